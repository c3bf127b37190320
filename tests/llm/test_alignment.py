import hashlib
import random
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
import pytest
import sentencepiece
from corpora import ODD, as_set, clashing, prose
from tokenizers import Tokenizer

from tidewatch.llm import alignment
from tidewatch.llm.queries import op12_alignment, tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=B)


def awkward():
    rng = random.Random(12)
    alphabets = ["abcehint  \n.é日", "the in'sre", "a \t\n\r\x0b\x0c\x1c\x1f", "a  b \u0085　    x", "12 .!-"]
    made = ["".join(rng.choice(a) for _ in range(rng.randrange(120))) for a in alphabets for _ in range(120)]
    return [t for _, t, *_ in ODD] + made + ["a▁b", "▁", "<|endoftext|> <s></s>", " ", "\n", "x" * 3000]


def tokens(text, libraries):
    """Ids and bytes of both tokenizers, or nothing where they do not give back the text."""
    first, second = libraries
    if not text:
        return [], []
    letters = alignment._byte_letters()
    a = [(i, bytes(letters[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in second.encode(text):
        piece = second.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    return (a, b) if all(b"".join(x for _, x in side) == whole for side in (a, b)) else ([], [])


def ends(side):
    out, at = [], 0
    for _, raw in side:
        at += len(raw)
        out.append(at)
    return out


def plain(texts, libraries):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of each text, one loop after another."""
    found, counts = [], Counter()
    for text in texts:
        a, b = tokens(text, libraries)
        end_a, end_b = ends(a), ends(b)
        a_at = {e: i for e, (i, _) in zip(end_a, a)}
        links = [(a_at[e], i) for e, (i, _) in zip(end_b, b) if e in a_at]
        cuts = sorted(set(end_a) & set(end_b))
        sides = []
        for side, at in ((a, end_a), (b, end_b)):
            per_group = [[] for _ in cuts]
            for (token, _), e in zip(side, at):
                per_group[bisect_left(cuts, e)].append(str(token))
            sides.append([",".join(x) for x in per_group])
        groups = ["|".join(x) for x in zip(*sides)]
        counts.update(links)
        found.append((len(a), len(b), len(cuts), links, ";".join(groups)))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [
        (n_a, n_b, n_groups, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links),
         hashlib.sha256(text.encode()).hexdigest() if text else "")
        for n_a, n_b, n_groups, links, text in found]


def test_byte_level_ids_are_the_library_s(libraries):
    texts = [" " + (t or "") for t in awkward()]
    ids, counts = alignment.byte_table(A).encode(pa.array(texts))
    at = 0
    for text, n in zip(texts, counts):
        assert ids[at: at + n].tolist() == libraries[0].encode(text, add_special_tokens=False).ids, repr(text)
        at += n


def check(frame, rows, libraries):
    found = as_set(alignment.align_corpus(frame, A, B), "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    expected = [(r[0], *p) for r, p in zip(rows, plain([r[1] for r in rows], libraries))]
    assert found == sorted(expected, key=lambda r: [(v is not None, str(v)) for v in r])


@pytest.mark.parametrize("hot", [1 << 19, 40, 0])
def test_rows(documents, libraries, monkeypatch, hot):
    monkeypatch.setattr(alignment, "HOT", hot)
    rows = [r for r in ODD if not r[1] or len(r[1]) < 6000] + [(100 + i, t) for i, t in enumerate(awkward()[14::9])]
    check(clashing(documents(rows)), rows, libraries)


def test_one_text_in_a_third_of_the_rows(documents, libraries):
    rows = [(i, prose(1, 40) if i % 3 == 0 else prose(i, 30)) for i in range(90)]
    check(documents(rows), rows, libraries)


def test_a_long_text(documents, libraries):
    rows = [(1, prose(5, 20000)), (2, "x" * 20000), (3, None)]
    frame = alignment.align_corpus(documents(rows), A, B).collect()
    expected = {r[0]: len(tokens(r[1], libraries)[0]) for r in rows}
    assert {r["doc_id"]: r["n_a"] for r in frame} == expected


def test_empty_table(empty):
    assert alignment.align_corpus(empty, A, B).count() == 0


def test_overlaps(documents, libraries):
    text = "unbelievable tokenisation, 12345 日本"
    rows = alignment.overlaps(documents([(4, text)]), A, B).collect()
    a, b = tokens(text, libraries)
    end_a, end_b = ends(a), ends(b)
    expected = []
    for (i, x), e in zip(a, end_a):
        for (j, y), f in zip(b, end_b):
            shared = min(e, f) - max(e - len(x), f - len(y))
            if shared > 0:
                expected.append((i, j, shared, e == f))
    assert [(r["a_id"], r["b_id"], r["shared"], r["together"]) for r in rows] == expected
    assert rows[0]["group"] == 0 and rows[-1]["group"] == len(set(end_a) & set(end_b)) - 1


def test_query_over_the_whole_table(spark, stored, libraries):
    found = {r["doc_id"]: tuple(r)[1:] for r in op12_alignment(spark, "/root/testdata/sf0.001").collect()}
    rows = [(r["doc_id"], r["text"]) for r in stored.select("doc_id", "text").collect()]
    assert found == {r[0]: p for r, p in zip(rows, plain([r[1] for r in rows], libraries))}
