import hashlib
import random

import numpy as np
import pytest
from corpora import ODD, as_set, clashing, prose

from tidewatch.llm import piecewise
from tidewatch.llm.queries import op13_piecewise


def plain_levels(text: bytes):
    """For each byte the number of zero bits that the mixed rolling hash ends in."""
    out = []
    for at in range(len(text)):
        roll = sum(text[at - i] * piecewise._ROLL[i] for i in range(piecewise.WINDOW) if at >= i) % 2**32
        roll ^= roll >> 15
        roll = roll * 0x85EBCA6B % 2**32
        roll ^= roll >> 13
        roll = roll * 0xC2B2AE35 % 2**32
        roll ^= roll >> 16
        out.append(min((roll & -roll).bit_length() - 1 if roll else 32, 31))
    return out


def plain_signature(text: bytes, level: int, levels) -> str:
    ends = [i + 1 for i, x in enumerate(levels) if x >= level][: piecewise.MOST - 1]
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    letters = ""
    for a, b in zip([0, *ends], ends):
        value = sum((c + 1) * pow(piecewise._STEP, i, 2**64) for i, c in enumerate(text[a:b])) % 2**64
        for _ in range(2):
            value ^= value >> 32
            value = value * 0xD6E8FEB86659FD93 % 2**64
        letters += chr(piecewise.LETTERS[value >> 58])
    return letters


def plain_fingerprint(text: bytes) -> str:
    levels = plain_levels(text)
    level = max([k for k in range(32) if sum(x >= k for x in levels) >= piecewise.LEAST and k >= piecewise.LOWEST], default=piecewise.LOWEST)
    return f"{level}:{plain_signature(text, level, levels)}:{plain_signature(text, level + 1, levels)}"


def plain_alike(a: str, b: str) -> float:
    """By the table of edit distances, a change of a letter costing two."""
    run = min(len(a), len(b), piecewise.RUN)
    if not run or not any(a[i: i + run] in b for i in range(len(a) - run + 1)):
        return 0.0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] if x == y else 1 + min(row[j], new[-1]))
        row = new
    return 1 - row[-1] / (len(a) + len(b))


def plain_likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    (k, *x), (m, *y) = a.split(":"), b.split(":")
    best = 0.0
    for i in (0, 1):
        for j in (0, 1):
            if int(k) + i == int(m) + j:
                best = max(best, plain_alike(x[i], y[j]))
    return best


def some_texts():
    rng = random.Random(8)
    made = [prose(i, rng.randrange(1, 400)).encode() for i in range(40)]
    return made + [b"", b"x", b"a" * 3000, b"ab" * 900, b"\0" * 500, bytes(rng.randrange(256) for _ in range(2500))] + [made[0] + made[1], made[0][:-9]]


def test_fingerprints_match_a_plain_computation():
    texts = some_texts()
    assert piecewise.fingerprints(texts).texts() == [plain_fingerprint(t) for t in texts]


def test_blocks_do_not_show(monkeypatch):
    texts = some_texts()
    whole = piecewise.fingerprints(texts).texts()
    monkeypatch.setattr(piecewise, "_BLOCK", 64)
    assert piecewise.fingerprints(texts).texts() == whole


def test_likeness_matches_a_plain_computation():
    prints = piecewise.fingerprints(some_texts())
    shown = prints.texts()
    assert piecewise.parsed(shown).texts() == shown
    for i in range(len(shown)):
        found = piecewise.likeness(prints[np.full(len(shown), i)], prints)
        assert found.tolist() == pytest.approx([plain_likeness(shown[i], s) for s in shown])


def test_edits_are_found_and_other_texts_are_not():
    texts = [prose(i, 300) for i in range(60)]
    cut = [t[: len(t) * 3 // 4] + texts[i - 1][: len(t) // 4] for i, t in enumerate(texts)]
    a, b = (piecewise.fingerprints([t.encode() for t in x]) for x in (texts, cut))
    assert piecewise.likeness(a, b).min() > 0.5
    assert piecewise.likeness(a[np.arange(59)], a[np.arange(1, 60)]).max() < 0.5


def plain_rows(rows):
    """The whole result of a table whose order is fixed by its ids."""
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    out = []
    for i, (doc_id, text, *_) in enumerate(ordered):
        text, after = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        k = len(text) // 4
        edited = (text[: len(text) - k] + after[:k]).encode()
        a, b, c = (plain_fingerprint(t) for t in (text.encode(), edited, after.encode()))
        out.append((doc_id, len(text), hashlib.sha256(edited).hexdigest(), a, b, round(plain_likeness(a, b), 9), round(plain_likeness(a, c), 9)))
    return sorted(out, key=lambda r: [(v is not None, str(v)) for v in r])


def rounded(df):
    return sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in as_set(df, *piecewise._NAMES)), key=lambda r: [(v is not None, str(v)) for v in r])


#: Ids that occur once, so the order of rows is fixed; the last has the long text behind it.
ONCE = [r for i, r in enumerate(ODD) if i and r[0] is not None and r[0] != 8]


@pytest.mark.parametrize("partitions", [1, 7])
def test_neighbours(documents, partitions):
    frame = clashing(documents(ONCE, partitions))
    assert rounded(piecewise.edited_neighbours(frame)) == plain_rows(ONCE)


def test_one_row_follows_itself(documents):
    assert rounded(piecewise.edited_neighbours(documents([(3, "abcdefgh")]))) == plain_rows([(3, "abcdefgh")])


def test_empty_table(empty):
    assert piecewise.edited_neighbours(empty).count() == 0


def test_ties_and_repeated_rows_keep_their_number(odd):
    found = piecewise.edited_neighbours(odd).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r[0]) for r in ODD)
    prints = {r[1] or "": plain_fingerprint((r[1] or "").encode()) for r in ODD}
    assert {r["fingerprint"] for r in found} == set(prints.values())


def test_a_third_of_the_rows_under_one_id(documents, spark):
    rows = [(7, prose(i % 5, 30)) for i in range(300)] + [(i + 100, prose(i, 30)) for i in range(600)]
    found = piecewise.edited_neighbours(documents(rows))
    assert found.count() == 900
    assert {r["fingerprint"] for r in found.where("doc_id = 7").collect()} == {plain_fingerprint(prose(i, 30).encode()) for i in range(5)}


def test_columns_and_likeness(documents):
    prints = piecewise.fingerprint_column(documents([(1, "one text"), (2, None)]))
    assert as_set(prints, "*") == [(1, plain_fingerprint(b"one text")), (2, plain_fingerprint(b""))]
    pairs = prints.select("doc_id", "fingerprint", prints["fingerprint"].alias("other"))
    assert [r[0] for r in piecewise.with_likeness(pairs, "fingerprint", "other").select("likeness").collect()] == [1.0, 1.0]


def test_query_over_the_whole_table(spark, stored):
    found = op13_piecewise(spark, "/root/testdata/sf0.001").collect()
    rows = [(r["doc_id"], r["text"]) for r in stored.select("doc_id", "text").collect()]
    assert len(found) == len(rows)
    expected = {r[0]: r[2] for r in plain_digest_only(rows)}
    assert {r["doc_id"]: r["edited_sha256"] for r in found} == expected
    assert sum(r["near_edited"] > 0.5 for r in found) > 0.9 * len(found)


def plain_digest_only(rows):
    ordered = sorted(rows)
    for i, (doc_id, text) in enumerate(ordered):
        k, after = len(text) // 4, ordered[(i + 1) % len(ordered)][1]
        yield doc_id, len(text), hashlib.sha256((text[: len(text) - k] + after[:k]).encode()).hexdigest()
