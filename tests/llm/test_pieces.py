import hashlib
import random

import pyarrow as pa
import pytest
import sentencepiece
from corpora import ODD, as_set, clashing

from tidewatch.llm import pieces
from tidewatch.llm.queries import tokenizer_path

MODEL = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def awkward():
    rng = random.Random(4)
    alphabets = ["abcehint  \n.é日▁", "the in", "aa-=", "ab"]
    made = ["".join(rng.choice(a) for _ in range(rng.randrange(300))) for a in alphabets for _ in range(150)]
    return [t for _, t, *_ in ODD] + made + ["aaaa" * 500, "ab" * 2000, "=====-----=====" * 50, " " * 40, "\n\n\n", "<s>x</s>", "a▁b"]


def test_ids_are_the_library_s(library):
    texts = awkward()
    ids, counts = pieces.encode_texts(pa.array(texts, pa.string()), MODEL)
    at = 0
    for text, n in zip(texts, counts):
        assert ids[at: at + n].tolist() == [*library.encode(text or ""), 2], text
        at += n


def test_decoding_is_the_library_s(library):
    rng = random.Random(5)
    lists = [[rng.randrange(32000) for _ in range(30)] for _ in range(200)] + [[rng.randrange(3, 259) for _ in range(30)] for _ in range(200)] + [[], [2], [0]]
    import numpy as np

    table = pieces.PieceTable(MODEL)
    found = table.decode(np.concatenate([np.array(x, int) for x in lists]), np.array([len(x) for x in lists]))
    assert found == [library.decode(x).encode() for x in lists]


def test_columns_round_trip(spark, odd, library):
    encoded = pieces.encode_column(clashing(odd), MODEL)
    assert encoded.columns == ["doc_id", "ids"]
    decoded = pieces.decode_column(encoded, MODEL)
    assert as_set(decoded, "doc_id", "text") == sorted(
        [(d, library.decode(library.encode(t or ""))) for d, t, *_ in ODD], key=lambda r: [(v is not None, str(v)) for v in r])


def test_digests(odd, library):
    def digest(text):
        ids = [*library.encode(text or ""), 2]
        return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()

    expected = sorted([(d, *digest(t)) for d, t, *_ in ODD], key=lambda r: [(v is not None, str(v)) for v in r])
    assert as_set(pieces.round_trip(odd, MODEL), "*") == expected


def test_empty_table(empty):
    assert pieces.round_trip(empty, MODEL).count() == 0


def test_store_that_forgets_gives_the_same_ids():
    table = pieces.PieceTable(MODEL)
    small = pieces.IdStore(table.encode_words, most=3)
    import numpy as np

    for batch in ([b" a", b" bc", b" the"], [b" the", b" day", b" was", b" a"], [b" a", b" zzz", b" bc"]):
        data = np.frombuffer(b"".join(batch), np.uint8)
        ids, lengths = small.encode_all(data, np.cumsum([0, *map(len, batch)]))
        expected = [table.encode_words([w])[0].tolist() for w in batch]
        assert ids.tolist() == sum(expected, []) and lengths.tolist() == [len(e) for e in expected]
