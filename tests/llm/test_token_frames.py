import struct
import zlib

import numpy as np
import pytest
from corpora import ODD, as_set, clashing
from tokenizers import Tokenizer

from tidewatch.llm import token_frames
from tidewatch.llm.queries import tokenizer_path
from tidewatch.llm.store import file_system

FILE = tokenizer_path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(FILE)


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def test_ids_are_the_library_s():
    import random

    import pyarrow as pa

    rng = random.Random(3)
    texts = ["", None, "<|endoftext|>a", "A<|startoftext|>.", "it's.", "'s.", "a'.", "é.,", "x.́", "́ a", "ΑΣ. ΑΣ", "don't, 'VE'll", "a.b.c.", "1,2,3,", "İ,", "\x00."]
    texts += ["".join(rng.choice("ab'stdlm.,! \n\t1é́Σ|<>") for _ in range(rng.randrange(60))) for _ in range(1500)]
    ids, counts = token_frames.encode_texts(pa.array(texts, pa.string()), FILE, 2)
    at = 0
    for text, n in zip(texts, counts):
        assert ids[at: at + n].tolist() == ids_of(text), text
        at += n


def test_digests_read_back(odd):
    found = by_id(as_set(token_frames.encode_and_read_back(clashing(odd), FILE), "doc_id", "start", "n_tokens", "ids_crc32"))
    lengths = [(d, len(ids_of(t)), zlib.crc32(np.array(ids_of(t), "<u4").tobytes())) for d, t, *_ in ODD]
    assert sorted((str(d), n, c) for d, _, n, c in found) == sorted((str(d), n, c) for d, n, c in lengths)
    starts = sorted((s, n) for _, s, n, _ in found)
    assert [s for s, _ in starts] == np.cumsum([0, *(n for _, n in starts)])[:-1].tolist()
    ordered = [d for _, d in sorted((s, d) for d, s, *_ in found if d is not None)]
    assert ordered == sorted(ordered)
    assert all(s < 10**4 and d is None for d, s, *_ in found[:2])


def test_wanted_documents_only(spark, stored, tmp_path):
    folder = f"file://{tmp_path}/files"
    manifest = token_frames.write_token_files(stored, folder, FILE, 2, files=5)
    assert manifest.count() <= 5 and manifest.agg({"n_docs": "sum"}).first()[0] == stored.count()
    wanted = spark.createDataFrame([(3,), (150,), (151,), (10**9,)], "doc_id long")
    found = {r.doc_id: r.ids for r in token_frames.read_documents(spark, folder, wanted).collect()}
    texts = {r.doc_id: r.text for r in stored.where("doc_id in (3, 150, 151)").collect()}
    assert found == {d: ids_of(t) for d, t in texts.items()}


def test_format_and_checksum(stored, tmp_path):
    import zstandard

    folder = f"file://{tmp_path}/files"
    name = token_frames.write_token_files(stored, folder, FILE, 2, files=1).first()["file"]
    system, inner = file_system(name)
    raw = system.open_input_file(inner).read()
    count, descriptor, magic = struct.unpack("<IBI", raw[-9:])
    assert (magic, descriptor, count) == (0x8F92EAB1, 0x80, stored.count() + 1)
    table = np.frombuffer(raw[-9 - 12 * count: -9], "<u4").reshape(-1, 3)
    assert struct.unpack("<II", raw[table[:, 0].sum():][:8]) == (0x184D2A5E, 12 * count + 9)
    assert zstandard.ZstdDecompressor().decompressobj().decompress(raw[: table[0, 0]]) == np.array(
        ids_of(stored.orderBy("doc_id").first()["text"]), "<u4").tobytes()
    broken = bytearray(raw)
    broken[-9 - 12 * count + 8] ^= 1
    path = f"{tmp_path}/broken.bin"
    open(path, "wb").write(broken)
    with system.open_input_file(path) as source, pytest.raises(ValueError, match="checksum"):
        token_frames.FrameReader(source).ids(0)


def test_empty_table(empty):
    assert token_frames.encode_and_read_back(empty, FILE).count() == 0
