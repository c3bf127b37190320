"""Token-id files of independent zstandard frames with a seek table at the end.

Layout of a file (little-endian):

* one zstandard frame per document: its ids as unsigned 32-bit integers,
* one frame with the documents' ids (``doc_id``) as signed 64-bit integers,
* a skippable frame (magic 0x184D2A5E, length): per frame its compressed size, its decompressed
  size and the low 32 bits of XXH64 of the decompressed bytes, each an unsigned 32-bit integer;
  then the number of frames (unsigned 32-bit), a descriptor byte 0x80 and the magic 0x8F92EAB1.

This is the published seekable format of zstandard, so common tools read it too. A reader takes
the footer, the seek table and then only the byte ranges of the documents it wants; each frame
is checked against its checksum.

Files hold ranges of ascending ``doc_id``; within one, documents are in order of ``doc_id``, then
of a hash of the text. Rows of the same ``doc_id`` are kept, each with its own place. A null
``doc_id`` comes first and is stored as the smallest 64-bit integer; a null text has the end id
alone. A task writes a file of its own name, and only files named by the committed manifest
count, so a task that runs twice does no harm. Memory of a task: the longest document.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.flat import LOWER, IdStore, flatten, packed_words, slices, word_bounds
from tidewatch.llm.store import as_uri, file_system, new_folder

#: Of the seekable format (fixed values).
SKIPPABLE, SEEKABLE, DESCRIPTOR = 0x184D2A5E, 0x8F92EAB1, 0x80
NULL_ID = -(2**63)
ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("sum", "<u4")])


def checksum(raw: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF


class FrameWriter:
    """Writes one file, frame by frame."""

    def __init__(self, out, level: int = 3):
        import zstandard

        self.out, self.entries, self.doc_ids = out, [], []
        self.packer = zstandard.ZstdCompressor(level=level, write_content_size=True)

    def _frame(self, raw: bytes) -> None:
        packed = self.packer.compress(raw)
        if max(len(packed), len(raw)) >= 2**32:
            raise ValueError("a frame holds less than 4 GiB")
        self.out.write(packed)
        self.entries.append((len(packed), len(raw), checksum(raw)))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(NULL_ID if doc_id is None else doc_id)
        self._frame(ids.astype("<u4").tobytes())

    def close(self) -> None:
        self._frame(np.array(self.doc_ids, "<i8").tobytes())
        table = np.array(self.entries, ENTRY).tobytes() + struct.pack("<IBI", len(self.entries), DESCRIPTOR, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class FrameReader:
    """Reads single documents of a file; ``source`` has ``seek``, ``read`` and ``size``."""

    def __init__(self, source):
        import zstandard

        self.source, self.unpacker = source, zstandard.ZstdDecompressor()
        size = source.size()
        count, descriptor, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or descriptor != DESCRIPTOR:
            raise ValueError("no seek table at the end of the file")
        self.table = np.frombuffer(self._at(size - 9 - ENTRY.itemsize * count, ENTRY.itemsize * count), ENTRY)
        self.starts = np.r_[0, np.cumsum(self.table["packed"], dtype=np.int64)]
        self.doc_ids = np.frombuffer(self._frame(count - 1), "<i8")

    def _at(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _frame(self, i: int) -> bytes:
        raw = self.unpacker.decompress(self._at(int(self.starts[i]), int(self.table["packed"][i])), max_output_size=int(self.table["size"][i]))
        if checksum(raw) != self.table["sum"][i]:
            raise ValueError(f"frame {i} does not match its checksum")
        return raw

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, i: int) -> np.ndarray:
        """Ids of the document at place ``i``; no other document's frame is read."""
        return np.frombuffer(self._frame(i), "<u4")


@lru_cache(maxsize=2)
def _store(tokenizer_file: str) -> IdStore:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file)

    def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for ids in found for i in ids), np.int32, int(lengths.sum())), lengths

    return IdStore(encode)


#: Only these two cut words: the tokenizer drops them, and no rule of it looks across them.
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x0A]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def encode_texts(texts: pa.Array, tokenizer_file: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, ``end_id`` behind each, and the ids of each text.

    The tokenizer drops white space and applies its rules within words, so each distinct word is
    encoded once; a closing full stop or comma behind an ASCII letter or digit is a token of its
    own. Letters are lower-cased here, as the tokenizer does, unless a special token may occur.
    """
    data, starts = flatten(texts)
    if len(data):
        if b"<|" not in data.tobytes():
            data = LOWER[data]
        inside = ~_BLANK[data]
        begins, ends, _ = word_bounds(inside, starts)
        marks = np.flatnonzero((data[ends - 1] == 0x2E) | (data[ends - 1] == 0x2C))
        marks = marks[ends[marks] - begins[marks] > 1]
        marks = ends[marks[_ALNUM[data[ends[marks] - 2]]]] - 1
        begins = np.sort(np.r_[begins, marks])
        ends = np.sort(np.r_[ends, marks])
        raw, offsets = packed_words(data, inside, begins, ends)
        ids, lengths = _store(tokenizer_file).encode_all(raw, offsets)
        before = np.searchsorted(begins, starts)
    else:
        ids, lengths, before = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(len(starts), np.int64)
    counts = np.diff(np.r_[0, np.cumsum(lengths)][before]) + 1
    out = np.empty(len(ids) + len(counts), np.int32)
    last = np.cumsum(counts) - 1
    inner = np.ones(len(out), bool)
    inner[last] = False
    out[inner], out[last] = ids, end_id
    return out, counts


MANIFEST = "file string, first_id long, seq int, n_docs long, n_tokens long"


def write_token_files(
    docs: DataFrame, folder: str, tokenizer_file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", files: int | None = None
) -> DataFrame:
    """Tokenize and write ``docs`` in ascending id order; returns the manifest, one row per file.

    ``files``: how many ranges of ids; None takes the session's shuffle partitions.
    """
    spark = docs.sparkSession
    folder = as_uri(folder)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange(
        files or int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", F.xxhash64("text")
    ).sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered = ordered.withColumn("seq", F.spark_partition_id())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = file_system(folder)
        writer, out, first, seq, tokens = None, None, None, 0, 0
        for batch in batches:
            for part in slices(batch):
                if writer is None:
                    name = f"{uuid.uuid4().hex}.zst"
                    system.create_dir(inner, recursive=True)
                    out = system.open_output_stream(f"{inner}/{name}", compression=None)
                    writer, first, seq = FrameWriter(out), part.column("doc_id")[0].as_py(), part.column("seq")[0].as_py()
                ids, counts = encode_texts(part.column("text"), tokenizer_file, end_id)
                at = 0
                for doc_id, n in zip(part.column("doc_id").to_pylist(), counts.tolist()):
                    writer.add(doc_id, ids[at: at + n])
                    at += n
                tokens += at
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pylist([{
                "file": f"{folder}/{name}", "first_id": first, "seq": seq, "n_docs": len(writer.doc_ids), "n_tokens": tokens,
            }], pa.schema([("file", pa.string()), ("first_id", pa.int64()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    manifest = ordered.mapInArrow(work, MANIFEST)
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_documents(spark: SparkSession, folder: str, wanted: DataFrame | None = None) -> DataFrame:
    """(doc_id, start, ids) of all documents, or of those whose id is in ``wanted.doc_id``.

    ``start`` counts the ids of all documents before it. Of a file only the seek table, the ids'
    frame and the frames of wanted documents are read. ``wanted`` is joined by id range first,
    so only files that can hold a wanted id are opened.
    """
    return _read(spark, folder, wanted, "ids array<long>", lambda ids: pa.ListArray.from_arrays(
        pa.array(np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)), pa.array(np.concatenate([np.zeros(0, "<u4"), *ids]).astype(np.int64))))


def document_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files."""
    def crcs(ids):
        return pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())

    return _read(spark, folder, None, "ids_crc32 long", crcs)


def _read(spark: SparkSession, folder: str, wanted: DataFrame | None, column: str, summary) -> DataFrame:
    manifest = spark.read.schema(MANIFEST).parquet(f"{as_uri(folder)}/manifest")
    order = Window.orderBy("seq")  # one row per file
    placed = manifest.withColumn("base", F.sum("n_tokens").over(order) - F.col("n_tokens")).withColumn("next_id", F.lead("first_id").over(order))
    if wanted is None:
        placed = placed.withColumn("want", F.lit(None).cast("array<long>"))
    else:
        ids = wanted.select(F.col("doc_id").alias("want_id")).distinct()
        placed = placed.join(
            ids, (F.col("want_id") >= F.coalesce("first_id", F.lit(NULL_ID))) & (F.col("next_id").isNull() | (F.col("want_id") <= F.col("next_id")))
        ).groupBy("file", "base").agg(F.collect_list("want_id").alias("want"))
    placed = placed.select("file", "base", "want")
    files = placed.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "file")
    name = column.split()[0]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, inner = file_system(row["file"])
                with system.open_input_file(inner) as source:
                    reader = FrameReader(source)
                    starts = row["base"] + np.r_[0, np.cumsum(reader.table["size"][:-1] // 4, dtype=np.int64)]
                    places = np.arange(len(reader)) if row["want"] is None else np.flatnonzero(np.isin(reader.doc_ids, row["want"]))
                    for some in np.array_split(places, len(places) // 256 + 1):
                        ids = [reader.ids(i) for i in some.tolist()]
                        own = reader.doc_ids[some]
                        yield pa.RecordBatch.from_arrays([
                            pa.array(own, pa.int64(), mask=own == NULL_ID), pa.array(starts[some], pa.int64()),
                            pa.array([len(x) for x in ids], pa.int64()), summary(ids),
                        ], ["doc_id", "start", "n_tokens", name])

    return files.mapInArrow(work, f"doc_id long, start long, n_tokens long, {column}")


def encode_and_read_back(docs: DataFrame, tokenizer_file: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Write the files of ``docs`` (into the shared folder unless one is named) and read them back."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "token-files")
    write_token_files(docs, folder, tokenizer_file, end_id)
    return document_digests(spark, folder)
