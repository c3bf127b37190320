"""Alignment of two tokenizers over the same texts, by interval coalescing.

Tokenizer A is a byte-level BPE, B a SentencePiece BPE; A is given a space before the text, which
B puts there itself, so both cut the same bytes. The tokens of both are intervals of bytes. All
intervals of a slice of texts are sorted by start (``lexsort``) and their ends accumulated to a
running maximum: where a start reaches it, a new group begins, which is where tokens of A and of B
end together. Within a group the pairs of A and B tokens that overlap are expanded. Those that
end together are links.

A pair of ids is counted over all links of the corpus. Per document its links are compared with
these counts: the sum of the counts, and how many links are their B id's most frequent pair (ties
included). The counts of frequent pairs go to every task, at most ``HOT`` of them; links of the
other pairs are joined with theirs by a shuffle.

A text that is null or empty, or whose tokens do not give back its bytes (such as one holding the
character that B writes for a space), has no tokens: all numbers are 0 and the digest is ''. Every
row gives one row, repeated rows each their own. A task holds a slice of texts, one text at least.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import pieces
from tidewatch.llm.flat import IdStore, flatten, gather, slices
from tidewatch.llm.store import written

#: Pairs whose counts every task holds (about 9 MB).
HOT = 1 << 19
#: Words whose pieces a worker remembers, and text it takes at a time.
WORDS_KEPT = 250_000
TEXT_BYTES = 1 << 19

#: How a byte-level tokenizer cuts words (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A stretch without ASCII white space that is longer is left to the library that merges it in a heap.
LONG_STRETCH = 2_000
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def _byte_letters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary, and that byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteTable:
    """Token bytes and ids of a byte-level BPE tokenizer file.

    Its vocabulary stands in the order of the merges, so it is also a table of ranks by which
    ``tiktoken`` finds the same ids several times faster. Raises ValueError if probes say otherwise.
    """

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.size = self.tokenizer.get_vocab_size()
        letters = _byte_letters()
        blobs = [b""] * self.size
        special = {i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        for token, i in self.tokenizer.get_vocab().items():
            if i not in special:
                blobs[i] = bytes(letters[c] for c in token)
        self.blob = np.frombuffer(b"".join(blobs), np.uint8)
        self.blob_lengths = np.array([len(b) for b in blobs], np.int64)
        self.blob_starts = np.cumsum(self.blob_lengths) - self.blob_lengths
        ranks = {b: i for i, b in enumerate(blobs) if b}
        self.ranked = tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        probes = [" a  b c's\n\n d ", " x\u00a0 \u00a0y \u3000z 12 ...!\u2003 w\u0085 v\x1c u", "  \u00e9\t\u65e5 \u672c", " <|endoftext|> unbelievable", "y" * 40]
        for probe in probes:
            if self.ranked.encode_to_numpy(probe, disallowed_special=()).tolist() != self.tokenizer.encode(probe, add_special_tokens=False).ids:
                raise ValueError(f"{tokenizer_file}: its vocabulary does not rank its merges")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the ids of each text."""
        data, starts = flatten(texts)
        cuts = np.sort(np.r_[np.flatnonzero(_BLANK[data]), starts], kind="stable")
        gaps = np.diff(cuts)
        long = np.unique(np.searchsorted(starts, cuts[:-1][gaps > LONG_STRETCH], "right") - 1)
        slow = np.zeros(len(texts), bool)
        slow[long] = True
        parts = [
            np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.int64) if heap
            else self.ranked.encode_to_numpy(t, disallowed_special=()).astype(np.int64)
            for t, heap in zip(texts.to_pylist(), slow.tolist())
        ]
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        return np.concatenate([np.zeros(0, np.int64), *parts]), counts


@lru_cache(maxsize=2)
def byte_table(tokenizer_file: str) -> ByteTable:
    return ByteTable(tokenizer_file)


class PieceWords:
    """Piece ids of texts; words seen before are looked up."""

    def __init__(self, model_file: str):
        self.table = pieces.PieceTable(model_file)
        self.store = IdStore(self.table.encode_words, WORDS_KEPT)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that begin with the space the library puts there, and the ids of each text."""
        data, starts = flatten(pc.replace_substring(texts, pieces.SPACE, " "))
        space = data == 0x20
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[starts[:-1][starts[1:] > starts[:-1]]] = True
        offsets = np.r_[np.flatnonzero(begins), len(data)]
        ids, lengths = self.store.encode_all(data, offsets)
        return ids, np.diff(np.r_[0, np.cumsum(lengths)][np.searchsorted(offsets[:-1], starts)])


@lru_cache(maxsize=2)
def piece_words(model_file: str) -> PieceWords:
    return PieceWords(model_file)


@dataclass
class Aligned:
    """The tokens of a slice of texts and how they meet. Places count the tokens of the slice."""

    a_ids: np.ndarray
    b_ids: np.ndarray
    a_text: np.ndarray  # text of each token
    b_text: np.ndarray
    a_group: np.ndarray  # group of each token, numbered through the slice
    b_group: np.ndarray
    a: np.ndarray  # overlapping pairs, as places of tokens
    b: np.ndarray
    together: np.ndarray  # whether both end at one byte
    shared: np.ndarray  # bytes in common


def _of_texts(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, weights=values, minlength=n).astype(np.int64)


def _given_back(table, ids, owner, lengths, good: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which of the ``good`` texts, whose tokens are as long as they are, consist of their tokens' bytes."""
    kept = good[owner]
    differ = gather(table.blob, table.blob_starts[ids[kept]], lengths[kept]) != data[np.repeat(good, sizes)]
    out = good.copy()
    if differ.any():
        out[np.repeat(np.flatnonzero(good), sizes[good])[differ]] = False
    return out


def align(texts: pa.Array, a_file: str, b_file: str) -> Aligned:
    """Encode texts by both tokenizers and align the tokens."""
    first = byte_table(a_file)
    second = piece_words(b_file)
    n = len(texts)
    filled = pc.fill_null(texts.cast(pa.large_string()), "")
    given = pc.if_else(pc.equal(filled, ""), filled, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), filled, pa.scalar("", pa.large_string())))
    data, starts = flatten(given)
    sizes = np.diff(starts)

    sides = []
    for table, (ids, counts) in ((first, first.encode(given)), (second.table, second.encode(given))):
        owner = np.repeat(np.arange(n), counts)
        sides.append((table, ids.astype(np.int64), owner, table.blob_lengths[ids]))
    good = sizes > 0
    for _, _, owner, lengths in sides:
        good &= _of_texts(lengths, owner, n) == sizes
    good = _given_back(*sides[0], good, data, sizes) & _given_back(*sides[1], good, data, sizes)
    (ids_a, text_a, len_a), (ids_b, text_b, len_b) = ((i[good[o]], o[good[o]], x[good[o]]) for _, i, o, x in sides)

    end_a, end_b = np.cumsum(len_a), np.cumsum(len_b)
    start_a, start_b = end_a - len_a, end_b - len_b
    start, end = np.r_[start_a, start_b], np.r_[end_a, end_b]
    order = np.lexsort((np.repeat([0, 1], [len(ids_a), len(ids_b)]), start))
    reached = np.maximum.accumulate(end[order]) if len(order) else end
    breaks = np.r_[True, start[order][1:] >= reached[:-1]][: len(order)]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks) - 1

    low = np.searchsorted(end_b, start_a, "right")
    high = np.searchsorted(start_b, end_a, "left")
    a = np.repeat(np.arange(len(ids_a)), high - low)
    b = gather(np.arange(len(ids_b)), low, high - low)
    shared = np.minimum(end_a[a], end_b[b]) - np.maximum(start_a[a], start_b[b])
    return Aligned(ids_a, ids_b, text_a, text_b, group[: len(ids_a)], group[len(ids_a):], a, b, end_a[a] == end_b[b], shared)


@lru_cache(maxsize=1)
def _shown(size: int) -> np.ndarray:
    """Decimal ids with each sign that may follow: 4 * id + (comma, bar, semicolon, nothing)."""
    return np.array([str(i).encode() + s for i in range(size) for s in (b",", b"|", b";", b"")], object)


def group_texts(found: Aligned, n: int, size: int) -> list[bytes]:
    """``a1,a2|b1;a3|b2`` of each of the ``n`` texts: ids of a group's A tokens, then of its B tokens."""
    ids, text = np.r_[found.a_ids, found.b_ids], np.r_[found.a_text, found.b_text]
    key = 2 * np.r_[found.a_group, found.b_group]
    key[len(found.a_ids):] += 1
    order = np.argsort(key, kind="stable")
    ids, text, key = ids[order], text[order], key[order]
    behind = np.r_[key[1:], -1]
    sign = np.where(behind == key, 0, 1 + key % 2)
    sign[text != np.r_[text[1:], -1]] = 3
    shown = _shown(size)[4 * ids + sign].tolist()
    ends = np.searchsorted(text, np.arange(n + 1))
    return [b"".join(shown[i:j]) for i, j in zip(ends.tolist(), ends[1:].tolist())]


_NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]
STORED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def alignments(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``STORED``: per row the tokens, groups and links, the digest of the groups, and the linked pairs.

    A pair is ``a_id * size + b_id`` with the size of B's vocabulary; ``times`` says how often each
    distinct pair is linked in the text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size_a, size_b = byte_table(a_file).size, piece_words(b_file).table.size
        for batch in batches:
            for part in slices(batch, most=TEXT_BYTES):
                n = part.num_rows
                found = align(part.column("text"), a_file, b_file)
                link_text = found.a_text[found.a[found.together]]
                code = found.a_ids[found.a[found.together]] * size_b + found.b_ids[found.b[found.together]]
                distinct, times = np.unique(link_text * (size_a * size_b) + code, return_counts=True)
                bounds = np.searchsorted(distinct, np.arange(n + 1) * (size_a * size_b)).astype(np.int32)
                # A group lies in one text; its last A token tells which.
                last = np.flatnonzero(np.r_[found.a_group[1:] != found.a_group[:-1], True][: len(found.a_group)])
                numbers = [np.bincount(x, minlength=n) for x in (found.a_text, found.b_text, found.a_text[last], link_text)]
                texts = group_texts(found, n, max(size_a, size_b))
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), *(pa.array(x, pa.int64()) for x in numbers),
                    pa.array([hashlib.sha256(t).hexdigest() if t else "" for t in texts], pa.string()),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(distinct % (size_a * size_b))),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(times, pa.int64())),
                ], ["doc_id", *_NUMBERS, "groups_sha256", "pairs", "times"])

    return rows.mapInArrow(work, STORED)


def overlaps(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, group, a_id, b_id, shared, together): every overlapping pair of tokens.

    ``group`` counts the groups of the text from 0, ``shared`` the bytes in common; ``together``
    tells a link. In the order of the text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=TEXT_BYTES):
                found = align(part.column("text"), a_file, b_file)
                text, group = found.a_text[found.a], found.a_group[found.a]
                first = group[np.searchsorted(text, text)] if len(text) else group
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id").take(pa.array(text)), pa.array(group - first), pa.array(found.a_ids[found.a]),
                    pa.array(found.b_ids[found.b]), pa.array(found.shared), pa.array(found.together),
                ], ["doc_id", "group", "a_id", "b_id", "shared", "together"])

    return rows.mapInArrow(work, "doc_id long, group long, a_id long, b_id long, shared long, together boolean")


def pair_counts(stored: DataFrame, size_b: int) -> DataFrame:
    """(pair, count, best): links of each pair in the corpus; whether no pair of its B id has more."""
    links = stored.select(F.inline(F.arrays_zip("pairs", "times")))
    counts = links.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("count"))
    counts = written(counts, "pair-counts")
    highest = counts.groupBy((F.col("pair") % size_b).alias("b")).agg(F.max("count").alias("highest"))
    joined = counts.join(F.broadcast(highest), F.col("pair") % size_b == F.col("b"))  # at most B's vocabulary
    return joined.select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def _least_hot(counts: DataFrame) -> tuple[int, bool]:
    """The power of two from which pairs are hot, so that at most ``HOT`` are, and whether all are."""
    sizes = {r["bits"]: r["n"] for r in counts.groupBy(F.length(F.bin("count")).alias("bits")).agg(F.count("*").alias("n")).collect()}
    total, least = 0, 64
    for bits in sorted(sizes, reverse=True):  # at most 63 of them
        total += sizes[bits]
        if total > HOT:
            return least, False
        least = bits
    return least, True


DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align_corpus(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``DIGEST``, one row per row of ``docs``."""
    spark = docs.sparkSession
    size_b = pieces.PieceTable(b_file).size
    stored = written(alignments(docs, a_file, b_file, id_col, text_col), "alignments")
    counts = written(pair_counts(stored, size_b), "pair-counts")
    bits, all_hot = _least_hot(counts)
    hot = counts.where(F.length(F.bin("count")) >= bits).toArrow()  # at most HOT rows
    order = np.argsort(hot.column("pair").to_numpy())
    known = spark.sparkContext.broadcast(tuple(hot.column(c).to_numpy()[order] for c in ("pair", "count", "best")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, count, best = known.value
        for batch in batches:
            pairs, times = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("pairs", "times"))
            lengths = batch.column("pairs").value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), lengths)
            at = np.minimum(np.searchsorted(pair, pairs), max(len(pair) - 1, 0))
            hit = pair[at] == pairs if len(pair) else np.zeros(len(pairs), bool)
            sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
            np.add.at(sums[0], row[hit], np.where(best[at[hit]], times[hit], 0))
            np.add.at(sums[1], row[hit], times[hit] * count[at[hit]])
            bounds = np.r_[0, np.cumsum(np.bincount(row[~hit], minlength=batch.num_rows))].astype(np.int32)
            cold = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(x[~hit], pa.int64())) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("row", "doc_id", *_NUMBERS)), *map(pa.array, sums), batch.column("groups_sha256"), *cold],
                ["row", "doc_id", *_NUMBERS, "n_best", "count_sum", "groups_sha256", "cold", "cold_times"])

    numbered = stored.withColumn("row", F.monotonically_increasing_id())
    scored = numbered.mapInArrow(work, f"row long, {DIGEST}, cold array<long>, cold_times array<long>")
    names = [part.split()[0] for part in DIGEST.split(", ")]
    if all_hot:
        return scored.select(*names)
    scored = written(scored, "scored")
    rest = scored.select("row", F.inline(F.arrays_zip("cold", "cold_times"))).join(counts, F.col("cold") == F.col("pair"))
    rest = rest.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("cold_times")).otherwise(F.lit(0))).alias("more_best"),
        F.sum(F.col("cold_times") * F.col("count")).alias("more_sum"))
    whole = scored.join(rest, "row", "left").withColumns({
        "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
    return whole.select(*names)
