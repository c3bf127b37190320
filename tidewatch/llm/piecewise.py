"""Document fingerprints by context-triggered piecewise hashing, compared by edit distance.

A hash rolls over the last ``WINDOW`` bytes of the UTF-8 text. Where its mixed value ends in
``level`` zero bits, a chunk of block size ``2 ** level`` ends, so boundaries follow the content
and survive edits elsewhere. A text's level is the largest at which it has ``LEAST`` boundaries
(shorter texts: ``LOWEST``). Each chunk gives one of 64 letters by a polynomial hash. The
fingerprint is ``level:letters:letters``, for the block size and twice that size; a signature has
at most ``MOST`` letters, and the last chunk then takes all the rest of the text, so every byte of
the text counts.

Likeness: signatures are compared where block sizes are compatible, that is equal or one the
double of the other. The edit distance with insertions and deletions of cost one gives
``1 - distance / (letters of both)``, provided the two share a run of ``RUN`` letters (or the whole
of a shorter one); the best of the comparable signatures counts, 0 without any. Equal fingerprints
are 1 alike. Signatures fit in a machine word, so distances of a whole batch are found by
bit-parallel longest common subsequences.

Texts: a null text is the empty one, whose fingerprint has no letters. Equal texts have equal
fingerprints. Tasks hold one slice of texts at a time, at least one text and its neighbour.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.flat import slices
from tidewatch.llm.store import written

WINDOW, LOWEST, LEAST, MOST, RUN = 7, 2, 32, 64, 4
LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_OF_LETTER = np.full(256, 255, np.uint8)
_OF_LETTER[LETTERS] = np.arange(64, dtype=np.uint8)
_TOP = 31
SLICE_BYTES = 2 << 20

# Odd multipliers of the two hashes; any would do.
_ROLL = [0x9E3779B1 * (2 * i + 1) ** 5 % 2**32 | 1 for i in range(WINDOW)]
_STEP = 0x9E3779B97F4A7C15
_BLOCK = 1 << 18


def _powers(base: int) -> np.ndarray:
    table = np.full(_BLOCK, base, np.uint64)
    table[0] = 1
    return np.multiply.accumulate(table)


_POWERS = _powers(_STEP)
_INVERSE = pow(_STEP, -1, 2**64)
_INVERSES = _powers(_INVERSE)


@dataclass
class Prints:
    """Fingerprints of a batch: levels, and per block size a matrix of letters and their numbers."""

    level: np.ndarray
    letters: tuple[np.ndarray, np.ndarray]
    lengths: tuple[np.ndarray, np.ndarray]

    def __getitem__(self, rows) -> Prints:
        return Prints(self.level[rows], tuple(x[rows] for x in self.letters), tuple(x[rows] for x in self.lengths))

    def texts(self) -> list[str]:
        shown = [LETTERS[np.minimum(x, 63)] for x in self.letters]
        return [
            f"{k}:{a[:m].tobytes().decode()}:{b[:n].tobytes().decode()}"
            for k, a, m, b, n in zip(self.level.tolist(), shown[0], self.lengths[0].tolist(), shown[1], self.lengths[1].tolist())
        ]


def parsed(texts: list[str]) -> Prints:
    """The fingerprints that :meth:`Prints.texts` wrote."""
    parts = [t.split(":") for t in texts]
    letters, lengths = [], []
    for i in (1, 2):
        n = np.fromiter((len(p[i]) for p in parts), np.int64, len(parts))
        matrix = np.full((len(parts), MOST), 255, np.uint8)
        matrix[np.arange(MOST) < n[:, None]] = _OF_LETTER[np.frombuffer("".join(p[i] for p in parts).encode(), np.uint8)]
        letters.append(matrix)
        lengths.append(n)
    return Prints(np.fromiter((int(p[0]) for p in parts), np.int64, len(parts)), tuple(letters), tuple(lengths))


def _boundaries(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places after which some chunk ends, and the highest level at which one does."""
    places, levels = [], []
    for at in range(0, len(flat), _BLOCK):
        low = max(0, at - WINDOW + 1)
        part = flat[low: at + _BLOCK].astype(np.uint32)
        roll = part * np.uint32(_ROLL[0])
        for i in range(1, WINDOW):
            roll[i:] += part[:-i] * np.uint32(_ROLL[i])
        roll ^= roll >> np.uint32(15)
        roll *= np.uint32(0x85EBCA6B)
        roll ^= roll >> np.uint32(13)
        roll *= np.uint32(0xC2B2AE35)
        roll ^= roll >> np.uint32(16)
        roll = roll[at - low:]
        found = np.flatnonzero((roll & np.uint32((1 << LOWEST) - 1)) == 0)
        value = roll[found]
        levels.append(np.minimum(np.bitwise_count((value & (~value + np.uint32(1))) - np.uint32(1)), _TOP))
        places.append(found + at)
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    return np.concatenate(places), np.concatenate(levels)


def _prefix_at(flat: np.ndarray, where: np.ndarray) -> np.ndarray:
    """The polynomial prefix sums of ``flat`` before the ascending places ``where``."""
    out = np.zeros(len(where), np.uint64)
    before, scale, step = np.uint64(0), 1, pow(_STEP, _BLOCK, 2**64)
    for at in range(0, len(flat), _BLOCK):
        part = (flat[at: at + _BLOCK].astype(np.uint64) + np.uint64(1)) * _POWERS[: min(_BLOCK, len(flat) - at)]
        sums = np.cumsum(part) * np.uint64(scale) + before
        a, b = np.searchsorted(where, [at, at + len(part)], "right")
        out[a:b] = sums[where[a:b] - at - 1]
        before, scale = sums[-1], scale * step % 2**64
    return out


def _inverse_power(of: np.ndarray) -> np.ndarray:
    blocks = of // _BLOCK
    far = np.ones(int(blocks.max(initial=0)) + 1, np.uint64)
    far[1:] = np.uint64(pow(_INVERSE, _BLOCK, 2**64))
    return _INVERSES[of % _BLOCK] * np.multiply.accumulate(far)[blocks]


def _signature(flat, starts, ends, owner, place, level, wanted):
    """Letters and their number for each text, at the level ``wanted`` of it."""
    n = len(starts)
    here = level >= wanted[owner]
    text, end = owner[here], place[here] + 1
    ordinal = np.arange(len(text)) - np.searchsorted(text, np.arange(n))[text]
    text, end = text[ordinal < MOST - 1], end[ordinal < MOST - 1]
    counts = np.bincount(text, minlength=n)
    last = np.where(counts > 0, np.r_[end, 0][np.cumsum(counts) - 1], starts)
    rest = np.flatnonzero(last < ends)
    text, end = np.r_[text, rest], np.r_[end, ends[rest]]
    order = np.argsort(text, kind="stable")
    text, end = text[order], end[order]
    counts = np.bincount(text, minlength=n)
    first = np.searchsorted(text, np.arange(n))
    ordinal = np.arange(len(text)) - first[text]
    start = np.where(ordinal == 0, starts[text], np.r_[0, end[:-1]][: len(end)])
    value = (_prefix_at(flat, end) - _prefix_at(flat, start)) * _inverse_power(start)
    value ^= value >> np.uint64(32)
    value *= np.uint64(0xD6E8FEB86659FD93)
    value ^= value >> np.uint64(32)
    value *= np.uint64(0xD6E8FEB86659FD93)
    letters = np.full((n, MOST), 255, np.uint8)
    letters[text, ordinal] = (value >> np.uint64(58)).astype(np.uint8)
    return letters, counts


def fingerprints(texts: list[bytes]) -> Prints:
    """Fingerprints of UTF-8 texts, all of them at once."""
    pad = b"\0" * WINDOW
    flat = np.frombuffer(pad + pad.join(texts) + pad, np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes + WINDOW)
    starts = ends - sizes
    place, level = _boundaries(flat)
    owner = np.searchsorted(ends, place, "right")
    inside = (owner < len(texts)) & (place >= np.r_[starts, 0][owner])
    owner, place, level = owner[inside], place[inside], level[inside].astype(np.int64)
    found = np.bincount(owner * (_TOP + 1) + level, minlength=len(texts) * (_TOP + 1)).reshape(len(texts), _TOP + 1)
    reached = np.cumsum(found[:, ::-1], axis=1)[:, ::-1] >= LEAST
    wanted = np.maximum(reached.sum(axis=1) - 1, LOWEST)
    one, two = (_signature(flat, starts, ends, owner, place, level, wanted + i) for i in (0, 1))
    return Prints(wanted, (one[0], two[0]), (one[1], two[1]))


def _alike(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Likeness of signatures, row by row."""
    out = np.zeros(len(x))
    for at in range(0, len(x), 512):
        a, b = x[at: at + 512], y[at: at + 512]
        same = (a[:, None, :] == b[:, :, None]) & (a < 64)[:, None, :]
        match = np.packbits(same, axis=2, bitorder="little").view("<u8")[:, :, 0]
        # Longest common subsequence: zero bits of v are places of a that are used.
        v = np.full(len(a), ~np.uint64(0))
        for j in range(MOST):
            used = v & match[:, j]
            v = (v + used) | (v - used)
        common = MOST - np.bitwise_count(v).astype(np.int64)
        least = np.minimum(np.minimum(nx[at: at + 512], ny[at: at + 512]), RUN)
        shared, run = np.zeros(len(a), np.int64), match
        for length in range(1, RUN + 1):
            shared[(run != 0).any(axis=1)] = length
            run = match[:, : MOST - length] & (run[:, 1:] >> np.uint64(1))
        total = nx[at: at + 512] + ny[at: at + 512]
        out[at: at + 512] = np.where((least > 0) & (shared >= least), 2 * common / np.maximum(total, 1), 0.0)
    return out


def likeness(a: Prints, b: Prints) -> np.ndarray:
    """Likeness of two batches of fingerprints, row by row, from 0 to 1."""
    out = np.zeros(len(a.level))
    apart = b.level - a.level
    for i, j, gap in ((0, 0, 0), (1, 1, 0), (1, 0, 1), (0, 1, -1)):
        rows = np.flatnonzero(apart == gap)
        found = _alike(a.letters[i][rows], a.lengths[i][rows], b.letters[j][rows], b.lengths[j][rows])
        out[rows] = np.maximum(out[rows], found)
    equal = (apart == 0) & np.all(a.letters[0] == b.letters[0], axis=1) & np.all(a.letters[1] == b.letters[1], axis=1)
    return np.where(equal, 1.0, out)


def fingerprint_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) for every row."""
    kept = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=SLICE_BYTES):
                prints = fingerprints(part.column("text").cast(pa.large_binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(prints.texts(), pa.string())], ["doc_id", "fingerprint"])

    return kept.mapInArrow(work, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def with_likeness(pairs: DataFrame, a_col: str, b_col: str, out_col: str = "likeness") -> DataFrame:
    """``pairs`` with the likeness of two columns of fingerprints; null where one is null."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in (a_col, b_col))
            known = [i for i in range(len(a)) if a[i] is not None and b[i] is not None]
            out: list[float | None] = [None] * len(a)
            for i, x in zip(known, likeness(parsed([a[i] for i in known]), parsed([b[i] for i in known])).tolist()):
                out[i] = x
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, out_col])

    return pairs.mapInArrow(work, StructType([*pairs.schema.fields, StructField(out_col, DoubleType())]))


DIGEST = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [part.split()[0] for part in DIGEST.split(", ")]


def _digests(ids: list, texts: list[str], following: list[str]) -> list[pa.Array]:
    """The columns of ``DIGEST`` for texts and the text that follows each of them."""
    edited = [(t[: len(t) - len(t) // 4] + f[: len(t) // 4]).encode() for t, f in zip(texts, following)]
    n = len(texts)
    # Where texts follow one another only the last of them is another text.
    chained = following[:-1] == texts[1:]
    prints = fingerprints([t.encode() for t in texts + (following[-1:] if chained else following)])
    own, after = prints[:n], prints[1: n + 1] if chained else prints[n:]
    changed = fingerprints(edited)
    return [
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
        pa.array(own.texts(), pa.string()), pa.array(changed.texts(), pa.string()),
        pa.array(likeness(own, changed)), pa.array(likeness(own, after)),
    ]


def edited_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint beside that of its edited text and of the next document's text.

    Rows stand in ascending order of id (null first; ties by a hash of the text, so rows that are
    wholly tied have equal texts). The edited text is the text with its last quarter (rounded
    down, in code points) replaced by the first as many of the row behind it; the first row stands
    behind the last one, a single row behind itself. Columns: ``DIGEST``, one row per input row.

    Texts are shuffled once, by ranges of that order with the row's place as the last key, so
    that repeated rows can be split. A task walks through its range; of its first and last row the
    text is written beside the digests, and the ends of neighbouring ranges are joined afterwards.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("place"), "text")
    order = [F.asc_nulls_first("doc_id"), F.asc("tie"), F.asc("place")]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def out(kind: str, columns: list[pa.Array], text: list[str | None]) -> pa.RecordBatch:
            n = len(columns[0])
            return pa.RecordBatch.from_arrays(
                [pa.array([kind] * n, pa.string()), pa.array([part] * n, pa.int32()), *columns, pa.array(text, pa.string())],
                ["kind", "part", *_NAMES, "text"])

        def end(kind: str, doc_id, text: str) -> pa.RecordBatch:
            return out(kind, [pa.array([doc_id], pa.int64()), *(pa.nulls(1, k) for k in _TYPES[1:])], [text])

        ids: list = []
        texts: list[str] = []
        for batch in batches:
            for piece in slices(batch, most=SLICE_BYTES):
                if not ids:
                    yield end("first", piece.column("doc_id")[0].as_py(), piece.column("text")[0].as_py())
                ids += piece.column("doc_id").to_pylist()
                texts += piece.column("text").to_pylist()
                if len(ids) > 1:
                    yield out("inner", _digests(ids[:-1], texts[:-1], texts[1:]), [None] * (len(ids) - 1))
                ids, texts = ids[-1:], texts[-1:]
        if ids:
            yield end("last", ids[0], texts[0])

    table = written(ordered.mapInArrow(walk, f"kind string, part int, {DIGEST}, text string"), "neighbours")
    ends = table.where("kind != 'inner'").select("kind", "part", "doc_id", "text")
    parts = sorted(r["part"] for r in ends.where("kind = 'first'").select("part").collect())  # at most one per range
    behind = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, behind int")
    firsts = ends.where("kind = 'first'").select(F.col("part").alias("behind"), F.col("text").alias("following"))
    open_rows = ends.where("kind = 'last'").join(F.broadcast(behind), "part").join(firsts, "behind").select("doc_id", "text", "following")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = [batch.column(c)[i].as_py() for c in ("doc_id", "text", "following")]
                yield pa.RecordBatch.from_arrays(_digests(*([x] for x in row)), _NAMES)

    return table.where("kind = 'inner'").select(*_NAMES).union(open_rows.mapInArrow(close, DIGEST))


_TYPES = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[part.split()[1]] for part in DIGEST.split(", ")]
