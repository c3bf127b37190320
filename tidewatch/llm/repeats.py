"""Removal of repeated passages: every byte inside a string of ``length`` bytes seen earlier goes.

A byte goes exactly if it lies in some ``length``-byte string of its document that also starts at
an earlier place, in a document of smaller id or before in the same one. In terms of the longest
previous factor (LPF) of a place, the longest string from there that also starts earlier: the
bytes [p, p + length) go for every p with LPF(p) >= length.

The suffix order of all places need not be built. Of each window of ``length`` bytes the seed
(run of ``SEED`` bytes) with the least hash is its anchor, the leftmost of equals. Equal windows
have the same anchor at the same offset, so only windows of equal anchors are compared, and
anchors are few: about 2 / (length - SEED + 2) of all places. The windows of one anchor are
consecutive, and the stretch of text they cover is its context.

1. Anchors (hash of the seed, hash of the context, place) are shuffled by seed. An anchor whose
   seed and context occur earlier has LPF >= length at all its windows. Repeats within a slice of
   the scan are settled before the shuffle, so a passage of very many documents sends one anchor
   per slice.
2. Anchors whose seed occurs with several contexts lie at the edges of repeats. For those the
   contexts themselves are shuffled by seed, their windows are put in suffix order (by prefix
   doubling, as far as ``length`` bytes), and the previous and next smaller place within each run
   of equal windows tell whether LPF >= length.
3. Covered windows are joined to their documents, united, and cut out.

Places are compared by (doc_id, hash of the text, offset); null ids come first, a null text is
empty. Of rows equal in id and text the first is treated as such and the others are repeats of
it. Context hashes have 64 bits within one seed's anchors. Tasks hold one slice of text, or the
anchors of one range of seeds, whose number is set by the size of the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.flat import flatten, gather, slices
from tidewatch.llm.store import written

SEED = 32
#: Text bytes whose anchors make up one group of the first shuffle, and anchors per group of the second.
GROUP_BYTES = 16 << 20
GROUP_ANCHORS = 8_000
#: Text taken at a time: the rolling hashes need some hundred bytes for each of it.
SCAN_BYTES = 1 << 20
_NULL_ID = -(2**63)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_CODE = np.random.default_rng(20240607).integers(1, 2**64 - 1, 256, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class RollingHash:
    """Hashes of any stretch of ``data`` from running sums of coded bytes times powers of a base."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        powers = np.full(n, _BASE, np.uint64)
        self.inverse = np.full(n, _INVERSE, np.uint64)
        if n:
            powers[0] = self.inverse[0] = 1
        powers = np.multiply.accumulate(powers)
        self.inverse = np.multiply.accumulate(self.inverse)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_CODE[data] * powers, out=self.sums[1:])

    def runs(self, width: int) -> np.ndarray:
        """The hash of the ``width`` bytes from each place that has so many."""
        n = len(self.sums) - width
        return _mix((self.sums[width:] - self.sums[:n]) * self.inverse[:n])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.inverse[starts]


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the place of its least, the leftmost of equals."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    blocks = -(-len(values) // width)
    grid = np.full(blocks * width, np.uint64(2**64 - 1))
    grid[: len(values)] = values
    grid = grid.reshape(blocks, width)
    place = np.arange(blocks * width, dtype=np.int64).reshape(blocks, width)
    tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1]
    tail_at = np.minimum.accumulate(np.where(grid == tail, place, np.int64(2**62))[:, ::-1], axis=1)[:, ::-1].ravel()
    head = np.minimum.accumulate(grid, axis=1)
    lower = np.ones_like(grid, bool)
    lower[:, 1:] = grid[:, 1:] < head[:, :-1]
    head_at = np.maximum.accumulate(np.where(lower, place, -1), axis=1).ravel()
    tail, head = tail.ravel()[:n], head.ravel()[width - 1: width - 1 + n]
    return np.where(tail <= head, tail_at[:n], head_at[width - 1: width - 1 + n])


def anchors(data: np.ndarray, starts: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Anchors of the texts in ``data`` cut at ``starts``.

    ``doc``: the text; ``at``: the anchor's offset in it; ``lo`` and ``hi``: first and last start of
    its windows; ``seed`` and ``context``: hashes of the seed and of [lo, hi + length).
    """
    sizes = np.diff(starts)
    doc = np.repeat(np.arange(len(sizes)), np.maximum(sizes - length + 1, 0))
    empty = np.zeros(0, np.int64)
    if not len(doc):
        return {k: empty for k in ("doc", "at", "lo", "hi")} | {k: empty.astype(np.uint64) for k in ("seed", "context")}
    hashes = RollingHash(data)
    seeds = hashes.runs(SEED)
    first = np.cumsum(np.maximum(sizes - length + 1, 0)) - np.maximum(sizes - length + 1, 0)
    window = np.arange(len(doc)) - first[doc] + starts[doc]
    at = least_places(seeds, length - SEED + 1)[window]
    fresh = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])])
    last = np.r_[fresh[1:], len(doc)] - 1
    at, lo, hi, doc = at[fresh], window[fresh], window[last], doc[fresh]
    context = hashes.of(lo, hi + length) * np.uint64(0x2545F4914F6CDD1D) + ((at - lo) * 2**20 + (hi - lo)).astype(np.uint64)
    begin = starts[doc]
    return {"doc": doc, "at": at - begin, "lo": lo - begin, "hi": hi - begin, "seed": seeds[at], "context": _mix(context)}


_FIELDS = [("seed", np.uint64), ("context", np.uint64), ("doc_id", np.int64), ("tie", np.int64), ("at", np.int64), ("lo", np.uint8), ("hi", np.uint8)]


def _packed(rows: dict[str, np.ndarray]) -> bytes:
    """Columns one after another; those that compress are compressed."""
    import zstandard

    n = len(rows["seed"])
    plain = n.to_bytes(8, "little") + rows["seed"].tobytes() + rows["context"].tobytes()
    rest = b"".join(np.diff(rows[f], prepend=rows[f].dtype.type(0)).tobytes() for f, _ in _FIELDS[2:])
    return plain + zstandard.ZstdCompressor(level=1).compress(rest)


def _unpacked(blobs: list[bytes]) -> dict[str, np.ndarray]:
    import zstandard

    parts = []
    for blob in blobs:
        n = int.from_bytes(blob[:8], "little")
        rest, at, row = zstandard.ZstdDecompressor().decompress(blob[8 + 16 * n:]), 0, {}
        row["seed"], row["context"] = np.frombuffer(blob, np.uint64, n, 8), np.frombuffer(blob, np.uint64, n, 8 + 8 * n)
        for name, kind in _FIELDS[2:]:
            row[name] = np.cumsum(np.frombuffer(rest, kind, n, at), dtype=kind)
            at += n * np.dtype(kind).itemsize
        parts.append(row)
    return {name: np.concatenate([p[name] for p in parts]) for name, _ in _FIELDS}


def _repeated(rows: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Rows in order of (seed, context, place); which repeat an earlier context; which are edges."""
    order = np.lexsort((rows["at"], rows["tie"], rows["doc_id"], rows["context"], rows["seed"]))
    rows = {k: v[order] for k, v in rows.items()}
    same_seed = rows["seed"][1:] == rows["seed"][:-1]
    same = same_seed & (rows["context"][1:] == rows["context"][:-1])
    twin = same & (rows["doc_id"][1:] == rows["doc_id"][:-1]) & (rows["tie"][1:] == rows["tie"][:-1]) & (rows["at"][1:] == rows["at"][:-1])
    keep = np.r_[True, ~twin] if len(order) else np.zeros(0, bool)
    if not keep.all():  # equal rows of the table
        return _repeated({k: v[keep] for k, v in rows.items()})
    repeat = np.r_[False, same][: len(order)]
    other = same_seed & ~same
    group = np.cumsum(np.r_[True, ~same_seed])[: len(order)] - 1
    several = np.zeros(int(group[-1]) + 1 if len(group) else 0, bool)
    several[group[1:][other]] = True
    return rows, repeat, several[group] & ~repeat


def _keyed(docs: DataFrame, id_col: str, text_col: str, ties: bool) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID))
    return docs.select(key.alias("key"), (F.xxhash64(text) if ties else F.lit(0).cast("long")).alias("tie"), text.alias("text"))


_FOUND = "edge boolean, key long, tie long, seed long, at long, lo long, hi long"


def scan_anchors(rows: DataFrame, length: int, groups: int) -> DataFrame:
    """Step 1: anchors that repeat an earlier context (``edge`` false) and those at edges."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=SCAN_BYTES):
                found = anchors(*flatten(part.column("text")), length)
                if not len(found["doc"]):
                    continue
                doc = found.pop("doc")
                found["doc_id"], found["tie"] = part.column("key").to_numpy()[doc], part.column("tie").to_numpy()[doc]
                found["lo"], found["hi"] = (found["at"] - found["lo"]).astype(np.uint8), (found["at"] - found["hi"]).astype(np.uint8)
                sorted_rows, repeat, _ = _repeated(found)
                group = (sorted_rows["seed"] >> np.uint64(20)) % np.uint64(groups)
                # Settled repeats travel as such: their group is negative.
                order = np.lexsort((sorted_rows["at"], sorted_rows["doc_id"], group, repeat))
                bounds = np.flatnonzero(np.r_[True, np.diff(group[order].astype(np.int64)) != 0, True] | np.r_[True, np.diff(repeat[order].astype(int)) != 0, True])
                blobs, names = [], []
                for a, b in zip(bounds[:-1], bounds[1:]):
                    some = order[a:b]
                    blobs.append(_packed({k: v[some] for k, v in sorted_rows.items()}))
                    names.append(int(group[some[0]]) if not repeat[some[0]] else -1 - int(group[some[0]]))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], ["grp", "blob"])

    def settle(table: pa.Table) -> pa.Table:
        found = _unpacked(table.column("blob").to_pylist())
        if table.column("grp")[0].as_py() < 0:
            repeat, edge = np.ones(len(found["seed"]), bool), np.zeros(len(found["seed"]), bool)
        else:
            found, repeat, edge = _repeated(found)
        take = repeat | edge
        at = found["at"][take]
        return pa.Table.from_arrays([
            pa.array(edge[take]), pa.array(found["doc_id"][take]), pa.array(found["tie"][take]), pa.array(found["seed"][take].view(np.int64)),
            pa.array(at), pa.array(at - found["lo"][take]), pa.array(at - found["hi"][take]),
        ], ["edge", "key", "tie", "seed", "at", "lo", "hi"])

    blobs = rows.mapInArrow(cut, "grp long, blob binary")
    return blobs.groupBy("grp").applyInArrow(settle, _FOUND)


def ranks(data: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """Rank of the ``length`` bytes from each of ``places`` in lexicographic order; equal bytes, equal ranks.

    Prefix doubling: ranks of 8 bytes, then pairs of ranks for 16, 32, ... up to ``length``.
    """
    width = min(8, length)
    whole = len(data) - width + 1
    value = np.zeros(whole, np.uint64)
    for k in range(width):
        value = (value << np.uint64(8)) | data[k: k + whole]
    rank = np.unique(value, return_inverse=True)[1].astype(np.uint64)
    while width * 2 <= length:
        whole -= width
        rank = np.unique((rank[:whole] << np.uint64(32)) | rank[width: width + whole], return_inverse=True)[1].astype(np.uint64)
        width *= 2
    rest = length - width
    pair = (rank[places] << np.uint64(32)) | rank[places + rest]
    return np.unique(pair, return_inverse=True)[1]


def has_earlier(rank: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For windows of these ranks at these places (numbers in order of place): LPF >= length or not.

    In suffix order the runs of equal rank are those whose common prefix has the length; a window
    has an earlier one if within its run there is a previous or a next smaller place.
    """
    suffix = np.lexsort((order, rank))
    r, p = rank[suffix], order[suffix]
    first = np.r_[True, r[1:] != r[:-1]]
    run = np.cumsum(first) - 1
    least = np.minimum.reduceat(p, np.flatnonzero(first)) if len(p) else p
    out = np.zeros(len(rank), bool)
    out[suffix] = least[run] < p
    return out


def settle_edges(docs: DataFrame, edges: DataFrame, length: int, groups: int) -> DataFrame:
    """Step 2: (key, tie, lo, hi), runs of windows of edge anchors that have LPF >= length."""
    wanted = edges.groupBy("key", "tie").agg(F.sort_array(F.collect_list(F.struct("at", "seed", "lo", "hi"))).alias("edges"))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, starts = flatten(part.column("text"))
                lists = part.column("edges")
                flat = lists.flatten()
                doc = np.repeat(np.arange(len(part)), lists.value_lengths().to_numpy(zero_copy_only=False))
                at, seed, lo, hi = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
                key, tie = part.column("key").to_numpy()[doc], part.column("tie").to_numpy()[doc]
                group = (seed.view(np.uint64) >> np.uint64(20)) % np.uint64(groups)
                for g in np.unique(group):
                    some = np.flatnonzero(group == g)
                    raw = gather(data, starts[doc[some]] + lo[some], hi[some] + length - lo[some]).tobytes()
                    meta = np.stack([seed[some], key[some], tie[some], at[some], lo[some], hi[some]]).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([int(g)], pa.int64()), pa.array([meta], pa.binary()), pa.array([raw], pa.binary())], ["grp", "meta", "raw"])

    def settle(table: pa.Table) -> pa.Table:
        meta = np.concatenate([np.frombuffer(m, np.int64).reshape(6, -1) for m in table.column("meta").to_pylist()], axis=1)
        data = np.frombuffer(b"".join(table.column("raw").to_pylist()), np.uint8)
        seed, key, tie, at, lo, hi = meta
        begins = np.cumsum(hi + length - lo) - (hi + length - lo)
        count = hi - lo + 1
        owner = np.repeat(np.arange(len(lo)), count)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        rank = ranks(data, begins[owner] + offset, length)
        by_place = np.lexsort((lo[owner] + offset, tie[owner], key[owner]))
        order = np.empty(len(owner), np.int64)
        order[by_place] = np.arange(len(owner))
        old = np.flatnonzero(has_earlier(rank, order))
        fresh = np.r_[True, (np.diff(old) != 1) | (np.diff(owner[old]) != 0)][: len(old)]
        begin = np.flatnonzero(fresh)
        end = np.r_[begin[1:], len(old)][: len(begin)] - 1
        who = owner[old[begin]]
        return pa.Table.from_arrays([
            pa.array(key[who]), pa.array(tie[who]), pa.array(lo[who] + offset[old[begin]]), pa.array(lo[who] + offset[old[end]]),
        ], ["key", "tie", "lo", "hi"])

    joined = docs.join(wanted, ["key", "tie"]).select("key", "tie", "text", "edges")
    blobs = joined.mapInArrow(contexts, "grp long, meta binary, raw binary")
    return blobs.groupBy("grp").applyInArrow(settle, "key long, tie long, lo long, hi long")


def cut_out(raw: bytes, runs: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of ``raw`` without the stretches, how many bytes go, and in how many maximal runs."""
    left, at, removed, spans, end = [], 0, 0, 0, -1
    for a, b in sorted(runs):
        if a > end:
            left.append(raw[at:a])
            spans += 1
            removed += b - a
            at = end = b
        elif b > end:
            removed += b - end
            at = end = b
    left.append(raw[at:])
    return b"".join(left), removed, spans


def covered_windows(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The documents by (key, tie), and (key, tie, lo, hi): all runs of windows that occur earlier."""
    if length < SEED + 1 or length - SEED > 250:
        raise ValueError(f"length is {SEED + 1} to {SEED + 250}")
    sizes = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string"))).alias("bytes")).first()["bytes"] or 0
    repeated_ids = not docs.groupBy(id_col).count().where("count > 1").isEmpty()
    rows = _keyed(docs, id_col, text_col, repeated_ids)
    found = written(scan_anchors(rows, length, sizes // GROUP_BYTES + 1), "anchors")
    edges = found.where("edge")
    more = written(settle_edges(rows.distinct() if repeated_ids else rows, edges, length, edges.count() // GROUP_ANCHORS + 1), "edges")
    return rows, found.where("not edge").select("key", "tie", "lo", "hi").union(more)


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row.

    ``kept``: the remaining bytes, null with ``texts=False``.
    """
    rows, windows = covered_windows(docs, length, id_col, text_col)
    runs = windows.groupBy("key", "tie").agg(F.collect_list(F.struct("lo", (F.col("hi") + length).alias("end"))).alias("runs"))
    first = F.row_number().over(Window.partitionBy("key", "tie").orderBy(F.lit(0))) == 1
    joined = rows.join(runs, ["key", "tie"], "left").withColumn("first", first).select("key", "text", "runs", "first")
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()),
    ])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = []
                for key, text, found, is_first in zip(*(part.column(c).to_pylist() for c in ("key", "text", "runs", "first"))):
                    raw = text.encode()
                    found = [(r["lo"], r["end"]) for r in found or ()] if is_first else [(0, len(raw))] * (len(raw) >= length)
                    kept, removed, spans = cut_out(raw, found)
                    out.append((None if key == _NULL_ID else key, len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), kept if texts else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return joined.mapInArrow(work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
