"""Benchmark passages in documents, found by spaced seeds and checked on the aligned words.

Words are runs of letters, digits and characters beyond ASCII, after lower-casing A-Z. A seed
mask names the word positions of a window that are hashed; the others may differ, so a window
with a replaced word still hits if the word stands where the mask ignores it, and several masks
ignore different places. The hashes of all benchmark windows fill a bitmap of fixed size that
every task holds; a window of a document whose hash is not in it cannot hit. What is left, a few
rows, is joined with the benchmark's hashes. Around each hit the words of document and item are
compared on the hit's diagonal.

A document and an item overlap if any stretch of the diagonal has ``least`` equal words (fewer for
an item of fewer words: all of them) and at least ``share`` of its words are equal. The masks
together hit every such stretch of 13 equal words and four in five, wherever its replaced words
stand; with a lower ``least`` or ``share`` some have no hit. Items shorter than a mask are
searched whole, by a mask of their own length; items below ``SHORTEST`` words say too little and
never match. Null and empty texts never match; a null id is reported as such.

Hits carry ``CONTEXT`` words on either side, so checking needs no second look at the document.
Every window that hits is joined: only then is it known which hits are true, and those within a
stretch found by an earlier hit of their document, item and diagonal are passed over. So a false
hit of the bitmap costs time and never a true one. A passage that a third of all
documents hold makes that many rows with the same few hashes: the benchmark's tables are measured
and sent to every task if they are within ``BROADCAST_BYTES``; otherwise both sides are shuffled
and skewed keys are split by the engine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.flat import LOWER, distinct, flatten, packed_words, slices, word_bounds
from tidewatch.llm.store import written

#: Masks of weight 7, and two of weight 6 that hit the few stretches those miss: 1 is a hashed
#: word, 0 a word that may differ.
MASKS = ("1110110011", "1101011101", "10111010011", "1100101100111", "1101111", "10111000101")
SHORTEST = 5
CONTEXT = 64
BITMAP_BITS = 24
BROADCAST_BYTES = 32 << 20
WINDOW_BYTES = 64  # a row of the benchmark's windows in memory, amply

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of all texts, and the number of words before each text."""
    import xxhash

    data, starts = flatten(texts)
    data = LOWER[data]
    inside = _WORD[data]
    begins, ends, before = word_bounds(inside, starts)
    if not len(begins):
        return np.zeros(0, np.uint64), before
    strings, which = distinct(*packed_words(data, inside, begins, ends))
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in strings.to_pylist()), np.uint64, len(strings))
    return hashes[which], before


def window_hashes(words: np.ndarray, mask: str, number: int) -> np.ndarray:
    """The hash of the masked window that begins at each word that has a whole window behind it."""
    n = len(words) - len(mask) + 1
    total = np.full(max(n, 0), number + 1, np.uint64)
    for at in (i for i, c in enumerate(mask) if c == "1"):
        if n > 0:
            total = (total + words[at: at + n]) * np.uint64(0x9E3779B97F4A7C15)
    return _mix(total)


def masks_for(benchmark: DataFrame, text_col: str = "text") -> list[str]:
    """The masks, and one of all ones for each length of an item that is shorter than a mask."""
    longest = max(map(len, MASKS))
    lengths = benchmark.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_lengths, "n long").where(f"n >= {SHORTEST} and n < {longest}").distinct()
    return [*MASKS, *("1" * r.n for r in sorted(lengths.collect()))]  # at most as many rows as a mask is long


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.diff(word_hashes(batch.column("text"))[1]), pa.int64())], ["n"])


def _windows(words: np.ndarray, before: np.ndarray, masks: list[str], whole: bool):
    """Per mask: the mask's number, window starts, hashes and texts; only within one text.

    ``whole``: of texts shorter than the longest mask, the mask of their length finds them whole.
    """
    owner = np.repeat(np.arange(len(before) - 1), np.diff(before))
    for number, mask in enumerate(masks):
        hashes = window_hashes(words, mask, number)
        at = np.arange(len(hashes))
        inner = owner[: len(hashes)] == owner[len(mask) - 1:] if len(hashes) else np.zeros(0, bool)
        if whole and number >= len(MASKS):
            inner &= np.diff(before)[owner[: len(hashes)]] == len(mask)
        at = at[inner]
        yield number, at, hashes[at], owner[at]


def benchmark_windows(items: DataFrame, masks: list[str], id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, mask, hash, place): all masked windows of all items."""
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, before = word_hashes(batch.column("text"))
            ids = batch.column("item_id").to_pylist()
            for number, at, hashes, owner in _windows(words, before, masks, whole=True):
                yield pa.RecordBatch.from_pydict({
                    "item_id": pa.array([ids[o] for o in owner], pa.int64()),
                    "mask": pa.array(np.full(len(at), number, np.int32)), "hash": hashes.view(np.int64), "place": at - before[owner],
                })

    return rows.mapInArrow(work, "item_id long, mask int, hash long, place long")


def item_words(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, words): each item's word hashes, the upper half of each as 32-bit integers."""
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, before = word_hashes(batch.column("text"))
            short = _short(words)
            raw = [short[a:b].tobytes() for a, b in zip(before[:-1], before[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(raw, pa.binary())], ["item_id", "words"])

    return rows.mapInArrow(work, "item_id long, words binary")


def _short(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(32)).astype(np.uint32)


def bitmap(windows: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """2 ** bits bits, set where a window's hash has these low bits. Its size is fixed."""
    slot = F.col("hash").bitwiseAND(F.lit((1 << bits) - 1))
    filled = windows.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("cell")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("value"))
    found = filled.toArrow()  # at most 2 ** (bits - 6) rows
    cells = np.zeros(1 << (bits - 6), np.int64)
    cells[found.column("cell").to_numpy()] = found.column("value").to_numpy()
    return cells.view(np.uint64)


def hits(docs: DataFrame, masks: list[str], cells: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Windows of documents that may be benchmark windows, with the words around each.

    (doc_id, mask, hash, at, left, right): ``left`` are up to ``CONTEXT`` word hashes before the
    window, nearest last; ``right`` those from its first word on.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(cells)
    bits = int(len(cells)).bit_length() - 1 + 6

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for part in slices(batch):
                words, before = word_hashes(part.column("text"))
                short, ids = _short(words), part.column("doc_id").to_pylist()
                for number, at, hashes, owner in _windows(words, before, masks, whole=False):
                    slot = hashes & np.uint64((1 << bits) - 1)
                    maybe = np.flatnonzero((table[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1))
                    if not len(maybe):
                        continue
                    for some in np.array_split(maybe, len(maybe) // 2000 + 1):
                        places, own = at[some], owner[some]
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": pa.array([ids[o] for o in own], pa.int64()),
                            "mask": pa.array(np.full(len(some), number, np.int32)), "hash": hashes[some].view(np.int64), "at": places - before[own],
                            "left": pa.array([short[max(before[o], p - CONTEXT): p].tobytes() for p, o in zip(places, own)], pa.binary()),
                            "right": pa.array([short[p: min(before[o + 1], p + 2 * CONTEXT)].tobytes() for p, o in zip(places, own)], pa.binary()),
                        })

    return rows.mapInArrow(work, "doc_id long, mask int, hash long, at long, left binary, right binary")


def best_stretch(same: np.ndarray, least: int, share: float) -> tuple[int, int, int] | None:
    """Begin, length and equal words of the stretch with the most equal words (ties: the shortest,
    then the first) among those that have ``least`` and the share; None if there is none.
    """
    if same.sum() < least:
        return None
    equal = np.r_[0, np.cumsum(same)]
    begin = np.flatnonzero(same)  # a stretch that begins or ends with an unequal word has no more
    end = begin + 1
    n = end - begin[:, None]
    held = equal[end] - equal[begin][:, None]
    good = (n > 0) & (held >= least) & (held >= share * n)
    if not good.any():
        return None
    at, to = np.unravel_index(np.where(good, held * (len(same) + 1) - n, -1).argmax(), n.shape)
    return int(begin[at]), int(n[at, to]), int(held[at, to])


def diagonal(left: np.ndarray, right: np.ndarray, item: np.ndarray, place: int) -> tuple[np.ndarray, int]:
    """Which words around a hit equal the item's word beside them, and how many of them stand
    before the hit. ``left`` ends at the hit, ``right`` begins at it; ``place`` is its word in the item.
    """
    back, ahead = min(len(left), place), min(len(right), len(item) - place)
    words = np.concatenate([left[len(left) - back:], right[:ahead]])
    return words == item[place - back: place + ahead], back


def overlaps(docs: DataFrame, items: DataFrame, least: int = 13, share: float = 0.8) -> DataFrame:
    """(doc_id, item_id, doc_start, n_words, n_equal, item_words): the best overlap of each pair.

    ``doc_start``: the word of the document at which it begins; ``n_words``: its length.
    Repeated rows of a document are one document here.
    """
    masks = masks_for(items)
    windows = written(benchmark_windows(items, masks), "benchmark-windows")
    found = hits(docs, masks, bitmap(windows))
    texts = written(item_words(items), "benchmark-words")
    size = texts.agg(F.sum(F.length("words") + 16)).first()[0] or 0
    small_windows = F.broadcast(windows) if windows.count() * WINDOW_BYTES <= BROADCAST_BYTES else windows
    small_texts = F.broadcast(texts) if size <= BROADCAST_BYTES else texts
    met = found.join(small_windows, ["mask", "hash"]).join(small_texts, "item_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple, dict] = {}
            out = []
            for r in (r for part in slices(batch, "right") for r in part.to_pylist()):
                key = (r["doc_id"], r["item_id"], r["at"] - r["place"])
                near = seen.get(key)
                if near and near["doc_start"] <= r["at"] < near["doc_start"] + near["n_words"]:
                    continue  # the stretch around an earlier hit of this diagonal holds this one
                item = np.frombuffer(r["words"], np.uint32)
                same, back = diagonal(np.frombuffer(r["left"], np.uint32), np.frombuffer(r["right"], np.uint32), item, r["place"])
                best = best_stretch(same, min(least, len(item)), share)
                if best:
                    row = {
                        "doc_id": r["doc_id"], "item_id": r["item_id"], "doc_start": r["at"] - back + best[0], "n_words": best[1], "n_equal": best[2],
                        "item_words": len(item)}
                    seen[key] = row
                    out.append(row)
            yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "item_id", "doc_start", "n_words", "n_equal", "item_words")])
    checked = met.mapInArrow(work, "doc_id long, item_id long, doc_start long, n_words long, n_equal long, item_words long")
    best = F.max(F.struct("n_equal", (-F.col("n_words")).alias("short"), (-F.col("doc_start")).alias("early"), "item_words")).alias("best")
    return checked.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", (-F.col("best.early")).alias("doc_start"), (-F.col("best.short")).alias("n_words"), "best.n_equal", "best.item_words")


def without_overlaps(docs: DataFrame, items: DataFrame, least: int = 13, share: float = 0.8) -> DataFrame:
    """The rows of ``docs`` whose document overlaps no item, all columns as they are.

    Rows with a null id are kept unless any row with a null id overlaps.
    """
    bad = overlaps(docs, items, least, share).select(F.col("doc_id").alias("__bad_id")).distinct()
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(F.col("__bad_id")), "left_anti")
