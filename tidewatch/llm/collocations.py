"""Phrase collocations by dynamic itemset counting.

Texts are lower-cased (A-Z), split at ``.,;:!?`` and line breaks into pieces, and those at spaces
and tabs into words. A phrase is a run of words within a piece; everything is counted per language.

Counting: the rows are dealt to ``shards`` and the shards scanned in cycles, one per step. Words
are counted from the start. A longer phrase becomes active at the step after both its subphrases
(without its last, without its first word) have been seen ``least`` times so far, and is then
counted for exactly one full cycle, while longer ones begin on their own. So phrases of several
lengths are counted by the same scan, and a scan ends when every active phrase has had its cycle.

A phrase is a 64-bit hash while it is counted, with the least and greatest of a second hash of 32
bits and one row where it stands. The step from which subphrases are active stands in a table of
``2 ** SLOT_BITS`` slots that every task holds (32 MB, whatever the input). Phrases that share a
slot can only be active earlier, never be missed, and no earlier than their own subphrases, so
that each has a whole cycle. A task adds up its own counts before they are
shuffled; the running table holds one number per phrase whose cycle is not over, and phrases that
ended below ``least`` leave it. When all phrases of two words have had their cycle, texts are cut
down to the runs of words whose neighbours all are frequent pairs, as longer phrases consist of
them, and further cycles scan these.

At the end the rows that phrases were seen in give their words. Should two phrases have had one
hash, which the second one tells, all are counted once more by their words instead.

Scores: a phrase seen ``a`` times in a language of ``n`` words, cut into parts seen ``l`` and ``r``
times, scores ``floor(1000 * a * n / (l * r))`` in exact decimals; the lowest-scoring cut counts,
the first of equals. Phrases inside a longer one that is as frequent are left out (with equal
numbers all phrases between the two are as frequent as well, so looking one word further is enough).

Null texts have no words; a null language is ``UNKNOWN``. Repeated rows count each time. A table
without phrases gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.flat import LOWER, distinct, flatten, packed_words, slices, word_bounds
from tidewatch.llm.store import dropped, new_folder, written

LONGEST = 5
SHARDS = 3
UNKNOWN = "und"
SLOT_BITS = 25
NEVER = 255
#: Counts a task holds before it adds them up, and rows of a batch that leaves it.
HELD = 3_000_000
BATCH_ROWS = 200_000
#: Phrases and where they were seen go to every task up to this size.
BROADCAST_BYTES = 16 << 20

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_BREAK
_WORD[[0x20, 0x09]] = False
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Words:
    """The words of a slice of texts: their bytes, their text, two hashes, the distinct word, and whether the next follows it."""

    data: np.ndarray
    starts: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    hash: np.ndarray
    second: np.ndarray
    follows: np.ndarray
    which: np.ndarray
    strings: pa.Array


def words_of(part: pa.RecordBatch) -> Words:
    import xxhash

    data, starts = flatten(part.column("text"))
    data = LOWER[data]
    inside = _WORD[data]
    begins, ends, firsts = word_bounds(inside, starts)
    text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    piece = np.searchsorted(np.flatnonzero(_BREAK[data]), begins)
    follows = np.zeros(len(begins), bool)
    follows[:-1] = (text[1:] == text[:-1]) & (piece[1:] == piece[:-1])
    strings, which = distinct(*packed_words(data, inside, begins, ends))
    raw = b"".join(map(xxhash.xxh3_128_digest, strings.to_pylist()))
    hashes = np.frombuffer(raw, np.uint64).reshape(-1, 2)
    return Words(data, starts, begins, ends, text, hashes[which, 0], hashes[which, 1].astype(np.uint32), follows, which, strings)


def _languages(part: pa.RecordBatch) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct languages, which of them each row has, and a hash of each."""
    import xxhash

    coded = part.column("lang").dictionary_encode()
    names = coded.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(s, seed=1) for s in names), np.uint64, len(names))
    return names, coded.indices.to_numpy(zero_copy_only=False), hashes


def _slot(h: np.ndarray, table: np.ndarray, size: int) -> np.ndarray:
    """The place of each phrase hash in a table of a power of two of slots, an eighth for each size.

    Sizes share no slots: phrases are scanned for from the step at which shorter ones got theirs.
    """
    eighth = len(table) // 8
    if eighth == 1:
        return np.full(len(h), size, np.int64)
    return size * eighth + (h >> np.uint64(64 - (eighth - 1).bit_length())).astype(np.int64)


def _phrases(words: Words, start: np.ndarray, longest: int, active) -> Iterator[tuple]:
    """(size, places, hashes, second hashes, active since) of the phrases whose subphrases are active.

    ``active`` gives for hashes the step from which a phrase made of them counts, ``NEVER + 1`` for
    none; only phrases with such a step are followed further.
    """
    at, h, second = np.arange(len(words.hash)), start * _STEP + words.hash, words.second
    since = np.zeros(len(at), np.int16)
    yield 1, at, h, second, since
    for size in range(2, longest + 1):
        both = at[1:] == at[:-1] + 1
        if size == 2:
            both &= words.follows[at[:-1]]
        i = np.flatnonzero(both)
        # A shared slot may be older than the phrase: nothing counts before what it is made of.
        since = np.maximum(since, active(h, size - 1))
        since = np.maximum(since[i], since[i + 1])
        i, since = i[since <= NEVER], since[since <= NEVER]
        at, end = at[i], at[i] + size - 1
        h, second = h[i] * _STEP + words.hash[end], second[i] * np.uint32(0x85EBCA6B) + words.second[end]
        yield size, at, h, second, since


def _packed(table: np.ndarray) -> bytes:
    """A table of slots for the way to the tasks: where few slots are in use, a fraction of its size."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(table.tobytes())


def _unpacked(raw: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)


_COUNTED = "h long, tag int, n long, low int, high int, spot long"


class _Tally:
    """Counts by (hash, tag) with the range of the second hash and a row; added up when many are held."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, h, tag, n, second, spot) -> None:
        self.parts.append((h, tag, n, second, second, spot))
        self.held += len(h)

    def compact(self) -> None:
        if not self.parts:
            return
        h, tag, n, low, high, spot = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(h)
        h, tag = h[order], tag[order]
        first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (tag[1:] != tag[:-1])][: len(h)])
        if len(first):
            n = np.add.reduceat(n[order], first)
            low, spot = (np.minimum.reduceat(x[order], first) for x in (low, spot))
            high = np.maximum.reduceat(high[order], first)
        self.parts = [(h[first], tag[first], n, low, high, spot)]
        self.held = len(first)

    def batches(self, rows: int) -> Iterator[pa.RecordBatch]:
        self.compact()
        for h, tag, n, low, high, spot in self.parts:
            columns = (h.view(np.int64), tag, n.astype(np.int64), low.view(np.int32), high.view(np.int32), spot)
            for at in range(0, len(h), rows):
                yield pa.RecordBatch.from_arrays([pa.array(c[at: at + rows]) for c in columns], [f.split()[0] for f in _COUNTED.split(", ")])
        self.parts, self.held = [], 0


def _added_up(counted: DataFrame) -> DataFrame:
    return counted.groupBy("h", "tag").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("spot").alias("spot"))


def _scan(shard: DataFrame, table, step: int, shards: int, sizes: list[int]) -> DataFrame:
    """``_COUNTED`` of the active phrases of ``sizes`` in a shard. tag: 8 * first step + size.

    In the first cycle also the words of each language, as phrases of size 0.
    """
    held, rows = HELD, BATCH_ROWS

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached = _unpacked(table.value)

        def active(h: np.ndarray, size: int) -> np.ndarray:
            since = reached[_slot(h, reached, size)].astype(np.int16) + 1
            since[since > step] = NEVER + 1
            return since

        tally = _Tally()
        for batch in batches:
            for part in slices(batch):
                words = words_of(part)
                spots = part.column("row").to_numpy()
                _, lang, hashes = _languages(part)
                start = hashes[lang[words.text]] if len(words.text) else words.hash
                if 1 in sizes:
                    n = np.bincount(words.text, minlength=part.num_rows)
                    tally.add(hashes[lang], np.zeros(len(n), np.int32), n, np.zeros(len(n), np.uint32), spots)
                for size, at, h, second, since in _phrases(words, start, max(sizes), active):
                    if size in sizes:
                        now = since + shards > step
                        tag = since[now].astype(np.int32) * 8 + size
                        tally.add(h[now], tag, np.ones(len(tag), np.int64), second[now], spots[words.text[at[now]]])
                if tally.held > held:
                    tally.compact()
                    if tally.held > held // 2:
                        yield from tally.batches(rows)
        yield from tally.batches(rows)

    return shard.select("lang", "text", "row").mapInArrow(work, _COUNTED)


def _cut_down(words: Words, kept: np.ndarray, joined: np.ndarray) -> pa.Array:
    """The texts with ``kept`` words alone, a space after a word that is ``joined`` to the next, else a line break."""
    data, starts, ends = words.data.copy(), words.starts, words.ends[kept]
    edges = np.zeros(len(data) + 1, np.int8)
    edges[words.begins[kept]] += 1
    edges[ends] -= 1
    stays = np.cumsum(edges[:-1], dtype=np.int8).view(bool)
    inner = ends < starts[words.text[kept] + 1]  # the last word of a text has no byte behind it
    data[ends[inner]] = np.where(joined[inner], 0x20, 0x0A)
    stays[ends[inner]] = True
    before = np.zeros(len(data) + 1, np.int32)
    np.cumsum(stays, out=before[1:])
    offsets, left = before[starts], np.ascontiguousarray(data[stays])
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(left))


def _pairs_only(sharded: DataFrame, table) -> DataFrame:
    """The texts cut down to runs of words in which all neighbours are reached pairs, a line each."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached = _unpacked(table.value)
        for batch in batches:
            for part in slices(batch):
                words = words_of(part)
                _, lang, hashes = _languages(part)
                start = hashes[lang[words.text]] if len(words.text) else words.hash
                *_, (_, at, h, _, _) = _phrases(words, start, 2, lambda h, size: np.where(reached[_slot(h, reached, size)] != NEVER, 0, NEVER + 1).astype(np.int16))
                at = at[reached[_slot(h, reached, 2)] != NEVER]
                joined = np.zeros(len(words.text) + 1, bool)
                joined[at] = True
                kept = np.flatnonzero(joined[:-1] | np.r_[False, joined[:-2]][: len(words.text)])
                left = _cut_down(words, kept, joined[kept])
                yield pa.RecordBatch.from_arrays([part.column("lang"), left, part.column("row"), part.column("shard")], ["lang", "text", "row", "shard"])

    return sharded.select("lang", "text", "row", "shard").mapInArrow(work, _SHARDED).where("text != ''")


_SHARDED = "lang string, text string, row long, shard int"


def _by_shard(rows: DataFrame) -> DataFrame:
    path = new_folder(rows.sparkSession, "shards")
    rows.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(_SHARDED).parquet(path)


def _sharded(docs: DataFrame, shards: int, text_col: str, lang_col: str) -> DataFrame:
    """``_SHARDED`` as a table cut by shard: rows are dealt by their place, not their values."""
    rows = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("row"))
    return _by_shard(rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")))


def _slots(phrases: DataFrame):
    """(size, slot) of phrases, at most one row per slot and size."""
    size, eighth = F.col("tag") % 8, (1 << SLOT_BITS) // 8
    high = F.shiftrightunsigned("h", 64 - (SLOT_BITS - 3)).cast("int") if eighth > 1 else F.lit(0)
    return phrases.select(size.cast("byte").alias("size"), (size * eighth + high).cast("int").alias("slot")).distinct()


def frequent_hashes(sharded: DataFrame, shards: int, least: int) -> tuple[DataFrame | None, np.ndarray]:
    """``_COUNTED`` of all phrases of up to ``LONGEST`` words counted ``least`` times, and marks on their slots.

    One step per shard and cycle; see the head of the module. Rows of size 0 hold all words.
    """
    spark = sharded.sparkSession
    reached = np.full(1 << SLOT_BITS, NEVER, np.uint8)
    wanted = np.zeros(1 << SLOT_BITS, bool)
    #: The last step at which a phrase of each size got its slot; longer ones may begin after it.
    last = {size: -1 for size in range(LONGEST)}
    scanned, running, done, step = sharded, None, [], 0
    while True:
        sizes = [s for s in range(1, LONGEST + 1) if (step < shards if s == 1 else last[s - 1] >= 0 and step <= max(last[k] for k in range(1, s)) + shards)]
        if not sizes or step >= NEVER:
            break
        table = spark.sparkContext.broadcast(_packed(reached))
        if scanned is sharded and min(sizes) > 2:
            scanned = _by_shard(_pairs_only(sharded, table))
        counted = _scan(scanned.where(F.col("shard") == step % shards), table, step, shards, sizes)
        if running is not None:
            counted = running.where((F.shiftright("tag", 3) + shards) > step).union(counted)
        tally = written(_added_up(counted), "tally")
        often = F.col("n") >= least
        found = _slots(tally.where(often & (F.col("tag") % 8 > 0))).toArrow()  # at most a row per slot and size
        size, slot = (found.column(c).to_numpy() for c in ("size", "slot"))
        wanted[slot] = True
        for s in range(1, LONGEST):
            new = slot[size == s]
            if (reached[new] == NEVER).any():
                last[s] = step
        fresh = slot[(size < LONGEST) & (reached[slot] == NEVER)]
        reached[fresh] = step
        over = (F.shiftright("tag", 3) + shards) <= step + 1
        done.append(written(tally.where(over & (often | (F.col("tag") == 0))), "frequent"))
        if running is not None:
            dropped(running)
        table.destroy()
        running, step = tally, step + 1
    if running is not None:
        dropped(running)
    if scanned is not sharded:
        dropped_tree(scanned)
    whole = None
    for part in done:
        whole = part if whole is None else whole.union(part)
    return whole, wanted


def dropped_tree(table: DataFrame) -> None:
    """Delete a table cut by shard."""
    spark = table.sparkSession
    for folder in {f.rpartition("/shard=")[0] for f in table.inputFiles()}:
        if "/corpus/" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _worded(sharded: DataFrame, frequent: DataFrame) -> DataFrame:
    """(lang, size, phrase, n) of counted phrases, their words read from the rows they were seen in."""
    seen = frequent.groupBy("spot").agg(F.collect_list(F.struct("h", "tag", "n")).alias("wanted"))
    size = frequent.count() * 32
    rows = sharded.select("lang", "text", "row").join(F.broadcast(seen) if size <= BROADCAST_BYTES else seen, F.col("row") == F.col("spot"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = words_of(part)
                names, lang, hashes = _languages(part)
                strings = words.strings.to_pylist()
                bounds = np.searchsorted(words.text, np.arange(part.num_rows + 1))
                out: list[tuple] = []
                for i, wanted in enumerate(part.column("wanted").to_pylist()):
                    name, own = names[lang[i]], words.hash[bounds[i]: bounds[i + 1]]
                    follows, which = words.follows[bounds[i]: bounds[i + 1]], words.which[bounds[i]: bounds[i + 1]]
                    by_size: dict[int, dict[int, int]] = {}
                    for w in wanted:
                        by_size.setdefault(w["tag"] % 8, {})[w["h"]] = w["n"]
                    out += [(name, 0, b"", n) for n in by_size.pop(0, {}).values()]
                    h, at = hashes[lang[i: i + 1]] * _STEP + own, np.arange(len(own))
                    for length in range(1, max(by_size, default=0) + 1):
                        if length > 1:
                            both = np.flatnonzero((at[1:] == at[:-1] + 1) & (follows[at[:-1]] if length == 2 else True))
                            at = at[both]
                            h = h[both] * _STEP + own[at + length - 1]
                        sought = by_size.get(length, {})
                        signed, places = np.unique(h.view(np.int64), return_index=True)
                        for j in np.flatnonzero(np.isin(signed, np.fromiter(sought, np.int64, len(sought)))).tolist():
                            first = int(at[places[j]])
                            out.append((name, length, b" ".join(strings[w] for w in which[first: first + length]), sought[int(signed[j])]))
                yield pa.RecordBatch.from_arrays([
                    pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int32()),
                    pa.array([r[2] for r in out], pa.binary()).cast(pa.string()), pa.array([r[3] for r in out], pa.int64())], ["lang", "size", "phrase", "n"])

    return rows.select("lang", "text", "wanted").mapInArrow(work, COUNTS)


COUNTS = "lang string, size int, phrase string, n long"


def _recount(sharded: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(lang, size, phrase, n) of all phrases in marked slots, and per language a row of size 0 with all words."""
    table = sharded.sparkSession.sparkContext.broadcast(_packed(wanted))
    most = BATCH_ROWS

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = _unpacked(table.value).view(bool)
        counts: dict[tuple, int] = {}

        def out() -> pa.RecordBatch:
            rows = list(counts.items())
            counts.clear()
            return pa.RecordBatch.from_arrays([
                pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.int32()),
                pa.array([k[2] for k, _ in rows], pa.binary()).cast(pa.string()), pa.array([n for _, n in rows], pa.int64()),
            ], ["lang", "size", "phrase", "n"])

        for batch in batches:
            for part in slices(batch):
                words = words_of(part)
                names, lang, hashes = _languages(part)
                strings = words.strings.to_pylist()
                of = lang[words.text] if len(words.text) else words.text
                for i, n in enumerate(np.bincount(of, minlength=len(names)).tolist()):
                    counts[names[i], 0, b""] = counts.get((names[i], 0, b""), 0) + n
                start = hashes[of] if len(of) else words.hash

                def active(h: np.ndarray, size: int) -> np.ndarray:
                    return np.where(marked[_slot(h, marked, size)], 0, NEVER + 1).astype(np.int16)

                for size, at, h, _, _ in _phrases(words, start, LONGEST, active):
                    at = at[marked[_slot(h, marked, size)]]
                    # Distinct phrases of the slice by their distinct words, which no hash stands for.
                    rows = np.stack([of[at], *(words.which[at + k] for k in range(size))])
                    order = np.lexsort(rows[::-1])
                    rows = rows[:, order]
                    first = np.flatnonzero(np.r_[True, (rows[:, 1:] != rows[:, :-1]).any(axis=0)][: rows.shape[1]])
                    for row, n in zip(rows[:, first].T.tolist(), np.diff(np.r_[first, rows.shape[1]]).tolist()):
                        key = (names[row[0]], size, b" ".join(strings[w] for w in row[1:]))
                        counts[key] = counts.get(key, 0) + n
                if len(counts) > most:
                    yield out()
        yield out()

    return sharded.select("lang", "text").mapInArrow(work, COUNTS).groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))


def frequent_phrases(docs: DataFrame, least: int = 100, shards: int = SHARDS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, size, phrase, n): words and phrases of up to ``LONGEST`` words seen ``least`` times.

    Rows of size 0 hold the number of all words of a language.
    """
    if not 1 <= shards <= 50:
        raise ValueError("shards is 1 to 50")
    sharded = _sharded(docs, shards, text_col, lang_col)
    frequent, wanted = frequent_hashes(sharded, shards, least)
    if frequent.where("low != high").isEmpty():
        counted = _worded(sharded, frequent)
    else:  # two phrases of one hash
        counted = _recount(sharded, wanted)
    found = written(counted.where((F.col("n") >= least) | (F.col("size") == 0)), "phrases")
    dropped(frequent)
    dropped_tree(sharded)
    return found


def _whole(*factors) -> F.Column:
    product = F.lit(1).cast("decimal(38,0)")
    for factor in factors:
        product = (product * factor.cast("decimal(20,0)")).cast("decimal(38,0)")
    return product


def collocations(phrases: DataFrame, top: int | None = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) from :func:`frequent_phrases`, the ``top`` of each language."""
    counts = phrases.where("size > 0").select("lang", "phrase", F.col("n").alias("count"))
    totals = phrases.where("size = 0").select("lang", F.col("n").alias("total"))
    rows = phrases.where("size > 1").select("lang", "size", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))

    def part(low, length):
        return F.array_join(F.slice("words", low, length), " ")

    longer = rows.where("size > 2").select(
        "lang", F.explode(F.array(part(F.lit(1), F.col("size") - 1), part(F.lit(2), F.col("size") - 1))).alias("phrase"), "a")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("inside"))
    left = rows.join(longer, ["lang", "phrase"], "left").where("inside is null or inside < a").drop("inside")
    cuts = left.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("head"), part(F.col("cut") + 1, F.col("size") - F.col("cut")).alias("tail"))
    heads = counts.select("lang", F.col("phrase").alias("head"), F.col("count").alias("l"))
    tails = counts.select("lang", F.col("phrase").alias("tail"), F.col("count").alias("r"))
    both = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(totals, "lang")
    scored = both.withColumn("over", _whole(F.lit(1000), F.col("a"), F.col("total"))).withColumn("under", _whole(F.col("l"), F.col("r")))
    scored = scored.withColumn("score", F.expr("over div under"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "total")).alias("best"))
    flat = best.select("lang", "phrase", "best.a", "best.l", "best.r", F.col("best.total").alias("n"), "best.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = flat.withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)  # limited before the rows of a language meet
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mine(docs: DataFrame, least: int = 100, top: int | None = 2000, shards: int = SHARDS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The best collocations of each language of ``docs``."""
    return collocations(frequent_phrases(docs, least, shards, text_col, lang_col), top)
