"""Shards of nearly equal bytes by sampled splitters.

Records are ordered by a key: a hash of the text, then the id, so equal texts stand together and
a group of copies of any size can still be split. A sample of keys, drawn with a chance
proportional to size, gives the splitters of many small ranges by its weighted quantiles; each
record finds its range by binary search. Ranges are measured, and one that came out overfull is
sampled again within itself and subdivided until none is above the bound (or holds one record).
Only then are records shuffled, by range, so no task gets more than a bounded range. Prefix sums
over the ranges and running sums within a range give each record's place in the whole order;
a shard is the next ``1 / shards`` of the bytes, and a record belongs where its middle falls. A
group of equal texts within a range goes whole to one shard if it is below ``WHOLE`` of a shard.

Cuts are off by at most half of the largest record or of ``WHOLE`` of a shard. Only splitters
and range totals, both bounded by the number of ranges, go through the driver.

A null text has size 1 and its own key; null ids order first. Rows that are equal in both are
interchangeable and keep their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.store import new_folder, written

#: A group of equal texts up to this share of a shard stays together.
WHOLE = 0.002
#: Samples per range; more make ranges more even, and the sample stays the driver's to hold.
SAMPLES = 16
#: A range above this many times the mean is subdivided.
OVERFULL = 4.0
_NULL_ID = -(2**63)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    raw = F.coalesce(text, F.lit("")).cast("binary")
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(raw).cast("long") + 1).alias("size"), F.crc32(raw).alias("text_crc32"),
        F.when(text.isNull(), F.lit(_NULL_ID)).otherwise(F.xxhash64(text)).alias("h"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("tie"),
    )


class Splitters:
    """Sorted (h, tie) pairs; ``find`` gives the number of splitters at or below each key."""

    def __init__(self, h: np.ndarray, tie: np.ndarray):
        order = np.lexsort((tie, h))
        self.h, self.tie = h[order], tie[order]

    def find(self, h: np.ndarray, tie: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(self.h, h, "left"), np.searchsorted(self.h, h, "right")
        at = high.copy()
        for key in np.unique(self.h[low[high > low]]):  # texts that hold a splitter: few
            a, b = np.searchsorted(self.h, key, "left"), np.searchsorted(self.h, key, "right")
            rows = np.flatnonzero(h == key)
            at[rows] = a + np.searchsorted(self.tie[a:b], tie[rows], "right")
        return at

    def with_range(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the number of each row's range."""
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = self.find(batch.column("h").to_numpy(), batch.column("tie").to_numpy())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.astype(np.int64))], [*batch.schema.names, "range"])

        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        return rows.mapInArrow(work, f"{schema}, range long")


def _sampled(rows: DataFrame, chance) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and sizes of rows taken with ``chance``, decided by a hash of the key, so always the same."""
    draw = F.pmod(F.xxhash64("h", "tie", F.lit("sample")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    found = rows.where(draw < chance).select("h", "tie", "size").toArrow()
    return found.column("h").to_numpy(), found.column("tie").to_numpy(), found.column("size").to_numpy().astype(float)


def _quantiles(h: np.ndarray, tie: np.ndarray, weight: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys that cut the weighted sample into ``ranges`` parts of equal weight."""
    if ranges < 2 or not len(h):
        return h[:0], tie[:0]
    order = np.lexsort((tie, h))
    h, tie, total = h[order], tie[order], np.cumsum(weight[order])
    cut = np.unique(np.searchsorted(total, total[-1] * np.arange(1, ranges) / ranges))
    cut = cut[cut < len(h)]
    return h[cut], tie[cut]


def find_splitters(rows: DataFrame, ranges: int) -> tuple[Splitters, dict[int, tuple[int, int]]]:
    """Splitters of ``rows`` and each range's (bytes, rows); no range is overfull."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    wanted = float(ranges * SAMPLES)
    h, tie, size = _sampled(rows, F.col("size") * wanted / max(total, 1))
    # A row above one sample's share is always taken and counts in full.
    splitters = Splitters(*_quantiles(h, tie, np.maximum(size, total / wanted), ranges))
    while True:
        placed = splitters.with_range(rows)
        sums = {r["range"]: (r["size"], r["n"]) for r in placed.groupBy("range").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}
        limit = OVERFULL * total / ranges
        full = {r: s for r, (s, n) in sums.items() if s > limit and n > 1}
        if not full:
            return splitters, sums
        inside = placed.where(F.col("range").isin(list(full)))
        h, tie, size = _sampled(inside, F.col("size") * wanted / max(total, 1) * 4)
        own = splitters.find(h, tie)
        more = [
            _quantiles(h[own == r], tie[own == r], np.maximum(size[own == r], total / wanted / 4), 2 * int(np.ceil(s / limit)))
            for r, s in full.items()
        ]
        grown = Splitters(np.r_[splitters.h, *(m[0] for m in more)], np.r_[splitters.tie, *(m[1] for m in more)])
        pairs = np.unique(np.stack([grown.h, grown.tie]), axis=1)
        if pairs.shape[1] == len(splitters.h):  # what is left are equal keys
            return splitters, sums
        splitters = Splitters(pairs[0], pairs[1])


def assign_shards(docs: DataFrame, shards: int, ranges_per_shard: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): each row's shard from 0 and its place in it."""
    spark = docs.sparkSession
    rows = written(_keyed(docs, id_col, text_col), "shard-keys")
    splitters, sums = find_splitters(rows, shards * ranges_per_shard)
    total = max(1, sum(s for s, _ in sums.values()))
    bases, at_bytes, at_rows = [], 0, 0
    for r in sorted(sums):
        bases.append((r, at_bytes, at_rows))
        at_bytes, at_rows = at_bytes + sums[r][0], at_rows + sums[r][1]
    base = F.broadcast(spark.createDataFrame(bases, "range long, base_bytes long, base_rows long"))  # one row per range
    order = Window.partitionBy("range").orderBy("h", "tie", "size")
    group = Window.partitionBy("range", "h")
    share = total / shards
    ordered = (
        splitters.with_range(rows).repartition("range")
        .withColumn("end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("place", F.row_number().over(order) - 1)
        .withColumn("group_bytes", F.sum("size").over(group)).withColumn("group_start", F.min(F.col("end") - F.col("size")).over(group))
    )
    middle = F.when(F.col("group_bytes") <= WHOLE * share, F.col("group_start") + F.col("group_bytes") / 2).otherwise(F.col("end") - F.col("size") / 2)
    placed = written(
        ordered.join(base, "range").withColumn("shard", F.least(F.floor((F.col("base_bytes") + middle) * shards / total), F.lit(shards - 1)).cast("int"))
        .select("doc_id", "size", "text_crc32", "shard", (F.col("base_rows") + F.col("place")).alias("rank")), "shard-places")
    first = F.broadcast(placed.groupBy("shard").agg(F.min("rank").alias("first")))  # one row per shard
    return placed.join(first, "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, shards: int, folder: str | None = None, id_col: str = "doc_id") -> str:
    """Write all columns of ``docs`` as Parquet, partitioned by shard, and return the folder.

    Ids must be unique and not null, as the shards are joined to the rows by id.
    """
    folder = folder or new_folder(docs.sparkSession, "shards")
    places = assign_shards(docs, shards, id_col=id_col).select(F.col("doc_id").alias(id_col), "shard", "slot")
    docs.join(places, id_col).repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
    return folder
