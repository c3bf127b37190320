"""Records of CSV files whose quoted texts hold line breaks, read in parallel blocks.

Whether a line begins a record depends on how many quotes stand before it in its file. So the
quotes of every block are counted first (an aggregate that combines on the map side); running sums
over the blocks of a file tell in which blocks the first line continues a record begun before.
Each task then puts its block's lines together on its own. Only a record that crosses the border
of blocks is left over, in pieces: two per block at most, which are joined afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_PIECES = "kind string, file string, block long, line long, text string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): physical lines in the order of each block."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _begun_before(lines: DataFrame) -> set[tuple[str, int]]:
    """The blocks whose first line continues a record. One job; only these blocks come back."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    counted = lines.groupBy("file", "block").agg(F.sum(quotes).alias("quotes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    odd = counted.withColumn("odd", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).where("odd")
    return {(r["file"], r["block"]) for r in odd.select("file", "block").collect()}


class _Block:
    """Puts the lines of one block together; lines may come in several batches."""

    def __init__(self, file: str, block: int, inside: bool):
        self.file, self.block = file, block
        self.inside = inside  # whether the next line continues a record
        self.began_here = not inside
        self.open: list[str] = []  # lines of the record that is not complete yet
        self.line = 0

    def add(self, values: pa.Array) -> tuple[list[str], list[int], list[str]]:
        """(kind, line number, text) columns of what is complete with these lines."""
        odd = pc.bit_wise_and(pc.count_substring(values, '"'), 1).to_numpy(zero_copy_only=False).astype(np.int64)
        before = (np.cumsum(odd) - odd + self.inside) % 2
        texts = values.to_pylist()
        begins = np.flatnonzero(before == 0).tolist()
        after = bool((before[-1] + odd[-1]) % 2)
        kinds, numbers, out = [], [], []
        head = begins[0] if begins else len(texts)
        if self.inside:
            self.open += texts[:head]
            if head < len(texts) or not after:
                self._close(kinds, numbers, out)
        for i, j in zip(begins, [*begins[1:], len(texts)]):
            self.open = texts[i:j]
            if j < len(texts) or not after:
                self._close(kinds, numbers, out)
        self.inside = after
        return kinds, numbers, out

    def _close(self, kinds, numbers, out) -> None:
        kinds.append("record" if self.began_here else "last")
        numbers.append(self.line)
        out.append("\n".join(self.open))
        self.line += self.began_here
        self.began_here, self.open = True, []

    def rest(self) -> tuple[list[str], list[int], list[str]]:
        if not self.open:
            return [], [], []
        return ["first" if self.began_here else "middle"], [self.line], ["\n".join(self.open)]


def _put_together(batches: Iterator[pa.RecordBatch], continued: set) -> Iterator[pa.RecordBatch]:
    now: _Block | None = None

    def out(block: _Block, found) -> Iterator[pa.RecordBatch]:
        kinds, numbers, texts = found
        if kinds:
            n = len(kinds)
            yield pa.RecordBatch.from_arrays([
                pa.array(kinds, pa.string()), pa.array([block.file] * n, pa.string()), pa.array([block.block] * n, pa.int64()),
                pa.array(numbers, pa.int64()), pa.array(texts, pa.string())], ["kind", "file", "block", "line", "text"])

    for batch in batches:
        if not batch.num_rows:
            continue
        files, blocks = batch.column("file").dictionary_encode(), batch.column("block").to_numpy(zero_copy_only=False)
        code = files.indices.to_numpy(zero_copy_only=False)
        change = np.flatnonzero((code[1:] != code[:-1]) | (blocks[1:] != blocks[:-1])) + 1
        for i, j in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
            key = (files.dictionary[int(code[i])].as_py(), int(blocks[i]))
            if now is None or (now.file, now.block) != key:
                if now is not None:
                    yield from out(now, now.rest())
                now = _Block(*key, key in continued)
            yield from out(now, now.add(batch.column("value").slice(i, j - i)))
    if now is not None:
        yield from out(now, now.rest())


def _joined(pieces: DataFrame) -> DataFrame:
    """The records that cross borders, at the place where they begin."""
    step = F.when(F.col("kind") == "first", 1).otherwise(0)  # a block ends one record before it begins the next
    order = Window.partitionBy("file").orderBy("block", step).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begun = F.last(F.when(F.col("kind") == "first", F.struct("block", "line")), ignorenulls=True).over(order)
    owned = pieces.withColumn("begun", begun).groupBy("file", "begun").agg(F.sort_array(F.collect_list(F.struct("block", "text"))).alias("parts"))
    return owned.select("file", F.col("begun.block").alias("block"), F.col("begun.line").alias("line"), F.array_join("parts.text", "\n").alias("text"))


def quoted_records(spark: SparkSession, path: str, names: list[str], escape: str) -> DataFrame:
    """``names`` as text columns, and ``__file``, ``__block``, ``__line`` as the record's place.

    The first record of each file is its header and must hold ``names``. Empty lines are no records.
    """
    lines = _lines(spark, path)
    continued = spark.sparkContext.broadcast(_begun_before(lines))
    pieces = lines.mapInArrow(lambda batches: _put_together(batches, continued.value), _PIECES)
    whole = pieces.where("kind = 'record'").select("file", "block", "line", "text")
    cut = _joined(pieces.where("kind != 'record'"))
    text = F.regexp_replace("text", "\r$", "")
    found = whole.unionByName(cut).withColumn("text", text).where("text != ''")
    marked = F.regexp_replace("text", '"[^"]*+"', "\u0001")
    irregular = F.col("text").contains('"') & marked.rlike('[^,\u0001]\u0001|\u0001[^,\u0001]|"')
    header = (F.col("block") == 0) & (F.col("line") == 0)
    fields = [f"`c{i}` string" for i in range(len(names))]
    cells = F.from_csv("text", ", ".join(fields), {"escape": escape, "multiLine": "true"})
    parsed = found.select("file", "block", "line", "text", header.alias("header"), irregular.alias("irregular"), cells.alias("cells"))
    agrees = F.lit(True)
    for i, name in enumerate(names):
        given = F.regexp_replace(F.col("cells")[f"c{i}"], "^﻿", "")
        agrees &= F.coalesce(F.lower(given) == F.lit(name.lower()), F.lit(name == f"_c{i}"))
    wrong = F.when(F.col("header") & ~agrees, F.raise_error(F.concat(F.lit("another header in "), F.col("file"))).cast("boolean"))
    odd = F.when(F.col("irregular"), F.raise_error(F.concat(
        F.lit("a quote inside a field that does not begin with one (read with parallel=False): "), F.col("file"))).cast("boolean"))
    rows = parsed.where(F.coalesce(wrong, odd, ~F.col("header")))
    return rows.select(*[F.col("cells")[f"c{i}"].alias(c) for i, c in enumerate(names)],
                       F.col("file").alias("__file"), F.col("block").alias("__block"), F.col("line").alias("__line"))
