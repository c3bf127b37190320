"""Near-duplicate documents by SimHash fingerprints and pigeonring filtering.

Fingerprint: words are what stands between ASCII white space after lower-casing A-Z, shingles
are runs of ``shingle`` words joined by a space (repeats count; a shorter text is one shingle),
hashed by XXH64 with seed 42. A bit is 1 if it is set in more than half of the hashes. A null
text or one without words has fingerprint zero, which links like any other.

Candidates: fingerprints are cut into ``most_bits + 1`` segments laid out in a ring. If two
differ in at most t bits, then by the pigeonring principle there is a segment from which every
chain of l segments differs in at most l * t / (t + 1) bits, that is l - 1. The first two links
of the chain are the join key: one segment equal, the next with at most one bit changed. Longer
chains and the whole distance are checked on the joined pairs. The key spans some two thirds of
the fingerprint, so only fingerprints that agree nearly everywhere meet, and equal fingerprints
have been reduced to one row before: a group of any size makes one row per distinct fingerprint
and changed bit, never its pairs.

Rows with a null id keep their row; a group of such rows alone has a null component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.components import components
from tidewatch.llm.flat import slices
from tidewatch.llm.store import row_hash, shuffled, written

BITS = 64
SEED = 42


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The fingerprint of one text as an unsigned integer."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, stops[:-1] + 1]
    size = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts[: len(starts) - size + 1].tolist(), stops[size - 1:].tolist())),
        np.uint64, len(words) - size + 1,
    )
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at: at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, fp): a hash of the row and its text's fingerprint as a signed 64-bit integer."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_hash(docs).alias("row"), F.col(text_col).cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                prints = np.array([fingerprint(t, shingle) for t in part.column("text").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), pa.array(prints.view(np.int64))], ["doc_id", "row", "fp"])

    return rows.mapInArrow(work, "doc_id long, row long, fp long")


def segment_masks(most_bits: int) -> list[int]:
    """Bit masks of ``most_bits + 1`` segments of nearly equal width, as unsigned integers."""
    cuts = [BITS * i // (most_bits + 1) for i in range(most_bits + 2)]
    return [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]


def _signed(value: int) -> int:
    return value - 2**BITS if value >= 2 ** (BITS - 1) else value


def near_pairs(prints: DataFrame, most_bits: int = 2) -> DataFrame:
    """(a, b) with a < b: distinct fingerprints ``fp`` of ``prints`` at most ``most_bits`` apart.

    A pair may come up once for each segment its chain can start at.
    """
    if not 1 <= most_bits < BITS // 2:
        raise ValueError("most_bits is 1 to 31")
    masks = segment_masks(most_bits)
    homes, visits = [], []
    for i, mask in enumerate(masks):
        following = masks[(i + 1) % len(masks)]
        key = F.col("fp").bitwiseAND(F.lit(_signed(mask | following)))
        homes.append(F.struct(F.lit(i).alias("ring"), key.alias("key")))
        flips = [0, *(1 << b for b in range(BITS) if following >> b & 1)]
        visits += [F.struct(F.lit(i).alias("ring"), key.bitwiseXOR(F.lit(_signed(f))).alias("key")) for f in flips]
    home = prints.select(F.col("fp").alias("a"), F.inline(F.array(*homes)))
    visit = prints.select(F.col("fp").alias("b"), F.inline(F.array(*visits)))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    within = F.lit(False)
    for i in range(len(masks)):
        chain, reached = F.lit(True), 0
        for length in range(1, len(masks) + 1):
            reached |= masks[(i + length - 1) % len(masks)]
            chain &= F.bit_count(differ.bitwiseAND(F.lit(_signed(reached)))) <= length - 1
        within |= (F.col("ring") == i) & chain
    met = home.join(shuffled(visit), ["ring", "key"]).where((F.col("a") != F.col("b")) & within & (F.bit_count(differ) <= most_bits))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _grouped(docs: DataFrame, shingle: int, most_bits: int, id_col: str, text_col: str) -> DataFrame:
    """(fp, doc_id, row, component_id) for every row."""
    prints = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    heads = written(prints.groupBy("fp").agg(F.min("doc_id").alias("head")), "heads")
    labels = components(near_pairs(heads.select("fp"), most_bits)).withColumnRenamed("node", "fp")
    joined = heads.join(shuffled(labels), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = joined.groupBy("component").agg(F.min("head").alias("component_id"))
    known = joined.select("fp", "component").join(least, "component").select("fp", "component", "component_id")
    return prints.join(shuffled(known), "fp")


def near_duplicates(docs: DataFrame, shingle: int = 3, most_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per input row.

    ``fingerprint`` as 16 lowercase hex digits; ``component_id`` is the smallest id that can be
    reached over links of at most ``most_bits`` differing bits, the row's own included.
    """
    return _grouped(docs, shingle, most_bits, id_col, text_col).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, shingle: int = 3, most_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are the first of their group by id, one for each group.

    Of rows of one id within a group the one with the least hash of its columns stays, and of
    equal rows one.
    """
    grouped = _grouped(docs, shingle, most_bits, id_col, text_col)
    first = grouped.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.min("row").alias("__row"))
    rows = docs.withColumn("__own", row_hash(docs))
    kept = rows.join(first.select("__row"), F.col("__own") == F.col("__row"), "left_semi")
    return kept.dropDuplicates(["__own"]).select(*(F.col(c) for c in docs.columns))
