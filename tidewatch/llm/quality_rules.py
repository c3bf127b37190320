"""Quality rules with thresholds learned per language and source.

Counts of each text come from built-in functions only. Two base rules reject short texts and
texts made of repeated word windows. Of the texts that pass, quartiles of five rates are taken
by mergeable sketches (``percentile_approx``) at three levels in one aggregate: language and
source, language, everything. A group of fewer than ``LEAST_GROUP`` texts uses its language, and
a language of fewer uses everything. A rate is out of bounds beyond the quartiles by more than
``FENCE`` times their distance; ``SPREADS`` is the least distance that counts, so a rate that
hardly varies does not reject texts over nothing. The thresholds, one row per group, are joined
back to the rows of counts; a third of all rows in one group is split by adaptive execution.

Null texts count as empty: no words, so they fail the base rules. Null languages and sources are
a group of their own. Every input row gives one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.store import row_hash, written

LEAST_WORDS = 50
MOST_REPEATED = 50  # percent of words
LEAST_GROUP = 50
FENCE = 3.0
ACCURACY = 10_000

#: Rate, and the least distance of its quartiles. All but the word length have an upper bound only.
SPREADS = {"symbol_rate": 0.05, "dup_line_rate": 0.15, "repeat_rate": 0.15, "upper_rate": 0.03, "word_length": 0.35}

_SPACE = "[\\x20\\x09-\\x0D]+"


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, width: int = 3) -> Column:
    """How many words lie in a window of ``width`` words that the text holds twice or more."""
    def hashes(w: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(w) - width)
        return F.transform(every, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(width))))

    def covered(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twins = _let(ordered, lambda s: F.filter(s, lambda e, j: F.coalesce(
            (F.get(s, j - 1)["h"] == e["h"]) | (F.get(s, j + 1)["h"] == e["h"]),
            F.get(s, j - 1)["h"] == e["h"], F.get(s, j + 1)["h"] == e["h"], F.lit(False))))
        inside = F.flatten(F.transform(twins, lambda e: F.transform(F.array(*(F.lit(k) for k in range(width))), lambda k: e["i"] + k)))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(F.size(F.array_distinct(inside)))

    return F.when(F.size(words) < width + 1, F.lit(0)).otherwise(
        _let(_let(words, hashes), covered)).cast("long")


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row of counts per input row, with its language and source."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"),
    )
    cut = rows.select(
        "doc_id", "lang", "source", "text",
        F.array_remove(F.split("text", _SPACE), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"),
    )
    return cut.select(
        "doc_id", "lang", "source",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size(F.split("text", "[#*$%&|<>]")) - 1).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size(F.split("text", "\\p{Lu}")) - 1).cast("long").alias("n_upper"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )


def _rates() -> dict[str, Column]:
    words = F.greatest("n_words", F.lit(1))
    return {
        "symbol_rate": F.col("n_symbols") / words, "dup_line_rate": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeat_rate": F.col("n_repeat_words") / words, "upper_rate": F.col("n_upper") / F.greatest("word_chars", F.lit(1)),
        "word_length": F.col("word_chars") / words,
    }


def base_failed() -> Column:
    """Too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def thresholds(rated: DataFrame) -> DataFrame:
    """(lang, source, low, high): bounds of each rate for each group, as structs by rate."""
    quartiles = [F.percentile_approx(c, [0.25, 0.75], ACCURACY).alias(c) for c in SPREADS]
    sketched = rated.where(~F.col("base_failed")).rollup("lang", "source").agg(
        F.grouping_id().alias("level"), F.count("*").alias("n"), *quartiles)
    levels = written(sketched, "quartiles")  # one row per group

    def at(level: int, name: str) -> DataFrame:
        return levels.where(F.col("level") == level).select(
            F.col("lang").alias(f"{name}_lang"), F.col("source").alias(f"{name}_source"), F.struct("n", *SPREADS).alias(name))

    own, lang, every = at(0, "own"), at(1, "by_lang").drop("by_lang_source"), at(3, "by_all").select("by_all")
    groups = own.join(F.broadcast(lang), F.col("own_lang").eqNullSafe(F.col("by_lang_lang"))).join(F.broadcast(every))
    chosen = F.when(F.col("own.n") >= LEAST_GROUP, F.col("own")).when(F.col("by_lang.n") >= LEAST_GROUP, F.col("by_lang")).otherwise(F.col("by_all"))
    groups = groups.select(F.col("own_lang").alias("t_lang"), F.col("own_source").alias("t_source"), chosen.alias("q"))
    bounds = []
    for c, least in SPREADS.items():
        first, third = F.col(f"q.{c}")[0], F.col(f"q.{c}")[1]
        reach = FENCE * F.greatest(third - first, F.lit(least))
        low = first - reach if c == "word_length" else F.lit(0.0)
        bounds += [low.alias(f"{c}_low"), (third + reach).alias(f"{c}_high")]
    return groups.select("t_lang", "t_source", *bounds)


def judge(docs: DataFrame, **columns) -> DataFrame:
    """Counts of every row with ``base_failed`` and the verdict ``kept``."""
    counted = counts(docs, **columns)
    rated = written(counted.select("*", base_failed().alias("base_failed"), *(v.alias(k) for k, v in _rates().items())), "quality-counts")
    limits = thresholds(rated)
    within = F.lit(True)
    for c in SPREADS:
        within &= F.col(c).between(F.col(f"{c}_low"), F.col(f"{c}_high"))
    joined = rated.join(limits, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(within, F.lit(False))).alias("kept"))


def without_rejected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they are."""
    rows = docs.withColumn("__own", row_hash(docs))
    verdicts = judge(rows, id_col="__own", text_col=text_col, lang_col=lang_col, source_col=source_col)
    rejected = verdicts.where(~F.col("kept")).select(F.col("doc_id").alias("__own")).distinct()
    return rows.join(rejected, "__own", "left_anti").select(*(F.col(c) for c in docs.columns))
