"""Exact interpolated quantiles that stay exact and bounded at any size.

``percentile`` keeps one counter per distinct value of a group in a single task. That is
right for columns known to have few values and unusable for a group holding a third
of 100 TB. Here the same numbers are computed from two reads of the input, whatever its size
(``distributed=False`` asks for ``percentile`` where few distinct values are known):

1. a KLL sketch per group (run when the plan is made), together with any other aggregates of the group, gives a bracket
   around each wanted rank, six times as wide as the sketch's error, and cuts within it;
2. one pass counts rows, collapsing everything outside the brackets to a counter per stretch
   between brackets, so only bracketed values leave the map side (as value, count), sorted
   into slices by the cuts of their bracket;
3. counts of the slices say which of them hold the wanted ranks, and a running count inside
   those alone gives the values.

No step holds a whole group, whatever its share of the rows. Several columns without keys are
treated as groups of one pass (:func:`column_quantiles`): their brackets come from one wide
aggregate, and only bracketed values are turned into rows.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch import schema as S
from tidewatch.functions.attach import by_group, with_row
from tidewatch.session import cut_lineage

#: Size of a sketch; its rank error is below 0.07 % of the rows (one side, in 99 of 100 cases).
_SKETCH = 8_192
_MARGIN = 1 / 200  # on either side of a rank: more than six times that error
_SMALL_GROUP = 2_000  # below this a group is its own bracket
_SLICES = 64  # of a bracket
_HELD_GROUPS = 1_000


def exact_quantiles(
    df: DataFrame, value: str, probs, keys=(), *, bound: int | None = None,
    distributed: bool = True,
) -> DataFrame:
    """One row per group: ``keys``, ``n`` (non-null values) and ``q`` (array, one per prob).

    Linear interpolation between the two nearest order statistics at rank ``p * (n - 1)``.
    ``bound`` is the caller's proof of the number of groups for keys that are not calendar
    columns; without one the group table is written and counted.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(
        *keys, F.col(value).cast("double").alias("__v")
    )
    if not distributed:
        ps = F.array(*[F.lit(float(p)) for p in probs])
        return rows.groupBy(*keys).agg(
            F.count("__v").alias("n"), F.percentile("__v", ps).alias("q")
        )
    probs = [float(p) for p in probs]
    out = _ranked_quantiles(rows, *_bracketed(rows, keys, [], probs, bound), probs, keys)
    if keys:
        return out
    # A global aggregate of an empty input still has one row.
    whole = with_row(rows.sparkSession.range(1), out)
    return whole.select(F.coalesce("n", F.lit(0)).alias("n"), "q")


def grouped_summary(
    df: DataFrame, keys, value: str, quantiles: dict[str, float], aggregates: list[Column],
    *, bound: int | None = None, distributed: bool = True,
) -> DataFrame:
    """``aggregates`` and named exact quantiles of ``value`` per group (no keys: one row).

    The aggregates come from the read that makes the sketches.
    """
    keys = list(keys)
    if not distributed:
        exact = [
            F.percentile(F.col(value).cast("double"), F.lit(p)).alias(name)
            for name, p in quantiles.items()
        ]
        return df.groupBy(*keys).agg(*aggregates, *exact)
    rows = df.withColumn("__v", F.col(value).cast("double"))
    probs = list(quantiles.values())
    table, bound = _bracketed(rows, keys, aggregates, probs, bound)
    internal = [c for c in table.columns if c.startswith("__")]
    valued = rows.where("__v IS NOT NULL").select(*keys, "__v")
    found = _ranked_quantiles(valued, table.select(*keys, *internal), bound, probs, keys)
    found = found.select(*keys, *[F.col("q")[i].alias(name) for i, name in enumerate(quantiles)])
    if keys:
        return by_group(table.drop(*internal), found, keys, null_safe=True, bound=bound)
    return with_row(table.drop(*internal), found)


def _bracketed(rows: DataFrame, keys: list[str], aggregates: list[Column], probs: list[float], bound) -> tuple[DataFrame, int]:
    """Per group its values, their brackets and other aggregates, and a bound of the groups.

    The table is computed here and now: a sketch is drawn at random, so a plan that came to it
    twice could count by one and pick by the other. Of a proven few groups the rows are
    held; other tables are written and counted.
    """
    sketched = rows.groupBy(*keys).agg(
        F.count("__v").alias("__n"), F.kll_sketch_agg_double("__v", F.lit(_SKETCH)).alias("__s"), *aggregates,
    )
    found = _brackets(F.col("__s"), F.col("__n"), probs)
    table = sketched.select(
        *[c for c in sketched.columns if c != "__s"], *[F.when(F.col("__n") > 0, c).alias(k) for k, c in found.items()])
    known = bound if bound is not None else S.group_bound(keys) if keys else 1
    if known is not None and known <= _HELD_GROUPS:
        return rows.sparkSession.createDataFrame(table.collect(), table.schema), known
    table = cut_lineage(table)
    return table, table.count()


def _steps(prob: float) -> list[float]:
    """Ranks that cut the bracket of ``prob`` into slices, its ends included where they are inside."""
    low, wide = prob - _MARGIN, 2 * _MARGIN
    return [r for r in (low + wide * i / _SLICES for i in range(_SLICES + 1)) if 0 < r < 1]


def _brackets(sketch: Column, n: Column, probs: list[float]) -> dict[str, Column]:
    """Columns ``__lo<i>``, ``__hi<i>`` (both inclusive) per prob and ``__cuts``, ascending.

    Small groups are bracketed whole: there a margin could be less than a rank.
    """
    out = {}
    whole = n <= _SMALL_GROUP

    def at(rank: float, beyond: str) -> Column:
        if not 0 < rank < 1:
            return F.lit(beyond).cast("double")
        return F.when(whole, F.lit(beyond).cast("double")).otherwise(F.kll_sketch_get_quantile_double(sketch, F.lit(rank)))

    for i, p in enumerate(probs):
        out[f"__lo{i}"] = at(p - _MARGIN, "-Infinity")
        out[f"__hi{i}"] = at(p + _MARGIN, "Infinity")
    ranks = sorted({r for p in probs for r in _steps(p)})
    none = F.array().cast("array<double>")
    cuts = F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(r) for r in ranks])) if ranks else none
    out["__cuts"] = F.when(whole, none).otherwise(F.array_distinct(cuts))
    return out


def _slice(value: Column, cuts: Column) -> Column:
    """Which stretch between the ``cuts`` a value is in; a value equal to a cut has one of its own."""
    return F.size(F.filter(cuts, lambda c: c < value)) + F.size(F.filter(cuts, lambda c: c <= value))


def _ranked_quantiles(rows: DataFrame, table: DataFrame, bound: int, probs: list[float], keys: list[str]) -> DataFrame:
    """``keys``, ``n``, ``q`` from rows (keys, ``__v``) and their brackets; no row for groups without values."""
    brackets = table.where("__n > 0")
    if keys:
        marked = by_group(rows, brackets, keys, null_safe=True, how="inner", bound=bound)
    else:
        marked = with_row(rows, brackets)
    v = F.col("__v")
    inside = reduce(or_, [v.between(F.col(f"__lo{i}"), F.col(f"__hi{i}")) for i in range(len(probs))])
    stretch = reduce(lambda a, b: a + b, [(v > F.col(f"__hi{i}")).cast("int") for i in range(len(probs))])
    counted = (
        marked.select(
            *keys, "__n", stretch.alias("__g"), F.when(inside, v).alias("__v"),
            F.when(inside, _slice(v, F.col("__cuts"))).otherwise(F.lit(-1)).alias("__b"))
        .groupBy(*keys, "__n", "__g", "__b", "__v")
        .agg(F.count(F.lit(1)).alias("__k"))
    )
    return _picked(counted, probs, keys, bound)


def _picked(counted: DataFrame, probs: list[float], keys: list[str], bound) -> DataFrame:
    """``keys``, ``n``, ``q`` from counts of values.

    ``__g``, ``__b`` order the stretches and slices of a group; ``__v`` is null for what is known
    by its stretch only. Both branches read the counts, as a rule through the same exchange.
    """
    n = F.col("__n")
    place = {f"{side}{i}": edge(F.lit(p) * (n - 1)) for i, p in enumerate(probs) for side, edge in (("l", F.floor), ("u", F.ceil))}
    group = [*keys, "__g", "__b"]
    running = Window.partitionBy(*keys).orderBy("__g", "__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = counted.groupBy(*group, "__n").agg(F.sum("__k").alias("__k"))
    totals = totals.withColumn("__o", F.coalesce(F.sum("__k").over(running), F.lit(0)))
    holds = reduce(or_, [F.col("__o").__le__(r) & (r < F.col("__o") + F.col("__k")) for r in place.values()])
    wanted = totals.where(holds).select(*group, "__o")
    known = bound if bound is not None else S.group_bound(keys)
    wanted_rows = None if known is None else known * 2 * len(probs)
    # No filter on the counts: one that is pushed below them would make this branch another read.
    here = by_group(counted, wanted, group, null_safe=True, how="inner", bound=wanted_rows)
    before = Window.partitionBy(*group).orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = here.withColumn("__r", F.col("__o") + F.coalesce(F.sum("__k").over(before), F.lit(0)))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("__r") <= rank) & (rank < F.col("__r") + F.col("__k")), F.col("__v")))

    picked = ranked.groupBy(*keys, "__n").agg(*[at(r).alias(f"__{name}") for name, r in place.items()])

    def quantile(i: int, p: float) -> Column:
        lower, upper, pos = F.col(f"__l{i}"), F.col(f"__u{i}"), F.lit(p) * (n - 1)
        value = F.when(lower == upper, lower).otherwise(
            (F.ceil(pos) - pos) * lower + (pos - F.floor(pos)) * upper
        )
        lost = F.raise_error(F.lit("quantile rank outside its bracket")).cast("double")
        return F.when(lower.isNull() | upper.isNull(), lost).otherwise(value)

    return picked.select(
        *keys, n.alias("n"), F.array(*[quantile(i, p) for i, p in enumerate(probs)]).alias("q"),
    )


#: How far fences may move while the quartiles they follow move within their brackets.
def _fences(q1, q3, multiplier: float) -> list[tuple[Column, Column]]:
    """Intervals that hold the lower and the upper fence of quartiles known to lie in intervals."""
    k = F.lit(float(multiplier))
    low = (q1[0] - k * (q3[1] - q1[0]), q1[1] - k * F.greatest(q3[0] - q1[1], F.lit(0.0)))
    high = (q3[0] + k * F.greatest(q3[0] - q1[1], F.lit(0.0)), q3[1] + k * (q3[1] - q1[0]))
    return [low, high]


def column_quantiles(df: DataFrame, columns, probs, multiplier: float | None = None) -> DataFrame:
    """One row per column that has values: ``column``, ``n``, ``min``, ``max``, ``q``, all columns at once.

    With a ``multiplier`` (and probs 0.25 and 0.75) also ``lower``, ``upper`` (fences that far
    from the quartiles, in quartile distances) and ``outside``, the values strictly beyond them,
    from the same two reads: where a fence can lie is known from the sketch, and values there
    are kept apart like those around the quartiles.
    """
    columns, probs = list(columns), [float(p) for p in probs]
    number = {c: i for i, c in enumerate(columns)}
    wide = df.select(*[F.col(c).cast("double").alias(f"__c{i}") for c, i in number.items()])
    firsts = []
    for i in number.values():
        c = F.col(f"__c{i}")
        firsts += [
            F.count(c).alias(f"__n{i}"), F.min(c).alias(f"__min{i}"), F.max(c).alias(f"__max{i}"),
            F.kll_sketch_agg_double(c, F.lit(_SKETCH)).alias(f"__s{i}"),
        ]
    sketch = wide.agg(*firsts)
    stats = []
    for i in number.values():
        n = F.col(f"__n{i}")
        found = _brackets(F.col(f"__s{i}"), n, probs)
        ends = [(found[f"__lo{j}"], found[f"__hi{j}"]) for j in range(len(probs))]
        entry = [n.alias("n"), F.col(f"__min{i}").alias("min"), F.col(f"__max{i}").alias("max"), found["__cuts"].alias("cuts")]
        entry += [e.alias(f"{side}{j}") for j, pair in enumerate(ends) for side, e in zip(("lo", "hi"), pair)]
        stats.append(F.when(n > 0, F.struct(*entry)).alias(f"__x{i}"))
    row = sketch.select(*stats)
    if multiplier is not None:
        if probs != [0.25, 0.75]:
            raise ValueError("fences follow from the quartiles")
        row = row.select(*[_with_fences(F.col(f"__x{i}"), multiplier).alias(f"__x{i}") for i in number.values()])
    brackets = len(probs) + (2 if multiplier is not None else 0)
    row = df.sparkSession.createDataFrame(row.collect(), row.schema)  # one row, fixed as in _bracketed

    attached = with_row(wide, row)
    counts, kept = [], []
    for i in number.values():
        v, x = F.col(f"__c{i}"), F.col(f"__x{i}")
        inside = reduce(or_, [v.between(x[f"lo{j}"], x[f"hi{j}"]) for j in range(brackets)])
        stretch = reduce(lambda a, b: a + b, [(v > x[f"hi{j}"]).cast("int") for j in range(brackets)])
        counts += [F.count_if(v.isNotNull() & ~inside & (stretch == g)).alias(f"__o{i}_{g}") for g in range(brackets + 1)]
        kept.append(F.when(inside, F.struct(F.lit(i).alias("i"), stretch.alias("g"), _slice(v, x["cuts"]).alias("b"), v.alias("v"))))
    # Per task one row of counters and the bracketed values of its share: no row is multiplied.
    tasks = attached.groupBy(F.spark_partition_id().alias("__task")).agg(
        *counts, F.flatten(F.collect_list(F.filter(F.array(*kept), lambda e: e.isNotNull()))).alias("__values"))
    beyond = [
        F.struct(F.lit(i).alias("i"), F.lit(g).alias("g"), F.lit(-1).alias("b"), F.lit(None).cast("double").alias("v"), F.col(f"__o{i}_{g}").alias("k"))
        for i in number.values() for g in range(brackets + 1)
    ]
    inner = F.transform("__values", lambda e: F.struct(e["i"].alias("i"), e["g"].alias("g"), e["b"].alias("b"), e["v"].alias("v"), F.lit(1).cast("long").alias("k")))
    long = tasks.select(F.inline(F.concat(F.filter(F.array(*beyond), lambda e: e["k"] > 0), inner)))
    facts = with_row(df.sparkSession.range(1), row).select(
        F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("column"), F.col(f"__x{i}").alias("x")) for c, i in number.items()]))
    ).where("x IS NOT NULL")
    counted = long.groupBy("i", "g", "b", "v").agg(F.sum("k").alias("k"))
    sized = by_group(counted, facts.select("i", F.col("x.n").alias("n")), ["i"], how="inner", bound=len(columns))
    ready = sized.select("i", F.col("n").alias("__n"), F.col("g").alias("__g"), F.col("b").alias("__b"), F.col("v").alias("__v"), F.col("k").alias("__k"))
    picked = _picked(ready, probs, ["i"], len(columns))
    out = by_group(picked, facts.select("i", "column", F.col("x.min").alias("min"), F.col("x.max").alias("max")), ["i"], how="inner", bound=len(columns))
    if multiplier is None:
        return out.select("column", "n", "min", "max", "q")
    k, q1, q3 = F.lit(float(multiplier)), F.col("q")[0], F.col("q")[1]
    fenced = out.select("i", "column", "n", "min", "max", "q", (q1 - k * (q3 - q1)).alias("lower"), (q3 + k * (q3 - q1)).alias("upper"))
    both = by_group(counted, fenced.select("i", "lower", "upper"), ["i"], how="inner", bound=len(columns))
    known = F.col("v").isNotNull()
    far = (known & ((F.col("v") < F.col("lower")) | (F.col("v") > F.col("upper")))) | (~known & F.col("g").isin(0, brackets))
    outside = both.groupBy("i").agg(F.coalesce(F.sum(F.when(far, F.col("k"))), F.lit(0)).alias("outside"))
    return by_group(fenced, outside, ["i"], how="inner", bound=len(columns)).drop("i")


def _with_fences(x: Column, multiplier: float) -> Column:
    """The facts of a column with the intervals of both fences as two more brackets."""
    low, high = _fences((x["lo0"], x["hi0"]), (x["lo1"], x["hi1"]), multiplier)
    return F.when(x.isNotNull(), F.struct(
        *[x[name].alias(name) for name in ("n", "min", "max", "cuts", "lo0", "hi0", "lo1", "hi1")],
        low[0].alias("lo2"), low[1].alias("hi2"), high[0].alias("lo3"), high[1].alias("hi3")))
