"""Statistics whose null and degenerate-input rules differ from Spark's own aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.scalars import column


def adjusted_skewness(value: str | Column) -> Column:
    """Sample skewness with the small-sample factor; 0 for a constant, null below 3 values."""
    v = column(value)
    n = F.count(v).cast("double")
    adjusted = F.skewness(v) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    return F.when(n < 3, None).when(F.min(v) == F.max(v), F.lit(0.0)).otherwise(adjusted)


def pearson(x: str | Column, y: str | Column, *, complete: bool = False) -> Column:
    """Pearson r over rows where both sides are present; null when either side is constant.

    ``corr`` divides by zero on a constant, and a merged variance of a constant need not be
    exactly zero, so constancy is read off the minimum and maximum. The regression sums keep
    central moments, skip incomplete rows themselves, and compile to short code. ``complete``
    says that no row has a null on either side.
    """
    x, y = column(x).cast("double"), column(y).cast("double")
    a, b = (x, y) if complete else (F.when(y.isNotNull(), x), F.when(x.isNotNull(), y))
    constant = (F.min(a) == F.max(a)) | (F.min(b) == F.max(b))
    spread = F.sqrt(F.regr_sxx(y, x)) * F.sqrt(F.regr_syy(y, x))
    return F.when(~constant, F.regr_sxy(y, x) / F.nullif(spread, F.lit(0.0)))


def strength(r: str | Column) -> Column:
    """Band of |r|. An undefined correlation is called so."""
    size = F.abs(column(r))
    return (
        F.when(size.isNull(), "undefined")
        .when(size < 0.1, "very weak")
        .when(size < 0.3, "weak")
        .when(size < 0.5, "moderate")
        .otherwise("strong")
    )
