"""Column builders for partial moments; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def _target(target) -> Column:
    return target.cast("double") if isinstance(target, Column) else F.lit(float(target))


def _beyond(gap: Column, degree: float) -> Column:
    """max(0, gap) ** degree; NULL where gap is, NaN where it is NaN."""
    d = F.when(gap > 0, gap).when(gap <= 0, F.lit(0.0))
    return d if degree == 1 else d * d if degree == 2 else F.pow(d, F.lit(float(degree)))


def lower_dev(x: Column | str, target, degree: float) -> Column:
    """max(0, target - x) ** degree; degree 0 counts x <= target. NULL, which no average counts, where x or target is NULL;
    a NaN is on neither side in degree 0 and makes the others NaN."""
    x, t = col(x), _target(target)
    if degree == 0:
        return F.when(F.isnan(x) | F.isnan(t), 0.0).when(x <= t, 1.0).when(x > t, 0.0)
    return _beyond(t - x, degree)


def upper_dev(x: Column | str, target, degree: float) -> Column:
    """max(0, x - target) ** degree; degree 0 counts x > target. NULL and NaN as in lower_dev."""
    x, t = col(x), _target(target)
    if degree == 0:
        return F.when(F.isnan(x) | F.isnan(t), 0.0).when(x <= t, 0.0).when(x > t, 1.0)
    return _beyond(x - t, degree)


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows that have a value in every column."""
    return df.dropna(subset=columns)


def lpm(x, target, degree: float) -> Column:
    return F.avg(lower_dev(x, target, degree))


def upm(x, target, degree: float) -> Column:
    return F.avg(upper_dev(x, target, degree))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b; NULL where b is 0."""
    return F.try_divide(a, b)


def lpm_ratio(x, target, degree: float) -> Column:
    low = lpm(x, target, degree)
    return low if degree == 0 else safe_ratio(low, low + upm(x, target, degree))


def upm_ratio(x, target, degree: float) -> Column:
    up = upm(x, target, degree)
    return up if degree == 0 else safe_ratio(up, up + lpm(x, target, degree))


def half_up(x: Column) -> Column:
    """Nearest integer, halves upwards."""
    return F.floor(x + 0.5)


def finite(x: Column | str) -> Column:
    x = col(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def correlation(a: str, b: str) -> Column:
    """Pearson's; NULL where a column is constant."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
