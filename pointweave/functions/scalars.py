"""Scalar column expressions shared by all operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def as_col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seconds(ts: ColumnLike) -> Column:
    """Wall-clock timestamp as float seconds since 1970, whatever the session time zone is."""
    c = as_col(ts)
    whole = F.unix_date(c.cast("date")) * F.lit(86400) + F.hour(c) * 3600 + F.minute(c) * 60
    micros = whole.cast("bigint") * 1000000 + (F.extract(F.lit("SECOND"), c) * 1000000).cast("bigint")
    return micros / F.lit(1e6)


def ratio(num: ColumnLike, den: ColumnLike) -> Column:
    """``num / den`` as double, NULL where the denominator is zero."""
    return as_col(num).cast("double") / F.nullif(as_col(den).cast("double"), F.lit(0.0))


def finite(c: ColumnLike) -> Column:
    """NaN and infinities become NULL: the one missing-value marker used downstream."""
    x = as_col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def clip(c: ColumnLike, lo: float | None = None, hi: float | None = None) -> Column:
    x = as_col(c)
    y = x if lo is None else F.greatest(x, F.lit(lo))
    y = y if hi is None else F.least(y, F.lit(hi))
    return F.when(x.isNotNull(), y)


def hash_key(salt: str, *cols: ColumnLike) -> Column:
    """Uniform, reproducible sort key: md5 of the salt and the columns, joined by '_'."""
    parts = [F.lit(salt)] + [as_col(c).cast("string") for c in cols]
    return F.md5(F.concat_ws("_", *parts))


def dot(a: ColumnLike, b: ColumnLike) -> Column:
    """Inner product of two equally long numeric arrays."""
    prod = F.zip_with(as_col(a), as_col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0), lambda acc, v: acc + v)


def sq_distance(a: ColumnLike, b: ColumnLike) -> Column:
    """Squared Euclidean distance of two equally long numeric arrays."""
    diff = F.zip_with(as_col(a), as_col(b), lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(diff, F.lit(0.0), lambda acc, v: acc + v * v)


def correlation(x: ColumnLike, y: ColumnLike) -> Column:
    """Pearson correlation aggregate over complete pairs; NULL, not an error, when one side is constant."""
    a, b = as_col(x), as_col(y)
    px, py = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return ratio(F.covar_pop(a, b), F.stddev_pop(px) * F.stddev_pop(py))


def regression_slope(y: ColumnLike, x: ColumnLike) -> Column:
    """Least-squares slope aggregate over complete pairs; NULL for a constant x."""
    a, b = as_col(x), as_col(y)
    return ratio(F.covar_pop(a, b), F.var_pop(F.when(b.isNotNull(), a)))


#: Coefficients of the published rational approximation of the complementary error function
#: (relative error below 1.2e-7), constant term first.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def normal_tails(z: ColumnLike) -> Column:
    """Two-sided p of a standard normal score."""
    x = F.abs(as_col(z)) / F.lit(2.0 ** 0.5)
    t = F.lit(1.0) / (F.lit(1.0) + x * 0.5)
    poly = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = F.lit(c) + t * poly
    return t * F.exp(-x * x + poly)


def normal_tails_sql(z: str) -> str:
    """The same formula as SQL text."""
    x = f"(abs({z}) / sqrt(2.0::DOUBLE))"
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + {x} * 0.5::DOUBLE))"
    poly = f"({ERFC[-1]!r}::DOUBLE)"
    for c in reversed(ERFC[:-1]):
        poly = f"(({c!r}::DOUBLE) + {t} * {poly})"
    return f"{t} * exp(-{x} * {x} + {poly})"


def names(cols: Sequence[str] | str) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)
