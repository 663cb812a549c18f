"""Column expressions: no UDF but the Student-t tail."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def clean(x: Column) -> Column:
    """NaN and infinities to null: null alone marks what is missing."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def wind_u(speed: Column, degrees: Column) -> Column:
    return -speed * F.sin(F.radians(degrees))


def wind_v(speed: Column, degrees: Column) -> Column:
    return -speed * F.cos(F.radians(degrees))


def split_label(ts: Column, splits: dict[str, tuple[str, str]]) -> Column:
    """The label of the half-open range that holds ``ts``, else none."""
    out = F.lit("none")
    for label, (a, b) in splits.items():
        out = F.when((ts >= F.lit(a).cast("timestamp_ntz")) & (ts < F.lit(b).cast("timestamp_ntz")), label).otherwise(out)
    return out


def tercile(x: Column, edges: Column) -> Column:
    """0, 1 or 2 by two edges, each the first value of the bin above; a missing x is in the last bin."""
    return F.coalesce((x >= edges[0]).cast("long") + (x >= edges[1]).cast("long"), F.lit(2).cast("long"))


def hour_bucket(hour: Column) -> Column:
    """Four buckets of six hours."""
    return F.least(F.greatest((hour / 6).cast("long"), F.lit(0)), F.lit(3)).cast("long")


def day_night(hour: Column) -> Column:
    """0 from 6 to before 18, else 1."""
    return F.when((hour >= 6) & (hour < 18), 0).otherwise(1).cast("long")


def cyclic(x: Column, period: int) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * x / period
    return F.sin(angle), F.cos(angle)


def covered(y: Column, lo: Column, hi: Column) -> Column:
    return (y >= lo) & (y <= hi)


def winkler(y: Column, lo: Column, hi: Column, alpha: float) -> Column:
    return hi - lo + F.lit(2 / alpha) * F.greatest(lo - y, F.lit(0.0)) + F.lit(2 / alpha) * F.greatest(y - hi, F.lit(0.0))


_LABELS = {"persistence": "Persistence", "ridge": "Ridge", "ridge_nowx": "Ridge, no weather ahead", "gbt": "Boosted trees", "gbt_nowx": "Boosted trees, no weather ahead"}


def display_label(model: Column) -> Column:
    """A model's name for readers: looked up, else made of its own name."""
    known = F.create_map(*[F.lit(x) for pair in _LABELS.items() for x in pair])
    naive = F.concat(F.lit("Seasonal naive, "), F.regexp_extract(model, r"([0-9]+)$", 1), F.lit(" steps"))
    return F.coalesce(F.try_element_at(known, model), F.when(model.startswith("seasonal_naive_"), naive), model)


def model_class(model: Column) -> Column:
    return F.when((model == "persistence") | model.startswith("seasonal_naive"), "baseline").when(model.startswith("ridge") | model.startswith("gbt"), "trained").otherwise("other")


def student_tail(x: float, df: float) -> float:
    """P(T > x) for x >= 0: half the regularised incomplete beta at df / (df + x^2), by its continued fraction (Lentz)."""
    if x != x or df <= 0:
        return float("nan")
    if x < 0:
        return 1 - student_tail(-x, df)
    z, a, b = df / (df + x * x), df / 2, 0.5
    if z >= 1:
        return 0.5

    def beta(z: float, a: float, b: float) -> float:
        if z <= 0:
            return 0.0
        if z > (a + 1) / (a + b + 2):
            return 1 - beta(1 - z, b, a)
        tiny, c = 1e-300, 1.0
        d = 1 / max(1 - (a + b) * z / (a + 1), tiny)
        out = d
        for m in range(1, 500):
            step = m * (b - m) * z / ((a + 2 * m - 1) * (a + 2 * m))
            d, c = 1 / (1 + step * d or tiny), 1 + step / c or tiny
            out *= d * c
            step = -(a + m) * (a + b + m) * z / ((a + 2 * m) * (a + 2 * m + 1))
            d, c = 1 / (1 + step * d or tiny), 1 + step / c or tiny
            out *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return out * math.exp(a * math.log(z) + b * math.log1p(-z) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a

    return beta(z, a, b) / 2


def student_tail_of(x: Column, df: Column) -> Column:
    """``student_tail`` of two columns, in Arrow batches."""

    @F.pandas_udf("double")
    def tail(x: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([student_tail(a, b) for a, b in zip(x, df, strict=True)])

    return tail(x, df)


def register(spark: SparkSession) -> None:
    """``student_tail(x, df)`` for SQL."""

    @F.pandas_udf("double")
    def tail(x: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([student_tail(a, b) for a, b in zip(x, df, strict=True)])

    spark.udf.register("student_tail", tail)
