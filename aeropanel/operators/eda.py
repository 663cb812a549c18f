"""The numbers behind exploratory figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import interpolated


def monthly_completeness(panel: DataFrame, value: str) -> DataFrame:
    return panel.groupBy("station", F.date_format("ts", "yyyy-MM").alias("month")).agg((F.count(value) / F.count(F.lit(1)) * 100).alias("percent"))


def macro_cycle(panel: DataFrame, value: str, part: Column, name: str) -> DataFrame:
    """Means by station and part of the cycle, then the mean of stations by environment."""
    each = panel.groupBy("station", "env_type", part.alias(name)).agg(F.avg(value).alias("m"))
    return each.groupBy("env_type", name).agg(F.avg("m").alias("mean"))


def episode_rate(panel: DataFrame, value: str, part: Column, name: str) -> DataFrame:
    """Percent of hours at or over the station's q90 (missing hours aren't), then the mean of stations."""
    q = interpolated(panel, ["station"], value, {"q90": 0.9})
    each = panel.join(q, "station").groupBy("station", part.alias(name)).agg((F.avg(F.coalesce(F.col(value) >= F.col("q90"), F.lit(False)).cast("int")) * 100).alias("rate"))
    return each.groupBy(name).agg(F.avg("rate").alias("rate"))


def ventilation(panel: DataFrame, value: str, driver: str) -> DataFrame:
    """Quartiles of ``value`` in the decile bins of ``driver``; bins by the inner edges, centre between the outer ones."""
    rows = panel.where(F.col(value).isNotNull() & F.col(driver).isNotNull()).select(F.col(driver).alias("x"), F.col(value).alias("y"))
    deciles = {f"e{i}": i / 10 for i in range(11)}
    edges = interpolated(rows, [], "x", deciles).select(F.array_sort(F.array_distinct(F.array(*deciles))).alias("e"))  # one row
    bins = F.size(F.filter(F.slice("e", 2, F.greatest(F.size("e") - 2, F.lit(0))), lambda v: F.col("x") >= v)).cast("long")
    binned = rows.crossJoin(F.broadcast(edges)).withColumn("bin", bins)
    quartiles = interpolated(binned, ["bin"], "y", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    by = binned.groupBy("bin", "e").agg(F.count(F.lit(1)).alias("n")).join(quartiles, "bin")
    return by.select("bin", ((F.element_at("e", (F.col("bin") + 1).cast("int")) + F.element_at("e", (F.col("bin") + 2).cast("int"))) / 2).alias("centre"), "q25", "median", "q75", "n")


def log_histogram(panel: DataFrame, value: str, edges: int = 60) -> DataFrame:
    """Counts in bins of equal logarithmic width from max(min, 0.1) to max; the last bin is closed."""
    rows = panel.where(F.col(value) > 0).select(F.log10(F.col(value)).alias("x"))
    ends = panel.where(F.col(value) > 0).agg(F.log10(F.greatest(F.min(value), F.lit(0.1))).alias("lo"), F.log10(F.max(value)).alias("hi"))
    at = F.floor((F.col("x") - F.col("lo")) / F.nullif((F.col("hi") - F.col("lo")) / (edges - 1), F.lit(0.0)))
    return rows.crossJoin(F.broadcast(ends)).where("x >= lo").withColumn("bin", F.least(F.coalesce(at, F.lit(0)), F.lit(edges - 2)).cast("long")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
