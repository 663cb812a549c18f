"""Forecast origins and the slices around them, as equi-joins on positions of the grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import Protocol
from . import ordered

KEY = ["station", "pollutant"]


def candidates(series: DataFrame, split: str, stride: int) -> DataFrame:
    """Every ``stride``-th position of the split, with the series' first observed position and length."""
    of_split = F.col("split") == split
    each = series.groupBy(*KEY).agg((F.max("pos") + 1).alias("n"), F.min(F.when(F.col("v").isNotNull(), F.col("pos"))).alias("first_obs"), F.min(F.when(of_split, F.col("pos"))).alias("first_pos"))
    own = series.where(of_split).select(*KEY, "pos").join(each, KEY)
    return own.where((F.col("pos") - F.col("first_pos")) % stride == 0).select(*KEY, F.col("pos").alias("origin_pos"), "n", "first_obs")


def eval_origins(series: DataFrame, split: str, protocol: Protocol) -> DataFrame:
    """Candidates whose whole forward-filled context is there and whose longest horizon ends within the series.

    The stride comes before validity: a candidate that fails is skipped, not replaced. Forward fill leaves only the gap
    before the first value, so a full context is one that begins at or after it.
    """
    start = F.col("origin_pos") - protocol.context + 1
    valid = (start >= 0) & (F.col("origin_pos") + protocol.max_horizon < F.col("n")) & (start >= F.col("first_obs"))
    return candidates(series, split, protocol.stride).where(valid).select(*KEY, F.lit(split).alias("phase"), "origin_pos")


def train_origins(series: DataFrame, protocol: Protocol) -> DataFrame:
    """Strided origins of the training split from ``train_context`` on, whose targets stay within the split."""
    end = series.where(F.col("split") == "train").groupBy(*KEY).agg((F.max("pos") + 1).alias("end"))
    return candidates(series, "train", protocol.train_stride).join(end, KEY).where((F.col("origin_pos") >= protocol.train_context) & (F.col("origin_pos") < F.col("end") - protocol.max_horizon)).select(*KEY, F.lit("train").alias("phase"), "origin_pos")


def with_leads(origins: DataFrame, horizon: int) -> DataFrame:
    """Origins times leads 1 to ``horizon``, and the position they target."""
    rows = origins.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(horizon).cast("long"))).alias("lead"))
    return rows.withColumn("target_pos", F.col("origin_pos") + F.col("lead"))


def actuals(origins: DataFrame, series: DataFrame, horizon: int) -> DataFrame:
    """(origin, lead, y) where the target was observed."""
    target = series.where("v is not null").select(*KEY, F.col("pos").alias("target_pos"), F.col("v").alias("y"))
    return with_leads(origins, horizon).join(target, [*KEY, "target_pos"])


def contexts(series: DataFrame, origins: DataFrame, length: int) -> DataFrame:
    """The ``length`` forward-filled values up to each origin, in order, as one array (for models that want a vector)."""
    filled = ordered.filled(series, KEY, {"v": "ff"}).select(*KEY, "pos", "ff")
    packed = ordered.framed(filled, KEY, {"ctx": lambda w: F.collect_list("ff").over(w.rowsBetween(1 - length, 0))}, before=length - 1).select(*KEY, F.col("pos").alias("origin_pos"), "ctx")
    return origins.join(packed, [*KEY, "origin_pos"])


def covariates(panel: DataFrame, origins: DataFrame, context: int, horizon: int, columns: list[str]) -> DataFrame:
    """(origin, an array for each of ``columns``): the panel from the context's first step to the horizon's last, in order."""
    steps = origins.select(*KEY, "origin_pos", F.explode(F.sequence(F.col("origin_pos") - (context - 1), F.col("origin_pos") + horizon)).alias("pos"))
    rows = steps.join(panel.select("station", "pos", *columns), ["station", "pos"])
    packed = rows.groupBy(*KEY, "origin_pos").agg(F.array_sort(F.collect_list(F.struct("pos", *columns))).alias("x"))
    return packed.select(*KEY, "origin_pos", *[F.col("x")[c].alias(c) for c in columns])


def first_meeting(rows: DataFrame, keys: list[str], wanted: Column, order: str) -> DataFrame:
    """(keys, order): the first row of each group that is ``wanted``, else its first."""
    return rows.groupBy(*keys).agg(F.min(F.struct((~F.coalesce(wanted, F.lit(False))).alias("not"), order)).alias("m")).select(*keys, F.col(f"m.{order}").alias(order))
