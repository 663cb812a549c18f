"""The ``events`` table as an hourly panel of five stations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import split_label, wind_u, wind_v
from ..operators.grid import grid, reindex
from ..schema import EVENTS, Protocol

_PLACES = [("click", "A", "urban_traffic"), ("error", "C", "suburban_industrial"), ("purchase", "B", "urban_background"), ("signup", "B", "urban_background"), ("view", "A", "urban_traffic")]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def places(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_PLACES, "station string, city string, env_type string")


def observations(rows: DataFrame) -> DataFrame:
    """(station, ts, no2, pm25) an hour: mean and maximum of value, to 4 places."""
    return rows.groupBy(F.col("event_type").alias("station"), F.date_trunc("hour", "ts").alias("ts")).agg(F.round(F.avg("value"), 4).alias("no2"), F.round(F.max("value"), 4).alias("pm25"))


def weather(rows: DataFrame) -> DataFrame:
    """Stand-ins for the hour's weather, over all stations."""
    k = F.get_json_object("props", "$.k").cast("double")
    by = rows.groupBy(F.date_trunc("hour", "ts").alias("ts")).agg(
        F.min("value").alias("t2m_c"),
        (F.count(F.lit(1)) + 1000).cast("double").alias("sp_hpa"),
        F.count_if(F.col("event_type") == "error").cast("double").alias("tp_mm"),
        F.round(F.sum("value"), 4).alias("blh"),
        F.round(F.avg(k) / 10, 4).alias("ws10"),
        F.pmod(F.sum("user_id") * 37, F.lit(360)).cast("double").alias("wd10"),
    )
    return by.withColumn("u10", F.round(wind_u(F.col("ws10"), F.col("wd10")), 6)).withColumn("v10", F.round(wind_v(F.col("ws10"), F.col("wd10")), 6))


def panel(spark: SparkSession, sf_dir: str, protocol: Protocol = EVENTS) -> DataFrame:
    """The panel: both tables aligned to the grid, labelled by split."""
    rows = events(spark, sf_dir)
    hours = grid(places(spark), protocol)
    joined = reindex(reindex(hours, observations(rows), ["station", "ts"]), weather(rows), ["ts"])
    return joined.withColumn("split", split_label(F.col("ts"), protocol.splits))
