"""Sources and sinks. Every reader turns NaN into null."""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import clean
from ..schema import MANIFEST, stations
from .cache import cached

_HOURLY = "hourly struct<time: array<string>, temperature_2m: array<double>, surface_pressure: array<double>, wind_speed_10m: array<double>, wind_direction_10m: array<double>, precipitation: array<double>, boundary_layer_height: array<double>>"


def clean_missing(df: DataFrame) -> DataFrame:
    """All floating columns through ``clean``."""
    return df.select(*[clean(F.col(f"`{c}`")).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])


def ensure_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Exactly ``columns`` (name to type): those absent are null, others go."""
    return df.select(*[(F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])


def read_panel(spark: SparkSession, path: str, station: str | None = None) -> DataFrame:
    """A panel written by ``write_panel``; one station reads its partition alone."""
    df = clean_missing(spark.read.parquet(path))
    return df.where(F.col("station") == station) if station else df


def write_panel(panel: DataFrame, path: str) -> None:
    panel.repartition("station").sortWithinPartitions("pos").write.mode("overwrite").partitionBy("station").parquet(path)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, recursiveFileLookup=True)


def write_results(df: DataFrame, path: str) -> None:
    """A result table, small by what it is: one CSV file."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def epoch_to_timestamp(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def union_years(parts: list[DataFrame], keys: list[str], order: str) -> DataFrame:
    """All yearly tables, columns that some lack as nulls, the first row of each key by ``order``."""
    return keep_first(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), keys, [order])


def parse_years(spec: str) -> list[int]:
    """"2019-2024" (both ends count) or "2019,2021"."""
    if "-" in spec:
        first, last = map(int, spec.split("-"))
        return list(range(first, last + 1))
    return [int(x) for x in spec.split(",") if x.strip()]


def read_years(spark: SparkSession, pattern: str, years: list[int], keys: list[str], order: str) -> DataFrame:
    """``union_years`` of the Parquet tables at ``pattern``, which has {year}; a year without one is skipped with a warning, all of them are an error."""
    parts = []
    for year in years:
        try:
            parts.append(spark.read.parquet(pattern.format(year=year)))
        except AnalysisException as why:
            warnings.warn(f"no table of {year}: {why.getCondition()}", stacklevel=2)
    if not parts:
        raise ValueError(f"no table of {years} at {pattern}")
    return union_years(parts, keys, order)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key, the first by ``order``; rows whose last key is null go."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.where(F.col(keys[-1]).isNotNull()).withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def unpack_hourly_json(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Weather payloads of column-oriented JSON, ``{"hourly": {"time": [...], ...}}``, to a row an hour with wind components."""
    h = F.from_json(column, _HOURLY)["hourly"]
    zipped = F.arrays_zip(*[h[c].alias(c) for c in ("time", "temperature_2m", "surface_pressure", "wind_speed_10m", "wind_direction_10m", "precipitation", "boundary_layer_height")])
    rows = payloads.select(*[c for c in payloads.columns if c != column], F.explode(zipped).alias("r"))
    from ..functions.exprs import wind_u, wind_v

    speed, degrees = F.col("r.wind_speed_10m"), F.col("r.wind_direction_10m")
    f32 = {"t2m_c": F.col("r.temperature_2m"), "sp_hpa": F.col("r.surface_pressure"), "tp_mm": F.col("r.precipitation"), "blh": F.col("r.boundary_layer_height"), "ws10": speed, "wd10": degrees, "u10": wind_u(speed, degrees), "v10": wind_v(speed, degrees)}
    return rows.select(*[c for c in rows.columns if c != "r"], F.col("r.time").cast("timestamp_ntz").alias("ts"), *[x.cast("float").alias(c) for c, x in f32.items()])


def coordinates(metadata: DataFrame, codes: list[str]) -> DataFrame:
    """(site_id, latitude, longitude) of ``codes``, once each."""
    return metadata.where(F.col("site_id").isin(codes)).dropDuplicates(["site_id"]).select("site_id", "latitude", "longitude")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of the files under ``path``."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def utc_now() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def manifest_rows(df: DataFrame) -> DataFrame:
    """The manifest's columns as strings: unknown ones go, missing ones are empty."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in MANIFEST])


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """External forecasts in long form (schema.PREDICTIONS), joined by key, never by position."""
    return clean_missing(spark.read.parquet(path))


def write_losses(losses: DataFrame, path: str) -> None:
    """Losses by origin, a folder a pollutant."""
    losses.repartition("pollutant").write.mode("overwrite").partitionBy("pollutant").parquet(path)


def read_losses(spark: SparkSession, path: str, pollutant: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.where(F.col("pollutant") == pollutant) if pollutant else df


def write_metrics(df: DataFrame, path: str) -> None:
    """A row a JSON object a line, times as text; small by what it is."""
    df.select(*[F.col(c).cast("string") if t.startswith("timestamp") or t == "date" else F.col(c) for c, t in df.dtypes]).coalesce(1).write.mode("overwrite").json(path)


def cached_predictions(spark: SparkSession, path: str, settings: dict, inputs: dict[str, DataFrame], make: Callable[[], DataFrame]) -> DataFrame:
    """The forecasts of these settings over these tables, made and written where there are none; changed data are never served old forecasts."""
    return clean_missing(cached(spark, path, settings, inputs, make)[0])


def with_retries(call: Callable[[], str], retries: int = 4, wait: Callable[[int], float] = lambda attempt: 2 + 3 * attempt) -> str:
    """What a remote source gives, tried ``retries`` times with a growing wait; the last error is raised."""
    for attempt in range(retries):
        try:
            return call()
        except OSError:
            if attempt == retries - 1:
                raise
            time.sleep(wait(attempt))
    raise ValueError("retries has to be 1 or more")


def station_series(spark: SparkSession, path: str, code: str, column: str) -> DataFrame:
    """(pos, v) of one registered station from the panel at ``path``; a station of another source, or of none, is an error."""
    found = stations(spark).where(F.col("code") == code).select("source").first()
    if found is None or found["source"] != "aurn":
        raise NotImplementedError(f"no reader for station {code}, of source {found['source'] if found else 'none'}")
    return read_panel(spark, path, code).select("pos", F.col(column).cast("double").alias("v"))
