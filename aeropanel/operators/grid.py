"""The dense time grid and what aligns to it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from ..schema import POLLUTANTS, Protocol
from . import ordered


def grid(stations: DataFrame, protocol: Protocol) -> DataFrame:
    """Every station at every step of [start, end): pos counts steps from 0."""
    start = F.lit(protocol.start).cast("timestamp_ntz")
    steps = F.timestamp_diff(protocol.unit.upper(), start, F.lit(protocol.end).cast("timestamp_ntz"))
    rows = stations.select("*", F.explode(F.sequence(F.lit(0).cast("long"), steps - 1)).alias("pos"))
    return rows.withColumn("ts", F.timestamp_add(protocol.unit.upper(), F.col("pos").cast("int"), start))


def reindex(slots: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``slots`` with the values of ``rows`` where there are some; rows off the grid or without a time go."""
    return slots.join(rows.where(F.col(keys[-1]).isNotNull()), keys, "left")


def series(panel: DataFrame, columns: list[str] = POLLUTANTS) -> DataFrame:
    """Long form: (station, pollutant, pos, ts, split, v)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("pollutant"), F.col(c).cast("double").alias("v")) for c in columns]))
    return panel.select("station", "pos", "ts", "split", pairs.alias("p")).select("station", "p.pollutant", "pos", "ts", "split", "p.v")


def completeness(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """The share of slots with a value by ``keys``."""
    return rows.groupBy(*keys).agg((F.count(value) / F.count(F.lit(1))).alias("completeness"))


def forward_filled(rows: DataFrame, values: dict[str, str], keys: tuple[str, ...] = ("station", "pollutant")) -> DataFrame:
    """Each of ``values`` (column to result) as its last value so far; a gap before the first stays. A series is scanned in blocks."""
    return ordered.filled(rows, keys, values)


def back_filled(rows: DataFrame, values: dict[str, str], keys: tuple[str, ...] = ("station", "pollutant")) -> DataFrame:
    """The next value from here on; a gap after the last stays."""
    return ordered.filled(rows, keys, values, back=True)


def _whole(v: Column, k: int, w: WindowSpec, aggregate: Callable[[Column], Column]) -> Column:
    rows = w.rowsBetween(1 - k, 0)
    return F.when(F.count(v).over(rows) == k, aggregate(v).over(rows))


def strict_mean(v: Column, k: int) -> Callable[[WindowSpec], Column]:
    """Mean of the last k values, null unless all are there; for ``ordered.framed``, which has to look back k - 1 rows."""
    return lambda w: _whole(v, k, w, F.avg)


def strict_std(v: Column, k: int) -> Callable[[WindowSpec], Column]:
    return lambda w: _whole(v, k, w, F.stddev_samp)


def lagged(v: Column, k: int) -> Callable[[WindowSpec], Column]:
    return lambda w: F.lag(v, k).over(w)
