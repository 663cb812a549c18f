"""Conformal intervals: split, and stratified by wind, mixing height and time of day (and episode regime), with backoff."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import day_night, hour_bucket, tercile
from . import ordered
from .grid import forward_filled
from .origins import KEY
from .quantiles import interpolated


def rank_of(n: Column, alpha: float) -> Column:
    """The 1-based rank that the quantile takes among n sorted residuals."""
    level = F.least(F.lit(1.0), F.ceil((n + 1) * F.lit(1 - alpha)) / n)
    return (F.ceil(level * (n - 1)) + 1).cast("long")


def quantiles(residuals: DataFrame, keys: list[str], alpha: float, value: str = "res", buckets: int = 256) -> DataFrame:
    """(keys, n, q) of the absolute values; nulls don't count.

    The exact order statistic of groups of any size: approximate percentiles cut a group into ``buckets``, their counts
    say which one holds the rank, and that one's distinct sizes are counted up to it. No task ranks a whole group.
    """
    own = residuals.where(F.col(value).isNotNull()).select(*[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"_{k}") for k in keys], *keys, F.abs(value).alias("size"))
    by = [f"_{k}" for k in keys]  # without nulls, so that they join
    share = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    groups = own.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("size", share, 10 * buckets).alias("cut"), *[F.first(k).alias(k) for k in keys])
    groups = groups.withColumn("rank", rank_of(F.col("n"), alpha))
    at = F.size(F.filter("cut", lambda c: c < F.col("size")))
    placed = own.drop(*keys).join(groups.select(*by, "cut"), by).select(*by, "size", at.alias("bucket")).groupBy(*by, "bucket", "size").agg(F.count(F.lit(1)).alias("k"))
    up = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    counts = placed.groupBy(*by, "bucket").agg(F.sum("k").alias("k")).withColumn("until", F.sum("k").over(up))
    hit = counts.join(groups.drop("cut"), by).withColumn("before", F.col("until") - F.col("k")).where("before < rank and rank <= until").drop("k", "until")
    inside = Window.partitionBy(*by).orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    found = placed.join(hit, [*by, "bucket"]).withColumn("until", F.col("before") + F.sum("k").over(inside)).where("until >= rank")
    return found.groupBy(*by).agg(*[F.first(k).alias(k) for k in keys], F.first("n").alias("n"), F.min("size").alias("q")).select(*keys, "n", "q")


def terciles(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ws_edges, blh_edges) over all calibration rows, with or without a residual."""
    each = lambda c, name: interpolated(rows, keys, c, {"a": 1 / 3, "b": 2 / 3}).select(*keys, F.array("a", "b").alias(f"{name}_edges"))
    return each("ws10", "ws").join(each("blh", "blh"), keys)


def binned(rows: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """w, b (missing values are in the last bin), hour buckets h4 and h2."""
    return rows.join(edges, keys).withColumns({"w": tercile(F.col("ws10"), F.col("ws_edges")), "b": tercile(F.col("blh"), F.col("blh_edges")), "h4": hour_bucket(F.col("hour")), "h2": day_night(F.col("hour"))}).drop("ws_edges", "blh_edges")


LEVELS_3D = {"cell": ["w", "b", "h4"], "wsblh": ["w", "b"], "global": []}
LEVELS_4D = {"cell": ["w", "b", "h2", "r"], "cell3": ["w", "b", "h2"], "wsblh": ["w", "b"], "global": []}


def fit(rows: DataFrame, keys: list[str], levels: dict[str, list[str]], alpha: float, n_min: int) -> DataFrame:
    """(keys, level, the cell's columns or null, n, q): every level of ``n_min`` residuals or more, the global one always.

    Each residual is replicated once a level, coarser cells with nulls, and ranked once for all levels.
    """
    cell = list(dict.fromkeys(c for cs in levels.values() for c in cs))
    copies = F.explode(F.array(*[F.struct(F.lit(name).alias("level"), *[(F.col(c) if c in cs else F.lit(None).cast("long")).alias(c) for c in cell]) for name, cs in levels.items()]))
    each = rows.select(*keys, "res", copies.alias("x")).select(*keys, "res", "x.*")
    return quantiles(each, [*keys, "level", *cell], alpha).where((F.col("level") == "global") | (F.col("n") >= n_min))


BINS = {"w": 3, "b": 3, "h4": 4, "h2": 2, "r": 2}


def with_cells(groups: DataFrame, cells: list[str]) -> DataFrame:
    """Every cell of the given axes for each row of ``groups``."""
    axis = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BINS[c] - 1).cast("long"))).alias(c)
    return reduce(lambda d, c: d.select("*", axis(c)), cells, groups)


def resolve(model: DataFrame, keys: list[str], levels: dict[str, list[str]], name: str = "q") -> DataFrame:
    """(keys, the finest level's columns, name): every cell with the quantile of the finest level that has it; a row a cell."""
    cells = next(iter(levels.values()))
    out = with_cells(model.select(*keys).distinct(), cells)
    for level, cs in levels.items():
        out = out.join(model.where(F.col("level") == level).select(*keys, *cs, F.col("q").alias(f"_{level}")), [*keys, *cs], "left")
    return out.select(*keys, *cells, F.coalesce(*[F.col(f"_{level}") for level in levels]).alias(name))


def apply(rows: DataFrame, cells: DataFrame, keys: list[str], levels: dict[str, list[str]]) -> DataFrame:
    """``rows`` with the quantile that ``resolve`` found for their cell: one join, with as many rows as there are cells."""
    return rows.join(F.broadcast(cells), [*keys, *next(iter(levels.values()))], "left")


def cell_summary(counts: DataFrame, keys: list[str], n_min: int) -> DataFrame:
    """(keys, cells, lo, median, enough): how the cells of ``cell_counts`` are filled, and how many have ``n_min`` or more."""
    return counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("cells"), F.min("n").alias("lo"), F.median("n").alias("median"), F.count_if(F.col("n") >= n_min).alias("enough"))


def cell_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Residuals in each of the 3 x 3 x 2 x 2 cells, empty ones too."""
    full = with_cells(rows.select(*keys).distinct(), ["w", "b", "h2", "r"])
    n = rows.where("res is not null").groupBy(*keys, "w", "b", "h2", "r").agg(F.count(F.lit(1)).alias("n"))
    return full.join(n, [*keys, "w", "b", "h2", "r"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def lookback(panel: DataFrame, series: DataFrame, hours: int = 24) -> DataFrame:
    """(station, pollutant, origin_pos, cbar): the mean of the forward-filled values of the last ``hours``."""
    ff = forward_filled(series, {"v": "ff"}).select(*KEY, "pos", "ff")
    mean = ordered.framed(ff, KEY, {"cbar": lambda w: F.avg("ff").over(w.rowsBetween(1 - hours, 0))}, before=hours - 1)
    return mean.select(*KEY, F.col("pos").alias("origin_pos"), "cbar")


def episode_cuts(panel: DataFrame, means: DataFrame, origins: DataFrame, hours: int = 24) -> DataFrame:
    """(pollutant, c3, blh_lo, ws_lo): upper third of lookback means, lower thirds of the lookback hours' blh and wind."""
    own = origins.join(means, [*KEY, "origin_pos"])
    c3 = interpolated(own, ["pollutant"], "cbar", {"c3": 2 / 3})
    steps = origins.select(*KEY, F.explode(F.sequence(F.col("origin_pos") - (hours - 1), F.col("origin_pos"))).alias("pos"))
    met = steps.join(panel.select("station", "pos", "blh", "ws10"), ["station", "pos"])
    low = [interpolated(met, ["pollutant"], c, {name: 1 / 3}) for c, name in (("blh", "blh_lo"), ("ws10", "ws_lo"))]
    return c3.join(low[0], "pollutant").join(low[1], "pollutant")


def regimes(panel: DataFrame, means: DataFrame, origins: DataFrame, cuts: DataFrame, hours: int = 24, least: int = 6) -> DataFrame:
    """(origin, r): 1 in an episode, high concentration or ``least`` stagnant hours of the lookback; a missing hour isn't stagnant."""
    steps = origins.select(*KEY, "phase", "origin_pos", F.explode(F.sequence(F.col("origin_pos") - (hours - 1), F.col("origin_pos"))).alias("pos"))
    still = F.coalesce((F.col("blh") < F.col("blh_lo")) & (F.col("ws10") < F.col("ws_lo")), F.lit(False)).cast("long")
    n = steps.join(panel.select("station", "pos", "blh", "ws10"), ["station", "pos"]).join(F.broadcast(cuts), "pollutant").groupBy(*KEY, "phase", "origin_pos", "c3").agg(F.sum(still).alias("nstag"))
    return n.join(means, [*KEY, "origin_pos"]).select(*KEY, "phase", "origin_pos", "cbar", "nstag", F.when((F.col("cbar") >= F.col("c3")) | (F.col("nstag") >= least), 1).otherwise(0).cast("long").alias("r"))
