"""Diebold-Mariano tests on losses by origin, and Benjamini-Hochberg control of the false discovery rate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import student_tail_of
from ..sources.shared import materialize
from . import ordered
from .grid import lagged


def origin_losses(rows: DataFrame) -> DataFrame:
    """(pollutant, model, station, origin_pos, loss): the mean absolute error of each origin."""
    return rows.groupBy("pollutant", "model", "station", "origin_pos").agg(F.avg("ae").alias("loss"))


def families(spark: SparkSession, models: list[str], named: dict[str, list[tuple[str, str]]]) -> DataFrame:
    """(pollutant, a, b): every model against the first, and each pollutant's named pairs; no pair twice."""
    pairs = [(p, a, b) for p, own in named.items() for a, b in dict.fromkeys([(models[0], m) for m in models[1:]] + own)]
    return spark.createDataFrame(pairs, "pollutant string, a string, b string")


def paired(losses: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pollutant, a, b, station, origin_pos, d): losses of a less those of b over origins that both have."""
    unit = ["pollutant", "station", "origin_pos"]
    side = lambda m: losses.select(*unit, F.col("model").alias(m), F.col("loss").alias(f"loss_{m}"))
    both = F.broadcast(pairs).join(side("a"), ["pollutant", "a"]).join(side("b"), [*unit, "b"])
    return both.select("pollutant", "a", "b", "station", "origin_pos", (F.col("loss_a") - F.col("loss_b")).alias("d")).where("d is not null")


def diebold_mariano(differences: DataFrame, lag: int = 0) -> DataFrame:
    """(pollutant, a, b, n, mean_diff, dm) with the small-sample correction; dm is 0 for under 3 origins or no variance.

    Origins follow each other by station and position, over station borders too. The autocovariance at k is the mean
    over the n - k overlapping pairs. Origins are dealt out in sorted blocks; no task holds a comparison.
    """
    key = ["pollutant", "a", "b"]
    rows, past = differences, {f"dev{k}": lagged(F.col("dev"), k) for k in range(1, lag + 1)}
    if lag:  # places by sorted blocks, over which lags reach
        placed = ordered.scan(ordered.laid_out(differences, key, ["station", "origin_pos"], "differences"), key, ["station", "origin_pos"], add={"place": F.lit(1).cast("long")})
        rows = materialize(placed.select(*key, "d", "place"), "placed")
    dev = rows.join(rows.groupBy(*key).agg(F.avg("d").alias("mean")).hint("broadcast"), key).withColumn("dev", F.col("d") - F.col("mean"))  # a row a comparison
    dev = ordered.framed(dev, key, past, before=lag, place="place", size=max(8192, lag)) if lag else dev
    by = dev.groupBy(*key).agg(
        F.count("d").alias("n"),
        F.avg("d").alias("mean_diff"),
        F.avg(F.col("dev") * F.col("dev")).alias("g0"),
        F.max(F.abs("d")).alias("most"),
        *[F.avg(F.col("dev") * F.col(f"dev{k}")).alias(f"g{k}") for k in range(1, lag + 1)],
    )
    s = F.col("g0")
    for k in range(1, lag + 1):
        s = s + 2 * F.coalesce(F.col(f"g{k}"), F.lit(0.0))
    n, h = F.col("n"), lag + 1
    factor = F.sqrt(F.greatest((n + 1 - 2 * h + F.lit(float(h * (h - 1))) / n) / n, F.lit(1e-12)))
    dm = F.when((n < 3) | (F.col("most") <= 1e-8) | (s <= 0), F.lit(0.0)).otherwise(F.col("mean_diff") / F.sqrt(F.when(s > 0, s) / n) * factor)
    return by.select(*key, "n", "mean_diff", dm.alias("dm"))


def with_p_values(tests: DataFrame) -> DataFrame:
    """Two-sided p of Student's t with n - 1 degrees of freedom; 1 where dm is 0."""
    return tests.withColumn("p", F.when(F.col("dm") == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * student_tail_of(F.abs("dm"), (F.col("n") - 1).cast("double")))))


def benjamini_hochberg(tests: DataFrame, by: list[str], p: str = "p", order: list[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """q: the smallest p * m / rank at this rank or above, 1 at most; reject where q <= alpha."""
    ranks = Window.partitionBy(*by).orderBy(p, *(order or []))
    up = Window.partitionBy(*by).orderBy("rank").rowsBetween(0, Window.unboundedFollowing)
    m = F.count(F.lit(1)).over(Window.partitionBy(*by))
    raw = tests.withColumn("rank", F.row_number().over(ranks).cast("long")).withColumn("raw", F.col(p) * m / F.col("rank"))
    return raw.withColumn("q", F.least(F.lit(1.0), F.min("raw").over(up))).withColumn("reject", F.col("q") <= alpha).drop("raw")
