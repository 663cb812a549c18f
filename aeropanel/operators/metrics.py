"""Point and tail metrics over (origin, lead) rows of y and yhat; null pairs never count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .origins import KEY
from .quantiles import interpolated


def errors(predictions: DataFrame, actuals: DataFrame) -> DataFrame:
    """Predictions with the observed y and the absolute error, where both are there."""
    return predictions.join(actuals.select(*KEY, "phase", "origin_pos", "lead", "y"), [*KEY, "phase", "origin_pos", "lead"]).where("yhat is not null").withColumn("ae", F.abs(F.col("y") - F.col("yhat")))


def point_metrics(y: str = "y", yhat: str = "yhat") -> list[Column]:
    """mae, rmse, smape (%; zero denominators don't count), bias (forecast less actual) and n."""
    y, p = F.col(y), F.col(yhat)
    e = p - y
    return [
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.avg(2 * F.abs(e) / F.nullif(F.abs(y) + F.abs(p), F.lit(0.0))) * 100).alias("smape"),
        F.avg(e).alias("bias"),
        F.count(e).alias("n"),
    ]


def tail_threshold(actuals: DataFrame, share: float = 0.9) -> DataFrame:
    """q90 by station and pollutant: the exact, interpolated percentile of the stacked target windows."""
    return interpolated(actuals, KEY, "y", {"q90": share})


def with_tail(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """``is_tail``: y at or over its threshold, ties included, false where something is missing."""
    return rows.join(thresholds, KEY).withColumn("is_tail", F.coalesce(F.col("y") >= F.col("q90"), F.lit(False)))


def cells(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Leaderboard cells of rows with ``is_tail``: overall and tail error, counts; and ``ms_per_forecast`` where rows say what their forecast took."""
    took = [F.avg("ms").alias("ms_per_forecast")] if "ms" in rows.columns else []
    return rows.groupBy(*keys).agg(F.avg("ae").alias("mae"), F.avg(F.when(F.col("is_tail"), F.col("ae"))).alias("mae_topdecile"), F.first("q90").alias("q90"), F.count("ae").alias("n"), F.countDistinct("origin_pos").alias("n_origins"), *took)


def totals(rows: DataFrame, by: list[str]) -> DataFrame:
    """Errors over every subset of ``by``: (by, grouping, mae, rmse, bias, n); a column that a total sums over is null and its bit in ``grouping`` (the first of ``by`` is the highest) is 1."""
    return rows.cube(*by).agg(F.grouping_id().cast("long").alias("grouping"), *[m for m, name in zip(point_metrics(), ("mae", "rmse", "smape", "bias", "n")) if name != "smape"])


def pivot_median(board: DataFrame, metric: str, horizons: list[int]) -> DataFrame:
    """Median over stations: a row a model, a column a horizon."""
    out = board.groupBy("model").pivot("horizon", horizons).agg(F.median(metric))
    return out.select("model", *[F.col(str(h)).alias(f"h{h}") for h in horizons])


def best_model(board: DataFrame, metric: str = "mae") -> DataFrame:
    """The model of the lowest median at each horizon (the first by name of equals)."""
    med = board.groupBy("horizon", "model").agg(F.median(metric).alias("m"))
    return med.groupBy("horizon").agg(F.min(F.struct("m", "model")).alias("b")).select("horizon", F.col("b.model").alias("model"), F.col("b.m").alias(metric))


ORDER = ["persistence", "seasonal_naive_24", "seasonal_naive_72", "seasonal_naive_168", "ridge", "ridge_nowx", "gbt", "gbt_nowx"]


def fixed_place(model: Column) -> Column:
    """The model's place in the tables' fixed order; others after all of these."""
    at = F.array_position(F.array(*map(F.lit, ORDER)), model)
    return F.when(at > 0, at).otherwise(len(ORDER) + 1).cast("long")
