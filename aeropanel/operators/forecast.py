"""Forecasters: origins to (origin, lead, yhat). Baselines are joins; others plug in by Arrow batches; ``series_models`` has those that are trained here."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from statistics import NormalDist
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import WEATHER
from . import ordered
from .grid import forward_filled, lagged, strict_mean, strict_std
from .origins import KEY, with_leads

LAGS = [1, 3, 6, 24, 168]
OUT = [*KEY, "model", "phase", "origin_pos", "lead", "yhat"]


def filled(series: DataFrame) -> DataFrame:
    return forward_filled(series, {"v": "ff"}).select(*KEY, "pos", "ff")


def persistence(series: DataFrame, origins: DataFrame, horizon: int) -> DataFrame:
    """The last known value for all leads."""
    last = filled(series).withColumnRenamed("pos", "origin_pos")
    return with_leads(origins.join(last, [*KEY, "origin_pos"]), horizon).select(*KEY, F.lit("persistence").alias("model"), "phase", "origin_pos", "lead", F.col("ff").alias("yhat"))


def seasonal_naive(series: DataFrame, origins: DataFrame, horizon: int, period: int) -> DataFrame:
    """The last ``period`` values, repeated to the horizon."""
    source = F.col("origin_pos") - period + 1 + (F.col("lead") - 1) % period
    past = filled(series).withColumnRenamed("pos", "source_pos")
    return with_leads(origins, horizon).withColumn("source_pos", source).join(past, [*KEY, "source_pos"]).select(*KEY, F.lit(f"seasonal_naive_{period}").alias("model"), "phase", "origin_pos", "lead", F.col("ff").alias("yhat"))


def baselines(series: DataFrame, origins: DataFrame, horizon: int, periods: list[int]) -> DataFrame:
    return reduce(DataFrame.unionByName, [persistence(series, origins, horizon), *[seasonal_naive(series, origins, horizon, p) for p in periods]])


def features(panel: DataFrame, series: DataFrame, origins: DataFrame, horizon: int, future_weather: bool = True, lags: list[int] = LAGS) -> DataFrame:
    """One row an (origin, lead): y0, lags, rolling statistics and weather at the origin, lead, calendar (and weather) at the target, and y.

    Values at the origin are the raw ones: gaps stay null. Origin features are windows over blocks of the series, the rest
    one equi-join with the panel at the target.
    """
    v = F.col("v")
    past = {**{f"lag{k}": lagged(v, k) for k in lags}, "rm3": strict_mean(v, 3), "rm24": strict_mean(v, 24), "rs24": strict_std(v, 24)}
    at_origin = ordered.framed(series, KEY, past, before=max(24, *lags)).select(*KEY, F.col("pos").alias("origin_pos"), v.alias("y0"), *past)
    met = panel.select("station", F.col("pos").alias("origin_pos"), *[F.col(c).cast("double").alias(f"{c}_o") for c in WEATHER])
    target = panel.select("station", F.col("pos").alias("target_pos"), *calendar(F.col("ts")), *([F.col(c).cast("double").alias(f"{c}_t") for c in WEATHER] if future_weather else []))
    y = series.select(*KEY, F.col("pos").alias("target_pos"), v.alias("y"))
    rows = origins.join(at_origin, [*KEY, "origin_pos"]).join(met, ["station", "origin_pos"])
    return with_leads(rows, horizon).join(target, ["station", "target_pos"]).join(y, [*KEY, "target_pos"])


def calendar(ts) -> list:
    """Hour, weekday (Monday 0) and month on circles, and weekend."""
    two_pi = 6.283185307179586
    out = []
    for name, x, period in (("h", F.hour(ts), 24), ("d", F.weekday(ts), 7), ("m", F.month(ts), 12)):
        angle = F.lit(two_pi) * x / period
        out += [F.sin(angle).alias(f"{name}sin"), F.cos(angle).alias(f"{name}cos")]
    return [*out, (F.weekday(ts) >= 5).cast("double").alias("wknd")]


def feature_names(columns: list[str]) -> list[str]:
    return [c for c in columns if c not in (*KEY, "phase", "origin_pos", "target_pos", "y")]


class Forecaster(Protocol):
    """What plugs in: contexts and covariates of a batch of origins to point forecasts and quantiles."""

    def __call__(self, contexts: list[np.ndarray], covariates: dict[str, list[np.ndarray]], horizon: int, quantiles: list[float]) -> tuple[np.ndarray, np.ndarray]:
        """([n, horizon], [n, quantiles, horizon]) of n contexts; a covariate reaches from the context's first step to the horizon's last, gaps as NaN."""


_RESIDENT: dict[str, Forecaster] = {}  # of this worker process


def resident(key: str, load: Callable[[], Forecaster]) -> Forecaster:
    """The model of ``key``, loaded once a worker process, whatever the number of its tasks."""
    if key not in _RESIDENT:
        _RESIDENT[key] = load()
    return _RESIDENT[key]


def batched(contexts: DataFrame, load: Callable[[], Forecaster], horizon: int, name: str, *, covariates: Sequence[str] = (), quantiles: Sequence[float] = (), batch: int = 256) -> DataFrame:
    """Any forecaster on the executors: (origin, lead, yhat, one column q<percent> a quantile, ms).

    ``contexts``: an origin a row with the array ``ctx`` and one of each of ``covariates``. The model is loaded by
    ``load`` once a worker and gets exactly ``batch`` origins at a time, over the borders of Arrow's batches too, but for
    a task's last; no more are held. ``ms``: the milliseconds that the origin's batch took, a forecast.
    """
    keys, columns = [*KEY, "phase", "origin_pos"], ["ctx", *covariates]
    named = [f"q{q * 100:g}".replace(".", "_") for q in quantiles]

    def predicted(rows: pa.Table, model: Forecaster) -> pa.RecordBatch:
        arrays = {c: [np.array(x, float) for x in rows.column(c).to_pylist()] for c in columns}
        began = time.perf_counter()
        point, spread = model(arrays["ctx"], {c: arrays[c] for c in covariates}, horizon, list(quantiles))
        ms = (time.perf_counter() - began) * 1000 / len(rows)
        if np.shape(point) != (len(rows), horizon) or quantiles and np.shape(spread) != (len(rows), len(quantiles), horizon):
            raise ValueError(f"{name} gave forecasts of shape {np.shape(point)} and quantiles of shape {np.shape(spread)} for {len(rows)} origins")
        lists = [pa.array(list(np.asarray(x, float)), pa.list_(pa.float64())) for x in (point, *(np.asarray(spread)[:, i] for i in range(len(quantiles))))]
        return pa.RecordBatch.from_arrays([*(rows.column(k).combine_chunks() for k in keys), *lists, pa.array(np.full(len(rows), ms))], [*keys, "yhat", *named, "ms"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held = None, None
        for own in batches:
            model = model or resident(name, load)
            held = pa.Table.from_batches([own]) if held is None else pa.concat_tables([held, pa.Table.from_batches([own])])
            whole = len(held) // batch * batch
            for at in range(0, whole, batch):
                yield predicted(held.slice(at, batch), model)
            held = held.slice(whole)
        if held is not None and len(held):
            yield predicted(held, model)

    rows = contexts.select(*[F.col(k).cast("long" if k == "origin_pos" else "string").alias(k) for k in keys], *[F.col(c).cast("array<double>").alias(c) for c in columns])
    lists = "".join(f", {c} array<double>" for c in ("yhat", *named))
    packed = rows.mapInArrow(run, f"station string, pollutant string, phase string, origin_pos long{lists}, ms double")
    each = packed.select(*keys, "ms", F.posexplode(F.arrays_zip("yhat", *named)).alias("i", "x"))
    return each.select(*KEY, F.lit(name).alias("model"), "phase", "origin_pos", (F.col("i") + 1).cast("long").alias("lead"), *[F.col("x")[c].alias(c) for c in ("yhat", *named)], "ms")


class Drift:
    """The context's mean slope carried on, with normal quantiles of its steps' deviation and a pull by the wind to come.

    A forecast of a lead l is last + l * slope - pull * (wind at l - the context's mean wind), a missing wind pulling nothing.
    """

    def __init__(self, pull: float = 0.1) -> None:
        self.pull = pull

    def __call__(self, contexts: list[np.ndarray], covariates: dict[str, list[np.ndarray]], horizon: int, quantiles: list[float]) -> tuple[np.ndarray, np.ndarray]:
        lead = np.arange(1, horizon + 1)
        point, spread = np.empty((len(contexts), horizon)), np.empty((len(contexts), len(quantiles), horizon))
        for i, x in enumerate(contexts):
            point[i] = x[-1] + lead * (x[-1] - x[0]) / (len(x) - 1)
            for wind in (w[i] for w in covariates.values()):
                past = wind[: len(x)]
                mean = past[~np.isnan(past)].mean() if (~np.isnan(past)).any() else np.nan
                point[i] -= self.pull * np.nan_to_num(wind[len(x) :] - mean)
            sd = np.diff(x).std()
            for j, q in enumerate(quantiles):
                spread[i, j] = point[i] + NormalDist().inv_cdf(q) * sd * np.sqrt(lead)
        return point, spread


def stagnation(panel: DataFrame, blh_lo: float, ws_lo: float, hours: int = 24) -> DataFrame:
    """(station, pos, nstag): the stagnant ones of the last ``hours``; a missing hour isn't stagnant."""
    still = F.coalesce((F.col("blh") < blh_lo) & (F.col("ws10") < ws_lo), F.lit(False)).cast("long")
    return ordered.framed(panel, ["station"], {"nstag": lambda w: F.sum(still).over(w.rowsBetween(1 - hours, 0))}, before=hours - 1).select("station", "pos", "nstag")
