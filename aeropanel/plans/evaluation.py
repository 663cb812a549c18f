"""Composite plans: panel to origins, forecasts, errors, leaderboards, tests and intervals, for all stations at once."""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bootstrap, compare, conformal, forecast, metrics, origins, series_models
from ..operators.grid import series
from ..schema import EVENTS, Protocol
from ..sources import events
from ..sources.shared import discard
from ..sources.shared import materialize as written

PERIODS = [24, 72]
MODELS = ["persistence", "seasonal_naive_24", "seasonal_naive_72"]
ALPHA_KEYS = ["pollutant", "model"]


@dataclass
class Evaluation:
    """The relations that the plans share; each is a lazy DataFrame."""

    panel: DataFrame
    protocol: Protocol = EVENTS
    periods: tuple[int, ...] = tuple(PERIODS)

    @classmethod
    def of_events(cls, spark: SparkSession, sf_dir: str) -> Evaluation:
        """The panel (stations times steps, whatever the events' number) is written, so the events are scanned once."""
        return cls(written(events.panel(spark, sf_dir), "panel"))

    def __post_init__(self) -> None:
        self._written = [self.panel] if hasattr(self.panel, "written_to") else []

    def _kept(self, df: DataFrame, tag: str) -> DataFrame:
        self._written.append(written(df, tag))
        return self._written[-1]

    def close(self) -> None:
        """Deletes the tables that were written for this evaluation; nothing it gave may be run afterwards."""
        while self._written:
            discard(self._written.pop())

    @property
    def series(self) -> DataFrame:
        return series(self.panel)

    def origins(self, phase: str) -> DataFrame:
        return origins.eval_origins(self.series, phase, self.protocol)

    def actuals(self, phase: str) -> DataFrame:
        return origins.actuals(self.origins(phase), self.series, self.protocol.max_horizon)

    def predictions(self, phase: str) -> DataFrame:
        return forecast.baselines(self.series, self.origins(phase), self.protocol.horizon, list(self.periods))

    def errors(self, phase: str, horizon: int | None = None) -> DataFrame:
        rows = metrics.errors(self.predictions(phase), self.actuals(phase))
        return rows.where(F.col("lead") <= horizon) if horizon else rows

    def tail_errors(self, phase: str = "test") -> DataFrame:
        return metrics.with_tail(self.errors(phase), metrics.tail_threshold(self.actuals(phase)))

    def leaderboard(self, horizons: list[int], rows: DataFrame | None = None) -> DataFrame:
        """Cells of all horizons from one run of the longest; of the baselines, or of ``rows`` with ``is_tail``."""
        rows = self.tail_errors() if rows is None else rows
        rows = rows.select("*", F.explode(F.array(*map(F.lit, horizons))).alias("horizon")).where("lead <= horizon")
        return metrics.cells(rows, ["station", "pollutant", "horizon", "model"])

    @cached_property
    def _units(self) -> DataFrame:
        return self._kept(bootstrap.numbered_units(self.origins("test"), ["pollutant"], ["station", "origin_pos"]), "units")

    def units(self) -> DataFrame:
        return self._units

    def comparisons(self) -> DataFrame:
        models = forecast_names(self.periods)
        return compare.families(self.panel.sparkSession, models, {p: [(models[1], models[-1])] for p in ("no2", "pm25")})

    def significance(self, tail: bool = False) -> DataFrame:
        value = F.when(F.col("is_tail"), F.col("ae")) if tail else F.col("ae")
        return bootstrap.mae_intervals(self.tail_errors(), self.units(), self.protocol.n_boot, value)

    def differences(self, tail: bool = False) -> DataFrame:
        value = F.when(F.col("is_tail"), F.col("ae")) if tail else F.col("ae")
        return bootstrap.mae_differences(self.tail_errors(), self.units(), self.comparisons(), self.protocol.n_boot, value)

    def tests(self, lag: int = 0) -> DataFrame:
        return compare.diebold_mariano(compare.paired(compare.origin_losses(self.errors("test")), self.comparisons()), lag)

    def agreement(self) -> DataFrame:
        """How many comparisons the corrected tests and the intervals judge alike."""
        judged = compare.benjamini_hochberg(compare.with_p_values(self.tests()), ["pollutant"], order=["a", "b"])
        both = judged.join(self.differences(), ["pollutant", "a", "b"])
        return both.groupBy("pollutant").agg(F.count_if(F.col("reject") == F.col("significant")).alias("agree"), F.count(F.lit(1)).alias("total"))

    def strata(self, phase: str) -> DataFrame:
        """(origin, lead, model, y, yhat or null, res, ws10, blh, hour at the target, regime r); every target, with or without a y."""
        met = self.panel.select("station", F.col("pos").alias("target_pos"), "ws10", "blh", F.hour("ts").cast("long").alias("hour"))
        rows = origins.with_leads(self.origins(phase), self.protocol.horizon).join(met, ["station", "target_pos"])
        y = self.actuals(phase).select(*origins.KEY, "origin_pos", "lead", "y")
        rows = rows.join(y, [*origins.KEY, "origin_pos", "lead"], "left").join(self.predictions(phase), [*origins.KEY, "phase", "origin_pos", "lead"])
        return rows.join(self.regimes(phase), [*origins.KEY, "phase", "origin_pos"]).withColumn("res", F.col("y") - F.col("yhat"))

    @cached_property
    def means(self) -> DataFrame:
        return self._kept(conformal.lookback(self.panel, self.series), "means")

    @cached_property
    def _cuts(self) -> DataFrame:
        return self._kept(conformal.episode_cuts(self.panel, self.means, self.origins("cal")), "cuts")

    def cuts(self) -> DataFrame:
        return self._cuts

    def regimes(self, phase: str) -> DataFrame:
        return conformal.regimes(self.panel, self.means, self.origins(phase), self.cuts())

    @cached_property
    def _calibration(self) -> tuple[DataFrame, DataFrame]:
        rows = self._kept(self.strata("cal"), "strata")
        edges = self._kept(conformal.terciles(rows, ALPHA_KEYS), "edges")
        return self._kept(conformal.binned(rows, edges, ALPHA_KEYS), "calibration"), edges

    def calibration(self) -> tuple[DataFrame, DataFrame]:
        """(binned calibration rows, edges), written once."""
        return self._calibration

    def fitted(self, levels: dict[str, list[str]]) -> DataFrame:
        return conformal.fit(self.calibration()[0], ALPHA_KEYS, levels, self.protocol.alpha, self.protocol.n_min)

    @cached_property
    def _intervals(self) -> DataFrame:
        rows = conformal.binned(self.strata("test"), self.calibration()[1], ALPHA_KEYS)
        three, four = (self._kept(self.fitted(levels), "fitted") for levels in (conformal.LEVELS_3D, conformal.LEVELS_4D))  # hundreds of rows
        for model, levels, name in ((three, conformal.LEVELS_3D, "q3"), (four, conformal.LEVELS_4D, "q4")):
            rows = conformal.apply(rows, self._kept(conformal.resolve(model, ALPHA_KEYS, levels, name), "cells"), ALPHA_KEYS, levels)
        whole = three.where("level = 'global'").select(*ALPHA_KEYS, F.col("q").alias("q1"))
        return self._kept(rows.join(F.broadcast(whole), ALPHA_KEYS), "intervals")

    def intervals(self) -> DataFrame:
        """Test targets with the half-widths of split (q1), three-way (q3) and regime-aware (q4) intervals, written once."""
        return self._intervals

    def tail_intervals(self) -> DataFrame:
        return metrics.with_tail(self.intervals(), metrics.tail_threshold(self.actuals("test"))).where("is_tail")

    def coverage_test(self, a: str = "q4", b: str = "q1") -> DataFrame:
        inside = lambda q: (F.abs(F.col("res")) <= F.col(q)).cast("long")
        rows = self.tail_intervals().join(self.units(), ["pollutant", "station", "origin_pos"]).select(*ALPHA_KEYS, "unit_id", inside(a).alias("cov_a"), inside(b).alias("cov_b"))
        return bootstrap.paired_coverage(rows, self.protocol.n_boot, ALPHA_KEYS)

    def trained(self, kind: str, future_weather: bool = True) -> DataFrame:
        """Ridge or boosted trees of each (station, pollutant), on its training origins: predictions of the test origins."""
        train = forecast.features(self.panel, self.series, origins.train_origins(self.series, self.protocol), self.protocol.horizon, future_weather)
        test = forecast.features(self.panel, self.series, self.origins("test"), self.protocol.horizon, future_weather)
        fit = {"ridge": series_models.ridge, "gbt": series_models.Boosting()}[kind]
        return series_models.each_series(train, test, fit, f"{kind}{'' if future_weather else '_nowx'}")

    @cached_property
    def _all_trained(self) -> DataFrame:
        parts = [self.trained(kind, wx) for kind in ("ridge", "gbt") for wx in (True, False)]
        return self._kept(reduce(DataFrame.unionByName, parts), "trained")

    def trained_errors(self) -> DataFrame:
        """Errors of the baselines and of the trained models, with and without the weather ahead, their tail, and what a forecast took.

        Baselines are joins: the time to write them all is shared out among their forecasts.
        """
        began = time.perf_counter()
        baselines = self._kept(self.predictions("test"), "baselines")
        n = baselines.select(*origins.KEY, "model", "origin_pos").distinct().count()
        baselines = baselines.withColumn("ms", F.lit((time.perf_counter() - began) * 1000 / max(1, n)))
        rows = metrics.errors(self._all_trained.unionByName(baselines), self.actuals("test"))
        return metrics.with_tail(rows, metrics.tail_threshold(self.actuals("test")))

    def tail_differences(self, pollutant: str = "pm25") -> DataFrame:
        """Each model's tail error against persistence, resampling only units that have a tail hour."""
        rows = self.tail_errors().where(F.col("is_tail") & (F.col("pollutant") == pollutant))
        units = bootstrap.numbered_units(rows, ["pollutant"], ["station", "origin_pos"])
        pairs = self.comparisons().where((F.col("pollutant") == pollutant) & (F.col("a") == "persistence"))
        return bootstrap.mae_differences(rows, self._kept(units, "tail-units"), pairs, self.protocol.n_boot)


def forecast_names(periods: tuple[int, ...]) -> list[str]:
    return ["persistence", *[f"seasonal_naive_{p}" for p in periods]]
