"""The registered queries: each applies one operator, or one composite plan, to the events panel."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import bootstrap, compare, conformal, eda, forecast, grid, metrics, ordered, origins, quantiles, series_models
from ..schema import EVENTS, MANIFEST, POLLUTANTS, WEATHER, stations
from ..sources import cache, events, readers, sinks
from ..sources.shared import discard, materialize, shared_dir
from .evaluation import Evaluation

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, Query] = {}
P = EVENTS


def _query(f: Query) -> Query:
    _FOUND[f.__name__] = f
    return f


def _on(f: Callable[[Evaluation], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(Evaluation.of_events(spark, sf_dir))

    _FOUND[f.__name__] = run
    return run


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to ``places``; the 1e-9 keeps half-way values from falling either way by the order of a sum."""
    return df.select(*[F.round(F.col(c) + 1e-9, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- sources, grid, panel


@_on
def hourly_grid_reindex(e):
    return e.panel.select("station", "pos", "ts", "no2", "pm25")


@_on
def panel_build(e):
    return e.panel.select("station", "city", "env_type", "pos", "ts", "split", "no2", "pm25", *WEATHER, "wd10")


@_query
def dedup_keep_first(spark, sf_dir):
    rows = events.events(spark, sf_dir).withColumn("hour", F.date_trunc("hour", "ts"))
    return readers.keep_first(rows, ["event_type", "hour"], ["ts", "event_id"]).select("event_type", "hour", "event_id", "value")


@_on
def split_labels(e):
    return e.panel.groupBy("station", "split").agg(F.count(F.lit(1)).alias("n"))


@_on
def split_completeness(e):
    return rounded(grid.completeness(e.series, ["station", "pollutant", "split"], F.col("v")))


@_on
def completeness_gate(e):
    share = grid.completeness(e.series, ["station", "pollutant"], F.col("v"))
    return rounded(share.withColumn("gate", F.when(F.col("completeness") >= 0.75, "OK").otherwise("LOW")))


@_on
def station_summary(e):
    out = e.series.groupBy("station", "pollutant").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean"), F.count("v").alias("n"))
    blh = e.panel.groupBy("station").agg(F.avg(F.col("blh").isNull().cast("double")).alias("blh_missing"))
    return rounded(out.join(blh, "station"))


@_query
def wind_components(spark, sf_dir):
    rows = events.weather(events.events(spark, sf_dir))
    return rows.select("ts", "ws10", "wd10", F.round(exprs.wind_u(F.col("ws10"), F.col("wd10")), 6).alias("u"), F.round(exprs.wind_v(F.col("ws10"), F.col("wd10")), 6).alias("v"))


@_query
def epoch_to_ts(spark, sf_dir):
    rows = events.events(spark, sf_dir).select("event_id", F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts")).alias("epoch"))
    return rows.select("event_id", "epoch", readers.epoch_to_timestamp(F.col("epoch")).cast("timestamp_ntz").alias("second"))


@_query
def json_column_unpack(spark, sf_dir):
    """Packs each day's weather as column-oriented JSON and unpacks it again."""
    w = events.weather(events.events(spark, sf_dir)).withColumn("day", F.to_date("ts"))
    one = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm").alias("time"), "t2m_c", "sp_hpa", "ws10", "wd10", "tp_mm", "blh")
    names = {"time": "time", "temperature_2m": "t2m_c", "surface_pressure": "sp_hpa", "wind_speed_10m": "ws10", "wind_direction_10m": "wd10", "precipitation": "tp_mm", "boundary_layer_height": "blh"}
    days = w.groupBy("day").agg(F.array_sort(F.collect_list(one)).alias("r"))
    payloads = days.select("day", F.to_json(F.struct(F.struct(*[F.col(f"r.{c}").alias(n) for n, c in names.items()]).alias("hourly"))).alias("payload"))
    out = readers.unpack_hourly_json(payloads)
    return out.select("day", "ts", *[F.round(F.col(c).cast("double"), 3).alias(c) for c in ("t2m_c", "sp_hpa", "tp_mm", "ws10", "wd10", "u10", "v10")])


# --- windows and features

HORIZONS = [6, 12, 24]


@_on
def ffill_series(e):
    return grid.forward_filled(e.series, {"v": "ff"}).select(*origins.KEY, "pos", "ff")


@_on
def ffill_bfill_covariates(e):
    rows = e.panel.select("station", "pos", *WEATHER)
    both = grid.back_filled(grid.forward_filled(rows, {c: f"{c}_f" for c in WEATHER}, ("station",)), {c: f"{c}_b" for c in WEATHER}, ("station",))
    return both.select("station", "pos", *[F.coalesce(f"{c}_f", f"{c}_b").alias(c) for c in WEATHER])


@_on
def rolling_stats_strict(e):
    v = F.col("v")
    past = {"rm3": grid.strict_mean(v, 3), "rm24": grid.strict_mean(v, 24), "rs24": grid.strict_std(v, 24)}
    return rounded(ordered.framed(e.series, origins.KEY, past, before=23).select(*origins.KEY, "pos", *past))


@_on
def lag_features(e):
    past = {f"lag{k}": grid.lagged(F.col("v"), k) for k in forecast.LAGS}
    return ordered.framed(e.series, origins.KEY, past, before=max(forecast.LAGS)).select(*origins.KEY, "pos", *past)


@_on
def calendar_features(e):
    return rounded(e.panel.select("station", "pos", *forecast.calendar(F.col("ts"))))


@_on
def test_origins(e):
    return e.origins("test").unionByName(e.origins("cal"))


@_on
def train_origins(e):
    return origins.train_origins(e.series, e.protocol)


@_on
def context_arrays(e):
    rows = origins.contexts(e.series, e.origins("test"), e.protocol.context)
    return rounded(rows.select(*origins.KEY, "origin_pos", F.size("ctx").cast("long").alias("n"), F.aggregate("ctx", F.lit(0.0), lambda a, x: a + x).alias("total"), F.element_at("ctx", -1).alias("last")))


@_on
def future_slices(e):
    rows = origins.with_leads(e.origins("test"), e.protocol.horizon).join(e.panel.select("station", F.col("pos").alias("target_pos"), "ws10", "blh", F.hour("ts").alias("hour")), ["station", "target_pos"])
    return rounded(rows.groupBy(*origins.KEY, "origin_pos").agg(F.count("ws10").alias("n_ws"), F.sum("ws10").alias("ws"), F.sum("blh").alias("blh"), F.sum("hour").alias("hours")))


@_on
def covariate_slices(e):
    """The weather of each test origin from the start of its context to the end of its horizon, in order."""
    rows = origins.covariates(e.panel, e.origins("test"), e.protocol.context, e.protocol.horizon, ["ws10", "blh"])
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return rounded(rows.select(*origins.KEY, "origin_pos", F.size("ws10").cast("long").alias("n"), total("ws10").alias("ws"), total("blh").alias("blh"), F.element_at("ws10", 1).alias("first"), F.element_at("ws10", -1).alias("last")))


@_on
def origins_by_horizon(e):
    """How many origins are valid where only the horizon itself has to fit, and not the longest."""
    parts = [origins.eval_origins(e.series, "test", replace(e.protocol, max_horizon=h)).withColumn("horizon", F.lit(h).cast("long")) for h in HORIZONS]
    return reduce(DataFrame.unionByName, parts).groupBy(*origins.KEY, "horizon").agg(F.count(F.lit(1)).alias("n"))


@_on
def first_complete_day(e):
    """Each series' first position from which a day's values are all there, else its first position."""
    rows = ordered.framed(e.series, origins.KEY, {"whole": lambda w: F.count("v").over(w.rowsBetween(0, 23)) == 24}, before=0, after=23)
    return origins.first_meeting(rows, origins.KEY, F.col("whole"), "pos")


def _features(e, future):
    rows = forecast.features(e.panel, e.series, e.origins("test"), e.protocol.horizon, future)
    return rounded(rows.select(*origins.KEY, "origin_pos", "lead", "y", *forecast.feature_names([c for c in rows.columns if c != "lead"])))


@_on
def direct_features_oracle(e):
    return _features(e, True)


@_on
def direct_features_no_oracle(e):
    return _features(e, False)


# --- forecasts, metrics, leaderboards


def _eval(e, model):
    return rounded(e.errors("test").where(F.col("model") == model).groupBy(*origins.KEY).agg(*metrics.point_metrics()))


@_on
def persistence_eval(e):
    return _eval(e, "persistence")


@_on
def seasonal_naive_eval_24(e):
    return _eval(e, "seasonal_naive_24")


@_on
def seasonal_naive_eval_72(e):
    return _eval(e, "seasonal_naive_72")


@_on
def rolling_origin_info(e):
    """Origins that a rolling evaluation used and skipped (too little context, or no observed target)."""
    tried = origins.candidates(e.series, "test", e.protocol.stride)
    used = e.errors("test").where("model = 'persistence'").select(*origins.KEY, "origin_pos").distinct().withColumn("used", F.lit(1))
    rows = tried.join(used, [*origins.KEY, "origin_pos"], "left")
    return rows.groupBy(*origins.KEY).agg(F.count("used").alias("n_origins"), F.count_if(F.col("used").isNull()).alias("n_skipped"))


@_on
def tail_threshold_q90(e):
    return rounded(metrics.tail_threshold(e.actuals("test")))


@_on
def tail_metrics(e):
    return rounded(e.tail_errors().where("is_tail").groupBy("pollutant", "model").agg(F.avg("ae").alias("mae"), F.count("ae").alias("n"), F.countDistinct("station", "origin_pos").alias("units")))


@_on
def leaderboard_cells(e):
    return rounded(e.leaderboard(HORIZONS).withColumn("horizon", F.col("horizon").cast("long")), 3)


@_on
def leaderboard_pivot_median(e):
    return rounded(metrics.pivot_median(e.leaderboard(HORIZONS).where("pollutant = 'no2'"), "mae", HORIZONS))


@_on
def best_per_horizon(e):
    return rounded(metrics.best_model(e.leaderboard(HORIZONS).where("pollutant = 'pm25'")).withColumn("horizon", F.col("horizon").cast("long")))


@_on
def leaderboard_sorted(e):
    """Models by median error, with their place in the fixed order, label and class."""
    board = e.leaderboard([24]).where("pollutant = 'pm25'").groupBy("model").agg(F.median("mae").alias("mae"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("mae", "model")).cast("long")  # a row a model
    return rounded(board.withColumn("place", place).select("model", "mae", "place", metrics.fixed_place(F.col("model")).alias("fixed"), exprs.display_label(F.col("model")).alias("label"), exprs.model_class(F.col("model")).alias("kind")))


@_on
def single_station_metrics(e):
    """The study of one station: its models' metrics, as a metrics file has them."""
    rows = e.errors("test").where("station = 'click' and pollutant = 'no2'")
    return rounded(rows.groupBy("model").agg(*metrics.point_metrics()))


@_on
def error_totals(e):
    """Errors by pollutant, model and quarter of the horizon, and all their subtotals."""
    rows = e.errors("test").withColumn("quarter", F.floor((F.col("lead") - 1) / 6).cast("long"))
    return rounded(metrics.totals(rows, ["pollutant", "model", "quarter"]))


@_on
def merged_leaderboard(e):
    """Two leaderboards, baseline and external, as one."""
    own = e.leaderboard([24]).select("station", "pollutant", "model", "mae")
    outer = own.where("model = 'seasonal_naive_24'").withColumn("model", F.lit("external"))
    return rounded(own.unionByName(outer, allowMissingColumns=True).groupBy("pollutant", "model").agg(F.median("mae").alias("mae"), F.count("mae").alias("n")))


@_on
def prediction_join(e):
    """External forecasts by key: every second lead is missing, and stays so."""
    outside = e.predictions("test").where("model = 'persistence' and lead % 2 = 0").withColumn("model", F.lit("external"))
    return rounded(metrics.errors(outside, e.actuals("test")).groupBy("pollutant").agg(F.count("ae").alias("n"), F.avg("ae").alias("mae")))


# --- exploration


@_on
def eda_monthly_completeness(e):
    return rounded(eda.monthly_completeness(e.panel, "no2"))


@_on
def eda_diurnal(e):
    return rounded(eda.macro_cycle(e.panel, "no2", F.hour("ts").cast("long"), "hour"))


@_on
def eda_seasonal(e):
    rows = eda.macro_cycle(e.panel, "no2", F.weekday("ts").cast("long"), "part")
    rate = eda.episode_rate(e.panel, "no2", F.weekday("ts").cast("long"), "part")
    return rounded(rows.join(rate, "part"))


@_on
def eda_monthly_climatology(e):
    rows = eda.macro_cycle(e.panel, "no2", F.month("ts").cast("long"), "month")
    rate = eda.episode_rate(e.panel, "no2", F.month("ts").cast("long"), "month")
    return rounded(rows.join(rate, "month"))


@_on
def pooled_q90(e):
    """The 90 % point of all positive values of a pollutant, over stations."""
    rows = e.series.where("v > 0")
    return rounded(quantiles.interpolated(rows, ["pollutant"], "v", {"q90": 0.9}).join(rows.groupBy("pollutant").agg(F.count("v").alias("n")), "pollutant"))


@_on
def refined_quantiles(e):
    """Quartiles and q90 of each pollutant by counted buckets, none of which may hold over 64 values in one task."""
    return rounded(quantiles.interpolated(e.series, ["pollutant"], "v", {"q25": 0.25, "median": 0.5, "q75": 0.75, "q90": 0.9}, most=64))


@_on
def eda_ventilation_deciles(e):
    return rounded(eda.ventilation(e.panel, "pm25", "blh"))


@_on
def eda_corr(e):
    return rounded(e.panel.groupBy("station").agg(F.corr("no2", "ws10").alias("r_ws"), F.corr("pm25", "blh").alias("r_blh")))


@_on
def eda_log_hist(e):
    return eda.log_histogram(e.panel, "pm25")


# --- bootstrap and tests


@_on
def unit_sums(e):
    rows = e.errors("test").join(e.units(), ["pollutant", "station", "origin_pos"])
    return rounded(bootstrap.unit_sums(rows, ["pollutant", "model", "unit_id"], F.col("ae")))


@_on
def per_origin_loss(e):
    return rounded(compare.origin_losses(e.errors("test")))


@_on
def bootstrap_count_matrix(e):
    return bootstrap.draws(e.units(), ["pollutant"], e.protocol.n_boot)


@_on
def bootstrap_mae_ci(e):
    return rounded(e.significance())


@_on
def bootstrap_numpy_ci(e):
    """As ``bootstrap_mae_ci``, each pollutant with the draws of numpy's generator of seed 42, followed from many places at once."""
    parts = []
    for pollutant in POLLUTANTS:  # two: each has its own number of units
        units = e.units().where(F.col("pollutant") == pollutant)
        drawn = bootstrap.NumpyDraws.found(e.panel.sparkSession, max(1, units.count()), e.protocol.n_boot)
        parts.append(bootstrap.mae_intervals(e.tail_errors(), units, e.protocol.n_boot, drawn=drawn))
    return rounded(reduce(DataFrame.unionByName, parts))


@_on
def bootstrap_tail_ci(e):
    return rounded(e.significance(tail=True))


@_on
def bootstrap_dmae_ci(e):
    return rounded(e.differences())


@_on
def bootstrap_tail_dmae_ci(e):
    return rounded(e.differences(tail=True))


@_on
def tail_replication(e):
    """No model beats persistence in the tail, or does it: units with a tail hour alone."""
    return rounded(e.tail_differences())


@_on
def dm_statistic_lag0(e):
    return rounded(e.tests(0))


@_on
def dm_statistic_lag1(e):
    return rounded(e.tests(1))


@_on
def dm_pvalues(e):
    return rounded(compare.with_p_values(e.tests(0)))


@_on
def bh_qvalues(e):
    """Over p = 1 / (1 + dm^2), which SQL can repeat."""
    rows = e.tests(0).withColumn("p", F.round(1 / (1 + F.col("dm") * F.col("dm")), 9))
    return rounded(compare.benjamini_hochberg(rows.select("pollutant", "a", "b", "p"), ["pollutant"], order=["a", "b"]))


@_on
def dm_bootstrap_agreement(e):
    return e.agreement()


# --- conformal intervals


@_on
def conformal_quantile(e):
    return rounded(conformal.quantiles(e.errors("cal").withColumn("res", F.col("y") - F.col("yhat")), ["pollutant", "model", "lead"], e.protocol.alpha))


@_on
def split_cp_intervals(e):
    q = conformal.quantiles(e.errors("cal").withColumn("res", F.col("y") - F.col("yhat")), ["pollutant", "model"], e.protocol.alpha)
    rows = e.errors("test").join(F.broadcast(q.select("pollutant", "model", "q")), ["pollutant", "model"])
    return rounded(rows.select(*origins.KEY, "model", "origin_pos", "lead", (F.col("yhat") - F.col("q")).alias("lo"), (F.col("yhat") + F.col("q")).alias("hi")))


@_on
def mmcp_edges(e):
    out = conformal.terciles(e.strata("cal"), ["pollutant", "model"])
    return rounded(out.select("pollutant", "model", *[F.col(c)[i].alias(f"{c}_{i}") for c in ("ws_edges", "blh_edges") for i in (0, 1)]))


@_on
def mmcp3d_fit(e):
    return rounded(e.fitted(conformal.LEVELS_3D))


@_on
def mmcp4d_fit(e):
    return rounded(e.fitted(conformal.LEVELS_4D))


@_on
def mmcp3d_apply(e):
    return rounded(e.intervals().select(*origins.KEY, "model", "origin_pos", "lead", (F.col("yhat") - F.col("q3")).alias("lo"), (F.col("yhat") + F.col("q3")).alias("hi")))


@_on
def mmcp4d_apply(e):
    return rounded(e.intervals().select(*origins.KEY, "model", "origin_pos", "lead", (F.col("yhat") - F.col("q4")).alias("lo"), (F.col("yhat") + F.col("q4")).alias("hi")))


@_on
def mmcp_cell_counts(e):
    return conformal.cell_counts(e.calibration()[0].where("model = 'persistence'"), ["pollutant"])


@_on
def mmcp_cell_summary(e):
    counts = conformal.cell_counts(e.calibration()[0].where("model = 'persistence'"), ["pollutant"])
    return rounded(conformal.cell_summary(counts, ["pollutant"], e.protocol.n_min))


@_on
def episode_cuts(e):
    return rounded(e.cuts())


@_on
def episode_regime(e):
    return rounded(e.regimes("test").unionByName(e.regimes("cal")))


@_on
def leakage_audit(e):
    """Correlation of the regime at the origin with the mean that follows, and the share of episodes."""
    ahead = e.actuals("test").groupBy(*origins.KEY, "origin_pos").agg(F.avg("y").alias("ahead"))
    rows = e.regimes("test").join(ahead, [*origins.KEY, "origin_pos"], "left")
    return rounded(rows.groupBy("pollutant").agg(F.corr(F.when(F.col("ahead").isNotNull(), F.col("r").cast("double")), F.col("ahead")).alias("r"), F.avg("r").alias("rate")))


def _inside(q):
    return F.avg((F.abs(F.col("res")) <= F.col(q)).cast("double"))


@_on
def coverage_by_method(e):
    return rounded(e.tail_intervals().groupBy("pollutant", "model").agg(_inside("q1").alias("split"), _inside("q3").alias("mmcp3d"), _inside("q4").alias("mmcp4d"), F.count("y").alias("n")))


@_on
def winkler_width(e):
    rows = e.intervals().where("y is not null")
    lo, hi = F.col("yhat") - F.col("q4"), F.col("yhat") + F.col("q4")
    return rounded(rows.groupBy("pollutant", "model").agg(F.avg(hi - lo).alias("width"), F.avg(exprs.winkler(F.col("y"), lo, hi, P.alpha)).alias("winkler")))


@_on
def paired_coverage_bootstrap(e):
    return rounded(e.coverage_test().select("pollutant", "model", "coverage_a", "coverage_b", "diff", "lo", "hi", "significant"))


# --- trained models and logs, without SQL


@_on
def ridge_forecast(e):
    return rounded(e.trained("ridge").drop("ms"))


@_on
def gbt_forecast(e):
    return rounded(e.trained("gbt").drop("ms"))


@_on
def trained_leaderboard(e):
    """Cells of ridge and boosted trees, with and without the weather ahead, beside the baselines, at all horizons."""
    return rounded(e.leaderboard(HORIZONS, e.trained_errors()).withColumn("horizon", F.col("horizon").cast("long")), 3)


@_on
def trained_counts(e):
    """How many forecasts the ridge models' cells count, with and without the weather ahead."""
    rows = metrics.errors(e.trained("ridge").unionByName(e.trained("ridge", False)), e.actuals("test"))
    return rows.groupBy("station", "pollutant", "model").agg(F.count("ae").alias("n"), F.countDistinct("origin_pos").alias("n_origins"))


@_on
def metrics_round_trip(e):
    """The metrics of one station through their JSON file."""
    spark = e.panel.sparkSession
    path = f"{shared_dir(spark)}/metrics-{uuid.uuid4().hex}"
    rows = rounded(e.errors("test").where("station = 'view' and pollutant = 'pm25'").groupBy("model").agg(*metrics.point_metrics()))
    readers.write_metrics(rows, path)
    return spark.read.schema(rows.schema).json(path)


@_query
def kept_columns(spark, sf_dir):
    """Events cut down to a list of columns, one of which they don't have."""
    return readers.ensure_columns(events.events(spark, sf_dir), {"event_id": "long", "user_id": "string", "value": "double", "absent": "double"})


@_query
def site_coordinates(spark, sf_dir):
    """Coordinates of wanted sites from a catalogue that names each many times; one wanted site isn't in it."""
    kind = F.col("event_type")
    catalogue = events.events(spark, sf_dir).select(kind.alias("site_id"), F.length(kind).cast("double").alias("latitude"), F.ascii(kind).cast("double").alias("longitude"))
    return readers.coordinates(catalogue, ["click", "view", "nowhere"])


_CODES = {"click": "KC1", "error": "MAHG", "purchase": "SHDG", "signup": "MAN3", "view": "MY1"}


@_on
def registered_series(e):
    """PM2.5 of the registered stations that report it, each read from its own part of the written panel."""
    spark = e.panel.sparkSession
    path = f"{shared_dir(spark)}/registered-{uuid.uuid4().hex}"
    codes = spark.createDataFrame(list(_CODES.items()), "station string, code string")
    readers.write_panel(e.panel.join(F.broadcast(codes), "station").select(F.col("code").alias("station"), "pos", "pm25"), path)
    eligible = [r["code"] for r in stations(spark, "PM2.5").where(F.col("code").isin(*_CODES.values())).collect()]  # of the registry
    return reduce(DataFrame.unionByName, [readers.station_series(spark, path, code, "pm25").withColumn("code", F.lit(code)) for code in eligible])


@_on
def sql_functions(e):
    """The p-values of ``dm_pvalues`` by the function that SQL gets."""
    spark, view = e.panel.sparkSession, f"tests_{uuid.uuid4().hex}"
    exprs.register(spark)
    e.tests(0).createOrReplaceTempView(view)
    return rounded(spark.sql(f"SELECT pollutant, a, b, n, dm, CASE WHEN dm = 0 THEN 1.0D ELSE least(1.0D, 2 * student_tail(abs(dm), CAST(n - 1 AS DOUBLE))) END AS p FROM {view}"))


@_on
def ridge_of_two_features(e):
    """Ridge of each series on the value at the origin (gaps filled by the median) and the lead, which SQL can solve too."""
    rows = lambda o: forecast.features(e.panel, e.series, o, e.protocol.horizon, False).select(*origins.KEY, "phase", "origin_pos", "lead", "target_pos", "y0", "y")
    found = series_models.each_series(rows(origins.train_origins(e.series, e.protocol)), rows(e.origins("test")), series_models.ridge, "ridge_two")
    return rounded(found.drop("ms", "phase"))


@_on
def drift_forecast(e):
    """A forecaster that plugs in: its model is loaded once a worker and gets batches of contexts with the wind, and gives quantiles too."""
    rows = origins.contexts(e.series, e.origins("test"), P.context).join(origins.covariates(e.panel, e.origins("test"), P.context, P.horizon, ["ws10"]), [*origins.KEY, "origin_pos"])
    return rounded(forecast.batched(rows, forecast.Drift, P.horizon, "drift", covariates=["ws10"], quantiles=[0.1, 0.5, 0.9], batch=16).drop("ms", "phase"))


@_on
def resumed_cells(e):
    """A leaderboard in runs, of which one is repeated and others bring cells that are there: each cell once."""
    spark, keys = e.panel.sparkSession, ["station", "pollutant", "horizon", "model"]
    path = f"{shared_dir(spark)}/cells-{uuid.uuid4().hex}"
    board = materialize(rounded(e.leaderboard(HORIZONS).withColumn("horizon", F.col("horizon").cast("long")), 3), "board")
    for run, part in (("a", "horizon = 6"), ("b", "horizon <= 12"), ("b", "horizon <= 12"), ("c", "true")):
        sinks.append_new(board.where(part), path, keys, run)
    return sinks.read_cells(spark, path, ", ".join(f"{c} {t}" for c, t in board.dtypes))


@_query
def manifest_append(spark, sf_dir):
    rows = events.events(spark, sf_dir).groupBy(F.col("event_type").alias("station")).agg(F.count(F.lit(1)).alias("n_rows"))
    rows, path = rows.withColumns({"source": F.lit("events"), "year": F.lit("2024"), "other": F.lit("goes")}), f"{shared_dir(spark)}/manifest-{uuid.uuid4().hex}"
    for _ in range(2):  # the second is a retry
        sinks.append_manifest(rows, path)
    return readers.read_results(spark, path, ", ".join(f"{c} string" for c in MANIFEST)).na.fill("")


@_on
def panel_round_trip(e):
    """The panel written by station and read again."""
    path = f"{shared_dir(e.panel.sparkSession)}/panel-files-{uuid.uuid4().hex}"
    readers.write_panel(e.panel.select("station", "pos", "split", "no2", "pm25"), path)
    return readers.read_panel(e.panel.sparkSession, path).select("station", "pos", "split", "no2", "pm25")


@_on
def losses_round_trip(e):
    """Losses by origin through their table."""
    path = f"{shared_dir(e.panel.sparkSession)}/losses-{uuid.uuid4().hex}"
    readers.write_losses(compare.origin_losses(e.errors("test")), path)
    return rounded(readers.read_losses(e.panel.sparkSession, path, "no2"))


@_on
def results_round_trip(e):
    """A leaderboard through its CSV file."""
    path = f"{shared_dir(e.panel.sparkSession)}/results-{uuid.uuid4().hex}"
    board = rounded(e.leaderboard([24]).select("station", "pollutant", "model", "mae", "n"), 3)
    readers.write_results(board, path)
    return readers.read_results(e.panel.sparkSession, path, "station string, pollutant string, model string, mae double, n long")


@_on
def predictions_round_trip(e):
    """Forecasts through the cache: the second call reads what the first wrote."""
    path = f"{shared_dir(e.panel.sparkSession)}/predictions-{uuid.uuid4().hex}"
    make = lambda: e.predictions("test").where("model = 'persistence'")
    for _ in range(2):
        found = readers.cached_predictions(e.panel.sparkSession, path, {"model": "persistence", "protocol": e.protocol}, {"panel": e.panel}, make)
    return rounded(found)


@_on
def cache_by_content(e):
    """Forecasts of a panel, of the same in another order, of one with other values, and of one with a row more: which were made anew, and what they say."""
    spark = e.panel.sparkSession
    path, panel = f"{shared_dir(spark)}/by-content-{uuid.uuid4().hex}", e.panel
    cases = {
        "first": panel,
        "other order": panel.repartition(7, "pos").sortWithinPartitions(F.desc("pos")),
        "other values": panel.withColumn("no2", F.when(F.col("station") == "view", 2 * F.col("no2")).otherwise(F.col("no2"))),
        "a row more": panel.union(panel.where("pos = 719 and station = 'view'")),
        "first again": panel,
    }
    parts = []
    for case, rows in cases.items():
        own = Evaluation(rows.dropDuplicates(["station", "pos"]) if case == "a row more" else rows, e.protocol)
        found, made = cache.cached(spark, path, {"model": "persistence"}, {"panel": rows}, lambda own=own: own.predictions("test").where("model = 'persistence' and pollutant = 'no2'"))
        parts.append(found.groupBy("station").agg(F.sum("yhat").alias("total"), F.count("yhat").alias("n")).select(F.lit(case).alias("case"), F.lit(made).alias("made"), "*"))
    return rounded(reduce(DataFrame.unionByName, parts))


@_query
def stream_tumbling_hourly(spark, sf_dir):
    """The stream's aggregate over the table as a batch."""
    from ..streaming.hourly import tumbling_hours

    return rounded(tumbling_hours(events.events(spark, sf_dir)).withColumn("ts", F.col("ts").cast("timestamp_ntz")))


@_query
def stream_sliding_windows(spark, sf_dir):
    """As the stream has them when all windows are closed."""
    from ..streaming.stateful import sliding_means

    ntz = {c: F.col(c).cast("timestamp_ntz") for c in ("since", "until")}
    return rounded(sliding_means(events.events(spark, sf_dir)).withColumns(ntz))


@_query
def stream_sessions(spark, sf_dir):
    from ..streaming.stateful import sessions

    ntz = {c: F.col(c).cast("timestamp_ntz") for c in ("since", "until")}
    return rounded(sessions(events.events(spark, sf_dir)).withColumns(ntz))


@_query
def stream_filled_means(spark, sf_dir):
    """A stream that runs: the first half of the hourly observations, then, from the checkpoint, the second; hours that the watermark has passed."""
    from ..streaming import stateful

    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = materialize(events.observations(events.events(spark, sf_dir)).select("station", "ts", F.col("no2").alias("v")), "observations")
    half = rows.agg(F.expr("timestampadd(SECOND, CAST(timestampdiff(SECOND, min(ts), max(ts)) / 2 AS INT), min(ts))")).first()[0]
    if half is None:
        return stateful.read_batches(spark, f"{at}/out", stateful.FILLED)
    for part in (F.col("ts") < F.lit(half), F.col("ts") >= F.lit(half)):
        rows.where(part).write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{at}/in")
        stateful.start(stateful.filled_means(stream), f"{at}/out", f"{at}/state").awaitTermination()
    discard(rows)
    return rounded(stateful.read_batches(spark, f"{at}/out", stateful.FILLED).withColumn("ts", F.col("ts").cast("timestamp_ntz")))


def queries() -> dict[str, Query]:
    return dict(_FOUND)


