"""Models of each series, sources and sinks, and properties of the intervals."""

import json
import os
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from aeropanel.functions import exprs
from aeropanel.operators import bootstrap, compare, conformal, forecast, metrics, series_models
from aeropanel.plans import queries
from aeropanel.schema import Protocol
from aeropanel.sources import cache, readers, shared, sinks


def test_ridge_of_each_series_is_the_closed_form(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for station in ("s", "t"):
        x = rng.normal(size=(80, 3)) * [1, 5, 0.1] + [0, 2, 1]
        y = x @ rng.normal(size=3) + rng.normal(size=80)
        w = (x - x[:60].mean(axis=0)) / x[:60].std(axis=0)
        beta = np.linalg.solve(w[:60].T @ w[:60] + np.eye(3), w[:60].T @ (y[:60] - y[:60].mean()))
        for i in range(80):
            rows.append((station, "no2", "train" if i < 60 else "test", i, 1, i + 1, *map(float, x[i]), float(y[i])))
            if i >= 60:
                want[station, i] = pytest.approx(w[i] @ beta + y[:60].mean())
    rows.append(("u", "no2", "test", 70, 1, 71, 1.0, 1.0, 1.0, 1.0))  # nothing to learn from
    frame = spark.createDataFrame(rows, "station string, pollutant string, phase string, origin_pos long, lead long, target_pos long, a double, b double, c double, y double")
    got = series_models.each_series(frame.where("phase = 'train'"), frame.where("phase = 'test'"), series_models.ridge, "ridge").collect()
    assert {(r["station"], r["origin_pos"]): r["yhat"] for r in got} == want


def test_ridge_fills_gaps_with_medians():
    x = np.array([[1.0, np.nan], [2.0, np.nan], [np.nan, np.nan], [9.0, np.nan]])
    full = np.array([[1.0], [2.0], [2.0], [9.0]])
    y = np.array([1.0, 2.0, 2.5, 8.0])
    assert np.allclose(series_models.ridge(x, y, np.array([[np.nan, 1.0]])), series_models.ridge(full, y, np.array([[2.0]])))


def test_boosting_learns_steps_and_gaps():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4))
    y = np.where(x[:, 0] > 0.3, 5.0, -1.0) + np.where(np.isnan(x[:, 1]), 2, 0)
    x[::5, 1] = np.nan
    y[::5] += 3
    fit = series_models.Boosting(trees=120, depth=3, rate=0.1)
    got = fit(x[:400], y[:400], x[400:])
    assert np.abs(got - y[400:]).mean() < 0.4 < np.abs(y[400:] - y[:400].mean()).mean()
    assert (got == fit(x[:400], y[:400], x[400:])).all()
    assert np.allclose(fit(x[:400], np.full(400, 2.0), x[400:]), 2.0)


def test_seasonal_naive_of_a_week(spark):
    protocol = Protocol(context=512, horizon=200)
    series = spark.range(700).select(F.lit("s").alias("station"), F.lit("no2").alias("pollutant"), F.col("id").alias("pos"), F.col("id").cast("double").alias("v"))
    origins = spark.createDataFrame([("s", "no2", "test", 499)], "station string, pollutant string, phase string, origin_pos long")
    got = {r["lead"]: r["yhat"] for r in forecast.seasonal_naive(series, origins, protocol.horizon, 168).collect()}
    assert got == {k: float(499 - 168 + 1 + (k - 1) % 168) for k in range(1, 201)}


def test_units_are_numbered_in_order(spark):
    rows = [("p", s, i) for s in ("b", "a", "c") for i in (30, 10, 20)] * 2 + [("q", "z", 1)]
    got = bootstrap.numbered_units(spark.createDataFrame(rows, "g string, s string, i long"), ["g"], ["s", "i"]).collect()
    assert sorted((r["g"], r["unit_id"], r["s"], r["i"]) for r in got) == [("p", k, s, i) for k, (s, i) in enumerate((s, i) for s in "abc" for i in (10, 20, 30))] + [("q", 0, "z", 1)]


def test_quantiles_with_ties_and_null_keys(spark):
    rng = np.random.default_rng(2)
    data = {"a": rng.integers(0, 4, 900).astype(float), None: rng.normal(size=700), "b": np.full(50, 2.5), "c": np.array([-3.0])}
    rows = spark.createDataFrame([(k, float(x)) for k, xs in data.items() for x in xs], "g string, res double")
    got = {r["g"]: (r["n"], r["q"]) for r in conformal.quantiles(rows, ["g"], 0.1, buckets=16).collect()}
    for k, xs in data.items():
        n = len(xs)
        rank = int(np.ceil(min(1.0, np.ceil((n + 1) * 0.9) / n) * (n - 1)))
        assert got[k] == (n, np.sort(np.abs(xs))[rank])


def test_wide_residuals_in_stagnation_get_wide_intervals(spark):
    """40,000 synthetic hours: residuals five times as wide where wind and mixing height are low."""
    rng = np.random.default_rng(5)
    n = 40_000
    ws, blh, hour = rng.uniform(0, 10, n), rng.uniform(0, 2000, n), rng.integers(0, 24, n)
    low = (ws < 10 / 3) & (blh < 2000 / 3)
    res = rng.normal(size=n) * np.where(low, 5, 1)
    rows = spark.createDataFrame([("p", "m", float(a), float(b), int(h), 0, float(r), bool(x), i < n // 2) for i, (a, b, h, r, x) in enumerate(zip(ws, blh, hour, res, low))], "pollutant string, model string, ws10 double, blh double, hour long, r long, res double, low boolean, cal boolean")
    keys, cal = ["pollutant", "model"], rows.where("cal")
    edges = conformal.terciles(cal, keys)
    model = conformal.fit(conformal.binned(cal, edges, keys), keys, conformal.LEVELS_3D, 0.1, 50)
    test = conformal.apply(conformal.binned(rows.where("not cal"), edges, keys), conformal.resolve(model, keys, conformal.LEVELS_3D), keys, conformal.LEVELS_3D)
    whole = model.where("level = 'global'").first()["q"]
    by = {r["low"]: (r["own"], r["one"]) for r in test.groupBy("low").agg(F.avg((F.abs("res") <= F.col("q")).cast("int")).alias("own"), F.avg((F.abs("res") <= whole).cast("int")).alias("one")).collect()}
    assert by[True][1] < 0.75 and abs(by[True][0] - 0.9) < 0.03 and abs(by[False][0] - 0.9) < 0.03


def test_labels_and_order(spark):
    rows = spark.createDataFrame([("persistence",), ("seasonal_naive_168",), ("gbt_nowx",), ("other",)], "m string")
    got = [tuple(r) for r in rows.select("m", metrics.fixed_place(F.col("m")), exprs.display_label(F.col("m")), exprs.model_class(F.col("m"))).collect()]
    assert got == [("persistence", 1, "Persistence", "baseline"), ("seasonal_naive_168", 4, "Seasonal naive, 168 steps", "baseline"), ("gbt_nowx", 8, "Boosted trees, no weather ahead", "trained"), ("other", 9, "other", "other")]


def test_years(spark, tmp_path):
    assert readers.parse_years("2019-2021") == [2019, 2020, 2021] and readers.parse_years("2019, 2022,") == [2019, 2022]
    for year in (2019, 2021):
        spark.createDataFrame([("s", year, 1.0), ("s", year, 1.0), ("s", None, 2.0)], "station string, ts long, v double").write.parquet(f"{tmp_path}/{year}")
    with pytest.warns(UserWarning, match="2020"):
        got = readers.read_years(spark, f"{tmp_path}/{{year}}", [2019, 2020, 2021], ["station", "ts"], "v")
    assert sorted(r["ts"] for r in got.collect()) == [2019, 2021]
    with pytest.raises(ValueError), pytest.warns(UserWarning):
        readers.read_years(spark, f"{tmp_path}/{{year}}", [2030], ["station", "ts"], "v")


def test_metrics_file_and_prediction_cache(spark, tmp_path):
    rows = spark.createDataFrame([("m", 1.5)], "model string, mae double").withColumn("at", F.lit("2024-01-02").cast("timestamp"))
    readers.write_metrics(rows, f"{tmp_path}/metrics")
    part = next(p for p in os.listdir(f"{tmp_path}/metrics") if p.endswith(".json"))
    assert json.loads(open(f"{tmp_path}/metrics/{part}").read()) == {"model": "m", "mae": 1.5, "at": "2024-01-02 00:00:00"}
    calls = []

    def make():
        calls.append(1)
        return spark.createDataFrame([("s", "no2", "m", "test", 1, 1, 2.0)], "station string, pollutant string, model string, phase string, origin_pos long, lead long, yhat double")

    panel = spark.createDataFrame([(1, 1.0), (2, None), (2, None), (3, 4.0)], "pos long, v double")
    other = [panel.repartition(3).orderBy("v"), panel.withColumn("v", F.coalesce("v", F.lit(5.0))), panel.union(panel.limit(1)), panel.distinct(), panel.withColumn("pos", F.col("pos").cast("int")), panel.withColumnRenamed("v", "w")]
    for settings, rows, n in (({"a": 1}, panel, 1), ({"a": 1}, panel, 1), ({"a": 2}, panel, 2), *[({"a": 1}, rows, n) for rows, n in zip(other, (2, 3, 4, 5, 6, 7))]):
        assert readers.cached_predictions(spark, f"{tmp_path}/cache", settings, {"panel": rows}, make).first()["yhat"] == 2.0
        assert len(calls) == n
    assert not [p for p in os.listdir(f"{tmp_path}/cache") if "." in p]  # nothing half-written stays


@pytest.mark.parametrize("kind, values", [("array<int>", [[None, 1], [1, None], [], None, [1]]), ("struct<a:int,b:int>", [(None, 1), (1, None), (None, None), None]), ("map<string,int>", [{"a": 1, "b": 2}, {"a": 2, "b": 1}, {}, None]), ("string", ["", None, "a"])])
def test_digest_tells_unlike_values_apart(spark, kind, values):
    seen = {cache.table_digest(spark.createDataFrame([(v,)], f"x {kind}")) for v in values}
    assert len(seen) == len(values)
    a, b = (spark.createDataFrame(rows, "x int, y int") for rows in ([(None, 1)], [(1, None)]))
    assert cache.table_digest(a) != cache.table_digest(b)
    twice = spark.createDataFrame([(values[0],)] * 2, f"x {kind}")
    assert cache.table_digest(twice) not in {*seen, cache.table_digest(twice.limit(0))}
    if kind.startswith("map"):
        assert cache.table_digest(spark.createDataFrame([({"b": 2, "a": 1},)], f"x {kind}")) in seen


def test_cache_is_whole_or_absent(spark, tmp_path):
    def broken():
        return spark.range(4).select(F.when(F.col("id") < 3, F.col("id")).otherwise(F.raise_error(F.lit("lost"))).cast("long").alias("id"))

    with pytest.raises(Exception, match="lost"):
        cache.cached(spark, f"{tmp_path}/c", {}, {}, broken)
    found, made = cache.cached(spark, f"{tmp_path}/c", {}, {}, lambda: spark.range(4))
    assert made and found.count() == 4 and not cache.commit(spark.range(9), f"{tmp_path}/c/{cache.content_key({}, {})}")


def test_manifest_digests_and_coordinates(spark, tmp_path):
    row = spark.createDataFrame([("src", "x", 3)], "source string, station string, n_rows int")
    for run in (None, None, "again", "again"):
        sinks.append_manifest(row, f"{tmp_path}/manifest", run)
    assert [tuple(r) for r in readers.read_results(spark, f"{tmp_path}/manifest", "source string, city string, station string, year string, pull_date_utc string, sha256 string, n_rows string, notes string").select("source", "station", "n_rows").collect()] == [("src", "x", "3")] * 2
    (tmp_path / "one.bin").write_bytes(b"abc")
    assert readers.file_digests(spark, f"{tmp_path}/one.bin").first()["sha256"].startswith("ba7816bf")
    sites = spark.createDataFrame([("A", 1.0, 2.0), ("A", 1.0, 2.0), ("B", 3.0, 4.0)], "site_id string, latitude double, longitude double")
    assert [tuple(r) for r in readers.coordinates(sites, ["A"]).collect()] == [("A", 1.0, 2.0)]


def test_written_tables_can_be_discarded(spark):
    df = shared.materialize(spark.range(3), "three")
    at = df.written_to.removeprefix("file://")
    assert df.count() == 3 and os.path.isdir(at)
    shared.discard(df)
    assert not os.path.isdir(at)


def test_retries_and_stations(spark, tmp_path):
    tries = []

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("busy")
        return "{}"

    assert readers.with_retries(call, 4, lambda _: 0) == "{}" and len(tries) == 3
    with pytest.raises(OSError):
        readers.with_retries(lambda: open("/no/such/file").read(), 2, lambda _: 0)
    panel = spark.createDataFrame([("KC1", 0, 1.5), ("KC1", 1, float("nan")), ("MY1", 0, 3.0)], "station string, pos long, no2 double")
    readers.write_panel(panel, f"{tmp_path}/panel")
    assert sorted(tuple(r) for r in readers.station_series(spark, f"{tmp_path}/panel", "KC1", "no2").collect()) == [(0, 1.5), (1, None)]
    with pytest.raises(NotImplementedError):
        readers.station_series(spark, f"{tmp_path}/panel", "nowhere", "no2")


def test_families_and_sql_function(spark):
    got = [tuple(r) for r in compare.families(spark, ["p", "q", "r"], {"no2": [("q", "r"), ("p", "q")], "pm25": []}).collect()]
    assert got == [("no2", "p", "q"), ("no2", "p", "r"), ("no2", "q", "r"), ("pm25", "p", "q"), ("pm25", "p", "r")]
    exprs.register(spark)
    assert spark.sql("select student_tail(1.0D, 1.0D) p").first()["p"] == pytest.approx(0.25)


class Counting:
    """Leaves a file a load, and gives the number of its batch as forecast."""

    def __init__(self, folder):
        open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()

    def __call__(self, contexts, covariates, horizon, quantiles):
        n = len(contexts)
        return np.full((n, horizon), float(n)), np.stack([np.array([[q + w[0]] * horizon for w in covariates["wind"]]) for q in quantiles], axis=1)


def test_plugged_in_models_are_loaded_once_a_worker_and_get_whole_batches(spark, tmp_path):
    rows = spark.range(1000).repartition(8).select(F.lit("s").alias("station"), F.lit("no2").alias("pollutant"), F.lit("test").alias("phase"), F.col("id").alias("origin_pos"), F.array(F.col("id").cast("double")).alias("ctx"), F.array(F.col("id").cast("double"), F.lit(None)).alias("wind"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    folder, name = str(tmp_path), f"counting-{uuid.uuid4().hex}"
    try:
        for _ in range(2):
            got = forecast.batched(rows, lambda: Counting(folder), 2, name, covariates=["wind"], quantiles=[0.1, 0.975], batch=50).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 2000 and {r["lead"] for r in got} == {1, 2} and all(r["ms"] > 0 for r in got)
    assert all(r["q10"] == r["origin_pos"] + 0.1 and r["q97_5"] == r["origin_pos"] + 0.975 for r in got)
    sizes = [r["yhat"] for r in got]
    assert max(sizes) == 50 and sizes.count(50.0) >= 2 * (1000 - 8 * 50)  # all but a task's last
    loads = os.listdir(folder)
    assert 1 <= len(loads) == len({p.split("-")[0] for p in loads}) <= 8  # 16 tasks


def test_shapes_are_checked(spark):
    rows = spark.createDataFrame([("s", "no2", "test", 1, [1.0])], "station string, pollutant string, phase string, origin_pos long, ctx array<double>")
    with pytest.raises(Exception, match="gave forecasts of shape"):
        forecast.batched(rows, lambda: lambda c, w, h, q: (np.zeros((1, 3)), None), 2, f"wrong-{uuid.uuid4().hex}").collect()


@pytest.mark.parametrize("form", ["parquet", "csv"])
def test_a_run_killed_between_cells_gives_each_cell_once(spark, tmp_path, form):
    path, keys, schema = f"{tmp_path}/cells", ["station", "h"], "station string, h int, mae double"
    cells = [("a", 6, 1.0), ("a", 12, 2.0), (None, 6, 3.0), ("b", None, 4.0)]
    done = []

    def compute(rows, fail_at=None):
        for i, cell in enumerate(rows):
            if i == fail_at:
                raise KeyboardInterrupt
            done.append(cell[:2])
            sinks.append_new(spark.createDataFrame([cell], schema), path, keys, f"cell-{cell[0]}-{cell[1]}", form)

    with pytest.raises(KeyboardInterrupt):
        compute(cells, 2)
    left = sinks.missing(spark.createDataFrame(cells, schema), path, keys, form)
    compute([tuple(r) for r in left.collect()])
    assert sorted(map(str, done)) == sorted(str(c[:2]) for c in cells)
    assert not sinks.append_new(spark.createDataFrame(cells, schema), path, keys, "cell-a-6", form)
    assert sinks.append_new(spark.createDataFrame([*cells, ("c", 1, 9.0), ("c", 1, 9.0)], schema), path, keys, "more", form)
    got = sorted(map(str, map(tuple, sinks.read_cells(spark, path, schema, form).collect())))
    assert got == sorted(map(str, [*cells, ("c", 1, 9.0)]))
    assert sinks.read_cells(spark, f"{tmp_path}/none", schema, form).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_trained_leaderboard_says_what_a_forecast_takes(spark):
    rows = queries.queries()["trained_leaderboard"](spark, "/root/testdata/sf0.001").collect()
    assert {r["model"] for r in rows} >= {"ridge", "gbt", "ridge_nowx", "gbt_nowx", "persistence"} and all(r["ms_per_forecast"] > 0 for r in rows)
