"""Operators against numpy, and the Student-t tail against tabulated values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from aeropanel.functions import exprs
from aeropanel.operators import bootstrap, compare, conformal, metrics


@pytest.mark.parametrize(("x", "df", "p"), [(1.0, 1, 0.25), (2.0, 10, 0.03669402), (1.959964, 1e7, 0.025), (12.7062, 1, 0.025), (2.5706, 5, 0.025), (0.0, 3, 0.5), (-1.0, 1, 0.75)])
def test_student_tail(x, df, p):
    assert exprs.student_tail(x, df) == pytest.approx(p, rel=1e-4)


def conformal_reference(res, alpha):
    r = np.sort(np.abs(res))
    level = min(1.0, math.ceil((len(r) + 1) * (1 - alpha)) / len(r))
    return r[math.ceil(level * (len(r) - 1))]


def test_conformal_rank_for_all_sizes(spark):
    rng = np.random.default_rng(1)
    data = {n: rng.normal(size=n).round(6) for n in [*range(1, 60), 99, 100, 199, 500]}
    rows = spark.createDataFrame([(n, float(x)) for n, xs in data.items() for x in xs] + [(5, None)], "g long, res double")
    got = {r["g"]: r["q"] for r in conformal.quantiles(rows, ["g"], 0.1).collect()}
    assert got == {n: pytest.approx(conformal_reference(xs, 0.1)) for n, xs in data.items()}


def test_point_metrics_with_gaps(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (0.0, 0.0), (None, 3.0), (4.0, None), (3.0, 1.0)], "y double, yhat double")
    r = rows.agg(*metrics.point_metrics()).first()
    assert (r["mae"], r["bias"], r["n"]) == (1.0, pytest.approx(-1 / 3), 3)
    assert r["rmse"] == pytest.approx(math.sqrt(5 / 3)) and r["smape"] == pytest.approx(100 * (2 / 3 + 1) / 2)
    assert rows.limit(0).agg(*metrics.point_metrics()).first()["mae"] is None


def losses(spark, n=40, seed=2):
    rng = np.random.default_rng(seed)
    a, b = rng.gamma(2, 3, n), rng.gamma(2, 2.6, n)
    rows = [("no2", m, "s", i, float(x[i])) for m, x in (("p", a), ("q", b)) for i in range(n)]
    return a, b, spark.createDataFrame(rows, "pollutant string, model string, station string, origin_pos long, loss double")


@pytest.mark.parametrize("lag", [0, 1, 2])
def test_diebold_mariano(spark, lag):
    a, b, frame = losses(spark)
    pairs = spark.createDataFrame([("no2", "p", "q")], "pollutant string, a string, b string")
    r = compare.with_p_values(compare.diebold_mariano(compare.paired(frame, pairs), lag)).first()
    d = a - b
    n, dev = len(d), d - d.mean()
    s = (dev**2).mean() + sum(2 * (dev[k:] * dev[:-k]).mean() for k in range(1, lag + 1))
    h = lag + 1
    dm = d.mean() / math.sqrt(s / n) * math.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n)
    assert r["dm"] == pytest.approx(dm) and r["n"] == n and r["p"] == pytest.approx(2 * exprs.student_tail(abs(dm), n - 1))
    same = compare.with_p_values(compare.diebold_mariano(compare.paired(frame, spark.createDataFrame([("no2", "p", "p")], "pollutant string, a string, b string")), lag)).first()
    assert (same["dm"], same["p"]) == (0.0, 1.0)


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.9, 0.04]
    rows = spark.createDataFrame([("f", str(i), x) for i, x in enumerate(p)], "g string, a string, p double")
    got = {r["a"]: (r["q"], r["reject"]) for r in compare.benjamini_hochberg(rows, ["g"], order=["a"]).collect()}
    order = np.argsort(p, kind="stable")
    q = np.minimum.accumulate((np.array(p)[order] * len(p) / np.arange(1, 7))[::-1])[::-1]
    for i, k in enumerate(order):
        assert got[str(k)][0] == pytest.approx(min(1, q[i])) and got[str(k)][1] == (q[i] <= 0.05)


def test_bootstrap_is_that_of_naive_resampling(spark):
    rng = np.random.default_rng(7)
    units = [rng.gamma(2, 3, int(rng.integers(0, 6))) for _ in range(25)]
    rows = [("no2", "s", i, "m", float(x)) for i, xs in enumerate(units) for x in xs]
    frame = spark.createDataFrame(rows, "pollutant string, station string, origin_pos long, model string, ae double")
    ids = spark.createDataFrame([("no2", "s", i, i) for i in range(25)], "pollutant string, station string, origin_pos long, unit_id long")
    r = bootstrap.mae_intervals(frame, ids, 120).first()
    counts = {}
    for b, u, m in bootstrap.draws(ids, ["pollutant"], 120).select("boot_id", "unit_id", "mult").collect():
        counts.setdefault(b, []).extend([u] * m)
    assert all(len(c) == 25 for c in counts.values())
    dist = [np.concatenate([units[u] for u in c]).mean() for c in counts.values()]
    assert r["point"] == pytest.approx(np.concatenate(units).mean())
    assert (r["lo"], r["hi"]) == tuple(pytest.approx(x) for x in np.percentile(dist, [2.5, 97.5]))


@pytest.mark.parametrize(("n", "seed"), [(1, 42), (2, 0), (25, 42), (1000, 7), (65_537, 1), ((1 << 31) + 12_345, 3), (3_000_000_000, 5)])
def test_draws_replay_the_sequential_generator(spark, n, seed):
    rng = np.random.default_rng(seed)
    if n > 1 << 20:  # half or a quarter of all numbers are passed over; the first draws of the one call
        want = rng.integers(0, n, 5000)
        got = np.concatenate([bootstrap.NumpyDraws.accepted(seed, n, 512, i) for i in range(16)])[:5000]
        assert (got == want).all()
        return
    n_boot = 9
    want = [rng.integers(0, n, n) for _ in range(n_boot)]
    found = bootstrap.NumpyDraws.found(spark, n, n_boot, seed, stretch=257)
    for first in (0, 1, 4, 8):
        got = list(found.rows(first, n_boot, n))
        assert len(got) == n_boot - first and all((a == b).all() for a, b in zip(got, want[first:]))
    if n < 2000:
        units = spark.range(n).select(F.lit("p").alias("g"), F.col("id").alias("unit_id"))
        rows = bootstrap.draws(units, ["g"], n_boot, found, block=2).collect()
        assert {(r["boot_id"], r["unit_id"]): r["mult"] for r in rows} == {(b, u): m for b, w in enumerate(want) for u, m in enumerate(np.bincount(w, minlength=n)) if m}


@pytest.mark.parametrize(("boots", "unit_block"), [(64, 1 << 17), (7, 10), (1, 1)])
def test_blocked_product_is_the_whole_one(spark, boots, unit_block):
    rng = np.random.default_rng(4)
    n, n_boot = 23, 30
    sums = [("a", m, u, float(rng.normal()), int(rng.integers(0, 9))) for m in ("p", "q", None) for u in range(n) if rng.random() < 0.8]
    sums += [("b", "p", 0, 2.5, 3)]
    units = spark.createDataFrame([("a", u) for u in range(n)] + [("b", 0)], "g string, unit_id long")
    frame = spark.createDataFrame(sums, "g string, model string, unit_id long, s double, n long")
    got = {(r["g"], r["model"], r["boot_id"]): (r["s"], r["n"]) for r in bootstrap.resampled(frame, units, ["g"], n_boot, ["s", "n"], ["model"], boots=boots, unit_block=unit_block).collect()}
    taken = list(bootstrap.Md5Draws().rows(0, n_boot, n))
    for m in ("p", "q", None):
        s, k = np.zeros(n), np.zeros(n)
        for g, model, u, x, c in sums:
            if g == "a" and model == m:
                s[u], k[u] = x, c
        for b in range(n_boot):
            assert got["a", m, b] == (pytest.approx(s[taken[b]].sum()), k[taken[b]].sum())
    assert {b for g, _, b in got if g == "b"} == set(range(n_boot)) and got["b", "p", 3] == (2.5, 3)


def test_intervals_of_numpy_draws(spark):
    rng = np.random.default_rng(9)
    units = [rng.gamma(2, 3, int(rng.integers(1, 6))) for _ in range(40)]
    frame = spark.createDataFrame([("no2", "s", i, "m", float(x)) for i, xs in enumerate(units) for x in xs], "pollutant string, station string, origin_pos long, model string, ae double")
    ids = spark.createDataFrame([("no2", "s", i, i) for i in range(40)], "pollutant string, station string, origin_pos long, unit_id long")
    r = bootstrap.mae_intervals(frame, ids, 200, drawn=bootstrap.NumpyDraws.found(spark, 40, 200)).first()
    gen = np.random.default_rng(42)
    dist = [np.concatenate([units[u] for u in gen.integers(0, 40, 40)]).mean() for _ in range(200)]
    assert (r["lo"], r["hi"]) == tuple(pytest.approx(x) for x in np.percentile(dist, [2.5, 97.5]))


def test_tercile_of_missing_is_the_last_bin(spark):
    rows = spark.createDataFrame([(0.5,), (1.0,), (2.0,), (None,)], "x double")
    edges = F.array(F.lit(1.0), F.lit(2.0))
    assert [r[0] for r in rows.select(exprs.tercile(F.col("x"), edges)).collect()] == [0, 1, 2, 2]
