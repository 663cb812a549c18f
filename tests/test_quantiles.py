"""Interpolated quantiles by refinement against numpy: ties, gaps, null keys, tiny and skewed groups."""

import numpy as np
import pytest

from aeropanel.operators import quantiles

SHARES = {"lo": 0.0, "third": 1 / 3, "mid": 0.5, "q90": 0.9, "hi": 1.0}


@pytest.mark.parametrize("most", [8, 100, 1 << 16])
def test_refinement(spark, most):
    rng = np.random.default_rng(3)
    data = {("a", 1): rng.normal(size=5000), ("a", None): 2.0 ** rng.integers(-500, 500, 3000), (None, 2): rng.integers(0, 3, 4000).astype(float), ("b", 1): np.full(900, 7.5), ("c", 1): np.array([4.0]), ("d", 1): np.array([1.0, 2.0])}
    rows = [(*k, float(x)) for k, xs in data.items() for x in xs] + [("a", 1, None), ("e", 3, None)]
    got = {(r["g"], r["h"]): r for r in quantiles.interpolated(spark.createDataFrame(rows, "g string, h int, v double").repartition(6), ["g", "h"], "v", SHARES, most).collect()}
    assert set(got) == {*data, ("e", 3)} and got["e", 3]["mid"] is None
    for k, xs in data.items():
        assert [got[k][c] for c in SHARES] == pytest.approx(list(np.quantile(xs, list(SHARES.values()))), rel=1e-12)


def test_no_keys_and_no_rows(spark):
    assert quantiles.interpolated(spark.createDataFrame([], "v double"), [], "v", {"q": 0.25}).collect() == []
    frame = spark.createDataFrame([(float(i),) for i in range(11)], "v double")
    assert quantiles.interpolated(frame, [], "v", {"q": 0.25}, most=3).first()["q"] == 2.5
    assert quantiles.interpolated(frame.limit(0), [], "v", {"q": 0.25}).collect() == []
