"""The published protocol at its full size: six years of hours, contexts of 512, weekly origins, three horizons."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aeropanel.functions.exprs import split_label
from aeropanel.operators.grid import grid
from aeropanel.plans.evaluation import Evaluation
from aeropanel.schema import WEATHER, Protocol
from aeropanel.sources.shared import materialize

HORIZONS = [24, 72, 168]


def test_six_years_of_two_stations(spark):
    protocol = Protocol(horizon=168)
    rng = np.random.default_rng(6)
    n = 52_608
    hour = np.arange(n)
    values = {}
    for station, level in (("a", 40.0), ("b", 12.0)):
        v = level + 8 * np.sin(hour * 2 * np.pi / 24) + 3 * np.sin(hour * 2 * np.pi / 168) + rng.normal(0, 4, n)
        v[rng.random(n) < 0.05] = np.nan
        v[30_000:30_900] = np.nan  # five weeks without a value
        values[station] = v
    frame = pd.concat([pd.DataFrame({"station": s, "pos": hour, "no2": v}) for s, v in values.items()])
    slots = grid(spark.createDataFrame([("a",), ("b",)], "station string"), protocol)
    assert slots.count() == 2 * n
    panel = slots.join(spark.createDataFrame(frame, "station string, pos long, no2 double"), ["station", "pos"]).withColumn("no2", F.nanvl("no2", F.lit(None)))
    panel = panel.withColumns({"pm25": F.lit(None).cast("double"), "split": split_label(F.col("ts"), protocol.splits), **{c: F.lit(1.0) for c in WEATHER}})
    e = Evaluation(materialize(panel, "six-years"), protocol, (24, 168))
    board = {(r["station"], r["horizon"], r["model"]): r for r in e.leaderboard(HORIZONS).collect()}
    first = 24 * (pd.Timestamp("2023-07-01") - pd.Timestamp("2019-01-01")).days
    for station, v in values.items():
        filled = pd.Series(v).ffill().to_numpy()
        origins = [p for p in range(first, n, 168) if p + 168 < n]
        assert len(origins) == 78
        for horizon in HORIZONS:
            y = np.stack([v[p + 1 : p + 1 + horizon] for p in origins])
            for model, ahead in {
                "persistence": np.stack([np.full(horizon, filled[p]) for p in origins]),
                "seasonal_naive_24": np.stack([np.resize(filled[p - 23 : p + 1], horizon) for p in origins]),
                "seasonal_naive_168": np.stack([np.resize(filled[p - 167 : p + 1], horizon) for p in origins]),
            }.items():
                got = board[station, horizon, model]
                assert got["n"] == np.isfinite(y).sum() and got["n_origins"] == len(origins)
                assert got["mae"] == pytest.approx(np.nanmean(np.abs(ahead - y)))
                q90 = np.nanquantile(np.stack([v[p + 1 : p + 169] for p in origins]), 0.9)
                assert got["q90"] == pytest.approx(q90) and got["mae_topdecile"] == pytest.approx(np.abs(ahead - y)[y >= q90].mean())
    e.close()
