"""Models of each (station, pollutant): Spark deals series out, a task fits one at a time in numpy."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .forecast import feature_names
from .origins import KEY

_OUT = "station string, pollutant string, model string, phase string, origin_pos long, lead long, yhat double, ms double"
Fit = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def ridge(x: np.ndarray, y: np.ndarray, ahead: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """Median imputation, population standardisation, ridge with an unpenalised intercept: predictions for ``ahead``.

    Features without a value in training, and constant ones, tell nothing.
    """
    some = ~np.isnan(x).all(axis=0)
    x, ahead = x[:, some], ahead[:, some]
    median = np.nanmedian(x, axis=0)
    x, ahead = np.where(np.isnan(x), median, x), np.where(np.isnan(ahead), median, ahead)
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd[sd == 0] = 1.0
    z, at = (x - mean) / sd, y.mean()
    beta = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - at))
    return (ahead - mean) / sd @ beta + at


@dataclass(frozen=True)
class Boosting:
    """Boosted trees on squared error: features in ``bins`` quantile bins, missing values in one of their own."""

    trees: int = 400
    depth: int = 7
    rate: float = 0.05
    rows: float = 0.8
    columns: float = 0.8
    penalty: float = 1.0
    bins: int = 64
    seed: int = 42

    def __call__(self, x: np.ndarray, y: np.ndarray, ahead: np.ndarray) -> np.ndarray:
        rng, (n, m), width = np.random.default_rng(self.seed), x.shape, self.bins + 1
        edges = [np.unique(np.quantile(c[~np.isnan(c)], np.linspace(0, 1, self.bins)[1:-1])) if (~np.isnan(c)).any() else np.zeros(0) for c in x.T]
        place = lambda z: np.stack([np.where(np.isnan(c), self.bins, np.searchsorted(e, np.nan_to_num(c), "right")) for c, e in zip(z.T, edges, strict=True)], axis=1)
        own, other = place(x), place(ahead)
        fitted, out = np.full(n, y.mean()), np.full(len(ahead), y.mean())
        for _ in range(self.trees):
            rest = y - fitted
            use, cols = rng.random(n) < self.rows, np.sort(rng.choice(m, max(1, int(self.columns * m)), replace=False))
            node, node_out, rest_used = np.zeros(n, np.int64), np.zeros(len(ahead), np.int64), np.repeat(rest[use], len(cols))
            at = own[use][:, cols] + np.arange(len(cols)) * width
            for level in range(self.depth):
                k = 1 << level
                size = k * len(cols) * width
                flat = (node[use, None] * (len(cols) * width) + at).ravel()
                g = np.bincount(flat, rest_used, size).reshape(k, len(cols), width)
                c = np.bincount(flat, minlength=size).astype(float).reshape(k, len(cols), width)
                g, c = g.cumsum(axis=2), c.cumsum(axis=2)
                left_g, left_c, all_g, all_c = g[..., :-1], c[..., :-1], g[..., -1:], c[..., -1:]
                right_c = all_c - left_c
                gain = left_g * left_g / (left_c + self.penalty) + (all_g - left_g) ** 2 / (right_c + self.penalty)
                gain[(left_c == 0) | (right_c == 0)] = 0
                gain = gain.reshape(k, -1)
                best = gain.argmax(axis=1)
                feature, cut = cols[best // (width - 1)], best % (width - 1)
                whole = all_g[:, 0, 0] ** 2 / (all_c[:, 0, 0] + self.penalty)
                cut = np.where(gain[np.arange(k), best] > whole * (1 + 1e-6) + 1e-12, cut, width)  # no gain: all stay left
                node = 2 * node + (own[np.arange(n), feature[node]] > cut[node])
                node_out = 2 * node_out + (other[np.arange(len(ahead)), feature[node_out]] > cut[node_out])
            leaves = 1 << self.depth
            value = self.rate * np.bincount(node[use], rest[use], leaves) / (np.bincount(node[use], minlength=leaves) + self.penalty)
            fitted, out = fitted + value[node], out + value[node_out]
        return out


def each_series(train: DataFrame, test: DataFrame, fit: Fit, name: str) -> DataFrame:
    """Predictions for the rows of ``test``, by a model of each series' rows of ``train`` that have a y.

    ``ms``: the milliseconds that fitting and predicting took the series, shared out among its origins. A task holds one series' rows, whose number the grid and the strides bound. Series without training rows give none.
    """
    names = feature_names(train.columns)
    pick = lambda df, of: df.select(*KEY, "phase", "origin_pos", "lead", F.col("y").cast("double").alias("y"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)], F.lit(of).alias("of"))
    features = [f"x{i}" for i in range(len(names))]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["of", "origin_pos", "lead"])
        own, ahead = part[part["of"] == "train"], part[part["of"] == "test"]
        ahead = ahead if len(own) else ahead.iloc[:0]
        out = ahead[[*KEY, "phase", "origin_pos", "lead"]].copy()
        out.insert(2, "model", name)
        began = time.perf_counter()
        out["yhat"] = fit(own[features].to_numpy(float), own["y"].to_numpy(float), ahead[features].to_numpy(float)) if len(ahead) else np.zeros(0)
        out["ms"] = (time.perf_counter() - began) * 1000 / max(1, ahead["origin_pos"].nunique())
        return out

    return pick(train.where("y is not null"), "train").unionByName(pick(test, "test")).groupBy(*KEY).applyInPandas(run, _OUT)
