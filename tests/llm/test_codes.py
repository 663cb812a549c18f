"""Vector codes: exponion search and whole results against brute force in Python's integers, hard rows, the SQL."""

import hashlib
import math
import os
import random
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from aeropanel.llm import codes

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, code string, `meta.len` int"
INF = float("inf")


def brute(rows, rounds=6, entries=16, parts=8):
    """[(vec_id, code, error, label_error, sha)] of rows (vec_id, vector, label, ...)."""
    kept = [r for r in rows if r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, list(r[1])))
    width = -(-max((len(r[1]) for r in kept), default=0) // parts) * parts
    q = [[math.floor(Fraction(float(np.float32(v))) * 4096) for v in r[1]] + [0] * (width - len(r[1])) for r in kept]
    cut = [[x[p * width // parts : (p + 1) * width // parts] for x in q] for p in range(parts)]
    books = [c[:entries] for c in cut]
    far = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b))
    near = lambda: [[min(range(len(b)), key=lambda e: (far(x, b[e]), e)) for x in c] for c, b in zip(cut, books)]
    for _ in range(rounds):
        at = near()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [x for x, k in zip(cut[p], at[p]) if k == e]
                if mine:
                    books[p] = [*books[p][:e], [sum(v) // len(mine) for v in zip(*mine)], *books[p][e + 1 :]]
    at = near()
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    error = [sum(far(cut[p][i], books[p][at[p][i]]) for p in range(parts)) for i in range(len(kept))]
    total = {}
    for r, e in zip(kept, error):
        total[r[2]] = total.get(r[2], 0) + e
    fits = lambda v: v if v < 1 << 63 else None
    return [(r[0], "".join(f"{at[p][i]:02x}" for p in range(parts)), fits(error[i]), fits(total[r[2]]), sha) for i, r in enumerate(kept)]


def fixture(n=120, width=16, seed=5):
    rng = random.Random(seed)
    rows = [(i * 37 % 997, [rng.choice([-0.5, 0.0, 0.25, 0.25, 1.0]) + rng.gauss(0, 0.05) * (i % 3) for _ in range(width)], rng.choice([0, 1, None]), "x", i) for i in range(n)]
    rows += [(7, rows[0][1], 1, "x", 1)] * 40 + [(None, rows[1][1], None, None, None)]
    return rows + [(9001, None, 1, "x", 1), (9002, [0.1] * (width - 1) + [None], 1, "x", 1), (9003, [INF] + [0.0] * (width - 1), 1, "x", 1), (9004, [float("nan")] * width, 1, "x", 1)]


def run(spark, rows):
    return sorted(map(tuple, codes.op12(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)


@pytest.mark.parametrize("seed", range(8))
def test_search_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    k, w, high = int(rng.integers(1, 17)), int(rng.integers(1, 9)), int(rng.choice([3, 100, 1 << 20]))
    book, x = rng.integers(-high, high, (k, w)), rng.integers(-high, high, (500, w))
    d = ((x[:, None] - book[None]) ** 2).sum(-1)
    best, least, computed = codes.Neighbours(book.tolist()).nearest(x, rng.integers(0, k, 500))
    assert (best == d.argmin(1)).all() and (least == d.min(1)).all() and computed <= 500 * k  # argmin takes the lower of ties


def test_search_prunes():
    rng = np.random.default_rng(1)
    book = rng.integers(-4000, 4000, (16, 8))
    x = np.repeat(book, 50, axis=0) + rng.integers(-40, 40, (800, 8))
    near = codes.Neighbours(book.tolist())
    assert near.nearest(x, near.nearest(x, np.zeros(800, int))[0])[2] < 1.1 * 800 < 0.5 * near.nearest(x, np.zeros(800, int))[2]


def test_whole_result(spark):
    rows = fixture()
    assert run(spark, rows) == sorted(brute(rows), key=str)


def test_few_rows_uneven_lengths_and_none(spark):
    rows = [(3, [0.5, -0.5, 1.0], 1, "a", 1), (1, [], 1, "a", 1), (2, [0.25] * 11, None, "a", 1), (2, [0.2] * 11, None, "a", 1)]
    assert run(spark, rows) == sorted(brute(rows), key=str)
    assert run(spark, [(1, [], None, "a", 1)]) == [(1, "00" * 8, 0, 0, hashlib.sha256(b"").hexdigest())]
    assert run(spark, []) == [] and run(spark, [(1, None, 1, "a", 1), (2, [INF], 1, "a", 1)]) == []


def test_huge_components(spark):
    rows = [(i, [3e38 if i % 3 else -2.5e8, float(i)] + [1e12 * i] * 14, i % 2, "a", 1) for i in range(40)]
    assert run(spark, rows) == sorted(brute(rows), key=str)


def test_other_columns_ride_along(spark):
    table, books = codes.compress(spark.createDataFrame(fixture(30), SCHEMA))
    got = table.where("part is null").select("row.*", "vec", "code")
    assert got.columns == ["vec_id", "label", "code", "meta.len", "vec", "code"] and got.count() == 71 and len(books) == 8


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_given_vectors_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = codes.op12(spark.read.parquet(f"{SF}/embeddings.parquet"))
    want = con.sql(codes.ORACLE)
    assert want.columns == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
