"""Scans by blocks equal windows over the whole series, for gaps, lags and frames over block borders."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from aeropanel.operators import compare, grid, ordered


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    found = [(s, p, rng.choice([None, None, round(rng.random(), 3)]) if not 20 < p < 61 else None) for s, n in (("a", 137), ("b", 3), ("c", 40), ("d", 1)) for p in range(n)]
    return spark.createDataFrame(found, "station string, pos long, v double").repartition(5).cache()


def same(left, right):
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, left.collect()), key=key) == sorted(map(tuple, right.collect()), key=key)


@pytest.mark.parametrize("size", [1, 2, 7, 64, 1000])
def test_fill_both_ways(rows, size):
    w = Window.partitionBy("station").orderBy("pos")
    for back, want in ((False, F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0))), (True, F.first("v", True).over(w.rowsBetween(0, Window.unboundedFollowing)))):
        got = ordered.filled(rows, ["station"], {"v": "f"}, size=size, back=back)
        same(got.select("station", "pos", "v", "f"), rows.select("*", want.alias("f")))


@pytest.mark.parametrize("size", [24, 25, 64, 1000])
def test_frames_and_lags(rows, size):
    columns = {"m": grid.strict_mean(F.col("v"), 2), "s": grid.strict_std(F.col("v"), 3), "l": grid.lagged(F.col("v"), 24), "n": lambda w: F.count("v").over(w.rowsBetween(-5, 7))}
    w = Window.partitionBy("station").orderBy("pos")
    got = ordered.framed(rows, ["station"], columns, before=24, after=7, size=size)
    same(got, rows.select("*", *[f(w).alias(n) for n, f in columns.items()]))
    with pytest.raises(ValueError):
        ordered.framed(rows, ["station"], columns, before=size + 1, size=size)


def test_sorted_blocks(spark, rows):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        blocks = ordered.laid_out(rows, ["station"], ["v", "pos"])
        got = ordered.scan(blocks, ["station"], ["v", "pos"], add={"place": F.lit(1).cast("long"), "total": F.coalesce("v", F.lit(0.0))}, last={"latest": F.when(F.col("pos") % 7 == 0, F.col("pos"))}, before={"was": F.when(F.col("pos") % 7 == 0, F.col("pos"))}, ends="end")
        assert blocks.select("station", "block").distinct().count() > 4  # series a spans blocks
        w = Window.partitionBy("station").orderBy("v", "pos")
        up, mark = w.rowsBetween(Window.unboundedPreceding, 0), F.when(F.col("pos") % 7 == 0, F.col("pos"))
        want = rows.select("station", "pos", F.row_number().over(w).cast("long").alias("place"), F.round(F.sum(F.coalesce("v", F.lit(0.0))).over(up), 6), F.last(mark, True).over(up), F.last(mark, True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lead("pos").over(w).isNull())
        same(got.select("station", "pos", "place", F.round("total", 6), "latest", "was", "end"), want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_task_holds_a_comparison(spark):
    """10,000 origins of one comparison: the lagged products come from many blocks."""
    d = spark.range(10_000).select(F.lit("no2").alias("pollutant"), F.lit("p").alias("a"), F.lit("q").alias("b"), F.lit("s").alias("station"), F.col("id").alias("origin_pos"), F.sin(F.col("id") * 7.0).alias("d"))
    got = compare.diebold_mariano(d, 2).first()
    x = [r["d"] for r in d.orderBy("origin_pos").collect()]
    n, mean = len(x), sum(x) / len(x)
    dev = [v - mean for v in x]
    s = sum(v * v for v in dev) / n + sum(2 * sum(p * q for p, q in zip(dev[k:], dev)) / (n - k) for k in (1, 2))
    want = 0.0 if s <= 0 else mean / (s / n) ** 0.5 * ((n + 1 - 6 + 6 / n) / n) ** 0.5
    assert got["n"] == n and got["dm"] == pytest.approx(want)
