"""Block bootstrap over origin units: sums by unit first, then counts of each resample times the sums."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import materialize


def numbered_units(rows: DataFrame, by: list[str], unit: list[str]) -> DataFrame:
    """(by, unit, unit_id): units counted from 0 in order within ``by``.

    Ranks within the first column of ``unit``, plus the units of its smaller values: no task orders all units.
    """
    found, first = rows.select(*by, *unit).distinct(), [*by, unit[0]]
    before = Window.partitionBy(*by).orderBy(unit[0]).rowsBetween(Window.unboundedPreceding, -1)
    starts = found.groupBy(*first).agg(F.count(F.lit(1)).alias("_n")).select(*first, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    ranked = found.withColumn("_rank", F.row_number().over(Window.partitionBy(*first).orderBy(*(unit[1:] or unit))) - 1)
    return ranked.join(starts, first).select(*by, *unit, (F.col("_start") + F.col("_rank")).cast("long").alias("unit_id"))


def unit_sums(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Sum (0 if none) and number of the values of each unit."""
    return rows.groupBy(*keys).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("s"), F.count(value).alias("n"))


class Md5Draws:
    """Draw k of resample b takes unit md5("b-k") modulo the number of units, which any engine can repeat."""

    def rows(self, first: int, last: int, n: int) -> Iterator[np.ndarray]:
        """The ``n`` draws of each resample from ``first`` to ``last`` - 1."""
        for b in range(first, last):
            head = hashlib.md5(b"%d-" % b)
            yield np.frombuffer(b"".join(_tail(head, k) for k in range(n)), ">u4").astype(np.int64) % n


def _tail(head, k: int) -> bytes:
    h = head.copy()
    h.update(b"%d" % k)
    return h.digest()[:4]


class NumpyDraws:
    """The draws of ``default_rng(seed).integers(0, n, n)``, call after call, found from any resample on.

    The generator halves each of PCG64's outputs into two numbers of 32 bits, the low one first. A number x gives the
    draw x * n >> 32 unless the low 32 bits of x * n are under 2^32 mod n: those are passed over. So a stretch of the
    stream needs nothing of those before it but how many draws they gave. ``starts[i]``: the draws before stretch i.
    """

    def __init__(self, seed: int, n: int, starts: np.ndarray, stretch: int) -> None:
        self.seed, self.n, self.starts, self.stretch = seed, n, starts, stretch

    @staticmethod
    def accepted(seed: int, n: int, stretch: int, i: int) -> np.ndarray:
        """The draws that stretch i of the stream, of ``stretch`` outputs, gives."""
        outputs = np.random.PCG64(seed).advance(i * stretch).random_raw(stretch)
        x = np.stack([outputs & np.uint64(0xFFFFFFFF), outputs >> np.uint64(32)], axis=1).reshape(-1) * np.uint64(n)
        return (x[(x & np.uint64(0xFFFFFFFF)) >= np.uint64((1 << 32) % n)] >> np.uint64(32)).astype(np.int64)

    @classmethod
    def found(cls, spark: SparkSession, n: int, n_boot: int, seed: int = 42, stretch: int = 1 << 20) -> NumpyDraws:
        """Counts what every stretch gives, a task each, until there are n * n_boot draws; the counts, a number a stretch, go to the driver."""
        if not 1 <= n <= 1 << 32:
            raise ValueError(f"draws from {n} units aren't of 32 bits")
        counts: list[int] = []
        while n > 1 and sum(counts) < n * n_boot:
            missing = n * n_boot - sum(counts)
            more = range(len(counts), len(counts) + 1 + int(missing / (2 * stretch) / (1 - ((1 << 32) % n) / (1 << 32))))

            def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    ids = batch.column(0).to_pylist()
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(cls.accepted(seed, n, stretch, i)) for i in ids], pa.int64())], ["id", "n"])

            tasks = min(len(more), 4 * spark.sparkContext.defaultParallelism)
            counts += [r["n"] for r in spark.range(more.start, more.stop, 1, tasks).mapInArrow(count, "id long, n long").orderBy("id").collect()]
        return cls(seed, n, np.concatenate([[0], np.cumsum(np.array(counts, np.int64))]), stretch)

    def rows(self, first: int, last: int, n: int) -> Iterator[np.ndarray]:
        if n != self.n:
            raise ValueError(f"these are draws from {self.n} units, not {n}")
        if n == 1:  # one unit takes nothing from the stream
            yield from [np.zeros(1, np.int64)] * (last - first)
            return
        i = int(np.searchsorted(self.starts, first * n, "right")) - 1
        held = self.accepted(self.seed, n, self.stretch, i)[first * n - int(self.starts[i]) :]
        for _ in range(first, last):
            while len(held) < n:
                i += 1
                held = np.concatenate([held, self.accepted(self.seed, n, self.stretch, i)])
            yield held[:n]
            held = held[n:]


def _boot_blocks(units: DataFrame, by: list[str], n_boot: int, block: int) -> DataFrame:
    """(by, n_unit, boot0, boot1): the resamples of each group in runs of ``block``."""
    sizes = units.groupBy(*by).agg(F.count(F.lit(1)).alias("n_unit"))
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_boot - 1).cast("long"), F.lit(block).cast("long")))
    return sizes.select("*", runs.alias("boot0")).withColumn("boot1", F.least(F.col("boot0") + block, F.lit(n_boot).cast("long")))


def draws(units: DataFrame, by: list[str], n_boot: int, drawn: Md5Draws | NumpyDraws | None = None, block: int = 32) -> DataFrame:
    """(by, boot_id, unit_id, mult): the count matrix of ``n_boot`` resamples of as many draws as there are units, as rows."""
    source = drawn or Md5Draws()
    runs = _boot_blocks(units, by, n_boot, block).repartition(*by, "boot0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                n, first, last = (batch.column(c)[r].as_py() for c in ("n_unit", "boot0", "boot1"))
                for b, taken in enumerate(source.rows(first, last, n), first):
                    unit, mult = np.unique(taken, return_counts=True)
                    same = [pa.array([batch.column(c)[r].as_py()] * len(unit), batch.schema.field(c).type) for c in by]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(np.full(len(unit), b)), pa.array(unit), pa.array(mult)], [*by, "boot_id", "unit_id", "mult"])

    schema = runs.select(*by, *[F.lit(0).cast("long").alias(c) for c in ("boot_id", "unit_id", "mult")]).schema
    return runs.mapInArrow(run, schema)


UNIT_BLOCK = 1 << 17  # units of one product: a count matrix of BOOT_BLOCK x UNIT_BLOCK numbers of 64 bits is 64 MB
BOOT_BLOCK = 64


def resampled(sums: DataFrame, units: DataFrame, by: list[str], n_boot: int, columns: list[str], own: list[str] = [], drawn: Md5Draws | NumpyDraws | None = None, boots: int = BOOT_BLOCK, unit_block: int = UNIT_BLOCK) -> DataFrame:
    """(by, own, boot_id, columns): the ``columns`` of ``sums(by, own, unit_id, ...)`` summed over the draws of each resample.

    The product of a count matrix and the sums, in blocks. Nothing of the count matrix is shuffled: a task gets a run
    of resamples and a block of units' sums, makes these draws itself, counts them in a dense matrix, multiplies, and
    gives a row for each (own, resample), which are added up over the blocks of units. What moves is the sums, once for
    each run of ``boots`` resamples, and the products. Over ``unit_block`` units the draws are made once a block.
    """
    source = drawn or Md5Draws()
    runs = _boot_blocks(units, by, n_boot, boots)
    rows = runs.join(sums.select(*by, *own, "unit_id", *columns), by).withColumn("units", F.floor(F.col("unit_id") / unit_block))
    rows = rows.select(*by, "n_unit", "boot0", "boot1", "units", *own, "unit_id", *[F.col(c).cast("double").alias(c) for c in columns])
    schema = rows.select(*by, *own, F.lit(0).cast("long").alias("boot_id"), *columns).schema

    def product(table: pa.Table) -> pa.Table:
        n, first, last, block = (table.column(c)[0].as_py() for c in ("n_unit", "boot0", "boot1", "units"))
        at, width = block * unit_block, min(unit_block, n - block * unit_block)
        counts = np.zeros((last - first, width))
        for i, taken in enumerate(source.rows(first, last, n)):
            here = taken[(taken >= at) & (taken < at + width)] - at
            counts[i] = np.bincount(here, minlength=width)
        keys = table.select([*by, *own]).to_pandas() if own else None
        group = np.zeros(len(table), np.int64) if keys is None else keys.groupby(own, dropna=False, sort=False).ngroup().to_numpy()
        firsts = np.unique(group, return_index=True)[1]
        unit = table.column("unit_id").to_numpy() - at
        dense = np.zeros((width, len(firsts) * len(columns)))
        for j, c in enumerate(columns):
            dense[unit, group * len(columns) + j] = table.column(c).to_numpy()
        out = counts @ dense
        same = table.select([*by, *own]).take(np.repeat(firsts, last - first))
        values = [pa.array(np.concatenate([out[:, g * len(columns) + j] for g in range(len(firsts))])) for j in range(len(columns))]
        boot = pa.array(np.tile(np.arange(first, last), len(firsts)))
        return pa.table([*same.columns, boot, *values], names=[*by, *own, "boot_id", *columns])

    parts = rows.groupBy(*by, "boot0", "units").applyInArrow(product, schema)
    return parts.groupBy(*by, *own, "boot_id").agg(*[F.sum(c).alias(c) for c in columns])


def distribution(sums: DataFrame, units: DataFrame, by: list[str], n_boot: int, values: dict[str, tuple[str, str]], own: list[str] = [], drawn: Md5Draws | NumpyDraws | None = None) -> DataFrame:
    """(by, own, boot_id, one column a value): sum(mult * s) / sum(mult * n) of each resample, all from the same draws.

    ``values``: name to the columns of a unit's sum and number. A resample without values is null.
    """
    columns = list(dict.fromkeys(c for pair in values.values() for c in pair))
    rows = resampled(sums, units, by, n_boot, columns, own, drawn)
    return rows.select(*by, *own, "boot_id", *[F.try_divide(s, n).alias(name) for name, (s, n) in values.items()])


def interval(x: Column, lo: float = 0.025, hi: float = 0.975) -> tuple[Column, Column]:
    """Interpolated percentiles; null if any resample is null, as those of an array with a NaN."""
    bounds = F.percentile(x, F.array(F.lit(lo), F.lit(hi)))
    whole = F.count(x) == F.count(F.lit(1))
    return F.when(whole, bounds[0]), F.when(whole, bounds[1])


def significant(lo: Column, hi: Column) -> Column:
    return F.coalesce((lo > 0) | (hi < 0), F.lit(False))


def mae_intervals(rows: DataFrame, units: DataFrame, n_boot: int, value: Column | None = None, drawn: Md5Draws | NumpyDraws | None = None) -> DataFrame:
    """(pollutant, model, point, lo, hi) with the same resamples for all models; ``units`` are all that are drawn from, also those without a value."""
    by = ["pollutant"]
    sums = materialize(unit_sums(rows.join(units, ["pollutant", "station", "origin_pos"]), ["pollutant", "model", "unit_id"], F.col("ae") if value is None else value), "unit-sums")
    point = sums.groupBy("pollutant", "model").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("point"))
    d = distribution(sums, units, by, n_boot, {"d": ("s", "n")}, ["model"], drawn)
    lo, hi = interval(F.col("d"))
    return d.groupBy("pollutant", "model").agg(lo.alias("lo"), hi.alias("hi")).join(point, ["pollutant", "model"]).select("pollutant", "model", "point", "lo", "hi")


def mae_differences(rows: DataFrame, units: DataFrame, pairs: DataFrame, n_boot: int, value: Column | None = None) -> DataFrame:
    """(pollutant, a, b, diff, lo, hi, significant) of the errors of a less those of b, paired by resample; over 0: b is better."""
    sums = materialize(unit_sums(rows.join(units, ["pollutant", "station", "origin_pos"]), ["pollutant", "model", "unit_id"], F.col("ae") if value is None else value), "unit-sums")
    d = materialize(distribution(sums, units, ["pollutant"], n_boot, {"d": ("s", "n")}, ["model"]), "resamples")  # each side of a pair reads it
    point = sums.groupBy("pollutant", "model").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("p"))
    side = lambda df, m, x: df.select("pollutant", F.col("model").alias(m), *[c for c in df.columns if c == "boot_id"], F.col(x).alias(f"{x}_{m}"))
    both = F.broadcast(pairs).join(side(d, "a", "d"), ["pollutant", "a"]).join(side(d, "b", "d"), ["pollutant", "b", "boot_id"])
    lo, hi = interval(F.col("d_a") - F.col("d_b"))
    out = both.groupBy("pollutant", "a", "b").agg(lo.alias("lo"), hi.alias("hi"))
    out = out.join(side(point, "a", "p"), ["pollutant", "a"]).join(side(point, "b", "p"), ["pollutant", "b"])
    return out.select("pollutant", "a", "b", (F.col("p_a") - F.col("p_b")).alias("diff"), "lo", "hi", significant(F.col("lo"), F.col("hi")).alias("significant"))


def paired_coverage(rows: DataFrame, n_boot: int, by: list[str]) -> DataFrame:
    """Rows (by, unit_id, cov_a, cov_b as 0/1 or null for no y): coverages, their difference, its interval; units without a y aren't drawn."""
    sums = rows.groupBy(*by, "unit_id").agg(F.sum("cov_a").alias("sa"), F.sum("cov_b").alias("sb"), F.count("cov_a").alias("n")).where("n > 0")
    sums = materialize(sums, "coverage-sums")  # three branches read it
    old = sums.withColumnRenamed("unit_id", "old").withColumn("thousand", F.floor(F.col("old") / 1000))
    units = numbered_units(old, by, ["thousand", "old"])
    own = old.join(units, [*by, "thousand", "old"])
    d = distribution(own, units, by, n_boot, {"a": ("sa", "n"), "b": ("sb", "n")})
    lo, hi = interval(F.col("a") - F.col("b"))
    point = sums.groupBy(*by).agg((F.sum("sa") / F.sum("n")).alias("coverage_a"), (F.sum("sb") / F.sum("n")).alias("coverage_b"))
    out = d.groupBy(*by).agg(lo.alias("lo"), hi.alias("hi")).join(point, by)
    return out.withColumn("diff", F.col("coverage_a") - F.col("coverage_b")).withColumn("significant", significant(F.col("lo"), F.col("hi")))
