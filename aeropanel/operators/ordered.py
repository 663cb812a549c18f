"""Ordered scans over series of any length: sorted blocks, values carried from block to block, halos for bounded frames."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.shared import materialize


def laid_out(df: DataFrame, keys: Sequence[str], order: Sequence[str], tag: str = "ordered") -> DataFrame:
    """``df`` as a written table with ``block``: ranges of (keys, order) of about equal size, one task's each; a long series spans several.

    Ascending, nulls first. Rows equal in all of ``keys`` and ``order`` share a block.
    """
    return materialize(df.repartitionByRange(*keys, *order).withColumn("block", F.spark_partition_id()), tag)


def scan(blocks: DataFrame, keys: Sequence[str], order: Sequence[str], add: Mapping[str, Column] = {}, last: Mapping[str, Column] = {}, before: Mapping[str, Column] = {}, ends: str | None = None) -> DataFrame:
    """``blocks`` (with ``block``, ascending along ``order`` within a key) with running columns.

    ``add``: sums up to the row; ``last``: the last value that isn't null up to the row; ``before``: the same up to the
    row before; ``ends``: whether the row is its key's last. Each (key, block) is scanned by itself; what the blocks
    before hold is summed up in a row a (key, block), scanned in turn and joined back, so no task holds a whole series.
    Keys must not be null.
    """
    group = Window.partitionBy(*keys, "block").orderBy(*order)
    here, above = group.rowsBetween(Window.unboundedPreceding, 0), group.rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*[F.col(c) for c in order])
    latest = {**last, **before}
    held = [F.sum(x).alias(n) for n, x in add.items()] + [F.max_by(x, F.when(x.isNotNull(), place)).alias(n) for n, x in latest.items()]
    summary = blocks.groupBy(*keys, "block").agg(*(held or [F.lit(1).alias("_any")]))
    series = Window.partitionBy(*keys).orderBy("block")
    earlier = series.rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.sum(n).over(earlier).alias(f"_{n}") for n in add] + [F.last(n, ignorenulls=True).over(earlier).alias(f"_{n}") for n in latest]
    carry = summary.select(*keys, "block", *carried, F.lead(F.lit(1)).over(series).isNull().alias("_end"))
    rows = blocks.select("*", *[F.sum(x).over(here).alias(f"_in_{n}") for n, x in add.items()], *[F.last(x, ignorenulls=True).over(here).alias(f"_in_{n}") for n, x in last.items()], *[F.last(x, ignorenulls=True).over(above).alias(f"_in_{n}") for n, x in before.items()], F.lead(F.lit(1)).over(group).isNull().alias("_in_end"))
    joined = rows.join(carry, [*keys, "block"])
    out = [(F.col(f"_in_{n}") + F.coalesce(f"_{n}", F.lit(0))).alias(n) for n in add] + [F.coalesce(f"_in_{n}", f"_{n}").alias(n) for n in latest]
    if ends:
        out.append((F.col("_in_end") & F.col("_end")).alias(ends))
    return joined.select(*[F.col(f"`{c}`") for c in blocks.columns], *out)


def by_place(df: DataFrame, place: str = "pos", size: int = 8192) -> DataFrame:
    """``block`` of rows that have their place in the series already (a grid's step, a rank): ranges of ``size`` places, so nothing is sorted to find it."""
    return df.withColumn("block", F.floor(F.col(place) / size))


def filled(series: DataFrame, keys: Sequence[str], values: Mapping[str, str], place: str = "pos", size: int = 8192, back: bool = False) -> DataFrame:
    """``series`` with each of ``values`` (column to result) filled by its last value before (``back``: after) a gap."""
    if back:
        rows = by_place(series.withColumn("_back", -F.col(place)), "_back", size)
        return scan(rows, keys, ["_back"], last={n: F.col(c) for c, n in values.items()}).drop("_back", "block")
    return scan(by_place(series, place, size), keys, [place], last={n: F.col(c) for c, n in values.items()}).drop("block")


def framed(series: DataFrame, keys: Sequence[str], columns: Mapping[str, Callable[[WindowSpec], Column]], before: int, after: int = 0, place: str = "pos", size: int = 8192) -> DataFrame:
    """``series`` with window columns that look at most ``before`` rows back and ``after`` ahead; ``columns``: name to what is made of the window.

    Rows have consecutive places. Blocks of ``size`` places are windows of their own; each takes along the last
    ``before`` rows of the block before and the first ``after`` of the next, a share of (before + after) / size of all.
    """
    if max(before, after) > size:
        raise ValueError(f"blocks of {size} rows can't hold a frame of {before} before and {after} after")
    at, own = F.pmod(F.col(place), F.lit(size)), F.floor(F.col(place) / size)
    blocks = F.array_compact(F.array(own, F.when(at >= size - before, own + 1) if before else F.lit(None).cast("long"), F.when(at < after, own - 1) if after else F.lit(None).cast("long")))
    rows = series.withColumn("_block", F.explode(blocks))
    window = Window.partitionBy(*keys, "_block").orderBy(place)
    return rows.select("*", *[f(window).alias(n) for n, f in columns.items()]).where(F.col("_block") == own).drop("_block")
