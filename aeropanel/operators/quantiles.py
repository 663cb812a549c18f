"""Exact quantiles of groups of any size, several ranks at once: buckets are counted and refined until a few values are left."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import discard, materialize

BUCKETS = 128


def at_ranks(rows: DataFrame, targets: DataFrame, value: str = "x", most: int = 1 << 16, buckets: int = BUCKETS) -> DataFrame:
    """(g, rank, x): the value of each 0-based ``rank`` among its group's; ``rows(g string, value)``, ``targets(g string, rank long)``.

    A group of over ``most`` values is cut at approximate percentiles into ``buckets``, whose exact counts say which of
    them hold a rank; these are groups of the next round, a small share of the rows, written. What is left is sorted in
    arrays of at most ``most`` distinct values with their counts: the largest state of a task. A value that repeats more
    often is a bucket of its own and done.
    """
    found, written = [], []
    rows = materialize(rows.select("g", F.col(value).alias("x")).where("x is not null").groupBy("g", "x").agg(F.count(F.lit(1)).alias("k")), "values")
    targets = targets.select("g", "rank", F.col("g").alias("own"), F.col("rank").alias("asked"))
    written.append(rows)
    while True:
        sizes = materialize(rows.groupBy("g").agg(F.count(F.lit(1)).alias("distinct")), "sizes")
        small = targets.join(sizes.where(F.col("distinct") <= most), "g").drop("distinct")
        found.append(materialize(_sorted_out(rows.join(sizes.where(F.col("distinct") <= most).select("g"), "g", "left_semi"), small), "found"))
        large = sizes.where(F.col("distinct") > most)
        if large.isEmpty():
            break
        inner = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
        cuts = rows.join(_narrow(large.select("g")), "g", "left_semi").groupBy("g").agg(F.array_distinct(F.percentile_approx("x", inner, 10 * buckets)).alias("cuts"))
        placed = rows.join(_narrow(materialize(cuts, "cuts")), "g").select("g", F.size(F.filter("cuts", lambda c: c < F.col("x"))).alias("bucket"), "x", "k")
        up = Window.partitionBy("g").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        counts = placed.groupBy("g", "bucket").agg(F.sum("k").alias("n")).withColumn("until", F.sum("n").over(up)).withColumn("before", F.col("until") - F.col("n"))
        hits = materialize(targets.join(counts, "g").where("before <= rank and rank < until").select(F.concat_ws("/", "g", F.col("bucket").cast("string")).alias("g"), (F.col("rank") - F.col("before")).alias("rank"), "own", "asked"), "hits")
        inside = placed.select(F.concat_ws("/", "g", F.col("bucket").cast("string")).alias("g"), "x", "k")
        rows, targets = materialize(inside.join(_narrow(hits.select("g").distinct()), "g", "left_semi"), "values"), hits
        written.append(rows)
    for t in written:
        discard(t)
    return reduce(DataFrame.union, found)


def _narrow(table: DataFrame, most: int = 10_000) -> DataFrame:
    """Broadcast where the table is counted to be short: many groups are joined by a shuffle instead."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def _sorted_out(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Of groups that fit an array: (own, asked, x)."""
    lists = rows.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("x", "k"))).alias("v"))
    upto = F.aggregate("v", F.struct(F.lit(0).cast("long").alias("before"), F.lit(None).cast("double").alias("x")), lambda a, e: F.struct((a["before"] + e["k"]).alias("before"), F.when((a["before"] <= F.col("rank")) & (F.col("rank") < a["before"] + e["k"]), e["x"]).otherwise(a["x"]).alias("x")))
    return targets.join(lists, "g").select("own", "asked", upto["x"].alias("x"))


def interpolated(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float], most: int = 1 << 16) -> DataFrame:
    """(keys, a column a share): linearly interpolated quantiles over the values that aren't null; groups without any are null.

    Keys may be null and of any type that has a text. Where each group is counted to have ``most`` values or fewer, one
    aggregate holds them; else groups of any size are dealt to many tasks (``at_ranks``). No task's state is larger.
    """
    if (rows.groupBy(*keys).agg(F.count(value).alias("n")).agg(F.max("n")).first()[0] or 0) <= most:
        q = F.percentile(F.col(value).cast("double"), F.array(*map(F.lit, shares.values())))
        return rows.groupBy(*keys).agg(q.alias("_q"), F.count(F.lit(1)).alias("_n")).where("_n > 0").select(*keys, *[F.col("_q")[i].alias(c) for i, c in enumerate(shares)])
    name = F.concat_ws("|", F.lit("g"), *[F.coalesce(F.concat(F.length(F.col(k).cast("string")).cast("string"), F.lit(":"), F.col(k).cast("string")), F.lit("-")) for k in keys])
    own = rows.select(*[F.col(k).alias(f"key{i}") for i, k in enumerate(keys)], name.alias("g"), F.col(value).cast("double").alias("x"))
    groups = materialize(own.groupBy("g").agg(F.count("x").alias("n"), *[F.first(f"key{i}").alias(f"key{i}") for i in range(len(keys))]), "groups")
    place = lambda q: F.lit(q) * (F.col("n") - 1)
    ends = [e.cast("long") for q in shares.values() for e in (F.floor(place(q)), F.ceil(place(q)))]
    targets = groups.where("n > 0").select("g", F.explode(F.array_distinct(F.array(*ends))).alias("rank"))
    at = at_ranks(own, targets, "x", most).groupBy(F.col("own").alias("g")).agg(F.map_from_entries(F.collect_list(F.struct("asked", "x"))).alias("at"))

    def between(q: float) -> Column:
        low, high = (F.element_at("at", e.cast("long")) for e in (F.floor(place(q)), F.ceil(place(q))))
        return low + (high - low) * (place(q) - F.floor(place(q)))

    return groups.join(at, "g", "left").select(*[F.col(f"key{i}").alias(k) for i, k in enumerate(keys)], *[between(q).alias(c) for c, q in shares.items()])
