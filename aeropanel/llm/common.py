"""Helpers shared by the training-data operators: written intermediates, exact ranks, components."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import discard, materialize

WORD = r"[^\x20\x09-\x0D]+"


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names`` with as many leading underscores as set them apart from all columns of ``df``, in any case."""
    taken, mark = {c.lower() for c in df.columns}, "_"
    while any((mark + n).lower() in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


def hot_safe_rank(df: DataFrame, keys: list[str], h: str, rows_in_bucket: int = 512) -> tuple[DataFrame, DataFrame]:
    """Exact ranks within groups of which one may hold most of the rows.

    ``h``: a BIGINT hash column that spreads rows; the rank follows its unsigned order (ties: any order). Keys must
    not be null. Each group is cut by the leading bits of ``h`` into buckets of about ``rows_in_bucket`` rows, so no
    task gets a whole hot group. Returns (rows with ``bucket`` and the 0-based ``in_bucket``, a table
    keys+bucket -> ``before``, the group's rows in earlier buckets): rank = before + in_bucket.
    """
    most = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(most, 1) / rows_in_bucket)))
    bucket = F.shiftrightunsigned(F.col(h), 64 - bits) if bits else F.lit(0).cast("long")
    rows = df.withColumn("bucket", bucket)
    by = Window.partitionBy(*keys, "bucket").orderBy(h)
    ranked = rows.withColumn("in_bucket", (F.row_number().over(by) - 1).cast("long"))
    earlier = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(*keys, "bucket").count().withColumn("before", F.coalesce(F.sum("count").over(earlier), F.lit(0)).cast("long")).drop("count")
    return ranked, before


def join_hot(rows: DataFrame, table: DataFrame, key: str | list[str], keys: int = 1024, by: str | None = None, total: int | None = None, most: int | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with ``table(key, n, ...)``, one row a key, ``n`` the rows that have it (or about); or ``sizes(key, n)`` has n.

    A key of over 1/``keys`` of all rows (``total``; by default the sum of n) is cut into salts of that share: at most
    ``keys`` keys, so their table is broadcast, whatever the input's size; where no key has over a share (``most``: the
    largest n, read with the total), nothing is salted or broadcast. Salts follow the hash of the column ``by``,
    which has to tell a key's rows apart; without it the rows' places, so that equal rows part too, for which ``rows`` has
    to be a written table: a task that runs again then gives the same. No task gets a whole hot key, at any setting of
    adaptive execution.
    """
    on = [key] if isinstance(key, str) else key
    counted = table if sizes is None else sizes
    if total is None:
        total, most = counted.agg(F.sum("n"), F.max("n")).first()
    share = max(1, (total or 0) // keys)
    if not total or (most is not None and most <= share):
        return rows.join(table.hint("merge"), on)
    salts, salt = "_salts", "_salt"  # ``rows`` and ``table`` are the operators' own
    hot = F.broadcast(counted.where(F.col("n") > share).select(*on, F.ceil(F.col("n") / share).cast("long").alias(salts)))
    place = rows.withColumn(salt, F.monotonically_increasing_id() if by is None else F.xxhash64(by))
    left = place.join(hot, on, "left").withColumn(salt, F.coalesce(F.pmod(F.col(salt), F.col(salts)), F.lit(0))).drop(salts)
    # a table that has n itself needs no join for its salts
    own = table.withColumn(salts, F.when(F.col("n") > share, F.ceil(F.col("n") / share).cast("long"))) if "n" in table.columns else table.join(hot, on, "left")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(salts) - 1, F.lit(0))))
    right = own.withColumn(salt, each).drop(salts)
    return left.join(right.hint("merge"), [*on, salt]).drop(salt)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node reachable, for every node of ``edges(a, b)``, BIGINT and not null.

    Minimum labels go over the edges and jump to their label's label; both halves of a round are written tables, so that a
    plan holds one of its joins, deleted once read. Hubs and the labels of large components are salted in both joins. An
    empty table gives an empty one.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    first = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    labels = written = materialize(first.select("node", F.least("node", "m").alias("label"), "n"), "labels")
    n_edges, hub, n_nodes = labels.agg(F.sum("n"), F.max("n"), F.count(F.lit(1))).first()
    for _ in range(max_rounds):
        seen = join_hot(both, labels.select(F.col("node").alias("b"), "label", "n"), "b", by="a", total=n_edges or 0, most=hub).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        lower = materialize(labels.join(seen.hint("merge"), "node").select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"), F.col("n").alias("degree")), "lower")
        sizes = lower.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        jump = sizes.join(labels.select(F.col("node").alias("label"), F.col("label").alias("next")).hint("merge"), "label")
        jumped = join_hot(lower, jump, "label", by="node", total=n_nodes, sizes=sizes)  # a label is a node, so none lacks
        new = materialize(jumped.select("node", "was", F.least("label", "next").alias("label"), F.col("degree").alias("n")), "labels")
        discard(lower)
        discard(written)
        written, moved = new, new.where("label <> was").limit(1).count()
        labels = new.select("node", "label", "n")
        if not moved:
            discard(both)
            return labels.select("node", "label")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


Alike = Callable[[list[bytes], list[bytes]], np.ndarray]
Cross = Callable[[list[bytes], np.ndarray, list[bytes], np.ndarray], set[tuple[int, int]]]


def components_of_blocks(keyed: DataFrame, sig: DataFrame, alike: Alike, cross: Cross, tag: str, rows: int = 2048) -> DataFrame:
    """(node, label): components of the links between alike nodes that share a block; nodes without a link may lack.

    ``keyed(block, node, loose)``, distinct; ``sig(node, sig binary)``, one row a node. Every node is held against the
    smallest of each of its blocks (``alike``, of pairs), and components follow. Blocks whose nodes are of several
    components by then, where they are ``loose`` (not all alike), are searched whole (``across``), so no link is lost
    and no list of all pairs is made.
    """
    heads = keyed.groupBy("block").agg(F.min("node").alias("head"), F.max("node").alias("last"), F.count(F.lit(1)).alias("n")).where("head <> last").drop("last")
    heads = materialize(heads, f"{tag}-heads")
    members = materialize(join_hot(keyed, heads, "block").select("block", "node", "head", "loose"), f"{tag}-members")
    discard(heads)
    pairs = members.where("node <> head").select("node", "head").distinct()
    pairs = materialize(pairs, f"{tag}-pairs")
    sizes = pairs.groupBy("head").agg(F.count(F.lit(1)).alias("n"))
    total, most = sizes.agg(F.sum("n"), F.max("n")).first()
    at_head = sizes.join(sig.select(F.col("node").alias("head"), F.col("sig").alias("other")).hint("merge"), "head")
    both = join_hot(pairs.join(sig.hint("merge"), "node"), at_head, "head", by="node", total=total or 0, most=most).select("node", "head", "sig", "other")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.filter(pa.array(alike(batch.column(2).to_pylist(), batch.column(3).to_pylist()), pa.bool_()))
            yield pa.RecordBatch.from_arrays([found.column(0), found.column(1)], ["a", "b"])

    edges = materialize(both.mapInArrow(match, "a long, b long"), f"{tag}-alike")
    discard(pairs)
    labels = components(edges)
    more = across(members.where("loose").select("block", "node"), labels, sig, cross, rows)
    discard(members)
    discard(edges)
    return labels if more.isEmpty() else joined_labels(labels, more, tag)


def joined_labels(labels: DataFrame, more: DataFrame, tag: str) -> DataFrame:
    """``labels(node, label)`` under the further links ``more(a, b)`` between labels or nodes that lack there; only these links take part in rounds."""
    joined = components(more)
    own = materialize(labels.union(joined.select("node", F.col("node").alias("label"))).distinct(), f"{tag}-own")  # a label's own row is in both
    sizes = own.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    to = sizes.join(joined.select(F.col("node").alias("label"), F.col("label").alias("to")).hint("merge"), "label", "left").select("label", "n", F.coalesce("to", "label").alias("to"))
    to = materialize(to, f"{tag}-to")
    return materialize(join_hot(own, to, "label", by="node").select("node", F.col("to").alias("label")), f"{tag}-labels")


def across(members: DataFrame, labels: DataFrame, sig: DataFrame, cross: Cross, rows: int = 2048) -> DataFrame:
    """(a, b), a written table: labels joined by alike nodes of one block; blocks of over ``rows`` nodes are cut, and each pair of pieces is a group of its own; smaller ones go in bundles."""
    own = materialize(members.join(labels.hint("merge"), "node", "left").select("block", "node", F.coalesce("label", "node").alias("label")), "labelled")
    mixed = own.groupBy("block").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count(F.lit(1)).alias("n")).where("a <> b").select("block", "n")
    mixed = materialize(mixed.withColumn("pieces", F.ceil(F.col("n") / rows).cast("int")), "mixed")
    piece = F.pmod(F.xxhash64("node"), F.col("pieces").cast("long")).cast("int")
    cut = in_bundles(join_hot(own, mixed, "block").join(sig.hint("merge"), "node").withColumn("piece", piece), mixed, rows // 16)

    def found_in(one: bool, left: np.ndarray, right: np.ndarray, label: np.ndarray, sigs: list[bytes]) -> set[tuple[int, int]]:
        names, n = np.unique(label[left] if one else label[np.concatenate((left, right))], return_counts=True)
        most, found = names[n.argmax()], set()  # nodes of the commonest label need not meet each other
        sides = [(left[label[left] != most], right)]
        if not one:
            sides.append((left[label[left] == most], right[label[right] != most]))
        for a, b in sides:
            if len(a) and len(b):
                found |= cross([sigs[i] for i in a.tolist()], label[a], [sigs[i] for i in b.tolist()], label[b])
        return found

    def search(table: pa.Table) -> pa.Table:
        block, piece, one, two, label = (table.column(c).to_numpy() for c in ("block", "piece", "one", "two", "label"))
        sigs, found = table.column("sig").to_pylist(), set()
        order = np.argsort(block, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
            left = rows[piece[rows] == one[rows]]
            right = left if (own := one[rows[0]] == two[rows[0]]) else rows[piece[rows] == two[rows]]
            found |= found_in(own, left, right, label, sigs)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    found = materialize(in_piece_pairs(cut.select("bundle", "block", "label", "sig", "piece", "pieces")).groupBy("bundle", "one", "two").applyInArrow(search, "a long, b long"), "across")
    discard(own)
    discard(mixed)
    return found


def in_bundles(cut: DataFrame, blocks: DataFrame, rows: int) -> DataFrame:
    """``cut(block, n, ...)`` with ``bundle``: blocks of ``rows`` rows at most together, about as many, others by themselves.

    A group costs a worker far more than a few rows, and most blocks have a few. ``blocks(block, n, pieces)`` has their sizes.
    """
    small = blocks.where(F.col("n") <= rows).agg(F.sum("n")).first()[0] or 0
    together = F.pmod(F.xxhash64("block"), F.lit(max(1, math.ceil(small / rows))))
    return cut.withColumn("bundle", F.when(F.col("n") <= rows, together).otherwise(F.col("block")))


def in_piece_pairs(cut: DataFrame) -> DataFrame:
    """Rows with ``piece`` of ``pieces``, once for each pair of pieces (one <= two) that theirs is in."""
    other = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    return cut.select("*", other.alias("other")).withColumn("one", F.least("piece", "other")).withColumn("two", F.greatest("piece", "other")).drop("other", "pieces")


def label_pairs(i: np.ndarray, j: np.ndarray) -> set[tuple[int, int]]:
    """Distinct unordered pairs of unlike labels."""
    some = i != j
    if not some.any():
        return set()
    return set(map(tuple, np.unique(np.sort(np.stack([i[some], j[some]], axis=1), axis=1), axis=0).tolist()))
