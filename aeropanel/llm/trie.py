"""Conversation prefix trie: nodes by sums of hashes along rebuilt conversations, subtree sums by heavy-path decomposition."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import laid_out, scan
from .common import discard, join_hot, materialize

SHARED, SPREAD = 100, 6  # a conversation takes its first turns, fewer than SPREAD, from the one of its hundred's start
LANES = ["s1", "s2", "s3", "s4"]


def _lanes() -> list[Column]:
    """What a turn ``t`` at depth ``d`` adds to a prefix: four numbers of 32 bits, summed in 64."""
    one, two = F.xxhash64("t", "d"), F.xxhash64("d", F.lit(1), "t")
    return [x for h in (one, two) for x in (F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit((1 << 32) - 1)))]


def _key(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", depth, *sums).cast("binary")))


ROOT = bytes.fromhex(hashlib.md5(b"0,0,0,0,0").hexdigest())


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((c, d, t, chars): the rebuilt turns of each conversation from depth 1, t a digest of role and text; all c). Both are written.

    Turns are put in order by ranges, so a conversation of any length is dealt to many tasks.
    """
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text"))
    turn = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("c"), "turn", F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("t"), F.length(text).cast("long").alias("chars")
    )
    blocks = laid_out(turn, ["c"], ["turn", "t"], "turns")
    placed = materialize(scan(blocks, ["c"], ["turn", "t"], add={"pos": F.lit(1).cast("long")}).select("c", "pos", "t", "chars", (F.col("c") - F.col("c") % SHARED).alias("base")), "placed")
    discard(blocks)
    h = F.crc32(F.col("c").cast("string").cast("binary")) % SPREAD
    first = placed.where((F.col("c") == F.col("base")) & (F.col("pos") < SPREAD)).select("base", "pos", "t", "chars")
    of_base = placed.groupBy("base").agg(F.count(F.lit(1)).alias("n")).join(first.groupBy("base").agg(F.count(F.lit(1)).alias("have")), "base", "left")
    bases = materialize(of_base.select("base", "n", F.coalesce("have", F.lit(0)).alias("have")), "bases")
    own = join_hot(placed.withColumn("h", h).where("pos > h"), bases, "base").select("c", (F.col("pos") - F.col("h") + F.least("h", "have")).alias("d"), "t", "chars")
    convs = materialize(placed.groupBy("c").agg(F.first("base").alias("base")), "convs")
    front = convs.withColumn("h", h).join(first, "base").where("pos <= h").select("c", F.col("pos").alias("d"), "t", "chars")
    turns = materialize(own.union(front), "rebuilt")
    for t in (placed, bases):
        discard(t)
    return turns, convs


def heavy_paths(rows: DataFrame, root: int) -> tuple[DataFrame, DataFrame]:
    """(nodes below the root, conversations' ends), both written, of ``rows(c, d, block, chars, key, pkey, ends)``, a written table.

    A node's heavy child is that with the most members (ties: the smallest member), so at most log2 of all
    conversations light edges lie on a way from the root. A node's ``level`` counts them, its ``head`` is the top of its
    path; both are running values along the turns of the node's smallest member. ``above`` is the head of the parent's
    path.
    """
    nodes = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("c").alias("conv_id"), F.first("pkey").alias("pkey"), F.first("chars").alias("chars")), "nodes")
    children = nodes.groupBy("pkey").agg(F.count(F.lit(1)).alias("n"), F.max_by("key", F.struct("members", -F.col("conv_id"))).alias("heavy"))
    parents = children.join(nodes.select(F.col("key").alias("pkey"), F.col("conv_id").alias("parent")), "pkey", "left").withColumn("parent", F.coalesce("parent", F.lit(root)))
    parents = materialize(parents, "parents")
    known = join_hot(nodes, parents, "pkey").select("key", "members", "conv_id", "chars", "parent", (F.col("key") != F.col("heavy")).alias("light"))
    known = known.join(parents.select(F.col("pkey").alias("key"), F.col("n").alias("children")), "key", "left")
    known = materialize(known.select("key", F.col("members").alias("n"), "conv_id", F.col("chars").alias("node_chars"), "parent", "light", F.coalesce("children", F.lit(0)).alias("children")), "known")
    placed = materialize(join_hot(rows.select("c", "d", "block", "key", "ends"), known, "key").drop("key"), "placed")
    top = F.when(F.col("light"), F.struct("conv_id", "d"))
    along = scan(placed, ["c"], ["d"], add={"level": F.col("light").cast("long")}, last={"head": top}, before={"above": top}).where("c = conv_id")
    start = F.struct(F.lit(root).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("d"))
    head, above = (F.coalesce(x, start) for x in ("head", "above"))
    found = along.select("conv_id", F.col("d").alias("depth"), "parent", "n", "children", F.col("node_chars").alias("chars"), "level", *[x[f].alias(f"{n}_{f}") for n, x in (("head", head), ("above", above)) for f in ("conv_id", "d")])
    found = materialize(found, "found")
    ends = materialize(placed.where("ends").select("conv_id", F.col("d").alias("depth"), "c"), "ends")
    for t in (nodes, parents, known, placed):
        discard(t)
    return found, ends


VALUES = ["leaves", "saved"]


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``leaves`` and ``saved`` summed over subtrees; a written table.

    A path's own sum and those of the light paths attached to it go up level by level, a small table each; then every
    node gets what is attached to it, and one suffix sum along the paths, laid out as arrays in blocks, gives all.
    """
    is_head = F.expr("conv_id = head_conv_id and depth = head_d")
    site = F.max(F.when(is_head, F.struct("parent", (F.col("depth") - 1).alias("at"), "above_conv_id", "above_d"))).alias("site")
    paths = materialize(nodes.groupBy("level", "head_conv_id", "head_d").agg(*[F.sum(v).alias(v) for v in VALUES], site).select("level", "head_conv_id", "head_d", *VALUES, "site.*"), "paths")
    levels = paths.agg(F.max("level")).first()[0]
    totals, arriving = [], None
    for level in range(levels, 0, -1):
        own = paths.where(F.col("level") == level)
        if arriving is not None:
            own = own.join(arriving, ["head_conv_id", "head_d"], "left").select("parent", "at", "above_conv_id", "above_d", *[(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in VALUES])
        totals.append(materialize(own.select("parent", "at", "above_conv_id", "above_d", *VALUES), "totals"))
        arriving = totals[-1].groupBy(F.col("above_conv_id").alias("head_conv_id"), F.col("above_d").alias("head_d")).agg(*[F.sum(v).alias(f"more_{v}") for v in VALUES])
    whole = nodes
    if totals:
        attached = reduce(DataFrame.union, totals).groupBy(F.col("parent").alias("conv_id"), F.col("at").alias("depth")).agg(*[F.sum(v).alias(f"more_{v}") for v in VALUES])
        whole = nodes.join(attached, ["conv_id", "depth"], "left").select(*[c for c in nodes.columns if c not in VALUES], *[(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in VALUES])
    blocks = laid_out(whole.withColumn("up", -F.col("depth")), ["head_conv_id", "head_d"], ["up"], "paths")
    out = scan(blocks.withColumnsRenamed({v: f"own_{v}" for v in VALUES}), ["head_conv_id", "head_d"], ["up"], add={v: F.col(f"own_{v}") for v in VALUES})
    out = materialize(out.select("conv_id", "depth", "parent", "n", "children", *VALUES), "sums")
    for t in (paths, blocks, *totals):
        discard(t)
    return out


def end_digests(ends: DataFrame, ids: int = 8192) -> DataFrame:
    """(conv_id, depth, ends_sha256) of ``ends(conv_id, depth, c)``: SHA-256 of the c, ascending and comma-joined.

    Ranges of (node, c) are joined into pieces of at most ``ids`` numbers by many tasks; the pieces of a node, a row
    each, then stream through its digest in order, none of them kept.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, depth, c = (x.to_numpy() for x in batch.columns)
            cuts = np.flatnonzero((np.diff(node) != 0) | (np.diff(depth) != 0)) + 1
            starts = [i for a, b in zip([0, *cuts], [*cuts, len(c)]) for i in range(a, b, ids)]
            if starts:
                pieces = [",".join(map(str, c[a:b].tolist())) for a, b in zip(starts, [*starts[1:], len(c)])]
                yield pa.RecordBatch.from_arrays([pa.array(node[starts]), pa.array(depth[starts]), pa.array(c[starts]), pa.array(pieces)], ["conv_id", "depth", "c", "piece"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int64()), pa.array([state.hexdigest()])], ["conv_id", "depth", "ends_sha256"])

        for batch in batches:
            for node, depth, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)):
                if (node, depth) != now:
                    if now:
                        yield done()
                    now, state = (node, depth), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(piece.as_buffer())
        if now:
            yield done()

    by = ["conv_id", "depth", "c"]
    pieces = ends.select(*by).repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(join, "conv_id long, depth long, c long, piece string")
    return pieces.repartition("conv_id", "depth").sortWithinPartitions(*by).mapInArrow(digest, "conv_id long, depth long, ends_sha256 string")


def op13(conversations: DataFrame) -> DataFrame:
    """The contract's columns, a row a node.

    Rows without conv_id belong to no conversation and go; null roles and texts are empty; null turns come first, equal
    turns in the order of the MD5 of their role and text, repeated rows are turns of their own; ``%`` has the sign of
    the id. A conversation left without turns ends at the root; long texts whole; no conversations give no rows; other
    columns go.
    """
    turns, convs = rebuilt(conversations.select("conv_id", "turn", "role", "text"))
    spark = conversations.sparkSession
    root, n = convs.agg(F.min("c"), F.count(F.lit(1))).first()
    if not n:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    blocks = laid_out(turns, ["c"], ["d"], "turns")
    discard(turns)
    lanes = [x.alias(f"a{i}") for i, x in enumerate(_lanes())]
    summed = scan(blocks.select("c", "d", "block", "chars", *lanes), ["c"], ["d"], add={s: F.col(f"a{i}") for i, s in enumerate(LANES)}, ends="ends")
    sums = [F.col(s) for s in LANES]
    keys = _key(F.col("d"), sums).alias("key"), _key(F.col("d") - 1, [s - F.col(f"a{i}") for i, s in enumerate(sums)]).alias("pkey")
    rows = materialize(summed.select("c", "d", "block", "chars", *keys, "ends"), "rows")
    discard(blocks)
    nodes, ends = heavy_paths(rows, root)
    tops = nodes.where("depth = 1").count()
    top = spark.createDataFrame([(root, 0, None, n, tops, 0, 0, root, 0, None, None)], nodes.schema)
    own = nodes.union(top).withColumn("leaves", (F.col("children") == 0).cast("long")).withColumn("saved", (F.col("n") - 1) * F.col("chars"))
    sums = subtree_sums(own)
    turnless = convs.join(rows.where("ends").select("c"), "c", "left_anti").select(F.lit(root).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), "c")
    turnless = materialize(turnless, "turnless")
    for t in (convs, rows, nodes):
        discard(t)
    found = sums.join(end_digests(ends.union(turnless)), ["conv_id", "depth"], "left")
    return found.select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")
    )


ORACLE = r"""
WITH RECURSIVE crc AS (SELECT list(list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
ids AS (
  SELECT c, c - c % 100 AS base, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL), crc),
turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
has AS (SELECT c, max(pos) AS n FROM turns GROUP BY c),
rebuilt AS (
  SELECT i.c, t.pos AS d, t.role, t.text FROM ids i JOIN turns t ON t.c = i.base AND t.pos <= i.h
  UNION ALL SELECT i.c, t.pos - i.h + least(i.h, coalesce(b.n, 0)), t.role, t.text FROM ids i JOIN turns t ON t.c = i.c AND t.pos > i.h LEFT JOIN has b ON b.c = i.base),
rows AS (
  SELECT c, 0 AS d, '' AS key, 0 AS chars FROM ids
  UNION ALL SELECT c, d, md5(string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER (PARTITION BY c ORDER BY d)), length(text) FROM rebuilt),
nodes AS (SELECT d AS depth, key, min(c) AS conv_id, count(*) AS n, any_value(chars) AS chars FROM rows GROUP BY d, key),
linked AS (SELECT v.*, p.conv_id AS parent FROM nodes v LEFT JOIN rows r ON r.c = v.conv_id AND r.d = v.depth - 1 LEFT JOIN nodes p ON p.depth = r.d AND p.key = r.key),
kids AS (SELECT parent, depth - 1 AS depth, count(*) AS k FROM linked WHERE depth > 0 GROUP BY ALL),
below AS (
  SELECT r.d AS depth, r.key, sum(CASE WHEN k.k IS NULL THEN 1 ELSE 0 END) AS leaves, sum((v.n - 1) * v.chars) AS saved
  FROM nodes v LEFT JOIN kids k ON k.parent = v.conv_id AND k.depth = v.depth JOIN rows r ON r.c = v.conv_id AND r.d <= v.depth GROUP BY r.d, r.key),
ends AS (SELECT d AS depth, key, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS cs FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY d DESC) AS o FROM rows) WHERE o = 1 GROUP BY d, key)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, v.parent AS parent_conv_id, v.n AS n_convs, CAST(coalesce(k.k, 0) AS BIGINT) AS n_children, CAST(b.leaves AS BIGINT) AS n_leaves,
  CAST(b.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.cs, '')) AS ends_sha256
FROM linked v LEFT JOIN kids k ON k.parent = v.conv_id AND k.depth = v.depth JOIN below b ON b.depth = v.depth AND b.key = v.key LEFT JOIN ends e ON e.depth = v.depth AND e.key = v.key
"""
