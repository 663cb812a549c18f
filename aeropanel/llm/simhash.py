"""SimHash near-duplicates: exact pairs through a vantage-point tree whose shards overlap at their boundaries."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from ..sources.shared import discard
from .common import Alike, Cross, components, components_of_blocks, in_piece_pairs, join_hot, label_pairs, materialize, unused

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: bytes, width: int = 4, seed: int = 42) -> list[int]:
    """XXH64 of every ``width``-word shingle of the lower-cased (A-Z) text, repeats included."""
    words = text.translate(_LOWER).split()  # bytes split at 20 and 09-0D alone
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(joined, seed)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)]


def bit_counts(words: np.ndarray) -> np.ndarray:
    """In how many rows of ``words`` [n, k] (64-bit) each of the 64 k bits is set."""
    bits, out = np.unpackbits(words.view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little"), np.zeros(64 * words.shape[1], np.int64)
    for at in range(0, len(bits), 255):  # as many as a byte counts
        out += bits[at : at + 255].sum(axis=0, dtype=np.uint8)
    return out


def simhash(text: bytes, width: int = 4, seed: int = 42, block: int = 1 << 16) -> int:
    """64 bits, each set if it is set in over half of the shingles' hashes; 0 for no words."""
    hashes = np.array(shingle_hashes(text, width, seed), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), block):
        ones += bit_counts(hashes[at : at + block, None])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp BIGINT) of every row; null texts are empty, and empty ones have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [simhash(t.as_buffer().to_pybytes() if t.is_valid else b"", width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def part_of(fps: np.ndarray, part: int, parts: int) -> np.ndarray:
    """The bits of ``part`` of ``parts`` of each fingerprint."""
    lo, hi = 64 * part // parts, 64 * (part + 1) // parts
    return (fps >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)


def _split(fps: np.ndarray, reach: int, rng: np.random.Generator, tries: int = 8) -> tuple[np.uint64, int, float]:
    """A vantage point and radius that copy the fewest points over the boundary; the share that the larger side gets."""
    best = (np.uint64(0), 0, 2.0)
    for point in rng.choice(fps, min(tries, len(fps)), replace=False):
        d = np.bincount(np.bitwise_count(fps ^ point), minlength=65).cumsum()
        radius = int(np.searchsorted(d, (len(fps) + 1) // 2))
        inside, outside = d[radius], len(fps) - (d[radius - reach] if radius >= reach else 0)
        share = max(inside, outside) / len(fps)
        if inside < len(fps) and share < best[2]:
            best = (point, radius, float(share))
    return best


def build_tree(sample: np.ndarray, leaves: int, reach: int, seed: int = 7) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage point, radius, inner child, outer child), children under 0 being shard -1-x; [] is one shard."""
    rng, nodes, shards = np.random.default_rng(seed), [], [0]
    depth = 1 + math.ceil(math.log2(leaves)) if leaves > 1 else 0

    def grow(fps: np.ndarray, level: int) -> int:
        if level < depth and len(fps) >= 16:
            point, radius, share = _split(fps, reach, rng)
            if share < 0.9:
                at = len(nodes)
                nodes.append((0, 0, 0, 0))
                d = np.bitwise_count(fps ^ point)
                nodes[at] = (int(point), radius, grow(fps[d <= radius], level + 1), grow(fps[d > radius], level + 1))
                return at
        shards[0] += 1
        return -shards[0]

    grow(sample, 0)
    return nodes


def route(fps: np.ndarray, tree: list[tuple[int, int, int, int]], reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, shard): every point's shard, and the outer shards of points less than ``reach`` inside a boundary.

    For a pair within ``reach`` with x inside and y outside a radius, the triangle inequality puts x's distance over
    radius - reach: copied outwards, x meets y there. So some shard holds both of any such pair.
    """
    if not tree:
        return np.arange(len(fps)), np.zeros(len(fps), np.int64)
    found_i, found_s, stack = [], [], [(0, np.arange(len(fps)))]
    while stack:
        node, own = stack.pop()
        if not len(own):
            continue
        if node < 0:
            found_i.append(own)
            found_s.append(np.full(len(own), -1 - node, np.int64))
            continue
        point, radius, inner, outer = tree[node]
        d = np.bitwise_count(fps[own] ^ np.uint64(point)).astype(np.int64)
        stack.append((inner, own[d <= radius]))
        stack.append((outer, own[d > radius - reach]))
    return (np.concatenate(found_i), np.concatenate(found_s)) if found_i else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class _Sets:
    def __init__(self, n: int):
        self.of = list(range(n))

    def find(self, i: int) -> int:
        of = self.of
        while of[i] != i:
            of[i] = of[of[i]]
            i = of[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.of[max(i, j)] = min(i, j)


def link(left: np.ndarray, right: np.ndarray | None, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(fps, root of each): components under links of ``reach`` differing bits or fewer, within ``left`` or between it and ``right``.

    Rows are laid out by their distance from a vantage point, the first of ``left``; a block of them is compared with
    those alone whose distance lies within ``reach`` of the block's (triangle inequality). A row goes to the components
    that it touches: no list of pairs is made.
    """
    by = lambda x: np.bitwise_count(x ^ left[0]).astype(np.int64)
    if len(left):
        left, right = (None if x is None else x[np.argsort(by(x), kind="stable")] for x in (left, right))
    fps = left if right is None else np.concatenate((left, right))
    sets, start = _Sets(len(fps)), 0 if right is None else len(left)
    own, other_by = (by(x) if len(left) else np.zeros(0, np.int64) for x in (left, fps[start:]))
    for at in range(0, len(left), 512):
        last = min(at + 512, len(left)) - 1
        lo = at if right is None else int(np.searchsorted(other_by, own[at] - reach, "left"))
        hi = int(np.searchsorted(other_by, own[last] + reach, "right"))
        first = start + lo
        near = np.bitwise_count(left[at : at + 512, None] ^ fps[None, first : start + hi]) <= reach
        for row in np.nonzero(near.sum(axis=1) > (right is None))[0].tolist():
            other = first + np.nonzero(near[row])[0]
            if len(other) > 64:  # the touched components, not the points
                roots = np.fromiter((sets.find(i) for i in other.tolist()), np.int64, len(other))
                other = other[np.unique(roots, return_index=True)[1]]
            for j in other.tolist():
                sets.join(at + row, j)
    return fps, fps[np.array([sets.find(i) for i in range(len(fps))], np.int64)] if len(fps) else fps


def piece_pairs(fps: DataFrame, reach: int, parts: int, shard_rows: int, sample_rows: int) -> DataFrame:
    """(shard, one, two, piece, fp): groups of two pieces of a shard (or one with itself) in which every pair within ``reach`` meets.

    A pair within ``reach`` differs in ``reach // parts`` bits or fewer in one of ``parts`` parts of its bits. For each
    part a tree of vantage points, built from about ``sample_rows`` fingerprints at most, deals fingerprints out to shards
    by their part's Hamming distance from vantage points, with copies where a boundary is within that smaller reach
    (``route``); the sample changes shards' sizes, never a result. Where that reach is 0, shards of over ``shard_rows`` are
    dealt again (``finer``). What is over ``shard_rows`` even so is cut into pieces.
    """
    n = fps.count()
    leaves, near, one_in = max(1, math.ceil(n / shard_rows)), reach // parts, math.ceil(n / sample_rows)
    some = fps.where(F.pmod(F.xxhash64("fp"), F.lit(one_in)) == 0).collect() if leaves > 1 else []
    sample = np.sort(np.array([r[0] for r in some], np.int64)).view(np.uint64)
    trees = [build_tree(part_of(sample, p, parts), leaves, near) for p in range(parts if leaves > 1 else 1)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            for p, tree in enumerate(trees):
                index, shard = route(part_of(own.view(np.uint64), p, parts), tree, near)
                yield pa.RecordBatch.from_arrays([pa.array(shard + (p << 32)), pa.array(own[index])], ["shard", "fp"])

    dealt = materialize(fps.select("fp").mapInArrow(deal, "shard long, fp long"), "shards")
    if not near and reach:
        dealt = finer(dealt, reach, parts, shard_rows)
    sizes = dealt.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("pieces"))
    cut = join_hot(dealt, materialize(sizes.withColumn("n", F.col("pieces").cast("long") * shard_rows), "pieces"), "shard").drop("n")
    return in_piece_pairs(cut.withColumn("piece", F.pmod(F.xxhash64("fp"), F.col("pieces").cast("long")).cast("int")))


def finer(dealt: DataFrame, reach: int, parts: int, shard_rows: int) -> DataFrame:
    """``dealt(shard, fp)``, written, with shards of over ``shard_rows`` dealt again, twice at most, by exact bits.

    A pair that a shard of part p is to find has that part equal, so the shard is split by the part's value. Its other
    bits differ in ``reach`` at most, so of ``reach + 1`` runs of them one is equal: where a value holds over
    ``shard_rows`` still, its fingerprints go to a shard for each run and its value. Of 64 random bits at a reach of 4
    these are 8,192 values and then 1,024 more: comparisons a fingerprint stay under 25 * ``shard_rows`` up to 10^10 of
    them, where equal first parts alone would make them grow with the input.
    """

    def over(rows: DataFrame) -> DataFrame:
        sizes = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
        return materialize(sizes.withColumn("over", F.col("n") > shard_rows), "sizes")

    def again(rows: DataFrame, split: Callable[[int, np.ndarray], tuple[np.ndarray, np.ndarray]], tag: str) -> DataFrame:
        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                shard, fp, part = (batch.column(i).to_numpy() for i in range(3))
                for p in np.unique(part).tolist():
                    own = part == p
                    index, key = split(p, fp[own].view(np.uint64))
                    mixed = (shard[own][index].view(np.uint64) * MIXERS[0] ^ key * MIXERS[1] ^ key >> np.uint64(29)) * MIXERS[2]
                    yield pa.RecordBatch.from_arrays([pa.array(mixed.view(np.int64)), pa.array(fp[own][index]), pa.array(np.full(len(index), p, np.int32))], ["shard", "fp", "part"])

        sized = join_hot(rows, over(rows), "shard")
        small = sized.where("not over").select("shard", "fp", "part")
        large = sized.where("over").select("shard", "fp", "part").mapInArrow(deal, "shard long, fp long, part int")
        return materialize(small.union(large), tag)

    def by_value(p: int, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.arange(len(fps)), part_of(fps, p, parts)

    def by_runs(p: int, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cuts = [64 * i // parts for i in range(parts + 1)]
        rest = np.array([b for b in range(64) if not cuts[p] <= b < cuts[p + 1]], np.uint64)
        keys = []
        for j, bits in enumerate(np.array_split(rest, reach + 1)):
            value = np.zeros(len(fps), np.uint64)
            for i, b in enumerate(bits):
                value |= (fps >> b & np.uint64(1)) << np.uint64(i)
            keys.append(value | np.uint64((j + 1) << 56))
        return np.tile(np.arange(len(fps)), reach + 1), np.concatenate(keys)

    rows = materialize(dealt.withColumn("part", F.shiftright("shard", 32).cast("int")), "parts")
    for split, tag in ((by_value, "by-value"), (by_runs, "by-runs")):
        if not rows.groupBy("shard").count().where(F.col("count") > shard_rows).isEmpty():
            rows = again(rows, split, tag)
    return rows.select("shard", "fp")


def near_links(fps: DataFrame, reach: int = 4, parts: int | None = None, shard_rows: int = 8192, sample_rows: int = 32_768) -> DataFrame:
    """(a, b) BIGINT: links that join the distinct fingerprints ``fps(fp)`` of every component; each group of ``piece_pairs`` is searched on its own.

    With the whole fingerprint as one part, boundaries copy 84 % of random ones at each level; with ``reach + 1`` parts
    (the default) the smaller reach is 0 and nothing is copied over a boundary, so a fingerprint lies in that many shards.
    """

    def search(table: pa.Table) -> pa.Table:
        own, piece, one, two = (table.column(c).to_numpy() for c in ("fp", "piece", "one", "two"))
        left, right = (own[piece == x].view(np.uint64) for x in (one, two))
        left, root = link(left, None if one[0] == two[0] else right, reach)
        some = root != left
        return pa.table({"a": left[some].view(np.int64), "b": root[some].view(np.int64)})

    groups = piece_pairs(fps, reach, parts or reach + 1, shard_rows, sample_rows)
    return groups.groupBy("shard", "one", "two").applyInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, reach: int = 4, width: int = 4, **settings) -> DataFrame:
    """(doc_id, fp, component_id): fingerprints link at ``reach`` or fewer differing bits; the smallest doc_id reachable.

    Equal fingerprints become one node before any search (``near_links``, which takes the ``settings``); components over
    shards follow by label rounds in Spark. Null texts are empty; texts of no words share fingerprint 0; a very long
    text is read whole by one task, in blocks; a null doc_id is never a component's id unless all its ids are null;
    repeated rows are rows of one component; other columns play no part; no rows give no rows.
    """
    own = materialize(fingerprints(docs, width), "fingerprints")
    nodes = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "nodes")
    links = materialize(near_links(nodes.select("fp"), reach, **settings), "links")
    labels = components(links)
    discard(links)
    of = nodes.join(labels.select(F.col("node").alias("fp"), "label"), "fp", "left").select("fp", "first", F.col("n").alias("rows"), F.coalesce("label", "fp").alias("label"))
    of = materialize(of, "labelled")
    smallest = materialize(of.groupBy("label").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n")), "smallest")
    named = join_hot(of, smallest, "label", by="fp").select("fp", F.col("rows").alias("n"), "component_id")
    return join_hot(own, materialize(named, "named"), "fp").select("doc_id", "fp", "component_id")


MIXERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def wide_fingerprint(text: bytes, width: int = 5, block: int = 1 << 12) -> tuple[bytes, list[int]]:
    """(512 bits of SimHash over the text's distinct shingles, the smallest of each of the 8 words' hashes)."""
    hashes = np.unique(np.array(shingle_hashes(text, width), np.uint64))
    ones, least = np.zeros(64 * len(MIXERS), np.int64), np.full(len(MIXERS), (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), block):
        x = hashes[at : at + block]
        x = (x ^ (x >> np.uint64(31)))[:, None] * MIXERS
        x ^= x >> np.uint64(29)
        ones += bit_counts(x)
        least = np.minimum(least, x.min(axis=0))
    return np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), least.view(np.int64).tolist()


def reach_for(similarity: float, bits: int = 512) -> int:
    """Differing bits of texts of that Jaccard similarity: their mean, by the cosine 2s / (1 + s), and two deviations more."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * p + 2 * math.sqrt(bits * p * (1 - p)))


def tree_leaves(x: np.ndarray, y: np.ndarray, reach: int, least: int = 1 << 14, tries: int = 4) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of ``x``, rows of ``y``) of the leaves of a vantage-point tree over wide fingerprints [n, words].

    A row of ``y`` is in one leaf. At a vantage point and radius the rows of ``x`` go inside up to ``reach`` beyond the
    radius and outside down to ``reach`` within it, so a row in the overlap goes both ways: by the triangle inequality
    any pair within ``reach`` meets in one leaf, once. Of ``tries`` vantage points and all radii that one is taken which
    leaves the fewest comparisons; a node of under ``least``, or where none saves twice what the tries cost, is a leaf.
    """
    bits, rng = 64 * x.shape[1], np.random.default_rng(7)
    stack = [(np.arange(len(x)), np.arange(len(y)))]
    while stack:
        i, j = stack.pop()
        if not len(i) or not len(j):
            continue
        best = (len(i) * len(j) - 2 * tries * (len(i) + len(j)), 0, None, None)
        for point in rng.choice(j, min(tries, len(j)), replace=False).tolist() if len(i) * len(j) > least else []:
            from_x, from_y = (np.bitwise_count(rows ^ y[point]).sum(axis=1, dtype=np.int64) for rows in (x[i], y[j]))
            up_to_x, up_to_y = (np.bincount(d, minlength=bits + 1).cumsum() for d in (from_x, from_y))
            radius = np.arange(bits)
            near_x = up_to_x[np.minimum(radius + reach, bits)]
            far_x = len(i) - np.where(radius < reach, 0, up_to_x[np.maximum(radius - reach, 0)])
            work = near_x * up_to_y[:-1] + far_x * (len(j) - up_to_y[:-1])
            if work.min() < best[0]:
                best = (int(work.min()), int(work.argmin()), from_x, from_y)
        _, radius, from_x, from_y = best
        if from_x is None:
            yield i, j
            continue
        stack.append((i[from_x <= radius + reach], j[from_y <= radius]))
        stack.append((i[from_x > radius - reach], j[from_y > radius]))


def alike_within(reach: int) -> tuple[Alike, Cross]:
    """The tests of ``components_of_blocks`` for binary fingerprints of equal length."""

    def words(sigs: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(sigs), np.uint64).reshape(len(sigs), -1)

    def alike(a: list[bytes], b: list[bytes]) -> np.ndarray:
        return np.bitwise_count(words(a) ^ words(b)).sum(axis=1) <= reach if a else np.zeros(0, bool)

    def cross(a: list[bytes], label_a: np.ndarray, b: list[bytes], label_b: np.ndarray) -> set[tuple[int, int]]:
        found, x, y = set(), words(a), words(b)
        for i, j in tree_leaves(x, y, reach):
            across, of = np.ascontiguousarray(y[j].T), label_b[j]
            for at in range(0, len(i), 512):
                rows = i[at : at + 512]
                differ = np.zeros((len(rows), len(j)), np.uint16)
                for word, own in enumerate(across):
                    differ += np.bitwise_count(x[rows, word, None] ^ own)
                k, m = np.nonzero((differ <= reach) & (label_a[rows, None] != of))
                found |= label_pairs(label_a[rows[k]], of[m])
        return found

    return alike, cross


def similar_groups(rows: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """(the columns of ``rows`` but text, group BIGINT): texts of ``similarity`` or more, by Jaccard, over shingles of ``width`` words share a group.

    At this similarity fingerprints of 64 bits differ in 10 bits and more, and no vantage point divides a whole corpus of
    them: random ones lie within a few bits of the same distance, so a boundary's copies are the whole shard. Hence the
    fingerprint has 512 bits, of which such texts differ in ``reach_for``, and shards are dealt by the smallest shingle
    hash of one of 8 orders, by which a linked pair is missed once in (1 - similarity)^-8, 400,000 times. Common hashes
    are cut into pieces (``components_of_blocks``). Within a shard, or pair of pieces, a tree of vantage points whose
    boundaries overlap by that reach finds the links (``tree_leaves``); texts of one shingle do have clusters that it divides.
    """
    others = [c for c in rows.columns if c != "text"]
    schema = StructType([*rows.select(*others).schema.fields, StructField("sig", BinaryType()), StructField("least", ArrayType(LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [wide_fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", width) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array([f for f, _ in found], pa.binary()), pa.array([k for _, k in found], pa.list_(pa.int64()))], schema.names)

    own = rows.withColumn("text", F.col("text").cast("string")).mapInArrow(run, schema).withColumn("node", F.xxhash64("sig"))
    own = materialize(own, "wide-fingerprints")
    sig = materialize(own.groupBy("node").agg(F.first("sig").alias("sig"), F.first("least").alias("least"), F.count(F.lit(1)).alias("n")), "wide-nodes")
    keyed = sig.select("node", F.posexplode("least").alias("i", "h")).select(F.xxhash64("i", "h").alias("block"), "node", F.lit(True).alias("loose")).distinct()
    keyed = materialize(keyed, "wide-blocks")
    labels = components_of_blocks(keyed, sig.select("node", "sig"), *alike_within(reach_for(similarity)), "wide")
    discard(keyed)
    of = sig.select("node", "n").join(labels.hint("merge"), "node", "left").select("node", "n", F.coalesce("label", "node").alias("group"))
    return join_hot(own.drop("sig", "least"), materialize(of, "wide-groups"), "node").select(*others, "group")


def keep_one(docs: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """One document of each group of ``similar_groups``, the one of the smallest doc_id; all its columns.

    Rows without a doc_id stay where no row of their group has one, then the one of the smallest hash of its text. Of
    rows equal in doc_id and text one stays, any. Null texts are empty, and texts of no words one group. Very long texts
    are read whole. No rows give no rows.
    """
    none, at, key = unused(docs, "none", "at", "key")
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = docs.withColumns({none: doc_id.isNull(), at: F.coalesce(doc_id, F.lit(0)), key: F.xxhash64(doc_id, text)})
    groups = similar_groups(named.select(F.col(none).alias("none"), F.col(at).alias("at"), F.col(key).alias("key"), "text"), similarity, width)
    kept = groups.groupBy("group").agg(F.min(F.struct("none", "at", "key")).alias("first")).select("first.*").toDF(none, at, key)
    found = named.join(kept.hint("merge"), [none, at, key], "left_semi")
    return found.dropDuplicates([none, at, key]).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
