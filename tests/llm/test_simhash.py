import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from aeropanel.llm import simhash

from .fixtures import documents, frame


def brute_fp(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_labels(fps, reach):
    of = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= reach:
                a, b = of[i], of[j]
                of = [min(a, b) if x in (a, b) else x for x in of]
    return of


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="abAB é\t\n\x0b\x1c\x85", max_size=60))
def test_fingerprint(text):
    assert simhash.simhash(text.encode()) == brute_fp(text)


def clustered(n, seed):
    rng = random.Random(seed)
    fps = set()
    centres = [rng.getrandbits(64) for _ in range(12)]
    while len(fps) < n:
        x = rng.choice(centres) if rng.random() < 0.6 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 9)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    return np.array(sorted(fps), np.uint64)


@pytest.mark.parametrize("parts", [1, 2, 3, 5])
def test_trees_lose_no_link(parts):
    fps = clustered(1500, 1)
    near = np.argwhere(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    together = np.zeros(len(near), bool)
    for p in range(parts):
        own = simhash.part_of(fps, p, parts)
        index, shard = simhash.route(own, simhash.build_tree(own[::3], 16, 4 // parts), 4 // parts)
        held = np.zeros((len(fps), shard.max() + 1), bool)
        held[index, shard] = True
        assert held.shape[1] > 4
        together |= (held[near[:, 0]] & held[near[:, 1]]).any(axis=1)
    assert together.all()


def roots(pairs):
    of = {}

    def find(x):
        while of.setdefault(x, x) != x:
            x = of[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        of[b] = a
    return {x: find(x) for x in of}


@pytest.mark.parametrize(("parts", "rows"), [(1, 64), (3, 64), (5, 64), (5, 8192)])
def test_links_join_what_brute_force_joins(spark, parts, rows):
    fps = clustered(1200, 2)
    signed = fps.view(np.int64).tolist()
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = roots((r["a"], r["b"]) for r in simhash.near_links(frame, 4, parts, rows, 400).collect())
    labels = brute_labels([int(x) for x in fps], 4)
    by = {}
    for x, k in zip(signed, labels):
        by.setdefault(k, set()).add(x)
    mine = {}
    for x, k in got.items():
        mine.setdefault(k, set()).add(x)
    assert sorted(map(sorted, mine.values())) == sorted(sorted(v) for v in by.values() if len(v) > 1)


def test_no_group_outgrows_two_pieces(spark):
    from pyspark.sql import functions as F

    frame = spark.range(300_000).select(F.xxhash64("id").alias("fp"))
    frame = frame.union(spark.range(60_000).select((F.col("id") * 2 + 1).alias("fp"))).distinct()  # a third alike in most bits
    groups = simhash.piece_pairs(frame, 4, 5, 4096, 16_384).groupBy("shard", "one", "two").count()
    assert groups.agg(F.max("count")).first()[0] < 2 * 4096 * 1.25


def test_dense_cluster():
    base = np.uint64(123456789)
    fps = np.unique(np.array([base ^ np.uint64(1 << a) ^ np.uint64(1 << b) for a in range(64) for b in range(64)], np.uint64))
    assert len(set(simhash.link(fps, None, 4)[1].tolist())) == 1
    both, root = simhash.link(fps[:700], fps[700:], 4)
    assert len(set(root.tolist())) == 1 and len(both) == len(fps)


def test_components(spark):
    rows = documents()
    long = " ".join(f"w{i}" for i in range(400))
    rows += [(3000 + i, long.replace("w7 ", f"v{i} "), "en", "a", 1, "x", "y", "z") for i in range(5)]
    docs = frame(spark, rows)
    got = simhash.near_duplicates(docs, shard_rows=16).collect()
    fps = [brute_fp(r[1]) for r in rows]
    label = brute_labels(fps, 4)
    first = {}
    for r, k in zip(rows, label):
        if r[0] is not None:
            first[k] = min(first.get(k, r[0]), r[0])
    want = sorted((str(r[0]), f, str(first.get(k))) for r, f, k in zip(rows, fps, label))
    assert want == sorted((str(r["doc_id"]), r["fp"] & (1 << 64) - 1, str(r["component_id"])) for r in got)
    digest = {r["doc_id"]: r["fingerprint"] for r in simhash.op8(docs).collect()}
    assert digest[2001] == "0" * 16 and all(digest[r[0]] == f"{f:016x}" for r, f in zip(rows, fps) if r[0] is not None)


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else {""}


def varied(seed=5, groups=14, own=60):
    """Texts with edited copies, and how alike they are."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choices(words, k=rng.randint(30, 400))) for _ in range(own)]
    for i in range(groups):
        base = texts[i].split()
        for k in range(4):
            copy = list(base)
            for at in rng.sample(range(len(base)), max(1, len(base) * k // 160)):
                copy[at] = f"new{rng.random()}"
            texts.append(" ".join(copy if k % 2 else [*copy, "and", "more", f"end{k}"]))
    return texts


def test_similar_groups_hold_all_alike_texts_and_no_others(spark):
    texts = varied()
    rows = [(i, t, "en", "a", 1, "x", "y", "z") for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["group"] for r in simhash.similar_groups(frame(spark, rows).select("doc_id", "text")).collect()}
    sets = [shingles(t) for t in texts]
    likeness = {(i, j): len(a & b) / len(a | b) for i, a in enumerate(sets) for j, b in enumerate(sets[:i])}
    sure = [(i, j) for (i, j), x in likeness.items() if x >= 0.8]
    assert len(sure) > 40 and sum(got[i] == got[j] for i, j in sure) >= 0.97 * len(sure)
    loose = roots([(i, j) for (i, j), x in likeness.items() if x >= 0.6])
    assert all(loose.get(i) is not None and loose.get(i) == loose.get(j) for i, j in likeness if got[i] == got[j])


def test_keep_one_of_each_group(spark):
    rows = documents() + [(3000 + i, t, "en", "a", 1, "x", "y", "z") for i, t in enumerate(varied(groups=5, own=20))]
    rows += [(1, "A a", "en", "a", 1, "x", "y", "z"), (None, "a A", "en", "a", 2, "x", "y", "z"), (None, "b b b", "en", "a", 3, "x", "y", "z"), (None, "B b b", "en", "a", 4, "x", "y", "z")]
    docs = frame(spark, rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    key = docs.select("doc_id", "text").distinct()
    groups = {(r["doc_id"], r["text"]): r["group"] for r in simhash.similar_groups(key.withColumn("own", key["text"])).withColumnRenamed("own", "text").collect()}
    first = {}
    for (doc_id, text), k in groups.items():
        first.setdefault(k, []).append(((doc_id is None, doc_id or 0), doc_id, text))
    assert len(got) == len(first) and len(set(got)) == len(got)
    for (doc_id, text) in got:
        assert (doc_id is None, doc_id or 0) == min(x for x, *_ in first[groups[doc_id, text]])
    assert sum(d is None for d, _ in got) == 1  # "b b b" alone: the other texts have ids


def test_clashing_columns(spark):
    docs = frame(spark, documents(6)).withColumnRenamed("bucket", "_none").withColumnRenamed("h", "_KEY").withColumnRenamed("size", "group")
    assert simhash.keep_one(docs).columns == docs.columns and simhash.keep_one(docs).count() == simhash.keep_one(frame(spark, documents(6))).count()


def test_empty(spark):
    assert simhash.op8(frame(spark, [])).collect() == [] and simhash.keep_one(frame(spark, [])).collect() == []


def test_comparisons_a_row_do_not_grow(spark):
    """Eight times the random fingerprints in shards of the same bound: shards are dealt again by exact bits, not cut into pairs of pieces."""
    from pyspark.sql import functions as F

    most, seen = 64, []
    for n in (50_000, 400_000):  # at 8,192 fingerprints a shard these would be 6 and 51 million
        frame = spark.range(n).select(F.xxhash64("id").alias("fp"))
        groups = simhash.piece_pairs(frame, 4, 5, most, 16_384).groupBy("shard", "one", "two").agg(F.count(F.lit(1)).alias("n"))
        seen.append(groups.agg(F.sum(F.col("n") * F.col("n")) / n).first()[0])
    assert max(seen) < 30 * most and seen[1] < 2 * seen[0]


def test_hubs_are_salted(spark):
    """A hub of 40,000 edges, adaptive execution off: no task of a round's joins gets a twentieth of the rows."""
    from pyspark.sql import functions as F

    from aeropanel.llm import common

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        edges = common.materialize(spark.range(1, 40_001).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b")).union(spark.range(50_000, 50_010).selectExpr("id AS a", "id + 1 AS b")), "hub")
        both = common.materialize(edges.union(edges.select("b", "a")), "both")
        degree = common.materialize(both.groupBy("b").agg(F.count(F.lit(1)).alias("n")), "degree")
        joined = common.join_hot(both, degree, "b", by="a", total=both.count()).withColumn("task", F.spark_partition_id())
        most = joined.groupBy("task").count().agg(F.max("count")).first()[0]
        assert joined.count() == both.count() and most < both.count() / 20
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    labels = {r["node"]: r["label"] for r in common.components(edges).collect()}
    assert len(labels) == 40_001 + 11 and set(labels.values()) == {0, 50_000}


def test_a_round_of_components_is_a_small_plan(spark, monkeypatch):
    """A hub with chains: what a round writes holds three joins at most, one of them broadcast; without a hot key a join broadcasts nothing."""
    from pyspark.sql import functions as F

    from aeropanel.llm import common

    def joins(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return plan.count("SortMergeJoin"), plan.count("BroadcastHashJoin")

    seen, write = [], common.materialize
    monkeypatch.setattr(common, "materialize", lambda df, tag: (seen.append(joins(df)), write(df, tag))[1])
    edges = [(0, i) for i in range(1, 3000)] + [(i, i + 1) for i in range(5000, 5009)] + [(9001, 9000), (9002, 9001)]
    labels = {r["node"]: r["label"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert labels == {i: 0 for i in range(3000)} | {i: 5000 for i in range(5000, 5010)} | {i: 9000 for i in range(9000, 9003)}
    assert len(seen) > 4 and all(a <= 2 and b <= 1 for a, b in seen)

    rows = write(spark.range(20_000).select((F.col("id") % 5000).alias("k"), "id"), "rows")
    for hot, broadcast in ((False, 0), (True, 1)):
        own = write(rows.withColumn("k", F.when(F.col("id") < 9000, 7).otherwise(F.col("k")).cast("long")), "hot") if hot else rows
        out = common.join_hot(own, write(own.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "sizes"), "k")
        assert joins(out) == (1, broadcast)
        assert out.columns == ["k", "id", "n"] and out.count() == out.select("id").distinct().count() == 20_000


def test_near_dedup_searches_shards_by_a_tree_of_vantage_points(monkeypatch):
    """Clusters of wide fingerprints: the links of brute force, by a fraction of its comparisons; the boundaries overlap by the whole reach."""
    rng, reach = np.random.default_rng(4), simhash.reach_for(0.8)

    def flipped(base, n, most):
        bits = np.unpackbits(np.tile(base, (n, 1)), axis=1)
        for row in bits:
            row[rng.choice(512, rng.integers(0, most + 1), replace=False)] ^= 1
        return np.packbits(bits, axis=1)

    rows = np.concatenate([flipped(rng.integers(0, 256, 64, np.uint8), 60, most) for most in (20, 40, 60, 100, 130, 160) * 4])
    rows = np.concatenate((rows, rng.integers(0, 256, (200, 64), np.uint8)))[rng.permutation(1640)]
    words = rows.view(np.uint64)
    near = np.bitwise_count(words[:, None] ^ words[None]).sum(axis=2) <= reach
    seen, compared = np.zeros(near.shape, np.int64), 0
    for i, j in simhash.tree_leaves(words, words, reach):
        seen[np.ix_(i, j)] += 1
        compared += len(i) * len(j)
    assert (seen[near] == 1).all() and seen.max() == 1 and compared == seen.sum() < near.size / 3
    sigs, label = [r.tobytes() for r in rows], np.arange(len(rows))
    calls, leaves = [], simhash.tree_leaves
    monkeypatch.setattr(simhash, "tree_leaves", lambda *a: calls.append(a) or leaves(*a))
    got = simhash.alike_within(reach)[1](sigs[:800], label[:800], sigs[800:], label[800:])
    i, j = np.nonzero(near[:800, 800:])
    assert got == set(zip(i.tolist(), (j + 800).tolist(), strict=True)) and calls
    for a, b in ((words[:0], words), (words, words[:0])):
        assert not list(simhash.tree_leaves(a, b, reach))
    same = np.tile(words[:1], (300, 1))
    assert sum(len(i) * len(j) for i, j in simhash.tree_leaves(same, same, reach)) == 300 * 300
