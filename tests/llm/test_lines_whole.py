"""The whole job of the line dedup: short lines, busy leaves, lines of fields."""

import random

import numpy as np

from aeropanel.llm import common, lines

from .fixtures import frame


def op3(spark, texts):
    rows = [(i, t, "en", "a", 1, "x", "y", "z") for i, t in enumerate(texts)]
    return [r["text"] for r in sorted(lines.op3(frame(spark, rows)).collect(), key=lambda r: r["doc_id"])]


def test_short_lines_that_recur_go(spark):
    texts = ["Les.\nof the first text alone here", "Les.\nAnd ornd.\nTo see\n12", "And ornd.\n\nLes.\nTo see\n13\n全文是一行", "12\n\n全文是一行\nLes"]
    assert op3(spark, texts) == [texts[0], "And ornd.\nTo see\n12", "\n13\n全文是一行", "\nLes"]


def groups_of(own, least=0.8):
    of = list(range(len(own)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i, a in enumerate(own):
        for j, b in enumerate(own[:i]):
            if len(a) == len(b) and a[:2] == b[:2] and sum(x == y for x, y in zip(a, b)) >= least * len(a):
                of[root(i)] = root(j)
    return [root(i) for i in range(len(own))]


def test_no_link_of_a_busy_leaf_is_missed(spark):
    rng = random.Random(5)
    words = [a + b for a in "bcdfgh" for b in ("a", "ee", "ou")]
    own = []
    for n, lines_of in ((5, 350), (7, 250), (10, 350), (16, 150)):
        some = [["from", "the", *rng.choices(words, range(len(words), 0, -1), k=n - 2)] for _ in range(lines_of)]
        for line in some[: lines_of // 2]:
            line = list(line)
            for at in rng.sample(range(2, n), n // 5):
                line[at] = rng.choice(words)
            some.append(line)
        own += some
    rng.shuffle(own)
    want = groups_of(own)
    got = op3(spark, [" ".join(line) for line in own])
    seen = set()
    for line, group, text in zip(own, want, got, strict=True):
        assert text == ("" if group in seen else " ".join(line))
        seen.add(group)


def test_blocks_cut_in_pieces_give_the_same_links(spark):
    rng = random.Random(9)
    own = ["from the old town " + " ".join(rng.choices("abcdefgh", k=6)) for _ in range(300)]
    _, _, line, marks, bounds = lines.parse_lines("\n".join(own).encode())
    tokens = {k: marks[a:b].tobytes() for k, a, b in zip(line.tolist(), bounds, bounds[1:])}
    members = spark.createDataFrame([(1, k) for k in tokens], "block long, node long")
    sig = spark.createDataFrame([(k, bytearray(v)) for k, v in tokens.items()], "node long, sig binary")
    labels = spark.createDataFrame([], "node long, label long")
    whole, cut = ({tuple(r) for r in common.across(members, labels, sig, lines.alike_lines(0.8)[1], rows).collect()} for rows in (2048, 40))
    assert whole == cut == {(a, b) for a, x in tokens.items() for b, y in tokens.items() if a < b and lines.alike_all([x], [y], 0.8)[0]}


def test_rows_of_fields_join_by_their_text_alone(spark):
    texts = ["12 45 7\n2024-01-01 3.4 5.6\n13 45 8\nhttps://a.b/1\nPage 3", "1 2 3\n2024-01-02 3.5 5.6\n4 5 6 7 8\n4 5 6 7 9\nhttps://a.b/2\nPage 4", "12 45 7\n2024-01-03 1 1 x\nhttps://a.b/1\nthe pump 3 was on at 7", "the pump 4 was on at 8"]
    assert op3(spark, texts) == [*texts[:2], "2024-01-03 1 1 x\nthe pump 3 was on at 7", ""]


def test_a_long_text_of_repeated_lines_takes_linear_time(spark):
    import time

    body = "\n".join(f"the line number x{'abcdefgh'[i % 8]} of the same old text" for i in range(120_000))
    began = time.time()
    got = op3(spark, [body, "alone\n" + body, ""])
    assert time.time() - began < 120
    assert got == ["the line number xa of the same old text", "alone", ""]


def test_flags_by_gaps(spark):
    rows = [("a\nb\nc\nd", [0]), ("a\nb\nc\nd", [1, 3]), ("a", [0]), ("\n\n", [1]), ("a\nb\nc\nd", [0, 1, 2, 3])]
    out = spark.createDataFrame(rows, "text string, gone array<int>").select(lines.without("text", "gone").alias("t")).collect()
    assert [r["t"] for r in out] == ["\n".join(x for i, x in enumerate(t.split("\n")) if i not in g) for t, g in rows]


def test_clashing_columns(spark):
    rows = [(i, f"one two three four five\nown{i} a b c d", "en", "a", 4, "x", "y", "z") for i in range(4)]
    docs = frame(spark, rows).withColumnRenamed("bucket", "lines_dropped").withColumnRenamed("h", "_key").withColumnRenamed("size", "_GONE")
    out = lines.drop_repeated(docs)
    assert out.columns[:-1] == docs.columns and sorted(r[-1] for r in out.collect()) == [0, 2, 2, 2]
    kept = lines.dedup_documents(docs)
    assert kept.columns == docs.columns and {r["lines_dropped"] for r in kept.collect()} == {"x"}


def test_join_hot_keeps_every_row(spark):
    from pyspark.sql import functions as F

    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).cast("long").alias("k"), "id")
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    for keys in (2, 64, 100_000):
        out = common.join_hot(rows, table, "k", keys)
        assert out.columns == ["k", "id", "n"] and out.count() == 5000 and out.select("id").distinct().count() == 5000


def test_small_blocks_go_in_bundles_and_lose_no_link(spark):
    """3,000 blocks of three lines and one of 300: few groups, the links of brute force; labels under these links are whole."""
    rng = random.Random(8)
    texts, members = {}, []
    for block in range(3000):
        base = [rng.randint(0, 60_000) for _ in range(10)]
        for k in range(3):
            line = [*base[:9], base[9] + 1 + k] if k < 2 else [rng.randint(0, 60_000) for _ in range(10)]
            texts[3 * block + k] = np.array(line, "<u2").tobytes()
            members.append((block, 3 * block + k))
    for node in range(9000, 9300):
        texts[node] = np.array([rng.randint(0, 1) for _ in range(10)], "<u2").tobytes()
        members.append((3000, node))
    rows = spark.createDataFrame(members, "block long, node long")
    sig = spark.createDataFrame(list(texts.items()), "node long, sig binary")
    labels = spark.createDataFrame([(0, 0)], "node long, label long")
    alike, cross = lines.alike_lines(0.8)
    links = common.across(rows, labels, sig, cross, 128)
    assert {(r["a"], r["b"]) for r in links.where("a < 9000").collect()} == {(3 * b, 3 * b + 1) for b in range(3000)}
    own = list(range(9000, 9300))
    want = {(a, b) for i, a in enumerate(own) for b in own[i + 1 :] if alike([texts[a]], [texts[b]])[0]}
    assert {(r["a"], r["b"]) for r in links.where("a >= 9000").collect()} == want
    blocks = common.materialize(rows.groupBy("block").count().selectExpr("block", "count AS n", "cast(ceil(count / 128) AS int) AS pieces"), "test-blocks")
    bundled = common.in_bundles(rows.join(blocks, "block"), blocks, 128)
    assert bundled.select("bundle").distinct().count() <= 73
    assert bundled.where("block = 3000").select("bundle").distinct().count() == 1
    assert bundled.groupBy("bundle").count().where("bundle <> 3000").agg({"count": "max"}).first()[0] < 3 * 128
    linked = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5), (9, 9)], "node long, label long")
    more = spark.createDataFrame([(5, 7), (1, 7), (10, 11)], "a long, b long")
    assert {tuple(r) for r in common.joined_labels(linked, more, "test").collect()} == {(1, 1), (2, 1), (5, 1), (6, 1), (7, 1), (9, 9), (10, 10), (11, 10)}
