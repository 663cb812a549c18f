"""Conversation trie: whole results against brute force, forced blocks, hard rows, the SQL."""

import hashlib
import os
import random
import zlib

import duckdb
import pytest

from aeropanel.llm import trie

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, n int, `meta.len` string, level long"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def brute(rows):
    convs = {}
    for c, turn, role, text in (r[:4] for r in rows):
        if c is not None:
            role, text = role or "", text or ""
            convs.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    original = {c: [t[3:] for t in sorted(v)] for c, v in convs.items()}
    rebuilt = {}
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = original.get(c - c % 100, [])[:h] + own[h:]
    nodes = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids, leaves, saved = {p: 0 for p in nodes}, {p: 0 for p in nodes}, {p: 0 for p in nodes}
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(members) - 1) * (len(p[-1][1]) if p else 0)
    ends = {p: ",".join(map(str, sorted(c for c in m if len(rebuilt[c]) == len(p)))) for p, m in nodes.items()}
    return sorted(((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], sha(ends[p])) for p, m in nodes.items()), key=str)


def fixture(seed=1, n=60):
    rng = random.Random(seed)
    rows = []
    for c in [*range(95, 95 + n), 300, 301, 302, 405, 406, 10_007]:
        for turn in range(rng.randint(1, 8)):
            rows.append((c, rng.choice([turn, turn, turn, None]), rng.choice(["user", "assistant", None]), rng.choice(["hé", "yes", "", None, "a\nb" * 9]), 1, "x", 2))
    rows += [(c, t, "user", f"same {t}", 1, "x", 2) for c in range(500, 560) for t in range(4)]  # copies
    rows += [(c, t, "user", "one and the same", 1, "x", 2) for c in range(600, 604) for t in (1, 1, 1, 2)]  # ties and repeated rows
    rows += [(700, t, "user", f"long {t % 3}", 1, "x", 2) for t in range(300)] + [(701, t, "user", "x" * 50_000 if t == 5 else f"long {t % 3}", 1, "x", 2) for t in range(300)]
    rows += [(None, 0, "user", "nobody's", None, None, None), (None, None, None, None, None, None, None), (-5, 0, "user", "negative", 1, "x", 2)]
    rng.shuffle(rows)
    return rows


def run(spark, rows):
    return sorted((tuple(r) for r in trie.op13(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)


@pytest.fixture
def many_blocks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_series_over_many_blocks(spark, many_blocks):
    rows = negative(fixture(3, n=10))
    assert run(spark, rows) == brute(rows)


def negative(rows):  # Python's % differs below 0: -5 % 100 is 95 there
    return [r for r in rows if r[0] is None or r[0] >= 0]


@pytest.mark.parametrize("seed", [1, 2])
def test_whole_result(spark, seed):
    rows = negative(fixture(seed))
    assert run(spark, rows) == brute(rows)


def test_negative_ids_share_the_start_of_their_hundred_towards_zero(spark):
    rows = [(-5, t, "user", f"n{t}", 1, "x", 2) for t in range(7)] + [(0, t, "user", f"z{t}", 1, "x", 2) for t in range(7)]
    h = zlib.crc32(b"-5") % 6
    depths = [r[1] for r in run(spark, rows) if r[0] == -5 and r[3] == 2]
    assert depths == list(range(0, h + 1)) and h > 0


def test_few_rows(spark):
    assert run(spark, []) == [] and run(spark, [(None, 1, "a", "b", 1, "x", 1)]) == []
    one = [(150, 0, "user", "hi", 1, "x", 1)]
    assert run(spark, one) == brute(one)
    absent = [(c, t, "user", "hi", 1, "x", 1) for c in range(101, 140) for t in range(2)]  # nobody is 100: some end at the root
    assert run(spark, absent) == brute(absent)


def test_caterpillar_has_many_blocks_and_levels(spark):
    """Every prefix of a long conversation ends one; a binary tree of choices makes light edges."""
    rows = [(c * 100, t, "user", "same", 1, "x", 1) for c in range(40) for t in range(c)]
    rows += [(4000 + c * 100, t, "user", str(c >> t & 1), 1, "x", 1) for c in range(64) for t in range(6)]
    assert run(spark, rows) == brute(rows)


def test_pieces_of_ends(spark):
    ends = spark.range(1000).selectExpr("7L AS conv_id", "2L AS depth", "id * 3 AS c").repartition(5)
    got = trie.end_digests(ends, ids=64).collect()
    assert [tuple(r) for r in got] == [(7, 2, sha(",".join(str(i * 3) for i in range(1000))))]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_given_conversations_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = con.sql(trie.ORACLE)
    got = trie.op13(spark.read.parquet(f"{SF}/conversations.parquet"))
    assert got.columns == want.columns
    rows = sorted((tuple(r) for r in got.collect()), key=str)
    assert rows == sorted(want.fetchall(), key=str)
    assert rows == brute(con.sql("SELECT conv_id, turn, role, text FROM conversations").fetchall())
