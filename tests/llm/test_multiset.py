import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from aeropanel.llm import multiset
from aeropanel.llm.multiset import MultisetHash

from .fixtures import documents, frame

texts = st.lists(st.text(alphabet="aébc ", max_size=40), min_size=1, max_size=5)


@settings(max_examples=80, deadline=None)
@given(texts, texts, st.randoms())
def test_sums_of_paragraphs(a, b, rng):
    def added(parts):
        out = MultisetHash()
        for p in parts:
            out = out.add(p)
        return out

    if "\n".join(a):
        assert str(MultisetHash.of("\n".join(a))) == str(added(a))
    mixed = a + b
    rng.shuffle(mixed)
    assert str(added(mixed)) == str(added(a) + added(b))
    less = added(mixed)
    for p in b:
        less = less.remove(p)
    assert str(less) == str(added(a)) == str(MultisetHash.parse(str(added(a))))
    assert (str(added(a)) == str(added(b))) == (sorted(a) == sorted(b))


def test_likeness_follows_the_shared_part():
    rng = random.Random(4)
    line = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "rho"]) + str(rng.randrange(999)) for _ in range(12))
    a, b = [line() for _ in range(40)], [line() for _ in range(40)]
    for share in (0.25, 0.5, 0.75):
        k = int(40 * share)
        near = MultisetHash.of("\n".join(a)).likeness(MultisetHash.of("\n".join(a[:k] + b[k:])))
        assert abs(near - share) < 0.2
    assert MultisetHash.of("\n".join(a)).likeness(MultisetHash.of("\n".join(b))) < 0.25


def test_edits(spark):
    rows = documents()
    docs = frame(spark, rows)
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is None, r[0] or 0))
    got = multiset.edit_fingerprints(docs).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["n_chars"]): r for r in got}
    for i, (doc_id, text) in enumerate(order):
        if sum(1 for x in order if x[0] == doc_id) > 1 or doc_id is None:
            continue
        after = order[(i + 1) % len(order)]
        if after[0] is None:
            continue
        half = len(text) // 2
        edited = text[: len(text) - half] + after[1][:half]
        r = by[doc_id, len(text)]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == str(MultisetHash.of(text)) and r["edited_fingerprint"] == str(MultisetHash.of(edited))
        assert r["near_next"] == MultisetHash.of(text).likeness(MultisetHash.of(after[1])) and 0 <= r["near_edited"] <= 1
    one = multiset.op9(frame(spark, rows[:1])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_hot_ids_and_nulls_are_spread_in_order(spark):
    from pyspark.sql import functions as F

    rng = random.Random(7)
    ids = [5] * 300 + [None] * 200 + [rng.randrange(100) for _ in range(150)] + [-3, 2**62]
    rng.shuffle(ids)
    rows = [(d, f"text {rng.random()}\nof row {i}", "en", "a", 1, "x", "y", "z") for i, d in enumerate(ids)]
    rows += [rows[0], rows[0], (None, None, "en", "a", 1, "x", "y", "z")]
    docs = frame(spark, rows)
    dealt = multiset.with_neighbours(docs, 16)
    assert dealt.where("copy = 0").groupBy("dest").count().agg(F.max("count")).first()[0] < 130
    h = {r["t"]: r["h"] for r in docs.select(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is None, r[0] or 0, h[r[1]], r[1]))
    want = []
    for i, (doc_id, text) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        half = len(text) // 2
        want.append((str(doc_id), len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()))
    assert sorted(want) == sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in multiset.op9(docs).collect())


def test_empty(spark):
    assert multiset.op9(frame(spark, [])).collect() == []
