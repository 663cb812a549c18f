import random
import zlib

import numpy as np
import pytest

from aeropanel.llm import quality
from aeropanel.llm.quality import ByteCNN

from .fixtures import documents, frame


def slow_pool(model, raw):
    """Maxima over chunks, position by position."""
    n = max(1, len(raw))
    data = raw + bytes(n + quality.WIDTH - len(raw))
    conv = np.array([sum(model.filters[w][data[i + w]] for w in range(quality.WIDTH)) for i in range(n)])
    span = quality.BLOCK * quality.BLOCKS
    out = []
    for c in range(quality.chunk_count(n)):
        out.append(conv[c * quality.STEP : min(c * quality.STEP + span, n)].max(axis=0))
    return np.array(out)


@pytest.mark.parametrize("n", [0, 1, 31, 33, 255, 256, 257, 288, 480, 481, 5000])
def test_pool_covers_the_whole_text(n):
    model, raw = ByteCNN.new(4, 3), random.Random(n).randbytes(n)
    assert np.allclose(model.pool(raw, model.tables(), rows=320), slow_pool(model, raw), atol=1e-5)


def test_gradients_are_slopes():
    rng = random.Random(1)
    texts = [rng.randbytes(rng.randint(1, 600)) for _ in range(5)]
    model = ByteCNN.new(4, 3, seed=3)
    for x in ("filters", "bias", "w1", "b1", "w2", "b2"):
        setattr(model, x, getattr(model, x).astype(np.float64))
    y, w = np.array([0, 1, 1, 0, 1.0]), np.array([1, 2, 1, 1, 0.5])
    chunks, bounds = quality._windows(texts)

    def loss():
        x = sum(model.filters[i][chunks[:, i : i + 256]] for i in range(quality.WIDTH))
        p = model.head(x.max(axis=1), bounds)[0]
        return float(-(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / w.sum())

    got = quality._gradients(model, chunks, bounds, y, w)
    for part, g in zip(model.parts(), got):
        flat, slopes = part.reshape(-1), np.asarray(g).reshape(-1)
        for i in sorted(np.argsort(-np.abs(slopes))[:6].tolist()):
            was = flat[i]
            flat[i] = was + 1e-5
            up = loss()
            flat[i] = was - 1e-5
            down = loss()
            flat[i] = was
            assert slopes[i] == pytest.approx((up - down) / 2e-5, rel=0.02, abs=1e-5)


def test_gradients_of_some_chunks_at_a_time_are_those_of_all():
    rng = random.Random(2)
    model, texts = ByteCNN.new(4, 3), [rng.randbytes(n) for n in (4000, 10, 900)]
    chunks, bounds = quality._windows(texts)
    a, b = (quality._gradients(model, chunks, bounds, np.array([0, 1, 1.0], np.float32), np.ones(3, np.float32), rows) for rows in (3, 2048))
    assert all(np.allclose(x, y, atol=1e-6) for x, y in zip(a, b))


def slow_score(model, raw):
    """The score of one whole text, step by step."""
    v = np.maximum(slow_pool(model, raw) + model.bias, 0)
    u = np.maximum(v @ model.w1 + model.b1, 0)
    return 1 / (1 + np.exp(-(np.concatenate((u.mean(axis=0), u.max(axis=0), u.min(axis=0))) @ model.w2 + model.b2[0])))


def test_scores_of_documents_are_those_of_brute_force(spark):
    rows = [r for r in documents(20) if r[1] is None or len(r[1]) < 5000] + [(9000, "long text " * 900, "en", "a", 1, "x", "y", "z")]
    model = ByteCNN.new(4, 3, seed=2)
    got = quality.classify(frame(spark, rows).select("doc_id", "text"), model).collect()
    want = sorted((str(r[0]), round(float(slow_score(model, (r[1] or "").encode())), 4)) for r in rows)
    assert want == sorted((str(r["doc_id"]), round(r["score"], 4)) for r in got)


def test_clashing_columns(spark):
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(200)], "doc_id long, quality int, toxic int")
    plain = frame(spark, corpus())
    docs = plain.withColumnRenamed("bucket", "score").withColumnRenamed("h", "_text").withColumnRenamed("size", "_RAW")
    kept = quality.good_documents(docs, labels)
    assert kept.columns == docs.columns and {(r["score"], r["_text"]) for r in kept.collect()} == {("x", "y")}
    assert sorted(r[0] for r in kept.collect()) == sorted(r[0] for r in quality.good_documents(plain, labels).collect())


def test_repeated_labels_and_texts_give_one_model(spark):
    rows = corpus(60) + [(i, "another text, quite good", "en", "a", 1, "x", "y", "z") for i in range(0, 60, 7)]
    known = [(i, int(i % 3 > 0), 0) for i in range(60)] + [(3, 1, 0), (4, 1, 0), (4, 1, 0)]
    labels = spark.createDataFrame(known, "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    a, b = quality.train(docs, labels), quality.train(docs.repartition(7), labels.repartition(5))
    assert all((x == y).all() for x, y in zip(a.parts(), b.parts()))


def corpus(n=200):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(["the", "sea", "was", "cold.", "And", "we", "went", "home,"]) for _ in range(rng.randint(5, 200)))
    return [(i, good() if i % 3 else good().upper().replace(" ", "!! "), "en", "a", 1, "x", "y", "z") for i in range(n)]


def test_held_out(spark):
    rows = corpus() + [r for r in documents(10) if r[0] is None or r[0] >= 2000]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(200)] + [(None, 1, 0), (5000, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.op2(frame(spark, rows), labels).collect()
    assert len(got) == len(rows)
    own = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 200]
    held = [r for r in own if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in own)
    assert np.mean([r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    kept = quality.good_documents(frame(spark, rows), labels)
    assert kept.columns == frame(spark, []).columns and kept.count() == sum(r["predicted"] for r in got)


def test_no_labels_and_no_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.op2(frame(spark, []), labels).collect() == []
    assert {r["score"] for r in quality.op2(frame(spark, corpus(3)), labels).collect()} == {0.5}
