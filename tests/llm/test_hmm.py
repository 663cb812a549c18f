import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from aeropanel.llm import hmm

from .fixtures import documents, frame


def some_model(k=3, s=5, seed=0):
    rng = np.random.default_rng(seed)
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    return hmm.HMM(norm(rng.random(k)), norm(rng.random((k, k))), norm(rng.random((k, s))))


def paths(model, seq):
    for path in itertools.product(range(len(model.start)), repeat=len(seq)):
        p = model.start[path[0]] * model.emit[path[0], seq[0]]
        for a, b, x in zip(path, path[1:], seq[1:]):
            p *= model.move[a, b] * model.emit[b, x]
        yield path, p


@pytest.mark.parametrize("span", [1, 2, 3, 1024])
def test_forward_and_counts_are_sums_over_all_paths(span):
    model, rng = some_model(), random.Random(2)
    seqs = [np.array([rng.randrange(5) for _ in range(n)]) for n in (1, 4, 2, 6, 3)]
    logs = hmm.likelihoods(model, seqs)
    starts, moves, emitted = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5))
    for seq, log in zip(seqs, logs):
        total = sum(p for _, p in paths(model, seq))
        assert log == pytest.approx(math.log10(total))
        for path, p in paths(model, seq):
            starts[path[0]] += p / total
            for t, (z, x) in enumerate(zip(path, seq)):
                emitted[z, x] += p / total
                if t:
                    moves[path[t - 1], z] += p / total
    got = hmm.expected_counts(model, seqs, span, 0)
    assert np.allclose(got[0], starts, atol=1e-4) and np.allclose(got[1], moves, atol=1e-4) and np.allclose(got[2], emitted, atol=1e-4)
    assert got[3] == pytest.approx(logs.sum(), rel=1e-5)


def test_long_and_short_sequences_together():
    model, rng = some_model(4, 30, 5), np.random.default_rng(1)
    seqs = [rng.integers(0, 30, n) for n in (5000, 1, 2500, 40, 40, 3)]
    whole, cut = hmm.expected_counts(model, seqs), hmm.expected_counts(model, seqs, 700, 0)
    each = [hmm.expected_counts(model, [s]) for s in seqs]
    for i in range(3):
        assert np.allclose(whole[i], cut[i], rtol=1e-3) and np.allclose(whole[i], sum(x[i] for x in each), rtol=1e-3)
    assert whole[3] == pytest.approx(cut[3]) == pytest.approx(float(hmm.likelihoods(model, seqs).sum()), rel=1e-5)
    assert whole[1].sum() == pytest.approx(sum(len(s) - 1 for s in seqs), rel=1e-4)
    groups = list(hmm._groups(seqs, 50))
    assert sorted(i for g in groups for i in g) == list(range(6)) and groups[0] == [0, 2]


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), "\n"]


def corpus(n=150):
    rng = random.Random(3)
    kinds = [["the", "and", "of", "in"], ["le", "et", "de", "un"]]
    return [(i, " ".join(rng.choice(kinds[i % 2]) if rng.random() < 0.7 else f"w{i % 2}{rng.randrange(400)}" for _ in range(rng.randint(0, 80))), "en", "a", 1, "x", "y", "z") for i in range(n)]


def test_base_counts_and_gain(spark):
    rows = corpus() + documents(20)
    got = hmm.op1(frame(spark, rows), states=4).collect()
    assert len(got) == len(rows)
    c = Counter(t for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 != 1 for t in tokens(r[1]))
    n, v = sum(c.values()), len(c)
    want = sorted((str(r[0]), len(t), sum(c[x] > 0 for x in t), round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t), 5)) for r in rows for t in [tokens(r[1])])
    assert want == sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 5)) for r in got)
    assert {r["train_tokens"] for r in got} == {n}
    held = [r for r in got if r["held_out"] and r["doc_id"] < 150]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1 for r in held)
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 0.1 * sum(r["n_tokens"] for r in held)
    assert all(r["score"] <= 1e-9 and math.isfinite(r["score"]) for r in got)


def test_classes_sum_to_one(spark):
    docs = frame(spark, corpus(40))
    counts = hmm.count_tokens(docs)
    vocab = hmm.vocabulary(counts, known=1 << 20, own=50)
    c = {r["word"]: r["n"] for r in counts.collect()}
    assert vocab.total == sum(c.values()) and vocab.distinct == len(c) and vocab.words[0] == hmm.END
    own = set(vocab.words[: vocab.symbols])
    shares = np.zeros(hmm.CLASSES)
    for w, n in c.items():
        if w not in own:
            k = hmm.class_of(w)
            shares[k] += (n + 0.5) / (vocab.class_n[k] + 0.5 * (vocab.class_v[k] + 1))
    spare = 0.5 / (vocab.class_n + 0.5 * (vocab.class_v + 1))
    assert np.allclose(shares + spare, 1)
    model = hmm.train(docs, vocab, states=3, rounds=2)
    assert np.allclose(model.emit.sum(axis=1), 1) and np.allclose(model.move.sum(axis=1), 1) and model.start.sum() == pytest.approx(1)


def test_training_raises_the_likelihood(spark):
    docs = frame(spark, corpus(80))
    vocab = hmm.vocabulary(hmm.count_tokens(docs))
    model = hmm.train(docs, vocab, states=4, rounds=5, prior=0.01)
    assert len(model.history) == 5 and all(b > a for a, b in zip(model.history, model.history[1:]))


def test_nothing_to_learn_from(spark):
    assert hmm.op1(frame(spark, [])).collect() == []
    got = hmm.op1(frame(spark, [(None, "a b", None, None, None, None, None, None)])).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got] == [(3, 0, 0, 0.0)]


def test_likelihoods_in_spans_are_the_same_and_need_little_memory():
    import tracemalloc

    rng = np.random.default_rng(1)
    model = hmm.HMM(rng.dirichlet(np.ones(12)), rng.dirichlet(np.ones(12), 12), rng.dirichlet(np.ones(500), 12))
    some = [rng.integers(0, 500, n) for n in (3, 700, 1, 50, 700, 1200)]
    whole = hmm.likelihoods(model, some, 1 << 40)
    assert all(np.allclose(hmm.likelihoods(model, some, most), whole) for most in (1, 7, 1000))
    long = [rng.integers(0, 500, 200_000) for _ in range(5)]
    tracemalloc.start()
    hmm.likelihoods(model, long)
    assert tracemalloc.get_traced_memory()[1] < 120e6  # 96 MB of emissions alone if all were looked up at once
    tracemalloc.stop()
