import os
from collections import defaultdict

import pytest

import corpus_pipeline
from aeropanel.llm import mixing, packing

from .fixtures import documents, frame
from .test_lines import brute as brute_lines
from .test_mixing import brute_targets
from .test_simhash import shingles

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path_factory.mktemp('stages')}/{name}"
        stage(spark, docs, SF).write.parquet(path)
        out.append((name, docs, spark.read.parquet(path)))
        docs = out[-1][2]
    return out


def rows_of(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_names_and_columns(stages):
    assert [name for name, *_ in stages] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "source_mixing", "packing"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns


def test_quality_keeps_good_documents_whole(spark, stages):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    _, before, after = stages[0]
    kept = {r["doc_id"] for r in after.collect()}
    good = [r["doc_id"] for r in before.collect() if labels.get(r["doc_id"]) == 1]
    bad = [r["doc_id"] for r in before.collect() if labels.get(r["doc_id"]) == 0]
    assert sum(d in kept for d in good) >= 0.95 * len(good) and sum(d in kept for d in bad) <= 0.3 * len(bad)
    assert set(rows_of(after)) <= set(rows_of(before))


def test_line_dedup_is_brute_force(stages):
    _, before, after = stages[1]
    rows = before.collect()
    want = brute_lines([(r["doc_id"], r["text"]) for r in rows], min_tokens=1)
    assert sorted((r["doc_id"], r["text"]) for r in after.collect()) == sorted((r["doc_id"], want.get((r["doc_id"], r["text"]), r["text"])) for r in rows)
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())


def test_near_dedup_keeps_one_of_alike_texts(stages):
    _, before, after = stages[2]
    sets = {r["doc_id"]: shingles(r["text"]) for r in before.collect()}
    kept = {r["doc_id"] for r in after.collect()}
    ids = sorted(sets)
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for i, a in enumerate(ids) for b in ids[i + 1 :]}
    both = [p for p, x in alike.items() if x >= 0.8 and p[0] in kept and p[1] in kept]
    assert len(both) <= 0.03 * max(1, sum(x >= 0.8 for x in alike.values()))
    lonely = {d for d in ids if all(x < 0.6 for p, x in alike.items() if d in p)}
    assert lonely <= kept and set(rows_of(after)) <= set(rows_of(before))


def test_mixing_meets_its_targets(stages):
    _, before, after = stages[3]
    size_of, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    size = {}
    for r in before.collect():
        size[r["doc_id"]] = len((r["text"] or "").encode().split())
        size_of[r["source"]] += size[r["doc_id"]]
        longest[r["source"]] = max(longest[r["source"]], size[r["doc_id"]])
    copies = defaultdict(int)
    for r in after.collect():
        taken[r["source"]] += size[r["doc_id"]]
        copies[r["doc_id"]] += 1
    for source, target in brute_targets(size_of).items():
        assert abs(taken[source] - target) <= max(3, longest[source] / 2)
    assert max(copies.values()) <= 3 and set(rows_of(after)) <= set(rows_of(before))


def test_packing_holds_every_document_of_the_mix(stages):
    _, before, after = stages[4]
    starts = defaultdict(int)
    for r in after.collect():
        starts[r["doc_id"]] += r["start"] == 0
    want = defaultdict(int)
    for r in before.collect():
        want[r["doc_id"]] += 1
    assert starts == want
    total = sum(r["length"] for r in after.collect())
    assert after.select("sequence_id").distinct().count() <= -(-total // 2048) + 1


def test_run_gives_what_the_stages_give(spark, stages):
    assert rows_of(corpus_pipeline.run(spark, SF)) == rows_of(stages[-1][2])


def test_hard_rows_and_clashing_columns(spark):
    names = {"bucket": "score", "h": "_key", "n_chars": "lines_dropped", "lang": "_size", "size": "group"}
    docs = frame(spark, documents(20))
    clash = docs
    for old, new in names.items():
        clash = clash.withColumnRenamed(old, new)
    for stage in dict(corpus_pipeline.STAGES[1:4]).values():
        plain = stage(spark, docs.drop("n_chars"), SF)
        got = stage(spark, clash.drop("lines_dropped").withColumnsRenamed({"score": "lines_dropped"}), SF)
        assert sorted((str(r["doc_id"]), str(r["text"])) for r in plain.collect()) == sorted((str(r["doc_id"]), str(r["text"])) for r in got.collect())
        assert got.columns == ["doc_id", "text", "_size", "source", "lines_dropped", "_key", "group", "meta.len"]
    kept = corpus_pipeline.good(spark, clash, SF)
    assert kept.columns == clash.columns and set(rows_of(kept)) <= set(rows_of(clash))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame(spark, []), SF).collect() == [], name


def test_stages_apply_their_operators(spark, stages):
    assert rows_of(mixing.mix(stages[3][1])) == rows_of(stages[3][2])
    assert rows_of(packing.pack(stages[4][1])) == rows_of(stages[4][2])
