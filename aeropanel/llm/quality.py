"""Quality classifier: a byte-level convolutional network in numpy over overlapping chunks of the whole document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import unused

WIDTH, BLOCK, BLOCKS = 6, 32, 8  # a filter's bytes; positions of a block; a chunk is 8 blocks and shares one with the next
STEP = BLOCK * (BLOCKS - 1)


def chunk_count(n: int) -> int:
    """Chunks of BLOCK * BLOCKS positions, STEP apart, that cover ``n`` positions (one for none)."""
    return max(1, -(-(n - BLOCK) // STEP))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class ByteCNN:
    """filters [WIDTH, 256, F]: what a byte at a place adds to each filter; hidden units read a chunk's maxima; a
    document's units are their mean, maximum and minimum over its chunks; these give one logit."""

    filters: np.ndarray
    bias: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @classmethod
    def new(cls, n_filters: int = 16, n_hidden: int = 12, seed: int = 1) -> ByteCNN:
        rng = np.random.default_rng(seed)
        f32 = lambda x: np.asarray(x, np.float32)
        return cls(f32(rng.normal(0, 0.3, (WIDTH, 256, n_filters))), f32(np.zeros(n_filters)), f32(rng.normal(0, 0.3, (n_filters, n_hidden))), f32(np.full(n_hidden, 0.1)), f32(rng.normal(0, 0.1, 3 * n_hidden)), f32(np.zeros(1)))

    def parts(self) -> list[np.ndarray]:
        return [self.filters, self.bias, self.w1, self.b1, self.w2, self.b2]

    def head(self, pooled: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        """Probabilities of the documents whose chunks are pooled[bounds[i]:bounds[i + 1]], and what training needs."""
        v = np.maximum(pooled + self.bias, 0)
        u = np.maximum(v @ self.w1 + self.b1, 0)
        mean = np.add.reduceat(u, bounds[:-1]) / np.diff(bounds)[:, None]
        doc = np.concatenate((mean, np.maximum.reduceat(u, bounds[:-1]), np.minimum.reduceat(u, bounds[:-1])), axis=1)
        return _sigmoid(doc @ self.w2 + self.b2[0]), doc, u, v

    def tables(self) -> np.ndarray:
        """Filters of pairs of bytes, [WIDTH / 2, 65536, F]: half the lookups."""
        return np.stack([(self.filters[i][:, None] + self.filters[i + 1][None]).reshape(65536, -1) for i in range(0, WIDTH, 2)])

    def pool(self, raw: bytes, tables: np.ndarray, rows: int = 1 << 15) -> np.ndarray:
        """The filters' maxima over each chunk, in bounded memory; zeros follow the last byte."""
        n = max(1, len(raw))
        data = np.frombuffer(raw + bytes(n + WIDTH - len(raw)), np.uint8).astype(np.int32)
        pairs = data[:-1] * 256 + data[1:]
        blocks = []
        for at in range(0, n, rows):
            end = min(at + rows, n)
            x = tables[0][pairs[at:end]]
            for i in range(1, WIDTH // 2):
                x += tables[i][pairs[at + 2 * i : end + 2 * i]]
            blocks.append(np.maximum.reduceat(x, np.arange(0, end - at, BLOCK)))
        blocks = np.concatenate(blocks)
        k = chunk_count(n)
        wanted = np.minimum(np.arange(k)[:, None] * (BLOCKS - 1) + np.arange(BLOCKS), len(blocks) - 1)
        return blocks[wanted].max(axis=1)

    def predict(self, texts: list[bytes], tables: np.ndarray) -> np.ndarray:
        """Scores of whole texts."""
        pooled = [self.pool(t, tables) for t in texts]
        bounds = np.concatenate(([0], np.cumsum([len(p) for p in pooled])))
        return self.head(np.concatenate(pooled), bounds)[0] if texts else np.zeros(0)


def _windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All chunks' bytes [chunks, BLOCK * BLOCKS + WIDTH - 1] and the documents' bounds; a short chunk repeats its document's last positions."""
    rows, counts = [], []
    span = BLOCK * BLOCKS
    for t in texts:
        n = max(1, len(t))
        data = np.frombuffer(t + bytes(n + WIDTH - len(t)), np.uint8)
        starts = np.minimum(np.arange(chunk_count(n)) * STEP, max(0, n - span))
        places = np.minimum(starts[:, None] + np.arange(span + WIDTH - 1), n + WIDTH - 2)
        rows.append(data[places])
        counts.append(len(starts))
    return np.concatenate(rows), np.concatenate(([0], np.cumsum(counts)))


def _gradients(model: ByteCNN, chunks: np.ndarray, bounds: np.ndarray, labels: np.ndarray, weights: np.ndarray, rows: int = 2048) -> list[np.ndarray]:
    span, n_filters = BLOCK * BLOCKS, model.filters.shape[2]
    best, pooled = np.empty((len(chunks), n_filters), np.int64), np.empty((len(chunks), n_filters), model.filters.dtype)
    for at in range(0, len(chunks), rows):  # a long text's chunks, some at a time
        part = chunks[at : at + rows]
        x = model.filters[0][part[:, :span]]
        for i in range(1, WIDTH):
            x += model.filters[i][part[:, i : span + i]]
        best[at : at + rows] = x.argmax(axis=1)
        pooled[at : at + rows] = np.take_along_axis(x, best[at : at + rows, None], 1)[:, 0]
    p, doc, u, v = model.head(pooled, bounds)
    h, size = u.shape[1], np.diff(bounds)
    g = ((p - labels) * weights / weights.sum()).astype(np.float32)
    g_doc = g[:, None] * model.w2
    g_u = np.repeat(g_doc[:, :h] / size[:, None], size, axis=0)
    for part, top in ((g_doc[:, h : 2 * h], doc[:, h : 2 * h]), (g_doc[:, 2 * h :], doc[:, 2 * h :])):
        at = u == np.repeat(top, size, axis=0)
        g_u += at * np.repeat(part / np.maximum(1, np.add.reduceat(at, bounds[:-1], dtype=np.float32)), size, axis=0)
    g_u *= u > 0
    g_v = (g_u @ model.w1.T) * (v > 0)
    g_filters = np.zeros_like(model.filters)
    column = np.arange(n_filters)
    for i in range(WIDTH):
        byte = np.take_along_axis(chunks, best + i, 1).astype(np.int64)
        g_filters[i] = np.bincount((byte * n_filters + column).ravel(), g_v.ravel(), 256 * n_filters).reshape(256, n_filters)
    return [g_filters, g_v.sum(axis=0), v.T @ g_u, g_u.sum(axis=0), doc.T @ g, np.array([g.sum()], np.float32)]


def _slice(text: bytes, rng: np.random.Generator) -> bytes:
    n = int(rng.integers(16, 257))
    at = int(rng.integers(0, max(1, len(text) - n)))
    return text[at : at + n]


def fit(texts: list[bytes], labels: np.ndarray, weights: np.ndarray, epochs: int = 8, least_steps: int = 300, batch: int = 32, rate: float = 0.01, sliced: float = 0.25, seed: int = 1) -> ByteCNN:
    """Weighted logistic loss, Adam, a falling rate, more epochs where few texts give few steps; the given order and seed make it repeatable.

    In a share ``sliced`` of the visits a text, of either label, gives way to a slice of it, so that length tells little.
    """
    model, rng = ByteCNN.new(seed=seed), np.random.default_rng(seed)
    share = float((labels * weights).sum() / weights.sum()) if len(labels) else 0.5
    model.b2[0] = np.log(max(share, 1e-3) / max(1 - share, 1e-3))
    if len(set(labels.tolist())) < 2:
        model.w2[:] = 0
        return model
    first = [np.zeros_like(x) for x in model.parts()]
    second = [np.zeros_like(x) for x in model.parts()]
    epochs = max(epochs, -(-least_steps // -(-len(texts) // batch)))
    step, steps = 0, epochs * -(-len(texts) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            chunks, bounds = _windows([_slice(texts[i], rng) if rng.random() < sliced else texts[i] for i in own])
            step += 1
            now = rate * (1 - 0.95 * step / steps)
            for x, g, m, s in zip(model.parts(), _gradients(model, chunks, bounds, labels[own], weights[own]), first, second, strict=True):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                x -= now * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)
    return model


def train(docs: DataFrame, labels: DataFrame, rows_per_label: int = 1200) -> ByteCNN:
    """Fit on a bounded sample: at most ``rows_per_label`` whole documents of each label, of any length, those of the lowest hashes (a 16th of them in each of 16 parts).

    ``docs(doc_id, text)``, ``labels(doc_id, quality)`` with quality 0 or 1; other qualities, doc_ids with both and null
    texts are not learned from; of several texts of one doc_id the one of the lowest hash is. Labels weigh as often as
    they occur among all labelled rows.
    """
    known = labels.where("quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"), F.max("quality").alias("other")).where("quality = other").drop("other")
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    parts = 16
    by = Window.partitionBy("quality", "part").orderBy("h", "doc_id")
    there = known.join(texts.select("doc_id"), "doc_id", "left_semi").withColumn("h", F.xxhash64("doc_id", F.lit(5))).withColumn("part", F.pmod("h", F.lit(parts)))
    sample = there.withColumn("n", F.row_number().over(by)).where(F.col("n") <= max(1, rows_per_label // parts)).select("doc_id", "quality", "h")
    found = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality", "h").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("t"))
    rows = found.select("doc_id", "quality", "h", "t.text").collect()  # 2 * rows_per_label rows at most
    rows.sort(key=lambda r: (r["h"], r["doc_id"]))
    y = np.array([r["quality"] for r in rows], np.float32)
    weights = np.array([counts[r["quality"]] / max(1, int((y == r["quality"]).sum())) for r in rows], np.float32)
    return fit([r["text"].encode() for r in rows], y, weights)


def classify(docs: DataFrame, model: ByteCNN) -> DataFrame:
    """All columns of ``docs`` and, last, score, from the whole text alone (null: empty); where ``docs`` has a score, it stays and ours is ``_score`` (or with as many underscores as set it apart)."""
    score = "score" if "score" not in map(str.lower, docs.columns) else unused(docs, "score")[0]
    raw = unused(docs, "raw")[0]
    schema = StructType([*docs.schema.fields, StructField(score, DoubleType())])
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables()
        for batch in batches:
            texts, scores = batch.column(len(names)), []
            for at in range(0, len(texts), 256):
                scores.append(model.predict([t.as_buffer().to_pybytes() if t.is_valid else b"" for t in texts.slice(at, 256)], tables))
            found = pa.array((np.concatenate(scores) if scores else np.zeros(0)).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], found], [*names, score])

    plain = [f"c{i}" for i in range(len(names) + 1)]  # whatever is in a name, dots too
    return docs.withColumn(raw, F.col("text").cast("string")).toDF(*plain).mapInArrow(run, schema)


def fold(parts: int):
    """crc32(doc_id as text) modulo ``parts``; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


def learned(docs: DataFrame, labels: DataFrame, **settings) -> ByteCNN:
    """Trained on the labels of the rows whose fold of 3 is not 1."""
    return train(docs.select("doc_id", "text"), labels.where(fold(3) != 1), **settings)


def good_documents(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with all their columns."""
    found = classify(docs, learned(docs, labels))
    return found.where(F.col(f"`{found.columns[-1]}`") >= least).select(*[F.col(f"`{c}`") for c in docs.columns])


def op2(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns.

    Null and empty texts are scored as a chunk of zero bytes; a null doc_id is never learned from nor held out;
    repeated rows are scored each; a very long text is read whole, some positions at a time; no rows give no rows; without labels of both kinds all get the share of label 1, or 0.5.
    """
    out = classify(docs.select("doc_id", "text"), learned(docs, labels))
    return out.select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
