"""Language ID with language-bitmask n-gram filters: one Bloom filter whose cells hold a bit for each language."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

HASHES = 3
CELLS_A_GRAM = 16  # of the language with most, up to MOST_CELLS
MOST_CELLS = 1 << 24  # 128 MB a word of 64 languages in every task
RARE = 1 << 22  # a trigram is kept from one in so many of its language's on: so many trigrams a language at most, at any size of the input
FULL = 0.9  # a language's share of set cells beyond which its hits tell too little
_CHARS = 2_000_000  # handled at a time


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x20000)])


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, a space before, between and after, other than letters as spaces; and the place where each text starts, and the end."""
    texts = [t.lower() for t in texts]
    points = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    known = _letters()
    letter = known[np.minimum(points, len(known) - 1)]
    if (odd := points >= len(known)).any():
        letter = letter.copy()
        letter[odd] = [chr(i).isalpha() for i in points[odd].tolist()]
    starts = np.cumsum([1] + [len(t) + 1 for t in texts])
    return np.where(letter, points, np.uint32(32)).astype(np.int64), starts


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, bounds): all trigrams with a letter in the middle, a space standing for a word's edge; text i's are keys[bounds[i]:bounds[i + 1]]."""
    points, starts = _points(texts)
    middle = np.flatnonzero(points[1:-1] != 32) + 1
    keys = points[middle - 1] | points[middle] << 21 | points[middle + 1] << 42
    return keys, np.searchsorted(middle, starts)


def cells_of(keys: np.ndarray, cells: int) -> list[np.ndarray]:
    """HASHES cells of each key, by multiplications of the same mixed value."""
    x = keys.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    shift = np.uint64(64 - int(cells).bit_length() + 1)
    return [((x * np.uint64(m)) >> shift).astype(np.int64) for m in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD)[:HASHES]]


def slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about _CHARS code points."""
    at, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t) + 1
        if n >= _CHARS:
            yield at, i + 1
            at, n = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


@dataclass(frozen=True)
class LanguageFilter:
    """languages: bit order; cell/mask: the cells that are not 0; words: 64-bit words a mask has."""

    languages: list[str]
    cells: int
    cell: np.ndarray
    mask: np.ndarray

    def table(self) -> np.ndarray:
        out = np.zeros((self.mask.shape[1], self.cells), np.uint64)
        out[:, self.cell] = self.mask.T
        return out

    def predict(self, texts: list[str], table: np.ndarray) -> tuple[list[str], np.ndarray]:
        """For each text the language of the most hits, corrected for false positives, and its share of all languages' hits."""
        keys, bounds = trigrams(texts)
        at = cells_of(keys, self.cells)
        hits = np.zeros((len(self.languages), len(texts)))
        n = np.diff(bounds).astype(float)
        for word, masks in enumerate(table):
            found = masks[at[0]]
            for more in at[1:]:
                found &= masks[more]
            for bit in range(min(64, len(self.languages) - 64 * word)):
                sums = np.concatenate(([0], np.cumsum((found >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)))
                wrong = float(((masks >> np.uint64(bit)) & np.uint64(1)).mean()) ** HASHES
                hits[64 * word + bit] = np.clip((sums[bounds[1:]] - sums[bounds[:-1]] - n * wrong) / max(1e-9, 1 - wrong), 0, None)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        best = hits.argmax(axis=0)
        score = hits.max(axis=0) / np.maximum(hits.sum(axis=0), 1e-9)
        known = n > 0
        return [self.languages[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)], np.where(known, score, 0.0)


def cells_for(grams: int, least: int = 1 << 20, most: int = MOST_CELLS) -> int:
    """CELLS_A_GRAM cells for each of ``grams`` trigrams, as a power of two from ``least`` to ``most``; an error where more than FULL of them would be set."""
    cells = max(least, min(most, 1 << max(0, CELLS_A_GRAM * grams - 1).bit_length()))
    if (fill := 1 - math.exp(-HASHES * grams / cells)) > FULL:
        raise ValueError(f"{grams} trigrams of one language would set {fill:.3f} of {cells} cells, more than {FULL}")
    return cells


def learn(docs: DataFrame, cells: int = 1 << 20, share: float = 0.5, rare: int = RARE) -> LanguageFilter:
    """From all rows of ``docs`` that have text and lang.

    Trigrams are counted by language over whole texts; a language's filter gets those whose frequency there is at least
    1/``rare``, and ``share`` of the highest in any language. So a language has ``rare`` trigrams at most, however much
    noise the input holds, and the filter stays under FULL: it grows from ``cells`` with the trigrams of the language
    that has most (``cells_for``). Only cells that are set reach the driver. A very long text is read whole by one task.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            return keys, np.bincount(where, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in kept.items():
                keys, n = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys), pa.array(n)], ["lang", "gram", "n"])
            kept.clear()

        for batch in batches:
            by: dict[str, list[str]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                for a, b in slices(texts):
                    keys, n = np.unique(trigrams(texts[a:b])[0], return_counts=True)
                    own = kept.setdefault(lang, [])
                    own.append((keys, n))
                    if len(own) > 16:
                        kept[lang] = [merged(own)]
            if sum(len(k) for own in kept.values() for k, _ in own) > 4_000_000:
                yield from out()
        yield from out()

    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    counts = materialize(rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # a row a language
    languages = sorted(totals, key=lambda k: (-totals[k], k))
    if not languages:
        return LanguageFilter([], cells, np.zeros(0, np.int64), np.zeros((0, 1), np.uint64))
    rank = {k: i for i, k in enumerate(languages)}
    weights = docs.sparkSession.createDataFrame([(k, i, float(totals[k])) for k, i in rank.items()], "lang string, bit int, total double")
    often = counts.join(F.broadcast(weights), "lang").withColumn("f", F.col("n") / F.col("total")).where(F.col("n") * rare >= F.col("total"))
    top = often.groupBy("gram").agg(F.max("f").alias("top"), F.collect_list(F.struct("bit", "f")).alias("by"))
    chosen = top.select("gram", F.transform(F.filter("by", lambda x: x["f"] >= share * F.col("top")), lambda x: x["bit"]).alias("bits"))
    chosen = materialize(chosen, "chosen")
    cells = cells_for(chosen.select(F.explode("bits").alias("bit")).groupBy("bit").count().agg(F.max("count")).first()[0] or 0, cells)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = cells_of(batch.column(0).to_numpy(), cells)
            bits = batch.column(1)
            flat, lengths = bits.flatten().to_numpy(), np.diff(bits.offsets.to_numpy())
            cell = np.concatenate([np.repeat(c, lengths) for c in at])
            bit = np.tile(flat, len(at))
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array((bit // 64).astype(np.int32)), pa.array((np.uint64(1) << (bit % 64).astype(np.uint64)).view(np.int64))], ["cell", "word", "mask"])

    found = chosen.mapInArrow(spread, "cell long, word int, mask long").groupBy("cell", "word").agg(F.bit_or("mask").alias("mask")).toArrow()
    cell, where = np.unique(found.column("cell").to_numpy(), return_inverse=True)
    mask = np.zeros((len(cell), -(-len(languages) // 64)), np.uint64)
    mask[where, found.column("word").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    return LanguageFilter(languages, cells, cell, mask)


def identify(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """(doc_id, lang_pred, score) of every row from its text alone; ``und`` and 0 where it is null or has no letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch in batches:
            texts, langs, scores = [t or "" for t in batch.column(1).to_pylist()], [], []
            for a, b in slices(texts):
                lang, score = model.predict(texts[a:b], table)
                langs += lang
                scores.append(score)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def fold(doc_id: str, parts: int):
    """crc32(doc_id as text) modulo ``parts``; a null doc_id has none."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts


def op7(docs: DataFrame) -> DataFrame:
    """Learns from rows whose fold of 5 is not 0 and identifies all; a null doc_id is neither learned from nor held out.

    Null langs are not learned from; repeated rows count each time; no rows give no rows, no languages ``und``.
    """
    model = learn(docs.where(fold("doc_id", 5) != 0))
    out = identify(docs, model)
    return out.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
