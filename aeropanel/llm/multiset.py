"""Document fingerprints: homomorphic multiset hashes, sums of wide vectors hashed from paragraphs."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRONG, WIDE, WINDOW, SHORT, SMALL = 8, 256, 16, 48, 4
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


def _sketch(words: np.ndarray) -> np.ndarray:
    """Mixed 64-bit values to ``WIDE`` lanes: each adds or takes 1 in one lane."""
    counts = np.bincount((words >> np.uint64(55)).astype(np.int64), minlength=2 * WIDE)
    return counts[0::2] - counts[1::2]


def _mix(words: np.ndarray) -> np.ndarray:
    words = (words ^ (words >> np.uint64(32))) * _M3
    return words ^ (words >> np.uint64(29))


class MultisetHash:
    """The sum of the vectors of a multiset of paragraphs; order never counts.

    A paragraph's vector: STRONG lanes of 64 bits, its BLAKE2b digest, summed modulo 2^64, for equality; and WIDE lanes
    modulo 2^32, where each of its WINDOW-byte windows adds or takes 1 in one lane, for likeness (SMALL-byte windows, or
    all of it, in a paragraph of under SHORT bytes). ``add`` and ``remove`` are inverse, ``+`` unites multisets, and no paragraphs are the zero vector.
    """

    __slots__ = ("strong", "wide")

    def __init__(self, strong: np.ndarray | None = None, wide: np.ndarray | None = None):
        self.strong = np.zeros(STRONG, np.uint64) if strong is None else strong
        self.wide = np.zeros(WIDE, np.uint32) if wide is None else wide

    @classmethod
    def of(cls, text: str) -> MultisetHash:
        """Of a text's paragraphs, the parts between line feeds; an empty text has none."""
        if not text:
            return cls()
        raw = text.encode("utf-8", "surrogatepass")
        parts = raw.split(b"\n")
        digests = [hashlib.blake2b(p, digest_size=8 * STRONG).digest() for p in parts]
        strong = np.frombuffer(b"".join(digests), "<u8").reshape(-1, STRONG).sum(axis=0, dtype=np.uint64)
        wide, short = np.zeros(WIDE, np.int64), [p for p in parts if 0 < len(p) < SHORT]
        if len(raw) >= SHORT:
            eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
            words = eight[:-8] * _M1 + eight[8:] * _M2
            if len(parts) > 1:
                whole, at = np.ones(len(words), bool), 0
                for p in parts:
                    end = at + len(p)
                    whole[at if len(p) < SHORT else end - WINDOW + 1 : end + 1] = False
                    at = end + 1
                words = words[whole]
            wide += _sketch(_mix(words))
        if short:
            small = [int.from_bytes(p[i : i + SMALL], "little") for p in short for i in range(max(1, len(p) - SMALL + 1))]
            wide += _sketch(_mix((np.array(small, np.uint64) + np.uint64(1)) * _M1))
        return cls(strong, wide.astype(np.uint32))

    def __add__(self, other: MultisetHash) -> MultisetHash:
        return MultisetHash(self.strong + other.strong, self.wide + other.wide)

    def __sub__(self, other: MultisetHash) -> MultisetHash:
        return MultisetHash(self.strong - other.strong, self.wide - other.wide)

    def add(self, paragraph: str) -> MultisetHash:
        return self + self._one(paragraph)

    def remove(self, paragraph: str) -> MultisetHash:
        return self - self._one(paragraph)

    @classmethod
    def _one(cls, paragraph: str) -> MultisetHash:
        if "\n" in paragraph:
            raise ValueError("a paragraph holds no line feed")
        return cls.of(paragraph) if paragraph else cls(np.frombuffer(hashlib.blake2b(b"", digest_size=8 * STRONG).digest(), "<u8").astype(np.uint64))

    def __str__(self) -> str:
        return base64.b64encode(self.strong.astype("<u8").tobytes() + self.wide.astype("<u4").tobytes()).decode()

    @classmethod
    def parse(cls, text: str) -> MultisetHash:
        raw = base64.b64decode(text)
        return cls(np.frombuffer(raw, "<u8", STRONG).astype(np.uint64), np.frombuffer(raw, "<u4", WIDE, 8 * STRONG).astype(np.uint32))

    def likeness(self, other: MultisetHash) -> float:
        """1 for equal sums, else the cosine of the wide lanes, 0 where it is under 0 or one has none."""
        if (self.strong == other.strong).all() and (self.wide == other.wide).all():
            return 1.0
        a, b = self.wide.view(np.int32).astype(np.float64), other.wide.view(np.int32).astype(np.float64)
        norm = float(np.sqrt((a @ a) * (b @ b)))
        return min(1.0, max(0.0, float(a @ b) / norm)) if norm else 0.0


class _Ranges:
    """Ranges of doc_ids in order, null last: ids that fill several ranges by themselves, and null, have as many, by the hash of the text."""

    def __init__(self, percentiles: list[int], null_ranges: int):
        splits, times = np.unique(np.array(percentiles, np.int64), return_counts=True)
        self.splits, self.pieces = splits, np.concatenate(([0], np.where(times > 1, times, 0)))
        self.offset = np.concatenate(([0], np.cumsum(self.pieces + 1)))
        self.null_ranges, self.n = null_ranges, int(self.offset[-1]) + null_ranges

    def of(self, ids: np.ndarray, none: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The range of each row; ``h`` counts by its signed order."""
        high = (h.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(33)
        i = np.searchsorted(self.splits, ids, "right")
        pieces = self.pieces[i]
        alone = (pieces > 0) & (ids == self.splits[np.maximum(i - 1, 0)]) if len(self.splits) else np.zeros(len(ids), bool)
        part = lambda n: (high * n.astype(np.uint64) >> np.uint64(31)).astype(np.int64)
        own = self.offset[i] + np.where(alone, part(pieces), pieces)
        return np.where(none, self.offset[-1] + part(np.full(len(ids), self.null_ranges)), own).astype(np.int32)


def with_neighbours(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """(dest, copy, doc_id, text, h), each ``dest`` a partition: a range of doc_ids with a copy of the row after its last one.

    Ranges, twice as many as shuffle partitions unless ``buckets`` says otherwise, come from approximate percentiles, so
    texts are shuffled once and a task's share stays the same as partitions grow with the input; ranges and their first
    keys alone reach the driver. Null ids come last; repeated ids follow each other by their texts' hashes, and an id that fills more
    than a range, or null, has several (rows equal in text too share one). The last range's copy is the first row of all.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    parts = buckets or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 100 * parts) if parts > 1 else F.lit(None)
    found, nulls, n = docs.agg(cuts, F.count_if(F.col("doc_id").isNull()), F.count(F.lit(1))).first()
    ranges = _Ranges(found or [], max(1, -(-parts * nulls // max(1, n))))

    @F.pandas_udf("int")
    def range_of(ids: pd.Series, none: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(ranges.of(ids.to_numpy(np.int64), none.to_numpy(bool), h.to_numpy(np.int64)))

    rows = docs.withColumn("dest", range_of(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), F.col("h")))

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = batch.to_pandas().sort_values(["dest", "doc_id", "h"])
            yield pa.RecordBatch.from_pandas(table.drop_duplicates("dest")[["dest", "doc_id", "h"]], preserve_index=False)

    keys = rows.select("dest", F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "h").mapInArrow(firsts, "dest int, doc_id long, h long")
    heads = sorted(keys.groupBy("dest").agg(F.min(F.struct("doc_id", "h")).alias("first")).select("dest", "first.*").collect())
    before = [(r["dest"], r["h"], r["doc_id"], heads[i - 1]["dest"]) for i, r in enumerate(heads)]
    table = spark.createDataFrame(before, "dest int, h long, head long, into int")  # one row a range
    copies = rows.join(F.broadcast(table), ["dest", "h"]).where(F.coalesce("doc_id", F.lit(0)) == F.col("head")).dropDuplicates(["into"])
    copies = copies.select(F.col("into").alias("dest"), F.lit(1).alias("copy"), "doc_id", "text", "h")
    return rows.select("dest", F.lit(0).alias("copy"), "doc_id", "text", "h").unionByName(copies).repartitionById(ranges.n, F.col("dest"))


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edit_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text, of its edited text, and their likeness.

    Edited: the last floor(n/2) code points give way to as many first ones (or all) of the next document by doc_id (after
    the last, the first). Null texts are empty; null ids come last, equal ids by the hash of their texts; a single row
    follows itself; a very long text is held whole with its neighbour; other columns play no part; no rows give no
    rows. Columns: see ``_OUT``.
    """
    rows = with_neighbours(docs).sortWithinPartitions("dest", "copy", F.col("doc_id").asc_nulls_last(), "h", "text").drop("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending = None
        for batch in batches:
            out = []
            for dest, copy, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if copy and (pending is None or pending[0] != dest):
                    continue
                own = MultisetHash.of(text)
                if pending is not None and pending[0] == dest:
                    _, last_id, last, fp = pending
                    half = len(last) // 2
                    edited = last[: len(last) - half] + text[:half]
                    other = MultisetHash.of(edited)
                    out.append((last_id, len(last), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), str(fp), str(other), fp.likeness(other), fp.likeness(own)))
                pending = None if copy else (dest, doc_id, text, own)
            names = [x.split()[0] for x in _OUT.split(", ")]
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 7, types, strict=True)], names)

    return rows.mapInArrow(run, _OUT)


def op9(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return edit_fingerprints(docs)
