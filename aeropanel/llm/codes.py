"""Vector code compression: product codes whose entries are found by exponion search in exact integers."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_hot, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
SMALL, LIMB = 1 << 29, 40  # components below SMALL have squared distances in 64 bits; sums travel in pieces of LIMB bits


def integers(vectors: pa.Array, width: int) -> np.ndarray:
    """[n, width]: floor(SCALE * x), short vectors extended by zeros; Python's integers where 64 bits may not hold a distance."""
    x = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64)
    with np.errstate(over="ignore"):
        q = np.floor(x * SCALE)
    if len(q) and not np.abs(q).max() < SMALL:
        q = np.array([int(v) * SCALE if abs(v) >= 2.0**53 else math.floor(v * SCALE) for v in x.tolist()] + [None], object)[:-1]
    else:
        q = q.astype(np.int64)
    n = np.diff(np.asarray(vectors.offsets))
    if (n == width).all():
        return q.reshape(len(n), width)
    out = np.zeros((len(n), width), q.dtype)
    out[np.repeat(np.arange(len(n)), n), np.concatenate([np.arange(k) for k in n])] = q
    return out


class Neighbours:
    """The entries of one part position, and for each of them all entries by distance."""

    def __init__(self, book: list[list[int]]) -> None:
        big = any(abs(v) >= SMALL for entry in book for v in entry)
        self.book = np.array(book, object if big else np.int64).reshape(len(book), len(book[0]))
        apart = ((self.book[:, None] - self.book[None]) ** 2).sum(-1)
        np.fill_diagonal(apart, -1)  # an entry comes first in its own list
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, axis=1)

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(the nearest entry of each row, ties to the lower index; its squared distance; the distances computed).

        From the entry a of ``start``, at distance u, an entry as near as a lies within 2u of a (triangle inequality),
        so the list of a is scanned only while squared distances from a are at most 4u².
        """
        first = ((x - self.book[start]) ** 2).sum(1)
        best, least, within, computed = start.copy(), first.copy(), 4 * first, len(x)
        at = np.arange(len(x))
        for rank in range(1, len(self.book)):
            at = at[(self.apart[start[at], rank] <= within[at]).astype(bool)]
            if not len(at):
                break
            other = self.order[start[at], rank]
            d = ((x[at] - self.book[other]) ** 2).sum(1)
            better = ((d < least[at]) | (d == least[at]) & (other < best[at])).astype(bool)
            best[at[better]], least[at[better]] = other[better], d[better]
            computed += len(at)
        return best, least, computed


def _limbs(value: int) -> list[tuple[int, int]]:
    """(place, piece) of the pieces of LIMB bits that aren't 0, all with the sign of ``value``."""
    sign, value, out, i = (-1 if value < 0 else 1), abs(value), [], 0
    while value:
        if value & ((1 << LIMB) - 1):
            out.append((i, sign * (value & ((1 << LIMB) - 1))))
        value, i = value >> LIMB, i + 1
    return out


def assigned(rows: DataFrame, books: list[list[list[int]]], width: int, tag: str) -> DataFrame:
    """A written table: ``rows`` with the code and squared error of each by ``books``, and, besides, marked by a ``part``, each task's sums of the vectors of an entry.

    Searches start at the row's code before, or at entry 0 where it has none. An error beyond 64 bits is null.
    """
    step, each = max(1, (1 << 20) // max(width, 1)), width // PARTS
    names = ["row", "vec", "code", "error", "part", "entry", "place", "limb", "amount"]
    types = rows.select("row", "vec", "code", *[F.lit(None).cast("int" if c in names[4:8] else "long").alias(c) for c in names[3:]]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = [Neighbours(b) for b in books if b]
        sums = np.zeros((PARTS, len(books[0]), each), object)
        counts = np.zeros((PARTS, len(books[0])), np.int64)
        row_type = vec_type = None
        for batch in batches:
            row_type, vec_type = batch.column(0).type, batch.column(1).type
            for at in range(0, len(batch), step):
                some = batch.slice(at, step)
                x, n = integers(some.column(1), width), len(some)
                before = b"".join(c or bytes(PARTS) for c in some.column(2).to_pylist())
                start = np.frombuffer(before, np.uint8).reshape(n, PARTS).astype(np.int64)
                codes, error = np.zeros((n, PARTS), np.uint8), np.zeros(n, object)
                for p in range(PARTS):
                    part = x[:, p * each : (p + 1) * each]
                    best, least, _ = near[p].nearest(part, start[:, p])
                    codes[:, p] = best
                    error += least
                    counts[p] += np.bincount(best, minlength=len(books[p]))
                    for e in np.unique(best).tolist():
                        sums[p, e] += part[best == e].sum(0)
                done = pa.array([bytes(c) for c in codes], pa.binary())
                miss = pa.array([int(e) if e < 1 << 63 else None for e in error.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), done, miss, *[pa.nulls(n, t) for t in (pa.int32(),) * 4 + (pa.int64(),)]], names)
        found = [(p, e, -1, 0, int(counts[p, e])) for p, e in zip(*np.nonzero(counts))]
        found += [(p, e, j, i, v) for p, e in zip(*np.nonzero(counts)) for j in range(each) for i, v in _limbs(int(sums[p, e, j]))]
        if found:
            n, columns = len(found), list(zip(*found))
            yield pa.RecordBatch.from_arrays([pa.nulls(n, row_type), pa.nulls(n, vec_type), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), *[pa.array(map(int, c), t) for c, t in zip(columns, (pa.int32(),) * 4 + (pa.int64(),))]], names)

    for f in types:
        f.nullable = True  # each kind of row lacks the other's columns
    return materialize(rows.select("row", "vec", "code").mapInArrow(run, types), tag)


def updated(table: DataFrame, books: list[list[list[int]]]) -> list[list[list[int]]]:
    """Each entry replaced by its vectors' componentwise floor(sum / count); entries without vectors stay. The sums are one row a component."""
    total = table.where("part is not null").groupBy("part", "entry", "place", "limb").agg(F.sum(F.col("amount").cast("decimal(38,0)")).alias("amount"))
    sums: dict[tuple[int, int, int], int] = {}
    for part, entry, place, limb, amount in total.collect():
        sums[part, entry, place] = sums.get((part, entry, place), 0) + (int(amount) << (LIMB * limb))
    mean = lambda p, e, j: sums.get((p, e, j), 0) // sums[p, e, -1]
    return [[[mean(p, e, j) for j in range(len(entry))] if (p, e, -1) in sums else entry for e, entry in enumerate(book)] for p, book in enumerate(books)]


def compress(vectors: DataFrame, order: str = "vec_id", column: str = "embedding", rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, list[list[list[int]]]]:
    """(a written table ``row``, ``vec``, ``code``, ``error``: the other columns as one, the vector, a byte a part, the squared error; the codebooks).

    Rows whose vector is null or holds a null, an infinity or NaN are dropped. Codebooks start as the vectors of the
    ``entries`` smallest ``order`` (ties: the smaller vector; nulls last; repeated rows each), at most 256. Vectors of
    several lengths, or of one that 8 doesn't divide, are extended by zeros; those of no components have errors of 0.
    Every round is a pass that reads the last written table, with the code to start from, and writes the next; what
    the driver gets is a row a component of the codebooks. Extra columns ride along in ``row``. No rows give no codebooks.
    """
    kind = dict(vectors.dtypes)[column]
    others = [F.col(f"`{c}`") for c in vectors.columns if c != column]
    vec = F.col(f"`{column}`").cast(kind if kind in ("array<float>", "array<double>") else "array<double>")
    rows = vectors.select(F.struct(*others).alias("row"), vec.alias("vec"), F.col(f"`{order}`").alias("order"))
    finite = F.forall("vec", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    rows = rows.where(F.coalesce(finite, F.lit(False)))
    width = -(-(rows.agg(F.max(F.size("vec"))).first()[0] or 0) // PARTS) * PARTS
    first = rows.orderBy(F.col("order").asc_nulls_last(), "vec").limit(entries).select("vec").toArrow().column("vec").combine_chunks()
    start = integers(first, width).tolist()
    if not start:
        return assigned(rows.select("row", "vec", F.lit(None).cast("binary").alias("code")).limit(0), [[]] * PARTS, 0, "codes"), [[]] * PARTS
    each = width // PARTS
    books = [[[int(v) for v in x[p * each : (p + 1) * each]] for x in start] for p in range(PARTS)]
    table = assigned(rows.select("row", "vec", F.lit(None).cast("binary").alias("code")), books, width, "codes")
    for _ in range(rounds):
        books = updated(table, books)
        last, table = table, assigned(table.where("part is null").select("row", "vec", "code"), books, width, "codes")
        discard(last)
    return table, books


def op12(embeddings: DataFrame) -> DataFrame:
    """The contract's columns.

    A null or repeated vec_id is a row like others (initial entries: nulls last, ties by vector); null labels are one
    label; an error, or a label's sum of errors, beyond 64 bits is null; long vectors whole; no rows, or none kept,
    give no rows; other columns go.
    """
    table, books = compress(embeddings.select("vec_id", "label", "embedding"))
    digest = hashlib.sha256(",".join(str(v) for book in books for entry in book for v in entry).encode()).hexdigest()
    label = F.coalesce(F.concat(F.lit("="), F.col("row.label").cast("string")), F.lit(""))
    rows = table.where("part is null").select("row.vec_id", F.lower(F.hex("code")).alias("code"), "error", label.alias("label"))
    total = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("error").cast("decimal(38,0)")).alias("total"), F.count("error").alias("whole"))
    by_label = materialize(total.select("label", "n", F.expr("CASE WHEN n = whole THEN try_cast(total AS BIGINT) END").alias("label_error")), "labels")
    return join_hot(rows, by_label, "label").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle(rounds: int = ROUNDS) -> str:
    """SQL for vectors of one length that 8 divides: every part meets all entries."""
    assign = "SELECT r, part, v, e, d FROM (SELECT p.r, p.part, p.v, b.e, list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - b.v[i]) * (p.v[i] - b.v[i]))) AS d, row_number() OVER (PARTITION BY p.r, p.part ORDER BY list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - b.v[i]) * (p.v[i] - b.v[i]))), b.e) AS o FROM parts p JOIN book{k} b ON p.part = b.part) WHERE o = 1"
    update = "SELECT b.part, b.e, coalesce(u.v, b.v) AS v FROM book{k} b LEFT JOIN (SELECT part, e, list(m ORDER BY j) AS v FROM (SELECT part, e, j, CAST(floor(CAST(sum(q) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM (SELECT part, e, unnest(range(1, len(v) + 1)) AS j, unnest(v) AS q FROM near{k}) GROUP BY part, e, j) GROUP BY part, e) u ON b.part = u.part AND b.e = u.e"
    steps = "".join(f",\nnear{k} AS MATERIALIZED ({assign.format(k=k)}),\nbook{k + 1} AS MATERIALIZED ({update.format(k=k)})" for k in range(rounds))
    return rf"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT r, part, list_transform(embedding[part * (len(embedding) // 8) + 1:(part + 1) * (len(embedding) // 8)], lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM (SELECT r, embedding, unnest(range(0, 8)) AS part FROM kept)),
book0 AS MATERIALIZED (SELECT part, r - 1 AS e, v FROM parts WHERE r <= 16){steps},
last AS MATERIALIZED ({assign.format(k=rounds)}),
coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM last GROUP BY r),
digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, e)) AS h FROM book{rounds})
SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM kept k JOIN coded c ON k.r = c.r CROSS JOIN digest
"""


ORACLE = _oracle()
