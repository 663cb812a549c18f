"""Line dedup with a log-template tree: token count, leading tokens, then groups of alike lines; templates that recur go."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import discard
from .common import Alike, Cross, components_of_blocks, join_hot, label_pairs, materialize, unused

_LINES = "doc_id long, key long, line_no int, n int, leaf long, line long, sig binary"
_SPACE = np.array([i in (9, 10, 11, 12, 13, 32) for i in range(256)])
_VARIABLE = np.array([chr(i) in "0123456789@" for i in range(256)])
_BASE, _TOKENS, _M1, _M2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC2B2AE3D27D4EB4F))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


FIELD = int(_mix(np.array([1], np.uint64))[0])  # a variable field's hash


@functools.lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number and of its inverse, modulo 2^64."""
    out = []
    for x in (base, pow(base, -1, 1 << 64)):
        steps = np.full(n, x, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps))
    return out[0], out[1]


def _spans(values: np.ndarray, base: np.uint64, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A polynomial hash of each values[start:end], by differences of one running sum."""
    up, down = _powers(int(base), 1 << max(16, len(values).bit_length()))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)))
    return (sums[end] - sums[start]) * down[start]


def parse_lines(raw: bytes, depth: int = 2) -> tuple[np.ndarray, ...]:
    """(n, leaf, line, marks, bounds) of the lines of ``raw``: tokens, hashes of the leaf and the whole line, and 16 bits for each token, line i's being marks[bounds[i]:bounds[i + 1]].

    Tokens lie between ASCII white space; those with a digit, an at sign or "://" are variable fields, which hash alike.
    The leaf is the number of tokens with the ``depth`` leading ones, or all of fewer than three. A template is two
    constant tokens at least: lines of fewer join as raw text, in a leaf a text.
    """
    data = np.frombuffer(raw + b"\n", np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[data])).astype(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    token = _mix(_spans(data.astype(np.uint64) + np.uint64(1), _BASE, starts, ends))
    marked = _VARIABLE[data]
    if b"://" in raw:
        marked[:-2] |= (data[:-2] == 58) & (data[1:-1] == 47) & (data[2:] == 47)
    seen = np.concatenate(([0], np.cumsum(marked, dtype=np.int64)))
    field = seen[ends] > seen[starts]
    bounds = np.searchsorted(starts, np.concatenate(([0], np.flatnonzero(data == 10) + 1)))
    n = np.diff(bounds)
    fields = np.diff(np.concatenate(([0], np.cumsum(field)))[bounds])
    plain = (fields > 0) & (n - fields < 2)
    of = np.repeat(np.arange(len(n)), n)
    token = np.where(field & ~plain[of], np.uint64(FIELD), token)
    leading = np.where((n < 3) | plain, n, np.minimum(n, depth))
    count = n.astype(np.uint64)
    line = _mix(_spans(token, _TOKENS, bounds[:-1], bounds[1:]) + count)
    leaf = _mix(_spans(token, _TOKENS, bounds[:-1], bounds[:-1] + leading) * _M1 + count)
    return n, leaf.view(np.int64), line.view(np.int64), (token >> np.uint64(48)).astype("<u2"), bounds


def _pieces(text: bytes, most: int = 1 << 20) -> Iterator[bytes]:
    """A text in pieces of whole lines, of about ``most`` bytes but for longer lines."""
    at = 0
    while len(text) - at > most and (end := text.find(b"\n", at + most)) >= 0:
        yield text[at:end]
        at = end + 1
    yield text[at:]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def alike_all(a: list[bytes], b: list[bytes], least: float) -> np.ndarray:
    """Of pairs of signatures, whether ``least`` of their tokens are equal, place by place."""
    size, other = (np.fromiter(map(len, x), np.int64, len(x)) // 2 for x in (a, b))
    out, same = np.zeros(len(a), bool), np.flatnonzero((size == other) & (size > 0))
    if len(same):
        x, y = (np.frombuffer(b"".join([sigs[i] for i in same.tolist()]), "<u2") for sigs in (a, b))
        size = size[same]
        equal = np.add.reduceat(x == y, np.concatenate(([0], np.cumsum(size)[:-1])), dtype=np.int64)
        out[same] = equal >= least * size - 1e-9
    return out


def blocks_of(sig: bytes, least: float, depth: int = 0) -> list[tuple[int, bytes]]:
    """(number, tokens) of blocks of which alike lines share one at least; none where only equal lines are alike.

    Where one token may differ: all tokens but one, for each, so lines that share a block are alike. Else one block
    more than the positions that may differ. The ``depth`` leading tokens, which all lines of a leaf have, are in no block.
    """
    n = len(sig) // 2
    free, differ = max(0, n - depth), may_differ(n, least)
    if differ <= 1:
        return [(i, sig[: 2 * i] + sig[2 * i + 2 :]) for i in range(n - free, n)] if differ else []
    ends = [n - free + free * (i + 1) // (differ + 1) for i in range(differ + 1)]
    return [(i, sig[2 * a : 2 * b]) for i, (a, b) in enumerate(zip([n - free, *ends[:-1]], ends, strict=True))]


def may_differ(n: int, least: float) -> int:
    return int((1 - least) * n + 1e-9)


def alike_lines(least: float) -> tuple[Alike, Cross]:
    """The tests of ``components_of_blocks`` for signatures."""

    def cross(a: list[bytes], label_a: np.ndarray, b: list[bytes], label_b: np.ndarray, cells: int = 1_000_000) -> set[tuple[int, int]]:
        found: set[tuple[int, int]] = set()
        size_a, size_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        for size in np.intersect1d(size_a, size_b).tolist():  # one, but for colliding hashes
            left, right = np.flatnonzero(size_a == size), np.flatnonzero(size_b == size)
            x, y = (np.frombuffer(b"".join(sigs[i] for i in own.tolist()), "<u2").reshape(len(own), -1) for sigs, own in ((a, left), (b, right)))
            by_place, step = np.ascontiguousarray(y.T), max(1, cells // len(right))
            for at in range(0, len(left), step):
                own = x[at : at + step]
                same = np.zeros((len(own), len(right)), np.uint8 if size < 500 else np.uint32)
                if len(own) < x.shape[1]:  # a few long lines: by line
                    for line, to in zip(own, same, strict=True):
                        np.sum(line == y, axis=1, dtype=same.dtype, out=to)
                else:
                    for place, tokens in enumerate(by_place):
                        same += (own[:, place, None] == tokens).view(np.uint8)
                i, j = np.nonzero((same >= least * x.shape[1] - 1e-9) & (label_a[left[at : at + step], None] != label_b[right]))
                found |= label_pairs(label_a[left[at + i]], label_b[right[j]])
        return found

    return lambda a, b: alike_all(a, b, least), cross


def parse(docs: DataFrame, depth: int = 2, min_tokens: int = 3) -> DataFrame:
    """``_LINES`` of every line of ``min_tokens`` tokens or more; key: a hash of doc_id and text, so equal rows are one document."""

    def groups(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
        """(bytes, [(row, number of its first line here)]): pieces of texts, put together up to about ``most`` bytes."""
        parts, rows, size = [], [], 0
        for row, text in enumerate(texts):
            first = 0
            for piece in _pieces(text.as_buffer().to_pybytes() if text.is_valid else b""):
                if parts and size + len(piece) > most:
                    yield b"\n".join(parts), rows
                    parts, rows, size = [], [], 0
                lines = piece.count(b"\n") + 1
                parts.append(piece)
                rows.append((row, first, lines))
                first, size = first + lines, size + len(piece)
        if parts:
            yield b"\n".join(parts), rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, rows in groups(batch.column(2)):
                n, leaf, line, marks, bounds = parse_lines(raw, depth)
                row, first, lines = np.array(rows, np.int64).T
                place = np.repeat(row, lines)
                number = np.arange(len(n)) - np.repeat(np.cumsum(lines) - lines - first, lines)
                sig = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((2 * bounds).astype(np.int32).tobytes()), pa.py_buffer(marks.tobytes())])
                out = pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(place)), batch.column(1).take(pa.array(place)), pa.array(number.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(leaf), pa.array(line), sig], [x.split()[0] for x in _LINES.split(", ")])
                yield out.filter(pa.array(n >= max(1, min_tokens)))

    return docs.select("doc_id", "key", "text").mapInArrow(run, _LINES)


def template_groups(lines: DataFrame, least: float = 0.8, depth: int = 2) -> DataFrame:
    """(line, template): lines that share a template with another text; template is the group's smallest line hash.

    Within a leaf, lines with ``least`` of their tokens equal, place by place, belong together. Lines of equal text
    count once. Alike lines share a block, and ``components_of_blocks`` links the lines of blocks, so no link is
    missed. Leaves of one text take no part.
    """
    lines = lines.where(F.floor(F.lit(1 - least) * F.col("n") + 1e-9) >= 1)  # others are alike only where they are equal
    # distinct lines come first, so repeated ones are not shuffled again
    distinct = materialize(lines.groupBy("leaf", "line").agg(F.first("sig").alias("sig")), "distinct-lines")
    several = materialize(distinct.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "leaves")
    texts = materialize(join_hot(distinct, several, "leaf").drop("n"), "leaf-lines")
    discard(distinct)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (_signed(xxhash.xxh64_intdigest(b"%d %d " % (leaf, i) + tokens)), line, may_differ(len(sig) // 2, least) > 1)
                for leaf, line, sig in zip(*(c.to_pylist() for c in batch.columns), strict=True)
                for i, tokens in blocks_of(sig, least, depth)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 3, [pa.int64(), pa.int64(), pa.bool_()], strict=True)], ["block", "node", "loose"])

    keyed = materialize(texts.select("leaf", "line", "sig").mapInArrow(blocks, "block long, node long, loose boolean"), "blocks")
    labels = components_of_blocks(keyed, texts.select(F.col("line").alias("node"), "sig"), *alike_lines(least), "line")
    for written in (several, texts, keyed):
        discard(written)
    return labels.select(F.col("node").alias("line"), F.col("label").alias("template"))


def repeated_lines(docs: DataFrame, least: float = 0.8, depth: int = 2, min_tokens: int = 3, min_docs: int = 2) -> DataFrame:
    """(key, doc_id, gone array<int>): of every document with some, the numbers of the lines to drop.

    A template recurs if lines of ``min_docs`` documents have it. Its first line, by doc_id, key and place, stays, so a
    passage or copied text is kept once; all its other lines are dropped, those of the same document too.
    """
    lines = materialize(parse(docs, depth, min_tokens), "lines")
    groups = template_groups(lines, least, depth)
    slim = lines.select("doc_id", "key", "line_no", "line").join(groups, "line", "left").select("doc_id", "key", "line_no", F.coalesce("template", "line").alias("template"))
    slim = materialize(slim, "templates")
    discard(lines)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "line_no")
    by_doc = slim.groupBy("template", "doc_id", "key").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("n"))
    often = by_doc.groupBy("template").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n"), F.min("place").alias("first")).where(F.col("docs") >= min_docs)
    found = join_hot(slim, materialize(often.drop("docs"), "often"), "template")
    gone = found.where((F.col("key") != F.col("first.key")) | (F.col("line_no") != F.col("first.line_no")) | ~F.col("doc_id").eqNullSafe(F.col("first.doc_id")))
    return gone.groupBy("key", "doc_id").agg(F.sort_array(F.collect_set("line_no")).alias("gone"))


def without(text: str, gone: str) -> Column:
    """The text without the lines whose numbers the sorted array ``gone`` has, in time that grows with the lines.

    The numbers become a flag a line (the gap before each, then true), read by place.
    """
    gap = lambda x, i: x - F.when(i == 0, 0).otherwise(F.get(F.col(gone), i - 1) + 1)
    flags = F.flatten(F.transform(gone, lambda x, i: F.concat(F.array_repeat(F.lit(False), gap(x, i)), F.array(F.lit(True)))))
    # the flags come in by a one-element array, so that they are made once a text
    rest = F.transform(F.array(flags), lambda f: F.array_join(F.filter(F.split(F.col(text), "\n", -1), lambda x, i: ~F.coalesce(F.get(f, i), F.lit(False))), "\n"))
    return rest[0]


def drop_repeated(docs: DataFrame, **settings) -> DataFrame:
    """All rows and columns of ``docs``, the text without the lines of recurring templates, and how many went (lines_dropped).

    Null and empty texts stay as they are; a text all of whose lines go is empty; rows that are equal in doc_id and text are
    one document; null ids come last; blank lines, and lines of under ``min_tokens`` tokens, stay; a very long text is
    read whole by one task; no rows give no rows. Where ``docs`` has a column lines_dropped, it stays, and the count is
    ``_lines_dropped`` (or with as many underscores as set it apart).
    """
    key, at, gone, again = unused(docs, "key", "at", "gone", "again")
    counted = "lines_dropped" if "lines_dropped" not in map(str.lower, docs.columns) else unused(docs, "lines_dropped")[0]
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    keyed = docs.withColumns({key: F.xxhash64(doc_id, text), at: doc_id})
    own = keyed.select(F.col(at).alias("doc_id"), F.col(key).alias("key"), text.alias("text")).where("text is not null and text <> ''")
    rows = repeated_lines(own, **settings).toDF(again, f"{again}_id", gone)
    found = keyed.join(rows, (F.col(key) == F.col(again)) & F.col(at).eqNullSafe(F.col(f"{again}_id")), "left")
    left = F.when(F.col(gone).isNull(), F.col("text")).otherwise(without("text", gone))
    dropped = F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long")
    return found.select(*[left.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns], dropped.alias(counted))


def op3(docs: DataFrame) -> DataFrame:
    """doc_id, the text that stays, and the number of lines dropped, of every document; every line that is not blank takes part."""
    return drop_repeated(docs.select("doc_id", "text"), min_tokens=1)


def dedup_documents(docs: DataFrame, **settings) -> DataFrame:
    """``drop_repeated`` with the columns of ``docs`` alone; where lines went, n_chars is the new text's."""
    out = drop_repeated(docs, **settings)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(out.columns[-1]) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
