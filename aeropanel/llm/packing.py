"""Packing by minimum bin slack: bitset subset sums over remaining lengths, patterns applied to counts."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_safe_rank, materialize

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
_PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_SIMPLE = re.compile(rb"((?:[A-Za-z]|[\xc3-\xc8][\x80-\xbf])+)([!-&(-/:-@\[-`{-~]*)")  # letters below U+0240, then ASCII signs but the apostrophe


# The normalizer and splitter under which a word of letters is one piece; with any others all words go through the tokenizer.
_SHORTCUT = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class _Words(dict):
    """Bytes of a word's ids (unsigned 32-bit, little endian) by the word's bytes; emptied when ``most`` are kept.

    A word of letters, with or without signs after them, is lower-cased and goes to the tokenizer's model as the one
    piece that its splitting would make of it, signs apart; all other words go through the whole tokenizer.
    """

    def __init__(self, path: str, most: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.most, self.tokenizer = most, Tokenizer.from_file(path)
        self.model, self.byte_level = self.tokenizer.model, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        spec = json.loads(self.tokenizer.to_str())
        self.simple = {k: spec[k] for k in ("normalizer", "pre_tokenizer")} == _SHORTCUT and not spec["model"].get("dropout") and spec["model"]["type"] == "BPE"

    def __missing__(self, word: bytes) -> bytes:
        m = _SIMPLE.fullmatch(word) if self.simple else None
        if m and (text := m[1].decode()).isalpha() and is_normalized("NFC", text) and len(low := text.lower()) == len(text):
            if m[2] or low != text:
                found = self[low.encode()] + (self[m[2]] if m[2] else b"")
            else:
                piece = text if text.isascii() else self.byte_level.pre_tokenize_str(text)[0][0]
                found = np.array([t.id for t in self.model.tokenize(piece)], "<u4").tobytes()
        else:
            found = np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = found
        return found


def tokenize(docs: DataFrame, path: str | None = None, capacity: int = 2048, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """The pieces of every document (null text: empty): its ids and ``end_id``, cut at each ``capacity`` ids.

    The tokenizer drops white space and merges nothing across it, so words between ASCII spaces are encoded once and
    remembered; a test holds that against whole texts, marks of special tokens included (they give their one id, as
    ``tokenizers`` does by default). Columns: doc_id, start, length, ids_crc32, doc_tokens, ids (unsigned 32-bit little
    endian; null unless ``keep_ids``). A very long text is held whole, with its ids, by one task.
    """
    path = path or default_tokenizer()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = _Words(path), np.array([end_id], "<u4").tobytes()
        get, step = words.__getitem__, 4 * capacity
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = b"".join(map(get, text.as_buffer().to_pybytes().split() if text.is_valid else ())) + end
                for at in range(0, len(ids), step):
                    piece = ids[at : at + step]
                    for to, x in zip(out, (doc_id, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, piece if keep_ids else None), strict=True):
                        to.append(x)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:5]), pa.array(out[5], pa.binary())], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, _PIECES)


def fill_window(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The lengths, with how many of each, of a fullest window: the longest, and a subset sum of the others.

    Bit s of an integer says that s is reachable; copies of a length come in by powers of two; lengths go longest first
    until the window can be full, and the counts come from going back through the bitsets.
    """
    first = max(counts)
    left = room - first
    rest = [(size, n - (size == first)) for size, n in sorted(counts.items(), reverse=True)]
    rest = [(size, min(n, left // size)) for size, n in rest if size <= left and n]
    mask, reach, before = (1 << (left + 1)) - 1, 1, []
    for size, n in rest:
        if reach >> left & 1:
            break
        before.append((size, reach))
        part = 1
        while n:
            k = min(part, n)
            reach |= (reach << (k * size)) & mask
            n, part = n - k, part * 2
    at, used = reach.bit_length() - 1, {first: 1}
    for size, was in reversed(before):
        while not was >> at & 1:
            at -= size
            used[size] = used.get(size, 0) + 1
    return sorted(used.items(), reverse=True)


def plan_windows(counts: dict[int, int], room: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, [(length, how many)]) until ``counts`` (length to number of pieces) is used up.

    A window's multiset is applied as often as the counts allow, so the work depends on the number of lengths (at most
    ``room``), not on the pieces.
    """
    counts, plan = {k: v for k, v in counts.items() if v}, []
    while counts:
        window = fill_window(counts, room)
        times = min(counts[size] // k for size, k in window)
        plan.append((times, window))
        for size, k in window:
            counts[size] -= times * k
            if not counts[size]:
                del counts[size]
    return plan


def place(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Give each row of ``pieces`` (doc_id, start, length 1..capacity, ids_crc32, doc_tokens) its sequence and offset.

    Only counts by length (``capacity`` rows at most) reach the driver. Pieces get exact ranks within their length; a
    rank range of a length belongs to a window of the plan, so a task finds a piece's place from its rank alone.
    Rows that are equal in all columns are pieces of their own. No rows give no rows.
    """
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    ranges: dict[int, list[tuple[int, int, int, int]]] = {}
    used, sequences = dict.fromkeys(counts, 0), 0
    for times, window in plan_windows(counts, capacity):
        offset = 0
        for size, k in window:
            ranges.setdefault(size, []).append((used[size], k, sequences, offset))
            used[size] += times * k
            offset += size * k
        sequences += times
    table = {size: np.array(rows, np.int64) for size, rows in ranges.items()}
    ranked, before = hot_safe_rank(pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.xxhash64("doc_id", "start", "ids_crc32").alias("h")), ["length"], "h")
    rows = ranked.join(before, ["length", "bucket"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("in_bucket")).alias("rank"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length).tolist():
                at, own = np.nonzero(length == size)[0], table[size]
                row = own[np.searchsorted(own[:, 0], rank[at], "right") - 1]
                nth = rank[at] - row[:, 0]
                sequence[at] = row[:, 2] + nth // row[:, 1]
                offset[at] = row[:, 3] + nth % row[:, 1] * size
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return rows.mapInArrow(find, _PLACED)


def pack(docs: DataFrame, path: str | None = None, capacity: int = 2048) -> DataFrame:
    """Every id of every document in one piece of one sequence of at most ``capacity`` ids, with little padding.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. An empty or null text is its end id
    alone; a null doc_id and repeated rows are documents of their own; no rows give no rows.
    """
    return place(materialize(tokenize(docs, path, capacity).drop("ids"), "pieces"), capacity)


def sequences(docs: DataFrame, path: str | None = None, capacity: int = 2048) -> DataFrame:
    """(sequence_id, ids array<int>) of ``pack``: the packed ids themselves, unpadded."""
    pieces = tokenize(docs, path, capacity, keep_ids=True)
    keys = ["doc_id", "start", "length", "ids_crc32"]
    placed = pack(docs, path, capacity)
    cond = [placed[k].eqNullSafe(pieces[k]) for k in keys]
    body = placed.join(pieces.dropDuplicates(keys).select(*keys, "ids"), cond).select(placed["sequence_id"], placed["offset"], pieces["ids"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [[int(x) for x in np.frombuffer(b"".join(p["ids"] for p in sorted(row, key=lambda p: p["offset"])), "<u4")] for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.list_(pa.int32()))], ["sequence_id", "ids"])

    return body.groupBy("sequence_id").agg(F.collect_list(F.struct("offset", "ids")).alias("parts")).mapInArrow(whole, "sequence_id long, ids array<int>")


def op6(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return pack(docs)
