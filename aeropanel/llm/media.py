"""Media columns: payloads cut by content, chunks deduplicated by Spark, chunk lists that rebuild verified media."""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, materialize

LEAST, MOST = 512, 8192
_GEAR = np.random.default_rng(2048).integers(0, 1 << 16, 256).astype(np.uint16)
_MASK = np.uint16(0x7FF << 5)  # 11 bits: a cut every 2048 bytes beyond the least, on average

_RECIPE = "array<struct<digest binary, length int, loose boolean>>"
_STORED = f"doc_id long, n_bytes long, media_id binary, header binary, recipe {_RECIPE}, pack binary"
_READ = "media_id binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload_of(text: bytes, unit: int = 64) -> bytes:
    """The bytes, and zeros up to a positive multiple of ``unit``."""
    return text + bytes(max(unit, -(-len(text) // unit) * unit) - len(text))


def wav_header(n: int, rate: int = 8000) -> bytes:
    """RIFF/WAVE, one channel of unsigned 8-bit samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n)


def wav_payload(media: bytes) -> bytes:
    """The samples of such a file; ValueError if it isn't one."""
    riff, size, wave, _, _, kind, channels, _, _, _, bits, data, n = struct.unpack_from("<4sI4s4sIHHIIHH4sI", media)
    if (riff, wave, kind, channels, bits, data) != (b"RIFF", b"WAVE", 1, 1, 8, b"data") or n != len(media) - 44 or size != n + 36:
        raise ValueError("not one channel of 8-bit samples")
    return media[44:]


def cut(payload: bytes) -> list[bytes]:
    """Chunks of LEAST to MOST bytes (the last may be shorter), cut where the rolling gear hash is 0 under the mask.

    h = (h << 1) + gear[byte] modulo 2^16 depends on the last 16 bytes alone, so it is summed for all places at once
    by doubling windows; LEAST is over 16, so a chunk's cut depends on its own bytes alone.
    """
    if len(payload) <= LEAST:
        return [payload]
    h = _GEAR[np.frombuffer(payload, np.uint8)]
    for s in (1, 2, 4, 8):
        wider = h.copy()
        wider[s:] += h[:-s] << np.uint16(s)
        h = wider
    places = np.flatnonzero((h & _MASK) == 0) + 1
    out, at, n = [], 0, len(payload)
    while n - at > LEAST:
        i = int(np.searchsorted(places, at + LEAST))
        end = min(int(places[i]) if i < len(places) else n, at + MOST, n)
        out.append(payload[at:end])
        at = end
    if at < n:
        out.append(payload[at:])
    return out


def digest_of(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=20).digest()


def samples_feature(payload: bytes) -> str:
    """Sum, sum of squares, changes of side of 128, and counts of the samples' 8 ranges of 32 values."""
    x = np.frombuffer(payload, np.uint8)
    side = x >= 128
    return ",".join(map(str, [int(x.sum(dtype=np.int64)), int((x.astype(np.int64) ** 2).sum()), int((side[1:] != side[:-1]).sum()), *np.bincount(x >> 5, minlength=8).tolist()]))


def _facts(media_id: bytes, media: bytes) -> tuple:
    if hashlib.sha256(media).digest() != media_id:
        raise ValueError(f"chunks don't rebuild media {media_id.hex()}")
    payload = wav_payload(media)
    return media_id, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), media_id.hex(), samples_feature(payload)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(names), types, strict=True)], names)


_READ_TYPES = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
_READ_NAMES = [x.split()[0] for x in _READ.split(", ")]


_PARTS = range(0, 20, 5)  # of a digest, each a place in the filter


def _bits(shared: DataFrame, most_bits: int) -> np.ndarray:
    """A Bloom filter of the shared digests, a place by each quarter of their bytes: 16 bits a digest, at most ``most_bits`` bits.

    A digest that isn't shared passes once in 400 times below that size. By one place it was once in 16 to 32, so most
    media of many chunks had one that passed, and their packs were shuffled.
    """
    n = shared.count()
    size = 1 << min(int(math.log2(most_bits)), max(13, math.ceil(math.log2(16 * max(n, 1)))))
    places = F.array(*[F.conv(F.hex(F.substring("digest", 1 + i, 5)), 16, 10).cast("long").bitwiseAND(F.lit(size - 1)) for i in _PARTS])
    words = shared.select(F.explode(places).alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).collect()
    out = np.zeros(size // 64, np.uint64)
    for w, bits in words:
        out[w] = np.uint64(bits & (1 << 64) - 1)
    return out


def may_be_shared(digest: bytes, bits: np.ndarray) -> bool:
    last = len(bits) * 64 - 1
    return all(int(bits[p >> 6]) >> (p & 63) & 1 for p in (int.from_bytes(digest[i : i + 5], "big") & last for i in _PARTS))


def store(docs: DataFrame, earlier: tuple[DataFrame, DataFrame] | None = None, most_bits: int = 1 << 27) -> tuple[DataFrame, DataFrame]:
    """Write the payloads of all texts as media; (media table, chunk store).

    Digests alone are counted first. A chunk whose digest occurs once lies in the pack of its media's row; one that may
    occur more often (a Bloom filter says so, its errors only move more bytes), or that the batches stored ``earlier``
    have, goes to the chunk store, once over all batches. So only such chunks are shuffled. Every media has its
    ordered list of chunk digests, and ``all_chunks`` finds any chunk, packed or not, by its digest.
    ``docs`` is read three times and has to give the same rows each time.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def chunks(text: pa.StringScalar) -> tuple[int, bytes, list[bytes]]:
        raw = text.as_buffer().to_pybytes() if text.is_valid else b""
        payload = payload_of(raw)
        return len(raw), payload, cut(payload)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([(digest_of(c),) for t in batch.column(1) for c in chunks(t)[2]], ["digest"], [pa.binary()])

    found = texts.mapInArrow(digests, "digest binary").groupBy("digest").count()
    known = None if earlier is None else all_chunks(*earlier)
    if known is None:
        shared = found.where("count > 1").select("digest")
    else:
        there = known.select("digest", F.lit(True).alias("there"))
        shared = found.join(there, "digest", "left").where("count > 1 or there").select("digest")
    bits = _bits(materialize(shared, "shared"), most_bits)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media_id", pa.binary()), ("header", pa.binary()), ("recipe", pa.list_(pa.struct([("digest", pa.binary()), ("length", pa.int32()), ("loose", pa.bool_())]))), ("pack", pa.binary())])
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part, rows = batch.slice(at, 1000), []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    n, payload, parts = chunks(text)
                    header, recipe, pack = wav_header(len(payload)), [], []
                    for c in parts:
                        d = digest_of(c)
                        some = may_be_shared(d, bits)
                        recipe.append({"digest": d, "length": len(c), "loose": some})
                        if not some:
                            pack.append(c)
                    rows.append((doc_id, n, hashlib.sha256(header + payload).digest(), header, recipe, b"".join(pack)))
                yield _batch(rows, schema.names, schema.types)

    def loose_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                own = {d: c for t in batch.column(1).slice(at, 1000) for c in chunks(t)[2] if may_be_shared(d := digest_of(c), bits)}
                yield _batch(list(own.items()), ["digest", "bytes"], [pa.binary(), pa.binary()])

    media = materialize(texts.mapInArrow(write, _STORED), "media")
    # cut again, as a copy of all occurrences beside the media would be their whole size on disk
    loose = texts.mapInArrow(loose_chunks, "digest binary, bytes binary").groupBy("digest").agg(F.first("bytes").alias("bytes"))
    if known is not None:
        loose = loose.join(known.select("digest"), "digest", "left_anti")
    return media, materialize(loose, "chunks")


def all_chunks(media: DataFrame, chunk_store: DataFrame) -> DataFrame:
    """(digest, bytes) of every distinct chunk: the chunk store's, and those in the packs of ``media``."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for recipe, pack in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = 0
                for c in recipe:
                    if not c["loose"]:
                        rows.append((c["digest"], pack[at : at + c["length"]]))
                        at += c["length"]
            yield _batch(rows, ["digest", "bytes"], [pa.binary(), pa.binary()])

    return media.select("recipe", "pack").mapInArrow(packed, "digest binary, bytes binary").unionByName(chunk_store.select("digest", "bytes"))


def rebuild(header: bytes, recipe: list[dict], pack: bytes, known: dict[bytes, bytes]) -> bytes:
    """A media from its ordered chunk list: packed chunks in their order, others by digest; every chunk's digest is verified."""
    parts, at = [header], 0
    for c in recipe:
        if c["loose"]:
            part = known[c["digest"]]
        else:
            part = pack[at : at + c["length"]]
            at += c["length"]
        if digest_of(part) != c["digest"]:
            raise ValueError(f"chunk {c['digest'].hex()} isn't what was stored")
        parts.append(part)
    return b"".join(parts)


def read_back(media: DataFrame, chunk_store: DataFrame) -> DataFrame:
    """Rebuild every media from its chunk list, verify it, and compute what is asked of its samples: doc_id, n_bytes and _READ.

    Rows whose chunks are all in their own pack need no other row; those that list chunks of the chunk store (to which
    ``all_chunks`` of earlier batches may be added) meet them in a join by digest, a media once however many rows have it.
    """
    some = F.exists("recipe", lambda c: c["loose"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, n, *_facts(m, rebuild(h, r, p, {}))) for d, n, m, h, r, p in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield _batch(rows, ["doc_id", "n_bytes", *_READ_NAMES], [pa.int64(), pa.int64(), *_READ_TYPES])

    alone = media.where(~some).select("doc_id", "n_bytes", "media_id", "header", "recipe", "pack").mapInArrow(own, f"doc_id long, n_bytes long, {_READ}")
    mixed = media.where(some)
    refs = materialize(mixed.select("media_id", F.explode("recipe").alias("c")).where("c.loose").select("media_id", "c.digest").distinct(), "chunk-refs")
    wanted = materialize(refs.groupBy("digest").agg(F.count(F.lit(1)).alias("n")), "wanted-chunks")  # a boilerplate chunk is one of many media
    found = join_hot(refs, chunk_store.select("digest", "bytes"), "digest", by="media_id", sizes=wanted).groupBy("media_id").agg(F.collect_list(F.struct("digest", "bytes")).alias("chunks"))
    each = mixed.groupBy("media_id").agg(F.first(F.struct("header", "recipe", "pack")).alias("m"), F.count(F.lit(1)).alias("n"))

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(*_facts(i, rebuild(m["header"], m["recipe"], m["pack"], {c["digest"]: c["bytes"] for c in chunks})), n) for i, m, n, chunks in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield _batch(rows, [*_READ_NAMES, "n"], [*_READ_TYPES, pa.int64()])

    facts = materialize(each.join(found, "media_id").select("media_id", "m", "n", "chunks").mapInArrow(rebuilt, f"{_READ}, n long"), "media-facts")
    rows = materialize(mixed.select("doc_id", "n_bytes", "media_id"), "media-rows")
    return alone.unionByName(join_hot(rows, facts, "media_id").drop("n"))


def media_columns(docs: DataFrame) -> DataFrame:
    """``store`` and ``read_back`` of every whole text (null: empty), UTF-8, padded with zeros to a multiple of 64.

    One row a document: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.
    Equal texts have equal values; a null doc_id and repeated rows are documents of their own; a very long text is one
    media, held whole by one task; other columns play no part; no rows give no rows.
    """
    return read_back(*store(docs)).drop("media_id")


def op10(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return media_columns(docs)
