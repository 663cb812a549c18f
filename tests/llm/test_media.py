import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from aeropanel.llm import media

from .fixtures import documents, frame


def slow_cut(payload):
    out, at = [], 0
    while len(payload) - at > media.LEAST:
        h, end = 0, min(at + media.MOST, len(payload))
        for i in range(at, end):
            h = (h << 1) + int(media._GEAR[payload[i]]) & 0xFFFF
            if i + 1 - at >= media.LEAST and h & int(media._MASK) == 0:
                end = i + 1
                break
        out.append(payload[at:end])
        at = end
    return out + ([payload[at:]] if at < len(payload) else [])


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40_000))
def test_cuts_are_those_of_the_rolling_hash(seed, n):
    payload = random.Random(seed).randbytes(n)
    assert media.cut(payload) == slow_cut(payload)
    wav = media.wav_header(n) + payload
    assert media.wav_payload(wav) == payload


def test_an_insertion_changes_few_chunks():
    payload = random.Random(5).randbytes(200_000)
    before, after = set(media.cut(payload)), set(media.cut(payload[:100_000] + b"more" + payload[100_000:]))
    assert len(before - after) <= 3


def test_round_trip(spark):
    rows = documents()
    long = " ".join(str(random.Random(1).random()) for _ in range(3000))
    rows += [(4000 + i, long[: 20_000 + 3000 * i], "en", "a", 1, "x", "y", "z") for i in range(5)]
    got = sorted((tuple(str(r[k]) for k in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")) for r in media.op10(frame(spark, rows)).collect()))
    want = []
    for doc_id, text, *_ in rows:
        raw = (text or "").encode()
        p = raw + bytes(-len(raw) % 64 if raw else 64)
        wav = media.wav_header(len(p)) + p
        want.append(tuple(map(str, (doc_id, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(wav), hashlib.sha256(wav).hexdigest(), media.samples_feature(p)))))
    assert got == sorted(want)


def test_store_keeps_a_shared_chunk_once(spark):
    body = random.Random(2).randbytes(30_000).hex()
    rows = [(i, body + "x" * i, "en", "a", 1, "x", "y", "z") for i in range(6)]
    _, chunks = media.store(frame(spark, rows))
    kept = chunks.collect()
    assert len({r["digest"] for r in kept}) == len(kept) and sum(len(r["bytes"]) for r in kept) < 1.2 * len(body)


def test_a_second_batch_is_deduplicated_against_the_first(spark):
    body = random.Random(3).randbytes(25_000).hex()
    first = media.store(frame(spark, [(1, body, "en", "a", 1, "x", "y", "z"), (2, "short", "en", "a", 1, "x", "y", "z")]))
    assert first[1].count() == 0  # every chunk is in a pack
    rows = [(3, body + "more of it", "en", "a", 1, "x", "y", "z"), (4, body[:30_000], "en", "a", 1, "x", "y", "z"), (5, "new", "en", "a", 1, "x", "y", "z")]
    second = media.store(frame(spark, rows), first)
    stored = sum(len(r["bytes"]) for r in media.all_chunks(*second).collect())
    assert stored < 20_000 < len(body)
    old = {r["digest"] for r in media.all_chunks(*first).collect()}
    assert not old & {r["digest"] for r in media.all_chunks(*second).collect()}
    got = {r["doc_id"]: r["payload_sha256"] for r in media.read_back(second[0], media.all_chunks(*first).unionByName(second[1])).collect()}
    assert got == {r[0]: hashlib.sha256(media.payload_of(r[1].encode())).hexdigest() for r in rows}


def test_every_media_follows_its_chunk_list(spark):
    rows = [(1, random.Random(4).randbytes(9000).hex(), "en", "a", 1, "x", "y", "z")]
    table, chunks = media.store(frame(spark, rows))
    row = table.collect()[0]
    recipe = [r.asDict() for r in row["recipe"]]
    assert len(recipe) > 2 and media.rebuild(bytes(row["header"]), recipe, bytes(row["pack"]), {})[44:] == media.payload_of(rows[0][1].encode())
    with pytest.raises(ValueError):
        media.rebuild(bytes(row["header"]), recipe[::-1], bytes(row["pack"]), {})


def test_empty(spark):
    assert media.op10(frame(spark, [])).collect() == []


def test_media_of_many_chunks_of_their_own_stay_packed(spark):
    texts = [random.Random(i).randbytes(100_000).hex() for i in range(12)]
    copied = [random.Random(100 + i).randbytes(150).hex() for i in range(500)]
    rows = [(i, t, "en", "a", 1, "x", "y", "z") for i, t in enumerate(texts + copied + copied)]
    table, chunks = media.store(frame(spark, rows))
    assert chunks.count() <= 510 and "loose" not in table.columns
    assert table.where("doc_id < 12 and exists(recipe, c -> c.loose)").count() <= 6
