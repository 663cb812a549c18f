import functools
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from aeropanel.llm import packing

from .fixtures import documents, frame


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


def whole(text):
    return tokenizer().encode(text, add_special_tokens=False).ids


@functools.cache
def known_words():
    return packing._Words(packing.default_tokenizer())


def by_words(text):
    words = known_words()
    assert words.simple
    return np.frombuffer(b"".join(words[w] for w in text.encode().split()), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdefghiABCéèñüßÉÜtheingon.,!'ɏłŉİıȲ×÷"), min_size=1, max_size=14))
def test_letters_with_signs(text):
    assert by_words(text) == whole(text)


MARKS = ["<|startoftext|>", "<|endoftext|>", "<|STARTOFTEXT|>", "x<|endoftext|>y", "<|endoftext|>\n", "<| endoftext|>", "<|endoftext|", "'s", "don't", "e\u0301", "\u0301x", "İß", "ΑΣ", "\n", "\x0b", "\x1c", "\x85", "\u3000", "\xa0"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(MARKS), st.text(alphabet=st.sampled_from("aAé'sStTΣς 1 \t\n\x0b\x1c\x85 \u3000\u0301.!|<>endofxтİßheingéèñü"), max_size=14)), max_size=12), st.sampled_from(["", " "]))
def test_words_give_the_ids_of_whole_texts(parts, between):
    text = between.join(parts)
    assert by_words(text) == whole(text)


def test_special_marks_are_one_id():
    assert whole("<|startoftext|> x<|startoftext|>y") == by_words("<|startoftext|> x<|startoftext|>y") and whole("<|startoftext|>") == [49406]


def test_words_are_forgotten():
    words = packing._Words(packing.default_tokenizer(), most=3)
    for text in ("a b. c D", "d e F a", "one, two; three"):
        assert np.frombuffer(b"".join(words[w] for w in text.encode().split()), "<u4").tolist() == whole(text)
    assert len(words) <= 3


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 24), st.integers(1, 6), min_size=1, max_size=6))
def test_window_is_as_full_as_any_with_the_longest(counts):
    window = packing.fill_window(counts, 24)
    assert all(k <= counts[s] for s, k in window) and window[0][0] == max(counts)
    reach = {0}
    for s, c in counts.items():
        reach = {x + k * s for x in reach for k in range(c + 1 - (s == max(counts))) if x + k * s <= 24}
    assert sum(s * k for s, k in window) == max(x + max(counts) for x in reach if x + max(counts) <= 24)
    used = defaultdict(int)
    for times, w in packing.plan_windows(counts, 24):
        for s, k in w:
            used[s] += times * k
    assert used == counts


def test_every_id_lies_in_one_piece(spark):
    docs = frame(spark)
    rows = packing.op6(docs).collect()
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    want = defaultdict(list)
    for doc_id, text, *_ in documents():
        ids = [*whole(text or ""), 1]
        for at in range(0, len(ids), 2048):
            want[doc_id].append((at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes()), len(ids)))
    assert {k: sorted(v) for k, v in want.items()} == {k: sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in v) for k, v in by.items()}
    total = sum(r["length"] for r in rows)
    assert len(places) <= -(-total // 2048) + 1


def test_sequences_hold_the_ids(spark):
    docs = frame(spark, documents(12)[:12])
    ids = sorted(x for r in packing.sequences(docs).collect() for x in r["ids"])
    assert ids == sorted(x for _, text, *_ in documents(12)[:12] for x in [*whole(text), 1])


def test_empty(spark):
    assert packing.op6(frame(spark, [])).collect() == []
