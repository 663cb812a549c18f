import random
import zlib

import numpy as np

from aeropanel.llm import language

from .fixtures import frame


def slow_trigrams(text):
    t = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    return sorted(ord(t[i - 1]) | ord(t[i]) << 21 | ord(t[i + 1]) << 42 for i in range(1, len(t) - 1) if t[i] != " ")


def test_trigrams_by_text():
    texts = ["The café, a!", "", "12 \U0001d4d0b \U00020001", "x"]
    keys, bounds = language.trigrams(texts)
    assert [sorted(keys[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:])] == [slow_trigrams(t) for t in texts]


def corpus(n=240):
    rng = random.Random(8)
    parts = {"en": ["th", "ing", "er", "and"], "fr": ["eau", "ette", "oi", "qu"], "de": ["sch", "ung", "ei", "tz"]}
    rows = []
    for i in range(n):
        lang = rng.choice(list(parts))
        text = " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 60)))
        rows.append((i, text, lang if i % 9 else None, "a", 1, lang, "y", "z"))
    return rows


def test_held_out_accuracy_and_no_lost_gram(spark):
    rows = corpus()
    got = {r["doc_id"]: r for r in language.op7(frame(spark, rows)).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert all(got[r[0]]["held_out"] == (r in held) for r in rows)
    assert np.mean([got[r[0]]["lang_pred"] == r[5] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())
    model = language.learn(frame(spark, rows), share=0.0)
    table = model.table()
    for _, text, lang, *_ in rows:
        if lang:
            at = language.cells_of(language.trigrams([text])[0], model.cells)
            found = table[0][at[0]] & table[0][at[1]] & table[0][at[2]]
            assert (found >> np.uint64(model.languages.index(lang)) & np.uint64(1)).all()


def slow_cells(key, cells):
    """The cells of one trigram, by whole numbers."""
    word = (1 << 64) - 1
    x = (key ^ (key >> 31)) * 0x9E3779B97F4A7C15 & word
    x ^= x >> 29
    return [(x * m & word) >> (64 - cells.bit_length() + 1) for m in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD)]


def slow_predictions(rows, cells, share=0.5, rare=1 << 22):
    """From counts to scores, a trigram at a time."""
    counts = {}
    for doc_id, text, lang, *_ in rows:
        if text is not None and lang is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5:
            for g in slow_trigrams(text):
                counts.setdefault(lang, {}).setdefault(g, 0)
                counts[lang][g] += 1
    total = {k: sum(v.values()) for k, v in counts.items()}
    languages = sorted(total, key=lambda k: (-total[k], k))
    often = {k: {g: n / total[k] for g, n in v.items() if n * rare >= total[k]} for k, v in counts.items()}
    set_cells = {k: set() for k in languages}
    for k in languages:
        for g, f in often[k].items():
            if f >= share * max(often[o].get(g, 0) for o in languages):
                set_cells[k].update(slow_cells(g, cells))
    out = []
    for doc_id, text, *_ in rows:
        grams = slow_trigrams(text or "")
        hits = []
        for k in languages:
            wrong = (len(set_cells[k]) / cells) ** 3
            hits.append(max(0.0, (sum(all(c in set_cells[k] for c in slow_cells(g, cells)) for g in grams) - len(grams) * wrong) / max(1e-9, 1 - wrong)))
        best = max(range(len(languages)), key=lambda i: hits[i])
        out.append((str(doc_id), languages[best] if grams else "und", round(hits[best] / max(sum(hits), 1e-9), 6) if grams else 0.0))
    return sorted(out)


def test_predictions_are_those_of_brute_force(spark):
    rows = corpus(90) + [(900, None, "en", None, None, None, None, None), (901, "12 !", "en", "a", 1, "x", "y", "z"), (None, "thing", None, "a", 1, "x", "y", "z"), (902, "zz qq xx", None, "a", 1, "x", "y", "z"), (902, "zz qq xx", None, "a", 1, "x", "y", "z")]
    docs = frame(spark, rows)
    own = docs.where(language.fold("doc_id", 5) != 0)
    for rare in (1 << 22, 150):
        model = language.learn(own, rare=rare)
        assert model.cells == 1 << 20
        got = sorted((str(r["doc_id"]), r["lang_pred"], round(r["score"], 6)) for r in language.identify(docs, model).collect())
        assert got == slow_predictions(rows, 1 << 20, rare=rare)
    assert sorted((str(r["doc_id"]), r["lang_pred"], round(r["score"], 6)) for r in language.op7(docs).collect()) == slow_predictions(rows, 1 << 20)


def test_many_languages_use_more_words(spark):
    rows = [(i, chr(0x4E00 + 40 * (i % 70)) * 6, f"l{i % 70:02}", "a", 1, "x", "y", "z") for i in range(700)]
    got = language.op7(frame(spark, rows)).collect()
    assert all(r["lang_pred"] == f"l{r['doc_id'] % 70:02}" for r in got)


def test_hard_rows(spark):
    rows = corpus(40) + [(900, None, "en", None, None, None, None, None), (901, "12 !", "en", "a", 1, "x", "y", "z"), (None, "thing", None, "a", 1, "x", "y", "z"), (None, "thing", None, "a", 1, "x", "y", "z")]
    got = language.op7(frame(spark, rows)).collect()
    assert len(got) == 44 and {r["doc_id"]: r["lang_pred"] for r in got}[900] == "und" == {r["doc_id"]: r["lang_pred"] for r in got}[901]
    assert language.op7(frame(spark, [])).collect() == []
    assert {r["lang_pred"] for r in language.op7(frame(spark, [(1, "abc", None, "a", 1, "x", "y", "z")])).collect()} == {"und"}
