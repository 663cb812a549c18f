import math
import random

import numpy as np
import pytest

from aeropanel.llm import language

from .fixtures import frame


def test_filter_grows_with_its_trigrams(spark):
    rng = random.Random(4)
    text = lambda n, a: " ".join("".join(chr(a + rng.randrange(60)) for _ in range(6)) for _ in range(n))
    rows = [(i, text(500, 0x4E00), "zh", "a", 1, "x", "y", "z") for i in range(20)] + [(100 + i, text(20, 0x430), "ru", "a", 1, "x", "y", "z") for i in range(5)]
    model = language.learn(frame(spark, rows), cells=1 << 10)
    grams = len(np.unique(language.trigrams([r[1] for r in rows[:20]])[0]))
    assert model.cells == 1 << math.ceil(math.log2(16 * grams))
    table = model.table()
    assert ((table & np.uint64(1)) != 0).mean() < 0.2
    assert model.predict([text(30, 0x4E00), text(30, 0x430)], table)[0] == ["zh", "ru"]


def test_size_of_many_trigrams():
    assert language.cells_for(1) == 1 << 20 and language.cells_for(1_000_000) == language.cells_for(12_000_000) == 1 << 24
    with pytest.raises(ValueError, match="cells"):
        language.cells_for(20_000_000)


def test_rare_trigrams_leave_room_at_any_size(spark):
    assert 1 - math.exp(-language.HASHES * language.RARE / language.cells_for(language.RARE)) < 0.6
    rng = random.Random(5)
    noise = " ".join("".join(chr(0x4E00 + rng.randrange(9000)) for _ in range(8)) for _ in range(1500))
    rows = [(i, "the same words again and again " * 60, "en", "a", 1, "x", "y", "z") for i in range(20)] + [(50, noise, "en", "a", 1, "x", "y", "z")]
    few, all_grams = (language.learn(frame(spark, rows), rare=n) for n in (3000, 1 << 22))
    assert len(few.cell) < 200 < 5000 < len(all_grams.cell)
