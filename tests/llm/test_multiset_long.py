from aeropanel.llm.multiset import MultisetHash


def test_many_repeats_do_not_wrap():
    whole, half = MultisetHash.of("word " * 100_000), MultisetHash.of("word " * 50_000)
    assert whole.likeness(half) > 0.99
    assert (MultisetHash.of("a\n" + "word " * 100_000) - MultisetHash.of("a")).likeness(whole) == 1
