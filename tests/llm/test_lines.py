import random
import re
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from aeropanel.llm import lines

from .fixtures import documents, frame


def corpus():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(3, 6)))
    rows = []
    passage = " ".join(word() for _ in range(60))
    for i in range(60):
        own = [" ".join(word() for _ in range(rng.randint(1, 25))) for _ in range(rng.randint(1, 5))]
        if i % 3 == 0:
            own.insert(rng.randrange(len(own) + 1), f"Page {i} of {i * 7} was seen on 2024-01-{i % 28:02}")
        if i % 4 == 0:
            own.append(passage)
        if i % 5 == 0:
            own.append(f"Sent to {word()} by the office in the north part of town")
        rows.append((1000 - i, "\n".join(own), "en", "a", 1, "x", "y", "z"))
    return rows


def tokens_of(line):
    return ["<*>" if re.search("[0-9@]|://", t) else t for t in re.findall(r"[^\x20\x09-\x0D]+", line)]


def brute(rows, least=0.8, min_tokens=3):
    docs = {(r[0], r[1]): r for r in rows if r[1]}
    found = []
    for doc_id, text in sorted(docs, key=lambda k: (k[0] is None, k[0] or 0)):
        for i, line in enumerate(text.split("\n")):
            t, leaf = template(line)
            if len(t) >= min_tokens:
                found.append((doc_id, text, i, t, leaf))
    leaves = defaultdict(set)
    for f in found:
        leaves[f[4]].add(f[3])
    of = {t: t for f in found for t in [f[3]]}

    def root(t):
        while of[t] != t:
            t = of[t]
        return t

    for texts in leaves.values():
        for a in texts:
            for b in texts:
                if a < b and sum(x == y for x, y in zip(a, b)) >= least * len(a) - 1e-9:
                    of[root(b)] = root(a)
    groups = defaultdict(list)
    for f in found:
        groups[root(f[3])].append(f)
    gone = defaultdict(set)
    for own in groups.values():
        if len({f[:2] for f in own}) > 1:
            for f in own[1:]:
                gone[f[:2]].add(f[2])
    return {k: "\n".join(x for i, x in enumerate(k[1].split("\n")) if i not in gone[k]) for k in docs}


def test_templates_are_those_of_brute_force(spark):
    rows = corpus()
    got = {r["doc_id"]: r["text"] for r in lines.op3(frame(spark, rows)).collect()}
    want = brute(rows)
    assert got == {k[0]: v for k, v in want.items()}
    text = "\n".join(got.values())
    assert text.count("Page ") == 1 and text.count("Sent to") == 1


def test_alike_lines_of_a_busy_leaf_meet(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(7))
    own = [["from", "the", word(), word(), word()] for _ in range(80)]
    own += [[*line[:-1], word()] for line in own[:20]] + [[*line[:2], word(), *line[3:]] for line in own[20:40]]
    rng.shuffle(own)
    rows = [(i, " ".join(line), "en", "a", 1, "x", "y", "z") for i, line in enumerate(own)]
    got = {r["doc_id"]: r["text"] for r in lines.op3(frame(spark, rows)).collect()}
    assert got == {k[0]: v for k, v in brute(rows).items()}
    assert sum(not t for t in got.values()) == 40


def template(line):
    """(tokens, leaf) of a line, a token at a time."""
    tokens, raw = tokens_of(line), re.findall(r"[^\x20\x09-\x0D]+", line)
    fields = tokens.count("<*>")
    if fields and len(tokens) - fields < 2:
        return (*raw,), (len(raw), *raw, None)
    return (*tokens,), (len(tokens), *tokens[: 2 if len(tokens) >= 3 else len(tokens)])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "ab", "é", "12", "x1", "@", "a://b", ":", "//", " ", "  ", "\t", "\n", "\x0b", "\x1c", "\xa0", "全文"]), max_size=40))
def test_parsed_lines_are_those_of_tokens(parts):
    text = "".join(parts)
    n, leaf, line, marks, bounds = lines.parse_lines(text.encode())
    own = [template(x) for x in text.split("\n")]
    assert n.tolist() == [len(t) for t, _ in own] and bounds[-1] == len(marks)
    for i, (t, k) in enumerate(own):
        for j, (u, m) in enumerate(own[:i]):
            assert (line[i] == line[j]) == (t == u) and (not t or not u or (leaf[i] == leaf[j]) == (k == m or (t == u)))
            if len(t) == len(u):
                same = marks[bounds[i] : bounds[i + 1]] == marks[bounds[j] : bounds[j + 1]]
                assert same.tolist() == [x == y for x, y in zip(t, u)]


def test_long_texts_are_parsed_in_pieces():
    text = b"\n".join(b"line %d of many" % i for i in range(500)) + b"\n" + b"x" * 3000 + b"\n\nend"
    for most in (1, 100, 2000, 1 << 20):
        pieces = list(lines._pieces(text, most))
        assert b"\n".join(pieces) == text and (most > 2000 or len(pieces) > 5)


def test_hard_rows(spark):
    rows = documents()
    out = lines.drop_repeated(frame(spark, rows))
    got = [(r["doc_id"], r["text"], r["bucket"]) for r in out.collect()]
    assert len(got) == len(rows) and out.columns == [*frame(spark, []).columns, "lines_dropped"]
    want = brute(rows)
    assert sorted(map(str, [(r[0], want.get((r[0], r[1]), r[1]), r[5]) for r in rows])) == sorted(map(str, got))
    assert lines.op3(frame(spark, [])).collect() == []


def test_two_constants_make_a_template(spark):
    rows = [(1, "GET /a/1 200 12ms from 10.0.0.1\n1 2 3"), (2, "GET /b/2 404 99ms from 10.0.0.9\n1 2 4"), (3, "GET /b/2 404 99ms to 10.0.0.9\nPUT /a/1 200 12ms from 10.0.0.1")]
    got = {r["doc_id"]: r["text"] for r in lines.op3(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # of 6 tokens one may differ, but not the leading two, which name the leaf; rows of numbers are no template
    assert got == {1: rows[0][1], 2: "1 2 4", 3: "PUT /a/1 200 12ms from 10.0.0.1"}
