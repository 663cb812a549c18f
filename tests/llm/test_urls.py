import datetime
import random

from aeropanel.llm import urls

D = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(n)


def keys_of(url):
    rest = url.split("://", 1)[1]
    host = rest.split("/")[0].split("?")[0].split("#")[0].split("@")[-1].split(":")[0].lower().rstrip(".")
    path = rest[len(rest.split("/")[0].split("?")[0].split("#")[0]):].split("?")[0].split("#")[0] or "/"
    labels = host.split(".")
    return [host + path, host + "/" + path.split("/")[1]] + [".".join(labels[i:]) for i in range(1 if host.replace(".", "").isdigit() else max(1, len(labels) - 1))]


def test_as_of_is_brute_force(spark):
    rng = random.Random(1)
    pool = [f"http://{h}{p}" for h in ("a.b.example.com", "U@B.example.com:80", "x.org.", "localhost", "10.2.3.4") for p in ("", "/", "/p/q?x=1", "/p#f")]
    captures = [(i % 50, rng.choice(pool), D(rng.randrange(30)), "c", "d") for i in range(200)]
    captures += [(900, None, D(1), "c", "d"), (901, "no url", D(1), "c", "d"), (902, pool[0], None, "c", "d"), (None, pool[0], D(3), "c", "d")]
    keys = sorted({k for u in pool for k in keys_of(u)})
    entries = [(rng.choice(keys), rng.random() < 0.6, D(rng.randrange(30))) for _ in range(30)] + [(None, True, D(0)), (keys[0], True, None)]
    state = {}
    for k, added, day in entries:
        if k and day:
            state.setdefault(k, {})[day] = state.get(k, {}).get(day, False) or added

    def verdict(url, at):
        if not url or "://" not in url or at is None:
            return False, None
        for k in keys_of(url):
            past = [d for d in state.get(k, {}) if d <= at]
            if past and state[k][max(past)]:
                return True, k
        return False, None

    cap = spark.createDataFrame(captures, "id long, url string, fetched date, key string, _matched_key string")
    ent = spark.createDataFrame(entries, "key string, added boolean, dated date")
    got = urls.as_of(cap, urls.validity(ent)).collect()
    want = sorted((str(i), str(u), str(t), *map(str, verdict(u, t))) for i, u, t, *_ in captures)
    assert want == sorted((str(r["id"]), str(r["url"]), str(r["fetched"]), str(r["blocked"]), str(r["matched_key"])) for r in got)
    for r in got:
        if r["blocked"]:
            assert state[r["matched_key"]][r["listed_since"]]


def test_native_and_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.example.com/x", "h"), (None, None, None)], "page_id long, url string, html string")
    out = urls.op4(pages)
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and len(out.collect()) == 2
    assert urls.op4(pages.limit(0)).collect() == []


def test_clashing_and_repeated_rows(spark):
    rows = [(1, "http://a.example.com/x", D(3), "mine"), (1, "http://a.example.com/x", D(3), "mine"), (2, "http://b.org", D(3), None)]
    captures = spark.createDataFrame(rows, "id long, url string, fetched date, Blocked string")
    lists = urls.validity(spark.createDataFrame([("example.com", True, D(1))], "key string, added boolean, dated date"))
    out = urls.as_of(captures, lists)
    assert out.columns == ["id", "url", "fetched", "Blocked", "_blocked", "_matched_key", "_listed_since"]
    assert sorted((r[0], str(r[3]), r[4]) for r in out.collect()) == [(1, "mine", True), (1, "mine", True), (2, "None", False)]
    assert urls.as_of(captures.limit(0), lists).collect() == []
    assert not any(r["_blocked"] for r in urls.as_of(captures, lists.limit(0)).collect())


def test_equals_sql_on_repeated_pages(spark):
    import duckdb
    import pyarrow as pa

    rng = random.Random(2)
    pages = [(rng.randrange(40), f"http://{rng.choice(['a', 'b.c', 'd'])}.site{rng.randrange(60)}.{rng.choice(['org', 'com'])}/{rng.choice('pq')}/{rng.randrange(3)}", "h") for _ in range(300)]
    pages += [(7, "http://10.1.2.3/x", "h"), (7, "https://[::1]/x", "h"), (8, None, "h"), (8, "nothing", "h"), pages[0]]
    con = duckdb.connect()
    con.register("pages", pa.table({"page_id": pa.array([p[0] for p in pages]), "url": [p[1] for p in pages], "html": [p[2] for p in pages]}))
    want = con.sql(urls.ORACLE)
    out = urls.op4(spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r[c] for c in want.columns)) for r in out.collect())
