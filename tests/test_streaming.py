"""Streams that run: state across batches and restarts, late rows, silent stations, repeated batches, windows equal to batch."""

import datetime as dt
import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from aeropanel.streaming import hourly, stateful

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "station string, ts timestamp_ntz, v double"


class Feed:
    """A folder that a stream reads, a file a batch."""

    def __init__(self, spark, folder, schema=SCHEMA):
        self.spark, self.folder, self.schema, self.n = spark, folder, schema, 0
        os.makedirs(folder)

    def add(self, rows):
        aside = f"{self.folder}-aside-{self.n}"
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(aside)
        part = next(p for p in os.listdir(aside) if p.endswith(".parquet"))
        os.rename(f"{aside}/{part}", f"{self.folder}/{self.n:04}.parquet")
        os.utime(f"{self.folder}/{self.n:04}.parquet", (1e9 + self.n,) * 2)  # read in this order
        self.n += 1

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.folder)


def at(h, station="a", v=None):
    return (station, T0 + dt.timedelta(hours=h), None if v is None else float(v))


def expected(values, last, hours=24):
    """{hour: (v, ff, mean)} up to ``last`` of {hour: value}."""
    out, ff, past = {}, None, []
    for h in range(min(values), last + 1):
        ff = values.get(h) if values.get(h) is not None else ff
        past = [*past, ff][-hours:]
        known = [x for x in past if x is not None]
        out[h] = (values.get(h), ff, pytest.approx(sum(known) / len(known)) if known else None)
    return out


def put_out(spark, path):
    rows = stateful.read_batches(spark, path, stateful.FILLED).collect()
    got = {}
    for r in rows:
        key = (r["station"], int((r["ts"] - T0).total_seconds() // 3600))
        assert key not in got  # each hour once
        got[key] = (r["v"], r["ff"], r["mean"])
    return got


def run(feed, tmp_path):
    q = stateful.start(stateful.filled_means(feed.stream()), f"{tmp_path}/out", f"{tmp_path}/state")
    q.awaitTermination()
    assert q.exception() is None


def test_fill_and_mean_over_batches_restarts_and_late_rows(spark, tmp_path):
    feed = Feed(spark, f"{tmp_path}/in")
    feed.add([at(2, v=5), at(0, v=1), at(5, v=2), at(1, "b", 7)])
    feed.add([at(4, v=None), at(3, v=9), at(10, v=3)])  # 3 and 4 come within three hours of 5
    run(feed, tmp_path)
    before = put_out(spark, f"{tmp_path}/out")
    a = {0: 1.0, 2: 5.0, 3: 9.0, 5: 2.0, 10: 3.0}
    assert before == {**{("a", h): x for h, x in expected(a, 6).items()}, **{("b", h): x for h, x in expected({1: 7.0}, 6).items()}}  # a timer brings out the hours of b, which is silent
    feed.add([at(2, v=99), at(8, v=4)])  # 2 is put out already: too late; 8 isn't
    feed.add([at(40, v=6), at(40, "b", 8)])
    run(feed, tmp_path)  # from the checkpoint
    after = put_out(spark, f"{tmp_path}/out")
    a |= {8: 4.0, 40: 6.0}
    want = {**{("a", h): x for h, x in expected(a, 36).items()}, **{("b", h): x for h, x in expected({1: 7.0, 40: 8.0}, 36).items()}}
    assert after == want and before.items() <= after.items()


def test_a_batch_that_is_repeated_leaves_its_rows_once(spark, tmp_path):
    feed = Feed(spark, f"{tmp_path}/in")
    for h in range(0, 30, 5):
        feed.add([at(h + k, v=h + k) for k in range(5)])
    run(feed, tmp_path)
    whole = put_out(spark, f"{tmp_path}/out")
    numbers = sorted(int(n) for n in os.listdir(f"{tmp_path}/state/commits") if n.isdigit())
    os.remove(f"{tmp_path}/state/commits/{numbers[-1]}")  # as if the run had died after the sink, before the commit
    crc = f"{tmp_path}/state/commits/.{numbers[-1]}.crc"
    if os.path.exists(crc):
        os.remove(crc)
    run(feed, tmp_path)
    assert put_out(spark, f"{tmp_path}/out") == whole and whole


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


@pytest.mark.parametrize("plan", [stateful.sliding_means, stateful.sessions, hourly.tumbling_hours])
def test_windows_of_a_stream_equal_those_of_the_table(spark, tmp_path, plan):
    rows = [(i, T0 + dt.timedelta(minutes=37 * i + (i * 7919) % 50), i % 4, "xyz"[i % 3], float(i % 11)) for i in range(120)]
    rows.append((999, T0 + dt.timedelta(days=30), 77, "end", 0.0))  # closes all windows before it
    feed = Feed(spark, f"{tmp_path}/in", EVENTS)
    for k in range(0, len(rows), 30):
        feed.add(rows[k : k + 30])
    stateful.start(plan(feed.stream()), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    table = plan(spark.createDataFrame(rows, EVENTS))
    got = stateful.read_batches(spark, f"{tmp_path}/out", table.schema.simpleString()[7:-1].replace(":", " "))
    text = lambda d: sorted(json.dumps([str(x) for x in r]) for r in d.collect() if not {"end", 77} & set(r))
    assert text(got) == text(table) and len(text(got)) > 5


def test_append_to_files(spark, tmp_path):
    feed = Feed(spark, f"{tmp_path}/in", EVENTS)
    feed.add([(i, T0 + dt.timedelta(minutes=20 * i), 1, "x", 1.0) for i in range(30)])
    feed.add([(99, T0 + dt.timedelta(days=2), 1, "x", 1.0)])
    q = hourly.append_to(feed.stream(), f"{tmp_path}/out", f"{tmp_path}/state")
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(f"{tmp_path}/out").agg(F.sum("n")).first()[0] == 30
    shutil.rmtree(f"{tmp_path}/out")
