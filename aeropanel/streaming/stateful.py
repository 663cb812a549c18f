"""Streams with state: hourly series filled and averaged as rows arrive, sliding and session windows, a sink that may repeat."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.cache import exists

HOUR = 3_600_000  # milliseconds
FILLED = "station string, ts timestamp, v double, ff double, mean double"


def filled_means(rows: DataFrame, late: str = "3 hours", hours: int = 24) -> DataFrame:
    """(station, ts, v, ff, mean) for every hour of a stream ``rows(station, ts, v)``: the last value so far and its mean over the last ``hours``.

    A station's rows may come in any order up to ``late`` behind the newest row of all; later ones are passed over, of
    two of one hour the last to come counts. An hour is put out once, when the watermark has passed it: in order, gaps
    too, from the station's first hour on. A timer brings hours out for stations that are silent, so what is out follows from
    the rows and the watermark, not from how they were cut into batches. The state
    of a station is the rows that wait and its last ``hours`` values, whatever the stream's length.
    """

    def step(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        upto, ff, past, waiting = state.get if state.exists else (None, None, [], [])
        held = {at: v for at, v in waiting}
        for frame in frames:
            for at, v in zip(frame["ms"].tolist(), frame["v"].tolist()):
                if upto is None or at > upto:
                    held[at] = None if pd.isna(v) else v
        mark = state.getCurrentWatermarkMs() // HOUR * HOUR - HOUR  # hours that end by the watermark
        out, past = [], list(past)
        if held or upto is not None:
            at = min(held) if upto is None else upto + HOUR
            while at <= mark:
                v = held.pop(at, None)
                ff = v if v is not None else ff
                past = [*past, ff][-hours:]
                known = [x for x in past if x is not None]
                out.append((key[0], pd.Timestamp(at, unit="ms", tz="UTC"), v, ff, sum(known) / len(known) if known else None))
                upto, at = at, at + HOUR
        state.update((upto, ff, past, sorted(held.items())))
        if held or upto is not None:  # come back when the next hour is over
            state.setTimeoutTimestamp((min(held) if upto is None else upto + HOUR) + HOUR)
        if out:
            yield pd.DataFrame(out, columns=["station", "ts", "v", "ff", "mean"])

    timed = rows.select("station", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts"), F.col("v").cast("double").alias("v")).withWatermark("ts", late)
    keyed = timed.select("station", "ts", (F.unix_millis("ts")).alias("ms"), "v")
    state = "upto long, ff double, past array<double>, waiting array<struct<ms:long,v:double>>"
    return keyed.groupBy("station").applyInPandasWithState(step, FILLED, state, "append", GroupStateTimeout.EventTimeTimeout)


def sliding_means(events: DataFrame, width: str = "24 hours", slide: str = "6 hours", late: str = "3 hours") -> DataFrame:
    """(station, since, until, n, mean) of overlapping windows of a stream or a table of events."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    by = timed.groupBy(F.window("at", width, slide).alias("w"), F.col("event_type").alias("station")).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return by.select("station", F.col("w.start").alias("since"), F.col("w.end").alias("until"), "n", "mean")


def sessions(events: DataFrame, key: str = "user_id", gap: str = "2 hours", late: str = "3 hours") -> DataFrame:
    """(key, since, until, n, total): runs of a key's events with less than ``gap`` between them; ``until`` is the last event plus the gap."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    by = timed.groupBy(F.session_window("at", gap).alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return by.select(key, F.col("w.start").alias("since"), F.col("w.end").alias("until"), "n", "total")


def start(stream: DataFrame, path: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Runs a stream into ``path``; with ``once`` over what there is now, else until stopped.

    Every batch is a folder named by its number, written whole in place of any earlier try: a batch that is repeated
    after a failure leaves its rows once, and a restart from ``checkpoint`` goes on where the last one ended.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(put)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows that ``start`` has put; none where nothing ran yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
