"""Files of many sites and years from a remote archive as a Spark data source: a partition a file, fetched on the executors."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .readers import unpack_hourly_json
from .shared import discard, materialize
from .sinks import append_new, missing, read_cells

FETCHED = "site string, year int, url string, content binary, error string"
KEPT = "site string, year int, url string, content binary"


class Archive(DataSource):
    """``spark.read.format("archive")``: the file of each (site, year) as a row.

    Options: ``files``, a JSON list of [site, year]; ``url``, with {site} and {year}; ``retries`` (4), tries in all;
    ``wait`` (2) and ``grow`` (3), seconds before the second try and what each further wait has more; ``timeout`` (180) in
    seconds. A file that isn't got by then has a null content and says why in ``error``; an answer of 404 or 410 isn't tried
    again. A task that Spark runs again fetches its file again and gives the same row.
    """

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return FETCHED

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.files, self.url = json.loads(options["files"]), options["url"]
        self.retries, self.timeout = int(options.get("retries", 4)), float(options.get("timeout", 180))
        self.wait, self.grow = float(options.get("wait", 2)), float(options.get("grow", 3))
        if self.retries < 1:
            raise ValueError("retries has to be 1 or more")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((site, int(year))) for site, year in self.files]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        site, year = partition.value
        url, error = self.url.format(site=site, year=year), None
        for attempt in range(self.retries):
            if attempt:
                time.sleep(self.wait + self.grow * (attempt - 1))
            try:
                with urllib.request.urlopen(url, timeout=self.timeout) as answer:
                    yield site, year, url, answer.read(), None
                    return
            except urllib.error.HTTPError as why:
                error = f"HTTP {why.code}"
                if why.code in (404, 410):
                    break
            except OSError as why:
                error = repr(why)
        yield site, year, url, None, error


def pull(spark: SparkSession, url: str, wanted: DataFrame, path: str, **options: str) -> DataFrame:
    """Fetches the files of ``wanted(site, year)`` that the table at ``path`` doesn't have and appends them; those that failed, with their errors.

    What is there isn't fetched again, so a pull that failed in part, or died, is repeated as it is. Files are listed
    by the driver: a row a site and year, not their contents.
    """
    spark.dataSource.register(Archive)
    left = missing(wanted.select(F.col("site").cast("string").alias("site"), F.col("year").cast("int").alias("year")).distinct(), path, ["site", "year"])
    files = [[r["site"], r["year"]] for r in left.collect()]
    if not files:
        return spark.createDataFrame([], "site string, year int, error string")
    got = materialize(spark.read.format("archive").options(files=json.dumps(files), url=url, **options).load(), "fetched")  # once
    append_new(got.where("error is null").drop("error"), path, ["site", "year"], f"pull-{uuid.uuid4().hex}")
    failed = [tuple(r) for r in got.where("error is not null").select("site", "year", "error").collect()]
    discard(got)
    return spark.createDataFrame(failed, "site string, year int, error string")


def hourly_weather(spark: SparkSession, path: str) -> DataFrame:
    """The hours of all pulled JSON files: (site, year, ts, weather, wind components)."""
    rows = read_cells(spark, path, KEPT)
    return unpack_hourly_json(rows.select("site", "year", F.col("content").cast("string").alias("payload")))
