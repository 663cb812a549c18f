"""Results kept by what they were made from: a digest of the data and of the settings names each table."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

LANES = 2


def _told_apart(column: Column, kind: DataType) -> list[Column]:
    """What a hash has to read of a column so that unlike values differ: hashes pass over nulls, in arrays and structs too, and don't take maps."""
    if isinstance(kind, MapType):
        return [column.isNull(), F.to_json(F.array_sort(F.map_entries(column)), {"ignoreNullFields": "false"})]
    if isinstance(kind, (ArrayType, StructType)):
        return [column.isNull(), F.to_json(column, {"ignoreNullFields": "false"})]
    if isinstance(kind, VariantType):
        return [column.isNull(), F.to_json(column)]
    return [column.isNull(), column]


def table_digest(df: DataFrame) -> str:
    """Names the rows of ``df``, whatever their order and partitions: equal for equal schemas and multisets of rows.

    One pass and one row: the number of rows, and sums and xors of 64-bit row hashes with unlike seeds, hashed together
    with the columns' names and types in order. Rows that repeat count as often as they occur; a changed value, row,
    name or type gives another digest (but for one chance in about 2^128).
    """
    read = [part for i, f in enumerate(df.schema) for part in (F.lit(i), *_told_apart(F.col(f"`{f.name}`"), f.dataType))]
    rows = df.select(*[F.xxhash64(F.lit(f"lane {k}"), *read).alias(f"h{k}") for k in range(LANES)])
    sums = [F.sum(F.col(f"h{k}").cast("decimal(38,0)")).cast("string").alias(f"s{k}") for k in range(LANES)]
    found = rows.agg(F.count(F.lit(1)).alias("n"), *sums, *[F.bit_xor(f"h{k}").alias(f"x{k}") for k in range(LANES)]).first()
    columns = [[f.name, f.dataType.jsonValue()] for f in df.schema]
    return hashlib.sha256(json.dumps([columns, *found]).encode()).hexdigest()


def content_key(settings: Mapping[str, object], inputs: Mapping[str, DataFrame]) -> str:
    """A digest of the settings and of every input table by name."""
    parts = [sorted((k, repr(v)) for k, v in settings.items()), sorted((k, table_digest(df)) for k, df in inputs.items())]
    return hashlib.sha256(json.dumps(parts).encode()).hexdigest()[:32]


def _path(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, at: str) -> bool:
    path, files = _path(spark, at)
    return files.exists(path)


def commit(df: DataFrame, at: str, form: str = "parquet", **options) -> bool:
    """Writes ``df`` beside ``at`` and renames it there, so that a table at ``at`` is whole; of two writers the first wins. Whether it was ours."""
    spark, (folder, _, name) = df.sparkSession, at.rpartition("/")
    aside = f"{folder}/_{name}.{uuid.uuid4().hex}"  # readers pass over names that begin so
    df.write.format(form).options(**options).save(aside)
    (source, files), (target, _) = _path(spark, aside), _path(spark, at)
    files.mkdirs(target.getParent())
    won = not files.exists(target) and files.rename(source, target)
    if not won:
        files.delete(source, True)
        if not files.exists(target):
            raise OSError(f"{aside} could not be renamed to {at}")
    return won


def cached(spark: SparkSession, path: str, settings: Mapping[str, object], inputs: Mapping[str, DataFrame], make: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """(the table made from these settings and inputs, whether it had to be made now); it is at ``path``/its key.

    A table is there as a whole or not at all: a run that dies while it writes leaves none behind.
    """
    at = f"{path}/{content_key(settings, inputs)}"
    made = not exists(spark, at) and commit(make(), at)
    return spark.read.parquet(at), made
