"""Result tables that grow by runs: a run that is repeated, or that dies half-way, leaves every cell once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cache import commit, exists, table_digest
from .readers import manifest_rows


def read_cells(spark: SparkSession, path: str, schema: str, form: str = "parquet") -> DataFrame:
    """All rows of a table of ``append_new``; none where nothing was written yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    options = {"header": "true"} if form == "csv" else {}
    return spark.read.format(form).schema(schema).options(recursiveFileLookup="true", **options).load(path)


def missing(cells: DataFrame, path: str, keys: list[str], form: str = "parquet") -> DataFrame:
    """The rows of ``cells`` whose keys (null equals null) the table at ``path`` doesn't have: what is left to compute."""
    if not exists(cells.sparkSession, path):
        return cells
    kinds = dict(cells.dtypes)
    schema = ", ".join(f"`{c}` {t}" for c, t in cells.dtypes) if form == "csv" else ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    there = read_cells(cells.sparkSession, path, schema, form).select(*[F.col(f"`{k}`").alias(f"_there{i}") for i, k in enumerate(keys)]).distinct()
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"_there{i}")) for i, k in enumerate(keys)]
    return cells.join(there, on=same, how="left_anti")


def append_new(cells: DataFrame, path: str, keys: list[str], run: str, form: str = "parquet") -> bool:
    """Appends the rows whose keys aren't there yet as the folder ``run``, by a rename; whether the folder is new.

    A run repeated under its name adds nothing. Of runs one after the other the first to bring a cell keeps it; runs at
    the same time have to bring different cells. CSV reads back all columns of ``cells`` in their order.
    """
    at = f"{path}/{run}"
    if exists(cells.sparkSession, at):
        return False
    new = missing(cells, path, keys, form).dropDuplicates(keys)
    return commit(new, at, form, **({"header": "true"} if form == "csv" else {}))


def append_manifest(df: DataFrame, path: str, run: str | None = None) -> bool:
    """Appends the manifest's rows as CSV, once a ``run``; the rows' digest names it if nothing else does, so that a retry isn't a second append."""
    rows = manifest_rows(df)
    at = f"{path}/{run or table_digest(rows)[:24]}"
    return not exists(df.sparkSession, at) and commit(rows.coalesce(1), at, "csv", header="true")
