"""Saved R workspaces as tables: files are read on executors, a data frame a file, straight into Arrow."""

from __future__ import annotations

import bz2
import gzip
import lzma
import struct
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import PurePosixPath
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Type codes of R's serialization.
SYMBOL, LIST, CLOSURE, ENVIRONMENT, PROMISE, LANGUAGE, CHARS, LOGICAL, INTEGER, REAL, COMPLEX, STRINGS, VECTOR, EXPRESSION, POINTER, RAW, S4 = 1, 2, 3, 4, 5, 6, 9, 10, 13, 14, 15, 16, 19, 20, 22, 24, 25
ALTERNATIVE, ATTRIBUTED_LIST, ATTRIBUTED_LANGUAGE, NAMESPACE, PACKAGE, NOTHING, REFERENCE = 238, 239, 240, 249, 250, 254, 255
NAMELESS = (241, 242, 247, 251, 252, 253)  # base and empty environments, missing and unbound values, the base namespace, the global environment
NA_INTEGER = -(1 << 31)


@dataclass
class Value:
    """A vector with its attributes."""

    data: Any
    kind: int = 0
    attributes: dict[str, Any] = field(default_factory=dict)

    def texts(self, name: str) -> list[str]:
        found = self.attributes.get(name)
        return list(found.data) if isinstance(found, Value) else []

    @property
    def is_frame(self) -> bool:
        return self.kind == VECTOR and "data.frame" in self.texts("class")

    def __len__(self) -> int:
        return max((len(c) for c in self.data), default=0) if self.is_frame else len(self.data)


class _Xdr:
    """Reads items of the big-endian binary form one after the other."""

    def __init__(self, raw: bytes) -> None:
        self.raw, self.at, self.seen = raw, 0, []

    def ints(self, n: int = 1) -> tuple[int, ...]:
        self.at += 4 * n
        return struct.unpack_from(f">{n}i", self.raw, self.at - 4 * n)

    def size(self) -> int:
        n = self.ints()[0]
        if n == -1:
            high, low = self.ints(2)
            n = (high << 32) + (low & 0xFFFFFFFF)
        return n

    def array(self, kind: str) -> np.ndarray:
        n, width = self.size(), np.dtype(kind).itemsize
        self.at += n * width
        return np.frombuffer(self.raw, kind, n, self.at - n * width)

    def noted(self, value: Any) -> Any:
        self.seen.append(value)
        return value

    def item(self) -> Any:
        flags = self.ints()[0]
        kind, attributed, tagged = flags & 0xFF, bool(flags & 0x200), bool(flags & 0x400)
        if kind == NOTHING or kind in NAMELESS:
            return None
        if kind == REFERENCE:
            return self.seen[(flags >> 8 or self.ints()[0]) - 1]
        if kind == SYMBOL:
            return self.noted(self.item())
        if kind in (NAMESPACE, PACKAGE):
            self.ints()
            return self.noted([self.item() for _ in range(self.size())])
        if kind == ENVIRONMENT:
            self.ints()
            own = self.noted(Value({}, kind))
            for _ in range(4):
                self.item()
            return own
        if kind == POINTER:
            own = self.noted(Value(None, kind))
            self.item(), self.item()
            return self.with_attributes(own, attributed)
        if kind in (LIST, LANGUAGE, CLOSURE, PROMISE, ATTRIBUTED_LIST, ATTRIBUTED_LANGUAGE):
            return self.pairs(attributed or kind in (ATTRIBUTED_LIST, ATTRIBUTED_LANGUAGE), tagged)
        if kind == CHARS:
            n = self.ints()[0]
            if n == -1:
                return None
            self.at += n
            return self.raw[self.at - n : self.at].decode("latin-1" if flags >> 12 & 4 else "utf-8", "replace")
        if kind == ALTERNATIVE:
            return self.alternative()
        if kind == S4:
            return self.with_attributes(Value(None, kind), attributed)
        if kind in (LOGICAL, INTEGER):
            data: Any = self.array(">i4")
        elif kind in (REAL, COMPLEX):
            data = self.array(">f8" if kind == REAL else ">c16")
        elif kind == RAW:
            data = self.array(">u1")
        elif kind in (STRINGS, VECTOR, EXPRESSION):
            data = [self.item() for _ in range(self.size())]
        else:
            raise ValueError(f"items of type {kind} can't be read")
        return self.with_attributes(Value(data, kind), attributed)

    def with_attributes(self, own: Value, attributed: bool) -> Value:
        if attributed:
            own.attributes = dict(self.item() or [])
        return own

    def pairs(self, attributed: bool, tagged: bool) -> list[tuple[Any, Any]]:
        """A list of (tag, value), its tail read in a loop, so that a long one needs no stack."""
        out = []
        while True:
            if attributed:
                self.item()
            tag = self.item() if tagged else None
            out.append((tag, self.item()))
            flags = struct.unpack_from(">i", self.raw, self.at)[0]
            if flags & 0xFF not in (LIST, LANGUAGE, ATTRIBUTED_LIST, ATTRIBUTED_LANGUAGE):
                self.item()
                return out
            self.at += 4
            attributed, tagged = bool(flags & 0x200) or flags & 0xFF in (ATTRIBUTED_LIST, ATTRIBUTED_LANGUAGE), bool(flags & 0x400)

    def alternative(self) -> Value:
        """Vectors kept in a short form: runs of numbers, wrapped ones, numbers to be shown as text."""
        (_, name), *_ = self.item()
        state, attributes = self.item(), dict(self.item() or [])
        if name in ("compact_intseq", "compact_realseq"):
            n, first, step = state.data
            own = Value(first + step * np.arange(int(n)), REAL) if name == "compact_realseq" else Value((first + step * np.arange(int(n))).astype(np.int64), INTEGER)
        elif name == "deferred_string":
            own = Value([None if x is None else str(x) for x in column(state[0][1], None).to_pylist()], STRINGS)
        elif name.startswith("wrap_"):
            own = state[0][1] if isinstance(state, list) else state.data[0]
        else:
            raise ValueError(f"vectors of the short form {name} can't be read")
        return Value(own.data, own.kind, {**own.attributes, **attributes})


def workspace(raw: bytes) -> dict[str, Value]:
    """The objects of a saved workspace by name; compressed ones are unpacked."""
    for magic, unpack in ((b"\x1f\x8b", gzip.decompress), (b"BZh", bz2.decompress), (b"\xfd7zXZ\0", lzma.decompress)):
        if raw.startswith(magic):
            raw = unpack(raw)
    if raw[:5] not in (b"RDX2\n", b"RDX3\n") or raw[5:7] != b"X\n":
        raise ValueError("not a saved workspace in binary form")
    items = _Xdr(raw)
    items.at = 7
    if items.ints(3)[0] == 3:
        encoding = items.ints()[0]  # the length of the writer's encoding, by name
        items.at += encoding
    return {name: value for name, value in items.item() or [] if isinstance(value, Value)}


def frame_of(objects: dict[str, Value], name: str) -> Value:
    """The data frame ``name``, else that of the most rows (the first of equals)."""
    frames = {k: v for k, v in objects.items() if v.is_frame}
    if not frames:
        raise ValueError("no data frame in it")
    return frames.get(name) or max(frames.values(), key=len)


def column(own: Value, kind: pa.DataType | None) -> pa.Array:
    """As Arrow: factors are their levels, NA and NaN null, dates and times by their class; cast to ``kind``."""
    classes = own.texts("class")
    if own.kind in (LOGICAL, INTEGER):
        gaps = own.data == NA_INTEGER
        if "factor" in classes:
            levels = own.texts("levels")
            out = pa.array([None if g else levels[i - 1] for i, g in zip(own.data.tolist(), gaps.tolist())], pa.string())
        else:
            out = pa.array(own.data.astype(np.int64), mask=gaps)
            out = out.cast(pa.bool_()) if own.kind == LOGICAL else out
    elif own.kind == REAL:
        data = own.data.astype(np.float64)
        out = pa.array(data, mask=np.isnan(data))
    elif own.kind == STRINGS:
        out = pa.array(own.data, pa.string())
    else:
        raise ValueError(f"columns of type {own.kind} can't be read")
    if own.kind in (REAL, INTEGER) and {"Date", "POSIXct"} & set(classes):
        per, unit = (86_400, pa.timestamp("us", "UTC")) if "Date" in classes else (1, pa.timestamp("us", "UTC"))
        seconds = [None if x is None else round(x * per * 1e6) for x in out.to_pylist()]
        out = pa.array(seconds, pa.int64()).cast(unit)
    if kind is not None and pa.types.is_timestamp(out.type) and pa.types.is_floating(kind):
        return pa.array([None if x is None else x / 1e6 for x in out.cast(pa.int64()).to_pylist()], kind)  # seconds, as R has them
    return out if kind is None else out.cast(kind)


def read_rdata(spark: SparkSession, path: str, schema: str, *, skip_broken: bool = True) -> DataFrame:
    """(file, the columns of ``schema``) of the workspaces at ``path``, a task reading a file at a time.

    Of a file's objects the data frame with the file's own name counts, else the largest. Columns it lacks are null, others
    go; a file that can't be read is passed over with a warning in the task's log, or with ``skip_broken`` off an error.
    """
    empty = spark.createDataFrame([], schema)
    wanted, arrow = empty.schema, empty.toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    own = frame_of(workspace(content.as_buffer().to_pybytes()), PurePosixPath(file).stem)
                    columns = dict(zip(own.texts("names"), own.data))
                    n = len(own)
                    arrays = [column(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in arrow]
                except Exception as why:
                    if not skip_broken:
                        raise ValueError(f"{file}: {why}") from why
                    warnings.warn(f"{file} is passed over: {why}", stacklevel=1)
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([file] * n), *arrays], ["file", *arrow.names])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted))


def hourly_air_quality(spark: SparkSession, path: str, pollutants: list[str]) -> DataFrame:
    """(site_code, year, timestamp_utc, pollutants) of files named <site>_<year>; times are seconds in the column ``date``, files without it give no rows."""
    rows = read_rdata(spark, path, "date double, " + ", ".join(f"`{p}` double" for p in pollutants)).where("date is not null")
    stem = F.regexp_extract("file", r"([^/]+?)_(\d{4})\.[^./]*$", 1), F.regexp_extract("file", r"([^/]+?)_(\d{4})\.[^./]*$", 2)
    return rows.select(stem[0].alias("site_code"), stem[1].cast("int").alias("year"), F.timestamp_seconds("date").alias("timestamp_utc"), *[F.col(f"`{p}`") for p in pollutants])
