"""Saved workspaces written here byte by byte: types, gaps, factors, dates, short forms, references, compression, choice of the frame."""

import bz2
import gzip
import lzma
import math
import struct

import pytest

from aeropanel.sources import rdata as r

i4 = lambda *x: struct.pack(f">{len(x)}i", *x)


class Writer:
    """The binary form of a few kinds of value."""

    def __init__(self):
        self.symbols = {}

    def chars(self, text, flags=0x40000):
        return i4(9, -1) if text is None else i4(9 | flags, len(text.encode())) + text.encode()

    def symbol(self, name):
        if name in self.symbols:
            return i4(self.symbols[name] << 8 | 255)
        self.symbols[name] = len(self.symbols) + 1
        return i4(1) + self.chars(name)

    def pairs(self, items):
        return b"".join(i4(0x402) + self.symbol(k) + v() for k, v in items) + i4(254)

    def vector(self, kind, body, n, attributes=()):
        head = i4(kind | (0x200 if attributes else 0), n) + body()
        return head + (self.pairs(attributes) if attributes else b"")

    def strings(self, values, attributes=()):
        return self.vector(16, lambda: b"".join(map(self.chars, values)), len(values), attributes)

    def ints(self, values, attributes=(), kind=13):
        return self.vector(kind, lambda: i4(*[r.NA_INTEGER if v is None else v for v in values]), len(values), attributes)

    def reals(self, values, attributes=()):
        return self.vector(14, lambda: struct.pack(f">{len(values)}d", *[math.nan if v is None else v for v in values]), len(values), attributes)

    def factor(self, codes, levels):
        return self.ints(codes, [("levels", lambda: self.strings(levels)), ("class", lambda: self.strings(["factor"]))])

    def run(self, n, first):
        info = i4(2) + self.symbol("compact_intseq") + i4(2) + self.symbol("base") + i4(2) + self.ints([13]) + i4(254)
        return i4(238) + info + self.reals([n, first, 1]) + i4(254)

    def frame(self, columns, n):
        return self.vector(19, lambda: b"".join(v() for v in columns.values()), len(columns), [("names", lambda: self.strings(list(columns))), ("class", lambda: self.strings(["data.frame"])), ("row.names", lambda: self.ints([None, -n]))])

    def workspace(self, objects, version=2):
        head = b"RDX%d\nX\n" % version + i4(version, 0x30602, 0x20300) + (i4(5) + b"UTF-8" if version == 3 else b"")
        return head + self.pairs(objects)


def sample(version=2):
    w = Writer()
    main = {
        "date": lambda: w.reals([1546300800.0, 1546304400.0, None], [("class", lambda: w.strings(["POSIXct", "POSIXt"])), ("tzone", lambda: w.strings(["GMT"]))]),
        "NO2": lambda: w.reals([41.5, None, 12.25]),
        "site": lambda: w.factor([2, None, 1], ["a", "é"]),
        "day": lambda: w.reals([17897.0, None, 17898.0], [("class", lambda: w.strings(["Date"]))]),
        "n": lambda: w.ints([7, None, -3]),
        "ok": lambda: w.ints([1, None, 0], kind=10),
        "note": lambda: w.strings(["x", None, ""]),
        "row": lambda: w.run(3, 5),
    }
    other = {"v": lambda: w.ints(list(range(10)))}
    return w.workspace([("small", lambda: w.frame(main, 3)), ("numbers", lambda: w.reals([1.0] * 50)), ("big", lambda: w.frame(other, 10))], version)


SCHEMA = "date timestamp, NO2 double, site string, day timestamp, n int, ok boolean, note string, row long, absent double"


@pytest.mark.parametrize("pack", [bytes, gzip.compress, bz2.compress, lzma.compress])
@pytest.mark.parametrize("version", [2, 3])
def test_types_gaps_and_compression(spark, tmp_path, pack, version):
    (tmp_path / "small.RData").write_bytes(pack(sample(version)))
    rows = r.read_rdata(spark, str(tmp_path), SCHEMA).drop("file").collect()
    assert [(str(x["date"]), x["NO2"], x["site"], str(x["day"]), x["n"], x["ok"], x["note"], x["row"], x["absent"]) for x in rows] == [
        ("2019-01-01 00:00:00", 41.5, "é", "2019-01-01 00:00:00", 7, True, "x", 5, None),
        ("2019-01-01 01:00:00", None, None, "None", None, None, None, 6, None),
        ("None", 12.25, "a", "2019-01-02 00:00:00", -3, False, "", 7, None),
    ]


def test_named_frame_else_the_largest_and_broken_files(spark, tmp_path):
    whole = sample()
    for name, raw in (("big.RData", whole), ("elsewhere.RData", whole), ("broken.RData", whole[:200]), ("none.RData", b"text"), ("empty.RData", b"")):
        (tmp_path / name).write_bytes(raw)
    with_v = {x["file"].rpartition("/")[2]: x["n"] for x in r.read_rdata(spark, str(tmp_path), "v int").where("v is not null").groupBy("file").agg({"v": "count"}).withColumnRenamed("count(v)", "n").collect()}
    assert with_v == {"big.RData": 10, "elsewhere.RData": 10}
    with pytest.raises(Exception, match=r"none.RData|empty.RData|broken.RData"):
        r.read_rdata(spark, str(tmp_path), "v int", skip_broken=False).collect()


def test_hours_of_a_site_and_year(spark, tmp_path):
    (tmp_path / "KC1_2019.RData").write_bytes(gzip.compress(sample()))
    w = Writer()
    (tmp_path / "MY1_2019.RData").write_bytes(w.workspace([("MY1_2019", lambda: w.frame({"date": lambda: w.reals([1546300800.0, 1546304400.5]), "PM2.5": lambda: w.ints([3, None])}, 2))]))
    got = r.hourly_air_quality(spark, str(tmp_path), ["NO2", "PM2.5"]).collect()
    assert sorted(map(str, (tuple(x) for x in got if x["site_code"] == "MY1"))) == ["('MY1', 2019, datetime.datetime(2019, 1, 1, 0, 0), None, 3.0)", "('MY1', 2019, datetime.datetime(2019, 1, 1, 1, 0, 0, 500000), None, None)"]
    assert not [x for x in got if x["site_code"] == "KC1"]  # its largest frame has no date


def test_long_pairlists_need_no_stack():
    w = Writer()
    assert len(r.workspace(w.workspace([(f"x{k}", lambda k=k: w.ints([k])) for k in range(5000)]))) == 5000
