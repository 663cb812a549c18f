"""URL filters by dated lists: entries become validity intervals, an as-of join finds what held when a page was fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_hot, materialize, unused


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) in lower-case host, without user, port and trailing dot; path without query and fragment, "/" at least; null if no scheme or host."""
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)), r":[0-9]*$", ""), r"\.$", "")
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(host != "", host), F.when(host != "", F.when(path == "", "/").otherwise(path))


def list_keys(host: Column, path: Column) -> Column:
    """Array of (key, rank): what list entries may name of a URL: host+path, host+/first part, host, and its parent domains of two labels or more (an IP address has none); the higher the rank, the more exact."""
    labels = F.split(host, r"\.")
    names = F.when(host.rlike(r"^([0-9.]+|\[.*)$"), 1).otherwise(F.greatest(F.size(labels) - 1, F.lit(1)))
    parents = F.transform(F.sequence(F.lit(1), names), lambda i: F.struct(F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("key"), (-i).alias("rank")))
    first = F.regexp_extract(path, r"^(/[^/]*)", 1)
    return F.concat(F.array(F.struct(F.concat(host, path).alias("key"), F.lit(2).alias("rank")), F.struct(F.concat(host, first).alias("key"), F.lit(1).alias("rank"))), parents)


def validity(entries: DataFrame) -> DataFrame:
    """(key, since, until): the intervals [since, until) in which ``key`` is listed; until is null while it still is.

    ``entries(key, added boolean, dated)``. Of several entries of one key and date an addition wins; an entry that
    repeats the state before it starts nothing; a removal before any addition means nothing; null keys or dates
    are no entries.
    """
    day = entries.where("key is not null and dated is not null").groupBy("key", "dated").agg(F.max("added").alias("added"))
    by = Window.partitionBy("key").orderBy("dated")
    changes = day.withColumn("was", F.coalesce(F.lag("added").over(by), F.lit(False))).where("added <> was")
    return changes.withColumn("until", F.lead("dated").over(by)).where("added").select("key", F.col("dated").alias("since"), "until")


def as_of(captures: DataFrame, intervals: DataFrame) -> DataFrame:
    """Every row of ``captures`` (url, fetched and any others), with blocked, matched_key and listed_since.

    Blocked if an entry for one of the URL's keys held at ``fetched`` (a null time or a URL without host: not); of
    several the most exact key names the match. Distinct (key, time) pairs meet the intervals in one equi-join with
    the time as a condition, so a host with many captures comes once a time; the URLs of a busy host and time are salted
    when they take it up; rows find their verdict by (url, time).
    Repeated rows get a verdict each; no rows give no rows, no intervals block nothing; a very long URL is a key like
    others. Columns of ``captures`` stay: where one has a result's name, the result's gets underscores before it.
    """
    result = ["blocked", "matched_key", "listed_since"]
    if {c.lower() for c in captures.columns} & set(result):
        result = unused(captures, *result)
    h, p, u, t = unused(captures, "host", "path", "url", "fetched")
    url = captures.where("url is not null and fetched is not null").select("url", "fetched").distinct()
    host, path = url_parts(F.col("url"))
    keys = url.withColumn(h, host).withColumn(p, path).where(F.col(h).isNotNull()).select("url", "fetched", F.explode(list_keys(F.col(h), F.col(p))).alias("k")).select("url", "fetched", "k.key", "k.rank")
    times = keys.groupBy("key", "fetched").agg(F.count(F.lit(1)).alias("n"))
    hits = times.join(intervals, "key").where("since <= fetched and (until is null or fetched < until)").select("key", "fetched", "since", "n")
    hits = materialize(hits, "hits")  # one interval a key and time at most
    best = join_hot(keys, hits, ["key", "fetched"], by="url").groupBy("url", "fetched").agg(F.max(F.struct("rank", "key", "since")).alias("best"))
    verdict = best.select(F.col("url").alias(u), F.col("fetched").alias(t), F.col("best.key").alias(result[1]), F.col("best.since").alias(result[2]))
    found = captures.join(verdict, (F.col("url") == F.col(u)) & (F.col("fetched") == F.col(t)), "left")
    return found.select(*[F.col(f"`{c}`") for c in captures.columns], F.col(result[1]).isNotNull().alias(result[0]), result[1], result[2])


def _number(column: str, offset: int) -> Column:
    """7 hex digits of the MD5 as a number: the same in any engine."""
    return F.conv(F.substring(F.md5(F.col(column).cast("binary")), offset, 7), 16, 10).cast("long")


def dated_lists(urls: DataFrame) -> DataFrame:
    """A list over all keys of ``urls``, as the tables have none: (key, added, dated).

    The MD5 of a key says whether it is listed (one in four), when (within 730 days from 2023-01-01), whether and when
    it is taken off (half of them), and whether it comes back (a third of these).
    """
    host, path = url_parts(F.col("url"))
    keys = urls.select(host.alias("h"), path.alias("p")).where("h is not null").distinct().select(F.explode(list_keys(F.col("h"), F.col("p"))).alias("k")).select("k.key").distinct()
    a, b = _number("key", 1), _number("key", 9)
    start = F.lit("2023-01-01").cast("date")
    on = (a / 4).cast("long") % 730
    off = on + 1 + b % 200
    event = lambda added, day: F.struct(F.lit(added).alias("added"), F.date_add(start, day.cast("int")).alias("dated"))
    events = F.array_compact(F.array(event(True, on), F.when(b % 2 == 0, event(False, off)), F.when(b % 6 == 0, event(True, off + 30))))
    return keys.where(a % 4 == 0).select("key", F.explode(events).alias("e")).select("key", "e.added", "e.dated")


def op4(pages: DataFrame) -> DataFrame:
    """All pages against ``dated_lists`` of their own keys, fetched on a day that page_id gives (the table has none).

    A null page_id has no day, so nothing blocks it; a null URL neither; repeated rows come out each; other columns go.
    """
    fetched = F.date_add(F.lit("2023-01-01").cast("date"), F.pmod(F.col("page_id") * 7919, F.lit(900)).cast("int"))
    captures = pages.select("page_id", "url", fetched.alias("fetched"))
    found = as_of(captures, validity(dated_lists(pages.select("url"))))
    return found.select("page_id", "url", F.date_format("fetched", "yyyy-MM-dd").alias("fetched"), "blocked", "matched_key", F.date_format("listed_since", "yyyy-MM-dd").alias("listed_since"))


ORACLE = r"""
WITH parts AS (
  SELECT page_id, url, DATE '2023-01-01' + CAST(((page_id * 7919) % 900 + 900) % 900 AS INTEGER) AS fetched,
    regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)', 1)), ':[0-9]*$', ''), '\.$', '') AS h,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS p0
  FROM pages),
named AS (SELECT DISTINCT url, fetched, h, CASE WHEN p0 = '' THEN '/' ELSE p0 END AS p, string_split(h, '.') AS l FROM parts WHERE h <> ''),
keyed AS (
  SELECT url, fetched, h || p AS key, 2 AS rank FROM named
  UNION ALL SELECT url, fetched, h || regexp_extract(p, '^(/[^/]*)', 1), 1 FROM named
  UNION ALL SELECT url, fetched, array_to_string(l[i:], '.'), -i FROM (SELECT *, unnest(generate_series(1, CASE WHEN regexp_matches(h, '^([0-9.]+|\[.*)$') THEN 1 ELSE greatest(len(l) - 1, 1) END)) AS i FROM named)),
hashed AS (SELECT key, CAST('0x' || substr(md5(key), 1, 7) AS BIGINT) AS a, CAST('0x' || substr(md5(key), 9, 7) AS BIGINT) AS b FROM (SELECT DISTINCT key FROM keyed)),
listed AS (SELECT key, b, (a // 4) % 730 AS s, (a // 4) % 730 + 1 + b % 200 AS e FROM hashed WHERE a % 4 = 0),
spans AS (
  SELECT key, DATE '2023-01-01' + CAST(s AS INTEGER) AS since, CASE WHEN b % 2 = 0 THEN DATE '2023-01-01' + CAST(e AS INTEGER) END AS until FROM listed
  UNION ALL SELECT key, DATE '2023-01-01' + CAST(e + 30 AS INTEGER), NULL FROM listed WHERE b % 6 = 0),
best AS (
  SELECT k.url, k.fetched, k.key, s.since, row_number() OVER (PARTITION BY k.url, k.fetched ORDER BY k.rank DESC, k.key DESC, s.since DESC) AS n
  FROM keyed k JOIN spans s ON k.key = s.key AND s.since <= k.fetched AND (s.until IS NULL OR k.fetched < s.until))
SELECT p.page_id, p.url, strftime(p.fetched, '%Y-%m-%d') AS fetched, b.key IS NOT NULL AS blocked, b.key AS matched_key, strftime(b.since, '%Y-%m-%d') AS listed_since
FROM parts p LEFT JOIN (SELECT * FROM best WHERE n = 1) b ON p.url = b.url AND p.fetched = b.fetched
"""
