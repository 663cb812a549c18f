"""Mixing sources to target weights: subset-sum budget fitting over exact token lengths."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, hot_safe_rank, materialize, unused

_FIT = "source_key string, size long, picks long"


def _with_copies(reach: int, size: int, n: int, mask: int) -> int:
    """The sums of ``reach`` (a bit each) with up to ``n`` copies of ``size`` more, by powers of two."""
    part = 1
    while n:
        k = min(part, n)
        reach |= (reach << (k * size)) & mask
        n, part = n - k, part * 2
    return reach


def closest_sum(items: list[tuple[int, int]], goal: int) -> list[int]:
    """How many of each (size, copies) make the sum closest to ``goal``: a bounded knapsack over a bit for every sum.

    Sums up to twice the goal count, as one above may be closer than all below. Bitsets are kept at every sqrt(n)-th
    size alone and made again between them when the counts are found by going back.
    """
    picks, every, most = [0] * len(items), max(1, math.isqrt(len(items))), 2 * goal
    reach, marks, used, mask = 1, [], 0, (1 << (most + 1)) - 1
    for used, (size, n) in enumerate(items, 1):
        if (used - 1) % every == 0:
            marks.append(reach)
        reach = _with_copies(reach, size, min(n, most // size), mask)
        if reach >> goal & 1:
            break
    at = (reach & ((1 << (goal + 1)) - 1)).bit_length() - 1
    if above := reach >> (goal + 1):
        over = goal + (above & -above).bit_length()
        at = over if over - goal < goal - at else at
    for m in range(len(marks) - 1, -1, -1):
        first, last = m * every, min((m + 1) * every, used)
        own = [marks[m]]
        for size, n in items[first : last - 1]:
            own.append(_with_copies(own[-1], size, min(n, most // size), mask))
        for j in range(last - 1, first - 1, -1):
            bits = own.pop().to_bytes(most // 8 + 1, "little")
            while not bits[at >> 3] >> (at & 7) & 1:
                at -= items[j][0]
                picks[j] += 1
    return picks


def least_miss(sizes: list[int], counts: list[int], budget: int, work: int = 1 << 32) -> int:
    """What every choice misses ``budget`` by at least.

    A sum's remainder by m is one that bounded copies of the sizes' remainders reach: a bit each of m, rotated. The
    distance from the budget's remainder to the next of these is a bound for any m. Those tried are the divisors that
    all sizes, or all but the lengths of fewest words, share, and the lengths of most words, as far as bits times lengths
    stay under ``work``.
    """
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i] * counts[i])
    moduli, divisor = [], 0
    for i in order:
        divisor = math.gcd(divisor, sizes[i])
        moduli.append(divisor)
    best = 0
    for m in sorted({m for m in [*moduli, *[sizes[i] for i in order[:4]]] if m > 1}):
        if m * len(sizes) > work or m // 2 <= best:
            continue
        reach, mask = 1, (1 << m) - 1
        for size, n in zip(sizes, counts, strict=True):
            part, n = 1, min(n, m - 1)  # m copies come back to the same remainder
            while n and size % m and reach != mask:
                k = min(part, n)
                by = k * size % m
                reach |= (reach << by | reach >> (m - by)) & mask
                n, part = n - k, part * 2
        at = budget % m
        turned = (reach >> at | reach << (m - at)) & mask  # bit d: the remainder d above the budget's
        best = max(best, min((turned & -turned).bit_length() - 1, m - turned.bit_length() + 1))
    return best


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: int, window: int = 65_536, work: int = 1 << 35) -> np.ndarray:
    """How many of ``counts[i]`` documents of ``sizes[i]`` words (all over 0) to take to come closest to ``budget``.

    First the budget's share of every length goes (the mix keeps its source's lengths), then the longest that fit until
    about ``window`` words remain, which ``closest_sum`` fits. A result is taken if no sum could be closer, by
    ``least_miss``; else the window grows to all that the shares leave, then the shares give back 1, 8, 64, ...
    documents a length, until nothing is fixed and the sum is the closest of all. A step of over ``work`` (bits of the
    window times lengths; its bitsets take 2 * bits * sqrt(lengths) / 8 bytes, at most 512 MB) isn't begun: then the
    closest sum so far stands, within the first window of the closest.
    """
    sizes, counts = np.asarray(sizes, np.int64), np.asarray(counts, np.int64)
    sizes_of, counts_of = sizes.tolist(), counts.tolist()
    total = sum(s * c for s, c in zip(sizes_of, counts_of, strict=True))
    if budget <= 0 or not total:
        return np.zeros(len(sizes), np.int64)
    if budget >= total:
        return counts.copy()
    if 2 * budget > total:  # the fewer words are chosen: those to leave out
        return counts - fit_budget(sizes, counts, total - budget, window, work)
    share, order = [c * budget // total for c in counts_of], sorted(range(len(sizes)), key=lambda i: -sizes_of[i])
    divisor = math.gcd(*sizes_of)
    best, least, free = None, min(budget % divisor, -budget % divisor), 0
    while True:
        picks = [max(0, x - free) for x in share]
        rest = left = budget - sum(p * s for p, s in zip(picks, sizes_of, strict=True))
        for i in order:
            if rest <= window:
                break
            k = min(counts_of[i] - picks[i], max(1, (rest - window) // sizes_of[i]), rest // sizes_of[i])
            picks[i] += k
            rest -= k * sizes_of[i]
        own = [i for i in order if sizes_of[i] <= 2 * rest and counts_of[i] > picks[i]]
        if best is not None and (2 * rest * len(own) > work or rest * math.isqrt(len(own)) > 1 << 30):
            return np.array(best[1], np.int64)
        for i, k in zip(own, closest_sum([(sizes_of[i], counts_of[i] - picks[i]) for i in own], rest), strict=True):
            picks[i] += k
        off = abs(budget - sum(p * s for p, s in zip(picks, sizes_of, strict=True)))
        if best is None and off > least:
            least = max(least, least_miss(sizes_of, counts_of, budget))
        if best is None or off < best[0]:
            best = off, picks
        if best[0] <= least or (window >= left and free >= max(share)):
            return np.array(best[1], np.int64)
        if window < left:
            window *= 8
        else:
            free, window = max(1, 8 * free), 1 << 62


def source_targets(sizes: DataFrame, most: float = 3.0) -> DataFrame:
    """(source_key, source_size, target) of ``sizes(source_key, source, size)``.

    Sources by code point, null last, weigh 1, 2, 3, repeating. Targets are the weights' shares of all words, capped at
    ``most`` times the source's words, the excess reshared by weight: target = min(cap, level * weight), where level
    is the largest over k of (all - caps of the k lowest cap/weight) / (the others' weights). One row a source.
    """
    by = sizes.groupBy("source_key", "source").agg(F.sum("size").cast("double").alias("s"))
    one = F.lit(0)
    ranked = by.withColumn("w", (F.pmod(F.row_number().over(Window.partitionBy(one).orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(3)) + 1).cast("double"))
    ranked = ranked.withColumn("cap", F.col("s") * most)
    all_rows = Window.partitionBy(one)
    lower = all_rows.orderBy(F.col("cap") / F.col("w"), "source_key").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("s").over(all_rows) - F.coalesce(F.sum("cap").over(lower), F.lit(0.0))) / (F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(lower), F.lit(0.0)))
    return ranked.withColumn("at", level).withColumn("level", F.max("at").over(all_rows)).select("source_key", F.col("s").cast("long").alias("source_size"), F.least("cap", F.col("level") * F.col("w")).alias("target"))


def mix_plan(docs: DataFrame, most: int = 3, seed: int = 42) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, copies.

    size: words ``[^\\x20\\x09-\\x0D]+`` of the whole text (null or empty: 0). Every source's words times copies come
    as close to its target as they can: whole repeats of all its documents (at most ``most``), then one more of
    some. Documents are counted by exact length; ``fit_budget`` says how many of each length go; which ones, the
    lowest ``xxhash64(doc_id, seed)`` say, so reruns agree. Null sources are a source of their own; a null doc_id and
    repeated rows are documents like others; documents of no words take part with 0; very long texts count whole; no
    rows give no rows.
    """
    source = F.col("source").cast("string")
    key = F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))
    sizes = materialize(docs.select("doc_id", source.alias("source"), key.alias("source_key"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sizes")
    targets = source_targets(sizes, most).withColumn("whole", F.least(F.lit(most), F.floor(F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0))))).withColumn("budget", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    targets = materialize(targets, "targets")
    lengths = sizes.groupBy("source_key", "size").agg(F.count(F.lit(1)).alias("n")).join(targets.select("source_key", "budget"), "source_key")

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part[part["size"] > 0]
        return pd.DataFrame({"source_key": part["source_key"], "size": part["size"], "picks": fit_budget(part["size"].to_numpy(), part["n"].to_numpy(), int(part["budget"].iloc[0]) if len(part) else 0)})

    picks = materialize(lengths.groupBy("source_key").applyInPandas(fit, _FIT), "picks")
    ranked, before = hot_safe_rank(sizes.withColumn("h", F.xxhash64("doc_id", F.lit(seed))), ["source_key", "size"], "h")
    quota = before.join(picks, ["source_key", "size"], "left").join(targets, "source_key").hint("merge")  # a row a length and bucket: it grows with the input
    more = (F.col("before") + F.col("in_bucket") < F.coalesce("picks", F.lit(0))).cast("long")
    return ranked.join(quota, ["source_key", "size", "bucket"]).select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + more).cast("long").alias("copies"))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The documents of the mix, all their columns, each as often as ``mix_plan`` says.

    Rows that share a doc_id, source and size are taken as often in all as their plan rows say together.
    """
    size, take, copy = unused(docs, "size", "take", "copy")
    plan = mix_plan(docs, **settings).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows"))
    p_id, p_source, p_size, copies, rows = unused(docs, "p_id", "p_source", "p_size", "copies", "rows")
    plan = plan.toDF(p_id, p_source, p_size, copies, rows)
    same = Window.partitionBy("doc_id", "source", size).orderBy(F.xxhash64("text"))
    own = docs.withColumn(size, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    found = own.join(plan, F.col("doc_id").eqNullSafe(F.col(p_id)) & F.col("source").cast("string").eqNullSafe(F.col(p_source)) & (F.col(size) == F.col(p_size)))
    share = F.floor(F.col(copies) / F.col(rows)) + (F.row_number().over(same) <= F.col(copies) % F.col(rows)).cast("long")
    found = found.withColumn(take, share.cast("int")).where(F.col(take) > 0)
    return found.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(take)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op5(docs: DataFrame) -> DataFrame:
    """The contract's columns from ``mix_plan``."""
    return mix_plan(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
