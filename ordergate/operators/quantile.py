"""Exact linear-interpolated quantile in two scans, without sorting or gathering values.

The first scan takes a mergeable quantile sketch, whose known rank error gives a bracket that
holds the rank; the second counts the values below the bracket and writes the bracket's distinct
values with their numbers, a few in a hundred thousand of all rows. The rank is then found in that table by
narrowing: its value range is cut into BUCKETS equal parts, one aggregate counts each part, and the
part that holds the rank becomes the next range, until it holds one value. Nothing grows with the
number of rows but the two scans, whatever the values are.
"""

from __future__ import annotations

import math
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACCURACY = 50_000      # a sketched rank is off by at most a 50,000th of the rows
BUCKETS = 4096
_MAX = sys.float_info.max


def _at_rank(d: DataFrame, rank: int, lo: float, hi: float) -> tuple[float, int, float | None]:
    """(value at the 0-based ``rank``, number of values up to and including its last
    equal, next larger value seen in the last range) of rows (x, n: how often) in [lo, hi]."""
    before, n, following = 0, None, None
    while n is None or lo < hi:
        span = hi / 2 - lo / 2             # halves: the full range may overflow
        share = (F.col("x") / 2 - F.lit(lo / 2)) / F.lit(span) if span else (F.col("x") > F.lit(lo)).cast("double")
        bucket = F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1))
        parts = (d.where(F.col("x").between(F.lit(lo), F.lit(hi))).groupBy(bucket.alias("b"))
                 .agg(F.sum("n").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("b").collect())
        i = 0
        while before + parts[i]["n"] <= rank:
            before += parts[i]["n"]
            i += 1
        part = parts[i]
        if i + 1 < len(parts):
            following = parts[i + 1]["lo"]   # ranges only shrink: the nearest one stays
        lo, hi, n = part["lo"], part["hi"], part["n"]
    return lo, before + n, following


def _bracketed(d: DataFrame, lo: float, hi: float) -> tuple[DataFrame, int, int, float | None]:
    """(x, n) of the values in [lo, hi], written; how many values lie below and inside, and the next one above."""
    from ordergate.plans.storage import materialize
    x = F.col("x")
    side = F.when(x < F.lit(lo), F.lit(-1)).when(x > F.lit(hi), F.lit(1)).otherwise(F.lit(0))
    counted = materialize(d.groupBy(side.alias("side"), F.when(side == 0, x).alias("v"))
                          .agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x")), "bracket")
    sides = {r["side"]: r for r in counted.groupBy("side").agg(F.sum("n").alias("n"), F.min("x").alias("x")).collect()}
    def of(s, name, default):
        return sides[s][name] if s in sides else default
    inside = counted.where("side = 0").select("x", "n")
    inside._ordergate_folder = counted._ordergate_folder
    return inside, of(-1, "n", 0), of(0, "n", 0), of(1, "x", None)


def exact_quantile(df: DataFrame, x: str, p: float) -> float | None:
    """Linear-interpolated ``p`` quantile of non-null ``x`` (NULL if none).

    Same definition as pandas ``Series.quantile`` and DuckDB
    ``quantile_cont``: h = (n-1)p, interpolate between ranks floor(h), ceil(h).
    """
    from ordergate.plans.storage import release
    value = F.col(x).cast("double")
    d = df.where(value.isNotNull()).select(F.greatest(F.least(value, F.lit(_MAX)), F.lit(-_MAX)).alias("x"))
    slack = 2 / ACCURACY
    around = [max(0.0, p - slack), min(1.0, p + slack)]
    stats = d.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"),
                  F.percentile_approx("x", around, ACCURACY).alias("around")).first()
    n = stats["n"]
    if n == 0:
        return None
    if stats["lo"] == stats["hi"]:
        return float(stats["lo"])
    h = (n - 1) * p
    r0 = math.floor(h)
    lo = stats["around"][0] if p > slack else stats["lo"]
    hi = stats["around"][1] if p < 1 - slack else stats["hi"]
    bracket, below, inside, after = _bracketed(d, lo, hi)
    if not below <= r0 < below + inside:   # beyond the sketch's promise: all values are the bracket
        release(bracket)
        bracket, below, inside, after = _bracketed(d, stats["lo"], stats["hi"])
        lo, hi = stats["lo"], stats["hi"]
    v0, upto, following = _at_rank(bracket, r0 - below, lo, hi)
    if following is None or upto + below <= r0 + 1:
        # The next value may lie in the bracket beyond the last range, or above the bracket.
        following = bracket.where(F.col("x") > F.lit(v0)).agg(F.min("x")).first()[0]
        following = after if following is None else following
    release(bracket)
    if h == r0 or upto + below > r0 + 1:   # both ranks hold the same value
        return float(v0)
    return float(v0 + (h - r0) * (following - v0))
