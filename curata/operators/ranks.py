"""Exact order statistics without sorting a table in one task.

``percentile_approx`` bounds the rank of what it returns, so a narrow band of values holds an exact percentile for sure.
Values below the bands are only counted, and the distinct values within them are few.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Accuracy of the approximate ranks, and the margin around a rank, as shares of the rows.
ACCURACY, MARGIN = 20_000, 1e-4


def exact_percentiles(df: DataFrame, value: Column, shares: list[float]) -> list[float | None]:
    """The linearly interpolated percentiles of the values that are not null; nulls without rows."""
    rows = df.select(value.cast("double").alias("v")).where("v is not null")
    n = rows.count()
    if not n:
        return [None] * len(shares)
    ranks = sorted({k for p in shares for k in (math.floor((n - 1) * p), math.ceil((n - 1) * p))})
    ends = [(max(0.0, k / n - MARGIN), min(1.0, (k + 1) / n + MARGIN)) for k in ranks]
    found = rows.agg(F.percentile_approx("v", F.array(*[F.lit(x) for e in ends for x in e]), F.lit(ACCURACY)).alias("q")).first()["q"]
    bands: list[list[float]] = []
    for lo, hi in sorted(zip(found[::2], found[1::2], strict=True)):
        if bands and lo <= bands[-1][1]:
            bands[-1][1] = max(bands[-1][1], hi)
        else:
            bands.append([lo, hi])
    # -1 - b: between the bands before band b; b: within it.
    place = F.lit(-1 - len(bands))
    for b, (lo, hi) in reversed(list(enumerate(bands))):
        place = F.when(F.col("v") < lo, -1 - b).when(F.col("v") <= hi, b).otherwise(place)
    kept = F.when(place >= 0, F.col("v"))
    tally = rows.groupBy(place.alias("place"), kept.alias("v")).agg(F.count("*").alias("n")).collect()  # a few distinct values per band
    out: dict[int, float] = {}
    seen = 0
    for b in range(len(bands)):
        seen += sum(r["n"] for r in tally if r["place"] == -1 - b)
        for r in sorted((r for r in tally if r["place"] == b), key=lambda r: r["v"]):
            out |= {k: r["v"] for k in ranks if seen <= k < seen + r["n"]}
            seen += r["n"]
    at = lambda x: out[math.floor(x)] + (out[math.ceil(x)] - out[math.floor(x)]) * (x - math.floor(x))
    return [at((n - 1) * p) for p in shares]


def edges(df: DataFrame, value: Column, parts: int) -> list[float]:
    """Values that cut the rows into about ``parts`` ranges: at most so many numbers."""
    found = df.agg(F.percentile_approx(value.cast("double"), F.array(*[F.lit(k / parts) for k in range(1, parts)]), F.lit(ACCURACY)).alias("q")).first()["q"]
    return sorted(set(found or []))


def running(df: DataFrame, value: str, amount: str, cuts: list[float]) -> DataFrame:
    """``df`` of distinct values with before: the sum of ``amount`` over all smaller values.  Ranges of values are summed first, so a window orders one range."""
    part = F.lit(0)
    for k, c in enumerate(cuts):
        part = F.when(F.col(value) >= c, k + 1).otherwise(part)
    parted = df.withColumn("__part", part)
    sums = parted.groupBy("__part").agg(F.sum(amount).alias("__sum"))
    sums = sums.select("__part", (F.sum("__sum").over(Window.orderBy("__part")) - F.col("__sum")).alias("__less"))  # a row per range
    within = F.sum(amount).over(Window.partitionBy("__part").orderBy(value)) - F.col(amount)
    return parted.join(F.broadcast(sums), "__part").withColumn("before", F.col("__less") + within).drop("__part", "__less")
