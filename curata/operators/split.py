"""Splits and samples by keyed hash order, and by replaying a seeded generator.

A keyed hash (SHA-256 of seed and key) gives the same order on any cluster, is stratified and counted exactly, and can be
checked in SQL.  ``replay`` gives the membership of the seeded shuffle of a sorted key list instead; it collects the keys,
so it refuses more than ``REPLAY`` of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curata.settings import SEED

#: Keys that the replay mode takes to the driver at most.
REPLAY = 1_000_000


def keyed(key: str, seed: int = SEED) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)


def _cut(keys: DataFrame, strata: str, take: Callable[[Column], Column], seed: int, key: str) -> DataFrame:
    """(s, last): the place in keyed order of the last of the first ``take(n)`` rows of each stratum of n.

    A stratum's rows are dealt to 4096 ranges of the hash and counted; only the range that holds the last row is ordered, so
    no task sorts a stratum, however large.
    """
    at = keys.select(F.col(strata).alias("s"), F.struct(keyed(key, seed).alias("h"), F.col(key).cast("string").alias("k")).alias("at")).withColumn("range", F.substring("at.h", 1, 3))
    counts = at.groupBy("s", "range").agg(F.count("*").alias("n"))
    total = Window.partitionBy("s")
    before = F.sum("n").over(total.orderBy("range")) - F.col("n")
    placed = counts.withColumn("before", before).withColumn("take", take(F.sum("n").over(total)))
    edge = placed.where("take > before and take <= before + n").select(F.col("s").alias("edge"), F.col("range").alias("edge_range"), (F.col("take") - F.col("before")).alias("nth"))
    inside = at.join(edge, F.col("s").eqNullSafe(F.col("edge")) & (F.col("range") == F.col("edge_range")))
    ranked = inside.withColumn("r", F.row_number().over(Window.partitionBy("s").orderBy("at")))
    return ranked.where("r = nth").select("s", F.col("at").alias("last"))


def _chosen(docs: DataFrame, strata: str, take: Callable[[Column], Column], seed: int, key: str) -> DataFrame:
    """``docs`` with __chosen: whether a row is among the first of its stratum; rows of equal key go together."""
    last = _cut(docs.select(strata, key), strata, take, seed, key)
    at = F.struct(keyed(key, seed).alias("h"), F.col(key).cast("string").alias("k"))
    joined = docs.join(last, F.col(strata).eqNullSafe(F.col("s")), "left")  # a row per stratum
    return joined.withColumn("__chosen", F.coalesce(at <= F.col("last"), F.lit(False))).drop("s", "last")


def _share(fraction: float) -> Callable[[Column], Column]:
    return lambda n: F.bround(n * F.lit(float(fraction)))


def stratified_split(docs: DataFrame, strata: str, fraction: float, seed: int = SEED, key: str = "filename") -> DataFrame:
    """``docs`` with split: in each stratum the first round(n * fraction), halves to even, by keyed hash are validation."""
    chosen = _chosen(docs, strata, _share(fraction), seed, key)
    return chosen.withColumn("split", F.when(F.col("__chosen"), "validation").otherwise("train")).drop("__chosen")


def grouped_split(docs: DataFrame, family: str, fraction: float, seed: int = SEED, require: bool = False) -> DataFrame:
    """``docs`` with split: whole families go to validation; rows without family stay in train, or raise if families are required."""
    if require and not docs.where(F.coalesce(F.col(family).cast("string"), F.lit("")) == "").isEmpty():
        raise ValueError(f"rows without {family}")
    families = docs.where(F.col(family).isNotNull()).select(family).distinct().withColumn("__all", F.lit(0))
    held = _chosen(families, "__all", _share(fraction), seed, family).where("__chosen").select(family, F.lit(True).alias("__held"))
    return docs.join(held, family, "left").withColumn("split", F.when(F.col("__held"), "validation").otherwise("train")).drop("__held")


def stratified_sample(docs: DataFrame, strata: str, n: int, seed: int = SEED, key: str = "filename") -> DataFrame:
    """Up to n rows of each stratum, by keyed hash."""
    return _chosen(docs, strata, lambda all_: F.least(all_, F.lit(n)), seed, key).where("__chosen").drop("__chosen")


def draw(docs: DataFrame, n: int, seed: int = SEED, key: str = "filename") -> DataFrame:
    """Up to n rows, by keyed hash."""
    return stratified_sample(docs.withColumn("__all", F.lit(0)), "__all", n, seed, key).drop("__all")


def epoch_order(docs: DataFrame, epoch: int, seed: int = SEED, key: str = "filename") -> DataFrame:
    """``docs`` with place: the order of an epoch depends on the seed and the epoch only, not on epochs before it.

    Rows are dealt to 4096 ranges of the keyed hash, and places are counted range by range.
    """
    h = F.sha2(F.concat(F.lit(f"{seed}:{epoch}:"), F.col(key).cast("string")), 256)
    rows = docs.withColumn("__h", h).withColumn("__range", F.substring("__h", 1, 3))
    counts = rows.groupBy("__range").agg(F.count("*").alias("n")).withColumn("__before", F.sum("n").over(Window.orderBy("__range")) - F.col("n")).drop("n")
    inside = F.row_number().over(Window.partitionBy("__range").orderBy("__h", key))
    return rows.join(counts, "__range").withColumn("place", F.col("__before") + inside - 1).drop("__h", "__range", "__before")


def long_supplement(docs: DataFrame, strata: str, per_class: int, min_chars: int, seed: int = SEED) -> DataFrame:
    """Up to ``per_class`` texts longer than ``min_chars`` of each class, marked coverage_only."""
    return stratified_sample(docs.where(F.length("doc_text") > min_chars), strata, per_class, seed).withColumn("coverage_only", F.lit(True))


def replay(docs: DataFrame, strata: str | None, fraction: float, seed: int = SEED, key: str = "filename") -> DataFrame:
    """The split of a seeded shuffle: one generator over the strata in sorted order, keys sorted within."""
    import numpy as np

    keys = docs.select(key, *([strata] if strata else []))
    if keys.limit(REPLAY + 1).count() > REPLAY:
        raise ValueError(f"replay takes at most {REPLAY} keys; use the keyed order")
    groups: dict = {}
    for r in keys.orderBy(key).collect():
        groups.setdefault(r[strata] if strata else "", []).append(r[key])
    random, held = np.random.RandomState(seed), []
    for name in sorted(groups):
        names = np.array(groups[name], object)
        random.shuffle(names)
        held += [(x,) for x in names[: round(len(names) * fraction)]]
    table = docs.sparkSession.createDataFrame(held, f"{key} string").withColumn("__held", F.lit(True))
    return docs.join(table, key, "left").withColumn("split", F.when(F.col("__held"), "validation").otherwise("train")).drop("__held")
