"""Calibration: expected calibration error, reliability, selective risk, temperature, out-of-distribution probe.

All work on (conf, correct) rows and reduce to a few aggregated rows in one shuffle.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.functions.arrays import argmax, bin_of, finite, softmax, wilson_lower
from curata.operators.ranks import exact_percentiles
from curata.settings import BAND_HIGH, BAND_LOW, EDGES, SWEEP_BAND_ECE, SWEEP_LOW, SWEEP_MIN_ROWS, SWEEP_RISK, SWEEP_STEPS


def bins(rows: DataFrame, edges: tuple[float, ...] = EDGES) -> DataFrame:
    """Per bin: n, mean confidence, accuracy; rows with a confidence that is not finite are left out."""
    kept = rows.withColumn("bin", bin_of(finite(F.col("conf")), edges)).where("bin is not null")
    return kept.groupBy("bin").agg(F.count("*").alias("n"), F.avg("conf").alias("mean_conf"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def ece(rows: DataFrame, edges: tuple[float, ...] = EDGES) -> DataFrame:
    """One row: n and the expected calibration error; 0 without rows."""
    gap = F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("mean_conf")))
    return bins(rows, edges).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.try_divide(gap, F.sum("n")), F.lit(0.0)).alias("ece"))


def band_edges() -> tuple[float, ...]:
    return tuple(float(x) for x in np.linspace(BAND_LOW, BAND_HIGH, 11))


def band_ece(rows: DataFrame) -> DataFrame:
    """Calibration error within the closed band of confidences."""
    return ece(rows.where(F.col("conf").between(BAND_LOW, BAND_HIGH)), band_edges())


def reliability(rows: DataFrame, edges: tuple[float, ...] = EDGES) -> DataFrame:
    """All bins in order, empty ones with null figures; figures to four places."""
    spark = rows.sparkSession
    names = spark.createDataFrame([(k, f"[{edges[k]:.1f},{edges[k + 1]:.1f}{']' if k == len(edges) - 2 else ')'}") for k in range(len(edges) - 1)], "bin int, label string")
    return names.join(bins(rows, edges), "bin", "left").select("bin", "label", F.coalesce("n", F.lit(0)).alias("n"), F.round("mean_conf", 4).alias("mean_conf"), F.round("accuracy", 4).alias("accuracy"))


def thresholds() -> list[float]:
    return [(SWEEP_LOW + k) / 100 for k in range(SWEEP_STEPS)]


def selective_risk(rows: DataFrame) -> DataFrame:
    """Per threshold: rows at or above it, coverage, accuracy, Wilson risk.

    Rows are counted once by the highest threshold they reach; a running sum over the 40 counts gives every threshold, so
    no row is copied per threshold.
    """
    conf = finite(F.col("conf"))
    steps = F.array(*[F.lit(t) for t in thresholds()])
    reached = F.size(F.filter(steps, lambda t: t <= conf))
    counts = rows.where(conf.isNotNull()).groupBy(reached.alias("step")).agg(F.count("*").alias("n"), F.count_if(F.col("correct").cast("boolean")).alias("hits"))
    spark = rows.sparkSession
    grid = spark.createDataFrame([(k + 1, t) for k, t in enumerate(thresholds())], "at int, threshold double")
    total = counts.agg(F.sum("n").alias("total"))
    above = grid.join(counts, F.col("step") >= F.col("at"), "left").groupBy("threshold").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))
    share = F.try_divide(F.col("n").cast("double"), F.col("total"))
    return above.crossJoin(F.broadcast(total)).select("threshold", "n", F.coalesce(share, F.lit(0.0)).alias("coverage"), F.try_divide(F.col("hits").cast("double"), F.col("n")).alias("accuracy"), F.when(F.col("n") > 0, 1 - wilson_lower(F.col("hits"), F.col("n"))).otherwise(1.0).alias("risk"))


def pick(sweep: DataFrame, band_error: float) -> float | None:
    """The lowest threshold with enough rows and little enough risk, if the band is calibrated."""
    if band_error > SWEEP_BAND_ECE:
        return None
    return sweep.where((F.col("n") >= SWEEP_MIN_ROWS) & (F.col("risk") <= SWEEP_RISK)).agg(F.min("threshold").alias("t")).first()["t"]


def routing_thresholds(sweep: DataFrame, band_error: float, ece_error: float | None, fallback: float = 0.9) -> dict:
    """The threshold artifact: the sweep's pick, or the fallback and why; refused without a calibration error under 0.1."""
    if ece_error is None or ece_error >= 0.10:
        return {"doc_confidence": fallback, "source": "refused", "reason": "no_ece" if ece_error is None else "ece_too_high"}
    found = pick(sweep, band_error)
    if found is None:
        return {"doc_confidence": fallback, "source": "fallback", "reason": "insufficient_data"}
    return {"doc_confidence": found, "source": "sweep", "reason": "picked"}


def temperature_grid(rows: DataFrame, grid: list[float]) -> DataFrame:
    """Mean negative log likelihood of ``label`` under each temperature: one pass, one column per temperature."""
    def loss(t: float) -> Column:
        return F.avg(-F.ln(F.greatest(F.get(softmax(F.col("logits"), t), F.col("label")), F.lit(1e-300))))

    one = rows.agg(*[loss(t).alias(f"t{k}") for k, t in enumerate(grid)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(t).alias("temperature"), F.col(f"t{k}").alias("nll")) for k, t in enumerate(grid)])).alias("x")).select("x.*")


def ece_of_logits(rows: DataFrame, temperature: float = 1.0) -> DataFrame:
    """One row: n and the calibration error of (logits, label) under a temperature."""
    probs = rows.select(softmax(F.col("logits"), temperature).alias("p"), "label")
    return ece(probs.select(F.array_max("p").alias("conf"), (argmax(F.col("p")) == F.col("label")).alias("correct")))


def fit_temperature(rows: DataFrame, low: float = 0.05, high: float = 10.0, rounds: int = 6) -> float:
    """The temperature of least loss by refining a grid; 1 for fewer than two rows or classes."""
    seen = rows.agg(F.count("*").alias("n"), F.countDistinct("label").alias("k")).first()
    if seen["n"] < 2 or (seen["k"] or 0) < 2:
        return 1.0
    for _ in range(rounds):
        grid = [float(x) for x in np.geomspace(low, high, 13)]
        best = temperature_grid(rows, grid).orderBy("nll", "temperature").first()["temperature"]
        at = grid.index(best)
        low, high = grid[max(0, at - 1)], grid[min(len(grid) - 1, at + 1)]
    return float(np.sqrt(low * high))


def ood_threshold(energies: DataFrame, share: float = 95.0) -> DataFrame:
    """One row: the (100 - share) percentile of the energies, interpolated, for the probe below it; and the rows."""
    found = exact_percentiles(energies, F.col("energy"), [(100.0 - share) / 100.0])[0]
    return energies.agg(F.lit(found).cast("double").alias("threshold"), F.count("*").alias("n"))


def ood_flags(energies: DataFrame, key: str, threshold: float, above: bool = True) -> DataFrame:
    """Per key: mean energy of its windows and whether it is beyond the threshold, strictly."""
    mean = energies.groupBy(key).agg(F.avg("energy").alias("mean_energy"))
    return mean.withColumn("ood_flag", F.col("mean_energy") > threshold if above else F.col("mean_energy") < threshold)
