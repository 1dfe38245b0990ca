"""Evaluation: confusion, accuracy, macro-F1, slices, comparisons, bootstrap, effects, gates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.operators.ranks import edges, exact_percentiles, running


def confusion(rows: DataFrame) -> DataFrame:
    """Counts by (gt, pred)."""
    return rows.groupBy("gt", "pred").agg(F.count("*").alias("n"))


def recall_by_class(rows: DataFrame) -> DataFrame:
    return rows.groupBy("gt").agg(F.count("*").alias("n"), F.avg(F.col("gt").eqNullSafe(F.col("pred")).cast("double")).alias("recall"))


def f1_by_class(rows: DataFrame) -> DataFrame:
    """Per observed true class: support, precision, recall and F1; a null prediction is a miss.

    Works on the confusion counts, so only classes are shuffled after the first aggregation.
    """
    counts = confusion(rows)
    hit = F.col("gt").eqNullSafe(F.col("pred"))
    true = counts.groupBy(F.col("gt").alias("label")).agg(F.sum("n").alias("support"), F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("tp"))
    said = counts.where("pred is not null").groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("predicted"))
    j = true.join(said, "label", "left").withColumn("predicted", F.coalesce("predicted", F.lit(0)))
    return j.select("label", "support", F.coalesce(F.try_divide("tp", "predicted"), F.lit(0.0)).alias("precision"), (F.col("tp") / F.col("support")).alias("recall"), (2 * F.col("tp") / (F.col("support") + F.col("predicted"))).alias("f1"))


def macro_f1(rows: DataFrame) -> DataFrame:
    """One row: observed classes and the mean of their F1."""
    return f1_by_class(rows).agg(F.count("*").alias("n_classes"), F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"))


def head_support(rows: DataFrame, head: DataFrame) -> DataFrame:
    """Support of every label of the head, 0 where unseen."""
    n = rows.groupBy(F.col("gt").alias("label")).agg(F.count("*").alias("support"))
    return head.select("label").distinct().join(n, "label", "left").select("label", F.coalesce("support", F.lit(0)).alias("support"))


def conditional_accuracy(rows: DataFrame) -> DataFrame:
    """One row: accuracy of the class, and of the subclass among rows whose class is right (an abstention is a miss)."""
    right = F.col("dt_correct")
    sub = right & F.col("sc_correct")
    return rows.agg(F.count("*").alias("n"), F.avg(right.cast("double")).alias("doc_type_accuracy"), F.count_if(right).alias("n_conditional"), F.try_divide(F.count_if(F.coalesce(sub, F.lit(False))).cast("double"), F.count_if(right)).alias("subclass_accuracy"))


def slices(rows: DataFrame, by: str) -> DataFrame:
    """Rows and accuracy overall (null slice) and per slice, by grouping sets in one aggregation."""
    out = rows.groupingSets([[], [F.col(by)]], F.col(by)).agg(F.count("*").alias("n"), F.avg(F.col("dt_correct").cast("double")).alias("accuracy"), F.grouping_id().alias("level"))
    return out.select(F.col(by).alias("slice"), "n", "accuracy", (F.col("level") > 0).alias("overall"))


def cohorts(rows: DataFrame) -> DataFrame:
    """By single or multi window: rows, accuracy, mean agreement."""
    return rows.groupBy(F.when(F.col("n_windows") == 1, "single").otherwise("multi").alias("cohort")).agg(F.count("*").alias("n"), F.avg(F.col("dt_correct").cast("double")).alias("accuracy"), F.avg("agreement").alias("mean_agreement"))


def window_buckets(rows: DataFrame) -> DataFrame:
    """Rows and accuracy by number of windows: 1, 2-3, 4-8, 9+."""
    w = F.col("n_windows")
    return rows.groupBy(F.when(w <= 1, "1").when(w <= 3, "2-3").when(w <= 8, "4-8").otherwise("9+").alias("bucket")).agg(F.count("*").alias("n"), F.avg(F.col("dt_correct").cast("double")).alias("accuracy"))


def compare(a: DataFrame, b: DataFrame, key: str = "filename") -> DataFrame:
    """One row for two result sets paired by key: pairs, accuracies, rows won and lost."""
    pairs = a.select(key, F.col("dt_correct").alias("x")).join(b.select(key, F.col("dt_correct").alias("y")), key)
    return pairs.agg(F.count("*").alias("n"), F.avg(F.col("x").cast("double")).alias("accuracy_a"), F.avg(F.col("y").cast("double")).alias("accuracy_b"), F.count_if(F.col("y") & ~F.col("x")).alias("won"), F.count_if(F.col("x") & ~F.col("y")).alias("lost"))


def paired_bootstrap(a: DataFrame, b: DataFrame, key: str = "filename", resamples: int = 2000, seed: int = 42) -> DataFrame:
    """One row: mean paired difference and its 95 % interval.

    Differences take three values, so a resample is a multinomial draw over their counts: no row leaves its executor.
    """
    pairs = a.select(key, F.col("dt_correct").cast("int").alias("x")).join(b.select(key, F.col("dt_correct").cast("int").alias("y")), key)
    counts = {r["d"]: r["n"] for r in pairs.groupBy((F.col("y") - F.col("x")).alias("d")).agg(F.count("*").alias("n")).collect()}
    n = sum(counts.values())
    shares = np.array([counts.get(d, 0) / n for d in (-1, 0, 1)]) if n else np.array([0.0, 1.0, 0.0])
    means = np.random.default_rng(seed).multinomial(n, shares, resamples) @ np.array([-1, 0, 1]) / max(1, n)
    low, high = np.percentile(means, [2.5, 97.5])
    return a.sparkSession.createDataFrame([(n, float(shares[2] - shares[0]), float(low), float(high))], "n long, mean_diff double, ci_low double, ci_high double")


def rank_auc(rows: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row: area under the ROC curve by mid-ranks of distinct scores, summed range by range of the scores."""
    tallies = rows.where(F.col(score).isNotNull()).groupBy(score).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count("*").alias("n"))
    ranked = running(tallies, score, "n", edges(rows, F.col(score), 200))
    mid = F.col("before") + (F.col("n") + 1) / 2
    one = ranked.agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"), F.sum(F.col("pos") * mid).alias("ranks"))
    return one.select(F.try_divide(F.col("ranks") - F.col("pos") * (F.col("pos") + 1) / 2, F.col("pos") * (F.col("n") - F.col("pos"))).alias("auc"), "n")


#: Blocks of rows that the bootstrap of effects draws from, folds of the fit's quality, draws, penalty of the surrogate.
BLOCKS, FOLDS, DRAWS, PENALTY = 200, 5, 200, 1.0


def ale_curve(rows: DataFrame, feature: str, outcome: str, covariate: str, n_bins: int = 10, key: str = "filename", seed: int = 42) -> DataFrame:
    """Accumulated local effects of a feature on an outcome under a ridge surrogate, with 5 to 95 % bands and the fit's R2.

    The surrogate has both standardized variables, their squares and their product.  Rows are dealt to BLOCKS by a hash of
    the key; a block's normal equations and its sums per bin are one aggregation, and only they (a row per block and bin)
    reach the driver.  Bands come from drawing blocks with replacement, R2 from fits without each fold of blocks.
    """
    x, z, y = (F.col(c).cast("double") for c in (feature, covariate, outcome))
    cuts = sorted({q for q in exact_percentiles(rows, x, [k / n_bins for k in range(n_bins + 1)]) if q is not None})
    schema = "bin int, upper double, n long, effect double, low double, high double, r2 double"
    if len(cuts) < 2:
        return rows.sparkSession.createDataFrame([], schema)
    place = F.lit(0)
    for k, c in enumerate(cuts[1:-1]):
        place = F.when(x > c, k + 1).otherwise(place)
    block = F.pmod(F.xxhash64(F.col(key)), F.lit(BLOCKS)).cast("int")
    power = lambda v, k: F.lit(1.0) if k == 0 else v if k == 1 else F.pow(v, F.lit(float(k)))
    moments = [(a, b) for a in range(5) for b in range(5 - a)]
    sums = [F.sum(power(x, a) * power(z, b)).alias(f"m{a}{b}") for a, b in moments] + [F.sum(power(x, a) * power(z, b) * y).alias(f"r{a}{b}") for a, b in moments if a + b < 3] + [F.sum(y * y).alias("yy")]
    kept = rows.where(x.isNotNull() & z.isNotNull() & y.isNotNull())
    found = kept.groupBy(block.alias("block"), place.alias("bin")).agg(*sums).collect()
    m, r, yy = np.zeros((BLOCKS, len(cuts) - 1, 5, 5)), np.zeros((BLOCKS, len(cuts) - 1, 3, 3)), np.zeros(BLOCKS)
    for f in found:
        at = f["block"], f["bin"]
        yy[f["block"]] += f["yy"]
        for a, b in moments:
            m[at][a, b] = f[f"m{a}{b}"]
            if a + b < 3:
                r[at][a, b] = f[f"r{a}{b}"]
    terms = [(0, 0), (1, 0), (0, 1), (2, 0), (0, 2), (1, 1)]
    everything = m.sum((0, 1))
    n = everything[0, 0]
    mean = np.array([everything[1, 0], everything[0, 1]]) / n
    spread = np.sqrt(np.maximum(np.array([everything[2, 0], everything[0, 2]]) / n - mean**2, 0.0)) + 1e-9
    change = _standardized(terms, mean, spread)

    def fit(m_: np.ndarray, r_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        gram = change @ np.array([[m_[a + c, b + d] for c, d in terms] for a, b in terms]) @ change.T
        right = change @ np.array([r_[a, b] for a, b in terms])
        penalty = PENALTY * np.eye(len(terms))
        penalty[0, 0] = 0.0
        return np.linalg.solve(gram + penalty, right), gram, right

    def curve(w: np.ndarray, bins: np.ndarray) -> np.ndarray:
        """Accumulated and centred effects from the sums of each bin."""
        raw = change.T @ w  # weights of the terms as they are
        count = np.maximum(bins[:, 0, 0], 1.0)
        lo, hi = np.array(cuts[:-1]), np.array(cuts[1:])
        step = raw[1] * (hi - lo) + raw[3] * (hi**2 - lo**2) + raw[5] * (hi - lo) * bins[:, 0, 1] / count
        whole = np.concatenate([[0.0], np.cumsum(np.where(bins[:, 0, 0] > 0, step, 0.0))])
        middle = (whole[:-1] + whole[1:]) / 2
        return whole[1:] - (middle * bins[:, 0, 0]).sum() / max(1.0, bins[:, 0, 0].sum())

    main = curve(fit(everything, r.sum((0, 1)))[0], m.sum(0))
    random = np.random.default_rng(seed)
    draws = []
    for _ in range(DRAWS):
        times = np.bincount(random.integers(0, BLOCKS, BLOCKS), minlength=BLOCKS).astype(float)
        bins = np.einsum("k,kbij->bij", times, m)
        draws.append(curve(fit(bins.sum(0), np.einsum("k,kbij->ij", times, r))[0], bins))
    low, high = np.percentile(np.array(draws), [5, 95], axis=0)
    total_r, left = r.sum((0, 1)), 0.0
    for fold in range(FOLDS):
        mine = slice(fold, BLOCKS, FOLDS)
        w = fit(everything - m[mine].sum((0, 1)), total_r - r[mine].sum((0, 1)))[0]
        _, gram, right = fit(m[mine].sum((0, 1)), r[mine].sum((0, 1)))
        left += yy[mine].sum() - 2 * w @ right + w @ gram @ w
    spread_y = yy.sum() - total_r[0, 0] ** 2 / n
    r2 = float(1 - left / spread_y) if spread_y > 0 else 0.0
    count = m.sum(0)[:, 0, 0]
    return rows.sparkSession.createDataFrame([(k, float(cuts[k + 1]), int(count[k]), float(main[k]), float(low[k]), float(high[k]), r2) for k in range(len(cuts) - 1)], schema)


def _standardized(terms: list[tuple[int, int]], mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Matrix from the terms x^a z^b to those of the standardized variables."""
    from math import comb

    out = np.zeros((len(terms), len(terms)))
    for k, (a, b) in enumerate(terms):
        for c in range(a + 1):
            for d in range(b + 1):
                out[k, terms.index((c, d))] += comb(a, c) * (-mean[0]) ** (a - c) * comb(b, d) * (-mean[1]) ** (b - d) / spread[0] ** a / spread[1] ** b
    return out


def gate_rows(metrics: DataFrame) -> DataFrame:
    """(name, value, bound, at_least) with status: MISSING for null or not finite, PASS or FAIL by the unrounded value."""
    v = F.col("value")
    missing = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    ok = F.when(F.col("at_least"), v >= F.col("bound")).otherwise(v <= F.col("bound"))
    return metrics.withColumn("status", F.when(missing, "MISSING").when(ok, "PASS").otherwise("FAIL"))


def select_epoch(rows: DataFrame, tolerance: float = 0.005, max_ece: float = 0.05) -> DataFrame:
    """The earliest of the best epochs: within tolerance of the best objective, calibrated ones preferred."""
    ok = rows.withColumn("calibrated", F.coalesce(F.col("ece") <= max_ece, F.lit(False)))
    best = ok.where("calibrated").agg(F.max("objective").alias("c")).crossJoin(ok.agg(F.max("objective").alias("a")))
    j = ok.crossJoin(F.broadcast(best))
    pool = j.where(F.when(F.col("c").isNotNull(), F.col("calibrated") & (F.col("objective") >= F.col("c") - tolerance)).otherwise(F.col("objective") >= F.col("a") - tolerance))
    return pool.orderBy(F.desc("objective"), "epoch").limit(1).select("epoch", "objective", "ece")


def parity(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row for two scorers' arrays: greatest difference and share of equal argmax."""
    from curata.functions.arrays import argmax

    j = a.select(key, F.col("scores").alias("x")).join(b.select(key, F.col("scores").alias("y")), key)
    gap = F.array_max(F.zip_with("x", "y", lambda p, q: F.abs(p - q)))
    return j.agg(F.count("*").alias("n"), F.max(gap).alias("max_diff"), F.avg((argmax(F.col("x")) == argmax(F.col("y"))).cast("double")).alias("argmax_agreement"))


def score_with(docs: DataFrame, make_scorer, schema: str, key: str = "filename", text: str = "doc_text") -> DataFrame:
    """(key, scores..., error) from an injected scorer, built once per task; a text that raises keeps its row with null scores."""
    def run(batches):
        scorer = make_scorer()
        for batch in batches:
            scores, errors = [], []
            for t in batch.column(1).to_pylist():
                try:
                    scores.append([float(x) for x in scorer(t or "")])
                    errors.append(None)
                except Exception as e:  # the row is kept and tells why
                    scores.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.list_(pa.float64())), pa.array(errors, pa.string())], names=["key", "scores", "error"])

    return docs.select(key, text).mapInArrow(run, schema).withColumnRenamed("key", key)


def score_pool(pool: DataFrame, make_scorer, key: str = "filename", title: str = "title", text: str = "doc_text") -> DataFrame:
    """(key, doc_type_conf, subclass_conf, agreement, scored, score_reason) of a pool without labels.

    The injected scorer maps (title, text) to a dict with confidence, subclass_confidence, agreement and, where it gives none,
    a reason.  A row that raises, or has no confidence, is kept with zero scores and says why.
    """
    schema = "doc_type_conf double, subclass_conf double, agreement double, scored boolean, score_reason string"

    def run(batches):
        scorer = make_scorer()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for name, body in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                try:
                    found = scorer(name or "", body or "")
                    known = found.get("confidence") is not None
                    values = [float(found.get(c) or 0.0) for c in ("confidence", "subclass_confidence", "agreement")]
                    why = "" if known else str(found.get("reason") or "unscored")
                except Exception as e:  # the row is kept and tells why
                    known, values, why = False, [0.0, 0.0, 0.0], f"error:{type(e).__name__}"
                for column, v in zip(out, [*values, known, why], strict=True):
                    column.append(v)
            kinds = (pa.float64(), pa.float64(), pa.float64(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=[key, *(x.split()[0] for x in schema.split(", "))])

    source = pool.select(key, title, text)
    return source.mapInArrow(run, f"{key} {source.schema[key].dataType.simpleString()}, {schema}")
