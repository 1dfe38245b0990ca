"""Report figures over judged documents (filename, gt and pred of both levels, dt_correct, sc_correct, n_windows, ...) and their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of an error table at most: a report shows the first ones and counts the rest.
SHOWN = 500


def _share(flag: Column) -> Column:
    return F.avg(F.coalesce(flag, F.lit(False)).cast("double"))


def subclass_stats(rows: DataFrame) -> DataFrame:
    """Per class, of rows whose class is right and whose subclasses are known: rows, right ones, and the commonest predicted and true subclass (the first by name of ties)."""
    scorable = rows.where("dt_correct and gt_subclass is not null and pred_subclass is not null")

    def top(column: str, name: str) -> DataFrame:
        counts = scorable.groupBy("gt_doc_type", F.col(column).alias("label")).agg(F.count("*").alias("n"))
        best = F.min_by(F.struct("label", "n"), F.struct(-F.col("n"), "label"))
        return counts.groupBy("gt_doc_type").agg(best.alias("b")).select("gt_doc_type", F.col("b.label").alias(name), F.col("b.n").alias(f"{name}_n"))

    base = scorable.groupBy("gt_doc_type").agg(F.count("*").alias("n"), F.count_if("sc_correct").alias("correct"))
    return base.join(top("pred_subclass", "top_pred"), "gt_doc_type").join(top("gt_subclass", "top_true"), "gt_doc_type")


def best_and_worst(rows: DataFrame) -> DataFrame:
    """One row: the classes of highest and lowest accuracy (the first by name of ties) with their accuracy and rows."""
    by = rows.groupBy("gt_doc_type").agg(_share(F.col("dt_correct")).alias("a"), F.count("*").alias("n"))
    one = F.struct(F.col("gt_doc_type").alias("c"), "a", "n")
    ends = by.agg(F.min_by(one, F.struct(-F.col("a"), "gt_doc_type")).alias("best"), F.min_by(one, F.struct("a", "gt_doc_type")).alias("worst"))
    return ends.select(*[F.col(f"{x}.{f}").alias(f"{x}_{name}") for x in ("best", "worst") for f, name in (("c", "class"), ("a", "accuracy"), ("n", "n"))])


def error_rows(rows: DataFrame, n: int = SHOWN) -> DataFrame:
    """The first ``n`` rows by file name with a wrong class or subclass, each with the number of all such rows."""
    wrong = rows.where(~F.coalesce(F.col("dt_correct"), F.lit(False)) | ~F.coalesce(F.col("sc_correct"), F.lit(True)))
    total = wrong.agg(F.count("*").alias("n_errors"))
    first = wrong.orderBy("filename").limit(n).select("filename", "gt_doc_type", "pred_doc_type", "dt_correct", "sc_correct", "n_windows")
    return first.crossJoin(total)  # one row


def comparable(rows: DataFrame) -> DataFrame:
    """One row of headline figures of a result set, to be paired with another's; null where there are no rows."""
    single = F.col("n_windows") == 1
    right = F.coalesce(F.col("dt_correct"), F.lit(False))
    return rows.agg(
        F.count("*").alias("n_docs"),
        _share(F.col("dt_correct")).alias("doc_type_accuracy"),
        F.try_divide(F.count_if(right & F.coalesce(F.col("sc_correct"), F.lit(False))).cast("double"), F.count_if(right)).alias("subclass_accuracy_conditional"),
        F.round(F.avg("agreement"), 4).alias("mean_window_agreement"),
        _share(F.col("fast_path")).alias("fast_path_rate"),
        F.count_if("fast_path").alias("fast_path_n_docs"),
        F.avg(F.when(single, right.cast("double"))).alias("single_window_accuracy"),
        F.avg(F.when(~single, right.cast("double"))).alias("multi_window_accuracy"),
        _share(F.col("ood_flag")).alias("ood_rate"),
    )


def macro_f1_all(rows: DataFrame, labels: DataFrame, observed_only: bool = False) -> DataFrame:
    """One row: mean F1 over every label of (label), or over those with true rows; rows without a true label are left out, undefined scores are 0."""
    kept = rows.where("gt is not null")
    true = kept.groupBy(F.col("gt").alias("label")).agg(F.count("*").alias("support"), F.count_if(F.col("gt").eqNullSafe(F.col("pred"))).alias("tp"))
    said = kept.where("pred is not null").groupBy(F.col("pred").alias("label")).agg(F.count("*").alias("predicted"))
    j = labels.select("label").distinct().join(true, "label", "left").join(said, "label", "left").na.fill(0)
    j = j.where("support > 0") if observed_only else j
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("support") + F.col("predicted")), F.lit(0.0))
    return j.agg(F.count("*").alias("n_classes"), F.coalesce(F.avg(f1), F.lit(0.0)).alias("macro_f1"))


def head_ece_policy(heads: DataFrame, limit: float = 0.1) -> DataFrame:
    """(head, ece, excluded) with status: an excluded head is out of the fast path whatever its error; others are refused above the limit or without one."""
    return heads.withColumn("status", F.when(F.col("excluded"), "excluded").when(F.col("ece").isNull(), "missing").when(F.col("ece") >= limit, "refused").otherwise("ok"))


def plus_slice(rows: DataFrame, baseline: DataFrame) -> DataFrame:
    """Rows whose file is not in the baseline; raises if the baseline is empty."""
    if baseline.isEmpty():
        raise ValueError("no baseline rows to subtract")
    return rows.join(baseline.select("filename").distinct(), "filename", "left_anti")


def check_same_model(report: dict, baseline: dict, key: str = "artifact_sha") -> None:
    """Raises if two reports name different models; a missing name proves nothing."""
    if report.get(key) and baseline.get(key) and report[key] != baseline[key]:
        raise ValueError(f"the report scored {report[key][:12]}, the baseline {baseline[key][:12]}")


def check_disjoint(a: DataFrame, b: DataFrame, key: str = "filename") -> None:
    """Raises if the two have a key in common."""
    both = a.select(key).join(b.select(key), key, "left_semi").distinct()
    if n := both.count():
        raise ValueError(f"{n} common values of {key}, such as {both.first()[0]}")


def markdown(df: DataFrame, title: str, n: int = SHOWN) -> str:
    """The first ``n`` rows of a small result as a table under a heading, and how many more there are; numbers to four places."""
    def cell(v: object) -> str:
        return "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")

    rows, total = df.limit(n).collect(), df.count()
    lines = [f"## {title}", "", f"| {' | '.join(df.columns)} |", f"|{' --- |' * len(df.columns)}"]
    lines += [f"| {' | '.join(map(cell, r))} |" for r in rows]
    return "\n".join(lines + ([f"| ... ({total - len(rows)} more) |{' |' * (len(df.columns) - 1)}"] if total > len(rows) else [])) + "\n"
