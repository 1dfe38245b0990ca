"""Label vocabularies: observed surfaces, head maps with their trainable part, support floors and their replay.

Counts by class and label are aggregates; what comes to the driver is one row per label, at most ``LABELS`` of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.functions.text import fold, strip
from curata.operators.enrich import LABELS

#: The catch-all label, which is never removed for want of rows.
OTHER = "other"


def contract_label(value: Column, keys: list[str], aliases: dict[str, str], names: dict[str, str], prefix: int = 8) -> Column:
    """Canonical key of a contract family: its folded key, an alias, a family name or the first ``prefix`` letters of one, else other."""
    folded = fold(strip(F.coalesce(value, F.lit(""))))
    table = {fold_text(k): v for k, v in aliases.items()} | {k: k for k in keys}
    exact = F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), folded) if table else F.lit(None).cast("string")
    named = F.lit(None).cast("string")
    for key in reversed(keys):
        name = fold_text(names.get(key, key))
        named = F.when((folded == name) | folded.startswith(name[:prefix]), key).otherwise(named)
    return F.when(folded == "", OTHER).otherwise(F.coalesce(exact, named, F.lit(OTHER)))


def enum_label(value: Column, allowed: list[str]) -> Column:
    """A label of a closed list: as it is, or folded, else other."""
    raw = strip(F.coalesce(value, F.lit("")))
    out = F.lit(OTHER)
    for label in reversed(allowed):
        out = F.when(fold(raw) == fold_text(label), label).otherwise(out)
    return F.when(raw.isin(allowed), raw).when(raw == "", OTHER).otherwise(out) if allowed else F.lit(OTHER)


def fold_text(text: str) -> str:
    return "".join(c for c in text.lower() if c.isascii() and c.isalnum())


def surfaces(docs: DataFrame, order: dict[str, list[str]], full: dict[str, list[str]]) -> DataFrame:
    """(doc_type, subclass, n, place, sanctioned): each class's labels in order.

    A class of ``full`` has exactly its list, seen or not; other classes have the labels seen outside test, those of
    ``order`` first in its order, then the rest by name.
    """
    spark = docs.sparkSession
    listed = [(c, x, k, c in full) for c, xs in (order | full).items() for k, x in enumerate(xs)]
    table = spark.createDataFrame(listed or [("", "", 0, False)], "doc_type string, subclass string, k int, whole boolean")
    seen = docs.where("split <> 'test'").groupBy("doc_type", "subclass").agg(F.count("*").alias("n"))
    j = seen.join(table, ["doc_type", "subclass"], "full")
    kept = j.where(F.when(F.col("doc_type").isin(list(full)), F.coalesce("whole", F.lit(False))).otherwise(F.col("n").isNotNull()))
    from pyspark.sql import Window

    at = Window.partitionBy("doc_type").orderBy(F.col("k").isNull(), "k", "subclass")  # rows are labels
    return kept.select("doc_type", "subclass", F.coalesce("n", F.lit(0)).alias("n"), (F.row_number().over(at) - 1).alias("place"), F.col("k").isNotNull().alias("sanctioned"))


def head_table(docs: DataFrame, order: dict[str, list[str]], full: dict[str, list[str]], routing_only: dict[str, list[str]]) -> DataFrame:
    """(doc_type, subclass, place, weight, inference_only, trainable_place) of every head's labels.

    ``weight`` is the inverse-frequency weight among the class's train rows, null without them (the label is then
    inference_only); ``trainable_place`` counts the labels that are not routing_only, for which it is null.
    """
    from pyspark.sql import Window

    spark = docs.sparkSession
    routed = spark.createDataFrame([(c, x) for c, xs in routing_only.items() for x in xs] or [("", "")], "doc_type string, subclass string").withColumn("routed", F.lit(True))
    counts = docs.where("split = 'train'").groupBy("doc_type", "subclass").agg(F.count("*").alias("n_train"))
    total = counts.groupBy("doc_type").agg(F.sum("n_train").alias("total"), F.count("*").alias("k"))
    j = surfaces(docs, order, full).join(counts, ["doc_type", "subclass"], "left").join(total, "doc_type", "left").join(routed, ["doc_type", "subclass"], "left")
    free = F.col("routed").isNull()
    place = F.sum(free.cast("int")).over(Window.partitionBy("doc_type").orderBy("place")) - 1
    return j.select("doc_type", "subclass", "place", (F.col("total") / (F.col("k") * F.col("n_train"))).alias("weight"), F.col("n_train").isNull().alias("inference_only"), F.when(free, place).cast("int").alias("trainable_place"))


def head_maps(table: DataFrame) -> dict[str, dict]:
    """The head table on the driver: labels, label2id, weights, inference_only, routing_only and the trainable part per class."""
    rows = table.limit(LABELS + 1).collect()
    if len(rows) > LABELS:
        raise ValueError("too many labels")
    out: dict[str, dict] = {}
    for r in sorted(rows, key=lambda r: (r["doc_type"], r["place"])):
        head = out.setdefault(r["doc_type"], {"labels": [], "weights": {}, "inference_only": [], "routing_only": [], "trainable_labels": []})
        head["labels"].append(r["subclass"])
        if r["weight"] is not None:
            head["weights"][r["subclass"]] = r["weight"]
        if r["inference_only"]:
            head["inference_only"].append(r["subclass"])
        head["trainable_labels" if r["trainable_place"] is not None else "routing_only"].append(r["subclass"])
    for head in out.values():
        head["label2id"] = {x: k for k, x in enumerate(head["labels"])}
        head["trainable_label2id"] = {x: k for k, x in enumerate(head["trainable_labels"])}
    return out


def support_plan(train: DataFrame, heads: DataFrame, least: int) -> DataFrame:
    """(doc_type, subclass, n, action) of labels with fewer than ``least`` train rows: remapped to other where the head has it, else dropped."""
    counts = train.groupBy("doc_type", "subclass").agg(F.count("*").alias("n"))
    low = counts.where((F.col("n") < least) & (F.col("subclass") != OTHER))
    has = heads.where(F.col("subclass") == OTHER).select("doc_type").distinct().withColumn("__other", F.lit(True))
    return low.join(has, "doc_type", "left").select("doc_type", "subclass", "n", F.when(F.col("__other"), "remapped").otherwise("dropped").alias("action"))


def apply_support(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows of any split under a plan made on train: remapped labels are other, rows of dropped labels go."""
    j = rows.join(plan.select("doc_type", "subclass", F.col("action").alias("__action")), ["doc_type", "subclass"], "left")
    kept = j.where(F.coalesce(F.col("__action") != "dropped", F.lit(True)))
    return kept.withColumn("subclass", F.when(F.col("__action") == "remapped", OTHER).otherwise(F.col("subclass"))).select(*rows.columns)
