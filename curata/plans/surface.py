"""Queries of scalar functions, folds, intake decisions, artifacts and log lines; each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.functions import text as tx
from curata.operators import calibrate, dedup, enrich, evaluate, merge, ops, split
from curata.operators import corpus as cp
from curata.plans.fixtures import CONF_SQL, CORPUS_SQL, JUDGED_SQL, LOGITS_SQL, confidences, corpus, judged, logits, table
from curata.plans.scoring import _DECIDED, _decided
from curata.settings import Gate
from curata.sources import readers

_C = f"WITH {CORPUS_SQL} "


def text_predicates(spark: SparkSession, d: str) -> DataFrame:
    """Folded labels, titles, truthy values, cues and word overlaps of every document."""
    i = F.col("doc_id")
    raw = F.concat(F.upper("subclass"), F.lit("__-  of - "), F.col("doc_type"))
    flag = F.when(i % 7 == 0, None).when(i % 5 == 0, " None ").when(i % 3 == 0, "FALSE").when(i % 2 == 0, "0").otherwise("yes")
    title = tx.title_of(F.when(i % 3 > 0, F.lit(" ")).otherwise(F.col("title")), F.when(i % 2 == 0, F.lit("Exhibit 1")))
    first, last = F.slice(F.split("doc_text", " "), 1, 20), F.slice(F.split("doc_text", " "), 11, 20)
    return corpus(spark, d).select("filename", tx.fold_label(raw).alias("folded_label"), F.sha2(title, 256).alias("title_sha256"), tx.truthy(flag).alias("truthy"), tx.cue_present(F.col("doc_text"), "the").alias("cue_word"), tx.cue_present(F.col("doc_text"), "in the").alias("cue_phrase"), tx.cue_present(F.col("doc_text"), ".").alias("cue_mark"), F.round(tx.jaccard(first, last), 9).alias("overlap"))


def json_fields(spark: SparkSession, d: str) -> DataFrame:
    """A JSON column's fields as columns, and nested fields by dotted path; broken JSON gives null."""
    i = F.col("event_id")
    nested = F.when(i % 10 == 0, "{broken").otherwise(F.concat(F.lit('{"a": {"b": '), "props", F.lit("}}")))
    rows = readers.promote(table(spark, d, "events").select("event_id", "event_type", "props"), "props", ["k", "event_type", "none"])
    return rows.select("event_id", "event_type", "k", "none", readers.nested(nested, "a.b.k").alias("deep"))


def section_maps(spark: SparkSession, d: str) -> DataFrame:
    """Three sections of each document, some of them empty or overlapping the last accepted one."""
    i, n = F.col("doc_id"), F.col("n_chars").cast("int")
    ends = [(F.lit(0), n / 3), ((n / 3) - (i % 3) * 5, n / 2), (n / 2, n / 2 + (i % 4)), ((n / 4) * (i % 5), n)]
    sections = F.array(*[F.struct(F.lit(f"s{k}").alias("name"), F.floor(a).cast("int").alias("begin"), F.floor(b).cast("int").alias("end")) for k, (a, b) in enumerate(ends)])
    kept = merge.section_map(sections)
    return table(spark, d, "documents").select("doc_id", F.array_join(F.transform(kept, lambda s: s["name"]), ",").alias("names"))


def llm_intake_decision(spark: SparkSession, d: str) -> DataFrame:
    i, text = F.col("doc_id"), F.col("doc_text")
    status, route = F.when(i % 9 == 0, "error").when(i % 10 > 0, "ok"), F.when(i % 4 > 0, "fast_path").otherwise("llm")
    runs = merge.llm_intake(text, tx.messy(text), tx.estimate_tokens(text), status, route, F.col("doc_type"), i % 6 > 0, ["en", "fr"], mode="skip")
    return corpus(spark, d).select("filename", runs.alias("llm_runs"), merge.context_fit(text, tx.estimate_tokens(text), 4000, 900).alias("fits"))


def ece_logits(spark: SparkSession, d: str) -> DataFrame:
    return calibrate.ece_of_logits(logits(spark, d), 0.1).select("n", F.round("ece", 6).alias("ece"))


def threshold_artifact(spark: SparkSession, d: str) -> DataFrame:
    """The artifact of the sweep, of a band that is not calibrated, and of a refused one."""
    rows = confidences(spark, d).withColumn("correct", F.col("conf") > 0.7)
    sweep = calibrate.selective_risk(rows)
    made = [calibrate.routing_thresholds(sweep, *x) for x in ((0.01, 0.02), (0.2, 0.02), (0.01, 0.3), (0.01, None))]
    return spark.createDataFrame([(k, m["doc_confidence"], m["source"], m["reason"]) for k, m in enumerate(made)], "k int, doc_confidence double, source string, reason string")


def trace_spans(spark: SparkSession, d: str) -> DataFrame:
    rows = merge.guard_chain(_decided(spark, d), Gate(max_chars=6000)).withColumns({"filename": F.concat(F.lit("doc_"), "doc_id"), "confidence": F.lit(0.5)})
    out = ops.spans(rows, "intake", {"model_id": "m"})
    fields = {"name": "name", "chars": "input.chars", "route": "output.route", "model_id": "metadata.model_id", "reason": "quality.reason", "failure": "failure"}
    return out.select("filename", *[F.get_json_object("span", f"$.{p}").alias(n) for n, p in fields.items()])


def log_lines(spark: SparkSession, d: str) -> DataFrame:
    """Printed log lines made of orders: steps, test steps with and without the second figure, and noise."""
    k = F.col("o_orderkey")
    cents = (k % 100).cast("string")
    step = F.concat(F.lit("2024-01-01 step "), k, F.lit(" loss 0."), cents, F.lit(" 1.5 steps/s 12.0 samples/s ETA 3m "), cents, F.lit("s "))
    test = F.concat(F.lit("test doc "), k, F.lit("/999 doc_type_acc 0."), cents, F.when(k % 2 == 0, " subclass_cond 0.25").otherwise(""))
    line = F.when(k % 5 == 0, "noise").when(k % 3 == 0, test).otherwise(step)
    out = ops.parse_log(table(spark, d, "orders").select(line.alias("value")))
    n = F.col("numbers")
    return out.select("event", *[n[x].alias(x) for x in ("step", "loss", "doc_done", "doc_type_acc", "subclass_acc_conditional")], "eta")


def cap_sizes(spark: SparkSession, d: str) -> DataFrame:
    """New rows per class under the source cap, and the steps of a training run over them."""
    rows = corpus(spark, d).where("split = 'train'").groupBy("doc_type").agg(F.count("*").alias("n")).collect()  # a row per class
    made = [(r["doc_type"], enrich.source_matched_cap(r["n"], 1.25), *(ops.schedule(r["n"], 8, 4, 3, 0.1)[x] for x in ("micro_steps", "optimizer_steps", "warmup_steps"))) for r in rows]
    return spark.createDataFrame(made, "doc_type string, cap int, micro_steps int, optimizer_steps int, warmup_steps int")


def family_split(spark: SparkSession, d: str) -> DataFrame:
    """Families must be known; whole ones go to validation."""
    rows = table(spark, d, "conversations").withColumn("family", F.concat(F.lit("c"), "conv_id"))
    return split.grouped_split(rows, "family", 0.3, require=True).groupBy("split").agg(F.countDistinct("family").alias("families"), F.count("*").alias("n"))


def ordered_pools(spark: SparkSession, d: str) -> DataFrame:
    """Files of both result sets by name, and those of one only."""
    docs = corpus(spark, d)
    a, b = docs.where("split <> 'test'").select("filename"), docs.where("split <> 'train'").select("filename")
    sides = a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.exceptAll(b).withColumn("side", F.lit("first"))).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))
    return sides.groupBy("side").agg(F.count("*").alias("n"), F.min("filename").alias("first_filename"))


def duplicate_filenames(spark: SparkSession, d: str) -> DataFrame:
    """File names of each hash that several rows have, in order, joined."""
    return dedup.hash_files(corpus(spark, d)).select("content_sha256", "n", F.array_join("filenames", ",").alias("filenames"), F.array_join("splits", ",").alias("splits"))


def window_stats(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 200 words by document, bucketed, with the accuracy of the judged rows."""
    windows = cp.word_windows(corpus(spark, d), 200, 20, ["filename"]).groupBy("filename").agg(F.count("*").cast("int").alias("n_windows"))
    return evaluate.window_buckets(judged(spark, d).drop("n_windows").join(windows, "filename")).select("bucket", "n", F.round("accuracy", 9).alias("accuracy"))


QUERIES = {f.__name__: f for f in (text_predicates, json_fields, section_maps, llm_intake_decision, ece_logits, threshold_artifact, trace_spans, log_lines, cap_sizes, family_split, ordered_pools, duplicate_filenames, window_stats)}

_MESSY = r"(regexp_matches(doc_text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x{FFFD}]') OR length(regexp_replace(doc_text, '[^\pL\pN\pM_]', '', 'g')) / greatest(length(doc_text), 1)::DOUBLE < 0.5)"
_WORD = r"regexp_matches(lower(doc_text), '(^|[^\pL\pN\pM_])the($|[^\pL\pN\pM_])')"

ORACLE_SQL = {
    "text_predicates": _C + rf""", t AS (SELECT *, list_distinct(string_split(doc_text, ' ')[1:20]) AS a, list_distinct(string_split(doc_text, ' ')[11:30]) AS b FROM corpus)
        SELECT filename, trim(regexp_replace(lower(upper(subclass) || '__-  of - ' || doc_type), '[_ -]+', ' ', 'g')) AS folded_label,
        sha256(CASE WHEN doc_id % 3 = 0 AND regexp_matches(title, '[^\s\pZ]') THEN regexp_replace(title, '^[\s\pZ]+|[\s\pZ]+$', '', 'g') WHEN doc_id % 2 = 0 THEN 'Exhibit 1' ELSE '' END) AS title_sha256, doc_id % 7 <> 0 AND doc_id % 5 <> 0 AND doc_id % 3 <> 0 AND doc_id % 2 <> 0 AS truthy,
        {_WORD} AS cue_word, contains(lower(doc_text), 'in the') AS cue_phrase, contains(doc_text, '.') AS cue_mark, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE END, 9) AS overlap FROM t""",
    "json_fields": "SELECT event_id, event_type, json_extract_string(props, '$.k') AS k, NULL AS none, CASE WHEN event_id % 10 <> 0 THEN json_extract_string(props, '$.k') END AS deep FROM events",
    "section_maps": """WITH s AS (SELECT doc_id, [0, floor(n_chars / 3.0::DOUBLE - (doc_id % 3) * 5), floor(n_chars / 2.0::DOUBLE), floor((n_chars / 4.0::DOUBLE) * (doc_id % 5))] AS b, [floor(n_chars / 3.0::DOUBLE), floor(n_chars / 2.0::DOUBLE), floor(n_chars / 2.0::DOUBLE + doc_id % 4), n_chars] AS e FROM documents),
        a AS (SELECT *, CASE WHEN e[1] > b[1] THEN e[1] ELSE 0 END AS l1 FROM s), c AS (SELECT *, b[2] >= l1 AND e[2] > b[2] AS k2 FROM a), f AS (SELECT *, CASE WHEN k2 THEN e[2] ELSE l1 END AS l2 FROM c),
        g AS (SELECT *, b[3] >= l2 AND e[3] > b[3] AS k3 FROM f), h AS (SELECT *, CASE WHEN k3 THEN e[3] ELSE l2 END AS l3 FROM g)
        SELECT doc_id, concat_ws(',', CASE WHEN e[1] > b[1] THEN 's0' END, CASE WHEN k2 THEN 's1' END, CASE WHEN k3 THEN 's2' END, CASE WHEN b[4] >= l3 AND e[4] > b[4] THEN 's3' END) AS names FROM h""",
    "llm_intake_decision": _C + rf""", f AS (SELECT *, NOT regexp_matches(doc_text, '[^\s\pZ]') AS blank, {_MESSY} AS messy, greatest(1, round_even(length(doc_text) / 4.0::DOUBLE, 0)) AS tokens FROM corpus)
        SELECT filename, CASE WHEN blank THEN false WHEN messy THEN true WHEN doc_id % 9 = 0 OR doc_id % 10 = 0 OR doc_id % 4 = 0 THEN true ELSE NOT (doc_id % 6 > 0 AND doc_type IN ('en', 'fr')) END AS llm_runs, length(doc_text) <= 4000 AND tokens <= 900 AS fits FROM f""",
    "ece_logits": f"""WITH {LOGITS_SQL}, m AS (SELECT label, list_transform(logits, lambda z: exp((z - list_max(logits)) / 0.1::DOUBLE)) AS e, list_position(logits, list_max(logits)) - 1 AS said FROM logits), c AS (SELECT list_max(e) / list_sum(e) AS conf, said = label AS correct FROM m),
        b AS (SELECT *, least(floor(conf * 10), 9) AS bin FROM c), g AS (SELECT count(*) AS n, abs(avg(correct::INT) - avg(conf)) AS gap FROM b GROUP BY bin) SELECT sum(n)::BIGINT AS n, round(sum(n * gap) / sum(n), 6) AS ece FROM g""",
    "threshold_artifact": f"""WITH {CONF_SQL}, t AS (SELECT (60 + k) / 100.0::DOUBLE AS threshold FROM range(0, 40) r(k)), s AS (SELECT threshold, count(*)::DOUBLE AS n, count(*) FILTER (conf > 0.7::DOUBLE) AS hits FROM t JOIN conf ON conf >= threshold GROUP BY 1),
        r AS (SELECT threshold, n, 1 - greatest(0, (hits / n + 3.8416 / (2 * n) - 1.96 * sqrt((hits / n) * (1 - hits / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)) AS risk FROM s), p AS (SELECT min(threshold) FILTER (n >= 30 AND risk <= 0.02::DOUBLE) AS p FROM r)
        SELECT 0 AS k, coalesce(p, 0.9::DOUBLE) AS doc_confidence, CASE WHEN p IS NULL THEN 'fallback' ELSE 'sweep' END AS source, CASE WHEN p IS NULL THEN 'insufficient_data' ELSE 'picked' END AS reason FROM p UNION ALL SELECT 1, 0.9, 'fallback', 'insufficient_data' UNION ALL SELECT 2, 0.9, 'refused', 'ece_too_high' UNION ALL SELECT 3, 0.9, 'refused', 'no_ece'""",
    "trace_spans": f"WITH {_DECIDED} SELECT 'doc_' || doc_id AS filename, 'intake' AS name, chars::VARCHAR AS chars, CASE WHEN reason = 'fast_path' THEN 'fast_path' ELSE 'llm' END AS route, 'm' AS model_id, reason, CASE WHEN reason = 'fast_path' THEN 'false' ELSE 'true' END AS failure FROM chain",
    "log_lines": """WITH o AS (SELECT o_orderkey AS k, ('0.' || (o_orderkey % 100))::DOUBLE AS x FROM orders WHERE o_orderkey % 5 <> 0) SELECT CASE WHEN k % 3 = 0 THEN 'test_step' ELSE 'step' END AS event, CASE WHEN k % 3 <> 0 THEN k::DOUBLE END AS step, CASE WHEN k % 3 <> 0 THEN x END AS loss,
        CASE WHEN k % 3 = 0 THEN k::DOUBLE END AS doc_done, CASE WHEN k % 3 = 0 THEN x END AS doc_type_acc, CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN 0.25::DOUBLE END AS subclass_acc_conditional, CASE WHEN k % 3 <> 0 THEN '3m ' || (k % 100) || 's' END AS eta FROM o""",
    "cap_sizes": _C + ", n AS (SELECT doc_type, count(*) AS n FROM corpus WHERE split = 'train' GROUP BY 1), s AS (SELECT *, ceil(n / 8.0::DOUBLE)::INT AS m FROM n) SELECT doc_type, (round_even(1.25::DOUBLE * n, 0) - n)::INT AS cap, m * 3 AS micro_steps, ceil(m / 4.0::DOUBLE)::INT * 3 AS optimizer_steps, floor(ceil(m / 4.0::DOUBLE) * 3 * 0.1::DOUBLE)::INT AS warmup_steps FROM s",
    "family_split": """WITH f AS (SELECT family, row_number() OVER (ORDER BY sha256('42:' || family)) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT 'c' || conv_id AS family FROM conversations)), h AS (SELECT family FROM f WHERE r <= round_even(n * 0.3::DOUBLE, 0))
        SELECT CASE WHEN 'c' || conv_id IN (SELECT family FROM h) THEN 'validation' ELSE 'train' END AS split, count(DISTINCT conv_id) AS families, count(*) AS n FROM conversations GROUP BY 1""",
    "ordered_pools": _C + "SELECT CASE split WHEN 'validation' THEN 'both' WHEN 'train' THEN 'first' ELSE 'second' END AS side, count(*) AS n, min(filename) AS first_filename FROM corpus GROUP BY 1",
    "duplicate_filenames": _C + "SELECT content_sha256, count(*) AS n, array_to_string(list_sort(list(DISTINCT filename)), ',') AS filenames, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits FROM corpus GROUP BY 1 HAVING count(*) > 1",
    "window_stats": f"""WITH {CORPUS_SQL}, {JUDGED_SQL}, w AS (SELECT filename, len(regexp_extract_all(doc_text, '\\S+')) AS n FROM corpus), k AS (SELECT filename, greatest(0, ceil((n - 200) / 180.0::DOUBLE))::INT + 1 AS k FROM w WHERE n > 0)
        SELECT CASE WHEN k <= 1 THEN '1' WHEN k <= 3 THEN '2-3' WHEN k <= 8 THEN '4-8' ELSE '9+' END AS bucket, count(*) AS n, round(avg(dt_correct::INT), 9) AS accuracy FROM judged JOIN k USING (filename) GROUP BY 1""",
}
