"""Queries of scores: probabilities, calibration, votes, routing, evaluation; each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.functions import arrays as ar
from curata.functions.text import estimate_tokens, messy
from curata.operators import calibrate, evaluate, merge
from curata.plans.fixtures import CONF_SQL, CORPUS_SQL, JUDGED_SQL, LOGITS_SQL, confidences, corpus, judged, logits, predictions, table
from curata.settings import EDGES, Gate

#: A prior for each of the 64 classes of the embeddings as logits.
_PRIOR = [0.1 * (k % 9) - 0.4 for k in range(64)]


def softmax_window_probs(spark: SparkSession, d: str) -> DataFrame:
    probs = logits(spark, d).select("vec_id", F.posexplode(ar.softmax(F.col("logits"), 0.5)).alias("class_id", "p"))
    return probs.select("vec_id", "class_id", F.round("p", 6).alias("p"))


def energy_scores(spark: SparkSession, d: str) -> DataFrame:
    return logits(spark, d).select("vec_id", F.round(ar.energy(F.col("logits")), 6).alias("energy"))


def ood_threshold(spark: SparkSession, d: str) -> DataFrame:
    rows = logits(spark, d).select(ar.energy(F.col("logits")).alias("energy"))
    return calibrate.ood_threshold(rows).select(F.round("threshold", 6).alias("threshold"), "n")


def ood_flags(spark: SparkSession, d: str) -> DataFrame:
    rows = logits(spark, d).select("document", ar.energy(F.col("logits")).alias("energy"))
    return calibrate.ood_flags(rows, "document", -2.5).select("document", F.round("mean_energy", 6).alias("mean_energy"), "ood_flag")


def logit_adjusted_argmax(spark: SparkSession, d: str) -> DataFrame:
    return logits(spark, d).select("vec_id", ar.argmax(ar.adjusted(F.col("logits"), _PRIOR, 0.5)).alias("class_id"))


def ece_bins(spark: SparkSession, d: str) -> DataFrame:
    return calibrate.bins(confidences(spark, d)).select("bin", "n", F.round("mean_conf", 9).alias("mean_conf"), F.round("accuracy", 9).alias("accuracy"))


def ece(spark: SparkSession, d: str) -> DataFrame:
    return calibrate.ece(confidences(spark, d)).select("n", F.round("ece", 9).alias("ece"))


def band_ece(spark: SparkSession, d: str) -> DataFrame:
    return calibrate.band_ece(confidences(spark, d)).select("n", F.round("ece", 9).alias("ece"))


def reliability_table(spark: SparkSession, d: str) -> DataFrame:
    return calibrate.reliability(confidences(spark, d))


def wilson_bounds(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_quantity") > 25).alias("hits"))
    return rows.select("l_suppkey", F.round(ar.wilson_lower(F.col("hits"), F.col("n")), 9).alias("bound"))


def selective_risk_sweep(spark: SparkSession, d: str) -> DataFrame:
    return calibrate.selective_risk(confidences(spark, d)).select("threshold", "n", *[F.round(c, 9).alias(c) for c in ("coverage", "accuracy", "risk")])


def temperature_grid(spark: SparkSession, d: str) -> DataFrame:
    return calibrate.temperature_grid(logits(spark, d), [0.5, 1.0, 2.0]).select("temperature", F.round("nll", 6).alias("nll"))


def window_plurality_vote(spark: SparkSession, d: str) -> DataFrame:
    rows = logits(spark, d).select("document", "window_index", F.transform(ar.softmax(F.col("logits")), lambda p: F.round(p, 9)).alias("probs"))
    out = merge.window_votes(rows, "document")
    return out.select("document", "winner", "n_windows", "agreement", F.round("confidence", 6).alias("confidence"), F.round("margin", 6).alias("margin"))


def margin_runner_up(spark: SparkSession, d: str) -> DataFrame:
    rows = logits(spark, d).select("document", "window_index", F.transform(ar.softmax(F.col("logits")), lambda p: F.round(p, 9)).alias("probs"))
    return merge.window_votes(rows, "document").select("document", "runner_up")


def _decided(spark: SparkSession, d: str) -> DataFrame:
    rows, i = table(spark, d, "documents"), F.col("doc_id")
    head = F.when(F.col("lang") == "es", F.array(F.lit("src1"))).otherwise(F.array(F.lit("src1"), F.lit("src2"), F.lit("src3"), F.lit("src4"), F.lit("other")))
    return rows.select(
        "doc_id", F.col("lang").alias("doc_type"), F.col("source").alias("subclass"), F.col("n_chars").alias("chars"), (i % 19).alias("n_windows"), (i % 23 == 0).alias("all_abstained"), (i % 29 != 0).alias("vocab_ok"),
        (i % 31 == 0).alias("head_excluded"), merge.project(F.col("source"), head).alias("projected"), (i % 8).alias("support"), (i % 13 == 0).alias("ood_flag"),
        F.when(i % 40 == 4, float("nan")).otherwise((80 + i % 20) / 100.0).alias("confidence"), ((75 + i % 25) / 100.0).alias("subclass_confidence"), ((60 + i % 41) / 100.0).alias("agreement"), ((i % 50) / 100.0).alias("margin"),
    )


def guard_chain_route(spark: SparkSession, d: str) -> DataFrame:
    return merge.guard_chain(_decided(spark, d), Gate(max_chars=6000)).select("doc_id", "reason", "route")


def subclass_projection(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d).select("doc_id", "projected")


def intake_decision(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("doc_text")
    reason = merge.bert_intake(text, messy(text), estimate_tokens(text), max_chars=6000, max_tokens=2000)
    return corpus(spark, d).select("filename", reason.alias("reason"))


def intake_gate_pass_fail(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    rows = table(spark, d, "documents").select(
        "doc_id", F.when(i % 17 == 0, "llm").otherwise("bert").alias("method"), (i % 7 != 0).alias("context_fit"), F.when(i % 53 == 0, "none").when(i % 11 == 0, "0.5").otherwise("1.0").alias("coverage"), (i % 13 == 0).alias("messy"), (i % 3 % 2).alias("n_guard_failures"),
        F.when(i % 37 == 0, None).otherwise((85 + i % 15) / 100.0).alias("confidence"), (i % 19 != 0).alias("triage_vocab_ok"), (i % 23 != 0).alias("section_map_ok"), F.col("lang").alias("doc_type"),
        F.when(i % 5 == 0, None).when(i % 4 == 0, "en").otherwise(F.col("lang")).alias("sorter_type"), F.when(i % 2 == 0, None).when(i % 9 == 0, "fr").otherwise(F.col("lang")).alias("reviewer_type"),
    )
    return merge.intake_gate(rows, "verify", ["en"]).select("doc_id", "verdict", "failures", "recommended_action")


def handoff_json(spark: SparkSession, d: str) -> DataFrame:
    rows = merge.guard_chain(_decided(spark, d), Gate(max_chars=6000)).withColumn("confidence", F.lit(0.5))
    out = merge.handoff(rows, "doc_id")
    return out.select("doc_id", *[F.get_json_object("handoff", f"$.{p}").alias(n) for n, p in (("schema_version", "schema_version"), ("route", "routing.path"), ("reason", "routing.reason"), ("doc_chars", "routing.doc_chars"), ("windows", "provenance.intake_windows"), ("skip", "gate.eligible_for_sorter_skip"), ("doc_class", "triage.primary_doc_class"), ("context_fit", "quality.context_fit"))])


def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.confusion(predictions(spark, d).select(F.col("gt_doc_type").alias("gt"), F.col("pred_doc_type").alias("pred")))


def class_f1(spark: SparkSession, d: str) -> DataFrame:
    out = evaluate.f1_by_class(predictions(spark, d).select(F.col("gt_doc_type").alias("gt"), F.col("pred_doc_type").alias("pred")))
    return out.select("label", "support", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def macro_f1_observed(spark: SparkSession, d: str) -> DataFrame:
    out = evaluate.macro_f1(predictions(spark, d).select(F.col("gt_doc_type").alias("gt"), F.col("pred_doc_type").alias("pred")))
    return out.select("n_classes", F.round("macro_f1", 9).alias("macro_f1"))


def conditional_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.conditional_accuracy(judged(spark, d)).select("n", "n_conditional", F.round("doc_type_accuracy", 9).alias("doc_type_accuracy"), F.round("subclass_accuracy", 9).alias("subclass_accuracy"))


def slice_metrics_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.slices(judged(spark, d), "gt_doc_type").select("slice", "n", F.round("accuracy", 9).alias("accuracy"), "overall")


def cohort_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.cohorts(judged(spark, d)).select("cohort", "n", F.round("accuracy", 9).alias("accuracy"), F.round("mean_agreement", 9).alias("mean_agreement"))


def window_buckets(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.window_buckets(judged(spark, d)).select("bucket", "n", F.round("accuracy", 9).alias("accuracy"))


def head_support(spark: SparkSession, d: str) -> DataFrame:
    rows = predictions(spark, d).select(F.col("gt_subclass").alias("gt"))
    head = table(spark, d, "documents").select(F.explode(F.array("source", F.lit("unseen"))).alias("label"))
    return evaluate.head_support(rows, head)


def _other(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).withColumn("dt_correct", F.col("sc_correct"))


def paired_compare(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.compare(judged(spark, d), _other(spark, d)).select("n", "won", "lost", F.round("accuracy_a", 9).alias("accuracy_a"), F.round("accuracy_b", 9).alias("accuracy_b"))


def paired_bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.paired_bootstrap(judged(spark, d), _other(spark, d))


def ale_curve(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.ale_curve(judged(spark, d).withColumn("hit", F.col("dt_correct").cast("double")).withColumn("log_windows", F.log2("n_windows")), "log_windows", "hit", "agreement")


def score_auc(spark: SparkSession, d: str) -> DataFrame:
    rows = confidences(spark, d).select(F.col("conf").alias("score"), F.col("correct").cast("int").alias("label"))
    return evaluate.rank_auc(rows).select(F.round("auc", 9).alias("auc"), "n")


def release_gates(spark: SparkSession, d: str) -> DataFrame:
    rows = judged(spark, d).groupBy("gt_doc_type").agg(F.when(F.first("gt_doc_type") == "es", float("nan")).otherwise(F.avg(F.col("dt_correct").cast("double"))).alias("value"))
    return evaluate.gate_rows(rows.select(F.col("gt_doc_type").alias("name"), "value", F.lit(0.8).alias("bound"), (F.col("gt_doc_type") != "fr").alias("at_least"))).select("name", "status")


def scorer_parity(spark: SparkSession, d: str) -> DataFrame:
    rows = logits(spark, d)
    other = rows.select("vec_id", F.transform("logits", lambda z: F.round(z, 1)).alias("scores"))
    return evaluate.parity(rows.select("vec_id", F.col("logits").alias("scores")), other, "vec_id").select("n", F.round("max_diff", 9).alias("max_diff"), F.round("argmax_agreement", 9).alias("argmax_agreement"))


def select_epoch(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 12).cast("int").alias("epoch")).agg(F.round(F.avg(F.col("l_quantity")) / 50, 4).alias("objective"), F.round(F.avg("l_tax"), 4).alias("ece"))
    return evaluate.select_epoch(rows)


QUERIES = {f.__name__: f for f in (softmax_window_probs, energy_scores, ood_threshold, ood_flags, logit_adjusted_argmax, ece_bins, ece, band_ece, reliability_table, wilson_bounds, selective_risk_sweep, temperature_grid, window_plurality_vote, margin_runner_up, guard_chain_route, subclass_projection, intake_decision, intake_gate_pass_fail, handoff_json, confusion_matrix, class_f1, macro_f1_observed, conditional_accuracy, slice_metrics_grouping_sets, cohort_metrics, window_buckets, head_support, paired_compare, paired_bootstrap_ci, ale_curve, score_auc, release_gates, scorer_parity, select_epoch)}

_EDGES = "[" + ", ".join(f"{e!r}::DOUBLE" for e in EDGES) + "]"
_BAND = "[" + ", ".join(f"{e!r}::DOUBLE" for e in calibrate.band_edges()) + "]"
_BINNED = "b AS (SELECT *, least(len(list_filter({e}, lambda e: e <= conf)), 10) - 1 AS bin FROM conf WHERE conf >= {e}[1] AND conf <= {e}[11])"
_L = f"WITH {LOGITS_SQL}"
_ENERGY = "-(list_max(logits) + ln(list_sum(list_transform(logits, lambda z: exp(z - list_max(logits))))))"
_SOFT = ", m AS (SELECT *, list_max(logits) AS top FROM logits), p AS (SELECT *, list_transform(logits, lambda z: exp((z - top) / {t})) AS e FROM m), q AS (SELECT *, list_transform(e, lambda x: x / list_sum(e)) AS probs FROM p)"
_VOTES = _L + _SOFT.format(t="1.0") + """, r AS (SELECT document, window_index, list_transform(probs, lambda p: round(p, 9)) AS probs FROM q),
  v AS (SELECT *, list_position(probs, list_max(probs)) - 1 AS vote FROM r),
  t AS (SELECT document, vote, count(*) AS n, min(window_index) AS first FROM v GROUP BY 1, 2),
  w AS (SELECT document, vote AS winner, n AS top FROM t QUALIFY row_number() OVER (PARTITION BY document ORDER BY n DESC, first) = 1),
  c AS (SELECT document, unnest(range(0, 64)) AS class_id, unnest(probs) AS p FROM v),
  a AS (SELECT document, class_id, avg(p) AS p FROM c GROUP BY 1, 2), s AS (SELECT document, count(*) AS n_windows FROM v GROUP BY 1)"""
_DECIDED = """decided AS (SELECT doc_id, lang AS doc_type, source AS subclass, n_chars AS chars, doc_id % 19 AS n_windows, doc_id % 23 = 0 AS all_abstained, doc_id % 29 <> 0 AS vocab_ok,
  doc_id % 31 = 0 AS head_excluded, CASE WHEN lang = 'es' THEN CASE WHEN source = 'src1' THEN source END WHEN source IN ('src1', 'src2', 'src3', 'src4') THEN source ELSE 'other' END AS projected, doc_id % 8 AS support,
  doc_id % 13 = 0 AS ood_flag, CASE WHEN doc_id % 40 = 4 THEN NULL ELSE (80 + doc_id % 20) / 100.0::DOUBLE END AS confidence, (75 + doc_id % 25) / 100.0::DOUBLE AS subclass_confidence,
  (60 + doc_id % 41) / 100.0::DOUBLE AS agreement, (doc_id % 50) / 100.0::DOUBLE AS margin FROM documents),
  chain AS (SELECT *, CASE WHEN chars > 6000 THEN 'oversize_chars' WHEN n_windows = 0 THEN 'no_windows' WHEN all_abstained THEN 'all_abstained' WHEN NOT vocab_ok THEN 'vocab_fail'
  WHEN head_excluded THEN 'head_excluded' WHEN projected IS NULL THEN 'subclass_unmapped' WHEN projected = 'other' THEN 'catchall_label' WHEN support < 5 THEN 'insufficient_support' WHEN ood_flag THEN 'ood'
  WHEN confidence IS NULL OR confidence < 0.9::DOUBLE OR subclass_confidence < 0.85::DOUBLE OR agreement < 0.75::DOUBLE OR margin < 0.1::DOUBLE THEN 'gate_fail' ELSE 'fast_path' END AS reason FROM decided)"""
_J = f"WITH {JUDGED_SQL} "
_WILSON = "greatest(0.0, coalesce(({h} / n::DOUBLE + 3.8416 / (2 * n) - 1.96 * sqrt(({h} / n::DOUBLE) * (1 - {h} / n::DOUBLE) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n), 0.0))"

ORACLE_SQL = {
    "softmax_window_probs": _L + _SOFT.format(t="0.5") + " SELECT vec_id, unnest(range(0, 64))::INT AS class_id, round(unnest(probs), 6) AS p FROM q",
    "energy_scores": _L + f" SELECT vec_id, round({_ENERGY}, 6) AS energy FROM logits",
    "ood_threshold": _L + f" SELECT round(quantile_cont({_ENERGY}, 0.05), 6) AS threshold, count(*) AS n FROM logits",
    "ood_flags": _L + f", e AS (SELECT document, avg({_ENERGY}) AS m FROM logits GROUP BY 1) SELECT document, round(m, 6) AS mean_energy, m > -2.5 AS ood_flag FROM e",
    "logit_adjusted_argmax": _L + f", a AS (SELECT vec_id, list_transform(logits, lambda z, i: z + 0.5::DOUBLE * [{', '.join(repr(p) + '::DOUBLE' for p in _PRIOR)}][i]) AS l FROM logits) SELECT vec_id, (list_position(l, list_max(l)) - 1)::INT AS class_id FROM a",
    "ece_bins": f"WITH {CONF_SQL}, {_BINNED.format(e=_EDGES)} SELECT bin::INT AS bin, count(*) AS n, round(avg(conf), 9) AS mean_conf, round(avg(correct::INT), 9) AS accuracy FROM b GROUP BY 1",
    "ece": f"WITH {CONF_SQL}, {_BINNED.format(e=_EDGES)}, g AS (SELECT count(*) AS n, abs(avg(correct::INT) - avg(conf)) AS gap FROM b GROUP BY bin) SELECT sum(n)::BIGINT AS n, round(sum(n * gap) / sum(n), 9) AS ece FROM g",
    "band_ece": f"WITH {CONF_SQL}, {_BINNED.format(e=_BAND)}, g AS (SELECT count(*) AS n, abs(avg(correct::INT) - avg(conf)) AS gap FROM b GROUP BY bin) SELECT sum(n)::BIGINT AS n, round(sum(n * gap) / sum(n), 9) AS ece FROM g",
    "reliability_table": f"WITH {CONF_SQL}, {_BINNED.format(e=_EDGES)}, g AS (SELECT bin, count(*) AS n, round(avg(conf), 4) AS mean_conf, round(avg(correct::INT), 4) AS accuracy FROM b GROUP BY 1)"
    + " SELECT k::INT AS bin, '[' || printf('%.1f', k / 10.0) || ',' || printf('%.1f', (k + 1) / 10.0) || CASE WHEN k = 9 THEN ']' ELSE ')' END AS label, coalesce(n, 0) AS n, mean_conf, accuracy FROM range(0, 10) r(k) LEFT JOIN g ON g.bin = k",
    "wilson_bounds": f"WITH s AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_quantity > 25) AS hits FROM lineitem GROUP BY 1) SELECT l_suppkey, round({_WILSON.format(h='hits')}, 9) AS bound FROM s",
    "selective_risk_sweep": f"WITH {CONF_SQL}, t AS (SELECT (60 + k) / 100.0::DOUBLE AS threshold FROM range(0, 40) r(k)), c AS (SELECT conf, count(*) AS m, count(*) FILTER (correct) AS h FROM conf GROUP BY 1), s AS (SELECT threshold, coalesce(sum(m), 0)::BIGINT AS n, coalesce(sum(h), 0)::BIGINT AS hits FROM t LEFT JOIN c ON conf >= threshold GROUP BY 1)"
    + f" SELECT threshold, n, round(n / (SELECT count(*) FROM conf)::DOUBLE, 9) AS coverage, round(hits / nullif(n, 0)::DOUBLE, 9) AS accuracy, round(CASE WHEN n > 0 THEN 1 - {_WILSON.format(h='hits')} ELSE 1.0 END, 9) AS risk FROM s",
    "temperature_grid": _L + ", t AS (SELECT unnest([0.5, 1.0, 2.0])::DOUBLE AS temperature) SELECT temperature, round(avg(-ln(greatest(exp((logits[label + 1] - list_max(logits)) / temperature) / list_sum(list_transform(logits, lambda z: exp((z - list_max(logits)) / temperature))), 1e-300))), 6) AS nll FROM logits, t GROUP BY 1",
    "window_plurality_vote": _VOTES + """, o AS (SELECT a.document, max(p) FILTER (class_id = winner) AS confidence, max(p) FILTER (class_id <> winner) AS second FROM a JOIN w USING (document) GROUP BY 1)
        SELECT document, winner::INT AS winner, n_windows, top / n_windows::DOUBLE AS agreement, round(confidence, 6) AS confidence, round(confidence - second, 6) AS margin FROM w JOIN s USING (document) JOIN o USING (document)""",
    "margin_runner_up": _VOTES + " SELECT document, class_id::INT AS runner_up FROM a JOIN w USING (document) WHERE class_id <> winner QUALIFY row_number() OVER (PARTITION BY document ORDER BY p DESC, class_id DESC) = 1",
    "guard_chain_route": f"WITH {_DECIDED} SELECT doc_id, reason, CASE WHEN reason = 'fast_path' THEN 'fast_path' ELSE 'llm' END AS route FROM chain",
    "subclass_projection": f"WITH {_DECIDED} SELECT doc_id, projected FROM decided",
    "intake_decision": f"WITH {CORPUS_SQL}" + r""", f AS (SELECT filename, doc_text, greatest(1, round_even(length(doc_text) / 4.0::DOUBLE, 0)) AS tokens,
        regexp_matches(doc_text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x{FFFD}]') OR length(regexp_replace(doc_text, '[^\pL\pN\pM_]', '', 'g')) / greatest(length(doc_text), 1)::DOUBLE < 0.5 AS messy FROM corpus)
        SELECT filename, CASE WHEN trim(doc_text, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'empty' WHEN messy THEN 'messy' WHEN tokens > 2000 THEN 'oversize_tokens' WHEN length(doc_text) > 6000 THEN 'oversize_chars' ELSE 'within_bert_ctx' END AS reason FROM f""",
    "intake_gate_pass_fail": """WITH r AS (SELECT doc_id, lang AS dt, doc_id % 17 <> 0 AND doc_id % 7 <> 0 AND doc_id % 11 <> 0 AS p1, doc_id % 13 <> 0 AND doc_id % 3 % 2 = 0 AS p2,
        doc_id % 37 <> 0 AND (85 + doc_id % 15) / 100.0::DOUBLE >= 0.9::DOUBLE AS p3, doc_id % 19 <> 0 AS p4, doc_id % 23 <> 0 AS p5,
        CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 4 = 0 THEN 'en' ELSE lang END AS st, CASE WHEN doc_id % 2 = 0 THEN NULL WHEN doc_id % 9 = 0 THEN 'fr' ELSE lang END AS rt FROM documents),
        q AS (SELECT *, st IS NOT NULL AND st = dt AS p6, rt IS NULL OR rt = dt OR coalesce(rt = st, false) AS p7 FROM r)
        SELECT doc_id, CASE WHEN doc_id % 53 <> 0 AND p1 AND p2 AND p3 AND p4 AND p5 AND p6 AND p7 THEN 'PASS' ELSE 'FAIL' END AS verdict,
        CASE WHEN doc_id % 53 = 0 THEN 'F7' ELSE concat_ws(',', CASE WHEN NOT p1 THEN 'F1' END, CASE WHEN NOT p2 THEN 'F2' END, CASE WHEN NOT p3 THEN 'F3' END, CASE WHEN NOT p4 OR NOT p5 THEN 'F4' END, CASE WHEN NOT p6 THEN 'F5' END, CASE WHEN NOT p7 THEN 'F6' END) END AS failures,
        CASE WHEN doc_id % 53 = 0 THEN 'force_llm_sorter' WHEN NOT p7 THEN 'escalate_reviewer' WHEN NOT p6 THEN 'force_llm_sorter' WHEN p1 AND p2 AND p3 AND p4 AND p5 THEN 'verify_with_sorter' ELSE 'force_llm_sorter' END AS recommended_action FROM q""",
    "handoff_json": f"WITH {_DECIDED} SELECT doc_id, '1' AS schema_version, chars::VARCHAR AS doc_chars, n_windows::VARCHAR AS windows, 'false' AS skip, CASE WHEN reason = 'fast_path' THEN 'fast_path' ELSE 'llm' END AS route, reason, doc_type AS doc_class, CASE WHEN chars <= 30000 THEN 'true' ELSE 'false' END AS context_fit FROM chain",
    "confusion_matrix": _J + "SELECT gt_doc_type AS gt, pred_doc_type AS pred, count(*) AS n FROM predictions GROUP BY 1, 2",
    "class_f1": _J + """, s AS (SELECT gt_doc_type AS label, count(*) AS support, count(*) FILTER (dt_correct) AS tp FROM judged GROUP BY 1), p AS (SELECT pred_doc_type AS label, count(*) AS said FROM judged WHERE pred_doc_type IS NOT NULL GROUP BY 1)
        SELECT label, support, round(coalesce(tp / nullif(said, 0)::DOUBLE, 0), 9) AS precision, round(tp / support::DOUBLE, 9) AS recall, round(2 * tp / (support + coalesce(said, 0))::DOUBLE, 9) AS f1 FROM s LEFT JOIN p USING (label)""",
    "macro_f1_observed": _J + """, s AS (SELECT gt_doc_type AS label, count(*) AS support, count(*) FILTER (dt_correct) AS tp FROM judged GROUP BY 1), p AS (SELECT pred_doc_type AS label, count(*) AS said FROM judged WHERE pred_doc_type IS NOT NULL GROUP BY 1)
        SELECT count(*) AS n_classes, round(avg(2 * tp / (support + coalesce(said, 0))::DOUBLE), 9) AS macro_f1 FROM s LEFT JOIN p USING (label)""",
    "conditional_accuracy": _J + "SELECT count(*) AS n, count(*) FILTER (dt_correct) AS n_conditional, round(avg(dt_correct::INT), 9) AS doc_type_accuracy, round(count(*) FILTER (dt_correct AND sc_correct) / count(*) FILTER (dt_correct)::DOUBLE, 9) AS subclass_accuracy FROM judged",
    "slice_metrics_grouping_sets": _J + "SELECT gt_doc_type AS slice, count(*) AS n, round(avg(dt_correct::INT), 9) AS accuracy, grouping(gt_doc_type) > 0 AS overall FROM judged GROUP BY GROUPING SETS ((), (gt_doc_type))",
    "cohort_metrics": _J + "SELECT CASE WHEN n_windows = 1 THEN 'single' ELSE 'multi' END AS cohort, count(*) AS n, round(avg(dt_correct::INT), 9) AS accuracy, round(avg(agreement), 9) AS mean_agreement FROM judged GROUP BY 1",
    "window_buckets": _J + "SELECT CASE WHEN n_windows <= 1 THEN '1' WHEN n_windows <= 3 THEN '2-3' WHEN n_windows <= 8 THEN '4-8' ELSE '9+' END AS bucket, count(*) AS n, round(avg(dt_correct::INT), 9) AS accuracy FROM judged GROUP BY 1",
    "head_support": "SELECT source AS label, count(*) AS support FROM documents GROUP BY 1 UNION ALL SELECT 'unseen', 0",
    "paired_compare": _J + "SELECT count(*) AS n, count(*) FILTER (sc_correct AND NOT dt_correct) AS won, count(*) FILTER (dt_correct AND NOT sc_correct) AS lost, round(avg(dt_correct::INT), 9) AS accuracy_a, round(avg(sc_correct::INT), 9) AS accuracy_b FROM judged",
    "score_auc": f"WITH {CONF_SQL}, t AS (SELECT conf, count(*) FILTER (correct) AS pos, count(*) AS n FROM conf GROUP BY 1), r AS (SELECT *, sum(n) OVER (ORDER BY conf) - n + (n + 1) / 2.0 AS mid FROM t) SELECT round((sum(pos * mid) - sum(pos) * (sum(pos) + 1) / 2) / (sum(pos) * (sum(n) - sum(pos)))::DOUBLE, 9) AS auc, sum(n)::BIGINT AS n FROM r",
    "release_gates": _J + ", g AS (SELECT gt_doc_type AS name, avg(dt_correct::INT) AS v FROM judged GROUP BY 1) SELECT name, CASE WHEN name = 'es' THEN 'MISSING' WHEN name = 'fr' THEN CASE WHEN v <= 0.8 THEN 'PASS' ELSE 'FAIL' END WHEN v >= 0.8 THEN 'PASS' ELSE 'FAIL' END AS status FROM g",
    "scorer_parity": _L + ", r AS (SELECT logits AS x, list_transform(logits, lambda z: round(z, 1)) AS y FROM logits) SELECT count(*) AS n, round(max(list_max(list_transform(x, lambda z, i: abs(z - y[i])))), 9) AS max_diff, round(avg((list_position(x, list_max(x)) = list_position(y, list_max(y)))::INT), 9) AS argmax_agreement FROM r",
    "select_epoch": "WITH e AS (SELECT (l_orderkey % 12)::INT AS epoch, round(avg(l_quantity) / 50, 4) AS objective, round(avg(l_tax), 4) AS ece FROM lineitem GROUP BY 1), b AS (SELECT *, max(objective) FILTER (ece <= 0.05) OVER () AS c, max(objective) OVER () AS a FROM e) SELECT epoch, objective, ece FROM b WHERE CASE WHEN c IS NOT NULL THEN ece <= 0.05 AND objective >= c - 0.005 ELSE objective >= a - 0.005 END ORDER BY objective DESC, epoch LIMIT 1",
}
