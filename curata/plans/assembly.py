"""Queries of pools, gates, windows, heads and reports; each with its DuckDB SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.functions import arrays as ar
from curata.functions.text import clean, compose
from curata.operators import corpus as cp
from curata.operators import labels, pools, report
from curata.operators.gates import CARD, seven_gates
from curata.plans.enrichment import _CAND, _candidates, _grams
from curata.plans.fixtures import CORPUS_SQL, JUDGED_SQL, corpus, judged, table

_C = f"WITH {CORPUS_SQL} "
_J = f"WITH {JUDGED_SQL} "
_HEAD = [f"src{k}" for k in range(15)]


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """The corpus as stored: with the hash of the cleaned text."""
    docs = corpus(spark, d)
    return compose(docs.withColumn("__t", F.col("doc_text")), "__t").withColumn("text_sha256", F.sha2(clean(F.col("__t")), 256)).drop("__t")


def _sent(spark: SparkSession, d: str) -> DataFrame:
    """A pool from the test split: some rows take the name of another file, some titles name the label."""
    i = F.col("doc_id")
    docs = corpus(spark, d).where("split = 'test'")
    return docs.select("doc_id", F.concat(F.lit("doc_"), F.when(i % 5 == 0, i + 1).otherwise(i)).alias("id"), F.struct(F.concat("doc_text", F.lit("  \n")).alias("doc_text")).alias("input"), F.to_json(F.struct(F.col("subclass").alias("category"))).alias("metadata"), F.when(i % 7 == 0, F.concat(F.lit("The "), F.upper("subclass"), F.lit(" file"))).otherwise("A file").alias("title"), F.col("doc_type").alias("expected"))


def _spec(**more: object) -> pools.Spec:
    return pools.Spec(**({"doc_type": "en", "label_source": "pool", "lineage": "pool", "head": _HEAD, "normalize": lambda raw: labels.enum_label(raw, _HEAD), "labels": ["subclass", "category"], "title": "title", "class_column": "expected", "cap": 1.03} | more))


def source_pool(spark: SparkSession, d: str) -> DataFrame:
    done = pools.assemble(_sent(spark, d), _stored(spark, d).where("split <> 'test'"), _spec())
    return done.kept.select("filename", F.lit("kept").alias("reason"), "content_sha256", "title", "label_source", "tier").unionByName(done.rejected, allowMissingColumns=True)


def render_pool(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus(spark, d).where("split = 'test'").select("filename", F.when(F.col("doc_id") % 3 > 0, F.col("doc_text")).alias("doc_text"))
    done = pools.assemble(rows, _stored(spark, d).where("split <> 'test'"), _spec(fixed="src1", normalize=None, exact=True, render=True, class_column=None, title=None, cap=None))
    return done.kept.select("filename", F.lit("kept").alias("reason")).unionByName(done.rejected).unionByName(done.needs_render)


def pseudo_documents(spark: SparkSession, d: str) -> DataFrame:
    family = F.floor(F.col("doc_id") / 2)
    canonical = _stored(spark, d).where("split <> 'validation'").withColumns({"family": family, "doc_type": F.lit("correspondence")})
    rows = _candidates(spark, d).where("split = 'validation'").withColumn("family", family)
    done = pools.pseudo_documents(rows, canonical, [f"src{k}" for k in range(17)], max_fraction=0.02, family="family", doc_conf=0.85, sub_conf=0.86, agreement=0.87)
    return done.kept.select("filename", F.lit("kept").alias("reason"), "label_confidence", "example_weight").unionByName(done.rejected, allowMissingColumns=True)


def held_out_rows(spark: SparkSession, d: str) -> DataFrame:
    docs, i = corpus(spark, d), F.col("doc_id")
    name = F.when(i % 2 == 0, F.concat(F.lit("new_"), i)).otherwise(F.col("filename"))
    rows = docs.select(name.alias("filename"), F.col("doc_type").alias("expected"), F.col("subclass").alias("expected_subclass"))
    texts = docs.where("split <> 'validation'").select(name.alias("filename"), F.col("doc_text").alias("text"), F.col("title").alias("subject"))
    canonical = _stored(spark, d).withColumn("content_sha256", F.col("text_sha256"))
    return pools.held_out(rows, texts, canonical, lambda raw: labels.enum_label(raw, _HEAD), "en").select("filename", "reason", F.when(F.col("reason").isNull(), F.col("subclass")).alias("subclass"))


_CUES = {"en": ["the", "and"], "fr": ["le", "que"], "de": ["und", "der"], "es": ["que", "el"]}


def _cards(spark: SparkSession) -> DataFrame:
    rows = [(c, f"src{k}", _CUES[c] if k % 2 else [], ["no such cue here"] if k % 3 else [], [], ["a"] if k % 5 == 0 else [], ["all rights reserved"] if k % 4 == 0 else []) for c in _CUES for k in range(18)]
    return spark.createDataFrame(rows, CARD)


def _synthetic(spark: SparkSession, d: str) -> DataFrame:
    i, sub = F.col("doc_id"), F.col("subclass")
    verdict = F.struct(F.when(i % 5 == 0, "").otherwise(F.col("doc_type")).alias("parent_class"), F.when(i % 22 == 1, "").when(i % 14 == 1, "src0").otherwise(sub).alias("subclass"))
    return corpus(spark, d).where("split <> 'test'").select(
        "doc_id", "filename", F.col("doc_type").alias("parent_class"), "subclass", F.when(i % 13 == 0, "").otherwise(F.col("doc_text")).alias("doc_text"), F.when(i % 17 == 0, " ").otherwise("A title").alias("title"),
        F.when(i % 3 > 0, verdict).alias("adjudication"), F.when(i % 19 > 0, F.col("doc_type")).alias("model_doc_type"), F.when(i % 10 == 3, "src0").otherwise(sub).alias("model_subclass"), F.when(i % 9 == 0, float("nan")).when(i % 8 > 0, (i % 100) / 100.0).alias("model_probability"),
    )


def seven_gates_first_failure(spark: SparkSession, d: str) -> DataFrame:
    """All rows outside test against the benchmark, and against the test rows' texts for diversity."""
    held = table(spark, d, "benchmark").select(F.col("text").alias("doc_text"))
    pool = corpus(spark, d).where("split = 'test'").select("doc_text")
    return seven_gates(_synthetic(spark, d), _cards(spark), held, "doc_id", ["Apache License"], pool, probability=0.2).select("doc_id", "passed", "first_failure", "reason")


def enrichment_windows(spark: SparkSession, d: str) -> DataFrame:
    size = F.greatest(F.lit(1), F.ceil(F.length("doc_text") / 400)).cast("int")
    docs = corpus(spark, d).withColumn("windows", F.transform(F.sequence(F.lit(0), size - 1), lambda k: F.substr("doc_text", k * 400 + 1, F.lit(400))))
    return pools.enrichment_windows(docs).select("filename", "window_index", "n_windows", F.sha2("text", 256).alias("text_sha256"), "window_tokens", "split")


class Words:
    """A tokenizer of white-space words."""

    def encode(self, text: str) -> list[str]:
        return re.findall(r"[^ \t\n\x0b\f\r]+", text)

    def decode(self, ids: list[str]) -> str:
        return " ".join(ids)


def token_windows(spark: SparkSession, d: str) -> DataFrame:
    out = cp.token_windows(corpus(spark, d).withColumn("title", F.lit("A short title")), Words, 200, 40, version=2)
    return out.select("filename", "window_index", "n_windows", F.sha2("window_text", 256).alias("text_sha256"))


_ORDER, _FULL, _ROUTED = {"en": ["src3", "src1", "never"]}, {"fr": [f"src{k}" for k in range(21, -1, -1)]}, {"fr": ["src2"], "en": ["src1"]}


def head_table(spark: SparkSession, d: str) -> DataFrame:
    out = labels.head_table(corpus(spark, d), _ORDER, _FULL, _ROUTED)
    return out.select("doc_type", "subclass", "place", F.round("weight", 9).alias("weight"), "inference_only", "trainable_place")


def support_replay(spark: SparkSession, d: str) -> DataFrame:
    """Labels with few train rows are remapped or dropped, and the plan is replayed on the test split."""
    docs = corpus(spark, d)
    heads = docs.select("doc_type", "subclass").distinct().unionByName(spark.createDataFrame([("en", "other"), ("fr", "other")], "doc_type string, subclass string"))
    plan = labels.support_plan(docs.where("split = 'train'"), heads, 9)
    return labels.apply_support(docs.where("split = 'test'"), plan).groupBy("doc_type", "subclass").agg(F.count("*").alias("n"))


def clamped_priors(spark: SparkSession, d: str) -> DataFrame:
    rows = cp.class_weights(corpus(spark, d)).collect()  # a row per label
    weights = {r["subclass"]: r["weight"] for r in rows} | {"unseen": None}
    names = sorted(weights)
    prior, bounded = (ar.log_prior([weights[x] for x in names], r) for r in (0.0, 1.2))
    loss = ar.loss_weights({k: v for k, v in weights.items() if v}, names, "sqrt-inverse", 1.02)
    return spark.createDataFrame([(a, round(b, 9), round(c, 9), round(e, 9)) for a, b, c, e in zip(names, prior, bounded, loss, strict=True)], "subclass string, prior double, bounded double, loss_weight double")


def subclass_stats(spark: SparkSession, d: str) -> DataFrame:
    return report.subclass_stats(judged(spark, d))


def best_and_worst(spark: SparkSession, d: str) -> DataFrame:
    out = report.best_and_worst(judged(spark, d))
    return out.select("best_class", F.round("best_accuracy", 9).alias("best_accuracy"), "best_n", "worst_class", F.round("worst_accuracy", 9).alias("worst_accuracy"), "worst_n")


def error_rows(spark: SparkSession, d: str) -> DataFrame:
    return report.error_rows(judged(spark, d))


def comparable_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = judged(spark, d).withColumns({"fast_path": F.col("agreement") > 0.5, "ood_flag": F.col("agreement") < 0.05})
    out = report.comparable(rows)
    return out.select([F.round(c, 6).alias(c) if t == "double" else c for c, t in out.dtypes])


def macro_f1_all(spark: SparkSession, d: str) -> DataFrame:
    rows = judged(spark, d).select(F.col("gt_doc_type").alias("gt"), F.col("pred_doc_type").alias("pred"))
    heads = spark.createDataFrame([("en",), ("fr",), ("de",), ("es",), ("unknown",)], "label string")
    return report.macro_f1_all(rows, heads).select("n_classes", F.round("macro_f1", 9).alias("macro_f1"))


def plus_slice(spark: SparkSession, d: str) -> DataFrame:
    docs = corpus(spark, d)
    return report.plus_slice(docs, docs.where("split = 'test'")).groupBy("doc_type").agg(F.count("*").alias("n"))


def head_ece_policy(spark: SparkSession, d: str) -> DataFrame:
    rows = judged(spark, d).groupBy(F.col("gt_doc_type").alias("head")).agg(F.abs(F.avg("agreement") - F.avg(F.col("dt_correct").cast("double"))).alias("ece"))
    return report.head_ece_policy(rows.withColumn("excluded", F.col("head") == "fr"), 0.4).select("head", "status")


QUERIES = {f.__name__: f for f in (source_pool, render_pool, pseudo_documents, held_out_rows, seven_gates_first_failure, enrichment_windows, token_windows, head_table, support_replay, clamped_priors, subclass_stats, best_and_worst, error_rows, comparable_metrics, macro_f1_all, plus_slice, head_ece_policy)}

_ODD = "chr(160) || chr(8232) || chr(8233) || chr(8203) || chr(8204) || chr(8205) || chr(65279) || chr(8288)"


def _clean_sql(text: str) -> str:
    """The cleaned text in SQL; words broken at line ends are joined twice, for the pattern takes the letters with it."""
    lines = rf"regexp_replace(translate(replace(replace(nfc_normalize({text}), chr(13) || chr(10), chr(10)), chr(13), chr(10)), {_ODD}, ' ' || chr(10) || chr(10)), '[\x00-\x08\x0b\x0c\x0e-\x1f]', ' ', 'g')"
    for _ in range(2):
        lines = rf"regexp_replace({lines}, '([A-Za-z])-\n([A-Za-z])', '\1\2', 'g')"
    right = rf"list_transform(string_split(regexp_replace({lines}, '\n[ \t]*\n(?:[ \t]*\n)+', chr(10) || chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '[\s\pZ]+$', ''))"
    each = rf"list_transform({right}, lambda x: CASE WHEN regexp_matches(x, '^[\s\pZ]*\|') AND ends_with(x, '|') THEN x ELSE regexp_replace(regexp_replace(x, '[\t\x0b\f\r\pZ]{{2,}}', ' ', 'g'), '^[\s\pZ]+', '') END)"
    return rf"regexp_replace(array_to_string({each}, chr(10)), '^\n+|\n+$', '', 'g')"


_HEADS = ", ".join(f"'{x}'" for x in _HEAD)
_STORED = CORPUS_SQL + f", stored AS (SELECT *, sha256({_clean_sql('doc_text')}) AS t FROM corpus)"
# Own duplicates by cleaned text, names of other content, content of the corpus: in that order.
_HYGIENE = """, f1 AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY t ORDER BY filename, h) > 1 THEN 'duplicate_sha' END AS r1 FROM f0 WHERE reason IS NULL),
  f2 AS (SELECT *, CASE WHEN filename IN (SELECT filename FROM known) AND NOT EXISTS (SELECT 1 FROM known k WHERE k.filename = f1.filename AND (k.content_sha256 = f1.h OR k.t = f1.t)) THEN 'filename_collision' END AS r2 FROM f1 WHERE r1 IS NULL),
  f3 AS (SELECT *, CASE WHEN h IN (SELECT x FROM hashes) OR t IN (SELECT x FROM hashes) THEN 'duplicate_sha_canonical' END AS r3 FROM f2 WHERE r2 IS NULL)"""
_KNOWN = ", known AS (SELECT * FROM stored WHERE split <> 'test'), hashes AS (SELECT content_sha256 AS x FROM known UNION SELECT t FROM known)"
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_CARDS = "cards AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', 'src{k}', {_LIST(_CUES[c] if k % 2 else [])}::VARCHAR[], {k % 5 == 0}, {k % 4 == 0})" for c in _CUES for k in range(18)) + ") c(parent_class, subclass, cues, need_a, banned))"

ORACLE_SQL = {
    "source_pool": f"""WITH {_STORED}{_KNOWN}, p AS (SELECT 'doc_' || (CASE WHEN doc_id % 5 = 0 THEN doc_id + 1 ELSE doc_id END) AS filename, doc_type, subclass, doc_text, doc_id, sha256(doc_text || '  ' || chr(10)) AS h, sha256({_clean_sql("doc_text || '  ' || chr(10)")}) AS t FROM corpus WHERE split = 'test'),
        f0 AS (SELECT *, CASE WHEN doc_type <> 'en' THEN 'not_en' WHEN NOT regexp_matches(doc_text, '[^\\s\\pZ]') THEN 'missing_doc_text' WHEN subclass NOT IN ({_HEADS}) THEN 'subclass_not_on_head' WHEN doc_id % 7 = 0 THEN 'leak_title' END AS reason FROM p){_HYGIENE},
        n AS (SELECT round_even(1.03::DOUBLE * count(*), 0)::BIGINT - count(*) AS cap FROM corpus WHERE split = 'train' AND doc_type = 'en'),
        f4 AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY filename) > (SELECT cap FROM n) THEN 'cap_en' END AS r4 FROM f3 WHERE r3 IS NULL)
        SELECT filename, reason, NULL AS content_sha256, NULL AS title, NULL AS label_source, NULL::INT AS tier FROM f0 WHERE reason IS NOT NULL UNION ALL SELECT filename, r1, NULL, NULL, NULL, NULL FROM f1 WHERE r1 IS NOT NULL UNION ALL SELECT filename, r2, NULL, NULL, NULL, NULL FROM f2 WHERE r2 IS NOT NULL
        UNION ALL SELECT filename, r3, NULL, NULL, NULL, NULL FROM f3 WHERE r3 IS NOT NULL UNION ALL SELECT filename, coalesce(r4, 'kept'), CASE WHEN r4 IS NULL THEN h END, CASE WHEN r4 IS NULL THEN '' END, CASE WHEN r4 IS NULL THEN 'pool' END, CASE WHEN r4 IS NULL THEN 1 END FROM f4""",
    "render_pool": f"""WITH {_STORED}{_KNOWN}, f0 AS (SELECT filename, content_sha256 AS h, t, CASE WHEN doc_id % 3 = 0 OR NOT regexp_matches(doc_text, '[^\\s\\pZ]') THEN 'needs_render' END AS reason FROM stored WHERE split = 'test'){_HYGIENE}
        SELECT filename, reason FROM f0 WHERE reason IS NOT NULL UNION ALL SELECT filename, r1 FROM f1 WHERE r1 IS NOT NULL UNION ALL SELECT filename, r2 FROM f2 WHERE r2 IS NOT NULL UNION ALL SELECT filename, coalesce(r3, 'kept') FROM f3""",
    "pseudo_documents": f"""WITH {_CAND}, stored AS (SELECT *, sha256({_clean_sql('doc_text')}) AS t FROM cand), known AS (SELECT * FROM stored WHERE split <> 'validation'), hashes AS (SELECT content_sha256 AS x FROM known UNION SELECT t FROM known),
        g AS (SELECT *, round_even(least(dc, sc, ag), 4) AS conf, CASE WHEN dc IS NULL OR ag IS NULL THEN 'missing_confidence' WHEN pt NOT IN ('', 'correspondence') THEN 'not_correspondence' WHEN dc < 0.85::DOUBLE THEN 'below_doc_type_conf' WHEN sc < 0.86::DOUBLE THEN 'below_subclass_conf'
        WHEN ag < 0.87::DOUBLE THEN 'below_agreement' WHEN NOT regexp_matches(doc_text, '[^\\s\\pZ]') THEN 'missing_doc_text' WHEN substr(subclass, 4)::INT >= 17 THEN 'unresolvable_subclass' WHEN contains(trim(regexp_replace(lower(title), '[_\\s-]+', ' ', 'g')), subclass) THEN 'leak_title' END AS reason FROM stored WHERE split = 'validation'),
        a AS (SELECT *, CASE WHEN content_sha256 IN (SELECT x FROM hashes) OR t IN (SELECT x FROM hashes) THEN 'duplicate_sha_canonical' END AS r1 FROM g WHERE reason IS NULL),
        b AS (SELECT *, CASE WHEN doc_id // 2 IN (SELECT doc_id // 2 FROM corpus WHERE split = 'test') THEN 'family_straddles_val_test' END AS r2 FROM a WHERE r1 IS NULL),
        c AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY conf DESC, filename) > round_even(0.02::DOUBLE * (SELECT count(*) FROM corpus WHERE split = 'train'), 0) THEN 'pseudo_cap' END AS r3 FROM b WHERE r2 IS NULL)
        SELECT filename, reason, NULL::DOUBLE AS label_confidence, NULL::DOUBLE AS example_weight FROM g WHERE reason IS NOT NULL UNION ALL SELECT filename, r1, NULL, NULL FROM a WHERE r1 IS NOT NULL UNION ALL SELECT filename, r2, NULL, NULL FROM b WHERE r2 IS NOT NULL
        UNION ALL SELECT filename, coalesce(r3, 'kept'), CASE WHEN r3 IS NULL THEN conf END, CASE WHEN r3 IS NULL THEN 0.5 END FROM c""",
    "held_out_rows": f"""WITH {_STORED}, l AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'new_' || doc_id ELSE filename END AS name FROM stored),
        r AS (SELECT name, CASE WHEN split = 'validation' THEN 'no_text' WHEN doc_id % 2 = 1 THEN 'filename_overlap' WHEN doc_type <> 'en' THEN 'label' WHEN NOT regexp_matches(doc_text, '[^\\s\\pZ]') THEN 'empty'
        WHEN t IN (SELECT t FROM stored WHERE split IN ('train', 'validation')) THEN 'sha_overlap' END AS reason, subclass FROM l) SELECT name AS filename, reason, CASE WHEN reason IS NULL THEN CASE WHEN subclass IN ({_HEADS}) THEN subclass ELSE 'other' END END AS subclass FROM r""",
    # Gate 6 by 4-grams: sets that are alike have one of their first elements, in any common order, in common.
    "seven_gates_first_failure": f"""WITH {CORPUS_SQL}, {_CARDS}, c0 AS (SELECT doc_id, doc_type AS parent_class, subclass, CASE WHEN doc_id % 13 = 0 THEN '' ELSE doc_text END AS text, lower(CASE WHEN doc_id % 13 = 0 THEN '' ELSE doc_text END) AS low, doc_id % 17 = 0 AS untitled FROM corpus WHERE split <> 'test'),
        dirty AS (SELECT DISTINCT doc_id FROM {_grams('c0', 'doc_id', 'text')} WHERE g IN (SELECT g FROM {_grams('benchmark', 'item_id', 'text')})),
        s AS (SELECT c0.*, CASE WHEN NOT regexp_matches(text, '[^\\s\\pZ]') THEN 'empty_doc_text' WHEN k.subclass IS NULL THEN 'no_label_card' WHEN untitled THEN 'empty_title' END AS a, CASE WHEN doc_id IN (SELECT doc_id FROM dirty) THEN 'ngram_overlap' END AS b,
        CASE WHEN len(cues) > 0 AND len(list_filter(cues, lambda x: regexp_matches(low, '(^|[^\\pL\\pN_])' || x || '($|[^\\pL\\pN_])'))) = 0 THEN 'missing_positive_cue' END AS c, CASE WHEN contains(low, 'apache license') THEN 'known_entity' END AS d,
        CASE WHEN doc_id % 3 > 0 THEN CASE WHEN doc_id % 22 = 1 THEN 'adjudication_empty' WHEN doc_id % 14 = 1 AND c0.subclass <> 'src0' THEN 'adjudication_mismatch' END WHEN need_a AND NOT contains(low, 'a') THEN 'required_structure_miss' WHEN banned AND contains(low, 'all rights reserved') THEN 'prohibited_fact_present' END AS e,
        CASE WHEN doc_id % 19 = 0 THEN 'missing_model_prediction' WHEN doc_id % 10 = 3 AND c0.subclass <> 'src0' THEN 'model_label_mismatch' WHEN doc_id % 9 = 0 OR (doc_id % 8 > 0 AND (doc_id % 100) / 100.0::DOUBLE < 0.2::DOUBLE) THEN 'model_prob_below_floor' END AS g
        FROM c0 LEFT JOIN cards k ON k.parent_class = c0.parent_class AND k.subclass = c0.subclass),
        u AS (SELECT 'c' || doc_id AS id, text FROM s WHERE a IS NULL AND c IS NULL AND d IS NULL AND e IS NULL UNION ALL SELECT 'p' || doc_id, doc_text FROM corpus WHERE split = 'test'),
        m AS (SELECT DISTINCT id, substr(x, k, 4) AS m FROM (SELECT id, x, unnest(range(1, length(x) - 2)) AS k FROM (SELECT id, regexp_replace(lower(text), '[\\s\\pZ]+', ' ', 'g') AS x FROM u) WHERE length(x) >= 4)),
        z AS (SELECT id, count(*) AS z FROM m GROUP BY 1), rank AS (SELECT m, row_number() OVER (ORDER BY count(*), m) AS r FROM m GROUP BY 1), o AS (SELECT id, r, z, row_number() OVER (PARTITION BY id ORDER BY r) AS k FROM m JOIN rank USING (m) JOIN z USING (id)),
        pairs AS (SELECT DISTINCT x.id AS i, y.id AS j FROM o x JOIN o y ON x.r = y.r WHERE x.id LIKE 'c%' AND y.id LIKE 'p%' AND x.k <= x.z - ceil(0.85 * x.z) + 1 AND y.k <= y.z - ceil(0.85 * y.z) + 1),
        common AS (SELECT i, j, count(*) AS n FROM pairs JOIN m x ON x.id = i JOIN m y ON y.id = j AND y.m = x.m GROUP BY 1, 2),
        near AS (SELECT DISTINCT i FROM common JOIN z x ON x.id = i JOIN z y ON y.id = j WHERE n / (x.z + y.z - n)::DOUBLE > 0.85::DOUBLE),
        w AS (SELECT *, CASE WHEN 'c' || doc_id IN (SELECT i FROM near) THEN 'near_duplicate' END AS f FROM s)
        SELECT doc_id, coalesce(a, b, c, d, e, f, g) IS NULL AS passed, CASE WHEN a IS NOT NULL THEN 'schema' WHEN b IS NOT NULL THEN 'lexical_contamination' WHEN c IS NOT NULL THEN 'rule_cues' WHEN d IS NOT NULL THEN 'entity_overlap' WHEN e IS NOT NULL THEN 'independent_adjudication'
        WHEN f IS NOT NULL THEN 'embedding_diversity' WHEN g IS NOT NULL THEN 'model_disagreement' END AS first_failure, coalesce(a, b, c, d, e, f, g) AS reason FROM w""",
    "enrichment_windows": _C + """, n AS (SELECT filename, doc_text, greatest(1, ceil(length(doc_text) / 400.0::DOUBLE))::INT AS n FROM corpus), w AS (SELECT filename, doc_text, n, unnest(range(0, n)) AS k FROM n), x AS (SELECT *, substr(doc_text, k * 400 + 1, 400) AS s FROM w)
        SELECT filename, k::INT AS window_index, n AS n_windows, sha256(s) AS text_sha256, greatest(1, round_even(length(s) / 4.0::DOUBLE, 0))::INT AS window_tokens, 'train' AS split FROM x""",
    # Tags and title take 8 words, so 190 are left; a window of over 188 is cut by 8 more.
    "token_windows": f"""WITH RECURSIVE {CORPUS_SQL}, t AS (SELECT filename, doc_text, regexp_extract_all(doc_text, '[^ \\t\\n\\x0b\\f\\r]+') AS words FROM corpus), n AS (SELECT *, len(words) AS n FROM t),
        w AS (SELECT filename, n, 0 AS k, 0 AS start, CASE WHEN least(n, 190) > 188 THEN least(n, 190) - 8 ELSE n END AS kept FROM n WHERE n > 190
        UNION ALL SELECT filename, n, k + 1, start + kept - 40, CASE WHEN least(n - (start + kept - 40), 190) > 188 THEN least(n - (start + kept - 40), 190) - 8 ELSE n - (start + kept - 40) END FROM w WHERE start + kept < n),
        x AS (SELECT filename, k, array_to_string(words[start + 1 : start + kept], ' ') AS body FROM w JOIN t USING (filename) UNION ALL SELECT filename, 0, doc_text FROM n WHERE n <= 190)
        SELECT filename, k::INT AS window_index, (count(*) OVER (PARTITION BY filename))::INT AS n_windows, sha256('[FILE_NAME] ' || filename || chr(10) || '[TITLE] A short title' || chr(10) || '[WINDOW_INDEX] ' || k || chr(10) || chr(10) || body) AS text_sha256 FROM x""",
    "head_table": _C + f""", s AS (SELECT doc_type, subclass FROM corpus WHERE split <> 'test' AND doc_type <> 'fr' GROUP BY 1, 2 UNION ALL SELECT 'fr', unnest({_LIST(_FULL['fr'])})),
        k AS (SELECT *, CASE doc_type WHEN 'fr' THEN list_position({_LIST(_FULL['fr'])}, subclass) WHEN 'en' THEN list_position({_LIST(_ORDER['en'])}, subclass) END AS k FROM s), p AS (SELECT *, row_number() OVER (PARTITION BY doc_type ORDER BY k NULLS LAST, subclass) - 1 AS place FROM k),
        n AS (SELECT doc_type, subclass, count(*) AS n FROM corpus WHERE split = 'train' GROUP BY 1, 2), t AS (SELECT doc_type, sum(n) AS total, count(*) AS c FROM n GROUP BY 1),
        q AS (SELECT *, (doc_type = 'fr' AND subclass = 'src2') OR (doc_type = 'en' AND subclass = 'src1') AS routed FROM p)
        SELECT q.doc_type, q.subclass, place::INT AS place, round(total::DOUBLE / (c * n.n), 9) AS weight, n.n IS NULL AS inference_only, CASE WHEN NOT routed THEN (sum((NOT routed)::INT) OVER (PARTITION BY q.doc_type ORDER BY place) - 1)::INT END AS trainable_place
        FROM q LEFT JOIN n ON n.doc_type = q.doc_type AND n.subclass = q.subclass LEFT JOIN t ON t.doc_type = q.doc_type""",
    "support_replay": _C + """, n AS (SELECT doc_type, subclass, count(*) AS n FROM corpus WHERE split = 'train' GROUP BY 1, 2), low AS (SELECT * FROM n WHERE n < 9)
        SELECT c.doc_type, CASE WHEN l.n IS NOT NULL THEN 'other' ELSE c.subclass END AS subclass, count(*) AS n FROM corpus c LEFT JOIN low l ON l.doc_type = c.doc_type AND l.subclass = c.subclass WHERE c.split = 'test' AND (l.n IS NULL OR c.doc_type IN ('en', 'fr')) GROUP BY 1, 2""",
    "clamped_priors": _C + """, n AS (SELECT subclass, count(*)::DOUBLE AS n FROM corpus WHERE split = 'train' GROUP BY 1), a AS (SELECT * FROM n UNION ALL SELECT 'unseen', min(n) FROM n), b AS (SELECT *, least(n, 1.2::DOUBLE * min(n) OVER ()) AS m, (SELECT sum(n) / count(*) FROM n) / n AS w FROM a)
        SELECT subclass, round(ln(n / sum(n) OVER ()), 9) AS prior, round(ln(m / sum(m) OVER ()), 9) AS bounded, round(least(greatest(CASE WHEN subclass = 'unseen' THEN 1.0 ELSE sqrt(w) END, 1 / 1.02::DOUBLE), 1.02::DOUBLE), 9) AS loss_weight FROM b""",
    "subclass_stats": _J + """, s AS (SELECT * FROM judged WHERE dt_correct), p AS (SELECT gt_doc_type, pred_subclass AS label, count(*) AS n FROM s GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY gt_doc_type ORDER BY count(*) DESC, pred_subclass) = 1),
        t AS (SELECT gt_doc_type, gt_subclass AS label, count(*) AS n FROM s GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY gt_doc_type ORDER BY count(*) DESC, gt_subclass) = 1), b AS (SELECT gt_doc_type, count(*) AS n, count(*) FILTER (sc_correct) AS correct FROM s GROUP BY 1)
        SELECT b.gt_doc_type, b.n, b.correct, p.label AS top_pred, p.n AS top_pred_n, t.label AS top_true, t.n AS top_true_n FROM b JOIN p USING (gt_doc_type) JOIN t USING (gt_doc_type)""",
    "best_and_worst": _J + """, g AS (SELECT gt_doc_type AS c, avg(dt_correct::INT) AS a, count(*) AS n FROM judged GROUP BY 1), b AS (SELECT * FROM g ORDER BY a DESC, c LIMIT 1), w AS (SELECT * FROM g ORDER BY a, c LIMIT 1)
        SELECT b.c AS best_class, round(b.a, 9) AS best_accuracy, b.n AS best_n, w.c AS worst_class, round(w.a, 9) AS worst_accuracy, w.n AS worst_n FROM b, w""",
    "error_rows": _J + ", e AS (SELECT * FROM judged WHERE NOT dt_correct OR NOT sc_correct) SELECT filename, gt_doc_type, pred_doc_type, dt_correct, sc_correct, n_windows, (SELECT count(*) FROM e) AS n_errors FROM e ORDER BY filename LIMIT 500",
    "comparable_metrics": _J + """SELECT count(*) AS n_docs, round(avg(dt_correct::INT), 6) AS doc_type_accuracy, round(count(*) FILTER (dt_correct AND sc_correct) / count(*) FILTER (dt_correct)::DOUBLE, 6) AS subclass_accuracy_conditional, round(round(avg(agreement), 4), 6) AS mean_window_agreement,
        round(avg((agreement > 0.5::DOUBLE)::INT), 6) AS fast_path_rate, count(*) FILTER (agreement > 0.5::DOUBLE) AS fast_path_n_docs, round(avg(dt_correct::INT) FILTER (n_windows = 1), 6) AS single_window_accuracy, round(avg(dt_correct::INT) FILTER (n_windows <> 1), 6) AS multi_window_accuracy, round(avg((agreement < 0.05::DOUBLE)::INT), 6) AS ood_rate FROM judged""",
    "macro_f1_all": _J + """, l AS (SELECT unnest(['en', 'fr', 'de', 'es', 'unknown']) AS label), s AS (SELECT gt_doc_type AS label, count(*) AS support, count(*) FILTER (dt_correct) AS tp FROM judged GROUP BY 1), p AS (SELECT pred_doc_type AS label, count(*) AS said FROM judged WHERE pred_doc_type IS NOT NULL GROUP BY 1)
        SELECT count(*) AS n_classes, round(avg(coalesce(2 * tp / (coalesce(support, 0) + coalesce(said, 0))::DOUBLE, 0)), 9) AS macro_f1 FROM l LEFT JOIN s USING (label) LEFT JOIN p USING (label)""",
    "plus_slice": _C + "SELECT doc_type, count(*) AS n FROM corpus WHERE split <> 'test' GROUP BY 1",
    "head_ece_policy": _J + "SELECT gt_doc_type AS head, CASE WHEN gt_doc_type = 'fr' THEN 'excluded' WHEN abs(avg(agreement) - avg(dt_correct::INT)) >= 0.4::DOUBLE THEN 'refused' ELSE 'ok' END AS status FROM judged GROUP BY 1",
}
