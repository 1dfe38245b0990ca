"""Queries of curation: text, hashes, splits, labels, windows, audits; each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.functions import text as tx
from curata.operators import corpus as cp
from curata.operators import dedup, split
from curata.plans.fixtures import CORPUS_SQL, corpus, table

_C = f"WITH {CORPUS_SQL} "


def corpus_overview(spark: SparkSession, d: str) -> DataFrame:
    docs = dedup.first_wins(corpus(spark, d).withColumn("token_estimate", tx.estimate_tokens(F.col("doc_text"))))
    return docs.groupBy("doc_type", "split").agg(F.count("*").alias("n"), F.round(F.avg("token_estimate"), 6).alias("mean_tokens"), F.count_if(F.col("reason").isNotNull()).alias("n_duplicates"))


def clean_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus(spark, d).withColumn("original", F.concat(F.lit("\r\n a-\nb-\nc  x ​"), "doc_text", F.lit("\r\n\r\n\r\n\r\n| k   v |\n  end \n")))
    rows = rows.withColumn("composed", F.col("original"))
    stats = tx.with_clean_stats(tx.compose(rows, "composed"), "composed", "original")
    return stats.select("doc_id", F.sha2("cleaned", 256).alias("cleaned_sha256"), "raw_chars", "cleaned_chars", "hyphen_unwraps", "changed")


def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).select("filename", tx.estimate_tokens(F.col("doc_text")).alias("token_estimate"))


def content_hash_groups(spark: SparkSession, d: str) -> DataFrame:
    return dedup.content_groups(corpus(spark, d))


def dedup_first_wins(spark: SparkSession, d: str) -> DataFrame:
    docs = corpus(spark, d)
    return dedup.first_wins(docs.unionByName(docs.where("split = 'test'"))).select("filename", "reason")


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = corpus(spark, d)
    rows = docs.withColumn("filename", F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("copy_"), "filename")).otherwise(F.col("filename")))
    return rows, docs.where("split <> 'train'")


_HALVES = CORPUS_SQL + """, incoming AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'copy_' || filename ELSE filename END AS filename, content_sha256, doc_text, subclass
  FROM corpus), canonical AS (SELECT * FROM corpus WHERE split <> 'train')"""


def dedup_identity_guard(spark: SparkSession, d: str) -> DataFrame:
    return dedup.identity_guard(*_halves(spark, d)).select("filename", "reason")


def dedup_additive(spark: SparkSession, d: str) -> DataFrame:
    rows, known = (x.withColumn("text_sha256", F.sha2(F.lower("doc_text"), 256)) for x in _halves(spark, d))
    return dedup.additive(rows, known).select("filename", "reason")


def filename_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Three canonical rows to a name, French ones without a hash; two incoming rows to a name."""
    docs, i = corpus(spark, d).withColumn("text_sha256", F.sha2(F.lower("doc_text"), 256)), F.col("doc_id")
    known = docs.withColumns({"filename": F.concat(F.lit("doc_"), i - i % 3), "content_sha256": F.when(F.col("doc_type") == "fr", "").otherwise(F.col("content_sha256"))})
    rows = docs.withColumn("filename", F.concat(F.lit("doc_"), i - i % 2)).select("doc_id", "filename", "content_sha256", "text_sha256")
    return dedup.filename_collisions(rows, known, text_key="text_sha256").select("doc_id", "reason")


def leakage_sha_across_splits(spark: SparkSession, d: str) -> DataFrame:
    return dedup.cross_split_hashes(corpus(spark, d))


def folded_title_groups(spark: SparkSession, d: str) -> DataFrame:
    return dedup.title_groups(corpus(spark, d))


def filename_leak_counts(spark: SparkSession, d: str) -> DataFrame:
    return dedup.filename_leaks(corpus(spark, d).withColumn("filename", F.when(F.col("doc_id") % 4 == 0, F.concat("subclass", F.lit("_"), "filename")).otherwise(F.col("filename"))).withColumn("title", F.when(F.col("doc_id") % 6 == 0, F.concat("filename", F.lit(".txt"))).when(F.col("doc_id") % 7 == 0, F.upper("filename")).otherwise(F.col("title"))))


def split_filenames(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus(spark, d).withColumn("filename", F.concat(F.lit("doc_"), F.col("doc_id") - F.col("doc_id") % 2))
    return dedup.split_filenames(rows).select("filename", F.array_join("splits", ",").alias("splits"))


def validation_share(spark: SparkSession, d: str) -> DataFrame:
    return dedup.validation_share(corpus(spark, d)).select("doc_type", "n", F.round("share", 9).alias("share"))


def title_exemplars(spark: SparkSession, d: str) -> DataFrame:
    return dedup.title_exemplars(corpus(spark, d))


def epoch_order(spark: SparkSession, d: str) -> DataFrame:
    return split.epoch_order(corpus(spark, d), 3).select("filename", "place")


def heldout_draw(spark: SparkSession, d: str) -> DataFrame:
    return split.draw(corpus(spark, d), 40).select("filename")


def stratified_split_hash(spark: SparkSession, d: str) -> DataFrame:
    return split.stratified_split(corpus(spark, d).drop("split"), "doc_type", 0.1).select("filename", "split")


def grouped_split_hash(spark: SparkSession, d: str) -> DataFrame:
    return split.grouped_split(table(spark, d, "conversations"), "conv_id", 0.2).groupBy("split").agg(F.countDistinct("conv_id").alias("families"), F.count("*").alias("n"), F.sum("conv_id").alias("id_sum"))


def stratified_sample_hash(spark: SparkSession, d: str) -> DataFrame:
    return split.stratified_sample(corpus(spark, d), "subclass", 5).select("subclass", "filename")


def long_doc_supplement(spark: SparkSession, d: str) -> DataFrame:
    return split.long_supplement(corpus(spark, d), "doc_type", 4, 3000).select("doc_type", "filename", "coverage_only")


def class_weights(spark: SparkSession, d: str) -> DataFrame:
    return cp.class_weights(corpus(spark, d)).select("subclass", "n", F.round("weight", 9).alias("weight"))


def label_surface(spark: SparkSession, d: str) -> DataFrame:
    return cp.label_surface(corpus(spark, d))


_LABELS = {"src1": "alpha", "src2": "beta", "src11": "beta", "source3": "gamma"}
_PREFIX = [("src1", "tens"), ("src4", "delta")]


def subclass_normalize(spark: SparkSession, d: str) -> DataFrame:
    surface = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" "), F.upper("subclass"), F.lit("- "))).otherwise(F.col("subclass"))
    return corpus(spark, d).select("filename", cp.normalize_label(surface, _LABELS, _PREFIX).alias("label"))


def word_windows(spark: SparkSession, d: str) -> DataFrame:
    out = cp.word_windows(corpus(spark, d), 128, 32, ["filename"])
    return out.select("filename", "window_index", "n_windows", F.sha2("window_text", 256).alias("window_sha256"), "window_tokens")


def cohort_report(spark: SparkSession, d: str) -> DataFrame:
    return cp.cohort_report(corpus(spark, d).withColumn("token_estimate", tx.estimate_tokens(F.col("doc_text"))))


def messy_flags(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).select("filename", tx.messy(F.col("doc_text")).alias("messy"))


def duplicate_families(spark: SparkSession, d: str) -> DataFrame:
    groups = corpus(spark, d).groupBy("content_sha256").agg(F.count("*").alias("n"))
    return groups.where("n > 1").groupBy("n").agg(F.count("*").alias("families"))


def verify_stage_report(spark: SparkSession, d: str) -> DataFrame:
    docs = corpus(spark, d).withColumns({"doc_type": F.when(F.col("doc_id") % 50 == 0, "xx").otherwise(F.col("doc_type")), "title": F.when(F.col("doc_id") % 60 == 0, F.upper("filename")).otherwise(F.col("title")), "source_corpus": F.when(F.col("doc_type") == "es", "pool")})
    windows = cp.word_windows(docs, 512, 0, ["filename"])
    head = corpus(spark, d).where("split <> 'test'").select("doc_type", "subclass")
    return cp.verify_stage(docs, windows, ["en", "fr", "de", "es"], head)


def cross_pool_fold(spark: SparkSession, d: str) -> DataFrame:
    docs = corpus(spark, d).withColumn("text_sha256", F.sha2(F.lower("doc_text"), 256))
    pools = [docs.where(F.col("split") == x) for x in ("validation", "test", "train")]
    return dedup.cross_pool(pools).select("pool", "filename", "reason")


def family_seam(spark: SparkSession, d: str) -> DataFrame:
    docs = corpus(spark, d).withColumn("family", F.floor(F.col("doc_id") / 3))
    return dedup.family_seam(docs.where("split = 'train'"), docs, "family").select("filename", "reason")


QUERIES = {f.__name__: f for f in (corpus_overview, clean_documents, token_estimates, content_hash_groups, dedup_first_wins, dedup_identity_guard, dedup_additive, filename_collisions, leakage_sha_across_splits, folded_title_groups, filename_leak_counts, split_filenames, validation_share, title_exemplars, epoch_order, heldout_draw, stratified_split_hash, grouped_split_hash, stratified_sample_hash, long_doc_supplement, class_weights, label_surface, subclass_normalize, word_windows, cohort_report, messy_flags, duplicate_families, verify_stage_report, cross_pool_fold, family_seam)}

_TOKENS = "greatest(1, round_even(length(doc_text) / 4.0::DOUBLE, 0))::INT"
_MESSY = r"(trim(doc_text, ' ' || chr(9) || chr(10) || chr(13)) = '' OR regexp_matches(doc_text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x{FFFD}]') OR length(regexp_replace(doc_text, '[^\pL\pN\pM_]', '', 'g')) / greatest(length(doc_text), 1)::DOUBLE < 0.5)"
_FOLD = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"

ORACLE_SQL = {
    "corpus_overview": _C + f"""SELECT doc_type, split, count(*) AS n, round(avg({_TOKENS}), 6) AS mean_tokens,
        count(*) FILTER (filename <> first_filename) AS n_duplicates
        FROM (SELECT *, min(filename) OVER (PARTITION BY content_sha256) AS first_filename FROM corpus) GROUP BY ALL""",
    "token_estimates": _C + f"SELECT filename, {_TOKENS} AS token_estimate FROM corpus",
    "content_hash_groups": _C + "SELECT content_sha256, count(*) AS n, min(filename) AS first_filename, max(filename) AS last_filename FROM corpus GROUP BY 1 HAVING count(*) > 1",
    "dedup_first_wins": _C + ", twice AS (SELECT * FROM corpus UNION ALL SELECT * FROM corpus WHERE split = 'test') SELECT filename, CASE WHEN row_number() OVER (PARTITION BY content_sha256 ORDER BY filename) > 1 THEN 'duplicate_sha' END AS reason FROM twice",
    "dedup_identity_guard": f"""WITH {_HALVES} SELECT filename, CASE WHEN EXISTS (SELECT 1 FROM canonical c WHERE c.content_sha256 = i.content_sha256)
        AND NOT EXISTS (SELECT 1 FROM canonical c WHERE c.content_sha256 = i.content_sha256 AND c.filename = i.filename) THEN 'duplicate_sha' END AS reason FROM incoming i""",
    "dedup_additive": f"""WITH {_HALVES}, known AS (SELECT content_sha256 AS h FROM canonical UNION SELECT sha256(lower(doc_text)) FROM canonical)
        SELECT filename, CASE WHEN content_sha256 IN (SELECT h FROM known) OR sha256(lower(doc_text)) IN (SELECT h FROM known) THEN 'duplicate_sha_canonical' END AS reason FROM incoming""",
    "filename_collisions": _C + """, known AS (SELECT 'doc_' || (doc_id - doc_id % 3) AS filename, CASE WHEN doc_type = 'fr' THEN '' ELSE content_sha256 END AS h, sha256(lower(doc_text)) AS t FROM corpus),
        named AS (SELECT DISTINCT filename FROM known WHERE h <> ''), r AS (SELECT doc_id, 'doc_' || (doc_id - doc_id % 2) AS filename, content_sha256 AS h, sha256(lower(doc_text)) AS t FROM corpus)
        SELECT doc_id, CASE WHEN filename IN (SELECT filename FROM named) AND NOT EXISTS (SELECT 1 FROM known k WHERE k.filename = r.filename AND (k.h = r.h OR k.t = r.t)) THEN 'filename_collision' END AS reason FROM r""",
    "leakage_sha_across_splits": _C + "SELECT content_sha256, count(DISTINCT split) AS n_splits, count(*) AS n FROM corpus GROUP BY 1 HAVING count(DISTINCT split) > 1",
    "folded_title_groups": _C + f"SELECT {_FOLD.format('title')} AS folded, count(*) AS n, count(DISTINCT title) AS n_exact, min(title) AS exemplar FROM corpus WHERE title <> '' GROUP BY 1 HAVING count(*) > 1 AND folded <> ''",
    "filename_leak_counts": _C + f""", named AS (SELECT doc_id, doc_type, subclass, doc_text, CASE WHEN doc_id % 4 = 0 THEN subclass || '_' || filename ELSE filename END AS filename, title FROM corpus),
        titled AS (SELECT doc_type, subclass, doc_text, filename, CASE WHEN doc_id % 6 = 0 THEN filename || '.txt' WHEN doc_id % 7 = 0 THEN upper(filename) ELSE title END AS title FROM named),
        f AS (SELECT *, {_FOLD.format('filename')} AS stem, {_FOLD.format('title')} AS t, {_FOLD.format('doc_text')} AS x, {_FOLD.format('subclass')} AS l, {_FOLD.format('doc_type')} AS k FROM titled),
        c AS (SELECT count(*) AS n_rows, count(*) FILTER (title = filename) AS title_eq_filename, count(*) FILTER (regexp_matches(title, '[.](htm|html|txt|pdf|docx?|xml)$', 'i') AND NOT contains(title, ' ')) AS title_looks_like_filename,
        count(*) FILTER (trim(title) <> '' AND (title = filename OR (t <> '' AND t = stem))) AS title_eq_filename_stem, count(*) FILTER (contains(t, k)) AS title_contains_doc_type, count(*) FILTER (contains(t, l)) AS title_contains_subclass,
        count(*) FILTER (contains(x, k)) AS doc_text_contains_doc_type, count(*) FILTER (contains(x, l)) AS doc_text_contains_subclass FROM f)
        SELECT *, round(100.0 * title_eq_filename / n_rows, 2)::DOUBLE AS title_eq_filename_pct, title_eq_filename + title_looks_like_filename + title_eq_filename_stem = 0 AS clean FROM c""",
    "split_filenames": _C + ", n AS (SELECT 'doc_' || (doc_id - doc_id % 2) AS filename, split FROM corpus) SELECT filename, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits FROM n GROUP BY 1 HAVING count(DISTINCT split) > 1",
    "validation_share": _C + "SELECT doc_type, count(*) AS n, round(avg((split = 'validation')::INT), 9) AS share FROM corpus WHERE split <> 'test' GROUP BY 1",
    "title_exemplars": _C + f", f AS (SELECT *, {_FOLD.format('title')} AS folded FROM corpus) SELECT folded, count(*) AS n, min(title) AS exemplar, min(filename) AS first_filename, max(filename) AS last_filename, count(DISTINCT split) AS n_splits FROM f WHERE folded <> '' GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, folded LIMIT 3",
    "epoch_order": _C + "SELECT filename, row_number() OVER (ORDER BY sha256('42:3:' || filename)) - 1 AS place FROM corpus",
    "heldout_draw": _C + "SELECT filename FROM corpus ORDER BY sha256('42:' || filename) LIMIT 40",
    "stratified_split_hash": _C + """SELECT filename, CASE WHEN row_number() OVER (PARTITION BY doc_type ORDER BY sha256('42:' || filename)) <= round_even(count(*) OVER (PARTITION BY doc_type) * 0.1::DOUBLE, 0)
        THEN 'validation' ELSE 'train' END AS split FROM corpus""",
    "grouped_split_hash": """WITH fam AS (SELECT conv_id, row_number() OVER (ORDER BY sha256('42:' || conv_id)) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT conv_id FROM conversations)),
        held AS (SELECT conv_id FROM fam WHERE r <= round_even(n * 0.2::DOUBLE, 0))
        SELECT CASE WHEN conv_id IN (SELECT conv_id FROM held) THEN 'validation' ELSE 'train' END AS split, count(DISTINCT conv_id) AS families, count(*) AS n, sum(conv_id)::BIGINT AS id_sum FROM conversations GROUP BY 1""",
    "stratified_sample_hash": _C + "SELECT subclass, filename FROM corpus QUALIFY row_number() OVER (PARTITION BY subclass ORDER BY sha256('42:' || filename)) <= 5",
    "long_doc_supplement": _C + "SELECT doc_type, filename, true AS coverage_only FROM corpus WHERE length(doc_text) > 3000 QUALIFY row_number() OVER (PARTITION BY doc_type ORDER BY sha256('42:' || filename)) <= 4",
    "class_weights": _C + ", c AS (SELECT subclass, count(*) AS n FROM corpus WHERE split = 'train' GROUP BY 1) SELECT subclass, n, round((sum(n) OVER ())::DOUBLE / (count(*) OVER () * n), 9) AS weight FROM c",
    "label_surface": _C + "SELECT doc_type, subclass, count(*) AS n FROM corpus WHERE split <> 'test' GROUP BY 1, 2",
    "subclass_normalize": _C + """, s AS (SELECT filename, regexp_replace(lower(CASE WHEN doc_id % 3 = 0 THEN ' ' || upper(subclass) || '- ' ELSE subclass END), '[^a-z0-9]', '', 'g') AS f FROM corpus)
        SELECT filename, CASE WHEN f = 'src1' THEN 'alpha' WHEN f IN ('src2', 'src11') THEN 'beta' WHEN f = 'source3' THEN 'gamma' WHEN starts_with(f, 'src1') THEN 'tens' WHEN starts_with(f, 'src4') THEN 'delta' ELSE 'other' END AS label FROM s""",
    "word_windows": _C + r""", w AS (SELECT filename, regexp_extract_all(doc_text, '\S+') AS words FROM corpus), n AS (SELECT *, greatest(0, ceil((len(words) - 128) / 96.0::DOUBLE))::INT AS last FROM w WHERE len(words) > 0),
        e AS (SELECT filename, words, last, unnest(range(0, last + 1)) AS k FROM n)
        SELECT filename, k::INT AS window_index, last + 1 AS n_windows, sha256(array_to_string(words[k * 96 + 1 : k * 96 + 128], ' ')) AS window_sha256, len(words[k * 96 + 1 : k * 96 + 128])::INT AS window_tokens FROM e""",
    "cohort_report": _C + f"""SELECT doc_type, count(*) AS n, count(*) FILTER (length(doc_text) <= 30000) AS n_short, count(*) FILTER (length(doc_text) > 30000) AS n_long,
        count(*) FILTER ({_TOKENS} <= 8192) AS n_single, count(*) FILTER ({_TOKENS} > 8192) AS n_multi, count(*) FILTER ({_MESSY}) AS n_messy FROM corpus GROUP BY 1""",
    "messy_flags": _C + f"SELECT filename, {_MESSY} AS messy FROM corpus",
    "duplicate_families": _C + ", g AS (SELECT content_sha256, count(*) AS n FROM corpus GROUP BY 1) SELECT n, count(*) AS families FROM g WHERE n > 1 GROUP BY 1",
    "cross_pool_fold": _C + """, h AS (SELECT *, sha256(lower(doc_text)) AS t, CASE split WHEN 'validation' THEN 0 WHEN 'test' THEN 1 ELSE 2 END AS pool FROM corpus),
        s0 AS (SELECT content_sha256 AS x FROM h WHERE pool = 0 UNION SELECT t FROM h WHERE pool = 0),
        b AS (SELECT *, CASE WHEN content_sha256 IN (SELECT x FROM s0) OR t IN (SELECT x FROM s0) THEN 'duplicate_sha_cross_pool' END AS reason FROM h WHERE pool = 1),
        s1 AS (SELECT x FROM s0 UNION SELECT content_sha256 FROM b WHERE reason IS NULL UNION SELECT t FROM b WHERE reason IS NULL)
        SELECT pool, filename, NULL AS reason FROM h WHERE pool = 0 UNION ALL SELECT pool, filename, reason FROM b
        UNION ALL SELECT pool, filename, CASE WHEN content_sha256 IN (SELECT x FROM s1) OR t IN (SELECT x FROM s1) THEN 'duplicate_sha_cross_pool' END FROM h WHERE pool = 2""",
    "family_seam": _C + """SELECT filename, CASE WHEN doc_id // 3 IN (SELECT doc_id // 3 FROM corpus WHERE split IN ('validation', 'test')) THEN 'family_straddles_val_test' END AS reason FROM corpus WHERE split = 'train'""",
    "clean_documents": _C + r""", o AS (SELECT doc_id, chr(13) || chr(10) || ' a-' || chr(10) || 'b-' || chr(10) || 'c' || chr(160) || chr(160) || 'x ' || chr(8203) || doc_text || chr(13) || chr(10) || chr(13) || chr(10) || chr(13) || chr(10) || chr(13) || chr(10) || '| k   v |' || chr(10) || '  end ' || chr(10) AS original FROM corpus),
        a AS (SELECT doc_id, original, regexp_replace(translate(replace(replace(nfc_normalize(original), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(160) || chr(8232) || chr(8233) || chr(8203) || chr(8204) || chr(8205) || chr(65279) || chr(8288), ' ' || chr(10) || chr(10)), '[\x00-\x08\x0b\x0c\x0e-\x1f]', ' ', 'g') AS t FROM o),
        h AS (SELECT *, regexp_replace(regexp_replace(t, '([A-Za-z])-\n([A-Za-z])', '\1\2', 'g'), '([A-Za-z])-\n([A-Za-z])', '\1\2', 'g') AS j FROM a),
        l AS (SELECT *, list_transform(string_split(regexp_replace(j, '\n[ \t]*\n(?:[ \t]*\n)+', chr(10) || chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '[\s\pZ]+$', '')) AS lines FROM h),
        c AS (SELECT *, regexp_replace(array_to_string(list_transform(lines, lambda x: CASE WHEN regexp_matches(x, '^[\s\pZ]*\|') AND ends_with(x, '|') THEN x ELSE regexp_replace(regexp_replace(x, '[\t\x0b\f\r\pZ]{2,}', ' ', 'g'), '^[\s\pZ]+', '') END), chr(10)), '^\n+|\n+$', '', 'g') AS cleaned FROM l)
        SELECT doc_id, sha256(cleaned) AS cleaned_sha256, length(original)::INT AS raw_chars, length(cleaned)::INT AS cleaned_chars, ((length(t) - length(j)) / 2)::INT AS hyphen_unwraps, cleaned <> original AS changed FROM c""",
    "verify_stage_report": _C + f""", docs AS (SELECT doc_id, filename, content_sha256, split, subclass, doc_text, doc_type = 'es' AS added, CASE WHEN doc_id % 60 = 0 THEN upper(filename) ELSE title END AS title, CASE WHEN doc_id % 50 = 0 THEN 'xx' ELSE doc_type END AS doc_type FROM corpus),
        head AS (SELECT DISTINCT doc_type, subclass FROM corpus WHERE split <> 'test'), shared AS (SELECT content_sha256, bool_or(added) AS added FROM docs GROUP BY 1 HAVING count(DISTINCT split) > 1)
        SELECT * FROM (
        SELECT 'error' AS severity, 'bad_doc_type' AS code, count(*) AS n FROM docs WHERE doc_type NOT IN ('en', 'fr', 'de', 'es')
        UNION ALL SELECT 'error', 'missing_split', 3 - count(DISTINCT split) FROM docs
        UNION ALL SELECT 'error', 'bad_subclass', count(*) FROM docs d WHERE doc_type <> 'xx' AND NOT EXISTS (SELECT 1 FROM head h WHERE h.doc_type = d.doc_type AND h.subclass = d.subclass)
        UNION ALL SELECT 'error', 'duplicate_filename', count(*) FROM (SELECT filename FROM docs GROUP BY 1 HAVING count(*) > 1)
        UNION ALL SELECT 'error', 'test_windows', sum(greatest(1, ceil(len(regexp_extract_all(doc_text, '\\S+')) / 512.0::DOUBLE)))::BIGINT FROM docs WHERE split = 'test' AND regexp_matches(doc_text, '\\S')
        UNION ALL SELECT 'error', 'title_from_filename', count(*) FROM docs WHERE trim(title) <> '' AND (title = filename OR ({_FOLD.format('title')} <> '' AND {_FOLD.format('title')} = {_FOLD.format('filename')}) OR (regexp_matches(title, '[.](htm|html|txt|pdf|docx?|xml)$', 'i') AND NOT contains(title, ' ')))
        UNION ALL SELECT 'error', 'enrichment_straddles', count(*) FROM shared WHERE added
        UNION ALL SELECT 'warning', 'content_straddles', count(*) FROM shared WHERE NOT added) WHERE n > 0""",
}
