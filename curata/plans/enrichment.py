"""Queries of enrichment, candidate gates, run analytics and the star schema; each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.operators import enrich, evaluate, ops
from curata.operators.dedup import ranked_cap
from curata.plans.fixtures import CORPUS_SQL, JUDGED_SQL, corpus, judged, table

_C = f"WITH {CORPUS_SQL} "


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    conf = F.when(i % 41 == 0, float("nan")).otherwise((800 + i % 200) / 1000.0)
    return corpus(spark, d).select("*", conf.alias("doc_type_conf"), ((850 + i % 150) / 1000.0).alias("subclass_conf"), F.when(i % 43 == 0, None).otherwise((86 + i % 15) / 100.0).alias("agreement"), F.when(i % 6 == 0, "contract").when(i % 2 == 0, "").otherwise("correspondence").alias("pred_doc_type"), F.col("subclass").alias("pred_subclass"), ((i % 97) / 97.0).alias("label_confidence"))


def insurance_tail_cap(spark: SparkSession, d: str) -> DataFrame:
    return enrich.tail_cap(corpus(spark, d), 200, ["src3", "src7", "src1"]).select("filename", "reason")


def global_cap(spark: SparkSession, d: str) -> DataFrame:
    return ranked_cap(_candidates(spark, d), 150, [-F.col("label_confidence"), F.col("filename")], "pseudo_cap").select("filename", "reason")


def waterfill_balance(spark: SparkSession, d: str) -> DataFrame:
    return enrich.balance(_candidates(spark, d), 320).where("reason is null").groupBy("subclass").agg(F.count("*").alias("n"), F.min("filename").alias("first_filename"))


def mixture_caps(spark: SparkSession, d: str) -> DataFrame:
    docs = corpus(spark, d)
    counts = enrich.counts_of(docs.where("split = 'validation'"))
    return enrich.apply_mixture(docs.where("split <> 'validation'"), counts, global_share=0.3, label_share=0.5).groupBy("subclass", "reason").agg(F.count("*").alias("n"))


def eligibility(spark: SparkSession, d: str) -> DataFrame:
    """Counts outside test; F1 and confusion of the subclasses from the judged rows."""
    counts = corpus(spark, d).where("split <> 'test'").groupBy("doc_type", "subclass").agg(F.count("*").alias("n"))
    rows = judged(spark, d).select(F.col("gt_subclass").alias("gt"), F.col("pred_subclass").alias("pred"))
    f1 = evaluate.f1_by_class(rows).select(F.col("label").alias("subclass"), "f1")
    confused = evaluate.confusion(rows.where("gt <> pred")).where("n >= 12").select(F.col("gt").alias("subclass"))
    return enrich.eligibility(counts, f1, confused)


def pseudo_label_gates(spark: SparkSession, d: str) -> DataFrame:
    head = [f"src{k}" for k in range(17)]
    return enrich.pseudo_labels(_candidates(spark, d).withColumn("title", F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("On "), F.upper("subclass"), F.lit(" again"))).otherwise(F.col("title"))), head, 0.88, 0.9, 0.9).select("filename", "reason", "label_confidence")


def pool_assembly(spark: SparkSession, d: str) -> DataFrame:
    docs = corpus(spark, d).withColumns({"text_sha256": F.col("content_sha256"), "a": F.col("doc_id") % 7 != 0, "b": F.col("doc_id") % 14 == 0})
    first = enrich.assemble(docs.where("split = 'train'"), [f"src{k}" for k in range(15)], doc_type="en", lineage=["a", "b"])
    last = enrich.finalize(first.kept, docs.where("split <> 'train'"))
    return first.rejected.unionByName(last.rejected).unionByName(last.kept.select("filename", F.lit("kept").alias("reason")))


def ngram_contamination(spark: SparkSession, d: str) -> DataFrame:
    return enrich.ngram_hits(table(spark, d, "documents"), table(spark, d, "benchmark").select(F.col("text").alias("held")), "doc_id", "text", "held", 5)


def char_jaccard_near_dup(spark: SparkSession, d: str) -> DataFrame:
    return enrich.char_similarity(table(spark, d, "documents"), "doc_id", "text").select("a", "b", F.round("similarity", 9).alias("similarity"))


def proper_noun_overlap(spark: SparkSession, d: str) -> DataFrame:
    docs = corpus(spark, d)
    return enrich.entity_hits(docs.where("split <> 'test'"), docs.where("split = 'test'").select(F.col("doc_text").alias("held")), "doc_id", "doc_text", "held")


def spot_audit(spark: SparkSession, d: str) -> DataFrame:
    docs = corpus(spark, d)
    authentic = docs.where("split = 'test'").groupBy("subclass").agg(F.count("*").alias("n"))
    return enrich.spot_audit(docs.where("split <> 'test'"), authentic, 6)


def verdict_shares(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus(spark, d).select("subclass", F.when(F.col("doc_id") % 4 == 0, "reject").otherwise("accept").alias("verdict"))
    return enrich.verdict_shares(rows, 5).select("subclass", "n", F.round("accepted", 9).alias("accepted"))


def reject_reasons(spark: SparkSession, d: str) -> DataFrame:
    return pool_assembly(spark, d).where("reason <> 'kept'").groupBy("reason").agg(F.count("*").alias("n"))


def log_deltas_median(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", "ts", "user_id")
    return ops.upper_median(ops.deltas(events, "user_id", "ts", "event_id"), "user_id", "seconds").select("user_id", "n", F.round("median", 6).alias("median"))


def ema_throughput(spark: SparkSession, d: str) -> DataFrame:
    return ops.ema(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value").select("user_id", F.col("n").cast("long").alias("n"), F.round("ema", 6).alias("ema"))


def event_rates_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return ops.event_rates(table(spark, d, "events"), "ts", "event_type").select("start", "event_type", "n", F.round("total", 6).alias("total"))


def last_events(spark: SparkSession, d: str) -> DataFrame:
    return ops.last_records(table(spark, d, "events").select("event_id", "event_type"), "event_id", 2)


def run_telemetry(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(F.sum("o_totalprice") / 1000, 3).alias("seconds"), F.count("*").alias("n_docs"))
    return ops.telemetry(runs).select("o_orderpriority", "seconds", "n_docs", F.round("seconds_per_doc", 9).alias("seconds_per_doc"), F.round("usd", 4).alias("usd"))


def manifest_upsert(spark: SparkSession, d: str) -> DataFrame:
    docs = corpus(spark, d).select("doc_id", "subclass", "split", F.length("doc_text").alias("n"))
    return ops.upsert(docs.where("split <> 'test'"), docs.where("split <> 'train'").withColumn("n", F.col("n") * 10), ["doc_id"])


def event_props(spark: SparkSession, d: str) -> DataFrame:
    props = F.from_json("props", "map<string,string>")
    return table(spark, d, "events").select("event_type", F.explode(F.map_keys(props)).alias("field")).groupBy("event_type", "field").agg(F.count("*").alias("n"))


def nation_revenue(spark: SparkSession, d: str) -> DataFrame:
    orders, items, people = (table(spark, d, t) for t in ("orders", "lineitem", "customer"))
    nation = table(spark, d, "nation")
    rows = items.join(orders, items.l_orderkey == orders.o_orderkey).join(people, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


QUERIES = {f.__name__: f for f in (insurance_tail_cap, global_cap, waterfill_balance, mixture_caps, eligibility, pseudo_label_gates, pool_assembly, ngram_contamination, char_jaccard_near_dup, proper_noun_overlap, spot_audit, verdict_shares, reject_reasons, log_deltas_median, ema_throughput, event_rates_tumbling, last_events, run_telemetry, manifest_upsert, event_props, nation_revenue)}

_CAND = CORPUS_SQL + """, cand AS (SELECT *, CASE WHEN doc_id % 41 = 0 THEN NULL ELSE (800 + doc_id % 200) / 1000.0::DOUBLE END AS dc, (850 + doc_id % 150) / 1000.0::DOUBLE AS sc,
  CASE WHEN doc_id % 43 = 0 THEN NULL ELSE (86 + doc_id % 15) / 100.0::DOUBLE END AS ag, CASE WHEN doc_id % 6 = 0 THEN 'contract' WHEN doc_id % 2 = 0 THEN '' ELSE 'correspondence' END AS pt, (doc_id % 97) / 97.0::DOUBLE AS lc FROM corpus)"""
_WORDS = r"trim(regexp_replace(lower({}), '[_\s-]+', ' ', 'g'))"
_POOL = CORPUS_SQL + """, i0 AS (SELECT *, CASE WHEN NOT (doc_id % 7 <> 0 OR doc_id % 14 = 0) THEN 'no_lineage' WHEN doc_type <> 'en' THEN 'wrong_class' WHEN trim(doc_text) = '' THEN 'missing_doc_text'
    WHEN substr(subclass, 4)::INT >= 15 THEN 'unresolvable_subclass' END AS reason FROM corpus WHERE split = 'train'),
  i1 AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY content_sha256 ORDER BY filename) > 1 THEN 'duplicate_sha' END AS r1 FROM i0 WHERE reason IS NULL),
  i2 AS (SELECT *, CASE WHEN content_sha256 IN (SELECT content_sha256 FROM corpus WHERE split <> 'train') THEN 'duplicate_sha_canonical' END AS r2 FROM i1 WHERE r1 IS NULL),
  pool AS (SELECT filename, reason FROM i0 WHERE reason IS NOT NULL UNION ALL SELECT filename, r1 FROM i1 WHERE r1 IS NOT NULL UNION ALL SELECT filename, coalesce(r2, 'kept') FROM i2)"""


def _grams(source: str, key: str, text: str) -> str:
    return f"(SELECT DISTINCT {key}, array_to_string(words[k:k + 4], ' ') AS g FROM (SELECT {key}, words, unnest(range(1, len(words) - 3)) AS k FROM (SELECT {key}, regexp_extract_all(lower({text}), '[a-z0-9]+') AS words FROM {source}) WHERE len(words) >= 5))"


_SPANS = "regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)+')"

ORACLE_SQL = {
    "insurance_tail_cap": _C + "SELECT filename, CASE WHEN row_number() OVER (ORDER BY CASE subclass WHEN 'src3' THEN 1 WHEN 'src7' THEN 2 WHEN 'src1' THEN 3 ELSE 4 END, filename) > 200 THEN 'tail_cap' END AS reason FROM corpus",
    "global_cap": f"WITH {_CAND} SELECT filename, CASE WHEN row_number() OVER (ORDER BY lc DESC, filename) > 150 THEN 'pseudo_cap' END AS reason FROM cand",
    # Slots in closed form: the highest common level that fits the budget, the rest to labels with most rows left.
    "waterfill_balance": f"""WITH {_CAND}, r AS (SELECT * FROM cand), c AS (SELECT subclass, count(*) AS a FROM r GROUP BY 1),
        l AS (SELECT max(k) AS level FROM range(0, 100000) t(k) WHERE (SELECT sum(least(a, k)) FROM c) <= 320), s AS (SELECT subclass, a, least(a, level) AS slot FROM c, l),
        x AS (SELECT *, 320 - sum(slot) OVER () AS rest, row_number() OVER (ORDER BY slot - a, subclass) AS o FROM s), t AS (SELECT subclass, slot + CASE WHEN a > slot AND o <= rest THEN 1 ELSE 0 END AS slot FROM x),
        k AS (SELECT r.*, row_number() OVER (PARTITION BY subclass ORDER BY lc DESC, filename) AS rn FROM r) SELECT subclass, count(*) AS n, min(filename) AS first_filename FROM k JOIN t USING (subclass) WHERE rn <= slot GROUP BY 1""",
    "mixture_caps": _C + """, n AS (SELECT subclass, count(*) AS n FROM corpus WHERE split = 'validation' GROUP BY 1),
        b AS (SELECT subclass, n, least(CASE WHEN n >= 75 THEN 0 WHEN n >= 30 THEN n WHEN n >= 15 THEN 2 * n WHEN n >= 5 THEN 3 * n ELSE 0 END, floor(n * 0.5::DOUBLE / 0.5::DOUBLE)::BIGINT) AS bound FROM n),
        room AS (SELECT floor(sum(n) * 0.3::DOUBLE / 0.7::DOUBLE)::BIGINT AS room FROM b), lv AS (SELECT max(k) AS level FROM range(0, 1000) t(k), room WHERE k <= (SELECT max(bound) FROM b) AND (SELECT sum(least(bound, k)) FROM b) <= room),
        s AS (SELECT subclass, bound, least(bound, level) AS cap FROM b, lv), x AS (SELECT *, room - sum(cap) OVER () AS rest, row_number() OVER (ORDER BY cap - bound, subclass) AS o FROM s, room),
        t AS (SELECT subclass, cap + CASE WHEN bound > cap AND o <= rest THEN 1 ELSE 0 END AS cap FROM x),
        k AS (SELECT subclass, row_number() OVER (PARTITION BY subclass ORDER BY filename) AS rn FROM corpus WHERE split <> 'validation')
        SELECT k.subclass, CASE WHEN cap IS NULL THEN 'no_authentic_support' WHEN rn > cap THEN 'mixture_cap' END AS reason, count(*) AS n FROM k LEFT JOIN t ON t.subclass = k.subclass GROUP BY 1, 2""",
    "eligibility": f"""WITH {CORPUS_SQL}, {JUDGED_SQL}, n AS (SELECT doc_type, subclass, count(*) AS n FROM corpus WHERE split <> 'test' GROUP BY 1, 2), s AS (SELECT *, n / (sum(n) OVER (PARTITION BY doc_type))::DOUBLE AS share,
        (CASE WHEN n >= 75 THEN 0 WHEN n >= 30 THEN n WHEN n >= 15 THEN 2 * n WHEN n >= 5 THEN 3 * n ELSE 0 END) AS cap FROM n),
        t AS (SELECT gt_subclass AS subclass, count(*) AS support, count(*) FILTER (sc_correct) AS tp FROM judged GROUP BY 1), q AS (SELECT pred_subclass AS subclass, count(*) AS said FROM judged GROUP BY 1),
        f AS (SELECT subclass, 2 * tp / (support + coalesce(said, 0))::DOUBLE AS f1 FROM t LEFT JOIN q USING (subclass)),
        x AS (SELECT DISTINCT gt_subclass AS subclass FROM (SELECT gt_subclass, pred_subclass, count(*) AS n FROM judged WHERE gt_subclass <> pred_subclass GROUP BY 1, 2) WHERE n >= 12),
        w AS (SELECT s.*, concat_ws(',', CASE WHEN n < 20 THEN 'below_authentic_floor' END, CASE WHEN f1 < 0.65::DOUBLE THEN 'macro_f1_below_floor' END, CASE WHEN subclass IN (SELECT subclass FROM x) THEN 'high_confusion_with_neighbor' END, CASE WHEN share > 0 AND share < 0.1::DOUBLE THEN 'sibling_underrepresented' END) AS why FROM s LEFT JOIN f USING (subclass))
        SELECT doc_type, subclass, n, cap, why <> '' AND cap > 0 AS eligible, CASE WHEN NOT (why <> '' AND cap > 0) AND cap = 0 AND n >= 20 THEN concat_ws(',', nullif(why, ''), 'tier_cap_zero') ELSE why END AS reasons FROM w""",
    "pseudo_label_gates": f"""WITH {_CAND} SELECT filename, CASE WHEN dc IS NULL OR ag IS NULL THEN 'missing_confidence' WHEN pt NOT IN ('', 'correspondence') THEN 'not_correspondence' WHEN dc < 0.88::DOUBLE THEN 'below_doc_type_conf'
        WHEN sc < 0.9::DOUBLE THEN 'below_subclass_conf' WHEN ag < 0.9::DOUBLE THEN 'below_agreement' WHEN trim(doc_text) = '' THEN 'missing_doc_text' WHEN substr(subclass, 4)::INT >= 17 THEN 'unresolvable_subclass'
        WHEN doc_id % 10 = 0 OR contains({_WORDS.format('title')}, {_WORDS.format('subclass')}) THEN 'leak_title' END AS reason, round_even(least(dc, sc, ag), 4) AS label_confidence FROM cand""",
    "pool_assembly": f"WITH {_POOL} SELECT filename, reason FROM pool",
    "reject_reasons": f"WITH {_POOL} SELECT reason, count(*) AS n FROM pool WHERE reason <> 'kept' GROUP BY 1",
    "ngram_contamination": f"SELECT d.doc_id, count(*) AS n_shared FROM {_grams('documents', 'doc_id', 'text')} d WHERE d.g IN (SELECT g FROM {_grams('benchmark', 'item_id', 'text')}) GROUP BY 1",
    # Pairs of texts as sets of 4-grams; each copy is paired with the first of its text.
    "char_jaccard_near_dup": r"""WITH t AS (SELECT min(doc_id) AS id, text FROM documents GROUP BY text), f AS (SELECT id, regexp_replace(lower(text), '[\s\pZ]+', ' ', 'g') AS s FROM t),
        g AS (SELECT DISTINCT id, substr(s, k, 4) AS g FROM (SELECT id, s, unnest(range(1, length(s) - 2)) AS k FROM f WHERE length(s) >= 4)), z AS (SELECT id, count(*) AS z FROM g GROUP BY 1),
        r AS (SELECT g, row_number() OVER (ORDER BY count(*), g) AS r FROM g GROUP BY 1), o AS (SELECT id, r, z, row_number() OVER (PARTITION BY id ORDER BY r) AS k FROM g JOIN r USING (g) JOIN z USING (id)),
        c AS (SELECT DISTINCT a.id AS a, b.id AS b FROM o a JOIN o b ON a.r = b.r AND a.id < b.id WHERE a.k <= a.z - ceil(0.85 * a.z) + 1 AND b.k <= b.z - ceil(0.85 * b.z) + 1),
        p AS (SELECT a, b, count(*) AS shared FROM c JOIN g x ON x.id = a JOIN g y ON y.id = b AND y.g = x.g GROUP BY 1, 2)
        SELECT a, b, round(shared / (x.z + y.z - shared)::DOUBLE, 9) AS similarity FROM p JOIN z x ON x.id = a JOIN z y ON y.id = b WHERE shared / (x.z + y.z - shared)::DOUBLE > 0.85::DOUBLE
        UNION ALL SELECT t.id, d.doc_id, 1.0 FROM documents d JOIN t USING (text) JOIN z USING (id) WHERE d.doc_id <> t.id""",
    "proper_noun_overlap": r"""WITH """ + CORPUS_SQL + r""", m AS (SELECT doc_id, split, regexp_replace(doc_text, '[\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2C1}\x{370}-\x{1FFF}]', '_', 'g') AS t FROM corpus),
        s AS (SELECT DISTINCT doc_id, split, unnest(regexp_extract_all(t, '\b[A-Z][a-z]+(?:[ \t\x0b\f\r]+[A-Z][a-z]+)+\b')) AS span FROM m) SELECT doc_id, count(*) AS n_shared FROM s WHERE split <> 'test' AND span IN (SELECT span FROM s WHERE split = 'test') GROUP BY 1""",
    "spot_audit": _C + "SELECT subclass, count(*) FILTER (split <> 'test') AS n FROM corpus GROUP BY 1 HAVING count(*) FILTER (split = 'test') < 6 AND count(*) FILTER (split <> 'test') > 0",
    "verdict_shares": "SELECT source AS subclass, count(*) AS n, round(avg((doc_id % 4 <> 0)::INT), 9) AS accepted FROM documents GROUP BY 1 HAVING count(*) >= 5",
    "log_deltas_median": "WITH d AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6::DOUBLE AS s FROM events), r AS (SELECT user_id, s, row_number() OVER (PARTITION BY user_id ORDER BY s) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM d WHERE s IS NOT NULL) SELECT user_id, n, round(s, 6) AS median FROM r WHERE r = n // 2 + 1",
    "ema_throughput": "WITH l AS (SELECT user_id, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY 1) SELECT user_id, len(v) AS n, round(list_reduce(v, lambda a, x: a * 0.8::DOUBLE + x * 0.2::DOUBLE), 6) AS ema FROM l",
    "event_rates_tumbling": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
    "last_events": "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 2",
    "run_telemetry": "WITH r AS (SELECT o_orderpriority, round(sum(o_totalprice) / 1000, 3) AS seconds, count(*) AS n_docs FROM orders GROUP BY 1) SELECT o_orderpriority, seconds, n_docs, round(seconds / n_docs, 9) AS seconds_per_doc, round(seconds / 3600 * 0.8, 4) AS usd FROM r",
    "manifest_upsert": _C + "SELECT doc_id, subclass, split, (CASE WHEN split = 'train' THEN 1 ELSE 10 END * length(doc_text))::INT AS n FROM corpus",
    "event_props": "WITH k AS (SELECT event_type, unnest(json_keys(props)) AS field FROM events) SELECT event_type, field, count(*) AS n FROM k GROUP BY 1, 2",
    "nation_revenue": "SELECT n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
}
