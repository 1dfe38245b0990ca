"""Pools, gates, heads, reports and staged trees on small hand-made rows."""

import json

import pytest
from pyspark.sql import functions as F

from curata.operators import corpus, dedup, evaluate, gates, labels, ops, pools, report, split
from curata.sources import readers, sinks

CANON = "filename string, doc_type string, subclass string, split string, doc_text string, content_sha256 string, text_sha256 string"


def canonical(spark, rows):
    df = spark.createDataFrame(rows, "filename string, doc_type string, subclass string, split string, doc_text string")
    return df.withColumns({"content_sha256": F.sha2("doc_text", 256), "text_sha256": F.sha2("doc_text", 256)})


def reasons(df, key="filename"):
    return {r[key]: r["reason"] for r in df.collect()}


def test_first_wins_keeps_one_row(spark):
    rows = spark.createDataFrame([("a", "h1"), ("a", "h1"), ("b", "h1"), ("c", None), ("c", None), ("d", "")], "filename string, content_sha256 string")
    out = dedup.first_wins(rows)
    assert out.where("reason is null and content_sha256 = 'h1'").count() == 1 and out.where("reason = 'duplicate_sha'").count() == 2
    assert out.where("reason is null").count() == 4


def test_collisions_know_all_hashes_and_opaque_ones(spark):
    known = spark.createDataFrame([("f", "h1", "t1"), ("f", "h2", "t2"), ("f", "h3", "t3"), ("g", "", "t4"), ("g", None, "t5")], "filename string, content_sha256 string, text_sha256 string")
    rows = spark.createDataFrame([(1, "f", "h2", "x"), (2, "f", "h9", "x"), (3, "g", "h9", "x"), (4, "f", "h9", "t3"), (5, "z", "h1", "t1")], "id int, filename string, content_sha256 string, text_sha256 string")
    assert reasons(dedup.filename_collisions(rows, known, text_key="text_sha256"), "id") == {1: None, 2: "filename_collision", 3: None, 4: None, 5: None}


def test_families_are_required_where_asked(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", None)], "filename string, family string")
    assert split.grouped_split(rows, "family", 0.5).where("filename = 'b' and split = 'train'").count() == 1
    with pytest.raises(ValueError):
        split.grouped_split(rows, "family", 0.5, require=True)


def test_epoch_order_depends_on_the_epoch_alone(spark):
    docs = spark.range(50).select(F.concat(F.lit("f"), "id").alias("filename"))
    order = lambda e, df: [r["filename"] for r in split.epoch_order(df, e).orderBy("place").collect()]
    assert order(1, docs) == order(1, docs.orderBy(F.desc("filename"))) != order(2, docs) and sorted(order(2, docs)) == sorted(order(1, docs))


def test_nested_pool(spark):
    known = canonical(spark, [(f"k{i}", "en", "sale", "train", f"canonical text {i}") for i in range(4)] + [("taken", "en", "sale", "test", "other text")])
    rows = [("a", "a fresh text", "Sale", "A title"), ("b", "a  fresh text ", "sale", ""), ("c", "  ", "sale", ""), ("d", "canonical text 2", "sale", ""), ("taken", "yet another", "sale", ""), ("e", "text e", "nonsense", ""), ("f", "text f", "sale", "A Sale of things"), (None, "text g", "rent", "")]
    pool = spark.createDataFrame([(i, (t,), json.dumps({"category": c}), title) for i, t, c, title in rows], "id string, input struct<doc_text:string>, metadata string, title string")
    spec = pools.Spec(doc_type="en", label_source="x", lineage="x", head=["sale", "rent"], normalize=lambda raw: labels.enum_label(raw, ["sale", "rent"]), labels=["subclass", "category"], other="reject", off_head="subclass_not_on_head", title="title", cap=1.25, prefix="x")
    done = pools.assemble(pool, known, spec)
    got = reasons(done.rejected)
    assert {k: got[k] for k in ("b", "c", "d", "taken", "e", "f")} == {"b": "duplicate_sha", "c": "missing_doc_text", "d": "duplicate_sha_canonical", "taken": "filename_collision", "e": "unresolvable_subclass", "f": "leak_title"}
    assert [v for k, v in got.items() if k.startswith("x:")] == ["cap_en"]  # one new row for four train rows
    kept = done.kept.first()
    assert (kept["filename"], kept["title"], kept["split"], kept["tier"], kept["doc_text"]) == ("a", "", "train", 1, "a fresh text")
    assert done.kept.columns[: len(pools.DOCUMENT)] == list(pools.DOCUMENT)
    with pytest.raises(ValueError):
        pools.documents_only(pool)


def test_tiers_combine_in_order_of_names(spark):
    known = canonical(spark, [(f"k{i}", "claim", "auto", "train", f"canonical text {i}") for i in range(2)])
    flat = "filename string, doc_text string"
    spec = lambda **m: pools.Spec(**({"doc_type": "claim", "label_source": "x", "lineage": "", "head": ["auto", "property"], "exact": True} | m))
    given = {
        "b": (spark.createDataFrame([("p1", "one"), ("p2", "two")], flat), spec(fixed="property")),
        "a": (spark.createDataFrame([("r1", "one"), ("r2", None)], flat), spec(fixed="auto", render=True)),
        "c": (spark.createDataFrame([("n1", "three")], flat), spec(fixed="narrative")),
        "d": (spark.createDataFrame([("z1", "four"), ("z2", "five")], flat), spec(fixed="auto")),
    }
    done, stats = pools.tier1(given, known, capped="claim", mult=2.0)
    assert {r["filename"] for r in done.kept.collect()} == {"p2", "r1"}  # two new rows: the tail label, then by name
    assert {(r["pool"], r["filename"]): r["reason"] for r in done.rejected.collect()} == {("a", "r2"): "needs_render", ("c", "n1"): "subclass_not_on_head", ("cross_pool", "p1"): "duplicate_sha_cross_pool", ("class_cap", "z1"): "cap_insurance_class", ("class_cap", "z2"): "cap_insurance_class"}
    assert {r["pool"]: (r["kept"], r["rejected"], r["needs_render"]) for r in stats.collect()} == {"a": (1, 0, 1), "b": (2, 0, 0), "c": (0, 1, 0), "d": (2, 0, 0)}


def test_mail_pool_is_balanced(spark):
    known = canonical(spark, [(f"k{i}", "mail", "x" if i < 6 else "y", "train", f"canonical {i}") for i in range(8)])
    rows = [(f"m{i}", f"mail text {i}", "mail" if i else "note", "x" if i % 3 else "y", i % 4 > 0, "false" if i % 4 > 1 else "yes") for i in range(16)]
    pool = spark.createDataFrame(rows, "filename string, doc_text string, expected string, expected_subclass string, a boolean, b string")
    spec = pools.Spec(doc_type="mail", label_source="gt", lineage="", head=["x", "y"], labels=["expected_subclass"], lineage_columns=("a", "b"), class_column="expected", off_head="unresolvable_subclass")
    first = pools.assemble(pool, known, spec)
    done = pools.balanced(first, known, spec)
    assert done.kept.count() <= 8 and reasons(first.rejected) == {"m0": "not_mail"}
    assert {r["lineage"] for r in first.kept.collect()} == {"a+b", "a", "b"}
    with pytest.raises(ValueError):
        pools.assemble(pool.drop("a"), known, spec)


CARD_ROWS = [("en", "sale", ["price", "Re:"], ["lorem"], ["sale"], ["clause"], ["secret"]), ("en", "rent", [], [], [], [], [])]


def test_gates(spark):
    good = "The price is in the clause and nothing else"
    rows = [
        (1, "en", "sale", good, "A sale", None, "en", "sale", 0.9), (2, "en", "sale", "", "A sale", None, "en", "sale", 0.9), (3, "en", "other", good, "t", None, "en", "sale", 0.9), (4, "en", "sale", good, " ", None, "en", "sale", 0.9),
        (5, "en", "rent", "we share five words of it in here", "t", None, "en", "rent", 0.9), (6, "en", "sale", "the prices of a clause", "sale", None, "en", "sale", 0.9), (7, "en", "sale", good + " lorem", "sale", None, "en", "sale", 0.9),
        (8, "en", "rent", "a word with Big Bank Plc inside", "t", None, "en", "rent", 0.9), (9, "en", "rent", "the house of Mary Smith is here", "t", None, "en", "rent", 0.9), (10, "en", "sale", good + " x", "t", None, "en", "sale", 0.9),
        (11, "en", "sale", "Re: a thing", "sale", None, "en", "sale", 0.9), (12, "en", "sale", good + " SECRET", "sale", None, "en", "sale", 0.9), (13, "en", "rent", "q1", "t", ("", ""), "en", "rent", 0.9), (14, "en", "rent", "q2", "t", ("fr", "rent"), "en", "rent", 0.9),
        (15, "en", "sale", good + " y", "no pattern", (None, "sale"), "en", "sale", 0.9), (16, "en", "rent", "a longish text that the pool has nearly as it is", "t", None, "en", "rent", 0.9), (17, "en", "rent", "q3", "t", None, None, "rent", 0.9),
        (18, "en", "rent", "q4", "t", None, "en", "sale", 0.9), (19, "en", "rent", "q5", "t", None, "en", "rent", float("nan")), (20, "en", "rent", "q6", "t", None, "en", "rent", None), (21, "en", "rent", "q7", "t", None, "en", "rent", 0.5),
    ]
    df = spark.createDataFrame(rows, "id int, parent_class string, subclass string, doc_text string, title string, adjudication struct<parent_class:string, subclass:string>, model_doc_type string, model_subclass string, model_probability double")
    held = spark.createDataFrame([("we share five words of something",), ("where Mary Smith lives",)], "doc_text string")
    pool = spark.createDataFrame([("a longish text that the pool has nearly as it is!",)], "doc_text string")
    out = {r["id"]: (r["first_failure"], r["reason"]) for r in gates.seven_gates(df, spark.createDataFrame(CARD_ROWS, gates.CARD), held, "id", ["big bank"], pool).collect()}
    s, c, a, m = "schema", "rule_cues", "independent_adjudication", "model_disagreement"
    assert out == {
        1: (None, None), 2: (s, "empty_doc_text"), 3: (s, "no_label_card"), 4: (s, "empty_title"), 5: ("lexical_contamination", "ngram_overlap"), 6: (c, "missing_positive_cue"), 7: (c, "negative_cue_present"), 8: ("entity_overlap", "known_entity"), 9: ("entity_overlap", "shared_span"),
        10: (a, "title_pattern_miss"), 11: (a, "required_structure_miss"), 12: (a, "prohibited_fact_present"), 13: (a, "adjudication_empty"), 14: (a, "adjudication_mismatch"), 15: (None, None), 16: ("embedding_diversity", "near_duplicate"),
        17: (m, "missing_model_prediction"), 18: (m, "model_label_mismatch"), 19: (m, "model_prob_below_floor"), 20: (None, None), 21: (None, None),
    }
    known = canonical(spark, [(f"k{i}", "en", "rent", "train", f"there Mary Smith lives {i}") for i in range(9)])
    done, audit = pools.tier3(df.withColumn("filename", F.col("id").cast("string")), spark.createDataFrame(CARD_ROWS, gates.CARD), known, known_entities=["big bank"], label_share=0.9, global_share=0.9)
    assert audit.where("passed").count() == done.kept.count() + done.rejected.count() and done.kept.where("tier = 3 and example_weight = 0.5").count() == done.kept.count()


def test_windows_are_never_made_up(spark):
    docs = spark.createDataFrame([("a", "en", "x", ["one", "two"])], "filename string, doc_type string, subclass string, windows array<string>")
    assert [(r["window_index"], r["text"], r["n_windows"]) for r in pools.enrichment_windows(docs).orderBy("window_index").collect()] == [(0, "one", 2), (1, "two", 2)]
    with pytest.raises(ValueError):
        pools.enrichment_windows(docs.withColumn("windows", F.lit(None).cast("array<string>")))


def test_labels(spark):
    values = [None, " ", "Non-Compete!", "affiliate_agreement", "Affiliate Agreements of old", "licence", "zzz"]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    keys = ["noncompete", "affiliate", "license"]
    out = rows.select("k", labels.contract_label(F.col("v"), keys, {"licence": "license"}, {"affiliate": "Affiliate Agreement"}).alias("l")).orderBy("k").collect()
    assert [r["l"] for r in out] == ["other", "other", "noncompete", "affiliate", "affiliate", "license", "other"]
    docs = spark.createDataFrame([("en", "b", "train"), ("en", "b", "train"), ("en", "a", "train"), ("en", "c", "validation"), ("en", "t", "test"), ("fr", "x", "train")], "doc_type string, subclass string, split string")
    heads = labels.head_maps(labels.head_table(docs, {"en": ["c", "b"]}, {"fr": ["y", "x", "other"]}, {"fr": ["other"]}))
    assert heads["en"]["labels"] == ["c", "b", "a"] and heads["en"]["inference_only"] == ["c"] and heads["en"]["weights"] == {"b": 0.75, "a": 1.5}
    assert heads["fr"]["labels"] == ["y", "x", "other"] and heads["fr"]["trainable_labels"] == ["y", "x"] and heads["fr"]["routing_only"] == ["other"]
    plan = labels.support_plan(docs.where("split = 'train'"), docs.select("doc_type", "subclass").unionByName(spark.createDataFrame([("fr", "other")], "doc_type string, subclass string")), 2)
    assert {(r["subclass"], r["action"]) for r in plan.collect()} == {("a", "dropped"), ("x", "remapped")}
    assert sorted(r["subclass"] for r in labels.apply_support(docs, plan).collect()) == ["b", "b", "c", "other", "t"]


def test_staged_tree(spark, tmp_path):
    root = str(tmp_path / "stage")
    docs = spark.createDataFrame([(f"f{i}", f"text {i}", s) for i, s in enumerate(["train", "train", "validation", "test"])], "filename string, doc_text string, split string")
    windows = docs.where("split <> 'test'").withColumn("window_index", F.lit(0))
    assert sinks.stage_tree(spark, docs, root, windows) == {"documents": {"train": 2, "validation": 1, "test": 1}, "windows": {"train": 2, "validation": 1}}
    assert readers.read_training(spark, root, "train").columns == windows.columns and readers.read_training(spark, root, "test").count() == 1
    assert readers.eval_documents(spark, root, "validation", docs.limit(0)).count() == 1 and readers.eval_documents(spark, root, "train", docs).count() == 3
    plus = spark.createDataFrame([("g", "more")], "filename string, doc_text string")
    assert readers.eval_documents(spark, root, "heldout-plus", docs, plus).columns == ["filename", "doc_text"]
    with pytest.raises(ValueError):
        readers.eval_documents(spark, root, "heldout-plus", docs, docs)
    sinks.replace_shards(spark, docs.limit(1).withColumn("split", F.lit("train")), root, "documents")
    assert sinks.stage_counts(spark, root)["documents"]["train"] == 3
    assert readers.without_shards(spark.read.option("recursiveFileLookup", True).parquet(f"{root}/data/documents/train")).count() == 2
    assert sinks.dataset_info(spark, root)["windows"]["splits"]["train"]["num_examples"] == 2
    assert sinks.stage_tree(spark, docs, root) .get("windows") is None and not readers.exists(spark, f"{root}/data/windows")


def test_pool_readers(spark, tmp_path):
    spark.createDataFrame([("a", "x"), ("b", "y")], "filename string, expected string").write.parquet(str(tmp_path / "mail/ground_truth"))
    spark.createDataFrame([("a", "hello", "s")], "filename string, text string, subject string").write.parquet(str(tmp_path / "mail/blind"))
    assert readers.read_mail(spark, str(tmp_path / "mail")).select("filename", "doc_text", "subject").collect() == [("a", "hello", "s")]
    spark.createDataFrame([(((("7",), [("one",), (None,), ("two",)])),)], "data struct<claim:struct<claimId:string>, contextDocuments:array<struct<extractedDocumentContent:string>>>").write.parquet(str(tmp_path / "claims"))
    assert readers.read_claims(spark, str(tmp_path / "claims")).first()[:2] == ("property:7.txt", "one\n\n\n\ntwo")
    spark.createDataFrame([(3,)], "claim_id int").write.parquet(str(tmp_path / "reg"))
    assert readers.resolve_pool(spark, "mail@blind", str(tmp_path)) == (str(tmp_path / "mail/blind"), "blind")
    assert readers.resolve_pool(spark, str(tmp_path / "reg"), "")[1] == readers.revision(spark, str(tmp_path / "reg"))
    with pytest.raises(FileNotFoundError):
        readers.resolve_pool(spark, "mail@none", str(tmp_path))
    assert readers.read_register(spark, str(tmp_path / "reg")).first()["filename"] == "auto:3.txt"
    (tmp_path / "n.csv").write_text('index,claim_narrative\n1,"two\nlines"\n')
    assert readers.read_narratives(spark, str(tmp_path / "n.csv")).select("filename", "doc_text").first() == ("insurbias:1.txt", "two\nlines")
    (tmp_path / "train.jsonl").write_text('{"a": 1}\n')
    assert readers.read_rendered(spark, str(tmp_path), "a int").first()["a"] == 1 and readers.read_table(spark, str(tmp_path / "train.jsonl")).count() == 1
    with pytest.raises(ValueError):
        readers.read_table(spark, str(tmp_path / "x.txt"))


def test_held_out_rows_and_guards(spark):
    known = canonical(spark, [("k1", "mail", "x", "train", "text one"), ("k2", "mail", "x", "test", "text two")])
    gt = spark.createDataFrame([("a", "mail", "x"), ("b", "mail", "x"), ("k1", "mail", "x"), ("c", "note", "x"), ("d", "mail", "x"), ("e", "mail", "zz"), ("f", "mail", "x")], "filename string, expected string, expected_subclass string")
    texts = spark.createDataFrame([("a", "text one", ""), ("k1", "text one", ""), ("c", "t", ""), ("d", " ", ""), ("e", "text two", "Subject"), ("f", "new", None)], "filename string, text string, subject string")
    out = pools.held_out(gt, texts, known, lambda raw: labels.enum_label(raw, ["x"]), "mail")
    assert reasons(out) == {"a": "sha_overlap", "b": "no_text", "k1": "filename_overlap", "c": "label", "d": "empty", "e": None, "f": None}
    report.check_same_model({"artifact_sha": "a"}, {})
    with pytest.raises(ValueError):
        report.check_same_model({"artifact_sha": "a" * 20}, {"artifact_sha": "b" * 20})
    with pytest.raises(ValueError):
        report.plus_slice(known, known.limit(0))
    with pytest.raises(ValueError):
        corpus.verify_counts(known, {"train": 2}, ["mail"])
    assert corpus.verify_counts(known, {"train": 1, "": 2}, ["mail"]) is known
    assert "| k1 |" in report.markdown(known.select("filename").orderBy("filename"), "Files", 1) and "1 more" in report.markdown(known.select("filename"), "Files", 1)


def test_pool_scores_keep_rows_that_fail(spark):
    def make():
        def score(title, text):
            if not text:
                raise ValueError("empty")
            return {"confidence": 0.9, "subclass_confidence": 0.8, "agreement": 1.0} if text != "long" else {"reason": "oversize"}

        return score

    rows = spark.createDataFrame([("a", "t", "x"), ("b", "t", ""), ("c", None, "long")], "filename string, title string, doc_text string")
    out = {r["filename"]: (r["doc_type_conf"], r["scored"], r["score_reason"]) for r in evaluate.score_pool(rows, make).collect()}
    assert out == {"a": (0.9, True, ""), "b": (0.0, False, "error:ValueError"), "c": (0.0, False, "oversize")}


def test_log_lines(spark):
    lines = spark.createDataFrame([(x,) for x in ("step 20 loss 0.5 2.0 steps/s 16.0 samples/s ETA 1m 2s ", "test doc 3/10 doc_type_acc 0.9", "test doc 4/10 doc_type_acc 0.8 subclass_cond 0.5", "test metrics: {'a': 1}", "noise")], "value string")
    out = ops.parse_log(lines).collect()
    assert [r["event"] for r in out] == ["step", "test_step", "test_step", "test_complete"]
    assert out[0]["numbers"] == {"step": 20.0, "loss": 0.5, "steps_per_sec": 2.0, "samples_per_sec": 16.0} and out[0]["eta"] == "1m 2s"
    assert "subclass_acc_conditional" not in out[1]["numbers"] and out[2]["numbers"]["subclass_acc_conditional"] == 0.5 and json.loads(out[3]["metrics"]) == {"a": 1}
    assert ops.eta(spark.createDataFrame([(4, 2.0), (4, None)], "micro_done int, ema double"), 10).collect()[0]["eta_seconds"] == 12.0
