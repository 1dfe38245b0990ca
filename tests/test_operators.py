"""Semantics that the driver's tables do not show: rounding, ties, missing values, order of guards, sources and streams."""

import json
import os

import pytest
from pyspark.sql import functions as F

from curata.functions import arrays as ar
from curata.functions import text as tx
from curata.operators import calibrate, corpus, dedup, enrich, evaluate, merge, ops, ranks, split
from curata.sources import readers, sinks
from curata.streaming import tail


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("n, tokens", [(0, 1), (2, 1), (6, 2), (10, 2), (14, 4)])
def test_estimate_rounds_half_to_even(spark, n, tokens):
    assert one(spark, tx.estimate_tokens(F.lit("x" * n))) == tokens


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("a-\nb-\nc", "abc"),
        ("| a   b |  ", "| a   b |"),
        ("x\u00a0\u00a0y", "x y"),
        ("a\r\n\r\n\r\n\r\nb", "a\n\nb"),
        ("\u200ba\ufeff\x01b", "a b"),
        ("a\u2028b", "a\nb"),
        ("\n\n  a  \n\n", "a"),
        ("", ""),
    ],
)
def test_clean(spark, raw, clean):
    assert one(spark, tx.clean(F.lit(raw))) == clean


def test_compose_only_where_needed(spark):
    rows = spark.createDataFrame([(1, "e\u0301"), (2, "plain"), (3, None)], "i int, t string")
    assert {r["i"]: r["t"] for r in tx.compose(rows, "t").collect()} == {1: "\u00e9", 2: "plain", 3: None}


@pytest.mark.parametrize("value, hash_", [(None, ""), (" NaN ", ""), ("None", ""), ("<NA>", ""), ("ab", "ab")])
def test_missing_hash(spark, value, hash_):
    assert one(spark, tx.hash_or_empty(F.lit(value).cast("string"))) == hash_


@pytest.mark.parametrize("conf, at", [(0.0, 0), (0.3, 2), (0.6, 5), (0.7, 6), (1.0, 9), (1.1, None), (-0.1, None)])
def test_bin_edges(spark, conf, at):
    assert one(spark, ar.bin_of(F.lit(conf))) == at


def test_finite(spark):
    for v in (float("nan"), float("inf"), float("-inf")):
        assert one(spark, ar.finite(F.lit(v))) is None


@pytest.mark.parametrize("few", [500_000, 0])
def test_overlaps_do_not_shuffle_candidates_for_a_small_corpus(spark, monkeypatch, few):
    monkeypatch.setattr(enrich, "FEW", few, raising=False)
    rows = spark.createDataFrame([(1, "one two three four five six"), (2, "one two three nine five six"), (3, None), (4, "Big Bank of four five six seven")], "id long, t string")
    corpus = spark.createDataFrame([("x two three four five six y",), ("said Big Bank today",)], "t string")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plans, settle = [], enrich.settled
    monkeypatch.setattr(enrich, "settled", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or settle(df))
    try:
        hits = {r["id"]: r["n_shared"] for r in enrich.ngram_hits(rows, corpus, "id", "t", "t", 5).collect()}
        named = enrich.entity_hits(rows, corpus, "id", "t", "t")
        found = {r["id"] for r in named.collect()}
        plans.append(named._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert hits == {1: 1} and found == {4}
    joins = [p for p in plans if "LeftSemi" in p]
    assert len(joins) >= 2 and all(("SortMergeJoin" not in p) == (few > 0) for p in joins)


def test_ngrams_of_short_texts(spark):
    assert one(spark, tx.word_ngrams(F.lit("a b c"), 5)) == []
    assert one(spark, tx.char_ngrams(F.lit("ab"), 4)) == []
    assert one(spark, tx.jaccard(F.array().cast("array<string>"), F.array(F.lit("a")))) == 0.0
    assert one(spark, tx.word_ngrams(F.lit("É a b"), 2)) == ["a b"]


@pytest.mark.parametrize("cue, found", [("cat", False), ("the cat", True), ("concat", True), ("", False)])
def test_cues(spark, cue, found):
    assert one(spark, tx.cue_present(F.lit("concat of the catalogue"), cue)) is found


def test_adjusted_common_prefix(spark):
    assert one(spark, ar.adjusted(F.array(*[F.lit(float(x)) for x in (1, 2, 3)]), [1.0, 1.0], 2.0)) == [3.0, 4.0, 3.0]


def test_votes_tie_to_the_first_seen(spark):
    rows = spark.createDataFrame([("d", 0, [0.1, 0.9]), ("d", 1, [0.8, 0.2])], "filename string, window_index int, probs array<double>")
    r = merge.window_votes(rows).first()
    assert (r["winner"], r["agreement"], r["runner_up"]) == (1, 0.5, 0)


def test_section_map_drops_overlaps(spark):
    sections = F.from_json(F.lit('[{"name":"a","begin":0,"end":5},{"name":"b","begin":3,"end":9},{"name":"c","begin":5,"end":6},{"name":"d","begin":6,"end":6}]'), "array<struct<name:string,begin:int,end:int>>")
    assert [s["name"] for s in one(spark, merge.section_map(sections))] == ["a", "c"]


def test_oversize_names_tokens_first(spark):
    assert one(spark, merge.bert_intake(F.lit("x" * 20), F.lit(False), F.lit(9), max_chars=10, max_tokens=5)) == "oversize_tokens"
    assert one(spark, merge.bert_intake(F.lit("x"), F.lit(False), F.lit(1), flag=False)) == "flag_off"


def test_gate_fails_on_missing_values(spark):
    row = spark.createDataFrame([(1, None)], "doc_id int, method string").selectExpr("*", "true context_fit", "1.0D coverage", "false messy", "0 n_guard_failures", "double('NaN') confidence", "true triage_vocab_ok", "true section_map_ok", "'en' doc_type", "'en' sorter_type", "cast(null as string) reviewer_type")
    r = merge.intake_gate(row, "skip", ["en"]).first()
    assert (r["verdict"], r["failures"]) == ("FAIL", "F1,F3")


def test_water_fill():
    assert enrich.water_fill({"a": 1, "b": 10, "c": 10}, 10) == {"a": 1, "b": 5, "c": 4}
    assert enrich.water_fill({"a": 2}, 10) == {"a": 2}
    assert enrich.water_fill({}, 5) == {}
    assert enrich.source_matched_cap(5, 2.5) == 7
    assert [enrich.synthetic_cap(n) for n in (4, 5, 15, 30, 75)] == [0, 15, 30, 30, 0]


def test_mixture_is_independent_of_order():
    counts = {"a": 20, "b": 7, "c": 40, "d": 3}
    assert enrich.mixture_caps(counts) == enrich.mixture_caps(dict(reversed(counts.items())))
    assert sum(enrich.mixture_caps(counts).values()) <= 30


def test_hash_files_names_every_row(spark):
    n = 2500
    rows = [("h", f"doc_{k}", "train" if k % 2 else "test") for k in range(n)] + [("h", "doc_1", "train"), ("x", "one", "test")]
    (r,) = dedup.hash_files(spark.createDataFrame(rows, "content_sha256 string, filename string, split string")).collect()
    assert (r["n"], r["filenames"], r["splits"]) == (n + 1, sorted(f"doc_{k}" for k in range(n)), ["test", "train"])


def test_char_similarity_matches_all_pairs(spark):
    texts = ["the quick brown fox jumps over the lazy dog", "the quick brown fox jumps over the lazy dog!", "something else entirely", "the quick brown fox jumped over a lazy dog"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    grams = lambda t: {t[k : k + 4] for k in range(len(t) - 3)}
    want = {(a, b) for b in range(4) for a in range(b) if len(grams(texts[a]) & grams(texts[b])) / len(grams(texts[a]) | grams(texts[b])) > 0.6}
    assert {(r["a"], r["b"]) for r in enrich.char_similarity(rows, "id", "text", 0.6).collect()} == want


def test_char_similarity_by_blocks_and_many_sizes(spark, monkeypatch):
    """Sketches of all widths, buckets of several blocks, and letters beyond the BMP: as all pairs give."""
    import random
    import re

    from curata.operators import alike

    monkeypatch.setattr(alike, "BLOCK", 16)
    draw, texts = random.Random(5), []
    for k in range(60):
        words = ["".join(draw.choice("abcdefghij é\U0001f600") for _ in range(draw.randint(2, 9))) for _ in range(draw.choice((1, 2, 5, 20, 90, 300)))]
        texts += [" ".join(words), " ".join(words[: -max(1, len(words) // 12)] + ["x" * (k % 7)]), " ".join(words + ["tail\n end"])]
    rows = spark.createDataFrame([(3 * k, t) for k, t in enumerate(texts)], "id long, text string")
    sets = [(lambda s: {s[k : k + 4] for k in range(len(s) - 3)})(re.sub(r"\s+", " ", t)) for t in texts]
    first = {}
    for k, t in enumerate(texts):
        first.setdefault(t, k)
    reps = sorted(first.values())
    want = {(3 * a, 3 * b, len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for i, b in enumerate(reps) for a in reps[:i] if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > 0.85}
    want |= {(3 * first[t], 3 * k, 1.0) for k, t in enumerate(texts) if first[t] != k and sets[k]}
    got = [tuple(r) for r in enrich.char_similarity(rows, "id", "text").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 40


def test_copies_are_near_duplicates(spark):
    rows = spark.createDataFrame([(3, "the very same text"), (1, "the very same text"), (2, "the very same text"), (4, "ab"), (5, "ab")], "id long, text string")
    assert sorted(map(tuple, enrich.char_similarity(rows, "id", "text").collect())) == [(1, 2, 1.0), (1, 3, 1.0)]


def test_similarity_to_a_prior_text(spark):
    texts = ["the quick brown fox jumps over the lazy dog near the river", "a letter about the premium that was never paid in march", "the third text is like none of the others at all"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    prior = spark.createDataFrame([(texts[0] + "s",), (texts[1],), (None,), ("",)], "doc_text string")
    got = {r["id"]: r["similarity"] for r in enrich.like_prior(rows, prior, "id", "text", "doc_text").collect()}
    assert set(got) == {0, 1} and got[1] == 1.0 and 0.85 < got[0] < 1


def test_cross_pool_rejected_rows_do_not_block(spark):
    schema = "filename string, content_sha256 string, text_sha256 string"
    pools = [spark.createDataFrame(r, schema) for r in ([("a", "1", "t1")], [("b", "1", "t2"), ("c", "2", "t1"), ("d", "4", "t4")], [("e", "3", "t2"), ("f", "t4", "t9")])]
    out = {(r["pool"], r["filename"]): r["reason"] for r in dedup.cross_pool(pools).collect()}
    hit = "duplicate_sha_cross_pool"
    assert out == {(0, "a"): None, (1, "b"): hit, (1, "c"): hit, (1, "d"): None, (2, "e"): None, (2, "f"): hit}


def test_replay_and_keyed_split_count_alike(spark):
    docs = spark.range(95).select(F.concat(F.lit("f"), "id").alias("filename"), (F.col("id") % 2).cast("string").alias("k"))
    a = split.stratified_split(docs, "k", 0.1).where("split = 'validation'").count()
    assert a == split.replay(docs, "k", 0.1).where("split = 'validation'").count() == 10


def test_sweep_of_no_rows(spark):
    empty = spark.createDataFrame([], "conf double, correct boolean")
    assert calibrate.selective_risk(empty).where("n > 0 or risk < 1").count() == 0
    assert calibrate.ece(empty).first()["ece"] == 0.0
    assert calibrate.routing_thresholds(calibrate.selective_risk(empty), 0.0, 0.01)["source"] == "fallback"


def test_temperature(spark):
    rows = spark.createDataFrame([([2.0, 0.0], k % 4 // 3) for k in range(200)], "logits array<double>, label int")
    import math

    assert abs(calibrate.fit_temperature(rows) - 2.0 / math.log(3)) < 0.05
    assert calibrate.fit_temperature(rows.limit(1)) == 1.0


def test_documents_take_the_last_text_and_need_one(spark):
    labels = spark.createDataFrame([("a", "x")], "filename string, doc_type string")
    schema = "filename string, doc_text string, metadata struct<subject:string, exhibit_description:string>"
    texts = spark.createDataFrame([("a", "old", (None, None)), ("a", "new  text", (" ", "Exhibit"))], schema).coalesce(1)
    r = corpus.documents(labels, texts).first()
    assert (r["doc_text"], r["title"]) == ("new text", "Exhibit")
    with pytest.raises(ValueError):
        corpus.documents(labels, texts.where("filename = 'b'"))


def test_token_windows_cover_and_overlap(spark):
    class Words:  # local, so it is sent to the workers as it is
        def encode(self, text):
            return text.split()

        def decode(self, ids):
            return " ".join(ids)

    docs = spark.createDataFrame([("a", "T", " ".join(map(str, range(50)))), ("b", "", "one two"), ("c", None, None)], "filename string, title string, doc_text string")
    for version, budget in ((1, 24), (2, 32)):
        out = corpus.token_windows(docs, Words, budget, 4, version).orderBy("filename", "window_index").collect()
        texts = [r["window_text"] for r in out if r["filename"] == "a"]
        head = (lambda k: "T\n\n") if version == 1 else (lambda k: f"[FILE_NAME] a\n[TITLE] T\n[WINDOW_INDEX] {k}\n\n")
        assert all(t.startswith(head(k)) for k, t in enumerate(texts))
        a = [[int(x) for x in t[len(head(k)) :].split() if x != "T"] for k, t in enumerate(texts)]
        assert sorted({x for w in a for x in w}) == list(range(50)) and a[0][-4:] == a[1][:4]
        assert all(len(t.split()) + 2 <= budget for t in texts)
        assert [r["n_windows"] for r in out if r["filename"] in "bc"] == [1, 1]
    assert corpus.windows_of(Words(), "a title that fills it all", "x " * 50, 9, 4) == ["a title that fills it all\n\n" + "x " * 50]
    with pytest.raises(ValueError):
        corpus.token_windows(docs, Words, 16, 4, 3)


def test_scorer_keeps_failing_rows(spark):
    docs = spark.createDataFrame([("a", "ok"), ("b", "")], "filename string, doc_text string")
    out = {r["filename"]: (r["scores"], r["error"]) for r in evaluate.score_with(docs, lambda: lambda t: [1 / len(t)], "key string, scores array<double>, error string").collect()}
    assert out["a"] == ([0.5], None) and out["b"][0] is None and "division" in out["b"][1]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('# comment\n\n{"a": 1, "g": "{\\"p\\": \\"q\\"}"}\nnot json\n')
    rows = readers.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int, g string").where("a is not null")
    assert readers.promote(rows, "g", ["p", "a"]).first().asDict() == {"a": 1, "g": '{"p": "q"}', "p": "q"}
    assert rows.select(readers.nested(F.col("g"), "p").alias("v"), readers.nested(F.lit("broken"), "p").alias("w")).first() == ("q", None)
    docs = spark.createDataFrame([("a", "en", "train"), ("b", "fr", "test")], "filename string, doc_type string, split string")
    sinks.stage(docs, str(tmp_path / "stage"))
    sinks.stage(docs.where("split = 'test'"), str(tmp_path / "stage"))
    assert spark.read.parquet(str(tmp_path / "stage")).count() == 2
    assert sinks.manifest(docs, "r") == sinks.manifest(docs.orderBy(F.desc("filename")), "r")
    sinks.register(docs.withColumn("reason", F.lit("x")), str(tmp_path / "rejects"), "p")
    assert sinks.read_register(spark.read.parquet(str(tmp_path / "rejects"))).first()["filename"] == "a"
    sinks.write_sidecar(str(tmp_path / "s.json"), {"b": 1})
    assert sinks.read_sidecar(str(tmp_path / "s.json")) == {"b": 1} and sinks.read_sidecar(str(tmp_path / "none")) is None
    assert readers.revision(spark, str(tmp_path / "stage")) == readers.revision(spark, str(tmp_path / "stage"))


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (2, 3, 0, 1), (3, 2, 1, 0)])
def test_stream_equals_batch(spark, tmp_path, order):
    folder = tmp_path / "log"
    folder.mkdir()
    values = [3.0, 1.0, 2.0, 5.0]
    lines = [json.dumps({"ts": "2024-01-01T00:00:00", "run": "r", "event": "step", "step": k, "seconds": v}) for k, v in enumerate(values)]
    for at, part in enumerate((order[:2], order[2:])):
        (folder / f"{at}.jsonl").write_text("\n".join([*(lines[k] for k in part), "{broken"]))
        os.utime(folder / f"{at}.jsonl", (1_700_000_000 + 60 * at,) * 2)  # in this order
    name = f"ema_{order[0]}"
    query = tail.ema(tail.follow(spark, str(folder), per_trigger=1)).writeStream.outputMode("update").format("memory").queryName(name).start()
    query.processAllAvailable()
    query.stop()
    got = spark.sql(f"select ema, late from {name} order by n desc").first()
    rows = spark.createDataFrame([("r", k, v) for k, v in enumerate(values)], "run string, step int, seconds double")
    assert abs(got["ema"] - ops.ema(rows, "run", ["step"], "seconds").first()["ema"]) < 1e-12 and got["late"] == 0


def test_stream_counts_what_comes_too_late(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(tail, "WAIT", 2)

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    state, out = State(), None
    for steps in ([5, 4, 6], [9, 1, 7]):
        out = next(tail._update(("r",), iter([pd.DataFrame({"step": steps, "seconds": [float(k) for k in steps]})]), state))
    want = 4.0
    for x in (5.0, 6.0, 7.0, 9.0):
        want = want * 0.8 + x * 0.2
    assert (out["n"][0], out["late"][0]) == (5, 1) and abs(out["ema"][0] - want) < 1e-12


def test_average_in_ranges_equals_a_loop(spark):
    import random

    rng = random.Random(4)
    rows = [(f"r{k % 3}", float(rng.randrange(1000)), k, rng.random() if rng.random() < 0.9 else None) for k in range(500)]
    got = {r["run"]: (r["n"], r["ema"]) for r in ops.ema(spark.createDataFrame(rows, "run string, at double, k long, v double"), "run", ["at", "k"], "v", parts=7).collect()}
    for run in ("r0", "r1", "r2"):
        a, mine = None, sorted(r[1:] for r in rows if r[0] == run)
        for _, _, v in mine:
            a = a if v is None else v if a is None else a * 0.8 + v * 0.2
        assert got[run][0] == len(mine) and abs(got[run][1] - a) < 1e-9


def test_upper_median_and_percentiles_are_exact(spark):
    import random

    import numpy as np

    rng = random.Random(5)
    rows = [("a", rng.gauss(0, 1)) for _ in range(3001)] + [("b", float(k % 3)) for k in range(2000)] + [("c", 4.0)] + [("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: (r["n"], r["median"]) for r in ops.upper_median(df, "g", "v").collect()}
    for g in "abc":
        mine = sorted(v for k, v in rows if k == g)
        assert got[g] == (len(mine), mine[len(mine) // 2])
    mine = [v for k, v in rows if k == "a"]
    shares = [0.0, 0.05, 0.5, 0.731, 1.0]
    assert np.allclose(ranks.exact_percentiles(df.where("g = 'a'"), F.col("v"), shares), np.percentile(mine, [100 * s for s in shares]))
    assert ranks.exact_percentiles(df.where("g = 'd'"), F.col("v"), [0.5]) == [None]


def test_effects_under_a_known_surface(spark):
    import random

    rng = random.Random(6)
    rows = [(f"f{k}", x, z, 2.0 * x + 0.5 * z + rng.gauss(0, 0.1)) for k in range(3000) for x, z in [(rng.random(), rng.random())]]
    out = evaluate.ale_curve(spark.createDataFrame(rows, "filename string, x double, z double, y double"), "x", "y", "z").orderBy("bin").collect()
    steps = [b["effect"] - a["effect"] for a, b in zip(out, out[1:])]
    assert all(abs(s - 2.0 * (b["upper"] - a["upper"])) < 0.02 for s, a, b in zip(steps, out, out[1:]))
    assert all(r["low"] <= r["effect"] <= r["high"] for r in out) and out[0]["r2"] > 0.95


def test_priors(spark):
    import math

    assert [round(math.exp(x), 6) for x in ar.log_prior([0.5, 2.0, None])] == [round(x, 6) for x in (2 / 3, 0.5 / 3, 0.5 / 3)]
    assert [round(math.exp(x), 6) for x in ar.log_prior([0.5, 2.0], 2.0)] == [round(x, 6) for x in (1 / 1.5, 0.5 / 1.5)]
    assert ar.loss_weights({"a": 9.0, "b": 0.01}, ["a", "b", "c"], "sqrt-inverse", 2.0) == [2.0, 0.5, 1.0]


def test_proper_nouns(spark):
    found = one(spark, tx.proper_nouns(F.lit("Acme  Corp met J. Doe.\nDear\nSir, \u00c9ric Martin and Big Co\u00e9 Ltd Inc.")))
    assert found == ["Acme  Corp", "Ltd Inc"]


def test_step_log(spark):
    lines = spark.createDataFrame([("2024-01-01 00:00:00 epoch=1 step=20 loss=0.5",), ("noise",)], "value string")
    assert ops.parse_steps(lines).first() == ("2024-01-01 00:00:00", 1, 20, 0.5)
