"""Window votes to document decisions, the ordered guard chain, intake decisions and the hand-off."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.functions.arrays import argmax
from curata.functions.text import strip
from curata.settings import MAX_CHARS, MAX_TOKENS, Gate


def window_votes(windows: DataFrame, key: str = "filename") -> DataFrame:
    """Per document from (key, window_index, probs): the winning class, agreement, confidence, margin and runner-up.

    Votes tie to the class seen first; agreement is over all windows; the runner-up is the best other class of the mean
    probabilities, the highest place on ties.
    """
    voted = windows.withColumn("vote", argmax(F.col("probs")))
    tally = voted.groupBy(key, "vote").agg(F.count("*").alias("n"), F.min("window_index").alias("first"))
    winner = tally.groupBy(key).agg(F.max_by("vote", F.struct("n", -F.col("first"))).alias("winner"), F.max("n").alias("top"), F.sum("n").alias("n_windows"))
    means = voted.select(key, F.posexplode("probs").alias("class_id", "p")).groupBy(key, "class_id").agg(F.avg("p").alias("p"))
    joined = means.join(winner, key)
    other = F.col("class_id") != F.col("winner")
    out = joined.groupBy(key).agg(
        F.first("winner").alias("winner"),
        F.first("n_windows").alias("n_windows"),
        (F.first("top") / F.first("n_windows")).alias("agreement"),
        F.max(F.when(~other, F.col("p"))).alias("confidence"),
        F.max(F.when(other, F.col("p"))).alias("second"),
        F.max_by(F.when(other, F.col("class_id")), F.when(other, F.struct("p", "class_id"))).alias("runner_up"),
    )
    return out.withColumn("margin", F.col("confidence") - F.col("second")).drop("second")


def project(label: Column, head: Column) -> Column:
    """A label as a head can say it: itself, else other if the head has it, else null."""
    return F.when(label.isNull() | F.array_contains(head, label), label).when(F.array_contains(head, F.lit("other")), "other")


def guard_chain(docs: DataFrame, gate: Gate = Gate()) -> DataFrame:
    """``docs`` with reason and route: the first guard that fails, in order, else the conjunctive gate.

    Needs chars, n_windows, all_abstained, vocab_ok, head_excluded, subclass, projected, support, ood_flag, confidence,
    subclass_confidence, agreement and margin.
    """
    def low(c: str, least: float) -> Column:
        x = F.col(c)
        return F.isnan(x) | F.coalesce(x < least, F.lit(True))

    need = F.col("projected").isNotNull()
    fails = low("confidence", gate.doc_confidence) | (need & low("subclass_confidence", gate.subclass_confidence)) | low("agreement", gate.agreement) | low("margin", gate.margin)
    reason = (
        F.when(F.col("chars") > gate.max_chars, "oversize_chars")
        .when(F.col("n_windows") == 0, "no_windows")
        .when(F.col("all_abstained"), "all_abstained")
        .when(~F.col("vocab_ok"), "vocab_fail")
        .when(F.col("head_excluded"), "head_excluded")
        .when(F.col("subclass").isNotNull() & F.col("projected").isNull(), "subclass_unmapped")
        .when(F.col("projected") == "other", "catchall_label")
        .when(need & (F.col("support") < gate.min_support), "insufficient_support")
        .when(F.col("ood_flag"), "ood")
        .when(fails, "gate_fail")
        .otherwise("fast_path")
    )
    return docs.withColumn("reason", reason).withColumn("route", F.when(F.col("reason") == "fast_path", "fast_path").otherwise("llm"))


def bert_intake(text: Column, messy: Column, tokens: Column, flag: bool = True, available: bool = True, max_chars: int = MAX_CHARS, max_tokens: int = MAX_TOKENS) -> Column:
    """The reason of the small model's intake; it runs where the reason is within_bert_ctx.  Tokens name the overflow first."""
    if not flag:
        return F.lit("flag_off")
    model = F.lit("no_model") if not available else None
    chain = F.when(strip(text) == "", "empty").when(messy, "messy")
    if model is not None:
        return chain.otherwise(model)
    return chain.when(F.coalesce(tokens, F.lit(0)) > max_tokens, "oversize_tokens").when(F.length(text) > max_chars, "oversize_chars").otherwise("within_bert_ctx")


def llm_intake(text: Column, messy: Column, tokens: Column, status: Column, route: Column, doc_type: Column, eligible: Column, allowed: list[str], flag: bool = True, mode: str = "shadow") -> Column:
    """Whether the large model must run."""
    oversize = (F.length(text) > MAX_CHARS) | (F.coalesce(tokens, F.lit(0)) > MAX_TOKENS)
    chain = F.when(strip(text) == "", False).when(messy, True)
    if not flag:
        return chain.otherwise(oversize)
    ready = (status == "ok") & (route == "fast_path")
    chain = chain.when(~F.coalesce(ready, F.lit(False)), True)
    if mode != "skip":
        return chain.otherwise(True)
    return chain.otherwise(~(F.coalesce(eligible, F.lit(False)) & F.coalesce(doc_type.isin(allowed), F.lit(False))))


def context_fit(text: Column, tokens: Column | None = None, max_chars: int = MAX_CHARS, max_tokens: int = MAX_TOKENS) -> Column:
    """Whether a text fits the context: its characters, and its tokens where they are known."""
    fits = F.length(text) <= max_chars
    return fits if tokens is None else fits & F.coalesce(tokens <= max_tokens, F.lit(True))


def intake_gate(docs: DataFrame, mode: str, allowed: list[str], threshold: float = 0.9) -> DataFrame:
    """``docs`` with the seven checks, failure codes, verdict and recommended action.

    Needs method, context_fit, coverage, messy, n_guard_failures, confidence, triage_vocab_ok, section_map_ok, doc_type,
    sorter_type and reviewer_type.  A value that is missing fails its check; a coverage or confidence that is there but is no
    number makes the whole hand-off invalid, with F7 as its one failure.
    """
    def sure(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    doc, sorter, reviewer = F.col("doc_type"), F.col("sorter_type"), F.col("reviewer_type")
    coverage, conf = F.col("coverage").try_cast("double"), F.col("confidence").try_cast("double")
    broken = (F.col("coverage").isNotNull() & coverage.isNull()) | (F.col("confidence").isNotNull() & conf.isNull())
    checks = {
        "P1": sure((F.col("method") == "bert") & F.col("context_fit") & (coverage == 1.0)),
        "P2": sure(~F.coalesce(F.col("messy"), F.lit(False)) & (F.coalesce(F.col("n_guard_failures"), F.lit(0)) == 0)),
        "P3": sure(~F.isnan(conf) & (conf >= threshold)),
        "P4": sure(F.col("triage_vocab_ok")),
        "P5": sure(F.col("section_map_ok")),
        "P6": sure(doc.isin(allowed)) if mode == "skip" else sorter.isNotNull() & sorter.eqNullSafe(doc),
        "P7": reviewer.isNull() | reviewer.eqNullSafe(doc) | sure(reviewer == sorter),
    }
    out = docs.withColumns(checks | {"__broken": broken})
    p, invalid = {k: F.col(k) for k in checks}, F.col("__broken")
    codes = [("F1", ~p["P1"]), ("F2", ~p["P2"]), ("F3", ~p["P3"]), ("F4", ~p["P4"] | ~p["P5"]), ("F5", ~p["P6"]), ("F6", ~p["P7"])]
    good = ~invalid & p["P1"] & p["P2"] & p["P3"] & p["P4"] & p["P5"] & p["P6"] & p["P7"]
    done = {"skip": "accept_bert", "verify": "verify_with_sorter"}.get(mode, "force_llm_sorter")
    return out.withColumns({
        "failures": F.when(invalid, "F7").otherwise(F.array_join(F.array_compact(F.array(*[F.when(c, code) for code, c in codes])), ",")),
        "verdict": F.when(good, "PASS").otherwise("FAIL"),
        "recommended_action": F.when(invalid, "force_llm_sorter").when(~p["P7"], "escalate_reviewer").when(~p["P6"], "force_llm_sorter").when(good, done).otherwise("force_llm_sorter"),
        "eligible_for_sorter_skip": good,
    }).drop("__broken")


def handoff(docs: DataFrame, key: str = "filename", model: dict[str, str] | None = None) -> DataFrame:
    """(key, handoff): the nested hand-off object as JSON; a column that the documents lack has its default."""
    def have(name: str, default: object, kind: str) -> Column:
        return F.coalesce(F.col(name).cast(kind), F.lit(default).cast(kind)) if name in docs.columns else F.lit(default).cast(kind)

    chars, tokens = have("chars", 0, "int"), have("token_estimate", 0, "int")
    body = F.struct(
        F.lit(1).alias("schema_version"),
        have("method", "bert", "string").alias("method"),
        F.struct(F.col("route").alias("path"), "reason", F.lit(MAX_TOKENS).alias("bert_context_limit_tokens"), chars.alias("doc_chars"), tokens.alias("doc_token_estimate")).alias("routing"),
        F.struct(F.col("doc_type").alias("primary_doc_class"), F.col("subclass").alias("doc_subclass"), "confidence", have("gist", "", "string").alias("gist"), (F.col("keywords") if "keywords" in docs.columns else F.array().cast("array<string>")).alias("keywords")).alias("triage"),
        (F.col("sections") if "sections" in docs.columns else F.array().cast("array<string>")).alias("sections"),
        F.struct(have("messy", False, "boolean").alias("messy"), ((chars <= MAX_CHARS) & (tokens <= MAX_TOKENS)).alias("context_fit"), have("coverage", 0.0, "double").alias("coverage"), have("section_map_ok", True, "boolean").alias("section_map_ok"), have("triage_vocab_ok", False, "boolean").alias("triage_vocab_ok")).alias("quality"),
        F.struct(have("eligible_for_sorter_skip", False, "boolean").alias("eligible_for_sorter_skip"), have("recommended_action", "force_llm_sorter", "string").alias("recommended_action"), F.lit(Gate().doc_confidence).alias("bert_threshold")).alias("gate"),
        F.struct(F.lit((model or {}).get("model_id")).alias("model_id"), F.lit((model or {}).get("model_revision")).alias("model_revision"), have("n_windows", 0, "int").alias("intake_windows")).alias("provenance"),
    )
    return docs.select(key, F.to_json(body, {"ignoreNullFields": "false"}).alias("handoff"))


def section_map(sections: Column) -> Column:
    """Accepted sections of array<struct<name, begin, end>>: in order, not empty, not before the last accepted one's end."""
    def step(kept: Column, s: Column) -> Column:
        last = F.coalesce(F.get(F.transform(F.slice(kept, -1, 1), lambda x: x["end"]), F.lit(0)), F.lit(0))
        return F.when((s["begin"] >= last) & (s["end"] > s["begin"]), F.concat(kept, F.array(s))).otherwise(kept)

    return F.aggregate(sections, F.filter(sections, lambda s: F.lit(False)), step)
