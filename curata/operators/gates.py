"""The seven gates of synthetic candidates against label cards: a record per candidate with the first gate it fails.

Cards are a dimension (parent_class, subclass, positive_cues, negative_cues, title_patterns, required_structure,
prohibited_facts: arrays of strings), joined to the candidates by class and subclass.  The gates that look at one row are
columns of one pass; those that look at a corpus are joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.functions.arrays import finite
from curata.functions.text import cue_present, strip
from curata.operators.enrich import entity_hits, like_prior, ngram_hits

# Gates in order.
GATES = ("schema", "lexical_contamination", "rule_cues", "entity_overlap", "independent_adjudication", "embedding_diversity", "model_disagreement")

#: Fields of a label card.
CARD = "parent_class string, subclass string, positive_cues array<string>, negative_cues array<string>, title_patterns array<string>, required_structure array<string>, prohibited_facts array<string>"


def _list(name: str) -> Column:
    return F.coalesce(F.col(f"__card.{name}"), F.array().cast("array<string>"))


def _has(text: Column, part: Column) -> Column:
    return F.contains(F.lower(text), F.lower(part))


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def schema_reason() -> Column:
    """Text, class, subclass and title as the card has them."""
    return (
        F.when(strip(_text("doc_text")) == "", "empty_doc_text")
        .when(F.col("__card").isNull(), "no_label_card")
        .when(strip(_text("title")) == "", "empty_title")
    )


def cue_reason() -> Column:
    """One of the positive cues, none of the negative ones; a card without cues passes."""
    text = _text("doc_text")
    found = F.exists(_list("positive_cues"), lambda c: cue_present(text, c))
    return F.when((F.size(_list("positive_cues")) > 0) & ~found, "missing_positive_cue").when(F.exists(_list("negative_cues"), lambda c: cue_present(text, c)), "negative_cue_present")


def adjudication_reason() -> Column:
    """An adjudicator's label, where there is one, must name the card's; else the card's own rules on title and text hold.

    ``adjudication`` is a struct (parent_class, subclass) that is null where nobody judged; an empty label is no agreement.
    """
    verdict, present = F.col("adjudication"), F.col("adjudication").isNotNull()
    parent, label = (strip(F.coalesce(verdict[c], F.lit(""))) for c in ("parent_class", "subclass"))
    judged = F.when(label == "", "adjudication_empty").when((parent != "") & (parent != F.col("parent_class")) | (label != F.col("subclass")), "adjudication_mismatch")
    full = lambda name: F.filter(_list(name), lambda p: p != "")
    title, text = _text("title"), _text("doc_text")
    by_card = (
        F.when((F.size(_list("title_patterns")) > 0) & ~F.exists(full("title_patterns"), lambda p: _has(title, p)), "title_pattern_miss")
        .when(F.exists(full("required_structure"), lambda p: ~_has(text, p)), "required_structure_miss")
        .when(F.exists(full("prohibited_facts"), lambda p: _has(text, p)), "prohibited_fact_present")
    )
    return F.when(present, judged).otherwise(by_card)


def model_reason(probability: float) -> Column:
    """The scorer's class and subclass, and its probability where it is given; what is not a number fails."""
    p = F.col("model_probability")
    return (
        F.when(F.col("model_doc_type").isNull() | F.col("model_subclass").isNull(), "missing_model_prediction")
        .when((F.col("model_doc_type") != F.col("parent_class")) | (F.col("model_subclass") != F.col("subclass")), "model_label_mismatch")
        .when(p.isNotNull() & ~F.coalesce(finite(p) >= probability, F.lit(False)), "model_prob_below_floor")
    )


def seven_gates(candidates: DataFrame, cards: DataFrame, corpus: DataFrame, key: str, known_entities: list[str] = (), pool: DataFrame | None = None, n_gram: int = 5, max_similarity: float = 0.85, probability: float = 0.5) -> DataFrame:
    """The audit record of each candidate: key, card, passed, first_failure, reason (null where all gates pass).

    Candidates have parent_class, subclass, title, doc_text, adjudication, model_doc_type, model_subclass and
    model_probability; ``corpus`` and ``pool`` have doc_text.  ``pool`` (by default the corpus) is what candidates must
    differ from.  The joins see only candidates that pass the gates of one row, so the costly ones see few.
    """
    shaped = cards.groupBy("parent_class", "subclass").agg(F.first(F.struct("positive_cues", "negative_cues", "title_patterns", "required_structure", "prohibited_facts")).alias("__card"))
    rows = candidates.join(F.broadcast(shaped), ["parent_class", "subclass"], "left")
    known = F.array(*[F.lit(e.strip().lower()) for e in known_entities if e.strip()]).cast("array<string>")
    low = F.lower(_text("doc_text"))
    rows = rows.withColumns({"__schema": schema_reason(), "__cue": cue_reason(), "__known": F.exists(known, lambda e: F.contains(low, e)), "__verdict": adjudication_reason(), "__model": model_reason(probability)})
    alive = rows.where("__schema is null")
    cued = alive.where("__cue is null")
    last = cued.where("not __known and __verdict is null")
    dirty = ngram_hits(alive.select(key, "doc_text"), corpus, key, "doc_text", "doc_text", n_gram).select(key, F.lit(True).alias("__dirty"))
    named = entity_hits(cued.select(key, "doc_text"), corpus, key, "doc_text", "doc_text").select(key, F.lit(True).alias("__named"))
    near = like_prior(last.select(key, "doc_text"), corpus if pool is None else pool, key, "doc_text", "doc_text", max_similarity).select(key, F.lit(True).alias("__near"))
    j = rows.join(dirty, key, "left").join(named, key, "left").join(near, key, "left")
    steps = (
        F.col("__schema"), F.when(F.col("__dirty"), "ngram_overlap"), F.col("__cue"), F.when(F.col("__known"), "known_entity").when(F.col("__named"), "shared_span"),
        F.col("__verdict"), F.when(F.col("__near"), "near_duplicate"), F.col("__model"),
    )
    gate, reason = F.lit(None).cast("string"), F.coalesce(*steps)
    for name, step in reversed(list(zip(GATES, steps, strict=True))):
        gate = F.when(step.isNotNull(), name).otherwise(gate)
    return j.select(key, F.concat_ws("/", "parent_class", "subclass").alias("card"), reason.isNull().alias("passed"), gate.alias("first_failure"), reason.alias("reason"))
