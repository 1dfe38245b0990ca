"""Source pools to training documents: one assembler with a specification per pool, and the tiers that combine them.

A pool's rows are tagged with the first check they fail in one pass; those that pass become document rows, go through the
common hygiene (own duplicates, file name collisions, duplicates of the canonical corpus) and a cap.  Every rejected row is
in the register with its reason.  Canonical documents need content_sha256 and text_sha256 (of the stored text).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.functions.text import clean, compose, estimate_tokens, strip
from curata.operators import enrich
from curata.operators.dedup import cross_pool, family_seam, ranked_cap
from curata.operators.enrich import Pool, source_matched_cap, title_leaks
from curata.operators.gates import seven_gates
from curata.operators.settle import settled
from curata.sources.readers import nested

# Columns of a document row, of its provenance and of a window row; labels that the insurance cap keeps first.
DOCUMENT = ("filename", "document_id", "content_sha256", "source_revision", "title", "doc_text", "doc_type", "subclass", "corpus_split", "token_estimate", "split")
PROVENANCE = ("source_corpus", "purpose", "label_source", "label_confidence", "example_weight", "lineage", "tier")
WINDOW = ("filename", "window_index", "n_windows", "text", "doc_type", "subclass", "split", "window_tokens")
TAIL_PRIORITY = ("property", "auto", "narrative", "pde", "carrier", "inpatient", "outpatient")


def require_columns(df: DataFrame, columns: Iterable[str], where: str) -> DataFrame:
    """``df`` if it has the columns; raises before anything is planned if not."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{where}: missing columns {missing}")
    return df


def documents_only(df: DataFrame) -> DataFrame:
    """Exactly the columns of a document row, in order."""
    return require_columns(df, DOCUMENT, "documents").select(*DOCUMENT)


def first_filled(df: DataFrame, keys: list[str], metadata: str = "metadata") -> Column:
    """The first value that is not empty: of each key its flat column, then its field in the metadata (JSON text or struct)."""
    values = []
    for k in keys:
        if k in df.columns:
            values.append(F.col(k).cast("string"))
        if metadata in df.columns:
            values.append(nested(F.col(metadata), k) if df.schema[metadata].dataType.typeName() == "string" else F.col(metadata).getField(k).cast("string") if k in df.schema[metadata].dataType.names else F.lit(None).cast("string"))
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(None).cast("string"))


def named(prefix: str, name: Column, text: Column) -> Column:
    """A row's id, or ``prefix:`` and the first 12 digits of its text's hash where it has none."""
    made = F.concat(F.lit(f"{prefix}:"), F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 12))
    return F.coalesce(F.nullif(name.cast("string"), F.lit("")), made)


def invented_other(raw: Column, label: Column, head: list[str]) -> Column:
    """Whether ``other`` was made up for a label that is neither other nor on the head."""
    token = F.regexp_replace(F.lower(strip(F.coalesce(raw, F.lit("")))), "[ -]", "_")
    return (label == "other") & ~token.isin("other", *head)


def records(df: DataFrame, *, doc_type: Column | str, subclass: Column, title: Column, source_corpus: str, source_revision: str, label_source: str, label_confidence: Column | float = 1.0, example_weight: float = 1.0, lineage: Column | str = "", tier: int = 1) -> DataFrame:
    """Document rows with provenance from (filename, doc_text): cleaned text and title, the source text's hash, train only; with text_sha256 and the frame's other columns."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    made = {"document_id": F.lit(""), "source_revision": F.lit(source_revision), "doc_type": lit(doc_type), "subclass": subclass, "corpus_split": F.lit(""), "split": F.lit("train"), "source_corpus": F.lit(source_corpus), "purpose": F.lit("train_only"), "label_source": F.lit(label_source), "label_confidence": lit(label_confidence).cast("double"), "example_weight": F.lit(float(example_weight)), "lineage": lit(lineage), "tier": F.lit(tier)}
    rows = df.withColumns(made | {"content_sha256": F.sha2(F.coalesce("doc_text", F.lit("")), 256), "title": F.coalesce(title, F.lit(""))})
    rows = compose(compose(rows, "doc_text"), "title")
    rows = rows.withColumn("doc_text", clean(F.coalesce("doc_text", F.lit("")))).withColumn("title", clean(F.col("title")))
    return rows.withColumns({"token_estimate": estimate_tokens(F.col("doc_text")), "text_sha256": F.sha2("doc_text", 256)})


@dataclass(frozen=True)
class Spec:
    """How a pool's rows become documents.

    ``normalize`` maps a raw label to its key (``other`` for what it does not know); ``fixed`` is one label for all rows,
    taken as it is with ``exact``.  ``other`` says what an invented ``other`` is: "reject" (never wanted, under
    ``unresolvable``), "silent" (wanted if the row says so) or "keep".  ``cap`` bounds new rows to a multiple of the class.
    """

    doc_type: str
    label_source: str
    lineage: str
    head: list[str]
    normalize: Callable[[Column], Column] | None = None
    labels: list[str] = field(default_factory=list)
    fixed: str | None = None
    exact: bool = False
    other: str = "keep"
    off_head: str = "subclass_not_on_head"
    title: str | None = None
    store_title: bool = False
    lineage_columns: tuple[str, ...] = ()
    class_column: str | None = None
    render: bool = False
    cap: float | None = None
    prefix: str = "row"
    corpus: str = ""
    revision: str = "local"


def _truthy_names(columns: tuple[str, ...]) -> Column:
    from curata.functions.text import truthy

    return F.concat_ws("+", *[F.when(truthy(F.col(c)), c) for c in columns])


def tagged(pool: DataFrame, spec: Spec) -> DataFrame:
    """The pool's rows with filename, doc_text, subclass, lineage and ``reason``: the first check that fails."""
    text = first_filled(pool, ["doc_text"], "input") if "doc_text" in pool.columns or "input" in pool.columns else F.lit(None).cast("string")
    name = F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("id", "filename", "document_id") if c in pool.columns], F.lit(None).cast("string"))
    raw = F.lit(spec.fixed) if spec.fixed is not None else first_filled(pool, spec.labels)
    label = raw if spec.exact else spec.normalize(raw) if spec.normalize else raw
    title = F.coalesce(F.col(spec.title), F.lit("")) if spec.title and spec.title in pool.columns else F.lit("")
    lineage = _truthy_names(require_columns(pool, spec.lineage_columns, "lineage") and spec.lineage_columns) if spec.lineage_columns else F.lit(spec.lineage)
    kind = F.coalesce(F.col(spec.class_column), F.lit("")) if spec.class_column else F.lit("")
    empty = strip(F.coalesce(F.col("doc_text"), F.lit(""))) == ""
    rows = pool.withColumns({"__raw": raw, "__label": label, "__title": title, "__lineage": lineage, "__kind": strip(kind), "__text": text, "__name": named(spec.prefix, name, text)})
    rows = rows.select(F.col("__name").alias("filename"), F.col("__text").alias("doc_text"), "__raw", F.col("__label").alias("subclass"), F.col("__title").alias("title"), F.col("__lineage").alias("lineage"), "__kind")
    sub = F.col("subclass")
    reason = F.when(F.col("lineage") == "", "no_lineage") if spec.lineage_columns else F.when(F.lit(False), "")
    reason = reason.when((F.col("__kind") != "") & (F.col("__kind") != spec.doc_type), f"not_{spec.doc_type}")
    reason = reason.when(empty, "needs_render" if spec.render else "missing_doc_text")
    if spec.fixed is None and not spec.normalize:
        reason = reason.when(F.coalesce(sub, F.lit("")) == "", "missing_subclass")
    if spec.other == "reject":
        reason = reason.when(F.coalesce(sub, F.lit("other")) == "other", "unresolvable_subclass")
    if spec.other == "silent":
        reason = reason.when(invented_other(F.col("__raw"), sub, spec.head), spec.off_head)
    reason = reason.when(~F.coalesce(sub.isin(spec.head), F.lit(False)), spec.off_head).when(title_leaks(F.col("title"), sub), "leak_title")
    return rows.withColumn("reason", reason)


def class_rows(canonical: DataFrame, doc_type: str) -> int:
    """Train rows of a class."""
    return canonical.where((F.col("doc_type") == doc_type) & (F.col("split") == "train")).count()


def _rejects(df: DataFrame, reason: str | None = None) -> DataFrame:
    return df.where("reason is not null").select("filename", (F.lit(reason) if reason else F.col("reason")).alias("reason"))


def assemble(pool: DataFrame, canonical: DataFrame, spec: Spec) -> Pool:
    """A pool's documents, its reject register (filename, reason) and the rows that need rendering first."""
    rows = tagged(pool, spec)
    kept = records(rows.where("reason is null"), doc_type=spec.doc_type, subclass=F.col("subclass"), title=F.col("title") if spec.store_title else F.lit(""), source_corpus=spec.corpus, source_revision=spec.revision, label_source=spec.label_source, lineage=F.col("lineage"))
    done = enrich.finalize(kept.select(*DOCUMENT, *PROVENANCE, "text_sha256"), canonical, settled)
    rejected = _rejects(rows.where("reason <> 'needs_render'")).unionByName(done.rejected)
    kept = done.kept
    if spec.cap is not None:
        cut = ranked_cap(kept, source_matched_cap(class_rows(canonical, spec.doc_type), spec.cap), [F.col("filename")], f"cap_{spec.doc_type}")
        kept, rejected = cut.where("reason is null").drop("reason"), rejected.unionByName(_rejects(cut))
    return Pool(kept, rejected, rows.where("reason = 'needs_render'").select("filename", "reason"))


def balanced(pool: Pool, canonical: DataFrame, spec: Spec, mult: float = 2.0) -> Pool:
    """A pool cut to the class's cap by water-fill over its labels, then to each label's authentic rows outside test."""
    budget = source_matched_cap(class_rows(canonical, spec.doc_type), mult)
    counts = enrich.counts_of(pool.kept)
    over = "cap_2x" if sum(counts.values()) > budget else "balance_cut"
    slots = enrich.water_fill(counts, budget)
    cut = enrich.cut_by_slots(pool.kept, slots, [-F.col("label_confidence"), F.col("filename")], over)
    rest = cut.where("reason is null").drop("reason")
    authentic = dict.fromkeys(counts, 0) | enrich.counts_of(canonical.where((F.col("doc_type") == spec.doc_type) & (F.col("split") != "test")))
    share = enrich.apply_mixture(rest, authentic, global_share=0.99, tiers=((0, 1),))
    return Pool(share.where("reason is null").drop("reason"), pool.rejected.unionByName(_rejects(cut)).unionByName(_rejects(share)), pool.needs_render)


def combine(pools: list[DataFrame]) -> Pool:
    """Adopted rows of pools in order of preference, and the later duplicates."""
    out = cross_pool(pools)
    return Pool(out.where("reason is null").drop("reason", "pool"), _rejects(out))


def insurance_cap(rows: DataFrame, canonical: DataFrame, doc_type: str = "insurance_claim", mult: float = 2.0, priority: tuple[str, ...] = TAIL_PRIORITY) -> Pool:
    """Rows within the class's cap, tail labels first."""
    out = enrich.tail_cap(rows, source_matched_cap(class_rows(canonical, doc_type), mult), list(priority), reason="cap_insurance_class")
    return Pool(out.where("reason is null").drop("reason"), _rejects(out))


def tier1(pools: dict[str, tuple[DataFrame, Spec]], canonical: DataFrame, capped: str = "insurance_claim", mult: float = 2.0, priority: tuple[str, ...] = TAIL_PRIORITY) -> tuple[Pool, DataFrame]:
    """Pools by name in order of their names, combined, one class capped; with counts (pool, kept, rejected, needs_render).

    Each pool's rows are a checkpoint, so that later pools do not assemble earlier ones again.
    """
    register, kept, stats = None, [], None
    for name in sorted(pools):
        done = Pool(*map(settled, assemble(pools[name][0], canonical, pools[name][1])))
        kept.append(done.kept)
        for part in (done.rejected, done.needs_render):
            mine = part.withColumn("pool", F.lit(name))
            register = mine if register is None else register.unionByName(mine)
        one = done.kept.agg(F.count("*").alias("kept")).crossJoin(done.rejected.agg(F.count("*").alias("rejected"))).crossJoin(done.needs_render.agg(F.count("*").alias("needs_render"))).withColumn("pool", F.lit(name))  # one row each
        stats = one if stats is None else stats.unionByName(one)
    both = Pool(*(settled(x) for x in combine(kept)[:2]))
    inside = insurance_cap(both.kept.where(F.col("doc_type") == capped), canonical, capped, mult, priority)
    register = register.unionByName(both.rejected.withColumn("pool", F.lit("cross_pool"))).unionByName(inside.rejected.withColumn("pool", F.lit("class_cap")))
    return Pool(both.kept.where(F.col("doc_type") != capped).unionByName(inside.kept), register), stats


def pseudo_documents(candidates: DataFrame, canonical: DataFrame, head: list[str], doc_type: str = "correspondence", max_fraction: float = 0.3, family: str | None = None, **gates: float) -> Pool:
    """Scored candidates to documents: gates, canonical duplicates, family seam, cap by confidence, balance by label."""
    need = ["filename", "doc_text", "doc_type_conf", "subclass_conf", "agreement", "pred_subclass"]
    marked = enrich.pseudo_labels(require_columns(candidates, need, "pseudo labels"), head, doc_type=doc_type, **gates)
    rejected = _rejects(marked)
    rows = records(marked.where("reason is null"), doc_type=doc_type, subclass=F.col("pred_subclass"), title=F.col("title"), source_corpus="pool", source_revision="pool", label_source="pseudo", label_confidence=F.col("label_confidence"), example_weight=0.5, lineage="pseudo", tier=2)
    rows = settled(rows)
    budget = round(max_fraction * class_rows(canonical, doc_type))
    steps = [lambda r: enrich.additive(r, canonical)]
    if family and family in candidates.columns and family in canonical.columns:
        steps.append(lambda r: family_seam(r, canonical, family))
    steps += [lambda r: ranked_cap(r, budget, [-F.col("label_confidence"), F.col("filename")], "pseudo_cap"), lambda r: enrich.balance(r, budget)]
    for step in steps:
        out = step(rows)
        rows, rejected = out.where("reason is null").drop("reason"), rejected.unionByName(_rejects(out))
    return Pool(rows.select(*DOCUMENT, *PROVENANCE), rejected)


def tier3(candidates: DataFrame, cards: DataFrame, canonical: DataFrame, key: str = "filename", weight: float = 0.5, global_share: float = 0.3, label_share: float = 0.5, known_entities: list[str] = ()) -> tuple[Pool, DataFrame]:
    """Synthetic candidates to documents: label card, seven gates, mixture caps; with the gates' audit records."""
    active = canonical.where("split <> 'test'")
    audit = seven_gates(candidates, cards, active.select("doc_text"), key, known_entities)
    passed = candidates.join(audit.where("passed").select(key), key, "left_semi")
    rows = records(passed, doc_type=F.col("parent_class"), subclass=F.col("subclass"), title=F.col("title"), source_corpus="synthetic", source_revision="card", label_source="synthetic_card", example_weight=weight, lineage="label_card+7gates", tier=3)
    cut = enrich.apply_mixture(rows, enrich.counts_of(active), global_share=global_share, label_share=label_share)
    return Pool(cut.where("reason is null").select(*DOCUMENT, *PROVENANCE), _rejects(cut)), audit


def enrichment_windows(docs: DataFrame, windows: str = "windows") -> DataFrame:
    """Window rows of documents that carry their windows' texts; raises if one has none: a text is never one unbounded window."""
    if not docs.where(F.coalesce(F.size(windows), F.lit(0)) <= 0).isEmpty():
        raise ValueError("documents without windows")
    rows = docs.select("filename", "doc_type", "subclass", F.size(windows).alias("n_windows"), F.posexplode(windows).alias("window_index", "text"))
    return rows.withColumns({"split": F.lit("train"), "window_tokens": estimate_tokens(F.col("text"))}).select(*WINDOW)


def held_out(labels: DataFrame, texts: DataFrame, canonical: DataFrame, normalize: Callable[[Column], Column], doc_type: str = "correspondence") -> DataFrame:
    """Labelled rows outside the canonical corpus, with ``reason``: the first check that a row fails.

    Text by file name; names of the corpus, other classes, empty texts and texts that another file of train or validation
    has are left out.  Rows with reason null are the fresh ones; counting reasons gives the skip counters.
    """
    text = texts.groupBy("filename").agg(F.max(F.struct(F.lit(True).alias("has"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("subject", F.lit("")).alias("subject"))).alias("__t"))
    rows = labels.select("filename", "expected", "expected_subclass").join(text, "filename", "left").withColumns({"doc_text": F.col("__t.text"), "title": F.coalesce("__t.subject", F.lit(""))})
    rows = compose(compose(rows, "doc_text"), "title").withColumns({"doc_text": clean(F.col("doc_text")), "title": clean(F.col("title"))})
    rows = rows.withColumns({"content_sha256": F.sha2("doc_text", 256), "subclass": normalize(F.col("expected_subclass")), "doc_type": F.col("expected")})
    names = canonical.select("filename").distinct().withColumn("__name", F.lit(True))
    pool = canonical.where(F.col("split").isin("train", "validation") & (F.coalesce("content_sha256", F.lit("")) != "")).select("content_sha256", "filename").distinct()
    j = rows.join(names, "filename", "left").join(pool.select("content_sha256").distinct().withColumn("__hash", F.lit(True)), "content_sha256", "left").join(pool.withColumn("__same", F.lit(True)), ["content_sha256", "filename"], "left")
    reason = (
        F.when(F.col("__t").isNull(), "no_text").when(F.col("__name"), "filename_overlap").when(~F.coalesce(F.col("expected") == doc_type, F.lit(False)), "label")
        .when(strip(F.col("doc_text")) == "", "empty").when(F.col("__hash") & F.col("__same").isNull(), "sha_overlap")
    )
    return j.withColumn("reason", reason).withColumns({"token_estimate": estimate_tokens(F.coalesce("doc_text", F.lit(""))), "split": F.lit("test"), "corpus_split": F.lit("test")}).select("filename", "content_sha256", "title", "doc_text", "doc_type", "subclass", "corpus_split", "token_estimate", "split", "reason")

