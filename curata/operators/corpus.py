"""Documents, labels, cohorts, windows and stage verification."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.functions.text import clean, compose, estimate_tokens, fold, messy, strip, title_of
from curata.settings import MAX_CHARS, MAX_TOKENS


def file_order(df: DataFrame) -> Column:
    """The place of a row in its source: file and row where the source is Parquet files, else the order in which rows are read."""
    try:
        df.select("_metadata.file_path", "_metadata.row_index").schema
    except AnalysisException:
        return F.monotonically_increasing_id()
    return F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r"))


def verify_counts(docs: DataFrame, pins: dict[str, int], types: list[str], split: str = "split", doc_type: str = "doc_type") -> DataFrame:
    """``docs`` if its rows by split (and in all, under "") and its classes are as pinned; raises if not."""
    found = {r[split]: r["n"] for r in docs.groupBy(split).agg(F.count("*").alias("n")).collect()}  # a row per split
    found[""] = sum(found.values())
    wrong = {k: (v, found.get(k, 0)) for k, v in pins.items() if found.get(k, 0) != v}
    seen = {r[0] for r in docs.select(doc_type).distinct().limit(len(types) + 1).collect()}
    if wrong or seen != set(types):
        raise ValueError(f"pinned and found rows differ: {wrong}, classes {sorted(map(str, seen))}")
    return docs


def documents(labels: DataFrame, texts: DataFrame, pins: dict[str, int] | None = None, types: list[str] | None = None) -> DataFrame:
    """Documents from labels and texts by file name: the last text of a file counts; clean text, title, hash, estimate.

    Raises if a label has no text, or if rows and classes are not as pinned.
    """
    if pins is not None:
        verify_counts(labels, pins, types or [])
    ordered = texts.withColumn("__order", file_order(texts))
    last = ordered.groupBy("filename").agg(F.max_by(F.struct("doc_text", "metadata"), "__order").alias("t"))
    joined = labels.join(last, "filename", "left")
    if not joined.where("t.doc_text is null").isEmpty():
        raise ValueError("labels without text")
    meta = F.col("t.metadata")
    named = joined.withColumn("doc_text", F.col("t.doc_text")).withColumn("title", title_of(meta["subject"], meta["exhibit_description"])).withColumn("content_sha256", F.sha2("doc_text", 256)).drop("t")
    cleaned = compose(named, "doc_text").withColumn("doc_text", clean(F.col("doc_text")))
    return cleaned.withColumn("token_estimate", estimate_tokens(F.col("doc_text")))


def lookup(pairs: dict[str, str]) -> Callable[[Column], Column]:
    """A literal map as a lookup; null for other keys."""
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return lambda key: F.try_element_at(table, key)


def normalize_label(value: Column, keys: dict[str, str], prefixes: list[tuple[str, str]] = ()) -> Column:
    """Canonical key of a label surface: exact folded key, then the first prefix that fits, else other."""
    folded = fold(strip(F.coalesce(value, F.lit(""))))
    out = lookup(keys)(folded)
    begins = F.lit(None).cast("string")
    for prefix, key in reversed(list(prefixes)):
        begins = F.when(folded.startswith(prefix), key).otherwise(begins)
    return F.when(folded == "", "other").otherwise(F.coalesce(out, begins, F.lit("other")))


def class_weights(docs: DataFrame, label: str = "subclass") -> DataFrame:
    """Inverse-frequency weights total / (K * n) of the train rows' labels."""
    counts = docs.where("split = 'train'").groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    return counts.crossJoin(F.broadcast(total)).select(label, "n", (F.col("total") / (F.col("k") * F.col("n"))).alias("weight"))


def label_surface(docs: DataFrame) -> DataFrame:
    """Labels seen outside test, with their counts, by class."""
    return docs.where("split <> 'test'").groupBy("doc_type", "subclass").agg(F.count("*").alias("n"))


def window_cohort(tokens: Column, text: Column) -> Column:
    """single or multi: by the token estimate, else by a quarter of the characters, rounded up."""
    return F.when(F.coalesce(tokens, F.ceil(F.length(text) / 4.0)) <= MAX_TOKENS, "single").otherwise("multi")


def cohort_report(docs: DataFrame) -> DataFrame:
    """Per class: rows, short and long texts, single and multi windows, messy texts."""
    size = F.length("doc_text")
    window = window_cohort(F.col("token_estimate"), F.col("doc_text"))
    return docs.groupBy("doc_type").agg(F.count("*").alias("n"), F.count_if(size <= MAX_CHARS).alias("n_short"), F.count_if(size > MAX_CHARS).alias("n_long"), F.count_if(window == "single").alias("n_single"), F.count_if(window == "multi").alias("n_multi"), F.count_if(messy(F.col("doc_text"))).alias("n_messy"))


def word_windows(docs: DataFrame, size: int, overlap: int, keys: list[str]) -> DataFrame:
    """Windows of ``size`` words that share ``overlap`` with the one before: one row each.

    A text is cut into its windows before they become rows, so a row carries one window and not the text.
    """
    step = size - overlap
    words = F.regexp_extract_all("doc_text", F.lit(r"\S+"), F.lit(0))
    cut = docs.select(*keys, words.alias("words")).where("size(words) > 0")
    last = F.greatest(F.lit(0), F.ceil((F.size("words") - size) / float(step)).cast("int"))
    parts = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice("words", k * step + 1, size))
    out = cut.select(*keys, parts.alias("parts")).select(*keys, F.size("parts").alias("n_windows"), F.posexplode("parts").alias("window_index", "part"))
    return out.select(*keys, "window_index", "n_windows", F.array_join("part", " ").alias("window_text"), F.size("part").alias("window_tokens"))


#: Tokens that a tokenizer adds to a text, and tokens by which a window that is too long is cut again.
SPECIALS, TRIM = 2, 8


def decorated(title: str, body: str, version: int, filename: str = "", index: int = 0) -> str:
    """A window's text: version 1 puts the title before the body, version 2 tagged lines of file, title and place."""
    if version == 1:
        return f"{title}\n\n{body}" if title else body
    if version == 2:
        return f"[FILE_NAME] {filename}\n[TITLE] {title}\n[WINDOW_INDEX] {index}\n\n{body}"
    raise ValueError(f"unknown window version {version}")


def windows_of(tokenizer, title: str, text: str, budget: int, overlap: int, version: int = 1, filename: str = "") -> list[str]:
    """A document's window texts by a tokenizer (``encode(text) -> ids``, ``decode(ids) -> text``).

    A text that fits is one window, and so is one whose title or tags leave no more room than the overlap: it is over
    context, and never cut.  Otherwise bodies slide over the text; each is cut to what fits with its title, and the next
    begins ``overlap`` before the end that was truly covered, so no token is lost.
    """
    whole = decorated(title, text, version, filename, 0)
    ids = tokenizer.encode(whole if version == 1 else text)
    before = len(tokenizer.encode(title if version == 1 else decorated(title, "", version, filename, 0))) if title or version != 1 else 0
    room = budget - SPECIALS - before
    if len(ids) + (before if version != 1 else 0) <= budget - SPECIALS or room <= max(overlap, 0):
        return [whole]
    out: list[str] = []
    start = 0
    while True:
        part = ids[start : start + room]
        body = tokenizer.decode(part)
        covered = len(part)
        again = tokenizer.encode(body)
        if len(again) > room:  # what decoding gives may take more tokens
            body = tokenizer.decode(again[:room])
            covered = None
        window = decorated(title, body, version, filename, len(out))
        while len(tokenizer.encode(window)) + 2 * SPECIALS > budget and len(again := tokenizer.encode(body)) > TRIM:
            body = tokenizer.decode(again[:-TRIM])
            window = decorated(title, body, version, filename, len(out))
            covered = None
        out.append(window)
        end = start + (len(part) if covered is not None else max(1, min(len(part), len(tokenizer.encode(body)))))
        if end >= len(ids):
            return out
        start = max(end - overlap, start + 1)


def token_windows(docs: DataFrame, make_tokenizer: Callable[[], object], budget: int, overlap: int, version: int = 1, keys: tuple[str, ...] = ("filename",)) -> DataFrame:
    """``windows_of`` every document as rows: keys, window_index, n_windows, window_text, window_tokens (estimated).

    One Arrow pass over the documents; the tokenizer is built once per task.  The first key names the document in version 2.
    """
    if version not in (1, 2):
        raise ValueError(f"unknown window version {version}")
    source = docs.select(*keys, "title", "doc_text")
    names = [*keys, "window_index", "n_windows", "window_text"]

    def run(batches):
        tokenizer = make_tokenizer()
        for batch in batches:
            n = len(keys)
            for at in range(batch.num_rows):  # a batch of windows per document
                *key, title, text = (batch.column(c)[at].as_py() for c in range(n + 2))
                texts = windows_of(tokenizer, title or "", text or "", budget, overlap, version, str(key[0]))
                count = len(texts)
                columns = [pa.array([k] * count, batch.schema[i].type) for i, k in enumerate(key)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(range(count), pa.int32()), pa.array([count] * count, pa.int32()), pa.array(texts, pa.string())], names=names)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[:-2])
    out = source.mapInArrow(run, f"{schema}, window_index int, n_windows int, window_text string")
    return out.withColumn("window_tokens", estimate_tokens(F.col("window_text")))


def verify_stage(docs: DataFrame, windows: DataFrame, types: list[str], head: DataFrame, folder: str | None = None) -> DataFrame:
    """Problems of a staged corpus: (severity, code, n), only those that occur.

    ``folder`` names a column with the split of the folder a row was read from.  Rows with a source_corpus are enrichment:
    content that they share with another split is an error, content that only canonical rows share is a warning.
    """
    splits = ["train", "validation", "test"]
    none = docs.where(F.lit(False))
    by_split = docs.agg(*[F.count_if(F.col("split") == s).alias(s) for s in splits])
    missing = by_split.select(F.explode(F.array(*[F.col(s) for s in splits])).alias("n")).where("n = 0")
    stem = F.regexp_replace("filename", r"(?<=[^.])\.[^.]*$", "")
    named = (F.col("title") == F.col("filename")) | ((stem != "") & (F.col("title") == stem)) | ((fold(F.col("title")) != "") & (fold(F.col("title")) == fold(stem))) | (F.col("title").rlike(r"(?i)\.(?:htm|html|txt|pdf|docx?|xml)$") & ~F.col("title").contains(" "))
    added = F.coalesce(strip(F.col("source_corpus")) != "", F.lit(False)) if "source_corpus" in docs.columns else F.lit(False)
    shared = docs.where("content_sha256 <> ''").groupBy("content_sha256").agg(F.countDistinct("split").alias("n"), F.max(added).alias("added")).where("n > 1")
    checks = [
        ("error", "missing_split", missing),
        ("error", "split_mismatch", docs.where(F.col(folder) != F.col("split")) if folder else none),
        ("error", "bad_doc_type", docs.where(~F.col("doc_type").isin(types))),
        ("error", "bad_subclass", docs.where(F.col("doc_type").isin(types)).join(head.select("doc_type", "subclass").distinct(), ["doc_type", "subclass"], "left_anti")),
        ("error", "duplicate_filename", docs.groupBy("filename").count().where("count > 1")),
        ("error", "bad_split", docs.where(~F.col("split").isin(splits))),
        ("error", "test_windows", windows.join(docs.where("split = 'test'").select("filename"), "filename", "left_semi")),
        ("error", "title_from_filename", docs.where((F.trim("title") != "") & named)),
        ("error", "enrichment_straddles", shared.where("added")),
        ("warning", "content_straddles", shared.where("not added")),
    ]
    out = None
    for severity, code, rows in checks:
        one = rows.agg(F.count("*").alias("n")).select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), "n")
        out = one if out is None else out.unionByName(one)
    return out.where("n > 0")
