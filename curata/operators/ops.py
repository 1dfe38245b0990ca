"""Run analytics: log parsing, throughput, telemetry, spans, manifest upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curata.settings import SEED

#: Price of an hour of the reference GPU, for estimates.
USD_PER_HOUR = 0.80


def parse_steps(lines: DataFrame) -> DataFrame:
    """Step log lines ``... epoch=1 step=20 loss=0.5``: epoch, step and loss; other lines are left out."""
    def part(name: str, kind: str) -> Column:
        return F.regexp_extract("value", rf"\b{name}[=: ]+([-+0-9.eE]+)", 1).try_cast(kind)

    return lines.select(F.regexp_extract("value", r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d)", 1).alias("ts"), part("epoch", "int").alias("epoch"), part("step", "long").alias("step"), part("loss", "double").alias("loss")).where("step is not null")


# The printed forms of a training step, a test step and the test's metrics.
_STEP = r"step\s+(\d+)\s+loss\s+([\d.]+)\s+([\d.]+)\s+steps/s\s+([\d.]+)\s+samples/s\s+ETA\s+(.+?)\s*$"
_TEST = r"test\s+doc\s+(\d+)/(\d+)\s+doc_type_acc\s+([\d.]+)(?:\s+subclass_cond\s+([\d.]+))?\s*$"
_METRICS = r"test metrics:\s*(\{.*\})\s*$"


def parse_log(lines: DataFrame) -> DataFrame:
    """(event, numbers, eta, metrics) of the printed log lines: step, test_step and test_complete; other lines are left out.

    ``numbers`` maps the event's figures by name; ``metrics`` is the text of the test's metrics as JSON, null if it is none.
    """
    line = F.trim("value")

    def figures(pattern: str, names: list[str]) -> Column:
        each = [F.struct(F.lit(n).alias("key"), F.regexp_extract(line, pattern, k + 1).try_cast("double").alias("value")) for k, n in enumerate(names)]
        return F.map_from_entries(F.filter(F.array(*each), lambda e: e["value"].isNotNull()))

    metrics = F.regexp_replace(F.regexp_extract(line, _METRICS, 1), "'", '"')
    event = F.when(line.rlike(_STEP), "step").when(line.rlike(_TEST), "test_step").when(line.rlike(_METRICS), "test_complete")
    numbers = F.when(line.rlike(_STEP), figures(_STEP, ["step", "loss", "steps_per_sec", "samples_per_sec"])).when(line.rlike(_TEST), figures(_TEST, ["doc_done", "doc_planned", "doc_type_acc", "subclass_acc_conditional"]))
    eta = F.when(line.rlike(_STEP), F.regexp_extract(line, _STEP, 5))
    return lines.select(event.alias("event"), numbers.alias("numbers"), eta.alias("eta"), F.when(line.rlike(_METRICS), F.to_json(F.try_parse_json(metrics))).alias("metrics")).where("event is not null")


def deltas(events: DataFrame, run: str, ts: str, order: str) -> DataFrame:
    """Seconds since the run's previous event."""
    w = Window.partitionBy(run).orderBy(ts, order)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    return events.withColumn("seconds", (at - F.lag(at).over(w)) / 1e6)


def upper_median(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Per group the element at n div 2 of the sorted values.

    An approximate percentile bounds the band that holds it, so only the distinct values of the band are ordered.
    """
    kept = rows.where(F.col(value).isNotNull()).select(by, F.col(value).alias("v"))
    half = F.percentile_approx("v", F.array(F.lit(0.49), F.lit(0.51)), F.lit(1000))
    ends = kept.groupBy(by).agg(F.count("*").alias("n"), half.alias("q"), F.min("v").alias("least"), F.max("v").alias("most"))
    few = F.col("n") < 1000  # of so few rows all are the band
    ends = ends.select(by, "n", F.when(few, F.col("least")).otherwise(F.col("q")[0]).alias("lo"), F.when(few, F.col("most")).otherwise(F.col("q")[1]).alias("hi"))
    placed = kept.join(ends, by).where("v <= hi")
    tally = placed.groupBy(by, "n", F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("v")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(by).orderBy(F.col("v").asc_nulls_first()))
    ranked = tally.withColumn("upto", upto).withColumn("at", F.floor(F.col("n") / 2) + 1)
    return ranked.where("upto >= at and upto - c < at and v is not null").select(by, "n", F.col("v").alias("median"))


def ema(rows: DataFrame, run: str, order: list[str], value: str, weight: float = 0.2, parts: int = 64) -> DataFrame:
    """Per run the exponential moving average of a value in order; rows without a value count but do not change it.

    A run is cut into ``parts`` ranges of its first order column, each folded to what it does to an average before it (its
    factor and its own share); the ranges' results are folded in order, so no run is one array.
    """
    ends = rows.groupBy(run).agg(F.min(order[0]).alias("__lo"), F.max(order[0]).alias("__hi"))
    number = lambda c: (F.unix_micros(c.cast("timestamp")) if dict(rows.dtypes)[order[0]].startswith("timestamp") else c).cast("double")
    lo, hi = number(F.col("__lo")), number(F.col("__hi"))
    part = F.least(F.lit(parts - 1), F.floor(F.coalesce(F.try_divide((number(F.col(order[0])) - lo) * parts, hi - lo), F.lit(0.0)))).cast("int")
    cut = rows.join(ends, run).groupBy(run, part.alias("part")).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("v")))).alias("s"))
    nothing = F.struct(F.lit(None).cast("double").alias("first"), F.lit(1.0).alias("factor"), F.lit(0.0).alias("share"))

    def step(a: Column, x: Column) -> Column:
        v = x["v"]
        first = F.when(a["first"].isNull(), v).otherwise(a["first"] * (1 - weight) + v * weight)
        return F.when(v.isNull(), a).otherwise(F.struct(first.alias("first"), (a["factor"] * (1 - weight)).alias("factor"), (a["share"] * (1 - weight) + v * weight).alias("share")))

    folded = cut.select(run, "part", F.size("s").alias("n"), F.aggregate("s", nothing, step).alias("f"))
    listed = folded.groupBy(run).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("part", "f"))).alias("s"))  # at most ``parts`` items
    whole = F.aggregate("s", F.lit(None).cast("double"), lambda a, x: F.when(x["f"]["first"].isNull(), a).when(a.isNull(), x["f"]["first"]).otherwise(a * x["f"]["factor"] + x["f"]["share"]))
    return listed.select(run, F.col("n").cast("int").alias("n"), whole.alias("ema"))


def eta(rows: DataFrame, planned: int, done: str = "micro_done", average: str = "ema") -> DataFrame:
    """``rows`` with eta_seconds: the steps left of those planned at the average's pace; null without an average."""
    return rows.withColumn("eta_seconds", F.greatest(F.lit(0), F.lit(planned) - F.col(done)) * F.col(average))


def last_records(rows: DataFrame, order: str, n: int = 2) -> DataFrame:
    """The last n records: a bounded top-k."""
    return rows.orderBy(F.desc(order)).limit(n)


def event_rates(events: DataFrame, ts: str, kind: str, width: str = "1 day") -> DataFrame:
    """Events by tumbling window and kind; works on streams too."""
    return events.groupBy(F.window(ts, width).alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")


def telemetry(runs: DataFrame) -> DataFrame:
    """(run, seconds, n_docs) with seconds per document and the estimated cost."""
    return runs.withColumn("seconds_per_doc", F.try_divide(F.col("seconds"), F.col("n_docs"))).withColumn("usd", F.round(F.col("seconds") / 3600 * USD_PER_HOUR, 6))


def spans(docs: DataFrame, name: str, model: dict[str, str] | None = None) -> DataFrame:
    """(filename, span): a trace span per document as nested JSON: input, output, the model's identity, quality and failure.

    Columns that the documents lack are left out of the span.
    """
    def part(*names: str) -> Column:
        have = [n for n in names if n in docs.columns]
        return F.struct(*have) if have else F.struct(F.lit(None).cast("string").alias("none"))

    identity = F.struct(*[F.lit(v).alias(k) for k, v in sorted((model or {}).items())]) if model else F.struct(F.lit(None).cast("string").alias("model_id"))
    body = F.struct(F.lit(name).alias("name"), part("filename", "chars", "token_estimate", "n_windows").alias("input"), part("doc_type", "subclass", "confidence", "route", "agreement").alias("output"), identity.alias("metadata"), part("reason").alias("quality"), (F.col("route") != "fast_path").alias("failure"))
    return docs.select("filename", F.to_json(body).alias("span"))


def upsert(manifest: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Manifest rows replaced by or joined with new ones of the same keys."""
    return manifest.join(rows.select(*keys), keys, "left_anti").unionByName(rows)


def schedule(n_windows: int, batch: int, accumulate: int, epochs: int, warmup: float) -> dict[str, int]:
    """Micro steps, optimizer steps and warm-up steps of a training run."""
    micro = -(-n_windows // batch)
    steps = -(-micro // accumulate) * epochs
    return {"micro_steps": micro * epochs, "optimizer_steps": steps, "warmup_steps": int(steps * warmup), "seed": SEED}
