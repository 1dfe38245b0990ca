"""Quality classifier by Bradley-Terry pairwise ranking.

Every whole text becomes a vector of shares and counts (symbols, capitals, repeated windows, lines, token entropy and so
on).  Preference pairs join a text labelled good with one labelled bad; the weights minimise the logistic loss on the
difference of their vectors.  A text's rank score is the weighted sum; the threshold is the quantile of the training
scores that leaves as large a share below as is labelled bad, and a logistic curve maps it to ``ACCEPT``.

The fit uses every labelled row.  Their vectors are a written table.  Rows of the larger class are dealt to blocks by a hash
of the id, those of the smaller class too, several times if they are few, and in a block each row of the larger side is
paired with several of the other.  A Newton step adds up what the pairs of a task give, so the driver gets sums only.

Edge cases: a null or empty text has the zero vector's text features and gets a score like any other; labels that are
null, or rows without both classes, leave nothing to rank, and then every text scores ``ACCEPT``; ids that are null are
scored but not held out; repeated rows give repeated results; an empty table gives an empty result; other columns are
ignored (``scores``) or passed through untouched (``keep_good``).
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curata.llm.fertility import duplicate_lines, repeated_words
from curata.llm.shared import written
from curata.llm.textmap import map_texts, release, words_of
from curata.operators.ranks import exact_percentiles

#: Preference pairs, if each row of the larger class can have as many; partners of each such row at least; rows of the larger
#: class in a block and of the smaller one, about; accepted score.
PAIRS, EACH, MAJOR, MINOR, ACCEPT = 60_000, 4, 4096, 64, 0.7

_UPPER = slice(0x41, 0x5B)
_LOWER = slice(0x61, 0x7B)
_DIGIT = slice(0x30, 0x3A)
_MARKS = {"symbols": b"#*$%&|<>", "bars": b"|", "stops": b".,;:!?", "shouts": b"!", "brackets": b"(){}[]=_/\\@^~+"}


def features(text: str) -> list[float]:
    """The vector of one text."""
    raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256).astype(float)
    size = max(1.0, raw.sum())
    words = words_of(text)
    n = max(1, len(words))
    table: dict[str, int] = {}
    numbers = np.fromiter((table.setdefault(w, len(table)) for w in words), np.int64, len(words))
    counts = np.sort(np.bincount(numbers))[::-1] if len(words) else np.zeros(1)
    share = counts[counts > 0] / n
    entropy = float(-(share * np.log2(share)).sum())
    letters = max(1.0, raw[_UPPER].sum() + raw[_LOWER].sum() + raw[0x80:].sum())
    marks = {k: raw[np.frombuffer(v, np.uint8)].sum() / n for k, v in _MARKS.items()}
    lines = text.count("\n") + 1
    again = repeated_words(numbers) / n
    chars = raw[raw > 0] / size
    soft = [math.log(x + 0.003) for x in (*marks.values(), raw[_UPPER].sum() / letters, raw[_DIGIT].sum() / size, again, duplicate_lines(text) / lines, share[0] if len(share) else 0.0)]
    hard = [min(1.0, x) for x in (4 * marks["symbols"], 4 * marks["bars"], 4 * marks["shouts"], 2 * raw[_UPPER].sum() / letters, 2 * again)]
    return [*soft, *hard, entropy / math.log2(n + 1), math.log(n), math.log(n / lines), letters / n / 10, float(-(chars * np.log2(chars)).sum()) if len(chars) else 0.0, math.log(size / n), len(table) / n]


WIDTH = len(features(""))


class Ranker:
    """Weights of the rank score and the curve to (0, 1)."""

    def __init__(self, weights: np.ndarray, middle: float, width: float) -> None:
        self.weights, self.middle, self.width = weights, middle, width

    def scores(self, rows: np.ndarray) -> np.ndarray:
        z = (rows @ self.weights - self.middle) / self.width + math.log(ACCEPT / (1 - ACCEPT))
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30.0, 30.0)))


def paired(good: np.ndarray, bad: np.ndarray, each: int) -> np.ndarray:
    """Differences good - bad: each row of the larger side with ``each`` rows of the other, or with all of them."""
    n, m = max(len(good), len(bad)), min(len(good), len(bad))
    few = min(each, m)
    at = np.repeat(np.arange(n), few)
    other = (at + np.tile(np.arange(few), n)) % max(1, m)
    return good[at] - bad[other] if len(good) >= len(bad) else good[other] - bad[at]


def partners(n_good: int, n_bad: int) -> int:
    return max(EACH, -(-PAIRS // max(1, n_good, n_bad)))


def _sums(diff: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Number of pairs, gradient and Hessian of the loss, in one array."""
    p = 1.0 / (1.0 + np.exp(np.clip(diff @ w, -30.0, 30.0)))  # chance that the pair is ranked wrongly
    return np.concatenate([[len(diff)], -diff.T @ p, ((diff * (p * (1 - p))[:, None]).T @ diff).ravel()])


def _newton(sums: Callable[[np.ndarray], np.ndarray], penalty: float) -> np.ndarray:
    """The weights at which the loss that ``sums`` measures is least."""
    w = np.zeros(WIDTH)
    for _ in range(25):
        s = sums(w)
        gradient = penalty * w + s[1 : 1 + WIDTH] / s[0]
        hessian = s[1 + WIDTH :].reshape(WIDTH, WIDTH) / s[0] + penalty * np.eye(WIDTH)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(rows: np.ndarray, labels: np.ndarray, penalty: float = 1e-3) -> Ranker:
    """Bradley-Terry weights by Newton steps on the logistic loss of pair differences, of rows in memory."""
    good, bad = rows[labels == 1], rows[labels == 0]
    if not len(good) or not len(bad):
        return Ranker(np.zeros(rows.shape[1]), 0.0, 1.0)
    scale = rows.std(0)
    scale[scale < 1e-9] = 1.0
    diff = paired(good, bad, partners(len(good), len(bad))) / scale
    w = _newton(lambda w: _sums(diff, w), penalty) / scale
    ranks = np.sort(rows @ w)
    cut = len(bad)  # as many scores below the threshold as there are bad labels
    return Ranker(w, float((ranks[cut - 1] + ranks[cut]) / 2), max(1e-6, float(ranks.std()) / 4))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), float).reshape(-1, WIDTH)


def _total(df: DataFrame, work: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray | None:
    """The sum of the arrays that ``work`` makes of the batches; each task sends one."""

    def run(batches):
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                made = work(batch.slice(at, 8192))
                total = made if total is None else total + made
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    parts = [np.frombuffer(r["sums"], float) for r in df.mapInArrow(run, "sums binary").collect()]
    return np.sum(parts, axis=0) if parts else None


def fit_table(rows: DataFrame, penalty: float = 1e-3) -> Ranker:
    """``fit`` of a table (h, x, label) of any size: hash of the id, vector as bytes."""
    base = np.array(features("A text.\nAnother line."))  # sums about a vector of the kind keep the digits of small spreads

    def moments(part: pa.RecordBatch) -> np.ndarray:
        x, y = _matrix(part.column(0)) - base, part.column(1).to_numpy()
        return np.concatenate([[len(y), (y == 0).sum()], x.sum(0), (x * x).sum(0)])

    total = _total(rows.select("x", "label"), moments)
    n, n_bad = (int(total[0]), int(total[1])) if total is not None else (0, 0)
    n_good = n - n_bad
    if not n_good or not n_bad:
        return Ranker(np.zeros(WIDTH), 0.0, 1.0)
    scale = np.sqrt(np.maximum(0.0, total[2 + WIDTH :] / n - (total[2 : 2 + WIDTH] / n) ** 2))
    scale[scale < 1e-9] = 1.0
    each, minor = partners(n_good, n_bad), int(n_good < n_bad)
    blocks = max(1, max(n_good, n_bad) // MAJOR)
    copies = min(blocks, -(-blocks * MINOR // min(n_good, n_bad)))
    times = F.when(F.col("label") == minor, copies).otherwise(1)
    dealt = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), times - 1))).withColumn("block", F.pmod(F.pmod("h", F.lit(blocks)) + F.col("copy"), F.lit(blocks)))

    def pair(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("h").to_numpy(), kind="stable")
        x, y = _matrix(table.column("x"))[order] / scale, table.column("label").to_numpy()[order]
        return pa.table({"d": pa.array([d.tobytes() for d in paired(x[y == 1], x[y == 0], each)], pa.binary())})

    pairs = written(dealt.groupBy("block").applyInArrow(pair, "d binary"), "preferences")
    w = _newton(lambda w: _total(pairs, lambda part: _sums(_matrix(part.column(0)), w)), penalty) / scale

    def rank(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_matrix(batch.column(0)) @ w)], names=["r"])

    ranks = written(rows.select("x").mapInArrow(rank, "r double"), "ranks")
    # Between the ranks n_bad - 1 and n_bad: as many scores below the threshold as there are bad labels.
    (middle,) = exact_percentiles(ranks, F.col("r"), [(n_bad - 0.5) / (n - 1)])
    return Ranker(w, middle, max(1e-6, (ranks.agg(F.stddev_pop("r").alias("s")).first()["s"] or 0.0) / 4))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Ranker:
    """Ranker from all labelled rows whose crc32(id as text) mod 4 is not 2."""
    key = F.col(f"`{id_col}`")
    learns = F.col("id").isNotNull() & (F.crc32(F.col("id").cast("string").cast("binary")) % 4 != 2)
    usable = labels.select(key.alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).where(learns & F.col("label").isin(0, 1))
    known = usable.groupBy("id").agg(F.max("label").alias("label"))
    texts = docs.select(key.alias("id"), F.col(f"`{text_col}`").alias("text")).where(learns)

    def make():
        release()
        return lambda texts: [[np.array(features(t)).tobytes() for t in texts]]

    # Vectors meet their labels, not texts, which are ten times as long; neither side is small enough to go to every worker.
    vectors = map_texts(texts, "text", ["id"], [T.StructField("x", T.BinaryType())], make)
    found = vectors.join(known.hint("merge"), "id").groupBy("id").agg(F.min("x").alias("x"), F.first("label").alias("label"))
    return fit_table(written(found.select(F.xxhash64("id").alias("h"), "x", "label"), "labelled"))


def _scored(df: DataFrame, text_col: str, keep: list[str], ranker: Ranker) -> DataFrame:
    def make():
        release()
        return lambda texts: [ranker.scores(np.array([features(t) for t in texts]).reshape(-1, WIDTH))]

    return map_texts(df, text_col, keep, [T.StructField("score", T.DoubleType())], make)


def scores(docs: DataFrame, ranker: Ranker, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, score, predicted (1 from ``ACCEPT``)."""
    out = _scored(docs, text_col, [id_col], ranker)
    held = F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return out.select(id_col, held.alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, ranker: Ranker, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``ACCEPT`` or more, with their own columns."""
    inside = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs[f"`{text_col}`"].alias("text"))
    return _scored(inside, "text", ["row"], ranker).where(F.col("score") >= ACCEPT).select("row.*")
