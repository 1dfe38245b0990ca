"""Katz backoff language model over words: training, tables and scoring.

The model is of order two and evaluated recursively for every token: a pair seen in training has its Good-Turing
discounted share of its context, any other backs off to the word with a weight that makes each context sum to one exactly,
and a word not seen in training shares what the discounted words leave.

Counting and scoring move the same, compact data.  Documents are read in blocks; a block lists its distinct words, and
later its distinct pairs, once, with their training counts, in one compressed array per bucket.  A bucket adds the counts
of all blocks and answers each block in the order of its list.  So what is shuffled is distinct pairs by block, not tokens,
and answers go back to blocks, where every token is looked up.  The tables of blocks, word answers and pair answers are
written to the shared folder, one row per block and bucket.

Words are dealt to buckets by hash.  Pairs are dealt by their first word, whose backoff weight needs all its pairs; a
first word with more than an even share of all tokens is spread over as many buckets as it has shares, and the few sums
of such words (at most two per bucket) are added on the driver.

Words are told apart by 64-bit hashes until they have numbers; pairs are exact.

Edge cases: a null or empty text is the end token alone; no training text leaves one unknown word of chance one, so every
text scores zero; repeated rows are counted and scored like others; null ids are in training; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.llm.shared import written
from curata.llm.textmap import chunks, lower_ascii, words_of

#: Counts up to this are discounted; text of a block.
K, BLOCK_BYTES = 5, 12 << 20

#: The end token, which no word equals, and the number of the begin context.
END, BEGIN = "\n", 0

_ROW = "bucket int, block long, data binary"
_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def pack(*arrays: np.ndarray) -> bytes:
    """Integer or float arrays as compressed byte planes; small numbers leave most planes empty."""
    import zstandard

    parts = []
    for a in arrays:
        wide = np.ascontiguousarray(a, "<f8" if a.dtype.kind == "f" else "<i8")
        planes = np.ascontiguousarray(wide.view(np.uint8).reshape(-1, 8).T).tobytes() if len(wide) else b""
        body = zstandard.ZstdCompressor(level=1).compress(planes)
        parts.append(np.array([len(body), a.dtype.kind == "f"], "<i8").tobytes() + body)
    return b"".join(parts)


def unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    out, at = [], 0
    while at < len(data):
        size, real = np.frombuffer(data, "<i8", 2, at)
        planes = zstandard.ZstdDecompressor().decompress(data[at + 16 : at + 16 + int(size)], max_output_size=1 << 31)
        a = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view("<f8" if real else "<i8").ravel() if planes else np.zeros(0, "<f8" if real else "<i8")
        out.append(a)
        at += 16 + int(size)
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    """A spread of integers over 0..2**31-1."""
    z = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)).astype(np.int64)


def discounts(n: np.ndarray) -> np.ndarray:
    """Katz's d_0..d_K from the counts of counts n_0..n_{K+1}; where Good-Turing fails, half a count is taken off."""
    d = np.ones(K + 1)
    common = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        good = (r + 1) * n[r + 1] / (n[r] * r) if n[r] else 0.0
        x = (good - common) / (1.0 - common) if common < 1.0 else 0.0
        d[r] = x if 0.0 < x < 1.0 else (r - 0.5) / r
    return d


def count_of_counts(c: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(c, K + 2), minlength=K + 3)[: K + 2]


class Words:
    """The word level: chances from counts."""

    def __init__(self, total: int, distinct: int, n: np.ndarray) -> None:
        self.total, self.distinct, self.d = total, distinct, discounts(n)
        left = float(sum((1 - self.d[r]) * r * n[r] for r in range(1, K + 1))) / max(1, total)
        self.unknown = max(left, 0.5 / (total + 0.5))
        self.scale = (1.0 - self.unknown) / (1.0 - left) if total else 0.0

    def chance(self, c: np.ndarray) -> np.ndarray:
        """P of words with these counts; a count of 0 is the unknown word."""
        d = self.d[np.minimum(c, K)] * (c <= K) + (c > K)
        return np.where(c > 0, d * c / max(1, self.total) * self.scale, self.unknown)


def blocks(docs: DataFrame, id_col: str, text_col: str, folds: int, fold: int, size: int) -> DataFrame:
    """A row per block: ids, held-out flags, tokens per document, the tokens' local numbers, and the words' hashes and training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        context = TaskContext.get()
        serial = (context.partitionId() if context else 0) << 24
        index: dict[str, int] = {}
        ids: list = []
        held: list[bool] = []
        tokens: list[np.ndarray] = []
        read = 0

        def row() -> pa.RecordBatch:
            nonlocal serial, index, ids, held, tokens, read
            flat = np.concatenate(tokens)
            lengths = np.array([len(t) for t in tokens])
            trained = np.bincount(flat[~np.repeat(held, lengths)], minlength=len(index))
            order = np.argsort(-np.bincount(flat, minlength=len(index)), kind="stable")  # frequent words get small numbers
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            words = np.array([xxh64_intdigest(w.encode()) for w in index], np.uint64)[order].view(np.int64)
            out = pa.RecordBatch.from_arrays([pa.array([serial], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([pack(np.array(held, np.int64), lengths, rank[flat])], pa.binary()), pa.array([pack(words, trained[order])], pa.binary())], names=["block", "ids", "tokens", "words"])
            serial, index, ids, held, tokens, read = serial + 1, {}, [], [], [], 0
            return out

        for batch in batches:
            for part in chunks(batch, 1):
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = words_of(lower_ascii(text or ""))
                    words.append(END)
                    number = index.setdefault
                    ids.append(doc)
                    held.append(doc is not None and zlib.crc32(str(doc).encode()) % folds == fold)
                    tokens.append(np.fromiter([number(w, len(index)) for w in words], np.int64, len(words)))
                    read += len(text or "")
                    if read >= size:
                        yield row()
        if ids:
            yield row()

    source = docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), docs[f"`{text_col}`"].cast("string").alias("text"))
    return source.mapInArrow(run, "block long, ids array<long>, tokens binary, words binary")


def _rows(buckets: list, block: list, data: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(block, pa.int64()), pa.array(data, pa.binary())], names=["bucket", "block", "data"])


def _parted(bucket: np.ndarray, n: int) -> list[np.ndarray]:
    """The places of each bucket's members, in order."""
    order = np.argsort(bucket, kind="stable")
    return np.split(order, np.searchsorted(bucket[order], np.arange(1, n)))


def word_table(table: DataFrame, n: int) -> DataFrame:
    """Word answers: for each block and bucket the numbers and total counts of the block's words; block -1 has totals."""

    def ask(batches):
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words, trained = unpack(data)
                parts = _parted(_mix(words) % n, n)
                yield _rows(list(range(n)), [block] * n, [pack(words[p], trained[p]) for p in parts])

    def answer(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        asked = [(b, *unpack(x)) for b, x in sorted(zip(group["block"].to_pylist(), group["data"].to_pylist(), strict=True))]
        words, place = np.unique(np.concatenate([a[1] for a in asked]), return_inverse=True)
        total = np.bincount(place, np.concatenate([a[2] for a in asked]), len(words)).astype(np.int64)
        rank = np.empty(len(words), np.int64)
        rank[np.lexsort((words, -total))] = np.arange(len(words))
        number = 1 + rank * n + bucket
        out, at = [], 0
        for _, w, _ in asked:
            p = place[at : at + len(w)]
            out.append(pack(number[p], total[p]))
            at += len(w)
        totals = np.concatenate([[total.sum(), (total > 0).sum()], count_of_counts(total)])
        return pa.Table.from_batches([_rows([bucket] * (len(asked) + 1), [a[0] for a in asked] + [-1], [*out, pack(totals)])])

    return table.select("block", "words").mapInArrow(ask, _ROW).groupBy("bucket").applyInArrow(answer, _ROW)


class _Block:
    """A block with its word answers, and its distinct pairs."""

    def __init__(self, row: dict, answers: dict[int, bytes], model: Words, n: int) -> None:
        self.held, self.lengths, tokens = unpack(row["tokens"])
        self.held, tokens = self.held.astype(bool), tokens.astype(np.int32)
        words, _ = unpack(row["words"])
        number, count = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        for bucket, p in enumerate(_parted(_mix(words) % n, n)):
            if len(p):
                number[p], count[p] = unpack(answers[bucket])
        self.count = count[tokens]
        number[count == 0] = 0  # unknown
        w = number[tokens]
        del tokens
        u = np.empty_like(w)
        u[1:] = w[:-1]
        first = np.cumsum(self.lengths) - self.lengths
        u[first] = BEGIN
        known = np.ones(len(w), bool)
        known[1:] = self.count[:-1] > 0
        known[first] = True  # whether the context was seen
        self.context = np.flatnonzero(known)
        context_count = np.empty_like(w)
        context_count[1:] = self.count[:-1]
        context_count[first] = -1  # the begin context: its count is the end token's
        # Distinct pairs by (context, word), with their training counts and the word's count.
        small, local = np.unique(np.concatenate([u[self.context], w[self.context]]), return_inverse=True)
        lu, lw = np.split(local, 2)
        del local
        _, at, pair = np.unique(lu * len(small) + lw, return_index=True, return_inverse=True)
        self.pair = pair.astype(np.int32)
        del lu, lw, pair
        at = self.context[at]
        train = ~np.repeat(self.held, self.lengths)[self.context]
        self.u, self.w, self.w_count = u[at], w[at], self.count[at]
        self.trained = np.bincount(self.pair[train], minlength=len(at))
        # A context's pairs are spread over as many buckets as it has even shares of all tokens.
        share = max(1, model.total // n)
        n_u = context_count[at]
        spread = np.where(n_u > share, -(-n_u // share), 1)
        spread[n_u < 0] = n if model.total else 1  # begin: at most every bucket
        self.hot = spread > 1
        self.bucket = (_mix(self.u) + _mix(self.w) % np.minimum(spread, n)) % n


def _answers(group: pa.Table, kind: str) -> dict[int, bytes]:
    return {b: x for b, k, x in zip(group["bucket"].to_pylist(), group["kind"].to_pylist(), group["data"].to_pylist(), strict=True) if k == kind}


_STATS = K + 1  # per context: r * n_r for r = 1..K, then the sum of larger counts


def _pair_stats(u: np.ndarray, c: np.ndarray, chance: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per distinct context: its number, the counts' sums by size, and the chance of its seen words."""
    contexts, at = np.unique(u, return_inverse=True)
    sums = np.zeros((len(contexts), _STATS), np.int64)
    np.add.at(sums, (at, np.clip(c, 1, K + 1) - 1), c)
    return contexts, sums, np.bincount(at, chance * (c > 0), len(contexts))


def pair_table(table: DataFrame, words: DataFrame, model: Words, n: int) -> DataFrame:
    """Pair answers: per block and bucket the total counts of the block's pairs and the sums of its contexts; block -1 has count-of-counts and the sums of spread contexts."""

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _rows([], [], [])
        row = {c: left[c][0].as_py() for c in ("block", "tokens", "words")}
        b = _Block(row, _answers(right, "word"), model, n)
        parts = _parted(b.bucket, n)
        return pa.Table.from_batches([_rows(list(range(n)), [row["block"]] * n, [pack(b.u[p], b.w[p], b.w_count[p], b.trained[p], b.hot[p].astype(np.int64)) for p in parts])])

    def answer(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        asked = [(b, unpack(x)) for b, x in sorted(zip(group["block"].to_pylist(), group["data"].to_pylist(), strict=True))]
        u, w, w_count, trained, hot = (np.concatenate([a[1][k] for a in asked]) for k in range(5))
        order = np.lexsort((w, u))
        new = np.ones(len(u), bool)
        new[1:] = (u[order][1:] != u[order][:-1]) | (w[order][1:] != w[order][:-1])
        place = np.empty(len(u), np.int64)
        place[order] = np.cumsum(new) - 1
        at = order[new]
        total = np.bincount(place, trained, len(at)).astype(np.int64)
        contexts, sums, seen = _pair_stats(u[at], total, model.chance(w_count[at]))
        out, lo = [], 0
        for _, a in asked:
            p = place[lo : lo + len(a[0])]
            k = np.searchsorted(contexts, np.unique(a[0]))
            out.append(pack(total[p], sums[k].ravel(), seen[k]))
            lo += len(a[0])
        spread = np.unique(u[hot > 0])
        k = np.searchsorted(contexts, spread)
        totals = pack(count_of_counts(total), spread, sums[k].ravel(), seen[k])
        return pa.Table.from_batches([_rows([bucket] * (len(asked) + 1), [a[0] for a in asked] + [-1], [*out, totals])])

    asked = table.groupBy("block").cogroup(words.where("block >= 0").groupBy("block")).applyInArrow(ask, _ROW)
    return asked.groupBy("bucket").applyInArrow(answer, _ROW)


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, fold: int = 1, size: int = BLOCK_BYTES) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10), learning from the other folds."""
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    table = written(blocks(docs, id_col, text_col, folds, fold, size), "blocks")
    words = written(word_table(table, n).withColumn("kind", F.lit("word")), "words")
    totals = [unpack(bytes(r["data"]))[0] for r in words.where("block < 0").select("data").collect()]  # a row per bucket
    sums = np.sum(totals, axis=0) if totals else np.zeros(K + 4, np.int64)
    model = Words(int(sums[0]), int(sums[1]), sums[2:])
    pairs = written(pair_table(table, words, model, n).withColumn("kind", F.lit("pair")), "pairs")
    counts, spread = np.zeros(K + 2, np.int64), {}
    for r in pairs.where("block < 0").select("data").collect():  # a row per bucket, with at most a few contexts each
        c, u, s, p = unpack(bytes(r["data"]))
        counts += c
        for context, x, y in zip(u.tolist(), s.reshape(-1, _STATS), p.tolist(), strict=True):
            old = spread.get(context, (0, 0.0))
            spread[context] = (old[0] + x, old[1] + y)
    d = discounts(counts)
    hot = np.array(sorted(spread), np.int64)
    hot_sums = np.array([spread[u][0] for u in hot.tolist()], np.int64).reshape(-1, _STATS)
    hot_seen = np.array([spread[u][1] for u in hot.tolist()])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [x.split()[0] for x in _OUT.split(", ")]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        if not left.num_rows:
            return pa.Table.from_arrays([pa.array([], k) for k in kinds], names=names)
        row = {c: left[c][0].as_py() for c in ("block", "ids", "tokens", "words")}
        b = _Block(row, _answers(right, "word"), model, n)
        answers = _answers(right, "pair")
        total = np.zeros(len(b.u), np.int64)
        stats, seen = np.zeros((len(b.u), _STATS), np.int64), np.zeros(len(b.u))
        for bucket, p in enumerate(_parted(b.bucket, n)):
            if len(p):
                total[p], s, q = unpack(answers[bucket])
                _, at = np.unique(b.u[p], return_inverse=True)
                stats[p], seen[p] = s.reshape(-1, _STATS)[at], q[at]
        if len(hot):
            k = np.minimum(np.searchsorted(hot, b.u), len(hot) - 1)
            own = hot[k] == b.u
            stats[own], seen[own] = hot_sums[k[own]], hot_seen[k[own]]
        mass = stats.sum(1).astype(float)
        left_over = stats[:, :K] @ (1.0 - d[1:])
        bare = (left_over == 0) & (mass > 0)  # nothing was discounted: half a count is left to back off
        mass, left_over = mass + 0.5 * bare, left_over + 0.5 * bare
        unit = np.maximum(mass, 1e-300)
        taken = np.where(total <= K, d[np.minimum(total, K)], 1.0) * total / unit
        word = model.chance(b.w_count)
        weight = np.where(mass > 0, left_over / unit / np.maximum(1.0 - seen, model.unknown), 1.0)
        pair = np.log10(np.where(total > 0, taken, weight * word))
        each = np.log10(model.chance(b.count))
        each[b.context] = pair[b.pair]
        first = np.cumsum(b.lengths) - b.lengths
        base = np.log10((b.count + 0.5) / (model.total + 0.5 * (model.distinct + 1)))
        add = lambda x: np.add.reduceat(x, first)
        columns = [row["ids"], b.held, b.lengths, add((b.count > 0).astype(np.int64)), np.full(len(first), model.total), add(base), add(each)]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    answers = words.where("block >= 0").unionByName(pairs.where("block >= 0"))
    return table.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, _OUT).withColumnRenamed("doc_id", id_col)
