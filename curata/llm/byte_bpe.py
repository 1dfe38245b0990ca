"""Byte-level BPE encoding and decoding with ranks.

Texts are cut into pre-tokens by the pattern of the rank file.  The distinct pre-tokens of a block of documents are
encoded once, by Spark's higher-order functions: a word is the array of its bytes' ids with the ranks of neighbours between
them, and a fold over its length merges, at each step, the first adjacent pair of the lowest rank, until no pair has a rank.
Decoding concatenates the binary pieces of the ids.

Ranks come from one literal: the rank of every pair of ids whose pieces together are a piece, which is that piece's id.
It is an array of small maps, a pair being in the map that its key's remainder names, because Spark searches a map from
its first key on.  The literal is the value of a scalar subquery over a local row, so tasks get it as flat bytes; its size
is that of the vocabulary.  A piece that the merges of its own bytes do not reach is taken whole, as in the reference
library, from a literal list that is empty for most vocabularies.

The fold costs the square of a word's length, so words of over ``LONG`` bytes are first cut between neighbouring bytes
that no piece of the vocabulary holds side by side, where no merge can reach across.

A block holds the documents of one task up to ``BLOCK_BYTES``; the words that no earlier block of the task had, the order of
words in each document, and the documents' ids form one row.  A task keeps its words, up to ``HELD``, and begins anew beyond
that.  There is no shuffle: nothing of one document leaves its task.

Edge cases: a null or empty text has no ids, and both digests are those of the empty string; a text of one long word is
encoded whole; repeated rows give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.llm.textmap import chunks, held
from curata.llm.word_bpe import _ODD

#: Text of a block, words that a task keeps, and bytes of a word that is first cut.
BLOCK_BYTES, HELD, LONG = 6 << 20, 650_000, 64

#: Small maps of the rank map (a prime, so remainders of keys spread), rank of no pair, and what tells ids from ranks.
MAPS, NONE, ID = 65_521, 1 << 29, 1 << 30

# The usual pattern, and the same for texts of plain characters, by the faster module.
_USUAL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_FAST = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by piece of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Splitter:
    """Pre-tokens of a text."""

    def __init__(self, pattern: str, ranks: dict[bytes, int], whole: dict[bytes, int]) -> None:
        exact = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.exact, self.plain = regex.compile(exact), pattern == _USUAL
        self.pairs = {p[k : k + 2] for p in ranks for k in range(len(p) - 1)}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.byte_pairs = np.array([[ranks.get(bytes([a, b]), NONE) for b in range(256)] for a in range(256)], np.int32)
        self.unreached = whole

    def split(self, text: str) -> list[str]:
        """The pre-tokens; long ones cut where no piece can reach across."""
        words = (_FAST if self.plain and not _ODD.search(text) else self.exact).findall(text)
        if len(text) > LONG and max(map(len, words)) > LONG // 4:
            return [p for w in words for p in self._cut(w)]
        return words

    def starts(self, raw: list[bytes]) -> pa.ListArray:
        """The state of each word before any merge, as ``merge_bytes`` takes it."""
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.concatenate([[0], np.cumsum(lengths)])
        text = np.frombuffer(b"".join(raw), np.uint8)
        at = 2 * np.arange(len(text)) + np.repeat(np.arange(len(raw)), lengths)
        flat = np.full(2 * len(text) + len(raw), NONE, np.int32)
        flat[at + 1] = self.byte_ids[text] + ID
        inner = np.ones(len(text), bool)
        inner[ends[:-1]] = False
        k = np.flatnonzero(inner)
        flat[at[k]] = self.byte_pairs[text[k - 1], text[k]]
        return pa.ListArray.from_arrays(pa.array((2 * ends + np.arange(len(raw) + 1)).astype(np.int32)), pa.array(flat))

    def _cut(self, word: str) -> list:
        if len(word) <= LONG // 4 or len(raw := word.encode()) <= LONG:
            return [word]
        at = [0, *(k for k in range(1, len(raw)) if raw[k - 1 : k + 1] not in self.pairs), len(raw)]
        return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]


#: Pair keys: the left id times this, plus the right id.
_LEFT = 1 << 21


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """Rank by pair key of all pairs of pieces that together are a piece."""
    return {ranks[p[:k]] * _LEFT + ranks[p[k:]]: rank for p, rank in ranks.items() for k in range(1, len(p)) if p[:k] in ranks and p[k:] in ranks}


def unreached(ranks: dict[bytes, int], pairs: dict[int, int]) -> dict[bytes, int]:
    """Pieces that merging their own bytes does not give."""
    out = {}
    for piece, rank in ranks.items():
        ids = [ranks[piece[k : k + 1]] for k in range(len(piece))]
        while len(ids) > 1:
            found, at = min((pairs.get(a * _LEFT + b, NONE), k) for k, (a, b) in enumerate(zip(ids, ids[1:], strict=False)))
            if found == NONE:
                break
            ids[at : at + 2] = [found]
        if ids != [rank]:
            out[piece] = rank
    return out


def literals(spark: SparkSession, ranks: dict[bytes, int]) -> tuple[Column, Column]:
    """The rank map (array of maps) and the pieces by id (array of binary), each a scalar subquery over one local row."""
    maps: list[list[tuple[int, int]]] = [[] for _ in range(MAPS)]
    for key, rank in pair_ranks(ranks).items():
        maps[key % MAPS].append((key, rank))
    by_id = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        by_id[rank] = piece
    row = {"maps": pa.array([maps], pa.list_(pa.map_(pa.int64(), pa.int32()))), "pieces": pa.array([by_id], pa.list_(pa.binary()))}
    table = spark.createDataFrame(pa.table(row))
    return table.select("maps").scalar(), table.select("pieces").scalar()


def merge_bytes(start: Column, maps: Column) -> Column:
    """Ids of one word: array<int>.

    The state is an array of ranks and ids in turn: a rank of no pair, id, rank of the pair with the next, next id, and so on
    to a rank of no pair; ids are raised by ``ID``, so the array's minimum is the lowest rank.  A step merges there: the
    pair and the ranks on both sides give way to one id and its ranks.  What a step needs twice is the variable of a fold
    over one element.  The place is found by a lambda: ``array_position`` leaves its loop by an exception, which took most
    of the time.
    """

    def let(value: Column, body) -> Column:
        return F.aggregate(F.array(value), F.lit(None).cast("array<int>"), lambda _, x: body(x))

    def rank(a: Column, b: Column) -> Column:
        key = (a - ID).cast("long") * _LEFT + (b - ID)
        return F.coalesce(F.try_element_at(F.get(maps, (key % MAPS).cast("int")), key), F.lit(NONE))

    def step(s: Column, _: Column) -> Column:
        def merged(m: Column, at: Column) -> Column:  # at: place of the rank, from 1
            left = F.when(at > 3, rank(F.get(s, at - 4), m + ID)).otherwise(F.lit(NONE))
            right = F.when(at + 2 < F.size(s), rank(m + ID, F.get(s, at + 2))).otherwise(F.lit(NONE))
            return F.concat(F.slice(s, F.lit(1), at - 3), F.array(left, m + ID, right), F.slice(s, at + 3, F.size(s)))

        first = lambda m: F.array_min(F.transform(s, lambda x, k: F.when(x == m, k + 1)))
        return let(F.array_min(s), lambda m: F.when(m >= NONE, s).otherwise(let(first(m), lambda at: merged(m, at))))

    last = F.aggregate(F.sequence(F.lit(3), F.shiftright(F.size(start), 1) + 1), start, step)
    return F.when(F.size(start) < 4, F.array(F.get(start, F.lit(1)) - ID)).otherwise(F.transform(F.filter(last, lambda x: x >= ID), lambda x: x - ID))


def decode_ids(ids: Column, pieces: Column) -> Column:
    """The bytes of an array of ids: the pieces' binaries, concatenated."""
    return F.aggregate(ids, F.lit(bytearray(b"")), lambda out, i: F.concat(out, F.get(pieces, i)))


class _Index(dict):
    """Word to number, in order of first sight."""

    def __missing__(self, word) -> int:
        n = self[word] = len(self)
        return n


def _blocks(pattern: str, path: str, whole_pieces: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = held(("split", path, pattern), lambda: Splitter(pattern, read_ranks(path), whole_pieces))
        index, base = _Index(), 0
        ids: list = []
        orders: list[np.ndarray] = []
        size = 0

        def row() -> pa.RecordBatch:
            nonlocal index, base, ids, orders, size
            raw = [w if isinstance(w, bytes) else w.encode() for w in islice(index, base, None)]
            whole = [(k, splitter.unreached[w]) for k, w in enumerate(raw) if w in splitter.unreached] if splitter.unreached else []
            words = splitter.starts(raw)
            order = np.concatenate(orders).astype(np.int32).tobytes()
            columns = [pa.array([ids], pa.list_(pa.int64())), pa.array([[len(o) for o in orders]], pa.list_(pa.int32())), pa.array([order], pa.binary()), pa.array([base], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(raw)], pa.int32()), words), pa.array([whole], pa.map_(pa.int32(), pa.int32()))]
            base, ids, orders, size = len(index), [], [], 0
            if base > HELD:
                index, base = _Index(), 0
            return pa.RecordBatch.from_arrays(columns, names=["ids", "lengths", "word_order", "base", "words", "whole"])

        for batch in batches:
            for part in chunks(batch, 1):
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = splitter.split(text or "")
                    ids.append(doc)
                    orders.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
                    size += len(text or "")
                if size >= BLOCK_BYTES:
                    yield row()
        if ids:
            yield row()

    return run


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = np.zeros(0, np.int64)
    decimal: list[bytes] = []
    raw: list[bytes] = []
    for batch in batches:
        for k in range(batch.num_rows):
            ids, lengths, order, base, coded, decoded = (batch.column(c)[k] for c in range(6))
            if not base.as_py():
                n, decimal, raw = n[:0], [], []
            ends = np.diff(coded.values.offsets.to_numpy())
            text = list(map(str, coded.values.flatten().tolist()))
            at = 0
            for size in ends.tolist():
                decimal.append(",".join(text[at : at + size]).encode())
                at += size
            n = np.concatenate([n, ends])
            raw += decoded.values.to_pylist()
            order = np.frombuffer(order.as_py(), np.int32)
            out: list[list] = [[], [], []]
            at = 0
            for size in lengths.values.to_pylist():
                words = order[at : at + size]
                listed = words.tolist()
                out[0].append(int(n[words].sum()))
                out[1].append(hashlib.sha256(b",".join([decimal[w] for w in listed])).hexdigest())
                out[2].append(hashlib.sha256(b"".join([raw[w] for w in listed])).hexdigest())
                at += size
            yield pa.RecordBatch.from_arrays([pa.array(ids.values.to_pylist(), pa.int64()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])


def coded_blocks(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per block: document ids, words per document, word order (int32), words known before, and the new words' ids and decoded bytes.

    Under the usual pattern (contractions, letters, numbers, others, white space) texts of plain characters are cut by a
    faster equal.
    """
    ranks = read_ranks(path)
    maps, pieces = literals(docs.sparkSession, ranks)
    source = docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), docs[f"`{text_col}`"].cast("string").alias("text"))
    blocks = source.mapInArrow(_blocks(pattern, path, unreached(ranks, pair_ranks(ranks))), "ids array<long>, lengths array<int>, word_order binary, base int, words array<array<int>>, whole map<int,int>")

    def word(w: Column, k: Column) -> Column:
        whole = F.try_element_at("whole", k)
        return F.when(whole.isNotNull(), F.array(whole)).otherwise(merge_bytes(w, F.col("maps")))

    coded = blocks.select("*", maps.alias("maps")).select("ids", "lengths", "word_order", "base", F.transform("words", word).alias("coded"))
    return coded.select("*", pieces.alias("pieces")).select("ids", "lengths", "word_order", "base", "coded", F.transform("coded", lambda ids: decode_ids(ids, F.col("pieces"))).alias("decoded"))


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, SHA-256 of the decimal ids joined by commas, SHA-256 of the decoded bytes."""
    return coded_blocks(docs, path, pattern, id_col, text_col).mapInArrow(_documents, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def fewer_tasks(docs: DataFrame) -> DataFrame:
    """A table as read, two splits to a task where all cores have two tasks still: a task encodes the words of both once."""
    n, cores = docs.rdd.getNumPartitions(), docs.sparkSession.sparkContext.defaultParallelism
    return docs.coalesce(max(1, min(n, 2 * cores), -(-n // 2)))
