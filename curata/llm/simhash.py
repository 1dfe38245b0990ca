"""SimHash near-dedup by deletion-variant signatures.

A text's fingerprint has a bit set where over half of its shingle hashes have it.  Two fingerprints of 64 bits that differ
in at most two bits are found without comparing all pairs.  Cut into two halves, one half differs by at most one bit:

* it is equal, and the other half differs in up to two bits; the other half, cut into three, has an equal third;
* or it differs in one bit, and so does the other half, or less; of the other half's two quarters one is equal.

So each distinct fingerprint is indexed under its halves with a third of the other (6 keys) and under its first half with
one bit left out, once for each bit, with a quarter of the second (64 keys).  Equality joins on a key propose pairs that
agree in 43 or 47 bits, and only pairs that truly differ in at most two bits go on.  Equal fingerprints are one node
throughout, so a group of copies costs one row; each pair is taken under its first shared key only.

Edge cases: a null or empty text has no shingles and fingerprint zero, and is linked like any other; fewer words than a
shingle make one shingle; repeated rows share a node; null ids get a component (its least id, null if it has none); an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curata.llm.components import components
from curata.llm.shared import written
from curata.llm.textmap import lower_ascii, map_texts, release, words_of


def simhash(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Fingerprints (uint64) of consecutive groups of hashes; an empty group has zero."""
    out = np.zeros(len(lengths), np.uint64)
    at = np.cumsum(lengths) - lengths
    some = np.flatnonzero(lengths)
    if len(some):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, at[some], axis=0, dtype=np.int64)
        out[some] = np.packbits(2 * ones > lengths[some, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def shingle_hashes(text: str, size: int) -> list[int]:
    """XXH64 (seed 42) of the text's word shingles, in order."""
    from xxhash import xxh64_intdigest

    words = words_of(lower_ascii(text))
    if len(words) <= size:
        return [xxh64_intdigest(" ".join(words).encode(), 42)] if words else []
    return [xxh64_intdigest(" ".join(w).encode(), 42) for w in zip(*(words[k:] for k in range(size)), strict=False)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of each row's whole text as a long."""

    def make():
        release()

        def work(texts: list[str]) -> list:
            hashes = [np.array(shingle_hashes(t, size), np.uint64) for t in texts]
            lengths = np.array([len(h) for h in hashes], np.int64)
            return [simhash(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), lengths).view(np.int64)]

        return work

    return map_texts(docs, text_col, [id_col], [T.StructField("fp", T.LongType())], make)


def _field(fp: Column, low: int, bits: int) -> Column:
    """``bits`` bits of fp from bit ``low``."""
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << bits) - 1))


def _keys(fp: Column) -> Column:
    """The index keys: array of (kind, value)."""
    kinds: list[tuple[Column, Column]] = []
    thirds = ((0, 11), (11, 11), (22, 10))
    for half in (0, 32):
        for at, bits in thirds:
            kinds.append((_field(fp, half, 32), _field(fp, 32 - half + at, bits)))
    for bit in range(32):
        rest = _field(fp, 0, 32).bitwiseAND(F.lit(((1 << 32) - 1) ^ (1 << bit)))
        for at in (32, 48):
            kinds.append((rest, _field(fp, at, 16)))
    return F.array(*[F.struct(F.lit(k).cast("short").alias("kind"), F.xxhash64(F.lit(k), a, b).alias("value")) for k, (a, b) in enumerate(kinds)])


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _first_kind(a: Column, b: Column) -> Column:
    """The one kind under which a pair at distance 1 or 2 counts."""
    diff = a.bitwiseXOR(b)
    low, high = _field(diff, 0, 32), _field(diff, 32, 32)

    def third(base: int, other: Column) -> Column:
        return F.when(other.bitwiseAND(F.lit((1 << 11) - 1)) == 0, base).when(_field(other, 11, 11) == 0, base + 1).otherwise(base + 2)

    quarter = F.when(_field(high, 0, 16) == 0, 0).otherwise(1)
    return F.when(low == 0, third(0, high)).when(high == 0, third(3, low)).otherwise(F.lit(6) + 2 * F.bit_count(low - 1) + quarter)


def links(distinct: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct fingerprints ``fp`` that differ in one or two bits, each once.

    The rows under keys are 70 times the fingerprints, which the planner's estimate leaves out; so the join is told to sort
    and never to collect them on the driver.
    """
    keyed = distinct.select("fp", F.explode(_keys(F.col("fp"))).alias("k")).select("fp", "k.kind", "k.value")
    x, y = keyed.alias("x"), keyed.alias("y")
    a, b = F.col("x.fp"), F.col("y.fp")
    return x.join(y.hint("merge"), (F.col("x.value") == F.col("y.value")) & (F.col("x.kind") == F.col("y.kind")) & (a < b) & (_distance(a, b) <= 2) & (_first_kind(a, b) == F.col("x.kind"))).select(a.alias("a"), b.alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """Per row: id, fingerprint (hex), component_id: the least id that links of at most two bits reach."""
    marked = written(fingerprints(docs, id_col, text_col, size).withColumnRenamed(id_col, "id"), "fingerprints")
    nodes = marked.groupBy("fp").agg(F.min("id").alias("least"))
    root = components(links(nodes.select("fp")))
    joined = nodes.join(root, nodes.fp == root.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = written(joined, "roots")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    table = named.select("fp", "root").join(least, "root").select("fp", "component_id")
    return marked.join(table, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
