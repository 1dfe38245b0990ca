"""SimHash near-dedup with an exact check: texts whose word shingles have a Jaccard index of a bound or more.

Operator 8 comes first: distinct SimHashes that are equal or differ in one or two bits are found by its index of deletion
variants (``by_fingerprint``), and the pairs of their texts are verified like all others.

Texts that share 0.8 of their five-word shingles differ in up to fifteen of the 64 bits of their SimHashes, where segments
that differ by at most one bit have eight bits and select nothing.  So for pairs further apart than the index reaches,
candidates must share a shingle of their prefixes.
All shingle sets are sorted by one order, that of a fixed table of counts (rare first) and then of the hash; sets of
similarity s have their first shared shingle in the first n - ceil(s * n) + 1 of both, and what follows it on either side
must be enough for s.  This holds for every order; rare first means that a passage of many documents is no key for texts
that hold enough besides it.  Within the texts of a key:

* up to ``COLD`` texts are compared pair by pair;
* of more (a large family of copies), each is first compared with the key's first text and with its neighbours by SimHash,
  as many pairs as rows.  Where these links leave a key's texts in several components, every text outside the key's largest
  component is then compared with all the key's texts of other components: pairs within a component add nothing.

Candidates are verified by the exact Jaccard index of their whole shingle sets, and links make components; they are those
that a comparison of all pairs gives.  Equal texts are one node from the start.

Edge cases: texts of no words are equal to each other; null ids are kept as they are; repeated rows of one id count as one
text and one row of them stays; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curata.llm.components import components
from curata.llm.shared import written
from curata.llm.simhash import links, shingle_hashes, simhash
from curata.llm.textmap import chunks, lower_ascii, map_texts, release, words_of

#: Texts of a key of which all pairs are compared, ids that may be broadcast, cells of the counts that order shingles and of one block of them.
COLD, BROADCAST, CELLS, BLOCK = 48, 1_000_000, 1 << 22, 1 << 14

#: Bits by which SimHashes are turned before sorting, and leading bits that neighbours have in common.
TURNS, SLICE = (0, 16, 32, 48), 12


def _set(text: str, size: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, size), np.uint64))


def _marked(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, same, fp): digest of the words and SimHash of the distinct shingles."""

    def make():
        release()

        def work(texts: list[str]) -> list:
            sets = [_set(t, size) for t in texts]
            lengths = np.array([len(s) for s in sets], np.int64)
            fps = simhash(np.concatenate(sets) if sets else np.zeros(0, np.uint64), lengths).view(np.int64)
            same = [hashlib.blake2b(" ".join(words_of(lower_ascii(t))).encode(), digest_size=16).digest() for t in texts]
            return [same, fps]

        return work

    return map_texts(docs, text_col, [id_col], [T.StructField("same", T.BinaryType()), T.StructField("fp", T.LongType())], make).withColumnRenamed(id_col, "id")


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - int(math.log2(CELLS)))).astype(np.int64)


def levels(docs: DataFrame, text_col: str, size: int) -> np.ndarray:
    """For each cell of hashes a number that grows with the texts that hold one of its shingles; it only orders, so a rough count will do."""

    def count(batches):
        release()
        cells = np.zeros(CELLS, np.uint32)
        for batch in batches:
            for part in chunks(batch, 0):
                for text in part.column(0).to_pylist():
                    np.add.at(cells, _cell(_set(text or "", size)), 1)
        blocks = np.minimum(cells, 255).astype(np.uint8).reshape(-1, BLOCK)
        some = np.flatnonzero(blocks.any(1))
        for lo in range(0, len(some), 64):
            at = some[lo : lo + 64]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([zlib.compress(blocks[k].tobytes(), 1) for k in at], pa.binary())], names=["block", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.int64)
        for x in table.column("counts"):
            total += np.frombuffer(zlib.decompress(x.as_py()), np.uint8)
        return pa.table({"block": table.column("block")[:1], "counts": pa.array([np.minimum(255, 8 * np.log2(1.0 + total)).astype(np.uint8).tobytes()], pa.binary())})

    kind = "block int, counts binary"
    out = np.zeros((CELLS // BLOCK, BLOCK), np.uint8)
    for r in docs.select(F.col(f"`{text_col}`").cast("string")).mapInArrow(count, kind).groupBy("block").applyInArrow(add, kind).collect():  # CELLS bytes
        out[r["block"]] = np.frombuffer(r["counts"], np.uint8)
    return out.ravel()


def keyed(texts: DataFrame, level: np.ndarray, size: int, similarity: float) -> DataFrame:
    """(key, id, n, at, count): the prefix shingles of each text of (id, text) that other texts' prefixes hold too."""

    def make():
        release()

        def work(batch: list[str]) -> list:
            sets = [_set(t, size) for t in batch]
            taken = [len(s) - math.ceil(similarity * len(s) - 1e-9) + 1 if len(s) else 0 for s in sets]
            return [[len(s) for s in sets], [s[np.lexsort((s, level[_cell(s)]))[:k]].view(np.int64) for s, k in zip(sets, taken, strict=True)]]

        return work

    fields = [T.StructField("n", T.IntegerType()), T.StructField("keys", T.ArrayType(T.LongType()))]
    rows = written(map_texts(texts, "text", ["id"], fields, make).select("id", "n", F.posexplode("keys").alias("at", "key")).select("key", "id", "n", "at"), "prefixes")
    return rows.join(rows.groupBy("key").count().where("count > 1"), "key")


def _fits(x: str, y: str, similarity: float) -> Column:
    """What similar sets fulfil at their first shared shingle: what is left of both is enough."""
    most = F.least(F.col(f"{x}.n") - F.col(f"{x}.at"), F.col(f"{y}.n") - F.col(f"{y}.at"))
    return most * (1 + similarity) >= (F.col(f"{x}.n") + F.col(f"{y}.n")) * similarity - 1e-6


def _pairs(joined: DataFrame, x: str, y: str) -> DataFrame:
    return joined.select(F.least(f"{x}.id", f"{y}.id").alias("a"), F.greatest(f"{x}.id", f"{y}.id").alias("b"))


def by_fingerprint(texts: DataFrame) -> DataFrame:
    """(a, b), a < b: of the texts (rep, fp), those that operator 8 links.

    Texts of one SimHash are each paired with the least of them, and SimHashes that differ in one or two bits by their least texts.
    """
    least = written(texts.groupBy("fp").agg(F.min("rep").alias("least")), "prints")
    x, y = (least.select(F.col("fp").alias(c), F.col("least").alias(f"least_{c}")) for c in ("a", "b"))
    apart = links(least.select("fp")).join(x, "a").join(y, "b").select(F.least("least_a", "least_b").alias("a"), F.greatest("least_a", "least_b").alias("b"))
    return apart.unionByName(texts.join(least, "fp").where("rep <> least").select(F.col("least").alias("a"), F.col("rep").alias("b")))


def candidates(rows: DataFrame, fps: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: all pairs that may be similar of keys of few texts, and as many as rows of the others."""
    cold = rows.where(F.col("count") <= COLD).select("key", "id", "n", "at")
    x, y = cold.alias("x"), cold.alias("y")
    pairs = _pairs(x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & _fits("x", "y", similarity)), "x", "y")
    hot = rows.where(F.col("count") > COLD).select("key", F.struct("id", "n", "at").alias("me"))
    first = hot.groupBy("key").agg(F.min("me").alias("other"))
    to_first = hot.join(first, "key").select("me", "other")
    turned = F.array(*[F.shiftleft("fp", t).bitwiseOR(F.shiftrightunsigned("fp", 64 - t)) if t else F.col("fp") for t in TURNS])
    parts = hot.join(fps, F.col("me.id") == fps.id).select("key", "me", F.posexplode(turned).alias("turn", "fp"))
    # The neighbour by SimHash, over slices that the SimHash and not the key's texts bound.
    order = Window.partitionBy("key", "turn", F.shiftrightunsigned("fp", 64 - SLICE)).orderBy("fp", "me.id")
    neighbour = parts.withColumn("other", F.lag("me").over(order)).where("other is not null").select("me", "other")
    linear = to_first.unionByName(neighbour).where((F.col("me.id") != F.col("other.id")) & _fits("me", "other", similarity))
    return pairs.unionByName(_pairs(linear, "me", "other"))


def rest(rows: DataFrame, root: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: all other pairs that may be similar, of keys of many texts whose texts lie in several components."""
    hot = rows.where(F.col("count") > COLD).join(root, F.col("id") == F.col("node"), "left").select("key", "id", "n", "at", F.coalesce("root", "id").alias("root"))
    hot = written(hot, "hot")
    several = hot.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    mixed = hot.join(several, "key")
    sizes = mixed.groupBy("key", "root").count()
    main = sizes.groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("main"))
    mixed = written(mixed.join(main, "key"), "mixed")
    x, y = mixed.where("root <> main").alias("x"), mixed.alias("y")
    return _pairs(x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & _fits("x", "y", similarity)), "x", "y").distinct()


def verified(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int, similarity: float) -> DataFrame:
    """The pairs whose whole shingle sets have a Jaccard index of ``similarity`` or more."""
    ids = written(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "ids")
    few = F.broadcast(ids) if ids.count() <= BROADCAST else ids
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(few, "id", "left_semi")

    def make():
        release()
        return lambda texts: [[np.unique(np.array(shingle_hashes(t, size), np.uint64)).tobytes() for t in texts]]

    sets = written(map_texts(texts, "text", ["id"], [T.StructField("set", T.BinaryType())], make).groupBy("id").agg(F.min("set").alias("set")), "sets")

    def check(batches):
        for batch in batches:
            kept = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = len(np.intersect1d(u, v, assume_unique=True))
                kept.append(shared >= similarity * (len(u) + len(v) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(kept, pa.bool_()))

    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")
    return both.mapInArrow(check, T.StructType(both.schema.fields[:2]))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, root) for the ids whose text is in a class with another's: ``root`` is the class's least id."""
    marked = written(_marked(docs, id_col, text_col, size).where("id is not null"), "marked")
    named = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    texts = written(marked.groupBy("same").agg(F.min("id").alias("rep"), F.min_by("fp", "id").alias("fp")), "texts")
    reps = texts.select(F.col("rep").alias("id")).distinct()
    few = F.broadcast(reps) if reps.count() <= BROADCAST else reps
    rows = written(keyed(named.join(few, "id", "left_semi"), levels(named, "text", size), size, similarity), "keyed")
    near = written(by_fingerprint(texts), "near")
    pairs = written(near.unionByName(candidates(rows, texts.select(F.col("rep").alias("id"), "fp"), similarity)).distinct(), "pairs")
    edges = written(verified(pairs, docs, id_col, text_col, size, similarity), "edges")
    root = components(edges)
    more = written(rest(rows, root, similarity), "rest")
    if not more.isEmpty():
        root = components(edges.unionByName(verified(more, docs, id_col, text_col, size, similarity)))
    rooted = texts.join(root, texts.rep == root.node, "left").select("same", F.coalesce("root", "rep").alias("root"))
    return marked.select("id", "same").join(rooted, "same").where("id <> root").select("id", "root").distinct()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` with one row of each class: that of its least id."""
    gone = written(classes(docs, id_col, text_col, size, similarity).select(F.col("id").alias(id_col)).distinct(), "gone")
    few = F.broadcast(gone) if gone.count() <= BROADCAST else gone
    kept = docs.join(few, id_col, "left_anti").select(*[docs[f"`{c}`"] for c in docs.columns])
    key, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    twice = written(docs.where(key.isNotNull()).groupBy(key.alias(id_col)).count().where("count > 1").select(F.col(f"`{id_col}`")), "twice")
    n = twice.count()
    if not n:
        return kept
    few = F.broadcast(twice) if n <= BROADCAST else twice
    once = kept.join(few, id_col, "left_anti").select(*[kept[f"`{c}`"] for c in docs.columns])
    rows = kept.join(few, id_col, "left_semi").select(key.alias("id"), F.struct(*[kept[f"`{c}`"] for c in docs.columns]).alias("row"), F.struct(F.xxhash64(text), text).alias("place"))
    first = rows.groupBy("id").agg(F.min_by("row", "place").alias("row"))  # combined before the shuffle, however often an id occurs
    return once.unionByName(first.select("row.*"))
