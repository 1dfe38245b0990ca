"""Pairs of texts whose character n-gram sets are alike, exactly and without an index of n-grams.

Texts of a few thousand letters share most of their n-grams with thousands of others, so keys made of n-grams propose more
pairs than there are.  Here a set is a row: its size and a parity sketch, a bit for each cell of hashes that holds an odd
number of its elements.  Two sketches differ in at most as many bits as two sets in elements, and sets with a Jaccard index
over t differ in fewer than (1 - t) / (1 + t) of their sizes' sum.  Sets that alike are also of sizes that differ by a factor
of less than 1 / t.  So rows are dealt to buckets of sizes 1 / t apart, a bucket is compared with itself and the next one in
units of two blocks of ``BLOCK`` rows, and what the sketches allow is verified on the texts.

Comparing costs a nanosecond or two for each 64 bits of a pair, in proportion to the square of a bucket's rows; rows go once
to each unit of their block.  Nothing is left out at any size.  Elements are 64-bit hashes of n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.functions.text import folded_space
from curata.operators.settle import settled

#: Rows of a block, rows that are compared at once, nodes that may be broadcast, elements that a task keeps between pairs.
BLOCK, AT_ONCE, BROADCAST, HELD = 1 << 15, 4096, 1_000_000, 8_000_000


def gram_set(text: str, n: int) -> np.ndarray:
    """Sorted hashes of the distinct character n-grams."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = len(points) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(size, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + points[k : k + size] + np.uint64(1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.unique(h ^ (h >> np.uint64(31)))


def sketch(hashes: np.ndarray) -> bytes:
    """Parity of each cell: about as many cells as elements, a power of two and 64 at least."""
    bits = max(6, round(np.log2(max(1, len(hashes)))))
    cells = np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.packbits((cells & 1).astype(np.uint8)).tobytes()


def _narrowed(words: np.ndarray, width: int) -> np.ndarray:
    """Sketches (words, rows) as they are with ``width`` words: a cell is the parity of those that it takes in."""
    bits = np.unpackbits(np.ascontiguousarray(words.T).view(np.uint8), axis=1)
    merged = bits.reshape(len(bits), width * 64, -1).sum(2, dtype=np.int64) & 1
    return np.ascontiguousarray(np.packbits(merged.astype(np.uint8), axis=1).view(np.uint64).T)


def _sized(sketches: list[bytes], width: int) -> np.ndarray:
    """(width, rows) of sketches of ``width`` words or more."""
    out = np.zeros((width, len(sketches)), np.uint64)
    lengths = np.array([len(s) // 8 for s in sketches])
    for w in np.unique(lengths):
        at = np.flatnonzero(lengths == w)
        words = np.ascontiguousarray(np.frombuffer(b"".join(sketches[k] for k in at), np.uint64).reshape(len(at), w).T)
        out[:, at] = words if w == width else _narrowed(words, width)
    return out


def compared(left: tuple, right: tuple, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """(row of left, rows of right) that may be alike; a side is (sizes, sketches)."""
    width = min(min(len(s) for s in side[1]) for side in (left, right)) // 8
    order = np.argsort(right[0], kind="stable")
    sizes, theirs, ours = right[0][order], _sized([right[1][k] for k in order], width), _sized(left[1], width)
    apart = (1 - threshold) / (1 + threshold)
    half = max(1, width // 2)
    for row, n in enumerate(left[0]):
        lo, hi = np.searchsorted(sizes, [np.ceil(n * threshold - 1e-6), np.floor(n / threshold + 1e-6) + 1])
        for at in range(lo, hi, AT_ONCE):
            to = min(hi, at + AT_ONCE)
            most = apart * (n + sizes[at:to]) + 1e-6
            bits = np.bitwise_count(theirs[:half, at:to] ^ ours[:half, row : row + 1]).sum(0, dtype=np.int64)
            some = np.flatnonzero(bits <= most)
            if half < width and len(some):
                more = np.bitwise_count(theirs[half:, at + some] ^ ours[half:, row : row + 1]).sum(0, dtype=np.int64)
                some = some[bits[some] + more <= most[some]]
            if len(some):
                yield row, order[at + some]


def _measured(texts: DataFrame, n: int) -> DataFrame:
    """(node, side, n, sketch) of (node, side, text): sets of no elements have none."""

    def work(batches):
        for batch in batches:
            sets = [gram_set(t, n) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int32()), pa.array([sketch(s) for s in sets], pa.binary())], names=["node", "side", "n", "sketch"])

    return texts.mapInArrow(work, "node binary, side int, n int, sketch binary").where("n > 0")


def _units(counts: dict[tuple[int, int], int], sides: bool) -> list[tuple]:
    """(bucket, side, block, unit, role): where each block goes; a unit is compared between its roles, or within its one role 0."""
    out, unit = [], 0
    blocks = {k: -(-v // BLOCK) for k, v in counts.items()}
    for (bucket, side), m in sorted(blocks.items()):
        for other in ((bucket, 1 - side) if sides else (bucket, side), (bucket + 1, 1 - side if sides else side)):
            if other not in blocks or (sides and other[0] == bucket and side):
                continue
            for i in range(m):
                for j in range(i if other == (bucket, side) else 0, blocks[other]):
                    out.append((bucket, side, i, unit, 0))
                    if (bucket, side, i) != (*other, j):
                        out.append((*other, j, unit, 1))
                    unit += 1
    return out


def near_pairs(texts: DataFrame, threshold: float, n: int, sides: bool = False) -> DataFrame:
    """(a, b, similarity) of nodes of (node binary, side int, text) over ``threshold``, each pair once; repeated nodes are one.

    With ``sides`` only pairs of a node of side 0 (a) with one of side 1 (b).
    """
    spark = texts.sparkSession
    texts = texts.select("node", "side", folded_space(F.col("text")).alias("text"))
    bucket = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(-np.log(threshold)))).cast("int")
    once = _measured(texts, n).dropDuplicates(["node", "side"])
    rows = settled(once.withColumn("bucket", bucket).withColumn("no", F.monotonically_increasing_id()))
    counts = {(r["bucket"], r["side"]): r["c"] for r in rows.groupBy("bucket", "side").agg(F.count("*").alias("c")).collect()}  # a hundred buckets
    plan = spark.createDataFrame(_units(counts, sides), "bucket int, side int, block int, unit int, role int")
    many = F.lit(1)
    for (b, s), c in counts.items():
        if c > BLOCK:
            many = F.when((F.col("bucket") == b) & (F.col("side") == s), -(-c // BLOCK)).otherwise(many)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("node"), many).cast("int")).join(F.broadcast(plan), ["bucket", "side", "block"]).select("unit", "role", "side", "no", "n", "sketch")

    def compare(table: pa.Table) -> pa.Table:
        nos, roles, sizes, side = (table.column(c).to_numpy() for c in ("no", "role", "n", "side"))
        sketches, unit = table.column("sketch").to_pylist(), table.column("unit")[0].as_py()
        at = [np.flatnonzero(roles == k) for k in (0, 1)]
        alone = table.column("alone")[0].as_py() if "alone" in table.column_names else False
        at[1] = at[0] if alone else at[1]
        left, right = ((sizes[k].astype(np.int64), [sketches[i] for i in k]) for k in at)
        pairs = [np.zeros((0, 2), np.int64)]
        for row, others in compared(left, right, threshold) if len(at[0]) and len(at[1]) else ():
            x, y = at[0][row], at[1][others]
            y = y[nos[y] > nos[x]] if alone else y
            turned = sides and side[x]
            pairs.append(np.stack((nos[y], np.full(len(y), nos[x])) if turned else (np.full(len(y), nos[x]), nos[y]), axis=1))
        found = np.concatenate(pairs)
        return pa.table({"unit": pa.array(np.full(len(found), unit), pa.int32()), "a": found[:, 0], "b": found[:, 1]})

    single = {u[3] for u in _units(counts, sides)} - {u[3] for u in _units(counts, sides) if u[4]}
    flagged = dealt.withColumn("alone", F.col("unit").isin(sorted(single)) if single else F.lit(False))
    pairs = settled(flagged.groupBy("unit").applyInArrow(compare, "unit int, a bigint, b bigint"))
    verified = _verified(pairs, rows, texts, threshold, n)
    x, y = (rows.select(F.col("no").alias(c), F.col("node").alias(f"node_{c}")) for c in ("a", "b"))
    return verified.join(x, "a").join(y, "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), "similarity")


def _verified(pairs: DataFrame, rows: DataFrame, texts: DataFrame, threshold: float, n: int) -> DataFrame:
    """The pairs (unit, a, b) whose whole sets have a Jaccard index over ``threshold``; a text goes once to each unit that has it in a pair."""
    uses = settled(pairs.select("unit", F.explode(F.array("a", "b")).alias("no")).distinct())
    wanted = rows.join(uses.select("no").distinct(), "no", "left_semi").select("node", "side", "no")
    wanted = settled(wanted)
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST else wanted
    sought = texts.join(few, ["node", "side"]).select("no", "text").dropDuplicates(["no"])
    there = uses.join(sought, "no").select(F.col("unit").alias("at"), "no", "text")

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        place = {no: k for k, no in enumerate(right.column("no").to_pylist())}
        column, sets, held = right.column("text"), {}, 0

        def of(no: int) -> np.ndarray:
            nonlocal held
            if no not in sets:
                if held > HELD:
                    sets.clear()
                    held = 0
                sets[no] = gram_set(column[place[no]].as_py(), n)
                held += len(sets[no])
            return sets[no]

        a, b = left.column("a").to_numpy(), left.column("b").to_numpy()
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        index = np.zeros(len(a))
        starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
        for lo, end in zip(starts, np.r_[starts[1:], len(a)], strict=True):
            u = of(int(a[lo]))
            for at in range(lo, end, 256):
                to = min(at + 256, end)
                others = [of(int(k)) for k in b[at:to]]
                lengths = np.array([len(v) for v in others])
                joined = np.concatenate(others)
                hit = u[np.minimum(np.searchsorted(u, joined), len(u) - 1)] == joined
                shared = np.add.reduceat(hit, np.cumsum(lengths) - lengths, dtype=np.int64)
                index[at:to] = shared / (len(u) + lengths - shared).astype(float)
        some = index > threshold
        return pa.table({"a": a[some], "b": b[some], "similarity": index[some]})

    return pairs.groupBy("unit").cogroup(there.groupBy("at")).applyInArrow(check, "a bigint, b bigint, similarity double")


def node_of(text: Column) -> Column:
    """The node of a text: equal texts are one."""
    return F.unhex(F.sha2(text, 256))
