"""Packing of documents into sequences by Karmarkar-Karp multiway differencing.

A document's ids (and its end id) are cut at every ``capacity`` ids; full pieces fill a sequence alone.  What remains of
each document is cut once more at ``capacity / 4`` boundaries, so that every piece to be packed is small against the
capacity, and pieces are packed in groups of ``GROUP`` documents' remainders: the pieces of a group are partial
partitions over k windows, and the two with the largest spread are merged with opposing imbalances until one partition
into k near-equal windows is left.  k starts at the least count that could hold the group and rises by one whenever a
window exceeds the capacity.

Each task packs the documents it reads, so nothing is shuffled; sequence numbers are unique across tasks.  Only the
last group of a task is small, which costs less than one sequence of padding per task.

Edge cases: a null or empty text is the end id alone; a long text yields many full pieces; an empty table gives an empty
result; repeated rows are packed like any others; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from curata.llm.textmap import chunks
from curata.llm.word_bpe import word_bpe

#: Remainders packed together.
GROUP = 512


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Partition of the items into k windows of near-equal sums: lists of item numbers.

    A partial partition is held as its non-empty windows, largest first; the rest are empty.  Merging joins the largest
    window of one with the smallest of the other, and so on.
    """
    heap = [(-s, i, [(s, (i,))]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        free = k - len(a)
        if len(b) <= free:  # every window of b meets an empty one
            both = a + b
        else:
            n = len(b) - free  # the n smallest of b meet the n smallest of a, the larger with the smaller
            low = b[len(b) - n :]
            both = a[: len(a) - n] + b[: len(b) - n] + [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a[len(a) - n :], reversed(low), strict=True)]
        both.sort(key=lambda w: -w[0])
        spread = both[0][0] - (both[-1][0] if len(both) == k else 0)
        heapq.heappush(heap, (-spread, tick, both))
        tick += 1
    return [list(w[1]) for w in heap[0][2]] if heap else []


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows of at most ``capacity``, as few as differencing finds."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        out = differencing(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in out):
            return out
        k += 1


def cut(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: full ones, then a remainder in pieces of at most a quarter."""
    quarter = max(1, capacity // 4)
    full, rest = divmod(n, capacity)
    small, last = divmod(rest, quarter)
    return [capacity] * full + [quarter] * small + [last] * (last > 0)


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece, under SCHEMA; ``doc_id`` holds ``id_col``.

    ``sequence_id`` is the task's number times 2**32 plus a count, ``offset`` the place of the piece there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        context = TaskContext.get()
        serial = (context.partitionId() if context else 0) << 32
        waiting: list[tuple] = []  # pieces of remainders
        docs_waiting = 0

        def placed(groups: list[list[tuple]]) -> pa.RecordBatch:
            nonlocal serial
            rows: list[tuple] = []
            for group in groups:
                at = 0
                for piece in group:
                    rows.append((*piece, serial, at))
                    at += piece[2]
                serial += 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 7)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for part in chunks(batch, 1):
                texts = [bpe.words(t or "") for t in part.column(1).to_pylist()]
                done: list[list[tuple]] = []
                for doc, numbers in zip(part.column(0).to_pylist(), bpe.codes.numbers(texts), strict=True):
                    ids = np.append(bpe.codes.ids(numbers), end_id).astype("<u4")
                    at = 0
                    for length in cut(len(ids), capacity):
                        piece = (doc, at, length, zlib.crc32(ids[at : at + length]), len(ids))
                        if length == capacity:
                            done.append([piece])
                        else:
                            waiting.append(piece)
                        at += length
                    docs_waiting += 1
                    if docs_waiting == GROUP:
                        done += [[waiting[i] for i in w] for w in windows([p[2] for p in waiting], capacity)]
                        waiting, docs_waiting = [], 0
                yield placed(done)
        if waiting:
            yield placed([[waiting[i] for i in w] for w in windows([p[2] for p in waiting], capacity)])

    return docs.select(docs[f"`{id_col}`"].cast("long").alias("doc_id"), docs[f"`{text_col}`"].cast("string").alias("text")).mapInArrow(run, SCHEMA)
