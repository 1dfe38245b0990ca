"""Shared machinery of the text operators: Arrow batches in, plain columns out.

``map_texts`` runs a worker-side processor over the whole texts of a DataFrame in one narrow stage: no shuffle, no
state outside the task, so a lost executor only costs the retry of its own partitions.  Texts are handled in chunks of
a bounded number of bytes, and a null text counts as the empty text.
"""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Texts handled together in a worker: at most so many rows and about so many bytes.
CHUNK_ROWS, CHUNK_BYTES = 512, 2 << 20

#: Characters and ids of the words that a table holds, in bytes.
MOST_BYTES = 48 << 20

#: White space of the word contract, and what ``str.split`` would split at besides it.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")


def words_of(text: str) -> list[str]:
    """Maximal runs of characters other than space and U+0009..U+000D."""
    if _OTHER_SPACE.search(text):
        return WORD.findall(text)
    return text.split()


_UPPER = str.maketrans({c: c + 32 for c in range(ord("A"), ord("Z") + 1)})


def lower_ascii(text: str) -> str:
    """Lower-cases A-Z only; all other characters stay."""
    return text.lower() if text.isascii() else text.translate(_UPPER)


def chunks(batch: pa.RecordBatch, text_at: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most CHUNK_ROWS rows and about CHUNK_BYTES of text."""
    size = max(1, batch.nbytes)
    step = max(1, min(CHUNK_ROWS, batch.num_rows * CHUNK_BYTES // size))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def map_texts(df: DataFrame, text_col: str, keep: list[str], fields: list[T.StructField], make: Callable[[], Callable[[list[str]], list]]) -> DataFrame:
    """``keep`` columns of each row, then ``fields`` computed from its text.

    ``make()`` is called once per task and gives a function from a list of texts to one list per field.  Columns of
    ``df`` that are not kept are ignored, so extra or clashing names do no harm.  An empty input gives an empty result.
    """
    held = list(dict.fromkeys(keep))
    own = "text" + "_" * max(map(len, ["", *held]))  # a name that no column has
    source = df.select(*[df[f"`{c}`"] for c in held], df[f"`{text_col}`"].cast("string").alias(own))
    schema = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in source.schema.fields[:-1]), *fields])
    kinds = [to_arrow_type(f.dataType, prefers_large_types=False) for f in fields]
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in chunks(batch, len(held)):
                texts = [t or "" for t in part.column(len(held)).to_pylist()]
                made = [pa.array(x, kind) for x, kind in zip(work(texts), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(held)], *made], names=names)
        trim()

    return source.mapInArrow(run, schema)


class _Index(dict):
    """Word to number; a word not seen before gets the next number and is noted as pending."""

    def __init__(self) -> None:
        super().__init__()
        self.pending: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.pending.append(word)
        return n


class WordCodes:
    """Ids of distinct words, each encoded once while it is held.

    ``encode`` maps a list of distinct words to one id list each.  The table is dropped and begun again beyond
    ``most`` words or ``MOST_BYTES`` of words and ids, so its memory is bounded; what is dropped is encoded anew when met,
    never lost.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], most: int = 400_000, also: Callable[[list[str]], list[int]] | None = None) -> None:
        """``also`` gives one more number for each word, kept in ``extra``."""
        self.encode, self.most, self.also = encode, most, also
        self._begin()

    def _begin(self) -> None:
        self.index, self.size = _Index(), 0
        self.flat, self.used = np.empty(1 << 16, np.int32), 0
        self.start, self.length = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int32)
        self.extra = np.empty(1 << 14 if self.also else 0, np.int32)

    def numbers(self, lists: list[list[str]]) -> list[np.ndarray]:
        """The word numbers of each list; valid until the next call."""
        if len(self.index) > self.most or self.size + 4 * self.used > MOST_BYTES:
            self._begin()
        get = self.index.__getitem__
        out = [np.fromiter(map(get, x), np.int64, len(x)) for x in lists]
        if pending := self.index.pending:
            self.index.pending = []
            self.size += sum(map(len, pending))
            self._add(pending)
        return out

    def _add(self, words: list[str]) -> None:
        at = len(self.index) - len(words)
        if len(self.index) > len(self.start):
            room = 2 * len(self.index)
            self.start, self.length = np.resize(self.start, room), np.resize(self.length, room)
            self.extra = np.resize(self.extra, room) if self.also else self.extra
        for lo in range(0, len(words), 4096):
            coded = self.encode(words[lo : lo + 4096])
            n = np.fromiter(map(len, coded), np.int32, len(coded))
            total = int(n.sum())
            if self.used + total > len(self.flat):
                self.flat = np.resize(self.flat, 2 * (self.used + total))
            self.flat[self.used : self.used + total] = np.fromiter((i for x in coded for i in x), np.int32, total)
            self.length[at + lo : at + lo + len(coded)] = n
            if self.also:
                self.extra[at + lo : at + lo + len(coded)] = self.also(words[lo : lo + 4096])
            self.start[at + lo : at + lo + len(coded)] = self.used + np.cumsum(n) - n
            self.used += total

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        """All ids of the numbered words, in order."""
        n = self.length[numbers]
        total = int(n.sum())
        if not total:
            return np.empty(0, np.int32)
        before = np.cumsum(n) - n
        return self.flat[np.repeat(self.start[numbers] - before, n) + np.arange(total)]


#: What a worker keeps between tasks, by kind and file.
_HELD: dict = {}


def held(key: tuple, make: Callable[[], object]) -> object:
    """The object of a key in this worker process; another key's is given up, so a worker holds one table at most."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Gives up what this worker holds, and its freed memory to the system.

    Tasks that need no table call it, or workers that are used again would carry the last stage's table along.
    """
    if _HELD:
        _HELD.clear()
        gc.collect()
    trim()


def trim() -> None:
    """Freed memory goes back to the system where the C library can; else a worker that is used again keeps the most that any of its tasks had."""
    pa.default_memory_pool().release_unused()
    freed = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if freed:
        freed(0)
