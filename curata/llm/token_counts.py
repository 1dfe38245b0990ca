"""Token counts without ids.

Pieces are counted once per distinct pre-token; the counts are joined to the pre-token frequencies of each document and
summed; ids are never made.  The join is local: documents and the table of the distinct pre-tokens they use meet in one task,
so nothing is shuffled and no document is broken into rows.  The table holds a number per pre-token, is bounded by the bytes
of its pre-tokens (``HELD_BYTES``) and begun again when it is full, so a pre-token may be counted again by a later task or
table; what is counted is the same.

Edge cases: a null or empty text has 0 bytes and 0 tokens; a very long pre-token is counted whole; repeated rows give repeated
results; an empty table gives an empty result; columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from operator import mul

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from curata.llm.textmap import held, map_texts
from curata.llm.word_bpe import WordBpe

#: Characters of the pre-tokens that a worker's table holds.
HELD_BYTES = 8 << 20


class Pieces(dict):
    """Pieces by pre-token, each counted when it is met first."""

    def __init__(self, count: Callable[[str], int]) -> None:
        super().__init__()
        self.count, self.size = count, 0

    def __missing__(self, pre_token: str) -> int:
        n = self[pre_token] = self.count(pre_token)
        self.size += len(pre_token) + 16
        return n

    def total(self, frequencies: Counter) -> int:
        """The pieces of all pre-tokens of these frequencies."""
        if self.size > HELD_BYTES:
            self.clear()
            self.size = 0
        return sum(map(mul, map(self.__getitem__, frequencies), frequencies.values()))


def _made(path: str) -> tuple[WordBpe, Pieces]:
    bpe = WordBpe(path)
    return bpe, Pieces(bpe.pieces)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""

    def make():
        bpe, pieces = held(("pieces of pre-tokens", path), lambda: _made(path))

        def work(texts: list[str]) -> list:
            n = [pieces.total(Counter(bpe.pre_tokens(t))) for t in texts]
            return [[len(t.encode()) for t in texts], n, [x > limit for x in n]]

        return work

    return map_texts(docs, text_col, [id_col], [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())], make)
