"""Quality rules by tokenizer fertility.

Each whole text is cut into words, and two public vocabularies encode each distinct word: pieces with byte fallback, and
byte-level BPE.  Four figures follow: characters per token of either, the share of byte-fallback tokens, and the entropy of
the text's token distribution against that of as many different tokens.

Each figure has an accepted band per script (the script of most of the text's letters).  Bands are measured: over all texts
of the table that pass the base rules, from the quartiles less and plus ``REACH`` times their distance; short texts, whose
figures scatter, have bands wider by ``SLACK`` of that distance, less with the root of their length.  A script's own ``PRIOR``
bands count like ``WEIGHT`` texts, so a script of few texts goes by them and one of many by its own.  A text outside a band
is rejected.

Base rules come first: a text of fewer than 10 words, or with over 20 % of its words in repeated 5-word windows, fails.

The figures of all rows are written once; the quartiles (a row per script) reach the driver, and verdicts are columns.

Edge cases: a null or empty text has no words and fails; repeated rows give repeated results; an empty table gives an
empty result; other columns are ignored (``measure``) or passed through untouched, whatever their names (``keep_fertile``).
"""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curata.llm.byte_bpe import read_ranks
from curata.llm.shared import written
from curata.llm.textmap import WordCodes, held, map_texts, words_of


class Band(NamedTuple):
    """Accepted figures of one script, before any text is seen."""

    chars: tuple[float, float]  # characters per token of the pieces
    byte_chars: tuple[float, float]  # characters per token of byte-level BPE
    evenness: tuple[float, float]  # entropy against its greatest value
    bytes_high: float  # share of byte-fallback tokens


#: Bands by script.  The vocabularies hold few pieces of scripts other than Latin and Cyrillic, so their bands are wide.
PRIOR = {
    "latin": Band((1.6, 6.5), (1.6, 6.5), (0.4, 1.0), 0.10),
    "cyrillic": Band((1.2, 6.0), (1.0, 6.0), (0.4, 1.0), 0.15),
    "greek": Band((0.6, 3.0), (0.5, 3.0), (0.3, 1.0), 0.40),
    "arabic": Band((0.5, 3.0), (0.5, 3.0), (0.3, 1.0), 0.60),
    "hebrew": Band((0.5, 3.0), (0.5, 3.0), (0.3, 1.0), 0.60),
    "indic": Band((0.3, 2.5), (0.3, 2.5), (0.3, 1.0), 0.90),
    "cjk": Band((0.3, 2.0), (0.3, 2.0), (0.3, 1.0), 0.80),
    "other": Band((0.2, 8.0), (0.2, 8.0), (0.2, 1.0), 1.00),
}

#: Distance of a band's ends from the quartiles in quartile distances, what short texts have more of it, tokens of a text
#: that is not short, texts that a prior band counts for.
REACH, SLACK, LONG, WEIGHT = 1.5, 0.5, 100, 50

#: Words that the table of both vocabularies holds.
HELD = 150_000

#: Figures with bands, as columns.
BANDED = ("chars_per_token", "chars_per_byte_token", "evenness")

_SCRIPTS = {
    "latin": re.compile("[A-Za-z\xc0-ɏ]"),
    "cyrillic": re.compile("[Ѐ-ԯ]"),
    "greek": re.compile("[Ͱ-Ͽἀ-῿]"),
    "arabic": re.compile("[؀-ۿݐ-ݿ]"),
    "hebrew": re.compile("[֐-׿]"),
    "indic": re.compile("[ऀ-෴]"),
    "cjk": re.compile("[぀-ヿ㐀-鿿가-힣]"),
}
_BEYOND_LATIN = re.compile("[Ͱ-῿぀-퟿]")
_SYMBOL = re.compile(r"[#*$%&|<>]")


def script_of(text: str) -> str:
    """The script with most letters; ties go to the first of PRIOR; no letters: other."""
    if not _BEYOND_LATIN.search(text):
        return "latin" if _SCRIPTS["latin"].search(text) else "other"
    n = {k: len(p.findall(text)) for k, p in _SCRIPTS.items()}
    best = max(n, key=n.get)
    return best if n[best] else "other"


def repeated_words(numbers: np.ndarray, size: int = 5) -> int:
    """Words in windows of ``size`` words that occur twice or more, the first occurrence included."""
    n = len(numbers) - size + 1
    if n < 2:
        return 0
    _, local = np.unique(numbers, return_inverse=True)
    if len(numbers) == local.max() + 1:
        return 0
    window = local[:n]
    for k in range(1, size):  # exact: each round numbers the distinct prefixes anew
        _, window = np.unique(window.astype(np.int64) * (local.max() + 1) + local[k : n + k], return_inverse=True)
    twice = np.bincount(window)[window] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + size, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines (split at line feeds) that have a word and equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = Counter(text.split("\n"))
    return sum(n - 1 for line, n in lines.items() if n > 1 and words_of(line))


class _Pieces:
    def __init__(self, path: str, byte_path: str) -> None:
        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        byte_level = tiktoken.Encoding("byte level", pat_str=PATTERN, mergeable_ranks=read_ranks(byte_path), special_tokens={})
        self.codes = WordCodes(lambda words: sp.encode(words, num_threads=1), HELD, lambda words: [len(byte_level.encode_ordinary(f" {w}")) for w in words])
        self.is_byte = np.array([sp.is_byte(i) for i in range(sp.get_piece_size())])


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_FIELDS = [*(T.StructField(c, T.LongType()) for c in _COUNTS), T.StructField("base_failed", T.BooleanType()), T.StructField("n_pieces", T.LongType()), T.StructField("chars_per_token", T.DoubleType()), T.StructField("chars_per_byte_token", T.DoubleType()), T.StructField("evenness", T.DoubleType()), T.StructField("byte_share", T.DoubleType()), T.StructField("script", T.StringType())]


def _make(path: str, byte_path: str):
    def make():
        pieces = held(("pieces", path, byte_path), lambda: _Pieces(path, byte_path))

        def one(text: str, words: list[str], numbers: np.ndarray) -> tuple:
            n, chars = len(words), sum(map(len, words))
            again = repeated_words(numbers)
            failed = n < 10 or 100 * again > 20 * n
            ids = pieces.codes.ids(numbers)
            counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
            seen = counts[counts > 0]
            share = seen / max(1, len(ids))
            entropy = float(-(share * np.log2(share)).sum()) + 0.0
            n_bytes = int(counts[pieces.is_byte[: len(counts)]].sum())
            byte_tokens = int(pieces.codes.extra[numbers].sum()) if n else 0
            symbols = len(_SYMBOL.findall(text))
            return n, chars, symbols, duplicate_lines(text), again, failed, len(ids), chars / max(1, len(ids)), chars / max(1, byte_tokens), entropy / float(np.log2(len(ids) + 1)) if len(ids) else 0.0, n_bytes / max(1, len(ids)), script_of(text)

        def work(texts: list[str]) -> list:
            words = [words_of(t) for t in texts]
            return [list(c) for c in zip(*map(one, texts, words, pieces.codes.numbers(words)), strict=True)] or [[] for _ in _FIELDS]

        return work

    return make


def bands(figures: DataFrame) -> dict[str, dict[str, tuple[float, float, float]]]:
    """(low, high, quartile distance) of each banded figure, and of byte_share, by script: from the texts that pass the base rules."""
    quartiles = [F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.75)), F.lit(10_000)).alias(c) for c in (*BANDED, "byte_share")]
    found = {r["script"]: r for r in figures.where("not base_failed").groupBy("script").agg(F.count("*").alias("n"), *quartiles).collect()}  # a row per script
    out: dict[str, dict[str, tuple[float, float, float]]] = {}
    for script, prior in PRIOR.items():
        r = found.get(script)
        n = r["n"] if r else 0
        mix = lambda mine, theirs, n=n: (n * mine + WEIGHT * theirs) / (n + WEIGHT)
        out[script] = {}
        for c, (low, high) in zip(BANDED, prior, strict=False):
            q1, q3 = r[c] if r else (low, high)
            out[script][c] = (mix(q1 - REACH * (q3 - q1), low), mix(q3 + REACH * (q3 - q1), high), mix(q3 - q1, (high - low) / 4))
        q1, q3 = r["byte_share"] if r else (0.0, 0.0)
        out[script]["byte_share"] = (0.0, max(prior.bytes_high, q3 + REACH * (q3 - q1)), 0.0)  # mostly none, so the wider of both
    return out


def outside(by_script: dict[str, dict[str, tuple[float, float, float]]]) -> Column:
    """Whether a row of figures is outside one of its script's bands."""
    slack = SLACK / F.sqrt(F.greatest(F.lit(1.0), F.col("n_pieces") / float(LONG)))
    out = F.lit(False)
    for script, figures in by_script.items():
        beyond = F.lit(False)
        for c, (low, high, wide) in figures.items():
            beyond = beyond | (F.col(c) < low - slack * wide) | (F.col(c) > high + slack * wide)
        out = F.when(F.col("script") == script, beyond).otherwise(out)
    return out


def measure(docs: DataFrame, path: str, byte_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: its id, the base counts, the fertility figures and both verdicts."""
    figures = written(map_texts(docs, text_col, [id_col], _FIELDS, _make(path, byte_path)), "figures")
    kept = ~F.col("base_failed") & ~outside(bands(figures))
    return figures.select(id_col, *_COUNTS, "base_failed", kept.alias("kept"), *[f.name for f in _FIELDS[len(_COUNTS) + 1 :]])


def keep_fertile(docs: DataFrame, path: str, byte_path: str, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns; only rows that pass the base rules are written once between."""
    inside = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs[f"`{text_col}`"].alias("text"))
    figures = written(map_texts(inside, "text", ["row"], _FIELDS, _make(path, byte_path)).where("not base_failed"), "figures")
    return figures.where(~outside(bands(figures))).select("row.*")
