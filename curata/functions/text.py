"""Column functions over text: cleaning, folding, estimates, n-grams."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space as Python's str.strip has it, and horizontal white space; runs of blank lines, words broken at line
# ends, control characters, characters that are replaced or dropped, and spans of capitalised words.
_SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
_EDGE = f"^{_SPACE}+|{_SPACE}+$"
_RUN = r"[\t\x0b\f\r\x1c-\x1f\x85\p{Z}]{2,}"
_BLANKS = r"\n[ \t]*\n(?:[ \t]*\n)+"
_HYPHEN = r"(?<=[A-Za-z])-\n(?=[A-Za-z])"
_CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
_REPLACED = ("\u00a0\u2028\u2029\u200b\u200c\u200d\ufeff\u2060", " \n\n")
_SPAN = r"(?U)\b[A-Z][a-z]+(?:[^\S\n]+[A-Z][a-z]+)+\b"


def strip(text: Column) -> Column:
    """Without white space at either end, Unicode white space included."""
    return F.regexp_replace(text, _EDGE, "")


def fold(text: Column) -> Column:
    """Lower case, ASCII letters and digits only: the key of titles and labels."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def fold_label(text: Column) -> Column:
    """Lower case with runs of separators as one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[_ -]+", " "))


def estimate_tokens(text: Column) -> Column:
    """max(1, chars / 4), halves to even."""
    return F.greatest(F.lit(1), F.bround(F.length(text) / F.lit(4.0))).cast("int")


def title_of(subject: Column, exhibit: Column) -> Column:
    """The first of subject and exhibit description that is not blank, else empty; never the file name."""
    return F.coalesce(F.nullif(strip(subject), F.lit("")), F.nullif(strip(exhibit), F.lit("")), F.lit(""))


def hash_or_empty(value: Column) -> Column:
    """A content hash; a missing one, or a word for missing, is empty."""
    v = strip(F.coalesce(value, F.lit("")))
    return F.when(F.lower(v).isin("nan", "none", "<na>"), "").otherwise(v)


def truthy(value: Column) -> Column:
    return ~F.lower(strip(F.coalesce(value.cast("string"), F.lit("")))).isin("", "none", "null", "nan", "false", "0")


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode composition (Spark has no built-in); filter to rows that need it before calling."""
    from unicodedata import normalize

    return text.map(lambda t: normalize("NFC", t), na_action="ignore")


def compose(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with ``text_col`` in NFC.  Only texts with a character beyond U+02FF go to Python: the rest are NFC already."""
    text = F.col(text_col)
    needs = F.coalesce(text.rlike("[\\x{0300}-\\x{10FFFF}]"), F.lit(False))
    return df.withColumn("__odd", F.when(needs, text)).withColumn("__nfc", nfc(F.col("__odd"))).withColumn(text_col, F.coalesce("__nfc", text_col)).drop("__odd", "__nfc")


def _unwrapped(text: Column) -> Column:
    """Line ends, invisible and control characters in order: the text before words broken at line ends are joined."""
    t = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.regexp_replace(F.translate(t, *_REPLACED), _CONTROL, " ")


def _tidy(joined: Column) -> Column:
    """Blank runs, spaces and empty ends of a text whose words are joined."""

    def line(raw: Column) -> Column:
        right = F.regexp_replace(raw, f"{_SPACE}+$", "")
        bare = strip(right)
        return F.when(bare.startswith("|") & bare.endswith("|"), right).otherwise(strip(F.regexp_replace(right, _RUN, " ")))

    lines = F.array_join(F.transform(F.split(F.regexp_replace(joined, _BLANKS, "\n\n"), "\n"), line), "\n")
    return F.regexp_replace(lines, r"^\n+|\n+$", "")


def clean(text: Column) -> Column:
    """Deterministic cleaning of a composed text: line ends, invisible characters, hyphen wraps, blank runs, spaces."""
    return _tidy(F.regexp_replace(_unwrapped(text), _HYPHEN, ""))


def with_clean_stats(df: DataFrame, text_col: str, original_col: str) -> DataFrame:
    """``df`` with cleaned, raw_chars, cleaned_chars, collapsed_blank_runs, hyphen_unwraps and changed for a composed text; each step is worked out once."""
    before, after, cleaned = F.col("__before"), F.col("__after"), F.col("cleaned")
    steps = df.withColumn("__before", _unwrapped(F.col(text_col))).withColumn("__after", F.regexp_replace(before, _HYPHEN, "")).withColumn("cleaned", _tidy(after))
    return steps.withColumns({
        "raw_chars": F.length(original_col),
        "cleaned_chars": F.length(cleaned),
        "collapsed_blank_runs": F.regexp_count(after, F.lit(_BLANKS)),
        "hyphen_unwraps": F.regexp_count(before, F.lit(_HYPHEN)),
        "changed": cleaned != F.col(original_col),
    }).drop("__before", "__after")


def messy(text: Column) -> Column:
    """Empty, a control or replacement character, or under half of the characters word characters."""
    control = text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{FFFD}]")
    share = F.regexp_count(text, F.lit(r"(?U)\w")) / F.greatest(F.length(text), F.lit(1))
    return (strip(text) == "") | control | (share < 0.5)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once: a lambda would compute what it takes from outside at every step."""
    return F.transform(F.array(value), body)[0]


def word_ngrams(text: Column, n: int = 5) -> Column:
    """Distinct n-grams of ASCII words, space-joined; none for fewer than n words."""

    def grams(words: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda k: F.array_join(F.slice(words, k, n), " "))
        return F.when(F.size(words) < n, F.array().cast("array<string>")).otherwise(F.array_distinct(each))

    return _let(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), grams)


def gram_hashes(text: Column, n: int = 5) -> Column:
    """Distinct hashes of ``word_ngrams``: words are hashed once and n of their hashes make one long."""

    def grams(words: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda k: F.xxhash64(F.slice(words, k, n)))
        return F.when(F.size(words) < n, F.array().cast("array<bigint>")).otherwise(F.array_distinct(each))

    return _let(F.transform(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.xxhash64(w)), grams)


def folded_space(text: Column) -> Column:
    """Lower case with runs of white space as one blank."""
    return F.regexp_replace(F.lower(text), f"{_SPACE}+", " ")


def char_ngrams(text: Column, n: int = 4) -> Column:
    """Distinct character n-grams of the lower-cased text with white space collapsed; blanks at the ends count."""

    def grams(letters: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(letters) - n + 1), lambda k: F.array_join(F.slice(letters, k, n), ""))
        return F.when(F.size(letters) < n, F.array().cast("array<string>")).otherwise(F.array_distinct(each))

    return _let(F.split(folded_space(text), ""), grams)


def proper_nouns(text: Column) -> Column:
    """Distinct spans of two or more capitalised words on one line."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(_SPAN), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard index of two arrays; 0 if either is empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


def cue_present(text: Column, cue: Column | str) -> Column:
    """Whether a cue occurs: blank never; long or spaced cues anywhere, others between word boundaries at word characters."""
    low, c = F.lower(text), F.lower(strip(F.lit(cue) if isinstance(cue, str) else cue))
    left = F.when(c.rlike(r"(?U)^\w"), r"(?<!\w)").otherwise("")
    right = F.when(c.rlike(r"(?U)\w$"), r"(?!\w)").otherwise("")
    quoted = F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    bounded = F.rlike(low, F.concat(F.lit("(?U)"), left, quoted, right))
    return F.when(c == "", False).when((F.length(c) > 24) | c.rlike(_SPACE), F.contains(low, c)).otherwise(bounded)
