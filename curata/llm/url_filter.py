"""URL filters: longest-prefix rules, then naive Bayes over segmented host and path tokens.

A host is cut at dots and hyphens; each part is segmented into words by unigram Viterbi.  The word counts come from the
whole table: path words, and the parts of hyphenated host labels, so that ``cheap-pills`` teaches the words that split
``cheappills``; other host labels may be concatenations themselves and teach nothing.  Multinomial naive Bayes scores the segmented host words and the path words.

Training rows are the pages whose url a rule decides (the rule gives the label; the tokens that the rule itself tests are
left out, or every rule would only learn itself).  All counts are aggregated over the whole table, partially before the
shuffle, and taken as they are with ``ALPHA`` added to each token; a token of no training page has no say.  A list of seed
words per class counts like a few tokens each, so it speaks where there are no or few pages and gives way to many.

The lexicon is a written table of all words of up to ``LONGEST`` letters; each distinct part is joined to those of its
substrings that are words, so its cut does not depend on a bound of the lexicon.  Other strings are spelled by a length-based
letter model, so every host is segmented.

Bounds: naive Bayes counts live in 2**16 hashed cells, a fixed size whatever the input, which is what is sent to the executors.

Edge cases: a null url, or one without ``://``, has an empty host and path and is judged by the class prior; ties in rule
length go to the first rule; equal class scores allow; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.llm.shared import written


class Rule(NamedTuple):
    """A rule for a host, all its subdomains, and the paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Cells of naive Bayes, longest word of the lexicon, distinct parts that may be broadcast.
CELLS, LONGEST, BROADCAST = 1 << 16, 24, 1_000_000

#: Added to each token's count, tokens that a seed word of a host counts for, log-odds of block before any token.
ALPHA, SEED_WEIGHT, PRIOR = 1.0, 10.0, -2.0

#: Seed words: what names of unwanted and of wanted sites are often made of.
SEED_BLOCK = "adult bet bets bonus buy casino cheap cialis coupon crack deals drugs escort farm free gambling keygen loan loans lottery meds nude payday pharmacy pill pills poker porn replica rich sale sex slots spam viagra warez weight win xxx".split()
SEED_ALLOW = "academy archive art articles blog book books city club community culture docs edu forum garden guide health help history home journal kids learn library local mail media museum music news page paper photo press project research school science shop site society sport story studio support team tech travel university weather wiki world".split()


def host_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased (A-Z) host and path of a url; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lowered, F.lit("")), F.coalesce(path, F.lit(""))


def rule_index(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The place in ``rules`` of the longest fitting rule, or null."""
    out = F.lit(None).cast("int")
    for k in sorted(range(len(rules)), key=lambda k: (len(rules[k].name), -k)):  # the longest is the outermost case
        r = rules[k]
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(k)).otherwise(out)
    return out


_PART = re.compile(r"[a-z0-9À-ɏ]+")


def parts_of(text: str) -> list[str]:
    """Runs of letters and digits, lower-cased; digits count as one class of token."""
    return ["0" if x.isdigit() else x for x in _PART.findall(text.lower())]


class Segmenter:
    """Unigram Viterbi over a lexicon of word counts."""

    def __init__(self, counts: dict[str, int], total: int | None = None) -> None:
        total = (sum(counts.values()) if total is None else total) + 1.0
        self.cost = {w: -math.log(n / total) for w, n in counts.items() if len(w) <= LONGEST}
        self.base, self.letter = math.log(total) + 1.0, math.log(26.0)
        self.known: dict[str, list[str]] = {}

    def split(self, part: str) -> list[str]:
        """The cheapest cut of a part; a stretch outside the lexicon pays once, and again for each letter."""
        if part in self.known:
            return self.known[part]
        n = len(part)
        best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
        for end in range(1, n + 1):
            for start in range(max(0, end - LONGEST), end):
                word = part[start:end]
                cost = best[start] + self.cost.get(word, self.base + self.letter * (end - start))
                if cost < best[end]:
                    best[end], back[end] = cost, start
        out, end = [], n
        while end:
            out.append(part[back[end] : end])
            end = back[end]
        if len(self.known) > 100_000:
            self.known.clear()
        self.known[part] = out[::-1]
        return self.known[part]


def cell(token: str) -> int:
    return zlib.crc32(token.encode()) % CELLS


def lexicon(urls: DataFrame) -> DataFrame:
    """(w, n): counts of the words of all paths and hyphenated host labels, and of the seed words."""
    marked = F.array_join(F.regexp_extract_all(F.lower("host"), F.lit(r"[^.]*-[^.]*"), F.lit(0)), " ")
    words = urls.select(F.explode(F.regexp_extract_all(F.concat_ws(" ", marked, F.lower("path")), F.lit(r"[a-z\u00c0-\u024f]{2,}"), F.lit(0))).alias("w"), F.lit(1).alias("n"))
    seeds = urls.sparkSession.createDataFrame([(w, 20) for w in dict.fromkeys([*SEED_BLOCK, *SEED_ALLOW])], "w string, n int")
    return words.where(F.length("w") <= LONGEST).unionByName(seeds).groupBy("w").agg(F.sum("n").alias("n"))


def parts_in(host: str, path: str, without: Rule | None = None) -> list[tuple[str, bool]]:
    """Host parts and path parts (marked), less what ``without`` tests."""
    if without is not None:
        host = host[: len(host) - len(without.host)]
        path = path[len(without.path) :]
    return [(p, False) for p in parts_of(host)] + [(p, True) for p in parts_of(path)]


def segmented(parts: DataFrame, words: DataFrame) -> DataFrame:
    """(part, words): the cut of each of the distinct parts by the words of (w, n) among its substrings."""
    total = int(words.agg(F.sum("n")).first()[0])

    def substrings(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                found = [(p, w) for p in batch.column(0).slice(lo, 1000).to_pylist() for w in {p[k:end] for k in range(len(p)) for end in range(k + 2, min(len(p), k + LONGEST) + 1)}]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in range(2)], names=["part", "w"])

    def cut(batches):
        for batch in batches:
            out = [Segmenter({x["w"]: x["n"] for x in held or ()}, total).split(p) for p, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], names=["part", "words"])

    held = parts.mapInArrow(substrings, "part string, w string").join(words, "w").groupBy("part").agg(F.collect_list(F.struct("w", "n")).alias("held"))
    return parts.join(held, "part", "left").select("part", "held").mapInArrow(cut, "part string, words array<string>")


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row of ``pages``: its id, host, path, the rule that fits (else null), verdict and the log-odds of block."""
    host, path = host_path(pages[f"`{url_col}`"].cast("string"))
    urls = pages.select(pages[f"`{id_col}`"].alias("id"), host.alias("host"), path.alias("path")).withColumn("rule_at", rule_index(F.col("host"), F.col("path"), rules))

    def counted(batches):
        counts: dict[tuple, int] = {}
        for batch in batches:
            for h, p, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for part in parts_in(h, p, rules[k]):
                    key = (rules[k].verdict == "block", *part)
                    counts[key] = counts.get(key, 0) + 1
        kinds = (pa.bool_(), pa.string(), pa.bool_())
        yield pa.RecordBatch.from_arrays([*(pa.array([x[k] for x in counts], kind) for k, kind in enumerate(kinds)), pa.array(list(counts.values()), pa.int64())], names=["block", "part", "in_path", "n"])

    def dealt(batches):
        for batch in batches:
            found = [(h, p, *part) for h, p in zip(*(c.to_pylist() for c in batch.columns), strict=True) for part in parts_in(h, p)]
            kinds = (pa.string(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)], names=["host", "path", "part", "in_path"])

    trained = written(urls.where("rule_at is not null").select("host", "path", "rule_at").mapInArrow(counted, "block boolean, part string, in_path boolean, n long").groupBy("block", "part", "in_path").agg(F.sum("n").alias("n")), "trained")
    placed = written(urls.select("host", "path").distinct().mapInArrow(dealt, "host string, path string, part string, in_path boolean"), "placed")
    parts = written(placed.select("part").unionByName(trained.select("part")).distinct(), "parts")
    split = written(segmented(parts, written(lexicon(urls), "lexicon")), "split")
    token = F.concat(F.when(F.col("in_path"), "/").otherwise(""), F.col("w"))
    cells = trained.join(split, "part").select("block", "in_path", "n", F.explode("words").alias("w")).select("block", (F.crc32(F.encode(token, "utf-8")) % CELLS).cast("int").alias("cell"), "n")
    table = np.full((2, CELLS), 0.0)
    for r in cells.groupBy("block", "cell").agg(F.sum("n").alias("n")).collect():  # at most 2 * CELLS rows
        table[int(r["block"]), r["cell"]] += r["n"]
    most = max(len(SEED_ALLOW), len(SEED_BLOCK))
    for k, words in enumerate((SEED_ALLOW, SEED_BLOCK)):
        for w in words:  # both lists weigh the same
            table[k, cell(w)] += SEED_WEIGHT * most / len(words)
            table[k, cell(f"/{w}")] += SEED_WEIGHT / 4 * most / len(words)
    seen = table.sum(0) > 0
    share = (table + ALPHA) / (table.sum(1, keepdims=True) + ALPHA * seen.sum())
    log_odds = np.where(seen, np.log(share[1]) - np.log(share[0]), 0.0)

    def scored(batches):
        for batch in batches:
            lists = batch.column(1).to_pylist()
            sums = [[float(sum(log_odds[cell(mark + w)] for w in words)) for words in lists] for mark in ("", "/")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.float64()) for x in sums)], names=["part", "as_host", "as_path"])

    scores = split.mapInArrow(scored, "part string, as_host double, as_path double")
    few = F.broadcast(scores) if parts.count() <= BROADCAST else scores
    each = placed.join(few, "part").select("host", "path", F.when(F.col("in_path"), F.col("as_path")).otherwise(F.col("as_host")).alias("s"))
    summed = F.aggregate(F.array_sort(F.collect_list("s")), F.lit(PRIOR), lambda x, y: x + y)  # in one order, so the same each time
    urls = urls.join(each.groupBy("host", "path").agg(summed.alias("odds")), ["host", "path"], "left").withColumn("log_odds", F.coalesce("odds", F.lit(PRIOR)))
    named = F.element_at(F.array(*[F.lit(r.name) for r in rules]), F.col("rule_at") + 1) if rules else F.lit(None).cast("string")
    fixed = F.element_at(F.array(*[F.lit(r.verdict) for r in rules]), F.col("rule_at") + 1) if rules else F.lit(None).cast("string")
    at = F.col("rule_at").isNotNull()
    return urls.select(F.col("id").alias(id_col), "host", "path", F.when(at, named).alias("rule"), F.when(at, fixed).otherwise(F.when(F.col("log_odds") > 0, "block").otherwise("allow")).alias("verdict"), "log_odds")
