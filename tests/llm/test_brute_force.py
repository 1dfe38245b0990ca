"""The registered queries and the pipeline's stages against plain loops over the small tables."""

import collections
import itertools
import math
import re
from html.parser import HTMLParser

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from curata.llm import fertility, quality, registry, url_filter

D, E = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(spark, folder, name):
    return [r.asDict() for r in spark.read.parquet(f"{folder}/{name}.parquet").collect()]


def test_fertility_query(spark):
    import base64

    import sentencepiece
    import tiktoken

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want, figures = {}, {}
    for r in rows_of(spark, D, "documents"):
        text = r["text"] or ""
        words = WORD.findall(text)
        windows = collections.defaultdict(list)
        for k in range(len(words) - 4):
            windows[tuple(words[k : k + 5])].append(k)
        covered = {k + j for places in windows.values() if len(places) > 1 for k in places for j in range(5)}
        lines, before = 0, set()
        for line in text.split("\n"):
            lines += bool(WORD.search(line)) and line in before
            before.add(line)
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        want[r["doc_id"]] = [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), lines, len(covered), failed]
        ids = [i for w in words for i in sp.encode(w)]
        n, chars = len(ids), want[r["doc_id"]][1]
        counts = collections.Counter(ids)
        entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
        byte_tokens = sum(len(library.encode_ordinary(" " + w)) for w in words)
        figures[r["doc_id"]] = (n, chars / max(1, n), chars / max(1, byte_tokens), entropy / math.log2(n + 1) if n else 0.0, sum(sp.is_byte(i) for i in ids) / max(1, n), fertility.script_of(text))
    bands = {}
    for script, prior in fertility.PRIOR.items():
        mine = [f for i, f in figures.items() if f[5] == script and not want[i][5]]
        m, weight, bands[script] = len(mine), fertility.WEIGHT, []
        for k, (low, high) in enumerate(prior[:3], 1):
            values = sorted(f[k] for f in mine)
            q1, q3 = (values[math.ceil(0.25 * m) - 1], values[math.ceil(0.75 * m) - 1]) if m else (low, high)
            wide = q3 - q1
            bands[script].append([(m * a + weight * b) / (m + weight) for a, b in ((q1 - fertility.REACH * wide, low), (q3 + fertility.REACH * wide, high), (wide, (high - low) / 4))])
        shares = sorted(f[4] for f in mine)
        q1, q3 = (shares[math.ceil(0.25 * m) - 1], shares[math.ceil(0.75 * m) - 1]) if m else (0.0, 0.0)
        bands[script].append([0.0, max(prior.bytes_high, q3 + fertility.REACH * (q3 - q1)), 0.0])
    got = {r["doc_id"]: r for r in registry.op4_fertility_rules(spark, D).collect()}
    assert len(got) == len(want)
    for i, base in want.items():
        n, *values = figures[i][:5]
        slack = fertility.SLACK / math.sqrt(max(1.0, n / fertility.LONG))
        inside = all(lo - slack * w <= v <= hi + slack * w for v, (lo, hi, w) in zip(values, bands[figures[i][5]], strict=True))
        r = got[i]
        assert [r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")] == [*base, not base[5] and inside], i


def test_url_query(spark):
    rules, pages = registry.URL_RULES, rows_of(spark, E, "pages")
    split = {}
    for r in pages:
        rest = r["url"].split("://", 1)[1] if r["url"] and "://" in r["url"] else ""
        host = re.match(r"[^/?#]*", rest)[0]
        split[r["page_id"]] = ("".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0])
    lexicon = collections.Counter({w: 20 for w in (*url_filter.SEED_BLOCK, *url_filter.SEED_ALLOW)})
    for host, path in split.values():
        for piece in [p for p in host.split(".") if "-" in p] + [path.lower()]:
            lexicon.update(w for w in re.findall("[a-zÀ-ɏ]{2,}", piece) if len(w) <= url_filter.LONGEST)
    total = sum(lexicon.values()) + 1.0

    def cut(part):
        best = [(0.0, [])]
        for end in range(1, len(part) + 1):
            ways = []
            for start in range(max(0, end - url_filter.LONGEST), end):
                w = part[start:end]
                cost = -math.log(lexicon[w] / total) if w in lexicon and len(w) > 1 else math.log(total) + 1.0 + math.log(26.0) * len(w)
                ways.append((best[start][0] + cost, [*best[start][1], w]))
            best.append(min(ways, key=lambda x: x[0]))
        return best[-1][1]

    def tokens(host, path):
        for text, mark in ((host, ""), (path, "/")):
            for part in re.findall("[a-z0-9À-ɏ]+", text.lower()):
                yield from (mark + w for w in cut("0" if part.isdigit() else part))

    counts = {v: collections.Counter() for v in ("allow", "block")}
    fits = {}
    for i, (host, path) in split.items():
        mine = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        fits[i] = max(mine, key=lambda r: len(r.host + r.path)) if mine else None
        if mine:
            counts[fits[i].verdict].update(url_filter.cell(t) for t in tokens(host[: len(host) - len(fits[i].host)], path[len(fits[i].path) :]))
    most = max(len(url_filter.SEED_BLOCK), len(url_filter.SEED_ALLOW))
    for v, seeds in (("allow", url_filter.SEED_ALLOW), ("block", url_filter.SEED_BLOCK)):
        for w in seeds:
            counts[v][url_filter.cell(w)] += url_filter.SEED_WEIGHT * most / len(seeds)
            counts[v][url_filter.cell("/" + w)] += url_filter.SEED_WEIGHT / 4 * most / len(seeds)
    seen = set(counts["allow"]) | set(counts["block"])
    size = {v: sum(c.values()) + url_filter.ALPHA * len(seen) for v, c in counts.items()}
    odds = {c: math.log((counts["block"][c] + url_filter.ALPHA) / size["block"]) - math.log((counts["allow"][c] + url_filter.ALPHA) / size["allow"]) for c in seen}
    verdicts = collections.Counter()
    for r in registry.op5_url_filter(spark, E).collect():
        i = r["page_id"]
        assert (r["host"], r["path"]) == split[i]
        assert r["rule"] == (fits[i] and fits[i].name)
        sum_ = url_filter.PRIOR + sum(odds.get(url_filter.cell(t), 0.0) for t in tokens(*split[i]))
        assert abs(r["log_odds"] - sum_) < 1e-9
        assert r["verdict"] == (fits[i].verdict if fits[i] else "block" if sum_ > 0 else "allow")
        verdicts[bool(fits[i]), r["verdict"]] += 1
    assert all(verdicts[ruled, v] for ruled in (True, False) for v in ("allow", "block"))


class Article(HTMLParser):
    """Text of the article's blocks, by the standard parser."""

    INLINE = {"b", "i", "a", "em", "strong", "span", "br", "code", "img", "u", "small", "sub", "sup"}

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.inside, self.skipped, self.parts, self.blocks = 0, 0, [], []
        self.feed(page)
        self.close()
        self.flush()

    def flush(self):
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            self.blocks.append(text)

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append(" ")
        if tag not in self.INLINE:
            self.flush()
        self.inside += tag == "article"
        self.skipped += tag in ("script", "style")

    def handle_endtag(self, tag):
        if tag not in self.INLINE:
            self.flush()
        self.inside -= tag == "article"
        self.skipped -= tag in ("script", "style")

    def handle_data(self, data):
        if self.inside and not self.skipped:
            self.parts.append(data)


def test_article_text_of_pages_with_an_article(spark):
    pages = {r["page_id"]: r["html"] for r in rows_of(spark, E, "pages")}
    rows = registry.op6_tag_path_text(spark, E).collect()
    assert len(rows) == len(pages)
    same = sum(r["text"] == "\n\n".join(Article(pages[r["page_id"]] or "").blocks) for r in rows)
    assert same >= 0.99 * len(rows) and all(r["n_chars"] == len(r["text"]) for r in rows)


def classes(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash_components(spark):
    rows = registry.op8_simhash_near_dedup(spark, E).collect()
    least = {}
    for r in rows:
        fp = int(r["fingerprint"], 16)
        least[fp] = min(least.get(fp, r["doc_id"]), r["doc_id"])
    near = [(least[a], least[b]) for a, b in itertools.combinations(least, 2) if (a ^ b).bit_count() <= 2]
    want = classes(least.values(), near)
    assert all(r["component_id"] == want[least[int(r["fingerprint"], 16)]] for r in rows)


def test_stages_on_their_own_input(spark):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{E}/documents.parquet")
    labels = spark.read.parquet(f"{E}/labels.parquet")
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    good = stages["quality classifier"](spark, docs, E)
    assert good.columns == docs.columns and ids(good) == ids(quality.scores(docs, quality.train(docs, labels)).where("predicted = 1"))
    fertile = stages["quality rules"](spark, good, E)
    measured = fertility.measure(good, P.path("piece_bpe_32k.model"), P.path("byte_bpe_multi_50k.tiktoken"))
    assert fertile.columns == docs.columns and ids(fertile) == ids(measured.where("kept"))
    texts = {r["doc_id"]: r["text"] or "" for r in fertile.collect()}
    sets, holders = {}, collections.defaultdict(list)
    for i, t in texts.items():
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) > 5 else {tuple(words)} if words else set()
        for s in sets[i]:
            holders[s].append(i)
    shared = collections.Counter(pair for held in holders.values() for pair in itertools.combinations(sorted(held), 2))
    links = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    kept = stages["near dedup"](spark, fertile, E)
    assert links and kept.columns == docs.columns and ids(kept) == {i for i, r in classes(texts, links).items() if i == r}


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_odd_rows(spark, empty):
    import corpus_pipeline

    long = "a long text of many different words " + " ".join(f"w{k}" for k in range(4000))
    rows = [(0, None, "en"), (1, "", None), (2, long, "en"), (2, long, "en"), (3, long, "fr"), (None, long, "en"), (None, None, None), (4, "x" * 5000, "en"), (5, " \n\t", "en")]
    docs = spark.createDataFrame([(*r, r[0], "s", 1.0, "k", "t") for r in rows], "doc_id long, text string, lang string, id long, script string, score double, row string, same string")
    docs = docs.limit(0) if empty else docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, D)
        if name != "packing":
            assert out.columns == docs.columns, name
        n = out.count()
        assert n == 0 if empty else n <= docs.count() or name == "packing"
        if name == "near dedup" and not empty:
            assert out.where("doc_id = 2").count() == 1 and out.where("doc_id = 3").count() == 0 and out.where("doc_id is null").count() == 2
        if name == "packing" and not empty:
            assert {r[0] for r in out.select("doc_id").distinct().collect()} == {r[0] for r in rows}


def test_katz_discounts_are_good_turing():
    """Against the textbook's formula, written out."""
    import numpy as np

    from curata.llm import katz

    n = np.array([0, 1000, 400, 200, 120, 80, 60])
    got = katz.discounts(n)
    a = (katz.K + 1) * n[katz.K + 1] / n[1]
    for r in range(1, katz.K + 1):
        star = (r + 1) * n[r + 1] / n[r]
        assert abs(got[r] - (star / r - a) / (1 - a)) < 1e-12
    assert ((katz.discounts(np.zeros(katz.K + 2, int))[1:] > 0) & (katz.discounts(np.zeros(katz.K + 2, int))[1:] < 1)).all()


def test_scores_are_bounded_and_differ_by_text_only(spark):
    docs = spark.createDataFrame([(1, "same text of words", "a"), (2, "same text of words", "b")], "doc_id long, text string, lang string")
    ranker = quality.train(spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet"))
    a, b = quality.scores(docs, ranker).orderBy("doc_id").collect()
    assert a["score"] == b["score"] and 0 <= a["score"] <= 1 and a["predicted"] == int(a["score"] >= 0.7)
    held = quality.scores(spark.read.parquet(f"{D}/documents.parquet"), ranker).select("doc_id", "held_out", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).alias("want"))
    assert held.where("held_out <> want").count() == 0
