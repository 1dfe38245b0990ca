"""Document fingerprints by invertible Bloom lookup sketches, in DataFrame functions only.

A text is the set of the XXH64 digests of its paragraphs: lines, cut after clause punctuation so that a long line does not
stand or fall as one.  A sketch has cells of (count, xor of digests, xor of check sums) in three thirds; each digest goes to
one cell in each third.  Two versions' sketches are subtracted cell by cell; what both hold cancels, and peeling recovers the
digests that differ: a cell with count 1 or -1 and a right check sum gives one, which is taken out of its cells in the other
thirds, and so on.  If cells are left the sketch was too small, and it is built anew with twice the cells and other hashes,
until nothing is left.

Cells are rows: digests are exploded, and a sketch, a subtraction and a step of peeling are one aggregation by cell, so the
work grows in proportion to the digests, in code that Spark compiles.  A step peels one third, where no two cells hold the
same digest.  Rows stay where the window over the ids put their text, so only texts are shuffled, and what was tried once,
with the digests of the few documents that need another try.

The sketches that are compared have ``LOAD`` cells a third for each digest of both sides.  The fingerprint column is one
sketch of ``FIXED`` cells over all digests, in hexadecimal: a digest of the text that the likenesses do not use.  The
likeness of two sets is their Jaccard index, from the sizes and the number of recovered digests; two empty sets are alike (1).

Edge cases: a null or empty text has no paragraphs and the all-zero fingerprint; repeated paragraphs count once; null ids
come first; rows of equal id are ordered by their text; a table of one row follows itself; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curata.llm.shared import written

#: Cells of a third for each digest, and at least; steps of peeling of a try; cells of the fingerprint.
LOAD, LEAST, STEPS, FIXED = 0.7, 24, 10, 12

#: Ids of a run (a run of over four times as many rows is cut), rows that may be broadcast, and partitions of texts for each
#: usual shuffle partition: the cells of a text take about ten times the text's bytes.
RUN, BROADCAST, SPREAD = 256, 500_000, 8


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def paragraphs(text: Column) -> Column:
    """The distinct digests of a text's paragraphs: array<long>."""
    pieces = F.filter(F.split(text, r"\n+|(?<=[.!?;:,|])\s+"), lambda u: F.trim(u) != "")
    return F.array_distinct(F.transform(pieces, lambda u: F.xxhash64(u)))


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(7))


def _cell(digest: Column, t: Column, third: Column, attempt: int) -> Column:
    """The digest's cell in third ``t`` of ``third`` cells."""
    return t * third + F.pmod(F.xxhash64(digest, t + 3 * attempt), third)


def _summed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of equal place as one: counts added, digests and check sums combined by xor; empty cells go."""
    cells = rows.groupBy(*keys, "pair", "third", "cell").agg(F.sum("c").alias("c"), F.bit_xor("k").alias("k"), F.bit_xor("x").alias("x"))
    return cells.where("c <> 0 or k <> 0 or x <> 0")


def differences(sets: DataFrame, keys: list[str], pairs: dict[str, tuple[str, str]], attempt: int = 0) -> DataFrame:
    """The cells of the subtracted sketches of each pair of digest-set columns: (keys, pair, third, cell, c, k, x)."""
    columns = list(dict.fromkeys(c for pair in pairs.values() for c in pair))
    thirds = [F.greatest(F.lit(LEAST), F.ceil((F.size(a) + F.size(b)) * F.lit(LOAD))).cast("long") * (1 << attempt) for a, b in pairs.values()]
    ends = [sum((F.size(c) for c in columns[: k + 1]), F.lit(0)) for k in range(len(columns))]
    listed = sets.select(*keys, F.array(*thirds).alias("thirds"), *[e.alias(f"end{k}") for k, e in enumerate(ends)], F.posexplode(F.concat(*columns)).alias("pos", "k"))
    # What a digest of each column is added to (even numbers) or subtracted from (odd numbers): pair and third.
    parts = F.array().cast("array<int>")
    for k in reversed(range(len(columns))):
        codes = [6 * p + 2 * t + (pair[1] == columns[k]) for p, pair in enumerate(pairs.values()) if columns[k] in pair for t in range(3)]
        parts = F.when(F.col("pos") < F.col(f"end{k}"), F.array(*[F.lit(c) for c in codes])).otherwise(parts)
    code = F.col("code")
    rows = listed.select(*keys, "thirds", "k", F.explode(parts).alias("code")).select(*keys, F.floor(code / 6).cast("int").alias("pair"), "thirds", "k", (F.floor(code / 2) % 3).cast("int").alias("t"), (1 - 2 * (code % 2)).cast("long").alias("c"))
    rows = rows.withColumn("third", F.get("thirds", F.col("pair")))
    return _summed(rows.select(*keys, "pair", "third", _cell(F.col("k"), F.col("t"), F.col("third"), attempt).alias("cell"), "c", "k", _check(F.col("k")).alias("x")), keys)


def peel(cells: DataFrame, keys: list[str], attempt: int = 0, steps: int = STEPS) -> DataFrame:
    """What is left of ``differences`` after peeling, and under cell -1 the number (c) of digests recovered from a pair."""
    c, k, third = F.col("c"), F.col("k"), F.col("third")
    for step in range(steps):
        t, others = step % 3, [x for x in range(3) if x != step % 3]
        pure = (F.abs(c) == 1) & (F.col("x") == _check(k)) & (F.col("cell") == _cell(k, F.lit(t), third, attempt))
        # 9 is the cell itself, 8 the tally; a pure cell goes, and its digest leaves its other two cells.
        moved = cells.select("*", F.explode(F.when(pure, F.array(F.lit(8), *map(F.lit, others))).otherwise(F.array(F.lit(9)))).alias("code"))
        code, tally, own = F.col("code"), F.col("code") == 8, F.col("code") == 9
        rows = moved.select(
            *keys, "pair", "third",
            F.when(own, F.col("cell")).when(tally, -1).otherwise(_cell(k, code, third, attempt)).alias("cell"),
            F.when(own, c).when(tally, 1).otherwise(-c).alias("c"), F.when(tally, 0).otherwise(k).alias("k"), F.when(tally, 0).otherwise(F.col("x")).alias("x"),
        )
        cells = _summed(rows, keys)
    return cells


def _tried(sets: DataFrame, keys: list[str], pairs: dict[str, tuple[str, str]], attempt: int) -> DataFrame:
    """Per document and pair p: n<p>, the digests recovered, and left<p>, the cells that peeling left (0: all recovered)."""
    cells = peel(differences(sets, keys, pairs, attempt), keys, attempt, STEPS + 3 * attempt)
    sums = [(p, F.col("pair") == p) for p in range(len(pairs))]
    return cells.groupBy(*keys).agg(*[F.sum(F.when(own & (F.col("cell") < 0), F.col("c"))).alias(f"n{p}") for p, own in sums], *[F.count_if(own & (F.col("cell") >= 0)).alias(f"left{p}") for p, own in sums])


def with_likeness(sets: DataFrame, keys: list[str], pairs: dict[str, tuple[str, str]], also: dict[str, Column]) -> DataFrame:
    """``sets`` without its digest-set columns, with the Jaccard index of each named pair of them, and what ``also`` makes of them; ``keys`` tell rows apart."""
    columns = list(dict.fromkeys(c for pair in pairs.values() for c in pair))
    ps = range(len(pairs))
    failed = F.greatest(*[F.col(f"left{p}") for p in ps], F.lit(0)) > 0
    found = sets.join(_tried(sets, keys, pairs, 0), keys, "left")
    rest = [c for c in sets.columns if c not in columns]
    held = [F.when(failed, F.col(c)).alias(c) for c in columns]
    sizes = [F.size(c).alias(f"size_{c}") for c in columns]
    tried = written(found.select(*rest, *[v.alias(name) for name, v in also.items()], *sizes, *[F.coalesce(f"n{p}", F.lit(0)).alias(f"n{p}") for p in ps], *[F.coalesce(f"left{p}", F.lit(0)).alias(f"left{p}") for p in ps], *held), "tried")
    again, settled, attempt = tried.where(failed).select(*keys, *columns, *[f"{x}{p}" for x in ("n", "left") for p in ps]), None, 0
    while not again.isEmpty():
        attempt += 1
        new = _tried(again.select(*keys, *columns).repartition(*keys), keys, pairs, attempt).select(*keys, *[F.col(f"{x}{p}").alias(f"new_{x}{p}") for x in ("n", "left") for p in ps])
        joined = again.join(new, keys, "left")
        better = [F.when(F.col(f"left{p}") == 0, F.col(f"{x}{p}")).otherwise(F.coalesce(f"new_{x}{p}", F.lit(0))).alias(f"{x}{p}") for x in ("n", "left") for p in ps]
        again = written(joined.select(*keys, *columns, *better), "again")
        done = again.where(~failed).select(*keys, *[F.col(f"n{p}").alias(f"later{p}") for p in ps])
        settled = done if settled is None else settled.unionByName(done)
        again = again.where(failed)
    if settled is not None:
        few = F.broadcast(settled) if settled.count() <= BROADCAST else settled
        tried = tried.join(few, keys, "left").withColumns({f"n{p}": F.coalesce(f"later{p}", f"n{p}") for p in ps})

    def index(p: int, a: str, b: str) -> Column:
        both = F.col(f"size_{a}") + F.col(f"size_{b}")
        return F.when(both == 0, 1.0).otherwise((both - F.col(f"n{p}")) / (both + F.col(f"n{p}")).cast("double"))

    return tried.select(*rest, *also, *[index(p, *pair).alias(name) for p, (name, pair) in enumerate(pairs.items())])


def fingerprint(digests: Column) -> Column:
    """The sketch of FIXED cells of a digest set, in hexadecimal."""
    third = FIXED // 3
    placed = F.transform(digests, lambda d: F.struct(d.alias("k"), _check(d).alias("x"), *[F.pmod(F.xxhash64(d, F.lit(t)), F.lit(third)).cast("int").alias(f"at{t}") for t in range(3)]))
    xor = lambda m, f: F.aggregate(m, F.lit(0).cast("long"), lambda a, e: a.bitwiseXOR(e[f]))
    text = lambda m: F.concat(F.lpad(F.hex(F.size(m)), 8, "0"), F.lpad(F.hex(xor(m, "k")), 16, "0"), F.lpad(F.hex(xor(m, "x")), 16, "0"))
    part = lambda all_, t: F.transform(F.sequence(F.lit(0), F.lit(third - 1)), lambda j: _let(F.filter(all_, lambda e: e[f"at{t}"] == j), text))
    return F.array_join(_let(placed, lambda p: F.concat(*[part(p, t) for t in range(3)])), "")


def _runs(rows: DataFrame) -> DataFrame:
    """(run, slice, first, before_run, before_slice): each run of (run, slice, key) with its first key and the run before it; the last is before the first.

    Runs are dealt by range, so a window orders one range's runs; only the ranges' ends, one row per range, are looked at as one.
    """
    held = rows.groupBy("run", "slice").agg(F.min("key").alias("first"))
    ranged = written(held.repartitionByRange("run", "slice").withColumn("range", F.spark_partition_id()), "runs")
    here = F.struct("run", "slice")
    ends = ranged.groupBy("range").agg(F.max(here).alias("end"))
    ends = ends.select("range", F.lag("end").over(Window.orderBy("range")).alias("end"), F.max("end").over(Window.partitionBy()).alias("last"))
    inside = ranged.withColumn("inside", F.lag(here).over(Window.partitionBy("range").orderBy("run", "slice")))
    before = F.coalesce("inside", "end", "last")
    return written(inside.join(F.broadcast(ends), "range").select("run", "slice", "first", before["run"].alias("before_run"), before["slice"].alias("before_slice")), "ordered")


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(at, part, row, id, text, next_text): each row with the text that follows by id; the first follows the last.

    Rows are grouped in runs of RUN ids, so no task sorts the whole table; a run of more rows (null or repeated ids) is cut
    by id and hash of the text.  The first row of a run also goes to the run before it.
    """
    key = F.coalesce("id", F.lit(-(1 << 63)))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).withColumn("key", key)
    run = F.shiftright("key", RUN.bit_length() - 1)
    crowded = written(rows.groupBy(run.alias("run")).count().where(F.col("count") > 4 * RUN).select("run", F.lit(True).alias("crowded")), "crowded")
    n = crowded.count()
    marked = rows.withColumn("run", run).withColumn("slice", F.lit(0).cast("long"))
    if n:
        cut = F.col("key").bitwiseAND(F.lit(RUN - 1)) * (1 << 20) + F.shiftright(F.xxhash64("text"), 44) + (1 << 19)
        marked = marked.join(F.broadcast(crowded) if n <= BROADCAST else crowded, "run", "left").withColumn("slice", F.when(F.col("crowded"), cut).otherwise(F.col("slice"))).drop("crowded")
    order = ("key", F.col("missing").desc(), F.xxhash64("text"), "text")
    table = _runs(marked.select("run", "slice", "key"))
    runs = table.count()
    joined = marked.join(F.broadcast(table) if runs <= BROADCAST else table, ["run", "slice"])
    own = F.struct(F.col("run").alias("at"), F.col("slice").alias("part"), F.lit(True).alias("own"))
    again = F.struct(F.col("before_run").alias("at"), F.col("before_slice").alias("part"), F.lit(False).alias("own"))
    first = F.col("key") == F.col("first")
    # Only what orders the rows is carried along, so all that is made of them shares one shuffle.
    placed = joined.select("key", F.col("id").isNull().alias("missing"), "text", F.explode(F.when(first, F.array(own, again)).otherwise(F.array(own))).alias("p")).select("key", "missing", "text", "p.*")
    usual = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Both are known; said here, for else a join by them adds the condition on one side only, which then has a shuffle of its own.
    placed = placed.where("at is not null and part is not null").repartition(max(usual, min(runs, SPREAD * usual)), "at", "part")
    window = Window.partitionBy("at", "part").orderBy(F.col("own").desc(), *order)
    return placed.withColumn("next_text", F.lead("text").over(window)).withColumn("row", F.row_number().over(window)).where("own").select("at", "part", "row", F.when(~F.col("missing"), F.col("key")).alias("id"), "text", "next_text")


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_chars, edited_sha256, both fingerprints, and their likeness to the edited and the next text.

    The edited text has its last half of code points replaced by as many (or all) of the next text's first.
    """
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    texts = with_next(docs, id_col, text_col).select("at", "part", "row", "id", "text", "next_text", n.cast("long").alias("n_chars"), edited.alias("edited"))
    sets = texts.select("at", "part", "row", "id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), paragraphs(F.col("text")).alias("a"), paragraphs(F.col("edited")).alias("b"), paragraphs(F.col("next_text")).alias("c"))
    prints = {"fingerprint": fingerprint(F.col("a")), "edited_fingerprint": fingerprint(F.col("b"))}
    liked = with_likeness(sets, ["at", "part", "row"], {"near_edited": ("a", "b"), "near_next": ("a", "c")}, prints)
    return liked.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
