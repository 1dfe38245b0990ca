"""Sources: split folders, JSON lines with comments, pools by suffix, content revisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A folder or file by suffix: .jsonl (with a schema, else inferred), .csv, else Parquet; other suffixes raise."""
    suffix = path.rstrip("/").rsplit("/", 1)[-1].rpartition(".")[2].lower() if "." in path.rstrip("/").rsplit("/", 1)[-1] else ""
    if suffix == "csv":
        return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if suffix == "jsonl":
        return read_jsonl(spark, path, schema) if schema else spark.read.json(path)
    if suffix not in ("", "parquet", "pq"):
        raise ValueError(f"unknown suffix {suffix}")
    return spark.read.parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def parquet_under(spark: SparkSession, root: str, names: list[str] = ()) -> DataFrame:
    """All Parquet files under the named folders of a root, or under the root, as one."""
    found = [p for p in (f"{root}/{n}" for n in names) if exists(spark, p)] if names else [root]
    if not found:
        raise FileNotFoundError(f"none of {list(names)} under {root}")
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").option("mergeSchema", True).parquet(*found)


def read_config(spark: SparkSession, root: str, config: str, splits: list[str]) -> DataFrame:
    """The splits of a config of a staged tree (root/data/config/split); splits that are not there are left out."""
    return read_splits(spark, f"{root}/data/{config}", [s for s in splits if exists(spark, f"{root}/data/{config}/{s}")])


def read_training(spark: SparkSession, root: str, split: str) -> DataFrame:
    """What training and its test read: windows for train and validation, whole documents for test."""
    return read_config(spark, root, "documents" if split == "test" else "windows", [split])


def eval_documents(spark: SparkSession, root: str, subset: str, corpus: DataFrame, plus: DataFrame | None = None) -> DataFrame:
    """Documents to evaluate: a staged split if it is there, else the corpus's; train means train and validation.

    ``heldout-plus`` is the corpus's test split and the extension, on the columns they share; common file names raise.
    """
    from curata.operators.report import check_disjoint

    if subset in ("test", "validation"):
        if exists(spark, f"{root}/data/documents/{subset}"):
            return read_config(spark, root, "documents", [subset])
        return corpus.where(F.col("split") == subset)
    if subset == "train":
        return corpus.where(F.col("split").isin("train", "validation"))
    if subset == "heldout-plus":
        if plus is None:
            raise FileNotFoundError("the extension is not there")
        test = corpus.where("split = 'test'")
        check_disjoint(test, plus)
        shared = [c for c in test.columns if c in plus.columns]
        return test.select(*shared).unionByName(plus.select(*shared))
    return corpus


def resolve_pool(spark: SparkSession, name: str, snapshots: str) -> tuple[str, str]:
    """(path, revision) of a pool: ``repo@rev`` is a snapshot under a folder of snapshots, anything else a path, whose revision is that of its content."""
    repo, at, rev = name.rpartition("@")
    if at and not exists(spark, name):
        path = f"{snapshots}/{repo}/{rev}"
        if not exists(spark, path):
            raise FileNotFoundError(f"no snapshot of {repo} at {rev}")
        return path, rev
    if not exists(spark, name):
        raise FileNotFoundError(name)
    return name, revision(spark, name)


def read_mail(spark: SparkSession, root: str) -> DataFrame:
    """Mail pool: labels inner-joined with their texts by file name."""
    labels, texts = parquet_under(spark, root, ["ground_truth"]), parquet_under(spark, root, ["default", "blind"])
    return labels.join(texts.select(*[c for c in ("filename", "text", "subject") if c in texts.columns]).withColumnRenamed("text", "doc_text"), "filename")


def read_claims(spark: SparkSession, root: str) -> DataFrame:
    """Nested claims: the text of all context documents, named by the claim."""
    rows = parquet_under(spark, root)
    texts = F.transform("data.contextDocuments", lambda d: F.coalesce(d["extractedDocumentContent"], F.lit("")))
    claim = F.col("data.claim.claimId").cast("string")
    name = F.coalesce(claim, F.col("id").cast("string")) if "id" in rows.columns else claim
    return rows.select(F.concat(F.lit("property:"), name, F.lit(".txt")).alias("filename"), F.trim(F.concat_ws("\n\n", texts)).alias("doc_text"), name.alias("claim_id"))


def read_register(spark: SparkSession, root: str) -> DataFrame:
    """A tabular register: rows named by their claim, without texts, so they have to be rendered first."""
    return parquet_under(spark, root).withColumn("filename", F.concat(F.lit("auto:"), F.col("claim_id").cast("string"), F.lit(".txt")))


def read_narratives(spark: SparkSession, path: str) -> DataFrame:
    """CSV narratives, named by their index."""
    rows = read_table(spark, path)
    text = rows.withColumn("doc_text", F.col("claim_narrative")) if "claim_narrative" in rows.columns else rows
    return text.withColumn("filename", F.concat(F.lit("insurbias:"), F.col("index").cast("string"), F.lit(".txt"))) if "index" in rows.columns else text


def read_rendered(spark: SparkSession, root: str, schema: T.StructType | str) -> DataFrame:
    """Rendered claims: train.jsonl only, for the other file is held out."""
    return read_jsonl(spark, f"{root}/train.jsonl", schema)


def read_splits(spark: SparkSession, root: str, splits: list[str]) -> DataFrame:
    """Parquet folders by split; ``split`` comes from the folder where the files have none."""
    out = None
    for split in splits:
        df = spark.read.option("recursiveFileLookup", True).parquet(f"{root}/{split}")
        df = df if "split" in df.columns else df.withColumn("split", F.lit(split))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines without blank lines and lines that begin with #; lines that are not JSON are left out."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))
    return lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r")).where("r is not null").select("r.*")


def promote(df: DataFrame, column: str, fields: list[str]) -> DataFrame:
    """Fields of a JSON object as columns; a column that exists already wins."""
    parsed = F.from_json(F.col(column), "map<string,string>")
    return df.select("*", *[F.try_element_at(parsed, F.lit(f)).alias(f) for f in fields if f not in df.columns])


def nested(value: Column, path: str) -> Column:
    """A field of a JSON text by dotted path; null where the text does not parse."""
    return F.try_variant_get(F.try_parse_json(value), f"$.{path}", "string")


def nested_texts(df: DataFrame, column: str, field: str = "text") -> DataFrame:
    """doc_text from an array of nested documents, joined by an empty line."""
    return df.withColumn("doc_text", F.concat_ws("\n\n", F.transform(column, lambda d: d[field])))


def without_shards(df: DataFrame, prefix: str = "enrichment") -> DataFrame:
    """Rows of files that are neither named by a prefix nor in a folder named so (call directly on a file source)."""
    return df.where(~F.col("_metadata.file_path").rlike(f"/{prefix}[-/][^/]*$"))


def revision(spark: SparkSession, path: str) -> str:
    """Content revision of a folder: hash of its files' hashes in order of name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    hashed = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("h"))
    return hashed.agg(F.sha2(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("name", "h"))), lambda x: F.concat_ws(" ", x["name"], x["h"]))), 256).alias("r")).first()["r"]
