"""Document sources: recursive file scans, chunk files, label files and manifests, with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.functions import text as X

SUFFIXES = [".epub", ".pdf", ".html", ".htm", ".md", ".markdown"]

_META = "struct<book:string,book_title:string,chapter:string,chapter_title:string,section:string,heading_path:string,chunk_type:string>"
CHUNK_FILE = f"parents array<struct<parent_id:string,text:string,metadata:{_META}>>, children array<struct<child_id:string,parent_id:string,text:string,context_text:string,metadata:{_META}>>"
GOLDEN = "query string, positive_child_ids array<string>, hard_negative_child_ids array<string>, domain string, book string, heading_path string, source_text string, original_query string, archetype string, relevance_grades map<string,int>"
MANIFEST = T.StructType([T.StructField("books", T.MapType(T.StringType(), T.StructType([T.StructField(n, T.StringType()) for n in ("title", "domain", "rerank_input")])))])


def scan_files(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """(path, slug, domain, suffix, content) of the documents under a folder; domain is the first folder below it, else ``general``."""
    root = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    below = F.regexp_replace(F.regexp_extract("path", _below(root), 1), "%20", " ")
    rows = files.select("path", *[c.alias(n) for n, c in X.place(below).items()], *(["content"] if content else []))
    return rows.where(F.col("suffix").isin(SUFFIXES))


def _below(root: str) -> str:
    import re

    tail = root.split("/")[-1]
    return "/" + re.escape(tail).replace(r"\-", "-") + "/(.*)$"


def first_of_slug(files: DataFrame) -> DataFrame:
    """Of files with the same slug the first by path."""
    best = files.groupBy("slug").agg(F.min("path").alias("path"))
    return files.join(best, ["slug", "path"])


def read_chunks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Parents and children of chunk files, one JSON object each."""
    rows = spark.read.schema(CHUNK_FILE).json(path, multiLine=True)
    parents = rows.select(F.posexplode("parents").alias("ord", "p")).select("p.*", "ord")
    children = rows.select(F.posexplode("children").alias("ord", "c")).select("c.*", "ord")
    return parents, children


def read_golden(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Label rows, the first ``limit`` of a file in its order."""
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    if limit is not None:
        lines = lines.orderBy("line").limit(limit)
    return lines.select("line", F.from_json("value", GOLDEN).alias("g")).select("line", "g.*")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(slug, title, domain, rerank_input); a manifest that is missing or broken is empty, a title not given is made from the slug, an unknown flag is ``child``."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "slug string, title string, domain string, rerank_input string")
    text = spark.read.text(path, wholetext=True)
    books = text.select(F.from_json("value", MANIFEST).alias("m")).select(F.explode("m.books").alias("slug", "b"))
    flag = F.when(F.col("b.rerank_input") == "heading", "heading").otherwise("child")
    return books.select("slug", F.coalesce("b.title", X.titleize(F.col("slug"))).alias("title"), F.coalesce("b.domain", F.lit("general")).alias("domain"), flag.alias("rerank_input"))
