"""Hybrid retrieval as tables: legs are rows, every step works on a batch of queries.

Ranking is by score (rounded to six places) from high to low and then by id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.config import EngineConfig
from spanforge.functions import text as X

#: Queries of one block that a dense scan holds in each task.
MAX_QUERIES = 10_000


def ranked(scores: DataFrame, k: int, by: list[str], score: str = "score", item: str = "id") -> DataFrame:
    """The ``k`` best rows of each group with their ``rank`` from 1."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(item))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


# -- sparse leg --------------------------------------------------------------


def postings(docs: DataFrame, config: EngineConfig = EngineConfig(), *, item: str = "id", text: str = "text", keep: list[str] = (), only: DataFrame | None = None) -> DataFrame:
    """(id, term, tf, len, weight): saturated term frequencies against a fixed average length; ``only`` of the terms of a table (term), sifted before anything is grouped."""
    rows = docs.select(F.col(item).alias("id"), *keep, X.terms(F.col(text)).alias("terms")).withColumn("len", F.size("terms"))
    words = rows.select("id", *keep, "len", F.explode("terms").alias("term"))
    if only is not None:
        words = words.join(only.select("term"), "term", "left_semi")
    counts = words.groupBy("id", *keep, "len", "term").agg(F.count("*").alias("tf"))
    weight = F.col("tf") * (config.bm25_k + 1) / (F.col("tf") + config.bm25_k * (1 - config.bm25_b + config.bm25_b * F.col("len") / config.bm25_avg_len))
    return counts.withColumn("weight", weight)


def term_idf(posts: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(term, df, idf) over a whole collection; ``n_docs`` is one row with ``n``."""
    df = posts.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return df.crossJoin(F.broadcast(n_docs)).withColumn("idf", idf).drop("n")


def sparse_leg(queries: DataFrame, posts: DataFrame, idf: DataFrame, config: EngineConfig = EngineConfig(), k: int | None = None) -> DataFrame:
    """Best documents of each query (query_id, text); the query is weighted as a document is."""
    own = postings(queries, config, item="query_id").select(F.col("id").alias("query_id"), "term", F.col("weight").alias("q")).join(idf, "term")
    scored = own.join(posts.select("id", "term", "weight"), "term").groupBy("query_id", "id").agg(F.round(F.sum(F.col("q") * F.col("weight") * F.col("idf")), 6).alias("score"))
    return ranked(scored, k or config.candidates, ["query_id"])


# -- dense leg ---------------------------------------------------------------


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, 0 where one has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))


def l2_normalise(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double") / F.greatest(norm(vector), F.lit(1e-9)))


def mean_vector(vectors: DataFrame, by: str, column: str) -> DataFrame:
    """Mean of arrays by group, by position: partial sums and no collected group."""
    parts = vectors.select(by, F.posexplode(column).alias("i", "x")).groupBy(by, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "x")))
    return parts.groupBy(by).agg(F.transform(ordered, lambda p: p["x"]).alias("mean"))


def dense_leg(queries: DataFrame, points: DataFrame, k: int = 50, *, item: str = "id", vector: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank) by cosine: blocks of queries against all points in Arrow batches.

    ``queries`` (query_id, vector) may be any number: blocks of at most ``MAX_QUERIES`` rows are scanned one after the other
    and their results united. Each batch gives its own ``k`` best, so what is ranked in the end is batches x ``k`` rows a query.
    """
    held, out = [], None
    for row in queries.select("query_id", "vector").toLocalIterator():
        held.append(row)
        if len(held) == MAX_QUERIES:
            part = _dense_block(held, queries, points, k, item, vector)
            out, held = part if out is None else out.unionByName(part), []
    if held or out is None:
        part = _dense_block(held, queries, points, k, item, vector)
        out = part if out is None else out.unionByName(part)
    return out


def _dense_block(held: list, queries: DataFrame, points: DataFrame, k: int, item: str, vector: str) -> DataFrame:
    ids = [r["query_id"] for r in held]
    q = np.array([r["vector"] for r in held], dtype=np.float64).reshape(len(held), len(held[0]["vector"]) if held else 0)
    q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
    points = points.select(F.col(item).alias("id"), F.col(vector).alias("v")).where("v is not null")

    def scan(batches):
        for batch in batches:
            if not batch.num_rows or not ids:
                continue
            values = batch.column(1)
            v = np.asarray(values.flatten(), dtype=np.float64).reshape(batch.num_rows, -1)
            size = np.linalg.norm(v, axis=1)
            scores = np.round((v / np.where(size > 0, size, 1)[:, None]) @ q.T, 6)
            item_ids = batch.column(0).to_numpy(zero_copy_only=False)
            out_q, out_i, out_s = [], [], []
            for j, query in enumerate(ids):
                order = np.lexsort((item_ids, -scores[:, j]))[:k]
                out_q += [query] * len(order)
                out_i.append(item_ids[order])
                out_s.append(scores[order, j])
            yield pa.RecordBatch.from_arrays([pa.array(out_q, query_kind), pa.array(np.concatenate(out_i), batch.column(0).type), pa.array(np.concatenate(out_s))], names=["query_id", "id", "score"])

    query_kind = pa.string() if isinstance(queries.schema["query_id"].dataType, T.StringType) else pa.int64()
    schema = T.StructType([T.StructField("query_id", T.StringType() if query_kind == pa.string() else T.LongType()), T.StructField("id", points.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    return ranked(points.mapInArrow(scan, schema), k, ["query_id"])


# -- fusion, cutoff, deduplication ---------------------------------------------


def plan_legs(queries: DataFrame) -> DataFrame:
    """Legs as rows (query_id, leg, kind, text) of queries (query_id, text, hyde, extras, keywords).

    Dense legs are the query, its hypothetical passage and each extra query; sparse legs are the
    keywords (else the query) and each extra. The passage is an added leg and has no sparse one.
    """
    extras = F.coalesce(F.col("extras"), F.array().cast("array<string>"))
    dense = F.filter(F.concat(F.array("text", "hyde"), extras), lambda t: t.isNotNull())
    words = F.when(F.size(F.coalesce(F.col("keywords"), F.array().cast("array<string>"))) > 0, F.array_join("keywords", " ")).otherwise(F.col("text"))
    sparse = F.concat(F.array(words), extras)
    pairs = F.concat(F.transform(dense, lambda t: F.struct(F.lit("dense").alias("kind"), t.alias("text"))), F.transform(sparse, lambda t: F.struct(F.lit("sparse").alias("kind"), t.alias("text"))))
    return queries.select("query_id", F.posexplode(pairs).alias("leg", "p")).select("query_id", "leg", "p.kind", "p.text")


def dbsf(legs: DataFrame, k: int) -> DataFrame:
    """Distribution-based score fusion of (query_id, leg, id, score): each leg is scaled by its mean and three standard deviations; one hit or no spread gives 0.5."""
    leg = Window.partitionBy("query_id", "leg")
    mean, sd = F.avg("score").over(leg), F.stddev_samp("score").over(leg)
    scaled = F.coalesce(F.try_divide(F.col("score") - (mean - 3 * sd), F.when(sd > 0, 6 * sd)), F.lit(0.5))
    fused = legs.withColumn("s", scaled).groupBy("query_id", "id").agg(F.round(F.sum("s"), 6).alias("score"))
    return ranked(fused, k, ["query_id"])


def rrf(legs: DataFrame, k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (query_id, leg, id, rank)."""
    fused = legs.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 6).alias("score"))
    return ranked(fused, k, ["query_id"])


def adaptive_cutoff(hits: DataFrame, floor: float, top_k: int, least: int = 3, strict: bool = False) -> DataFrame:
    """Hits at or above the floor, ``top_k`` at most; the first ``least`` where fewer remain (more than ``top_k`` if that is smaller, unless ``strict``)."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    above = F.sum((F.col("score") >= floor).cast("int")).over(Window.partitionBy("query_id"))
    kept = F.least(F.lit(top_k), above)
    limit = F.when(kept < least, F.lit(min(least, top_k) if strict else least)).otherwise(kept)
    out = hits.withColumns({"rank": F.row_number().over(order), "_n": limit})
    return out.where("rank <= _n").drop("_n").withColumn("rank", F.col("rank").cast("long"))


def dedup_parents(hits: DataFrame, parent: str = "parent_id") -> DataFrame:
    """The first hit of each parent; nothing moves up to fill. Missing parents are one parent."""
    order = Window.partitionBy("query_id", "_p").orderBy("rank")
    return hits.withColumn("_p", F.coalesce(F.col(parent).cast("string"), F.lit(""))).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_p", "_n")


def pool(legs: DataFrame, gold: DataFrame) -> DataFrame:
    """Judging pool of (query_id, leg, rank, id, parent_id): the first seen child of each parent by leg and rank, gold (query_id, id, parent_id) in place of any other."""
    order = Window.partitionBy("query_id", "parent_id").orderBy("leg", "rank", "id")
    seen = legs.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("query_id", "id", "parent_id")
    rest = seen.join(gold.select("query_id", "parent_id"), ["query_id", "parent_id"], "left_anti")
    return rest.withColumn("gold", F.lit(False)).unionByName(gold.select("query_id", "id", "parent_id").withColumn("gold", F.lit(True)))


def rerank_text(rows: DataFrame, override: str | None = None) -> Column:
    """Text for the reranker: heading (by the book's flag or the override), context and child."""
    use = F.lit(override == "heading") if override in ("heading", "child") else F.coalesce(F.col("rerank_input"), F.lit("child")) == "heading"
    return X.join_present("\n", F.when(use, F.col("heading_path")), F.col("context_text"), F.col("text"))


def lexical_score(query: Column, text: Column) -> Column:
    """Ten times the share of the query's distinct terms that a text holds: the rerank stand-in as a column."""
    asked = F.array_distinct(X.terms(query))
    return F.round(10.0 * F.size(F.array_intersect(asked, X.terms(text))) / F.greatest(F.size(asked), F.lit(1)), 6)


def embed_text() -> Column:
    return X.join_present("\n\n", F.col("heading_path"), F.col("context_text"), F.col("text"))


# -- literal search and navigation -----------------------------------------------


def grep(lines: DataFrame, pattern: str, max_results: int, n_files: int) -> DataFrame:
    """Hits of a case-insensitive pattern in (book, ln, line) with a line of context on both sides, capped by book and in all."""
    pattern = X.try_pattern(pattern)
    order = Window.partitionBy("book").orderBy("ln")
    context = F.concat_ws("\n", F.lag("line").over(order), "line", F.lead("line").over(order))
    hit = lines.withColumn("context", F.substring(context, 1, 500)).where(F.col("line").rlike("(?i)" + pattern))
    per_file = max(3, max_results // max(1, n_files))
    capped = hit.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_file)
    return capped.orderBy("book", "ln").limit(max_results).select("book", (F.col("ln") + 1).cast("long").alias("line_number"), "context")


def neighbours(chunks: DataFrame, window: int, *, parent: str = "parent_id", order: str = "ord", item: str = "chunk_id") -> DataFrame:
    """Each chunk with the ids of up to ``window`` chunks before and after it in its parent."""
    w = Window.partitionBy(parent).orderBy(order)
    return chunks.select(item, parent, F.collect_list(item).over(w.rowsBetween(-window, -1)).alias("previous"), F.collect_list(item).over(w.rowsBetween(1, window)).alias("next"))


def payload(children: DataFrame, parents: DataFrame, books: DataFrame) -> DataFrame:
    """What is stored beside a child's vector: its texts, its parent's text and its place; what a chunk file leaves out is empty, a missing title is the book's own, a missing kind prose."""
    about = ["chapter", "chapter_title", "section", "heading_path"]
    rows = children.join(parents.select("parent_id", F.col("text").alias("parent_text")), "parent_id", "left").join(books.select(F.col("slug").alias("book"), F.col("title").alias("_title")), "book", "left")
    return rows.select(
        "child_id",
        "parent_id",
        F.col("text").alias("child_text"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("context_text", "parent_text")],
        "book",
        F.coalesce("book_title", "_title", "book").alias("book_title"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in about],
        F.coalesce("chunk_type", F.lit("prose")).alias("chunk_type"),
    )


def with_passages(queries: DataFrame, passages: DataFrame) -> DataFrame:
    """Queries (query_id, text) with the hypothetical passage (query_id, hyde) that was written for them, the query's own text where there is none."""
    found = queries.join(passages.groupBy("query_id").agg(F.min("hyde").alias("hyde")), "query_id", "left")
    return found.withColumn("hyde", F.coalesce(F.nullif(F.trim("hyde"), F.lit("")), "text"))
