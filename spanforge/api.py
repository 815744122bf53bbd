"""A document store on stored tables: build it, search batches of queries, read and look around."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.config import EngineConfig
from spanforge.functions import models
from spanforge.functions import text as X
from spanforge.operators import chunking, markdown, retrieval
from spanforge.sources import converters, readers, sinks


class DocumentStore:
    """Tables under one folder: markdown, books, parents, children, points and postings, each appended to by id."""

    def __init__(self, spark: SparkSession, root: str, config: EngineConfig = EngineConfig(), embedder: models.Embedder | None = None, reranker: models.Reranker | None = None):
        self.spark, self.root, self.config = spark, root.rstrip("/"), config
        self.embedder = embedder or models.HashingEmbedder(config.embedding_dim, config.embed_max_chars)
        self.reranker = reranker or models.LexicalReranker()

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._path(name))

    # -- build ------------------------------------------------------------------

    def ingest(self, folder: str, extra: dict[str, converters.Converter] | None = None) -> DataFrame:
        """Convert what is new under a folder; returns the files that failed (slug, error)."""
        files = readers.first_of_slug(readers.scan_files(self.spark, folder))
        done = converters.convert(files, extra).persist()
        fresh = done.where("markdown is not null")
        sinks.append_new(fresh.select("slug", "markdown"), self._path("markdown"), "slug")
        books = fresh.select("slug", X.titleize(F.col("slug")).alias("title"), "domain", F.lit("child").alias("rerank_input"))
        sinks.append_new(books, self._path("books"), "slug")
        return done.where("error is not null").select("slug", "error")

    def chunk(self) -> None:
        md = self.table("markdown").join(self.table("books").select("slug", "title"), "slug", "left")
        count = models.BpeCounter(self.config.token_ranks, self.config.token_pattern) if self.config.token_ranks else chunking.count_words
        chunked = chunking.chunk_books(md, count=count, config=self.config).persist()
        sinks.append_new(chunking.parents_of(chunked), self._path("parents"), "parent_id")
        sinks.append_new(chunking.children_table(chunked), self._path("children"), "child_id")
        chunked.unpersist()

    def index(self) -> None:
        """Points and postings of the children that have none; a half-indexed book is finished."""
        rows = self.table("children").withColumns({"point_id": X.point_id(F.col("child_id")), "embed_text": retrieval.embed_text()})
        vectors = models.embed_column(rows, "embed_text", self.embedder)
        sinks.append_new(vectors.select("child_id", "point_id", "parent_id", "book", "embedding"), self._path("points"), "child_id")
        posts = retrieval.postings(rows, self.config, item="child_id", text="embed_text", keep=["book"])
        sinks.append_new(posts.withColumnRenamed("id", "child_id"), self._path("postings"), "child_id")

    def build(self, folder: str) -> DataFrame:
        failed = self.ingest(folder)
        self.chunk()
        self.index()
        return failed

    # -- search -------------------------------------------------------------------

    def search_batch(self, queries: DataFrame, top_k: int | None = None, book: str | None = None, use_reranker: bool = True) -> DataFrame:
        """Ranked children of queries (query_id, text and, optionally, hyde, extras, keywords)."""
        for name, kind in (("hyde", "string"), ("extras", "array<string>"), ("keywords", "array<string>")):
            if name not in queries.columns:
                queries = queries.withColumn(name, F.lit(None).cast(kind))
        top_k = top_k or self.config.top_k
        points = self.table("points").withColumnRenamed("child_id", "id")
        posts = self.table("postings").withColumnRenamed("child_id", "id")
        idf = retrieval.term_idf(posts, points.agg(F.count("*").alias("n")))
        if book is not None:
            points, posts = points.where(F.col("book") == book), posts.where(F.col("book") == book)
        legs = retrieval.plan_legs(queries).withColumn("key", F.concat_ws("\x01", F.col("query_id").cast("string"), F.col("leg").cast("string")))
        dense = models.embed_column(legs.where("kind = 'dense'"), "text", self.embedder, "vector", "query")
        hits = retrieval.dense_leg(dense.select(F.col("key").alias("query_id"), "vector"), points, self.config.candidates)
        sparse = retrieval.sparse_leg(legs.where("kind = 'sparse'").select(F.col("key").alias("query_id"), "text"), posts, idf, self.config)
        both = hits.select("query_id", "id", "score").unionByName(sparse.select("query_id", "id", "score"))
        named = both.withColumnRenamed("query_id", "key").join(legs.select("key", "query_id", "leg"), "key").drop("key")
        fused = retrieval.dbsf(named, self.config.candidates if use_reranker else top_k)
        # texts are joined to the ranked ids alone
        children = self.table("children").withColumnRenamed("child_id", "id")
        found = fused.join(children, "id").join(self.table("books").select(F.col("slug").alias("book"), "rerank_input"), "book", "left")
        if use_reranker:
            found = found.withColumn("rerank_text", retrieval.rerank_text(found, self.config.rerank_input)).join(queries.select("query_id", F.col("text").alias("query")), "query_id")
            found = retrieval.adaptive_cutoff(models.rerank(found, self.reranker), self.config.rerank_floor, top_k, self.config.min_results)
        first = retrieval.dedup_parents(found)
        parents = self.table("parents").select("parent_id", F.col("text").alias("content"))
        out = first.join(parents, "parent_id", "left")
        return out.select("query_id", "rank", F.round("score", 4).alias("score"), F.col("book_title").alias("book"), "chapter_title", "section", "heading_path", F.coalesce("content", F.lit("")).alias("content"), F.col("text").alias("child_match"), F.col("id").alias("chunk_id"))

    def search(self, query: str, top_k: int = 10, book: str | None = None, hyde: str | None = None, extras: list[str] | None = None, keywords: list[str] | None = None) -> list[dict]:
        rows = self.spark.createDataFrame([(0, query, hyde, extras, keywords)], "query_id long, text string, hyde string, extras array<string>, keywords array<string>")
        return [r.asDict() for r in self.search_batch(rows, top_k, book).drop("query_id").orderBy("rank").collect()]

    def search_book(self, query: str, book: str, top_k: int = 5) -> list[dict]:
        if self.table("books").where(F.col("slug") == book).isEmpty():
            return [{"error": f"unknown book: {book}"}]
        return self.search(query, top_k, book)

    # -- look around ------------------------------------------------------------------

    def list_books(self) -> list[dict]:
        heads = markdown.chapters(self.table("markdown")).groupBy("slug").agg(F.transform(F.array_sort(F.collect_list(F.struct("ln", "title"))), lambda c: c["title"]).alias("chapters"))
        rows = self.table("books").join(heads, "slug", "left").orderBy("title", "slug")
        return [r.asDict() for r in rows.withColumn("n_chapters", F.size(F.coalesce("chapters", F.array().cast("array<string>")))).collect()]

    def get_chapter(self, book: str, chapter: str) -> str:
        row = markdown.get_chapter(self.table("markdown").where(F.col("slug") == book), chapter).first()
        return row["chapter"] if row else f"No chapter matching '{chapter}' in '{book}'."

    def read_chunk(self, chunk_id: str, window: int = 1) -> dict:
        child = self.table("children").where(F.col("child_id") == chunk_id).first()
        if child is None:
            return {"error": f"unknown chunk: {chunk_id}"}
        near = self.table("children").where((F.col("parent_id") == child["parent_id"]) & F.col("ord").between(child["ord"] - window, child["ord"] + window)).orderBy("ord").collect()
        slim = [{"chunk_id": r["child_id"], "text": r["text"], "ord": r["ord"]} for r in near]
        parent = self.table("parents").where(F.col("parent_id") == child["parent_id"]).first()
        return {
            "chunk_id": chunk_id,
            "book": child["book"],
            "heading_path": child["heading_path"],
            "text": child["text"],
            "parent_text": parent["text"] if parent else "",
            "previous": [{k: s[k] for k in ("chunk_id", "text")} for s in slim if s["ord"] < child["ord"]],
            "next": [{k: s[k] for k in ("chunk_id", "text")} for s in slim if s["ord"] > child["ord"]],
            "seen_chunk_ids": [s["chunk_id"] for s in slim],
        }

    def grep_books(self, pattern: str, book: str | None = None, max_results: int = 20) -> list[dict]:
        books = self.table("markdown")
        if book is not None:
            books = books.where(F.col("slug") == book)
        n = books.count()
        if not n:
            return [{"error": f"unknown book: {book}"}]
        try:
            hits = retrieval.grep(books.select(F.col("slug").alias("book"), F.posexplode(F.split("markdown", "\n")).alias("ln", "line")), pattern, max_results, n)
        except ValueError as error:
            return [{"error": str(error)}]
        return [r.asDict() for r in hits.collect()]


def sweep(configs: list[EngineConfig], evaluate) -> list[tuple[EngineConfig, dict]]:
    """Results of ``evaluate(config)`` for each configuration."""
    return [(c, evaluate(c)) for c in configs]


