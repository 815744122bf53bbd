"""Retrieval queries over whole collections.

Text queries are all ``benchmark`` passages against ``documents``; vector queries are the vectors whose id is divisible by 20
(a further leg of query ``q`` is the vector ``q`` + 1 or + 2) against all of ``embeddings``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.functions import text as X
from spanforge.operators import retrieval as R
from spanforge.session import read_table, stored


def _docs(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("book"))


def _queries(spark, sf_dir):
    return read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def bm25_postings(spark, sf_dir):
    return R.postings(_docs(spark, sf_dir)).select("id", "term", "tf", F.round("weight", 6).alias("weight"))


def bm25_term_idf(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return R.term_idf(R.postings(docs), docs.agg(F.count("*").alias("n"))).select("term", "df", F.round("idf", 6).alias("idf"))


def _sparse(spark, sf_dir, k, book=None):
    docs, queries = _docs(spark, sf_dir), _queries(spark, sf_dir)
    terms = queries.select(F.explode(X.terms(F.col("text"))).alias("term")).distinct()
    # read twice, for the document frequencies and for the scores
    posts = stored(R.postings(docs, keep=["book"], only=terms))
    idf = R.term_idf(posts, docs.agg(F.count("*").alias("n")))
    return R.sparse_leg(queries, posts if book is None else posts.where(F.col("book") == book), idf, k=k)


def bm25_topk(spark, sf_dir):
    return _sparse(spark, sf_dir, 10)


def bm25_topk_filtered(spark, sf_dir):
    return _sparse(spark, sf_dir, 10, "src3")


def _points(spark, sf_dir):
    return read_table(spark, sf_dir, "embeddings")


def _vector_queries(spark, sf_dir, shift=0):
    return _points(spark, sf_dir).where((F.col("vec_id") - shift) % 20 == 0).select((F.col("vec_id") - shift).alias("query_id"), F.col("embedding").alias("vector"))


def dense_topk(spark, sf_dir):
    return R.dense_leg(_vector_queries(spark, sf_dir), _points(spark, sf_dir), 50, item="vec_id")


def dense_topk_filtered(spark, sf_dir):
    return R.dense_leg(_vector_queries(spark, sf_dir), _points(spark, sf_dir).where("label = 3"), 20, item="vec_id")


def l2_normalize(spark, sf_dir):
    v = R.l2_normalise(F.col("embedding"))
    return _points(spark, sf_dir).select("vec_id", F.posexplode(v).alias("i", "x")).select("vec_id", "i", F.round("x", 6).alias("x"))


def mean_pool(spark, sf_dir):
    return R.mean_vector(_points(spark, sf_dir), "label", "embedding").select("label", F.posexplode("mean").alias("i", "x")).select("label", "i", F.round("x", 6).alias("x"))


def _legs(spark, sf_dir, k=50):
    points = _points(spark, sf_dir)
    one = R.dense_leg(_vector_queries(spark, sf_dir), points, k, item="vec_id").withColumn("leg", F.lit(0))
    two = R.dense_leg(_vector_queries(spark, sf_dir, 1), points, k, item="vec_id").withColumn("leg", F.lit(1))
    return one.unionByName(two)


def hybrid_dbsf(spark, sf_dir):
    return R.dbsf(_legs(spark, sf_dir), 50)


def hybrid_multi_leg(spark, sf_dir):
    three = R.dense_leg(_vector_queries(spark, sf_dir, 2), _points(spark, sf_dir), 50, item="vec_id").withColumn("leg", F.lit(2))
    return R.dbsf(_legs(spark, sf_dir).unionByName(three), 20)


def rrf_fusion(spark, sf_dir):
    return R.rrf(_legs(spark, sf_dir), 20)


_FLOOR, _TOP = 1.5, 10


def adaptive_cutoff(spark, sf_dir):
    return R.adaptive_cutoff(R.dbsf(_legs(spark, sf_dir), 50), _FLOOR, _TOP)


def hybrid_search_e2e(spark, sf_dir):
    hits = adaptive_cutoff(spark, sf_dir).join(_points(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("label").alias("parent_id")), "id")
    return R.dedup_parents(hits).select("query_id", "id", "parent_id", "score", "rank")


def hybrid_search(spark, sf_dir):
    """The whole search for each passage: a sparse leg over the texts and a dense leg over the vectors of the same ids (the query's
    vector is that of its own id), fusion, reranking of heading and text, cutoff, one hit for each source."""
    docs, queries = _docs(spark, sf_dir), _queries(spark, sf_dir)
    points = _points(spark, sf_dir)
    vectors = queries.join(points.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), "query_id").select("query_id", "vector")
    dense = R.dense_leg(vectors, points, 50, item="vec_id").select("query_id", "id", "score").withColumn("leg", F.lit(0))
    sparse = _sparse(spark, sf_dir, 50).select("query_id", "id", "score").withColumn("leg", F.lit(1))
    fused = R.dbsf(dense.unionByName(sparse), 50)
    texts = docs.select("id", F.col("book").alias("parent_id"), F.col("book").alias("heading_path"), F.lit(None).cast("string").alias("context_text"), "text")
    asked = queries.select("query_id", F.col("text").alias("query"))
    found = fused.join(texts, "id").join(asked, "query_id")
    reranked = found.withColumn("score", R.lexical_score(F.col("query"), R.rerank_text(found, "heading"))).select("query_id", "id", "parent_id", "score")
    return R.dedup_parents(R.adaptive_cutoff(reranked, 4.0, 10)).select("query_id", "id", "parent_id", "score", "rank")


def dedup_parents(spark, sf_dir):
    hits = dense_topk(spark, sf_dir).join(_points(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("label").alias("parent_id")), "id")
    return R.dedup_parents(hits).select("query_id", "id", "parent_id", "score", "rank")


def plan_legs(spark, sf_dir):
    q = read_table(spark, sf_dir, "benchmark")
    rows = q.select(
        F.col("item_id").alias("query_id"),
        "text",
        F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("passage "), "text")).alias("hyde"),
        F.when(F.col("item_id") % 3 == 0, F.array(F.lit("one"), F.lit("two"))).alias("extras"),
        F.when(F.col("item_id") % 5 == 0, F.array(F.lit("a"), F.lit("b"))).alias("keywords"),
    )
    return R.plan_legs(rows)


def pool_union(spark, sf_dir):
    labels = _points(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("label").alias("parent_id"))
    legs = _legs(spark, sf_dir, 20).join(labels, "id")
    gold = labels.where("id % 20 = 0").select(F.col("id").alias("query_id"), "id", "parent_id")
    return R.pool(legs, gold)


def grep_lines(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select(F.concat("source", F.lit("-"), F.col("doc_id").cast("string")).alias("book"), F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    return R.grep(docs, "the th[a-e]", 200, 20)


def read_chunk_neighbors(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("chunk_id"), F.col("conv_id").alias("parent_id"), F.col("turn").alias("ord"))
    return R.neighbours(conv, 2)


def point_ids(spark, sf_dir):
    child = F.concat("source", F.lit("-p"), F.col("doc_id").cast("string"), F.lit("-c0"))
    return read_table(spark, sf_dir, "documents").select("doc_id", X.point_id(child).alias("point_id"))


def _chunks(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.concat("lang", F.lit(" > doc "), F.col("doc_id").cast("string"))).alias("heading_path"),
        F.when(F.col("doc_id") % 3 == 0, F.lit("From here.")).alias("context_text"),
        "text",
        F.when(F.col("source") == "src1", "heading").when(F.col("source") == "src2", "child").alias("rerank_input"),
    )


def embed_text(spark, sf_dir):
    return _chunks(spark, sf_dir).select("doc_id", R.embed_text().alias("embed_text"))


def rerank_text(spark, sf_dir):
    rows = _chunks(spark, sf_dir)
    return rows.select("doc_id", R.rerank_text(rows).alias("by_manifest"), R.rerank_text(rows, "heading").alias("by_heading"))


QUERIES = {f.__name__: f for f in (bm25_postings, bm25_term_idf, bm25_topk, bm25_topk_filtered, dense_topk, dense_topk_filtered, l2_normalize, mean_pool, hybrid_dbsf, hybrid_multi_leg, rrf_fusion, adaptive_cutoff, hybrid_search_e2e, hybrid_search, dedup_parents, plan_legs, pool_union, grep_lines, read_chunk_neighbors, point_ids, embed_text, rerank_text)}

_POST = """w AS (SELECT doc_id AS id, source AS book, regexp_extract_all(lower(text), '([a-z0-9]+)', 1) AS t FROM documents), e AS (SELECT id, book, len(t) AS len, unnest(t) AS term FROM w),
post AS (SELECT id, book, term, count(*) AS tf, count(*) * 2.2 / (count(*) + 1.2 * (1 - 0.75 + 0.75 * len / 256.0)) AS weight FROM e GROUP BY id, book, len, term),
idf AS (SELECT term, count(*) AS df, ln(((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM post GROUP BY term)"""
_QUERY = """qw AS (SELECT item_id AS query_id, regexp_extract_all(lower(text), '([a-z0-9]+)', 1) AS t FROM benchmark), qe AS (SELECT query_id, len(t) AS len, unnest(t) AS term FROM qw),
q AS (SELECT query_id, term, count(*) * 2.2 / (count(*) + 1.2 * (1 - 0.75 + 0.75 * len / 256.0)) AS w FROM qe GROUP BY query_id, len, term)"""


def _rank(src: str, k: int) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ({src})) WHERE rank <= {k}"


def _bm25_legs(where: str, k: int) -> str:
    return _rank(f"SELECT query_id, id, round(sum(q.w * post.weight * idf.idf), 6) AS score FROM q JOIN idf USING (term) JOIN post USING (term) {where} GROUP BY query_id, id", k)


def _bm25(where: str) -> str:
    return f"WITH {_POST}, {_QUERY} " + _bm25_legs(where, 10)


def _dense(shift: int, k: int, where: str = "") -> str:
    return _rank(f"SELECT q.vec_id - {shift} AS query_id, p.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings p WHERE (q.vec_id - {shift}) % 20 = 0 {where}", k)


_LEGS = f"legs AS (SELECT *, 0 AS leg FROM ({_dense(0, 50)}) UNION ALL SELECT *, 1 FROM ({_dense(1, 50)}))"
_DBSF = """n AS (SELECT *, avg(score) OVER (PARTITION BY query_id, leg) AS m, stddev_samp(score) OVER (PARTITION BY query_id, leg) AS sd FROM legs),
f AS (SELECT query_id, id, round(sum(CASE WHEN sd > 0 THEN (score - (m - 3 * sd)) / (6 * sd) ELSE 0.5 END), 6) AS score FROM n GROUP BY query_id, id)"""
_CUT = f"""{_LEGS}, {_DBSF}, top AS ({_rank('SELECT * FROM f', 50)}), c AS (SELECT *, least({_TOP}, sum(CASE WHEN score >= {_FLOOR} THEN 1 ELSE 0 END) OVER (PARTITION BY query_id)) AS kept FROM top),
cut AS (SELECT query_id, id, score, rank FROM c WHERE rank <= CASE WHEN kept < 3 THEN 3 ELSE kept END)"""


def _dedup(src: str) -> str:
    return f"SELECT query_id, id, parent_id, score, rank FROM (SELECT h.*, label AS parent_id, row_number() OVER (PARTITION BY query_id, label ORDER BY rank) AS n FROM {src} h JOIN embeddings ON vec_id = id) WHERE n = 1"


_EMBED = "WITH c AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE lang || ' > doc ' || doc_id END AS h, CASE WHEN doc_id % 3 = 0 THEN 'From here.' END AS x, text, source FROM documents)"

ORACLE = {
    "bm25_postings": f"WITH {_POST} SELECT id, term, tf, round(weight, 6) AS weight FROM post",
    "bm25_term_idf": f"WITH {_POST} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "bm25_topk": _bm25(""),
    "bm25_topk_filtered": _bm25("WHERE post.book = 'src3'"),
    "dense_topk": _dense(0, 50),
    "dense_topk_filtered": _dense(0, 20, "AND p.label = 3"),
    "l2_normalize": "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings), u AS (SELECT vec_id, n, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM e) SELECT vec_id, i::INT AS i, round(x / greatest(n, 1e-9), 6) AS x FROM u",
    "mean_pool": "WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) SELECT label, i::INT AS i, round(avg(x), 6) AS x FROM e GROUP BY label, i",
    "hybrid_dbsf": f"WITH {_LEGS}, {_DBSF} {_rank('SELECT * FROM f', 50)}",
    "hybrid_multi_leg": f"WITH legs AS (SELECT *, 0 AS leg FROM ({_dense(0, 50)}) UNION ALL SELECT *, 1 FROM ({_dense(1, 50)}) UNION ALL SELECT *, 2 FROM ({_dense(2, 50)})), {_DBSF} {_rank('SELECT * FROM f', 20)}",
    "rrf_fusion": f"WITH {_LEGS} " + _rank("SELECT query_id, id, round(sum(1.0 / (60 + rank)), 6) AS score FROM legs GROUP BY query_id, id", 20),
    "adaptive_cutoff": f"WITH {_CUT} SELECT * FROM cut",
    "hybrid_search_e2e": f"WITH {_CUT} {_dedup('cut')}",
    "hybrid_search": f"""WITH {_POST}, {_QUERY},
dense AS ({_rank("SELECT b.item_id AS query_id, p.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 6) AS score FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id, embeddings p", 50)}),
sparse AS ({_bm25_legs("", 50)}), legs AS (SELECT query_id, id, score, 0 AS leg FROM dense UNION ALL SELECT query_id, id, score, 1 FROM sparse), {_DBSF}, top AS ({_rank("SELECT * FROM f", 50)}),
tt AS (SELECT top.query_id, top.id, source AS parent_id, list_distinct(regexp_extract_all(lower(b.text), '([a-z0-9]+)', 1)) AS a, regexp_extract_all(lower(concat_ws(chr(10), d.source, nullif(d.text, ''))), '([a-z0-9]+)', 1) AS t
FROM top JOIN documents d ON d.doc_id = top.id JOIN benchmark b ON b.item_id = top.query_id),
r AS (SELECT query_id, id, parent_id, round(10.0 * len(list_intersect(a, t)) / greatest(len(a), 1), 6) AS score FROM tt),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, least(10, sum(CASE WHEN score >= 4.0 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id)) AS kept FROM r),
k AS (SELECT * FROM c WHERE rank <= CASE WHEN kept < 3 THEN 3 ELSE kept END)
SELECT query_id, id, parent_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, parent_id ORDER BY rank) AS n FROM k) WHERE n = 1""",
    "dedup_parents": f"WITH d AS ({_dense(0, 50)}) {_dedup('d')}",
    "plan_legs": """WITH q AS (SELECT item_id AS query_id, text, CASE WHEN item_id % 2 = 0 THEN 'passage ' || text END AS hyde, CASE WHEN item_id % 3 = 0 THEN ['one', 'two'] ELSE []::VARCHAR[] END AS ex, CASE WHEN item_id % 5 = 0 THEN 'a b' ELSE text END AS kw FROM benchmark),
l AS (SELECT query_id, list_concat(list_transform(list_filter(list_concat([text, hyde], ex), lambda t: t IS NOT NULL), lambda t: {'kind': 'dense', 'text': t}), list_transform(list_concat([kw], ex), lambda t: {'kind': 'sparse', 'text': t})) AS p FROM q),
u AS (SELECT query_id, unnest(p) AS s, generate_subscripts(p, 1) - 1 AS leg FROM l) SELECT query_id, leg::INT AS leg, s.kind AS kind, s.text AS text FROM u""",
    "pool_union": f"""WITH legs AS (SELECT *, 0 AS leg FROM ({_dense(0, 20)}) UNION ALL SELECT *, 1 FROM ({_dense(1, 20)})),
s AS (SELECT query_id, id, label AS parent_id, row_number() OVER (PARTITION BY query_id, label ORDER BY leg, rank, id) AS n FROM legs JOIN embeddings ON vec_id = id),
g AS (SELECT vec_id AS query_id, vec_id AS id, label AS parent_id FROM embeddings WHERE vec_id % 20 = 0)
SELECT query_id, id, parent_id, false AS gold FROM s WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM g WHERE g.query_id = s.query_id AND g.parent_id = s.parent_id) UNION ALL SELECT query_id, id, parent_id, true FROM g""",
    "grep_lines": """WITH l AS (SELECT source || '-' || doc_id AS book, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS ln, unnest(string_split(text, chr(10))) AS line FROM documents),
c AS (SELECT book, ln, line, substr(concat_ws(chr(10), lag(line) OVER w, line, lead(line) OVER w), 1, 500) AS context FROM l WINDOW w AS (PARTITION BY book ORDER BY ln)),
h AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY ln) AS n FROM c WHERE regexp_matches(line, '(?i)the th[a-e]'))
SELECT book, ln + 1 AS line_number, context FROM h WHERE n <= 10 ORDER BY book, ln LIMIT 200""",
    "read_chunk_neighbors": """SELECT chunk_id, parent_id, coalesce(list(chunk_id) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), []) AS previous, coalesce(list(chunk_id) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), []) AS next
FROM (SELECT conv_id || '-' || turn AS chunk_id, conv_id AS parent_id, turn AS ord FROM conversations) WINDOW w AS (PARTITION BY parent_id ORDER BY ord)""",
    "point_ids": "SELECT doc_id, ((('0x' || substr(sha256(source || '-p' || doc_id || '-c0'), 1, 16))::UBIGINT) >> 1)::BIGINT AS point_id FROM documents",
    "embed_text": f"{_EMBED} SELECT doc_id, concat_ws(chr(10) || chr(10), h, x, nullif(text, '')) AS embed_text FROM c",
    "rerank_text": f"{_EMBED} SELECT doc_id, concat_ws(chr(10), CASE WHEN source = 'src1' THEN h END, x, nullif(text, '')) AS by_manifest, concat_ws(chr(10), h, x, nullif(text, '')) AS by_heading FROM c",
}
