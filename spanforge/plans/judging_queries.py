"""Queries of label building and of the small tallies, over grades made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.operators import evaluation as E
from spanforge.operators import labeling as L
from spanforge.operators import retrieval as R
from spanforge.plans.retrieval_queries import dense_topk
from spanforge.session import read_table
from spanforge.sources import sinks


def _graded(spark, sf_dir):
    """Candidates of ten documents a query, graded 0 to 2 by the id."""
    docs = read_table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.expr("doc_id div 10").alias("query_id"), (F.col("doc_id") % 7 % 3).alias("grade"), (F.col("doc_id") % 10 == 0).alias("gold"), F.when(F.col("doc_id") % 13 != 0, F.col("text")).alias("text"))


def grade_histogram(spark, sf_dir):
    return E.grade_summary(_graded(spark, sf_dir))


def judge_sample(spark, sf_dir):
    return L.per_grade(_graded(spark, sf_dir), 60).select("id", "grade")


def route_pools(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("heading_path"), F.when(F.col("lang") == "de", "code").otherwise("text").alias("chunk_type"))
    return L.route_eligible(rows).select("doc_id", "pool")


def archetype_slices(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    return L.sliced_then_capped(docs, {"paraphrase": 10, "keyword": 8, "symptom": 5}, 3, F.col("lang") == "en", "doc_id").select("doc_id", "part")


def negative_pool(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("parent_id"), F.col("source").alias("book"))
    return L.filled_pool(docs.where("id % 50 = 0"), docs, 80).select("id", "book", "filled")


def rerank_moves(spark, sf_dir):
    first = dense_topk(spark, sf_dir).select((F.col("rank")).alias("before"), (F.col("id") % 40 + 1).alias("after"))
    return E.rank_moves(first)


def score_at_10(spark, sf_dir):
    return E.score_at(dense_topk(spark, sf_dir))


def unpaired_counts(spark, sf_dir):
    a = read_table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("query_id"))
    b = read_table(spark, sf_dir, "labels").where("toxic = 0").select(F.col("doc_id").alias("query_id"))
    return E.unpaired(a, b)


def corpus_totals(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations")
    return sinks.totals(parents=conv.where("turn = 0"), children=conv, vectors=read_table(spark, sf_dir, "embeddings"))


def point_payload(spark, sf_dir):
    """Turns as children of their conversation; every third has no texts beside its own, every fifth book no title."""
    conv = read_table(spark, sf_dir, "conversations")
    book = F.concat(F.lit("b"), (F.col("conv_id") % 10).cast("string"))
    some = F.when(F.col("turn") % 3 != 0, F.col("role"))
    children = conv.select(F.concat_ws("-", "conv_id", "turn").alias("child_id"), F.col("conv_id").alias("parent_id"), "text", some.alias("context_text"), book.alias("book"), F.lit(None).cast("string").alias("book_title"), some.alias("chapter"), some.alias("chapter_title"), some.alias("section"), some.alias("heading_path"), F.when(F.col("turn") % 2 == 0, "code").alias("chunk_type"))
    parents = conv.where("turn = 1").select(F.col("conv_id").alias("parent_id"), "text")
    books = conv.select(book.alias("slug")).distinct().where("slug not in ('b0', 'b5')").withColumn("title", F.upper("slug"))
    return R.payload(children, parents, books)


def query_passages(spark, sf_dir):
    queries = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    passages = read_table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("query_id"), F.when(F.col("doc_id") % 4 == 0, F.col("text")).otherwise(" ").alias("hyde"))
    return R.with_passages(queries, passages).select("query_id", "hyde")


def blind_rows(spark, sf_dir):
    return L.blind(_graded(spark, sf_dir).withColumn("query", F.col("query_id").cast("string")), "id", text="text")


def audit_sample(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    sample = L.per_grade(_graded(spark, sf_dir), 30).select(F.col("id").alias("query_id"), "grade")
    found = docs.where("doc_id % 4 <> 1").select(F.col("doc_id").alias("query_id"), F.concat_ws("/", "source", "lang").alias("candidates"))
    easy = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("query_id"), F.col("lang").alias("easy_query"))
    return L.audit_rows(sample, found, easy)


def distinct_slices(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations")
    rows = conv.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("part"), F.initcap(F.substring("text", 1, 3)).alias("query"))
    return L.distinct_then_capped(rows, {"user": 12, "assistant": 7}, 3)


QUERIES = {f.__name__: f for f in (grade_histogram, judge_sample, route_pools, archetype_slices, negative_pool, rerank_moves, score_at_10, unpaired_counts, corpus_totals, point_payload, query_passages, blind_rows, audit_sample, distinct_slices)}

_GRADED = "g AS (SELECT doc_id AS id, doc_id // 10 AS query_id, doc_id % 7 % 3 AS grade, doc_id % 10 = 0 AS gold, CASE WHEN doc_id % 13 <> 0 THEN text END AS text FROM documents)"
_DENSE = "t AS (SELECT q.vec_id AS query_id, p.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings p WHERE q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM t), d AS (SELECT * FROM r WHERE rank <= 50)"

ORACLE = {
    "grade_histogram": f"""WITH {_GRADED}, q AS (SELECT query_id, count(*) FILTER (grade >= 1) AS n, count(*) FILTER (grade >= 1 AND NOT gold) AS more FROM g GROUP BY query_id)
SELECT 'grade ' || grade AS stat, count(*)::DOUBLE AS value FROM g GROUP BY grade UNION ALL SELECT 'mean positives', round(avg(n), 6) FROM q
UNION ALL SELECT 'gained %', round(100.0 * count(*) FILTER (more > 0) / greatest(count(*), 1), 6) FROM q""",
    "judge_sample": f"""WITH {_GRADED} SELECT id, grade FROM (SELECT *, row_number() OVER (PARTITION BY grade ORDER BY sha256('42' || id), id) AS r FROM g WHERE NOT gold AND trim(coalesce(text, '')) <> '') WHERE r <= 20""",
    "route_pools": "SELECT doc_id, CASE WHEN lang = 'de' THEN 'code' ELSE 'prose' END AS pool FROM documents WHERE doc_id % 5 <> 0 AND trim(source) <> ''",
    "archetype_slices": """WITH r AS (SELECT doc_id, lang, row_number() OVER (ORDER BY sha256('42' || doc_id), doc_id) AS r FROM documents),
p AS (SELECT *, CASE WHEN r <= 30 THEN 'paraphrase' WHEN r <= 54 THEN 'keyword' ELSE 'symptom' END AS part FROM r WHERE r <= 69),
n AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY r) AS n FROM p WHERE lang = 'en')
SELECT doc_id, part FROM n WHERE n <= CASE part WHEN 'paraphrase' THEN 10 WHEN 'keyword' THEN 8 ELSE 5 END""",
    "negative_pool": """WITH c AS (SELECT doc_id AS id, source AS book FROM documents WHERE doc_id % 50 = 0), o AS (SELECT doc_id AS id, source AS book FROM documents WHERE doc_id % 50 <> 0),
s AS (SELECT book, count(*) AS cnt FROM o GROUP BY book), need AS (SELECT greatest(0, 80 - (SELECT count(*) FROM c)) AS m),
a AS (SELECT book, least(cnt, greatest(round_even((SELECT m FROM need) * cnt / (SELECT sum(cnt) FROM s), 0), 0))::BIGINT AS n FROM s),
r AS (SELECT id, book, row_number() OVER (PARTITION BY book ORDER BY sha256('42' || id), id) AS r FROM o)
SELECT id, book, false AS filled FROM c UNION ALL SELECT id, book, true FROM r JOIN a USING (book) WHERE r.r <= a.n""",
    "rerank_moves": f"WITH {_DENSE}, m AS (SELECT rank AS before, id % 40 + 1 AS after FROM d) SELECT count(*) AS n, count(*) FILTER (before <= 15) AS near, count(*) FILTER (before > 25) AS far, count(*) FILTER (after < before) AS helped, count(*) FILTER (after > before) AS hurt FROM m",
    "score_at_10": f"WITH {_DENSE} SELECT query_id, arg_max(score, rank) AS score FROM d WHERE rank <= 10 GROUP BY query_id",
    "unpaired_counts": """WITH a AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), b AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 0)
SELECT (SELECT count(*) FROM a SEMI JOIN b USING (doc_id)) AS n_both, (SELECT count(*) FROM a ANTI JOIN b USING (doc_id)) AS n_a_only, (SELECT count(*) FROM b ANTI JOIN a USING (doc_id)) AS n_b_only""",
    "corpus_totals": "SELECT 'parents' AS name, count(*) AS n FROM conversations WHERE turn = 0 UNION ALL SELECT 'children', count(*) FROM conversations UNION ALL SELECT 'vectors', count(*) FROM embeddings",
    "point_payload": """WITH c AS (SELECT conv_id || '-' || turn AS child_id, conv_id AS parent_id, text AS child_text, CASE WHEN turn % 3 <> 0 THEN role ELSE '' END AS said, 'b' || conv_id % 10 AS book, CASE WHEN turn % 2 = 0 THEN 'code' ELSE 'prose' END AS chunk_type FROM conversations),
p AS (SELECT conv_id AS parent_id, text AS parent_text FROM conversations WHERE turn = 1)
SELECT child_id, parent_id, child_text, said AS context_text, coalesce(parent_text, '') AS parent_text, book, CASE WHEN book IN ('b0', 'b5') THEN book ELSE upper(book) END AS book_title, said AS chapter, said AS chapter_title, said AS section, said AS heading_path, chunk_type FROM c LEFT JOIN p USING (parent_id)""",
    "query_passages": "SELECT item_id AS query_id, CASE WHEN item_id % 4 = 0 AND trim(d.text) <> '' THEN d.text ELSE b.text END AS hyde FROM benchmark b LEFT JOIN documents d ON d.doc_id = item_id",
    "blind_rows": f"WITH {_GRADED} SELECT id AS idx, query_id::VARCHAR AS query, text AS candidate_text FROM g",
    "audit_sample": f"""WITH {_GRADED}, s AS (SELECT id, grade FROM g WHERE NOT gold AND trim(coalesce(text, '')) <> '' QUALIFY row_number() OVER (PARTITION BY grade ORDER BY sha256('42' || id), id) <= 10)
SELECT id AS query_id, grade, source || '/' || lang AS candidates, CASE WHEN id % 3 = 0 THEN lang ELSE '' END AS easy_query FROM s JOIN documents ON doc_id = id WHERE id % 4 <> 1""",
    "distinct_slices": """WITH RECURSIVE a AS (SELECT conv_id * 1000 + turn AS id, role AS part, CASE role WHEN 'user' THEN 12 WHEN 'assistant' THEN 7 END AS cap, array_to_string(list_transform(string_split(lower(substr(text, 1, 3)), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS query FROM conversations),
b AS (SELECT * FROM a WHERE cap IS NOT NULL AND query IS NOT NULL QUALIFY row_number() OVER (PARTITION BY part ORDER BY id) <= 3 * cap), o AS (SELECT *, row_number() OVER (ORDER BY id) AS pos FROM b),
f AS (SELECT 0::BIGINT AS pos, []::VARCHAR[] AS seen, []::VARCHAR[] AS parts, false AS taken UNION ALL
  SELECT o.pos, CASE WHEN t THEN list_append(seen, lower(query)) ELSE seen END, CASE WHEN t THEN list_append(parts, part) ELSE parts END, t
  FROM (SELECT o.*, f.seen, f.parts, NOT list_contains(f.seen, lower(o.query)) AND len(list_filter(f.parts, lambda x: x = o.part)) < o.cap AS t FROM f JOIN o ON o.pos = f.pos + 1) o)
SELECT id, part, query FROM o JOIN f USING (pos) WHERE taken""",
}
