"""Evaluation, significance, sampling and label queries.

``embeddings.label`` is the relevance group: for query vector ``q`` a vector of the same label has grade 1, of
ids that leave the same remainder modulo 7 as well grade 2. Queries are the vectors whose id is divisible by 20.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanforge.functions import text as X
from spanforge.operators import evaluation as E
from spanforge.operators import labeling as L
from spanforge.operators import retrieval as R
from spanforge.session import read_table


def _run(spark, sf_dir, shift=0, k=50):
    points = read_table(spark, sf_dir, "embeddings")
    q = points.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    if shift:
        q = q.withColumn("vector", F.transform("vector", lambda x, i: F.when(i % 4 == 0, F.lit(0.0)).otherwise(x.cast("double"))))
    return R.dense_leg(q, points, k, item="vec_id")


def _qrels(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "label")
    q = e.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), "label")
    grade = F.when(F.col("vec_id") % 7 == F.col("query_id") % 7, 2).otherwise(1)
    return q.join(e, "label").select("query_id", F.col("vec_id").alias("id"), grade.alias("grade"))


def _scores(spark, sf_dir, shift=0):
    run = _run(spark, sf_dir, shift)
    return E.per_query(run, run, _qrels(spark, sf_dir))


def ndcg_at_10(spark, sf_dir):
    return E.graded_ndcg(_run(spark, sf_dir), _qrels(spark, sf_dir)).select("query_id", F.round("ndcg", 6).alias("ndcg"))


def mrr_hit(spark, sf_dir):
    others = _qrels(spark, sf_dir).where("id <> query_id and grade = 2")
    return E.first_hits(_run(spark, sf_dir), others).select("query_id", F.coalesce("first_rank", F.lit(0)).alias("first_rank"), "hit", F.round("rr", 6).alias("rr"))


def eval_by_group(spark, sf_dir):
    scores = _scores(spark, sf_dir).withColumns({"domain": (F.floor(F.col("query_id") / 20) % 4).cast("string"), "archetype": F.when(F.floor(F.col("query_id") / 20) % 3 == 0, "hard").otherwise("baseline")})
    return E.report(scores, ["ndcg", "hit", "rr", "ceiling_hit"], ["domain", "archetype"])


def _hard(spark, sf_dir):
    return E.per_query(_run(spark, sf_dir), _run(spark, sf_dir), _qrels(spark, sf_dir).where("grade = 2 and id <> query_id"))


def misses(spark, sf_dir):
    return E.misses(_hard(spark, sf_dir))


def ceiling_gap(spark, sf_dir):
    return E.ceiling_gap(_hard(spark, sf_dir))


def _judges(spark, sf_dir):
    return read_table(spark, sf_dir, "labels").select(F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b"))


def judge_agreement(spark, sf_dir):
    return E.judge_agreement(_judges(spark, sf_dir))


def judge_confusion(spark, sf_dir):
    return E.confusion(_judges(spark, sf_dir))


def score_gaps(spark, sf_dir):
    return E.score_gaps(_run(spark, sf_dir, k=10))


def gap_cutoffs(spark, sf_dir):
    return E.gap_cutoffs(score_gaps(spark, sf_dir))


def floor_counts(spark, sf_dir):
    return E.floor_counts(_run(spark, sf_dir), [0.0, 0.01, 0.05, 0.1, 0.5])


def first_pos_rank(spark, sf_dir):
    others = _qrels(spark, sf_dir).where("id <> query_id").select("query_id", "id")
    run = _run(spark, sf_dir)
    tenth = run.where("rank = 10").select("query_id", F.col("score").alias("score_at_10"))
    return E.first_hits(run, others, 50).join(tenth, "query_id", "left").select("query_id", F.coalesce("first_rank", F.lit(0)).alias("first_rank"), "score_at_10")


def _pairs(spark, sf_dir):
    a = _scores(spark, sf_dir).select("query_id", F.round("ndcg", 6).alias("ndcg"))
    b = _scores(spark, sf_dir, 1).select("query_id", F.round("ndcg", 6).alias("ndcg"))
    return E.paired(a, b, "ndcg")


def paired_delta(spark, sf_dir):
    return _pairs(spark, sf_dir).select("query_id", "x", "y", F.round("delta", 6).alias("delta"))


def paired_summary(spark, sf_dir):
    return E.paired_summary(_pairs(spark, sf_dir))


def sign_test_counts(spark, sf_dir):
    return E.sign_counts(_pairs(spark, sf_dir).withColumn("delta", F.round("delta", 6)))


def wilcoxon_ranks(spark, sf_dir):
    return E.wilcoxon_sums(_pairs(spark, sf_dir).withColumn("delta", F.round("delta", 6)))


def bootstrap_ci(spark, sf_dir):
    return E.bootstrap_ci(_pairs(spark, sf_dir))


def mde_table(spark, sf_dir):
    return E.mde_table(spark, 0.3111, 200, [0.0, 0.5, 0.7, 0.9, 0.95])


def coverage_stats(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    by = docs.groupBy("source").agg(F.count("*").alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), E.upper_median("n_chars").alias("upper_median"), E.nth_share("n_chars", 0.9).alias("p90"), F.round(E.interpolated_median("n_chars"), 4).alias("median"), F.round(E.sample_stddev("n_chars"), 4).alias("sd"))
    return by


def ratio_stats(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").where(F.col("n_chars") > 0)
    rows = docs.select("lang", (F.col("n_chars") / F.greatest(X.word_count(F.col("text")), F.lit(1))).alias("ratio"))
    out = rows.groupBy("lang").agg(F.round(F.avg("ratio"), 6).alias("mean"), F.round(E.interpolated_median("ratio"), 6).alias("median"), F.round(E.nth_share("ratio", 0.95), 6).alias("p95"), F.round(E.sample_stddev("ratio"), 6).alias("sd"))
    return out.withColumn("threshold", F.bround(250 * F.col("mean")).cast("long"))


_STOP = ["the", "and", "that", "was"]


def lexical_overlap(spark, sf_dir):
    q = read_table(spark, sf_dir, "benchmark").select("item_id", X.content_terms(F.col("text"), _STOP).alias("q"))
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), X.content_terms(F.col("text"), _STOP).alias("c"))
    overlap = F.when(F.size("q") > 0, F.size(F.array_intersect("q", "c")) / F.greatest(F.size("q"), F.lit(1))).otherwise(0.0)
    return q.join(d, "item_id").select("item_id", F.round(overlap, 6).alias("overlap"))


def _plan(spark, sf_dir):
    counts = read_table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("count"))
    return L.allocate(counts, 60)


def stratified_allocate(spark, sf_dir):
    return _plan(spark, sf_dir)


def stratified_sample(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    return L.stratified_sample(docs, _plan(spark, sf_dir), "lang", "doc_id")


def blind_batches(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("candidate_text"))
    return L.round_robin(docs, 8, "doc_id")


def live_reconcile(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    golden = docs.select(F.col("doc_id").alias("query_id"), F.array("doc_id", F.col("doc_id") + 3, F.col("doc_id") + 1).alias("positive_ids"))
    live = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return L.reconcile(golden, live).select("query_id", F.array_join(F.transform("positive_ids", lambda x: x.cast("string")), ",").alias("positive_ids"))


def child_parent_join(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations")
    parents = conv.where("turn = 0").select("conv_id", F.col("text").alias("parent_text"))
    return conv.join(parents, "conv_id", "left").select("conv_id", "turn", F.coalesce("parent_text", F.lit("")).alias("parent_text"))


def orphan_parents(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return L.orphan_parents(docs.select(F.col("doc_id").alias("parent_id")), read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("parent_id")))


def incremental_todo(spark, sf_dir):
    return L.todo(read_table(spark, sf_dir, "documents").select("doc_id"), read_table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")


def hard_negatives(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("parent_id"), F.col("source").alias("book"), F.col("lang").alias("chapter"))
    return L.siblings(docs.where("id % 20 = 0"), docs)


def eligible_chunks(spark, sf_dir):
    return L.eligible(read_table(spark, sf_dir, "documents"), "index|contents|preface").select("doc_id", "n_words")


def junk_filter(spark, sf_dir):
    lines = read_table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ln", "query"))
    return L.usable_queries(lines, r"(?i)(^| )(the|una?)( |$)")


def index_page_strip(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    page = Window.partitionBy("source").orderBy("doc_id")
    rows = docs.withColumn("page", F.row_number().over(page)).withColumn("heading", F.when(F.col("page") > 45, F.concat(F.lit("Index (part "), F.col("page").cast("string"), F.lit(") > x"))).otherwise(F.concat("lang", F.lit(" > Index"))))
    return L.index_report(rows, "source")


def grade_parse(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    reply = F.concat(F.lit("Grades: ["), (F.col("event_id") % 4).cast("string"), F.lit(", "), (F.col("user_id") % 3).cast("string"), F.lit("] done"))
    g = L.parse_grades(reply)
    return e.select("event_id", F.element_at(g, 1).alias("g0"), F.element_at(g, 2).alias("g1"))


JUNK_KEYS = {"ip", "session", "k", "page"}


def scrub_keys(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    return L.scrub(e.select("event_id", "props"), "props", JUNK_KEYS)


def junk_key_counts(spark, sf_dir):
    return L.key_counts(read_table(spark, sf_dir, "events"), "props")


def scrubbed_key_counts(spark, sf_dir):
    """How often each key that ``scrub_keys`` removes occurs."""
    return L.key_counts(read_table(spark, sf_dir, "events"), "props", JUNK_KEYS)


QUERIES = {f.__name__: f for f in (ndcg_at_10, mrr_hit, eval_by_group, misses, ceiling_gap, judge_agreement, judge_confusion, score_gaps, gap_cutoffs, floor_counts, first_pos_rank, paired_delta, paired_summary, sign_test_counts, wilcoxon_ranks, bootstrap_ci, mde_table, coverage_stats, ratio_stats, lexical_overlap, stratified_allocate, stratified_sample, blind_batches, live_reconcile, child_parent_join, orphan_parents, incremental_todo, hard_negatives, eligible_chunks, junk_filter, index_page_strip, grade_parse, scrub_keys, junk_key_counts, scrubbed_key_counts)}


def _run_sql(name: str, k: int = 50, shift: bool = False) -> str:
    v = "list_transform(q.embedding::DOUBLE[], lambda x, i: CASE WHEN (i - 1) % 4 = 0 THEN 0.0 ELSE x END)" if shift else "q.embedding::DOUBLE[]"
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT q.vec_id AS query_id, p.vec_id AS id, round(list_cosine_similarity({v}, p.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings p WHERE q.vec_id % 20 = 0)) WHERE rank <= {k})"""


_QREL = f"qrel AS (SELECT q.vec_id AS query_id, p.vec_id AS id, CASE WHEN p.vec_id % 7 = q.vec_id % 7 THEN 2 ELSE 1 END AS grade FROM embeddings q JOIN embeddings p ON q.label = p.label WHERE q.vec_id % 20 = 0)"


def _score_sql(run: str, tag: str, where: str = "true") -> str:
    return f"""rel{tag} AS (SELECT * FROM qrel WHERE {where}),
d{tag} AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(rank + 1)) AS dcg FROM {run} JOIN rel{tag} USING (query_id, id) WHERE rank <= 10 GROUP BY query_id),
i{tag} AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(r + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, id) AS r FROM rel{tag}) WHERE r <= 10 GROUP BY query_id),
h{tag} AS (SELECT query_id, min(rank) FILTER (rank <= 10) AS first_rank, count(*) AS c FROM {run} JOIN rel{tag} USING (query_id, id) GROUP BY query_id),
s{tag} AS (SELECT i{tag}.query_id, coalesce(dcg, 0) / idcg AS ndcg, first_rank, CASE WHEN first_rank IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS hit, coalesce(1.0 / first_rank, 0)::DOUBLE AS rr, CASE WHEN c IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS ceiling_hit
  FROM i{tag} LEFT JOIN d{tag} ON d{tag}.query_id = i{tag}.query_id LEFT JOIN h{tag} ON h{tag}.query_id = i{tag}.query_id)"""


_HARD = f"WITH {_run_sql('run')}, {_QREL}, {_score_sql('run', 'a', 'grade = 2 AND id <> query_id')}"
_PAIR = f"""WITH {_run_sql('run')}, {_run_sql('other', shift=True)}, {_QREL}, {_score_sql('run', 'a')}, {_score_sql('other', 'b')},
pair AS (SELECT query_id, round(sa.ndcg, 6) AS x, round(sb.ndcg, 6) AS y, round(round(sb.ndcg, 6) - round(sa.ndcg, 6), 6) AS delta FROM sa JOIN sb USING (query_id))"""
_GAPS = f"WITH {_run_sql('run', 10)}, gaps AS (SELECT query_id, rank, round(score - lead(score) OVER (PARTITION BY query_id ORDER BY rank), 6) AS gap FROM run), g AS (SELECT * FROM gaps WHERE gap IS NOT NULL)"
_JUDGE = "WITH p AS (SELECT quality AS a, 1 - toxic AS b FROM labels)"
_MEANS = "count(*) AS n, round(avg(ndcg), 4) AS ndcg, round(avg(hit), 4) AS hit, round(avg(rr), 4) AS rr, round(avg(ceiling_hit), 4) AS ceiling_hit"
_WORDS = "len(list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> ''))"
_ALLOC = "WITH c AS (SELECT lang, count(*) AS count, least(2, count(*)) AS f FROM documents GROUP BY lang), p AS (SELECT lang, count, least(count, f + greatest(round_even((60 - sum(f) OVER ()) * count / sum(count) OVER (), 0), 0))::BIGINT AS n FROM c)"
_TERMS = "list_distinct(list_filter(regexp_extract_all(lower(text), '([a-z0-9]+)', 1), lambda t: length(t) > 2 AND t NOT IN ('the', 'and', 'that', 'was')))"
_HASH = "sha256('42' || {0})"

ORACLE = {
    "ndcg_at_10": f"WITH {_run_sql('run')}, {_QREL}, {_score_sql('run', 'a')} SELECT query_id, round(ndcg, 6) AS ndcg FROM sa",
    "mrr_hit": f"{_HARD} SELECT query_id, coalesce(first_rank, 0) AS first_rank, hit, round(rr, 6) AS rr FROM sa",
    "eval_by_group": f"""WITH {_run_sql('run')}, {_QREL}, {_score_sql('run', 'a')}, t AS (SELECT *, (query_id // 20 % 4)::VARCHAR AS domain, CASE WHEN query_id // 20 % 3 = 0 THEN 'hard' ELSE 'baseline' END AS archetype FROM sa)
SELECT 'domain' AS stratum, domain AS value, {_MEANS} FROM t GROUP BY domain UNION ALL SELECT 'archetype', archetype, {_MEANS} FROM t GROUP BY archetype UNION ALL SELECT 'all', 'all', {_MEANS} FROM t""",
    "misses": f"{_HARD} SELECT query_id, ceiling_hit > 0 AS in_ceiling FROM sa WHERE hit = 0",
    "ceiling_gap": f"{_HARD} SELECT round(avg(ceiling_hit), 4) AS ceiling, round(avg(hit), 4) AS delivered, round(avg(ceiling_hit - hit), 4) AS gap, round(avg(ceiling_hit - hit), 4) > 0.05 AS rerank_loses FROM sa",
    "judge_agreement": f"""{_JUDGE}, s AS (SELECT count(*) AS n, round(avg((a = b)::INT), 4) AS exact, round(avg((abs(a - b) <= 1)::INT), 4) AS within_one, round(sum((a >= 1 AND b >= 1)::INT) / sum((b >= 1)::INT), 4) AS precision, round(sum((a >= 1 AND b >= 1)::INT) / sum((a >= 1)::INT), 4) AS recall FROM p) SELECT *, precision >= 0.8 AS passes FROM s""",
    "judge_confusion": f"{_JUDGE}, c AS (SELECT x.range::INT AS a, y.range::INT AS b FROM range(3) x, range(3) y) SELECT c.a, c.b, count(p.a) AS n FROM c LEFT JOIN p ON p.a = c.a AND p.b = c.b GROUP BY c.a, c.b",
    "score_gaps": f"{_GAPS} SELECT * FROM g",
    "gap_cutoffs": f"""{_GAPS}, b AS (SELECT query_id, list_sort(list(gap))[count(*) // 2 + 1] AS m, max(rank) AS last FROM g GROUP BY query_id), k AS (SELECT unnest([1.0, 1.5, 2.0, 2.5, 3.0])::DOUBLE AS multiple)
SELECT g.query_id, multiple, coalesce(min(CASE WHEN gap > multiple * m THEN rank END), max(last) + 1) AS cut FROM g JOIN b USING (query_id), k GROUP BY g.query_id, multiple""",
    "floor_counts": f"WITH {_run_sql('run')} SELECT query_id, " + ", ".join(f"count(*) FILTER (score >= {f}) AS n_{i}" for i, f in enumerate([0.0, 0.01, 0.05, 0.1, 0.5])) + " FROM run GROUP BY query_id",
    "first_pos_rank": f"WITH {_run_sql('run')}, {_QREL} SELECT q.query_id, coalesce(f.first_rank, 0) AS first_rank, t.score AS score_at_10 FROM (SELECT DISTINCT query_id FROM qrel WHERE id <> query_id) q LEFT JOIN (SELECT query_id, min(rank) AS first_rank FROM run JOIN qrel USING (query_id, id) WHERE id <> query_id GROUP BY query_id) f USING (query_id) LEFT JOIN (SELECT * FROM run WHERE rank = 10) t USING (query_id)",
    "paired_delta": f"{_PAIR} SELECT * FROM pair",
    "paired_summary": f"{_PAIR} SELECT count(*) AS n, round(avg(y - x), 6) AS mean_delta, round(stddev_samp(y - x), 6) AS sd_delta, round(coalesce(corr(x, y), 0), 6) AS rho, round(2.802 * stddev_samp(y - x) / sqrt(count(*)), 6) AS mde FROM pair",
    "sign_test_counts": f"{_PAIR} SELECT count(*) FILTER (delta > 0) AS plus, count(*) FILTER (delta < 0) AS minus, count(*) FILTER (delta = 0) AS zero FROM pair",
    "wilcoxon_ranks": f"""{_PAIR}, r AS (SELECT delta, rank() OVER (ORDER BY abs(delta)) + (count(*) OVER (PARTITION BY abs(delta)) - 1) / 2.0 AS rk FROM pair WHERE delta <> 0),
s AS (SELECT count(*) AS n, coalesce(sum(rk) FILTER (delta > 0), 0)::DOUBLE AS w_plus, coalesce(sum(rk) FILTER (delta < 0), 0)::DOUBLE AS w_minus FROM r)
SELECT n, w_plus, w_minus, round(coalesce(greatest(abs(least(w_plus, w_minus) - n * (n + 1) / 4.0) - 0.5, 0) / nullif(sqrt(n * (n + 1) * (2 * n + 1) / 24.0), 0), 0), 6) AS z FROM s""",
    "mde_table": "SELECT rho::DOUBLE AS rho, round(0.3111 * sqrt(2 * (1 - rho)), 4) AS sd_delta, round(2.802 * 0.3111 * sqrt(2 * (1 - rho)) / sqrt(200), 4) AS mde FROM (SELECT unnest([0.0, 0.5, 0.7, 0.9, 0.95])::DOUBLE AS rho)",
    "coverage_stats": "SELECT source, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most, list_sort(list(n_chars))[count(*) // 2 + 1] AS upper_median, list_sort(list(n_chars))[least(floor(count(*) * 0.9), count(*) - 1)::BIGINT + 1] AS p90, round(quantile_cont(n_chars, 0.5), 4) AS median, round(coalesce(stddev_samp(n_chars), 0), 4) AS sd FROM documents GROUP BY source",
    "ratio_stats": f"""WITH r AS (SELECT lang, n_chars / greatest({_WORDS.format('text')}, 1) AS ratio FROM documents WHERE n_chars > 0),
s AS (SELECT lang, round(avg(ratio), 6) AS mean, round(quantile_cont(ratio, 0.5), 6) AS median, round(list_sort(list(ratio))[least(floor(count(*) * 0.95), count(*) - 1)::BIGINT + 1], 6) AS p95, round(coalesce(stddev_samp(ratio), 0), 6) AS sd FROM r GROUP BY lang) SELECT *, round_even(250 * mean, 0)::BIGINT AS threshold FROM s""",
    "lexical_overlap": f"WITH q AS (SELECT item_id, {_TERMS} AS q FROM benchmark), d AS (SELECT doc_id AS item_id, {_TERMS} AS c FROM documents) SELECT item_id, round(CASE WHEN len(q) > 0 THEN len(list_intersect(q, c)) / len(q) ELSE 0 END, 6) AS overlap FROM q JOIN d USING (item_id)",
    "stratified_allocate": f"{_ALLOC} SELECT * FROM p",
    "stratified_sample": f"{_ALLOC}, r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_HASH.format('doc_id')}, doc_id) AS r FROM documents) SELECT lang, doc_id FROM r JOIN p USING (lang) WHERE r <= n",
    "blind_batches": "SELECT doc_id, text AS candidate_text, ((row_number() OVER (ORDER BY doc_id) - 1) % 8)::INT AS batch FROM documents",
    "live_reconcile": """WITH g AS (SELECT doc_id AS query_id, unnest([doc_id, doc_id + 3, doc_id + 1]) AS id, unnest([0, 1, 2]) AS pos FROM documents)
SELECT query_id, string_agg(id::VARCHAR, ',' ORDER BY pos) AS positive_ids FROM g WHERE id IN (SELECT doc_id FROM labels) GROUP BY query_id""",
    "child_parent_join": "SELECT c.conv_id, c.turn, coalesce(p.text, '') AS parent_text FROM conversations c LEFT JOIN (SELECT * FROM conversations WHERE turn = 0) p ON p.conv_id = c.conv_id",
    "orphan_parents": "SELECT doc_id AS parent_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "incremental_todo": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "hard_negatives": f"""WITH n AS (SELECT a.doc_id AS query_id, b.doc_id AS id, CASE WHEN a.lang = b.lang THEN 0 ELSE 1 END AS tier, {_HASH.format('b.doc_id')} AS h FROM documents a JOIN documents b ON a.source = b.source AND a.doc_id <> b.doc_id WHERE a.doc_id % 20 = 0)
SELECT query_id, id, tier, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, h) AS place FROM n) WHERE place <= 6""",
    "eligible_chunks": f"WITH w AS (SELECT doc_id, text, {_WORDS.format('text')} AS n_words FROM documents) SELECT doc_id, n_words FROM w WHERE n_words BETWEEN 90 AND 250 AND NOT regexp_matches(lower(text), '^\\s*(index|contents|preface)\\b')",
    "junk_filter": f"WITH q AS (SELECT doc_id, (unnest(generate_series(0, len(string_split(text, chr(10))) - 1)))::INT AS ln, unnest(string_split(text, chr(10))) AS query FROM documents) SELECT doc_id, ln, query FROM q WHERE NOT regexp_matches(query, '(?i)(^| )(the|una?)( |$)') AND length(query) >= 10 AND {_WORDS.format('query')} <= 12",
    "index_page_strip": """WITH p AS (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page FROM documents), f AS (SELECT *, regexp_matches(trim(string_split(CASE WHEN page > 45 THEN 'Index (part ' || page || ') > x' ELSE lang || ' > Index' END, '>')[1]), '^Index \\(part \\d+\\)$') AS f FROM p),
g AS (SELECT source, count(*) FILTER (f) AS flagged, (min(page) FILTER (f))::INT AS first_page, (max(page) FILTER (f))::INT AS last_page, (max(page) FILTER (NOT f))::INT AS kept_last FROM f GROUP BY source) SELECT *, coalesce(first_page < 0.5 * kept_last, false) AS warn FROM g""",
    "grade_parse": "SELECT event_id, least(2, event_id % 4)::INT AS g0, least(2, user_id % 3)::INT AS g1 FROM events",
    "junk_key_counts": "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key",
    "scrubbed_key_counts": "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) WHERE key IN ('ip', 'session', 'k', 'page') GROUP BY key",
    # the objects are flat
    "scrub_keys": """WITH k AS (SELECT event_id, props, list_sort(json_keys(props)) AS ks FROM events)
SELECT event_id, '{' || array_to_string(list_transform(list_filter(ks, lambda x: x NOT IN ('ip', 'session', 'k', 'page')), lambda x: '"' || x || '":' || (json_extract(props, '$."' || x || '"'))::VARCHAR), ',') || '}' AS props, len(list_filter(ks, lambda x: x IN ('ip', 'session', 'k', 'page'))) AS removed FROM k""",
}
