"""Queries of the experiment operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.operators import experiments as P
from spanforge.operators import markdown as M
from spanforge.session import read_table


def promote_headings(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    lines = docs.select(F.col("doc_id").alias("slug"), F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    # titles of one to three lines
    first = F.transform(F.slice(F.split("text", "\n"), F.lit(1), (F.col("doc_id") % 3 + 1).cast("int")), lambda x: F.trim(x))
    titles = docs.select(F.col("doc_id").alias("slug"), F.array_join(first, " ").alias("title")).where("title <> ''")
    return P.promote_headings(lines, titles)


def late_pool(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    tokens = e.select(F.col("label").alias("parent_id"), (F.col("vec_id") * 4).alias("low"), (F.col("vec_id") * 4 + 4).alias("high"), F.col("embedding").alias("vector"))
    spans = e.select(F.col("label").alias("parent_id"), F.col("vec_id").alias("child_id"), (F.col("vec_id") * 4 - 30).alias("start"), (F.col("vec_id") * 4 + 90).alias("stop"))
    return P.late_pool(tokens, spans).select("parent_id", "child_id", "i", F.round("x", 6).alias("x"))


def frozen_background(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").where("doc_id % 20 = 0")
    own = docs.select(F.col("doc_id").alias("query_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"))
    background = read_table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("id"))
    return P.frozen_background(background, own, own)


def render_prompt(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    heading = F.when(F.col("doc_id") % 2 == 0, F.lit("12")).otherwise(F.col("lang"))
    return docs.select("doc_id", P.prompt("Book %s%s: %s", {"text": 500}, source=F.col("source"), where=P.location(heading), text=F.col("text")).alias("prompt"))


def train_dev_split(spark, sf_dir):
    return P.split_by_order(read_table(spark, sf_dir, "documents").select("doc_id", "lang"), {"train": 10, "dev": 5}, "doc_id", ["lang"])


def array_key_join(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations")
    key = F.array((F.col("conv_id") % 10).cast("long"), F.col("turn").cast("long"))
    left = conv.select("conv_id", "turn", key.alias("k"))
    right = conv.where("role = 'assistant'").select(key.alias("k"), F.col("conv_id").alias("easy_id"))
    return P.join_on_array(left, right, "k", "easy_id").select("conv_id", "turn", F.coalesce("easy_id", F.lit(-1)).alias("easy_id"))


def label_rollup(spark, sf_dir):
    rows = read_table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    return P.label_rollup(rows, ["good", "toxic"])


def distinct_queries(spark, sf_dir):
    rows = read_table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.col("text").alias("query"))
    return P.distinct_queries(rows, "query", "qid")


#: Ways to ask for the context of a passage.
INSTRUCTIONS = {
    "plain": "Say in one sentence where this passage of %s stands: %s",
    "terms": "Name the terms that a reader of %s would look this passage up by: %s",
    "question": "Write the question about %s that this passage answers: %s",
    "summary": "Sum up this passage of %s in two sentences: %s",
}


def prompt_variants(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return P.prompt_variants(docs, INSTRUCTIONS, {"text": 4000}, source=F.col("source"), text=F.col("text")).select("doc_id", "variant", "prompt")


def headings_by_size(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations")
    size = F.when(F.col("turn") == 0, 22.0).when(F.col("role") == "assistant", 14.0).otherwise(10.0 + F.col("conv_id") % 3)
    lines = conv.select((F.col("conv_id") % 10).cast("string").alias("slug"), "conv_id", "turn", F.col("conv_id").alias("page"), F.col("turn").alias("ln"), "text", size.alias("size"))
    return M.headings_by_size(lines)


QUERIES = {f.__name__: f for f in (promote_headings, late_pool, frozen_background, render_prompt, train_dev_split, array_key_join, label_rollup, distinct_queries, prompt_variants, headings_by_size)}

ORACLE = {
    "promote_headings": """WITH d AS (SELECT * FROM documents), l AS (SELECT doc_id AS slug, unnest(generate_series(0, len(string_split(text, chr(10))) - 1))::INT AS ln, unnest(string_split(text, chr(10))) AS line FROM d),
t AS (SELECT doc_id AS slug, array_to_string(list_transform(string_split(text, chr(10))[1 : (doc_id % 3 + 1)::INT], lambda x: trim(x)), ' ') AS title FROM d),
o AS (SELECT slug, ln, trim(line) AS a, trim(lead(line, 1) OVER w) AS b, trim(lead(line, 2) OVER w) AS c FROM l WINDOW w AS (PARTITION BY slug ORDER BY ln)),
j AS (SELECT slug, ln, 0 AS more, a AS title FROM o WHERE a <> '' UNION ALL SELECT slug, ln, 1, concat_ws(' ', a, b) FROM o WHERE a <> '' UNION ALL SELECT slug, ln, 2, concat_ws(' ', a, b, c) FROM o WHERE a <> ''),
m AS (SELECT j.*, count(*) OVER (PARTITION BY slug, title) AS n FROM j JOIN t USING (slug, title) WHERE title <> ''),
best AS (SELECT slug, ln, arg_min(title, more) AS title FROM m WHERE n = 1 GROUP BY slug, ln)
SELECT l.slug, l.ln, CASE WHEN best.title IS NOT NULL THEN '## ' || best.title ELSE line END AS line FROM l LEFT JOIN best USING (slug, ln)""",
    "late_pool": """WITH s AS (SELECT label AS parent_id, vec_id AS child_id, vec_id * 4 - 30 AS a, vec_id * 4 + 90 AS b FROM embeddings),
p AS (SELECT parent_id, child_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings JOIN s ON label = parent_id AND vec_id * 4 + 4 > a AND vec_id * 4 < b)
SELECT parent_id, child_id, i::INT AS i, round(avg(x), 6) AS x FROM p GROUP BY parent_id, child_id, i""",
    "frozen_background": "SELECT doc_id AS query_id, 'b' || item_id AS id FROM documents, benchmark WHERE doc_id % 20 = 0 UNION ALL SELECT doc_id, 'd' || doc_id FROM documents WHERE doc_id % 20 = 0",
    "render_prompt": "SELECT doc_id, 'Book ' || source || CASE WHEN doc_id % 2 = 0 THEN '' ELSE ' in ' || lang END || ': ' || substr(text, 1, 500) AS prompt FROM documents",
    "train_dev_split": """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('42' || doc_id), doc_id) AS r FROM documents)
SELECT doc_id, lang, CASE WHEN r <= 10 THEN 'train' ELSE 'dev' END AS part FROM r WHERE r <= 15""",
    "array_key_join": """WITH r AS (SELECT conv_id % 10 AS a, turn AS b, max(conv_id) AS easy_id FROM conversations WHERE role = 'assistant' GROUP BY 1, 2)
SELECT conv_id, turn, coalesce(easy_id, -1) AS easy_id FROM conversations LEFT JOIN r ON conv_id % 10 = a AND turn = b""",
    "label_rollup": "SELECT count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic, round(100.0 * count(*) FILTER (quality = 1) / greatest(count(*), 1), 2) AS good_pct, round(100.0 * count(*) FILTER (toxic = 1) / greatest(count(*), 1), 2) AS toxic_pct FROM labels",
    "distinct_queries": "SELECT qid, query FROM (SELECT conv_id * 1000 + turn AS qid, text AS query, row_number() OVER (PARTITION BY lower(text) ORDER BY conv_id * 1000 + turn) AS n FROM conversations) WHERE n = 1",
    "prompt_variants": " UNION ALL ".join(
        f"SELECT doc_id, '{name}' AS variant, '{a}' || coalesce(source, '') || '{b}' || substr(coalesce(text, ''), 1, 4000) AS prompt FROM documents" for name, (a, b, _) in ((n, t.split("%s")) for n, t in INSTRUCTIONS.items())
    ),
    "headings_by_size": """WITH l AS (SELECT (conv_id % 10)::VARCHAR AS slug, conv_id AS page, turn AS ln, text, CASE WHEN turn = 0 THEN 22.0 WHEN role = 'assistant' THEN 14.0 ELSE 10.0 + conv_id % 3 END::DOUBLE AS size FROM conversations),
c AS (SELECT slug, size, sum(length(text)) AS chars FROM l GROUP BY slug, size), b AS (SELECT slug, size AS body FROM c QUALIFY row_number() OVER (PARTITION BY slug ORDER BY chars DESC, size) = 1),
v AS (SELECT slug, size, row_number() OVER (PARTITION BY slug ORDER BY size DESC) AS level FROM c JOIN b USING (slug) WHERE size > body)
SELECT slug, page, ln, level::INT AS level, trim(text) AS title FROM l JOIN v USING (slug, size) WHERE level <= 3 AND length(text) <= 200 AND trim(text) <> ''""",
}
