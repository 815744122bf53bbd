"""Ingestion and markdown queries over a markdown corpus composed from ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.functions import text as X
from spanforge.operators import markdown as M
from spanforge.session import read_table
from spanforge.sources import converters

_FENCED = "'```' || chr(10) || '# not a heading' || chr(10) || '```' || chr(10)"

#: Markdown books of the documents of a source, with ids in a run of ``BOOK_IDS``, so that a book's size does not grow with the table; every seventh document holds a fenced line that looks like a heading.
BOOK_IDS = 10_000
SQL_MD = f"""md AS (SELECT source || '-' || doc_id // {BOOK_IDS} AS slug, string_agg('# ' || lang || chr(10) || '## doc ' || doc_id || chr(10)
  || CASE WHEN doc_id % 7 = 0 THEN {_FENCED} ELSE '' END || text, chr(10) ORDER BY lang, doc_id) AS markdown FROM documents GROUP BY slug)"""
SQL_LINES = """lines AS (SELECT slug, unnest(generate_series(0, len(string_split(markdown, chr(10))) - 1)) AS ln, unnest(string_split(markdown, chr(10))) AS line FROM {src}),
fl AS (SELECT *, regexp_matches(line, '^\\s*```') AS toggle, sum(CASE WHEN regexp_matches(line, '^\\s*```') THEN 1 ELSE 0 END) OVER (PARTITION BY slug ORDER BY ln) % 2 = 1 AS in_code FROM lines)"""
_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


def _lines(src: str = "md") -> str:
    return SQL_LINES.replace("{src}", src)


def book_markdown(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    fenced = F.when(F.col("doc_id") % 7 == 0, F.lit("```\n# not a heading\n```\n")).otherwise("")
    body = F.concat(F.lit("# "), "lang", F.lit("\n## doc "), F.col("doc_id").cast("string"), F.lit("\n"), fenced, "text")
    rows = docs.select(F.concat_ws("-", "source", F.floor(F.col("doc_id") / BOOK_IDS)).alias("slug"), F.struct("lang", "doc_id", body.alias("body")).alias("s"))
    return rows.groupBy("slug").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["body"]), "\n").alias("markdown"))


def _noisy(md):
    return F.concat(F.lit("**Title**: A book\n**Author**: N\n"), F.replace(md, F.lit("th "), F.lit("th\\- ![fig](x.png) <span class=a>")), F.lit("\n\n\n\n\n\n"))


def clean_markdown(spark, sf_dir):
    return book_markdown(spark, sf_dir).select("slug", M.clean_markdown(_noisy(F.col("markdown"))).alias("markdown"))


def _framed(md):
    return F.concat(F.lit("# Preface\nintro\n## Contents\nlist\n"), md, F.lit("\n# Index\nterms, 1, 2"))


def strip_matter(spark, sf_dir):
    return M.strip_matter(book_markdown(spark, sf_dir).withColumn("markdown", _framed(F.col("markdown"))))


def strip_matter_numbered(spark, sf_dir):
    numbered = F.concat(F.lit("# Opening words\ntext\n# Chapter 1\n"), "markdown")
    return M.strip_matter(book_markdown(spark, sf_dir).withColumn("markdown", numbered))


def _lowered(md):
    return md.withColumn("markdown", F.regexp_replace("markdown", "(?m)^(#{1,2} [^n])", "##$1"))


def normalize_headings(spark, sf_dir):
    return M.normalise_headings(_lowered(book_markdown(spark, sf_dir)), fence_aware=True)


def normalize_headings_all_lines(spark, sf_dir):
    return M.normalise_headings(_lowered(book_markdown(spark, sf_dir)))


def demote_headings(spark, sf_dir):
    return M.demote_headings(book_markdown(spark, sf_dir))


def balance_fences(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    opened = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("```\n"), "text")).otherwise(F.col("text"))
    return docs.select("doc_id", M.balance_fences(opened).alias("markdown"))


def toc_inject(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations")
    pages = conv.select(F.col("conv_id").cast("string").alias("slug"), F.col("turn").alias("page"), F.concat(F.lit("# x\n"), "text").alias("text"))
    toc = conv.select(F.col("conv_id").cast("string").alias("slug"), F.col("turn").alias("page"), F.lit(0).alias("ord"), (F.col("turn") % 5 + 1).cast("int").alias("level"), F.when(F.col("turn") % 3 == 2, " ").otherwise(F.col("role")).alias("title"))
    return M.inject_toc(pages, toc)


def extract_sections(spark, sf_dir):
    return M.sections(book_markdown(spark, sf_dir))


def chapter_numbering(spark, sf_dir):
    return M.chapter_numbers(M.sections(book_markdown(spark, sf_dir)).select("slug", "ord", "chapter"))


def heading_counts(spark, sf_dir):
    return M.heading_counts(book_markdown(spark, sf_dir))


def list_books(spark, sf_dir):
    found = M.chapters(book_markdown(spark, sf_dir), fence_aware=False).groupBy("slug").agg(F.count("*").alias("n_chapters"), F.countDistinct("title").alias("n_titles"), F.min("title").alias("first_title"))
    return found.select("slug", X.titleize(F.col("slug")).alias("title"), "n_chapters", "n_titles", "first_title")


def get_chapter(spark, sf_dir):
    return M.get_chapter(book_markdown(spark, sf_dir), "FR")


def last_sentences(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", X.last_sentences(F.col("text")).alias("overlap"))


def garble_ratio(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", F.round(X.garble_ratio(F.col("text"), "\\u00E0-\\u00FF"), 6).alias("ratio"))


def slug_domain(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages")
    found = X.place(F.regexp_extract("url", "^[a-z]+://[^/]+/(.*)$", 1))
    return pages.select("page_id", *[c.alias(n) for n, c in found.items()], X.titleize(found["slug"]).alias("title"))


def html_text_extract(spark, sf_dir):
    html = F.regexp_replace("html", r"(?is)<(script|style|nav|footer)\b.*?</(script|style|nav|footer)>", "")
    html = F.regexp_replace(html, r"(?is)<h1[^>]*>", "\n# ")
    html = F.regexp_replace(html, r"(?is)<li[^>]*>", "\n- ")
    html = F.regexp_replace(html, r"(?is)</?(p|div|article|h1|ul|ol|body|head|html|title)[^>]*>", "\n")
    html = F.regexp_replace(html, r"(?s)<[^>]+>", "")
    html = F.regexp_replace(html, r"[ \t]*\n[ \t\n]*", "\n\n")
    return read_table(spark, sf_dir, "pages").select("page_id", X.strip_ws(html).alias("markdown"))


def html_convert(spark, sf_dir):
    """Pages through the converter of HTML files."""
    pages = read_table(spark, sf_dir, "pages")
    files = pages.select(F.col("page_id").cast("string").alias("slug"), F.lit("web").alias("domain"), F.lit(".html").alias("suffix"), F.encode("html", "UTF-8").alias("content"))
    return converters.raw_markdown(files).select("slug", "markdown", "error")


QUERIES = {f.__name__: f for f in (clean_markdown, strip_matter, strip_matter_numbered, normalize_headings, normalize_headings_all_lines, demote_headings, balance_fences, toc_inject, extract_sections, chapter_numbering, heading_counts, list_books, get_chapter, last_sentences, garble_ratio, slug_domain, html_text_extract, html_convert)}

_JOIN = "string_agg(line, chr(10) ORDER BY ln)"
_LEVEL = "length(regexp_extract(line, '^(#{1,6})\\s+', 1))"
_TITLE = "array_to_string(list_transform(list_filter(regexp_split_to_array({0}, '[-_\\s]+'), lambda w: w <> ''), lambda w: upper(w[1]) || w[2:]), ' ')"
_FRONT_LIST = ", ".join(f"'{p}'" for p in M.FRONT_MATTER)


def _strip_sql(src: str) -> str:
    head = _STRIP.format("regexp_replace(line, '^#{1,6}\\s+', '')")
    return f"""WITH {SQL_MD}, src AS ({src}), {_lines('src')},
h AS (SELECT *, regexp_matches(line, '^#{{1,2}}\\s+') AS head, lower({head}) AS txt, count(*) OVER (PARTITION BY slug) AS n FROM lines),
s AS (SELECT *, coalesce(min(CASE WHEN head AND ln <= floor(n * 0.4) AND regexp_full_match(txt, '(\\d+|chapter\\s+\\d+)') THEN ln END) OVER (PARTITION BY slug),
  min(CASE WHEN head AND len(list_filter([{_FRONT_LIST}], lambda p: contains(txt, p))) = 0 THEN ln END) OVER (PARTITION BY slug), 0) AS start FROM h),
e AS (SELECT *, coalesce(max(CASE WHEN head AND ln > start AND (txt IN ('index', 'subject index', 'author index') OR contains(txt, 'other books you may enjoy') OR contains(txt, 'packt page') OR contains(txt, 'download a free pdf')) THEN ln END) OVER (PARTITION BY slug), n) AS stop FROM s)
SELECT slug, {_STRIP.format(_JOIN)} || chr(10) AS markdown FROM e WHERE ln >= start AND ln < stop GROUP BY slug"""


def _normal_sql(aware: bool) -> str:
    counted = "AND NOT in_code" if aware else ""
    return f"""WITH {SQL_MD}, src AS (SELECT slug, regexp_replace(markdown, '(?m)^(#{{1,2}} [^n])', '##\\1', 'g') AS markdown FROM md), {_lines('src')},
l AS (SELECT *, {_LEVEL} AS level FROM fl), t AS (SELECT *, coalesce(min(CASE WHEN level > 0 {counted} THEN level END) OVER (PARTITION BY slug) - 1, 0) AS shift FROM l)
SELECT slug, string_agg(CASE WHEN shift > 0 AND level > 0 AND NOT in_code THEN repeat('#', greatest(level - shift, 1)) || substr(line, level + 1) ELSE line END, chr(10) ORDER BY ln) AS markdown FROM t GROUP BY slug"""


_SECTIONS = f"""{SQL_MD}, {_lines()},
hd AS (SELECT *, CASE WHEN NOT in_code AND NOT toggle THEN nullif({_STRIP.format("regexp_extract(line, '^#\\s+(.+)', 1)")}, '') END AS h1,
  CASE WHEN NOT in_code AND NOT toggle THEN nullif({_STRIP.format("regexp_extract(line, '^##\\s+(.+)', 1)")}, '') END AS h2 FROM fl),
pt AS (SELECT *, sum(CASE WHEN h1 IS NOT NULL OR h2 IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY slug ORDER BY ln) AS part, sum(CASE WHEN h1 IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY slug ORDER BY ln) AS cn FROM hd),
cf AS (SELECT *, coalesce(last_value(h1 IGNORE NULLS) OVER (PARTITION BY slug ORDER BY ln), '') AS chapter, coalesce(last_value(h2 IGNORE NULLS) OVER (PARTITION BY slug, cn ORDER BY ln), '') AS section FROM pt),
ag AS (SELECT slug, part, max(chapter) AS chapter, max(section) AS section, {_STRIP.format(_JOIN)} AS text FROM cf GROUP BY slug, part),
sec AS (SELECT slug, row_number() OVER (PARTITION BY slug ORDER BY part) - 1 AS ord, text, chapter, section,
  CASE WHEN section = '' THEN chapter WHEN chapter = '' THEN section ELSE chapter || ' > ' || section END AS heading_path FROM ag WHERE text <> '')"""

ORACLE = {
    "clean_markdown": f"""WITH {SQL_MD}, n AS (SELECT slug, '**Title**: A book' || chr(10) || '**Author**: N' || chr(10) || replace(markdown, 'th ', 'th\\- ![fig](x.png) <span class=a>') || repeat(chr(10), 6) AS t FROM md),
a AS (SELECT slug, regexp_replace(regexp_replace(t, '(?m)^\\*\\*(Title|Authors?|Language|Publisher|Date|Description|Identifier)\\*\\*:.*\\n', '', 'g'), '!\\[[^\\]]*\\]\\([^)]*\\)', '', 'g') AS t FROM n),
b AS (SELECT slug, regexp_replace(regexp_replace(replace(replace(replace(replace(t, '\\-', '-'), '\\*', '*'), '\\_', '_'), '\\.', '.'), '</?span[^>]*>', '', 'g'), '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g') AS t FROM a)
SELECT slug, {_STRIP.format('t')} || chr(10) AS markdown FROM b""",
    "strip_matter": _strip_sql("SELECT slug, '# Preface' || chr(10) || 'intro' || chr(10) || '## Contents' || chr(10) || 'list' || chr(10) || markdown || chr(10) || '# Index' || chr(10) || 'terms, 1, 2' AS markdown FROM md"),
    "strip_matter_numbered": _strip_sql("SELECT slug, '# Opening words' || chr(10) || 'text' || chr(10) || '# Chapter 1' || chr(10) || markdown AS markdown FROM md"),
    "normalize_headings": _normal_sql(True),
    "normalize_headings_all_lines": _normal_sql(False),
    "demote_headings": f"""WITH {SQL_MD}, {_lines()}, l AS (SELECT *, {_LEVEL} AS level FROM fl)
SELECT slug, string_agg(CASE WHEN level > 0 AND NOT in_code THEN repeat('#', least(level + 2, 6)) || substr(line, level + 1) ELSE line END, chr(10) ORDER BY ln) AS markdown FROM l GROUP BY slug""",
    "balance_fences": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '```' || chr(10) || text || chr(10) || '```' ELSE text END AS markdown FROM documents",
    "toc_inject": f"""WITH p AS (SELECT conv_id::VARCHAR AS slug, turn AS page, 0 AS ord, repeat('#', least(turn % 5 + 1, 3)::BIGINT) || ' ' || role AS piece FROM conversations WHERE turn % 3 <> 2
UNION ALL SELECT conv_id::VARCHAR, turn, 1, {_STRIP.format("(' # x' || chr(10) || text)")} FROM conversations)
SELECT slug, string_agg(piece, chr(10) || chr(10) ORDER BY page, ord) AS markdown FROM p GROUP BY slug""",
    "extract_sections": f"WITH {_SECTIONS} SELECT * FROM sec",
    "chapter_numbering": f"""WITH {_SECTIONS}, c AS (SELECT slug, ord, chapter, CASE WHEN chapter <> '' AND chapter <> coalesce(lag(chapter) OVER (PARTITION BY slug ORDER BY ord), '') THEN 1 ELSE 0 END AS c FROM sec)
SELECT slug, ord, chapter, (sum(c) OVER (PARTITION BY slug ORDER BY ord))::BIGINT::VARCHAR AS chapter_no FROM c""",
    "heading_counts": f"WITH {SQL_MD}, {_lines()} SELECT slug, " + ", ".join(f"count(*) FILTER (regexp_matches(line, '^#{{{n}}}\\s+\\S'))::INT AS h{n}" for n in (1, 2, 3)) + " FROM lines GROUP BY slug",
    "list_books": f"""WITH {SQL_MD}, {_lines()}, c AS (SELECT slug, {_STRIP.format("regexp_replace(line, '^#\\s+', '')")} AS title FROM lines WHERE regexp_matches(line, '^#\\s+\\S'))
SELECT slug, {_TITLE.format('slug')} AS title, count(*) AS n_chapters, count(DISTINCT c.title) AS n_titles, min(c.title) AS first_title FROM c GROUP BY slug""",
    "get_chapter": f"""WITH {SQL_MD}, {_lines()}, h AS (SELECT *, CASE WHEN NOT in_code THEN nullif(lower({_STRIP.format("regexp_extract(line, '^#\\s+(.+)', 1)")}), '') END AS head FROM fl),
n AS (SELECT *, sum(CASE WHEN head IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY slug ORDER BY ln) AS no FROM h), f AS (SELECT *, min(CASE WHEN contains(head, 'fr') OR contains('fr', head) THEN no END) OVER (PARTITION BY slug) AS first FROM n),
t AS (SELECT slug, {_JOIN} AS chapter FROM f WHERE no = first GROUP BY slug)
SELECT slug, CASE WHEN length(chapter) > 50000 THEN substr(chapter, 1, 50000) || chr(10) || chr(10) || '[truncated]' ELSE chapter END AS chapter FROM t""",
    "last_sentences": f"""WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace({_STRIP.format("replace(text, chr(10), ' ')")}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: length(x) > 20) AS s FROM documents)
SELECT doc_id, array_to_string(s[greatest(len(s) - 1, 1) : len(s)], ' ') AS overlap FROM s""",
    "garble_ratio": "SELECT doc_id, round(CASE WHEN length(text) > 0 THEN (length(text) - length(regexp_replace(text, '[\\x{00E0}-\\x{00FF}]', '', 'g'))) / length(text) ELSE 0 END, 6) AS ratio FROM documents",
    "slug_domain": f"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/(.*)$', 1) AS path FROM pages), q AS (SELECT page_id, path, string_split(path, '/') AS parts, regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', '') AS slug FROM p)
SELECT page_id, slug, CASE WHEN len(parts) > 1 THEN parts[1] ELSE 'general' END AS domain, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS suffix, {_TITLE.format('slug')} AS title FROM q""",
    "html_text_extract": f"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<(script|style|nav|footer)\\b.*?</(script|style|nav|footer)>', '', 'g') AS h FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?is)<h1[^>]*>', chr(10) || '# ', 'g'), '(?is)<li[^>]*>', chr(10) || '- ', 'g') AS h FROM a),
c AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?is)</?(p|div|article|h1|ul|ol|body|head|html|title)[^>]*>', chr(10), 'g'), '(?s)<[^>]+>', '', 'g') AS h FROM b),
d AS (SELECT page_id, regexp_replace(h, '[ \\t]*\\n[ \\t\\n]*', chr(10) || chr(10), 'g') AS h FROM c) SELECT page_id, {_STRIP.format('h')} AS markdown FROM d""",
    "html_convert": f"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<(head|script|style|nav|footer)\\b.*?</(head|script|style|nav|footer)>|<!.*?>', '', 'g'), '\\s+', ' ', 'g') AS h FROM
  (SELECT page_id, regexp_replace(html, '(?is)<(script|style)\\b.*?</(script|style)>', '', 'g') AS html FROM pages)),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(h, '<h1>', chr(10) || chr(10) || '# ', 'g'), '</?b>', '**', 'g'), '<br>', chr(10), 'g') AS h FROM a),
c AS (SELECT page_id, regexp_replace(regexp_replace(h, '</?(p|div|article|body|h1)[^>]*>', chr(10) || chr(10), 'g'), '<[^>]+>', '', 'g') AS h FROM b),
d AS (SELECT page_id, replace(replace(regexp_replace(regexp_replace(h, ' *\\n *', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '&quot;', '"'), '&amp;', '&') AS h FROM c)
SELECT page_id::VARCHAR AS slug, {_STRIP.format('h')} || chr(10) AS markdown, NULL::VARCHAR AS error FROM d""",
}
