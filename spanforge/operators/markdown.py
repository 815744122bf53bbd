"""Markdown transforms on tables (slug, markdown): line-oriented plans without Python functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions.text import strip_ws

# Heading texts that mark front and back matter.
FRONT_MATTER = [
    "table of contents", "contents", "copyright", "dedication",
    "about the author", "about the reviewer", "about the technical",
    "preface", "acknowledgment", "foreword", "contributor",
    "join our community", "discord", "landmarks", "cover",
    "who this book is for", "what this book covers",
    "what you need for this book", "conventions used",
    "get in touch", "download the example", "packt.link",
    "to get the most out", "sections", "reviews", "leave a review",
    "making the most out", "unlock your book", "how to unlock",
    "running a jupyter", "conventions", "code in action",
    "why subscribe", "packtpub", "packt.com", "subscribe",
]
BACK_MATTER_EXACT = ["index", "subject index", "author index"]
BACK_MATTER = ["other books you may enjoy", "packt page", "download a free pdf"]
METADATA_KEYS = "Title|Authors?|Language|Publisher|Date|Description|Identifier"

_FENCE = r"^\s*```"


def clean_markdown(md: Column) -> Column:
    """Converter noise out: metadata lines, images, escapes, span and div tags, long runs of blank lines."""
    md = F.regexp_replace(md, rf"(?m)^\*\*(?:{METADATA_KEYS})\*\*:.*\n", "")
    md = F.regexp_replace(md, r"!\[[^\]]*\]\([^)]*\)", "")
    md = F.regexp_replace(md, r"\\([-*_.\[\]])", "$1")
    md = F.regexp_replace(md, r"</?span[^>]*>", "")
    md = F.regexp_replace(md, r"</?div[^>]*>", "")
    md = F.regexp_replace(md, r"\n{4,}", "\n\n\n")
    return F.concat(strip_ws(md), F.lit("\n"))


def neutralise_headings(md: Column) -> Column:
    """Headings of a page body are indented by a space and so are none."""
    return F.regexp_replace(md, r"(?m)^(#{1,6}\s)", " $1")


def lines_of(md: DataFrame, slug: str = "slug", text: str = "markdown") -> DataFrame:
    """(slug, ln, line) with line numbers from 0."""
    return md.select(slug, F.posexplode(F.split(text, "\n")).alias("ln", "line"))


def _joined(lines: DataFrame, name: str = "markdown") -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("ln", "line")))
    return lines.groupBy("slug").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias(name))


def with_fences(lines: DataFrame) -> DataFrame:
    """``toggle`` marks fence lines, ``in_code`` lines within a fence (its first line included, its last not)."""
    so_far = Window.partitionBy("slug").orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    toggle = F.col("line").rlike(_FENCE)
    return lines.withColumn("toggle", toggle).withColumn("in_code", F.sum(toggle.cast("int")).over(so_far) % 2 == 1)


def _level(line: Column) -> Column:
    return F.length(F.regexp_extract(line, r"^(#{1,6})\s+", 1))


def heading_text(line: Column) -> Column:
    return F.regexp_replace(line, r"^#{1,6}\s+", "")


def is_front_matter(heading: Column) -> Column:
    low = F.lower(heading)
    return F.exists(F.array(*[F.lit(p) for p in FRONT_MATTER]), lambda p: F.contains(low, p))


def is_back_matter(heading: Column) -> Column:
    low = F.lower(strip_ws(heading))
    return low.isin(BACK_MATTER_EXACT) | F.exists(F.array(*[F.lit(p) for p in BACK_MATTER]), lambda p: F.contains(low, p))


def strip_matter(md: DataFrame) -> DataFrame:
    """Front and back matter off; the start is a numbered chapter within the first 40 % of the lines, or the first other heading that is no front matter."""
    lines = lines_of(md)
    text = strip_ws(heading_text(F.col("line")))
    whole = Window.partitionBy("slug")
    marked = lines.withColumns({"head": F.col("line").rlike(r"^#{1,2}\s+"), "text": text, "n": F.count("*").over(whole)})
    early = F.col("head") & (F.col("ln") <= F.floor(F.col("n") * 0.4)) & F.col("text").rlike(r"(?i)^(\d+|chapter\s+\d+)$")
    body = F.col("head") & ~is_front_matter(F.col("text"))
    bounded = marked.withColumn("start", F.coalesce(F.min(F.when(early, F.col("ln"))).over(whole), F.min(F.when(body, F.col("ln"))).over(whole), F.lit(0)))
    back = F.col("head") & is_back_matter(F.col("text")) & (F.col("ln") > F.col("start"))
    bounded = bounded.withColumn("stop", F.coalesce(F.max(F.when(back, F.col("ln"))).over(whole), F.col("n")))
    kept = bounded.where((F.col("ln") >= F.col("start")) & (F.col("ln") < F.col("stop")))
    return _joined(kept.select("slug", "ln", "line")).withColumn("markdown", F.concat(strip_ws(F.col("markdown")), F.lit("\n")))


def normalise_headings(md: DataFrame, fence_aware: bool = False) -> DataFrame:
    """Headings are raised so that the highest is of level 1; the highest is sought in fences too unless ``fence_aware``."""
    lines = with_fences(lines_of(md)).withColumn("level", _level(F.col("line")))
    counted = (F.col("level") > 0) & (~F.col("in_code") if fence_aware else F.lit(True))
    top = F.min(F.when(counted, F.col("level"))).over(Window.partitionBy("slug"))
    shift = F.coalesce(top - 1, F.lit(0))
    raised = F.concat(F.repeat(F.lit("#"), F.greatest(F.col("level") - shift, F.lit(1))), F.substring(F.col("line"), F.col("level") + 1, F.length("line")))
    new = F.when((shift > 0) & (F.col("level") > 0) & ~F.col("in_code"), raised).otherwise(F.col("line"))
    return _joined(lines.select("slug", "ln", new.alias("line")))


def demote_headings(md: DataFrame, by: int = 2) -> DataFrame:
    """Headings outside fences are lowered, to level 6 at most."""
    lines = with_fences(lines_of(md)).withColumn("level", _level(F.col("line")))
    lower = F.concat(F.repeat(F.lit("#"), F.least(F.col("level") + by, F.lit(6))), F.substring(F.col("line"), F.col("level") + 1, F.length("line")))
    new = F.when((F.col("level") > 0) & ~F.col("in_code"), lower).otherwise(F.col("line"))
    return _joined(lines.select("slug", "ln", new.alias("line")))


def balance_fences(md: Column) -> Column:
    """A closing fence is appended where fences are odd in number."""
    odd = F.regexp_count(md, F.lit(r"(?m)^[ \t]*```")) % 2 == 1
    return F.when(odd, F.concat(md, F.lit("\n```"))).otherwise(md)


def sections(md: DataFrame) -> DataFrame:
    """(slug, ord, text, chapter, section, heading_path): cut at headings of levels 1 and 2 outside fences."""
    lines = with_fences(lines_of(md))
    outside = ~F.col("in_code") & ~F.col("toggle")
    h1 = F.when(outside, F.nullif(strip_ws(F.regexp_extract("line", r"^#\s+(.+)", 1)), F.lit("")))
    h2 = F.when(outside, F.nullif(strip_ws(F.regexp_extract("line", r"^##\s+(.+)", 1)), F.lit("")))
    lines = lines.withColumns({"h1": h1, "h2": h2})
    so_far = Window.partitionBy("slug").orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumns({"part": F.sum((F.col("h1").isNotNull() | F.col("h2").isNotNull()).cast("int")).over(so_far), "chapter_no": F.sum(F.col("h1").isNotNull().cast("int")).over(so_far)})
    in_chapter = Window.partitionBy("slug", "chapter_no").orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumns({"chapter": F.coalesce(F.last("h1", True).over(so_far), F.lit("")), "section": F.coalesce(F.last("h2", True).over(in_chapter), F.lit(""))})
    ordered = F.array_sort(F.collect_list(F.struct("ln", "line")))
    parts = lines.groupBy("slug", "part").agg(F.max("chapter").alias("chapter"), F.max("section").alias("section"), strip_ws(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")).alias("text"))
    path = F.when(F.col("section") == "", F.col("chapter")).when(F.col("chapter") == "", F.col("section")).otherwise(F.concat_ws(" > ", "chapter", "section"))
    kept = parts.where("text <> ''").withColumn("heading_path", path)
    return kept.select("slug", (F.row_number().over(Window.partitionBy("slug").orderBy("part")) - 1).cast("long").alias("ord"), "text", "chapter", "section", "heading_path")


def chapter_numbers(parts: DataFrame) -> DataFrame:
    """Parts (slug, ord, chapter) with ``chapter_no``: it grows where a named chapter differs from the part before."""
    order = Window.partitionBy("slug").orderBy("ord")
    change = (F.col("chapter") != "") & (F.col("chapter") != F.coalesce(F.lag("chapter").over(order), F.lit("")))
    return parts.withColumn("_c", change.cast("int")).withColumn("chapter_no", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("string")).drop("_c")


def heading_counts(md: DataFrame) -> DataFrame:
    """Headings of levels 1 to 3 of each document, fences not considered."""
    return md.select("slug", *[F.regexp_count("markdown", F.lit(rf"(?m)^#{{{n}}}\s+\S")).alias(f"h{n}") for n in (1, 2, 3)])


def chapters(md: DataFrame, fence_aware: bool = True) -> DataFrame:
    """(slug, ln, title) of the first-level headings."""
    lines = with_fences(lines_of(md))
    keep = F.col("line").rlike(r"^#\s+\S") & (~F.col("in_code") if fence_aware else F.lit(True))
    return lines.where(keep).select("slug", "ln", strip_ws(F.regexp_replace("line", r"^#\s+", "")).alias("title"))


def get_chapter(md: DataFrame, query: str, limit: int = 50_000) -> DataFrame:
    """Of each document the first chapter whose heading contains the query or is contained in it, up to ``limit`` characters."""
    lines = with_fences(lines_of(md))
    head = F.when(~F.col("in_code"), F.nullif(F.lower(strip_ws(F.regexp_extract("line", r"^#\s+(.+)", 1))), F.lit("")))
    so_far = Window.partitionBy("slug").orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    low = F.lit(query.lower())
    lines = lines.withColumn("head", head).withColumn("no", F.sum(F.col("head").isNotNull().cast("int")).over(so_far))
    hit = F.contains(F.col("head"), low) | F.contains(low, F.col("head"))
    lines = lines.withColumn("first", F.min(F.when(hit, F.col("no"))).over(Window.partitionBy("slug")))
    text = _joined(lines.where("no = first").select("slug", "ln", "line"), "chapter")
    notice = F.lit("\n\n[truncated]")
    return text.withColumn("chapter", F.when(F.length("chapter") > limit, F.concat(F.substring("chapter", 1, limit), notice)).otherwise(F.col("chapter")))


def inject_toc(pages: DataFrame, toc: DataFrame, deepest: int = 3) -> DataFrame:
    """(slug, markdown) of pages (slug, page, text) with the table of contents (slug, page, ord, level, title) as headings before their pages."""
    heads = toc.where(F.trim("title") != "").select("slug", "page", "ord", F.concat(F.repeat(F.lit("#"), F.least("level", F.lit(deepest))), F.lit(" "), F.trim("title")).alias("piece"))
    body = pages.select("slug", "page", F.lit(1 << 30).alias("ord"), strip_ws(neutralise_headings(F.col("text"))).alias("piece")).where("piece <> ''")
    both = heads.withColumn("ord", F.col("ord").cast("int")).unionByName(body)
    ordered = F.array_sort(F.collect_list(F.struct("page", "ord", "piece")))
    return both.groupBy("slug").agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), "\n\n").alias("markdown"))


def headings_by_size(lines: DataFrame, deepest: int = 3, longest: int = 200) -> DataFrame:
    """(slug, page, ln, level, title) of the lines (slug, page, ln, text, size) set larger than their book's body.

    The body's size is that of most characters (of equals the smaller); the sizes above it give the levels, largest first. Lines of
    over ``longest`` characters, and of sizes beyond ``deepest``, are no headings.
    """
    chars = lines.groupBy("slug", "size").agg(F.sum(F.length("text")).alias("chars"))
    body = chars.groupBy("slug").agg(F.max_by("size", F.struct("chars", -F.col("size"))).alias("body"))
    above = chars.join(body, "slug").where("size > body")
    levels = above.withColumn("level", F.row_number().over(Window.partitionBy("slug").orderBy(F.desc("size")))).where(F.col("level") <= deepest)
    heads = lines.join(levels.select("slug", "size", "level"), ["slug", "size"])
    return heads.where((F.length("text") <= longest) & (F.trim("text") != "")).select("slug", "page", "ln", "level", F.trim("text").alias("title"))
