"""Pieces of the offline experiments: heading promotion, late pooling, frozen-background scoring, splits and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.operators.labeling import hash_order


def promote_headings(lines: DataFrame, titles: DataFrame, ahead: int = 3, level: int = 2) -> DataFrame:
    """Lines (slug, ln, line) with ``line`` made a heading where it, joined with up to ``ahead`` - 1 lines after it, is a known title (slug, title) found just once."""
    order = Window.partitionBy("slug").orderBy("ln")
    trimmed = F.trim("line")
    joined = [F.when(trimmed != "", F.concat_ws(" ", trimmed, *[F.trim(F.lead("line", k).over(order)) for k in range(1, n)])) for n in range(1, ahead + 1)]
    rows = lines.withColumn("tries", F.array(*joined))
    found = rows.select("slug", "ln", F.posexplode("tries").alias("more", "title")).join(titles, ["slug", "title"])
    single = found.withColumn("n", F.count("*").over(Window.partitionBy("slug", "title"))).where("n = 1")
    best = single.groupBy("slug", "ln").agg(F.min_by("title", "more").alias("title"))
    head = F.when(F.col("title").isNotNull(), F.concat(F.lit("#" * level + " "), F.col("title"))).otherwise(F.col("line"))
    return lines.join(best, ["slug", "ln"], "left").select("slug", "ln", head.alias("line"))


def late_pool(tokens: DataFrame, spans: DataFrame, width: int = 512) -> DataFrame:
    """(parent_id, child_id, i, x): mean of a parent's token vectors (parent_id, low, high, vector) whose offsets overlap the child's span (parent_id, child_id, start, stop).

    Both are filed by stretches of ``width`` offsets; a pair is taken in the first stretch that both reach.
    """

    def filed(rows: DataFrame, low: str, high: str) -> DataFrame:
        return rows.withColumn("_at", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.greatest(F.col(high) - 1, F.col(low)) / width))))

    pairs = filed(tokens, "low", "high").join(filed(spans, "start", "stop"), ["parent_id", "_at"]).where((F.col("high") > F.col("start")) & (F.col("low") < F.col("stop")))
    pairs = pairs.where(F.col("_at") == F.floor(F.greatest("low", "start") / width))
    parts = pairs.select("parent_id", "child_id", F.posexplode("vector").alias("i", "x"))
    return parts.groupBy("parent_id", "child_id", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))


def frozen_background(background: DataFrame, own: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, ...) of every query over the same background and its own positive, which no other query sees."""
    every = queries.select("query_id").join(background)
    return every.join(own.select("query_id", "id"), ["query_id", "id"], "left_anti").unionByName(own.select(*every.columns))


def prompt(template: str, limits: dict[str, int], **fields: Column) -> Column:
    """A prompt with its fields cut to their limits; null fields are empty."""
    parts = [F.substring(F.coalesce(fields[name], F.lit("")), 1, limits.get(name, 1 << 30)) for name in fields]
    return F.format_string(template, *parts)


def location(heading: Column) -> Column:
    """A clause that names the place, where the heading has a letter."""
    return F.when(heading.rlike(r"\p{L}"), F.concat(F.lit(" in "), heading)).otherwise(F.lit(""))


def split_by_order(rows: DataFrame, sizes: dict[str, int], key: str, by: list[str] = (), seed: str = "42") -> DataFrame:
    """Rows with the ``part`` that their place in hash order falls into; rows beyond all sizes go."""
    order = Window.partitionBy(*by).orderBy(hash_order(F.col(key), seed), key) if by else Window.orderBy(hash_order(F.col(key), seed), key)
    placed = rows.withColumn("_r", F.row_number().over(order))
    part, start = F.lit(None).cast("string"), 0
    for name, size in sizes.items():
        part = F.when((F.col("_r") > start) & (F.col("_r") <= start + size), F.lit(name)).otherwise(part)
        start += size
    return placed.withColumn("part", part).where("part is not null").drop("_r")


def join_on_array(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """Left join on an array column; of equal keys on the right the last by ``order``."""
    last = right.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
    return left.join(last, key, "left")


def label_rollup(verdicts: DataFrame, flags: list[str]) -> DataFrame:
    """Counts and shares (of at least one row) of boolean verdicts."""
    n = F.greatest(F.count("*"), F.lit(1))
    return verdicts.agg(F.count("*").alias("n"), *[F.count_if(F.col(f)).alias(f) for f in flags], *[F.round(100.0 * F.count_if(F.col(f)) / n, 2).alias(f"{f}_pct") for f in flags])


def distinct_queries(rows: DataFrame, text: str, order: str) -> DataFrame:
    """The first row of each query text, case aside."""
    w = Window.partitionBy(F.lower(text)).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def prompt_variants(rows: DataFrame, instructions: dict[str, str], limits: dict[str, int], **fields: Column) -> DataFrame:
    """Every row once for each instruction, with its name as ``variant`` and the ``prompt`` that its template gives."""
    made = [F.struct(F.lit(name).alias("variant"), prompt(template, limits, **fields).alias("prompt")) for name, template in instructions.items()]
    return rows.withColumn("_v", F.explode(F.array(*made))).withColumns({"variant": F.col("_v.variant"), "prompt": F.col("_v.prompt")}).drop("_v")
