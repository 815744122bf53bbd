"""Label building and hygiene: sampling, splits, reconciliation, scrubbing."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanforge.functions.text import word_count
from spanforge.session import stored


def hash_order(key: Column, seed: str = "42") -> Column:
    """A repeatable shuffle order that any engine can compute."""
    return F.sha2(F.concat(F.lit(seed), key.cast("string")), 256)


def allocate(counts: DataFrame, total: int, least: int = 2) -> DataFrame:
    """``n`` rows of each stratum (stratum, count): a floor, then shares of the rest, rounded half to even, all there is at most."""
    whole = Window.partitionBy()
    floor = F.least(F.lit(least), F.col("count"))
    rest = F.lit(total) - F.sum(floor).over(whole)
    return counts.withColumn("n", F.least(F.col("count"), floor + F.greatest(F.bround(rest * F.col("count") / F.sum("count").over(whole)), F.lit(0))).cast("long"))


def stratified_sample(rows: DataFrame, plan: DataFrame, stratum: str, key: str, seed: str = "42") -> DataFrame:
    """The first ``n`` rows of each stratum of ``plan`` (stratum, n) in hash order; a task passes on no more rows of a stratum than the largest ``n``."""
    most = plan.agg(F.max("n")).collect()[0][0] or 0
    order = Window.partitionBy(stratum).orderBy(hash_order(F.col(key), seed), key)
    first = rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most)
    return first.join(plan.select(stratum, "n"), stratum).where("_r <= n").drop("_r", "n")


def per_grade(rows: DataFrame, total: int, grades: int = 3, *, grade: str = "grade", key: str = "id", text: str = "text", gold: str = "gold", seed: str = "42") -> DataFrame:
    """An equal part of ``total`` rows of each grade in hash order, without gold rows and empty texts."""
    usable = rows.where(~F.coalesce(F.col(gold), F.lit(False)) & (F.trim(F.coalesce(F.col(text), F.lit(""))) != ""))
    order = Window.partitionBy(grade).orderBy(hash_order(F.col(key), seed), key)
    return usable.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= total // grades).drop("_r")


def route_eligible(chunks: DataFrame, *, heading: str = "heading_path", kind: str = "chunk_type") -> DataFrame:
    """Chunks with a heading and the ``pool`` (code or prose) that questions for them come from."""
    headed = chunks.where(F.trim(F.coalesce(F.col(heading), F.lit(""))) != "")
    return headed.withColumn("pool", F.when(F.col(kind) == "code", "code").otherwise("prose"))


def eligible(chunks: DataFrame, matter: str, least: int = 90, most: int = 250, text: str = "text") -> DataFrame:
    """Chunks of ``least`` to ``most`` words (``n_words``) that do not begin with a heading of ``matter`` (a pattern of lower-case words)."""
    rows = chunks.withColumn("n_words", word_count(F.col(text)).cast("long"))
    return rows.where(F.col("n_words").between(least, most) & ~F.lower(text).rlike(rf"^\s*({matter})\b"))


def usable_queries(rows: DataFrame, junk: str, least_chars: int = 10, most_words: int = 12, query: str = "query") -> DataFrame:
    """Generated queries that hold no junk and are neither too short nor too long."""
    return rows.where(~F.col(query).rlike(junk) & (F.length(query) >= least_chars) & (word_count(F.col(query)) <= most_words))


def is_index_page(heading: Column) -> Column:
    """The topmost part of a heading path is that of a split index."""
    return F.trim(F.element_at(F.split(heading, ">"), 1)).rlike(r"^Index \(part \d+\)$")


def index_report(pages: DataFrame, book: str, *, page: str = "page", heading: str = "heading") -> DataFrame:
    """Of each book the index pages: how many, their first and last place, the last page kept, and whether the first lies so early that it is doubtful."""
    at, flag = F.col(page), is_index_page(F.col(heading))
    out = pages.groupBy(book).agg(F.count_if(flag).alias("flagged"), F.min(F.when(flag, at)).alias("first_page"), F.max(F.when(flag, at)).alias("last_page"), F.max(F.when(~flag, at)).alias("kept_last"))
    return out.withColumn("warn", F.coalesce(F.col("first_page") < 0.5 * F.col("kept_last"), F.lit(False)))


def key_counts(rows: DataFrame, json_col: str, keys: set[str] | None = None) -> DataFrame:
    """Keys of JSON objects by how often they occur, of ``keys`` alone where these are given."""
    found = rows.select(F.explode(F.json_object_keys(json_col)).alias("key"))
    if keys is not None:
        found = found.where(F.col("key").isin(sorted(keys)))
    return found.groupBy("key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key")


def sliced_then_capped(rows: DataFrame, caps: dict[str, int], factor: int, keep: Column, key: str, seed: str = "42") -> DataFrame:
    """Disjoint slices of ``factor`` x cap rows a kind in hash order; of each the first rows that pass ``keep``, to the cap, with their ``part``.

    ``keep`` is judged after the slices are dealt, as an answer to a row is known only then.
    """
    most = factor * sum(caps.values())
    order = Window.orderBy(hash_order(F.col(key), seed), key)
    # the first rows alone are numbered: a task passes on no more than ``most``
    first = rows.orderBy(hash_order(F.col(key), seed), key).limit(most).withColumn("_r", F.row_number().over(order))
    part, start = F.lit(None).cast("string"), 0
    for name, cap in caps.items():
        part = F.when((F.col("_r") > start) & (F.col("_r") <= start + factor * cap), F.lit(name)).otherwise(part)
        start += factor * cap
    limits = F.create_map(*[F.lit(x) for pair in caps.items() for x in pair])
    passed = first.withColumn("part", part).where(keep).withColumn("_n", F.row_number().over(Window.partitionBy("part").orderBy("_r")))
    return passed.where(F.col("_n") <= F.element_at(limits, F.col("part"))).drop("_r", "_n")


def distinct_then_capped(rows: DataFrame, caps: dict[str, int], factor: int, *, text: str = "query", part: str = "part", order: str = "id") -> DataFrame:
    """Rows taken in order while their part's cap is not reached and no row taken before has the same text, case aside.

    Whether a text is new depends on what was taken, so the first ``factor`` x cap rows of each part, a number that does not grow
    with the table, are gone through in one task; null texts and parts without a cap are not taken.
    """
    limits = F.create_map(*[F.lit(x) for pair in caps.items() for x in pair])
    place = F.row_number().over(Window.partitionBy(part).orderBy(order))
    few = rows.where(F.col(part).isin(list(caps)) & F.col(text).isNotNull()).withColumn("_n", place).where(F.col("_n") <= factor * F.element_at(limits, F.col(part))).drop("_n")

    def take(frame):
        seen, left, kept = set(), dict(caps), []
        for said, of in zip(frame.sort_values(order)[text].str.lower(), frame.sort_values(order)[part]):
            kept.append(left[of] > 0 and said not in seen)
            if kept[-1]:
                left[of] -= 1
                seen.add(said)
        return frame.sort_values(order)[kept]

    return few.groupBy().applyInPandas(take, few.schema)


def filled_pool(chosen: DataFrame, chunks: DataFrame, total: int, *, stratum: str = "book", seed: str = "42") -> DataFrame:
    """``chosen`` (id, parent_id, ...) and, up to ``total`` rows, further chunks by their strata's shares, one for each parent that has none yet."""
    one = chunks.groupBy("parent_id").agg(F.min_by(F.struct("id", stratum), hash_order(F.col("id"), seed)).alias("c")).select("parent_id", "c.id", f"c.{stratum}")
    rest = one.join(chosen.select("parent_id"), "parent_id", "left_anti")
    need = max(0, total - chosen.count())
    plan = allocate(rest.groupBy(stratum).agg(F.count("*").alias("count")), need, 0)
    more = stratified_sample(rest, plan, stratum, "id", seed)
    return chosen.select("id", "parent_id", stratum).withColumn("filled", F.lit(False)).unionByName(more.select("id", "parent_id", stratum).withColumn("filled", F.lit(True)))


def round_robin(rows: DataFrame, batches: int, order: str) -> DataFrame:
    """Every row's ``batch``: rows are numbered within blocks of a range partition, then across blocks.

    The numbered rows are stored, as both uses must see the same blocks.
    """
    ranged = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    ranged = stored(ranged)
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_c"))
    starts = sizes.withColumn("_s", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_s")
    return ranged.join(starts, "_p").withColumn("batch", ((F.col("_s") + F.col("_i")) % batches).cast("int")).drop("_p", "_i", "_s")


def blind(rows: DataFrame, key: str, query: str = "query", text: str = "candidate_text") -> DataFrame:
    """What a judge sees of graded rows: no grade and nothing that tells it."""
    return rows.select(F.col(key).alias("idx"), F.col(query).alias("query"), F.col(text).alias("candidate_text"))


def audit_rows(sample: DataFrame, found: DataFrame, easy: DataFrame, key: str = "query_id") -> DataFrame:
    """Sampled queries that were retrieved for, with their candidates (key, candidates) and, where there is one, the easier query (key, easy_query)."""
    rows = sample.join(found.select(key, "candidates"), key).join(easy.select(key, "easy_query"), key, "left")
    return rows.withColumn("easy_query", F.coalesce("easy_query", F.lit("")))


def reconcile(golden: DataFrame, live: DataFrame, ids: str = "positive_ids") -> DataFrame:
    """Queries with their ids that are still live (id), in their order; queries left without any go."""
    rows = golden.select("query_id", F.posexplode(ids).alias("at", "id")).join(live.select("id"), "id", "left_semi")
    ordered = F.array_sort(F.collect_list(F.struct("at", "id")))
    return rows.groupBy("query_id").agg(F.transform(ordered, lambda x: x["id"]).alias(ids))


def orphan_parents(parents: DataFrame, children: DataFrame) -> DataFrame:
    return parents.join(children.select("parent_id").distinct(), "parent_id", "left_anti")


def todo(every: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of ``every`` that are not done yet; a null key is never done."""
    return every.join(done.select(key), key, "left_anti")


def siblings(positives: DataFrame, chunks: DataFrame, limit: int = 6, seed: str = "42") -> DataFrame:
    """Up to ``limit`` other chunks of each positive's book, those of its chapter first, one for each parent.

    A parent lies in one chapter. No positive needs more than the first ``limit`` + 1 parents of a
    chapter, so only those are joined with it.
    """
    one = chunks.groupBy("book", "chapter", "parent_id").agg(F.min_by("id", hash_order(F.col("id"), seed)).alias("id"))
    first = Window.partitionBy("book", "chapter").orderBy(hash_order(F.col("id"), seed))
    few = one.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= limit + 1).drop("_n")
    a, b = positives.alias("a"), few.alias("b")
    near = a.join(b, F.col("a.book") == F.col("b.book")).where("a.parent_id <> b.parent_id")
    tier = F.when(F.col("a.chapter") == F.col("b.chapter"), 0).otherwise(1)
    rows = near.select(F.col("a.id").alias("query_id"), F.col("b.id").alias("id"), F.col("b.parent_id").alias("parent_id"), tier.alias("tier"), hash_order(F.col("b.id"), seed).alias("h"))
    one = rows.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "parent_id").orderBy("tier", "h"))).where("_n = 1")
    return one.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("tier", "h"))).where(F.col("place") <= limit).select("query_id", "id", "tier", F.col("place").cast("long").alias("place"))


def parse_grades(text: Column) -> Column:
    """Grades of the first JSON array in a reply, each from 0 to 2; null where there is none."""
    found = F.regexp_extract(text, r"(?s)\[.*\]", 0)
    return F.transform(F.from_json(found, "array<double>"), lambda g: F.greatest(F.lit(0), F.least(F.lit(2), g.cast("int"))))


def scrub(rows: DataFrame, json_col: str, keys: set[str]) -> DataFrame:
    """JSON texts without ``keys`` at any depth, and how many were removed; texts that are no JSON stay."""

    def clean(value):
        if isinstance(value, dict):
            kept, gone = {}, 0
            for k, v in value.items():
                if k in keys:
                    gone += 1
                else:
                    kept[k], n = clean(v)
                    gone += n
            return kept, gone
        if isinstance(value, list):
            parts = [clean(v) for v in value]
            return [p for p, _ in parts], sum(n for _, n in parts)
        return value, 0

    @F.pandas_udf(T.StructType([T.StructField("json", T.StringType()), T.StructField("removed", T.LongType())]))
    def run(texts):
        import pandas as pd

        out = []
        for text in texts:
            try:
                value, gone = clean(json.loads(text))
                out.append((json.dumps(value, separators=(",", ":"), sort_keys=True), gone))
            except (TypeError, ValueError):
                out.append((text, 0))
        return pd.DataFrame(out, columns=["json", "removed"])

    return rows.withColumn("_s", run(F.col(json_col))).withColumn(json_col, F.col("_s.json")).withColumn("removed", F.col("_s.removed")).drop("_s")
