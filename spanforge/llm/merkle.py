"""Document fingerprints: a Merkle tree over paragraphs and sections, with DataFrame functions only.

A paragraph (leaf) is a run of text up to and with its line end or sentence
mark, so the leaves joined are the text. Eight paragraphs form a section. Leaf
hashes are 64 bits of SHA-256, a section's hash is taken over its leaves'
hashes, the root over the sections' hashes. The fingerprint is the text
``root:sections:leaves`` in hexadecimal: equal roots mean equal texts, differing
sections and then differing leaves say where two texts differ.

Defined results: a null text is the empty text; its fingerprint has no section
and no leaf. Equal texts have equal fingerprints. Documents are ordered by id,
null ids first and equal ids by a hash of their text. A single document is its own
successor. An empty table gives no rows.
"""

from __future__ import annotations

import json
import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm.common import documents

HEX = 16
FANOUT = 8
PARAGRAPH = r"[^\n.!?]*[\n.!?]+|[^\n.!?]+"

#: Rows that one range of the successor search holds, and the most ranges; beyond that the ranges grow.
ROWS_PER_RANGE = 4096
MOST_RANGES = 1 << 16


def _short(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, HEX)


def leaves(text: Column) -> Column:
    """Hashes of the paragraphs, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), _short)


def sections(leaf: Column) -> Column:
    """Hashes of the sections over an array of leaf hashes."""
    count = F.ceil(F.size(leaf) / FANOUT).cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: _short(F.array_join(F.slice(leaf, i * FANOUT + 1, FANOUT), "")))


def fingerprint(leaf: Column) -> Column:
    """``root:sections:leaves`` of an array of leaf hashes."""
    section = F.array_join(sections(leaf), "")
    return F.concat_ws(":", F.substring(F.sha2(section, 256), 1, 2 * HEX), section, F.array_join(leaf, ""))


def root(print_: Column) -> Column:
    return F.substring_index(print_, ":", 1)


def fingerprint_leaves(print_: Column) -> Column:
    """The leaf hashes that a fingerprint holds."""
    return F.regexp_extract_all(F.substring_index(print_, ":", -1), F.lit(f".{{{HEX}}}"), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    """Shared paragraphs of two leaf arrays over all their paragraphs; two empty texts are alike."""
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(every, F.lit(1)))


def differing_paragraphs(a: Column, b: Column) -> Column:
    """Positions (from 0) at which two fingerprints' leaves differ; none where the roots are equal."""
    x, y = fingerprint_leaves(a), fingerprint_leaves(b)
    last = F.greatest(F.size(x), F.size(y)) - 1
    at = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: ~F.get(x, i).eqNullSafe(F.get(y, i)))
    return F.when((root(a) == root(b)) | (last < 0), F.array().cast("array<int>")).otherwise(at)


def fingerprints(docs: DataFrame, *, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """All rows and columns of ``docs`` with the fingerprint of each text."""
    return docs.withColumn(out, fingerprint(leaves(F.coalesce(F.col(text_col), F.lit("")))))


def _ranges(keys: DataFrame, rows_per_range: int, most: int) -> Column:
    """The number of a row's range by its ``_key`` and ``_tie``: ranges ascend with both and hold about equal numbers of rows.

    Bounds are approximate percentiles of the keys, so any spread of ids gives even ranges. A key
    that fills several of them is dealt on by ``_tie``, a hash. The driver gets at most ``most`` numbers.
    """
    count = keys.count()
    parts = max(1, min(most, count // rows_per_range))
    if parts == 1:
        return F.lit(0)
    cuts = F.from_json(F.lit(json.dumps([i / parts for i in range(1, parts)])), "array<double>")
    bounds = keys.agg(F.percentile_approx("_key", cuts, max(10_000, 8 * parts))).collect()[0][0]
    step = max(1, math.isqrt(len(bounds)))
    blocks = [bounds[a : a + step] for a in range(0, len(bounds), step)]
    nested = F.from_json(F.lit(json.dumps(blocks)), "array<array<bigint>>")
    lasts = F.from_json(F.lit(json.dumps([block[-1] for block in blocks])), "array<bigint>")
    key = F.col("_key")
    # bounds below the key: whole blocks, then those of the block that the key falls into
    whole = F.size(F.filter(lasts, lambda x: x < key))
    below = whole * step + F.size(F.filter(F.coalesce(F.get(nested, whole), F.array().cast("array<bigint>")), lambda x: x < key))
    often = {x: n for x, n in Counter(bounds).items() if n > 1}
    if not often:
        return below
    same = F.coalesce(F.element_at(F.from_json(F.lit(json.dumps({str(x): n for x, n in often.items()})), "map<string,int>"), key.cast("string")), F.lit(0))
    share = F.col("_tie") / F.lit(2.0**64) + F.lit(0.5)
    return below + F.floor(share * same).cast("int")


def with_successor(docs: DataFrame, key: str, payload: list[str], *, rows_per_range: int = ROWS_PER_RANGE, most: int = MOST_RANGES) -> DataFrame:
    """Each row with ``next``, a struct of the ``payload`` of the row that follows by ``key``; the first follows the last.

    Rows of equal keys follow one another by a hash of their payload. Rows are dealt out once, by ranges of
    about ``rows_per_range`` rows; the first row of each range joins the range before it once more, as the
    successor of that range's last row. These firsts are found from keys alone, one row a range.
    """
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(f"`{key}`").alias("_key"), F.xxhash64(*[F.col(f"`{c}`") for c in payload]).alias("_tie"))
    rows = rows.withColumn("_range", _ranges(rows.select("_key"), rows_per_range, most))
    # one row a range, at most ``most``: small enough to order in one place and to broadcast
    heads = rows.groupBy("_range").agg(F.min(F.struct("_key", "_tie")).alias("_head"))
    order = Window.orderBy("_range")
    last = F.last("_range").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select(F.col("_range").alias("_own"), F.col("_head._key").alias("_k"), F.col("_head._tie").alias("_t"), F.coalesce(F.lag("_range").over(order), last).alias("_before"))
    first = rows.join(F.broadcast(heads), (F.col("_range") == F.col("_own")) & (F.col("_key") == F.col("_k")) & (F.col("_tie") == F.col("_t")))
    first = first.groupBy("_before").agg(F.first("_row").alias("_row"), F.first("_key").alias("_key"), F.first("_tie").alias("_tie")).withColumnRenamed("_before", "_range")
    every = rows.withColumn("_extra", F.lit(False)).unionByName(first.withColumn("_extra", F.lit(True)))
    along = Window.partitionBy("_range").orderBy("_extra", "_key", "_tie")
    found = every.withColumn("next", F.lead(F.struct(*[F.col("_row").getField(c).alias(c) for c in payload])).over(along)).where(~F.col("_extra"))
    return found.select(*[F.col("_row").getField(c).alias(c) for c in names if c != "next"], "next")


def op9_fingerprints(spark, sf_dir):
    """Contract query: fingerprints of each document and of its edited text, and their likeness."""
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    keyed = docs.withColumn("_key", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))))
    paired = with_successor(keyed, "_key", ["text"])
    n = F.col("n_chars")
    cut = F.floor(n / 4).cast("int")
    rows = paired.withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), (n - cut).cast("int")), F.substring(F.col("next.text"), F.lit(1), cut)))
    rows = rows.withColumns({"_own": leaves(F.col("text")), "_edited": leaves(F.col("edited")), "_next": leaves(F.col("next.text"))})
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("_own")).alias("fingerprint"),
        fingerprint(F.col("_edited")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_edited")).alias("near_edited"),
        likeness(F.col("_own"), F.col("_next")).alias("near_next"),
    )


_SQL_PRINT = """
  concat_ws(':',
    substr(sha256(array_to_string(list_transform(range(0, (len({0}) + 7) // 8), lambda i: substr(sha256(array_to_string({0}[i * 8 + 1 : i * 8 + 8], '')), 1, 16)), '')), 1, 32),
    array_to_string(list_transform(range(0, (len({0}) + 7) // 8), lambda i: substr(sha256(array_to_string({0}[i * 8 + 1 : i * 8 + 8], '')), 1, 16)), ''),
    array_to_string({0}, ''))"""
_SQL_LEAVES = r"list_transform(regexp_extract_all({0}, '[^\n.!?]*[\n.!?]+|[^\n.!?]+', 0), lambda x: substr(sha256(x), 1, 16))"
_SQL_LIKE = "CASE WHEN len(list_distinct(list_concat({0}, {1}))) = 0 THEN 1.0 ELSE len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))) END"

OP9_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT doc_id, text, coalesce(lead(text) OVER w, first_value(text) OVER w) AS nxt FROM d WINDOW w AS (ORDER BY doc_id NULLS FIRST, text)),
e AS (SELECT *, length(text) AS n_chars, substr(text, 1, length(text) - length(text) // 4) || substr(nxt, 1, length(text) // 4) AS edited FROM p),
l AS (SELECT *, {_SQL_LEAVES.format('text')} AS a, {_SQL_LEAVES.format('edited')} AS b, {_SQL_LEAVES.format('nxt')} AS c FROM e)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, {_SQL_PRINT.format('a')} AS fingerprint, {_SQL_PRINT.format('b')} AS edited_fingerprint,
  ({_SQL_LIKE.format('a', 'b')})::DOUBLE AS near_edited, ({_SQL_LIKE.format('a', 'c')})::DOUBLE AS near_next FROM l
"""
