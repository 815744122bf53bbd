"""Sinks that can be run again: rows already there are left alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stored(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table at ``path``, empty if there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def append_new(rows: DataFrame, path: str, key: str, partition: str | None = None) -> None:
    """Append the rows whose key is not stored yet; of rows with equal keys one. Rows with a null key are appended each."""
    old = stored(rows.sparkSession, path, rows.schema)
    # one pass over the rows, as they may be answers of a service: rows without a key differ by their place
    apart = rows.withColumn("_apart", F.when(F.col(key).isNull(), F.monotonically_increasing_id())).dropDuplicates([key, "_apart"])
    new = apart.join(old.select(key), key, "left_anti").select(*rows.columns)
    writer = new.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def append_in_parts(rows: DataFrame, path: str, key: str, make: Callable[[DataFrame], DataFrame], parts: int) -> None:
    """``make`` of the rows, appended in ``parts`` portions by the key's hash: after a failure a further run makes only what is not stored yet."""
    place = F.pmod(F.xxhash64(key), F.lit(parts))
    for part in range(parts):
        some = rows.where(place == part)
        done = stored(rows.sparkSession, path, make(rows.limit(0)).schema).select(key)
        append_new(make(some.join(done, key, "left_anti")), path, key)


def rewrite_with_backup(rows: DataFrame, path: str, backup: str) -> None:
    """The table at ``path`` becomes ``rows``, which may be read from it; the table before stands at ``backup``, where an older one is kept instead.

    The new table is complete before a name changes.
    """
    spark = rows.sparkSession
    made = f"{path.rstrip('/')}.new"
    rows.write.mode("overwrite").parquet(made)
    old, new, kept = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, made, backup))
    files = old.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(kept):
        files.delete(old, True)
    elif files.exists(old) and not files.rename(old, kept):
        raise OSError(f"{path} could not be moved to {backup}")
    if not files.rename(new, old):
        raise OSError(f"{made} could not be moved to {path}")


def replace_partitions(rows: DataFrame, path: str, partition: str) -> None:
    """Overwrite just the partitions that ``rows`` has: an upsert by book."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def delete_where(spark: SparkSession, path: str, target: str, condition) -> None:
    """A copy of the table without the rows of a condition, written to a new path."""
    spark.read.parquet(path).where(~F.coalesce(condition, F.lit(False))).write.parquet(target)


def merge_manifest(new: DataFrame, old: DataFrame) -> DataFrame:
    """Entries of both, those there before unchanged, by slug."""
    return old.unionByName(new.join(old.select("slug"), "slug", "left_anti")).orderBy("slug")


def write_report(report: DataFrame, path: str, label: str) -> None:
    """A run's report as JSON lines under ``path``/run=``label``; a later report of the same run takes its place."""
    report.withColumn("run", F.lit(label)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").json(path)


def append_audit(rows: DataFrame, path: str) -> None:
    """Audit rows as further JSON lines; nothing there before is touched."""
    rows.write.mode("append").json(path)


def totals(**tables: DataFrame) -> DataFrame:
    """(name, n) of tables."""
    counts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def concat_sheets(sheets: DataFrame) -> DataFrame:
    """(slug, markdown) of books given as sheets (slug, path, title, markdown): titles as headings of level 2, bodies two levels lower, fences closed."""
    from spanforge.operators import markdown as M

    keyed = sheets.withColumn("_k", F.concat_ws("\x01", "slug", "path"))
    lower = M.demote_headings(keyed.select(F.col("_k").alias("slug"), "markdown")).select(F.col("slug").alias("_k"), M.balance_fences(F.col("markdown")).alias("body"))
    rows = keyed.select("_k", "slug", "path", "title").join(lower, "_k")
    ordered = F.array_sort(F.collect_list(F.struct("path", F.concat(F.lit("## "), "title", F.lit("\n\n"), "body").alias("s"))))
    return rows.groupBy("slug").agg(F.array_join(F.transform(ordered, lambda x: x["s"]), "\n\n").alias("markdown"))
