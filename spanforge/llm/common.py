"""Shared plumbing of the corpus operators: Arrow batches in and out, shared folders, folds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one Arrow batch that are turned into Python objects at a time.
SLICE_ROWS = 256
#: Rows of an Arrow batch between Spark and a Python worker; Spark's default of 10,000 whole texts takes hundreds of megabytes on both sides.
BATCH_ROWS = 2000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table ``documents``; a session that has Spark's default size of Arrow batches gets a smaller one."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lean(run: Callable) -> Callable:
    """``run`` over the batches of a task; at its end the worker, which is used again, gives free memory back."""

    def inner(batches):
        yield from run(batches)
        import ctypes
        import gc

        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:
            # not glibc
            pass

    return inner


def shared_dir(spark: SparkSession, kind: str) -> str:
    """A fresh path under the folder that all executors share.

    The cluster names that folder in ``spark.checkpoint.dir``. Only where it is
    unset (a local test session) is a temporary folder of this machine used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="spanforge-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base}/{kind}-{uuid.uuid4().hex}"


#: Paths written inside the open ``scratch`` blocks.
_scratch: list[list[str]] = []


def materialise(df: DataFrame, kind: str, codec: str = "zstd", keep: bool = False) -> DataFrame:
    """Write ``df`` to a fresh shared folder and read it again: lineage is cut, each task can be retried.

    Inside a ``scratch`` block the table goes with the block, unless it is to be kept.
    """
    spark = df.sparkSession
    path = shared_dir(spark, kind)
    outer = _scratch[:-1] if keep else _scratch
    if outer:
        outer[-1].append(path)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialise`` writes inside are deleted at the end: what is still needed must be stored with ``keep``."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def fold(id_col: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % F.lit(parts)


def slices(batch: pa.RecordBatch, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def append_columns(
    docs: DataFrame,
    text_col: str,
    fields: list[tuple[str, T.DataType]],
    make: Callable[[], Callable[[list], list[list]]],
    as_bytes: bool = False,
) -> DataFrame:
    """Map every row's text to ``fields`` in Arrow batches, keeping all columns and rows.

    ``make()`` runs once per task and returns a function from the texts of a
    slice to one list of values per field. A column of ``docs`` that has the
    name of a field is replaced by it. The input text column is passed on as it
    is; with ``as_bytes`` the function sees UTF-8 bytes instead of strings.
    """
    names = {n for n, _ in fields}
    kept = [c for c in docs.columns if c not in names]
    seen = "__text__"
    while seen in kept:
        seen += "_"
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").cast("binary" if as_bytes else "string").alias(seen))
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(n, t) for n, t in fields])
    arrow = [pa.field(n, _arrow_type(t)) for n, t in fields]
    at = len(kept)

    def run(batches):
        function = make()
        for whole in batches:
            for batch in slices(whole):
                values = function(batch.column(at).to_pylist())
                arrays = list(batch.columns[:at]) + [pa.array(v, type=f.type) for v, f in zip(values, arrow)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *[f.name for f in arrow]])

    return source.mapInArrow(lean(run), schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    simple = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "float": pa.float32()}
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow_type(kind.elementType))
    return simple[kind.simpleString()]


#: Groups whose shares a plan may hold as literals.
GROUPS = 10_000


def smallest_hashes(rows: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """The ``n`` rows of each group with the smallest hashes of the key (ties by key).

    Groups are counted first, so little more than ``n`` rows of a group are ranked in its
    task, however many the group has. Where that share gives too few (keys that
    repeat), or where there are more than ``GROUPS`` groups, all are ranked.
    """
    order = Window.partitionBy(group).orderBy(F.xxhash64(key), key)

    def pick(some: DataFrame) -> DataFrame:
        return some.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")

    counts = {r[0]: r[1] for r in rows.groupBy(group).agg(F.count("*")).limit(GROUPS + 1).collect()}
    if not counts:
        return rows
    if len(counts) > GROUPS:
        return pick(rows)
    place = F.xxhash64(key) / float(1 << 64) + 0.5
    # six standard deviations above n rows
    shares = literal_map({g: min(1.0, (n + 6 * n**0.5 + 10) / c) for g, c in counts.items()})
    sifted = pick(rows.where(place <= F.element_at(shares, F.col(group))))
    found = {r[0]: r[1] for r in sifted.groupBy(group).agg(F.count("*")).collect()}
    return sifted if all(found.get(g, 0) == min(n, c) for g, c in counts.items()) else pick(rows)


def literal_map(values: dict) -> Column:
    """A map column of literals; it travels with the plan, so its size must be bounded."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
