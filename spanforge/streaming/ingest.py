"""Incremental ingestion as a stream: files of documents in, chunks of new documents appended. An addition to the batch engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanforge.config import EngineConfig
from spanforge.operators import chunking
from spanforge.sources.sinks import append_new


def chunk_stream(spark: SparkSession, source: str, parents: str, children: str, checkpoint: str, config: EngineConfig = EngineConfig()):
    """A streaming query over parquet files (slug, markdown): each micro-batch chunks what is new and appends it by id, so a replayed batch adds nothing."""
    stream = spark.readStream.schema("slug string, markdown string").parquet(source)

    def write(batch: DataFrame, _: int) -> None:
        chunked = chunking.chunk_books(batch, config=config).persist()
        append_new(chunking.parents_of(chunked), parents, "parent_id")
        append_new(chunking.children_table(chunked), children, "child_id")
        chunked.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
