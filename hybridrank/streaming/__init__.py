"""Incremental ingest: new documents are chunked and appended to an index's postings as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import chunk
from ..operators.retrieval import postings
from ..plans import Config


def append_postings(docs: DataFrame, path: str, checkpoint: str, config: Config | None = None) -> StreamingQuery:
    """Writes chunks and postings of each micro-batch below path, in a folder of the batch's number, so that a repeated batch replaces itself.

    Chunks and terms are those of the configuration, so they can be joined with its snapshot.
    """
    c = config or Config()

    def write(batch: DataFrame, number: int) -> None:
        chunks = chunk(batch, **c.chunk).select(F.concat_ws("::", F.col("doc_id").cast("string"), "ordinal").alias("chunk_id"), "*")
        chunks.write.mode("overwrite").parquet(f"{path}/chunks/batch={number}")
        written = batch.sparkSession.read.parquet(f"{path}/chunks/batch={number}")
        postings(written.select(F.col("chunk_id").alias("doc_id"), "text"), c.stemmed, c.truncate).write.mode("overwrite").parquet(f"{path}/postings/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
