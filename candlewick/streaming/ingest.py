"""Blocks that arrive as files are chunked, embedded and appended to an index folder as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from candlewick.operators.chunk import Chunker
from candlewick.operators.retrieve import ARRIVED

BLOCKS = "file_pos int, block_pos int, source_file string, page_number int, heading string, text string"


def follow(spark: SparkSession, folder: str, index: str, chunker: Chunker, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends the chunks of Parquet files of blocks in folder to index/arrived, each batch in a folder of its own.

    A batch that is run again after a failure overwrites its own folder, so no chunk is appended twice. VectorIndex.load()
    gives the index's rows and, numbered after them, those of the batches that no save() has taken in yet.
    """

    def append(batch: DataFrame, number: int) -> None:
        made = chunker.chunk(batch).withColumn("vector", chunker.embedder.vector(F.col("text")))
        made.write.mode("overwrite").parquet(f"{index}/{ARRIVED}/batch={number}")

    stream = spark.readStream.schema(BLOCKS).parquet(folder).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()
