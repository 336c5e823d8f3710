"""New text files of a folder to chunks, as a stream; each file is chunked once, exactly as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import split_long


def text_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, n, text) of each text file that comes to ``folder``."""
    lines = spark.readStream.format("text").option("wholetext", True).load(folder)
    doc_id = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return lines.select(doc_id.alias("doc_id"), F.posexplode(split_long(F.col("value"))).alias("n", "text"))


def run(stream: DataFrame, out: str, checkpoint: str):
    """Append to a Parquet table; what is there when it starts is done and then it ends."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
