"""Streams run to their end over what is there, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tickloom.functions.folders import shared_folder
from tickloom.streaming.state import use_rocksdb


def replayed(make, mode: str = "append") -> DataFrame:
    """What a stream (or a function that makes one) puts out over all the input there is, and after its watermark, as a table in the shared folder."""
    stream = make() if callable(make) else make
    spark = stream.sparkSession
    use_rocksdb(spark)
    folder = shared_folder(spark, "replay")
    query = (
        stream.writeStream.format("parquet").outputMode(mode).trigger(availableNow=True)
        .option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/progress").start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
