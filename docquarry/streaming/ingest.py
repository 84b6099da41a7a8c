"""Incremental ingestion of a folder of files: each batch adds what the table lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from docquarry.operators.dml import first_of


def add_new(batch: DataFrame, path: str, keys: list[str], order: list[str]) -> None:
    """Append the batch's first row of each key that the table does not have."""
    spark = batch.sparkSession
    new = first_of(batch, keys, order)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        new = new.join(spark.read.parquet(path).select(*keys), keys, "left_anti")
    new.write.mode("append").parquet(path)


def ingest(spark: SparkSession, source: str, schema: str, path: str, checkpoint: str, keys: list[str], order: list[str]) -> StreamingQuery:
    """Read the Parquet files that arrive in a folder, in micro-batches, until none is left."""
    rows = spark.readStream.schema(schema).parquet(source)
    return rows.writeStream.foreachBatch(lambda batch, _: add_new(batch, path, keys, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
