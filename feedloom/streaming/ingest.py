"""Incremental ingest: payload files as a stream, each batch added to the stored listings it lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedloom.operators.merging import keep_first
from feedloom.sources.payloads import FIELDS, Parser, is_valid


def payload_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files that appear in a folder, one payload each."""
    return spark.readStream.format("text").option("wholetext", True).load(path).withColumnRenamed("value", "payload")


def ingest(stream: DataFrame, parser: Parser, store: str, checkpoint: str) -> StreamingQuery:
    """Each batch's valid listings that no earlier batch stored are written to a folder of that batch's number, over
    what a failed try of it left; so a batch that runs again gives the same result. Of a batch's rows of one key, which
    come in no order, the smallest in the order of its fields counts. Of the store only the keys are read."""

    def add(batch: DataFrame, number: int) -> None:
        first = keep_first(["source_name", "external_id"], "_at")
        new = parser(batch).filter(is_valid()).withColumn("_at", F.struct(*FIELDS)).transform(first).drop("_at")
        try:
            stored = batch.sparkSession.read.parquet(store)
        except Exception as e:  # the first batch finds no store
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        else:
            earlier = stored.filter(f"batch < {number}").select("source_name", "external_id")
            new = new.join(earlier, ["source_name", "external_id"], "left_anti")
        new.write.mode("overwrite").parquet(f"{store}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
