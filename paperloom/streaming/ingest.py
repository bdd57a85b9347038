"""Incremental batches: new files are cleaned once, then signed and entered into the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as X
from paperloom.operators.lsh import bucket_table, sign
from paperloom.operators.metadata import basename

TEXTS = "file_path string, text string, word_count bigint"


def clean_texts(texts: DataFrame, compose: bool = True) -> DataFrame:
    """(paper_id, file_path, clean_text, word counts, ratio, flags) of page texts; without compose no Unicode NFKC."""
    done = X.clean_offline(texts, "text", compose=compose)
    return done.select(basename(F.col("file_path")).alias("paper_id"), "file_path", F.col("word_count").alias("word_count_raw"), "cleaned.*")


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, files_each: int = 64, pattern: str | None = None, compose: bool = True) -> None:
    """Take up all new files of source (those whose names fit pattern), in bounded batches, each file once.

    A batch's tables go under its own number, so a batch that is run again
    after a failure overwrites what it wrote before.
    """
    reader = spark.readStream.schema(TEXTS).option("maxFilesPerTrigger", files_each)
    stream = (reader.option("pathGlobFilter", pattern) if pattern else reader).parquet(source)

    def store(batch: DataFrame, number: int) -> None:
        done = clean_texts(batch.dropDuplicates(["file_path"]), compose)
        done.write.mode("overwrite").parquet(f"{target}/cleaned/batch={number}")
        # read again what was written: nothing is cleaned twice, nothing is held in executors
        cleaned = batch.sparkSession.read.parquet(f"{target}/cleaned/batch={number}")
        sign(cleaned, "paper_id", "clean_text").write.mode("overwrite").parquet(f"{target}/signatures/batch={number}")
        signatures = batch.sparkSession.read.parquet(f"{target}/signatures/batch={number}")
        bucket_table(signatures, "paper_id").write.mode("overwrite").parquet(f"{target}/buckets/batch={number}")

    query = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
