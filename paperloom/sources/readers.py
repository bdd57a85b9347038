"""Scans: metadata dumps, tables with pushed-down columns and keys, files, PDFs by a parser of the caller's."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from paperloom.functions import text as X
from paperloom.session import cut_lineage


def read_jsonl(spark: SparkSession, path: str, schema: StructType, columns: list[str] | None = None) -> DataFrame:
    """One JSON object a line; globs of several dumps are unioned and not deduplicated."""
    df = spark.read.schema(schema).json(path)
    return df.select(*columns) if columns else df


def line_range(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """(line_no, value) of lines start to end - 1 of text files.

    Files count in the order of their names. A line's number is its place in
    its split and the lines of the splits before, which are counted first, so
    that no task holds a file; only splits that reach into the range are read
    further.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = spark.read.text(path).select("value", at.alias("at"), F.spark_partition_id().alias("part"), place.alias("row"))
    # a split of a scan may hold several blocks, one after another
    blocks = cut_lineage(lines.groupBy("at").agg(F.count("*").alias("n"), F.min("row").alias("first")))
    before = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # one row for each block of a file
    offsets = blocks.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).filter((F.col("offset") < end) & (F.col("offset") + F.col("n") > start))
    found = lines.join(offsets, "at").select((F.col("row") - F.col("first") + F.col("offset")).alias("line_no"), "value")
    return found.filter((F.col("line_no") >= start) & (F.col("line_no") < end))


#: Lines of a zip member that are parsed at a time.
ZIP_LINES = 20_000


def read_jsonl_zip(spark: SparkSession, path: str, schema: StructType, columns: list[str] | None = None) -> DataFrame:
    """One JSON object a line of every member of zip files, unpacked as a stream.

    A zip file can't be split: one task reads one, of at most 2 GB packed, the
    limit of a binary value; larger dumps are to be unpacked once.
    """

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as packed:
                    for name in packed.namelist():
                        with packed.open(name) as lines:
                            held = []
                            for line in lines:
                                held.append(line.decode("utf-8").rstrip("\r\n"))
                                if len(held) == ZIP_LINES:
                                    yield pa.RecordBatch.from_arrays([pa.array(held)], ["value"])
                                    held = []
                            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("content")
    rows = files.mapInArrow(run, "value string").filter("trim(value) <> ''")
    df = rows.select(F.from_json("value", schema).alias("r")).select("r.*")
    return df.select(*columns) if columns else df


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, ids: DataFrame | None = None, key: str = "paper_id", sections: list[str] | None = None) -> DataFrame:
    """Columns and a section list reach the scan; a set of ids of any size is a semi-join."""
    df = spark.read.parquet(path)
    if sections:
        df = df.filter(F.col("section").isin(sections))
    if ids is not None:
        df = df.join(ids.select(key).distinct(), key, "left_semi")
    return df.select(*columns) if columns else df


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    """A lookup table stored by pid_prefix; prefixes stay strings, so 0704 isn't read as a number."""
    stored = spark.read.parquet(path).schema
    return spark.read.schema(StructType([StructField(f.name, StringType()) if f.name == "pid_prefix" else f for f in stored])).parquet(path)


def list_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, modified, length) without reading contents; Spark leaves files without a byte out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("modificationTime").alias("modified"), "length")


def storage_audit(files: DataFrame) -> DataFrame:
    """One row: files, bytes and GB of 1024**3 bytes."""
    return files.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes")).withColumn("gigabytes", F.col("n_bytes") / F.lit(1024**3))


def extract_pages(spark: SparkSession, path: str, parse: Callable[[bytes], list[str]], least_words: int | None = 10, keep_failed: bool = False) -> DataFrame:
    """(file_path, text, pages, page_count, word_count, error) of PDFs, by a parser from bytes to page texts.

    pages are (page, text), counted from 1. Files whose text has at most
    least_words words are dropped and the others' text stripped; with None, as
    for a text that is checked, all are kept as they are. A file the parser
    fails on is dropped, or kept with its error.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for file_path, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows.append((file_path, parse(content), None))
                except Exception as e:  # the file's fault, reported with it
                    rows.append((file_path, [], repr(e)[:500]))
            yield pd.DataFrame(rows, columns=["file_path", "pages", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path).select("path", "content")
    pages = files.mapInPandas(run, "file_path string, pages array<string>, error string")
    joined = F.array_join("pages", "\n")
    made = pages.withColumn("text", joined if least_words is None else X.strip(joined)).withColumn("word_count", X.word_count(F.col("text"))).withColumn("page_count", F.size("pages"))
    made = made.withColumn("pages", F.transform("pages", lambda t, i: F.struct((i + 1).alias("page"), t.alias("text"))))
    good = F.col("error").isNull() & (F.lit(True) if least_words is None else F.col("word_count") > least_words)
    return made.filter(good | F.col("error").isNotNull() if keep_failed else good)


def storage_paths(names: DataFrame, files: DataFrame, name: str = "paper_id") -> DataFrame:
    """names with the path each is stored under, by its base name; names that aren't stored are dropped.

    files(path) may hold a name in several folders; the first path counts.
    """
    known = files.select(F.substring_index("path", "/", -1).alias(name), "path").groupBy(name).agg(F.min("path").alias("path"))
    return names.join(known, name)


def pending(all_files: DataFrame, done: DataFrame, key: str = "file_path") -> DataFrame:
    """Files not processed yet."""
    return all_files.join(done.select(key).distinct(), key, "left_anti")


def status_tally(log: DataFrame, status: str = "status") -> DataFrame:
    return log.groupBy(status).agg(F.count("*").alias("n"))
