"""Metadata normalisation, keys and the joins that make the cleaned table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from paperloom.functions import text as X

#: A raw third-party metadata snapshot, one JSON object a line.
RAW_SNAPSHOT = StructType(
    [
        StructField("id", StringType()),
        StructField("title", StringType()),
        StructField("abstract", StringType()),
        StructField("authors_parsed", ArrayType(ArrayType(StringType()))),
        StructField("categories", StringType()),
        StructField("update_date", StringType()),
        StructField("doi", StringType()),
    ]
)
SITE = "https://arxiv.org"


def safe_id(raw: Column) -> Column:
    return F.concat(F.lit("arxiv_"), F.replace(raw, F.lit("/"), F.lit("_")))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def join_key(path: Column) -> Column:
    """File name without .pdf and version; '' if it isn't a paper's."""
    return F.regexp_replace(F.regexp_extract(path, r"(?d)(arxiv_[^/]+)\.pdf\n?\z", 1), r"v\d+\n?\z", "")


def pid_norm(pid: Column) -> Column:
    """Id without prefix and suffix; the version stays."""
    return X.strip(F.replace(F.replace(X.strip(F.lower(pid)), F.lit("arxiv_"), F.lit("")), F.lit(".pdf"), F.lit("")))


def pid_prefix(norm: Column) -> Column:
    """Partition of a normalised id; null for ids too short to have one."""
    return F.when(F.length(norm) >= 4, F.substring(norm, 1, 4))


def base_id(pid: Column) -> Column:
    """Id without prefix, suffix and version; null if nothing is left."""
    bare = F.regexp_replace(F.replace(F.replace(pid, F.lit("arxiv_"), F.lit("")), F.lit(".pdf"), F.lit("")), r"v\d+\z", "")
    return F.nullif(bare, F.lit(""))


def pid_url(pid: Column) -> Column:
    return F.concat(F.lit(f"{SITE}/abs/"), base_id(pid))


def normalise_metadata(raw: DataFrame, scraped_at: str, day: str) -> DataFrame:
    """Bronze rows of a raw snapshot. Missing texts become ''; a null doi stays null."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    line = lambda c: X.strip(F.replace(text(c), F.lit("\n"), F.lit(" ")))
    doc_id = safe_id(text("id"))
    source = F.concat(F.lit(f"{SITE}/abs/"), text("id"))
    name = lambda a: X.strip(F.concat(F.coalesce(F.get(a, F.lit(1)), F.lit("")), F.lit(" "), F.coalesce(F.get(a, F.lit(0)), F.lit(""))))
    return raw.select(
        doc_id.alias("doc_id"),
        F.sha2(source, 256).alias("hash_sha256"),
        line("title").alias("title"),
        line("abstract").alias("abstract"),
        F.coalesce(F.transform("authors_parsed", name), F.array().cast("array<string>")).alias("authors"),
        F.lit("en").alias("language"),
        F.split(text("categories"), " ").alias("categories"),
        text("update_date").alias("publish_date"),
        F.col("doi"),
        source.alias("source_url"),
        F.concat(F.lit(f"{SITE}/pdf/"), text("id"), F.lit(".pdf")).alias("pdf_url"),
        F.concat(F.lit(f"bronze/raw_pdfs/{day}/"), doc_id, F.lit(".pdf")).alias("local_path_bronze"),
        F.lit(scraped_at).alias("scraped_at"),
    )


def join_silver_plus(cleaned: DataFrame, texts: DataFrame, metadata: DataFrame, once: bool = False) -> DataFrame:
    """Cleaned papers with raw text and metadata, both optional, and their sections.

    Dumps that repeat a key double rows, as published; once keeps the latest
    row of each key on the right sides.
    """
    raw = texts.select("file_path", F.col("text").alias("raw_text"))
    meta = metadata.select("doc_id", "title", "abstract", "authors", "categories", "scraped_at")
    if once:
        raw = raw.dropDuplicates(["file_path"])
        latest = F.max_by(F.struct("title", "abstract", "authors", "categories"), "scraped_at").alias("m")
        meta = meta.groupBy("doc_id").agg(latest).select("doc_id", "m.*")
    else:
        meta = meta.drop("scraped_at")
    joined = cleaned.withColumn("join_key", join_key(F.col("file_path"))).join(raw, "file_path", "left").join(meta, F.col("join_key") == F.col("doc_id"), "left")
    return joined.withColumn("s", X.sections_offline(F.col("clean_text"))).select(
        basename(F.col("file_path")).alias("paper_id"), "file_path", "raw_text", "clean_text", "abstract", "s.introduction", "s.body", "word_count_raw", "word_count_clean", "title", "authors", "categories", "quality_flag"
    )


def null_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows, and the nulls of each column, in one pass."""
    return df.agg(F.count("*").alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns])


def quality_histogram(df: DataFrame, flag: str = "quality_flag") -> DataFrame:
    return df.groupBy(flag).agg(F.count("*").alias("n"))
