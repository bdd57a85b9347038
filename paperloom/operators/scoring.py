"""Interval unions, similarity scores, contributions and risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as X


def merge_intervals(df: DataFrame, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Unions of intervals that overlap or touch, for each group: gaps and islands by windows."""
    order = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.select(*by, F.col(start).alias("s"), F.col(end).alias("e"), F.when(F.col(start) <= reach, 0).otherwise(1).alias("fresh"))
    island = F.sum("fresh").over(Window.partitionBy(*by).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("island", island).groupBy(*by, "island").agg(F.min("s").alias(start), F.max("e").alias(end)).drop("island")


def _covered_words(texts: DataFrame, intervals: DataFrame, key: str, by: list[str]) -> DataFrame:
    words = X.word_count(F.substring(F.col("clean_text"), F.col("start") + 1, F.col("end") - F.col("start")))
    return intervals.join(texts.select(key, "clean_text"), key).groupBy(*by).agg(F.sum(words).alias("matched_words"))


def risk_level(similarity: Column) -> Column:
    return F.when(similarity < 10, "Low").when(similarity < 25, "Medium").when(similarity < 40, "High").otherwise("Very High")


def _valid(matches: DataFrame, *columns: str) -> DataFrame:
    return matches.filter(~F.col("excluded")).select(*columns, F.col("input_start").alias("start"), F.col("input_end").alias("end"))


def similarity_scores(texts: DataFrame, matches: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, total_words, matched_words, overall_similarity, risk_level) of each text(key, clean_text), with or without matches."""
    merged = merge_intervals(_valid(matches, key), [key])
    totals = texts.select(key, X.word_count(F.col("clean_text")).alias("total_words"))
    joined = totals.join(_covered_words(texts, merged, key, [key]), key, "left").withColumn("matched_words", F.coalesce("matched_words", F.lit(0)))
    similarity = F.when(F.col("total_words") > 0, F.col("matched_words") / F.col("total_words") * 100).otherwise(F.lit(0.0))
    return joined.withColumn("overall_similarity", similarity).withColumn("risk_level", risk_level(F.col("overall_similarity")))


def source_contributions(texts: DataFrame, matches: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, source_paper_id, source_title, matched_words, contribution_percent, rank) of each source with a valid match."""
    by = [key, "source_paper_id"]
    merged = merge_intervals(_valid(matches, *by), by)
    titles = matches.groupBy(*by).agg(F.min_by("source_title", F.struct("input_start", "source_segment_id")).alias("source_title"))
    totals = texts.select(key, X.word_count(F.col("clean_text")).alias("total_words"))
    joined = _covered_words(texts, merged, key, by).join(titles, by).join(totals, key)
    percent = F.when(F.col("total_words") > 0, F.col("matched_words") / F.col("total_words") * 100).otherwise(F.lit(0.0))
    order = Window.partitionBy(key).orderBy(F.desc("contribution_percent"), "source_paper_id")
    return joined.withColumn("contribution_percent", percent).withColumn("rank", F.row_number().over(order)).drop("total_words")
