"""Segment matching: equal, containing, or alike in characters."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom import constants as K
from paperloom.functions import patterns as P
from paperloom.functions import similarity as S
from paperloom.functions import text as X
from paperloom.functions.rx import java
from paperloom.session import cut_lineage, split_hot


def any_like(t: Column, patterns) -> Column:
    """Whether any pattern is found. A leading .+ only asks for a character before, and as such needs no backtracking."""
    out = F.lit(False)
    for p in patterns:
        out = out | t.rlike(java(re.sub(r"^(\(\?\w+\))?\.\+", r"\1.", p)))
    return F.coalesce(out, F.lit(False))


def quoted_segment(t: Column) -> Column:
    """Within straight quotes of one kind."""
    t = X.strip(t)
    return F.coalesce((t.startswith('"') & t.endswith('"')) | (t.startswith("'") & t.endswith("'")), F.lit(False))


def make_segments(df: DataFrame, key: str, sections: list[tuple[str, str]], least_words: int = K.MIN_SEGMENT_WORDS, carry: list[str] = ()) -> DataFrame:
    """One row for each paragraph of at least least_words words of the sections (name, column).

    segment_id counts all paragraphs of its section; start_char and end_char
    count from the section's start. Null and empty sections give no rows.
    """
    made = []
    for name, column in sections:
        own = df.select(key, *carry, F.explode(X.segments(F.col(column), least_words)).alias("s"))
        made.append(own.select(key, *carry, F.lit(name).alias("section"), F.concat(F.lit(f"{name}_seg_"), F.col("s.idx")).alias("segment_id"), "s.text", "s.start_char", "s.end_char", "s.word_count"))
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out.withColumns({"is_reference": F.lower("section") == "references", "is_quote": quoted_segment(F.col("text")), "near_citation": any_like(F.col("text"), P.SEGMENT_CITATIONS)})


def comparable(a: Column, b: Column) -> Column:
    """Both of at least ten words, and neither over three times the other."""
    low, high = F.least(a, b), F.greatest(a, b)
    return (low >= K.SMALL_MATCH_WORDS) & (high <= K.SEGMENT_RATIO * low)


def find_matches(inputs: DataFrame, sources: DataFrame, candidates: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Matches between segments of a query and segments of its candidates.

    inputs: (query_id, segment columns); sources: (paper_id, title, segment
    columns); candidates: (query_id, paper_id). Pairs are compared only within
    a query's candidates and by native length tests; the character ratio runs
    in batches on what the cheap tests leave, and not at all where the texts
    are equal. Without fuzzy it isn't needed and fuzzy_ratio is null.
    """
    shingled = lambda t: F.transform(S.shingles(t), lambda s: F.xxhash64(s))
    a = inputs.select(
        "query_id", F.col("segment_id").alias("input_segment_id"), F.col("section").alias("input_section"), F.col("text").alias("input_text"),
        F.col("start_char").alias("input_start"), F.col("end_char").alias("input_end"), "word_count",
        F.col("is_quote").alias("input_is_quote"), F.col("near_citation").alias("input_near_citation"),
        shingled(F.col("text")).alias("input_shingles"), S.normalised(F.col("text")).alias("input_plain"),
    )
    b = sources.select(
        "paper_id", F.col("title").alias("source_title"), F.col("segment_id").alias("source_segment_id"), F.col("section").alias("source_section"), F.col("text").alias("source_text"),
        F.col("word_count").alias("source_words"), shingled(F.col("text")).alias("source_shingles"), S.normalised(F.col("text")).alias("source_plain"),
    )
    pairs = candidates.select("query_id", "paper_id").distinct().join(a, "query_id").join(b, "paper_id").filter(comparable(F.col("word_count"), F.col("source_words")))
    scored = pairs.withColumn("is_exact", F.col("input_plain") == F.col("source_plain")).withColumn("ngram_overlap", S.containment(F.col("input_shingles"), F.col("source_shingles")))
    scored = scored.drop("input_shingles", "source_shingles", "input_plain", "source_plain")
    sure = scored.filter(F.col("is_exact") | (F.col("ngram_overlap") >= K.NGRAM_THRESHOLD))
    ratio = S.indel_ratio(F.col("input_text"), F.col("source_text"))
    # equal texts have ratio 1; the function is not called for them
    found = sure.withColumn("fuzzy_ratio", F.coalesce(S.indel_ratio(F.when(~F.col("is_exact") | (F.col("input_text") != F.col("source_text")), F.col("input_text")), F.col("source_text")), F.lit(1.0)) if fuzzy else F.lit(None).cast("double"))
    if fuzzy:
        rest = scored.filter(~F.col("is_exact") & (F.col("ngram_overlap") < K.NGRAM_THRESHOLD) & S.indel_possible(F.col("input_text"), F.col("source_text"), K.FUZZY_THRESHOLD))
        found = found.unionByName(rest.withColumn("fuzzy_ratio", ratio).filter(F.col("fuzzy_ratio") >= K.FUZZY_THRESHOLD))
    kind = F.when(F.col("is_exact"), "exact").when(F.col("ngram_overlap") >= K.NGRAM_THRESHOLD, "ngram").otherwise("fuzzy")
    score = F.when(F.col("is_exact"), F.lit(1.0)).when(F.col("ngram_overlap") >= K.NGRAM_THRESHOLD, F.col("ngram_overlap")).otherwise(F.col("fuzzy_ratio"))
    return found.withColumn("match_type", kind).withColumn("match_score", score).withColumnRenamed("paper_id", "source_paper_id").drop("is_exact", "source_words")


def containment_join(queries: DataFrame, corpus: DataFrame, key: str, text: str, least: float = K.NGRAM_THRESHOLD) -> DataFrame:
    """(query_id, source_id, shared, ngram_overlap): corpus rows that contain at least that share of a query's shingles.

    An inverted index on shingle hashes: the number of shared shingles is a
    count over an equi-join, so no pair without a common shingle is formed. A
    row isn't its own source.
    """
    q = queries.select(F.col(key).alias("query_id"), F.explode(S.shingles(F.col(text))).alias("s")).select("query_id", F.xxhash64("s").alias("h"))
    sizes = q.groupBy("query_id").agg(F.count("*").alias("n"))
    q = cut_lineage(q)
    wanted = q.select("h").distinct()
    c = corpus.select(F.col(key).alias("source_id"), F.explode(S.shingles(F.col(text))).alias("s")).select("source_id", F.xxhash64("s").alias("h")).join(wanted, "h", "left_semi")
    # a shingle that a third of all rows have is dealt over several tasks
    c, q, on = split_hot(cut_lineage(c), q, ["h"])
    shared = q.join(c, on).filter("query_id <> source_id").groupBy("query_id", "source_id").agg(F.count("*").alias("shared"))
    return shared.join(sizes, "query_id").withColumn("ngram_overlap", F.col("shared") / F.col("n")).filter(F.col("ngram_overlap") >= least).drop("n")
