"""The layered comparison of a query text with candidate papers, and its verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom import constants as K
from paperloom.functions import similarity as S
from paperloom.functions import text as X
from paperloom.operators.vectors import semantic_score

#: Query sentences compared, the longest first.
SENTENCES = 100
#: Papers of a ranked list.
RANKED = 15


def layer1(probed: DataFrame) -> DataFrame:
    """(query_id, pid, jaccard) of candidates with an estimated similarity of at least 0.3."""
    return probed.filter(F.col("jaccard_similarity") >= 0.3).select("query_id", F.col("candidate").alias("pid"), X.rounded(F.col("jaccard_similarity"), 4).alias("jaccard"))


def longest_sentences(queries: DataFrame, most: int = SENTENCES) -> DataFrame:
    """(query_id, pos, sentence, n_sentences) of queries(query_id, clean_text): the longest of the first 200 sentences."""
    each = queries.select("query_id", F.posexplode(F.slice(X.sentences_demo(F.col("clean_text")), 1, 200)).alias("pos", "sentence"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.length("sentence")), "pos")
    ranked = each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).drop("rank")
    return ranked.withColumn("n_sentences", F.count("*").over(Window.partitionBy("query_id")))


def layer2(queries: DataFrame, candidates: DataFrame, papers: DataFrame, least: float = K.FUZZY_THRESHOLD) -> DataFrame:
    """(query_id, pid, fuzzy_count, fuzzy_ratio): share of the query's sentences with a like one in the paper.

    Length tests run inside the join; equal sentences are settled without the
    character ratio, which sees only what is left, in batches. With least 1
    only equal sentences are alike.
    """
    own = longest_sentences(queries).withColumn("a", F.lower("sentence"))
    each = papers.join(candidates.select(F.col("pid").alias("paper_id")).distinct(), "paper_id", "left_semi")
    theirs = each.select(F.col("paper_id").alias("pid"), F.explode(F.concat(*[X.sentences_demo(F.coalesce(F.col(c), F.lit(""))) for c in ("abstract", "introduction", "body")])).alias("o"))
    theirs = theirs.select("pid", F.lower("o").alias("b")).distinct()
    low, high = F.least(F.length("a"), F.length("b")), F.greatest(F.length("a"), F.length("b"))
    pairs = candidates.select("query_id", "pid").distinct().join(own, "query_id").join(theirs, "pid").filter((high <= K.SENTENCE_RATIO * low) & S.indel_possible(F.col("a"), F.col("b"), least))
    equal = pairs.filter(F.col("a") == F.col("b")).select("query_id", "pid", "pos", "n_sentences").distinct()
    rest = pairs.join(equal.select("query_id", "pid", "pos"), ["query_id", "pid", "pos"], "left_anti").withColumn("r", S.indel_ratio(F.col("a"), F.col("b")))
    alike = rest.filter(F.col("r") >= least).select("query_id", "pid", "pos", "n_sentences")
    hits = (equal.unionByName(alike) if least < 1 else equal).distinct().groupBy("query_id", "pid", "n_sentences").agg(F.count("*").alias("fuzzy_count"))
    return hits.select("query_id", "pid", "fuzzy_count", X.rounded(F.col("fuzzy_count") / F.greatest(F.col("n_sentences"), F.lit(1)), 4).alias("fuzzy_ratio"))


def layer3(neighbours: DataFrame) -> DataFrame:
    """(query_id, pid, cosine): the best chunk of each paper among neighbours(query_id, pid, cosine)."""
    return neighbours.groupBy("query_id", "pid").agg(X.rounded(F.max("cosine"), 4).alias("cosine"))


def concept_score(title_a: Column, abstract_a: Column, title_b: Column, abstract_b: Column, title_ratio: Column | None = None) -> Column:
    """Weighted likeness of titles, keywords, cue phrases and percentages."""
    ratio = S.sequence_ratio(F.lower(title_a), F.lower(title_b)) if title_ratio is None else title_ratio
    return (
        0.3 * ratio
        + 0.3 * S.jaccard(S.keywords(abstract_a), S.keywords(abstract_b))
        + 0.2 * S.jaccard(S.cue_phrases(abstract_a), S.cue_phrases(abstract_b))
        + 0.2 * S.jaccard(S.percent_numbers(abstract_a), S.percent_numbers(abstract_b))
    )


def layer4(queries: DataFrame, candidates: DataFrame, papers: DataFrame) -> DataFrame:
    """(query_id, pid, concept) over 0.2; queries(query_id, title, abstract), papers(paper_id, title, abstract)."""
    a = queries.select("query_id", F.coalesce("title", F.lit("")).alias("ta"), F.coalesce("abstract", F.lit("")).alias("aa"))
    b = papers.select(F.col("paper_id").alias("pid"), F.coalesce("title", F.lit("")).alias("tb"), F.coalesce("abstract", F.lit("")).alias("ab")).dropDuplicates(["pid"])
    pairs = candidates.select("query_id", "pid").distinct().join(a, "query_id").join(b, "pid")
    score = concept_score(F.col("ta"), F.col("aa"), F.col("tb"), F.col("ab"))
    return pairs.withColumn("concept", score).filter(F.col("concept") > 0.2).select("query_id", "pid", X.rounded(F.col("concept"), 4).alias("concept"))


def layer5(queries: DataFrame, scores: DataFrame, papers: DataFrame) -> DataFrame:
    """(query_id, pid, common, sim) for papers with a common author; common lists three of them in order, sim is the paper's best score."""
    plain = lambda c: F.array_distinct(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: X.strip(F.lower(x))))
    a = queries.select("query_id", plain("authors").alias("qa"))
    b = papers.select(F.col("paper_id").alias("pid"), plain("authors").alias("pa")).dropDuplicates(["pid"])
    both = scores.join(a, "query_id").join(b, "pid").withColumn("shared", F.array_sort(F.array_intersect("qa", "pa")))
    return both.filter(F.size("shared") > 0).select("query_id", "pid", F.slice("shared", 1, 3).alias("common"), X.rounded(F.col("score"), 4).alias("sim"))


def all_scores(l1: DataFrame, l2: DataFrame, l3: DataFrame) -> DataFrame:
    """(query_id, pid, score, band): the best of three layers for each paper."""
    named = [l1.select("query_id", "pid", F.col("jaccard").alias("s")), l2.select("query_id", "pid", F.col("fuzzy_ratio").alias("s")), l3.select("query_id", "pid", F.col("cosine").alias("s"))]
    best = named[0].unionByName(named[1]).unionByName(named[2]).groupBy("query_id", "pid").agg(F.max("s").alias("score"))
    return best.withColumn("band", score_band(F.col("score")))


def score_band(s: Column) -> Column:
    return F.when(s >= 0.7, "high").when(s >= 0.5, "medium").when(s >= 0.3, "low").otherwise("none")


def ranked_list(scores: DataFrame, most: int = RANKED) -> DataFrame:
    """(query_id, pid, score, band, rank): the best papers of each query; equal scores rank by id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "pid")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def verdict_columns(l1: Column, l2: Column, l3: Column, l4: Column, l5: Column) -> dict[str, Column]:
    """score, confidence, verdict and self_overlap of five layer scores."""
    base = F.when(l1 < 0.05, 0.35 * l2 + 0.45 * l3 + 0.10 * l4 + 0.10 * l5).otherwise(0.40 * l1 + 0.25 * l2 + 0.25 * l3 + 0.10 * l4)
    score = F.least(base * F.when(l1 > 0.3, 1.2).otherwise(1.0) * F.when(l2 > 0.5, 1.15).otherwise(1.0), F.lit(1.0))
    confidence = F.when((l1 > 0.15) | (l2 > 0.25), "HIGH").when(l3 > 0.5, "MEDIUM").otherwise("LOW")
    verdict = (
        F.when((score > 0.65) & (confidence != "LOW"), "PLAGIARISM").when(score > 0.50, "HIGHLY SUSPICIOUS").when(score > 0.35, "SUSPICIOUS").when(score > 0.20, "SIMILAR").otherwise("CLEAN")
    )
    return {"score": score, "confidence": confidence, "verdict": verdict, "self_overlap": l5 > 0.5}


def verdicts(queries: DataFrame, l1: DataFrame, l2: DataFrame, l3: DataFrame, l4: DataFrame, l5: DataFrame) -> DataFrame:
    """(query_id, l1 .. l5, score, confidence, verdict, self_overlap): one row for each query, 0 where a layer has nothing."""
    out = queries.select("query_id").distinct()
    for name, layer, value in (("l1", l1, "jaccard"), ("l2", l2, "fuzzy_ratio"), ("l3", l3, "cosine"), ("l4", l4, "concept"), ("l5", l5, "sim")):
        best = layer.groupBy("query_id").agg(F.max(value).alias(name))
        out = out.join(best, "query_id", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    out = out.withColumn("l3", X.rounded(semantic_score(F.col("l3")), 4))
    return out.withColumns(verdict_columns(*(F.col(f"l{i}") for i in range(1, 6))))
