"""From texts to index, and from many query texts to scores, sources and verdicts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom import constants as K
from paperloom.functions import text as X
from paperloom.operators import layers as L
from paperloom.operators.exclusion import apply_exclusion, for_reference_match
from paperloom.operators.lsh import bucket_mates, look_up, sign
from paperloom.operators.matching import find_matches, make_segments
from paperloom.operators.scoring import similarity_scores, source_contributions
from paperloom.session import cut_lineage


@dataclass
class Check:
    """Results of check(), each keyed by query_id."""

    texts: DataFrame
    segments: DataFrame
    source_segments: DataFrame
    candidates: DataFrame
    matches: DataFrame
    scores: DataFrame
    sources: DataFrame
    members: DataFrame


def chunk_table(papers: DataFrame) -> DataFrame:
    """(paper_id, chunk_id, section, chunk_text, chunk_uid) of papers(paper_id, abstract, introduction, body)."""
    each = papers.select("paper_id", F.posexplode(X.chunks(F.col("abstract"), F.col("introduction"), F.col("body"))).alias("chunk_id", "c"))
    return each.select("paper_id", "chunk_id", "c.section", "c.chunk_text", F.concat_ws("_", "paper_id", F.col("chunk_id").cast("string")).alias("chunk_uid"))


def index_signatures(papers: DataFrame) -> DataFrame:
    """Signatures of abstract, introduction and body of each paper."""
    return sign(papers.withColumn("_t", X.index_text(F.col("abstract"), F.col("introduction"), F.col("body"))), "paper_id", "_t")


def prepare_queries(queries: DataFrame, compose: bool = True) -> DataFrame:
    """queries(query_id, raw_text) cleaned and cut into sections."""
    cleaned = X.clean_online(queries, "raw_text", compose=compose).select("query_id", "cleaned.*")
    return cleaned.withColumn("s", X.sections_online(F.col("clean_text"))).select("*", "s.introduction", "s.body").drop("s")


def _heads(papers: DataFrame, columns: list[str]) -> DataFrame:
    """(paper_id, head): the least id of the papers that are equal in all columns; rows of one id are one paper."""
    each = papers.select("paper_id", F.sha2(F.to_json(F.struct(*columns)), 256).alias("h")).groupBy("paper_id").agg(F.array_sort(F.collect_set("h")).alias("h"))
    return each.join(each.groupBy("h").agg(F.min("paper_id").alias("head")), "h").select("paper_id", "head")


def check(queries: DataFrame, signatures: DataFrame, lookup: DataFrame, citation_mode: str = "reference", fuzzy: bool = True, compose: bool = True) -> Check:
    """Hold any number of queries(query_id, raw_text) against an index.

    signatures: (paper_id, signature); lookup: (paper_id, title, introduction,
    body, clean_text), where a blank body is replaced by clean_text. A query
    isn't compared with a paper of its own id. Every bucket mate is a
    candidate; papers with equal texts are compared once and joined back. A
    lookup of lookup_table, stored by prefix, is read only where candidates
    are. Without fuzzy segments match only if equal or by shared shingles,
    without compose texts are cleaned without Unicode NFKC.
    """
    texts = cut_lineage(prepare_queries(queries, compose))
    words = texts.withColumn("_q", X.query_text(F.col("clean_text"), F.col("introduction"), F.col("body")))
    own = sign(words.select(F.col("query_id").alias("paper_id"), "_q"), "paper_id", "_q", least_chars=0)
    candidates = cut_lineage(bucket_mates(own, signatures, "paper_id"))
    # of a lookup table stored by prefix only the candidates' partitions are read
    stored = {"pid_norm", "pid_prefix"} <= set(lookup.columns)
    wanted = candidates.select(F.col("candidate").alias("paper_id")).distinct()
    found = look_up(wanted, lookup, "paper_id") if stored else lookup.join(wanted, "paper_id", "left_semi")
    found = found.select("paper_id", "title", "introduction", "body", "clean_text").dropDuplicates(["paper_id"])
    body = F.when(X.strip(F.coalesce("body", F.lit(""))) == "", F.col("clean_text")).otherwise(F.col("body"))
    sections = [("introduction", "introduction"), ("body", "body")]
    found = cut_lineage(found.withColumn("body", body))  # a paper of several rows keeps one of them
    members = cut_lineage(_heads(found, ["introduction", "body"]))
    sources = make_segments(found.join(members.select(F.col("head").alias("paper_id")).distinct(), "paper_id", "left_semi"), "paper_id", sections, carry=["title"])
    segments = make_segments(texts, "query_id", sections)
    asked = candidates.select("query_id", F.col("candidate").alias("paper_id")).join(members, "paper_id")
    compared = find_matches(segments, sources, asked.select("query_id", F.col("head").alias("paper_id")).distinct(), fuzzy)
    named = asked.join(found.select("paper_id", F.col("title").alias("source_title")), "paper_id").withColumnsRenamed({"paper_id": "source_paper_id", "head": "_head"})
    raw = compared.withColumnRenamed("source_paper_id", "_head").drop("source_title").join(named, ["query_id", "_head"]).drop("_head")
    cited = texts.select("query_id", for_reference_match(F.col("references_text")).alias("references_text"))
    matches = cut_lineage(apply_exclusion(raw.join(cited, "query_id"), mode=citation_mode, normalised=True).drop("references_text"))
    return Check(texts, segments, sources, candidates, matches, similarity_scores(texts, matches), source_contributions(texts, matches), members)


def facts(queries: DataFrame, made: Check) -> DataFrame:
    """(query_id, ...): what a report says of a query beside its scores.

    candidate_ids are the MAX_CANDIDATES most similar ones, candidate_count
    counts all. page_count is null where queries has no such column.
    """
    pages = F.col("page_count") if "page_count" in queries.columns else F.lit(None).cast("int").alias("page_count")
    path = F.col("file_path") if "file_path" in queries.columns else F.col("query_id").cast("string").alias("file_path")
    own = queries.select("query_id", path, pages, X.word_count(F.col("raw_text")).alias("word_count_raw")).dropDuplicates(["query_id"])
    texts = made.texts.select("query_id", "quality_flag", "word_count_clean")
    order = Window.partitionBy("query_id").orderBy(F.desc("jaccard_similarity"), "candidate")
    first = made.candidates.withColumn("no", F.row_number().over(order)).filter(F.col("no") <= K.MAX_CANDIDATES)
    named = first.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("no", "candidate"))), lambda x: x["candidate"]).alias("candidate_ids"))
    per_paper = made.source_segments.groupBy(F.col("paper_id").alias("head")).agg(F.count("*").alias("n"))
    loaded = made.candidates.join(made.members.withColumnRenamed("paper_id", "candidate"), "candidate").join(per_paper, "head", "left")
    counted = loaded.groupBy("query_id").agg(F.count("*").alias("candidate_rows_loaded"), F.coalesce(F.sum("n"), F.lit(0)).alias("source_segment_count"))
    numbers = {"candidate_count": made.candidates.groupBy("query_id").agg(F.count("*").alias("candidate_count")), "input_segment_count": made.segments.groupBy("query_id").agg(F.count("*").alias("input_segment_count"))}
    out = own.join(texts, "query_id").withColumn("created_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"))
    for more in (named, counted, *numbers.values()):
        out = out.join(more, "query_id", "left")
    return out.fillna(0, ["candidate_rows_loaded", "source_segment_count", *numbers]).withColumn("candidate_ids", F.coalesce("candidate_ids", F.array().cast("array<string>")))


def verdict(queries: DataFrame, signatures: DataFrame, papers: DataFrame, neighbours: DataFrame) -> DataFrame:
    """One verdict row for each of queries(query_id, clean_text, title, abstract, authors).

    neighbours(query_id, pid, cosine) are the nearest chunks' papers. Every
    bucket mate is a candidate; papers with equal texts are compared once.
    """
    own = sign(queries.select(F.col("query_id").alias("paper_id"), "clean_text"), "paper_id", "clean_text", least_chars=0)
    l1 = cut_lineage(L.layer1(bucket_mates(own, signatures, "paper_id")))
    l3 = cut_lineage(L.layer3(neighbours))
    candidates = l1.select("query_id", "pid").unionByName(l3.select("query_id", "pid")).distinct()
    near = papers.join(candidates.select(F.col("pid").alias("paper_id")).distinct(), "paper_id", "left_semi")
    heads = cut_lineage(_heads(near, ["title", "abstract", "introduction", "body"]).withColumnRenamed("paper_id", "pid"))
    asked = candidates.join(heads, "pid")
    once = asked.select("query_id", F.col("head").alias("pid")).distinct()
    l2 = L.layer2(queries, once, papers).withColumnRenamed("pid", "head")
    l2 = cut_lineage(asked.join(l2, ["query_id", "head"]).drop("head"))
    l4 = L.layer4(queries, once, papers)  # only its best value of a query counts
    l5 = L.layer5(queries, L.all_scores(l1, l2, l3), papers)
    return L.verdicts(queries, l1, l2, l3, l4, l5)
