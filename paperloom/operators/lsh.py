"""Signatures, banded index, all-pairs and probe."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom import constants as K
from paperloom.functions import similarity as S
from paperloom.operators.metadata import base_id, pid_norm, pid_prefix
from paperloom.session import PAIR_ROWS, cut_lineage, split_hot, spread


def sign(df: DataFrame, key: str, text: str, least_chars: int = 200) -> DataFrame:
    """(key, signature) of every text of over least_chars characters with five tokens; others and nulls give no row."""
    rows = spread(df.filter(F.col(text).isNotNull() & (F.length(text) > least_chars)).select(key, F.col(text).alias("_text")))
    return S.text_signatures(rows, "_text").filter("signature is not null")


def whole(signatures: DataFrame) -> DataFrame:
    """Rows whose signature has all its values."""
    return signatures.filter(F.size("signature") == K.PERMUTATIONS)


def bucket_table(signatures: DataFrame, key: str) -> DataFrame:
    """(band, bucket, key): the index. The bucket is a hash of the band's five values."""
    keyed = whole(signatures).select(key, F.explode(S.band_keys(F.col("signature"))).alias("b"))
    return keyed.select(F.col("b.band").alias("band"), F.xxhash64("b.band", "b.key").alias("bucket"), key)


def _classes(signatures: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Members (key, class_id) and classes (class_id, signature): equal signatures are one class, so copies never meet in a bucket."""
    hashed = whole(signatures).select(key, "signature", F.xxhash64("signature").alias("class_id"))
    return hashed.select(key, "class_id"), hashed.groupBy("class_id").agg(F.first("signature").alias("signature"))


def class_links(classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard_similarity): classes that share a bucket and reach the threshold; hot buckets are dealt over several tasks."""
    buckets = cut_lineage(bucket_table(classes, "class_id").select("bucket", "class_id"))
    left, right, on = split_hot(buckets, buckets, ["bucket"], PAIR_ROWS)
    found = left.withColumnRenamed("class_id", "a").join(right.withColumnRenamed("class_id", "b"), on).filter("a < b").select("a", "b").distinct()
    side = lambda n: classes.select(F.col("class_id").alias(n), F.col("signature").alias(f"s{n}"))
    scored = found.join(side("a"), "a").join(side("b"), "b").select("a", "b", S.agreement(F.col("sa"), F.col("sb")).alias("jaccard_similarity"))
    return scored.filter(F.col("jaccard_similarity") >= threshold)


def near_duplicate_classes(signatures: DataFrame, key: str, threshold: float = K.LSH_THRESHOLD) -> DataFrame:
    """(key, class_id, n_links): one row for each key, links counted between classes; copies are never paired."""
    members, classes = _classes(signatures, key)
    links = class_links(classes, threshold)
    ends = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    return members.join(ends, "class_id", "left").select(key, "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def near_duplicate_pairs(signatures: DataFrame, key: str, threshold: float = K.LSH_THRESHOLD) -> DataFrame:
    """(id_a, id_b, jaccard_similarity, similarity_level), id_a < id_b: linked representatives.

    The representative of a class of equal signatures is its least key; each
    other member is paired with it at similarity 1, so no link is lost and
    copies are not expanded.
    """
    members, classes = _classes(signatures, key)
    heads = members.groupBy("class_id").agg(F.min(key).alias("head"))
    links = class_links(classes, threshold)
    side = lambda n: heads.select(F.col("class_id").alias(n), F.col("head").alias(f"h{n}"))
    between = links.join(side("a"), "a").join(side("b"), "b").select(F.least("ha", "hb").alias("id_a"), F.greatest("ha", "hb").alias("id_b"), "jaccard_similarity")
    copies = members.join(heads, "class_id").filter(F.col(key) != F.col("head")).select(F.col("head").alias("id_a"), F.col(key).alias("id_b"), F.lit(1.0).alias("jaccard_similarity")).distinct()
    return between.unionByName(copies).withColumn("similarity_level", S.similarity_level(F.col("jaccard_similarity")))


def different_papers(pairs: DataFrame) -> DataFrame:
    """Pairs that aren't versions of one paper; a null id is no paper."""
    return pairs.filter(base_id(F.col("id_a").cast("string")) != base_id(F.col("id_b").cast("string")))


def _met(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(a, b): classes of the queries and of the index that share a bucket; a hot bucket's classes are dealt over several tasks."""
    left, right, on = split_hot(cut_lineage(bucket_table(index, "class_id")), bucket_table(queries, "class_id"), ["band", "bucket"])
    return right.withColumnRenamed("class_id", "a").join(left.withColumnRenamed("class_id", "b"), on).select("a", "b").distinct()


def bucket_mates(queries: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """(query_id, candidate, jaccard_similarity): every bucket mate of each query, without a cut.

    queries and index have (key, signature). Equal signatures are one class on
    either side while buckets are joined and signatures compared; members are
    joined back afterwards. A key isn't its own candidate; of a key with
    several signatures the best counts.
    """
    asking, q = _classes(queries, key)
    members, c = _classes(index, key)
    side = lambda df, n: df.select(F.col("class_id").alias(n), F.col("signature").alias(f"s{n}"))
    met = _met(q, c)
    scored = met.join(side(q, "a"), "a").join(side(c, "b"), "b").select("a", "b", S.agreement(F.col("sa"), F.col("sb")).alias("jaccard_similarity"))
    found = scored.join(asking.select(F.col(key).alias("query_id"), F.col("class_id").alias("a")), "a").join(members.select(F.col(key).alias("candidate"), F.col("class_id").alias("b")), "b")
    return found.filter(F.col("query_id") != F.col("candidate")).groupBy("query_id", "candidate").agg(F.max("jaccard_similarity").alias("jaccard_similarity"))


def probe(queries: DataFrame, index: DataFrame, key: str, most: int = K.MAX_CANDIDATES) -> DataFrame:
    """(query_id, candidate, jaccard_similarity, rank): for each query its most similar bucket mates.

    queries and index have (key, signature). Classes of equal signatures are
    compared once, and only the classes that can hold the first most mates are
    expanded to their members. Equal similarities rank by id, so the cut is
    the same in every run. A key isn't its own candidate.
    """
    asking, q = _classes(queries.dropDuplicates([key]), key)
    members, c = _classes(index.dropDuplicates([key]), key)
    side = lambda df, n: df.select(F.col("class_id").alias(n), F.col("signature").alias(f"s{n}"))
    scored = _met(q, c).join(side(q, "a"), "a").join(side(c, "b"), "b").select("a", "b", S.agreement(F.col("sa"), F.col("sb")).alias("jaccard_similarity"))
    # by id, so that of a class only its first most + 1 members can be among the first most mates
    first = members.withColumn("no", F.row_number().over(Window.partitionBy("class_id").orderBy(key))).filter(F.col("no") <= most + 1)
    better = Window.partitionBy("a").orderBy(F.desc("jaccard_similarity")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = members.groupBy(F.col("class_id").alias("b")).agg(F.count("*").alias("n"))
    above = F.sum("n").over(better) - F.sum("n").over(Window.partitionBy("a", "jaccard_similarity"))
    needed = scored.join(sizes, "b").withColumn("above", above).filter(F.col("above") <= most)
    found = needed.join(first.select(F.col("class_id").alias("b"), F.col(key).alias("candidate")), "b").join(asking.select(F.col("class_id").alias("a"), F.col(key).alias("query_id")), "a")
    order = Window.partitionBy("query_id").orderBy(F.desc("jaccard_similarity"), "candidate")
    ranked = found.filter(F.col("query_id") != F.col("candidate")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return ranked.select("query_id", "candidate", "jaccard_similarity", "rank")


def self_probe(signatures: DataFrame, key: str, first: int = 5, most: int = K.MAX_CANDIDATES) -> DataFrame:
    """The mates of the index's first keys in their order, as a test of the index."""
    asked = whole(signatures).select(key).distinct().orderBy(key).limit(first)
    return probe(signatures.join(F.broadcast(asked), key, "left_semi"), signatures, key, most)


def top_pairs(pairs: DataFrame, most: int = 10) -> DataFrame:
    """The most similar pairs of the highest level; equal similarities come by their ids."""
    return pairs.filter(F.col("similarity_level") == "HIGH").orderBy(F.desc("jaccard_similarity"), "id_a", "id_b").limit(most)


def lookup_table(papers: DataFrame) -> DataFrame:
    """papers with pid_norm and pid_prefix, to be written by prefix; ids too short to have one are left out, as published."""
    norm = pid_norm(F.col("paper_id"))
    return papers.withColumn("pid_norm", norm).withColumn("pid_prefix", pid_prefix(norm)).filter("pid_prefix is not null")


#: Candidates whose ids are broadcast at most, about 4 MB, and prefixes that are named to the scan at most; beyond it the lookup is a shuffled join over all partitions.
LOOKUP_IDS, LOOKUP_PREFIXES = 50_000, 2_000


def look_up(candidates: DataFrame, lookup: DataFrame, key: str = "candidate", most: int | None = None) -> DataFrame:
    """Rows of a lookup table (see lookup_table) whose paper is a candidate.

    The candidates' prefixes are a filter of the scan, so of a table stored by
    pid_prefix only their partitions are read. With most only so many rows,
    the first by paper.
    """
    norm = pid_norm(F.col(key))
    ids = cut_lineage(candidates.select(norm.alias("pid_norm"), pid_prefix(norm).alias("pid_prefix")).filter("pid_prefix is not null").distinct())
    prefixes = [r[0] for r in ids.select("pid_prefix").distinct().limit(LOOKUP_PREFIXES + 1).collect()]
    if len(prefixes) <= LOOKUP_PREFIXES:
        lookup = lookup.filter(F.col("pid_prefix").isin(prefixes))
    small = ids.limit(LOOKUP_IDS + 1).count() <= LOOKUP_IDS
    found = lookup.join(F.broadcast(ids) if small else ids, ["pid_prefix", "pid_norm"], "left_semi")
    return found.orderBy("pid_norm", "paper_id").limit(most) if most is not None else found
