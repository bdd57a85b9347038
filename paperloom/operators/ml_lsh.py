"""The all-pairs variant on hashed shingles and five hash tables."""

from __future__ import annotations

from pyspark.ml.feature import HashingTF, MinHashLSH, NGram, RegexTokenizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.ml.functions import vector_to_array

from paperloom import constants as K
from paperloom.functions import similarity as S
from paperloom.operators.metadata import base_id
from paperloom.session import PAIR_ROWS, cut_lineage, split_hot

#: SPACE is the number of features, below the prime of MinHashLSH.
TABLES, SPACE, LEAST_FILES, LEAST_WORDS = 5, 1 << 30, 2, 20


def tokens(df: DataFrame, text: str, out: str = "words") -> DataFrame:
    """df with the lower-case tokens of two or more ASCII word characters, rows of fewer than LEAST_WORDS left out."""
    made = RegexTokenizer(inputCol=text, outputCol=out, pattern="\\W+", minTokenLength=2, toLowercase=True).transform(df.filter(F.col(text).isNotNull()))
    return made.filter(F.size(out) >= LEAST_WORDS)


def shared_shingles(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, shared): hashes of the shingles of each row that at least LEAST_FILES rows have; rows without any have an empty list."""
    rows = df.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text"))
    grams = NGram(n=K.SHINGLE_WORDS, inputCol="words", outputCol="grams").transform(tokens(rows, "text"))
    hashes = grams.select("id", F.array_distinct(F.transform("grams", lambda g: F.xxhash64(g))).alias("all"))
    hashes = cut_lineage(hashes.withColumn("row", F.monotonically_increasing_id()))  # read by the counts and by the vectors
    lone = hashes.select("row", F.explode("all").alias("h")).groupBy("h").agg(F.count("*").alias("n"), F.min("row").alias("row")).filter(F.col("n") < LEAST_FILES)
    lone = lone.groupBy("row").agg(F.collect_list("h").alias("lone"))
    return hashes.join(lone, "row", "left").select("id", F.when(F.col("lone").isNull(), F.col("all")).otherwise(F.array_except("all", "lone")).alias("shared"))


def table_pairs(keyed: DataFrame, least: float = 0.5) -> DataFrame:
    """(id_a, id_b, jaccard_similarity, similarity_level) of keyed(id, h): rows whose lists of table values h agree in that share of places.

    Equal lists are one row in the buckets, joined back to their least id; a
    hot bucket is dealt over several tasks. Versions of one paper are no pair.
    """
    heads = cut_lineage(keyed.groupBy("h").agg(F.min("id").alias("head"), F.first(F.size("h")).alias("tables")))
    entries = cut_lineage(heads.select("head", "tables", F.posexplode("h").alias("band", "value")))
    left, right, on = split_hot(entries, entries.select("band", "value", F.col("head").alias("b")), ["band", "value"], PAIR_ROWS)
    found = left.withColumnRenamed("head", "a").join(right, on).filter("a < b").groupBy("a", "b", "tables").agg(F.count("*").alias("n"))
    found = found.select("a", "b", (F.col("n") / F.col("tables")).alias("jaccard_similarity"))
    copies = keyed.join(heads, "h").filter("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("jaccard_similarity")).distinct()
    pairs = found.unionByName(copies).filter(F.col("jaccard_similarity") >= least).filter(base_id(F.col("a")) != base_id(F.col("b")))
    return pairs.select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), "jaccard_similarity", S.similarity_level(F.col("jaccard_similarity")).alias("similarity_level"))


def ml_pairs(df: DataFrame, key: str, text: str, seed: int = 42) -> DataFrame:
    """(id_a, id_b, jaccard_similarity, similarity_level): pairs that agree in at least half of five hash tables.

    Tokens are split on ASCII non-word characters. Every shingle of at least
    LEAST_FILES (2) texts takes part, at any size: shingles are hashed into a
    space of 2**30 features instead of the published vocabulary of the 2**18
    most frequent ones. What only one text has is taken out of that text's
    list, by counts that are added up before they are moved, so frequent
    shingles gather nowhere. Copies with the same hashes are one row in the
    buckets, joined back to their least key afterwards; a bucket is a plain
    join key, of any size.
    """
    shared = shared_shingles(df, key, text)
    vectors = HashingTF(inputCol="shared", outputCol="features", numFeatures=SPACE, binary=True).transform(shared.filter(F.size("shared") > 0))
    hashed = MinHashLSH(inputCol="features", outputCol="hashes", numHashTables=TABLES, seed=seed).fit(vectors).transform(vectors)
    # each table's hash is a vector of one value
    values = hashed.select("id", F.posexplode("hashes").alias("table", "v")).select("id", "table", vector_to_array("v")[0].cast("bigint").alias("v"))
    keyed = values.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("table", "v"))), lambda x: x["v"]).alias("h"))
    return table_pairs(cut_lineage(keyed))
