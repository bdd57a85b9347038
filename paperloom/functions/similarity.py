"""Shingles, min-hash signatures and similarities as columns."""

from __future__ import annotations

import difflib
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from paperloom import constants as K
from paperloom.functions import patterns as P
from paperloom.functions.rx import SPACE, WORD, java
from paperloom.functions.text import let


def tokens(t: Column) -> Column:
    """Lower-case runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(t), F.lit(f"([{WORD}]{{2,}})"))


def shingles_of(words: Column, k: int = K.SHINGLE_WORDS) -> Column:
    def made(words: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.array_join(F.slice(words, i, k), " "))
        return F.when(F.size(words) >= k, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))

    return let(words, made)


def shingles(t: Column, k: int = K.SHINGLE_WORDS) -> Column:
    """The set of k-word shingles; empty for fewer words and for null."""
    return shingles_of(tokens(t), k)


def shingle_hash(s: Column) -> Column:
    """The md5 of a shingle modulo 2**31 - 1, from its four 32-bit words: 2**32 is 2 modulo that prime."""


    def modulo(hex_: Column) -> Column:
        part = lambda i: F.conv(F.substring(hex_, 8 * i + 1, 8), 16, 10).cast("bigint")
        return F.pmod(part(0) * 8 + part(1) * 4 + part(2) * 2 + part(3), F.lit(K.PRIME))

    return let(F.md5(s), modulo)


def shingle_hashes(t: Column) -> Column:
    return F.array_distinct(F.transform(shingles(t), shingle_hash))


_A, _B = (np.array(x, dtype=np.uint64)[:, None] for x in K.permutation_parameters())


def minima(h: np.ndarray) -> np.ndarray:
    low = None
    for i in range(0, len(h), 4096):
        part = ((_A * h[None, i : i + 4096] + _B) % np.uint64(K.PRIME)).min(axis=1)
        low = part if low is None else np.minimum(low, part)
    return low.astype(np.int32)


def signatures(df: DataFrame, hashes: str, out: str = "signature") -> DataFrame:
    """df with the 128 minima of (a * h + b) mod p in place of the array column hashes; null where that is empty.

    The minima are matrix operations on whole arrays; as lambdas inside Spark
    each would be interpreted for every permutation and every shingle.
    """
    others = [f for f in df.schema.fields if f.name != hashes]

    def run(batches):
        for batch in batches:
            sets = batch.column(batch.num_columns - 1)
            flat, edge = sets.values.to_numpy(zero_copy_only=False).astype(np.uint64), sets.offsets.to_numpy()
            valid = sets.is_valid().to_numpy(zero_copy_only=False)
            made = [minima(flat[i:j]) if ok and j > i else None for i, j, ok in zip(edge, edge[1:], valid)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.list_(pa.int32()))], [*(f.name for f in others), out])

    schema = StructType([*others, StructField(out, ArrayType(IntegerType()))])
    return df.select(*(f.name for f in others), F.col(hashes).cast("array<bigint>")).mapInArrow(run, schema)


_WORDS = re.compile(r"\w{2,}").findall


def hash_set(text: str, k: int = K.SHINGLE_WORDS) -> np.ndarray:
    """The distinct shingle hashes of a text; none for fewer than k words."""
    words = _WORDS(text.lower())
    made = {" ".join(words[i : i + k]) for i in range(len(words) - k + 1)}
    parts = np.frombuffer(b"".join(hashlib.md5(s.encode("utf-8", "surrogatepass")).digest() for s in made), dtype=">u4").reshape(-1, 4).astype(np.uint64)
    return np.unique((parts @ np.array([8, 4, 2, 1], dtype=np.uint64)) % np.uint64(K.PRIME))


def text_signatures(df: DataFrame, text: str, out: str = "signature") -> DataFrame:
    """df with the signature of the column text in its place; null for null texts and those of fewer than five words.

    The same values as signatures() of shingle_hashes(). One Python step does
    the whole: cutting and hashing shingles by Spark's array lambdas, which
    are interpreted, took several times as long.
    """
    others = [f for f in df.schema.fields if f.name != text]

    def run(batches):
        for batch in batches:
            made = []
            for t in batch.column(batch.num_columns - 1).to_pylist():
                h = hash_set(t) if t else ()
                made.append(minima(h) if len(h) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.list_(pa.int32()))], [*(f.name for f in others), out])

    schema = StructType([*others, StructField(out, ArrayType(IntegerType()))])
    return df.select(*(f.name for f in others), text).mapInArrow(run, schema)


def band_keys(signature: Column) -> Column:
    """One struct(band, key) for each band of the signature."""
    return F.transform(F.sequence(F.lit(0), F.lit(K.BANDS - 1)), lambda b: F.struct(b.alias("band"), F.slice(signature, b * K.BAND_ROWS + 1, K.BAND_ROWS).alias("key")))


def agreement(a: Column, b: Column) -> Column:
    """Share of equal positions of two signatures: the estimated Jaccard similarity."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)


def similarity_level(s: Column) -> Column:
    return F.when(s >= K.SIMILARITY_HIGH, "HIGH").otherwise("MEDIUM")


def normalised(t: Column) -> Column:
    """Lower case with white space collapsed; two texts are the same if these are."""
    return F.trim(F.regexp_replace(F.lower(t), f"[{SPACE}]+", " "))


def containment(a: Column, b: Column) -> Column:
    """Share of a's shingles that b has too; 0 if a has none."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def longest_common_subsequence(a: str, b: str) -> int:
    """Length of it, by bit-parallel rows: one big integer holds a row of the table."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    mask = (1 << len(a)) - 1
    row = mask
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & mask
    return len(a) - row.bit_count()


def indel(a: str | None, b: str | None) -> float | None:
    """2 * LCS / (len a + len b); 1 for two empty texts."""
    if a is None or b is None:
        return None
    total = len(a) + len(b)
    return 2 * longest_common_subsequence(a, b) / total if total else 1.0


@F.arrow_udf(DoubleType())
def indel_ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([indel(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())


def indel_possible(a: Column, b: Column, least: float) -> Column:
    """Lengths that allow a ratio of at least least; a cheap test before indel_ratio."""
    low, high = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return low * (2 - least) >= high * least


@F.arrow_udf(DoubleType())
def sequence_ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    """Ratio of matching blocks of two short texts."""
    return pa.array([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())


def keywords(t: Column) -> Column:
    """Words of four or more letters a to z that no other word character touches."""
    words = F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit(f"([{WORD}]+)"))
    return F.array_distinct(F.filter(words, lambda w: w.rlike(P.KEYWORD_WHOLE)))


def cue_phrases(t: Column) -> Column:
    low = F.lower(F.coalesce(t, F.lit("")))
    return F.array_compact(F.array(*[F.when(low.contains(c), F.lit(c)) for c in P.CUES]))


def percent_numbers(t: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(java(P.PERCENT)), F.lit(1)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """A vector divided by its length; itself if that is 0."""
    return let(F.sqrt(dot(v, v)), lambda size: F.transform(v, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(x.cast("double"))))
