"""Problem 6: records that share most of their content, by multi-index hashing.

The fingerprint of a text is a vector of min-hash symbols of its word
shingles; the Hamming distance of two fingerprints counts the symbols that
differ, and a similarity of s makes each symbol agree with probability s. The
vector is cut into segments, and of each segment the Hamming ball of radius
one is entered into the tables: every way to leave out one symbol. A pair is
fetched where two balls meet, and its complete distance is verified, here the
exact Jaccard similarity of the shingle sets.

With 24 segments of three symbols a pair of similarity 0.5 is missed with
probability 0.5 ** 24, and a likelier one less often still. Texts with equal
shingle sets are one class with one fingerprint. A table entry carries four
bits of each of 64 symbols, so the distance of what meets in it is known at
once and chance pairs go no further: of pairs at the threshold less than one
in ten million is lost to it. An entry that many classes share is dealt over
several tasks.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.similarity import text_signatures
from paperloom.llm.common import mix64
from paperloom.session import PAIR_ROWS, cut_lineage, split_hot

SHINGLE_WORDS = 5
SEGMENTS, SEGMENT_SYMBOLS = 24, 3
#: Symbols of the fingerprint kept with an entry, bits of each, and the share of pairs at the threshold that may be lost to them.
SKETCH_SYMBOLS, SKETCH_BITS, SKETCH_LOSS = 64, 4, 1e-7
#: Candidates of one class that one task compares.
PARTNERS = 1000

_WORDS = re.compile(r"\w{2,}").findall
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) > 500_000:
            self.clear()
        self[word] = value
        return value


def shingle_set(text: str | None, words: _WordHash, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of size words; none for shorter texts."""
    found = _WORDS(text.lower()) if text else []
    if len(found) < size:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(words.__getitem__, found), dtype=np.uint64, count=len(found))
    n = len(h) - size + 1
    total = h[:n].copy()
    for i in range(1, size):
        total = total * _SPREAD + h[i : i + n]
    return np.unique(mix64(total))


#: Odd multipliers, one for each symbol: shingle hashes are mixed already, and an odd factor permutes them.
_FACTORS = mix64(np.arange(1, SEGMENTS * SEGMENT_SYMBOLS + 1, dtype=np.uint64) * _SPREAD) | np.uint64(1)


def _symbols(shingles: np.ndarray) -> np.ndarray:
    """Min-hash symbols of a set, 32 bits each."""
    low = np.full(len(_FACTORS), np.uint64(2**64 - 1))
    for at in range(0, len(shingles), 512):
        np.minimum(low, (_FACTORS[:, None] * shingles[None, at : at + 512]).min(axis=1), out=low)
    return mix64(low) >> np.uint64(32)


def ball_keys(symbols: np.ndarray, segments: int = SEGMENTS, width: int = SEGMENT_SYMBOLS) -> np.ndarray:
    """Table entries of each row of symbols: of each segment, every way to leave out one symbol."""
    parts = symbols.reshape(-1, segments, width)
    keys = np.empty(parts.shape, dtype=np.uint64)
    for out in range(width):
        value = np.broadcast_to(np.arange(segments, dtype=np.uint64) * np.uint64(width) + np.uint64(out + 1), parts.shape[:2])
        for j in range(width):
            if j != out:
                value = mix64(value * _SPREAD ^ parts[:, :, j])
        keys[:, :, out] = value
    return keys.reshape(len(parts), -1)


def sketches(symbols: np.ndarray) -> np.ndarray:
    """Planes of SKETCH_BITS bits of the first SKETCH_SYMBOLS symbols of each row, 64 symbols in an integer."""
    place = np.uint64(1) << np.arange(SKETCH_SYMBOLS, dtype=np.uint64)
    return np.stack([(((symbols[:, :SKETCH_SYMBOLS] >> np.uint64(b)) & np.uint64(1)) * place).sum(axis=1, dtype=np.uint64) for b in range(SKETCH_BITS)])


def least_agreement(threshold: float, loss: float = SKETCH_LOSS) -> int:
    """Symbols of a sketch that must agree, so that a pair at the threshold fails with less than the probability loss."""
    p, total = threshold + (1 - threshold) / 2**SKETCH_BITS, 0.0
    for k in range(SKETCH_SYMBOLS + 1):
        total += math.comb(SKETCH_SYMBOLS, k) * p**k * (1 - p) ** (SKETCH_SYMBOLS - k)
        if total > loss:
            return k
    return SKETCH_SYMBOLS


def text_classes(df: DataFrame, key: str, text: str, size: int = SHINGLE_WORDS) -> DataFrame:
    """(key, class_id, shingles) of each row with a key: its shingle set and a hash of it, null for texts without shingles."""

    def run(batches):
        words = _WordHash()
        for batch in batches:
            sets = [shingle_set(t, words, size) for t in batch.column(1).to_pylist()]
            blobs = [s.tobytes() if len(s) else None for s in sets]
            ids = [None if b is None else xxhash.xxh3_64_intdigest(b) - (1 << 63) for b in blobs]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], ["key", "class_id", "shingles"])

    rows = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).filter("key is not null")
    return rows.mapInArrow(run, "key string, class_id bigint, shingles binary")


_PLANES = [f"s{i}" for i in range(SKETCH_BITS)]


def _entries(batches):
    for batch in batches:
        ids = batch.column(0).to_numpy()
        blobs = batch.column(1).to_pylist()
        for at in range(0, len(blobs), 2048):
            symbols = np.stack([_symbols(np.frombuffer(b, dtype=np.uint64)) for b in blobs[at : at + 2048]])
            keys = ball_keys(symbols)
            each = keys.shape[1]
            columns = [keys.ravel().view(np.int64), np.repeat(ids[at : at + 2048], each), *(np.repeat(p.view(np.int64), each) for p in sketches(symbols))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["entry", "class_id", *_PLANES])


def candidates_of(classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: classes whose balls meet in an entry and whose sketches are near enough."""
    entries = cut_lineage(classes.select("class_id", "shingles").mapInArrow(_entries, "entry bigint, class_id bigint, " + ", ".join(f"{p} bigint" for p in _PLANES)))
    left, right, on = split_hot(entries, entries, ["entry"], PAIR_ROWS)
    left = left.withColumnsRenamed({"class_id": "a"} | {p: f"a_{p}" for p in _PLANES})
    right = right.withColumnsRenamed({"class_id": "b"} | {p: f"b_{p}" for p in _PLANES})
    differ = " | ".join(f"(a_{p} ^ b_{p})" for p in _PLANES)
    near = F.expr(f"bit_count({differ}) <= {SKETCH_SYMBOLS - least_agreement(threshold)}")
    return left.join(right, on).filter(F.col("a") < F.col("b")).filter(near).select("a", "b").distinct()


def similar_classes(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity), a < b: pairs of classes of at least the threshold; sets(class_id, shingles) is a stored table and may repeat a class."""
    once = lambda df: df.groupBy("class_id").agg(F.first("shingles").alias("shingles"))
    candidates = cut_lineage(candidates_of(once(sets), threshold))
    wanted = candidates.select(F.explode(F.array("a", "b")).alias("class_id")).distinct()
    classes = cut_lineage(once(sets.join(wanted, "class_id", "left_semi")))

    def verify(batches):
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            share = np.zeros(len(a))
            for i, (x, y) in enumerate(zip(a, b)):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                if min(len(x), len(y)) < threshold * max(len(x), len(y)):
                    continue
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                share[i] = common / (len(x) + len(y) - common)
            keep = share >= threshold
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep)), pa.array(share[keep])], ["a", "b", "similarity"])

    # a class of very many partners is dealt over several tasks
    side = lambda name: classes.select(F.col("class_id").alias(name), F.col("shingles").alias(f"set_{name}"))
    left, set_a, on_a = split_hot(candidates, side("a"), ["a"], PARTNERS, "_part_a")
    left, set_b, on_b = split_hot(left, side("b"), ["b"], PARTNERS, "_part_b")
    both = left.join(set_a, on_a).join(set_b, on_b)
    return both.select("a", "b", "set_a", "set_b").mapInArrow(verify, "a bigint, b bigint, similarity double")


def near_copies(df: DataFrame, key: str, text: str, threshold: float = 0.8, size: int = SHINGLE_WORDS) -> tuple[DataFrame, DataFrame]:
    """(members, links): members(key, class_id) of each key, links(a, b, similarity) between classes.

    Two keys are similar if their classes are the same or linked. Rows of one
    key with different texts put it into several classes. A key that has only
    null texts or texts under size words has one row with a null class_id;
    null keys are left out and other columns dropped; an empty table gives
    empty results. This compact form never expands copies into pairs.
    """
    sets = cut_lineage(text_classes(df, key, text, size))
    known = sets.filter("class_id is not null")
    found = known.select("key", "class_id").distinct()
    alone = sets.filter("class_id is null").select("key", "class_id").distinct().join(known, "key", "left_anti")
    return cut_lineage(found.unionByName(alone)), similar_classes(known, threshold)


#: Values of a whole stored signature.
SIGNATURE_VALUES = 128


def sketch_states(papers: DataFrame, stored: DataFrame, key: str, text: str, signature: str) -> DataFrame:
    """(key, state): how far the stored signatures can stand for the texts, one row for each key of papers.

    state is missing (no row), null, cut (not of SIGNATURE_VALUES values),
    fresh (some row equals the signature of some text of the key) or stale.
    Where a key has several rows the best state counts, in the order fresh,
    stale, cut, null. Keys without a text that can be signed have only missing
    or unsigned; null keys are left out.
    """
    signed = text_signatures(papers.filter(F.col(key).isNotNull()).select(key, F.col(text).alias("_text")), "_text", "own").distinct()
    kept = stored.filter(F.col(key).isNotNull()).select(key, F.col(signature).alias("kept"), F.lit(True).alias("there")).distinct()
    both = signed.join(kept, key, "left")
    known = F.when(F.col("there").isNull(), 5).when(F.col("own").isNull(), 4).when(F.col("kept").isNull(), 3).when(F.size("kept") != SIGNATURE_VALUES, 2).when(F.col("kept") != F.col("own"), 1).otherwise(0)
    names = F.array(*[F.lit(n) for n in ("fresh", "stale", "cut", "null", "unsigned", "missing")])
    return both.groupBy(key).agg(F.min(known).alias("n")).select(key, F.element_at(names, F.col("n") + 1).alias("state"))


def similar_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(key_a, key_b), key_a < key_b: every pair of different keys, copies expanded; members is a stored table."""
    members = members.filter("class_id is not null")
    own = lambda name: members.select(F.col("key").alias(f"key_{name}"), F.col("class_id").alias(name))

    def expanded(pairs: DataFrame, name: str) -> DataFrame:
        dealt, pairs, on = split_hot(own(name), pairs, [name])
        return dealt.join(pairs, on).drop("_part")

    between = expanded(expanded(links.select("a", "b"), "a"), "b")
    within = expanded(own("b").withColumnRenamed("b", "a"), "a").filter("key_a < key_b").select("key_a", "key_b")
    ordered = between.filter("key_a <> key_b").select(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b"))
    return ordered.unionByName(within).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges(a, b); component is the least node reached.

    Large-star and small-star steps in turn, each a shuffle on the node, until
    nothing changes; no node's neighbours are gathered in one row.
    """
    edges = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        edges = cut_lineage(small.filter("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()).distinct()


def copy_groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """(key, class_id, group_id, n_links): one row for each key and class.

    group_id is the least class joined to it by links; n_links counts the
    linked classes. A key without a class has null ids and no links.
    """
    links = cut_lineage(links)
    ends = links.select(F.col("a").alias("class_id")).unionAll(links.select(F.col("b").alias("class_id"))).groupBy("class_id").agg(F.count("*").alias("n_links"))
    found = components(links.select("a", "b")).withColumnRenamed("node", "class_id")
    return (
        members.join(found, "class_id", "left")
        .join(ends, "class_id", "left")
        .select("key", "class_id", F.coalesce("component", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
