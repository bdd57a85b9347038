"""Problem 9: documents that say the same over and over.

Two orders of one n-gram model look at each document. The lower orders are
counted by Spark over the whole corpus, smoothed by modified Kneser-Ney and
kept as sorted arrays of hashes with log probabilities; the perplexity they
give a document is held against bands of its language, and one outside is
rejected as broken or copied-out text. The highest order, eight words, is
counted within each document, in sorted arrays too; the share of words that
lie in a sequence counted twice or more is the share of repeated content.

The bands can't replace that share: a document may be a third repetition and
be as likely, word for word, as any other. p9_found therefore decides by the
highest order alone; README.md has the figures.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import mix64
from paperloom.session import cut_lineage

SEQUENCE = 8
SHARE = 0.3
#: Most word pairs and words the broadcast part of the model may hold, 12 and
#: 16 bytes each. Rarer pairs stay in a table that the documents' pairs are
#: joined with, so probabilities are those of all pairs at any bound; it only
#: says how many of the commonest ones need no join.
MODEL_PAIRS, MODEL_WORDS = 100_000, 50_000
#: A band reaches so many robust deviations from the median of its language.
BAND = 4.0
#: Texts with fewer words are not judged by perplexity.
LEAST_WORDS = 20
#: Tables of bands of up to so many languages are broadcast, about 1 MB; others are left to the join's own size check.
LANGUAGES = 20_000
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
STEP_WORDS = 500_000


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) > 500_000:
            self.clear()
        self[word] = value
        return value


def _steps(texts: pa.Array, hashes: _Hashes):
    """(first row, word hashes, where each text's words start) of about STEP_WORDS words at a time."""
    first, flat, counts = 0, [], []
    for i, t in enumerate(texts.to_pylist()):
        words = t.lower().split() if t else []
        flat += words
        counts.append(len(words))
        if len(flat) >= STEP_WORDS or i + 1 == len(texts):
            yield first, np.fromiter(map(hashes.__getitem__, flat), dtype=np.uint64, count=len(flat)), np.r_[0, np.cumsum(counts)]
            first, flat, counts = i + 1, [], []


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64(a * _SPREAD + b)


def repeated_share(words: np.ndarray, starts: np.ndarray, length: int = SEQUENCE) -> np.ndarray:
    """For each text the share of its words in sequences of length words found twice or more in it; 0 without words."""
    n, texts = len(words), len(starts) - 1
    sizes = np.diff(starts)
    share = np.zeros(texts)
    if n < length:
        return share
    owner = np.repeat(np.arange(texts, dtype=np.uint64), sizes)
    h = words[: n - length + 1].copy()
    for i in range(1, length):
        h = h * _SPREAD + words[i : n - length + 1 + i]
    inside = np.flatnonzero(owner[: len(h)] == owner[length - 1 :])
    key = mix64(mix64(h[inside]) ^ mix64(owner[inside] + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = inside[order[np.r_[same, False] | np.r_[False, same]]]
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + length, -1)
    covered = np.r_[0, np.cumsum(np.cumsum(edge[:-1]) > 0)]
    some = sizes > 0
    share[some] = (covered[starts[1:]] - covered[starts[:-1]])[some] / sizes[some]
    return share


def count_pairs(df: DataFrame, text: str) -> DataFrame:
    """(a, b, n): how often word b follows word a, over all texts; a is 0 at a text's start."""

    def run(batches):
        hashes = _Hashes()
        for batch in batches:
            for _, words, starts in _steps(batch.column(0), hashes):
                before = np.r_[np.uint64(0), words[:-1]] if len(words) else words
                if len(words):
                    before[starts[:-1][np.diff(starts) > 0]] = 0
                _, at, n = np.unique(pair_key(before, words), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(before[at].view(np.int64)), pa.array(words[at].view(np.int64)), pa.array(n)], ["a", "b", "n"])

    parts = df.select(F.col(text).alias("text")).filter("text is not null").mapInArrow(run, "a bigint, b bigint, n bigint")
    return parts.groupBy("a", "b").agg(F.sum("n").alias("n"))


def discounts(counts_of_counts: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and 3 or more, from how many grams have counts 1 to 4."""
    n1, n2, n3, n4 = (max(1, n) for n in counts_of_counts)
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


def _discount(n, d) -> F.Column:
    return F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])


class Model:
    """Sorted hash arrays: pairs with their log probability, words with their own and the weight of their back-off.

    rest has the pairs that are too many for the arrays, as a table (a, b,
    log); None if there are none.
    """

    rest: DataFrame | None = None

    def __init__(self, pairs, words, unknown: float):
        self.pairs, self.pair_log = pairs
        self.words, self.word_log, self.backoff = words
        self.unknown = unknown

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "rest"}

    def log_probabilities(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of each word after the one before, from the arrays alone."""
        return self.look_up(words, starts)[0]

    def look_up(self, words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log probabilities, the words before, and whether the arrays have the pair."""
        if not len(words):
            return np.zeros(0), words, np.zeros(0, dtype=bool)
        before = np.r_[np.uint64(0), words[:-1]]
        before[starts[:-1][np.diff(starts) > 0]] = 0
        own, known = _look_up(self.words, words)
        log = np.where(known, self.word_log[own], self.unknown)
        prior, seen = _look_up(self.words, before)
        log = log + np.where(seen, self.backoff[prior], 0.0)
        at, found = _look_up(self.pairs, pair_key(before, words))
        return np.where(found, self.pair_log[at], log), before, found


def _look_up(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted


def _fitting(df: DataFrame, column: str, most: int) -> int:
    """The least count from which on at most so many rows are kept; from 1,024 on only powers of two are looked at."""
    n = F.col(column)
    step = F.when(n < 1024, n).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(n))).cast("bigint"))
    by = df.groupBy(step.alias("n")).agg(F.count("*").alias("rows")).collect()  # at most 1,024 + 54 rows
    cut, kept = 1 << 62, 0
    for r in sorted(by, key=lambda r: -r["n"]):
        if kept + r["rows"] > most:
            break
        kept, cut = kept + r["rows"], r["n"]
    return cut


def fit_model(df: DataFrame, text: str) -> Model:
    """A pair model by interpolated modified Kneser-Ney, of all words of all texts."""
    pairs = cut_lineage(count_pairs(df, text))
    following = pairs.groupBy("b").agg(F.count("*").alias("k"))
    low = [F.count_if(F.col("n") == i) for i in (1, 2, 3, 4)]
    total, *of_pairs = pairs.agg(F.count("*"), *low).first()
    if not total:
        return Model((np.zeros(1, np.uint64), np.zeros(1)), (np.zeros(1, np.uint64), np.zeros(1), np.zeros(1)), 0.0)
    words, *of_words = following.agg(F.count("*"), *[F.count_if(F.col("k") == i) for i in (1, 2, 3, 4)]).first()
    d2, d1 = discounts(of_pairs), discounts(of_words)
    spare = following.agg(F.sum(_discount(F.col("k"), d1))).first()[0] / total / (words + 1)
    own = following.select("b", "k", ((F.col("k") - _discount(F.col("k"), d1)) / total + spare).alias("p"))
    given = pairs.groupBy("a").agg(F.sum("n").alias("all"), F.sum(_discount(F.col("n"), d2)).alias("held")).select("a", "all", (F.col("held") / F.col("all")).alias("weight"))
    cut = _fitting(pairs, "n", MODEL_PAIRS)
    score = lambda some: some.join(own, "b").join(given, "a").select("a", "b", F.log((F.col("n") - _discount(F.col("n"), d2)) / F.col("all") + F.col("weight") * F.col("p")).cast("float").alias("log"))
    table = score(pairs.filter(F.col("n") >= cut)).toArrow()  # at most MODEL_PAIRS rows
    key = pair_key(table["a"].to_numpy().view(np.uint64), table["b"].to_numpy().view(np.uint64))
    order = np.argsort(key)
    kept = own.withColumnRenamed("b", "w").join(given.withColumnRenamed("a", "w"), "w", "full_outer").fillna({"k": 0})
    kept = kept.withColumn("size", F.greatest("k", F.coalesce("all", F.lit(0))))
    kept = kept.filter(F.col("size") >= _fitting(kept, "size", MODEL_WORDS))
    unknown = math.log(spare)
    vocabulary = kept.select("w", F.coalesce(F.log("p"), F.lit(unknown)).cast("float").alias("log"), F.coalesce(F.log("weight"), F.lit(0.0)).cast("float").alias("back")).toArrow()  # at most MODEL_WORDS rows
    w = vocabulary["w"].to_numpy().view(np.uint64)
    by = np.argsort(w)
    if not len(w):  # not even the most frequent ones fit
        w, by = np.zeros(1, np.uint64), np.zeros(1, np.int64)
        vocabulary = pa.table({"log": [unknown], "back": [0.0]})
    if not len(key):
        key, order, table = np.zeros(1, np.uint64), np.zeros(1, np.int64), pa.table({"log": [unknown]})
    model = Model(
        (key[order], table["log"].to_numpy()[order]),
        (w[by], vocabulary["log"].to_numpy()[by], vocabulary["back"].to_numpy()[by]),
        unknown,
    )
    if len(table) < total:
        model.rest = score(pairs.filter(F.col("n") < cut))
    return model


def measure(df: DataFrame, key: str, text: str, lang: str, model: Model, length: int = SEQUENCE) -> DataFrame:
    """(key, lang, n_words, repeated_share, log_perplexity) of each row of df.

    Null and empty texts have n_words 0, share 0 and null log_perplexity.
    Pairs that the model's arrays lack are joined with its rest; they are the
    rare ones, so no key of that join is hot.
    """
    shared, rest = df.sparkSession.sparkContext.broadcast(model), model.rest

    more = rest is not None

    def run(batches):
        hashes, m = _Hashes(), shared.value
        for batch in batches:
            for first, words, starts in _steps(batch.column(2), hashes):
                n = np.diff(starts)
                log, before, found = m.look_up(words, starts)
                sums = np.r_[0.0, np.cumsum(log, dtype=np.float64)]
                with np.errstate(invalid="ignore", divide="ignore"):
                    mean = -(sums[starts[1:]] - sums[starts[:-1]]) / n
                part = batch.slice(first, len(n))
                made = [part.column(0), part.column(1), pa.array(n), pa.array(repeated_share(words, starts, length)), pa.array(mean, mask=n == 0)]
                if more:
                    at = np.flatnonzero(~found)
                    each = pa.StructArray.from_arrays([pa.array(before[at].view(np.int64)), pa.array(words[at].view(np.int64)), pa.array(log[at].astype(np.float64))], ["a", "b", "back"])
                    made.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(at, starts).astype(np.int32)), each))
                yield pa.RecordBatch.from_arrays(made, ["key", "lang", "n_words", "repeated_share", "log_perplexity", "missing"][: len(made)])

    kind = df.schema[key].dataType.simpleString()
    language = F.coalesce(F.lower(F.trim(lang)), F.lit("und"))
    chosen = df.select(F.col(key).alias("key"), language.alias("lang"), F.col(text).alias("text"))
    schema = f"key {kind}, lang string, n_words bigint, repeated_share double, log_perplexity double"
    if not more:
        return chosen.mapInArrow(run, schema).withColumnRenamed("key", key)
    looked = chosen.mapInArrow(run, schema + ", missing array<struct<a:bigint,b:bigint,back:double>>")
    looked = cut_lineage(looked.withColumn("row", F.monotonically_increasing_id()))  # read by the join and by what it adds to
    wanted = looked.select("row", F.explode("missing").alias("m")).select("row", "m.*")
    gain = wanted.join(rest, ["a", "b"]).groupBy("row").agg(F.sum(F.col("log") - F.col("back")).alias("gain"))
    summed = looked.drop("missing").join(gain, "row", "left").withColumn("log_perplexity", F.col("log_perplexity") - F.coalesce("gain", F.lit(0.0)) / F.col("n_words"))
    return summed.drop("row", "gain").withColumnRenamed("key", key)


def repetition(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", share: float = SHARE) -> DataFrame:
    """(key, lang, n_words, repeated_share, perplexity, lower, upper, repeated, band) of each row.

    repeated says whether the share of words in repeated sequences of eight is
    at least share. lower and upper are the perplexity bands of the row's
    language (null languages are one, named und); band is low, high, inside,
    or null for texts of under LEAST_WORDS words. Ties and repeated rows are
    rows of their own, other columns are dropped, an empty table gives none.
    """
    measured = cut_lineage(measure(df, key, text, lang, fit_model(df, text)))
    judged = measured.filter(F.col("n_words") >= LEAST_WORDS)
    middle = cut_lineage(judged.groupBy("lang").agg(F.percentile_approx("log_perplexity", 0.5, 10000).alias("middle")))
    small = F.broadcast if middle.count() <= LANGUAGES else lambda df: df
    spread = judged.join(small(middle), "lang").groupBy("lang", "middle").agg((F.percentile_approx(F.abs(F.col("log_perplexity") - F.col("middle")), 0.5, 10000) * 1.4826 * BAND + 1e-9).alias("reach"))
    p = F.exp("log_perplexity")
    lower, upper = F.exp(F.col("middle") - F.col("reach")), F.exp(F.col("middle") + F.col("reach"))
    band = F.when(F.col("n_words") >= LEAST_WORDS, F.when(p < lower, "low").when(p > upper, "high").otherwise("inside"))
    return measured.join(small(spread), "lang", "left").select(
        key, "lang", "n_words", "repeated_share", p.alias("perplexity"), lower.alias("lower"), upper.alias("upper"), (F.col("repeated_share") >= share).alias("repeated"), band.alias("band")
    )
