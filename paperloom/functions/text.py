"""Text functions as Spark columns: words, both cleaners, sections, segments, sentences, chunks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from paperloom import constants as K
from paperloom.functions import patterns as P
from paperloom.functions.rx import SPACE, java



def let(value: Column, then) -> Column:
    """then(value), with value computed once.

    Catalyst shares equal subexpressions within one projection, but not inside
    lambdas, where an outer expression would be computed for every element.
    """
    return F.transform(F.array(value), then)[0]


_EDGES = f"^[{SPACE}]+|[{SPACE}]+\\z"


def strip(t: Column) -> Column:
    return F.regexp_replace(t, _EDGES, "")


def word_count(t: Column) -> Column:
    """Runs of non-white-space; 0 for null. Splitting at white space takes a seventh of the time of matching what is none."""
    return F.coalesce(F.size(F.array_remove(F.split(t, f"[{SPACE}]+"), "")), F.lit(0))


def _replace_where(sign: str, pattern: str, by: str):
    return lambda t: F.when(F.contains(t, F.lit(sign)), F.regexp_replace(t, java(pattern), by)).otherwise(t)


def replace_all(t: Column, steps) -> Column:
    for pattern, by in steps:
        if "@" in pattern:  # needed by every match, and most texts have none
            t = let(t, _replace_where("@", pattern, by))
        else:
            t = F.regexp_replace(t, java(pattern), by)
    return t


@F.pandas_udf(StringType())
def nfkc_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(t: Column) -> Column:
    """Unicode NFKC; only texts beyond ASCII go through Python."""
    return F.coalesce(nfkc_udf(F.when(~t.rlike(r"\A[\x00-\x7f]*\z"), t)), t)


def ligatures(t: Column, upto: str = "ﬆ") -> Column:
    for sign, letters in P.LIGATURES.items():
        if sign <= upto:
            t = F.replace(t, F.lit(sign), F.lit(letters))
    return t


def first_match(t: Column, pattern: str) -> Column:
    """Position of the first match from 1, or 0."""
    return F.regexp_instr(t, F.lit(java(pattern)))


# ---- offline cleaner --------------------------------------------------------


def drop_front_matter(t: Column) -> Column:
    """Header line, time stamp, publisher notices and report numbers."""
    return replace_all(t, [(P.OFFLINE_HEADER, ""), (P.OFFLINE_STAMP, ""), (P.OFFLINE_PUBLISHER, ""), (P.OFFLINE_REPORT, "")])


def references_at(t: Column) -> Column:
    """Length of what stands before the references: a heading in the last 40 %, else a list in the last 25 %; null if neither."""
    size = F.length(t)
    low, strict = F.floor(size * 0.60).cast("int"), F.floor(size * 0.75).cast("int")
    heading = first_match(F.substring(t, low + 1, size), P.OFFLINE_REFERENCES)
    listed = first_match(F.substring(t, strict + 1, size), P.OFFLINE_REFERENCE_LIST)
    return F.when(heading > 0, low + heading - 1).when(listed > 0, strict + listed - 1)


def rounded(x: Column, digits: int) -> Column:
    """As published: halves that a double holds exactly go to the even digit."""
    return F.bround(x, digits)


def _normalised(df: DataFrame, parted: str, pages, upto: str, control: str, tail, compose: bool) -> DataFrame:
    """df with _clean: the last steps of a cleaner, each column computed once."""
    df = df.withColumn("_plain", ligatures(replace_all(F.col(parted), pages), upto))
    df = df.withColumn("_plain", nfkc(F.col("_plain"))) if compose else df
    body = F.regexp_replace(F.regexp_replace(F.col("_plain"), P.CONTROL, control), java(P.HYPHEN), "$1$2")
    return df.withColumn("_clean", strip(replace_all(body, tail))).drop("_plain")


def clean_offline(df: DataFrame, text: str, out: str = "cleaned", compose: bool = True) -> DataFrame:
    """df with struct(clean_text, has_references, word_count_clean, reduction_ratio, quality_flag); a null text is as an empty one.

    The flag follows from the ratio before it is rounded to three digits.
    Without compose the step of Unicode NFKC is left out.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    # a column for each step: inside lambdas Catalyst would interpret them
    df = df.withColumn("_front", drop_front_matter(raw)).withColumn("_cut", references_at(F.col("_front")))
    kept = F.when(F.col("_cut").isNotNull(), F.substring(F.col("_front"), F.lit(1), F.col("_cut"))).otherwise(F.col("_front"))
    df = df.withColumn("_parted", F.struct(kept.alias("kept"), F.col("_cut").isNotNull().alias("cut"))).drop("_front", "_cut")
    df = _normalised(df, "_parted.kept", P.OFFLINE_PAGES, "ﬆ", "", P.OFFLINE_TAIL, compose)
    counted = F.struct(word_count(F.col("_clean")).alias("n"), word_count(raw).alias("raw"))

    def result(c: Column) -> Column:
        ratio = F.when(c["raw"] > 0, c["n"] / c["raw"]).otherwise(F.lit(0.0))
        return F.struct(
            F.col("_clean").alias("clean_text"), F.col("_parted.cut").alias("has_references"), c["n"].alias("word_count_clean"), rounded(ratio, 3).alias("reduction_ratio"), quality_offline(c["n"], ratio).alias("quality_flag")
        )

    return df.withColumn(out, let(counted, result)).drop("_parted", "_clean")


def quality_offline(words: Column, ratio: Column) -> Column:
    return F.when(words < 300, "empty").when(words < 500, "low_quality").when(ratio < 0.3, "over_cleaned").otherwise("ok")


# ---- online cleaner ---------------------------------------------------------


def online_front(t: Column) -> Column:
    return replace_all(t, [(P.ONLINE_HEADER, " "), *((p, " ") for p in P.ONLINE_JOURNAL)])


def online_references_at(t: Column) -> Column:
    """Length of what stands before the first marker word from 55 % on; null if there is none."""
    start = F.floor(F.length(t) * 0.55).cast("int")
    low = F.lower(t)
    found = [F.locate(marker, F.substring(low, start + 1, F.length(t))) for marker in P.ONLINE_MARKERS]
    return F.least(*[F.when(f > 0, start + f - 1) for f in found])


def clean_online(df: DataFrame, text: str, out: str = "cleaned", compose: bool = True) -> DataFrame:
    """df with struct(clean_text, references_text, word_count_clean, quality_flag, has_references); without compose no Unicode NFKC."""

    def parts(front: Column) -> Column:
        return let(
            online_references_at(front),
            lambda cut: F.struct(
                F.when(cut.isNotNull(), F.substring(front, F.lit(1), cut)).otherwise(front).alias("body"),
                F.when(cut.isNotNull(), F.substring(front, cut + 1, F.length(front))).otherwise("").alias("references"),
            ),
        )

    df = df.withColumn("_parted", let(online_front(F.coalesce(F.col(text), F.lit(""))), parts))
    df = _normalised(df, "_parted.body", P.ONLINE_PAGES, "ﬅ", " ", P.ONLINE_TAIL, compose)

    def result(n: Column) -> Column:
        return F.struct(
            F.col("_clean").alias("clean_text"),
            F.col("_parted.references").alias("references_text"),
            n.alias("word_count_clean"),
            F.when(n >= 500, "ok").when(n >= 300, "low_quality").otherwise("empty").alias("quality_flag"),
            (strip(F.col("_parted.references")) != "").alias("has_references"),
        )

    return df.withColumn(out, let(word_count(F.col("_clean")), result)).drop("_parted", "_clean")


# ---- sections ---------------------------------------------------------------


def _rest(t: Column, start: Column) -> Column:
    return F.substring(t, start, F.length(t))


def _matched(t: Column, pattern: str) -> Column:
    return F.regexp_extract(t, java(pattern), 0)


def sections_offline(t: Column) -> Column:
    """struct(introduction, body). What stands before the introduction is in neither; without a heading all is body."""

    def parted(t: Column, at: Column) -> Column:
        tail = _rest(t, at + F.length(_matched(t, P.OFFLINE_INTRODUCTION)))
        return let(
            F.struct(tail.alias("tail"), first_match(tail, P.OFFLINE_NEXT).alias("after")),
            lambda x: F.struct(
                strip(F.when(x["after"] > 0, F.substring(x["tail"], F.lit(1), x["after"] - 1)).otherwise(x["tail"])).alias("introduction"),
                F.when(x["after"] > 0, strip(_rest(x["tail"], x["after"]))).otherwise("").alias("body"),
            ),
        )

    whole = lambda t: F.struct(F.lit("").alias("introduction"), strip(t).alias("body"))
    return let(F.coalesce(t, F.lit("")), lambda t: let(first_match(t, P.OFFLINE_INTRODUCTION), lambda at: F.when(at > 0, parted(t, at)).otherwise(whole(t))))


def sections_online(t: Column) -> Column:
    """struct(introduction, body): the body is the text with the introduction's first occurrence blanked."""

    def opening(t: Column, at: Column) -> Column:
        tail = _rest(t, at + F.length(_matched(t, P.ONLINE_INTRODUCTION)))
        return let(
            F.struct(tail.alias("tail"), first_match(tail, P.ONLINE_NEXT).alias("after")),
            lambda x: strip(F.when(x["after"] > 0, F.substring(x["tail"], F.lit(1), x["after"] - 1)).otherwise(F.substring(x["tail"], 1, 6000))),
        )

    def parted(t: Column, found: Column) -> Column:
        where = F.call_function("locate", found, t)
        without = F.concat(F.substring(t, F.lit(1), where - 1), F.lit(" "), _rest(t, where + F.length(found)))
        return F.struct(found.alias("introduction"), F.when(found == "", t).otherwise(strip(without)).alias("body"))

    return let(
        F.coalesce(t, F.lit("")),
        lambda t: let(first_match(t, P.ONLINE_INTRODUCTION), lambda at: let(F.when(at > 0, opening(t, at)).otherwise(""), lambda found: parted(t, found))),
    )


def paragraphs(t: Column) -> Column:
    return F.filter(F.transform(F.split(t, java(r"\n\s*\n")), strip), lambda p: p != "")


SEGMENT = "struct<idx:int,text:string,start_char:int,end_char:int,word_count:int>"


def segments(t: Column, least_words: int = K.MIN_SEGMENT_WORDS) -> Column:
    """Paragraphs of at least least_words words with their number among all paragraphs and place in the section."""

    def add(t: Column, state: Column, x: Column) -> Column:
        p, words = x["p"], x["words"]
        start = F.call_function("locate", p, t, state["cursor"] + 1) - 1
        item = F.struct(state["idx"].alias("idx"), p.alias("text"), start.alias("start_char"), (start + F.length(p)).alias("end_char"), words.alias("word_count"))
        keep = words >= least_words
        return F.struct(
            (state["idx"] + 1).alias("idx"),
            F.when(keep, start + F.length(p)).otherwise(state["cursor"]).alias("cursor"),
            F.when(keep, F.concat(state["items"], F.array(item))).otherwise(state["items"]).alias("items"),
        )

    counted = lambda t: F.transform(paragraphs(t), lambda p: F.struct(p.alias("p"), word_count(p).cast("int").alias("words")))
    first = F.struct(F.lit(0).alias("idx"), F.lit(0).alias("cursor"), F.array().cast(f"array<{SEGMENT}>").alias("items"))
    return let(t, lambda t: F.aggregate(counted(t), first, lambda state, x: add(t, state, x), lambda s: s["items"]))


def sentences(t: Column, least: int) -> Column:
    return F.filter(F.transform(F.split(strip(t), f"(?<=[.!?])[{SPACE}]+"), strip), lambda s: F.length(s) >= least)


def sentences_demo(t: Column) -> Column:
    """Sentences of at least 30 characters; none of a shorter or null text."""
    return F.when(F.length(t) >= 30, sentences(t, 30)).otherwise(F.array().cast("array<string>"))


def _section_chunks(name: str, t: Column) -> Column:
    def grouped(found: Column) -> Column:
        count = F.ceil(F.size(found) / K.CHUNK_SENTENCES).cast("int")
        return F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: F.array_join(F.slice(found, i * K.CHUNK_SENTENCES + 1, K.CHUNK_SENTENCES), " "))

    def made(t: Column) -> Column:
        kept = F.filter(let(sentences(t, 20), grouped), lambda c: F.length(c) >= 50)
        named = F.transform(kept, lambda c: F.struct(F.lit(name).alias("section"), c.alias("chunk_text")))
        return F.when(F.length(t) >= 50, named).otherwise(F.array().cast("array<struct<section:string,chunk_text:string>>"))

    return let(strip(F.coalesce(t, F.lit(""))), made)


def chunks(abstract: Column, introduction: Column, body: Column) -> Column:
    """Groups of four sentences, section after section; position in the array is the chunk's id."""
    return F.concat(_section_chunks("abstract", abstract), _section_chunks("introduction", introduction), _section_chunks("body", body))


def extract_abstract(t: Column) -> Column:
    to_heading = strip(F.regexp_extract(t, java(P.ABSTRACT_TO_HEADING), 1))
    long = strip(F.regexp_extract(t, java(P.ABSTRACT_LONG), 1))
    words = F.array_join(F.slice(F.regexp_extract_all(t, F.lit(f"([^{SPACE}]+)")), 1, 300), " ")
    return F.when(F.length(to_heading) > 50, to_heading).when(t.rlike(java(P.ABSTRACT_LONG)), long).otherwise(words)


def query_title(t: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(t, java(P.TITLE), 1), F.lit("")), F.substring(t, 1, 100))


def index_text(abstract: Column, introduction: Column, body: Column) -> Column:
    """What a paper's signature is made of."""
    return F.concat_ws(" ", abstract, introduction, body)


def query_text(clean: Column, introduction: Column, body: Column) -> Column:
    joined = strip(F.concat(introduction, F.lit(" "), body))
    return F.when(F.length(joined) < 200, clean).otherwise(joined)
