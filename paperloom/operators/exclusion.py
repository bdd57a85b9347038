"""Citation and exclusion rules on matches, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom import constants as K
from paperloom.functions import patterns as P
from paperloom.functions import text as X
from paperloom.functions.rx import SPACE, java
from paperloom.operators.matching import any_like


def has_inline_citation(t: Column) -> Column:
    return any_like(t, P.INLINE_CITATIONS)


def for_reference_match(t: Column) -> Column:
    """Lower case without addresses and signs, white space collapsed."""
    t = F.regexp_replace(F.lower(F.coalesce(t, F.lit(""))), java(r"https?://\S+|www\.\S+"), " ")
    t = F.regexp_replace(t, r"[^a-z0-9.\-:]+", " ")  # white space becomes blanks here already
    return X.strip(F.regexp_replace(t, f"[{SPACE}]+", " "))


def source_is_cited(references: Column, title: Column, paper_id: Column, url: Column | None = None, mode: str = "reference", normalised: bool = False) -> Column:
    """Whether a source stands in the references; normalised says that they went through for_reference_match already.

    In mode "reference" an address of a paper, which normalises to nothing, is
    found in any references; in mode "strict" empty needles are passed over.
    """
    refs, name = F.coalesce(references, F.lit("")) if normalised else for_reference_match(references), for_reference_match(title)
    bare = F.trim(F.replace(F.replace(F.trim(F.lower(F.coalesce(paper_id, F.lit("")))), F.lit("arxiv_"), F.lit("")), F.lit(".pdf"), F.lit("")))
    found = (F.length(name) > 20) & refs.contains(name)
    if mode == "reference":
        found = found | (bare != "")
    else:
        plain = for_reference_match(bare)
        found = found | ((bare != "") & (refs.contains(bare) | ((plain != "") & refs.contains(plain))))
    if url is not None:
        address = F.trim(F.lower(F.coalesce(url, F.lit(""))))
        needle = for_reference_match(address)
        found = found | ((address != "") & refs.contains(needle) & ((needle != "") | F.lit(mode == "reference")))
    return (refs != "") & found


def is_reference_section(name: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    out = F.lit(False)
    for k in P.REFERENCE_SECTIONS:
        out = out | low.contains(k)
    return out


def is_reference_like(t: Column) -> Column:
    return F.coalesce(X.let(X.strip(t), lambda s: any_like(s, P.REFERENCE_LIKE)), F.lit(False))


def is_quote(t: Column) -> Column:
    t = X.strip(t)
    out = F.lit(False)
    for left, right in P.QUOTES:
        out = out | (t.startswith(left) & t.endswith(right))
    return F.coalesce((F.length(t) >= 2) & out, F.lit(False))


def is_boilerplate(t: Column) -> Column:
    return F.coalesce(X.let(F.lower(t), lambda s: any_like(s, P.BOILERPLATE)), F.lit(False))


def letter_ratio(t: Column) -> Column:
    size = F.length(t)
    return F.when(size > 0, (size - F.length(F.regexp_replace(t, r"\p{L}+", ""))) / size).otherwise(F.lit(0.0))


def symbol_ratio(t: Column) -> Column:
    size = F.length(t)
    return F.when(size > 0, F.length(F.regexp_replace(t, f"[\\p{{L}}\\p{{N}}{SPACE}]+", "")) / size).otherwise(F.lit(0.0))


def is_short_formula(t: Column, words: Column) -> Column:
    return (words <= P.SYMBOL_WORDS) & (symbol_ratio(t) >= P.SYMBOL_RATIO) & (letter_ratio(t) < P.ALPHA_RATIO)


def apply_exclusion(matches: DataFrame, references: str = "references_text", mode: str = "reference", normalised: bool = False) -> DataFrame:
    """Matches with excluded, exclusion_reasons in their fixed order, source_cited, inline_cited, quoted, risk_modifier and validity.

    The references of a query are the same for all its matches; normalised
    says that they were normalised before, once for each query.
    """
    c = F.col
    with_flags = matches.withColumns(
        {
            "inline_cited": F.coalesce(c("input_near_citation"), F.lit(False)) | has_inline_citation(c("input_text")),
            "quoted": F.coalesce(c("input_is_quote"), F.lit(False)) | is_quote(c("input_text")),
            "source_cited": source_is_cited(c(references), c("source_title"), c("source_paper_id").cast("string"), mode=mode, normalised=normalised),
        }
    )
    tests = [
        c("word_count") < K.SMALL_MATCH_WORDS,
        is_reference_section(c("input_section")) | is_reference_section(c("source_section")),
        is_reference_like(c("input_text")),
        c("quoted") & (c("inline_cited") | c("source_cited")),
        is_boilerplate(c("input_text")) | is_boilerplate(c("source_text")),
        is_short_formula(c("input_text"), c("word_count")),
    ]
    reasons = F.array_compact(F.array(*[F.when(t, F.lit(name)) for t, name in zip(tests, P.EXCLUSION_REASONS)]))
    risk = F.when(c("source_cited"), 0.70).otherwise(1.0) * F.when(c("inline_cited"), 0.75).otherwise(1.0) * F.when(c("quoted"), 0.60).otherwise(1.0)
    done = with_flags.withColumn("exclusion_reasons", reasons).withColumn("excluded", F.size("exclusion_reasons") > 0)
    return done.withColumn("risk_modifier", risk).withColumn("validity", F.when(c("excluded"), "EXCLUDED").otherwise("VALID"))


def exclusion_summary(matches: DataFrame, by: list[str]) -> DataFrame:
    """For each group the numbers and words of valid and excluded matches."""
    out = c_if = F.col("excluded")
    return matches.groupBy(*by).agg(
        F.count("*").alias("total_matches"), F.count_if(~out).alias("valid_matches"), F.count_if(c_if).alias("excluded_matches"),
        F.coalesce(F.sum(F.when(~out, F.col("word_count"))), F.lit(0)).alias("valid_words"), F.coalesce(F.sum(F.when(out, F.col("word_count"))), F.lit(0)).alias("excluded_words"),
    )


def reason_counts(matches: DataFrame, by: list[str]) -> DataFrame:
    return matches.select(*by, F.explode("exclusion_reasons").alias("reason")).groupBy(*by, "reason").agg(F.count("*").alias("n"))
