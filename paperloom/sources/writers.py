"""Sinks: JSON lines, Parquet parts, partitions, buckets, reports."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom import constants as K
from paperloom.functions import patterns as P
from paperloom.operators.metadata import SITE
from paperloom.operators.scoring import risk_level

#: Characters of a text and matches of a query that a report shows.
SHOWN, SHOWN_MATCHES = 1200, 50


def write_jsonl(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def write_parts(df: DataFrame, path: str, rows: int = 5000, mode: str = "append") -> None:
    """Parquet files of at most so many rows; names are unique, so appended parts go on where earlier ones end."""
    df.write.mode(mode).option("maxRecordsPerFile", rows).parquet(path)


def write_partitioned(df: DataFrame, path: str, by: list[str], mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*by).parquet(path)


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int, mode: str = "overwrite") -> None:
    """A table whose joins on key need no shuffle."""
    df.write.mode(mode).bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def index_description(signatures: DataFrame) -> DataFrame:
    """One row with what a signature index was built with."""
    fixed = [F.lit(K.PERMUTATIONS).alias("num_perm"), F.lit(K.LSH_THRESHOLD).alias("threshold"), F.lit(K.SHINGLE_WORDS).alias("shingle_k")]
    return signatures.agg(F.count("*").alias("n_papers")).select(F.to_json(F.struct(*fixed, "n_papers")).alias("config"))


def vector_index_description(vectors: DataFrame, vector: str, model: str, kind: str, sections: list[str]) -> DataFrame:
    """One row with what a vector index was built with: model, dimension, vectors, kind of index and sections; null vectors don't count."""
    facts = vectors.filter(F.col(vector).isNotNull()).agg(F.coalesce(F.max(F.size(vector)), F.lit(0)).alias("dim"), F.count("*").alias("n"))
    fixed = F.struct(F.lit(model).alias("model"), "dim", "n", F.lit(kind).alias("type"), F.array(*map(F.lit, sections)).alias("sections"))
    return facts.select(F.to_json(fixed).alias("config"))


def preview(df: DataFrame, most: int = 10, order: list[str] | None = None) -> list[dict]:
    """The first rows as dictionaries, in a given order or as they come; what a console shows."""
    return [r.asDict(recursive=True) for r in (df.orderBy(*order) if order else df).limit(most).collect()]


def truncated(text: Column, most: int = SHOWN) -> Column:
    """A text cut for display; '' for null."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit("...")))


def risk_class(level: Column) -> Column:
    return F.when(level.isin("Very High", "High"), "high").when(level == "Medium", "medium").otherwise("low")


def source_rows(sources: DataFrame) -> DataFrame:
    """sources (see source_contributions) with the risk of each, its class and the addresses of the paper."""
    bare = F.replace(F.replace("source_paper_id", F.lit("arxiv_"), F.lit("")), F.lit(".pdf"), F.lit(""))
    level = risk_level(F.col("contribution_percent"))
    return sources.withColumns({"risk_level": level, "risk_class": risk_class(level), "abs_url": F.concat(F.lit(f"{SITE}/abs/"), bare), "pdf_url": F.concat(F.lit(f"{SITE}/pdf/"), bare)})


def best_matches(matches: DataFrame, most: int | None = SHOWN_MATCHES) -> DataFrame:
    """matches with their rank by score within each query, the first most of them; equal scores rank by segments and paper."""
    order = Window.partitionBy("query_id").orderBy(F.desc("match_score"), "input_segment_id", "source_paper_id", "source_segment_id")
    ranked = matches.withColumn("match_rank", F.row_number().over(order))
    return ranked if most is None else ranked.filter(F.col("match_rank") <= most)


def reports(scores: DataFrame, sources: DataFrame, matches: DataFrame, facts: DataFrame | None = None, most_matches: int | None = SHOWN_MATCHES) -> DataFrame:
    """(query_id, report): for each query a JSON object with its scores, sources, matches, filter summary and facts.

    Sources come by contribution. A report lists its most_matches best matches
    and counts all; the table of matches itself has every one (with None the
    report has too, and grows with them). facts(query_id, ...) are what is
    known of the query beside (see pipeline.facts). Queries without matches
    have empty lists and counts of 0.
    """
    source = F.struct("rank", "source_paper_id", "source_title", "matched_words", "contribution_percent", "risk_level", "abs_url", "pdf_url")
    by_source = source_rows(sources).groupBy("query_id").agg(F.array_sort(F.collect_list(source)).alias("top_sources"))
    match = F.struct(
        "match_rank", "input_segment_id", "source_paper_id", "source_segment_id", "match_type", "match_score", "ngram_overlap", "fuzzy_ratio", "input_start", "input_end", "word_count",
        "input_text", "source_text", "source_title", "source_cited", "inline_cited", "quoted", "validity", "exclusion_reasons", "risk_modifier",
    )
    shown = best_matches(matches, most_matches).groupBy("query_id").agg(F.array_sort(F.collect_list(match)).alias("matches"))
    out = F.col("excluded")
    counted = matches.groupBy("query_id").agg(
        F.count("*").alias("match_count"),
        F.struct(
            F.count("*").alias("total_matches"), F.count_if(~out).alias("valid_matches"), F.count_if(out).alias("excluded_matches"),
            F.struct(*[F.count_if(F.array_contains("exclusion_reasons", r)).alias(r) for r in P.EXCLUSION_REASONS]).alias("exclusion_reason_counts"),
        ).alias("filter_summary"),
        F.struct(
            F.coalesce(F.sum(F.when(~out, F.col("word_count"))), F.lit(0)).alias("valid_match_words_raw"), F.coalesce(F.sum(F.when(out, F.col("word_count"))), F.lit(0)).alias("excluded_match_words_raw")
        ).alias("filter_word_summary"),
    )
    whole = scores if facts is None else scores.join(facts, "query_id", "left")
    whole = whole.join(by_source, "query_id", "left").join(shown, "query_id", "left").join(counted, "query_id", "left").withColumn("match_count", F.coalesce("match_count", F.lit(0)))
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(whole.schema[c].dataType)).alias(c)
    columns = [empty(c) if c in ("top_sources", "matches") else F.col(c) for c in whole.columns]
    return whole.select("query_id", F.to_json(F.struct(*columns)).alias("report"))


def _text(x) -> str:
    return html.escape(str(x if x is not None else ""))


def _cards(values: dict) -> str:
    return "<div class='cards'>" + "".join(f"<div class='card'><div>{_text(k)}</div><b>{_text(v)}</b></div>" for k, v in values.items()) + "</div>"


def _table(head: list[str], rows: list[list[str]], none: str) -> str:
    body = "".join("<tr>" + "".join(cells) + "</tr>" for cells in rows) or f"<tr><td colspan='{len(head)}'>{_text(none)}</td></tr>"
    return "<table><tr>" + "".join(f"<th>{_text(h)}</th>" for h in head) + f"</tr>{body}</table>"


def _cell(x) -> str:
    return f"<td>{_text(x)}</td>"


def _source_cells(s: dict) -> list[str]:
    level = s.get("risk_level") or ""
    links = " | ".join(f"<a href='{_text(s.get(key))}'>{name}</a>" for key, name in (("abs_url", "abstract"), ("pdf_url", "PDF")) if s.get(key))
    return [_cell(s.get("rank")), _cell(s.get("source_paper_id")), _cell(s.get("source_title")), f"<td class='{_RISK_CLASS.get(level, 'low')}'>{_text(level)}</td>", _cell(f"{s.get('contribution_percent') or 0:.2f} %"), _cell(s.get("matched_words")), f"<td>{links}</td>"]


_RISK_CLASS = {"Very High": "high", "High": "high", "Medium": "medium"}


def _short(text: str | None, most: int = SHOWN) -> str:
    text = text or ""
    return text if len(text) <= most else text[:most] + "..."


def render_html(report: dict, most_matches: int = SHOWN_MATCHES) -> str:
    """One query's report, already parsed, as a page: cards, sources, filter summary and the best matches.

    Where the report has no filter summary its numbers are counted from its
    matches. Every text is escaped.
    """
    level = report.get("risk_level") or ""
    matches = report.get("matches") or []
    is_out = lambda m: m.get("validity") == "EXCLUDED"
    summary = report.get("filter_summary") or {"total_matches": len(matches), "valid_matches": sum(not is_out(m) for m in matches), "excluded_matches": sum(map(is_out, matches))}
    words = report.get("filter_word_summary") or {
        "valid_match_words_raw": sum(m.get("word_count") or 0 for m in matches if not is_out(m)), "excluded_match_words_raw": sum(m.get("word_count") or 0 for m in matches if is_out(m))
    }
    reasons = summary.get("exclusion_reason_counts") or {r: n for r in P.EXCLUSION_REASONS if (n := sum(r in (m.get("exclusion_reasons") or []) for m in matches))}
    found = "".join(
        f"<section class='{_text((m.get('validity') or '').lower())}'><h3>{i}. {_text(m.get('match_type'))} {m.get('match_score') or 0:.3f}, {_text(m.get('source_paper_id'))} ({_text(m.get('validity'))})</h3>"
        f"<p>{_text(', '.join(m.get('exclusion_reasons') or []))}</p><p class='input'>{_text(_short(m.get('input_text')))}</p><p class='source'>{_text(_short(m.get('source_text')))}</p></section>"
        for i, m in enumerate(sorted(matches, key=lambda m: -(m.get("match_score") or 0))[:most_matches], 1)
    )
    return "".join(
        [
            f"<!doctype html><html><head><meta charset='utf-8'><title>Similarity report</title></head><body class='{_RISK_CLASS.get(level, 'low')}'><h1>Similarity report</h1>",
            _cards({
                "Similarity": f"{report.get('overall_similarity') or 0:.2f} %", "Risk": level, "Matched words": f"{report.get('matched_words') or 0}/{report.get('total_words') or 0}",
                "Candidates": report.get("candidate_count") or 0, "Matches": report.get("match_count", len(matches)),
            }),
            "<h2>Sources</h2>",
            _table(["Rank", "Paper", "Title", "Risk", "Contribution", "Matched words", "Links"], [_source_cells(s) for s in report.get("top_sources") or []], "No sources"),
            "<h2>Filters</h2>",
            _cards({"Matches": summary["total_matches"], "Valid": summary["valid_matches"], "Excluded": summary["excluded_matches"], "Words in excluded": words["excluded_match_words_raw"], "Words in valid": words["valid_match_words_raw"]}),
            _table(["Reason", "Matches"], [[_cell(r), _cell(n)] for r, n in reasons.items() if n], "None"),
            f"<h2>Matches</h2>{found}</body></html>",
        ]
    )
