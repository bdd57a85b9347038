"""Every query of the core, over whole tables, with its SQL equivalent where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom import constants as K
from paperloom.functions import patterns as P
from paperloom.functions import similarity as S
from paperloom.functions import text as X
from paperloom.functions.rx import SPACE, WORD, sql
from paperloom.operators import exclusion as E
from paperloom.operators import layers as L
from paperloom.operators import lsh, metadata, ml_lsh, scoring, vectors
from paperloom.operators.matching import any_like, containment_join, make_segments
from paperloom.plans import pipeline
from paperloom.session import cut_lineage, shared_folder, spread, table
from paperloom.sources import readers, writers
from paperloom.streaming import ingest

#: Searches take the rows with these ids as queries, against all rows.
QUERY_STEP = 50


def _is_query(key: str) -> F.Column:
    return F.pmod(F.col(key), F.lit(QUERY_STEP)) == 0


# ---- keys, joins, audits ----------------------------------------------------


def meta_ids(spark: SparkSession, d: str) -> DataFrame:
    norm = metadata.pid_norm(F.col("doc_id"))
    return table(spark, d, "arxiv_metadata_sample").select(
        "doc_id", metadata.base_id(F.col("doc_id")).alias("base_id"), norm.alias("pid_norm"), metadata.pid_prefix(norm).alias("pid_prefix"),
        F.sha2("source_url", 256).alias("url_sha256"), F.md5("source_url").alias("url_md5"), F.size("authors").alias("n_authors"), F.array_join("categories", " ").alias("categories"),
    )


def file_keys(spark: SparkSession, d: str) -> DataFrame:
    path = F.col("file_path")
    return table(spark, d, "arxiv_text_parquet").select("file_path", metadata.basename(path).alias("paper_id"), metadata.join_key(path).alias("join_key"))


def word_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "arxiv_text_parquet").select("file_path", X.word_count(F.col("text")).alias("n_words"), (X.word_count(F.col("text")) > 10).alias("kept"))


def silver_plus_audit(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned papers joined with texts and metadata, and the nulls that leaves."""
    cleaned = table(spark, d, "arxiv_silver_plus").select("file_path", "clean_text", "word_count_raw", "word_count_clean", "quality_flag")
    joined = metadata.join_silver_plus(cleaned, table(spark, d, "arxiv_text_parquet"), table(spark, d, "arxiv_metadata_sample"))
    return metadata.null_audit(joined, ["raw_text", "clean_text", "title", "abstract", "authors"])


def quality_histogram(spark: SparkSession, d: str) -> DataFrame:
    return metadata.quality_histogram(table(spark, d, "arxiv_silver_plus"))


def status_tally(spark: SparkSession, d: str) -> DataFrame:
    return readers.status_tally(table(spark, d, "events"), "event_type")


# ---- cleaners, step by step -------------------------------------------------


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "arxiv_text_parquet").select("file_path", "text"))


def offline_front_matter(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("file_path", X.drop_front_matter(F.col("text")).alias("text"))


def offline_references(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("file_path", X.references_at(F.col("text")).alias("kept_chars"))


def offline_page_numbers(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("file_path", X.ligatures(X.replace_all(F.col("text"), P.OFFLINE_PAGES)).alias("text"))


def offline_tail(spark: SparkSession, d: str) -> DataFrame:
    joined = F.regexp_replace(F.regexp_replace("text", P.CONTROL, ""), f"([{WORD}])-\\n([{WORD}])", "$1$2")
    return _pages(spark, d).select("file_path", X.strip(X.replace_all(joined, P.OFFLINE_TAIL)).alias("text"))


def online_front(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("file_path", X.online_front(F.col("text")).alias("text"))


def online_references(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("file_path", X.online_references_at(F.col("text")).alias("kept_chars"))


def online_tail(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("file_path", X.strip(X.replace_all(X.replace_all(F.col("text"), P.ONLINE_PAGES), P.ONLINE_TAIL)).alias("text"))


def clean_offline(spark: SparkSession, d: str) -> DataFrame:
    return ingest.clean_texts(spread(table(spark, d, "arxiv_text_parquet")))


def clean_online(spark: SparkSession, d: str) -> DataFrame:
    return X.clean_online(_pages(spark, d), "text").select("file_path", "cleaned.*")


# ---- sections, segments, chunks ---------------------------------------------


def _papers(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return spread(table(spark, d, "arxiv_silver_plus").select("paper_id", *columns))


def sections_offline(spark: SparkSession, d: str) -> DataFrame:
    return _papers(spark, d, "clean_text").select("paper_id", X.sections_offline(F.col("clean_text")).alias("s")).select("paper_id", "s.*")


def sections_online(spark: SparkSession, d: str) -> DataFrame:
    return _papers(spark, d, "clean_text").select("paper_id", X.sections_online(F.col("clean_text")).alias("s")).select("paper_id", "s.*")


def segments(spark: SparkSession, d: str) -> DataFrame:
    made = make_segments(_papers(spark, d, "introduction", "body"), "paper_id", [("introduction", "introduction"), ("body", "body")], carry=["introduction", "body"])
    whole = F.when(F.col("section") == "introduction", F.col("introduction")).otherwise(F.col("body"))
    placed = F.substring(whole, F.col("start_char") + 1, F.col("end_char") - F.col("start_char")) == F.col("text")
    return made.select("paper_id", "section", "segment_id", "text", "word_count", "is_quote", "near_citation", (F.col("end_char") - F.col("start_char")).alias("n_chars"), placed.alias("placed"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.chunk_table(_papers(spark, d, "abstract", "introduction", "body"))


def chunks_by_section(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).groupBy("section").agg(F.count("*").alias("n"))


# ---- signatures and index ---------------------------------------------------


def _signed(spark: SparkSession, d: str) -> DataFrame:
    """Signatures of the documents, made once and kept: every plan reads them more than once."""
    return cut_lineage(lsh.sign(table(spark, d, "documents"), "doc_id", "text"))


def shingle_counts(spark: SparkSession, d: str) -> DataFrame:
    return _papers(spark, d, "clean_text").select("paper_id", F.size(S.shingles(F.col("clean_text"))).alias("n_shingles")).filter("n_shingles > 0")


def minhash_signatures(spark: SparkSession, d: str) -> DataFrame:
    return lsh.sign(table(spark, d, "documents"), "doc_id", "text").select("doc_id", F.array_join(F.col("signature").cast("array<string>"), " ").alias("signature"))


def lsh_bucket_sizes(spark: SparkSession, d: str) -> DataFrame:
    """For each band the number of buckets and the size of the largest."""
    sizes = lsh.bucket_table(_signed(spark, d), "doc_id").groupBy("band", "bucket").agg(F.count("*").alias("n"))
    return sizes.groupBy("band").agg(F.count("*").alias("buckets"), F.max("n").alias("largest"))


def near_dup_levels(spark: SparkSession, d: str) -> DataFrame:
    return lsh.near_duplicate_pairs(_signed(spark, d), "doc_id")


def near_dup_classes(spark: SparkSession, d: str) -> DataFrame:
    """Stored signatures of papers: each paper with its number of links to other classes."""
    stored = table(spark, d, "minhash_signatures")
    return lsh.near_duplicate_classes(stored, "paper_id").groupBy("paper_id").agg(F.max("n_links").alias("n_links"), F.count_distinct("class_id").alias("n_classes"))


def stored_pair_levels(spark: SparkSession, d: str) -> DataFrame:
    pairs = lsh.different_papers(lsh.near_duplicate_pairs(table(spark, d, "minhash_signatures"), "paper_id"))
    return pairs.groupBy("similarity_level").agg(F.count("*").alias("n"))


def lsh_probe_topk(spark: SparkSession, d: str) -> DataFrame:
    signed = _signed(spark, d)
    return lsh.probe(signed.filter(_is_query("doc_id")), signed, "doc_id")


def ml_lsh_pairs(spark: SparkSession, d: str) -> DataFrame:
    return ml_lsh.ml_pairs(_papers(spark, d, "clean_text").dropDuplicates(["paper_id"]), "paper_id", "clean_text")


# ---- matching, rules, scores ------------------------------------------------


def equal_texts(spark: SparkSession, d: str) -> DataFrame:
    plain = table(spark, d, "documents").filter("text is not null").select("doc_id", F.md5(S.normalised(F.col("text"))).alias("text_md5"))
    return plain.groupBy("text_md5").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


def ngram_overlap(spark: SparkSession, d: str) -> DataFrame:
    documents = spread(table(spark, d, "documents").select("doc_id", "text"))
    return containment_join(documents.filter(_is_query("doc_id")), documents, "doc_id", "text")


def chunk_flags(spark: SparkSession, d: str) -> DataFrame:
    """Citation and exclusion rules on every chunk."""
    t = F.col("chunk_text")
    words = X.word_count(t)
    return spread(table(spark, d, "chunks_sample").select("paper_id", "chunk_id", "section", "chunk_text")).select(
        "paper_id", "chunk_id", E.has_inline_citation(t).alias("inline_citation"), any_like(t, P.SEGMENT_CITATIONS).alias("segment_citation"), E.is_reference_like(t).alias("reference_like"),
        E.is_boilerplate(t).alias("boilerplate"), E.is_quote(t).alias("is_quote"), E.is_short_formula(t, words).alias("short_formula"), E.is_reference_section(F.col("section")).alias("reference_section"),
    )


def character_ratios(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("chunk_text")
    return table(spark, d, "chunks_sample").filter("chunk_text is not null").select("paper_id", "chunk_id", E.letter_ratio(t).alias("letter_ratio"), E.symbol_ratio(t).alias("symbol_ratio"))


def interval_union(spark: SparkSession, d: str) -> DataFrame:
    """Unions of the time spans in which each supplier's items were under way."""
    day = lambda c: F.unix_date(F.to_date(c))
    spans = table(spark, d, "lineitem").select("l_suppkey", day("l_shipdate").alias("start"), (day("l_shipdate") + F.col("l_linenumber").cast("int")).alias("end"))
    return scoring.merge_intervals(spans, ["l_suppkey"])


def _layer_values(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return table(spark, d, "lineitem").select(
        (c("l_discount").cast("double") * 8).alias("l1"), (c("l_tax").cast("double") * 9).alias("l2"), (F.pmod(c("l_partkey"), F.lit(100)) / 100).alias("l3"),
        (F.pmod(c("l_suppkey"), F.lit(10)) / 10).alias("l4"), (F.pmod(c("l_orderkey"), F.lit(20)) / 20).alias("l5"),
    )


def verdict_counts(spark: SparkSession, d: str) -> DataFrame:
    """The verdict rules over every row of a table of layer values."""
    made = _layer_values(spark, d).withColumns(L.verdict_columns(*(F.col(f"l{i}") for i in range(1, 6))))
    made = made.withColumn("risk_level", scoring.risk_level(F.col("l3") * 100))
    return made.groupBy("verdict", "confidence", "self_overlap", "risk_level").agg(F.count("*").alias("n"))


def concept_parts(spark: SparkSession, d: str) -> DataFrame:
    """Keyword, cue-phrase and percentage likeness of each document and the abstract of its paper."""
    abstracts = table(spark, d, "arxiv_silver_plus").filter("abstract is not null").groupBy("paper_id").agg(F.min("abstract").alias("abstract"))
    both = spread(table(spark, d, "documents").filter("text is not null").select("doc_id", "paper_id", "text")).join(abstracts, "paper_id")
    a, b = F.col("text"), F.col("abstract")
    return both.select(
        "doc_id", S.jaccard(S.keywords(a), S.keywords(b)).alias("keyword_share"), S.jaccard(S.cue_phrases(a), S.cue_phrases(b)).alias("cue_share"), S.jaccard(S.percent_numbers(a), S.percent_numbers(b)).alias("number_share")
    )


def knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    vecs = table(spark, d, "embeddings")
    return vectors.nearest(vecs.filter(_is_query("vec_id")), vecs, "vec_id", "embedding").select("query_id", "vec_id", "rank", F.round("cosine", 6).alias("cosine"))


def index_positions(spark: SparkSession, d: str) -> DataFrame:
    """Places of the chunks in an index ordered by paper and chunk."""
    rows = table(spark, d, "chunks_sample").filter("length(chunk_text) > 20").select("paper_id", "chunk_id")
    return vectors.index_positions(rows, ["paper_id", "chunk_id"])


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, raw_text): page texts of later versions of papers, one for each."""
    rows = table(spark, d, "arxiv_silver_plus").filter(F.col("paper_id").rlike(r"v[0-9]+\.pdf\z") & F.col("raw_text").isNotNull())
    return rows.groupBy(F.col("paper_id").alias("query_id")).agg(F.min("raw_text").alias("raw_text"))


def _check(spark: SparkSession, d: str) -> pipeline.Check:
    """Later versions of papers held against all papers, with their titles and sections."""
    papers = table(spark, d, "arxiv_silver_plus").select("paper_id", "title", "abstract", "introduction", "body", "clean_text")
    signatures = cut_lineage(pipeline.index_signatures(papers.dropDuplicates(["paper_id"])))
    return pipeline.check(_asked(spark, d), signatures, papers)


def check_matches(spark: SparkSession, d: str) -> DataFrame:
    return _check(spark, d).matches.drop("input_text", "source_text")


def check_scores(spark: SparkSession, d: str) -> DataFrame:
    return _check(spark, d).scores


def check_summary(spark: SparkSession, d: str) -> DataFrame:
    return E.exclusion_summary(_check(spark, d).matches, ["query_id"])


def report_json(spark: SparkSession, d: str) -> DataFrame:
    made = _check(spark, d)
    return writers.reports(made.scores, made.sources, made.matches, pipeline.facts(_asked(spark, d), made))


def layer_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of query documents against all papers; a document's vector stands for its paper."""
    documents, vecs = table(spark, d, "documents"), table(spark, d, "embeddings")
    own = documents.filter(_is_query("doc_id") & F.col("text").isNotNull())
    queries = own.select("doc_id", F.col("doc_id").alias("query_id"), F.col("text").alias("clean_text"), X.query_title(F.col("text")).alias("title"), X.extract_abstract(F.col("text")).alias("abstract"), "paper_id")
    papers = table(spark, d, "arxiv_silver_plus").select("paper_id", "title", "abstract", "introduction", "body", "authors", "clean_text").dropDuplicates(["paper_id"])
    queries = queries.join(papers.select("paper_id", "authors"), "paper_id", "left").drop("paper_id", "doc_id")
    near = vectors.nearest(vecs.filter(_is_query("vec_id")), vecs, "vec_id", "embedding")
    neighbours = near.join(documents.select(F.col("doc_id").alias("vec_id"), F.col("paper_id").alias("pid")), "vec_id").filter("pid is not null").select("query_id", "pid", "cosine")
    return pipeline.verdict(queries, pipeline.index_signatures(papers), papers, neighbours)


def incremental_ingest(spark: SparkSession, d: str) -> DataFrame:
    """All page texts taken up by the file stream, each file once: cleaned (without NFKC, which SQL lacks), signed, entered into the buckets."""
    target = shared_folder(spark, "ingest")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/arxiv_text_parquet.parquet")
    single = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile()
    source, pattern = (d, path.getName()) if single else (str(path), None)
    ingest.ingest(spark, source, target, f"{target}/checkpoint", pattern=pattern, compose=False)
    cleaned = spark.read.parquet(f"{target}/cleaned").dropDuplicates(["file_path"])
    n = spark.read.parquet(f"{target}/buckets").groupBy("paper_id").agg(F.count_distinct("band").alias("bands"))
    return cleaned.join(n, "paper_id", "left").select("file_path", "word_count_raw", "word_count_clean", "quality_flag", F.md5("clean_text").alias("clean_md5"), F.coalesce("bands", F.lit(0)).alias("bands"))


# ---- SQL --------------------------------------------------------------------

_W = f"[^{SPACE}]+"


def _words(t: str) -> str:
    return f"coalesce(len(regexp_extract_all({t}, '{_W}')), 0)"


def _strip(t: str) -> str:
    return f"regexp_replace({t}, '^[{SPACE}]+|[{SPACE}]+\\z', '', 'g')"


def _steps(t: str, steps) -> str:
    for pattern, by in steps:
        by = by.replace("\n", "' || chr(10) || '")
        t = f"regexp_replace({t}, {sql(pattern)}, '{by}', 'g')"
    return t


def _at(t: str, pattern: str) -> str:
    """Position of the first match, 0 without one: where a mark put in its place stands."""
    return f"strpos(regexp_replace({t}, {sql(pattern)}, chr(1)), chr(1))"


def _like(t: str, patterns) -> str:
    return "coalesce(" + " OR ".join(f"regexp_matches({t}, {sql(p)})" for p in patterns) + ", false)"


def _shingles(t: str) -> str:
    words = f"regexp_extract_all(lower({t}), '[{WORD}]{{2,}}')"
    return f"(SELECT CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) ELSE [] END FROM (SELECT {words} AS w))"


def signature_sql(rows: str) -> str:
    """CTE sig(id, signature) of rows(id, t)."""
    a, b = K.permutation_parameters()
    part = lambda i: f"('0x' || substr(m, {8 * i + 1}, 8))::BIGINT"
    return f"""
      params AS (SELECT unnest(range(1, {K.PERMUTATIONS + 1})) AS i, unnest({a}::BIGINT[]) AS a, unnest({b}::BIGINT[]) AS b),
      shingled AS (SELECT id, unnest({_shingles('t')}) AS s FROM ({rows})),
      hashed AS (SELECT DISTINCT id, (8 * {part(0)} + 4 * {part(1)} + 2 * {part(2)} + {part(3)}) % {K.PRIME} AS h FROM (SELECT id, md5(s) AS m FROM shingled)),
      minima AS (SELECT id, i, min((a * h + b) % {K.PRIME}) AS v FROM hashed, params GROUP BY id, i),
      sig AS (SELECT id, list(v ORDER BY i) AS signature FROM minima GROUP BY id)"""


_DOCUMENTS = "SELECT doc_id AS id, text AS t FROM documents WHERE text IS NOT NULL AND length(text) > 200"


def _pairs_sql() -> str:
    """CTEs from sig to pairs(id_a, id_b, jaccard_similarity) of representatives and copies."""
    agree = f"len(list_filter(range(1, {K.PERMUTATIONS + 1}), lambda i: x.signature[i] = y.signature[i])) / {K.PERMUTATIONS}"
    return f"""
      heads AS (SELECT signature, min(id) AS head FROM sig GROUP BY signature),
      bands AS (SELECT head, signature, unnest(range(0, {K.BANDS})) AS band FROM heads),
      keyed AS (SELECT head, band, signature[band * {K.BAND_ROWS} + 1 : band * {K.BAND_ROWS} + {K.BAND_ROWS}] AS k FROM bands),
      mates AS (SELECT DISTINCT p.head AS a, q.head AS b FROM keyed p JOIN keyed q ON p.band = q.band AND p.k = q.k AND p.head < q.head),
      linked AS (SELECT a AS id_a, b AS id_b, {agree} AS jaccard_similarity FROM mates JOIN heads x ON x.head = a JOIN heads y ON y.head = b),
      pairs AS (SELECT * FROM linked WHERE jaccard_similarity >= {K.LSH_THRESHOLD}
        UNION ALL SELECT DISTINCT h.head, s.id, 1.0::DOUBLE FROM sig s JOIN heads h ON s.signature = h.signature WHERE s.id <> h.head)"""


def _chunk_sql() -> str:
    parts = []
    for n, name in enumerate(("abstract", "introduction", "body")):
        t = _strip(f"coalesce({name}, '')")
        split = f"list_filter(list_transform(string_split(regexp_replace(t, '([.!?])[{SPACE}]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {_strip('s')}), lambda s: length(s) >= 20)"
        parts.append(
            f"""SELECT r, paper_id, {n} AS part, '{name}' AS section, g, array_to_string(ss[g * 4 + 1 : g * 4 + 4], ' ') AS chunk_text
            FROM (SELECT r, paper_id, ss, unnest(range(0, ceil(len(ss) / 4)::BIGINT)) AS g FROM (SELECT r, paper_id, {split} AS ss FROM (SELECT r, paper_id, {t} AS t FROM rows) WHERE length(t) >= 50))"""
        )
    return f"""WITH rows AS (SELECT row_number() OVER () AS r, paper_id, abstract, introduction, body FROM arxiv_silver_plus),
      made AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE length(chunk_text) >= 50),
      chunks AS (SELECT paper_id, (row_number() OVER (PARTITION BY r ORDER BY part, g) - 1)::INTEGER AS chunk_id, section, chunk_text FROM made)"""


def _segment_sql() -> str:
    paragraph = f"list_filter(list_transform(regexp_split_to_array(t, {sql(chr(92) + 'n' + chr(92) + 's*' + chr(92) + 'n')}), lambda p: {_strip('p')}), lambda p: p <> '')"
    parts = [
        f"SELECT paper_id, '{name}' AS section, '{name}_seg_' || (i - 1) AS segment_id, ps[i] AS text FROM (SELECT paper_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT paper_id, {paragraph} AS ps FROM (SELECT paper_id, {name} AS t FROM arxiv_silver_plus WHERE {name} IS NOT NULL)))"
        for name in ("introduction", "body")
    ]
    plain = _strip("text")
    quote = f"(({plain} LIKE '\"%' AND {plain} LIKE '%\"') OR ({plain} LIKE '''%' AND {plain} LIKE '%'''))"
    return f"""SELECT paper_id, section, segment_id, text, {_words('text')}::INTEGER AS word_count, {quote} AS is_quote, {_like('text', P.SEGMENT_CITATIONS)} AS near_citation, length(text)::INTEGER AS n_chars, true AS placed
      FROM ({' UNION ALL '.join(parts)}) WHERE {_words('text')} >= {K.MIN_SEGMENT_WORDS}"""


def _offline_sections_sql() -> str:
    return f"""WITH a AS (SELECT paper_id, coalesce(clean_text, '') AS t FROM arxiv_silver_plus),
      b AS (SELECT paper_id, t, {_at('t', P.OFFLINE_INTRODUCTION)} AS pos, length(regexp_extract(t, {sql(P.OFFLINE_INTRODUCTION)}, 0)) AS n FROM a),
      c AS (SELECT *, substr(t, pos + n) AS tail FROM b),
      e AS (SELECT *, {_at('tail', P.OFFLINE_NEXT)} AS after FROM c)
      SELECT paper_id, {_strip("CASE WHEN pos = 0 THEN '' WHEN after > 0 THEN substr(tail, 1, after - 1) ELSE tail END")} AS introduction,
        {_strip("CASE WHEN pos = 0 THEN t WHEN after > 0 THEN substr(tail, after) ELSE '' END")} AS body FROM e"""


def _online_sections_sql() -> str:
    return f"""WITH a AS (SELECT paper_id, coalesce(clean_text, '') AS t FROM arxiv_silver_plus),
      b AS (SELECT paper_id, t, {_at('t', P.ONLINE_INTRODUCTION)} AS pos, length(regexp_extract(t, {sql(P.ONLINE_INTRODUCTION)}, 0)) AS n FROM a),
      c AS (SELECT *, substr(t, pos + n) AS tail FROM b),
      e AS (SELECT *, {_at('tail', P.ONLINE_NEXT)} AS after FROM c),
      f AS (SELECT paper_id, t, {_strip("CASE WHEN pos = 0 THEN '' WHEN after > 0 THEN substr(tail, 1, after - 1) ELSE substr(tail, 1, 6000) END")} AS introduction FROM e)
      SELECT paper_id, introduction, CASE WHEN introduction = '' THEN t ELSE {_strip("substr(t, 1, strpos(t, introduction) - 1) || ' ' || substr(t, strpos(t, introduction) + length(introduction))")} END AS body FROM f"""


def _jaccard_sql(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) ELSE 0.0 END"


def _verdict_sql() -> str:
    return """WITH v AS (SELECT l_discount::DOUBLE * 8 AS l1, l_tax::DOUBLE * 9 AS l2, (l_partkey % 100) / 100 AS l3, (l_suppkey % 10) / 10 AS l4, (l_orderkey % 20) / 20 AS l5 FROM lineitem),
      s AS (SELECT *, CASE WHEN l1 < 0.05 THEN 0.35::DOUBLE * l2 + 0.45::DOUBLE * l3 + 0.10::DOUBLE * l4 + 0.10::DOUBLE * l5 ELSE 0.40::DOUBLE * l1 + 0.25::DOUBLE * l2 + 0.25::DOUBLE * l3 + 0.10::DOUBLE * l4 END
        * CASE WHEN l1 > 0.3 THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN l2 > 0.5 THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END AS f FROM v),
      c AS (SELECT *, least(f, 1.0) AS score, CASE WHEN l1 > 0.15 OR l2 > 0.25 THEN 'HIGH' WHEN l3 > 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM s)
      SELECT CASE WHEN score > 0.65 AND confidence <> 'LOW' THEN 'PLAGIARISM' WHEN score > 0.50 THEN 'HIGHLY SUSPICIOUS' WHEN score > 0.35 THEN 'SUSPICIOUS' WHEN score > 0.20 THEN 'SIMILAR' ELSE 'CLEAN' END AS verdict,
        confidence, l5 > 0.5 AS self_overlap, CASE WHEN l3 * 100 < 10 THEN 'Low' WHEN l3 * 100 < 25 THEN 'Medium' WHEN l3 * 100 < 40 THEN 'High' ELSE 'Very High' END AS risk_level, count(*) AS n
      FROM c GROUP BY ALL"""


def _flags_sql() -> str:
    t = "coalesce(chunk_text, '')"
    s = _strip(t)
    quote = " OR ".join(f"({s} LIKE '{a.replace(chr(39), chr(39) * 2)}%' AND {s} LIKE '%{b.replace(chr(39), chr(39) * 2)}')" for a, b in P.QUOTES)
    symbols, letters = f"len(regexp_extract_all({t}, '[^\\p{{L}}\\p{{N}}{SPACE}]'))", f"len(regexp_extract_all({t}, '\\p{{L}}'))"
    formula = f"length({t}) > 0 AND {_words(t)} <= {P.SYMBOL_WORDS} AND {symbols} / length({t}) >= {P.SYMBOL_RATIO}::DOUBLE AND {letters} / length({t}) < {P.ALPHA_RATIO}::DOUBLE"
    section = " OR ".join(f"contains(lower(coalesce(section, '')), '{k}')" for k in P.REFERENCE_SECTIONS)
    return f"""SELECT paper_id, chunk_id, {_like(t, P.INLINE_CITATIONS)} AS inline_citation, {_like(t, P.SEGMENT_CITATIONS)} AS segment_citation, {_like(s, P.REFERENCE_LIKE)} AS reference_like,
      {_like(f'lower({t})', P.BOILERPLATE)} AS boilerplate, (length({s}) >= 2 AND ({quote})) AS is_quote, coalesce({formula}, false) AS short_formula, ({section}) AS reference_section FROM chunks_sample"""


def queries() -> dict:
    made = (
        meta_ids, file_keys, word_counts, silver_plus_audit, quality_histogram, status_tally,
        offline_front_matter, offline_references, offline_page_numbers, offline_tail, online_front, online_references, online_tail, clean_offline, clean_online,
        sections_offline, sections_online, segments, chunks, chunks_by_section,
        shingle_counts, minhash_signatures, lsh_bucket_sizes, near_dup_levels, near_dup_classes, stored_pair_levels, lsh_probe_topk, ml_lsh_pairs,
        equal_texts, ngram_overlap, chunk_flags, character_ratios, interval_union, verdict_counts, concept_parts, knn_cosine, index_positions,
        check_matches, check_scores, check_summary, report_json, layer_verdicts, incremental_ingest,
    )
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    norm = f"{_strip('replace(replace(' + _strip('lower(doc_id)') + ', ' + chr(39) + 'arxiv_' + chr(39) + ', ' + chr(39) * 2 + '), ' + chr(39) + '.pdf' + chr(39) + ', ' + chr(39) * 2 + ')')}"
    text = "FROM arxiv_text_parquet"
    ligated = _steps("text", P.OFFLINE_PAGES)
    for sign, letters in P.LIGATURES.items():
        ligated = f"replace({ligated}, '{sign}', '{letters}')"
    rejoined = f"regexp_replace(regexp_replace(text, '{P.CONTROL}', '', 'g'), {sql(P.HYPHEN)}, '\\1\\2', 'g')"
    low, strict = "floor(length(text) * 0.60::DOUBLE)::BIGINT", "floor(length(text) * 0.75::DOUBLE)::BIGINT"
    heading, listed = _at(f"substr(text, {low} + 1)", P.OFFLINE_REFERENCES), _at(f"substr(text, {strict} + 1)", P.OFFLINE_REFERENCE_LIST)
    half = "floor(length(text) * 0.55::DOUBLE)::BIGINT"
    marks = ", ".join(f"nullif(strpos(substr(lower(text), {half} + 1), '{m}'), 0)" for m in P.ONLINE_MARKERS)
    stored = f"sig AS (SELECT DISTINCT paper_id AS id, signature FROM minhash_signatures WHERE len(signature) = {K.PERMUTATIONS})"
    base = lambda c: f"nullif(regexp_replace(replace(replace({c}, 'arxiv_', ''), '.pdf', ''), 'v[0-9]+\\z', ''), '')"
    band = f"signature[band * {K.BAND_ROWS} + 1 : band * {K.BAND_ROWS} + {K.BAND_ROWS}]"
    keyword = lambda t: f"list_distinct(list_filter(regexp_extract_all(lower({t}), '[{WORD}]+'), lambda x: regexp_full_match(x, '[a-z]{{4,}}')))"
    cues = lambda t: "list_filter([" + ", ".join(f"CASE WHEN contains(lower({t}), '{c}') THEN '{c}' END" for c in P.CUES) + "], lambda x: x IS NOT NULL)"
    percent = lambda t: f"list_distinct(regexp_extract_all({t}, {sql(P.PERCENT)}, 1))"
    query = f"doc_id % {QUERY_STEP} = 0"
    return {
        "meta_ids": f"SELECT doc_id, {base('doc_id')} AS base_id, {norm} AS pid_norm, CASE WHEN length({norm}) >= 4 THEN substr({norm}, 1, 4) END AS pid_prefix, sha256(source_url) AS url_sha256, md5(source_url) AS url_md5, len(authors)::INTEGER AS n_authors, array_to_string(categories, ' ') AS categories FROM arxiv_metadata_sample",
        "file_keys": f"SELECT file_path, regexp_extract(file_path, '[^/]*$', 0) AS paper_id, regexp_replace(regexp_extract(file_path, '(arxiv_[^/]+)\\.pdf\\z', 1), 'v[0-9]+\\z', '') AS join_key {text}",
        "word_counts": f"SELECT file_path, {_words('text')}::INTEGER AS n_words, {_words('text')} > 10 AS kept {text}",
        "silver_plus_audit": """WITH c AS (SELECT file_path, clean_text, regexp_replace(regexp_extract(file_path, '(arxiv_[^/]+)\\.pdf\\z', 1), 'v[0-9]+\\z', '') AS k FROM arxiv_silver_plus),
            j AS (SELECT t.text AS raw_text, clean_text, m.title, m.abstract, m.authors FROM c LEFT JOIN arxiv_text_parquet t ON c.file_path = t.file_path LEFT JOIN arxiv_metadata_sample m ON c.k = m.doc_id)
            SELECT count(*) AS n_rows, count_if(raw_text IS NULL)::BIGINT AS null_raw_text, count_if(clean_text IS NULL)::BIGINT AS null_clean_text, count_if(title IS NULL)::BIGINT AS null_title, count_if(abstract IS NULL)::BIGINT AS null_abstract, count_if(authors IS NULL)::BIGINT AS null_authors FROM j""",
        "quality_histogram": "SELECT quality_flag, count(*) AS n FROM arxiv_silver_plus GROUP BY quality_flag",
        "status_tally": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
        "offline_front_matter": f"SELECT file_path, {_steps('text', [(P.OFFLINE_HEADER, ''), (P.OFFLINE_STAMP, ''), (P.OFFLINE_PUBLISHER, ''), (P.OFFLINE_REPORT, '')])} AS text {text}",
        "offline_references": f"SELECT file_path, CASE WHEN {heading} > 0 THEN {low} + {heading} - 1 WHEN {listed} > 0 THEN {strict} + {listed} - 1 END::INTEGER AS kept_chars {text}",
        "offline_page_numbers": f"SELECT file_path, {ligated} AS text {text}",
        "offline_tail": f"SELECT file_path, {_strip(_steps(rejoined, P.OFFLINE_TAIL))} AS text {text}",
        "online_front": f"SELECT file_path, {_steps('text', [(P.ONLINE_HEADER, ' '), *((p, ' ') for p in P.ONLINE_JOURNAL)])} AS text {text}",
        "online_references": f"SELECT file_path, ({half} + least({marks}) - 1)::INTEGER AS kept_chars {text}",
        "online_tail": f"SELECT file_path, {_strip(_steps(_steps('text', P.ONLINE_PAGES), P.ONLINE_TAIL))} AS text {text}",
        "sections_offline": _offline_sections_sql(),
        "sections_online": _online_sections_sql(),
        "segments": _segment_sql(),
        "chunks": _chunk_sql() + " SELECT *, paper_id || '_' || chunk_id AS chunk_uid FROM chunks",
        "chunks_by_section": _chunk_sql() + " SELECT section, count(*) AS n FROM chunks GROUP BY section",
        "shingle_counts": f"SELECT * FROM (SELECT paper_id, len({_shingles('clean_text')})::INTEGER AS n_shingles FROM arxiv_silver_plus WHERE clean_text IS NOT NULL) WHERE n_shingles > 0",
        "minhash_signatures": f"WITH {signature_sql(_DOCUMENTS)} SELECT id AS doc_id, array_to_string(signature, ' ') AS signature FROM sig",
        "lsh_bucket_sizes": f"WITH {signature_sql(_DOCUMENTS)}, b AS (SELECT band, {band} AS k, count(*) AS n FROM (SELECT signature, unnest(range(0, {K.BANDS})) AS band FROM sig) GROUP BY ALL) SELECT band::INTEGER AS band, count(*) AS buckets, max(n) AS largest FROM b GROUP BY band",
        "near_dup_levels": f"WITH {signature_sql(_DOCUMENTS)}, {_pairs_sql()} SELECT *, CASE WHEN jaccard_similarity >= {K.SIMILARITY_HIGH} THEN 'HIGH' ELSE 'MEDIUM' END AS similarity_level FROM pairs",
        "near_dup_classes": f"WITH {stored}, {_pairs_sql()}, ends AS (SELECT h, count(*) AS n FROM (SELECT id_a AS h FROM linked WHERE jaccard_similarity >= {K.LSH_THRESHOLD} UNION ALL SELECT id_b FROM linked WHERE jaccard_similarity >= {K.LSH_THRESHOLD}) GROUP BY h) SELECT s.id AS paper_id, max(coalesce(n, 0))::BIGINT AS n_links, count(DISTINCT h.head) AS n_classes FROM sig s JOIN heads h ON s.signature = h.signature LEFT JOIN ends ON ends.h = h.head GROUP BY s.id",
        "stored_pair_levels": f"WITH {stored}, {_pairs_sql()} SELECT CASE WHEN jaccard_similarity >= {K.SIMILARITY_HIGH} THEN 'HIGH' ELSE 'MEDIUM' END AS similarity_level, count(*) AS n FROM pairs WHERE {base('id_a')} <> {base('id_b')} GROUP BY ALL",
        "lsh_probe_topk": f"""WITH {signature_sql(_DOCUMENTS)}, keyed AS (SELECT id, band, {band} AS k FROM (SELECT id, signature, unnest(range(0, {K.BANDS})) AS band FROM sig)),
            mates AS (SELECT DISTINCT p.id AS query_id, q.id AS candidate FROM keyed p JOIN keyed q ON p.band = q.band AND p.k = q.k AND p.id <> q.id WHERE p.id % {QUERY_STEP} = 0),
            scored AS (SELECT query_id, candidate, len(list_filter(range(1, {K.PERMUTATIONS + 1}), lambda i: x.signature[i] = y.signature[i])) / {K.PERMUTATIONS} AS jaccard_similarity FROM mates JOIN sig x ON x.id = query_id JOIN sig y ON y.id = candidate)
            SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY jaccard_similarity DESC, candidate)::INTEGER AS rank FROM scored) WHERE rank <= {K.MAX_CANDIDATES}""",
        "equal_texts": f"SELECT md5(trim(regexp_replace(lower(text), '[{SPACE}]+', ' ', 'g'))) AS text_md5, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
        "ngram_overlap": f"""WITH s AS (SELECT doc_id, unnest({_shingles('text')}) AS s FROM documents WHERE text IS NOT NULL), q AS (SELECT * FROM s WHERE {query}), n AS (SELECT doc_id, count(*) AS n FROM q GROUP BY doc_id)
            SELECT q.doc_id AS query_id, s.doc_id AS source_id, count(*) AS shared, count(*) / n AS ngram_overlap FROM q JOIN s ON q.s = s.s AND q.doc_id <> s.doc_id JOIN n ON n.doc_id = q.doc_id GROUP BY q.doc_id, s.doc_id, n HAVING count(*) / n >= {K.NGRAM_THRESHOLD}::DOUBLE""",
        "chunk_flags": _flags_sql(),
        "character_ratios": f"SELECT paper_id, chunk_id, CASE WHEN length(chunk_text) > 0 THEN len(regexp_extract_all(chunk_text, '\\p{{L}}')) / length(chunk_text) ELSE 0.0 END AS letter_ratio, CASE WHEN length(chunk_text) > 0 THEN len(regexp_extract_all(chunk_text, '[^\\p{{L}}\\p{{N}}{SPACE}]')) / length(chunk_text) ELSE 0.0 END AS symbol_ratio FROM chunks_sample WHERE chunk_text IS NOT NULL",
        "interval_union": """WITH i AS (SELECT l_suppkey, (l_shipdate::DATE - DATE '1970-01-01')::INTEGER AS s, (l_shipdate::DATE - DATE '1970-01-01')::INTEGER + l_linenumber::INTEGER AS e FROM lineitem),
            m AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM i),
            g AS (SELECT *, sum(fresh) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
            SELECT l_suppkey, min(s) AS start, max(e) AS "end" FROM g GROUP BY l_suppkey, island""",
        "verdict_counts": _verdict_sql(),
        "concept_parts": f"""WITH a AS (SELECT paper_id, min(abstract) AS abstract FROM arxiv_silver_plus WHERE abstract IS NOT NULL GROUP BY paper_id),
            p AS (SELECT doc_id, {keyword('text')} AS ka, {keyword('abstract')} AS kb, {cues('text')} AS ca, {cues('abstract')} AS cb, {percent('text')} AS na, {percent('abstract')} AS nb FROM documents d JOIN a ON d.paper_id = a.paper_id WHERE text IS NOT NULL)
            SELECT doc_id, {_jaccard_sql('ka', 'kb')} AS keyword_share, {_jaccard_sql('ca', 'cb')} AS cue_share, {_jaccard_sql('na', 'nb')} AS number_share FROM p""",
        "knn_cosine": f"""WITH u AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
            p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) / q.n / c.n AS cosine FROM u q JOIN u c ON q.vec_id <> c.vec_id WHERE q.vec_id % {QUERY_STEP} = 0)
            SELECT query_id, vec_id, rank, round(cosine, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id)::INTEGER AS rank FROM p) WHERE rank <= 20""",
        "index_positions": "SELECT paper_id, chunk_id, row_number() OVER (ORDER BY paper_id NULLS FIRST, chunk_id NULLS FIRST) - 1 AS index_position FROM chunks_sample WHERE length(chunk_text) > 20",
    }
