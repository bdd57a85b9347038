"""Queries of the core on inputs derived from whole tables, each beside its SQL: scans, sinks, metadata, rules, scores and layers."""

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
from paperloom.operators.matching import any_like, find_matches, make_segments, quoted_segment
from paperloom.plans import catalogue as C
from paperloom.session import cut_lineage, shared_folder, spread, table
from paperloom.sources import readers, web, writers

_QUERY_STEP = C.QUERY_STEP


def _is_query(paper_id: str = "paper_id") -> F.Column:
    """Later versions of papers: the queries of searches over papers, against all of them."""
    return F.col(paper_id).rlike(r"v[0-9]+\.pdf\z")


def _base_sql(c: str) -> str:
    return f"regexp_replace(replace(replace({c}, 'arxiv_', ''), '.pdf', ''), 'v[0-9]+\\z', '')"


def _is_query_sql(c: str = "paper_id") -> str:
    return f"regexp_matches({c}, 'v[0-9]+\\.pdf\\z')"


def _papers(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """One row for each paper: the least value of each column."""
    rows = table(spark, d, "arxiv_silver_plus").groupBy("paper_id")
    return rows.agg(*[F.min(c).alias(c) for c in columns])


def _papers_sql(*columns: str) -> str:
    return f"SELECT paper_id, {', '.join(f'min({c}) AS {c}' for c in columns)} FROM arxiv_silver_plus GROUP BY paper_id"


# ---- scans and sinks --------------------------------------------------------


def jsonl_dump(spark: SparkSession, d: str) -> DataFrame:
    """The metadata written as JSON lines in two dumps, and read again by a glob."""
    folder = shared_folder(spark, "dumps")
    rows = table(spark, d, "arxiv_metadata_sample").select("doc_id", "title", "scraped_at")
    writers.write_jsonl(rows, f"{folder}/a/dump")
    writers.write_jsonl(rows.filter("title is null"), f"{folder}/b/dump")
    return readers.read_jsonl(spark, f"{folder}/*/dump", rows.schema, ["doc_id", "scraped_at"])


JSONL_DUMP = "SELECT doc_id, scraped_at FROM arxiv_metadata_sample UNION ALL SELECT doc_id, scraped_at FROM arxiv_metadata_sample WHERE title IS NULL"

#: Lines 100 to 1999 of a dump.
FIRST_LINE, LAST_LINE = 100, 2000


def json_lines(spark: SparkSession, d: str) -> DataFrame:
    """A range of lines of a dump in the order of its rows."""
    folder = shared_folder(spark, "lines")
    order = ["doc_id", "scraped_at", "hash_sha256"]
    writers.write_jsonl(table(spark, d, "arxiv_metadata_sample").select(*order).orderBy(*order), folder)
    lines = readers.line_range(spark, folder, FIRST_LINE, LAST_LINE)
    return lines.select("line_no", F.get_json_object("value", "$.doc_id").alias("doc_id"))


JSON_LINES = f"SELECT * FROM (SELECT row_number() OVER (ORDER BY doc_id, scraped_at, hash_sha256) - 1 AS line_no, doc_id FROM arxiv_metadata_sample) WHERE line_no >= {FIRST_LINE} AND line_no < {LAST_LINE}"


def chunks_of_papers(spark: SparkSession, d: str) -> DataFrame:
    """Columns of the chunks of two sections, of papers of a list of any length."""
    ids = table(spark, d, "arxiv_silver_plus").filter("quality_flag = 'ok'").select("paper_id")
    return readers.read_parquet(spark, f"{d}/chunks_sample.parquet", ["paper_id", "chunk_id", "section"], ids, "paper_id", ["abstract", "introduction"])


CHUNKS_OF_PAPERS = "SELECT paper_id, chunk_id, section FROM chunks_sample WHERE section IN ('abstract', 'introduction') AND paper_id IN (SELECT paper_id FROM arxiv_silver_plus WHERE quality_flag = 'ok')"


def lookup_rows(spark: SparkSession, d: str) -> DataFrame:
    """A lookup table stored by prefix, and the rows of it that candidates ask for."""
    folder = shared_folder(spark, "lookup")
    papers = table(spark, d, "arxiv_silver_plus").select("paper_id", "quality_flag", "word_count_clean")
    writers.write_partitioned(lsh.lookup_table(papers).repartition("pid_prefix"), folder, ["pid_prefix"])
    candidates = table(spark, d, "minhash_signatures").filter(_is_query()).select(F.col("paper_id").alias("candidate"))
    return lsh.look_up(candidates, readers.read_lookup(spark, folder))


def _norm_sql(c: str) -> str:
    return f"{C._strip(f'''replace(replace({C._strip(f'lower({c})')}, 'arxiv_', ''), '.pdf', '')''')}"


LOOKUP_ROWS = f"""WITH p AS (SELECT paper_id, quality_flag, word_count_clean, {_norm_sql('paper_id')} AS pid_norm FROM arxiv_silver_plus)
  SELECT *, substr(pid_norm, 1, 4) AS pid_prefix FROM p WHERE length(pid_norm) >= 4 AND pid_norm IN (SELECT {_norm_sql('paper_id')} FROM minhash_signatures WHERE {_is_query_sql()})"""


def pending_files(spark: SparkSession, d: str) -> DataFrame:
    return readers.pending(table(spark, d, "arxiv_text_parquet").select("file_path"), table(spark, d, "arxiv_silver_plus"))


PENDING_FILES = "SELECT file_path FROM arxiv_text_parquet WHERE file_path NOT IN (SELECT file_path FROM arxiv_silver_plus WHERE file_path IS NOT NULL)"


def stored_paths(spark: SparkSession, d: str) -> DataFrame:
    """Names of papers with signatures, and where their page texts are stored."""
    names = table(spark, d, "minhash_signatures").select("paper_id").distinct()
    return readers.storage_paths(names, table(spark, d, "arxiv_text_parquet").select(F.col("file_path").alias("path")))


STORED_PATHS = "WITH f AS (SELECT regexp_extract(file_path, '[^/]*$', 0) AS paper_id, min(file_path) AS path FROM arxiv_text_parquet GROUP BY 1) SELECT s.paper_id, path FROM (SELECT DISTINCT paper_id FROM minhash_signatures) s JOIN f ON s.paper_id = f.paper_id"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """A page of HTML of each document with a text and a category."""
    safe = lambda c: F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    rows = table(spark, d, "documents").filter("text is not null and primary_category is not null")
    parts = [
        F.lit("<html><a href='/p/"), F.col("doc_id").cast("string"), F.lit("'>next</a><a href='/q/x'>no</a><h1 class='article-content__title'>"), safe("primary_category"),
        F.lit("</h1><div class='article-content__body'><p>"), safe("source"), F.lit("</p><script>drop()</script><div><b>"), safe("section"), F.lit("</b></div></div><div>after</div></html>"),
    ]
    return rows.select(F.concat(F.lit("http://site/p/"), F.col("doc_id").cast("string")).alias("url"), F.concat(*parts).alias("html"))


def web_articles(spark: SparkSession, d: str) -> DataFrame:
    return web.articles(_pages(spark, d), "url", "html")


WEB_ARTICLES = f"""SELECT md5(url) AS doc_id, url, title, body || chr(10) || section AS content FROM (
  SELECT 'http://site/p/' || doc_id AS url, {C._strip('primary_category')} AS title, {C._strip('source')} AS body, {C._strip('section')} AS section FROM documents WHERE text IS NOT NULL AND primary_category IS NOT NULL AND source IS NOT NULL AND section IS NOT NULL)"""


def web_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of the pages that weren't seen yet."""
    pages = _pages(spark, d)
    return web.links(pages, "html", "/p/", "http://site", pages.filter("url like '%7'"))


WEB_LINKS = "SELECT DISTINCT 'http://site/p/' || doc_id AS url FROM documents WHERE text IS NOT NULL AND primary_category IS NOT NULL AND source IS NOT NULL AND section IS NOT NULL AND doc_id % 10 <> 7"

# ---- metadata ---------------------------------------------------------------


def bronze_rows(spark: SparkSession, d: str) -> DataFrame:
    """Metadata put back into the form of a raw snapshot, and normalised from it."""
    parts = lambda a: F.split(a, " ")
    name = lambda a: F.array(F.element_at(parts(a), -1), F.array_join(F.slice(parts(a), 1, F.size(parts(a)) - 1), " "))
    raw = table(spark, d, "arxiv_metadata_sample").select(
        F.regexp_replace("doc_id", "^arxiv_", "").alias("id"), "title", "abstract", F.transform("authors", name).alias("authors_parsed"), F.array_join("categories", " ").alias("categories"),
        F.col("publish_date").alias("update_date"), "doi",
    )
    made = metadata.normalise_metadata(raw, "2024-01-01", "day")
    return made.withColumns({c: F.array_join(c, "|") for c in ("authors", "categories")})


_LINE = lambda c: C._strip(f"replace(coalesce({c}, ''), chr(10), ' ')")
BRONZE_ROWS = f"""WITH r AS (SELECT *, regexp_replace(doc_id, '^arxiv_', '') AS id, list_transform(coalesce(authors, []), lambda a: string_split(a, ' ')) AS names FROM arxiv_metadata_sample)
  SELECT 'arxiv_' || replace(id, '/', '_') AS doc_id, sha256('https://arxiv.org/abs/' || id) AS hash_sha256, {_LINE('title')} AS title, {_LINE('abstract')} AS abstract,
    array_to_string(list_transform(names, lambda n: {C._strip("array_to_string(n[1:len(n) - 1], ' ') || ' ' || n[len(n)]")}), '|') AS authors, 'en' AS language,
    replace(array_to_string(coalesce(categories, []), ' '), ' ', '|') AS categories, coalesce(publish_date, '') AS publish_date, doi, 'https://arxiv.org/abs/' || id AS source_url,
    'https://arxiv.org/pdf/' || id || '.pdf' AS pdf_url, 'bronze/raw_pdfs/day/arxiv_' || replace(id, '/', '_') || '.pdf' AS local_path_bronze, '2024-01-01' AS scraped_at FROM r"""


def text_parts(spark: SparkSession, d: str) -> DataFrame:
    """Abstract, title, query text and index text of each paper's text."""
    t = F.coalesce("clean_text", F.lit(""))
    part = lambda c: F.coalesce(c, F.lit(""))
    return spread(table(spark, d, "arxiv_silver_plus")).select(
        "paper_id", X.extract_abstract(t).alias("abstract"), X.query_title(t).alias("title"), F.md5(X.query_text(t, part("introduction"), part("body"))).alias("query_md5"),
        F.md5(X.index_text(F.col("abstract"), F.col("introduction"), F.col("body"))).alias("index_md5"), F.size(X.sentences_demo(t)).alias("n_sentences"), metadata.pid_url(F.col("paper_id")).alias("url"),
    )


def _sentences_sql(t: str, least: int) -> str:
    split = f"string_split(regexp_replace({C._strip(t)}, '([.!?])[{SPACE}]+', '\\1' || chr(1), 'g'), chr(1))"
    return f"(CASE WHEN length({t}) >= {least} THEN list_filter(list_transform({split}, lambda s: {C._strip('s')}), lambda s: length(s) >= {least}) ELSE [] END)"


def _text_parts_sql() -> str:
    short = f"regexp_extract(t, {sql(P.ABSTRACT_TO_HEADING)}, 1)"
    joined = C._strip("i || ' ' || b")
    long = sql(P.ABSTRACT_LONG.replace("{100,2000}", "{100,1000}.{0,1000}"))  # RE2 repeats up to 1000 times
    return f"""WITH p AS (SELECT paper_id, abstract AS a, introduction, body, coalesce(clean_text, '') AS t, coalesce(introduction, '') AS i, coalesce(body, '') AS b FROM arxiv_silver_plus)
      SELECT paper_id, CASE WHEN length({C._strip(short)}) > 50 THEN {C._strip(short)} WHEN regexp_matches(t, {long}) THEN {C._strip(f'regexp_extract(t, {long}, 1)')}
        ELSE array_to_string(regexp_extract_all(t, '[^{SPACE}]+')[1:300], ' ') END AS abstract,
        coalesce(nullif(regexp_extract(t, {sql(P.TITLE)}, 1), ''), substr(t, 1, 100)) AS title, md5(CASE WHEN length({joined}) < 200 THEN t ELSE {joined} END) AS query_md5,
        md5(concat_ws(' ', a, introduction, body)) AS index_md5, len({_sentences_sql('t', 30)})::INTEGER AS n_sentences, 'https://arxiv.org/abs/' || {_base_sql('paper_id')} AS url FROM p"""


def title_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Character ratios of each paper's title and the beginning of its abstract, as they are and in lower case."""
    rows = spread(_papers(spark, d, "title", "abstract").filter("title is not null and abstract is not null"))
    a, b = F.col("title"), F.expr("substring(abstract, 1, length(title))")
    return rows.select("paper_id", S.indel_ratio(a, b).alias("ratio"), S.indel_ratio(F.lower(a), F.lower(b)).alias("lower_ratio"))


#: The longest common subsequence row by row: an entry is the best of what precedes it, a character further on a match.
TITLE_RATIOS = f"""WITH RECURSIVE t AS (SELECT paper_id, title AS a, substr(abstract, 1, length(title)) AS b FROM ({_papers_sql('title', 'abstract')}) WHERE title IS NOT NULL AND abstract IS NOT NULL),
  both_cases AS (SELECT paper_id, 0 AS low, string_split(a, '') AS a, string_split(b, '') AS b, length(a) AS la, length(b) AS lb FROM t UNION ALL SELECT paper_id, 1, string_split(lower(a), ''), string_split(lower(b), ''), length(a), length(b) FROM t),
  step AS (SELECT paper_id, low, a, b, la, lb, 0 AS i, list_transform(range(0, lb), lambda k: 0::BIGINT) AS r FROM both_cases
    UNION ALL SELECT paper_id, low, a, b, la, lb, i + 1, list_transform(range(1, lb + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN b[k] = a[i + 1] THEN CASE WHEN k > 1 THEN r[k - 1] ELSE 0 END + 1 ELSE r[k] END))) FROM step WHERE i < la AND lb > 0),
  done AS (SELECT paper_id, low, CASE WHEN la + lb > 0 THEN 2 * coalesce(r[lb], 0) / (la + lb) ELSE 1.0 END AS ratio FROM step WHERE i = la OR lb = 0)
  SELECT paper_id, max(CASE WHEN low = 0 THEN ratio END) AS ratio, max(CASE WHEN low = 1 THEN ratio END) AS lower_ratio FROM done GROUP BY paper_id"""

# ---- cleaners without the step that SQL lacks -------------------------------


def clean_offline_plain(spark: SparkSession, d: str) -> DataFrame:
    """The offline cleaner in whole but for Unicode NFKC."""
    rows = spread(table(spark, d, "arxiv_text_parquet").select("file_path", "text"))
    return X.clean_offline(rows, "text", compose=False).select("file_path", "cleaned.*")


def clean_online_plain(spark: SparkSession, d: str) -> DataFrame:
    """The online cleaner in whole but for Unicode NFKC."""
    rows = spread(table(spark, d, "arxiv_text_parquet").select("file_path", "text"))
    return X.clean_online(rows, "text", compose=False).select("file_path", "cleaned.*")


def _ligated_sql(t: str, upto: str) -> str:
    for sign, letters in P.LIGATURES.items():
        if sign <= upto:
            t = f"replace({t}, '{sign}', '{letters}')"
    return t


def _finished_sql(t: str, pages, upto: str, control: str, tail) -> str:
    """The last steps of a cleaner, a subquery for each, so that no expression is written out twice."""
    return f"""n1 AS (SELECT *, {_ligated_sql(C._steps(t, pages), upto)} AS x1 FROM n0), n2 AS (SELECT *, regexp_replace(regexp_replace(x1, '{P.CONTROL}', '{control}', 'g'), {sql(P.HYPHEN)}, '\\1\\2', 'g') AS x2 FROM n1),
      n3 AS (SELECT *, {C._strip(C._steps('x2', tail))} AS clean_text FROM n2)"""


def _clean_offline_sql() -> str:
    low, strict = "floor(length(front) * 0.60::DOUBLE)::BIGINT", "floor(length(front) * 0.75::DOUBLE)::BIGINT"
    heading, listed = C._at(f"substr(front, {low} + 1)", P.OFFLINE_REFERENCES), C._at(f"substr(front, {strict} + 1)", P.OFFLINE_REFERENCE_LIST)
    front = C._steps("coalesce(text, '')", [(P.OFFLINE_HEADER, ""), (P.OFFLINE_STAMP, ""), (P.OFFLINE_PUBLISHER, ""), (P.OFFLINE_REPORT, "")])
    return f"""WITH f AS (SELECT file_path, {C._words("coalesce(text, '')")} AS raw, {front} AS front FROM arxiv_text_parquet),
      g AS (SELECT *, CASE WHEN {heading} > 0 THEN {low} + {heading} - 1 WHEN {listed} > 0 THEN {strict} + {listed} - 1 END AS cut FROM f),
      n0 AS (SELECT *, CASE WHEN cut IS NULL THEN front ELSE substr(front, 1, cut) END AS kept FROM g), {_finished_sql('kept', P.OFFLINE_PAGES, 'ﬆ', '', P.OFFLINE_TAIL)},
      c AS (SELECT *, {C._words('clean_text')} AS n, CASE WHEN raw > 0 THEN {C._words('clean_text')} / raw ELSE 0.0 END AS ratio FROM n3)
      SELECT file_path, clean_text, cut IS NOT NULL AS has_references, n::INTEGER AS word_count_clean, round_even(ratio::DOUBLE, 3) AS reduction_ratio,
        CASE WHEN n < 300 THEN 'empty' WHEN n < 500 THEN 'low_quality' WHEN ratio < 0.3::DOUBLE THEN 'over_cleaned' ELSE 'ok' END AS quality_flag FROM c"""


def _clean_online_sql() -> str:
    half = "floor(length(front) * 0.55::DOUBLE)::BIGINT"
    marks = ", ".join(f"nullif(strpos(substr(lower(front), {half} + 1), '{m}'), 0)" for m in P.ONLINE_MARKERS)
    front = C._steps("coalesce(text, '')", [(P.ONLINE_HEADER, " "), *((p, " ") for p in P.ONLINE_JOURNAL)])
    return f"""WITH f AS (SELECT file_path, {front} AS front FROM arxiv_text_parquet), g AS (SELECT *, {half} + least({marks}) - 1 AS cut FROM f),
      n0 AS (SELECT *, CASE WHEN cut IS NULL THEN front ELSE substr(front, 1, cut) END AS kept, CASE WHEN cut IS NULL THEN '' ELSE substr(front, cut + 1) END AS references_text FROM g),
      {_finished_sql('kept', P.ONLINE_PAGES, 'ﬅ', ' ', P.ONLINE_TAIL)}, c AS (SELECT *, {C._words('clean_text')}::INTEGER AS n FROM n3)
      SELECT file_path, clean_text, references_text, n AS word_count_clean, CASE WHEN n >= 500 THEN 'ok' WHEN n >= 300 THEN 'low_quality' ELSE 'empty' END AS quality_flag, {C._strip('references_text')} <> '' AS has_references FROM c"""


# ---- index ------------------------------------------------------------------


def _stored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "minhash_signatures").select("paper_id", "signature")


_STORED = f"sig AS (SELECT DISTINCT paper_id AS id, signature FROM minhash_signatures WHERE len(signature) = {K.PERMUTATIONS})"
_AGREE = f"len(list_filter(range(1, {K.PERMUTATIONS + 1}), lambda i: x.signature[i] = y.signature[i])) / {K.PERMUTATIONS}"
#: mates(query_id, candidate, j): bucket mates of the papers that are queries, the best of their signatures.
_MATES = f"""{_STORED}, bands AS (SELECT id, signature, band, signature[band * {K.BAND_ROWS} + 1 : band * {K.BAND_ROWS} + {K.BAND_ROWS}] AS k FROM (SELECT id, signature, unnest(range(0, {K.BANDS})) AS band FROM sig)),
  met AS (SELECT DISTINCT p.id AS query_id, q.id AS candidate, p.signature AS s, q.signature AS t FROM bands p JOIN bands q ON p.band = q.band AND p.k = q.k AND p.id <> q.id WHERE {_is_query_sql('p.id')}),
  mates AS (SELECT query_id, candidate, max(len(list_filter(range(1, {K.PERMUTATIONS + 1}), lambda i: s[i] = t[i])) / {K.PERMUTATIONS}) AS j FROM met GROUP BY ALL)"""


def paper_mates(spark: SparkSession, d: str) -> DataFrame:
    """Every bucket mate of the papers that are queries."""
    stored = _stored(spark, d)
    return lsh.bucket_mates(stored.filter(_is_query()), stored, "paper_id")


PAPER_MATES = f"WITH {_MATES} SELECT query_id, candidate, j AS jaccard_similarity FROM mates"


def _once(spark: SparkSession, d: str) -> DataFrame:
    """The papers that have one signature."""
    one = _stored(spark, d).filter(F.size("signature") == K.PERMUTATIONS).distinct()
    return one.groupBy("paper_id").agg(F.count("*").alias("n"), F.first("signature").alias("signature")).filter("n = 1").drop("n")


_ONE = f"one AS (SELECT id, any_value(signature) AS signature FROM (SELECT DISTINCT paper_id AS id, signature FROM minhash_signatures WHERE len(signature) = {K.PERMUTATIONS}) GROUP BY id HAVING count(*) = 1)"


def _probe_sql(queries: str) -> str:
    return f"""WITH {_ONE}, bands AS (SELECT id, band, signature[band * {K.BAND_ROWS} + 1 : band * {K.BAND_ROWS} + {K.BAND_ROWS}] AS k FROM (SELECT id, signature, unnest(range(0, {K.BANDS})) AS band FROM one)), asked AS ({queries}),
      met AS (SELECT DISTINCT p.id AS query_id, q.id AS candidate FROM bands p JOIN bands q ON p.band = q.band AND p.k = q.k AND p.id <> q.id WHERE p.id IN (SELECT id FROM asked)),
      scored AS (SELECT query_id, candidate, {_AGREE} AS jaccard_similarity FROM met JOIN one x ON x.id = query_id JOIN one y ON y.id = candidate)
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY jaccard_similarity DESC, candidate)::INTEGER AS rank FROM scored) WHERE rank <= {K.MAX_CANDIDATES}"""


def paper_probe(spark: SparkSession, d: str) -> DataFrame:
    """The most similar bucket mates of the papers that are queries."""
    one = cut_lineage(_once(spark, d))
    return lsh.probe(one.filter(_is_query()), one, "paper_id")


PAPER_PROBE = _probe_sql(f"SELECT id FROM one WHERE {_is_query_sql('id')}")


def index_self_probe(spark: SparkSession, d: str) -> DataFrame:
    return lsh.self_probe(cut_lineage(_once(spark, d)), "paper_id", 50)


INDEX_SELF_PROBE = _probe_sql("SELECT id FROM one ORDER BY id LIMIT 50")


def top_pairs(spark: SparkSession, d: str) -> DataFrame:
    return lsh.top_pairs(lsh.near_duplicate_pairs(_stored(spark, d), "paper_id"))


TOP_PAIRS = f"WITH {_STORED}, {C._pairs_sql()} SELECT *, 'HIGH' AS similarity_level FROM pairs WHERE jaccard_similarity >= {K.SIMILARITY_HIGH}::DOUBLE ORDER BY jaccard_similarity DESC, id_a, id_b LIMIT 10"


def index_config(spark: SparkSession, d: str) -> DataFrame:
    """What the signature index and the vector index are built with."""
    vecs = writers.vector_index_description(table(spark, d, "embeddings"), "embedding", "given", "exact", ["text"])
    return writers.index_description(lsh.whole(_stored(spark, d))).unionByName(vecs)


INDEX_CONFIG = f"""SELECT '{{"num_perm":{K.PERMUTATIONS},"threshold":{K.LSH_THRESHOLD},"shingle_k":{K.SHINGLE_WORDS},"n_papers":' || count(*) || '}}' AS config FROM minhash_signatures WHERE len(signature) = {K.PERMUTATIONS}
  UNION ALL SELECT '{{"model":"given","dim":' || max(len(embedding)) || ',"n":' || count(embedding) || ',"type":"exact","sections":["text"]}}' FROM embeddings"""


def ml_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of the hash-table variant, which are ASCII, of papers with enough of them."""
    return ml_lsh.tokens(table(spark, d, "arxiv_silver_plus").select("paper_id", "clean_text"), "clean_text").select("paper_id", F.array_join("words", " ").alias("words"))


_ML_WORDS = "list_filter(regexp_split_to_array(lower(clean_text), '[^a-zA-Z0-9_]+'), lambda w: length(w) >= 2)"
ML_TOKENS = f"SELECT paper_id, array_to_string(w, ' ') AS words FROM (SELECT paper_id, {_ML_WORDS} AS w FROM arxiv_silver_plus WHERE clean_text IS NOT NULL) WHERE len(w) >= {ml_lsh.LEAST_WORDS}"


def ml_shingles(spark: SparkSession, d: str) -> DataFrame:
    """How many of its shingles each paper shares with another one."""
    papers = _papers(spark, d, "clean_text")
    return ml_lsh.shared_shingles(papers, "paper_id", "clean_text").select(F.col("id").alias("paper_id"), F.size("shared").alias("n_shared"))


ML_SHINGLES = f"""WITH t AS (SELECT paper_id, {_ML_WORDS} AS w FROM ({_papers_sql('clean_text')}) WHERE clean_text IS NOT NULL),
  g AS (SELECT DISTINCT paper_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT paper_id, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= {ml_lsh.LEAST_WORDS})),
  n AS (SELECT s FROM g GROUP BY s HAVING count(*) >= {ml_lsh.LEAST_FILES})
  SELECT t.paper_id, count(n.s)::INTEGER AS n_shared FROM t LEFT JOIN g ON g.paper_id = t.paper_id LEFT JOIN n ON n.s = g.s WHERE len(w) >= {ml_lsh.LEAST_WORDS} GROUP BY t.paper_id"""


def table_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs by agreement in five hash tables, here the first five values of the stored signatures."""
    keyed = _once(spark, d).select(F.col("paper_id").alias("id"), F.transform(F.slice("signature", 1, 5), lambda v: v.cast("bigint")).alias("h"))
    return ml_lsh.table_pairs(cut_lineage(keyed))


TABLE_PAIRS = f"""WITH {_ONE}, k AS (SELECT id, signature[1:5] AS h FROM one), heads AS (SELECT h, min(id) AS head FROM k GROUP BY h),
  links AS (SELECT x.head AS a, y.head AS b, len(list_filter(range(1, 6), lambda i: x.h[i] = y.h[i])) / 5 AS s FROM heads x JOIN heads y ON x.head < y.head),
  p AS (SELECT * FROM links WHERE s >= 0.5 UNION ALL SELECT head, id, 1.0::DOUBLE FROM k JOIN heads ON k.h = heads.h WHERE id <> head)
  SELECT a AS id_a, b AS id_b, s AS jaccard_similarity, CASE WHEN s >= {K.SIMILARITY_HIGH}::DOUBLE THEN 'HIGH' ELSE 'MEDIUM' END AS similarity_level FROM p WHERE nullif({_base_sql('a')}, '') <> nullif({_base_sql('b')}, '')"""

# ---- citation and exclusion rules -------------------------------------------


def cited_sources(spark: SparkSession, d: str) -> DataFrame:
    """Each document's text as references, and whether they cite its paper, by both rules."""
    rows = table(spark, d, "documents").select("doc_id", "text", "paper_id").join(_papers(spark, d, "title"), "paper_id", "left")
    refs = F.col("text")
    cited = lambda mode: F.coalesce(E.source_is_cited(refs, F.col("title"), F.col("paper_id"), mode=mode), F.lit(False))
    return rows.select("doc_id", F.md5(E.for_reference_match(refs)).alias("references_md5"), cited("reference").alias("cited"), cited("strict").alias("cited_strict"))


def _reference_sql(t: str) -> str:
    plain = f"regexp_replace(lower(coalesce({t}, '')), {sql(r'https?://\S+|www\.\S+')}, ' ', 'g')"
    return C._strip(f"regexp_replace(regexp_replace({plain}, '[^a-z0-9{SPACE}.\\-:]', ' ', 'g'), '[{SPACE}]+', ' ', 'g')")


def _cited_sql(refs: str, title: str, paper: str) -> tuple[str, str]:
    """Conditions of both rules on normalised references and titles."""
    bare = f"trim(replace(replace(trim(lower(coalesce({paper}, ''))), 'arxiv_', ''), '.pdf', ''))"
    by_title = f"(length({title}) > 20 AND contains({refs}, {title}))"
    plain = _reference_sql(bare)
    return f"({refs} <> '' AND ({by_title} OR {bare} <> ''))", f"({refs} <> '' AND ({by_title} OR ({bare} <> '' AND (contains({refs}, {bare}) OR ({plain} <> '' AND contains({refs}, {plain}))))))"


_CITED = _cited_sql("refs", "name", "paper_id")
CITED_SOURCES = f"""WITH t AS ({_papers_sql('title')}), r AS (SELECT doc_id, d.paper_id, {_reference_sql('text')} AS refs, {_reference_sql('title')} AS name FROM documents d LEFT JOIN t ON d.paper_id = t.paper_id)
  SELECT doc_id, md5(refs) AS references_md5, {_CITED[0]} AS cited, {_CITED[1]} AS cited_strict FROM r"""


def _chunk_matches(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk as a match with its paper's abstract, its introduction taken as references."""
    papers = cut_lineage(_papers(spark, d, "title", "abstract", "introduction").withColumn("introduction", E.for_reference_match(F.col("introduction"))))
    t = F.col("chunk_text")
    rows = spread(table(spark, d, "chunks_sample").filter("chunk_text is not null").select("paper_id", "chunk_id", "section", "chunk_text")).join(papers, "paper_id", "left")
    made = rows.select(
        "paper_id", "chunk_id", X.word_count(t).alias("word_count"), F.col("section").alias("input_section"), F.lit("abstract").alias("source_section"), t.alias("input_text"), F.col("abstract").alias("source_text"),
        F.col("title").alias("source_title"), F.col("paper_id").alias("source_paper_id"), F.col("introduction").alias("references_text"), any_like(t, P.SEGMENT_CITATIONS).alias("input_near_citation"), quoted_segment(t).alias("input_is_quote"),
    )
    return E.apply_exclusion(made, normalised=True)


def exclusions(spark: SparkSession, d: str) -> DataFrame:
    """Exclusion reasons of every chunk, and what follows from them."""
    made = _chunk_matches(spark, d)
    return made.select("paper_id", "chunk_id", F.array_join("exclusion_reasons", ",").alias("reasons"), "excluded", "source_cited", "inline_cited", "quoted", "risk_modifier", "validity")


def _exclusions_sql() -> str:
    """CTE x with a row for each chunk."""
    t, s = "chunk_text", C._strip("chunk_text")
    quoted = lambda marks: " OR ".join(f"({s} LIKE '{a.replace(chr(39), chr(39) * 2)}%' AND {s} LIKE '%{b.replace(chr(39), chr(39) * 2)}')" for a, b in marks)
    section = " OR ".join(f"contains(lower(coalesce(section, '')), '{k}')" for k in P.REFERENCE_SECTIONS)
    symbols, letters = f"len(regexp_extract_all({t}, '[^\\p{{L}}\\p{{N}}{SPACE}]'))", f"len(regexp_extract_all({t}, '\\p{{L}}'))"
    formula = f"(length({t}) > 0 AND n <= {P.SYMBOL_WORDS} AND {symbols} / length({t}) >= {P.SYMBOL_RATIO}::DOUBLE AND {letters} / length({t}) < {P.ALPHA_RATIO}::DOUBLE)"
    tests = [
        f"n < {K.SMALL_MATCH_WORDS}", f"({section})", C._like(s, P.REFERENCE_LIKE), "(quoted AND (inline_cited OR source_cited))",
        f"({C._like(f'lower({t})', P.BOILERPLATE)} OR {C._like('lower(abstract)', P.BOILERPLATE)})", f"coalesce({formula}, false)",
    ]
    reasons = ", ".join(f"CASE WHEN {test} THEN '{name}' END" for test, name in zip(tests, P.EXCLUSION_REASONS))
    two = [("\"", "\""), ("'", "'")]
    return f"""WITH p AS ({_papers_sql('title', 'abstract', 'introduction')}),
      m AS (SELECT c.paper_id, chunk_id, section, chunk_text, abstract, {_reference_sql('introduction')} AS refs, {_reference_sql('title')} AS name, {C._words('chunk_text')} AS n FROM chunks_sample c LEFT JOIN p ON c.paper_id = p.paper_id WHERE chunk_text IS NOT NULL),
      f AS (SELECT *, ({C._like(t, P.SEGMENT_CITATIONS)} OR {C._like(t, P.INLINE_CITATIONS)}) AS inline_cited, (({quoted(two)}) OR (length({s}) >= 2 AND ({quoted(P.QUOTES)}))) AS quoted, {_cited_sql('refs', 'name', 'paper_id')[0]} AS source_cited FROM m),
      x AS (SELECT *, list_filter([{reasons}], lambda r: r IS NOT NULL) AS reasons FROM f)"""


EXCLUSIONS = f"""{_exclusions_sql()} SELECT paper_id, chunk_id, array_to_string(reasons, ',') AS reasons, len(reasons) > 0 AS excluded, source_cited, inline_cited, quoted,
  CASE WHEN source_cited THEN 0.70::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN inline_cited THEN 0.75::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN quoted THEN 0.60::DOUBLE ELSE 1.0::DOUBLE END AS risk_modifier,
  CASE WHEN len(reasons) > 0 THEN 'EXCLUDED' ELSE 'VALID' END AS validity FROM x"""


def exclusion_totals(spark: SparkSession, d: str) -> DataFrame:
    """Numbers and words of valid and excluded chunks by section."""
    return E.exclusion_summary(_chunk_matches(spark, d), ["input_section"])


EXCLUSION_TOTALS = f"""{_exclusions_sql()} SELECT section AS input_section, count(*) AS total_matches, count_if(len(reasons) = 0)::BIGINT AS valid_matches, count_if(len(reasons) > 0)::BIGINT AS excluded_matches,
  coalesce(sum(CASE WHEN len(reasons) = 0 THEN n END), 0)::BIGINT AS valid_words, coalesce(sum(CASE WHEN len(reasons) > 0 THEN n END), 0)::BIGINT AS excluded_words FROM x GROUP BY section"""


def exclusion_reasons(spark: SparkSession, d: str) -> DataFrame:
    return E.reason_counts(_chunk_matches(spark, d), ["input_section"])


EXCLUSION_REASONS = f"{_exclusions_sql()} SELECT section AS input_section, reason, count(*) AS n FROM (SELECT section, unnest(reasons) AS reason FROM x) GROUP BY ALL"

# ---- scores, contributions, reports -----------------------------------------


def _spans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Texts of papers, and each chunk as a match of its paper's text: place, source and score follow from its number."""
    papers = _papers(spark, d, "clean_text").filter("clean_text is not null")
    start = F.pmod(F.col("chunk_id") * 211, F.lit(4000))
    rows = table(spark, d, "chunks_sample").filter("chunk_text is not null").join(papers.select("paper_id"), "paper_id", "left_semi")
    matches = rows.select(
        F.col("paper_id").alias("query_id"), F.concat(F.lit("arxiv_07"), F.pmod("chunk_id", F.lit(3)).cast("string"), F.lit(".pdf")).alias("source_paper_id"), F.col("section").alias("source_title"),
        F.concat_ws("_", "paper_id", F.col("chunk_id").cast("string")).alias("source_segment_id"), F.col("chunk_id").cast("string").alias("input_segment_id"), start.alias("input_start"),
        (start + F.pmod(F.length("chunk_text"), F.lit(900))).alias("input_end"), (F.pmod("chunk_id", F.lit(7)) == 0).alias("excluded"), (F.pmod(F.length("chunk_text"), F.lit(41)) / 40).alias("match_score"), F.col("chunk_text").alias("input_text"),
    )
    return papers.withColumnRenamed("paper_id", "query_id"), matches.distinct()


_SPANS = f"""texts AS (SELECT * FROM ({_papers_sql('clean_text')}) WHERE clean_text IS NOT NULL),
  m AS (SELECT DISTINCT paper_id AS query_id, 'arxiv_07' || (chunk_id % 3) || '.pdf' AS source_paper_id, section AS source_title, paper_id || '_' || chunk_id AS source_segment_id, chunk_id::VARCHAR AS input_segment_id,
    (chunk_id * 211) % 4000 AS s, (chunk_id * 211) % 4000 + length(chunk_text) % 900 AS e, chunk_id % 7 = 0 AS excluded, (length(chunk_text) % 41) / 40 AS match_score, chunk_text AS input_text
    FROM chunks_sample WHERE chunk_text IS NOT NULL AND paper_id IN (SELECT paper_id FROM texts))"""


def _covered_sql(by: str) -> str:
    """CTE covered(by, matched): words in the unions of valid spans."""
    return f"""o AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY {by} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM m WHERE NOT excluded),
      i AS (SELECT *, sum(fresh) OVER (PARTITION BY {by} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM o), u AS (SELECT {by}, min(s) AS s, max(e) AS e FROM i GROUP BY {by}, island),
      covered AS (SELECT {by}, sum({C._words('substr(clean_text, s::BIGINT + 1, (e - s)::BIGINT)')}) AS matched FROM u JOIN texts ON texts.paper_id = u.query_id GROUP BY {by})"""


_RISK = lambda x: f"CASE WHEN {x} < 10 THEN 'Low' WHEN {x} < 25 THEN 'Medium' WHEN {x} < 40 THEN 'High' ELSE 'Very High' END"


def span_scores(spark: SparkSession, d: str) -> DataFrame:
    texts, matches = _spans(spark, d)
    return scoring.similarity_scores(texts, cut_lineage(matches))


SPAN_SCORES = f"""WITH {_SPANS}, {_covered_sql('query_id')}, t AS (SELECT paper_id AS query_id, {C._words('clean_text')} AS total, coalesce(matched, 0) AS matched FROM texts LEFT JOIN covered ON covered.query_id = paper_id),
  w AS (SELECT *, CASE WHEN total > 0 THEN matched / total * 100 ELSE 0.0 END AS s FROM t)
  SELECT query_id, total::INTEGER AS total_words, matched::BIGINT AS matched_words, s AS overall_similarity, {_RISK('s')} AS risk_level FROM w"""


def span_sources(spark: SparkSession, d: str) -> DataFrame:
    """Contributions of sources with their risk, its class and their addresses."""
    texts, matches = _spans(spark, d)
    return writers.source_rows(scoring.source_contributions(texts, cut_lineage(matches)))


SPAN_SOURCES = f"""WITH {_SPANS}, {_covered_sql('query_id, source_paper_id')}, n AS (SELECT query_id, source_paper_id, first(source_title ORDER BY s, source_segment_id) AS source_title FROM m GROUP BY ALL),
  w AS (SELECT c.*, source_title, CASE WHEN {C._words('clean_text')} > 0 THEN matched / {C._words('clean_text')} * 100 ELSE 0.0 END AS p FROM covered c JOIN n ON n.query_id = c.query_id AND n.source_paper_id = c.source_paper_id JOIN texts ON texts.paper_id = c.query_id)
  SELECT query_id, source_paper_id, source_title, matched::BIGINT AS matched_words, p AS contribution_percent, row_number() OVER (PARTITION BY query_id ORDER BY p DESC, source_paper_id)::INTEGER AS rank, {_RISK('p')} AS risk_level,
    CASE WHEN p >= 25 THEN 'high' WHEN p >= 10 THEN 'medium' ELSE 'low' END AS risk_class, 'https://arxiv.org/abs/' || replace(replace(source_paper_id, 'arxiv_', ''), '.pdf', '') AS abs_url,
    'https://arxiv.org/pdf/' || replace(replace(source_paper_id, 'arxiv_', ''), '.pdf', '') AS pdf_url FROM w"""


def shown_matches(spark: SparkSession, d: str) -> DataFrame:
    """The matches that a report shows, their texts cut."""
    return writers.best_matches(_spans(spark, d)[1]).select("query_id", "match_rank", "source_segment_id", writers.truncated(F.col("input_text")).alias("input_text"))


SHOWN_MATCHES = f"""WITH {_SPANS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY match_score DESC, input_segment_id, source_paper_id, source_segment_id) AS match_rank FROM m)
  SELECT query_id, match_rank::INTEGER AS match_rank, source_segment_id, CASE WHEN length(input_text) <= {writers.SHOWN} THEN input_text ELSE substr(input_text, 1, {writers.SHOWN}) || '...' END AS input_text FROM r WHERE match_rank <= {writers.SHOWN_MATCHES}"""

# ---- layers -----------------------------------------------------------------


def layer_one(spark: SparkSession, d: str) -> DataFrame:
    return L.layer1(paper_mates(spark, d))


LAYER_ONE = f"WITH {_MATES} SELECT query_id, candidate AS pid, round_even(j, 4) AS jaccard FROM mates WHERE j >= 0.3"


def _neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The papers of the documents nearest to each query vector."""
    vecs = table(spark, d, "embeddings")
    near = vectors.nearest(vecs.filter(F.pmod("vec_id", F.lit(_QUERY_STEP)) == 0), vecs, "vec_id", "embedding")
    papers = table(spark, d, "documents").filter("paper_id is not null").select(F.col("doc_id").alias("vec_id"), F.col("paper_id").alias("pid"))
    return near.join(papers, "vec_id").select("query_id", "pid", "cosine")


_NEIGHBOURS = f"""u AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
  c AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) / q.n / c.n AS cosine FROM u q JOIN u c ON q.vec_id <> c.vec_id WHERE q.vec_id % {_QUERY_STEP} = 0),
  near AS (SELECT query_id, paper_id AS pid, cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM c) JOIN documents ON doc_id = vec_id WHERE rank <= 20 AND paper_id IS NOT NULL),
  l3 AS (SELECT query_id, pid, round_even(max(cosine), 4) AS cosine FROM near GROUP BY ALL)"""


def layer_three(spark: SparkSession, d: str) -> DataFrame:
    """The best cosine of each paper, and the stretched score."""
    return L.layer3(_neighbours(spark, d)).withColumn("score", X.rounded(vectors.semantic_score(F.col("cosine")), 4))


LAYER_THREE = f"WITH {_NEIGHBOURS} SELECT query_id, pid, cosine, round_even(greatest(0.0::DOUBLE, (cosine - {K.SEMANTIC_THRESHOLD}::DOUBLE) / (1 - {K.SEMANTIC_THRESHOLD}::DOUBLE)), 4) AS score FROM l3"


def _titled(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the abstract of their paper; the likeness of titles, which SQL can't say, is a given value."""
    rows = spread(table(spark, d, "documents").filter("text is not null").select("doc_id", "paper_id", "text")).join(_papers(spark, d, "abstract").filter("abstract is not null"), "paper_id")
    return rows.select("doc_id", "paper_id", "text", "abstract", (F.pmod("doc_id", F.lit(11)) / 10).alias("title_ratio"))


def layer_four(spark: SparkSession, d: str) -> DataFrame:
    """Concept scores of documents and their papers, before the last rounding: sums such as 0.22875 lie on either side of it by the order of their terms."""
    none = F.lit("")
    score = L.concept_score(none, F.col("text"), none, F.col("abstract"), F.col("title_ratio"))
    return _titled(spark, d).withColumn("s", score).filter("s > 0.2").select("doc_id", "paper_id", F.round("s", 6).alias("concept"))


def _layer_four_sql() -> str:
    keyword = lambda t: f"list_distinct(list_filter(regexp_extract_all(lower({t}), '[{WORD}]+'), lambda x: regexp_full_match(x, '[a-z]{{4,}}')))"
    cues = lambda t: "list_filter([" + ", ".join(f"CASE WHEN contains(lower({t}), '{c}') THEN '{c}' END" for c in P.CUES) + "], lambda x: x IS NOT NULL)"
    percent = lambda t: f"list_distinct(regexp_extract_all({t}, {sql(P.PERCENT)}, 1))"
    parts = " + ".join(f"{w}::DOUBLE * {x}" for w, x in ((0.3, "((doc_id % 11) / 10)"), (0.3, C._jaccard_sql("ka", "kb")), (0.2, C._jaccard_sql("ca", "cb")), (0.2, C._jaccard_sql("na", "nb"))))
    return f"""WITH a AS (SELECT * FROM ({_papers_sql('abstract')}) WHERE abstract IS NOT NULL),
      p AS (SELECT doc_id, d.paper_id, {keyword('text')} AS ka, {keyword('abstract')} AS kb, {cues('text')} AS ca, {cues('abstract')} AS cb, {percent('text')} AS na, {percent('abstract')} AS nb FROM documents d JOIN a ON d.paper_id = a.paper_id WHERE text IS NOT NULL),
      s AS (SELECT doc_id, paper_id, {parts} AS s FROM p) SELECT doc_id, paper_id, round(s, 6) AS concept FROM s WHERE s > 0.2::DOUBLE"""


def _three_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the neighbours' papers, other layers' values following from the cosine and the query."""
    l3 = cut_lineage(L.layer3(_neighbours(spark, d)))
    l1 = l3.filter("query_id % 100 = 0").select("query_id", "pid", (1 - F.col("cosine")).alias("jaccard"))
    l2 = l3.filter("query_id % 150 = 0").select("query_id", F.concat("pid", F.lit("v2")).alias("pid"), F.lit(0.5).alias("fuzzy_ratio"))
    return L.all_scores(l1, l2, l3)


_THREE = f"""{_NEIGHBOURS}, named AS (SELECT query_id, pid, cosine AS s FROM l3 UNION ALL SELECT query_id, pid, 1 - cosine FROM l3 WHERE query_id % 100 = 0 UNION ALL SELECT query_id, pid || 'v2', 0.5::DOUBLE FROM l3 WHERE query_id % 150 = 0),
  best AS (SELECT query_id, pid, max(s) AS score FROM named GROUP BY ALL)"""


def ranked_papers(spark: SparkSession, d: str) -> DataFrame:
    """The best papers of each query over three layers, with bands."""
    return L.ranked_list(_three_scores(spark, d)).withColumn("score", F.round("score", 6))


RANKED_PAPERS = f"""WITH {_THREE} SELECT query_id, pid, round(score, 6) AS score, CASE WHEN score >= 0.7::DOUBLE THEN 'high' WHEN score >= 0.5::DOUBLE THEN 'medium' WHEN score >= 0.3::DOUBLE THEN 'low' ELSE 'none' END AS band, rank::INTEGER AS rank
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pid) AS rank FROM best) WHERE rank <= {L.RANKED}"""


def layer_five(spark: SparkSession, d: str) -> DataFrame:
    """Authors that each query paper has in common with its bucket mates."""
    papers = _papers(spark, d, "authors")
    scores = layer_one(spark, d).withColumnRenamed("jaccard", "score")
    found = L.layer5(papers.withColumnRenamed("paper_id", "query_id"), scores, papers)
    return found.withColumn("common", F.array_join("common", "|"))


_PLAIN = lambda a: f"list_distinct(list_transform(coalesce({a}, []), lambda x: {C._strip('lower(x)')}))"
LAYER_FIVE = f"""WITH {_MATES}, p AS ({_papers_sql('authors')}),
  x AS (SELECT query_id, candidate AS pid, list_sort(list_intersect({_PLAIN('a.authors')}, {_PLAIN('b.authors')})) AS common, j FROM mates JOIN p a ON a.paper_id = query_id JOIN p b ON b.paper_id = candidate WHERE j >= 0.3)
  SELECT query_id, pid, array_to_string(common[1:3], '|') AS common, round_even(j, 4) AS sim FROM x WHERE len(common) > 0"""


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Papers that are queries, each with its bucket mates."""
    return cut_lineage(paper_mates(spark, d).select("query_id", F.col("candidate").alias("pid")))


def layer_two(spark: SparkSession, d: str) -> DataFrame:
    """Equal sentences of query papers and their bucket mates."""
    papers = _papers(spark, d, "clean_text", "abstract", "introduction", "body")
    queries = papers.filter(_is_query()).select(F.col("paper_id").alias("query_id"), "clean_text")
    return L.layer2(queries, _asked(spark, d), papers, least=1.0)


LAYER_TWO = f"""WITH {_MATES}, p AS ({_papers_sql('clean_text', 'abstract', 'introduction', 'body')}),
  qs AS (SELECT paper_id AS query_id, i, ss[i] AS s FROM (SELECT paper_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM (SELECT paper_id, ({_sentences_sql("coalesce(clean_text, '')", 30)})[1:200] AS ss FROM p WHERE {_is_query_sql()}))),
  ql AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY length(s) DESC, i) AS rank FROM qs) WHERE rank <= {L.SENTENCES}),
  o AS (SELECT DISTINCT paper_id AS pid, lower(unnest(list_concat({_sentences_sql("coalesce(abstract, '')", 30)}, {_sentences_sql("coalesce(introduction, '')", 30)}, {_sentences_sql("coalesce(body, '')", 30)}))) AS b FROM p),
  h AS (SELECT mates.query_id, candidate AS pid, n, count(DISTINCT i) AS c FROM mates JOIN ql ON ql.query_id = mates.query_id JOIN o ON o.pid = candidate AND o.b = lower(ql.s) GROUP BY ALL)
  SELECT query_id, pid, c AS fuzzy_count, round_even(c / n, 4) AS fuzzy_ratio FROM h"""


def segment_matches(spark: SparkSession, d: str) -> DataFrame:
    """Segments of query papers that equal or share most shingles with segments of their bucket mates."""
    papers = _papers(spark, d, "introduction", "body").withColumn("title", F.lit(""))
    asked = _asked(spark, d)
    sections = [("introduction", "introduction"), ("body", "body")]
    own = make_segments(papers.filter(_is_query()).withColumnRenamed("paper_id", "query_id"), "query_id", sections)
    sources = make_segments(papers.join(asked.select(F.col("pid").alias("paper_id")).distinct(), "paper_id", "left_semi"), "paper_id", sections, carry=["title"])
    found = find_matches(own, sources, asked.select("query_id", F.col("pid").alias("paper_id")), fuzzy=False)
    return found.select("query_id", "source_paper_id", "input_segment_id", "source_segment_id", "match_type", "match_score", "ngram_overlap", "word_count")


def _segment_matches_sql() -> str:
    paragraph = f"list_filter(list_transform(regexp_split_to_array(t, {sql(chr(92) + 'n' + chr(92) + 's*' + chr(92) + 'n')}), lambda p: {C._strip('p')}), lambda p: p <> '')"
    parts = " UNION ALL ".join(
        f"SELECT paper_id, '{name}_seg_' || (i - 1) AS seg, ps[i] AS text FROM (SELECT paper_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT paper_id, {paragraph} AS ps FROM (SELECT paper_id, {name} AS t FROM p WHERE {name} IS NOT NULL)))" for name in ("introduction", "body")
    )
    plain = f"trim(regexp_replace(lower(text), '[{SPACE}]+', ' ', 'g'))"
    return f"""WITH {_MATES}, p AS ({_papers_sql('introduction', 'body')}),
      s AS (SELECT paper_id, seg, n, {plain} AS plain, {C._shingles('text')} AS sh FROM (SELECT *, {C._words('text')} AS n FROM ({parts})) WHERE n >= {K.MIN_SEGMENT_WORDS}),
      c AS (SELECT query_id, b.paper_id AS source_paper_id, a.seg AS input_segment_id, b.seg AS source_segment_id, a.n, a.plain = b.plain AS same, CASE WHEN len(a.sh) > 0 THEN len(list_intersect(a.sh, b.sh)) / len(a.sh) ELSE 0.0 END AS o
        FROM mates JOIN s a ON a.paper_id = query_id JOIN s b ON b.paper_id = candidate WHERE least(a.n, b.n) >= {K.SMALL_MATCH_WORDS} AND greatest(a.n, b.n) <= {K.SEGMENT_RATIO} * least(a.n, b.n))
      SELECT query_id, source_paper_id, input_segment_id, source_segment_id, CASE WHEN same THEN 'exact' ELSE 'ngram' END AS match_type, CASE WHEN same THEN 1.0::DOUBLE ELSE o END AS match_score, o AS ngram_overlap, n::INTEGER AS word_count FROM c WHERE same OR o >= {K.NGRAM_THRESHOLD}::DOUBLE"""


_QUERIES = {
    jsonl_dump: JSONL_DUMP, json_lines: JSON_LINES, chunks_of_papers: CHUNKS_OF_PAPERS, lookup_rows: LOOKUP_ROWS, pending_files: PENDING_FILES, stored_paths: STORED_PATHS, web_articles: WEB_ARTICLES, web_links: WEB_LINKS,
    bronze_rows: BRONZE_ROWS, text_parts: _text_parts_sql(), title_ratios: TITLE_RATIOS, clean_offline_plain: _clean_offline_sql(), clean_online_plain: _clean_online_sql(), paper_mates: PAPER_MATES, paper_probe: PAPER_PROBE, index_self_probe: INDEX_SELF_PROBE,
    top_pairs: TOP_PAIRS, index_config: INDEX_CONFIG, ml_tokens: ML_TOKENS, ml_shingles: ML_SHINGLES, table_pairs: TABLE_PAIRS, cited_sources: CITED_SOURCES, exclusions: EXCLUSIONS, exclusion_totals: EXCLUSION_TOTALS, exclusion_reasons: EXCLUSION_REASONS,
    span_scores: SPAN_SCORES, span_sources: SPAN_SOURCES, shown_matches: SHOWN_MATCHES, layer_one: LAYER_ONE, layer_two: LAYER_TWO, layer_three: LAYER_THREE, layer_four: _layer_four_sql(), layer_five: LAYER_FIVE, ranked_papers: RANKED_PAPERS,
    segment_matches: _segment_matches_sql(),
}


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def _ingest_sql() -> str:
    tokens = f"len(regexp_extract_all(lower(clean_text), '[{WORD}]{{2,}}'))"
    return f"""SELECT DISTINCT c.file_path, t.word_count AS word_count_raw, word_count_clean, quality_flag, md5(clean_text) AS clean_md5, CASE WHEN length(clean_text) > 200 AND {tokens} >= {K.SHINGLE_WORDS} THEN {K.BANDS} ELSE 0 END::BIGINT AS bands
      FROM ({_clean_offline_sql()}) c JOIN (SELECT file_path, min(word_count) AS word_count FROM arxiv_text_parquet GROUP BY file_path) t ON t.file_path = c.file_path"""


def oracle_sql() -> dict[str, str]:
    return {f.__name__: text for f, text in _QUERIES.items()} | {"incremental_ingest": _ingest_sql()}
