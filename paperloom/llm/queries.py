"""The pN_ queries of the training-data operators and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.rx import SPACE, WORD
from paperloom.llm.encode import encode_texts
from paperloom.llm.markup import strip_markup
from paperloom.llm.near_copies import copy_groups, near_copies, similar_pairs, sketch_states
from paperloom.llm.packing import pack_documents
from paperloom.llm.quality import quality_findings, text_statistics
from paperloom.llm.repetition import repetition
from paperloom.llm.scan_repair import page_texts, repair_pages
from paperloom.llm.shared_spans import compact, shared_spans, span_runs
from paperloom.llm.splitting import split_texts
from paperloom.plans.catalogue import signature_sql
from paperloom.session import cut_lineage, table


CHUNK_KEY = "concat(paper_id, '_', chunk_id)"


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = split_texts(table(spark, sf_dir, "chunks_sample"), "chunk", CHUNK_KEY, "chunk_text")
    return chunks.unionByName(split_texts(table(spark, sf_dir, "arxiv_silver_plus"), "introduction", "paper_id", "introduction"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that came out in more than one piece."""
    whole = p1_pieces(spark, sf_dir).groupBy("src", "item_key", "cut").agg(F.max("piece_no").alias("last"))
    return whole.filter("last > 0").select("src", "item_key", "cut")


def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = page_texts(table(spark, sf_dir, "arxiv_text_parquet"), table(spark, sf_dir, "arxiv_silver_plus"))
    return repair_pages(pages, "file_path", "text")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_repaired(spark, sf_dir).select("file_path", F.explode("damage").alias("damage")).distinct()


def p3_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = table(spark, sf_dir, "arxiv_silver_plus").select(F.lit("body").alias("src"), F.col("paper_id").alias("item_key"), F.col("body").alias("text"))
    chunks = table(spark, sf_dir, "chunks_sample").select(F.lit("chunk").alias("src"), F.expr(CHUNK_KEY).alias("item_key"), F.col("chunk_text").alias("text"))
    return shared_spans(bodies.unionByName(chunks))


def p3_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks in two batches, each held against the history of the other; the rows are those of one batch.

    A chunk's key decides its batch, so its rows stay together.
    """
    chunks = table(spark, sf_dir, "chunks_sample").select(F.lit("chunk").alias("src"), F.expr(CHUNK_KEY).alias("item_key"), F.col("chunk_text").alias("text"))
    batch = F.pmod(F.xxhash64("item_key"), F.lit(2))
    out = []
    for own in (0, 1):
        history = compact(cut_lineage(span_runs(chunks.filter(batch != own), 0)))
        out.append(shared_spans(chunks.filter(batch == own), history=history))
    return out[0].unionByName(out[1])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_spans(spark, sf_dir).filter("n_spans > 0").select("src", "item_key")


def _common_words(spark: SparkSession, sf_dir: str) -> list[str]:
    """A fixed reference list of 245 words."""
    return [r[0] for r in table(spark, sf_dir, "common_words").select("word").filter("word is not null").collect()]


def p4_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_statistics(table(spark, sf_dir, "arxiv_silver_plus"), "paper_id", "clean_text", _common_words(spark, sf_dir), ["word_count_clean", "quality_flag"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_findings(table(spark, sf_dir, "arxiv_silver_plus"), table(spark, sf_dir, "common_words"))


def p5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _common_words(spark, sf_dir)
    papers = strip_markup(table(spark, sf_dir, "arxiv_silver_plus"), "clean_text", "paper_id", "clean_text", words)
    return papers.unionByName(strip_markup(table(spark, sf_dir, "arxiv_metadata_sample"), "abstract", "doc_id", "abstract", words))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_clean(spark, sf_dir).select("src", "item_key", F.explode("markup").alias("markup")).distinct()


#: TESTDATA.md sets the similarity of problem 6.
P6_SIMILARITY = 0.5


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, links = near_copies(table(spark, sf_dir, "arxiv_silver_plus"), "paper_id", "clean_text", P6_SIMILARITY)
    return copy_groups(members, links).withColumnRenamed("key", "paper_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, links = near_copies(table(spark, sf_dir, "arxiv_silver_plus"), "paper_id", "clean_text", P6_SIMILARITY)
    return similar_pairs(members, links).withColumnsRenamed({"key_a": "paper_a", "key_b": "paper_b"})


def p6_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the stored signatures are those of the papers' texts."""
    return sketch_states(table(spark, sf_dir, "arxiv_silver_plus"), table(spark, sf_dir, "minhash_signatures"), "paper_id", "clean_text", "signature")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents")).withColumnRenamed("n_units", "n_tokens")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text lies in more than one container."""
    spread = pack_documents(table(spark, sf_dir, "documents")).groupBy("doc_id")
    return spread.agg(F.min("container_id").alias("low"), F.max("container_id").alias("high")).filter("low < high").select("doc_id")


def p9_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(table(spark, sf_dir, "documents")).filter("repeated").select("doc_id")


def queries() -> dict:
    return {f.__name__: f for f in (p1_pieces, p1_found, p2_repaired, p2_found, p3_spans, p3_incremental, p3_found, p4_statistics, p4_found, p5_clean, p5_found, p6_groups, p6_sketches, p6_found, p7_ids, p8_containers, p8_found, p9_repetition, p9_found)}


_WHITE = SPACE


def _texts_sql(other: str, nulls: bool = False) -> str:
    """Texts of a column of the papers and of the chunks, each once, without white space at both ends, with or without nulls."""
    return f"""
      SELECT DISTINCT src, item_key, regexp_replace(t, '^[{_WHITE}]+|[{_WHITE}]+\\z', '', 'g') AS t FROM (
        SELECT '{other}' AS src, paper_id AS item_key, {other} AS t FROM arxiv_silver_plus
        UNION ALL SELECT 'chunk', paper_id || '_' || chunk_id, chunk_text FROM chunks_sample){'' if nulls else ' WHERE t IS NOT NULL'}"""


def _spans_sql(texts: str) -> str:
    """Shared spans of texts(src, item_key, t) by every window of 300."""
    return f"""WITH x AS (SELECT row_number() OVER () AS r, * FROM ({texts})),
      w AS (SELECT r, src, item_key, i, md5(substr(t, i, 300)) AS h FROM (SELECT r, src, item_key, t, unnest(range(1, length(t) - 298)) AS i FROM x WHERE length(t) >= 300)),
      s AS (SELECT src, h FROM w GROUP BY src, h HAVING count(DISTINCT item_key) > 1),
      g AS (SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) AS step FROM w JOIN s ON w.src = s.src AND w.h = s.h),
      c AS (SELECT r, sum(coalesce(least(step, 300), 300))::BIGINT AS shared_chars, count_if(step IS NULL OR step > 300)::BIGINT AS n_spans FROM g GROUP BY r),
      f AS (SELECT src, item_key, max({{'a': coalesce(shared_chars, 0), 'b': coalesce(length(t), 0), 'c': coalesce(n_spans, 0)}}) AS best FROM x LEFT JOIN c ON x.r = c.r GROUP BY src, item_key)
      SELECT src, item_key, best.b AS n_chars, best.a AS shared_chars, best.c AS n_spans, CASE WHEN best.b > 0 THEN best.a / best.b ELSE 0.0 END AS shared_share FROM f"""


def oracle_sql() -> dict[str, str]:
    """SQL for what SQL can say; the other operators are tested by brute force, exact round trips or held-out accuracy."""
    return {
        "p1_found": f"""WITH x AS ({_texts_sql('introduction')})
          SELECT DISTINCT src, item_key, CASE WHEN list_max(list_transform(regexp_split_to_array(t, '[{_WHITE}]+'), lambda w: length(w))) > 1200 THEN 'forced' ELSE 'boundary' END AS cut FROM x WHERE length(t) > 1200""",
        "p3_found": f"""WITH x AS ({_texts_sql('body')}),
          w AS (SELECT DISTINCT src, item_key, md5(substr(t, i, 300)) AS h FROM (SELECT src, item_key, t, unnest(range(1, length(t) - 298)) AS i FROM x WHERE length(t) >= 300)),
          s AS (SELECT src, h FROM w GROUP BY src, h HAVING count(*) > 1)
          SELECT DISTINCT w.src, item_key FROM w JOIN s ON w.src = s.src AND w.h = s.h""",
        "p3_spans": _spans_sql(_texts_sql("body", True)),
        "p3_incremental": _spans_sql(f"SELECT * FROM ({_texts_sql('body', True)}) WHERE src = 'chunk'"),
        "p6_found": f"""WITH t AS (SELECT DISTINCT paper_id, regexp_extract_all(lower(clean_text), '[{WORD}]{{2,}}') AS w FROM arxiv_silver_plus WHERE clean_text IS NOT NULL),
          s AS (SELECT DISTINCT paper_id, md5(array_to_string(w[i:i+4], ' ')) AS h FROM (SELECT paper_id, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5)),
          n AS (SELECT paper_id, count(*) AS n FROM s GROUP BY paper_id),
          p AS (SELECT a.paper_id AS paper_a, b.paper_id AS paper_b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.paper_id < b.paper_id GROUP BY ALL)
          SELECT paper_a, paper_b FROM p JOIN n x ON x.paper_id = paper_a JOIN n y ON y.paper_id = paper_b WHERE c / (x.n + y.n - c) >= 0.5""",
        "p6_sketches": f"""WITH {signature_sql("SELECT DISTINCT md5(clean_text) AS id, clean_text AS t FROM arxiv_silver_plus WHERE clean_text IS NOT NULL")},
          o AS (SELECT paper_id, sig.signature AS own FROM arxiv_silver_plus p LEFT JOIN sig ON sig.id = md5(clean_text) WHERE paper_id IS NOT NULL),
          b AS (SELECT o.paper_id, CASE WHEN m.paper_id IS NULL THEN 5 WHEN own IS NULL THEN 4 WHEN signature IS NULL THEN 3 WHEN len(signature) <> 128 THEN 2 WHEN signature::BIGINT[] <> own::BIGINT[] THEN 1 ELSE 0 END AS n FROM o LEFT JOIN minhash_signatures m ON m.paper_id = o.paper_id)
          SELECT paper_id, (['fresh', 'stale', 'cut', 'null', 'unsigned', 'missing'])[min(n) + 1] AS state FROM b GROUP BY paper_id""",
        "p9_found": f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[^{_WHITE}]+') AS w FROM documents WHERE text IS NOT NULL),
          g AS (SELECT doc_id, n, i, count(*) OVER (PARTITION BY doc_id, h) AS c FROM (SELECT doc_id, len(w) AS n, i, md5(array_to_string(w[i:i+7], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM t WHERE len(w) >= 8))),
          m AS (SELECT DISTINCT doc_id, n, unnest(range(i, i + 8)) AS at FROM g WHERE c > 1)
          SELECT doc_id FROM m GROUP BY doc_id, n HAVING count(*) / n >= 0.3::DOUBLE""",
    }
