import json

from pyspark.sql import functions as F

from paperloom.operators import exclusion as E
from paperloom.operators import layers as L
from paperloom.operators import metadata, scoring
from paperloom.operators.matching import comparable, find_matches, make_segments
from paperloom.plans import pipeline
from paperloom.operators.lsh import sign
from paperloom.sources import writers

WORDS = " ".join(f"word{i}" for i in range(30))


def _matches(spark, **over):
    base = dict(query_id="q", input_section="body", source_section="body", input_text=WORDS, source_text=WORDS, word_count=30, source_title="", source_paper_id="", input_near_citation=False, input_is_quote=False, references_text="")
    return spark.createDataFrame([base | over])


def test_each_reason(spark):
    cases = [
        (dict(), []),
        (dict(word_count=9), ["small_match"]),
        (dict(source_section="References"), ["reference_section"]),
        (dict(input_text="[12] Some entry"), ["reference_like_text"]),
        (dict(input_text='"quoted [3] words"'), ["quoted_and_cited"]),
        (dict(source_text="All rights reserved"), ["metadata_or_boilerplate"]),
        (dict(input_text="+-=/*" * 10 + " a"), ["symbol_heavy_short_formula"]),
        (dict(word_count=9, input_text="12. Title copyright"), ["small_match", "reference_like_text", "metadata_or_boilerplate"]),
    ]
    for over, want in cases:
        r = E.apply_exclusion(_matches(spark, **over)).first()
        assert r["exclusion_reasons"] == want and r["excluded"] == bool(want) and r["validity"] == ("EXCLUDED" if want else "VALID")


def test_source_cited_modes(spark):
    over = dict(source_paper_id="arxiv_1234.5.pdf", references_text="[1] Something else")
    assert E.apply_exclusion(_matches(spark, **over)).first()["source_cited"]
    assert not E.apply_exclusion(_matches(spark, **over), mode="strict").first()["source_cited"]
    assert E.apply_exclusion(_matches(spark, **(over | dict(references_text="see arXiv:1234.5"))), mode="strict").first()["source_cited"]
    assert not E.apply_exclusion(_matches(spark, **(over | dict(references_text="")))).first()["source_cited"]


def test_citations(spark):
    texts = [("[1-3]", True), ("[1, 2]", True), ("(Smith, 2020a)", True), ("(Smith and Jones, 2020)", True), ("(Smith et al., 2020)", True), ("(see 2020)", False), (None, False)]
    got = spark.createDataFrame([(t,) for t, _ in texts], "t string").select(E.has_inline_citation(F.col("t"))).collect()
    assert [r[0] for r in got] == [w for _, w in texts]


def test_intervals_and_risk(spark):
    rows = [("a", 0, 5), ("a", 5, 9), ("a", 2, 3), ("a", 20, 30), ("a", 20, 30), ("b", 1, 2)]
    got = {tuple(r) for r in scoring.merge_intervals(spark.createDataFrame(rows, "k string, start int, end int"), ["k"]).collect()}
    assert got == {("a", 0, 9), ("a", 20, 30), ("b", 1, 2)}
    levels = spark.createDataFrame([(9.99,), (10.0,), (25.0,), (40.0,)], "s double").select(scoring.risk_level(F.col("s"))).collect()
    assert [r[0] for r in levels] == ["Low", "Medium", "High", "Very High"]


def test_length_rule(spark):
    df = spark.createDataFrame([(10, 30), (10, 31), (9, 10)], "a int, b int")
    assert [r[0] for r in df.select(comparable(F.col("a"), F.col("b"))).collect()] == [True, False, False]


def test_match_kinds(spark):
    near = WORDS.replace("word7", "wordx")
    edited = " ".join(w if i % 4 else w[:-1] + "q" for i, w in enumerate(WORDS.split()))
    inputs = make_segments(spark.createDataFrame([("q", WORDS)], "query_id string, body string"), "query_id", [("body", "body")])
    papers = spark.createDataFrame([("same", WORDS.upper(), "t"), ("near", near, "t"), ("edited", edited, "t"), ("none", "other text here " * 10, "t"), ("null", None, "t")], "paper_id string, body string, title string")
    sources = make_segments(papers, "paper_id", [("body", "body")], carry=["title"])
    candidates = papers.select(F.lit("q").alias("query_id"), "paper_id")
    got = {r["source_paper_id"]: r for r in find_matches(inputs, sources, candidates).collect()}
    assert {k: r["match_type"] for k, r in got.items()} == {"same": "exact", "near": "ngram", "edited": "fuzzy"}
    assert got["same"]["match_score"] == 1.0 and 0.6 <= got["near"]["match_score"] < 1 and got["edited"]["match_score"] >= 0.85


def test_check_end_to_end(spark):
    para = lambda s: " ".join(f"{s}{i} token" for i in range(40))
    papers = spark.createDataFrame([("p1", "T1", "", para("a") + "\n\n" + para("b")), ("p2", "T2", "", para("c"))], "paper_id string, title string, introduction string, body string").withColumn("clean_text", F.col("body"))
    queries = spark.createDataFrame([("q1", para("a") + "\n\n" + para("b")), ("q2", para("z")), ("q3", None)], "query_id string, raw_text string")
    made = pipeline.check(queries, sign(papers, "paper_id", "clean_text"), papers)
    scores = {r["query_id"]: r for r in made.scores.collect()}
    assert scores["q1"]["overall_similarity"] == 100.0 and scores["q1"]["risk_level"] == "Very High" and scores["q2"]["overall_similarity"] == 0.0 and scores["q3"]["total_words"] == 0
    assert [(r["source_paper_id"], r["rank"]) for r in made.sources.collect()] == [("p1", 1)]
    report = {r["query_id"]: json.loads(r["report"]) for r in writers.reports(made.scores, made.sources, made.matches).collect()}
    assert report["q1"]["top_sources"][0]["source_paper_id"] == "p1" and "<h1>" in writers.render_html(report["q1"])


def test_candidates_after_the_fiftieth(spark):
    para = lambda s: " ".join(f"{s}{i} token" for i in range(60))
    copies = [(f"a{i:02}", f"T{i}", "", para("a") + "\n\n" + para("b")) for i in range(55)]
    papers = spark.createDataFrame([*copies, ("zz", "Z", "", para("a") + "\n\n" + para("b") + "\n\n" + para("c"))], "paper_id string, title string, introduction string, body string").withColumn("clean_text", F.col("body")).withColumn("abstract", F.lit(None).cast("string"))
    text = para("a") + "\n\n" + para("b")
    signed = sign(papers, "paper_id", "clean_text")
    made = pipeline.check(spark.createDataFrame([("q1", text), ("a00", text)], "query_id string, raw_text string"), signed, papers)
    got = {}
    for r in made.sources.collect():
        got.setdefault(r["query_id"], {})[r["source_paper_id"]] = (r["source_title"], r["contribution_percent"])
    every = {p: (t, 100.0) for p, t, _, _ in copies} | {"zz": ("Z", 100.0)}
    assert got["q1"] == every
    assert got["a00"] == {k: v for k, v in every.items() if k != "a00"}  # its equals are sources, itself isn't
    queries = spark.createDataFrame([("q1", text, "T", "", ["Ann Doe"])], "query_id string, clean_text string, title string, abstract string, authors array<string>")
    authors = papers.withColumn("authors", F.when(F.col("paper_id") == "zz", F.array(F.lit("Ann Doe"))).otherwise(F.array(F.lit("Jo Roe"))))
    none = spark.createDataFrame([], "query_id string, pid string, cosine double")
    r = pipeline.verdict(queries, signed, authors, none).first()
    assert r["l1"] == 1.0 and r["l5"] > 0.5 and r["self_overlap"]


def test_verdict_borders(spark):
    rows = [(0.0, 0.0, 0.0, 0.0, 0.0), (1.0, 1.0, 1.0, 1.0, 1.0), (0.04, 0.0, 1.0, 0.0, 0.6), (0.5, 0.2, 0.4, 0.0, 0.0), (0.0, 0.0, 0.5, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "l1 double, l2 double, l3 double, l4 double, l5 double")
    got = [(r["verdict"], r["confidence"], r["self_overlap"]) for r in df.withColumns(L.verdict_columns(*(F.col(f"l{i}") for i in range(1, 6)))).collect()]
    assert got == [("CLEAN", "LOW", False), ("PLAGIARISM", "HIGH", True), ("HIGHLY SUSPICIOUS", "MEDIUM", True), ("SUSPICIOUS", "HIGH", False), ("SIMILAR", "LOW", False)]


def test_metadata(spark):
    raw = spark.createDataFrame([("hep-th/9901001", " A\ntitle ", None, [["Doe", "Jane", ""], ["Solo", ""]], "cs.LG cs.AI", "2020-01-01", None)], metadata.RAW_SNAPSHOT)
    r = metadata.normalise_metadata(raw, "now", "d").first()
    assert (r["doc_id"], r["title"], r["abstract"], r["authors"], r["categories"], r["doi"]) == ("arxiv_hep-th_9901001", "A title", "", ["Jane Doe", "Solo"], ["cs.LG", "cs.AI"], None)
    paths = spark.createDataFrame([("gs://x/arxiv_1.2v3.pdf",), ("gs://x/other.pdf",), (None,)], "p string")
    assert [x[0] for x in paths.select(metadata.join_key(F.col("p"))).collect()] == ["arxiv_1.2", "", None]
