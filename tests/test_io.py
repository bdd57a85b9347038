import http.server
import json
import os
import re
import threading
import zipfile

import numpy as np
from pyspark.sql import functions as F

from paperloom.functions.register import register
from paperloom.operators import lsh, metadata, vectors
from paperloom.sources import fetch, readers, web, writers
from paperloom.streaming.ingest import ingest


def test_jsonl_lines_and_parts(spark, tmp_path):
    rows = [{"id": f"{i}", "title": f"t{i}"} for i in range(12)]
    (tmp_path / "dump.jsonl").write_text("\n".join(json.dumps(r) for r in rows))
    path = str(tmp_path / "dump.jsonl")
    df = readers.read_jsonl(spark, path, metadata.RAW_SNAPSHOT, ["id", "title"])
    assert df.count() == 12 and df.columns == ["id", "title"]
    assert [json.loads(r["value"])["id"] for r in readers.line_range(spark, path, 3, 6).orderBy("line_no").collect()] == ["3", "4", "5"]
    writers.write_parts(df.coalesce(1), str(tmp_path / "parts"), rows=5)
    assert len(list((tmp_path / "parts").glob("*.parquet"))) == 3
    writers.write_partitioned(df.withColumn("k", F.col("id") % 2), str(tmp_path / "by"), ["k"])
    assert readers.read_parquet(spark, str(tmp_path / "by"), ["id"], spark.createDataFrame([("3",)], "id string"), "id").collect()[0][0] == "3"
    writers.write_jsonl(df, str(tmp_path / "out"))
    writers.write_jsonl(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 24


def test_files_and_pages(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"p{i}.pdf").write_bytes(b"%broken" if i == 2 else (f"word{i} " * 20).encode())
    (tmp_path / "x.txt").write_text("no")
    audit = readers.storage_audit(readers.list_files(spark, str(tmp_path))).first()
    assert audit["n_files"] == 3 and audit["n_bytes"] == sum(f.stat().st_size for f in tmp_path.glob("*.pdf"))

    def parse(content):
        if content.startswith(b"%"):
            raise ValueError("broken")
        return [content.decode(), "end"]

    assert readers.extract_pages(spark, str(tmp_path), parse).count() == 2
    kept = readers.extract_pages(spark, str(tmp_path), parse, keep_failed=True)
    assert kept.filter("error IS NOT NULL").count() == 1
    assert readers.pending(readers.list_files(spark, str(tmp_path)).withColumnRenamed("path", "file_path"), kept.select("file_path")).count() == 0


def test_web(spark):
    page = "<html><a href='/p/one'>1</a><a class='x' href=\"/p/two\">2</a><a href='/q'>3</a><h1 class='article-content__title'>A &amp; B</h1><div class='article-content__body'><p>Text<br>more</p><script>bad()</script><div>in <b>side</b></div></div><div>after</div></html>"
    pages = spark.createDataFrame([("u1", page), ("u2", "<h1>none</h1>"), ("u3", None)], "url string, html string")
    got = {r[0] for r in web.links(pages, "html", "/p/", "http://s", spark.createDataFrame([("http://s/p/two",)], "url string")).collect()}
    assert got == {"http://s/p/one"}
    out = web.articles(pages, "url", "html").collect()
    assert [(r["url"], r["title"], r["content"]) for r in out] == [("u1", "A & B", "Text\nmore\nin\nside")]


def test_ingest_takes_each_file_once(spark, tmp_path):
    text = "words of a page that goes on and on in the same way " * 40
    make = lambda *ids: spark.createDataFrame([(f"x/arxiv_{i}.pdf", text, 480) for i in ids], "file_path string, text string, word_count bigint")
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    make(1, 2, 2).coalesce(1).write.mode("append").parquet(source)
    ingest(spark, source, target, state)
    make(3).coalesce(1).write.mode("append").parquet(source)
    ingest(spark, source, target, state)
    ingest(spark, source, target, state)
    assert sorted(r["paper_id"] for r in spark.read.parquet(target + "/cleaned").collect()) == ["arxiv_1.pdf", "arxiv_2.pdf", "arxiv_3.pdf"]
    assert spark.read.parquet(target + "/buckets").groupBy("paper_id").count().filter("count = 25").count() == 3


def test_catalogue_names():
    from paperloom.plans import catalogue

    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


def test_line_range_over_several_files(spark, tmp_path):
    lines = [f"line {i}" for i in range(500)]
    for n in range(5):
        (tmp_path / f"part-{n}.txt").write_text("\n".join(lines[100 * n : 100 * (n + 1)]) + "\n")
    for start, end in ((0, 3), (95, 305), (499, 600), (600, 700)):
        got = readers.line_range(spark, str(tmp_path), start, end).orderBy("line_no").collect()
        assert [(r["line_no"], r["value"]) for r in got] == [(i, lines[i]) for i in range(start, min(end, 500))]


def test_zipped_lines(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "dump.zip", "w") as packed:
        packed.writestr("a.jsonl", "\n".join(json.dumps({"id": f"{i}", "title": "é"}) for i in range(50)) + "\n")
        packed.writestr("b.jsonl", json.dumps({"id": "x"}) + "\n\n")
    df = readers.read_jsonl_zip(spark, str(tmp_path), metadata.RAW_SNAPSHOT, ["id", "title"])
    assert {(r["id"], r["title"]) for r in df.collect()} == {(f"{i}", "é") for i in range(50)} | {("x", None)}


def test_pages_of_a_checked_text_and_paths(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.pdf").write_bytes(b"  few words ")
    (tmp_path / "two.pdf").write_bytes(b"more")
    out = readers.extract_pages(spark, str(tmp_path), lambda c: [c.decode(), "end"], least_words=None).filter("file_path like '%one.pdf'").first()
    assert out["text"] == "  few words \nend" and [tuple(p) for p in out["pages"]] == [(1, "  few words "), (2, "end")] and out["page_count"] == 2 and out["word_count"] == 3
    names = spark.createDataFrame([("one.pdf",), ("none.pdf",)], "paper_id string")
    found = readers.storage_paths(names, readers.list_files(spark, str(tmp_path))).collect()
    assert [r["paper_id"] for r in found] == ["one.pdf"] and found[0]["path"].endswith("/a/one.pdf")


def test_lookup_reads_only_the_candidates_partitions(spark, tmp_path):
    rows = [(f"arxiv_{p}.{i:05d}.pdf", i) for p in ("0704", "2101", "2102", "2103") for i in range(20)] + [("x", 1)]
    table = lsh.lookup_table(spark.createDataFrame(rows, "paper_id string, n int"))
    writers.write_partitioned(table, str(tmp_path / "lookup"), ["pid_prefix"])
    lookup = readers.read_lookup(spark, str(tmp_path / "lookup"))
    candidates = spark.createDataFrame([("arxiv_0704.00003.pdf",), ("arxiv_2103.00007",), ("abc",), (None,)], "candidate string")
    found = lsh.look_up(candidates, lookup)
    assert sorted(r["paper_id"] for r in found.collect()) == ["arxiv_0704.00003.pdf", "arxiv_2103.00007.pdf"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*pid_prefix#\d+ IN \((0704,2103|2103,0704)\)", plan), plan
    assert lsh.look_up(candidates, lookup, most=1).count() == 1


def test_vector_index_description_and_preview(spark):
    vecs = spark.createDataFrame([(1, [0.5, 0.5]), (2, None)], "vec_id int, v array<double>")
    assert json.loads(writers.vector_index_description(vecs, "v", "m", "exact", ["abstract"]).first()[0]) == {"model": "m", "dim": 2, "n": 1, "type": "exact", "sections": ["abstract"]}
    assert [r["vec_id"] for r in writers.preview(vecs.select("vec_id"), 1, ["vec_id"])] == [1]


def test_page_of_a_report():
    match = {"match_type": "exact", "match_score": 1.0, "source_paper_id": "p1", "validity": "EXCLUDED", "exclusion_reasons": ["small_match"], "input_text": "<b>" + "x" * 1300, "source_text": None, "word_count": 7}
    source = {"rank": 1, "source_paper_id": "arxiv_1.pdf", "source_title": "A & B", "matched_words": 5, "contribution_percent": 45.0, "risk_level": "Very High", "abs_url": "https://arxiv.org/abs/1", "pdf_url": "https://arxiv.org/pdf/1"}
    page = writers.render_html({"overall_similarity": 41.234, "risk_level": "Very High", "matched_words": 3, "total_words": 9, "candidate_count": 4, "top_sources": [source], "matches": [match, match | {"validity": "VALID", "exclusion_reasons": []}]})
    for part in ("41.23 %", "3/9", "A &amp; B", "<td class='high'>Very High</td>", "https://arxiv.org/abs/1", "https://arxiv.org/pdf/1", "&lt;b&gt;" + "x" * 1197 + "...", "<td>small_match</td><td>1</td>", "<div>Valid</div><b>1</b>", "<div>Words in excluded</div><b>7</b>", "<div>Candidates</div><b>4</b>"):
        assert part in page, part
    assert "No sources" in writers.render_html({})


class _Site(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        found = self.path in ("/a.pdf", "/page")
        self.send_response(200 if found else 404)
        self.send_header("Content-Type", "application/pdf" if self.path == "/a.pdf" else "text/html")
        self.end_headers()
        self.wfile.write(b"%PDF words" if found else b"no")

    def log_message(self, *args):
        pass


def test_fetch_and_copy(spark, tmp_path):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    folder = tmp_path / "files"
    rows = [(f"{base}/a.pdf", "a.pdf"), (f"{base}/page", "b.pdf"), (f"{base}/none", "c.pdf"), (None, "d.pdf"), ("http://127.0.0.1:9/x", "e.pdf"), (f"{base}/a.pdf", "../f.pdf")]
    urls = spark.createDataFrame(rows, "url string, name string").coalesce(1)
    out = {r["name"]: r for r in fetch.fetch(urls, str(folder), tries=2, backoff=0.01).collect()}
    assert {n: r["status"] for n, r in out.items()} == {"a.pdf": "SUCCESS", "b.pdf": "ERROR", "c.pdf": "ERROR", "d.pdf": "ERROR", "e.pdf": "ERROR", "../f.pdf": "ERROR"}
    assert os.listdir(folder) == ["a.pdf"] and out["a.pdf"]["n_bytes"] == 10 and "404" in out["c.pdf"]["error"]
    again = readers.status_tally(fetch.fetch(urls, str(folder), tries=1)).collect()
    assert {r["status"]: r["count"] if "count" in r else r["n"] for r in again} == {"SKIPPED": 1, "ERROR": 5}
    server.shutdown()
    assert fetch.copy_if_absent(spark, str(folder), str(tmp_path / "copy")) and (tmp_path / "copy" / "a.pdf").read_bytes() == b"%PDF words"
    assert not fetch.copy_if_absent(spark, str(folder), str(tmp_path / "copy"))


def test_functions_known_to_sql(spark):
    assert register(spark) == ["indel_ratio", "minhash_signature", "nfkc", "sequence_ratio"]
    r = spark.sql("SELECT indel_ratio('abcd', 'abxd') AS a, sequence_ratio('abcd', 'bcde') AS b, nfkc('ﬁ²') AS c, minhash_signature('one two three four five six') AS d, minhash_signature('one') AS e").first()
    assert r["a"] == 0.75 and r["b"] == 0.75 and r["c"] == "fi2" and len(r["d"]) == 128 and r["e"] is None


def test_embeddings_of_a_given_model(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None), (3, ""), (4, "abcd")], "doc_id bigint, text string")
    out = {r["doc_id"]: r["embedding"] for r in vectors.embed(df, "doc_id", "text", lambda texts: np.array([[len(t), 1.0] for t in texts]), size=1).collect()}
    assert out == {1: [2.0, 1.0], 2: None, 3: None, 4: [4.0, 1.0]}
