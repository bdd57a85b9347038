import random

from paperloom.llm import quality as Q

COMMON = ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "with", "was", "on"]
PROSE = "The order of the graph is the same as in the last case, and it was shown that the limit holds for a set of points. "
LIST = "\n".join(f"• sparse kernel number{i}" for i in range(60))
TABLE = "\n".join(f"run{i} 3.{i} 17% {i * 7} 0.5" for i in range(60))
JUNK = "\n".join("(cid:12) (cid:33) �� � the (cid:4)" for _ in range(60))


def _kind(spark, *texts, chunk=Q.CHUNK_CHARS):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "paper_id string, clean_text string")
    rows = {r["paper_id"]: r for r in Q.text_statistics(df, "paper_id", "clean_text", COMMON, chunk_chars=chunk).collect()}
    return [rows[str(i)] for i in range(len(texts))]


def test_kinds(spark):
    broken = "\n".join((PROSE * 5).split())
    got = [r["kind"] for r in _kind(spark, PROSE * 8, LIST, TABLE, JUNK, broken, LIST[:300] + "\n" + PROSE * 20, LIST + "\n" + PROSE, "", None, "k e r n e l s a r e h e r e " * 20)]
    assert got == ["prose", "list", "table", "junk", "prose", "prose", "list", "prose", None, "junk"]


def test_partials_are_associative():
    draw = random.Random(4)
    kinds = Q._Kinds(frozenset(COMMON))
    for _ in range(60):
        text = "".join(draw.choice(["The word. ", "\n", "x", " ", "12.5 ", "\n\n", "€ ", "• item\n", "réseau ", "\u2003"]) for _ in range(draw.randint(1, 120)))
        whole = Q.count_chunk(text, kinds).finish()
        assert whole[0] == len(text.split())
        cuts = sorted(draw.randrange(len(text) + 1) for _ in range(draw.randint(0, 6)))
        parts = [Q.count_chunk(text[a:b], kinds) for a, b in zip([0, *cuts], [*cuts, len(text)])]
        left = Q.Partial()
        for p in parts:
            left = left.add(p)
        right = Q.Partial()
        for p in reversed(parts):
            right = p.add(right)
        assert left.finish() == right.finish()
        exact = [0, 1, 2, 3, 4, 10, 11]
        assert [left.finish()[i] for i in exact] == [whole[i] for i in exact]


def test_huge_text_is_as_its_chunks(spark):
    text = (PROSE * 3 + "\n" + LIST + "\n") * 4
    a, b = _kind(spark, text)[0], _kind(spark, text, chunk=1 << 9)[0]
    for c in ("words", "chars", "mean_word_length", "symbol_ratio", "ended_lines", "kind"):
        assert a[c] == b[c]


def test_findings(spark):
    rows = [("ok", PROSE * 20, 10**9, 480, "x"), ("null", None, 1, 1, "ok"), ("empty", "", 10, 0, "empty"), ("count", PROSE * 25, 700, 7, "ok"), ("nulls", PROSE * 2, None, None, None), ("dup", LIST, 200, 240, "empty"), ("dup", LIST, 200, 240, "empty")]
    df = spark.createDataFrame([(*r, "kind", 5) for r in rows], "paper_id string, clean_text string, word_count_raw bigint, word_count_clean bigint, quality_flag string, kind string, words int")
    n = len((PROSE * 20).split())
    out = {tuple(r) for r in Q.quality_findings(df, spark.createDataFrame([(w,) for w in COMMON] + [(None,)], "word string")).collect()}
    assert ("ok", "wrong_flag") in out and (("ok", "wrong_count") in out) == (n != 480)
    assert ("count", "wrong_count") in out and ("count", "wrong_flag") not in out
    assert ("nulls", "wrong_count") in out and ("nulls", "wrong_flag") in out
    assert ("dup", "list") in out and not any(k in ("null", "empty") for k, _ in out)
    assert Q.quality_findings(df.limit(0), spark.createDataFrame([], "word string")).count() == 0
