import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from paperloom.functions import patterns as P
from paperloom.functions import text as X

PAGE = (
    "arXiv:1234.50001v2  [cs.LG]  3 May 2012\nJanuary 4, 2012\n10:20\nPreprint submitted to Journal\nshort line\nABC-12-34\nAbstract\nWe ﬁnd a thing time-\nvarying.\n12\n"
    "Introduction\nText with mail a@b.org and http://x.y/z here.\tTwo  tabs\n3/14\nBody page 3 of 9 ends.\n\n\n\nMore ½ text\x07 here.\n" + "Filler words stand here and there.\n" * 20 + "References\n[1] A. Name, Title\n"
)
TEXTS = [PAGE, None, "", "one", "x" * 5000, "No refs " * 50, "a references b " * 3, "preferences " * 30 + "\nBibliography\n", "résumé naïve café " * 40, "tail space  ", PAGE * 40]


def _sub(t, steps):
    for p, by in steps:
        t = re.sub(p, by, t)
    return t


def _offline(t):
    """The published steps in plain Python."""
    if not t:
        return "", False
    t = _sub(t, [(P.OFFLINE_HEADER, ""), (P.OFFLINE_STAMP, ""), (P.OFFLINE_PUBLISHER, ""), (P.OFFLINE_REPORT, "")])
    low, strict, cut = int(len(t) * 0.60), int(len(t) * 0.75), None
    if m := re.search(P.OFFLINE_REFERENCES, t[low:]):
        cut = low + m.start()
    elif m := re.search(P.OFFLINE_REFERENCE_LIST, t[strict:]):
        cut = strict + m.start()
    t = _sub(t if cut is None else t[:cut], P.OFFLINE_PAGES)
    for a, b in P.LIGATURES.items():
        t = t.replace(a, b)
    t = re.sub(P.CONTROL, "", unicodedata.normalize("NFKC", t))
    return _sub(re.sub(P.HYPHEN, r"\1\2", t), P.OFFLINE_TAIL).strip(), cut is not None


def _online(t):
    t = _sub(t or "", [(P.ONLINE_HEADER, " "), *((p, " ") for p in P.ONLINE_JOURNAL)])
    found = [i for i in (t.lower().find(m, int(len(t) * 0.55)) for m in P.ONLINE_MARKERS) if i >= 0]
    refs = t[min(found) :] if found else ""
    t = _sub(t[: min(found)] if found else t, P.ONLINE_PAGES)
    for a, b in P.LIGATURES.items():
        t = t.replace(a, b)
    t = re.sub(P.CONTROL, " ", unicodedata.normalize("NFKC", t))
    return _sub(re.sub(P.HYPHEN, r"\1\2", t), P.ONLINE_TAIL).strip(), refs


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")


def test_offline_cleaner(rows):
    for r in X.clean_offline(rows, "t").collect():
        clean, cut = _offline(TEXTS[r["i"]])
        c = r["cleaned"]
        n, before = len(clean.split()), len((TEXTS[r["i"]] or "").split())
        assert (c["clean_text"], c["has_references"], c["word_count_clean"]) == (clean, cut, n)
        ratio = n / before if before else 0.0
        assert c["reduction_ratio"] == round(ratio, 3)
        assert c["quality_flag"] == ("empty" if n < 300 else "low_quality" if n < 500 else "over_cleaned" if ratio < 0.3 else "ok")


def test_online_cleaner(rows):
    for r in X.clean_online(rows, "t").collect():
        clean, refs = _online(TEXTS[r["i"]])
        assert (r["cleaned"]["clean_text"], r["cleaned"]["references_text"], r["cleaned"]["has_references"]) == (clean, refs, bool(refs.strip()))


def test_quality_borders(spark):
    df = spark.createDataFrame([(299, 1.0), (300, 1.0), (499, 1.0), (500, 1.0), (500, 0.299), (500, 0.3)], "n int, r double")
    assert [r[0] for r in df.select(X.quality_offline(F.col("n"), F.col("r"))).collect()] == ["empty", "low_quality", "low_quality", "ok", "over_cleaned", "ok"]


def test_sections(spark):
    texts = ["Before\n1. Introduction\nIntro text.\n2. Method\nBody", "a\nIntroduction\nonly", "nothing here", None, "x\nINTRODUCTION\nin\nMETHODS\nrest"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    off = [tuple(r[0]) for r in df.select(X.sections_offline(F.col("t"))).collect()]
    assert off == [("Intro text.", "2. Method\nBody"), ("only", ""), ("", "nothing here"), ("", ""), ("in", "METHODS\nrest")]
    on = [tuple(r[0]) for r in df.select(X.sections_online(F.col("t"))).collect()]
    assert on[0] == ("Intro text.", "Before\n1. Introduction\n \n2. Method\nBody") and on[2] == ("", "nothing here") and on[3] == ("", "")


def test_segments_and_chunks(spark):
    para = lambda k: " ".join(f"w{i}" for i in range(k))
    text = "\n \n".join([para(19), para(20), para(20), "", para(25)])
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(X.segments(F.col("t"))).collect()]
    assert [s["idx"] for s in got[0]] == [1, 2, 3] and all(text[s["start_char"] : s["end_char"]] == s["text"] for s in got[0])
    assert got[0][0]["start_char"] < got[0][1]["start_char"] and not got[1] and not got[2]
    body = " ".join(f"This sentence has number {i} in it." for i in range(9)) + " Too short."
    c = spark.createDataFrame([(None, "x" * 49, body)], "a string, i string, b string").select(X.chunks(F.col("a"), F.col("i"), F.col("b"))).first()[0]
    assert [x["section"] for x in c] == ["body", "body"] and c[0]["chunk_text"].count("sentence") == 4
    demo = spark.createDataFrame([("Short. " + "A sentence that is long enough here. " * 2,), ("tiny",), (None,)], "t string").select(X.sentences_demo(F.col("t"))).collect()
    assert [len(r[0]) for r in demo] == [2, 0, 0]
