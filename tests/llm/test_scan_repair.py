import random

import pytest

from paperloom.llm import scan_repair as R

WORDS = "the order graph that determines method under chaotic kernel number with diagnosis residual cluster boundary measured tensor median analysis threshold solution individual hidden".split()


@pytest.fixture(scope="module")
def editor():
    vocabulary = {w: 400 - 3 * i for i, w in enumerate(WORDS)} | {"time-varying": 60, "long-range": 50, "time": 80, "varying": 60, "long": 60, "range": 60}
    return R.Editor(R.train_editor(vocabulary), vocabulary)


def test_held_out_damage_is_undone(editor):
    draw = random.Random(8)
    right = total = 0
    for _ in range(400):
        word = draw.choice([w for w in WORDS if len(w) > 3])
        read = "".join(c for c, _ in R.damage_word(word, draw, 0.25))
        if read != word:
            total += 1
            right += editor.correct(read) == word
    assert right / total >= 0.95
    for word in [*WORDS, "Zanradell", "run51", "x0", "(cid:12)", "bxhrv"]:
        assert editor.correct(word) == word


def test_lost_doubled_and_changed_characters(editor):
    """Beyond any confusion: held-out words with one such edit come back, words of the corpus and names stay."""
    draw = random.Random(5)
    right = total = 0
    for _ in range(300):
        word = draw.choice([w for w in WORDS if len(w) > 5])
        read = "".join(c for c, _ in R.damage_word(word, draw, 0.0, other=draw.choice(("lose", "double", "change"))))
        if read != word and read not in editor.vocabulary:
            total += 1
            right += editor.mend(read) == word
    assert right / total >= 0.85
    assert editor.mend("diagnsis") == "diagnosis" and editor.mend("bounddary") == "boundary" and editor.mend("hiddn") == "hidden"
    for word in [*WORDS, "Kernal", "zanradell", "run51"]:
        assert editor.mend(word) == word
    found, clean = R.repair("the graph that determnes the order", editor)
    assert found == [] and clean == "the graph that determines the order"
    assert "thresh" in R.repair("the thresh-\nold", editor)[1]


def test_confusions_are_learned():
    draw = random.Random(3)
    words = ["".join(draw.choice("aeioglnrst") for _ in range(7)) for _ in range(300)]
    vocabulary = {w: 100 for w in words} | {w.replace("g", "9"): 4 for w in words if "g" in w} | {words[0][:-1]: 3, words[1] + "s": 3}
    assert R.learn_confusions(vocabulary) == [("g", "9")]
    confusions = R.CONFUSIONS + [("g", "9")]
    editor = R.Editor(R.train_editor(vocabulary, confusions), vocabulary, confusions)
    damaged = [w for w in words if w.count("g") == 1]
    assert sum(editor.correct(w.replace("g", "9")) == w for w in damaged) >= 0.95 * len(damaged)


def test_form_feeds_part_pages():
    body = lambda k: [f"line {k} {i} of the running text goes on with more" for i in range(8)]
    text = "\n\x0c\n".join("\n".join(["pelen londoth | cs.ir", *body(k), "within the text", *body(k + 9), str(k + 3)]) for k in range(3))
    lines, edges = R.page_lines(text)
    headers, pages = R.furniture(lines, edges)
    assert {lines[i] for i in headers} == {"pelen londoth | cs.ir"} and [lines[i] for i in sorted(pages)] == ["3", "4", "5"]
    plain = [x.replace("\x0c", "") for x in lines]
    assert R.furniture(plain)[0] == set()  # without the borders it doesn't look like a header
    assert R.page_lines("a\nb") == (["a", "b"], None)


def test_line_ends(editor):
    assert editor.joins("deter", "-", "mines") and editor.joins("thres", "\xad", "hold") and editor.joins("clus", "¬", "ter")
    assert not editor.joins("time", "-", "varying") and not editor.joins("long", "-", "range")


def _page(n, header, number, body):
    return [header, *body, number]


def test_furniture():
    body = lambda k: [f"line {k} {i} of the running text goes on with more" for i in range(8)]
    for style in ("- {} -", "p. {}", "Page {} of 40", "{}/40", "~ {} ~", "{}", "[{}]"):
        lines = [x for k in range(4) for x in [*body(k), style.format(17 + k)]]
        headers, pages = R.furniture(lines)
        assert not headers and len(pages) == 4, style
    lines = [x for k in range(4) for x in [f"{k + 3}   A. AUTHOR ET AL." if k % 2 else "A. AUTHOR ET AL.      " + str(k + 3), *body(k)]]
    headers, pages = R.furniture(lines)
    assert len(headers) == len(pages) == 4
    column = ["Values read:", "711", "712", "399", "23", *body(0), "1. Introduction", *body(1), "2. Results", *body(2), "[1] A. Name, 1990", "[2] B. Name, 1991"]
    assert R.furniture(column) == (set(), set())


def test_repair(editor):
    body = "the graph that deter-\nmines the order of the 6oundary with the time-\nvarying kernel and the rnethod"
    found, clean = R.repair("\n".join(["Draft of 1 May", body, "x y z w", body, "Draft of 1 May", body, body, "Draft of 1 May"]), editor)
    assert found == ["header", "hyphen", "misread"]
    assert "determines" in clean and "boundary" in clean and "time-varying" in clean and "method" in clean and "Draft" not in clean
    assert R.repair("", editor) == ([], "")
    assert R.repair("Abstract\nthe graph that\ndetermines\n1. Main Results\nthe order\nof it", editor)[1] == "Abstract\n\nthe graph that determines\n\n1. Main Results\n\nthe order of it"


def test_rows(spark):
    text = "the graph that determines the order\n" * 30
    rows = [("a", text), ("b", text), ("c", text), ("d", text + "the grap-\nh"), ("a", text), ("n", None), ("e", ""), (None, text), ("long", text * 300)]
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "file_path string, text string, damage int, repaired string")
    out = R.repair_pages(df, "file_path", "text").collect()
    assert len(out) == len(rows)
    by = {r["file_path"]: r for r in out}
    assert by["n"]["repaired"] is None and by["e"]["damage"] == [] and "the graph that" in by["a"]["repaired"]
    empty = df.limit(0)
    assert R.repair_pages(empty, "file_path", "text").count() == 0
    pages = R.page_texts(df, spark.createDataFrame([("a", text), ("z", "other"), ("y", None)], "file_path string, raw_text string"))
    assert pages.filter("file_path = 'z'").count() == 1 and pages.count() == 8
