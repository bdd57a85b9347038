import random

from paperloom.llm.splitting import pieces, split_texts


def _whole(text, found, overlap=100):
    return text[: found[0][1]] + "".join(text[a + overlap : b] for a, b, _ in found[1:])


def test_round_trip_and_limits():
    draw = random.Random(3)
    for _ in range(300):
        text = "".join(draw.choice(["a" * draw.randint(1, 2500), "word ", "End. ", "\n", "\n\n", "中文。", "\u2003x "]) for _ in range(draw.randint(1, 200))).strip()
        found, _ = pieces(text)
        assert all(b - a <= 1200 for a, b, _ in found)
        assert all(n[0] == p[1] - 100 for p, n in zip(found, found[1:]))
        assert _whole(text, found) == text


def test_best_boundary_is_taken():
    paragraph = "Some words stand here. " * 40
    text = (paragraph.strip() + "\n\n" + paragraph.strip() + "\n\n" + paragraph.strip()).strip()
    found, _ = pieces(text)
    assert {k for _, _, k in found} == {"paragraph", "end"}
    assert pieces("x" * 3000)[0][0][2] == "forced"
    assert {k for _, _, k in pieces("w " * 1500)[0]} == {"word", "end"}


def test_other_limits_and_no_overlap():
    text = "one two three four five six seven eight nine ten"
    found, _ = pieces(text, 12, 0)
    assert "".join(text[a:b] for a, b, _ in found) == text and all(b - a <= 12 for a, b, _ in found)


def test_edge_rows(spark):
    long = "Sentence number one is here. " * 60
    rows = [("a", long), ("a", long), ("b", None), ("c", ""), ("d", "  " + "x" * 1200 + "  "), ("e", "y" * 1201), (None, long), ("f", "z" * 200_000)]
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "paper_id string, introduction string, cut int, pieces string")
    out = split_texts(df, "introduction", "paper_id", "introduction").collect()
    cuts = {(r["item_key"], r["cut"]) for r in out}
    assert cuts == {("a", "boundary"), ("e", "forced"), (None, "boundary"), ("f", "forced")}
    assert sum(r["item_key"] == "a" and r["piece_no"] == 0 for r in out) == 1
    assert split_texts(df.limit(0), "introduction", "paper_id", "introduction").count() == 0
