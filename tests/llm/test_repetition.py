import math
import random
from collections import Counter, defaultdict

import numpy as np

from paperloom.llm import repetition as R


def _share(text, n=8):
    w = (text or "").lower().split()
    where = defaultdict(list)
    for i in range(len(w) - n + 1):
        where[tuple(w[i : i + n])].append(i)
    covered = {p for at in where.values() if len(at) > 1 for i in at for p in range(i, i + n)}
    return len(covered) / len(w) if w else 0.0


def _texts():
    draw = random.Random(6)
    out = []
    for _ in range(60):
        base = [draw.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(draw.randrange(40)) for _ in range(draw.randint(0, 60))]
        out.append(" ".join(base + base[: draw.randint(0, len(base))] * draw.randint(0, 3)))
    return [*out, None, "", "one", "a " * 9, "A a " * 20, "same " * 30_000]


def test_share_against_brute_force(spark):
    rows = list(enumerate(_texts()))
    rows.append(rows[3])
    df = spark.createDataFrame([(i, t, None if i % 5 == 0 else "EN ", 1, "x") for i, t in rows], "doc_id bigint, text string, lang string, perplexity int, repeated string")
    out = R.repetition(df).collect()
    assert len(out) == len(rows)
    for r in out:
        want = _share(dict(rows)[r["doc_id"]])
        assert abs(r["repeated_share"] - want) < 1e-12 and r["repeated"] == (want >= 0.3)
        assert r["lang"] in ("und", "en")
    assert R.repetition(df.limit(0)).count() == 0


def test_model_is_a_distribution(spark):
    draw = random.Random(2)
    texts = [" ".join(draw.choice("a b c d e f".split()) for _ in range(30)) for _ in range(40)]
    model = R.fit_model(spark.createDataFrame([(t,) for t in texts], "text string"), "text")
    hashes = R._Hashes()
    vocabulary = [hashes[w] for w in "abcdef"]
    for before in vocabulary:
        total = sum(math.exp(model.log_probabilities(np.array([before, w], dtype=np.uint64), np.array([0, 2]))[1]) for w in vocabulary)
        assert 0.97 <= total <= 1.0 + 1e-6
    pairs = Counter()
    for t in texts:
        w = t.split()
        pairs.update(zip(w, w[1:]))
    frequent, rare = pairs.most_common()[0][0], pairs.most_common()[-1][0]
    score = lambda p: model.log_probabilities(np.array([hashes[x] for x in p], dtype=np.uint64), np.array([0, 2]))[1]
    assert score(frequent) > score(rare)


def test_discounts_stay_in_range():
    for counts in ([100, 40, 20, 10], [1, 0, 0, 0], [0, 0, 0, 0], [5, 50, 500, 5000]):
        for k, d in zip((1, 2, 3), R.discounts(counts)):
            assert 0 < d < k


def test_model_keeps_within_its_bound(spark):
    counts = [1] * 50 + [2] * 20 + [700] * 5 + [1024] * 4 + [1500] * 3 + [5000] * 2
    df = spark.createDataFrame([(n,) for n in counts], "n bigint")
    for most in (0, 1, 2, 5, 9, 14, 34, 84, 1000):
        cut = R._fitting(df, "n", most)
        kept = sum(n >= cut for n in counts)
        assert kept <= most and (most < 84 or kept == 84)
    assert R._fitting(df, "n", 34) == 2 and R._fitting(df, "n", 9) == 1024


def test_pairs_beyond_the_bound_count_as_well(spark, monkeypatch):
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(_texts()[:-1])], "doc_id bigint, text string, lang string").repartition(3)
    rows = lambda: {r["doc_id"]: r for r in R.repetition(df).collect()}
    want = rows()
    for most in ((0, 0), (5, 3), (200, 50)):
        monkeypatch.setattr(R, "MODEL_PAIRS", most[0])
        monkeypatch.setattr(R, "MODEL_WORDS", most[1])
        got = rows()
        assert got.keys() == want.keys()
        for k, w in want.items():
            for c in ("perplexity", "lower", "upper"):
                assert (got[k][c] is None) == (w[c] is None) and (w[c] is None or math.isclose(got[k][c], w[c], rel_tol=1e-4)), (most, k, c)
            assert got[k]["band"] == w["band"] and got[k]["repeated"] == w["repeated"]
