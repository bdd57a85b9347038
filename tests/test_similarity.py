import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from paperloom import constants as K
from paperloom.functions import similarity as S
from paperloom.operators import lsh, ml_lsh, vectors
from paperloom.operators.matching import containment_join


def _signature(text):
    words = re.findall(r"\w{2,}", text.lower())
    hashes = {int(hashlib.md5(" ".join(words[i : i + 5]).encode()).hexdigest(), 16) % K.PRIME for i in range(len(words) - 4)}
    a, b = K.permutation_parameters()
    return [min((x * h + y) % K.PRIME for h in hashes) for x, y in zip(a, b)] if hashes else None


TEXTS = ["one two three four five", "one two three four", "Héllo wörld ünï çode ñame again and again", "the cat sat on the mat " * 30, "", None]


def test_signatures_are_the_published_ones(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    want = {i: _signature(t) if t else None for i, t in enumerate(TEXTS)}
    assert {r["i"]: r["signature"] for r in S.text_signatures(df, "t").collect()} == want
    hashed = df.select("i", S.shingle_hashes(F.col("t")).alias("h"))
    assert {r["i"]: r["signature"] for r in S.signatures(hashed, "h").collect()} == want
    assert K.permutation_parameters()[0][:2] == [1373158607, 239081664]


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_indel_ratio(spark):
    draw = random.Random(1)
    pairs = [("".join(draw.choice("abcd ") for _ in range(draw.randint(0, 70))), "".join(draw.choice("abcd ") for _ in range(draw.randint(0, 70)))) for _ in range(200)]
    for a, b in pairs:
        assert S.longest_common_subsequence(a, b) == _lcs(a, b) == S.longest_common_subsequence(b, a)
    got = spark.createDataFrame([*pairs, (None, "a"), ("", "")], "a string, b string").select(S.indel_ratio("a", "b").alias("r"), S.indel_possible(F.col("a"), F.col("b"), 0.85).alias("p")).collect()
    assert got[-2]["r"] is None and got[-1]["r"] == 1.0
    assert all(r["p"] for r in got[:-2] if r["r"] >= 0.85)


def _corpus(draw):
    words = [f"w{i}" for i in range(300)]
    base = [draw.choice(words) for _ in range(80)]
    rows = [(i, " ".join(base[:40] + [draw.choice(words) for _ in range(40)] if i % 2 else [draw.choice(words) for _ in range(80)])) for i in range(20)]
    near = list(base)
    near[5] = "other"
    return rows + [(100, " ".join(base)), (101, " ".join(near)), (102, " ".join(base)), (103, None), (104, "")]


def test_near_duplicates_and_probe(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in _corpus(random.Random(3))], "doc_id bigint, text string, signature int")
    signed = lsh.sign(df, "doc_id", "text", 10)
    pairs = {(r["id_a"], r["id_b"]): r for r in lsh.near_duplicate_pairs(signed, "doc_id").collect()}
    assert pairs[100, 102]["jaccard_similarity"] == 1.0 and pairs[100, 101]["similarity_level"] == "HIGH" and (101, 102) not in pairs
    classes = {r["doc_id"]: r for r in lsh.near_duplicate_classes(signed, "doc_id").collect()}
    assert classes[100]["class_id"] == classes[102]["class_id"] and classes[100]["n_links"] == classes[101]["n_links"]
    top = lsh.probe(signed.filter("doc_id = 101"), signed, "doc_id", most=1).collect()
    assert [(r["candidate"], r["rank"]) for r in top] == [(100, 1)]
    assert lsh.near_duplicate_pairs(signed.limit(0), "doc_id").count() == 0
    assert ml_lsh.ml_pairs(df, "doc_id", "text").filter("id_a = '100' AND id_b = '102'").count() == 1


def test_every_shared_shingle_takes_part(spark):
    def words(i):
        return [f"t{i}w{j}" for j in range(300)]

    rows = []
    for i in range(450):  # 450 pairs of copies with 296 shingles each are 133,200 shared by two texts; the frequent text has the rest of 2**18
        rows += [(f"a{i}", " ".join(words(i))), (f"b{i}", " ".join(words(i)))]
    for i in range(3):
        rows.append((f"c{i}", " ".join(f"f{j}" for j in range(200_000))))
    df = spark.createDataFrame(rows, "id string, text string").repartition(8)
    got = {(r["id_a"], r["id_b"]): r["jaccard_similarity"] for r in ml_lsh.ml_pairs(df, "id", "text").collect()}
    assert all(got.get((f"a{i}", f"b{i}")) == 1.0 for i in range(450))
    lone = spark.createDataFrame([("x", " ".join(words(1))), ("y", " ".join(words(2))), ("z", " ".join([*words(1), *words(3)]))], "id string, text string")
    assert [(r["id_a"], r["id_b"], r["jaccard_similarity"]) for r in ml_lsh.ml_pairs(lone, "id", "text").collect()] == [("x", "z", 1.0)]


def test_containment_and_neighbours(spark):
    df = spark.createDataFrame([(1, "a1 b2 c3 d4 e5 f6 g7"), (2, "x1 a1 b2 c3 d4 e5 f6 g7 y1"), (3, "a1 b2 c3 d4 e5 q q"), (4, None)], "id bigint, t string")
    got = {(r["query_id"], r["source_id"]): r["ngram_overlap"] for r in containment_join(df, df, "id", "t", 0.3).collect()}
    assert got[1, 2] == 1.0 and got[2, 1] == 0.6 and abs(got[1, 3] - 1 / 3) < 1e-12 and (1, 1) not in got
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None)], "vec_id bigint, embedding array<float>")
    near = vectors.nearest(v, v, "vec_id", "embedding", 2).filter("query_id = 1").orderBy("rank").collect()
    assert [(r["vec_id"], round(r["cosine"], 6)) for r in near] == [(2, 1.0), (3, 0.0)]
    assert vectors.nearest(v.limit(0), v.limit(0), "vec_id", "embedding").count() == 0


def test_index_positions(spark):
    rows = [(None, 3), ("b", 2), ("a", 9), ("a", 1), ("a", 1)] + [(f"k{i}", i) for i in range(200)]
    got = vectors.index_positions(spark.createDataFrame(rows, "p string, c int"), ["p", "c"]).collect()
    assert [(r["p"], r["c"]) for r in sorted(got, key=lambda r: r["index_position"])] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert sorted(r["index_position"] for r in got) == list(range(len(rows)))


def test_nearest_exact_and_in_cells(spark):
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(40, 16))
    data = centres[draw.integers(0, 40, 3000)] + 0.6 * draw.normal(size=(3000, 16))
    data[:900] = data[0]  # a third of all vectors are copies
    data[5] = 0
    rows = [(i, [float(x) for x in v], "x") for i, v in enumerate(data)] + [(9999, None, "x")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, id string")
    asked = df.filter("vec_id % 50 = 0")
    exact = {}
    for r in vectors.nearest(asked, df, "vec_id", "embedding", 10).collect():
        exact.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    unit = np.asarray(data, dtype=np.float32).astype(float)
    unit = unit / np.where(np.linalg.norm(unit, axis=1) > 0, np.linalg.norm(unit, axis=1), 1)[:, None]
    for q, found in exact.items():
        score = np.round(unit @ unit[q], 12)
        score[q] = -9
        want = np.lexsort((np.arange(3000), -score))[:10]
        assert np.allclose(score[[v for _, v in sorted(found)]], score[want])
    index = vectors.fit_cells(df, "embedding", 10)
    assert index.recall >= vectors.RECALL and index.probes < len(index.centres)
    near = vectors.nearest_in_cells(asked, df, "vec_id", "embedding", 10, index).collect()
    hit = total = 0
    for q, found in exact.items():
        if q in (0, 50) or q < 900:
            continue
        got = {r["vec_id"] for r in near if r["query_id"] == q}
        hit += len(got & {v for _, v in found})
        total += len(found)
    assert hit / total >= 0.9
    assert vectors.nearest_in_cells(asked.limit(0), df.limit(0), "vec_id", "embedding").count() == 0
    assert vectors.nearest(asked.limit(0), df.limit(0), "vec_id", "embedding").count() == 0


def test_probe_equals_brute_force_with_many_copies(spark, monkeypatch):
    draw = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(draw.choice(words) for _ in range(60)) for _ in range(8)]
    rows = [(i, texts[0] if i % 3 == 0 else texts[draw.randrange(8)] + f" tail {draw.randrange(3)}") for i in range(240)]
    signed = lsh.sign(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text", least_chars=0).cache()
    sig = {r["doc_id"]: r["signature"] for r in signed.collect()}
    bands = lambda s: {(b, tuple(s[5 * b : 5 * b + 5])) for b in range(25)}
    for most in (3, 50):
        got = {}
        for r in lsh.probe(signed.filter("doc_id % 50 = 0"), signed, "doc_id", most).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["candidate"], r["jaccard_similarity"]))
        for q in range(0, 240, 50):
            mates = [(-sum(a == b for a, b in zip(sig[q], s)) / 128, i) for i, s in sig.items() if i != q and bands(sig[q]) & bands(s)]
            assert sorted(got.get(q, [])) == [(n, i, -s) for n, (s, i) in enumerate(sorted(mates)[:most], 1)]
    pairs = {tuple(r) for r in lsh.near_duplicate_pairs(signed, "doc_id").collect()}
    split = lsh.split_hot
    monkeypatch.setattr(lsh, "split_hot", lambda left, right, on, most: split(left, right, on, 2))
    assert {tuple(r) for r in lsh.near_duplicate_pairs(signed, "doc_id").collect()} == pairs
