import math
import random
import re

from paperloom.llm import near_copies as N


def _jaccard(a, b):
    sets = []
    for t in (a, b):
        w = re.findall(r"\w{2,}", (t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] and sets[1] else 0.0


def _corpus(seed):
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(400)]
    out = []
    for g in range(12):
        base = [draw.choice(words) for _ in range(150)]
        for v in range(6):
            w = list(base)
            for _ in range(draw.randint(0, 14)):
                w[draw.randrange(len(w))] = draw.choice(words)
            if v == 4:
                w = w[60:] + w[:60]
            out.append((f"p{g}_{v}", " ".join(w)))
    out += [("copy1", out[0][1]), ("copy2", out[0][1].upper()), ("short", "only four words here"), ("none", None), ("empty", ""), (out[0][0], out[0][1]), ("long", " ".join(words) * 40)]
    return out


def _want(rows, least):
    texts = {}
    for k, t in rows:
        texts[k] = t
    keys = sorted(texts)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if _jaccard(texts[a], texts[b]) >= least}


def test_every_pair_is_found(spark):
    rows = _corpus(2)
    df = spark.createDataFrame([(k, t, 1, b"x") for k, t in rows], "paper_id string, clean_text string, class_id int, shingles binary")
    for least in (0.5, 0.8):
        members, links = N.near_copies(df, "paper_id", "clean_text", least)
        assert {tuple(r) for r in N.similar_pairs(members, links).collect()} == _want(rows, least)


def test_crowded_entries_and_classes_lose_nothing(spark, monkeypatch):
    split = N.split_hot
    for rows_each in (1, 3, 10_000):
        monkeypatch.setattr(N, "PARTNERS", rows_each)
        monkeypatch.setattr(N, "split_hot", lambda left, right, on, most=10_000, part="_part", n=rows_each: split(left, right, on, min(n, most), part))
        rows = _corpus(5)
        df = spark.createDataFrame(rows, "paper_id string, clean_text string")
        members, links = N.near_copies(df, "paper_id", "clean_text", 0.5)
        assert {tuple(r) for r in N.similar_pairs(members, links).collect()} == _want(rows, 0.5)


def test_sketch_bound():
    for threshold in (0.5, 0.8):
        p = threshold + (1 - threshold) / 2**N.SKETCH_BITS
        k = N.least_agreement(threshold)
        below = sum(math.comb(64, i) * p**i * (1 - p) ** (64 - i) for i in range(k))
        assert below <= N.SKETCH_LOSS


def test_groups_are_components(spark):
    draw = random.Random(9)
    edges = [(draw.randrange(60), draw.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["node"]: r["component"] for r in N.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for x in parent}


def test_groups_and_empty_table(spark):
    rows = _corpus(3)
    df = spark.createDataFrame(rows, "paper_id string, clean_text string")
    members, links = N.near_copies(df, "paper_id", "clean_text", 0.5)
    out = {r["key"]: r for r in N.copy_groups(members, links).collect()}
    assert out["copy1"]["group_id"] == out["copy2"]["group_id"] == out["p0_0"]["group_id"]
    assert all(out[k]["class_id"] is None and out[k]["group_id"] is None and out[k]["n_links"] == 0 for k in ("none", "short", "empty"))
    members, links = N.near_copies(df.limit(0), "paper_id", "clean_text")
    assert members.count() == 0 and links.count() == 0 and N.copy_groups(members, links).count() == 0
