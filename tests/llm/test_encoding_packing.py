import random
from collections import Counter

import numpy as np
import pytest

from paperloom.llm.byte_bpe import encoder
from paperloom.llm.encode import count_tokens, encode_texts
from paperloom.llm.packing import pack, plan_containers

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_same_ids_as_the_merges_give(reference):
    draw = random.Random(1)
    letters = [*"abcdeéñ  \n\t'’sdtrlvem019!?<|>_-中文字русабв", "<|endoftext|>", "'ll", "   ", "\x1c", "\x85", "\u3000", "\U0001f600"]
    encode = encoder().encode
    for _ in range(1500):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 80)))
        assert np.frombuffer(encode(text), "<i4").tolist() == reference(text), text
    for _ in range(40):
        text = "".join(draw.choice("etaoinshrdlu") for _ in range(1500))
        assert np.frombuffer(encode(text), "<i4").tolist() == reference(text)


def test_long_run_is_linear():
    assert len(encoder().encode("ab" * 100_000)) > 0


def test_rows(spark, reference):
    rows = [(1, "Hello <|endoftext|> world"), (2, ""), (3, None), (4, "again"), (4, "again"), (None, "x" * 50_000)]
    df = spark.createDataFrame([(a, b, "k", 9) for a, b in rows], "doc_id bigint, text string, key string, ids int")
    out = [(r["doc_id"], r["ids"]) for r in encode_texts(df, "doc_id", "text").collect()]
    want = [(a, reference(b) if b else []) for a, b in rows]
    assert sorted(map(repr, out)) == sorted(map(repr, want))
    assert [r["n_tokens"] for r in count_tokens(df, "doc_id", "text").orderBy("n_tokens").collect()] == sorted(len(w) for _, w in want)
    assert encode_texts(df.limit(0), "doc_id", "text").count() == 0


def test_plan_takes_every_item_once():
    draw = random.Random(5)
    for _ in range(20):
        histogram = Counter(min(64, max(1, int(draw.expovariate(0.08)))) for _ in range(draw.randint(1, 3000)))
        rows, containers = plan_containers(histogram, 64)
        fill, ranks = Counter(), Counter()
        for length, first, last, container, each in rows:
            assert ranks[length] == first
            ranks[length] = last
            for rank in range(first, last):
                fill[container + (rank - first) // each] += length
        assert ranks == histogram and max(fill.values()) <= 64 and len(fill) == containers
        assert containers <= -(-sum(n * k for n, k in histogram.items()) // 64) * 1.1 + 2
    assert plan_containers({}, 64) == ([], 0)


def test_pack_rows(spark):
    sizes = [0, None, 10, 10, 10, 100, 101, 250, 64, 36, 1]
    df = spark.createDataFrame([(i, s, 0, 0) for i, s in enumerate(sizes)] + [(2, 10, 0, 0), (None, 5, 0, 0)], "doc_id bigint, n_tokens bigint, part int, container_id int")
    out = pack(df, "doc_id", "n_tokens", 100).collect()
    fill, parts = Counter(), Counter()
    for r in out:
        fill[r["container_id"]] += r["n_units"]
        parts[r["doc_id"]] += 1
    assert max(fill.values()) <= 100 and sum(fill.values()) == sum(s or 0 for s in sizes) + 15
    assert parts[6] == 2 and parts[7] == 3 and parts[5] == 1 and parts[2] == 2 and parts[None] == 1
    assert pack(df.limit(0), "doc_id", "n_tokens", 100).count() == 0


def test_one_hot_size(spark, monkeypatch):
    import paperloom.llm.packing as packing

    monkeypatch.setattr(packing, "RANK_ROWS", 50)
    df = spark.range(1000).selectExpr("id AS doc_id", "IF(id < 700, 7, id % 90 + 1) AS n_tokens")
    out = pack(df, "doc_id", "n_tokens", 100)
    assert out.count() == 1000
    assert out.groupBy("container_id").sum("n_units").agg({"sum(n_units)": "max"}).first()[0] <= 100
