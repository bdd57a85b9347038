import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from paperloom.llm import shared_spans as S
from paperloom.llm.shared_spans import compact, shared_spans, span_runs


def _brute(rows, length):
    """Shared code points of each record by looking at every window."""
    where = defaultdict(set)
    for src, key, text in rows:
        t = (text or "").strip()
        for i in range(len(t) - length + 1):
            where[src, t[i : i + length]].add(key)
    best = {}
    for src, key, text in rows:
        t = (text or "").strip()
        hit = [len(where[src, t[i : i + length]]) > 1 for i in range(max(0, len(t) - length + 1))]
        covered = sum(any(hit[max(0, p - length + 1) : p + 1]) for p in range(len(t)))
        best[src, key] = max(best.get((src, key), 0), covered)
    return best


def _rows(seed, n=40):
    draw = random.Random(seed)
    word = lambda k: "".join(draw.choice("abcdefghij klmno") for _ in range(k))
    common = [word(k) for k in (299, 300, 301, 450, 900)]
    rows = []
    for i in range(n):
        t = word(draw.randint(0, 300))
        for _ in range(draw.randint(0, 2)):
            t += draw.choice(common) + word(draw.randint(0, 200))
        rows.append((draw.choice("xy"), f"k{i}", t))
    rows += [("x", "k0", rows[0][2]), ("x", None, common[3]), ("x", "null", None), ("x", "empty", ""), ("x", "pad", "  " + common[1] + "\n"), ("x", "same", "a" * 1000), ("x", "same2", "a" * 400)]
    return rows


def test_against_every_window(spark):
    rows = _rows(7)
    df = spark.createDataFrame(rows, "src string, item_key string, text string")
    out = {(r["src"], r["item_key"]): r["shared_chars"] for r in shared_spans(df.selectExpr("*", "1 AS run", "2 AS record"), run_chars=3000).collect()}
    assert out == _brute(rows, 300)


def _history(spark, tmp_path, batches, fan_in):
    """Batch after batch, each compacted and stored; the levels after each."""
    path, levels = None, []
    for n, rows in enumerate(batches):
        made = span_runs(spark.createDataFrame(rows, "src string, item_key string, text string"), n, run_chars=4000)
        made = made if path is None else spark.read.parquet(path).unionByName(made)
        path = str(tmp_path / f"h{n}")
        compact(made, fan_in).write.parquet(path)
        levels.append(sorted(tuple(r) for r in spark.read.parquet(path).select("level", "segment").distinct().collect()))
    return spark.read.parquet(path), levels


def test_new_batch_against_history(spark, tmp_path, monkeypatch):
    rows = _rows(11)
    old, new = rows[:28], rows[28:]
    monkeypatch.setattr(S, "RANGE_HASHES", 500)  # many ranges, cut ever finer as the history grows
    history, levels = _history(spark, tmp_path, [old[:7], old[7:14], old[14:21], old[21:]], 2)
    assert levels == [[(0, 0)], [(1, 1)], [(0, 2), (1, 1)], [(2, 3)]]
    for chars in (4000, 1_000_000):
        out = {(r["src"], r["item_key"]): r["shared_chars"] for r in shared_spans(spark.createDataFrame(new, "src string, item_key string, text string"), history=history, run_chars=chars).collect()}
        want = _brute(rows, 300)
        keys = {(s, k) for s, k, _ in new} - {(s, k) for s, k, _ in old}
        assert {k: v for k, v in out.items() if k in keys} == {k: want[k] for k in keys}


def test_history_of_another_length_is_refused(spark, tmp_path):
    history, _ = _history(spark, tmp_path, [_rows(3)], 4)
    df = spark.createDataFrame(_rows(3), "src string, item_key string, text string")
    with pytest.raises(ValueError, match="300"):
        shared_spans(df, length=400, history=history)


def test_two_batches_equal_one(spark, tmp_path):
    rows = [(s, k, t) for s, k, t in _rows(5) if k is not None]
    make = lambda r: spark.createDataFrame(r, "src string, item_key string, text string")
    halves = [[r for r in rows if len(r[1]) % 2 == i] for i in (0, 1)]
    together = {}
    for own, other in ((0, 1), (1, 0)):
        path = tmp_path / str(own)
        path.mkdir()
        history, _ = _history(spark, path, [halves[other]], 4)
        together |= {(r["src"], r["item_key"]): (r["shared_chars"], r["n_spans"]) for r in shared_spans(make(halves[own]), history=history).collect()}
    assert together == {(r["src"], r["item_key"]): (r["shared_chars"], r["n_spans"]) for r in shared_spans(make(rows)).collect()}


def test_ranges_are_even():
    draw = np.random.default_rng(1)
    table = lambda n: pa.table({"record": list(range(1, n + 1)), "seed": [5] * n, "text": ["".join(map(chr, draw.integers(97, 120, 3000))) for _ in range(n)]})
    key, _, _ = S._Run(table(40), 300).minima()
    found, edge = S._cells(key, 5)
    assert len(found) == 32 and np.diff(edge).max() < 2 * len(key) / 32


def test_hot_span_and_empty_table(spark):
    df = spark.range(300).selectExpr("'x' AS src", "cast(id AS string) AS item_key", "concat(repeat(cast(id AS string), 40), ' ', repeat('the same notice ', 40)) AS text")
    out = shared_spans(df, run_chars=20_000)
    assert out.filter("n_spans >= 1").count() == 300
    assert shared_spans(df.limit(0)).count() == 0
