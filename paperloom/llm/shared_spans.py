"""Problem 3: spans of a given length that stand word for word in several records.

A log-structured fingerprint index. Texts are hashed into runs of bounded
size; a run is a sorted array of the distinct window hashes of its records,
each with the record that has it or a mark for several. Runs are immutable:
they are cut by hash range, the parts of one range from all runs are merged in
one task, and each run gets back one bit for each of its hashes, whether
another record has it too. Texts never meet each other, a hash that stands in
a third of all records comes once from each run, and no pair is formed.

Two rounds keep the traffic small. The first asks for the minima of short
windows; a span of the wanted length can be shared only where every minimum
inside it is. The second asks for the full windows that remain, which match by
two independent rolling hashes of 64 and 32 bits.

span_runs() keeps both kinds of runs of a batch as a segment of level 0 of the
history. A new batch is merge-joined with all segments, so that it is held
against earlier records without reading them again; compact() merges FAN_IN
segments of a level into one of the next. Every row of the history says for
which length it was made and how finely its ranges are cut: another length is
refused, another cut is adapted when it is read, so ranges can be cut finer as
the history grows and no task's share of it does.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import code_points, mix64

LENGTH = 300
#: Code points of the short windows, and how many of them give one minimum.
GRAM, WINNOW = 64, 64
#: Code points of all records of a run, about; and of one step in a task.
RUN_CHARS, STEP_CHARS = 2_000_000, 1_000_000
#: Hashes of one range, about, which one task merges; 16 bytes each.
RANGE_HASHES = 1_000_000
#: Segments of one level that are merged into one of the next.
FAN_IN = 4
SEVERAL = 0

#: Odd multipliers of the rolling hashes.
_BASE = {"minima": 0x9E3779B97F4A7C15, "windows": 0xD6E8FEB86659FD93, "check": 0xA0761D6478BD642F}
_powers: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _power(name: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(name)
    if have is None or len(have[0]) < size:
        size = max(size, STEP_CHARS + 100_000)
        out = []
        for base in (_BASE[name], pow(_BASE[name], -1, 1 << 64)):
            p = np.full(size, np.uint64(base), dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _powers[name] = (out[0], out[1])
    return have


def rolling(points: np.ndarray, width: int, name: str) -> np.ndarray:
    """Hash of each window of width code points; windows may cross from text to text."""
    n = len(points)
    if n < width:
        return np.zeros(0, dtype=np.uint64)
    up, down = _power(name, n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(mix64(points.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return mix64((sums[width:] - sums[:-width]) * down[: n - width + 1])


def _inside(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which windows of width lie within one text."""
    bad = np.zeros(n + 1, dtype=np.int32)
    for a in starts[1:-1]:
        bad[max(0, a - width + 1)] += 1
        bad[a] -= 1
    return np.cumsum(bad[: max(0, n - width + 1)]) == 0


def _minima(points: np.ndarray, starts: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least short-window hash of each WINNOW neighbours, and which of them lie within one text."""
    h = rolling(points, GRAM, "minima")
    if len(h) < WINNOW:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
    h = mix64(h ^ seed[: len(h)])
    step = 1
    while step < WINNOW:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    return h, _inside(starts, GRAM + WINNOW - 1, len(points))


def _steps(table: pa.Table):
    """(row numbers, texts) of at most STEP_CHARS each, or one text."""
    rows, texts, size = [], [], 0
    at = 0
    for batch in table.column("text").chunks:
        for t in batch.to_pylist():
            if rows and size + len(t) > STEP_CHARS:
                yield rows, texts
                rows, texts, size = [], [], 0
            rows.append(at)
            texts.append(t)
            size += len(t)
            at += 1
    if rows:
        yield rows, texts


def _starts(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Where in sorted hashes and checks a new value begins."""
    return np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])]) if len(h) else np.zeros(0, dtype=np.int64)


def _distinct(hashes: list[np.ndarray], checks: list[np.ndarray], records: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes with checks, each with its record or SEVERAL, which is the least value and wins against any record."""
    if not hashes:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.uint32)
    h, c, r = np.concatenate(hashes), np.concatenate(checks), np.concatenate(records)
    order = _order(h, c)
    h, c, r = h[order], c[order], r[order]
    first = _starts(h, c)
    if not len(first):
        return h, c, r
    low, high = np.minimum.reduceat(r, first), np.maximum.reduceat(r, first)
    return h[first], c[first], np.where(low == high, low, SEVERAL).astype(np.uint32)


def _order(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.lexsort((c, h)) if c.any() else np.argsort(h, kind="stable")


class _Run:
    """One run's records and what can be computed from them."""

    def __init__(self, table: pa.Table, length: int):
        self.table, self.length = table, length
        self.record = table.column("record").to_numpy().astype(np.uint32)
        self.seed = table.column("seed").to_numpy().astype(np.uint64)

    def _views(self):
        for rows, texts in _steps(self.table):
            points, starts = code_points(texts)
            sizes = np.diff(starts)
            yield np.array(rows), points, starts, np.repeat(self.seed[rows], sizes), np.repeat(self.record[rows], sizes)

    def minima(self):
        """Distinct minima with their records, sorted by their key, and the minima themselves in the same order.

        The key is the minimum mixed once more: minima lie low, and ranges are
        cut evenly.
        """
        hashes, records = [], []
        for _, points, starts, seed, record in self._views():
            h, inside = _minima(points, starts, seed)
            keep = inside.copy()
            keep[1:] &= (h[1:] != h[:-1]) | ~inside[:-1] | (record[1 : len(h)] != record[: max(0, len(h) - 1)])
            hashes.append(h[keep])
            records.append(record[: len(h)][keep])
        h, _, r = _distinct(hashes, [np.zeros(len(x), dtype=np.uint32) for x in hashes], records)
        key = mix64(h + np.uint64(1))
        order = np.argsort(key)
        return key[order], r[order], h[order]

    def _candidates(self, shared_minima: np.ndarray | None):
        """For each step: rows, texts' starts, starts of the windows that may be shared, their hashes, checks and records."""
        for rows, points, starts, seed, record in self._views():
            inside = _inside(starts, self.length, len(points))
            if not inside.any():
                continue
            if shared_minima is not None:
                h, within = _minima(points, starts, seed)
                at = np.searchsorted(shared_minima, h)
                at[at == len(shared_minima)] = 0
                bad = within & (shared_minima[at] != h if len(shared_minima) else True)
                sums = np.r_[0, np.cumsum(bad)]
                reach = self.length - GRAM - WINNOW + 2
                first = np.arange(len(inside))
                inside &= sums[np.minimum(first + reach, len(bad))] == sums[np.minimum(first, len(bad))]
            where = np.flatnonzero(inside)
            if not len(where):
                continue
            h = mix64(rolling(points, self.length, "windows")[where] ^ seed[where])
            c = (rolling(points, self.length, "check")[where] >> np.uint64(32)).astype(np.uint32)
            yield rows, starts, where, h, c, record[where]

    def windows(self, shared_minima: np.ndarray | None):
        found = [_distinct([h], [c], [r]) for *_, h, c, r in self._candidates(shared_minima)]
        return _distinct(*([x[i] for x in found] for i in range(3)))

    def covered(self, shared_minima: np.ndarray | None, shared_windows: np.ndarray):
        """Code points in shared windows and number of shared spans, by row."""
        n = self.table.num_rows
        chars, spans = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        if not len(shared_windows):
            return chars, spans
        for rows, starts, where, h, _, _ in self._candidates(shared_minima):
            at = np.searchsorted(shared_windows, h)
            at[at == len(shared_windows)] = 0
            hit = where[shared_windows[at] == h]
            if not len(hit):
                continue
            text = np.searchsorted(starts, hit, side="right") - 1
            fresh = np.r_[True, text[1:] != text[:-1]]
            step = np.r_[0, np.diff(hit)]
            # windows that overlap or touch are one span
            np.add.at(spans, rows[text], (fresh | (step > self.length)).astype(np.int64))
            np.add.at(chars, rows[text], np.where(fresh, self.length, np.minimum(step, self.length)))
        return chars, spans


PART = "bits int, range int, run int, hashes binary, checks binary, records binary"
REPLY = "run int, round int, range int, bits binary"
HISTORY = "kind string, level int, segment bigint, length int, bits int, range int, hashes binary, checks binary, records binary"


def _range_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The range of each hash: its first bits."""
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), dtype=np.int64)


def _cells(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranges that sorted hashes lie in, and where each begins and the last ends."""
    found, first = np.unique(_range_of(hashes, bits), return_index=True)
    return found, np.r_[first, len(hashes)]


def _bits(hashes: int, spark) -> int:
    """How many first bits cut so many hashes into ranges of about RANGE_HASHES, at least one range for each core."""
    return min(30, max(0, (-(-hashes // RANGE_HASHES) - 1).bit_length(), (spark.sparkContext.defaultParallelism - 1).bit_length()))


def _parts(hashes: np.ndarray, checks: np.ndarray | None, records: np.ndarray, run: int, bits: int) -> pa.Table:
    found, edge = _cells(hashes, bits)
    pieces = lambda x: pa.array([b"" if x is None else x[i:j].tobytes() for i, j in zip(edge, edge[1:])], pa.binary())
    n = len(found)
    return pa.table(
        {"bits": pa.array([bits] * n, pa.int32()), "range": pa.array(found, pa.int32()), "run": pa.array([run] * n, pa.int32()), "hashes": pieces(hashes), "checks": pieces(checks), "records": pieces(records)}
    )


def _load(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All hashes, checks (0 where none are kept) and records of the rows, and how many each row has."""
    hashes = [np.frombuffer(b, dtype=np.uint64) for b in table.column("hashes").to_pylist()]
    checks = [np.frombuffer(b, dtype=np.uint32) if b else np.zeros(len(h), dtype=np.uint32) for h, b in zip(hashes, table.column("checks").to_pylist())]
    records = [np.frombuffer(b, dtype=np.uint32) for b in table.column("records").to_pylist()]
    return np.concatenate(hashes), np.concatenate(checks), np.concatenate(records), np.array([len(h) for h in hashes])


def _reply(round_no: int):
    def merge(table: pa.Table) -> pa.Table:
        runs = table.column("run").to_numpy()
        h, c, r, sizes = _load(table)
        order = _order(h, c)
        first = _starts(h[order], c[order])
        low, high = np.minimum.reduceat(r[order], first), np.maximum.reduceat(r[order], first)
        shared = np.empty(len(h), dtype=bool)
        shared[order] = np.repeat((low != high) | (low == SEVERAL), np.diff(np.r_[first, len(h)]))
        edge = np.r_[0, np.cumsum(sizes)]
        own = [i for i in range(len(runs)) if runs[i] >= 0]
        return pa.table(
            {
                "run": pa.array([runs[i] for i in own], pa.int32()),
                "round": pa.array([round_no] * len(own), pa.int32()),
                "range": pa.array([table.column("range")[0].as_py()] * len(own), pa.int32()),
                "bits": pa.array([np.packbits(shared[edge[i] : edge[i + 1]]).tobytes() for i in own], pa.binary()),
            }
        )

    return merge


def _marked(hashes: np.ndarray, replies: pa.Table, round_no: int, bits: int) -> np.ndarray:
    """Which of a run's hashes the merge found in other records too."""
    found, edge = _cells(hashes, bits)
    keep = np.zeros(len(hashes), dtype=bool)
    answered = 0
    for n, i, mask in zip(replies.column("round").to_pylist(), replies.column("range").to_pylist(), replies.column("bits").to_pylist()):
        if n == round_no:
            at = int(np.searchsorted(found, i))
            if at == len(found) or found[at] != i or len(mask) != -(-int(edge[at + 1] - edge[at]) // 8):
                raise RuntimeError("a run changed between two rounds")
            size = int(edge[at + 1] - edge[at])
            keep[edge[at] : edge[at + 1]] = np.unpackbits(np.frombuffer(mask, dtype=np.uint8), count=size)
            answered += size
    if answered != len(hashes):
        raise RuntimeError("a run has hashes without a reply")
    return keep


def _trimmed(text: str):
    white = r"[\t-\r\x1c-\x1f \x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
    return F.regexp_replace(F.regexp_replace(text, "^" + white, ""), white + r"\z", "")


def _as_records(df: DataFrame, run_count: int) -> DataFrame:
    """(run, src, item_key, record, seed, text), white space at both ends of text removed.

    Rows repeated are dropped, most of them before they are shuffled, and the
    text has a part in choosing the run: neither copies of one row nor a key
    that many rows have gather in one run.
    """
    once = df.select("src", "item_key", _trimmed("text").alias("text")).withColumn("h", F.xxhash64("text")).groupBy("src", "item_key", "h").agg(F.first("text").alias("text"))
    record = F.pmod(F.xxhash64("item_key", F.lit(1)), F.lit(2**32 - 1)) + 1  # 1 .. 2**32 - 1
    return once.select(
        F.pmod(F.xxhash64("src", "item_key", "h"), F.lit(run_count)).cast("int").alias("run"),
        "src",
        "item_key",
        record.alias("record"),
        F.pmod(F.xxhash64("src", F.lit(2)), F.lit(2**62)).alias("seed"),
        "text",
    )


def _run_count(df: DataFrame, run_chars: int) -> int:
    """Runs by the code points of all texts, so that each has a bounded size."""
    chars = df.agg(F.sum(F.length("text"))).first()[0] or 0
    return max(1, -(-chars // run_chars))


def _recut(runs: DataFrame, bits: int, keep: list[str]) -> DataFrame:
    """Rows of runs with their ranges cut by so many bits; the columns keep stay."""

    def run(batches):
        for batch in batches:
            rows, parts = [], []
            for i in range(batch.num_rows):
                row = pa.Table.from_batches([batch.slice(i, 1)])
                h, c, r, _ = _load(row)
                made = _parts(h, c if row.column("checks")[0].as_py() else None, r, -1, bits)
                rows += [i] * made.num_rows
                parts.append(made)
            if parts:
                whole = pa.concat_tables(parts)
                kept = batch.select(keep).take(pa.array(rows, pa.int64()))
                out = pa.table([*kept.columns, *whole.columns], names=[*keep, *whole.column_names])
                yield from out.to_batches()

    kinds = {f.name: f.dataType.simpleString() for f in runs.schema}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keep), PART])
    return runs.select(*keep, "hashes", "checks", "records").mapInArrow(run, schema)


def span_runs(df: DataFrame, segment: int, length: int = LENGTH, run_chars: int = RUN_CHARS) -> DataFrame:
    """The minima and all windows of a batch df(src, item_key, text) as a segment of level 0 of a history.

    Texts that are null, empty or shorter than length have no window and
    leave nothing. Segments are told apart by their number.
    """
    spark = df.sparkSession
    rows = df.filter(F.length("text") >= length)
    count = _run_count(rows, run_chars)
    records = _as_records(rows, count)
    bits = _bits(count * run_chars, spark)

    def build(table: pa.Table) -> pa.Table:
        made = _Run(table, length)
        key, r, _ = made.minima()
        both = [("minima", _parts(key, None, r, -1, bits)), ("windows", _parts(*made.windows(None), -1, bits))]
        return pa.concat_tables([t.add_column(0, "kind", pa.array([kind] * t.num_rows, pa.string())) for kind, t in both])

    found = records.groupBy("run").applyInArrow(build, "kind string, " + PART)
    return found.select("kind", F.lit(0).alias("level"), F.lit(segment).cast("bigint").alias("segment"), F.lit(length).alias("length"), "bits", "range", "hashes", "checks", "records")


def compact(history: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """History with every level of at least fan_in segments merged into one segment of the next, and so on upwards.

    Of equal hashes of a merged segment one is kept. Only the numbers of
    segments, under fan_in a level, come to the driver; ranges are cut so fine
    that a task merges about RANGE_HASHES of them.
    """
    sizes = F.sum(F.length("hashes") / 8).cast("bigint")
    known = history.groupBy("level", "segment").agg(sizes.alias("n")).collect()  # one row for each segment
    place = {(r["level"], r["segment"]): (r["level"], r["segment"]) for r in known}
    level = 0
    while place and level <= max(at for at, _ in place.values()):
        here = sorted({segment for at, segment in place.values() if at == level})
        if len(here) >= fan_in:
            place = {k: (level + 1, here[-1]) if v[0] == level else v for k, v in place.items()}
        level += 1
    moved = {k: v for k, v in place.items() if k != v}
    if not moved:
        return history
    spark = history.sparkSession
    plan = F.broadcast(spark.createDataFrame([(*k, *v) for k, v in moved.items()], "level int, segment bigint, new_level int, new_segment bigint"))
    bits = _bits(sum(r["n"] for r in known), spark)
    keep = ["kind", "new_level", "new_segment", "length"]
    cut = _recut(history.join(plan, ["level", "segment"]), bits, keep)

    def merge(table: pa.Table) -> pa.Table:
        h, c, r, _ = _load(table)
        made = _parts(*_distinct([h], [c], [r]), -1, bits)
        if not table.column("checks")[0].as_py():
            made = made.set_column(made.column_names.index("checks"), "checks", pa.array([b""] * made.num_rows, pa.binary()))
        first = {k: table.column(k)[0].as_py() for k in keep}
        return pa.table([pa.array([first[k]] * made.num_rows, table.schema.field(k).type) for k in keep] + made.columns, names=[*keep, *made.column_names])

    kinds = {f.name: f.dataType.simpleString() for f in cut.schema}
    merged = cut.groupBy("kind", "new_segment", "range").applyInArrow(merge, ", ".join([*(f"{k} {kinds[k]}" for k in keep), PART]))
    merged = merged.select("kind", F.col("new_level").alias("level"), F.col("new_segment").alias("segment"), "length", "bits", "range", "hashes", "checks", "records")
    return history.join(plan, ["level", "segment"], "left_anti").select(merged.columns).unionByName(merged)


def shared_spans(df: DataFrame, length: int = LENGTH, history: DataFrame | None = None, run_chars: int = RUN_CHARS) -> DataFrame:
    """(src, item_key, n_chars, shared_chars, shared_share, n_spans) of each record of df(src, item_key, text).

    shared_chars counts the code points that lie in some span of at least
    length consecutive ones which stands, equal in every code point, in
    another record of the same src. Rows of one key are one record, whose row
    with the largest share counts. Null, empty and shorter texts share
    nothing and have n_spans 0. With history (segments of span_runs of earlier
    batches, compacted or not, in a stored table) records there count too; a
    history of another length is refused.
    """
    if length < GRAM + WINNOW:
        raise ValueError(f"spans of under {GRAM + WINNOW} code points can't be found by these minima")
    spark = df.sparkSession
    kept = {"minima": 0, "windows": 0}
    if history is not None:
        for r in history.groupBy("kind", "length").agg(F.sum(F.length("hashes") / 8).cast("bigint").alias("n")).collect():  # two rows
            if r["length"] != length:
                raise ValueError(f"the history has spans of {r['length']} code points, not of {length}")
            kept[r["kind"]] = r["n"]
    long = df.filter(F.length("text") >= length)
    run_count = _run_count(long, run_chars)
    records = _as_records(long, run_count)
    # a minimum stands for half of its neighbours on average; windows are all code points at most
    bits1, bits2 = _bits(kept["minima"] + run_count * run_chars * 2 // WINNOW, spark), _bits(kept["windows"] + run_count * run_chars, spark)

    def first_round(table: pa.Table) -> pa.Table:
        key, r, _ = _Run(table, length).minima()
        return _parts(key, None, r, table.column("run")[0].as_py(), bits1)

    def shared_minima(run: _Run, replies: pa.Table) -> np.ndarray:
        key, _, h = run.minima()
        return np.sort(h[_marked(key, replies, 1, bits1)])

    def second_round(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _parts(np.zeros(0, np.uint64), None, np.zeros(0, np.uint32), 0, bits2)
        run = _Run(table, length)
        return _parts(*run.windows(shared_minima(run, replies)), table.column("run")[0].as_py(), bits2)

    def result(table: pa.Table, replies: pa.Table) -> pa.Table:
        if table.num_rows:
            run = _Run(table, length)
            known = shared_minima(run, replies)
            h = run.windows(known)[0]
            chars, spans = run.covered(known, h[_marked(h, replies, 2, bits2)])
            sizes = np.array([len(t) for t in table.column("text").to_pylist()], dtype=np.int64)
        else:
            chars = spans = sizes = np.zeros(0, dtype=np.int64)
        return pa.table({"src": table.column("src"), "item_key": table.column("item_key"), "n_chars": pa.array(sizes), "shared_chars": pa.array(chars), "n_spans": pa.array(spans)})

    def with_history(parts: DataFrame, kind: str, bits: int) -> DataFrame:
        return parts if history is None else parts.unionByName(_recut(history.filter(F.col("kind") == kind), bits, []))

    by_run = records.groupBy("run")
    parts = with_history(by_run.applyInArrow(first_round, PART), "minima", bits1)
    replies = parts.groupBy("range").applyInArrow(_reply(1), REPLY)
    parts = with_history(by_run.cogroup(replies.groupBy("run")).applyInArrow(second_round, PART), "windows", bits2)
    replies = replies.unionByName(parts.groupBy("range").applyInArrow(_reply(2), REPLY))
    found = by_run.cogroup(replies.groupBy("run")).applyInArrow(result, "src string, item_key string, n_chars bigint, shared_chars bigint, n_spans bigint")
    short = df.filter(F.col("text").isNull() | (F.length("text") < length)).select(
        "src", "item_key", F.coalesce(F.length(_trimmed("text")), F.lit(0)).cast("bigint").alias("n_chars"), F.lit(0).cast("bigint").alias("shared_chars"), F.lit(0).cast("bigint").alias("n_spans")
    )
    share = F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(F.lit(0.0))
    best = F.max(F.struct("shared_chars", "n_chars", "n_spans")).alias("best")
    whole = found.unionByName(short).groupBy("src", "item_key").agg(best).select("src", "item_key", "best.n_chars", "best.shared_chars", "best.n_spans")
    return whole.withColumn("shared_share", share)
