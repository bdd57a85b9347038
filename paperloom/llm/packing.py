"""Problem 8: filling containers of fixed capacity with items of varying length.

The corpus is seen by the planner as a histogram of lengths, which has at most
as many rows as the capacity has units. Shallow combinations of lengths that
fill a window just under the capacity become the columns of a non-negative
least-squares problem against that histogram; the rounded solution says how
often each combination is used, and what the rounding leaves is packed by best
fit, again on the histogram. The plan is a table of (length, ranks from, to)
-> containers, and each item finds its container by its rank among the items
of its length: no item ever travels to the driver.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.encode import count_tokens
from paperloom.session import cut_lineage

#: Combinations may leave this share of the capacity unused.
SLACK = 1 / 256
#: Combinations the planner enumerates for each length.
PER_LENGTH = 6
#: Rows of one length ranked by one task.
RANK_ROWS = 200_000


def shallow_combinations(lengths: np.ndarray, capacity: int, slack: int, per_length: int = PER_LENGTH) -> list[dict[int, int]]:
    """Combinations of at most three different lengths that fill the window.

    Each takes one length some times, perhaps a second once, and closes with
    the length that comes nearest to the space left.
    """
    have = [int(x) for x in lengths]
    out: dict[tuple, dict[int, int]] = {}

    def close(base: dict[int, int], room: int) -> None:
        if 0 < room:
            at = bisect.bisect_right(have, room) - 1
            if at < 0 or have[at] < room - slack:
                return
            base = dict(base)
            base[have[at]] = base.get(have[at], 0) + 1
        out.setdefault(tuple(sorted(base.items())), base)

    for i, length in enumerate(have):
        most = capacity // length
        for times in dict.fromkeys(max(1, most * k // per_length) for k in range(1, per_length + 1)):
            room = capacity - times * length
            if room <= slack:
                close({length: times}, 0)
                continue
            close({length: times}, room)
            second = have[(i * 7 + times * 13) % len(have)]
            if second < room:
                base = {length: times}
                base[second] = base.get(second, 0) + 1
                close(base, room - second)
    return list(out.values())


def solve_counts(columns: list[dict[int, int]], histogram: dict[int, int], sweeps: int = 60) -> np.ndarray:
    """Non-negative least squares by cyclic coordinate descent on sparse columns."""
    size = max(histogram) + 1
    left = np.zeros(size)
    for length, n in histogram.items():
        left[length] = n
    sparse = [(np.array(list(c)), np.array(list(c.values()), dtype=float)) for c in columns]
    norms = [float(v @ v) for _, v in sparse]
    x = np.zeros(len(columns))
    for _ in range(sweeps):
        moved = 0.0
        for j, (rows, values) in enumerate(sparse):
            step = max(-x[j], float(left[rows] @ values) / norms[j])
            if step:
                x[j] += step
                left[rows] -= step * values
                moved = max(moved, abs(step))
        if moved < 0.25:
            break
    return x


def plan_containers(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows (length, first rank, rank after the last, first container, items of that length in each), and the number of containers."""
    left = {length: n for length, n in histogram.items() if n > 0 and 0 < length <= capacity}
    used = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int]] = []
    containers = 0

    def take(pattern: dict[int, int], times: int) -> None:
        nonlocal containers
        for length, each in pattern.items():
            rows.append((length, used[length], used[length] + times * each, containers, each))
            used[length] += times * each
            left[length] -= times * each
        containers += times

    if left:
        lengths = np.array(sorted(left))
        columns = shallow_combinations(lengths, capacity, max(1, int(capacity * SLACK)))
        if columns:
            counts = solve_counts(columns, left)
            for j in np.argsort(-counts, kind="stable"):
                times = min(int(counts[j]), *(left[n] // each for n, each in columns[j].items()))
                if times > 0:
                    take(columns[j], times)
    active = sorted(n for n, k in left.items() if k > 0)
    while active:
        pattern, room = {active[-1]: 1}, capacity - active[-1]
        while room >= active[0]:
            at = bisect.bisect_right(active, room) - 1
            while at >= 0 and left[active[at]] <= pattern.get(active[at], 0):
                at -= 1
            if at < 0:
                break
            pattern[active[at]] = pattern.get(active[at], 0) + 1
            room -= active[at]
        take(pattern, min(left[n] // each for n, each in pattern.items()))
        for n in [n for n in pattern if not left[n]]:
            del active[bisect.bisect_left(active, n)]
    return rows, containers


def rank_within_size(items: DataFrame, order: list[str], size_counts: dict[int, int]) -> DataFrame:
    """A column rank, from 0 without gaps among the items of each size.

    A size is ranked in as many salted parts as its count needs; the parts'
    offsets come from their counts, so no task holds a whole hot size.
    """
    parts = max(1, -(-max(size_counts.values(), default=1) // RANK_ROWS))
    salted = items.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    offsets = (
        salted.groupBy("size", "salt")
        .count()
        .withColumn("offset", F.coalesce(F.sum("count").over(Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("count")
    )
    within = F.row_number().over(Window.partitionBy("size", "salt").orderBy(*order)) - 1
    return salted.withColumn("within", within).join(offsets, ["size", "salt"]).withColumn("rank", F.col("within") + F.col("offset")).drop("within", "offset", "salt")


def pack(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, part, container_id, n_units): where every item goes.

    Items over the capacity, and only those, are cut: full parts take a
    container each, the rest is packed like any item. Items of size 0 or null
    take no room and are spread over the containers (container 0 if there is
    no other). Rows with the same or a null key are items of their own. Other
    columns are dropped. An empty table gives an empty result.
    """
    sized = items.select(F.col(key).alias("key"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("whole"))
    whole_parts = F.ceil(F.col("whole") / capacity).cast("int")
    parts = cut_lineage(
        sized.select("key", F.explode(F.sequence(F.lit(0), F.greatest(whole_parts, F.lit(1)) - 1)).alias("part"), "whole").select(
            "key", "part", F.least(F.lit(capacity), F.col("whole") - F.col("part").cast("bigint") * capacity).alias("size")
        )
    )
    histogram = {r["size"]: r["n"] for r in parts.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most capacity + 1 rows
    rows, containers = plan_containers(histogram, capacity)
    plan: dict[int, tuple[np.ndarray, ...]] = {}
    for length in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == length)
        plan[length] = tuple(np.array(x, dtype=np.int64) for x in zip(*own))[1:]
    spread = max(1, containers)

    def place(batches):
        for batch in batches:
            sizes = batch.column("size").to_numpy(zero_copy_only=False)
            ranks = batch.column("rank").to_numpy(zero_copy_only=False)
            where = ranks % spread
            for length in np.unique(sizes[sizes > 0]):
                begins, _, first, each = plan[int(length)]
                mine = np.flatnonzero(sizes == length)
                at = np.searchsorted(begins, ranks[mine], side="right") - 1
                where[mine] = first[at] + (ranks[mine] - begins[at]) // each[at]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("part"), pa.array(where), batch.column("size")], ["key", "part", "container_id", "n_units"])

    kind = items.schema[key].dataType.simpleString()
    ranked = rank_within_size(parts, ["key", "part"], histogram).select("key", "part", "size", "rank")
    return ranked.mapInArrow(place, f"key {kind}, part int, container_id bigint, n_units bigint").withColumnRenamed("key", key)


def pack_documents(documents: DataFrame, capacity: int = 2048) -> DataFrame:
    """Where each text of documents, measured in tokens, goes."""
    return pack(count_tokens(documents, "doc_id", "text"), "doc_id", "n_tokens", capacity)
