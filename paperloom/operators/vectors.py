"""Nearest neighbours by inner product of unit vectors, exact or through cells."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom import constants as K
from paperloom.session import cut_lineage

#: Query vectors of one block; a block of 32-bit floats of 768 dimensions is 6 MB. Corpus blocks have four times as many.
BLOCK = 2048
#: From so many vectors on an index has cells, at most MOST_CELLS of them.
CELLS_FROM, MOST_CELLS = 100_000, 4096
#: Vectors that cells are fitted on: so many for each cell, and at most SAMPLE in all (200 MB of 768 dimensions).
EACH_CELL, SAMPLE = 64, 65_536
#: Recall that the number of cells looked into must reach on a part of the sample, before the index is used.
RECALL = 0.95
ROUNDS, TRIED = 12, 256


def _blocks(df: DataFrame, key: str, vector: str, by: list[str], size: int, salt: int) -> DataFrame:
    """(by, ids, vs): rows of df packed into blocks of about size rows within each value of by; a large group has several."""
    rows = df.select(*by, F.col(key).alias("id"), F.col(vector).alias("v"))
    counts = rows.groupBy(*by).agg(F.count("*").alias("n")) if by else rows.agg(F.count("*").alias("n"))
    sized = counts.withColumn("parts", F.ceil(F.col("n") / size).cast("int")).drop("n")
    placed = rows.join(sized, by) if by else rows.crossJoin(F.broadcast(sized))  # one row
    part = F.pmod(F.xxhash64("id", F.lit(salt)), F.greatest("parts", F.lit(1)))
    return placed.withColumn("part", part).groupBy(*by, "part").agg(F.collect_list(F.struct("id", "v")).alias("rows")).select(*by, "part", F.col("rows.id").alias("ids"), F.col("rows.v").alias("vs"))


def _matrix(column: pa.ListArray, i: int) -> np.ndarray:
    """The vectors of one block as unit rows."""
    rows = column[i].values
    return _unit(rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1).astype(np.float64))


def _product(k: int):
    def run(batches):
        for batch in batches:
            qids, qvs, ids, vs = (batch.column(c) for c in ("qids", "qvs", "ids", "vs"))
            for i in range(batch.num_rows):
                q, c = _matrix(qvs, i), _matrix(vs, i)
                if q.shape[1] != c.shape[1]:
                    raise ValueError(f"vectors of {q.shape[1]} and of {c.shape[1]} dimensions")
                own, there = np.array(qids[i].as_py()), np.array(ids[i].as_py())
                scores = q @ c.T
                scores[own[:, None] == there[None, :]] = -np.inf
                top = min(k, scores.shape[1])
                if top < scores.shape[1]:
                    # all that reach the k-th best, so that ties are settled by id
                    least = np.partition(scores, -top, axis=1)[:, -top]
                    row, col = np.nonzero(scores >= least[:, None])
                else:
                    row, col = np.nonzero(np.isfinite(scores))
                value = scores[row, col]
                order = np.lexsort((there[col], -value, row))
                row, col, value = row[order], col[order], value[order]
                place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
                keep = (place < top) & np.isfinite(value)
                yield pa.RecordBatch.from_arrays([pa.array(own[row[keep]]), pa.array(there[col[keep]]), pa.array(value[keep])], ["query_id", "vec_id", "cosine"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(queries: DataFrame, corpus: DataFrame, key: str, vector: str, k: int = 20) -> DataFrame:
    """(query_id, vec_id, cosine, rank): the k nearest rows of the corpus for each query, the exact ones, a row itself left out.

    The stated queries meet all rows in blocks: each block of queries is sent
    to each block of the corpus, an equi-join on the block's number, and they
    meet in one matrix product; only a block's best k for each query leave it,
    so what is shuffled is k rows a query and block, never the product. Zero
    vectors have cosine 0 with all; null vectors are left out; vectors of
    different dimensions are an error.
    """
    known = lambda df: df.filter(F.col(vector).isNotNull())
    asked = _blocks(known(queries), key, vector, [], BLOCK, 1).select(F.col("ids").alias("qids"), F.col("vs").alias("qvs"))
    there = cut_lineage(_blocks(known(corpus), key, vector, [], 4 * BLOCK, 7))
    sent = asked.join(F.broadcast(there.agg(F.max("part").alias("last"))), F.lit(True)).select("qids", "qvs", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("part"))
    kind = corpus.schema[key].dataType.simpleString()
    found = sent.join(there, "part").select("qids", "qvs", "ids", "vs").mapInArrow(_product(k), f"query_id {kind}, vec_id {kind}, cosine double")
    return _best(found, k)


class Cells:
    """Centres of the cells of an index and how many of the nearest a query looks into."""

    def __init__(self, centres: np.ndarray, probes: int, recall: float):
        self.centres, self.probes, self.recall = centres, probes, recall


def _lloyd(sample: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means of unit vectors; an empty cell starts anew at a random vector."""
    draw = np.random.default_rng(42)
    centres = sample[draw.choice(len(sample), cells, replace=False)]
    for _ in range(ROUNDS):
        own = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        empty = np.bincount(own, minlength=cells) == 0
        sums[empty] = sample[draw.choice(len(sample), int(empty.sum()))]
        centres = _unit(sums)
    return centres


def fit_cells(corpus: DataFrame, vector: str, k: int = 20, cells: int | None = None, probes: int | None = None) -> Cells:
    """Cells for all vectors of corpus, fitted on a sample of at most SAMPLE of them; cells is by default the root of their number, MOST_CELLS at most.

    Equal vectors of the sample count once. Without probes their number is
    measured: for TRIED vectors of the sample against the rest of it by brute
    force, the least one with a recall of RECALL, which is kept with the
    result.
    """
    known = corpus.filter(F.col(vector).isNotNull())
    n = known.count()
    cells = max(1, min(cells or min(math.isqrt(n), MOST_CELLS), n))
    size = min(SAMPLE, max(EACH_CELL * cells, 8 * TRIED))
    share = min(1.0, 1.2 * size / max(1, n))
    drawn = known.select(vector) if share == 1 else known.sample(share, 42).select(vector)
    rows = drawn.limit(size).toArrow()[vector]  # at most SAMPLE
    if not len(rows):
        return Cells(np.zeros((1, 1)), 1, 1.0)
    sample = _unit(np.array(rows.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1), dtype=np.float64))
    # copies would take cells for themselves and make the recall look better than it is
    sample = np.random.default_rng(7).permutation(np.unique(sample, axis=0))
    cells = min(cells, len(sample))
    centres = _lloyd(sample, cells)
    tried, rest = sample[:TRIED], sample[TRIED:] if len(sample) > 2 * TRIED else sample
    scores = tried @ rest.T
    truth = np.argsort(-scores, axis=1)[:, : min(k, len(rest))]
    home = np.argmax(rest @ centres.T, axis=1)
    near = np.argsort(-(tried @ centres.T), axis=1)
    place = np.empty_like(near)
    np.put_along_axis(place, near, np.arange(cells)[None, :].repeat(len(tried), 0), axis=1)
    needed = np.take_along_axis(place, home[truth], axis=1)  # how many cells a query must open to see each neighbour
    recall = lambda p: float((needed < p).mean())
    probes = probes or next(p for p in range(1, cells + 1) if recall(p) >= RECALL)
    return Cells(centres, probes, recall(probes))


def nearest_in_cells(queries: DataFrame, corpus: DataFrame, key: str, vector: str, k: int = 20, index: Cells | None = None) -> DataFrame:
    """(query_id, vec_id, cosine, rank): the k nearest rows of the corpus in the cells nearest to each query; approximate.

    Every vector lies in one cell; a query goes to index.probes cells. Cells
    are packed into blocks of bounded size, so a cell that holds a third of all
    vectors is several tasks.
    """
    index = index or fit_cells(corpus, vector, k)
    shared = corpus.sparkSession.sparkContext.broadcast(index)  # MOST_CELLS centres at most
    kind = corpus.schema[key].dataType.simpleString()

    def cells_of(probes: int):
        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = batch.column(1)
                unit = _unit(v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1).astype(np.float64))
                near = np.argsort(-(unit @ shared.value.centres.T), axis=1, kind="stable")[:, :probes]
                rows = pa.array(np.repeat(np.arange(len(v)), near.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), batch.column(0).take(rows), v.take(rows)], ["cell", "id", "v"])

        return run

    def placed(df: DataFrame, probes: int) -> DataFrame:
        rows = df.filter(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast("array<float>").alias("v"))
        return cut_lineage(rows.mapInArrow(cells_of(probes), f"cell int, id {kind}, v array<float>"))

    there = _blocks(placed(corpus, 1), "id", "v", ["cell"], 4 * BLOCK, 7).drop("part")
    asked = _blocks(placed(queries, index.probes), "id", "v", ["cell"], BLOCK, 1).select("cell", F.col("ids").alias("qids"), F.col("vs").alias("qvs"))
    found = asked.join(there, "cell").select("qids", "qvs", "ids", "vs").mapInArrow(_product(k), f"query_id {kind}, vec_id {kind}, cosine double")
    return _best(found, k)


def search(queries: DataFrame, corpus: DataFrame, key: str, vector: str, k: int = 20) -> DataFrame:
    """The k nearest rows: exact up to CELLS_FROM vectors, through cells beyond, as published; nearest() is exact at any size."""
    return (nearest if corpus.filter(F.col(vector).isNotNull()).count() < CELLS_FROM else nearest_in_cells)(queries, corpus, key, vector, k)


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(size > 0, size, 1.0)


def embed(df: DataFrame, key: str, text: str, model: Callable[[list[str]], np.ndarray], size: int = 64) -> DataFrame:
    """(key, embedding) of each text, by a model of the caller's from a list of texts to a matrix; null and empty texts have a null vector.

    The model is called in the tasks with size texts at a time; it should load
    what it needs at its first call.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            known = [i for i, t in enumerate(texts) if t]
            out: list[list[float] | None] = [None] * len(texts)
            for at in range(0, len(known), size):
                part = known[at : at + size]
                for i, v in zip(part, np.asarray(model([texts[i] for i in part]), dtype=np.float32)):
                    out[i] = v.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float32()))], [key, "embedding"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, embedding array<float>")


def semantic_score(best_cosine):
    """Cosine above the threshold, stretched to 0 .. 1."""
    return F.greatest(F.lit(0.0), (best_cosine - K.SEMANTIC_THRESHOLD) / (1 - K.SEMANTIC_THRESHOLD))


def index_positions(df: DataFrame, order: list[str], out: str = "index_position") -> DataFrame:
    """df with the place of each row, from 0, in the order of the columns order, nulls first.

    Rows are ranged over partitions and numbered there; the partitions' counts
    give the offsets, so no task holds the whole order. Rows that tie get
    neighbouring places.
    """
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_row", row))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offsets = ranged.groupBy("_part").agg(F.count("*").alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    return ranged.join(offsets, "_part").withColumn(out, F.col("_row") + F.col("_offset")).drop("_part", "_row", "_offset")
