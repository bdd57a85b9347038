"""Problem 7: the whole corpus as token ids of a public tokenizer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.byte_bpe import DEFAULT_VOCABULARY, encoder
from paperloom.llm.common import list_column

#: Texts of one batch are encoded in groups of at most this many characters,
#: or one text, so that a worker's memory doesn't follow the batch.
GROUP_CHARS = 4_000_000


def _groups(texts: pa.Array):
    sizes = pc.utf8_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(sizes):
        reach = np.cumsum(sizes[at:])
        n = max(1, int(np.searchsorted(reach, GROUP_CHARS, side="right")))
        yield at, n
        at += n


def encode_texts(df: DataFrame, key: str, text: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, ids) of every row; no shuffle.

    ids is an empty list for an empty and for a null text; a null key stays
    null; repeated rows give repeated rows; other columns are dropped, so
    their names can't clash.
    """

    def run(batches):
        encode = encoder(vocabulary).encode
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for at, n in _groups(texts):
                coded = [encode(t) for t in texts.slice(at, n).to_pylist()]
                lengths = np.fromiter(map(len, coded), dtype=np.int64, count=n) // 4
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(at, n), list_column(np.frombuffer(b"".join(coded), dtype="<i4"), lengths)], ["key", "ids"]
                )

    kind = df.schema[key].dataType.simpleString()
    chosen = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def count_tokens(df: DataFrame, key: str, text: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, n_tokens) of every row; 0 for empty and null texts."""

    def run(batches):
        encode = encoder(vocabulary).encode
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for at, n in _groups(texts):
                lengths = np.fromiter((len(encode(t)) for t in texts.slice(at, n).to_pylist()), dtype=np.int64, count=n) // 4
                yield pa.RecordBatch.from_arrays([keys.slice(at, n), pa.array(lengths)], ["key", "n_tokens"])

    kind = df.schema[key].dataType.simpleString()
    chosen = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, f"key {kind}, n_tokens bigint").withColumnRenamed("key", key)
