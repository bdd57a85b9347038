"""The functions that Spark lacks, under names that SQL can use."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from paperloom.functions import similarity as S
from paperloom.functions import text as X


@F.arrow_udf(ArrayType(IntegerType()))
def _signature(texts: pa.Array) -> pa.Array:
    sets = [S.hash_set(t) if t else () for t in texts.to_pylist()]
    return pa.array([S.minima(h) if len(h) else None for h in sets], pa.list_(pa.int32()))


def register(spark: SparkSession) -> list[str]:
    """Makes indel_ratio, sequence_ratio, nfkc and minhash_signature known to SQL; returns their names. All work on Arrow batches."""
    made = {"indel_ratio": S.indel_ratio, "sequence_ratio": S.sequence_ratio, "nfkc": X.nfkc_udf, "minhash_signature": _signature}
    for name, function in made.items():
        spark.udf.register(name, function)
    return sorted(made)
