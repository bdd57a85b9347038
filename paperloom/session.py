"""Session set-up, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


#: Tables of more bytes than this, by the scan's size, are never dealt out anew.
SPREAD_BYTES = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """A small df over as many partitions as there are cores, where its files give fewer.

    For work that costs far more than moving the rows. What is moved is at
    most SPREAD_BYTES at any size of the cluster; larger tables keep the
    partitions of their scan.
    """
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SPREAD_BYTES:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="paperloom-checkpoint-")
        atexit.register(shutil.rmtree, shared, True)
    sc.setCheckpointDir(shared)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder of that name for tables a query writes, under the shared checkpoint folder; in local mode only, a temporary one where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="paperloom-tables-")
        atexit.register(shutil.rmtree, base, True)
    return f"{base}/{name}-{os.urandom(6).hex()}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from the files.

    Files survive the loss of any executor, and what follows is computed from
    one fixed copy however often a stage is retried.
    """
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of one key that one join task may meet, and hot keys that are broadcast at most (some 3 MB).
HOT_ROWS, HOT_KEYS = 10_000, 100_000
#: The same where a table meets itself, so that a key's pairs grow with the square of its rows.
PAIR_ROWS = 500


def split_hot(left: DataFrame, right: DataFrame, on: list[str], most: int = HOT_ROWS, part: str = "_part") -> tuple[DataFrame, DataFrame, list[str]]:
    """(left, right, keys) whose inner join on keys is that of left and right on on, with hot keys split.

    A key of more than most rows on the left is dealt over so many parts that
    each has about most of them, and its rows on the right are repeated for
    each part, so neither a task nor a driver gathers it. Left is read twice
    and should be a stored table. Without hot keys nothing is added, else the
    column part on both sides.
    """
    hot = left.groupBy(*on).agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select(*on, F.ceil(F.col("_n") / most).cast("int").alias("_parts"))
    hot = cut_lineage(hot)
    found = hot.limit(HOT_KEYS + 1).count()
    if not found:
        return left, right, on
    small = F.broadcast(hot) if found <= HOT_KEYS else hot
    parts = F.coalesce("_parts", F.lit(1))
    dealt = left.join(small, on, "left").withColumn(part, F.pmod(F.xxhash64(*left.columns, F.lit(1)), parts).cast("int")).drop("_parts")
    copied = right.join(small, on, "left").withColumn(part, F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt, copied, [*on, part]
