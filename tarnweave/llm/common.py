"""Helpers shared by the corpus operators: shared work folder, checkpoints, word patterns."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as all operators of this package understand it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_paths: list[str] = []


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors: spark.checkpoint.dir. Only a session of a single
    machine gets a fresh local one where that is unset."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tarnweave-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def checkpoint(df: DataFrame) -> DataFrame:
    """df, computed once and stored in the shared folder; the lineage ends here."""
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    _paths.append(out._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get())
    return out


def work_path(spark: SparkSession, name: str) -> str:
    """A new path for tables in the shared folder."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tarnweave-{name}-{uuid.uuid4().hex}"
    _paths.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clean_up(spark: SparkSession) -> None:
    """Delete all tables and checkpoints that operators of this driver have put in the shared
    folder. Results that were not written yet need them."""
    while _paths:
        remove(spark, _paths.pop())


def row_hash(columns: list[Column], seed: int = 0) -> Column:
    """A hash of all columns that tells nulls apart by their place."""
    return F.xxhash64(F.lit(seed), *[x for c in columns for x in (c.isNull(), c)])


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with its rows numbered from 0 in a global order: tasks number their own range, and the
    ranges' sizes are added up."""
    rows = checkpoint(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__tw_m", F.monotonically_increasing_id()))
    task, nth = F.shiftrightunsigned("__tw_m", 33), F.col("__tw_m").bitwiseAND((1 << 33) - 1)
    sizes, before, at = rows.groupBy(task.alias("t")).agg(F.count(F.lit(1)).alias("n")).collect(), 0, {}  # a row for each task
    for r in sorted(sizes):
        at[r["t"]], before = before, before + r["n"]
    start = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in at.items() for x in kv]), task) if at else F.lit(0).cast("long")
    return rows.withColumn(name, start + nth).drop("__tw_m")


#: Copies of an equal row that are numbered at once.
SPREAD = 100_000


def repeated(df: DataFrame, n: str, by: list[str]) -> DataFrame:
    """Each row of df as often as its column n says, numbered from 0 in a new column nth; a row with very
    many copies is dealt to several tasks. by: columns that tell rows apart."""
    rows = df.withColumn("__tw_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / SPREAD))))
    rows = rows.repartition(*by, "__tw_part").withColumn("__tw_at", F.col("__tw_part") * SPREAD)
    last = F.least(F.col("__tw_at") + SPREAD, F.col(n)) - 1
    return rows.withColumn("nth", F.explode(F.sequence(F.col("__tw_at"), last))).drop("__tw_part", "__tw_at")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder; the shuffle files that made it are removed at once."""
    spark, path = df.sparkSession, work_path(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.parquet(path)


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """From now on the session hands at most `rows` rows at a time to Python workers: whole texts
    are long, and both sides hold a batch. The plan reads this when it runs, so it stays set."""
    now = int(spark.conf.get(_BATCH, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(_BATCH, str(rows))


def release_memory() -> None:
    """Hand back to the system what a Python worker has freed; idle workers keep it otherwise."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)
