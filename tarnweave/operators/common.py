"""Checkpoints and work folders in the shared folder, and numbers in a global order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_paths: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Only a session of a single machine gets a
    fresh local folder where that is unset."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tarnweave-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """df, computed once and stored in the shared folder; the lineage ends here."""
    shared_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    _paths.append(out._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get())
    return out


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_folder(spark)}/tarnweave-{name}-{uuid.uuid4().hex}"
    _paths.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget(df: DataFrame) -> None:
    """Delete the files of a checkpoint that nothing will read again."""
    file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined() and file.get() in _paths:
        _paths.remove(file.get())
        remove(df.sparkSession, file.get())


def clean_up(spark: SparkSession) -> None:
    """Delete the checkpoints and work folders of this driver's operators. Results that were not written yet need them."""
    while _paths:
        remove(spark, _paths.pop())


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with its rows numbered from 0 in a global order: each task numbers its own range, and the
    ranges' sizes (a number for each task) are added up."""
    rows = checkpoint(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()))
    task, nth = F.shiftrightunsigned("__m", 33), F.col("__m").bitwiseAND((1 << 33) - 1)
    at, before = [], 0
    for r in sorted(rows.groupBy(task.alias("t")).agg(F.count(F.lit(1)).alias("n")).collect()):
        at += [F.lit(r["t"]).cast("long"), F.lit(before).cast("long")]
        before += r["n"]
    start = F.element_at(F.create_map(*at), task) if at else F.lit(0).cast("long")
    return rows.withColumn(name, start + nth).drop("__m")
