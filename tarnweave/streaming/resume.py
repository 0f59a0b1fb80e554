"""Incremental runs: a file stream that skips what is done and records failures."""

from __future__ import annotations

import multiprocessing
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def outstanding(batch: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return batch.join(done.select(key).distinct(), key, "left_anti")


def run_available(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], key: str) -> None:
    """Read new Parquet files of `source`, take out keys that the sink has, append work(rest);
    run again, it goes on where it stopped. work adds a status column; a row that fails is
    recorded with its status like any other."""

    def each(batch: DataFrame, _: int) -> None:
        jvm = spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(sink)
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        todo = outstanding(batch.dropDuplicates([key]), spark.read.parquet(sink), key) if there else batch.dropDuplicates([key])
        work(todo).write.mode("append").parquet(sink)

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class _Watched:
    """A step in a process of its own, which is ended when a row takes longer than `limit` seconds; the next row gets a new one."""

    def __init__(self, f: Callable, limit: float):
        self.f, self.limit, self.child = f, limit, None

    def _serve(self, there) -> None:
        while True:
            try:
                row = there.recv()
            except EOFError:
                return
            try:
                there.send((self.f(row), "OK"))
            except Exception as e:  # noqa: BLE001  one row's failure is its status
                there.send((None, f"FAILED ({type(e).__name__})"))

    def __call__(self, row: dict) -> tuple:
        if self.child is None:
            fork = multiprocessing.get_context("fork")
            self.here, there = fork.Pipe()
            self.child = fork.Process(target=self._serve, args=(there,), daemon=True)
            self.child.start()
            there.close()
        try:
            self.here.send(row)
            if self.here.poll(self.limit):
                return self.here.recv()
            status = "TIMEOUT"
        except (EOFError, OSError):
            status = "FAILED (died)"
        self.close()
        return None, status

    def close(self) -> None:
        if self.child is not None:
            self.child.kill()
            self.child.join()
            self.here.close()
            self.child = None


def guarded(f: Callable, out: str, limit: float | None = None):
    """A row-wise step for mapInPandas: status OK, or the error of that row alone. With a limit in seconds rows are watched: one
    that takes longer has the status TIMEOUT, one that ends its process FAILED (died), and the batch goes on."""

    def plain(row: dict) -> tuple:
        try:
            return f(row), "OK"
        except Exception as e:  # noqa: BLE001  one row's failure is its status
            return None, f"FAILED ({type(e).__name__})"

    def run(batches):
        step = _Watched(f, limit) if limit is not None else plain
        try:
            for pdf in batches:
                found = [step(row) for row in pdf.to_dict("records")]
                yield pdf.assign(**{out: [v for v, _ in found], "status": [s for _, s in found]})
        finally:
            if limit is not None:
                step.close()

    return run


def windowed_counts(events: DataFrame, time: str = "ts", width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts of event types in tumbling windows, for batch and stream; late rows are dropped after `late`."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, width), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
