"""Stateful incremental runs: what a key has gathered lives in the state store, not in the sink.

A run reads the files that are new, folds them into each key's state and appends what changed to the sink, a folder for each
micro-batch (written anew if the batch is tried again). The current rows are the latest of each key (`current`); no run reads
the sink. Results do not depend on how the input is split or on late rows: a session, an id or a merged threat is the same
after three runs over parts as after one over all, except that ids go by the micro-batch first.

Keys may be null (a null key has no id). With `late` set, rows older than the watermark are dropped and sessions that no such row can reach leave the
state; without it the state keeps all. An empty input gives an empty sink.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators import rules
from ..operators.common import numbered

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_stateful(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, step: Callable[[DataFrame], DataFrame], finish: Callable[[DataFrame, int], DataFrame] = lambda rows, batch: rows, *, files: int | None = None) -> None:
    """Fold the new Parquet files below `source` into the state; step is the stateful part, finish what follows for the rows of one
    micro-batch. files: at most so many for a micro-batch, the oldest first."""

    def each(rows: DataFrame, batch: int) -> None:
        finish(rows, batch).write.mode("overwrite").parquet(f"{sink}/batch={batch}")

    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    reader = reader.option("maxFilesPerTrigger", files) if files else reader
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)  # the store that keeps typed state; a started query holds the setting
    try:
        query = step(reader.parquet(source)).writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)
    query.awaitTermination()


def current(spark: SparkSession, sink: str, schema: str, keys: list[str], gone: str | None = None) -> DataFrame:
    """The latest row of each key, without those whose column `gone` is true. schema: of the sink's rows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sink)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):  # no run has had a file yet
        rows = spark.createDataFrame([], schema)
        return rows.drop(gone) if gone else rows
    rows = spark.read.schema(schema + ", batch long").parquet(sink)
    values = [c for c in rows.columns if c not in keys and c != "batch"]
    rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("__v")).select(*keys, "__v.*") if values else rows.select(*keys).distinct()
    return rows.where(~F.col(gone)).drop(gone) if gone else rows


# ---------------------------------------------------------------- sessions

SESSIONS = "first timestamp, last timestamp, n long, gone boolean"


class _Sessions(StatefulProcessor):
    """Sessions of a key: a map from the first moment to the last and the number of rows."""

    def __init__(self, gap: int, evict: bool):
        self.gap, self.evict = gap, evict

    def init(self, handle) -> None:
        self.map = handle.getMapState("sessions", "first long", "last long, n long")

    def handleInputRows(self, key, rows, timerValues):
        old = {k[0]: tuple(v) for k, v in self.map.iterator()} if self.map.exists() else {}
        points = [(int(t), int(t), 1) for pdf in rows for t in pdf["at"]]
        new: list[list[int]] = []
        for first, last, n in sorted([(f, *v) for f, v in old.items()] + points):
            if new and first - new[-1][1] < self.gap:
                new[-1][1], new[-1][2] = max(new[-1][1], last), new[-1][2] + n
            else:
                new.append([first, last, n])
        now = {first: (last, n) for first, last, n in new}
        out = [(first, last, n, False) for first, (last, n) in now.items() if old.get(first) != (last, n)]
        out += [(first, *old[first], True) for first in old if first not in now]  # joined to an earlier one
        done = timerValues.getCurrentWatermarkInMs() * 1000 - self.gap if self.evict else None
        for first, value in now.items():
            if done is not None and value[0] < done:
                self.map.removeKey((first,))
            elif old.get(first) != value:
                self.map.updateValue((first,), value)
        for first in old:
            if first not in now:
                self.map.removeKey((first,))
        if out:
            first, last, n, gone = zip(*out)
            moment = lambda v: pd.to_datetime(pd.Series(v, dtype="int64"), unit="us")
            yield pd.DataFrame({"none": [key[0]] * len(out), "key": [key[1]] * len(out), "first": moment(first), "last": moment(last), "n": n, "gone": gone})

    def close(self) -> None:
        pass


def sessions(rows: DataFrame, by: str, time: str, gap: int, late: str | None = None) -> DataFrame:
    """Changed sessions of a stream: rows of a key that are less than `gap` microseconds apart. by, first, last, n, gone
    (the session has become part of another)."""
    rows = rows.withWatermark(time, late) if late else rows
    keyed = rows.where(F.col(time).isNotNull()).select(*_key(by), time, F.unix_micros(F.col(time).cast("timestamp")).alias("at"))
    out = keyed.groupBy("none", "key").transformWithStateInPandas(_Sessions(gap, bool(late)), f"none boolean, key string, {SESSIONS}", "Update", "EventTime" if late else "None")
    return _with_key(out, by, dict(rows.dtypes)[by])


def _key(by: str) -> list[Column]:
    """A key as text beside a mark for null: pandas has no whole numbers beside nulls, and no null that equals itself."""
    return [F.col(by).isNull().alias("none"), F.coalesce(F.col(by).cast("string"), F.lit("")).alias("key")]


def _with_key(rows: DataFrame, by: str, kind: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in ("none", "key")]
    return rows.select(F.when(~F.col("none"), F.col("key")).cast(kind).alias(by), *rest)


def run_sessions(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, by: str, time: str, gap: int, late: str | None = None) -> None:
    run_stateful(spark, source, schema, sink, checkpoint, lambda rows: sessions(rows, by, time, gap, late))


# ---------------------------------------------------------------- ids by first sight


class _FirstSight(StatefulProcessor):
    """The least place at which a key came first; later rows of a key give nothing."""

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "at long")

    def handleInputRows(self, key, rows, timerValues):
        first = min((int(v) for pdf in rows for v in pdf["at"]), default=None)
        if first is not None and not self.seen.exists():
            self.seen.update((first,))
            yield pd.DataFrame({"none": [key[0]], "key": [key[1]], "first": [first]})

    def close(self) -> None:
        pass


def run_ids(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, key: str, order: str, *, files: int | None = None) -> None:
    """Dense ids from 0 for the keys of a stream of rows: by micro-batch, in it by the least `order` (whole numbers), then by key. Where
    a batch's ids begin stands beside the checkpoint, a small file for each batch."""

    def step(rows: DataFrame) -> DataFrame:
        kind = dict(rows.dtypes)[key]
        keyed = rows.where(F.col(key).isNotNull() & F.col(order).isNotNull()).select(*_key(key), F.col(order).cast("long").alias("at"))
        return _with_key(keyed.groupBy("none", "key").transformWithStateInPandas(_FirstSight(), "none boolean, key string, first long", "Update", "None"), key, kind)

    def finish(rows: DataFrame, batch: int) -> DataFrame:
        begin = _begin(spark, checkpoint, batch)
        out = numbered(rows, [F.col("first"), F.col(key)], "id").withColumn("id", F.col("id") + begin)
        _note(spark, checkpoint, batch + 1, begin + out.count())
        return out

    run_stateful(spark, source, schema, sink, checkpoint, step, finish, files=files)


def _file(spark: SparkSession, checkpoint: str, batch: int):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}-ids/{batch}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _begin(spark: SparkSession, checkpoint: str, batch: int) -> int:
    fs, path = _file(spark, checkpoint, batch)
    if not fs.exists(path):
        return 0
    stream = fs.open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _note(spark: SparkSession, checkpoint: str, batch: int, begin: int) -> None:
    fs, path = _file(spark, checkpoint, batch)
    stream = fs.create(path, True)
    try:
        stream.write(bytearray(json.dumps(begin).encode()))
    finally:
        stream.close()


# ---------------------------------------------------------------- merged threats

#: What a merged threat is made of, the parts of it that are folded, and what tells findings of a part apart besides the route.
_THREAT = ["domain", "source", "sink", "key_dest"]
_FINDING = [*_THREAT, "label", "destination", "party", "rule_group", "trigger_context", "observed_trackers"]


def run_threats(spark: SparkSession, source: str, sink: str, checkpoint: str) -> None:
    """Keeps of a stream of findings (the rows of rules.threats, with rule_group and route_id for seq) the least route of each kind of
    finding in the state: a streaming aggregate, so that a batch's findings are reduced before they are shuffled and no row leaves
    the engine. The sink gets the kinds that a batch has; current_threats folds them."""
    schema = "domain string, rule_group int, route_id long, label string, trigger_context string, source string, sink string, destination string, observed_trackers string, party string"
    run_stateful(spark, source, schema, sink, checkpoint, lambda rows: rules.with_key(rows).groupBy(*_FINDING).agg(F.min("route_id").alias("route_id")))


MERGED = "domain string, source string, sink string, key_dest string, threat_type string, trigger_context string, destination string, observed_trackers string, party string"


def current_threats(spark: SparkSession, sink: str) -> DataFrame:
    """The rows of rules.merge_threats, each folded in seq order over all findings so far."""
    schema = ", ".join(f"{c} {'int' if c == 'rule_group' else 'string'}" for c in _FINDING) + ", route_id long"
    # a kind's least route only falls from batch to batch, so that its latest row need not be told from the others
    path = spark._jvm.org.apache.hadoop.fs.Path(sink)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    rows = spark.read.schema(schema + ", batch long").parquet(sink).drop("batch") if there else spark.createDataFrame([], schema)
    return rules.merge_threats(rows.withColumn("seq", F.struct("rule_group", "route_id")))
