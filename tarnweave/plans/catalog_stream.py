"""Catalogue: incremental runs over the test tables in three parts, the last with late rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules as O
from ..operators.common import work_path
from ..streaming import state
from . import catalog_rules, fixtures as X  # noqa: F401  the SQL of merge_threats
from .registry import SQL, query


def in_parts(spark: SparkSession, rows: DataFrame, part: Column, run) -> str:
    """Write rows once, in three parts, and let each part come in turn, with a run(source, sink, checkpoint) after it; the sink. All of it is in
    the shared folder."""
    base = work_path(spark, "stream")
    rows.withColumn("__part", part).write.partitionBy("__part").parquet(f"{base}/parts")
    place = spark._jvm.org.apache.hadoop.fs.Path
    files = place(base).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(place(f"{base}/in"))
    for n in range(3):
        came = place(f"{base}/parts/__part={n}")  # not there if it has no rows
        if files.exists(came) and not files.rename(came, place(f"{base}/in/{n}")):
            raise OSError(f"{came} could not be moved below {base}/in")
        run(f"{base}/in", f"{base}/out", f"{base}/state")
    return f"{base}/out"


def _split(at: Column, middle: Column) -> Column:
    """Two parts by time and a third with every tenth row of all times, so that it comes late."""
    return F.when(F.pmod(F.xxhash64("event_id"), F.lit(10)) == 0, 2).when(at < middle, 0).otherwise(1)


def _events(spark, d):
    e = X.table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    ends = e.agg(F.avg("event_id").alias("m")).first()
    return e, _split(F.col("event_id"), F.lit(ends["m"] or 0))


@query("incremental_sessions", """WITH c AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS c FROM events), g AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM c)
  SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM g GROUP BY user_id, g""")
def incremental_sessions(spark, d):
    e, part = _events(spark, d)
    kind = dict(e.dtypes)["user_id"]
    run = lambda source, sink, ckpt: state.run_sessions(spark, source, f"event_id long, user_id {kind}, ts {dict(e.dtypes)['ts']}", sink, ckpt, "user_id", "ts", 30 * 60 * 1_000_000)
    sink = in_parts(spark, e, part, run)
    return state.current(spark, sink, f"user_id {kind}, {state.SESSIONS}", ["user_id", "first"], "gone").select("user_id", "first", "last", "n")


@query("incremental_ids", """WITH b AS (SELECT user_id, event_id, least(event_id * 3 // (SELECT max(event_id) + 1 FROM events), 2) AS part FROM events), f AS (SELECT user_id, min(part) AS part, arg_min(event_id, (part, event_id)) AS place FROM b GROUP BY 1)
  SELECT user_id, row_number() OVER (ORDER BY part, place, user_id) - 1 AS id FROM f""")
def incremental_ids(spark, d):
    e = X.table(spark, d, "events").select("event_id", "user_id")
    most = (e.agg(F.max("event_id")).first()[0] or 0) + 1
    kind = dict(e.dtypes)["user_id"]
    sink = in_parts(spark, e, F.least(F.floor(F.col("event_id") * 3 / most), F.lit(2)), lambda source, sink, ckpt: state.run_ids(spark, source, f"event_id long, user_id {kind}", sink, ckpt, "user_id", "event_id"))
    return state.current(spark, sink, f"user_id {kind}, first long, id long", ["user_id"]).select("user_id", "id")


@query("incremental_merge", SQL["merge_threats"])
def incremental_merge(spark, d):
    found = O.threats(O.rewrite_routes(X.routes(spark, d), X.netlog(spark, d)), X.netlog(spark, d))
    found = found.select("domain", F.col("seq.rule_group").cast("int").alias("rule_group"), F.col("seq.route_id").cast("long").alias("route_id"), "label", "trigger_context", "source", "sink", "destination", "observed_trackers", "party")
    # dealt by hash: each part has findings of all places, so later ones come before earlier ones
    sink = in_parts(spark, found, F.pmod(F.xxhash64("domain", "route_id", "rule_group"), F.lit(3)), lambda source, sink, ckpt: state.run_threats(spark, source, sink, ckpt))
    return state.current_threats(spark, sink)
