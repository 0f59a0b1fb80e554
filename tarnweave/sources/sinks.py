"""Writers: threat and summary tables, graphs, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .readers import THREAT_COLUMNS


def threat_table(merged: DataFrame) -> DataFrame:
    """Threats under the names of the exported table."""
    names = ("domain", "threat_type", "trigger_context", "source", "sink", "destination", "observed_trackers", "party", "confidence")
    return merged.select(*[F.col(a).alias(b) for a, b in zip(names, THREAT_COLUMNS)])


def _marked(rows: DataFrame, mark: bool) -> DataFrame:
    """With a byte order mark before the header of each file, by which spreadsheets tell UTF-8."""
    return rows.withColumnRenamed(rows.columns[0], "\ufeff" + rows.columns[0]) if mark else rows


def write_threats(merged: DataFrame, path: str, mark: bool = False) -> None:
    """CSV with header, in the report's order; statistics are a table of their own, not a trailer. mark: with a byte order mark."""
    ordered = merged.orderBy("min_rule", "domain", "source", "sink", "destination") if "min_rule" in merged.columns else merged
    _marked(threat_table(ordered), mark).write.option("header", True).csv(path)


def write_summary(summary: DataFrame, path: str, mark: bool = False) -> None:
    _marked(summary.orderBy(F.desc("total_routes"), "domain"), mark).write.option("header", True).csv(path)


def write_dot(dot: DataFrame, path: str) -> None:
    """One folder for each site, with the lines of dot_lines in order."""
    dot.repartition("domain").sortWithinPartitions("domain", "part", "line").select("domain", "line").write.partitionBy("domain").text(path)


def report_lines(modules: DataFrame, routes: DataFrame) -> DataFrame:
    """modules: domain, event_driven_functions. A JSON report for each module, also without routes."""
    item = F.struct("route_id", "source_name", "sink_name", "sink_type", "path_length", "path_nodes", "trigger_context", "destination_url")
    packed = routes.groupBy("domain").agg(F.array_sort(F.collect_list(item)).alias("s2s_routes"))
    rows = modules.join(packed, "domain", "left").withColumn("s2s_routes", F.coalesce("s2s_routes", F.array()))
    return rows.select("domain", F.to_json(F.struct(F.col("domain").alias("target_url"), "event_driven_functions", "s2s_routes")).alias("value"))


def free_name(base: str, taken: set[str], day: str) -> str:
    """base_day.csv, or the first of base_day_2.csv, base_day_3.csv ... that is free."""
    name, n = f"{base}_{day}.csv", 2
    while name in taken:
        name, n = f"{base}_{day}_{n}.csv", n + 1
    return name
