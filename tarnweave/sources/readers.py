"""Readers of the record formats: each gives a DataFrame with a declared schema."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import records
from ..operators.common import checkpoint
from ..operators.prefix import Ordered

ROUTE = "route_id int, source_name string, sink_name string, sink_type string, path_length int, path_nodes array<string>, trigger_context string, destination_url string"
REPORT = f"target_url string, event_driven_functions int, s2s_routes array<struct<{', '.join(f'{a}: {b}' for a, b in (x.split(' ', 1) for x in ROUTE.split(', ')))}>>"
THREAT_COLUMNS = ("Domain", "Threat_Type", "Trigger_Context", "Leaked_Data (Source)", "Leak_Method (Sink)", "Destination", "Observed_Trackers", "Party_Check", "Confidence_Score")


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """target: the second field of rank,domain lines, else the line; blank lines and # comments dropped."""
    line = F.trim("value")
    rows = spark.read.text(path).select(line.alias("line")).where((F.col("line") != "") & ~F.startswith("line", F.lit("#")))
    field = F.when(F.contains("line", F.lit(",")), F.trim(F.get(F.split("line", ","), 1))).otherwise(F.col("line"))
    return rows.select(F.when(field.rlike("(?i)^https?:"), field).otherwise(F.concat(F.lit("https://"), field)).alias("target"))


def _stem(col: str = "_metadata.file_name"):
    return F.regexp_replace(F.col(col), r"(_report|_log|_network_logs)?\.json$", "")


def reports(spark: SparkSession, path: str) -> DataFrame:
    """domain, event_driven_functions, route fields: a row for each route of each readable report;
    reports without routes give one row with nulls."""
    rows = spark.read.schema(REPORT + ", _broken string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    rows = rows.select("*", _stem().alias("domain")).where("_broken is null")
    flat = rows.select("domain", F.coalesce("event_driven_functions", F.lit(0)).alias("event_driven_functions"), F.posexplode_outer("s2s_routes").alias("ord", "r"))
    return flat.select("domain", "event_driven_functions", "ord", "r.*")


def network_logs(spark: SparkSession, path: str) -> DataFrame:
    """domain, ord, url: JSON arrays of URLs, one file a site, in order, each URL once."""
    rows = spark.read.option("wholetext", True).text(path).select(_stem().alias("domain"), F.from_json("value", "array<string>").alias("urls"))
    each = rows.select("domain", F.posexplode("urls").alias("ord", "url")).where(F.startswith("url", F.lit("http")))
    return each.groupBy("domain", "url").agg(F.min("ord").alias("ord")).select("domain", "ord", "url")


def labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """Labelled routes: header with or without byte order mark; rows of the trailer are dropped."""
    rows = spark.read.option("header", True).option("multiLine", True).csv(path)
    rows = rows.toDF(*[c.replace("﻿", "") for c in rows.columns])
    return rows.where(F.col("Tracker_Class").isNotNull() & ~F.startswith("Tracker_Class", F.lit("Routes:"))).withColumn("Domain", F.trim("Domain"))


def profile(spark: SparkSession, path: str) -> DataFrame:
    """func (checksum), profile_index, count of each basic block; other versions than 2 raise."""
    schema = "version int, page_size int, functions array<struct<checksum: string, basic_blocks: array<struct<profile_index: int, execution_count: bigint>>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    rows = rows.withColumn("version", F.when(F.col("version") == 2, F.col("version")).otherwise(F.raise_error(F.lit("profile version is not 2")).cast("int"))).where("version = 2")
    blocks = rows.select(F.explode("functions").alias("f")).select(F.col("f.checksum").alias("func"), F.explode("f.basic_blocks").alias("b"))
    return blocks.select("func", F.col("b.profile_index").alias("profile_index"), F.col("b.execution_count").alias("count"))


def heap_snapshot(spark: SparkSession, path: str) -> DataFrame:
    schema = "nodes array<bigint>, edges array<bigint>, locations array<bigint>, samples array<bigint>, trace_function_infos array<bigint>, strings array<string>"
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("id", F.col("_metadata.file_name"))


def page_trace(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("page int, time_us int").option("header", True).option("sep", "\t").csv(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def sections(spark: SparkSession, path: str) -> DataFrame:
    """title, start, end from `title: [start, end)` lines."""
    p = r"^\s*(.*?):\s*\[(\d+),\s*(\d+)\)"
    rows = spark.read.text(path).where(F.col("value").rlike(p))
    return rows.select(F.regexp_extract("value", p, 1).alias("title"), F.regexp_extract("value", p, 2).cast("long").alias("start"), F.regexp_extract("value", p, 3).cast("long").alias("end"))


def native_stats(spark: SparkSession, path: str) -> DataFrame:
    """Lines of five words, the last NativeCall."""
    words = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(words.alias("w")).where((F.size("w") == 5) & (F.get("w", F.lit(4)) == "NativeCall"))
    return rows.select(*[F.get("w", F.lit(i)).alias(f"f{i}") for i in range(5)])


def section_sizes(spark: SparkSession, path: str) -> DataFrame:
    """section, size, address from `.name size address` lines."""
    p = r"^(\.?\S+)\s+(\d+)\s+(\d+)\s*$"
    rows = spark.read.text(path).where(F.col("value").rlike(p))
    return rows.select(F.regexp_extract("value", p, 1).alias("section"), F.regexp_extract("value", p, 2).cast("long").alias("size"), F.regexp_extract("value", p, 3).cast("long").alias("address"))


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """path, md5 of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.md5("content").alias("md5"))


VLQ = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def decode_vlq(text: str) -> list[int]:
    """Whole numbers of a base-64 variable-length text: five bits a letter, the sixth goes on, the lowest is the sign."""
    out, value, shift = [], 0, 0
    for c in text:
        digit = VLQ.index(c)
        value |= (digit & 31) << shift
        shift += 5
        if not digit & 32:
            out.append(-(value >> 1) if value & 1 else value >> 1)
            value, shift = 0, 0
    return out


def encode_vlq(numbers: list[int]) -> str:
    out = []
    for n in numbers:
        n = (-n << 1) | 1 if n < 0 else n << 1
        while True:
            digit, n = n & 31, n >> 5
            out.append(VLQ[digit | (32 if n else 0)])
            if not n:
                break
    return "".join(out)


def source_map(maps: DataFrame, **options) -> DataFrame:
    """maps: key (one map each), mappings. key, line, gen_column, source, src_line, src_column (the last three
    null for segments of one field). Columns start anew on each line, the rest goes on: the numbers of a segment are steps, which
    running sums add up, over as many tasks as a map needs (options: see prefix.Ordered). A null text has no segments."""

    @F.pandas_udf("array<bigint>")
    def numbers(segments: pd.Series) -> pd.Series:
        return segments.map(decode_vlq)

    lines = maps.select("key", F.posexplode(F.split("mappings", ";", -1)).alias("line", "t"))
    segments = lines.select("key", F.col("line").cast("long").alias("line"), F.posexplode(F.split("t", ",", -1)).alias("seg", "s")).where("s <> ''").select("key", "line", "seg", numbers("s").alias("f"))
    full = F.size("f") >= 4
    step = lambda i: F.when(full, F.get("f", F.lit(i))).otherwise(F.lit(0).cast("long"))
    rows = Ordered(segments, ["key", "line"], ["seg"], **options).sum("gen_column", F.get("f", F.lit(0))).rows
    rows = Ordered(rows, ["key"], ["line", "seg"], **options).sum("source", step(1)).sum("src_line", step(2)).sum("src_column", step(3)).rows
    return rows.select("key", "line", "gen_column", *[F.when(full, F.col(c)).alias(c) for c in ("source", "src_line", "src_column")])


def trace_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """JSON trace files: records (trace: the file, ord, and the columns of records.RECORD), and a row for each trace: trace, version,
    globalObjID. Keys that no record of the format has are left out."""
    columns = [c for c in records.RECORD.split(", ")[2:]]
    entry = ",".join(c.replace(" ", ":", 1) for c in columns)
    files = spark.read.option("multiLine", True).schema(f"version int, globalObjID long, trace array<struct<{entry}>>").json(path).withColumn("__file", F.input_file_name())
    rows = files.select(F.col("__file").alias("file"), F.posexplode("trace").alias("ord", "r"))
    return rows.select(F.col("file").alias("trace"), F.col("ord").cast("long").alias("ord"), "r.*"), files.select(F.col("__file").alias("trace"), "version", "globalObjID")


#: What stands before an element that begins a list, and behind one that ends it.
_LIST_OPENS = r"^\s*(?:\{\s*|\"\w+\"\s*:\s*\{\s*)*\"(\w+)\"\s*:\s*\["
_LIST_ENDS = r"\s*\]\s*[\]}\s]*$"


def list_elements(spark: SparkSession, path: str, lists: list[str], *, split_bytes: int | None = None, **options) -> DataFrame:
    """file, list, at (from 0), value: the elements of some flat lists of JSON files of any size. value is JSON text: a number, or a
    string in quotes.

    A file is read in splits, cut at its commas, so that many tasks read it. Commas inside strings are told by the number of
    quotes before them, and places by running counts, split by split (options: see prefix.Ordered). Only what stands between two
    commas outside strings is put together in one row. Lists of lists are not read.
    """
    reader = spark.read.option("lineSep", ",")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        if split_bytes:
            spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
            spark.conf.set("spark.sql.files.openCostInBytes", 0)
        parts = reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value")
        # within a block rows stand in their order, and blocks in theirs: stored, as the row's number depends on the splits
        parts = checkpoint(parts)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    plain = F.regexp_replace("value", r"\\.", "")
    quotes = F.length(plain) - F.length(F.replace(plain, F.lit('"')))
    o = Ordered(parts, ["file"], ["block", "row"], **options).sum("quotes", quotes.cast("long"), before=True)
    o = o.sum("no", F.when(F.col("quotes") % 2 == 0, 1).otherwise(0).cast("long"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "row", "value"))), lambda x: x["value"]), ",")
    found = o.rows.groupBy("file", "no").agg(text.alias("text"))
    opens, ends = F.regexp_extract("text", _LIST_OPENS, 1), F.col("text").rlike(_LIST_ENDS)
    o = Ordered(found, ["file"], ["no"], **options).last("begun", F.when(opens != "", F.struct(opens.alias("name"), F.col("no").alias("no"))))
    o = o.last("ended", F.when(ends, F.col("no")), before=True)
    inside = o.rows.where(F.col("begun.name").isin(lists) & (F.coalesce("ended", F.lit(-1)) < F.col("begun.no")))
    value = F.trim(F.regexp_replace(F.regexp_replace("text", _LIST_OPENS, ""), _LIST_ENDS, ""), F.lit(" \t\r\n"))
    return inside.select("file", F.col("begun.name").alias("list"), (F.col("no") - F.col("begun.no")).alias("at"), value.alias("value")).where("value <> ''")


def list_rows(elements: DataFrame, name: str, fields: list[str]) -> DataFrame:
    """file, no and a column for each field: a flat list of numbers, len(fields) of them to a row."""
    k = len(fields)
    rows = elements.where(F.col("list") == name).select("file", F.floor(F.col("at") / k).alias("no"), (F.col("at") % k).alias("k"), F.col("value").try_cast("long").alias("v"))
    return rows.groupBy("file", "no").agg(*[F.max(F.when(F.col("k") == i, F.col("v"))).alias(f) for i, f in enumerate(fields)])


def list_strings(elements: DataFrame, name: str = "strings") -> DataFrame:
    """file, at, text: a list of strings, without quotes and escapes."""
    rows = elements.where((F.col("list") == name) & F.startswith("value", F.lit('"')))
    return rows.select("file", "at", F.from_json(F.concat(F.lit('{"t":'), "value", F.lit("}")), "t string")["t"].alias("text"))
