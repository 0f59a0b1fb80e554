"""Trace and profile analytics: as-of and interval joins, islands, running totals, attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, numbered
from .prefix import Ordered


def asof(left: DataFrame, right: DataFrame, by: str, left_on: str, right_on: str, value: str, **options) -> DataFrame:
    """left with the value of the last right row of the same key at or before it; null if none.

    One order of the union of both sides by key and place, no join; a key may span tasks (options: see prefix.Ordered).
    """
    a = left.withColumns({"__at": F.col(left_on), "__side": F.lit(1), "__value": F.lit(None).cast(right.schema[value].dataType)})
    b = right.groupBy(by, right_on).agg(F.max(value).alias("__value")).select(by, F.col(right_on).alias("__at"), F.lit(0).alias("__side"), "__value")
    rows = Ordered(a.unionByName(b, allowMissingColumns=True), [by], ["__at", "__side"], **options).last(value, F.col("__value")).rows
    return rows.where("__side = 1").drop("__at", "__side", "__value")


#: The widest cell, as a power of two.
LEVELS = 62


def _cover(start: Column, end: Column) -> Column:
    """Cells (level, no) of 2^level units that together are [start, end): at most two of each size."""
    def at(level):
        # the first whole cell from start on, and the first behind the last one before end
        a, b = -F.call_function("shiftright", -start, level), F.call_function("shiftright", end, level)
        cell = lambda test, no: F.when((a < b) & (test % 2 != 0), F.struct(level.cast("int").alias("level"), no.alias("no")))
        return F.array(cell(a, a), cell(b, b - 1))

    top = F.least(F.floor(F.log2((end - start).cast("double"))).cast("int") + 1, F.lit(LEVELS))
    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), top), at)))


def cells(intervals: DataFrame, width: int = 1) -> DataFrame:
    """intervals [start, end) dealt to cells of several sizes, of `width` units and powers of two more: level and no added. However
    long an interval is, it has a few cells."""
    first, behind = F.floor(F.col("start") / width).cast("long"), F.floor((F.col("end") - 1) / width).cast("long") + 1
    return intervals.where(F.col("end") > F.col("start")).select("*", F.explode(_cover(first, behind)).alias("__cell")).select(*[f"`{c}`" for c in intervals.columns], "__cell.level", "__cell.no")


def _in_cells(points: DataFrame, at: Column, dealt: DataFrame) -> DataFrame:
    """points once for each size of cell that there is, with the cell of that size that holds them."""
    levels = sorted(r["level"] for r in dealt.select("level").distinct().collect()) or [0]  # at most LEVELS + 1
    return points.select("*", F.explode(F.array(*[F.struct(F.lit(x).alias("level"), F.call_function("shiftright", at.cast("long"), F.lit(x)).alias("no")) for x in levels])).alias("__cell")).select(*[f"`{c}`" for c in points.columns], "__cell.level", "__cell.no")


def interval_overlap(sections: DataFrame, width: int, pages: DataFrame | None = None) -> DataFrame:
    """page, title: pages of `width` units and the sections [start, end) that touch them. With pages (page), only those, found by
    cells; else every page that a section touches, a row each."""
    if pages is not None:
        dealt = cells(sections, width)
        return _in_cells(pages.select("page").distinct(), F.col("page"), dealt).join(dealt, ["level", "no"]).select("page", "title")
    last = F.floor((F.col("end") - 1) / width)
    return sections.where(F.col("end") > F.col("start")).select(F.explode(F.sequence(F.floor(F.col("start") / width), last)).alias("page"), "title")


def gap_fill(sections: DataFrame, by: str, name: str = "<unknown>", **options) -> DataFrame:
    """Sections of a group with the holes between them filled."""
    rows = Ordered(sections, [by], ["start", "end"], **options).previous("__end", F.col("end")).rows.withColumn("__end", F.col("__end.v"))
    holes = rows.where(F.col("__end") < F.col("start")).select(by, F.lit(name).alias("title"), F.col("__end").alias("start"), F.col("start").alias("end"))
    return sections.select(by, "title", "start", "end").unionByName(holes)


def islands(rows: DataFrame, by: str, order: list[str], label: str, measure: str, **options) -> DataFrame:
    """Runs of consecutive rows with the same label: by, island, label, n, total."""
    o = Ordered(rows, [by], order, **options).previous("__before", F.col(label))
    same = F.col("__before").isNotNull() & F.col("__before.v").eqNullSafe(F.col(label))
    rows = o.sum("island", F.when(same, 0).otherwise(1).cast("long")).rows
    return rows.groupBy(by, "island").agg(F.first(label).alias("label"), F.count(F.lit(1)).alias("n"), F.sum(measure).alias("total"))


def value_islands(rows: DataFrame, by: str, value: str, **options) -> DataFrame:
    """Runs of adjacent whole numbers: by, first, last."""
    rows = Ordered(rows.select(by, value).distinct(), [by], [value], **options).number("__g").rows.withColumn("__g", F.col(value) - F.col("__g"))
    return rows.groupBy(by, "__g").agg(F.min(value).alias("first"), F.max(value).alias("last")).drop("__g")


def merge_ranges(rows: DataFrame, by: str, **options) -> DataFrame:
    """Ranges [start, end) of a group that touch or overlap become one."""
    o = Ordered(rows, [by], ["start", "end"], **options).max("__before", F.col("end"), before=True)
    rows = o.sum("__g", F.when(F.col("start") <= F.col("__before"), 0).otherwise(1).cast("long")).rows
    return rows.groupBy(by, "__g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__g")


def running_topk(totals: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """The k largest with running sum and the sum of all; ties by key. The windows run over the k
    rows and one row with the sum."""
    whole = totals.agg(F.sum(value).alias("__all"))
    top = totals.orderBy(F.desc(value), key).limit(k).select(key, value)
    rows = top.withColumn("__all", F.lit(None).cast(whole.schema["__all"].dataType)).unionByName(whole, allowMissingColumns=True)
    w = Window.orderBy(F.desc_nulls_last(value), key)
    rows = rows.select(key, value, F.row_number().over(w).alias("rank"), F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("running"), F.max("__all").over(Window.partitionBy()).alias("whole"))
    return rows.where(F.col(value).isNotNull())


def time_delta(rows: DataFrame, by: str, time: str, order: list[str], **options) -> DataFrame:
    """Microseconds since the row before; 0 for the first."""
    t = F.unix_micros(F.col(time).cast("timestamp"))
    rows = Ordered(rows, [by], order, **options).previous("__before", t).rows
    return rows.withColumn("delta", F.coalesce(t - F.col("__before.v"), F.lit(0))).drop("__before")


def ids_by_first_sight(rows: DataFrame, key: str, order: str) -> DataFrame:
    """key, id: 0, 1, 2 ... by first appearance; numbered after aggregation, range by range."""
    first = rows.groupBy(key).agg(F.min(order).alias("__first"))
    return numbered(first, [F.col("__first"), F.col(key)], "id").select(key, "id")


def moments(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, min, max, sum, sum of squares, mean, population deviation; 0 where there is nothing."""
    v = F.col(value)
    aggs = [F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.coalesce(F.sum(v), F.lit(0.0)).alias("total"), F.coalesce(F.sum(v * v), F.lit(0.0)).alias("squares"), F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_pop(v), F.lit(0.0)).alias("deviation")]
    return rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)


def attribution(usage: DataFrame) -> DataFrame:
    """usage: grp, type (a:b:c), key, size. For each group and type prefix: private (only this
    group uses it), shared (all), amortised (size by number of users)."""
    rows = usage.select("grp", "type", "key", "size").distinct()
    users = rows.groupBy("type", "key").agg(F.count_distinct("grp").alias("users"))
    rows = rows.join(users, ["type", "key"])
    parts = F.split("type", ":")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), ":"))
    rows = rows.withColumn("prefix", F.explode(prefixes))
    return rows.groupBy("grp", "prefix").agg(F.sum(F.when(F.col("users") == 1, F.col("size")).otherwise(0)).alias("private"), F.sum("size").alias("shared"), F.sum(F.col("size") / F.col("users")).alias("amortised"))


def stack_trie(samples: DataFrame) -> DataFrame:
    """samples: stack (array of names, root first). path, depth, hits (of stacks that end there), total."""
    prefixes = F.transform(F.sequence(F.lit(1), F.size("stack")), lambda i: F.struct(F.array_join(F.slice("stack", 1, i), "/").alias("path"), i.alias("depth"), (i == F.size("stack")).cast("int").alias("leaf")))
    rows = samples.where(F.size("stack") > 0).groupBy("stack").agg(F.count(F.lit(1)).alias("n")).select("n", F.explode(prefixes).alias("x"))
    return rows.groupBy(F.col("x.path").alias("path"), F.col("x.depth").alias("depth")).agg(F.sum(F.col("n") * F.col("x.leaf")).alias("hits"), F.sum("n").alias("total"))


def pages_touched(ranges: DataFrame, by: str, width: int, **options) -> DataFrame:
    """Distinct pages that a group's ranges [start, end) touch: page ranges are merged, and their lengths summed up."""
    page = lambda c: F.floor(c / width).cast("long")
    pages = ranges.where(F.col("end") > F.col("start")).select(by, page(F.col("start")).alias("start"), (page(F.col("end") - 1) + 1).alias("end"))
    return merge_ranges(pages, by, **options).groupBy(by).agg(F.sum(F.col("end") - F.col("start")).alias("pages"))


def function_stats(blocks: DataFrame) -> DataFrame:
    """blocks: func, profile_index, count, insts. Entries (count of the highest index) and instructions run."""
    return blocks.groupBy("func").agg(F.max_by("count", "profile_index").alias("entries"), F.sum(F.col("count") * F.col("insts")).alias("instructions"))


def trace_summary(blocks: DataFrame) -> DataFrame:
    """One row; index 0 gathers overflow and does not count."""
    good = F.col("profile_index") > 0
    return blocks.agg(F.count_distinct(F.when(good, F.col("func"))).alias("functions"), F.count_if(good).alias("blocks"), F.count_if(good & (F.col("count") > 0)).alias("run_blocks"), F.sum(F.when(good, F.col("count"))).alias("executions"))


def section_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """section, before, after, change over all sections of either side."""
    out = before.select("section", F.col("size").alias("before")).join(after.select("section", F.col("size").alias("after")), "section", "full")
    return out.select("section", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after")).withColumn("change", F.col("after") - F.col("before"))


def heap_nodes(snapshot: DataFrame, fields: list[str]) -> DataFrame:
    """snapshot: id, numbers (flat array). A row for each chunk of len(fields) numbers."""
    k = len(fields)
    rows = snapshot.select("id", F.explode(F.sequence(F.lit(0), F.floor(F.size("numbers") / k) - 1)).alias("no"), "numbers").where("no >= 0")
    return rows.select("id", "no", *[F.get("numbers", (F.col("no") * k + i).cast("int")).alias(f) for i, f in enumerate(fields)])


def heap_locations(locations: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """locations: id, object_index (a place in the flat array of nodes of `width` numbers), script_id, line,
    column. nodes: id, no. Each location with its node's columns."""
    at = locations.withColumn("no", F.floor(F.col("object_index") / width).cast("long")).drop("object_index")
    return nodes.withColumn("no", F.col("no").cast("long")).join(at, ["id", "no"])


def predicate_islands(rows: DataFrame, by: str, order: str, test: Column, **options) -> DataFrame:
    """Runs of consecutive rows for which test holds: by, first, last (of order), n."""
    o = Ordered(rows.select(by, order, F.coalesce(test, F.lit(False)).alias("__t")), [by], [order], **options)
    # the rows for which it does not hold, so far, stay as many within a run
    good = o.sum("__g", (~F.col("__t")).cast("long")).rows.where("__t")
    return good.groupBy(by, "__g").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n")).drop("__g")


def paired_ranges(rows: DataFrame, by: str, value: str, name: str, **options) -> DataFrame:
    """Runs of adjacent whole numbers, in which a row whose name ends in First> and the next, whose name ends in
    Last>, stand for all numbers from one to the other: by, first, last."""
    rows = Ordered(rows, [by], [value], **options).next("__next", F.struct(F.col(name).alias("name"), F.col(value).alias("value"))).rows
    rows = rows.withColumn("__end", F.when(F.col(name).endswith("First>") & F.col("__next.v.name").endswith("Last>"), F.col("__next.v.value")).otherwise(F.col(value)))
    # half-open, so that neighbours touch
    return merge_ranges(rows.select(by, F.col(value).alias("start"), (F.col("__end") + 1).alias("end")), by, **options).select(by, F.col("start").alias("first"), (F.col("end") - 1).alias("last"))


def top_blocks(blocks: DataFrame, k: int) -> DataFrame:
    """The k blocks that ran most instructions: func, profile_index, instructions, average_loop (runs of the
    block for each entry of its function; 0 if it was never entered). Index 0 gathers overflow and is left out."""
    entries = blocks.groupBy("func").agg(F.max_by("count", "profile_index").alias("__entries"))
    top = blocks.where("profile_index > 0").withColumn("instructions", F.col("count") * F.col("insts")).orderBy(F.desc("instructions"), "func", "profile_index").limit(k)
    return top.join(entries, "func").select("func", "profile_index", "instructions", share(F.col("count"), F.col("__entries")).alias("average_loop"))


def ancestors(parents: DataFrame) -> DataFrame:
    """parents: node, parent (0: none). node, stack: ancestors from the root down, the node last.

    Chains double in length with each round: stack[node] = stack[ancestor] + stack[node]; rounds go
    on until every chain has come to its root. A parent that is no node ends a chain like a root; nodes whose
    chain comes back to itself have none, and an error names the first of them.
    """
    rows = checkpoint(parents.select("node", F.col("parent").alias("up"), F.array("node").alias("stack")))
    longest, nodes = 1, rows.count()
    while not (open_ := rows.where("up <> 0")).isEmpty():
        if longest > nodes:  # longer than any chain without a cycle
            raise ValueError(f"the chain of node {open_.agg(F.min('node')).first()[0]} has no root")
        above = rows.select(F.col("node").alias("up"), F.col("up").alias("__up"), F.col("stack").alias("__stack"))
        rows = rows.join(above, "up", "left").select("node", F.when(F.col("up") == 0, F.lit(0)).otherwise(F.coalesce("__up", F.lit(0))).cast("long").alias("up"), F.when(F.col("__stack").isNull(), F.col("stack")).otherwise(F.concat("__stack", "stack")).alias("stack"))
        rows, longest = checkpoint(rows), longest * 2
    return rows.select("node", "stack")


def point_in_interval(points: DataFrame, intervals: DataFrame, width: int) -> DataFrame:
    """points: id, x. intervals: name, start, end, not overlapping. name of the interval that
    holds x, else null: intervals are dealt to cells of several sizes, points join on their cell of each size."""
    dealt = cells(intervals.select("name", "start", "end"), width)
    asked = _in_cells(points.select("id", "x", F.monotonically_increasing_id().alias("__row")), F.floor(F.col("x") / width), dealt)
    held = asked.join(dealt, ["level", "no"], "left")
    name = F.when((F.col("start") <= F.col("x")) & (F.col("x") < F.col("end")), F.struct("name"))
    return held.groupBy("__row", "id", "x").agg(F.max(name).alias("__name")).select("id", "x", F.col("__name.name").alias("name"))


def override(layers: list[DataFrame], key: str, value: str) -> DataFrame:
    """The value of the last layer that has a key."""
    parts = [df.select(key, value, F.lit(n).alias("__n")) for n, df in enumerate(layers)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy(key).agg(F.max_by(value, "__n").alias(value))


def case_maps(data: DataFrame, special: DataFrame, folding: DataFrame) -> DataFrame:
    """cp, upper, lower, fold of each letter, from the lines (value) of the tables of letters, of special cases and of folds.

    Special cases without a condition come before the table's; a form of several letters is the letter itself. Of the folds those of status C
    and S count; the others of a letter are itself.
    """
    field = lambda i: F.trim(F.get(F.split(F.split("value", "#")[0], ";"), i))
    number = lambda c: F.conv(c, 16, 10).cast("long")
    single = lambda c, cp: F.when((c != "") & (F.size(F.split(c, r"\s+")) == 1), number(c)).otherwise(cp)
    cp = number(field(0))
    form = lambda upper, lower: F.struct(single(field(upper), cp).alias("upper"), single(field(lower), cp).alias("lower")).alias("form")
    letters = data.where(F.coalesce(field(0), F.lit("")) != "").select(cp.alias("cp"), form(12, 13))
    parts = F.split(F.split("value", "#")[0], ";")
    cases = special.where((F.size(parts) >= 5) & (field(4) == "")).select(cp.alias("cp"), form(3, 1))
    folds = folding.where((F.size(parts) == 4) & field(1).isin("C", "S")).select(cp.alias("cp"), number(field(2)).alias("fold"))
    out = override([letters, cases], "cp", "form").join(folds.groupBy("cp").agg(F.max("fold").alias("fold")), "cp", "left")
    return out.select("cp", "form.upper", "form.lower", F.coalesce("fold", "cp").alias("fold"))


def canonical(maps: DataFrame) -> DataFrame:
    """maps with canonical: what a letter is compared as where case is ignored without the unicode flag (with it: fold). Only ASCII may become ASCII."""
    return maps.withColumn("canonical", F.when((F.col("upper") < 128) & (F.col("cp") >= 128), F.col("cp")).otherwise(F.col("upper")))


def compress_runs(rows: DataFrame, by: str, key: str, value: str, span: int = 256, **options) -> DataFrame:
    """by, first, last, stride, delta: pairs in order of key join a block while value - key and
    the stride stay the same and the block spans less than `span`. Repeated pairs count once.

    For every pair it is known where a block that began there would end: where delta or stride change, or the span is full. Blocks begin where
    the delta changes, and where the block before ends; the latter are found by jumps that double in length, so that
    rounds grow with the logarithm of the longest chain of blocks.
    """
    pairs = rows.select(F.col(by).alias("g"), F.col(key).cast("long").alias("k"), (F.col(value) - F.col(key)).cast("long").alias("delta")).distinct()
    place = F.struct("k", "delta")
    o = Ordered(pairs, ["g"], ["k", "delta"], **options).number("i").next("after", place).previous("before", place)
    same = F.coalesce((F.col("after.v.delta") == F.col("delta")) & (F.col("after.v.k") > F.col("k")), F.lit(False))
    stride = F.when(same, F.col("after.v.k") - F.col("k"))
    begins = ~F.coalesce((F.col("before.v.delta") == F.col("delta")) & (F.col("before.v.k") < F.col("k")), F.lit(False))
    runs = Ordered(o.rows.select("g", "k", "delta", "i", stride.alias("stride"), begins.alias("begins")), ["g"], ["i"], **options).previous("was", F.col("stride"))
    change = F.col("was").isNull() | ~F.col("was.v").eqNullSafe(F.col("stride")) | F.col("begins")
    pairs = runs.sum("run", change.cast("long")).rows.drop("was")
    ends = pairs.groupBy("g", "run").agg((F.max("i") + 1).alias("end")).select(F.col("g").alias("__g"), "run", "end")
    pairs = pairs.join(ends.withColumnRenamed("run", "__run"), F.col("g").eqNullSafe(F.col("__g")) & (F.col("run") == F.col("__run"))).drop("__g", "__run", "run")
    jump = F.when(F.col("stride").isNull(), F.col("i") + 1).otherwise(F.least(F.col("end"), F.col("i") + F.floor(F.lit(span - 1) / F.col("stride"))) + 1)
    pairs = checkpoint(pairs.withColumn("jump", jump).drop("end"))
    jumps, starts = pairs.select("g", "i", "jump"), pairs.where("begins").select("g", "i")
    # of blocks that fill their span, or whose stride changes: others end where the delta changes, where a block begins anyway
    while True:
        there = pairs.select(F.col("g").alias("__g"), F.col("i").alias("__i"))
        landed = starts.select(F.col("g").alias("__sg"), F.col("i").alias("__si")).join(jumps, F.col("__sg").eqNullSafe(F.col("g")) & (F.col("__si") == F.col("i"))).select("g", F.col("jump").alias("i"))
        landed = landed.distinct().join(there, F.col("g").eqNullSafe(F.col("__g")) & (F.col("i") == F.col("__i")), "left_semi")
        known = starts.select(F.col("g").alias("__g"), F.col("i").alias("__i"))
        new = checkpoint(landed.join(known, F.col("g").eqNullSafe(F.col("__g")) & (F.col("i") == F.col("__i")), "left_anti"))
        if new.isEmpty():
            break
        starts = checkpoint(starts.unionByName(new))
        far = jumps.select(F.col("g").alias("__g"), F.col("i").alias("__i"), F.col("jump").alias("__jump"))
        jumps = checkpoint(jumps.join(far, F.col("g").eqNullSafe(F.col("__g")) & (F.col("jump") == F.col("__i"))).select("g", "i", F.col("__jump").alias("jump")))
    begun = starts.select(F.col("g").alias("__g"), F.col("i").alias("__i"))
    marked = pairs.join(begun, F.col("g").eqNullSafe(F.col("__g")) & (F.col("i") == F.col("__i")), "left").withColumn("start", F.col("__i").isNotNull().cast("long")).drop("__g", "__i")
    blocks = Ordered(marked.select("g", "k", "delta", "i", "start"), ["g"], ["i"], **options).sum("block", F.col("start")).rows.groupBy("g", "block")
    out = blocks.agg(F.min("k").alias("first"), F.max("k").alias("last"), F.count(F.lit(1)).alias("n"), F.first("delta").alias("delta"))
    return out.select(F.col("g").alias(by), "first", "last", F.when(F.col("n") > 1, F.floor((F.col("last") - F.col("first")) / (F.col("n") - 1))).otherwise(0).cast("long").alias("stride"), "delta")


def slowest(rows: DataFrame, key: str, value: str, k: int) -> DataFrame:
    return rows.orderBy(F.desc(value), F.desc(key)).limit(k).select(key, value)


def share(n: Column, d: Column) -> Column:
    return F.when(d == 0, F.lit(0.0)).otherwise(n / d)
