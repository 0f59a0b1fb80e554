"""Threat graphs and reachability.

Reachability deals the edges to parts of bounded size; each part is followed to its end in one task, and only what is
nearer than known goes on to other parts, so that there are as many rounds as shortest paths cross parts, not as they have edges. Paths run as
breadth-first levels: the frontier is joined to the edges, and nodes that were reached before are taken out by an anti join. Rounds
and levels are stored by checkpoint() in the shared folder, so lineage stays short and lost executors are no matter; cycles end,
as nothing in them is nearer; without a level cap, fixpoints run until nothing is new.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import registries as R
from .common import checkpoint, forget


def node_id(label: Column) -> Column:
    return F.concat(F.lit("N_"), F.substring(F.md5(label), 1, 10))


def _labels(routes: DataFrame) -> DataFrame:
    source = F.trim(F.coalesce("source_name", F.lit("")))
    source = F.when((source == "") | (source == "Unknown"), "[Dynamic_Source]").otherwise(source)
    sink, dest = F.trim("sink_name"), F.replace(F.trim("destination_url"), F.lit('"'), F.lit("'"))
    steps = F.transform("path_nodes", lambda x, i: F.concat_ws("_", F.col("route_id").cast("string"), i.cast("string"), x))
    return routes.select("domain", "route_id", source.alias("source"), F.concat(sink, F.lit("\n"), dest).alias("sink_key"), "path_nodes", F.concat(F.array(source), steps, F.array(F.concat(sink, F.lit("\n"), dest))).alias("chain"))


#: Nodes or edges that are told apart in one task.
TASK_ROWS = 1 << 19


def _once(rows: DataFrame, n: int) -> DataFrame:
    """The distinct ones of at most n rows, few of which come twice: they are dealt out as they are, to as many tasks as they need, as
    partial results would not be smaller."""
    tasks = max(-(-n // TASK_ROWS), min(rows.sparkSession.sparkContext.defaultParallelism, -(-n // 1000)), 1)
    return rows.repartition(tasks, *rows.columns).distinct()


def _steps(routes: DataFrame) -> int:
    """Steps of all routes, and one more for each: as many as edges."""
    return routes.agg(F.sum(F.greatest(F.coalesce(F.size("path_nodes"), F.lit(0)), F.lit(0)) + 1)).first()[0] or 0


def taint_graph_nodes(routes: DataFrame) -> DataFrame:
    """domain, node, kind (source, step, sink), label: one row for each node of a site's graph."""
    rows = _labels(routes)
    steps = F.transform("path_nodes", lambda x, i: F.struct(F.lit("step").alias("kind"), x.alias("label"), F.element_at("chain", i + 2).alias("key")))
    ends = [F.struct(F.lit("source").alias("kind"), F.col("source").alias("label"), F.col("source").alias("key")), F.struct(F.lit("sink").alias("kind"), F.col("sink_key").alias("label"), F.col("sink_key").alias("key"))]
    out = lambda items: rows.select("domain", F.explode(items).alias("x")).select("domain", node_id(F.col("x.key")).alias("node"), "x.kind", "x.label")
    # many routes have the same ends, a step is one route's
    return out(F.array(*ends)).distinct().unionByName(_once(out(steps), _steps(routes)))


def taint_graph_edges(routes: DataFrame) -> DataFrame:
    """domain, src, dst: each edge of a site's graph once."""
    ids = F.transform("chain", node_id)
    pairs = F.arrays_zip(F.slice("ids", 1, F.size("ids") - 1).alias("src"), F.slice("ids", 2, F.size("ids") - 1).alias("dst"))
    rows = _labels(routes).select("domain", ids.alias("ids"))
    return _once(rows.select("domain", F.explode(pairs).alias("x")).select("domain", F.col("x.src").alias("src"), F.col("x.dst").alias("dst")), _steps(routes))


def resolved_routes(routes: DataFrame) -> DataFrame:
    """Routes with a known destination; all of them in domains that have none."""
    any_ = routes.groupBy("domain").agg(F.max(F.col("destination_url") != R.DYNAMIC).alias("any"))
    return routes.join(any_, "domain").where((F.col("destination_url") != R.DYNAMIC) | ~F.col("any")).drop("any")


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """domain, part, line: the lines of a DOT file for each site, in order of part and line. A site's lines are rows of
    their own, so that no site is held in one."""
    label = F.replace(F.replace("label", F.lit('"'), F.lit("'")), F.lit("\n"), F.lit("\\n"))
    n = nodes.select("domain", F.lit(1).alias("part"), F.format_string('    "%s" [label="%s"];', "node", label).alias("line"))
    e = edges.select("domain", F.lit(2).alias("part"), F.format_string('    "%s" -> "%s";', "src", "dst").alias("line"))
    frame = nodes.select("domain").distinct().select("domain", F.explode(F.array(F.struct(F.lit(0).alias("part"), F.lit("digraph G {").alias("line")), F.struct(F.lit(3).alias("part"), F.lit("}").alias("line")))).alias("x"))
    return n.unionByName(e).unionByName(frame.select("domain", "x.part", "x.line"))


def _levels(max_depth: int | None):
    return itertools.count(1) if max_depth is None else range(1, max_depth + 1)


#: Edges that are followed in one task; levels of paths after which they become one table; levels that are joined before edges are dealt to parts.
PART_EDGES, MERGED, JOINED = 1 << 21, 8, 12
#: Pairs of stores and loads of one key that are written by one task.
KEY_PAIRS = 1 << 22
#: Ways through a node, from which on it is a hub; sinks that a source without a hub has in one list.
HUB_WAYS, OWN_SINKS = 64, 1 << 10


def _follow(most: int | None):
    """All nodes that a part makes nearer: node, depth, part. The second table has the depths of its nodes; new: not yet followed."""

    def run(edges: pa.Table, known: pa.Table) -> pa.Table:
        names = {"node": edges.schema.field("src").type if edges.num_columns else pa.int64(), "depth": pa.int64(), "part": pa.int64()}
        if not edges.num_rows or not known.num_rows:
            return pa.table({c: pa.array([], type=t) for c, t in names.items()})
        src, dst, own = (c.combine_chunks() for c in (edges.column("src"), edges.column("dst"), known.column("node")))
        nodes = pa.chunked_array([src, dst, own]).unique()
        at = lambda values: pc.index_in(values, value_set=nodes).to_numpy(zero_copy_only=False)
        src, dst, own = at(src), at(dst), at(own)
        order = np.argsort(src, kind="stable")
        dst, starts = dst[order], np.searchsorted(src[order], np.arange(len(nodes) + 1))
        far = np.iinfo(np.int64).max
        depth, open_, nearer = np.full(len(nodes), far), np.zeros(len(nodes), dtype=bool), np.zeros(len(nodes), dtype=bool)
        np.minimum.at(depth, own, known.column("depth").to_numpy())
        open_[own[known.column("new").to_numpy(zero_copy_only=False)]] = True
        waiting = {}  # nodes that are open, by depth
        for d in np.unique(depth[open_]):
            waiting[int(d)] = [np.flatnonzero(open_ & (depth == d))]
        while waiting:
            d = min(waiting)
            front = np.unique(np.concatenate(waiting.pop(d)))
            front = front[depth[front] == d]
            if most is not None and d >= most:
                continue
            sizes = starts[front + 1] - starts[front]
            places = np.arange(sizes.sum()) + np.repeat(starts[front] - (np.cumsum(sizes) - sizes), sizes)
            reached = np.unique(dst[places])
            reached = reached[depth[reached] > d + 1]
            if len(reached):
                depth[reached], nearer[reached] = d + 1, True
                waiting.setdefault(d + 1, []).append(reached)
        out = np.flatnonzero(nearer)
        part = edges.column("part")[0].as_py()
        return pa.table({"node": nodes.take(pa.array(out)), "depth": pa.array(depth[out]), "part": pa.array(np.full(len(out), part))})

    return run


def _paths(edges: DataFrame, seeds: DataFrame, max_depth: int | None) -> DataFrame:
    """As reach, level by level, with the least of the shortest paths."""
    links = edges.select("src", "dst").distinct()
    found = checkpoint(seeds.select("node").distinct().select("node", F.lit(0).alias("depth"), F.array("node").alias("path")))
    frontier = found
    for depth in _levels(max_depth):
        step = frontier.hint("merge").join(links, frontier["node"] == links["src"]).groupBy(F.col("dst").alias("node")).agg(F.min(F.array_append("path", F.col("dst"))).alias("path"))
        frontier = checkpoint(step.hint("merge").join(found.select("node"), "node", "left_anti").select("node", F.lit(depth).alias("depth"), "path"))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
        if depth % MERGED == 0:  # else each level reads all earlier ones one by one
            found = checkpoint(found)
    return found


def reach(edges: DataFrame, seeds: DataFrame, *, max_depth: int | None = None, with_path: bool = False, part_edges: int = PART_EDGES) -> DataFrame:
    """edges: src, dst. seeds: node. node, depth (fewest edges), and path, on request: of the shortest ones the least. At most
    max_depth levels, or all of them. Null nodes take no part."""
    if with_path:
        return _paths(edges, seeds, max_depth)
    links = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    n = links.count()
    parts = max(1, -(-n // part_edges))
    if parts == 1:
        part = F.lit(0)
    else:
        # a node with very many edges is dealt to several parts
        large = links.groupBy("src").agg(F.ceil(F.count(F.lit(1)) / part_edges).alias("__salts")).where("__salts > 1")
        links = links.hint("merge").join(large, "src", "left")
        part = F.pmod(F.xxhash64("src", F.pmod(F.xxhash64("dst"), F.coalesce("__salts", F.lit(1)))), F.lit(parts))
    links = checkpoint(links.select("src", "dst", part.cast("long").alias("part")))
    homes = links.select(F.col("src").alias("node"), "part").distinct()
    kind = links.schema["src"].dataType.simpleString()
    known = checkpoint(seeds.select(F.col("node").cast(kind).alias("node")).where("node is not null").distinct().select("node", F.lit(0).cast("long").alias("depth")))
    new = known.hint("merge").join(homes, "node").select("node", "depth", "part")
    while True:
        active = new.select("part").distinct()
        old = known.hint("merge").join(homes, "node").hint("merge").join(active, "part", "left_semi").select("node", "depth", "part")
        told = new.withColumn("new", F.lit(True)).unionByName(old.withColumn("new", F.lit(False))).select(*[F.col(c).alias(c) for c in ("node", "depth", "part", "new")])
        followed = links.hint("merge").join(active, "part", "left_semi").groupBy("part").cogroup(told.groupBy("part")).applyInArrow(_follow(max_depth), f"node {kind}, depth long, part long")
        followed = checkpoint(followed)
        nearest = followed.groupBy("node").agg(F.min("depth").alias("depth"))
        before, known = known, checkpoint(known.unionByName(nearest).groupBy("node").agg(F.min("depth").alias("depth")))
        if parts == 1:
            break
        better = known.hint("merge").join(before.select("node", F.col("depth").alias("__was")), "node", "left").where("__was is null or depth < __was").select("node", "depth")
        # to the parts that do not have it from themselves
        new = checkpoint(better.hint("merge").join(homes, "node").hint("merge").join(followed, ["node", "depth", "part"], "left_anti").select("node", "depth", "part"))
        forget(before)
        forget(followed)
        if new.isEmpty():
            break
    return known.select("node", F.col("depth").cast("int").alias("depth"))


def reached(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """node: what reach finds, without depths. The first levels are joins, which cost less than parts; what lies further is followed by parts."""
    links = edges.select("src", "dst")
    frontier = found = checkpoint(seeds.select("node").where("node is not null").distinct())
    for _ in range(JOINED):
        step = frontier.hint("merge").join(links, frontier["node"] == links["src"]).where("dst is not null").select(F.col("dst").alias("node")).distinct()
        frontier = checkpoint(step.hint("merge").join(found, "node", "left_anti"))
        if frontier.isEmpty():
            return found
        found = found.unionByName(frontier)
    return reach(edges, found).select("node")


def program_edges(uses: DataFrame, stores: DataFrame, loads: DataFrame, frame_stores: DataFrame, frame_loads: DataFrame, arguments: DataFrame, parameters: DataFrame, links: DataFrame) -> DataFrame:
    """Where taint moves in a program, as src, dst.

    uses: def_id, user_id. stores / loads: object_id, prop, value_id. frame_stores /
    frame_loads: env_id, name, value_id. arguments: call_id, ord, value_id (from 1, 0 is this).
    parameters: func_id, ord, value_id (from 0). links: call_id, func_id.
    """
    key = lambda kind, *c: F.concat_ws("|", F.lit(kind), *[F.concat(F.length(F.col(x).cast("string")).cast("string"), F.lit(":"), F.col(x).cast("string")) for x in c])
    side = lambda df, kind, c, name: df.where(" and ".join(f"{x} is not null" for x in (*c, "value_id"))).select(key(kind, *c).alias("key"), F.col("value_id").alias(name))
    called = arguments.join(links.hint("merge"), "call_id").select("func_id", "ord", "value_id")
    params = parameters.select("func_id", (F.col("ord") + 1).alias("ord"), "value_id")
    ends = [(stores, loads, "p", ("object_id", "prop")), (frame_stores, frame_loads, "f", ("env_id", "name")), (called, params, "c", ("func_id", "ord"))]
    out = _united([side(a, kind, c, "src") for a, _, kind, c in ends]), _united([side(b, kind, c, "dst") for _, b, kind, c in ends])
    given = uses.select(F.col("def_id").alias("src"), F.col("user_id").alias("dst")).where("src <> dst")
    return _pairs_once(*out, given)


def _united(parts: list[DataFrame]) -> DataFrame:
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first


def _pairs_once(stores: DataFrame, loads: DataFrame, given: DataFrame) -> DataFrame:
    """src, dst: each pair of different values that meet at a key, or that are given, once. stores: key, src. loads: key, dst.

    A pair can only come twice where both of its values have several keys (given pairs count as one). Only these pairs are
    compared; the others, nearly all as a rule, are streamed from the join. Keys with many pairs are dealt to several tasks.
    """
    stores, loads = stores.distinct(), loads.distinct()
    several = lambda rows, c: rows.select(c).unionByName(given.select(c).distinct()).groupBy(c).agg((F.count(F.lit(1)) > 1).alias("many"))
    stores = checkpoint(stores.hint("merge").join(several(stores, "src"), "src").select("key", "src", F.col("many").alias("many_src")))
    loads = checkpoint(loads.hint("merge").join(several(loads, "dst"), "dst").select("key", "dst", F.col("many").alias("many_dst")))
    left, right = _dealt(stores, loads, "key", "src")
    pairs = left.hint("merge").join(right, ["key", "share"]).where("src <> dst")
    twice = F.col("many_src") & F.col("many_dst")
    once = pairs.where(~twice).select("src", "dst")
    # given pairs are compared with the pairs of their values, which have several keys if they meet at one
    return once.unionByName(pairs.where(twice).select("src", "dst").unionByName(given).distinct())


def _dealt(left: DataFrame, right: DataFrame, key: str, by: str) -> tuple[DataFrame, DataFrame]:
    """Both with share: shares of a key's rows on the left, dealt out by a column, each of which meets all of its rows on the right. Only
    keys of both sides stay."""
    shares = left.groupBy(key).agg(F.count(F.lit(1)).alias("n")).hint("merge").join(right.groupBy(key).agg(F.count(F.lit(1)).alias("m")), key)
    shares = checkpoint(shares.select(key, (F.col("n") * F.col("m")).alias("pairs"), F.least(F.ceil(F.col("n") * F.col("m") / KEY_PAIRS), F.col("n")).alias("shares")))
    tasks = -(-(shares.agg(F.sum("pairs")).first()[0] or 0) // KEY_PAIRS)
    shares = shares.drop("pairs")
    spark = left.sparkSession
    left = left.hint("merge").join(shares, key).withColumn("share", F.pmod(F.xxhash64(by), F.col("shares"))).drop("shares")
    right = right.hint("merge").join(shares, key).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).drop("shares")
    if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")):
        # few rows may give very many pairs, so that tasks are counted by these
        left, right = (df.repartition(min(tasks, 1 << 14), key, "share") for df in (left, right))
    return left, right


def _spread(links: DataFrame, seeds: DataFrame, max_depth: int | None) -> DataFrame:
    """source, node, path: of each seed (node) and node that it reaches the least of the shortest paths, level by level."""
    frontier = found = checkpoint(seeds.select(F.col("node").alias("source"), "node", F.array("node").alias("path")).distinct())
    for depth in _levels(max_depth):
        step = frontier.hint("merge").join(links, frontier["node"] == links["src"]).where(~F.array_contains("path", F.col("dst")))
        step = step.groupBy("source", F.col("dst")).agg(F.min(F.array_append("path", F.col("dst"))).alias("path")).withColumnRenamed("dst", "node")
        frontier = checkpoint(step.hint("merge").join(found.select("source", "node"), ["source", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
        if depth % MERGED == 0:
            found = checkpoint(found)
    return found


def taint_routes(edges: DataFrame, sources: DataFrame, sinks: DataFrame, *, max_depth: int | None = None, shown=lambda path, first: F.slice(path, first + 1, F.size(path))) -> DataFrame:
    """source, sink, path: the shortest path of each pair, the least of several. sources, sinks: node.

    A path never visits a value twice, and ends at the sink. Values from which no sink can be reached
    are found first, backwards, and not followed.

    Many ways meet at hubs. Sources are followed to their first hubs, and these to the sinks, so that pairs are not stored level by level; each is
    written by the join at its hub. Only pairs that come by several hubs, or also without one, are compared.

    shown(path, first): what is returned of a path from its place first on, as an array, in which a step may depend on the one before it; source
    and sink are returned as its first entry for these nodes.
    """
    links = edges.select("src", "dst").distinct()
    useful = reached(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")), sinks)
    links = checkpoint(links.hint("merge").join(useful.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"))
    sinks = sinks.select("node").distinct()
    ways = links.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n")).hint("merge").join(links.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("m")), "node")
    hubs = checkpoint(ways.where(F.col("n") * F.col("m") >= HUB_WAYS).select("node"))
    near = checkpoint(_spread(links.hint("merge").join(hubs.withColumnRenamed("node", "src"), "src", "left_anti").select("src", "dst"), sources, max_depth))
    to_hub = near.hint("merge").join(hubs, "node").select("source", F.col("node").alias("hub"), F.col("path").alias("prefix"))
    direct = near.hint("merge").join(hubs, "node", "left_anti").hint("merge").join(sinks, "node").where("source <> node").select("source", F.col("node").alias("sink"), "path")
    far = _spread(links, to_hub.select(F.col("hub").alias("node")).distinct(), max_depth)
    onward = far.hint("merge").join(sinks, "node").select(F.col("source").alias("hub"), F.col("node").alias("sink"), F.col("path").alias("suffix"))
    # pairs that may come by several hubs; pairs without a hub, of which a source holds a bounded list
    several = lambda rows, c, name: rows.groupBy(c).agg((F.count(F.lit(1)) > 1).alias(name))
    own = direct.groupBy("source").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= OWN_SINKS).select("source")
    own = direct.hint("merge").join(own, "source").groupBy("source").agg(F.collect_list("sink").alias("own"))
    left = to_hub.hint("merge").join(several(to_hub, "source", "many_source"), "source").hint("merge").join(own, "source", "left").hint("merge").join(direct.select("source", F.lit(True).alias("any")).distinct(), "source", "left")
    left = left.select("source", "hub", "prefix", "own", (F.col("any").isNotNull() & F.col("own").isNull()).alias("large"), "many_source", F.get(shown(F.array("source"), 0), F.lit(0)).alias("from"), shown(F.col("prefix"), 0).alias("before"))
    right = onward.hint("merge").join(several(onward, "sink", "many_sink"), "sink")
    right = right.select("hub", "sink", "suffix", "many_sink", F.get(shown(F.array("sink"), 0), F.lit(0)).alias("to"), shown(F.col("suffix"), 1).alias("after"))
    left, right = checkpoint(left), checkpoint(right)
    a, b = _dealt(left, right, "hub", "source")
    pairs = a.hint("merge").join(b, ["hub", "share"]).where("source <> sink")
    if max_depth is not None:
        pairs = pairs.where(F.size("prefix") + F.size("suffix") - 2 <= max_depth)
    compared = F.col("large") | (F.col("many_source") & F.col("many_sink"))
    once = pairs.where(~compared & ~F.coalesce(F.array_contains("own", F.col("sink")), F.lit(False)))
    once = once.select(F.col("from").alias("source"), F.col("to").alias("sink"), F.concat("before", "after").alias("path"))
    whole = F.concat("prefix", F.slice("suffix", 2, F.size("suffix"))).alias("path")
    again = direct.select("source", "sink").hint("merge").join(left.where("not large").select("source", "hub", "prefix"), "source").hint("merge").join(right.select("hub", "sink", "suffix"), ["hub", "sink"])
    rest = pairs.where(compared).select("source", "sink", whole).unionByName(again.select("source", "sink", whole)).unionByName(direct)
    rest = rest.groupBy("source", "sink").agg(F.min(F.struct(F.size("path").alias("n"), "path")).alias("x"))
    rest = rest.select(F.get(shown(F.array("source"), 0), F.lit(0)).alias("source"), F.get(shown(F.array("sink"), 0), F.lit(0)).alias("sink"), shown(F.col("x.path"), 0).alias("path"))
    return once.unionByName(rest)


def call_links(calls: DataFrame, functions: DataFrame, *, internal: tuple[str, ...] = ()) -> DataFrame:
    """calls: call_id, prop. functions: func_id, name, ord. A call goes to the first function of
    that name; common and very short names link nothing. internal: parts of the names of the
    script engine's own functions, which are left out."""
    good = functions.where((F.length("name") > 0) & (F.col("name") != "global"))
    for part in internal:
        good = good.where(~F.contains("name", F.lit(part)))
    first = good.groupBy("name").agg(F.min_by("func_id", "ord").alias("func_id"))
    asked = calls.where((F.length("prop") > 2) & ~F.col("prop").isin(*R.COMMON_METHODS))
    return asked.join(first, asked["prop"] == first["name"]).select("call_id", "func_id")


def reconstruct_strings(constants: DataFrame, sums: DataFrame, *, max_depth: int = 8) -> DataFrame:
    """value_id, text: constant string evaluation from the leaves up. constants: value_id, text.
    sums: value_id, lhs, rhs. Sides that are not known within max_depth rounds are {VAR}."""
    known = constants.select("value_id", "text")
    depth = checkpoint(sums.select("value_id", "lhs", "rhs"))
    all_ = known
    for _ in range(max_depth):
        left, right = all_.select(F.col("value_id").alias("lhs"), F.col("text").alias("l")), all_.select(F.col("value_id").alias("rhs"), F.col("text").alias("r"))
        step = depth.join(left, "lhs", "left").join(right, "rhs", "left")
        text = F.concat(F.coalesce("l", F.lit(R.HOLE)), F.coalesce("r", F.lit(R.HOLE)))
        all_ = checkpoint(known.unionByName(step.select("value_id", text.alias("text"))))
    return all_


def destination(arguments: DataFrame) -> DataFrame:
    """call_id, destination: the first argument, from 1, that reads like a URL. arguments: call_id, ord, text."""
    like = arguments.where("ord >= 1").where(F.col("text").rlike("^(http|//|/)"))
    first = like.groupBy("call_id").agg(F.min_by("text", "ord").alias("destination"))
    return arguments.select("call_id").distinct().join(first, "call_id", "left").select("call_id", F.coalesce("destination", F.lit(R.DYNAMIC)).alias("destination"))


def source_table(spark) -> DataFrame:
    return spark.createDataFrame(R.SOURCES, "name string, kind string, returns string")


def sink_table(spark) -> DataFrame:
    """name, type, is_method, url_arg, data_arg (places, -1: none), object_name, method (of methods)."""
    places = {name: (url, data) for name, url, data in R.SINK_ARGUMENTS}
    rows = [(n, t, m, *places[n], *(n.rsplit(".", 1) if m and "." in n else (None, None))) for n, t, m in R.SINKS]
    return spark.createDataFrame(rows, "name string, type string, is_method boolean, url_arg int, data_arg int, object_name string, method string")


def severity(sink_type: Column) -> Column:
    """Of an unknown type: that of Network."""
    table = F.create_map(*[F.lit(x) for t, tag, _ in R.SEVERITIES for x in (t, tag)])
    return F.coalesce(F.try_element_at(table, sink_type), F.lit(R.SEVERITIES[0][1]))


def category(sink_type: Column) -> Column:
    table = F.create_map(*[F.lit(x) for t, _, c in R.SEVERITIES for x in (t, c)])
    return F.coalesce(F.try_element_at(table, sink_type), F.lit(R.SEVERITIES[0][2]))


def object_name(kind: Column, prop: Column, callee_func: Column, callee_prop: Column) -> Column:
    """The name of a value as an object. kind: null without a value, '' for one that is no
    instruction; prop: literal of a property load; callee_func, callee_prop: of a call."""
    call = F.coalesce(F.concat(callee_func, F.lit("()")), F.concat(callee_prop, F.lit("()")), F.lit("AnonymousFunction()"))
    return (
        F.when(kind.isNull(), "Unknown").when((kind == "LoadPropertyInst") & prop.isNotNull(), prop)
        .when(F.endswith(kind, F.lit("CallInst")), call).when(kind == "", "UnknownSource").otherwise(kind)
    )


def backtracked_property(loads: DataFrame, stores: DataFrame) -> DataFrame:
    """load_id, name: the literal of a load, else that of the last store of its block whose object
    or property is the load's own property value, else DynamicProperty. loads: load_id, block_id,
    literal, prop_id. stores: block_id, pos, object_id, prop_id, stored (literal)."""
    s = stores.where("stored is not null").select("block_id", "pos", F.explode(F.array_distinct(F.array("object_id", "prop_id"))).alias("prop_id"), "stored")
    # the last store of each block and property first, so that no pairs of loads and stores are written
    s = s.groupBy("block_id", "prop_id").agg(F.max_by("stored", "pos").alias("stored"), F.max("pos").alias("pos"))
    last = loads.where("literal is null").join(s, ["block_id", "prop_id"]).groupBy("load_id").agg(F.max_by("stored", "pos").alias("found"))
    return loads.join(last, "load_id", "left").select("load_id", F.coalesce("literal", "found", F.lit("DynamicProperty")).alias("name"))


def source_label(found: Column, kind: Column) -> Column:
    """The registry's name of a source, else a label by its kind."""
    named = F.when(F.coalesce(found, F.lit("")) != "", found)
    return F.coalesce(named, F.when(kind == "LoadPropertyInst", "Obfuscated_Property (LoadPropertyInst)").when(F.endswith(kind, F.lit("CallInst")), "Obfuscated_Call (CallInst)").otherwise(F.concat(F.lit("Dynamic_Source ("), kind, F.lit(")"))))


def trigger_context(function: Column, event_driven: Column) -> Column:
    """Of a source's function: null: UNKNOWN; global code and functions that no event starts: AUTONOMOUS."""
    return F.when(function.isNull(), "UNKNOWN").when(function.isin("global", "main", ""), "AUTONOMOUS").when(F.coalesce(event_driven, F.lit(False)), "EVENT_DRIVEN").otherwise("AUTONOMOUS")


def source_instructions(values: DataFrame) -> DataFrame:
    """values: value_id, full_name (object.property or null), prop, callee_prop. Those that are
    sources: registered names, fingerprint properties, decoding calls."""
    names = [n for n, _, _ in R.SOURCES]
    inside = lambda c, names: F.coalesce(F.col(c).isin(*names), F.lit(False))
    return values.where(inside("full_name", names) | inside("prop", R.FINGERPRINT_PROPERTIES) | inside("callee_prop", R.ENCODING_CALLS))


def tainted_globals(stores: DataFrame, loads: DataFrame) -> DataFrame:
    """Loads of globals that a tainted store of the module wrote, by name only. stores: module_id,
    name. loads: module_id, name, value_id."""
    good = stores.where((F.length("name") > 1) & ~F.col("name").isin(*R.IGNORED_GLOBALS)).select("module_id", "name").distinct()
    return loads.join(good, ["module_id", "name"], "left_semi")


def sink_instructions(stores: DataFrame, calls: DataFrame) -> DataFrame:
    """value_id, sink, type. stores: value_id, object_name, prop. calls: value_id, object_name,
    method. Stores to src or href always count, as evasions; else object.name before name."""
    spark = stores.sparkSession
    table = F.broadcast(sink_table(spark))  # a fixed number of rows
    evade = F.col("prop").isin("src", "href")
    forced = stores.where(evade).select("value_id", F.concat("object_name", F.lit("."), "prop", F.lit(" (Evasion Suspected)")).alias("sink"), F.lit("Network").alias("type"))
    props, methods = table.where("not is_method"), table.where("is_method and contains(name, '.')")
    near = stores.where(~evade).withColumn("name", F.explode(F.array(F.struct(F.lit(0).alias("n"), F.concat_ws(".", "object_name", "prop").alias("name")), F.struct(F.lit(1).alias("n"), F.col("prop").alias("name")))))
    hit = near.select("value_id", "name.n", "name.name").join(props, "name").groupBy("value_id").agg(F.min_by(F.struct("name", "type"), "n").alias("x"))
    asked = calls.select("value_id", F.concat_ws(".", "object_name", "method").alias("name")).join(methods, "name")
    return forced.unionByName(hit.select("value_id", F.col("x.name").alias("sink"), F.col("x.type").alias("type"))).unionByName(asked.select("value_id", F.col("name").alias("sink"), "type"))


#: A string or template, as a whole; a comment. Possessive, so that long ones are read once.
STRING = r"(?:\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\]|\\[\s\S])*+`)"
COMMENT = r"(?://[^\n]*+|/\*[\s\S]*?\*/)"


def blanked(code: Column) -> Column:
    """A script's text with a space for each comment; what looks like one inside a string or template stays."""
    return F.regexp_replace(code, f"({STRING})|{COMMENT}", "$1 ")


def dependencies(scripts: DataFrame) -> DataFrame:
    """key, name, kind: modules that a script asks for. scripts: key, text.

    Kinds: ESM (imports and re-exports of values), Type (of types; an import list may have both), Async (import
    calls), Require (also requireActual and requireMock of require or jest), Resource, PrefetchedResource,
    GraphQL (operations in graphql templates). Read by pattern, not from a syntax tree, but not from comments, strings and other
    templates: comments are blanked first, and strings and templates are passed over as a whole, as every pattern comes after
    theirs in one alternation. (A quote inside a pattern literal of the language may begin a string too many, up to its line's end.)
    """
    quoted = r"['\"]([^'\"]+)['\"]"
    called = lambda names: r"(?<![\w.$])(?:" + "|".join(names) + r")\s*\(\s*" + quoted
    typed = r"\{[^{}'\"]*\btype\s+\w[^{}'\"]*\}"
    kinds = {
        "ESM": [r"\bimport\s+(?!type\b)(?:[^'\"();]*?\bfrom\s+)?" + quoted, r"\bexport\s+(?!type\b)(?:\*(?:\s+as\s+\w+)?|\{[^{}'\"]*\})\s*from\s+" + quoted],
        "Type": [r"\bimport\s+type(?:of)?\s+[^'\"();]*?\bfrom\s+" + quoted, r"\bexport\s+type\s+[^'\"();]*?\bfrom\s+" + quoted, r"\bimport\s+(?!type\b)(?:\w+\s*,\s*)?" + typed + r"\s*from\s+" + quoted],
        "Async": [r"\bimport\s*\(\s*" + quoted],
        "Require": [called(["require"]), r"(?<![\w.$])(?:require|jest)\.(?:requireActual|requireMock)\s*\(\s*" + quoted],
        "Resource": [called(R.RESOURCE_CALLS)], "PrefetchedResource": [called(R.PREFETCHED_CALLS)],
    }
    code = blanked(F.col("text"))

    def outside(pattern: str) -> Column:
        return F.filter(F.regexp_extract_all(code, F.lit(f"{STRING}|{pattern}"), 1), lambda x: x != "")

    found = [F.transform(outside(p), _named(k)) for k, patterns in kinds.items() for p in patterns]
    templates = outside(r"(?<![\w.$])graphql\s*`([^`]*)`")
    operations = F.flatten(F.transform(templates, lambda t: F.regexp_extract_all(t, F.lit(r"(?m)^\s*?(?:query|fragment|mutation|subscription) +(\w+)"), 1)))
    return scripts.select("key", F.explode(F.concat(*found, F.transform(operations, _named("GraphQL")))).alias("x")).select("key", "x.name", "x.kind").distinct()


def _named(kind: str):
    return lambda n: F.struct(n.alias("name"), F.lit(kind).alias("kind"))


def first_paths(rows: DataFrame) -> DataFrame:
    """Row number from 1 in path order: source, sink, path to route_id."""
    return rows.withColumn("route_id", F.row_number().over(Window.partitionBy("source").orderBy("sink", "path")))
