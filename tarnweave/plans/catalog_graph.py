"""Catalogue: threat graphs, reachability, links and joins of the program graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import registries as R
from ..operators import graph as O
from . import fixtures as X
from .registry import query

_ID = lambda x: f"'N_' || substr(md5({x}), 1, 10)"
_LAB = f"""WITH {X.BASE_SQL}, lab AS (SELECT domain, route_id, CASE WHEN trim(source_name) IN ('', 'Unknown') THEN '[Dynamic_Source]' ELSE trim(source_name) END AS source,
  trim(sink_name) || chr(10) || replace(trim(destination_url), '"', '''') AS sink_key, path_nodes, destination_url FROM fx_routes),
chain AS (SELECT domain, [source] || list_transform(range(len(path_nodes)), lambda i: route_id || '_' || i || '_' || path_nodes[i + 1]) || [sink_key] AS c, destination_url FROM lab)"""
_EDGES = f"SELECT DISTINCT domain, {_ID('c[i]')} AS src, {_ID('c[i + 1]')} AS dst FROM (SELECT domain, c, unnest(range(1, len(c))) AS i FROM {{t}})"


@query("gtg_nodes", f"""{_LAB} SELECT DISTINCT domain, {_ID('source')} AS node, 'source' AS kind, source AS label FROM lab UNION SELECT DISTINCT domain, {_ID('sink_key')}, 'sink', sink_key FROM lab
  UNION SELECT domain, {_ID("route_id || '_' || i || '_' || path_nodes[i + 1]")}, 'step', path_nodes[i + 1] FROM (SELECT *, unnest(range(len(path_nodes))) AS i FROM lab)""")
def gtg_nodes(spark, d):
    return O.taint_graph_nodes(X.routes(spark, d))


@query("gtg_edges", f"{_LAB} {_EDGES.format(t='chain')}")
def gtg_edges(spark, d):
    return O.taint_graph_edges(X.routes(spark, d))


@query("ctg_edges", f"""{_LAB}, good AS (SELECT * FROM chain c WHERE destination_url <> 'DYNAMIC_URL' OR domain NOT IN (SELECT domain FROM fx_routes WHERE destination_url <> 'DYNAMIC_URL')) {_EDGES.format(t='good')}""")
def ctg_edges(spark, d):
    return O.taint_graph_edges(O.resolved_routes(X.routes(spark, d)))


#: Seeds are the largest parts; each node keeps its first level.
_REACH = f"""WITH RECURSIVE {X.EDGES_SQL}, r(node, depth) USING KEY (node) AS (SELECT p_partkey, 0::BIGINT FROM part WHERE p_size = 50
    UNION SELECT dst, min(r.depth) + 1 FROM r JOIN fx_edges ON src = r.node WHERE NOT EXISTS (SELECT 1 FROM recurring.r AS x WHERE x.node = dst) GROUP BY dst)"""


def _seeds(spark, d):
    return X.table(spark, d, "part").where("p_size = 50").select(F.col("p_partkey").alias("node"))


@query("reachability", f"{_REACH} SELECT node, depth::INT AS depth FROM r")
def reachability(spark, d):
    return O.reach(X.edges(spark, d), _seeds(spark, d))


@query("event_closure", f"{_REACH} SELECT node, depth::INT AS depth FROM r WHERE depth <= 10")
def event_closure(spark, d):
    """The closure of event functions ends after ten rounds, as a feature."""
    return O.reach(X.edges(spark, d), _seeds(spark, d), max_depth=10)


#: Every seventh call asks for a common name, every eleventh for one of two letters; functions of these names are there.
_COMMON = "CASE WHEN l_partkey % 7 = 0 THEN 'push' WHEN l_partkey % 11 = 0 THEN 'ab' ELSE p_type END"


@query("call_links", f"""WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN 'push' WHEN p_partkey % 17 = 0 THEN 'ab' WHEN p_partkey % 19 = 0 THEN 'global' WHEN p_partkey % 23 = 0 THEN '' ELSE p_type END AS name FROM part),
  f AS (SELECT name, min(p_partkey) AS func_id FROM n WHERE name NOT IN ('', 'global') GROUP BY name)
  SELECT l_orderkey * 10 + l_linenumber AS call_id, func_id FROM lineitem JOIN part ON l_partkey = p_partkey JOIN f ON name = {_COMMON} WHERE length(name) > 2 AND name NOT IN {R.COMMON_METHODS}""")
def call_links(spark, d):
    part, k, c = X.table(spark, d, "part").select("p_partkey", "p_type"), F.col("p_partkey"), F.col("l_partkey")
    prop = F.when(c % 7 == 0, "push").when(c % 11 == 0, "ab").otherwise(F.col("p_type"))
    calls = X.table(spark, d, "lineitem").join(part, c == k).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("call_id"), prop.alias("prop"))
    name = F.when(k % 13 == 0, "push").when(k % 17 == 0, "ab").when(k % 19 == 0, "global").when(k % 23 == 0, "").otherwise(F.col("p_type"))
    return O.call_links(calls, part.select(k.alias("func_id"), name.alias("name"), k.alias("ord")))


def _edges(spark, d, **tables):
    """program_edges of some of its tables; the others are empty."""
    p = X.table(spark, d, "part").limit(0)
    pair = lambda a, b, c, n="p_size": p.select(F.col("p_partkey").alias(a), F.col(n).alias(b), F.col("p_partkey").alias(c))
    none = {
        "uses": p.select(F.col("p_partkey").alias("def_id"), F.col("p_partkey").alias("user_id")), "stores": pair("object_id", "prop", "value_id", "p_brand"), "loads": pair("object_id", "prop", "value_id", "p_brand"),
        "frame_stores": pair("env_id", "name", "value_id", "p_brand"), "frame_loads": pair("env_id", "name", "value_id", "p_brand"), "arguments": pair("call_id", "ord", "value_id"),
        "parameters": pair("func_id", "ord", "value_id"), "links": p.select(F.col("p_partkey").alias("call_id"), F.col("p_partkey").alias("func_id")),
    }
    return O.program_edges(**(none | tables))


@query("property_join", """SELECT DISTINCT s.p_partkey AS src, l.p_partkey AS dst FROM part s JOIN part l ON s.p_partkey % 20 = l.p_partkey % 20 AND s.p_brand = l.p_brand AND s.p_size > 45 AND l.p_size < 5 AND s.p_partkey <> l.p_partkey""")
def property_join(spark, d):
    p = X.table(spark, d, "part")
    side = lambda c: p.where(c).select((F.col("p_partkey") % 20).alias("object_id"), F.col("p_brand").alias("prop"), F.col("p_partkey").alias("value_id"))
    return _edges(spark, d, stores=side("p_size > 45"), loads=side("p_size < 5"))


@query("frame_join", "SELECT DISTINCT s.p_partkey AS src, l.p_partkey AS dst FROM part s JOIN part l ON s.p_size = l.p_size AND s.p_type = l.p_type AND s.p_partkey <> l.p_partkey")
def frame_join(spark, d):
    p = X.table(spark, d, "part").select(F.col("p_size").alias("env_id"), F.col("p_type").alias("name"), F.col("p_partkey").alias("value_id"))
    return _edges(spark, d, frame_stores=p, frame_loads=p)


@query("argument_join", """SELECT DISTINCT a.l_partkey AS src, p.p_partkey AS dst FROM lineitem a JOIN part p ON p.p_partkey % 50 = a.l_suppkey % 50 AND p.p_size = a.l_linenumber - 1 AND a.l_partkey <> p.p_partkey""")
def argument_join(spark, d):
    args = X.table(spark, d, "lineitem").select((F.col("l_suppkey") % 50).alias("call_id"), F.col("l_linenumber").alias("ord"), F.col("l_partkey").alias("value_id"))
    params = X.table(spark, d, "part").select((F.col("p_partkey") % 50).alias("func_id"), F.col("p_size").alias("ord"), F.col("p_partkey").alias("value_id"))
    return _edges(spark, d, arguments=args.distinct(), parameters=params, links=params.select(F.col("func_id").alias("call_id"), "func_id").distinct())


@query("source_registry", f"WITH {X.BASE_SQL}, s(name, kind, returns) AS (VALUES {', '.join(repr(x) for x in R.SOURCES)}) SELECT domain, route_id, kind, returns FROM fx_routes JOIN s ON name = source_name")
def source_registry(spark, d):
    # the registry has a fixed number of rows
    table = F.broadcast(O.source_table(spark))
    return X.routes(spark, d).join(table, F.col("source_name") == F.col("name")).select("domain", "route_id", "kind", "returns")


@query("sink_registry", f"""WITH {X.BASE_SQL}, s(name, type, m) AS (VALUES {', '.join(f"('{a}', '{b}', {str(c).lower()})" for a, b, c in R.SINKS)})
  SELECT domain, route_id, CASE WHEN regexp_matches(sink_name, '\\.(src|href) \\(Evasion') THEN 'Network' ELSE coalesce(type, 'Unknown') END AS found,
  CASE sink_type WHEN 'Network' THEN '[CRITICAL]' WHEN 'XSS' THEN '[MEDIUM]' WHEN 'Navigation' THEN '[LOW]' WHEN 'Storage' THEN '[WARNING]' ELSE '[HIGH]' END AS severity FROM fx_routes LEFT JOIN s ON name = sink_name""")
def sink_registry(spark, d):
    table = F.broadcast(O.sink_table(spark))
    rows = X.routes(spark, d).join(table, F.col("sink_name") == F.col("name"), "left")
    return rows.select("domain", "route_id", F.when(F.col("sink_name").rlike(r"\.(src|href) \(Evasion"), "Network").otherwise(F.coalesce("type", F.lit("Unknown"))).alias("found"), O.severity(F.col("sink_type")).alias("severity"))


@query("sink_arguments", f"""WITH {X.BASE_SQL}, s(name, m) AS (VALUES {', '.join(f"('{a}', {str(c).lower()})" for a, _, c in R.SINKS)}), a(name, url_arg, data_arg) AS (VALUES {', '.join(map(str, R.SINK_ARGUMENTS))})
  SELECT domain, route_id, url_arg, data_arg, CASE WHEN m AND contains(name, '.') THEN split_part(name, '.', 1) END AS object_name, CASE WHEN m AND contains(name, '.') THEN split_part(name, '.', 2) END AS method FROM fx_routes JOIN s ON name = sink_name JOIN a USING (name)""")
def sink_arguments(spark, d):
    # the registry has a fixed number of rows
    table = F.broadcast(O.sink_table(spark))
    return X.routes(spark, d).join(table, F.col("sink_name") == F.col("name")).select("domain", "route_id", "url_arg", "data_arg", "object_name", "method")


@query("string_reconstruct", """WITH RECURSIVE c AS (SELECT p_partkey AS v, p_brand AS x FROM part WHERE p_partkey % 3 = 1), s AS (SELECT p_partkey AS v, p_partkey + 1 AS l, p_partkey // 2 AS r FROM part WHERE p_partkey % 3 = 0),
  t(n, v, x) AS (SELECT 0, v, x FROM c UNION ALL SELECT k.n + 1, u.v, u.x FROM (SELECT max(n) AS n FROM t) k, (SELECT v, x FROM c UNION ALL SELECT s.v, coalesce(a.x, '{VAR}') || coalesce(b.x, '{VAR}') FROM s LEFT JOIN t a ON a.v = s.l LEFT JOIN t b ON b.v = s.r) u WHERE k.n < 8)
  SELECT v AS value_id, x AS text FROM t WHERE n = 8""")
def string_reconstruct(spark, d):
    p = X.table(spark, d, "part")
    sums = p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("value_id"), (F.col("p_partkey") + 1).alias("lhs"), F.floor(F.col("p_partkey") / 2).cast("long").alias("rhs"))
    return O.reconstruct_strings(p.where("p_partkey % 3 = 1").select(F.col("p_partkey").alias("value_id"), F.col("p_brand").alias("text")), sums, max_depth=8)


@query("destination_accept", """WITH a AS (SELECT l_orderkey AS call_id, l_linenumber AS ord, min(CASE WHEN l_partkey % 3 = 0 THEN '//x/' || l_partkey WHEN l_partkey % 3 = 1 THEN 'https://y/' || l_partkey ELSE 'z' END) AS text FROM lineitem GROUP BY ALL)
  SELECT call_id, coalesce(arg_min(text, ord) FILTER (WHERE ord >= 1 AND regexp_matches(text, '^(http|//|/)')), 'DYNAMIC_URL') AS destination FROM a GROUP BY call_id""")
def destination_accept(spark, d):
    k = F.col("l_partkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("//x/"), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("https://y/"), k.cast("string"))).otherwise("z")
    return O.destination(X.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("call_id"), F.col("l_linenumber").alias("ord")).agg(F.min(text).alias("text")))


@query("dependencies", """WITH s AS (SELECT page_id AS key, page_id % 7 AS a, page_id % 5 AS b, page_id % 3 AS c FROM pages)
  SELECT DISTINCT key, unnest(['m' || a, 'e' || b, 'v' || c, 'm' || a || 't', 'v' || c, 'l' || c || '.js', 'r' || b, 'q' || a, 's' || a, 'p' || b, 'Get' || a, 'Frag' || b]) AS name,
    unnest(['ESM', 'ESM', 'ESM', 'Type', 'Type', 'Async', 'Require', 'Require', 'Resource', 'PrefetchedResource', 'GraphQL', 'GraphQL']) AS kind FROM s""")
def dependencies(spark, d):
    k = F.col("page_id")
    a, b, c = ((k % n).cast("string") for n in (7, 5, 3))
    text = F.concat(
        F.lit("// require('c1')\n/* import 'c2';\n from 'c3' */ var s = \"require('c4') // \", t = `import 'c5' /*`, u = 'it\\'s \"';\nimport a from 'm"), a, F.lit("'; export * from \"e"), b, F.lit("\"; import {x, type T} from 'v"), c, F.lit("'; import type U from 'm"), a, F.lit("t';\nimport('l"), c,
        F.lit(".js'); const b = require(\"r"), b, F.lit("\"); jest.requireActual('q"), a, F.lit("'); JSResource('s"), a, F.lit("'); PrefetchedJSResource('p"), b,
        F.lit("'); graphql`\n  query Get"), a, F.lit(" { x }\n fragment Frag"), b, F.lit(" on Y { z } query`; my.require('no'); other`query No`"),
    )
    return O.dependencies(X.pages(spark, d).select(k.alias("key"), text.alias("text")))


@query("event_registry", f"WITH {X.BASE_SQL}, e(name) AS (VALUES {', '.join(f"('{n}')" for n in R.EVENT_NAMES)}) SELECT event_id, event_type IN (SELECT name FROM e) AS listened FROM events")
def event_registry(spark, d):
    return X.table(spark, d, "events").select("event_id", F.col("event_type").isin(*R.EVENT_NAMES).alias("listened"))


@query("dot_export", f"""{_LAB}, e AS ({_EDGES.format(t='chain')}), n AS (SELECT DISTINCT domain, {_ID('source')} AS node, source AS label FROM lab UNION SELECT DISTINCT domain, {_ID('sink_key')}, sink_key FROM lab
  UNION ALL SELECT domain, {_ID("route_id || '_' || i || '_' || path_nodes[i + 1]")}, path_nodes[i + 1] FROM (SELECT *, unnest(range(len(path_nodes))) AS i FROM lab))
  SELECT domain, 1 AS part, '    "' || node || '" [label="' || replace(replace(label, '"', ''''), chr(10), '\\n') || '"];' AS line FROM n UNION ALL SELECT domain, 2, '    "' || src || '" -> "' || dst || '";' FROM e
  UNION ALL SELECT DISTINCT domain, 0, 'digraph G {{' FROM lab UNION ALL SELECT DISTINCT domain, 3, '}}' FROM lab""")
def dot_export(spark, d):
    r = X.routes(spark, d)
    return O.dot_lines(O.taint_graph_nodes(r), O.taint_graph_edges(r))


@query("context_labels", f"""WITH {X.BASE_SQL} SELECT domain, route_id, CASE WHEN source_name <> '' THEN source_name WHEN path_nodes[1] = 'LoadPropertyInst' THEN 'Obfuscated_Property (LoadPropertyInst)' ELSE 'x' END AS label,
  CASE WHEN route_id % 4 = 0 THEN 'UNKNOWN' WHEN route_id % 4 = 1 THEN 'AUTONOMOUS' WHEN route_id % 3 = 0 THEN 'EVENT_DRIVEN' ELSE 'AUTONOMOUS' END AS context FROM fx_routes""")
def context_labels(spark, d):
    k = F.col("route_id") % 4
    function = F.when(k == 1, "global").when(k == 2, "f").when(k == 3, "g")
    return X.routes(spark, d).select("domain", "route_id", O.source_label(F.col("source_name"), F.get("path_nodes", F.lit(0))).alias("label"), O.trigger_context(function, F.col("route_id") % 3 == 0).alias("context"))


@query("source_detection", "SELECT p_partkey AS value_id FROM part WHERE p_partkey % 6 IN (1, 3, 5)")
def source_detection(spark, d):
    k = F.col("p_partkey")
    full = F.when(k % 6 == 1, "navigator.userAgent").when(k % 6 == 2, "x.y")
    values = X.table(spark, d, "part").select(k.alias("value_id"), full.alias("full_name"), F.when(k % 6 == 3, "timeZone").when(k % 6 == 4, "other").alias("prop"), F.when(k % 6 == 5, "atob").alias("callee_prop"))
    return O.source_instructions(values).select("value_id")


@query("sink_detection", """SELECT p_partkey AS value_id, CASE p_partkey % 6 WHEN 0 THEN 'Image().src (Evasion Suspected)' WHEN 1 THEN 'document.cookie' WHEN 2 THEN 'innerHTML' WHEN 3 THEN 'window.open' END AS sink,
  CASE p_partkey % 6 WHEN 0 THEN 'Network' WHEN 1 THEN 'Storage' WHEN 2 THEN 'XSS' WHEN 3 THEN 'Navigation' END AS type FROM part WHERE p_partkey % 6 < 4""")
def sink_detection(spark, d):
    k = F.col("p_partkey") % 6
    p = X.table(spark, d, "part")
    stores = p.where((k < 3) | (k == 4)).select(F.col("p_partkey").alias("value_id"), F.when(k == 0, "Image()").when(k == 1, "document").otherwise("e").alias("object_name"), F.when(k == 0, "src").when(k == 1, "cookie").when(k == 2, "innerHTML").otherwise("zzz").alias("prop"))
    calls = p.where((k == 3) | (k == 5)).select(F.col("p_partkey").alias("value_id"), F.lit("window").alias("object_name"), F.when(k == 3, "open").otherwise("nothing").alias("method"))
    return O.sink_instructions(stores, calls)


@query("global_join", "SELECT p_partkey AS value_id FROM part WHERE p_partkey % 2 = 1 AND p_brand <> 'Brand#1' AND (p_size, p_brand) IN (SELECT (p_size, p_brand) FROM part WHERE p_partkey % 4 = 0)")
def global_join(spark, d):
    p = X.table(spark, d, "part")
    side = lambda c: p.where(c).select(F.col("p_size").alias("module_id"), F.when(F.col("p_brand") == "Brand#1", "window").otherwise(F.col("p_brand")).alias("name"), F.col("p_partkey").alias("value_id"))
    return O.tainted_globals(side("p_partkey % 4 = 0").select("module_id", "name"), side("p_partkey % 2 = 1")).select("value_id")


@query("property_backtrack", """WITH s AS (SELECT p_partkey % 40 AS b, p_partkey AS pos, p_partkey % 7 AS o, p_partkey % 5 AS q, p_brand AS v FROM part WHERE p_partkey % 3 = 0), l AS (SELECT p_partkey AS id, p_partkey % 40 AS b, p_partkey % 11 AS q, CASE WHEN p_partkey % 5 = 0 THEN p_type END AS lit FROM part WHERE p_partkey % 3 = 1)
  SELECT id AS load_id, coalesce(any_value(lit), arg_max(v, pos) FILTER (WHERE lit IS NULL), 'DynamicProperty') AS name FROM l LEFT JOIN s ON l.b = s.b AND (s.o = l.q OR s.q = l.q) GROUP BY id""")
def property_backtrack(spark, d):
    k, p = F.col("p_partkey"), X.table(spark, d, "part")
    loads = p.where(k % 3 == 1).select(k.alias("load_id"), (k % 40).alias("block_id"), F.when(k % 5 == 0, F.col("p_type")).alias("literal"), (k % 11).alias("prop_id"))
    stores = p.where(k % 3 == 0).select((k % 40).alias("block_id"), k.alias("pos"), (k % 7).alias("object_id"), (k % 5).alias("prop_id"), F.col("p_brand").alias("stored"))
    return O.backtracked_property(loads, stores)


@query("object_names", "SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'Unknown' WHEN 1 THEN p_brand WHEN 2 THEN p_brand || '()' WHEN 3 THEN 'AnonymousFunction()' WHEN 4 THEN 'UnknownSource' ELSE 'PhiInst' END AS name FROM part")
def object_names(spark, d):
    k, b = F.col("p_partkey") % 6, F.col("p_brand")
    kind = F.when(k == 1, "LoadPropertyInst").when((k == 2) | (k == 3), "CallInst").when(k == 4, "").when(k == 5, "PhiInst")
    return X.table(spark, d, "part").select(F.col("p_partkey").alias("id"), O.object_name(kind, F.when(k == 1, b), F.lit(None).cast("string"), F.when(k == 2, b)).alias("name"))
