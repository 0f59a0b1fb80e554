"""Catalogue: traces, profiles, intervals, attribution, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import records
from ..operators import trace as O
from . import fixtures as X
from .registry import query

_C = F.col


def _events(spark, d):
    return X.table(spark, d, "events")


@query("asof_lookup", """SELECT c.event_id, c.user_id, v.event_id AS last_view FROM (SELECT * FROM events WHERE event_type = 'click') c
  ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY ALL) v ON c.user_id = v.user_id AND c.ts >= v.ts""")
def asof_lookup(spark, d):
    e = _events(spark, d)
    left = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'view'").select("user_id", "ts", _C("event_id").alias("last_view"))
    return O.asof(left, right, "user_id", "ts", "ts", "last_view").select("event_id", "user_id", "last_view")


def _sections(spark, d):
    k = _C("p_partkey")
    return X.table(spark, d, "part").select(k, k.cast("string").alias("title"), (k * 100).alias("start"), (k * 100 + 100).alias("end"))


@query("interval_overlap", "SELECT p.page, (p_partkey)::VARCHAR AS title FROM part JOIN (SELECT unnest(range((SELECT max(p_partkey) * 100 // 4096 + 2 FROM part))) AS page) p ON p_partkey * 100 < (p.page + 1) * 4096 AND p_partkey * 100 + 100 > p.page * 4096")
def interval_overlap(spark, d):
    return O.interval_overlap(_sections(spark, d), 4096)


@query("gap_fill", """WITH s AS (SELECT p_size AS grp, p_partkey::VARCHAR AS title, p_partkey * 100 AS s, p_partkey * 100 + 100 AS e FROM part WHERE p_partkey % 7 <> 0), g AS (SELECT *, lag(e) OVER (PARTITION BY grp ORDER BY s) AS b FROM s)
  SELECT grp, title, s AS start, e AS "end" FROM s UNION ALL SELECT grp, '<unknown>', b, s FROM g WHERE b < s""")
def gap_fill(spark, d):
    k = _C("p_partkey")  # the sections are all but every seventh, so that there are holes to fill
    s = X.table(spark, d, "part").where(k % 7 != 0).select(_C("p_size").alias("grp"), k.cast("string").alias("title"), (k * 100).alias("start"), (k * 100 + 100).alias("end"))
    return O.gap_fill(s, "grp")


@query("gaps_and_islands", """WITH c AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
  g AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM c) SELECT user_id, island::BIGINT AS island, any_value(event_type) AS label, count(*) AS n, sum(event_id)::BIGINT AS total FROM g GROUP BY user_id, island""")
def gaps_and_islands(spark, d):
    return O.islands(_events(spark, d), "user_id", ["event_id"], "event_type", "event_id")


@query("range_islands", "WITH k AS (SELECT p_brand AS grp, p_partkey // 3 AS v FROM part GROUP BY ALL), g AS (SELECT *, v - row_number() OVER (PARTITION BY grp ORDER BY v) AS g FROM k) SELECT grp, min(v) AS first, max(v) AS last FROM g GROUP BY grp, g")
def range_islands(spark, d):
    return O.value_islands(X.table(spark, d, "part").select(_C("p_brand").alias("grp"), F.floor(_C("p_partkey") / 3).alias("v")), "grp", "v")


@query("range_merge", """WITH r AS (SELECT p_brand AS grp, p_partkey AS s, p_partkey + p_size AS e FROM part), m AS (SELECT *, max(e) OVER (PARTITION BY grp ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM r),
  g AS (SELECT *, sum(CASE WHEN s <= b THEN 0 ELSE 1 END) OVER (PARTITION BY grp ORDER BY s, e) AS g FROM m) SELECT grp, min(s) AS start, max(e) AS "end" FROM g GROUP BY grp, g""")
def range_merge(spark, d):
    return O.merge_ranges(X.table(spark, d, "part").select(_C("p_brand").alias("grp"), _C("p_partkey").alias("start"), (_C("p_partkey") + _C("p_size")).alias("end")), "grp")


@query("running_total_topk", """WITH t AS (SELECT l_partkey, sum(l_quantity)::BIGINT AS q FROM lineitem GROUP BY 1), k AS (SELECT * FROM t ORDER BY q DESC, l_partkey LIMIT 100)
  SELECT l_partkey, q, row_number() OVER w::INT AS rank, sum(q) OVER w AS running, (SELECT sum(q) FROM t) AS whole FROM k WINDOW w AS (ORDER BY q DESC, l_partkey)""")
def running_total_topk(spark, d):
    t = X.table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").cast("long").alias("q"))
    return O.running_topk(t, "l_partkey", "q", 100)


@query("top_blocks", """WITH b AS (SELECT l_suppkey AS func, l_partkey % 11 AS profile_index, sum(l_quantity)::BIGINT AS count, max(l_linenumber)::BIGINT AS insts FROM lineitem GROUP BY ALL), e AS (SELECT func, arg_max(count, profile_index) AS entries FROM b GROUP BY func)
  SELECT func, profile_index, count * insts AS instructions, CASE WHEN entries = 0 THEN 0.0 ELSE count / entries END AS average_loop FROM b JOIN e USING (func) WHERE profile_index > 0 ORDER BY instructions DESC, func, profile_index LIMIT 100""")
def top_blocks(spark, d):
    return O.top_blocks(_blocks(spark, d), 100)


@query("time_delta", "SELECT event_id, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS delta FROM events")
def time_delta(spark, d):
    return O.time_delta(_events(spark, d), "user_id", "ts", ["event_id"]).select("event_id", "delta")


@query("id_normalise", "SELECT user_id, row_number() OVER (ORDER BY min(event_id)) - 1 AS id FROM events GROUP BY user_id")
def id_normalise(spark, d):
    return O.ids_by_first_sight(_events(spark, d), "user_id", "event_id")


@query("stats_moments", "SELECT l_returnflag, count(*) AS n, min(l_quantity) AS low, max(l_quantity) AS high, sum(l_quantity) AS total, sum(l_quantity * l_quantity) AS squares, avg(l_quantity) AS mean, stddev_pop(l_quantity) AS deviation FROM lineitem GROUP BY 1")
def stats_moments(spark, d):
    return O.moments(X.table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity")


@query("attribution_rollup", """WITH u AS (SELECT DISTINCT l_suppkey AS grp, l_returnflag || ':' || l_linestatus AS type, l_partkey AS key, l_partkey % 97 + 1 AS size FROM lineitem),
  n AS (SELECT type, key, count(DISTINCT grp) AS users FROM u GROUP BY ALL), x AS (SELECT grp, unnest([string_split(type, ':')[1], type]) AS prefix, size, users FROM u JOIN n USING (type, key))
  SELECT grp, prefix, sum(CASE WHEN users = 1 THEN size ELSE 0 END)::BIGINT AS private, sum(size)::BIGINT AS shared, round(sum(size / users), 6) AS amortised FROM x GROUP BY ALL""")
def attribution_rollup(spark, d):
    li = X.table(spark, d, "lineitem").select(_C("l_suppkey").alias("grp"), F.concat_ws(":", "l_returnflag", "l_linestatus").alias("type"), _C("l_partkey").alias("key"), (_C("l_partkey") % 97 + 1).alias("size"))
    return O.attribution(li).withColumn("amortised", F.round("amortised", 6))


@query("usage_records", "SELECT DISTINCT l_suppkey AS func, l_returnflag AS type, l_partkey AS key FROM lineitem")
def usage_records(spark, d):
    return X.table(spark, d, "lineitem").select(_C("l_suppkey").alias("func"), _C("l_returnflag").alias("type"), _C("l_partkey").alias("key")).distinct()


@query("opcode_frequency", "SELECT p_type AS opcode, sum(l_quantity)::BIGINT AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def opcode_frequency(spark, d):
    return X.table(spark, d, "lineitem").join(X.table(spark, d, "part"), _C("l_partkey") == _C("p_partkey")).groupBy(_C("p_type").alias("opcode")).agg(F.sum("l_quantity").cast("long").alias("n"))


def _blocks(spark, d):
    return X.table(spark, d, "lineitem").groupBy(_C("l_suppkey").alias("func"), (_C("l_partkey") % 11).alias("profile_index")).agg(F.sum("l_quantity").cast("long").alias("count"), F.max("l_linenumber").cast("long").alias("insts"))


_BLOCKS = "WITH b AS (SELECT l_suppkey AS func, l_partkey % 11 AS profile_index, sum(l_quantity)::BIGINT AS count, max(l_linenumber)::BIGINT AS insts FROM lineitem GROUP BY ALL)"


@query("function_stats", f"{_BLOCKS} SELECT func, arg_max(count, profile_index) AS entries, sum(count * insts)::BIGINT AS instructions FROM b GROUP BY func")
def function_stats(spark, d):
    return O.function_stats(_blocks(spark, d))


@query("trace_summary", f"{_BLOCKS} SELECT count(DISTINCT func) FILTER (WHERE profile_index > 0) AS functions, count(*) FILTER (WHERE profile_index > 0) AS blocks, count(*) FILTER (WHERE profile_index > 0 AND count > 0) AS run_blocks, (sum(count) FILTER (WHERE profile_index > 0))::BIGINT AS executions FROM b")
def trace_summary(spark, d):
    return O.trace_summary(_blocks(spark, d))


@query("pages_touched", "SELECT p_brand AS func, count(DISTINCT page) AS pages FROM (SELECT p_brand, unnest(range(p_partkey * 100 // 4096, (p_partkey * 100 + p_size * 10 + 9) // 4096 + 1)) AS page FROM part) GROUP BY 1")
def pages_touched(spark, d):
    k = _C("p_partkey")
    return O.pages_touched(X.table(spark, d, "part").select(_C("p_brand").alias("func"), (k * 100).alias("start"), (k * 100 + _C("p_size") * 10 + 10).alias("end")), "func", 4096)


@query("stack_trie", """WITH s AS (SELECT ['main', l_returnflag, l_linestatus, 'f' || l_linenumber][1:(l_orderkey % 4 + 1)] AS stack FROM lineitem), x AS (SELECT stack, unnest(range(1, len(stack) + 1)) AS i FROM s)
  SELECT array_to_string(stack[1:i], '/') AS path, i::INT AS depth, sum((i = len(stack))::INT)::BIGINT AS hits, count(*) AS total FROM x GROUP BY ALL""")
def stack_trie(spark, d):
    stack = F.slice(F.array(F.lit("main"), "l_returnflag", "l_linestatus", F.concat(F.lit("f"), _C("l_linenumber").cast("string"))), F.lit(1), (_C("l_orderkey") % 4 + 1).cast("int"))
    return O.stack_trie(X.table(spark, d, "lineitem").select(stack.alias("stack")))


@query("cache_miss_ranking", "SELECT l_suppkey AS place, count(*) AS misses FROM lineitem WHERE l_discount > 0.05 GROUP BY 1 ORDER BY misses DESC, place LIMIT 50")
def cache_miss_ranking(spark, d):
    return X.table(spark, d, "lineitem").where("l_discount > 0.05").groupBy(_C("l_suppkey").alias("place")).agg(F.count(F.lit(1)).alias("misses")).orderBy(F.desc("misses"), "place").limit(50)


@query("coverage_distinct", "SELECT DISTINCT l_suppkey AS module, l_partkey AS func FROM lineitem")
def coverage_distinct(spark, d):
    return X.table(spark, d, "lineitem").select(_C("l_suppkey").alias("module"), _C("l_partkey").alias("func")).distinct()


@query("status_histogram", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_histogram(spark, d):
    return X.table(spark, d, "orders").groupBy(_C("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("slowest_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 20")
def slowest_topk(spark, d):
    return O.slowest(X.table(spark, d, "orders"), "o_orderkey", "o_totalprice", 20)


@query("size_by_category", "SELECT CASE WHEN p_brand < 'Brand#3' THEN 'text' ELSE 'data' END AS category, sum(p_size)::BIGINT AS size FROM part GROUP BY 1")
def size_by_category(spark, d):
    return X.table(spark, d, "part").groupBy(F.when(_C("p_brand") < "Brand#3", "text").otherwise("data").alias("category")).agg(F.sum("p_size").alias("size"))


@query("self_size", "SELECT l_partkey AS node, sum(l_linenumber * l_quantity)::BIGINT AS self_size FROM lineitem GROUP BY 1")
def self_size(spark, d):
    return X.table(spark, d, "lineitem").groupBy(_C("l_partkey").alias("node")).agg(F.sum(_C("l_linenumber") * _C("l_quantity")).cast("long").alias("self_size"))


@query("section_diff", """WITH a AS (SELECT p_brand AS section, sum(p_size) AS size FROM part WHERE p_partkey % 2 = 0 AND p_brand <> 'Brand#1' GROUP BY 1), b AS (SELECT p_brand AS section, sum(p_size) AS size FROM part WHERE p_partkey % 2 = 1 AND p_brand <> 'Brand#2' GROUP BY 1)
  SELECT section, coalesce(a.size, 0)::BIGINT AS before, coalesce(b.size, 0)::BIGINT AS after, (coalesce(b.size, 0) - coalesce(a.size, 0))::BIGINT AS change FROM a FULL JOIN b USING (section)""")
def section_diff(spark, d):
    p = X.table(spark, d, "part")
    side = lambda c: p.where(c).groupBy(_C("p_brand").alias("section")).agg(F.sum("p_size").alias("size"))
    return O.section_diff(side("p_partkey % 2 = 0 AND p_brand <> 'Brand#1'"), side("p_partkey % 2 = 1 AND p_brand <> 'Brand#2'"))


@query("new_functions_anti", "SELECT p_partkey AS func, p_size AS size FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48) ORDER BY size DESC, func LIMIT 10")
def new_functions_anti(spark, d):
    # few lines are that large, so that there are parts without one
    old = X.table(spark, d, "lineitem").where("l_quantity > 48").select(_C("l_partkey").alias("p_partkey")).distinct()
    return X.table(spark, d, "part").join(old, "p_partkey", "left_anti").orderBy(F.desc("p_size"), "p_partkey").limit(10).select(_C("p_partkey").alias("func"), _C("p_size").alias("size"))


@query("profile_unmatched", "SELECT l_partkey AS checksum, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5) GROUP BY 1")
def profile_unmatched(spark, d):
    good = X.table(spark, d, "part").where("p_size > 5").select(_C("p_partkey").alias("l_partkey"))
    return X.table(spark, d, "lineitem").join(good, "l_partkey", "left_anti").groupBy(_C("l_partkey").alias("checksum")).agg(F.count(F.lit(1)).alias("n"))


@query("point_in_interval", """SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey * 37 AS x, p_name AS name FROM lineitem LEFT JOIN part ON l_partkey * 37 // 100 = p_partkey AND l_partkey * 37 % 100 < 60""")
def point_in_interval(spark, d):
    k = _C("p_partkey")
    points = X.table(spark, d, "lineitem").select((_C("l_orderkey") * 10 + _C("l_linenumber")).alias("id"), (_C("l_partkey") * 37).alias("x"))
    return O.point_in_interval(points, X.table(spark, d, "part").select(_C("p_name").alias("name"), (k * 100).alias("start"), (k * 100 + 60).alias("end")), 128)


@query("casemap_override", "SELECT p_partkey AS cp, CASE WHEN p_partkey % 5 = 0 THEN p_partkey + 2 WHEN p_partkey % 3 = 0 THEN p_partkey + 1 ELSE p_partkey END AS mapped FROM part")
def casemap_override(spark, d):
    k = X.table(spark, d, "part").select(_C("p_partkey").alias("cp"))
    layer = lambda c, n: k.where(c).select("cp", (_C("cp") + n).alias("mapped"))
    return O.override([layer("true", 0), layer("cp % 3 = 0", 1), layer("cp % 5 = 0", 2)], "cp", "mapped")


def _hexed(c):
    return F.hex(c.cast("long"))


#: Lines of the three tables of letters: a letter's upper case is the next one's, some have special ones, of two letters or with a condition.
_LETTERS = """u AS (SELECT p_partkey AS cp, CASE WHEN p_partkey % 3 = 0 THEN p_partkey + 1 END AS upper, CASE WHEN p_partkey % 4 = 0 THEN p_partkey - 2 END AS lower FROM part WHERE p_partkey > 2),
  x AS (SELECT p_partkey AS cp, p_partkey + 5 AS upper FROM part WHERE p_partkey % 10 = 7 AND p_size % 2 = 0 AND p_partkey > 2), two AS (SELECT p_partkey AS cp FROM part WHERE p_partkey % 10 = 9 AND p_partkey > 2), f AS (SELECT p_partkey AS cp, p_partkey + 32 AS fold FROM part WHERE p_partkey % 6 IN (1, 2) AND p_partkey > 2)"""


@query("case_canonical", f"""WITH {_LETTERS}, m AS (SELECT cp, CASE WHEN two.cp IS NOT NULL THEN cp WHEN x.upper IS NOT NULL THEN x.upper ELSE coalesce(u.upper, cp) END AS upper, CASE WHEN x.cp IS NOT NULL OR two.cp IS NOT NULL THEN cp ELSE coalesce(lower, cp) END AS lower, coalesce(fold, cp) AS fold FROM u LEFT JOIN x USING (cp) LEFT JOIN two USING (cp) LEFT JOIN f USING (cp))
  SELECT cp, upper, lower, fold, CASE WHEN upper < 128 AND cp >= 128 THEN cp ELSE upper END AS canonical FROM m""")
def case_canonical(spark, d):
    p, k = X.table(spark, d, "part").where("p_partkey > 2"), _C("p_partkey")
    opt = lambda test, v: F.when(test, _hexed(v)).otherwise("")
    data = p.select(F.concat(_hexed(k), F.lit(";LETTER;" + ";" * 10), opt(k % 3 == 0, k + 1), F.lit(";"), opt(k % 4 == 0, k - 2), F.lit(";")).alias("value"))
    special = p.where("p_partkey % 10 = 7").select(F.concat(_hexed(k), F.lit("; "), _hexed(k), F.lit("; 41; "), _hexed(k + 5), F.lit("; "), F.when(_C("p_size") % 2 == 1, "tr; ").otherwise(""), F.lit("# note; x")).alias("value"))
    special = special.union(p.where("p_partkey % 10 = 9").select(F.concat(_hexed(k), F.lit("; "), _hexed(k), F.lit(" 61; 41; 41 42; # two")).alias("value")))
    folding = p.select(F.concat(_hexed(k), F.lit("; "), F.element_at(F.array(*map(F.lit, "TCSFTF")), (k % 6 + 1).cast("int")), F.lit("; "), _hexed(k + 32), F.lit("; # x")).alias("value"))
    return O.canonical(O.case_maps(data, special, folding))


@query("run_compression", """WITH RECURSIVE r AS (SELECT p_brand AS grp, p_partkey AS k, p_partkey + p_partkey // 500 * 32 AS v, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part),
  t(grp, n, f, l, s, d, id) AS (SELECT grp, n, k, k, 0::BIGINT, v - k, 1 FROM r WHERE n = 1 UNION ALL SELECT grp, n, CASE WHEN ok THEN f ELSE k END, k, CASE WHEN ok THEN k - l ELSE 0 END, v - k, CASE WHEN ok THEN id ELSE id + 1 END
    FROM (SELECT r.*, t.f, t.l, t.id, r.v - r.k = t.d AND r.k - t.f < 256 AND (t.s = 0 OR r.k - t.l = t.s) AS ok FROM t JOIN r ON r.grp = t.grp AND r.n = t.n + 1) x)
  SELECT grp, min(f) AS first, max(l) AS last, arg_max(s, n) AS stride, any_value(d) AS delta FROM t GROUP BY grp, id""")
def run_compression(spark, d):
    k = _C("p_partkey")
    return O.compress_runs(X.table(spark, d, "part").select(_C("p_brand").alias("grp"), k.alias("key"), (k + F.floor(k / 500) * 32).alias("value")), "grp", "key", "value")


@query("heap_unnest", "SELECT vec_id AS id, i AS no, embedding[i * 4 + 1] AS a, embedding[i * 4 + 2] AS b, embedding[i * 4 + 3] AS c, embedding[i * 4 + 4] AS d FROM (SELECT *, unnest(range(len(embedding) // 4)) AS i FROM embeddings)")
def heap_unnest(spark, d):
    return O.heap_nodes(X.table(spark, d, "embeddings").select(_C("vec_id").alias("id"), _C("embedding").alias("numbers")), ["a", "b", "c", "d"])


@query("heap_edges", "SELECT l_orderkey * 10 + l_linenumber AS edge, l_partkey AS target, p_name AS name FROM lineitem JOIN part ON l_partkey = p_partkey")
def heap_edges(spark, d):
    return X.table(spark, d, "lineitem").join(X.table(spark, d, "part"), _C("l_partkey") == _C("p_partkey")).select((_C("l_orderkey") * 10 + _C("l_linenumber")).alias("edge"), _C("l_partkey").alias("target"), _C("p_name").alias("name"))


@query("alloc_stack", """WITH RECURSIVE p AS (SELECT p_partkey + 1 AS node, (p_partkey + 1) // 3 AS up FROM part), r(node, up, stack) AS (SELECT node, up, [node] FROM p UNION ALL SELECT r.node, p.up, list_prepend(p.node, stack) FROM r JOIN p ON p.node = r.up WHERE r.up <> 0)
  SELECT node, array_to_string(stack, '/') AS stack FROM r WHERE up = 0""")
def alloc_stack(spark, d):
    k = _C("p_partkey") + 1
    out = O.ancestors(X.table(spark, d, "part").select(k.alias("node"), F.floor(k / 3).cast("long").alias("parent")))
    return out.select("node", F.array_join(F.transform("stack", lambda x: x.cast("string")), "/").alias("stack"))


@query("resume_anti_join", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def resume_anti_join(spark, d):
    done = X.table(spark, d, "lineitem").where("l_quantity > 45").select(_C("l_orderkey").alias("o_orderkey")).distinct()
    return X.table(spark, d, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")


@query("allowlist_semi_join", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 500)")
def allowlist_semi_join(spark, d):
    from ..operators.text import allow_listed

    listed = X.table(spark, d, "customer").select(_C("c_custkey").alias("o_custkey"))
    return allow_listed(X.table(spark, d, "orders"), listed, "o_custkey", "o_custkey", 500).select("o_orderkey")


@query("record_number", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS no FROM events")
def record_number(spark, d):
    from pyspark.sql import Window

    return _events(spark, d).select("event_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long").alias("no"))


@query("set_operations", """WITH a AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 48), b AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 48)
  SELECT 'union' AS op, k FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'except', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'intersect', k FROM (SELECT k FROM a INTERSECT SELECT k FROM b)""")
def set_operations(spark, d):
    li = X.table(spark, d, "lineitem").where("l_quantity > 48")
    a, b = (li.where(_C("l_returnflag") == f).select(_C("l_suppkey").alias("k")).distinct() for f in "AR")
    named = lambda n, df: df.select(F.lit(n).alias("op"), "k")
    return named("union", a.union(b).distinct()).unionByName(named("except", a.subtract(b))).unionByName(named("intersect", a.intersect(b)))


@query("event_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    w = F.window("ts", "1 hour")
    return _events(spark, d).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(_C("window.start").alias("hour"), "event_type", "n", "total")


@query("sessions", """WITH c AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS c FROM events), g AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM c)
  SELECT user_id, min(ts) AS first, count(*) AS n FROM g GROUP BY user_id, g""")
def sessions(spark, d):
    return _events(spark, d).groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.min("ts").alias("first"), F.count(F.lit(1)).alias("n")).select("user_id", "first", "n")


@query("heap_locations", """WITH n AS (SELECT vec_id AS id, i AS no, embedding[i * 4 + 1] AS a FROM (SELECT *, unnest(range(len(embedding) // 4)) AS i FROM embeddings)), l AS (SELECT p_partkey AS id, (p_size % 16) * 4 AS object_index, p_size AS line FROM part)
  SELECT id, no, a, line FROM l JOIN n USING (id) WHERE no = object_index // 4""")
def heap_locations(spark, d):
    nodes = O.heap_nodes(X.table(spark, d, "embeddings").select(_C("vec_id").alias("id"), _C("embedding").alias("numbers")), ["a", "b", "c", "d"])
    places = X.table(spark, d, "part").select(_C("p_partkey").alias("id"), (_C("p_size") % 16 * 4).alias("object_index"), _C("p_size").alias("line"))
    return O.heap_locations(places, nodes, 4).select("id", "no", "a", "line")


@query("predicate_islands", """WITH n AS (SELECT user_id, event_id, event_type IN ('click', 'view', 'purchase') AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), g AS (SELECT *, n - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM n WHERE t)
  SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM g GROUP BY user_id, g""")
def predicate_islands(spark, d):
    return O.predicate_islands(_events(spark, d), "user_id", "event_id", _C("event_type").isin("click", "view", "purchase"))


@query("paired_ranges", """WITH r AS (SELECT p_size AS grp, p_partkey AS v, CASE WHEN p_partkey % 3 = 0 THEN 'x, First>' ELSE 'x, Last>' END AS name FROM part), e AS (SELECT *, CASE WHEN ends_with(name, 'First>') AND ends_with(lead(name) OVER w, 'Last>') THEN lead(v) OVER w ELSE v END AS e FROM r WINDOW w AS (PARTITION BY grp ORDER BY v)),
  b AS (SELECT *, CASE WHEN v <= max(e + 1) OVER (PARTITION BY grp ORDER BY v, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM e), g AS (SELECT *, sum(n) OVER (PARTITION BY grp ORDER BY v, e) AS g FROM b) SELECT grp, min(v) AS first, max(e) AS last FROM g GROUP BY grp, g""")
def paired_ranges(spark, d):
    k = _C("p_partkey")
    rows = X.table(spark, d, "part").select(_C("p_size").alias("grp"), k.alias("v"), F.when(k % 3 == 0, "x, First>").otherwise("x, Last>").alias("name"))
    return O.paired_ranges(rows, "grp", "v", "name")


#: Records of all kinds from the order lines: a trace for every supplier's remainder, ids from few numbers so that they come again.
_KINDS = ("CreateObjectRecord", "CreateHostFunctionRecord", "GetPropertyRecord", "SetPropertyNativeRecord", "CreatePropNameIDRecord", "CallFromNativeRecord", "ReturnToNativeRecord")


def _records(spark, d):
    # an order's line number may come twice, with another part
    k, q, at = _C("l_partkey"), _C("l_quantity").cast("long"), (_C("l_orderkey") * 8 + _C("l_linenumber")) * 100_000_000 + _C("l_partkey") * 1000 + _C("l_suppkey") % 1000
    t = _C("l_linenumber") % 7
    value = lambda n: F.when((k + n) % 4 == 0, F.concat(F.lit("string:a:"), q.cast("string"))).when((k + n) % 4 == 1, F.concat(F.lit("object:"), (k % 61 + n).cast("string"))).when((k + n) % 4 == 2, "undefined:")
    null = lambda kind: F.lit(None).cast(kind)
    return X.table(spark, d, "lineitem").select(
        (_C("l_suppkey") % 5).cast("long").alias("trace"), at.cast("long").alias("ord"), F.element_at(F.array(*map(F.lit, _KINDS)), (t + 1).cast("int")).alias("type"),
        F.when(t != 5, k % 97).cast("long").alias("objID"), F.when(t == 5, k % 89).cast("long").alias("functionID"), null("long").alias("hostObjectID"), null("long").alias("propNamesID"), null("long").alias("propID"), null("long").alias("propNameID"),
        F.when(t.isin(2, 3), F.concat(F.lit("p"), (k % 7).cast("string"))).alias("propName"), F.when((t == 1) & (k % 2 == 0), "f").alias("functionName"), null("string").alias("encoding"),
        F.when(t == 4, F.concat(F.lit("n"), (k % 11).cast("string"))).alias("chars"), F.when(t == 3, value(0)).alias("value"), F.when(t == 6, value(1)).alias("retval"), F.when(t == 5, "undefined:").alias("thisArg"),
        F.when(t == 5, F.array(value(0), value(1), value(2), value(4))).alias("args"), null("array<string>").alias("properties"),
    )


def _value_sql(n: int) -> str:
    return f"CASE (l_partkey + {n}) % 4 WHEN 0 THEN 'string:a:' || l_quantity::BIGINT WHEN 1 THEN 'object:' || (l_partkey % 61 + {n}) WHEN 2 THEN 'undefined:' END"


_RECORDS = f"""rec AS (SELECT (l_suppkey % 5)::BIGINT AS trace, ((l_orderkey * 8 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey % 1000)::BIGINT AS ord, l_linenumber % 7 AS t, {list(_KINDS)}[l_linenumber % 7 + 1] AS type,
  CASE WHEN t <> 5 THEN l_partkey % 97 END AS objID, CASE WHEN t = 5 THEN l_partkey % 89 END AS functionID, CASE WHEN t IN (2, 3) THEN 'p' || (l_partkey % 7) END AS propName, CASE WHEN t = 1 AND l_partkey % 2 = 0 THEN 'f' END AS functionName,
  CASE WHEN t = 4 THEN 'n' || (l_partkey % 11) END AS chars, CASE WHEN t = 3 THEN {_value_sql(0)} END AS value, CASE WHEN t = 6 THEN {_value_sql(1)} END AS retval, CASE WHEN t = 5 THEN 'undefined:' END AS thisArg, CASE WHEN t = 5 THEN [{_value_sql(0)}, {_value_sql(1)}, {_value_sql(2)}, {_value_sql(4)}] END AS args FROM lineitem)"""


def _shown(rows):
    return rows.select("trace", "ord", "type", "objID", "functionID", "propID", "propNameID", "propName", "chars", "value", "retval", F.array_join("args", ",", "-").alias("args"))


@query("trace_upgrade", f"""WITH {_RECORDS},
  news AS (SELECT *, list_concat(CASE WHEN t = 1 THEN [coalesce(functionName, '')] WHEN t IN (2, 3) THEN [propName] ELSE [] END, list_transform(list_filter(list_concat([value, retval], coalesce(args, [])), lambda v: starts_with(v, 'string:')), lambda v: substr(v, 8))) AS news FROM rec),
  most AS (SELECT trace, max(i) AS most FROM (SELECT trace, greatest(objID, functionID) AS i FROM rec UNION ALL SELECT trace, substr(v, 8)::BIGINT FROM (SELECT trace, unnest(list_concat([value, retval], coalesce(args, []))) AS v FROM rec) WHERE starts_with(v, 'object:')) GROUP BY 1),
  b AS (SELECT *, coalesce(sum(len(news)) OVER (PARTITION BY trace ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before, row_number() OVER (PARTITION BY trace ORDER BY ord) AS nth FROM news JOIN most USING (trace)),
  p AS (SELECT *, most + 1 + before AS id, before + nth - 1 AS place, CASE WHEN t IN (1, 2, 3) THEN 1 ELSE 0 END AS head FROM b),
  a AS (SELECT trace, ord, i, CASE WHEN starts_with(v, 'string:') THEN 'string:' || (id + sum(CASE WHEN starts_with(v, 'string:') THEN 1 ELSE 0 END) OVER (PARTITION BY trace, ord ORDER BY i)::BIGINT - 1) ELSE v END AS v FROM (SELECT trace, ord, id, unnest(args) AS v, unnest(range(len(args))) AS i FROM p)),
  g AS (SELECT trace, ord, string_agg(coalesce(v, '-'), ',' ORDER BY i) AS args FROM a GROUP BY ALL)
  SELECT trace, place + len(news) AS ord, type, objID, functionID, CASE WHEN t = 2 THEN id END AS propID, CASE WHEN t IN (1, 3) THEN id END AS propNameID, propName, chars,
    CASE WHEN starts_with(value, 'string:') THEN 'string:' || (id + head) ELSE value END AS value, CASE WHEN starts_with(retval, 'string:') THEN 'string:' || (id + head) ELSE retval END AS retval, g.args FROM p LEFT JOIN g USING (trace, ord)
  UNION ALL SELECT trace, place + i, CASE WHEN i = 0 AND t IN (1, 3) THEN 'CreatePropNameIDRecord' ELSE 'CreateStringRecord' END, id + i, NULL, NULL, NULL, NULL, news[i + 1], NULL, NULL, NULL FROM (SELECT *, unnest(range(len(news))) AS i FROM p)""")
def trace_upgrade(spark, d):
    return _shown(records.upgrade(_records(spark, d)))


@query("trace_normalise", f"""WITH {_RECORDS},
  m0 AS (SELECT trace, ord, t = 4 AS makes, chars, unnest(list_concat([objID, functionID], list_transform(list_filter(list_concat([value, retval], coalesce(args, [])), lambda v: starts_with(v, 'object:')), lambda v: substr(v, 8)::BIGINT))) AS id, unnest(range(2 + len(list_filter(list_concat([value, retval], coalesce(args, [])), lambda v: starts_with(v, 'object:'))))) AS k FROM rec),
  m AS (SELECT trace, ord, k, id, makes AND k = 0 AS makes, CASE WHEN k = 0 THEN chars END AS chars FROM m0 WHERE id IS NOT NULL),
  f AS (SELECT *, row_number() OVER (PARTITION BY trace, id ORDER BY ord, k) AS n FROM m QUALIFY n = 1), o AS (SELECT * FROM f WHERE id <> trace * 3),
  l AS (SELECT *, CASE WHEN makes THEN first_value(id) OVER (PARTITION BY trace, makes, chars ORDER BY ord, k) ELSE id END AS leader FROM o),
  n AS (SELECT trace, id AS leader, row_number() OVER (PARTITION BY trace ORDER BY ord, k) AS normal FROM l WHERE leader = id),
  w AS (SELECT trace, id, normal FROM l JOIN n USING (trace, leader) UNION ALL SELECT DISTINCT trace, trace * 3, 0 FROM rec),
  a AS (SELECT r.trace, r.ord, i, CASE WHEN starts_with(v, 'object:') THEN 'object:' || normal ELSE v END AS v FROM (SELECT trace, ord, unnest(args) AS v, unnest(range(len(args))) AS i FROM rec) r LEFT JOIN w ON w.trace = r.trace AND starts_with(v, 'object:') AND w.id = try_cast(substr(v, 8) AS BIGINT)),
  g AS (SELECT trace, ord, string_agg(coalesce(v, '-'), ',' ORDER BY i) AS args FROM a GROUP BY ALL)
  SELECT rec.trace, rec.ord, type, x.normal AS objID, y.normal AS functionID, NULL::BIGINT AS propID, NULL::BIGINT AS propNameID, propName, chars, CASE WHEN starts_with(value, 'object:') THEN 'object:' || u.normal ELSE value END AS value, CASE WHEN starts_with(retval, 'object:') THEN 'object:' || v.normal ELSE retval END AS retval, g.args
  FROM rec LEFT JOIN w x ON x.trace = rec.trace AND x.id = objID LEFT JOIN w y ON y.trace = rec.trace AND y.id = functionID LEFT JOIN w u ON u.trace = rec.trace AND starts_with(value, 'object:') AND u.id = try_cast(substr(value, 8) AS BIGINT)
  LEFT JOIN w v ON v.trace = rec.trace AND starts_with(retval, 'object:') AND v.id = try_cast(substr(retval, 8) AS BIGINT) LEFT JOIN g ON g.trace = rec.trace AND g.ord = rec.ord""")
def trace_normalise(spark, d):
    r = _records(spark, d)
    # strings are texts here, not ids: only objects are made dense
    plain = r.withColumns({c: F.regexp_replace(c, "^string:", "text:") for c in ("value", "retval")} | {"args": F.transform("args", lambda v: F.regexp_replace(v, "^string:", "text:"))})
    out = records.normalise(plain, r.select("trace").distinct().withColumn("globalObjID", _C("trace") * 3))
    back = lambda c: F.regexp_replace(c, "^text:", "string:")
    return _shown(out.withColumns({"value": back("value"), "retval": back("retval"), "args": F.transform("args", back)}))


@query("page_sections", """WITH s AS (SELECT p_partkey::VARCHAR AS title, p_partkey * 100 AS s, p_partkey * 100 + p_size * 1000 AS e FROM part), p AS (SELECT DISTINCT l_partkey * 37 // 4096 AS page FROM lineitem) SELECT page, title FROM p JOIN s ON s < (page + 1) * 4096 AND e > page * 4096""")
def page_sections(spark, d):
    k = _C("p_partkey")
    sections = X.table(spark, d, "part").select(k.cast("string").alias("title"), (k * 100).alias("start"), (k * 100 + _C("p_size") * 1000).alias("end"))
    return O.interval_overlap(sections, 4096, X.table(spark, d, "lineitem").select(F.floor(_C("l_partkey") * 37 / 4096).alias("page")))
