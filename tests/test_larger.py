"""Rows as larger tables hold them, and steps that must not grow with pairs or be held in the driver."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tarnweave import catalog
from tarnweave.functions import js as J
from tarnweave.operators import graph as G
from tarnweave.operators import records as N
from tarnweave.operators import rules as L
from tarnweave.operators.common import checkpoint
from tarnweave.plans import fixtures as X
from tarnweave.plans.catalog_stream import in_parts
from tarnweave.streaming import state

from .oracle import connect, differences
from .test_taint import shortest


def folder(path, **tables):
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        sql = tables.get(name, f"SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
        duckdb.connect().execute(f"COPY ({sql}) TO '{path}/{name}.parquet' (FORMAT parquet)")
    return str(path)


def same(spark, d, name):
    return differences(spark, connect(d), d, catalog.queries()[name], catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", ["arr_comparator_sort", "arr_edit", "arr_iterate"])
def test_components_are_scaled_in_single_precision(spark, tmp_path, name):
    d = folder(tmp_path, embeddings="SELECT k::BIGINT AS vec_id, [(i * k / 100)::FLOAT for i in range(1, 9)] AS embedding, 0 AS label FROM range(1, 12) t(k)")
    assert same(spark, d, name) == ""


def test_zeros_of_folded_whole_numbers_have_no_sign(spark):
    rows = catalog.queries()["constant_fold"](spark, "/root/testdata/sf0.01").where("event_id % 17 <> 3").select("value", "unary").collect()
    assert not any(str(x) == "-0.0" for r in rows for x in r)


def test_large_ids_are_divided_as_whole_numbers(spark, tmp_path):
    d = folder(tmp_path, events="SELECT event_id + 35000000000000000 AS event_id, * EXCLUDE (event_id) FROM '/root/testdata/sf0.01/events.parquet'")
    assert same(spark, d, "constant_fold") == ""


def test_folded_operators_are_compiled(spark):
    """Places are shifted by an expression, not taken from a list of all that may be meant."""
    plan = catalog.queries()["constant_fold"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("shiftright") < 20


def test_long_texts_in_base64_are_one_line(spark, tmp_path):
    d = folder(tmp_path, pages="SELECT page_id, url || repeat('/abc', (page_id % 60)::INT) AS url, html FROM '/root/testdata/sf0.001/pages.parquet'")
    assert same(spark, d, "encoding_functions") == ""


def test_sizes_of_a_thousand_mebibytes(spark, tmp_path):
    d = folder(tmp_path, part="SELECT p_partkey + 838000 AS p_partkey, * EXCLUDE (p_partkey) FROM '/root/testdata/sf0.01/part.parquet'")
    assert same(spark, d, "human_formats") == ""


def test_each_pair_once_however_many_keys_it_meets_at(spark, monkeypatch):
    monkeypatch.setattr(G, "KEY_PAIRS", 7)
    t = lambda rows, cols: spark.createDataFrame(rows, cols)
    stores = t([(o, p, v) for o in range(3) for p in "ab" for v in range(o, 12)] + [(1, "a", 5), (None, "a", 6), (1, "a", None)], "object_id long, prop string, value_id long")
    loads = t([(o, p, v) for o in range(1, 4) for p in "ab" for v in range(5, 5 + 4 * o)] + [(9, "z", 1), (None, "a", 7)], "object_id long, prop string, value_id long")
    frames = t([(1, "x", v) for v in range(30, 40)] + [(1, "x", 5)], "env_id long, name string, value_id long")
    uses = t([(5, 6), (5, 6), (77, 78), (30, 31), (4, 4), (30, 79)], "def_id long, user_id long")
    args, params = t([(1, 1, 5), (1, 1, 41), (2, 1, 41)], "call_id long, ord long, value_id long"), t([(8, 0, 6), (8, 0, 42)], "func_id long, ord long, value_id long")
    links = t([(1, 8), (2, 8)], "call_id long, func_id long")
    got = [tuple(r) for r in G.program_edges(uses, stores, loads, frames, frames, args, params, links).collect()]
    rows = lambda df: [tuple(r) for r in df.collect()]
    want = set(rows(uses))
    for a, b in ((stores, loads), (frames, frames)):
        want |= {(x[2], y[2]) for x in rows(a) for y in rows(b) if x[:2] == y[:2] and None not in x + y}
    want |= {(x[2], y[2]) for x in rows(args) for c, f in rows(links) for y in rows(params) if x[0] == c and y[0] == f and y[1] + 1 == x[1]}
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a, b in want if a != b}


def test_what_is_near_is_reached_by_joins(spark, monkeypatch):
    """Edges are dealt to parts only for what lies beyond."""
    dealt = []
    monkeypatch.setattr(G, "reach", lambda *a, plain=G.reach: dealt.append(a) or plain(*a))
    edges = spark.createDataFrame([(n, n + 1) for n in range(9)] + [(9, 3), (40, 41), (3, None)], "src long, dst long")
    seeds = spark.createDataFrame([(0,), (0,), (77,), (None,)], "node long")
    for joined, calls in ((12, 0), (4, 1)):
        monkeypatch.setattr(G, "JOINED", joined)
        assert sorted(r["node"] for r in G.reached(edges, seeds).collect()) == [*range(10), 77] and len(dealt) == calls


@pytest.mark.parametrize("ways, own", [(1, 1 << 10), (4, 1 << 10), (4, 1), (6, 0), (1 << 20, 1)])
def test_routes_through_hubs_are_the_shortest(spark, monkeypatch, ways, own):
    """Whatever counts as a hub, sources and sinks that are hubs among them, and several hubs on the ways of a pair."""
    monkeypatch.setattr(G, "HUB_WAYS", ways)
    monkeypatch.setattr(G, "OWN_SINKS", own)
    monkeypatch.setattr(G, "KEY_PAIRS", 9)
    pick = random.Random(5)
    edges = sorted({(f"v|{pick.randrange(26)}", f"v|{pick.randrange(26)}") for _ in range(62)} - {(f"v|{n}", f"v|{n}") for n in range(26)})
    sources, sinks = [f"v|{n}" for n in range(0, 26, 3)], [f"v|{n}" for n in range(0, 26, 2)]
    nodes = lambda names: spark.createDataFrame([(n,) for n in names], "node string")
    for most in (None, 3):
        got = G.taint_routes(spark.createDataFrame(edges, "src string, dst string"), nodes(sources), nodes(sinks), max_depth=most).collect()
        want = {k: list(v) for k, v in shortest(edges, sources, sinks).items() if most is None or len(v) <= most + 1}
        assert len(got) == len(want) > 20 and {(r["source"], r["sink"]): r["path"] for r in got} == want


def test_pairs_that_meet_at_a_hub_are_not_stored(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(G, "checkpoint", lambda df: stored.append(checkpoint(df)) or stored[-1])
    edges = spark.sql("SELECT concat('s', id) AS src, 'h' AS dst FROM range(60) UNION ALL SELECT 'h', concat('t', id) FROM range(60)")
    nodes = lambda x: spark.range(60).selectExpr(f"concat('{x}', id) AS node")
    routes = G.taint_routes(edges, nodes("s"), nodes("t"))
    assert max(df.count() for df in stored) < 200 and routes.count() == 3600
    assert {tuple(r["path"]) for r in routes.collect()} == {(f"s{a}", "h", f"t{b}") for a in range(60) for b in range(60)}


def test_only_the_last_store_of_a_block_and_property_meets_loads(spark):
    loads = spark.range(300).selectExpr("id AS load_id", "0L AS block_id", "cast(null AS string) AS literal", "id % 2 AS prop_id")
    stores = spark.range(400).selectExpr("0L AS block_id", "id AS pos", "id % 2 AS object_id", "5L AS prop_id", "concat('s', id) AS stored")
    found = G.backtracked_property(loads, stores)
    assert {(r["load_id"] % 2, r["name"]) for r in found.collect()} == {(0, "s398"), (1, "s399")}
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("max_by") >= 2


@pytest.mark.parametrize("name", ["event_handlers", "event_functions", "transfer_edges", "taint_pairs", "sink_destinations", "returned_sources"])
def test_program_tables_are_not_broadcast(spark, name):
    """A few bytes of the file become sixteen values each."""
    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_routes_are_numbered_in_groups_of_bounded_size(spark, tmp_path, monkeypatch):
    """A site's routes do not stay in one task: what is grouped by site and more is dealt out anew."""
    monkeypatch.setattr(X, "GROUP_IDS", 7)
    monkeypatch.setattr(G, "TASK_ROWS", 50)
    d = folder(tmp_path, events="SELECT event_id * 3 AS event_id, * EXCLUDE (event_id) FROM '/root/testdata/sf0.001/events.parquet'")
    for name in ("url_netloc", "gtg_nodes", "gtg_edges", "ctg_edges", "dot_export"):
        assert same(spark, d, name) == "", name
    routes = X.routes(spark, d)
    plan = routes.groupBy("domain", "source_name").count()._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(domain" in plan and "source_name" in plan[plan.index("hashpartitioning(domain") :].split(")")[0]
    tasks = G.taint_graph_edges(routes)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in tasks


def test_findings_are_merged_without_sorting_all_of_them(spark):
    """The first step of the merge is an aggregate by hash of fixed width; nulls and equal places give what one minimum gives."""
    made = "id, 'd' || id % 2 AS domain, struct(id % 3 AS rule_group, id div 4 AS route_id) AS seq, 'l' || id % 2 AS label, CASE WHEN id % 5 > 0 THEN 'c' || id % 3 END AS trigger_context"
    rows = spark.sql(f"SELECT {made}, 's' AS source, 'k' AS sink, 'https://x/' || id % 7 AS destination, CASE WHEN id % 4 > 0 THEN 't' END AS observed_trackers, 'p' AS party FROM range(400)")
    merged = L.merge_threats(rows)
    keyed = L.with_key(rows).groupBy("domain", "source", "sink", "key_dest", "label", "destination", "party").agg(F.min(F.struct("seq", "trigger_context", "observed_trackers")).alias("first"))
    want = L.fold_threats(keyed).drop("key_dest").select(*merged.columns)
    assert sorted(map(repr, merged.collect())) == sorted(map(repr, want.collect())) and merged.count() == 14
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[domain" in plan


def test_escapes_of_many_and_few_letters(spark):
    """Whole texts are escaped in Python, not letter by letter in expressions; what looks like an escape comes back as it was."""
    texts = ["", "a b", "%", "%20", "%2520 %u0041", "x%u12%20y", "€%€ %u20AC", "😀한é\n\x00 ~!'()", "".join(map(chr, range(0x20, 0xD800))), "".join(map(chr, range(256))) * 3, "😀" * 50, None]

    def plain(t):
        units = [int.from_bytes(u, "little") for u in (t.encode("utf-16-le")[i : i + 2] for i in range(0, 2 * len(t.encode("utf-16-le")) // 2, 2))]
        return "".join(chr(u) if u < 128 and (chr(u).isalnum() or chr(u) in "@*_+-./") else f"%{u:02X}" if u < 256 else f"%u{u:04X}" for u in units)

    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    out = rows.select("t", J.escaped(F.col("t")).alias("e"), J.unescaped(J.escaped(F.col("t"))).alias("b"), J.unescaped(F.col("t")).alias("u"))
    for r in out.collect():
        assert r["e"] == (None if r["t"] is None else plain(r["t"])) and r["b"] == r["t"]
    assert [r["u"] for r in out.where("t in ('%2520 %u0041', 'x%u12%20y', '%')").collect()] == ["%", "%20 A", "x%u12 y"]
    assert "transform" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_findings_are_reduced_before_the_state(spark, tmp_path):
    """No row leaves the engine, and a batch's findings of a kind are one row before they are shuffled."""
    found = spark.sql("SELECT 'd' AS domain, 1 AS rule_group, id AS route_id, 'l' AS label, 'c' AS trigger_context, 's' AS source, 'k' AS sink, 'x' AS destination, 'None' AS observed_trackers, 'p' AS party FROM range(5000)")
    sink = in_parts(spark, found, F.col("route_id") % 2 * 2, lambda source, sink, ckpt: state.run_threats(spark, source, sink, ckpt))
    assert spark.read.parquet(sink).count() == 2  # a row for each batch
    assert state.current_threats(spark, sink).count() == 1


@pytest.mark.parametrize("held", [0, 1 << 16])
def test_first_mentions_are_found_once(spark, monkeypatch, held):
    """Not anew for each step that needs them, and by hash; results are the same where ids are joined."""
    monkeypatch.setattr(N, "TABLE_IDS", held)
    stored = []
    monkeypatch.setattr(N, "checkpoint", lambda df: stored.append(df._jdf.queryExecution().executedPlan().toString()) or checkpoint(df))
    d = "/root/testdata/sf0.001"
    assert same(spark, d, "trace_normalise") == ""
    assert len(stored) == 2 and "HashAggregate(keys=[trace" in stored[0] and "posexplode" not in stored[1]
