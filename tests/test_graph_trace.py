from tarnweave.operators import graph as G
from tarnweave.operators import trace as T


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def nodes(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "node long")


def test_reach_ends_on_cycles(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 1), (3, 4), (5, 6)])
    got = {r["node"]: (r["depth"], r["path"]) for r in G.reach(e, nodes(spark, 1), max_depth=50, with_path=True).collect()}
    assert got == {1: (0, [1]), 2: (1, [1, 2]), 3: (2, [1, 2, 3]), 4: (3, [1, 2, 3, 4])}


def test_taint_moves_through_properties_frames_and_calls(spark):
    t = lambda rows, s: spark.createDataFrame(rows, s)
    e = G.program_edges(
        t([(1, 2)], "def_id long, user_id long"), t([(7, "p", 2)], "object_id long, prop string, value_id long"), t([(7, "p", 3), (8, "p", 99)], "object_id long, prop string, value_id long"),
        t([(1, "v", 3)], "env_id long, name string, value_id long"), t([(1, "v", 4)], "env_id long, name string, value_id long"),
        t([(50, 1, 4), (50, 0, 98)], "call_id long, ord int, value_id long"), t([(60, 0, 5)], "func_id long, ord int, value_id long"), t([(50, 60)], "call_id long, func_id long"),
    )
    got = G.taint_routes(e, nodes(spark, 1), nodes(spark, 5, 99, 98)).collect()
    assert [(r["source"], r["sink"], r["path"]) for r in got] == [(1, 5, [1, 2, 3, 4, 5])]


def test_fixpoints_run_until_nothing_is_new(spark):
    """All pairs of sources and sinks, more than 40 levels away, on a cycle; by brute force."""
    pairs = [(i, i + 1) for i in range(45)] + [(45, 0), (3, 60)]
    e, seeds = edges(spark, pairs).coalesce(1), (0, 20)
    depth = {s: {s: 0} for s in seeds}
    for s, seen in depth.items():
        todo = [s]
        for x in todo:
            for y in (b for a, b in pairs if a == x and b not in seen):
                seen[y] = seen[x] + 1
                todo.append(y)
    everything = nodes(spark, *range(61))
    got = {(r["source"], r["sink"]): len(r["path"]) - 1 for r in G.taint_routes(e, nodes(spark, *seeds), everything).collect()}
    assert got == {(s, x): n for s, seen in depth.items() for x, n in seen.items() if x != s} and max(got.values()) == 45
    assert {r["node"]: r["depth"] for r in G.reach(edges(spark, pairs[:12]), nodes(spark, 0)).collect()} == {i: i for i in range(13)}


def test_call_links_take_the_first_function(spark):
    calls = spark.createDataFrame([(1, "send"), (2, "push"), (3, "ab"), (4, "global")], "call_id long, prop string")
    funcs = spark.createDataFrame([(10, "send", 2), (11, "send", 1), (12, "push", 0), (13, "global", 0)], "func_id long, name string, ord int")
    assert [tuple(r) for r in G.call_links(calls, funcs).collect()] == [(1, 11)]


def test_strings_are_put_together(spark):
    const = spark.createDataFrame([(1, "https://"), (2, "a.b/")], "value_id long, text string")
    sums = spark.createDataFrame([(3, 1, 2), (4, 3, 9), (5, 4, 2)], "value_id long, lhs long, rhs long")
    got = {r["value_id"]: r["text"] for r in G.reconstruct_strings(const, sums).collect()}
    assert got[3] == "https://a.b/" and got[4] == "https://a.b/{VAR}" and got[5] == "https://a.b/{VAR}a.b/"


def test_resolved_routes_fall_back(spark):
    r = spark.createDataFrame([("a", "DYNAMIC_URL"), ("b", "DYNAMIC_URL"), ("b", "https://x")], "domain string, destination_url string")
    assert sorted(map(tuple, G.resolved_routes(r).collect())) == [("a", "DYNAMIC_URL"), ("b", "https://x")]


def test_attribution_example(spark):
    """Two files share one key of 8; bar has 8 of its own."""
    u = spark.createDataFrame([("bar", "code", "k1", 8), ("bar", "code", "k2", 8), ("foo", "code", "k2", 8), ("bar", "code", "k1", 8)], "grp string, type string, key string, size int")
    got = {r["grp"]: (r["private"], r["amortised"], r["shared"]) for r in T.attribution(u).collect()}
    assert got == {"bar": (8, 12.0, 16), "foo": (0, 4.0, 8)}


def test_asof_before_the_first_is_null(spark):
    left = spark.createDataFrame([("k", 1, 5), ("k", 2, 1), ("j", 3, 9)], "k string, id long, at long")
    right = spark.createDataFrame([("k", 2, "x"), ("k", 5, "y")], "k string, at long, v string")
    got = {r["id"]: r["v"] for r in T.asof(left, right, "k", "at", "at", "v").collect()}
    assert got == {1: "y", 2: None, 3: None}


def test_moments_of_nothing(spark):
    r = T.moments(spark.createDataFrame([], "value double"), [], "value").first()
    assert (r["n"], r["mean"], r["deviation"], r["total"]) == (0, 0.0, 0.0, 0.0)


def test_ancestors(spark):
    p = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (4, 3), (5, 1)], "node long, parent long")
    got = {r["node"]: r["stack"] for r in T.ancestors(p).collect()}
    assert got == {1: [1], 2: [1, 2], 3: [1, 2, 3], 4: [1, 2, 3, 4], 5: [1, 5]}


def test_run_compression(spark):
    rows = [("g", k, k + 32) for k in (65, 66, 67, 70)] + [("g", 100, 101), ("g", 102, 103), ("g", 104, 105)]
    got = sorted(map(tuple, T.compress_runs(spark.createDataFrame(rows, "g string, key long, value long"), "g", "key", "value").collect()))
    assert got == [("g", 65, 67, 1, 32), ("g", 70, 70, 0, 32), ("g", 100, 104, 2, 1)]


def test_interval_cells(spark):
    s = spark.createDataFrame([("a", 0, 100), ("b", 100, 4097), ("c", 5000, 5000)], "title string, start long, end long")
    assert sorted(map(tuple, T.interval_overlap(s, 4096).collect())) == [(0, "a"), (0, "b"), (1, "b")]


def distances(pairs, seeds, most=None):
    out, front, d = {s: 0 for s in seeds}, set(seeds), 0
    while front and (most is None or d < most):
        d += 1
        front = {b for a, b in pairs if a in front} - set(out)
        out |= dict.fromkeys(front, d)
    return out


def test_reach_over_many_parts(spark):
    """Chains, cycles, and a node with many edges, in parts of a few edges; text nodes."""
    import random

    r = random.Random(3)
    pairs = [(i, i + 1) for i in range(9)] + [(9, 0)] + [(7, 100 + i) for i in range(80)] + [(100 + r.randrange(80), 200 + r.randrange(60)) for _ in range(90)] + [(200 + i, 5) for i in range(9)] + [(900, 901)]
    for most, part_edges in ((None, 1 << 21), (None, 60), (4, 60), (4, 1 << 21)):
        got = {x["node"]: x["depth"] for x in G.reach(edges(spark, pairs), nodes(spark, 0, 205), max_depth=most, part_edges=part_edges).collect()}
        assert got == distances(pairs, [0, 205], most)
    text = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in pairs] + [(None, "n1"), ("n1", None)], "src string, dst string")
    got = {x["node"]: x["depth"] for x in G.reach(text, spark.createDataFrame([("n0",), (None,)], "node string"), part_edges=1 << 21).collect()}
    assert got == {f"n{k}": v for k, v in distances(pairs, [0]).items()}
    assert G.reach(edges(spark, []), nodes(spark, 5)).collect()[0]["node"] == 5 and G.reach(edges(spark, pairs), nodes(spark)).count() == 0


def test_compression_like_a_walk(spark):
    import random

    r = random.Random(8)
    rows = []
    for g in ("a", "b", None):
        k = 0
        for _ in range(300):
            k += r.choice([1, 1, 1, 2, 2, 2, 40, 300])
            rows.append((g, k, k + r.choice([5, 5, 5, 5, 7])))
    rows += [("long", i, i + 1) for i in range(2000)] + [("wide", i * 3, i * 3) for i in range(700)]
    want = []
    for g in {x[0] for x in rows}:
        blocks = []
        for _, k, v in sorted(x for x in rows if x[0] == g):
            b = blocks[-1] if blocks else None
            if b and v - k == b[4] and k - b[1] < 256 and (b[3] == 0 or k - b[2] == b[3]):
                b[3], b[2] = k - b[2], k
            else:
                blocks.append([g, k, k, 0, v - k])
        want += map(tuple, blocks)
    df = spark.createDataFrame(rows + rows[:50], "g string, k long, v long")
    plan = T.compress_runs(df, "g", "k", "v")
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString() and "Pandas" not in plan._jdf.queryExecution().executedPlan().toString()
    for options in ({}, {"key_rows": 0, "tasks": 5}):
        assert sorted(map(tuple, T.compress_runs(df, "g", "k", "v", **options).collect()), key=str) == sorted(want, key=str)
    assert T.compress_runs(df.where("false"), "g", "k", "v").count() == 0
