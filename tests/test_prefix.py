"""Scans along a key that spans several tasks, and cells of several sizes."""

import random

import pytest
from pyspark.sql import functions as F

from tarnweave.operators import trace as T
from tarnweave.operators.prefix import Ordered

WAYS = [{}, {"key_rows": 0, "tasks": 8}]


def table(spark, n=400, seed=1):
    """One key holds most rows; nulls among keys, order and values."""
    r = random.Random(seed)
    rows = [(r.choice([None, 1, 2, 3, 3, 3, 3, 3, 3]), None if i == 5 else i, r.choice([None, r.randrange(9)])) for i in range(n)]
    r.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k long, at long, v long").repartition(5)


def walk(rows, step):
    """For each row in order, step(rows of the key before it, the row, rows behind it)."""
    out = {}
    for key in {k for k, _, _ in rows}:
        own = sorted((x for x in rows if x[0] == key), key=lambda x: (x[1] is not None, x[1] or 0))
        for i, x in enumerate(own):
            out[x[:2]] = step([y[2] for y in own[:i]], x[2], [y[2] for y in own[i + 1 :]])
    return out


def some(values):
    return [v for v in values if v is not None]


@pytest.mark.parametrize("options", WAYS)
def test_scans(spark, options):
    rows, df = table(spark)
    o = Ordered(df, ["k"], ["at"], **options)
    if options:
        assert o._rows.where("k = 3").select("__task").distinct().count() >= 4
    v = F.col("v")
    out = o.sum("s", v).sum("b", v, before=True).max("m", v).max("mb", v, before=True).last("l", v).last("lb", v, before=True).previous("p", v).next("n", v).number("i").rows
    assert out.columns == ["k", "at", "v", "s", "b", "m", "mb", "l", "lb", "p", "n", "i"]
    got = {(r["k"], r["at"]): (r["s"], r["b"], r["m"], r["mb"], r["l"], r["lb"], r["p"] and (r["p"]["v"],), r["n"] and (r["n"]["v"],), r["i"]) for r in out.collect()}
    last = lambda x: x[-1] if x else None

    def step(before, own, behind):
        upto = some(before + [own])
        return (sum(upto) if upto else None, sum(some(before)), max(upto, default=None), max(some(before), default=None), last(upto), last(some(before)), (before[-1],) if before else None, (behind[0],) if behind else None, len(before) + 1)

    assert got == walk(rows, step)


@pytest.mark.parametrize("options", WAYS)
def test_without_a_key(spark, options):
    df = spark.range(100).repartition(3)
    got = {r["id"]: r["s"] for r in Ordered(df, [], ["id"], **options).sum("s", F.col("id")).rows.collect()}
    assert got == {i: i * (i + 1) // 2 for i in range(100)}
    assert Ordered(df.where("false"), [], ["id"], **options).sum("s", F.col("id")).rows.count() == 0


def test_operators_do_not_depend_on_the_number_of_tasks(spark):
    r = random.Random(4)
    rows = [(3 if r.random() < 0.8 else r.randrange(3), i, r.choice("aab"), i * 5 + r.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, at long, label string, start long").withColumns({"end": F.col("start") + F.col("at") % 11, "ts": F.timestamp_micros(F.col("start") * 1000), "name": F.concat("label", F.when(F.col("at") % 3 == 0, ", First>").otherwise(", Last>"))})
    other = df.where("label = 'b'").select("k", F.col("at").alias("place"), F.col("start").alias("found"))
    runs = [
        lambda o: T.asof(df.select("k", "at"), other, "k", "at", "place", "found", **o), lambda o: T.gap_fill(df.select("k", "start", "end", F.col("label").alias("title")), "k", **o),
        lambda o: T.islands(df, "k", ["at"], "label", "start", **o), lambda o: T.value_islands(df.where("at % 4 <> 0"), "k", "at", **o), lambda o: T.merge_ranges(df, "k", **o),
        lambda o: T.time_delta(df, "k", "ts", ["at"], **o), lambda o: T.predicate_islands(df, "k", "at", F.col("label") == "a", **o), lambda o: T.paired_ranges(df, "k", "at", "name", **o), lambda o: T.pages_touched(df, "k", 16, **o),
    ]
    for run in runs:
        one, many = (sorted(map(str, run(o).collect())) for o in WAYS)
        assert one == many and one


def test_cells_cover_an_interval_exactly(spark):
    r = random.Random(5)
    spans = [(0, 1), (7, 7), (9, 3), (-5, 12), (1023, 1025), (0, 1 << 30)] + [(a, a + r.randrange(300)) for a in (r.randrange(-500, 500) for _ in range(40))]
    got = {}
    for x in T.cells(spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(spans)], "id long, start long, end long")).collect():
        got.setdefault(x["id"], []).append((x["no"] << x["level"], (x["no"] + 1) << x["level"]))
    for i, (a, b) in enumerate(spans):
        own = sorted(got.get(i, []))
        assert [lo for lo, _ in own[:1]] == ([a] if a < b else []) and all(x[1] == y[0] for x, y in zip(own, own[1:])) and (not own or own[-1][1] == b)


def test_a_long_interval_has_few_cells(spark):
    one = spark.createDataFrame([("x", 12_345, 1_000_012_345)], "name string, start long, end long")
    assert T.cells(one).count() < 64
    points = spark.createDataFrame([(1, 12_344), (2, 12_345), (3, 500_000_000), (4, 1_000_012_344), (5, 1_000_012_345)], "id long, x long")
    assert {r["id"]: r["name"] for r in T.point_in_interval(points, one, 128).collect()} == {1: None, 2: "x", 3: "x", 4: "x", 5: None}


def test_overlaps_of_given_pages(spark):
    r = random.Random(6)
    spans = [(str(i), a, a + r.randrange(2000)) for i, a in enumerate(r.randrange(5000) for _ in range(60))]
    sections = spark.createDataFrame(spans, "title string, start long, end long")
    pages = spark.createDataFrame([(p,) for p in range(0, 120, 3)], "page long")
    got = sorted(map(tuple, T.interval_overlap(sections, 64, pages).select("page", "title").collect()))
    assert got == sorted((p, t) for p in range(0, 120, 3) for t, a, b in spans if a < b and a < (p + 1) * 64 and b > p * 64)
