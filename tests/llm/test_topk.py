import math

import numpy as np
import pytest

from tarnweave.llm.topk import best, top_products

SCHEMA = "vec_id long, embedding array<float>, rank int, score string, `a.b` string, part string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "s", "d", "p") for i, v in rows], SCHEMA)


def brute(rows, k=5, every=50):
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, x) in enumerate(good):
        if q is not None and q % every == 0:
            scored = [(-max(-(1 << 63), min(sum(s * t for s, t in zip(x, y)), (1 << 63) - 1)), i is None, i or 0) for b, (i, y) in enumerate(good) if a != b]
            out += [(q, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect()), key=str)


@pytest.mark.parametrize("part_rows, block", [(16_384, 1024), (300, 7)])
def test_equals_brute_force_with_ties_and_copies(spark, part_rows, block):
    r = np.random.default_rng(2)
    v = r.normal(size=(1500, 12)).astype(np.float32)
    v[::3] = v[0]  # a third of all rows are copies
    v[1::7] = np.round(v[1::7])
    rows = list(enumerate(v))
    assert result(top_products(table(spark, rows).repartition(5), part_rows=part_rows, block=block)) == brute(rows)


def test_odd_vectors(spark):
    v = np.random.default_rng(3).normal(size=(9, 4)).astype(np.float32)
    rows = [(0, v[0]), (50, v[1]), (50, v[1]), (50, v[2]), (None, v[3]), (None, v[1]), (1, None), (2, [None, 1.0]), (3, [math.nan] * 4), (4, [math.inf] + [0.0] * 3), (5, []), (100, []), (6, [0.0] * 4), (7, [2.0]), (8, list(v[4]) + [9.0, -9.0]), (150, list(v[5]) + [0.5]), (-50, v[6])]
    assert result(top_products(table(spark, rows))) == brute(rows)
    assert result(top_products(table(spark, rows), k=100)) == brute(rows, k=100)
    assert top_products(table(spark, [])).count() == 0
    assert top_products(table(spark, [(50, v[0])])).count() == 0


def test_large_components_stay_exact(spark):
    r = np.random.default_rng(4)
    for size in (2.0**22, 2.0**30, 1e38):
        rows = [(i, (size * r.normal(size=5)).astype(np.float32)) for i in range(120)]
        assert result(top_products(table(spark, rows))) == brute(rows)


def test_lists_are_read_only_as_far_as_needed():
    """Few vectors stand out in the dimensions of the query: the others are outsiders early."""
    r = np.random.default_rng(5)
    x = r.integers(-20, 20, size=(8192, 16))
    x[:40, :4] += 4000
    queries, read = x[:8].copy(), []
    queries[:, 4:] = 0
    got = best(x, queries, np.arange(8), 5, read=read)
    assert max(read) < 8192 / 8
    for i, (rows, scores) in enumerate(got):
        exact = x @ queries[i]
        exact[i] = -(1 << 62)
        assert sorted(scores.tolist())[-5:] == sorted(exact.tolist())[-5:] and all(scores == exact[rows])
