import math
import random

import numpy as np

from tarnweave.llm.ann import fit, fit_cells, nearest

SCHEMA = "vec_id long, embedding array<float>, label int, score string, `a.b` string"


def vectors(n, dim=16, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, dim))
    return (centres[r.integers(0, 12, n)] + 0.4 * r.normal(size=(n, dim))).astype(np.float32)


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "s", "d") for i, v in rows], SCHEMA)


def brute(rows, k=10, every=100):
    dim = 16
    good = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in good:
        if q % every == 0:
            out[q] = [(i, d) for d, i in sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in good if i != q)[:k]]
    return out


def recall(rows, found, want):
    return sum(len(found.get(q, set()) & {i for i, _ in want[q]}) for q in want) / sum(len(v) for v in want.values())


def test_recall_on_many_vectors_in_parts_and_blocks(spark):
    """Clusters of all sizes, one of which holds a third of the vectors, and vectors without clusters."""
    v = vectors(40_000, seed=5)
    v[::3] = v[0] + 0.05 * np.random.default_rng(6).normal(size=v[::3].shape)
    v = np.vstack([v, np.random.default_rng(7).normal(size=(10_000, 16)).astype(np.float32)])
    rows = list(enumerate(v))
    x = v.astype(np.float64)
    asked, half = list(range(0, 50_000, 500)), (x * x).sum(axis=1)
    want = {}
    for q in asked:
        d = half - 2 * x @ x[q]
        d[q] = np.inf
        want[q] = [(int(i), 0.0) for i in np.argsort(d, kind="stable")[:10]]
    found = {}
    for r in nearest(table(spark, rows), every=500, part_rows=2000, block=30).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert recall(rows, found, want) >= 0.9


def test_few_cells_are_probed_where_vectors_form_clusters():
    r = np.random.default_rng(1)
    close = fit_cells(np.repeat(10 * r.normal(size=(100, 16)), 60, axis=0) + r.normal(size=(6000, 16)))
    loose = fit_cells(r.normal(size=(6000, 64)))
    assert close.probes < len(close.centres) / 10 and loose.probes > len(loose.centres) / 2


def test_repeated_ids_are_queries_and_candidates_of_their_own(spark):
    v = vectors(3)
    got = sorted(map(tuple, nearest(table(spark, [(100, v[0]), (100, v[1]), (7, v[2])])).select("query_id", "rank", "vec_id").collect()))
    assert [g[:2] for g in got] == [(100, 1), (100, 1), (100, 2), (100, 2)] and sorted(g[2] for g in got) == [7, 7, 100, 100]


def test_recall_and_exact_scores(spark):
    rows = list(enumerate(vectors(3000)))
    want, got = brute(rows), {}
    for r in nearest(table(spark, rows).repartition(3), rerank=40).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    exact = {q: dict(brute(rows, k=3000)[q]) for q in list(want)[:3]}
    assert all(abs(exact[q][i] - d) < 1e-12 for q in exact for i, d in got[q])


def test_odd_vectors_and_ties(spark):
    v = vectors(30)
    rows = [(100, v[0]), (101, v[0]), (102, v[0]), (105, v[0]), (103, None), (104, [0.0] * 16), (106, [float("nan")] * 16), (107, [float("inf")] + [1.0] * 15), (108, [None] + [1.0] * 15), (109, [1.0] * 8), (None, v[1]), (200, [0.0] * 16), (300, v[2])]
    got = {}
    for r in nearest(table(spark, rows)).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert got == {100: [(1, 101), (2, 102), (3, 105), (4, 300)], 300: [(1, 100), (2, 101), (3, 102), (4, 105)]}
    assert nearest(table(spark, [])).count() == 0
    assert nearest(table(spark, [(100, v[0])])).count() == 0


def test_more_queries_than_a_block(spark):
    rows = list(enumerate(vectors(500)))
    one, many = (sorted(map(tuple, nearest(table(spark, rows), every=10, block=b).collect())) for b in (1000, 7))
    assert one == many


def test_parallel_error_weighs_more():
    x = vectors(2000).astype(np.float64)
    plain, aware = fit(x, 1.0), fit(x, 6.0)

    def along(q):
        r = x - q.decode(q.encode(x))
        return ((r * x).sum(axis=1) ** 2 / (x * x).sum(axis=1)).mean()

    assert along(aware) < 0.6 * along(plain)


def test_every_query_finds_k_where_there_are_as_many(spark):
    """Most vectors are the same, so that most cells hold next to nothing."""
    r = np.random.default_rng(3)
    v = np.vstack([np.repeat(r.normal(size=(1, 16)), 300, axis=0), 50 * r.normal(size=(200, 16))]).astype(np.float32)
    got = [tuple(x) for x in nearest(table(spark, list(enumerate(v))), every=5, rerank=10).select("query_id", "rank").collect()]
    assert len(got) == 1000 and len(set(got)) == 1000


def test_the_codes_select_and_the_work_grows_with_the_vectors(spark, monkeypatch):
    """Clusters: few of the vectors are reranked, and four times the vectors give at most eight times the pairs of codes and queries."""
    from tarnweave.llm import ann

    told, seen = [], []
    calibrate = ann._calibrate

    def counted(*args):
        out = calibrate(*args)
        told.append((out, args[0].count(), len(args[2].centres)))
        return out

    monkeypatch.setattr(ann, "_calibrate", counted)
    for n in (4000, 16_000):
        r = np.random.default_rng(2)
        centres = 4 * r.normal(size=(n // 100, 16))
        v = (centres[r.integers(0, len(centres), n)] + r.normal(size=(n, 16))).astype(np.float32)
        found = {}
        for x in nearest(table(spark, list(enumerate(v))), rerank=20, every=200, block=64, part_rows=1000).collect():
            found.setdefault(x["query_id"], set()).add(x["vec_id"])
        x, hits = v.astype(np.float64), 0
        for q in range(0, n, 200):
            d = ((x - x[q]) ** 2).sum(axis=1)
            d[q] = np.inf
            hits += len(found[q] & set(np.argsort(d, kind="stable")[:10].tolist()))
        assert hits >= 0.9 * 10 * len(range(0, n, 200))
        (probes, rerank), rows, cells = told[-1]
        assert rerank < 0.1 * rows and probes < 0.25 * cells
        seen.append(probes / cells * n * n / 200)
    assert seen[1] <= 8 * seen[0]


def test_cells_are_dealt_to_parts():
    from tarnweave.llm.ann import deal_cells

    for sizes in ([0, 0, 5], [0, 50, 0, 0, 3], [10, 10, 10], [25, 1, 9, 0, 10], [0], [100, 100]):
        first, pieces = deal_cells(sizes, 10)
        held = {}
        for n, a, k in zip(sizes, first, pieces):
            assert a >= 0 and k == max(1, -(-n // 10))
            for p in range(a, a + k):
                held.setdefault(p, []).append(n)
        assert all(len(v) == 1 or sum(v) <= 10 or sum(n > 10 for n in v) == 1 and sum(n for n in v if n <= 10) == 0 for v in held.values())


def test_queries_that_are_unlike_most_vectors(spark):
    """Most vectors are small, and nearly equal beside the few large ones, of which the queries are."""
    r = np.random.default_rng(8)
    v = 1e-3 * r.normal(size=(8000, 16))
    large = (r.random(8000) < 0.1) | (np.arange(8000) % 100 == 0)
    v[large] = r.normal(size=(large.sum(), 16))
    v = v.astype(np.float32)
    x, found = v.astype(np.float64), {}
    for q in nearest(table(spark, list(enumerate(v)))).collect():
        found.setdefault(q["query_id"], set()).add(q["vec_id"])
    shares = []
    for q in range(0, 8000, 100):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        shares.append(len(found[q] & set(np.argsort(d, kind="stable")[:10].tolist())) / 10)
    assert np.mean(shares) >= 0.97 and sum(s < 0.8 for s in shares) <= 1
