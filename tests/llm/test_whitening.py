import math

import numpy as np
import pytest

from tarnweave.llm.whitening import whiten

SCHEMA = "vec_id long, embedding array<float>, n int, x string, component string, `a.b` string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "s", "c", "d") for i, v in rows], SCHEMA)


def brute(rows, most=16):
    """Plain numpy on Python integers."""
    good = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dim = max((len(x) for _, x in good), default=0)
    good = [(i, tuple(x + [1_000_000] * (dim - len(x)))) for i, x in good]
    once = sorted({x for _, x in good})
    n, sums = len(once), [sum(c) for c in zip(*once)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in once])
    v = centred.T @ centred / n
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1][:most], axes[:, ::-1][:, :most]
    keep = e > 1e-10 * e[0]
    e, axes = e[keep], axes[:, keep]
    out = {}
    for r, (i, x) in enumerate(good):
        z = np.array([(n * c - s) / n for c, s in zip(x, sums)]) @ axes / np.sqrt(e)
        out.setdefault((i, sum((n * c - s) ** 2 for c, s in zip(x, sums))), []).append(z)
    return n, out, e / np.trace(v)


def compare(got, rows):
    n, want, explained = brute(rows)
    assert len(got) == sum(len(z) for z in want.values()) * len(explained)
    found = {}
    want = {(i, d if d < 1 << 63 else None): z for (i, d), z in want.items()}
    for r in got:
        assert r["n"] == n and abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9 and 0 <= r["identity_error"] < 1e-9
        found.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r["whitened"])
    assert set(found) == set(want)
    keys, k = list(want), len(explained)
    a = np.array([[v for c in range(1, k + 1) for v in [found[q][c][0]]] for q in keys])
    b = np.array([want[q][0] for q in keys])
    sign = np.sign((a * b).sum(axis=0))  # the same for all rows
    assert np.abs(a * sign - b).max() < 1e-7
    assert len({r["identity_error"] for r in got}) == 1


def test_equals_numpy_where_copies_weigh_once(spark):
    r = np.random.default_rng(1)
    v = (r.normal(size=(900, 20)) * np.linspace(0.3, 4, 20) + r.normal(size=20) * 50).astype(np.float32)
    v[::3] = v[0]
    rows = list(enumerate(v))
    compare(whiten(table(spark, rows).repartition(5)).collect(), rows)


def test_odd_vectors(spark):
    r = np.random.default_rng(2)
    v = r.normal(size=(40, 3)).astype(np.float32)
    rows = [(None, v[0]), (7, v[1]), (7, v[1]), (7, v[2]), (8, None), (9, [None, 1.0, 2.0]), (10, [math.nan] * 3), (11, [math.inf, 0.0, 0.0]), (12, []), (13, [0.0, -0.0, 0.0]), (14, [3.0])]
    rows += [(100 + i, x) for i, x in enumerate(v)]
    compare(whiten(table(spark, rows)).collect(), rows)
    assert whiten(table(spark, [])).count() == 0
    assert whiten(table(spark, [(1, v[0]), (2, v[0]), (3, None)])).count() == 0  # no variance
    assert whiten(table(spark, [(1, []), (2, [])])).count() == 0


def test_fewer_components_where_dimensions_depend_on_each_other(spark):
    r = np.random.default_rng(3)
    base = r.integers(-500, 500, size=(300, 2)) / 64
    rows = [(i, [a, b, a + b, 2 * a]) for i, (a, b) in enumerate(base)]
    got = whiten(table(spark, rows)).collect()
    assert {x["component"] for x in got} == {1, 2} and got[0]["identity_error"] < 1e-9


@pytest.mark.parametrize("size", [1e4, 1e6])
def test_large_entries(spark, size):
    r = np.random.default_rng(4)
    rows = [(i, (size * r.normal(size=4)).astype(np.float32)) for i in range(50)]
    compare(whiten(table(spark, rows)).collect(), rows)
