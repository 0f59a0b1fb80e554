import hashlib
import random
import re

import numpy as np
import pytest

from tarnweave.llm.simhash import _links, drop_near_copies, fingerprint, fingerprint_links, near_groups, several, signatures

from .data import documents, odd_rows, prose


def roots(fps):
    left, comp = set(fps), {}
    while left:
        todo = [left.pop()]
        group = set(todo)
        while todo:
            x = todo.pop()
            near = {y for y in left if bin(x ^ y).count("1") <= 4}
            left -= near
            group |= near
            todo += near
        for x in group:
            comp[x] = min(group)
    return comp


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def cluster(seed, n):
    r, out = random.Random(seed), set()
    centres = [r.getrandbits(64) for _ in range(4)]
    while len(out) < n:
        x = r.choice(centres)
        for b in r.sample(range(64), r.randrange(0, 5)):
            x ^= 1 << b
        out.add(x)
    return sorted(out | {r.getrandbits(64) for _ in range(30)})


def union(pairs, nodes):
    nodes = list(nodes)
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("bucket_rows", [8192, 5])
def test_links_are_whole(spark, bucket_rows):
    """With small buckets, crowded ones are linked by the second way."""
    fps = cluster(7, 160)
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    pairs = [tuple(r) for r in fingerprint_links(df, bucket_rows=bucket_rows).collect()]
    got, want = union(pairs, map(signed, fps)), roots(fps)
    groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert groups(got) == groups({signed(k): signed(v) for k, v in want.items()})


@pytest.mark.parametrize("n", [1000, 10**9, 10**11])
def test_signatures_meet_for_every_near_pair(n):
    masks, r = signatures(n), random.Random(n)
    for _ in range(300):
        x = r.getrandbits(64)
        y = x
        for b in r.sample(range(64), r.randrange(1, 5)):
            y ^= 1 << b
        assert any(x & m == y & m for m in masks)


def test_spanning_forest():
    fps = np.array(cluster(3, 90), dtype=np.uint64)
    assert len(set(union(_links(fps), map(int, fps)).values())) == len(set(roots(list(map(int, fps))).values()))


def test_groups_of_odd_rows(spark):
    docs = documents(spark, odd_rows())
    got = near_groups(docs).collect()
    assert len(got) == len(odd_rows())
    by = {}
    for (i, t, _), f in ((row, fingerprint(row[1])) for row in odd_rows()):
        by.setdefault(f, []).append(i)
    comp = roots(list(by))
    for r in got:
        f = int(r["fingerprint"], 16)
        ids = [i for g, v in by.items() if comp[g] == comp[f] for i in v if i is not None]
        assert r["component_id"] == (min(ids) if ids else None)
    assert fingerprint(None) == fingerprint(" ") == 0
    out = drop_near_copies(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in drop_near_copies(docs, shingle=4, copies=1).collect() if r["doc_id"] is not None} == {r["component_id"] for r in got if r["component_id"] is not None}
    assert near_groups(documents(spark, [])).count() == 0


def joined(texts, shingle, copies):
    """A number for each text: those that any fingerprint links have the same."""
    fps = {t: [int(x) for x in several(t, shingle, copies)] for t in texts}
    pairs = [(a, b) for a in texts for b in texts if any(bin(x ^ y).count("1") <= 4 for x, y in zip(fps[a], fps[b]))]
    order = {t: i for i, t in enumerate(texts)}
    return union([(order[a], order[b]) for a, b in pairs], range(len(texts))), order


@pytest.mark.parametrize("copies", [1, 4])
def test_exactly_one_row_of_each_group_stays(spark, copies):
    """Also where ids are null or repeated: (a) lone null ids, (b) an id in two groups, (c) copies that share an id."""
    rows = odd_rows() + [(2, prose(40, 80), "a"), (30, prose(41, 80), "a"), (30, prose(41, 80).upper(), "b"), (None, prose(42, 80), "a"), (None, prose(42, 80).upper(), "b")]
    r = random.Random(12)
    for i in range(40, 60):  # chains of texts that differ by a few words
        words = prose(60 + i // 5, 120).split()
        for _ in range(i % 5):
            words[r.randrange(120)] = "other"
        rows.append((i, " ".join(words), "a"))
    texts = sorted({t or "" for _, t, _ in rows})
    comp, number = joined(texts, 5, copies)
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(comp[number[t or ""]], []).append((i is None, i or 0, "null" if t is None else hashlib.sha256(t.encode()).hexdigest(), i, t))
    want = [min(v)[3:] for v in groups.values()]
    got = [(r["doc_id"], r["text"]) for r in drop_near_copies(documents(spark, rows), copies=copies).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert (None, "no id here") in got and (2, prose(40, 80)) in got and sum(i == 30 for i, _ in got) == 1


def test_near_copies_are_caught_and_others_left_alone(spark):
    """Five-word similarity: 0.95 and more, about 0.88, and 0.5."""
    def changed(seed, n, k):
        words = prose(seed, n).split()
        for j in random.Random(seed).sample(range(5, n - 5), k):
            words[j] = f"zz{j}"
        return " ".join(words)

    rows = []
    for i in range(60):
        rows += [(10 * i, prose(1000 + i, 400), "a"), (10 * i + 1, changed(1000 + i, 400, 2), "a"), (10 * i + 2, prose(2000 + i, 400), "a"), (10 * i + 3, changed(2000 + i, 400, 5), "a"), (10 * i + 4, prose(3000 + i, 400), "a"), (10 * i + 5, changed(3000 + i, 400, 27), "a")]
    left = {r["doc_id"] for r in drop_near_copies(documents(spark, rows)).collect()}
    gone = [sum(1 for i in range(60) if 10 * i + k not in left) for k in range(6)]
    assert gone[0] == gone[2] == gone[4] == 0 and gone[1] >= 48 and gone[3] >= 18 and gone[5] <= 1


def test_a_string_id_null_is_not_a_null_id(spark):
    schema = "doc_id string, text string, lang string"
    rows = [("null", prose(50, 80), "x"), (None, prose(50, 80), "x"), (None, prose(51, 80), "x"), ("7", prose(52, 80), "x")]
    got = sorted(map(tuple, drop_near_copies(spark.createDataFrame(rows, schema)).collect()), key=repr)
    assert got == sorted([rows[0], rows[2], rows[3]], key=repr)


def test_fingerprints_like_the_sessions_own_hash(spark):
    """XXH64 with seed 42 of each shingle, by the session's function; more than half of the hashes have the bit."""
    from pyspark.sql import functions as F

    texts = [t for _, t, _ in odd_rows() if t] + ["ÄB Çd\tE\x0bF  g h", "a b c d", "a b c d e", "İ ſ K a"]
    for t in texts:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t)) if w]
        shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
        df = spark.createDataFrame([(s,) for s in shingles], "s string").select(F.xxhash64("s").alias("h"))
        hashes = [r["h"] % (1 << 64) for r in df.collect()]
        assert fingerprint(t) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_long_signatures_give_the_same_groups(spark, monkeypatch):
    """As with 10 ** 10 fingerprints."""
    import tarnweave.llm.simhash as module

    fps = cluster(11, 150)
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    monkeypatch.setattr(module, "signatures", lambda n: signatures(10**10))
    got, want = union([tuple(r) for r in module.fingerprint_links(df).collect()], map(signed, fps)), roots(fps)
    groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert groups(got) == groups({signed(k): signed(v) for k, v in want.items()})


def test_long_texts(spark):
    text = prose(9, 400_000)
    got = near_groups(documents(spark, [(1, text, "a"), (2, text + " one more word", "a"), (3, prose(8, 50), "a")])).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 1, 3: 3}


def test_the_row_that_stays_does_not_depend_on_the_layout(spark):
    """Rows equal in id and text, unlike in other columns."""
    rows = [(1, prose(2, 80), s) for s in "abcdefgh"] + [(2, prose(3, 50), None), (2, prose(3, 50), "z"), (None, prose(4, 30), "x"), (None, prose(4, 30), "y")]
    docs = documents(spark, rows)
    kept = [sorted(map(tuple, drop_near_copies(d).select("doc_id", "source").collect()), key=str) for d in (docs, docs.repartition(7), docs.orderBy("source").coalesce(1), docs.orderBy(docs["source"].desc()))]
    assert kept[0] == kept[1] == kept[2] == kept[3] and len(kept[0]) == 3
