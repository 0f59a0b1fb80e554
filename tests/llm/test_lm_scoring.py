import math
from collections import Counter

import pytest

from tarnweave.llm import common, lm_scoring
from tarnweave.llm.lm_scoring import cross_entropy_difference

from .data import documents, odd_rows, prose


def brute(rows, good, mix=0.6, add=0.5, least=2):
    texts = [((t or "").lower().split(), i in good) for i, t, _ in rows]
    words, pairs = [Counter(), Counter()], [Counter(), Counter()]
    for w, g in texts:
        for m in (0, 1) if g else (0,):
            words[m].update(w)
            pairs[m].update(zip(w, w[1:]))
    vocabulary = {w for w, n in words[0].items() if n >= least}
    out = []
    for (i, _, _), (w, g) in zip(rows, texts):
        own, own2, loss = Counter(w), Counter(zip(w, w[1:])), []
        for m in (1, 0):
            inside = g if m else True
            total = sum(words[m].values())
            rare = total - sum(n for x, n in words[m].items() if x in vocabulary) - inside * sum(x not in vocabulary for x in w)
            s = 0.0
            for k, x in enumerate(w):
                p = ((words[m][x] - inside * own[x] if x in vocabulary else rare) + add) / (total - inside * len(w) + add * (len(vocabulary) + 1))
                if k:
                    c = words[m][w[k - 1]] - inside * own[w[k - 1]]
                    if w[k - 1] in vocabulary and c > 0:
                        both = pairs[m][w[k - 1], x] - inside * own2[w[k - 1], x] if x in vocabulary else 0
                        p = mix * min(1.0, both / c) + (1 - mix) * p
                s -= math.log(p)
            loss.append(s / max(1, len(w)))
        out.append((i, len(w), *loss, loss[0] - loss[1]))
    return out


def same(a, b):
    a, b = (sorted([(x[0], x[1], *[round(v, 9) for v in x[2:]]) for x in rows], key=repr) for rows in (a, b))
    return a == b


@pytest.mark.parametrize("fan", [8, 1])
def test_like_brute_force(spark, monkeypatch, fan):
    """Also by way of many steps of two receivers each."""
    monkeypatch.setattr(lm_scoring, "PART_CHARS", 900)
    monkeypatch.setattr(lm_scoring, "CHUNK_CHARS", 700)
    monkeypatch.setattr(lm_scoring, "FAN_BITS", fan)
    rows = odd_rows() + [(i, prose(i, 40), "a") for i in range(20, 60)]
    good = {1, 3, 9, 20, 21, 22, 23, 59, 999}
    targets = spark.createDataFrame([(g,) for g in good] + [(None,), (20,)], "doc_id long")
    got = [tuple(r) for r in cross_entropy_difference(documents(spark, rows), targets).collect()]
    assert same(got, brute(rows, good))


def test_no_target_and_empty(spark):
    none = spark.createDataFrame([], "doc_id long")
    rows = odd_rows()
    assert same([tuple(r) for r in cross_entropy_difference(documents(spark, rows), none).collect()], brute(rows, set()))
    assert cross_entropy_difference(documents(spark, []), none).count() == 0


def test_rows_grow_with_the_corpus(spark, monkeypatch):
    """Four times the documents, with other words: four times the rows, and one step more at most."""
    monkeypatch.setattr(lm_scoring, "PART_CHARS", 200)
    monkeypatch.setattr(lm_scoring, "CHUNK_CHARS", 400)
    monkeypatch.setattr(lm_scoring, "FAN_BITS", 2)
    counts, steps = [], []
    for n in (100, 400):
        written = []
        monkeypatch.setattr(lm_scoring, "store", lambda df, name: written.append((name, common.store(df, name))) or written[-1][1])
        rows = [(i, " ".join(f"w{i}x{k}" for k in range(30)), "a") for i in range(n)]
        cross_entropy_difference(documents(spark, rows).coalesce(1), spark.createDataFrame([(1,)], "doc_id long")).count()
        counts.append(sum(df.count() for name, df in written if name != "chunks"))
        steps.append(sum(name.startswith("asked") for name, _ in written))
    assert steps[0] < steps[1] <= steps[0] + 2 and counts[1] <= 4 * counts[0] * (steps[1] + 1) / (steps[0] + 1) * 1.3


def test_inputs_behind_a_shuffle(spark):
    rows = odd_rows() + [(i, prose(i, 40), "a") for i in range(20, 60)]
    docs = documents(spark, rows).repartition(7)
    assert same([tuple(r) for r in cross_entropy_difference(docs, spark.createDataFrame([(1,)], "doc_id long")).collect()], brute(rows, {1}))


def test_keys_round_trip():
    import numpy as np

    for keys in ([], [5], [1, 2, 3], [0, 1 << 63, (1 << 64) - 1], list(range(0, 1 << 45, 1 << 40))):
        keys = np.array(keys, dtype=np.uint64)
        first, raw = lm_scoring._unpack(lm_scoring._pack(*lm_scoring._pack_keys(keys)))
        assert (lm_scoring._unpack_keys(first, raw, len(keys)) == keys).all()


def test_scores_tell_like_from_unlike(spark):
    like = [(i, prose(i, 60), "a") for i in range(40)]
    other = [(i, " ".join("xyz"[j % 3] * (j % 5 + 1) for j in range(i, i + 60)), "b") for i in range(40, 60)]
    targets = spark.createDataFrame([(i,) for i in range(20)], "doc_id long")
    got = {r["doc_id"]: r["score"] for r in cross_entropy_difference(documents(spark, like + other), targets).collect()}
    assert max(got[i] for i in range(20, 40)) < min(got[i] for i in range(40, 60))


def test_long_texts(spark):
    rows = [(1, prose(3, 300_000), "a"), (2, prose(4, 50), "a"), (3, prose(4, 50), "a")]
    got = [tuple(r) for r in cross_entropy_difference(documents(spark, rows), spark.createDataFrame([(2,)], "doc_id long")).collect()]
    assert same(got, brute(rows, {2}))
