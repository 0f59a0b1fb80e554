import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tarnweave.llm.toxicity import Landmarks, _codes, drop_toxic, fit, held_out, subsequence_kernel, toxicity_scores, training_rows

from .data import documents, odd_rows, prose

BAD = ["blarghface", "snorkwit", "gutmuffin"]


def labelled(n=240):
    r, rows, labels = random.Random(3), [], []
    for i in range(100, 100 + n):
        words, y = prose(i, r.randrange(20, 60)).split(), int(i % 4 == 0)
        if y:
            words.insert(r.randrange(len(words)), r.choice(BAD) + r.choice(["", "en", "s", "isch"]))
        rows.append((i, " ".join(words) + ".", "a"))
        labels.append((i, 1, y))
    return rows, labels


def brute_kernel(a, b, p=3, decay=0.7):
    import itertools

    def sub(s):
        out = {}
        for c in itertools.combinations(range(len(s)), p):
            k = "".join(s[i] for i in c)
            out[k] = out.get(k, 0) + decay ** (c[-1] - c[0] + 1)
        return out

    x, y = sub(a), sub(b)
    return sum(v * y.get(k, 0) for k, v in x.items())


def test_kernel_is_the_sum_over_subsequences():
    for a, b in (("abcde", "abcde"), ("abxcde", "abcde"), ("banana", "ananas"), ("xyz", "abc"), ("aaaa", "aaa")):
        other = np.where(_codes([b], 8) == 0, np.uint32(1), _codes([b], 8))
        assert abs(float(subsequence_kernel(_codes([a], 9), other)[0]) - brute_kernel(a, b)) < 1e-5


def test_gaps_and_inserted_letters_still_match():
    marks = Landmarks(["snorkwit"])
    near = marks.similarities(["snorkwit", "snorxkwit", "snorkwiten", "snoorkwit", "table", "snow"])[:, 0]
    assert near[0] == 1 and all(near[1:4] > 0.65) and not near[4:].any()
    rows, labels = labelled()
    machine = fit([t for _, t, _ in rows], [y for _, _, y in labels])
    from tarnweave.llm.toxicity import Scorer, words_of

    def score(text):
        s = Scorer(Landmarks(machine.landmarks))
        s.learn(words_of(text))
        return machine.score(s.document(text, words_of(text)))

    for w in ("snorkwit", "snork-wit", "s n o r k w i t", "snorxkwit", "gut.muffin!", "blarghfacelich"):
        assert score(f"the of1 {w} to2") >= 0.5, w
    assert score("the of1 to2 and3") < 0.5 and score("") < 0.5


def test_letters_between_all_letters_still_count():
    """Two letters inserted in a short insult; a letter or digit between all letters."""
    from tarnweave.llm.toxicity import Scorer, words_of

    r, rows = random.Random(3), []
    for i in range(100, 340):
        words, y = prose(i, r.randrange(20, 60)).split(), int(i % 4 == 0)
        if y:
            words.insert(r.randrange(len(words)), r.choice(["blarg", "snork", "gutmuffin"]))
        rows.append((" ".join(words) + ".", y))
    machine = fit(*map(list, zip(*rows)))
    scorer = Scorer(Landmarks(machine.landmarks))

    def score(text):
        scorer.learn(words_of(text))
        return machine.score(scorer.document(text, words_of(text)))

    for w in ("snxxork", "sxnzork", "s1n1o1r1k", "sxnxoxrxk", "b1l1a1r1g", "gxuxtxmxuxfxfxixn"):
        assert score(f"the of1 {w} to2") >= 0.5, w
    assert all(score(prose(i, 200)) < 0.5 for i in range(1000, 1020))


def test_held_out_accuracy_and_odd_rows(spark):
    rows, labels = labelled()
    docs = documents(spark, rows + odd_rows())
    table = spark.createDataFrame(labels + [(1, 1, None), (None, 1, 1), (5000, 1, 1), (100, 0, 0)], "doc_id long, quality int, toxic int")
    got = toxicity_scores(docs, table).collect()
    assert len(got) == len(rows) + len(odd_rows())
    truth = {i: y for i, _, y in labels}
    out = [(r["predicted"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(out) > 20 and sum(a == b for a, b in out) >= 0.95 * len(out)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    kept = drop_toxic(docs, table)
    assert kept.columns == docs.columns and {r["a.b"] for r in kept.collect()} == {"dot"}
    assert kept.count() == sum(r["predicted"] == 0 for r in got)


def test_held_out_labels_are_never_used(spark):
    rows, labels = labelled()
    out = {i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0}
    docs = documents(spark, rows)
    one, two = (toxicity_scores(docs, spark.createDataFrame([(i, q, 1 - y if flip and i in out else y) for i, q, y in labels], "doc_id long, quality int, toxic int")) for flip in (False, True))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_a_text_that_does_not_fit_is_skipped(spark):
    """Wherever it comes in the order; and labels without a document take no places."""
    ids = [i for i in range(100, 130) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, prose(i, 10), "a") for i in ids]
    table = spark.createDataFrame([(i, 1, i % 2) for i in [*ids, *range(10_000, 10_200)]], "doc_id long, quality int, toxic int")
    for long in ids[:6]:
        docs = documents(spark, [(i, "x" * 5000 if i == long else t, s) for i, t, s in rows])
        texts, _ = training_rows(docs, table, "doc_id", "text", "toxic", 15, 4000)
        assert sorted(texts) == sorted(t for i, t, _ in rows if i != long)


def test_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity_scores(documents(spark, odd_rows()), none).collect()} == {0.0}
    assert toxicity_scores(documents(spark, []), none).count() == 0
    assert documents(spark, [(None, "x", "a")]).select(held_out()).first()[0] is False
    assert F is not None


def test_long_texts_are_scored_whole(spark):
    """The insult stands behind a million letters without a break, and behind many sentences."""
    rows = [(i, "you are a snorkwit and a bad one" if i % 2 else f"a fine day number {i} for all of us", "a") for i in range(60)]
    long = [(1001, "z" * 1_000_000 + " you are a snorkwit", "a"), (1002, "a fine day for all. " * 50_000, "a"), (1003, "a fine day for all. " * 50_000 + "you are a snorkwit and a bad one", "a")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity_scores(documents(spark, rows + long), labels).collect()}
    assert (got[1001], got[1002], got[1003]) == (1, 0, 1)


def test_pairs_left_out_cannot_reach_the_floor():
    """The bound is never below the kernel of a word that has each of the landmark's letters once at most."""
    r = random.Random(4)
    marks = Landmarks(["^lose", "^snorkwit", "^gux", "^abab"])
    for z, mark in enumerate(marks.words):
        for _ in range(200):
            kept = r.sample(sorted(set(mark)), r.randrange(3, len(set(mark)) + 1)) if len(set(mark)) >= 3 else sorted(set(mark))
            r.shuffle(kept)
            word = "".join(c + "123"[: r.randrange(3)] for c in kept)
            codes = np.array([[ord(c) for c in word]], dtype=np.uint32)
            kernel = subsequence_kernel(codes, marks.codes[z : z + 1])[0] / marks.norms[z]
            missing = sum(1 << (ord(c) % 63) for c in set(mark) - set(kept))
            assert kernel <= marks.bound(z, missing) + 1e-9


def test_the_landmark_matrix_is_positive_semidefinite():
    marks = Landmarks(["^snorkwit", "^snork", "^lose", "^loser", "^worthless", "^worth"])
    assert np.linalg.eigvalsh(marks.matrix()).min() > -1e-9 and np.allclose(np.diag(marks.matrix()), 1)
