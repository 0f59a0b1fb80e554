import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tarnweave.llm.ranked import Asked, bisected, build_index, fit_tree, forward, ranked, search, terms_of

from .data import documents, odd_rows, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=50):
    """docs: (doc_id, text); items: (item_id, text)."""
    have = [(i, Counter(plain_terms(t))) for i, t in docs]
    total, length = sum(1 for _, c in have if c), sum(sum(c.values()) for _, c in have)
    df = Counter(t for _, c in have for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in have:
            n = sum(c.values())
            m = 100 - 50 + 50 * n * total // max(length, 1)
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(plain_terms(text)) if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def items_table(spark, items):
    return spark.createDataFrame([(i, t, "x", 0) for i, t in items], "item_id long, text string, doc_id string, score int")


def corpus(n, seed=1):
    """Documents on some subjects; a third are copies of one."""
    r = random.Random(seed)
    subjects = [[f"w{s}x{i}" for i in range(60)] for s in range(8)]
    out = []
    for i in range(n):
        words = r.choices(r.choice(subjects), k=r.randrange(1, 60)) + r.choices([f"all{j}" for j in range(40)], k=r.randrange(30))
        out.append((i, " ".join(words) if i % 3 else "W0x1 w0x2, ALL1 all2 all2"))
    r.shuffle(out)
    return out


@pytest.mark.parametrize("options", [{}, {"group_docs": 100, "shard_docs": 8, "first": 1, "then": 3}, {"group_docs": 50, "shard_docs": 4, "sample_docs": 300, "first": 2, "then": 2, "block_terms": 300}])
def test_equals_brute_force(spark, options):
    docs, items = corpus(900), [(i, " ".join(t.split()[:12])) for i, t in corpus(12, 5)] + [(50, "all1 all2 all3"), (51, "nothing here"), (52, "w0x1")]
    got = rows_of(ranked(documents(spark, [(i, t, "s") for i, t in docs]).repartition(4), items_table(spark, items), k=7, **options))
    assert got == brute(docs, items, k=7)


def test_odd_rows(spark):
    docs = [(i, t) for i, t, _ in odd_rows()] + [(11, "a0b A0B ünï ÜNÏ\x00q_r\x7fs [x] 1é2" + " long" * 40_000)]
    items = [(1, prose(2, 80)), (1, "one two"), (1, "one two"), (None, "no id here"), (2, None), (3, ""), (4, " .,! "), (5, "ÜNÏ ünï a0b q s X 1É2 1é2 long"), (6, "absent")]
    got = rows_of(ranked(documents(spark, [(i, t, "s") for i, t in docs]), items_table(spark, items)))
    assert got == brute(docs, items)
    assert rows_of(ranked(documents(spark, []), items_table(spark, items))) == []
    assert rows_of(ranked(documents(spark, [(1, "one", "s")]), items_table(spark, []))) == []
    assert rows_of(ranked(documents(spark, [(1, None, "s"), (2, " ", "s")]), items_table(spark, items))) == []


def test_terms():
    texts = ["Don't stop: it's 3.14, naïve_ÄB c d e \U0001f600f", "", "\t\r\n", "ABC\x7fdef{g}"]
    assert [[w.decode() for w in terms_of(t.encode())] for t in texts] == [plain_terms(t) for t in texts]


def test_bisection_brings_alike_documents_together():
    """Eight subjects in random order: fewer shards hold each term than without the new order."""
    r = np.random.default_rng(3)
    subject = r.integers(0, 8, 512)
    terms = [np.unique(s * 100 + r.integers(0, 30, 12)) for s in subject]
    starts, flat = np.concatenate([[0], np.cumsum([len(t) for t in terms])]), np.concatenate(terms)

    def spread(shards):
        return sum(len(np.unique(np.concatenate([terms[d] for d in docs]))) for docs in shards)

    new = bisected(starts, flat, 32)
    assert sorted(np.concatenate(new).tolist()) == list(range(512)) and max(map(len, new)) <= 32
    assert spread(new) < 0.45 * spread(np.array_split(np.arange(512), len(new)))
    tree = fit_tree([t.tolist() for t in terms], 3)
    part = tree.part(starts, flat)
    assert tree.levels == 3 and np.mean([np.bincount(part[subject == s], minlength=8).max() / (subject == s).sum() for s in range(8)]) > 0.9


def test_shards_that_cannot_qualify_are_not_visited(spark):
    docs = [(i, " ".join(f"s{i // 40}w{(i * 7 + j) % 50}" for j in range(20))) for i in range(800)]
    names = sorted({t for _, d in docs for t in plain_terms(d)})
    fwd = forward(documents(spark, [(i, t, "s") for i, t in docs]), "doc_id", "text", {t.encode(): n for n, t in enumerate(names, 1)})
    index = build_index(fwd, 800, 16_000, shard_docs=16)
    number = {t: n for n, t in enumerate(names)}
    terms = np.array([number[t] for t in sorted(set(plain_terms(docs[5][1])))])
    visits, asked = [], Asked(np.array([0, len(terms)]), terms, np.full(len(terms), 1000), len(names))
    found = search(index, asked, 5, first=2, then=2, visits=visits).collect()
    assert index.count() >= 50 and len(visits) == 1 and found[0]["doc_id"] is not None and len(found) == 5
