import itertools
import random

from tarnweave.llm.packing import optimal_boundaries, pack

from .data import documents, odd_rows


def cost(histogram, ends):
    return sum(n * (min(e for e in ends if e >= x) - x) for x, n in histogram.items())


def test_boundaries_are_optimal():
    r = random.Random(3)
    for _ in range(40):
        histogram = {x: r.randrange(1, 30) for x in r.sample(range(1, 40), r.randrange(1, 9))}
        for k in (1, 2, 3, 20):
            ends = optimal_boundaries(histogram, k)
            top = max(histogram)
            best = min(cost(histogram, (*c, top)) for m in range(0, min(k, len(histogram))) for c in itertools.combinations(sorted(histogram), m))
            assert len(ends) <= k and ends[-1] == top and cost(histogram, ends) == best
    assert optimal_boundaries({}, 4) == []


def test_round_trip_and_budget(spark):
    docs = documents(spark, odd_rows())
    rows = pack(docs, max_length=50, buckets=4, token_budget=120, group_words=400, with_text=True).collect()
    back = {}
    for r in sorted(rows, key=lambda r: (str(r["doc_id"]), r["first_word"])):
        assert r["length"] == len(r["text"].split()) <= r["bucket"] and r["padding"] == r["bucket"] - r["length"]
        back.setdefault(r["doc_id"], []).append(r["text"])
    for i, t, _ in odd_rows():
        if i in (1, 2, 3, 7, 8, 10):
            assert " ".join(back[i]) == " ".join(t.split())
    assert sum(r["length"] for r in rows) == sum(len((t or "").split()) for _, t, _ in odd_rows())
    batches = {}
    for r in rows:
        batches.setdefault((r["bucket"], r["batch"]), []).append(r["slot"])
    for (bucket, _), slots in batches.items():
        assert sorted(slots) == list(range(len(slots))) and (bucket * len(slots) <= 120 or len(slots) == 1)


def test_empty(spark):
    assert pack(documents(spark, [(1, None, "a"), (2, " ", "b")])).count() == 0
    assert pack(documents(spark, [])).count() == 0


def test_equal_rows_are_dealt_to_all_groups(spark):
    docs = documents(spark, [(1, "five words are in here", "a")] * 300 + [(i, "other", "a") for i in range(2, 20)])
    rows = [r for r in pack(docs, group_words=150, token_budget=50, with_text=True).collect() if r["doc_id"] == 1]
    groups = {r["batch"].rsplit("-", 1)[0] for r in rows}
    assert len(rows) == 300 and len(groups) >= 8 and len({(r["batch"], r["slot"]) for r in rows}) == 300
    assert {r["text"] for r in rows} == {"five words are in here"}


def test_reruns_agree(spark):
    docs = documents(spark, odd_rows() * 2)
    one, two = (sorted(map(tuple, pack(docs.repartition(n), group_words=400, token_budget=120, max_length=50).collect()), key=repr) for n in (2, 5))
    assert one == two
