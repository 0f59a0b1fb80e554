import random

from tarnweave.llm.mixing import _coin, flight, landing, mix, mixed_documents, source_targets

from .data import documents, odd_rows, prose


def targets(sizes, share=1.5, cap=2.0):
    """Excess shared again and again, as stated."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        got = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if got[s] > cap * sizes[s] + 1e-9]
        if not over:
            return fixed | got
        fixed |= {s: cap * sizes[s] for s in over}


def rows():
    r = random.Random(4)
    return [(i, prose(i, r.randrange(1, 60)), r.choice(["a", "b", "b", "b", "c", "d", None])) for i in range(400)]


def test_targets_and_totals(spark):
    got = mix(documents(spark, rows()), block_rows=40).collect()
    size = {}
    for _, t, s in rows():
        size[s] = size.get(s, 0) + len(t.split())
    want = targets(size)
    assert len(got) == 400
    for s in size:
        mine = [g for g in got if g["source"] == s]
        assert abs(mine[0]["target"] - want[s]) < 1e-6 and mine[0]["source_size"] == size[s]
        assert abs(sum(g["taken"] for g in mine) - want[s]) <= 60
        assert abs(sum(g["copies"] for g in mine) - len(mine) * want[s] / size[s]) <= 2
    assert all(g["taken"] <= 2 * g["size"] and g["taken"] == g["copies"] * g["size"] for g in got)


def test_many_sources_fill_to_a_level(spark):
    r = random.Random(9)
    sizes = {f"s{i:03d}": r.randrange(1, 10 ** r.randrange(1, 6)) for i in range(150)}
    got = source_targets(spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, size long, n long")).collect()
    want = targets(sizes)
    assert [g["source"] for g in sorted(got, key=lambda g: g["src_no"])] == sorted(sizes)
    assert all(abs(g["target"] - want[g["source"]]) < 1e-6 * want[g["source"]] for g in got)


def test_reruns_agree(spark):
    one, two = (sorted(map(tuple, mix(documents(spark, rows()).repartition(n), block_rows=40).collect()), key=repr) for n in (3, 5))
    assert one == two


def test_a_source_does_not_depend_on_the_others_sizes(spark):
    """Capped at twice its size either way, and at one and a half with a cap of that."""
    mine = [(i, prose(i, 1 + i % 50), "m") for i in range(60)]
    few = [(100 + i, prose(i, 30), "z") for i in range(60)]
    many = [(100 + i, prose(i, 30), "z") for i in range(600)]
    one, two = ({g["doc_id"]: g["copies"] for g in mix(documents(spark, mine + more), block_rows=64, max_repeats=1.5).collect() if g["source"] == "m"} for more in (few, many))
    assert one == two and len(set(one.values())) == 2


def test_flight_keeps_both_totals():
    r = random.Random(1)
    for sizes in ([r.randrange(1, 500) for _ in range(300)], [7] * 300, [1] * 150 + [9000] + [2] * 149, [3, 3, 8], [5] * 2 + [6]):
        probs = [0.37] * len(sizes)
        p = flight(sizes, probs, r.random)
        assert sum(0 < x < 1 for x in p) <= 2
        assert abs(sum(p) - sum(probs)) < 1e-6 and abs(sum(a * b for a, b in zip(sizes, p)) - 0.37 * sum(sizes)) < 1e-4
        assert all(x in (0.0, 1.0) for x in landing(p, r.random))
    sizes = [r.randrange(1, 500) for _ in range(300)]
    p = flight(sizes, [0.37] * 300, r.random, 64)
    assert 60 <= sum(0 < x < 1 for x in p) <= 64


def test_what_is_left_to_the_landing_is_short():
    r = random.Random(8)
    sizes = [max(1, int(r.lognormvariate(5.5, 1.2))) for _ in range(500)] + [20_000]
    for seed in range(20):
        p = flight(sizes, [0.41] * 501, _coin(seed))
        assert max([s for s, x in zip(sizes, p) if 0 < x < 1], default=0) < 40


def test_inclusion_is_by_probability():
    """Of all documents, those that the landing rounds included."""
    r = random.Random(2)
    sizes, probs, n = [r.randrange(1, 400) for _ in range(24)], [0.1 + 0.035 * i for i in range(24)], [0] * 24
    for seed in range(2000):
        coin = _coin(seed)
        for i, x in enumerate(landing(flight(sizes, probs, coin), coin)):
            n[i] += x
    # four standard errors
    assert all(abs(x / 2000 - p) < 4 * (p * (1 - p) / 2000) ** 0.5 for x, p in zip(n, probs))


def test_landing_keeps_each_probability():
    for p, q in ((0.3, 0.4), (0.7, 0.8), (0.5, 0.5)):
        coin, n = _coin(5), [0, 0, 0]
        for _ in range(4000):
            a, b = landing([p, q], coin)
            n = [n[0] + a, n[1] + b, n[2] + a * b]
        assert abs(n[0] / 4000 - p) < 0.03 and abs(n[1] / 4000 - q) < 0.03 and abs(n[2] / 4000 - max(0, p + q - 1)) < 0.03


def test_equal_rows_are_dealt_to_all_blocks(spark, monkeypatch):
    import tarnweave.llm.common as module

    monkeypatch.setattr(module, "SPREAD", 50)
    docs = documents(spark, [(None, "three same words", "a")] * 400 + [(i, "x y", "b") for i in range(20)])
    got = mix(docs, block_rows=32, max_repeats=1.5).where("source = 'a'")
    assert got.count() == 400 and abs(got.agg({"copies": "sum"}).first()[0] - 600) <= 2
    assert mixed_documents(docs, block_rows=32, max_repeats=1.5).where("source = 'a'").count() in range(598, 603)


def test_odd_rows(spark):
    docs = documents(spark, odd_rows())
    got = mix(docs).collect()
    assert len(got) == len(odd_rows()) and all(g["taken"] == 0 for g in got if g["size"] == 0)
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    assert sum(len((r["text"] or "").split()) for r in out.collect()) == sum(g["taken"] for g in got)
    assert mix(documents(spark, [])).count() == 0 and mixed_documents(documents(spark, [])).count() == 0
