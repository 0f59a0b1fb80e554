import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tarnweave.llm.exact_dedup import DigestIndex, drop_exact_copies, exact_groups, sha256_digest

from .data import documents, odd_rows


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[norm(t)].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, left = (min(known) if known else None), True
        for i in ids:
            kept = left and i == keep
            left = left and not kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_like_brute_force(spark):
    rows = odd_rows()
    got = exact_groups(documents(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_digest_collisions_are_told_apart_by_bytes(spark):
    rows = odd_rows()
    short = lambda t: F.substring(sha256_digest(t), 1, 0)  # noqa: E731  all texts collide
    got = exact_groups(documents(spark, rows), digest=short).collect()
    assert sorted([tuple(r)[:4] for r in got], key=repr) == sorted([x[:4] for x in brute(rows)], key=repr)


def test_drop_keeps_one_row_of_each_text_and_all_columns(spark):
    docs = documents(spark, odd_rows())
    out = drop_exact_copies(docs)
    assert out.columns == docs.columns
    kept = out.collect()
    assert len(kept) == len({re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in docs.collect()})
    assert {r["a.b"] for r in kept} == {"dot"}


def test_empty_table(spark):
    assert exact_groups(documents(spark, [])).count() == 0
    assert drop_exact_copies(documents(spark, [])).count() == 0


def test_no_python_in_the_plan(spark):
    plan = exact_groups(documents(spark, odd_rows()).where("true"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_small_memtables_merge_level_by_level(spark):
    rows = [(i, f"text {i % 37}", "a") for i in range(300)]
    index = DigestIndex(spark, memtable_rows=4, fanout=3)
    index.flush(documents(spark, rows[:150]))
    index.flush(documents(spark, rows[150:]))
    runs = index.log().select("batch", "run").distinct().count()
    top = index.compact()
    assert runs >= 75 and index.levels >= 4
    assert {(r["keep_id"], r["group_size"]) for r in top.collect()} == {(k, len(range(k, 300, 37))) for k in range(37)}
    fs = spark._jvm.org.apache.hadoop.fs.Path(index.path).getFileSystem(spark._jsc.hadoopConfiguration())
    kept = {f.getPath().getName() for f in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(index.path))}
    assert kept == {"runs", f"level{index.levels}"}  # merged levels are retired


def test_filters_rule_out_and_never_miss(spark):
    index = DigestIndex(spark)
    index.flush(documents(spark, [(i, f"text {i}", "a") for i in range(500)] + [(1000 + i, f"text {i}", "a") for i in range(20)]))
    index.compact()
    asked = documents(spark, [(i, f"text {i}", "b") for i in range(400, 900)])
    assert {tuple(r) for r in index.find(asked).collect()} == {(i, i) for i in range(400, 500)}
    every = documents(spark, [(i, f"text {i}", "a") for i in range(500)]).withColumn("__tw_digest", index.digested(F.col("text")))
    maybe = {r["doc_id"] for r in index.hit_filter().mark(every, "maybe").where("maybe").collect()}
    assert set(range(20)) <= maybe and len(maybe) < 60


def test_a_full_filter_changes_nothing(spark):
    rows = odd_rows() + [(100 + i, f"t{i % 50}", "a") for i in range(200)]
    got = exact_groups(documents(spark, rows), filter_bits=1, memtable_rows=2, fanout=2).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_texts_meet_the_filter_before_they_are_dealt_out(spark):
    plan = drop_exact_copies(documents(spark, odd_rows()))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.count("Exchange hashpartitioning") <= 1
    kept = drop_exact_copies(documents(spark, odd_rows()), digest=lambda t: F.substring(sha256_digest(t), 1, 0))
    assert sorted((r["text"] or "").split() for r in kept.collect()) == sorted((r["text"] or "").split() for r in drop_exact_copies(documents(spark, odd_rows())).collect())


def test_of_rows_with_one_id_the_same_row_stays_on_every_run(spark):
    rows = [(1, "a  b", "x"), (1, "a b", "y"), (1, "a b", "z"), (None, "a b", "w")]
    runs = [drop_exact_copies(documents(spark, rows[k:] + rows[:k])).collect() for k in range(3)]
    assert len(runs[0]) == 1 and runs[0] == runs[1] == runs[2]
