import json
import random

import pytest

from tarnweave.sources import readers as R
from tarnweave.sources import sinks as S
from tarnweave.streaming import resume


def write(path, text, encoding="utf-8"):
    path.write_text(text, encoding=encoding)
    return str(path)


def test_url_list(spark, tmp_path):
    p = write(tmp_path / "u.txt", "# head\n\n1,a.com\nb.com\nhttp://c.com \n")
    assert [r["target"] for r in R.url_list(spark, p).collect()] == ["https://a.com", "https://b.com", "http://c.com"]


def test_reports(spark, tmp_path):
    route = {"route_id": 1, "source_name": "s", "path_nodes": ["CallInst"], "destination_url": "d"}
    write(tmp_path / "a.com_report.json", json.dumps({"target_url": "a", "event_driven_functions": 3, "s2s_routes": [route, route | {"route_id": 2}]}, indent=4))
    write(tmp_path / "b.com_report.json", json.dumps({"target_url": "b", "s2s_routes": []}))
    write(tmp_path / "c.com_report.json", "{ broken")
    got = sorted(((r["domain"], r["event_driven_functions"], r["ord"], r["route_id"]) for r in R.reports(spark, str(tmp_path)).collect()), key=repr)
    assert got == [("a.com", 3, 0, 1), ("a.com", 3, 1, 2), ("b.com", 0, None, None)]


def test_network_logs(spark, tmp_path):
    write(tmp_path / "a.com.json", json.dumps(["https://x/", "data:1", "https://y/", "https://x/"]))
    assert sorted(map(tuple, R.network_logs(spark, str(tmp_path)).collect())) == [("a.com", 0, "https://x/"), ("a.com", 2, "https://y/")]


def test_labelled_csv(spark, tmp_path):
    p = write(tmp_path / "l.csv", "﻿Domain,Threat_Type,Tracker_Class\n a.com ,t,Mixed Tracker - Known\nb,t,Routes: 4\nc,t,\n")
    assert [(r["Domain"], r["Tracker_Class"]) for r in R.labelled_csv(spark, p).collect()] == [("a.com", "Mixed Tracker - Known")]


def test_profile(spark, tmp_path):
    body = {"version": 2, "page_size": 4096, "functions": [{"checksum": "f", "basic_blocks": [{"profile_index": 1, "execution_count": 5}]}]}
    assert [tuple(r) for r in R.profile(spark, write(tmp_path / "p.json", json.dumps(body))).collect()] == [("f", 1, 5)]
    with pytest.raises(Exception, match="version"):
        R.profile(spark, write(tmp_path / "q.json", json.dumps(body | {"version": 1}))).collect()


def test_small_text_formats(spark, tmp_path):
    assert [tuple(r) for r in R.sections(spark, write(tmp_path / "s.txt", "head: [0, 10)\nnoise\n code table: [10, 40)\n")).collect()] == [("head", 0, 10), ("code table", 10, 40)]
    assert R.native_stats(spark, write(tmp_path / "n.txt", "1 2 3 4 NativeCall\n1 2 NativeCall\n1 2 3 4 Other\n")).count() == 1
    assert [tuple(r) for r in R.section_sizes(spark, write(tmp_path / "z.txt", ".text 100 7\nTotal 3\n")).collect()] == [(".text", 100, 7)]
    assert [tuple(r) for r in R.page_trace(spark, write(tmp_path / "t.tsv", "page\ttime\n0\t42\n")).collect()] == [(0, 42)]
    assert R.fingerprints(spark, write(tmp_path / "f.bin", "abc")).first()["md5"] == "900150983cd24fb0d6963f7d28e17f72"
    assert R.json_lines(spark, write(tmp_path / "j.json", '{"a": 1}\n{"a": 2}\n'), "a int").count() == 2
    assert R.heap_snapshot(spark, write(tmp_path / "h.json", json.dumps({"nodes": [1, 2, 3], "strings": ["a"]}))).first()["nodes"] == [1, 2, 3]


def test_vlq_round_trip():
    r = random.Random(5)
    for _ in range(200):
        numbers = [r.randrange(-(1 << 31), 1 << 31) for _ in range(r.randrange(1, 6))]
        assert R.decode_vlq(R.encode_vlq(numbers)) == numbers


def test_source_map(spark):
    text = ",".join([R.encode_vlq([0, 0, 0, 0]), R.encode_vlq([5, 0, 1, 2])]) + ";;" + R.encode_vlq([3, 1, -1, 0]) + "," + R.encode_vlq([2])
    got = [tuple(r) for r in R.source_map(spark.createDataFrame([("k", text)], "key string, mappings string")).collect()]
    assert got == [("k", 0, 0, 0, 0, 0), ("k", 0, 5, 0, 1, 2), ("k", 2, 3, 1, 0, 2), ("k", 2, 5, None, None, None)]


@pytest.mark.parametrize("options", [{}, {"key_rows": 0, "tasks": 5}])
def test_long_source_maps(spark, options):
    r = random.Random(9)
    texts, want = [("none", None), ("empty", "")], []
    for key in ("a", "b"):
        lines, at = [], [0, 0, 0]
        for n in range(40):
            segments, column = [], 0
            for _ in range(r.choice([0, 1, 30])):
                f = [r.randrange(9)] + ([r.randrange(-3, 4) for _ in range(r.choice([3, 4]))] if r.random() < 0.7 else [])
                column += f[0]
                if len(f) >= 4:
                    at = [x + y for x, y in zip(at, f[1:4])]
                want.append((key, n, column, *(at if len(f) >= 4 else [None] * 3)))
                segments.append(R.encode_vlq(f))
            lines.append(",".join(segments))
        texts.append((key, ";".join(lines)))
    got = R.source_map(spark.createDataFrame(texts, "key string, mappings string"), **options)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", "t", "AUTONOMOUS", "s", "k", "d", "None", "p", 3)], "domain string, threat_type string, trigger_context string, source string, sink string, destination string, observed_trackers string, party string, confidence int")
    S.write_threats(rows, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == list(R.THREAT_COLUMNS)
    assert S.free_name("r", {"r_20260101.csv", "r_20260101_2.csv"}, "20260101") == "r_20260101_3.csv"
    modules = spark.createDataFrame([("a", 1), ("b", 0)], "domain string, event_driven_functions int")
    routes = spark.createDataFrame([("a", 1, "s", "k", "Network", 1, ["CallInst"], "AUTONOMOUS", "d")], "domain string, " + R.ROUTE)
    got = {r["domain"]: json.loads(r["value"]) for r in S.report_lines(modules, routes).collect()}
    assert len(got["a"]["s2s_routes"]) == 1 and got["b"]["s2s_routes"] == []


def test_resume_skips_what_is_done(spark, tmp_path):
    src, sink, ckpt = (str(tmp_path / n) for n in ("src", "sink", "ckpt"))

    def work(df):
        return df.mapInPandas(resume.guarded(lambda r: 10 // r["id"], "value"), "id long, value double, status string")

    for ids in ([1, 2, 0], [2, 5]):
        spark.createDataFrame([(i,) for i in ids], "id long").write.mode("append").parquet(src)
        resume.run_available(spark, src, "id long", sink, ckpt, work, "id")
    got = sorted((r["id"], r["status"]) for r in spark.read.parquet(sink).collect())
    assert got == [(0, "FAILED (ZeroDivisionError)"), (1, "OK"), (2, "OK"), (5, "OK")]


def test_windows_on_a_stream(spark, tmp_path):
    import datetime as dt

    rows = [(dt.datetime(2024, 1, 1, 0, m), "click") for m in (0, 1, 6)] + [(dt.datetime(2024, 1, 2), "view")]
    spark.createDataFrame(rows, "ts timestamp, event_type string").write.parquet(str(tmp_path / "e"))
    stream = resume.windowed_counts(spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "e")))
    q = stream.writeStream.format("memory").queryName("wc").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["n"] for r in spark.table("wc").where("event_type = 'click'").collect()) == [1, 2]


def test_dot_files_are_whole(spark, tmp_path):
    from tarnweave.operators import graph

    nodes = spark.createDataFrame([("a.b", "N_1", "source", 'say "x"'), ("a.b", "N_2", "sink", "s\nd"), ("c.d", "N_3", "source", "y")], "domain string, node string, kind string, label string")
    edges = spark.createDataFrame([("a.b", "N_1", "N_2")], "domain string, src string, dst string")
    S.write_dot(graph.dot_lines(nodes, edges), str(tmp_path / "dot"))
    files = {p.parent.name: p.read_text() for p in (tmp_path / "dot").glob("domain=*/*.txt")}
    assert files["domain=a.b"] == 'digraph G {\n    "N_1" [label="say \'x\'"];\n    "N_2" [label="s\\nd"];\n    "N_1" -> "N_2";\n}\n'
    assert set(files) == {"domain=a.b", "domain=c.d"}


def test_a_row_that_never_ends_does_not_stop_its_batch(spark):
    def step(row):
        import os
        import re

        if row["id"] == 1:
            while True:
                pass
        if row["id"] == 2:
            re.match("(a+)+$", "a" * 40 + "b")  # does not come back to the interpreter for very long
        if row["id"] == 3:
            os._exit(1)
        return 10 / (row["id"] - 4)

    rows = spark.createDataFrame([(i,) for i in range(7)], "id long").coalesce(1)
    got = {r["id"]: r["status"] for r in rows.mapInPandas(resume.guarded(step, "value", limit=1.0), "id long, value double, status string").collect()}
    assert got == {0: "OK", 1: "TIMEOUT", 2: "TIMEOUT", 3: "FAILED (died)", 4: "FAILED (ZeroDivisionError)", 5: "OK", 6: "OK"}


def test_dependencies_outside_comments_and_strings(spark):
    from tarnweave.operators import graph

    texts = [
        ("a", "// require('x')\nrequire('y') /* require('z')\n import 'w' */"), ("b", "var s = \"require('x')\"; require(\"y\")"), ("c", "`require('x') ${1}`; import(`n`); import('y')"), ("d", "'http://a'; require('y')"),
        ("e", r"'it\'s // '; require('y') // '"), ("f", "graphql`query Q { a } // 'x`; other`query N`; /* graphql`query M` */"), ("g", "'open\nrequire('y')"), ("h", "/* open require('x')"), ("i", ""), ("j", None),
    ]
    got = sorted((r["key"], r["name"]) for r in graph.dependencies(spark.createDataFrame(texts, "key string, text string")).collect())
    assert got == [("a", "y"), ("b", "y"), ("c", "y"), ("d", "y"), ("e", "y"), ("f", "Q"), ("g", "y"), ("h", "x")]


SNAPSHOT = {
    "snapshot": {"meta": {"node_fields": ["type", "name", "id"], "node_types": [["a", "b"], "string"]}, "node_count": 3}, "nodes": list(range(100, 400)), "edges": [5, 6, 7, 8], "samples": [], "locations": [-1, 0, 2],
    "strings": ["", "plain", "with, comma", "quote \" and, \\", "\\\\\",\"", "nodes", "\"nodes\":[1,2", "] }", "é😀, ,x", "a" * 500 + ",,", ",", "]"],
}


@pytest.mark.parametrize("split_bytes, options", [(None, {}), (700, {}), (700, {"key_rows": 0, "tasks": 4}), (97, {"key_rows": 0, "tasks": 3})])
@pytest.mark.parametrize("indent", [None, 1])
def test_a_file_in_splits_gives_the_rows_of_one(spark, tmp_path, split_bytes, options, indent):
    for n in (1, 2):
        (tmp_path / f"{n}.heapsnapshot").write_text(json.dumps(SNAPSHOT | {"edges": [n] * 8}, indent=indent, ensure_ascii=n == 1))
    got = R.list_elements(spark, str(tmp_path), ["nodes", "edges", "samples", "locations", "strings"], split_bytes=split_bytes, **options).cache()
    found = {}
    for r in got.collect():
        found.setdefault((r["file"][-14:-13], r["list"]), {})[r["at"]] = json.loads(r["value"])
    for n in (1, 2):
        want = SNAPSHOT | {"edges": [n] * 8}
        for name in ("nodes", "edges", "locations", "strings"):
            assert [v for _, v in sorted(found[str(n), name].items())] == want[name], name
    assert not any(name == "samples" for _, name in found)
    rows = sorted((r["no"], r["a"], r["b"], r["c"]) for r in R.list_rows(got, "nodes", ["a", "b", "c"]).where("file like '%1.heapsnapshot'").collect())
    assert rows == [(i, 100 + 3 * i, 101 + 3 * i, 102 + 3 * i) for i in range(100)]
    assert {r["at"]: r["text"] for r in R.list_strings(got).where("file like '%2.heapsnapshot'").collect()} == dict(enumerate(SNAPSHOT["strings"]))


def test_names_with_a_moment_and_files_with_a_mark(spark, tmp_path):
    from pyspark.sql import functions as F

    from tarnweave.operators import text

    df = spark.createDataFrame([("https://a.com/x/y z.js?q=1",), ("https://a.com/",)], "u string").select(text.safe_name(F.col("u"), F.timestamp_millis(F.lit(1700000000123))).alias("n"))
    assert [r["n"] for r in df.collect()] == ["y_z.js_1700000000123.js", "script.js_1700000000123.js"]
    rows = spark.createDataFrame([("a", 1)], "domain string, total_routes int").coalesce(1)
    S.write_summary(rows, str(tmp_path / "s"), mark=True)
    assert next((tmp_path / "s").glob("part-*.csv")).read_bytes() == b"\xef\xbb\xbfdomain,total_routes\na,1\n"
