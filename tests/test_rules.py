"""Hand-made cases of the rules and the merge, against a plain-Python version of the fold."""

from pyspark.sql import Row

from tarnweave import registries as R
from tarnweave.functions import urls as U
from tarnweave.operators import rules as O


def _threats(spark, rows):
    """rows: (source, sink, destination, label, party) in seq order, of one domain."""
    data = [("a.example", Row(rule_group=0, route_id=i), lab, "AUTONOMOUS" if i else "EVENT_DRIVEN", s, k, d, p, "None") for i, (s, k, d, lab, p) in enumerate(rows)]
    return spark.createDataFrame(data, "domain string, seq struct<rule_group: int, route_id: bigint>, label string, trigger_context string, source string, sink string, destination string, party string, observed_trackers string")


def test_label_appending(spark):
    d = [("s", "k", "DYNAMIC_URL", R.R4_DYNAMIC, "p"), ("s", "k", "DYNAMIC_URL", R.R4, "p")]
    assert O.merge_threats(_threats(spark, d)).first()["threat_type"] == R.R4_DYNAMIC
    assert O.merge_threats(_threats(spark, d[::-1])).first()["threat_type"] == R.R4
    three = [("s", "k", "DYNAMIC_URL", x, "p") for x in (R.R4, R.R3, R.R4_DYNAMIC)]
    assert O.merge_threats(_threats(spark, three)).first()["threat_type"] == f"{R.R4} | {R.R3}"


def test_destination_upgrade_and_party(spark):
    cloak = "https://t.a.example/x" + R.PREDICTED_NOTE
    r = O.merge_threats(_threats(spark, [("s", "document.cookie", "DYNAMIC_URL", R.R3, "Local"), ("s", "document.cookie", cloak, R.R2, "q")])).first()
    assert (r["destination"], r["party"], r["trigger_context"]) == (cloak, "1st-Party (CNAME Cloaked)", "EVENT_DRIVEN")
    r = O.merge_threats(_threats(spark, [("s", "k", "DYNAMIC_URL", R.R1, "Unknown (WCC Isolated)"), ("s", "k", cloak, R.R2, "q")])).first()
    assert (r["destination"], r["party"]) == (cloak, "Unknown (WCC Isolated)")


def test_urls(spark):
    rows = [("a.b", "https://a.b/{VAR}"), ("www.a.b", "https://x.a.b:8080/y"), ("naver.com", "https://img.pstatic.net/a"), ("a.b", "DYNAMIC_URL"), ("a.b", "/login"), ("b", "https://ab/")]
    df = spark.createDataFrame(rows, "d string, u string")
    got = df.select(U.netloc(df.u).alias("n"), U.is_first_party(df.d, df.u).alias("f"), U.is_first_party(df.d, df.u, False).alias("s")).collect()
    assert [r["n"] for r in got] == ["a.b", "x.a.b:8080", "img.pstatic.net", "", "", "ab"]
    assert [r["f"] for r in got] == [True, False, True, False, False, False]
    assert [r["s"] for r in got][2] is False


def _route(spark, **k):
    base = {"domain": "a.example", "route_id": 1, "source_name": "x.Date.y", "sink_name": "navigator.sendBeacon", "sink_type": "Network", "trigger_context": "AUTONOMOUS", "destination_url": "https://a.example/collect", "path_nodes": ["CallInst"], "path_length": 1}
    return spark.createDataFrame([tuple((base | k).values())], "domain string, route_id bigint, source_name string, sink_name string, sink_type string, trigger_context string, destination_url string, path_nodes array<string>, path_length int")


def test_sources_match_by_substring(spark):
    none = spark.createDataFrame([], "domain string, has_tracker boolean")
    assert O.semantic(_route(spark), none).first()["label"] == R.R5_CERTAIN
    assert O.semantic(_route(spark, destination_url="https://a.example/login?collect"), none).count() == 0
    assert O.fingerprinting(_route(spark, source_name="screen.width", destination_url="DYNAMIC_URL")).count() == 1
    assert O.fingerprinting(_route(spark, source_name="screen.width")).count() == 0


def test_handlers_prove_events(spark):
    r = _route(spark)
    assert O.dual_context(r).count() == 0
    assert O.dual_context(r, spark.createDataFrame([("a.example", 2)], "domain string, event_driven_functions int")).count() == 1


def test_isolated_is_dropped_where_rule_four_speaks(spark):
    r = _route(spark, sink_name="Image().src (Evasion Suspected)")
    assert O.isolated(r).count() == 1 and O.isolated_only(r).count() == 0
    assert O.isolated(_route(spark, path_nodes=[])).count() == 0 and O.isolated(_route(spark, path_nodes=["PhiInst"])).count() == 0


def test_whole_classification_is_empty_on_empty(spark):
    assert O.classify(_route(spark).limit(0), spark.createDataFrame([], "domain string, ord bigint, url string")).count() == 0


def test_hot_site_is_looked_up_by_rare_grams(spark):
    """Destinations and URLs of one site: candidates are few, and the same URLs are found as by trying all pairs."""
    from pyspark.sql import functions as F

    names = [f"item{i:03d}x" for i in range(150)]
    urls = [("hot.com", i, f"https://hot.com/collect/{n}?user={i}&z=1") for i, n in enumerate(names)] + [("hot.com", 900, "https://hot.com/q"), ("b.com", 1, "https://b.com/collect/item000x?a=b"), ("hot.com", 500, "https://hot.com/collect/item003x?user=77&z=1")]
    dests = [("hot.com", "https://hot.com/collect/" + n + "?user={VAR}&z=1") for n in names[::2]] + [("hot.com", d) for d in ("{VAR}/q{VAR}", "https://hot.com/none{VAR}", "{VAR}", "ab{VAR}", "{VAR}&z=1", "https://{VAR}/collect/item149x{VAR}")] + [("b.com", "https://b.com{VAR}a=b"), ("c.com", "https://c.com/{VAR}")]
    routes = spark.createDataFrame(dests, "domain string, destination_url string")
    log = spark.createDataFrame(urls, "domain string, ord long, url string")
    plain, grams = (sorted(map(tuple, O.hybrid_targets(routes, log, tried=n).collect())) for n in (1 << 20, 0))
    assert plain == grams and len(plain) >= 78
    open_ = routes.withColumn("parts", O.fragments(F.col("destination_url"))).where(F.size("parts") > 0)
    assert O.candidates(open_, log.groupBy("domain", "url").agg(F.min("ord").alias("ord"))).count() < 150 * 4
