"""Report measures over labelled routes: domain, threat_type, trigger_context, source, sink,
destination, observed_trackers, party, confidence, tracker_class.

Each report is one pass of conditional aggregates, or an aggregate of a per-domain aggregate;
nothing but the domain is ever a shuffle key, and partial aggregation keeps hot domains small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KNOWN, NOVEL = ("Mixed Tracker - Known",), ("Mixed Tracker - Unknown", "Mixed Tracker - Novel")


def percent(n: Column, d: Column) -> Column:
    """One decimal, half up; 0 of nothing."""
    return F.when(d == 0, F.lit(0.0)).otherwise(F.floor(n * 1000.0 / d + 0.5) / 10.0)


def has_rule(n: int) -> Column:
    """Does a row's threat_type name rule n?"""
    names = {1: ("Rule 1", "Isolated_Exfiltration"), 2: ("Rule 2", "Parasitic_Branch"), 3: ("Rule 3", "Dual_Execution_Context"), 4: ("Rule 4",), 5: ("Rule 5", "Fingerprinting_Leak")}
    return reduce(lambda a, b: a | b, [F.contains("threat_type", F.lit(x)) for x in names[n]])


def rule_count() -> Column:
    """Distinct rules of a row, by their markers."""
    found = F.regexp_extract_all("threat_type", F.lit(r"\(Rule (\d)\)"), 1)
    return F.size(F.array_distinct(F.concat(found, F.when(F.contains("threat_type", F.lit("Fingerprinting_Leak")), F.array(F.lit("5"))).otherwise(F.array().cast("array<string>")))))


def route_class() -> Column:
    """known, novel, r3_only, tracker_only; null for the rest."""
    c = F.col("tracker_class")
    return F.when(c.isin(*KNOWN), "known").when(c.isin(*NOVEL), "novel").when(F.startswith(c, F.lit("R3 Only")), "r3_only").when(F.startswith(c, F.lit("Tracker Only")), "tracker_only")


def labelled(rows: DataFrame) -> DataFrame:
    """Without trailer rows; route_class added."""
    return rows.where("tracker_class is not null and not startswith(tracker_class, 'Routes:')").withColumn("route_class", route_class())


def mixed(rows: DataFrame) -> DataFrame:
    return labelled(rows).where(F.col("route_class").isin("known", "novel"))


def class_partition(rows: DataFrame) -> DataFrame:
    """domain, domain_class: known before novel before the others; a domain may be in both of the last."""
    per = labelled(rows).where("route_class is not null").groupBy("domain").agg(F.collect_set("route_class").alias("has"))
    inside = lambda c: F.array_contains("has", c)
    classes = F.when(inside("known"), F.array(F.lit("known"))).when(inside("novel"), F.array(F.lit("novel"))).otherwise(F.array_sort("has"))
    return per.select("domain", F.explode(classes).alias("domain_class"))


#: Bins of routes per domain: name, most routes.
BINS = (("1", 1), ("2-3", 3), ("4-5", 5), ("6-10", 10), ("11-20", 20), ("21-50", 50), ("51+", 1 << 62))


def routes_per_domain(rows: DataFrame) -> DataFrame:
    """Bins of routes per domain: domains, routes, and their shares. One aggregate of the
    per-domain counts gives all bins and totals at once."""
    per = mixed(rows).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    n, low, aggs, items = F.col("n"), 0, [], []
    for i, (name, high) in enumerate(BINS):
        inside = (n > low) & (n <= high)
        aggs += [F.count_if(inside).alias(f"d{i}"), F.sum(F.when(inside, n).otherwise(0)).alias(f"r{i}")]
        items.append(F.struct(F.lit(name).alias("bin"), F.col(f"d{i}").alias("domains"), F.col(f"r{i}").alias("routes")))
        low = high
    one = per.agg(*aggs, F.count(F.lit(1)).alias("all_domains"), F.sum("n").alias("all_routes"), F.floor(F.median("n")).alias("median"), F.max("n").alias("most"))
    out = one.select(F.explode(F.array(*items)).alias("x"), "all_domains", "all_routes", "median", "most").select("x.*", "all_domains", "all_routes", "median", "most").where("domains > 0")
    return out.select("bin", "domains", "routes", percent(F.col("domains"), F.col("all_domains")).alias("domain_pct"), percent(F.col("routes"), F.col("all_routes")).alias("route_pct"), "median", "most")


def rule_complexity(rows: DataFrame) -> DataFrame:
    """Routes by their number of rules, known and novel."""
    return mixed(rows).groupBy(rule_count().alias("rules")).agg(F.count_if(F.col("route_class") == "known").alias("known"), F.count_if(F.col("route_class") == "novel").alias("novel"))


def counts(rows: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """measure, routes, domains: one pass, a row for each measure."""
    aggs = []
    for i, c in enumerate(measures.values()):
        aggs += [F.count_if(c).alias(f"r{i}"), F.count_distinct(F.when(c, F.col("domain"))).alias(f"d{i}")]
    one = rows.agg(*aggs)
    items = F.array(*[F.struct(F.lit(k).alias("measure"), F.col(f"r{i}").alias("routes"), F.col(f"d{i}").alias("domains")) for i, k in enumerate(measures)])
    return one.select(F.explode(items).alias("x")).select("x.*")


def semantic_rule(kind: str) -> Column:
    return F.contains("threat_type", F.lit(kind)) & (F.contains("threat_type", F.lit("Rule 5")) | F.contains("threat_type", F.lit("Semantic_CrossValidation")))


def rule_distribution(rows: DataFrame) -> DataFrame:
    """Rule 4 goes by the sink. Rows that are deterministic and probabilistic count as
    deterministic; device leaks are no part of rule 5's total."""
    certain, likely = semantic_rule("Deterministic"), semantic_rule("Probabilistic")
    evasive, hidden = F.contains("sink", F.lit("Evasion Suspected")), F.contains("threat_type", F.lit("Dynamic Obfuscated"))
    return counts(mixed(rows), {
        "R1": has_rule(1), "R2": has_rule(2), "R3": has_rule(3), "R4": evasive, "R4 hidden": evasive & hidden, "R4 identified": evasive & ~hidden,
        "R5": certain | likely, "R5 deterministic": certain, "R5 probabilistic": likely & ~certain, "R5 device": F.contains("threat_type", F.lit("Fingerprinting_Leak")),
    })


def trigger_contexts(rows: DataFrame) -> DataFrame:
    out = mixed(rows).groupBy("route_class", "trigger_context").agg(F.count(F.lit(1)).alias("routes"), F.count_distinct("domain").alias("domains"))
    return out


def sink_family() -> Column:
    """The first that holds."""
    s = F.col("sink")
    has = lambda x: F.contains(s, F.lit(x))
    return (
        F.when(has("LoadFrameInst"), "dom iframe").when(s == "createElement().href (Evasion Suspected)", "dom create").when(s == "Image().src (Evasion Suspected)", "dom image")
        .when(has("Evasion Suspected"), "dom other").when(s == "document.cookie", "cookie").when(has("Storage"), "storage")
        .when(has("window.open") | has("location."), "navigation").when(has("sendBeacon"), "beacon").otherwise("other")
    )


def dom_sink() -> Column:
    return F.contains("sink", F.lit("Evasion"))


def third_party() -> Column:
    return F.startswith("party", F.lit("3rd-Party")) | F.startswith("party", F.lit("Confirmed 3rd"))


def date_source() -> Column:
    return F.col("source").isin("Date", "Date.now")


def sink_distribution(rows: DataFrame) -> DataFrame:
    return mixed(rows).groupBy(sink_family().alias("sink_family")).agg(F.count(F.lit(1)).alias("routes"), F.count_distinct("domain").alias("domains"))


def cloaked() -> Column:
    return F.contains("party", F.lit("CNAME"))


def cname_beneficiaries(rows: DataFrame) -> DataFrame:
    """Hosts that gain from cloaked routes."""
    host = F.explode(F.split("observed_trackers", r" \| ")).alias("host")
    each = labelled(rows).where(cloaked()).select("domain", host).withColumn("host", F.trim("host")).where("host <> '' and host <> 'None'")
    return each.groupBy("host").agg(F.count(F.lit(1)).alias("routes"), F.count_distinct("domain").alias("domains"))


def cname_profile(rows: DataFrame) -> DataFrame:
    """Per domain with cloaked routes: their number, the share through the DOM, distinct hosts."""
    hosts = F.filter(F.transform(F.split("observed_trackers", r" \| "), F.trim), lambda h: (h != "") & (h != "None"))
    per = mixed(rows).where(cloaked()).groupBy("domain").agg(F.count(F.lit(1)).alias("routes"), F.count_if(dom_sink()).alias("dom"), F.size(F.array_distinct(F.flatten(F.collect_set(hosts)))).alias("hosts"))
    return per.withColumn("dom_pct", percent(F.col("dom"), F.col("routes")))


def cookie_cohorts(rows: DataFrame) -> DataFrame:
    """Domains with and without a cookie write, and how many of either do what."""
    stored = F.col("source").isin("localStorage.getItem", "sessionStorage.getItem") & F.contains("sink", F.lit("Evasion Suspected"))
    per = mixed(rows).groupBy("domain").agg(
        F.max(F.col("sink") == "document.cookie").alias("cookie"), F.max(dom_sink()).alias("dom"), F.max(date_source()).alias("date"), F.max(third_party()).alias("foreign"), F.max(stored).alias("stored"),
    )
    return per.groupBy("cookie").agg(F.count(F.lit(1)).alias("domains"), *[F.count_if(F.col(c)).alias(c) for c in ("dom", "date", "foreign", "stored")])


def source_families(rows: DataFrame) -> DataFrame:
    s = F.col("source")
    exact = s.isin("Obfuscated_Property (LoadPropertyInst)", "Obfuscated_Call (CallInst)")
    return counts(mixed(rows), {"location": F.startswith(s, F.lit("location.")), "obfuscated": exact, "obfuscated in name": F.contains(s, F.lit("Obfuscated")), "date": date_source(), "cookie read": s == "document.cookie"})


def source_sink_flows(rows: DataFrame) -> DataFrame:
    s, frame = F.col("source"), F.contains("sink", F.lit("LoadFrameInst"))
    return counts(mixed(rows), {
        "obfuscated to iframe": F.contains(s, F.lit("Obfuscated")) & frame, "location to iframe": (s == "location.href") & frame,
        "location to createElement": (s == "location.href") & F.contains("sink", F.lit("createElement")), "date to cookie": date_source() & (F.col("sink") == "document.cookie"),
    })


def obfuscation_axes(rows: DataFrame) -> DataFrame:
    """Hidden destination, hidden source, DOM sink and all three, by class and in all (null)."""
    a, b, c = F.col("destination") == "DYNAMIC_URL", F.contains("source", F.lit("Obfuscated")), dom_sink()
    aggs = [F.count(F.lit(1)).alias("routes")]
    for name, x in (("dest", a), ("source", b), ("dom", c), ("all", a & b & c)):
        aggs += [F.count_if(x).alias(f"{name}_routes"), F.count_distinct(F.when(x, F.col("domain"))).alias(f"{name}_domains")]
    return mixed(rows).rollup("route_class").agg(*aggs)


def party_breakdown(rows: DataFrame) -> DataFrame:
    family = F.when(third_party(), "third").when(F.startswith("party", F.lit("1st-Party")), "first").when(F.startswith("party", F.lit("Local")), "local").otherwise("unknown")
    return mixed(rows).groupBy("party", family.alias("family")).agg(F.count(F.lit(1)).alias("routes"), F.count_distinct("domain").alias("domains"))


def single_rule_domains(rows: DataFrame) -> DataFrame:
    """Domains all of whose novel routes have exactly one rule."""
    return mixed(rows).where("route_class = 'novel'").groupBy("domain").agg(F.min(rule_count() == 1).alias("single"), F.count(F.lit(1)).alias("routes")).where("single").select("domain", "routes")


def score_histogram(rows: DataFrame) -> DataFrame:
    """Domains by their best score, known and novel."""
    per = mixed(rows).groupBy("domain").agg(F.max("confidence").alias("score"), F.max(F.col("route_class") == "known").alias("known"))
    return per.groupBy("score").agg(F.count_if("known").alias("known"), F.count_if(~F.col("known")).alias("novel"))


def score_averages(rows: DataFrame) -> DataFrame:
    m = cloaked() & dom_sink()
    return mixed(rows).agg(F.sum("confidence").alias("total"), F.count(F.lit(1)).alias("routes"), F.sum(F.when(m, F.col("confidence"))).alias("cloaked_total"), F.count_if(m).alias("cloaked_routes"), F.count_if(F.col("confidence") >= 5).alias("top_routes"), F.avg("confidence").alias("average"))


def rule_combos(rows: DataFrame) -> DataFrame:
    both = has_rule(3) & F.contains("sink", F.lit("Evasion Suspected"))
    certain = F.contains("threat_type", F.lit("Deterministic"))
    any_ = semantic_rule("Deterministic") | semantic_rule("Probabilistic")
    return counts(mixed(rows), {"R3+R4+R5": both & any_, "R3+R4+R5 deterministic": both & certain, "R3+R4+R5 deterministic, cloaked": both & certain & cloaked()})


def check_table(computed: DataFrame, expected: DataFrame) -> DataFrame:
    """measure, computed, expected, ok; measures on one side only fail."""
    out = computed.withColumnRenamed("value", "computed").join(expected.withColumnRenamed("value", "expected"), "measure", "full")
    return out.withColumn("ok", F.coalesce(F.col("computed") == F.col("expected"), F.lit(False)))


def pipeline_outcomes(messages: DataFrame) -> DataFrame:
    """status, n: outcome lines by ordered tests."""
    m = F.col("message")
    status = F.when(F.contains(m, F.lit("SUCCESS")), "SUCCESS").when(F.contains(m, F.lit("TIMEOUT")), "TIMEOUT").when(F.contains(m, F.lit("No taint path")), "NO_TAINT").when(F.contains(m, F.lit("PARSE ERROR")), "PARSE_ERROR").otherwise("ENGINE_CRASH")
    return messages.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))
