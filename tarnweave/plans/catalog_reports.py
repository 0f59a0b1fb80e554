"""Catalogue: report measures over labelled routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports as O
from . import fixtures as X
from .registry import query

_THREATS = (
    "DOM_Evasion (Rule 4) [Dynamic Obfuscated] | Dual_Execution_Context (Rule 3)",
    "Dual_Execution_Context (Rule 3)",
    "Isolated_Exfiltration (Rule 1) | Dual_Execution_Context (Rule 3) | Semantic_CrossValidation (Rule 5) [Deterministic]",
    "DOM_Evasion (Rule 4) | Dual_Execution_Context (Rule 3) | Semantic_CrossValidation (Rule 5) [Probabilistic]",
    "Parasitic_Branch (Rule 2) | Fingerprinting_Leak (Rule 5)",
    "Semantic_CrossValidation (Rule 5) [Deterministic] | Semantic_CrossValidation (Rule 5) [Probabilistic]",
    "Dual_Execution_Context (Rule 3) | DOM_Evasion (Rule 4) [Dynamic Obfuscated] | Semantic_CrossValidation (Rule 5) [Deterministic]",
)
_PARTIES = ("1st-Party (CNAME Cloaked)", "3rd-Party/Unknown", "Local (Cookie/Storage)", "Unknown (Obfuscated)", "1st-Party")
_CLASSES = ("Mixed Tracker - Known", "Mixed Tracker - Novel", "R3 Only (no tracker)", "Tracker Only (no rule 3)", "Mixed Tracker - Unknown", "Routes: 12")
_SEEN = ("None", "www.google-analytics.com", "stats.example.org | www.googletagmanager.com")


def labelled_routes(spark, d):
    r, i = X.routes(spark, d), F.col("route_id")
    return r.select(
        "domain", X._pick(_THREATS, F.when(F.length("domain") % 12 == 10, F.lit(1)).otherwise(i % 7)).alias("threat_type"), "trigger_context", F.col("source_name").alias("source"), F.col("sink_name").alias("sink"),
        F.col("destination_url").alias("destination"), X._pick(_SEEN, F.length("domain") % 3).alias("observed_trackers"), X._pick(_PARTIES, i % 5).alias("party"),
        (i % 5 + 1).cast("int").alias("confidence"), X._pick(_CLASSES, (F.length("domain") + (i % 97 == 0).cast("int")) % 6).alias("tracker_class"),
    )


_L = f"""WITH {X.BASE_SQL}, lab AS (SELECT domain, {X._sql_pick(_THREATS, 'CASE WHEN length(domain) % 12 = 10 THEN 1 ELSE route_id % 7 END')} AS threat_type, trigger_context, source_name AS source, sink_name AS sink,
  destination_url AS destination, {X._sql_pick(_SEEN, 'length(domain) % 3')} AS observed_trackers, {X._sql_pick(_PARTIES, 'route_id % 5')} AS party, (route_id % 5 + 1)::INT AS confidence,
  {X._sql_pick(_CLASSES, '(length(domain) + (route_id % 97 = 0)::INT) % 6')} AS tracker_class FROM fx_routes),
ok AS (SELECT *, CASE WHEN tracker_class = 'Mixed Tracker - Known' THEN 'known' WHEN tracker_class IN ('Mixed Tracker - Unknown', 'Mixed Tracker - Novel') THEN 'novel'
  WHEN starts_with(tracker_class, 'R3 Only') THEN 'r3_only' WHEN starts_with(tracker_class, 'Tracker Only') THEN 'tracker_only' END AS route_class
  FROM lab WHERE tracker_class IS NOT NULL AND NOT starts_with(tracker_class, 'Routes:')),
mix AS (SELECT *, len(list_distinct(regexp_extract_all(threat_type, '\\(Rule (\\d)\\)', 1) || CASE WHEN contains(threat_type, 'Fingerprinting_Leak') THEN ['5'] ELSE [] END)) AS rules,
  CASE WHEN contains(sink, 'LoadFrameInst') THEN 'dom iframe' WHEN sink = 'createElement().href (Evasion Suspected)' THEN 'dom create' WHEN sink = 'Image().src (Evasion Suspected)' THEN 'dom image' WHEN contains(sink, 'Evasion Suspected') THEN 'dom other'
    WHEN sink = 'document.cookie' THEN 'cookie' WHEN contains(sink, 'Storage') THEN 'storage' WHEN contains(sink, 'window.open') OR contains(sink, 'location.') THEN 'navigation' WHEN contains(sink, 'sendBeacon') THEN 'beacon' ELSE 'other' END AS sink_family,
  contains(sink, 'Evasion') AS dom, source IN ('Date', 'Date.now') AS dated, starts_with(party, '3rd-Party') OR starts_with(party, 'Confirmed 3rd') AS third,
  contains(party, 'CNAME') AS cloaked FROM ok WHERE route_class IN ('known', 'novel'))"""


def _rule(n):
    extra = {1: "Isolated_Exfiltration", 2: "Parasitic_Branch", 3: "Dual_Execution_Context", 5: "Fingerprinting_Leak"}
    return f"(contains(threat_type, 'Rule {n}') OR contains(threat_type, '{extra[n]}'))"


def _counts(measures):
    return f"{_L} " + " UNION ALL ".join(f"SELECT '{k}' AS measure, count(*) FILTER (WHERE {c}) AS routes, count(DISTINCT domain) FILTER (WHERE {c}) AS domains FROM mix" for k, c in measures.items())


def _grouped(cols, extra=""):
    return f"{_L} SELECT {cols}, count(*) AS routes, count(DISTINCT domain) AS domains{extra} FROM mix GROUP BY ALL"


def _pct(n, d):
    return f"CASE WHEN {d} = 0 THEN 0.0 ELSE floor({n} * 1000.0 / {d} + 0.5) / 10.0 END::DOUBLE"


_EV, _DET = "contains(sink, 'Evasion Suspected')", "contains(threat_type, 'Deterministic')"
_HID = "contains(threat_type, 'Dynamic Obfuscated')"
_SEM = "(contains(threat_type, 'Rule 5') OR contains(threat_type, 'Semantic_CrossValidation'))"
_CERTAIN, _LIKELY = f"({_DET} AND {_SEM})", f"(contains(threat_type, 'Probabilistic') AND {_SEM})"

_SQL = {
    "class_partition": f"""{_L}, h AS (SELECT domain, list(DISTINCT route_class) AS has FROM ok WHERE route_class IS NOT NULL GROUP BY domain)
      SELECT domain, unnest(CASE WHEN list_contains(has, 'known') THEN ['known'] WHEN list_contains(has, 'novel') THEN ['novel'] ELSE has END) AS domain_class FROM h""",
    "routes_per_domain": f"""{_L}, p AS (SELECT domain, count(*) AS n FROM mix GROUP BY domain), t AS (SELECT count(*) AS ad, sum(n) AS ar, floor(median(n))::BIGINT AS median, max(n) AS most FROM p),
      b AS (SELECT CASE WHEN n = 1 THEN '1' WHEN n <= 3 THEN '2-3' WHEN n <= 5 THEN '4-5' WHEN n <= 10 THEN '6-10' WHEN n <= 20 THEN '11-20' WHEN n <= 50 THEN '21-50' ELSE '51+' END AS bin, count(*) AS domains, sum(n)::BIGINT AS routes FROM p GROUP BY 1)
      SELECT bin, domains, routes, {_pct('domains', 'ad')} AS domain_pct, {_pct('routes', 'ar')} AS route_pct, median, most FROM b, t""",
    "rule_complexity": f"{_L} SELECT rules, count(*) FILTER (WHERE route_class = 'known') AS known, count(*) FILTER (WHERE route_class = 'novel') AS novel FROM mix GROUP BY rules",
    "rule_distribution": _counts({"R1": _rule(1), "R2": _rule(2), "R3": _rule(3), "R4": _EV, "R4 hidden": f"{_EV} AND {_HID}", "R4 identified": f"{_EV} AND NOT {_HID}", "R5": f"({_CERTAIN} OR {_LIKELY})", "R5 deterministic": _CERTAIN,
      "R5 probabilistic": f"{_LIKELY} AND NOT {_CERTAIN}", "R5 device": "contains(threat_type, 'Fingerprinting_Leak')"}),
    "trigger_contexts": _grouped("route_class, trigger_context"),
    "sink_distribution": _grouped("sink_family"),
    "cname_beneficiaries": f"""{_L} SELECT host, count(*) AS routes, count(DISTINCT domain) AS domains FROM (SELECT domain, trim(unnest(string_split(observed_trackers, ' | '))) AS host FROM ok WHERE contains(party, 'CNAME')) WHERE host NOT IN ('', 'None') GROUP BY host""",
    "cname_profile": f"""{_L}, c AS (SELECT domain, count(*) AS routes, count(*) FILTER (WHERE dom) AS dom, list_distinct(flatten(list(list_filter(string_split(observed_trackers, ' | '), lambda h: h NOT IN ('', 'None'))))) AS hs FROM mix WHERE cloaked GROUP BY domain)
      SELECT domain, routes, dom, len(hs)::INT AS hosts, {_pct('dom', 'routes')} AS dom_pct FROM c""",
    "cookie_cohorts": f"""{_L}, p AS (SELECT domain, bool_or(sink = 'document.cookie') AS cookie, bool_or(dom) AS dom, bool_or(dated) AS date, bool_or(third) AS f, bool_or(source IN ('localStorage.getItem', 'sessionStorage.getItem') AND contains(sink, 'Evasion Suspected')) AS s FROM mix GROUP BY domain)
      SELECT cookie, count(*) AS domains, count(*) FILTER (WHERE dom) AS dom, count(*) FILTER (WHERE date) AS date, count(*) FILTER (WHERE f) AS "foreign", count(*) FILTER (WHERE s) AS stored FROM p GROUP BY cookie""",
    "source_families": _counts({"location": "starts_with(source, 'location.')", "obfuscated": "source IN ('Obfuscated_Property (LoadPropertyInst)', 'Obfuscated_Call (CallInst)')", "obfuscated in name": "contains(source, 'Obfuscated')", "date": "dated", "cookie read": "source = 'document.cookie'"}),
    "source_sink_flows": _counts({"obfuscated to iframe": "contains(source, 'Obfuscated') AND contains(sink, 'LoadFrameInst')", "location to iframe": "source = 'location.href' AND contains(sink, 'LoadFrameInst')", "location to createElement": "source = 'location.href' AND contains(sink, 'createElement')", "date to cookie": "dated AND sink = 'document.cookie'"}),
    "obfuscation_axes": f"{_L} SELECT route_class, count(*) AS routes, " + ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}_routes, count(DISTINCT domain) FILTER (WHERE {c}) AS {n}_domains" for n, c in {
      "dest": "destination = 'DYNAMIC_URL'", "source": "contains(source, 'Obfuscated')", "dom": "dom", "all": "destination = 'DYNAMIC_URL' AND contains(source, 'Obfuscated') AND dom"}.items()) + " FROM mix GROUP BY ROLLUP (route_class)",
    "party_breakdown": f"""{_L} SELECT party, CASE WHEN third THEN 'third' WHEN starts_with(party, '1st-Party') THEN 'first' WHEN starts_with(party, 'Local') THEN 'local' ELSE 'unknown' END AS family, count(*) AS routes, count(DISTINCT domain) AS domains FROM mix GROUP BY ALL""",
    "single_rule_domains": f"{_L} SELECT domain, count(*) AS routes FROM mix WHERE route_class = 'novel' GROUP BY domain HAVING bool_and(rules = 1)",
    "score_histogram": f"{_L}, p AS (SELECT domain, max(confidence) AS score, bool_or(route_class = 'known') AS k FROM mix GROUP BY domain) SELECT score, count(*) FILTER (WHERE k) AS known, count(*) FILTER (WHERE NOT k) AS novel FROM p GROUP BY score",
    "score_averages": f"""{_L} SELECT sum(confidence)::BIGINT AS total, count(*) AS routes, (sum(confidence) FILTER (WHERE cloaked AND dom))::BIGINT AS cloaked_total, count(*) FILTER (WHERE cloaked AND dom) AS cloaked_routes,
      count(*) FILTER (WHERE confidence >= 5) AS top_routes, avg(confidence) AS average FROM mix""",
    "rule_combos": _counts({"R3+R4+R5": f"{_rule(3)} AND {_EV} AND ({_CERTAIN} OR {_LIKELY})", "R3+R4+R5 deterministic": f"{_rule(3)} AND {_EV} AND {_DET}", "R3+R4+R5 deterministic, cloaked": f"{_rule(3)} AND {_EV} AND {_DET} AND cloaked"}),
}


def _register(name, sql):
    @query(name, sql)
    def run(spark, d):
        return getattr(O, name)(labelled_routes(spark, d))


for _name, _sql in _SQL.items():
    _register(_name, _sql)


@query("expected_check", f"""{_L}, c AS (SELECT sink_family AS measure, count(*) AS value FROM mix GROUP BY 1), e AS (SELECT sink_family AS measure, count(*) AS value FROM mix WHERE rules > 0 GROUP BY 1)
  SELECT measure, c.value AS computed, e.value AS expected, coalesce(c.value = e.value, false) AS ok FROM c FULL JOIN e USING (measure)""")
def expected_check(spark, d):
    m = O.mixed(labelled_routes(spark, d))
    by = lambda rows: rows.groupBy(O.sink_family().alias("measure")).agg(F.count(F.lit(1)).alias("value"))
    return O.check_table(by(m), by(m.where(O.rule_count() > 0)))


_MESSAGES = ("SUCCESS", "SUCCESS (fallback)", "TIMEOUT (>300s)", "FAILED (No taint path found -- clean exit)", "PARSE ERROR -> x", "ENGINE CRASH (exit=-11) -> x")


@query("pipeline_outcomes", f"""WITH m AS (SELECT {X._sql_pick(_MESSAGES, 'page_id % 6')} AS message FROM pages)
  SELECT CASE WHEN contains(message, 'SUCCESS') THEN 'SUCCESS' WHEN contains(message, 'TIMEOUT') THEN 'TIMEOUT' WHEN contains(message, 'No taint path') THEN 'NO_TAINT' WHEN contains(message, 'PARSE ERROR') THEN 'PARSE_ERROR' ELSE 'ENGINE_CRASH' END AS status, count(*) AS n FROM m GROUP BY 1""")
def pipeline_outcomes(spark, d):
    return O.pipeline_outcomes(X.pages(spark, d).select(X._pick(_MESSAGES, F.col("page_id") % 6).alias("message")))
