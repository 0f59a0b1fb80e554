"""Catalogue: rewriting, rules, merging and scoring of routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import registries as R
from ..functions import urls as U
from ..operators import rules as O
from . import fixtures as X
from . import sqltext as S
from .registry import query

_D = "destination_url"


def _rewritten(spark, d):
    return O.rewrite_routes(X.routes(spark, d), X.netlog(spark, d))


def _classified(spark, d):
    return O.classify(X.routes(spark, d), X.netlog(spark, d))


@query("url_list", f"WITH {X.PAGES_SQL} SELECT page_id, domain, CASE WHEN regexp_matches(domain, '^(?i)https?:') THEN domain ELSE 'https://' || domain END AS target FROM fx_pages")
def url_list(spark, d):
    return X.pages(spark, d).select("page_id", "domain", F.when(F.col("domain").rlike("(?i)^https?:"), F.col("domain")).otherwise(F.concat(F.lit("https://"), "domain")).alias("target"))


@query("network_log", f"WITH {X.PAGES_SQL}, {X.NETLOG_SQL} SELECT domain, min(ord) AS ord, url FROM fx_netlog WHERE starts_with(url, 'http') GROUP BY domain, url")
def network_log(spark, d):
    return X.netlog(spark, d).where(F.startswith("url", F.lit("http"))).groupBy("domain", "url").agg(F.min("ord").alias("ord"))


@query("url_netloc", f"WITH {X.BASE_SQL} SELECT domain, route_id, {S.netloc(_D)} AS netloc, {S.base('domain')} AS base FROM fx_routes")
def url_netloc(spark, d):
    return X.routes(spark, d).select("domain", "route_id", U.netloc(F.col(_D)).alias("netloc"), U.bare_domain(F.col("domain")).alias("base"))


@query("is_first_party", f"WITH {X.BASE_SQL} SELECT domain, route_id, {S.first_party('domain', _D)} AS own, {S.first_party('domain', _D, False)} AS own_strict FROM fx_routes")
def is_first_party(spark, d):
    r = X.routes(spark, d)
    return r.select("domain", "route_id", U.is_first_party(F.col("domain"), F.col(_D)).alias("own"), U.is_first_party(F.col("domain"), F.col(_D), False).alias("own_strict"))


@query("tracker_keyword", f"WITH {X.BASE_SQL} SELECT domain, route_id, {S.tracker(_D)} AS tracker, {S.whitelist(_D)} AS listed, {S.cookie(_D)} AS cookie FROM fx_routes")
def tracker_keyword(spark, d):
    c = F.col(_D)
    return X.routes(spark, d).select("domain", "route_id", U.has_tracker(c).alias("tracker"), U.has_whitelist(c).alias("listed"), U.is_cookie(c).alias("cookie"))


@query("source_predicates", f"""WITH {X.BASE_SQL} SELECT domain, route_id, {S.any_of('source_name', R.SENSITIVE_SOURCES)} AS sensitive,
  starts_with(source_name, 'screen.') OR starts_with(source_name, 'navigator.') AS device, {S.EXFIL} AS exfil, contains(sink_name, '{R.EVASION}') AS evasive,
  len(path_nodes) > 0 AND NOT list_has_any(path_nodes, ['StoreFrameInst', 'PhiInst', 'LoadFrameInst']) AS no_ui FROM fx_routes""")
def source_predicates(spark, d):
    quiet = (F.size("path_nodes") > 0) & ~F.arrays_overlap("path_nodes", F.array(*map(F.lit, R.UI_NODES)))
    device = F.startswith("source_name", F.lit("screen.")) | F.startswith("source_name", F.lit("navigator."))
    return X.routes(spark, d).select("domain", "route_id", U.any_of(F.col("source_name"), R.SENSITIVE_SOURCES).alias("sensitive"), device.alias("device"), F.col("sink_type").isin(*R.EXFIL_SINKS).alias("exfil"), F.contains("sink_name", F.lit(R.EVASION)).alias("evasive"), quiet.alias("no_ui"))


@query("party_check", f"WITH {X.BASE_SQL} SELECT {S.party('domain', _D, 'sink_type')} AS party, count(*) AS n FROM fx_routes GROUP BY 1")
def party_check(spark, d):
    return X.routes(spark, d).groupBy(U.party(F.col("domain"), F.col(_D), F.col("sink_type")).alias("party")).agg(F.count(F.lit(1)).alias("n"))


@query("dest_normalise", f"WITH {X.BASE_SQL} SELECT {S.normal(_D)} AS dest, count(*) AS n FROM fx_routes GROUP BY 1")
def dest_normalise(spark, d):
    return X.routes(spark, d).groupBy(U.normal_destination(F.col(_D)).alias("dest")).agg(F.count(F.lit(1)).alias("n"))


@query("source_inference", f"WITH {X.BASE_SQL}, {S.INFERRED} SELECT domain, route_id, source_name FROM fx_named")
def source_inference(spark, d):
    return O.infer_sources(X.routes(spark, d)).select("domain", "route_id", "source_name")


@query("hybrid_reconstruct", f"WITH {X.BASE_SQL}, {S.HYBRID} SELECT domain, destination_url, hybrid_url FROM fx_hybrid")
def hybrid_reconstruct(spark, d):
    return O.hybrid_targets(X.routes(spark, d), X.netlog(spark, d))


@query("cname_scan", f"WITH {X.BASE_SQL}, {S.CLOAKED} SELECT domain, cloaked_url FROM fx_cloaked")
def cname_scan(spark, d):
    return O.cloaked_targets(X.netlog(spark, d))


@query("rewritten_routes", f"{S.REWRITE} SELECT domain, route_id, source_name, destination_url, clean_url FROM fx_rewritten")
def rewritten_routes(spark, d):
    return _rewritten(spark, d).select("domain", "route_id", "source_name", "destination_url", "clean_url")


@query("domain_has_tracker", f"WITH {X.BASE_SQL}, {S.TRACKERS} SELECT domain, has_tracker FROM fx_trackers")
def domain_has_tracker(spark, d):
    return O.tracker_domains(X.netlog(spark, d)).select("domain", "has_tracker")


@query("observed_trackers", f"WITH {X.BASE_SQL}, {S.TRACKERS} SELECT domain, observed_trackers FROM fx_trackers")
def observed_trackers(spark, d):
    return O.tracker_domains(X.netlog(spark, d)).select("domain", "observed_trackers")


_COLS = ["domain", "route_id", "source_name", "sink_name", "destination_url", "label"]
_LIST = ", ".join(_COLS)


@query("r4_dom_evasion", f"{S.REWRITE}, {S.T4} SELECT {_LIST} FROM t4 WHERE label IS NOT NULL")
def r4_dom_evasion(spark, d):
    return O.evasion(_rewritten(spark, d)).select(*_COLS)


@query("r1_isolated", f"{S.REWRITE}, {S.T4}, {S.T1} SELECT {_LIST} FROM t1")
def r1_isolated(spark, d):
    return O.isolated_only(_rewritten(spark, d)).select(*_COLS)


@query("r2_parasitic", f"{S.REWRITE}, {S.T2} SELECT {_LIST} FROM t2")
def r2_parasitic(spark, d):
    return O.parasitic(_rewritten(spark, d)).select(*_COLS)


@query("r3_dual_context", f"{S.REWRITE}, {S.T3} SELECT {_LIST} FROM t3")
def r3_dual_context(spark, d):
    return O.dual_context(_rewritten(spark, d)).select(*_COLS)


@query("r5_semantic", f"{S.REWRITE}, {S.T5.replace('SELECT r.*,', 'SELECT r.*,')} SELECT {_LIST} FROM t5 WHERE label IS NOT NULL")
def r5_semantic(spark, d):
    return O.semantic(_rewritten(spark, d), O.tracker_domains(X.netlog(spark, d))).select(*_COLS)


@query("r5_fingerprint", f"{S.REWRITE}, {S.T6} SELECT {_LIST} FROM t6")
def r5_fingerprint(spark, d):
    return O.fingerprinting(_rewritten(spark, d)).select(*_COLS)


_BY_NAME = {"evasion": "t4", "isolated_exfiltration": "t1", "parasitic_branch": "t2", "dual_execution_context": "t3", "semantic_crossvalidation": "t5", "fingerprinting_leak": "t6"}


@query("rules_by_name", f"{S.REWRITE}, {S.T4}, {S.T1}, {S.T2}, {S.T3}, {S.T5}, {S.T6} " + " UNION ALL ".join(f"SELECT domain, route_id, '{rule}' AS rule, label FROM {t} WHERE label IS NOT NULL" for rule, t in _BY_NAME.items()))
def rules_by_name(spark, d):
    from ..operators.common import checkpoint

    return O.run_rules(checkpoint(_rewritten(spark, d)), X.netlog(spark, d))


@query("merge_threats", f"{S.ALL_THREATS} SELECT domain, threat_type, trigger_context, source, sink, destination, observed_trackers, party FROM merged")
def merge_threats(spark, d):
    return O.merge_threats(O.threats(_rewritten(spark, d), X.netlog(spark, d)))


@query("confidence_score", f"{S.ALL_THREATS} SELECT domain, source, sink, destination, threat_type, confidence, min_rule FROM scored")
def confidence_score(spark, d):
    return _classified(spark, d).select("domain", "source", "sink", "destination", "threat_type", "confidence", "min_rule")


@query("party_refine", f"{S.ALL_THREATS} SELECT domain, source, sink, destination, party FROM scored")
def party_refine(spark, d):
    return _classified(spark, d).select("domain", "source", "sink", "destination", "party")


_STAT = " ".join(f"WHEN '{label}' THEN '{stat}'" for label, _, stat in R.LABELS)


@query("final_stats", f"""{S.ALL_THREATS} SELECT statistic, count(*) AS cases FROM (SELECT unnest(list_distinct(list_transform(string_split(threat_type, ' | '), lambda v: CASE v {_STAT} END))) AS statistic FROM scored) GROUP BY 1
  UNION ALL SELECT 'total_malicious', count(DISTINCT domain) FROM scored""")
def final_stats(spark, d):
    return O.final_stats(_classified(spark, d))


@query("context_histogram", f"""WITH {X.BASE_SQL} SELECT domain, count(*) FILTER (WHERE trigger_context = 'AUTONOMOUS') AS autonomous, count(*) FILTER (WHERE trigger_context = 'EVENT_DRIVEN') AS event_driven,
  CASE WHEN bool_or(trigger_context = 'AUTONOMOUS') AND bool_or(trigger_context = 'EVENT_DRIVEN') THEN 'Mixed (Dual Context)' ELSE 'Single Context' END AS context FROM fx_routes GROUP BY domain""")
def context_histogram(spark, d):
    return O.context_histogram(X.routes(spark, d))


#: Functions that events call, of each site: a number from its pages, none for every third page.
_HANDLERS = "fx_handlers AS (SELECT domain, sum(page_id % 3)::BIGINT AS event_driven_functions FROM fx_pages WHERE page_id % 5 < 3 GROUP BY domain)"


def _handlers(spark, d):
    return X.pages(spark, d).where("page_id % 5 < 3").groupBy("domain").agg(F.sum(F.col("page_id") % 3).alias("event_driven_functions"))


@query("context_handlers", f"""WITH {X.BASE_SQL}, {_HANDLERS}, c AS (SELECT domain, count(*) FILTER (WHERE trigger_context = 'AUTONOMOUS') AS a, count(*) FILTER (WHERE trigger_context = 'EVENT_DRIVEN') AS e, count(*) AS n FROM fx_routes GROUP BY domain)
  SELECT domain, coalesce(a, 0) AS autonomous, coalesce(e, 0) AS event_driven, coalesce(n - a - e, 0) AS unknown, coalesce(event_driven_functions, 0) AS event_driven_functions, CASE WHEN a > 0 AND (e > 0 OR event_driven_functions > 0) THEN 'Mixed (Dual Context)' ELSE 'Single Context' END AS context FROM c FULL JOIN fx_handlers USING (domain)""")
def context_handlers(spark, d):
    return O.context_histogram(X.routes(spark, d), _handlers(spark, d))


@query("missing_logs", f"WITH {X.BASE_SQL} SELECT domain, 'network log not found for ' || domain AS warning FROM (SELECT DISTINCT domain FROM fx_routes WHERE domain NOT IN (SELECT domain FROM fx_netlog WHERE length(url) % 4 = 0))")
def missing_logs(spark, d):
    # the log of a site with no URL of such a length counts as lost
    return O.missing_logs(X.routes(spark, d), X.netlog(spark, d).where(F.length("url") % 4 == 0))


@query("domain_rules", f"{S.ALL_THREATS} SELECT domain, string_agg('R' || n, ',' ORDER BY n) AS rules FROM (SELECT DISTINCT domain, unnest({S.NUMBERS('threat_type')}) AS n FROM scored) GROUP BY domain")
def domain_rules(spark, d):
    return O.domain_rules(_classified(spark, d))


_CASES = " ".join(f"WHEN '{label}' THEN {n}" for label, n, _ in R.LABELS)


@query("domain_summary", f"""{S.ALL_THREATS}, n AS (SELECT *, list_transform(string_split(threat_type, ' | '), lambda v: CASE v {_CASES} END) AS nums FROM scored)
  SELECT domain, {', '.join(f'sum(len(list_filter(nums, lambda v: v = {k})))::BIGINT AS rule_{k}' for k in range(1, 6))}, count(*) AS total_routes, max(confidence) AS max_confidence, bool_or(contains(party, '3rd-Party')) AS third_party FROM n GROUP BY domain""")
def domain_summary(spark, d):
    return O.domain_summary(_classified(spark, d))


@query("threat_order", f"{S.ALL_THREATS} SELECT row_number() OVER (ORDER BY min_rule, domain, source, sink, destination)::INT AS position, domain, source, sink FROM scored")
def threat_order(spark, d):
    return O.with_order(_classified(spark, d)).select("position", "domain", "source", "sink")
