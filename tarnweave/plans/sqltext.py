"""DuckDB expressions and table expressions that the catalogue's SQL is put together from."""

from __future__ import annotations

import re

from .. import registries as R
from . import fixtures as X


def any_of(col: str, keywords) -> str:
    return f"regexp_matches({col}, '{'|'.join(re.escape(k) for k in keywords)}')"


def netloc(u: str) -> str:
    return f"lower(regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1))"


def base(d: str) -> str:
    return f"lower(replace({d}, 'www.', ''))"


def first_party(d: str, u: str, affiliated: bool = True) -> str:
    host, own = netloc(u), base(d)
    tests = [f"{host} = {own} OR ends_with({host}, '.' || {own})"]
    if affiliated:
        for k, v in R.AFFILIATES.items():
            each = " OR ".join(f"{host} = '{a}' OR ends_with({host}, '.{a}')" for a in v)
            tests.append(f"({own} = '{k}' AND ({each}))")
    return f"({u} <> '{R.DYNAMIC}' AND starts_with({u}, 'http') AND ({' OR '.join(tests)}))"


def tracker(u: str) -> str:
    return any_of(f"lower({u})", R.TRACKER_KEYWORDS)


def whitelist(u: str) -> str:
    return any_of(f"lower({u})", R.WHITELIST_KEYWORDS)


def cookie(u: str) -> str:
    return any_of(u, R.COOKIE_MARKS)


def unresolved(u: str) -> str:
    return f"({u} = '{R.DYNAMIC}' OR contains({u}, '{R.HOLE}'))"


def normal(u: str) -> str:
    return f"CASE WHEN {u} IS NULL OR {u} = '' OR {unresolved(u)} OR {any_of(u, ('Predicted', 'Hybrid Reconstructed', 'CNAME Cloaked'))} THEN '{R.DYNAMIC}' ELSE {u} END"


def party(d: str, u: str, t: str) -> str:
    own = first_party(d, u)
    return (
        f"CASE WHEN contains({u}, 'CNAME Cloaked') THEN '1st-Party (CNAME Cloaked)'"
        f" WHEN contains({u}, 'Hybrid Reconstructed') THEN CASE WHEN {own} THEN '1st-Party (Hybrid)' ELSE '3rd-Party (Identified)' END"
        f" WHEN {t} = 'Storage' OR {cookie(u)} THEN 'Local (Cookie/Storage)' WHEN {unresolved(u)} THEN 'Unknown (Obfuscated)'"
        f" WHEN {own} THEN '1st-Party' ELSE '3rd-Party/Unknown' END"
    )


_SHORT = "['LoadPropertyInst', 'StorePropertyInst', 'CallInst']"
INFERRED = f"""fx_named AS (SELECT * REPLACE (CASE WHEN trim(coalesce(source_name, '')) <> '' THEN source_name
    WHEN contains(sink_name, 'LoadFrameInst') THEN 'Inferred: Indirect Frame Property (DOM Obfuscated)'
    WHEN contains(sink_name, 'createElement') THEN 'Inferred: Dynamic Element Property'
    WHEN sink_name = 'document.cookie' THEN 'Inferred: Opaque Cookie Source'
    WHEN sink_name = 'sessionStorage.setItem' THEN 'Inferred: Opaque Storage Source'
    WHEN len(path_nodes) <= 2 AND len(list_filter(path_nodes, lambda x: NOT list_contains({_SHORT}, x))) = 0 THEN 'Inferred: Indirect Prop Access (2-hop)'
    ELSE 'Inferred: Unresolved Source (Engine Limit)' END AS source_name) FROM fx_routes)"""
HYBRID = f"""fx_hybrid AS (SELECT r.domain, destination_url, arg_min(l.url, l.ord) AS hybrid_url
  FROM (SELECT domain, destination_url, list_filter(string_split(destination_url, '{R.HOLE}'), lambda f: length(trim(f)) >= 2) AS parts
        FROM fx_routes WHERE contains(destination_url, '{R.HOLE}') AND NOT {cookie('destination_url')} GROUP BY ALL) r
  JOIN fx_netlog l ON r.domain = l.domain
  WHERE len(parts) > 0 AND len(list_filter(parts, lambda f: NOT contains(l.url, f))) = 0 GROUP BY ALL)"""
CLOAKED = f"""fx_cloaked AS (SELECT domain, arg_min(url, ord) AS cloaked_url FROM fx_netlog
  WHERE {first_party('domain', 'url', False)} AND {tracker(netloc('url'))} GROUP BY domain)"""
_ELIGIBLE = f"({unresolved('r.destination_url')} AND NOT {cookie('r.destination_url')})"
REWRITTEN = f"""fx_rewritten AS (SELECT r.* REPLACE (
    CASE WHEN hybrid_url IS NOT NULL THEN hybrid_url || '{R.HYBRID_NOTE}' WHEN {_ELIGIBLE} AND cloaked_url IS NOT NULL THEN cloaked_url || '{R.PREDICTED_NOTE}' ELSE r.destination_url END AS destination_url),
    CASE WHEN hybrid_url IS NOT NULL THEN hybrid_url WHEN {_ELIGIBLE} AND cloaked_url IS NOT NULL THEN cloaked_url ELSE r.destination_url END AS clean_url
  FROM fx_named r LEFT JOIN fx_hybrid h ON r.domain = h.domain AND r.destination_url = h.destination_url LEFT JOIN fx_cloaked c ON r.domain = c.domain)"""
_FOREIGN = f"{tracker('url')} AND NOT {first_party('domain', 'url')}"
TRACKERS = f"""fx_trackers AS (SELECT domain, bool_or({_FOREIGN}) AS has_tracker,
    coalesce(array_to_string(list_sort(list(DISTINCT {netloc('url')}) FILTER (WHERE {_FOREIGN})), ' | '), '') AS observed_trackers FROM fx_netlog GROUP BY domain)"""
REWRITE = f"WITH {X.BASE_SQL}, {INFERRED}, {HYBRID}, {CLOAKED}, {REWRITTEN}, {TRACKERS}"

EXFIL = "sink_type IN ('Network', 'Navigation')"
_D = "destination_url"
_LISTED, _OWN, _VAGUE = whitelist(_D), first_party("domain", _D), unresolved(_D)
T4 = f"""t4 AS (SELECT *, CASE WHEN {_LISTED} AND {_OWN} THEN NULL WHEN {_VAGUE} THEN '{R.R4_DYNAMIC}' WHEN {_LISTED} THEN '{R.R4_CAMOUFLAGE}' ELSE '{R.R4}' END AS label
  FROM fx_rewritten WHERE contains(sink_name, '{R.EVASION}') AND {EXFIL})"""
T1 = f"""t1 AS (SELECT *, '{R.R1}' AS label FROM fx_rewritten r WHERE {EXFIL} AND len(path_nodes) > 0
  AND NOT list_has_any(path_nodes, ['StoreFrameInst', 'PhiInst', 'LoadFrameInst'])
  AND NOT EXISTS (SELECT 1 FROM t4 WHERE t4.label IS NOT NULL AND t4.domain = r.domain AND t4.source_name = r.source_name AND t4.sink_name = r.sink_name AND t4.destination_url = r.destination_url))"""
T2 = f"""t2 AS (SELECT *, '{R.R2}' AS label FROM fx_rewritten WHERE {EXFIL} AND (domain, source_name) IN
  (SELECT (domain, source_name) FROM fx_rewritten GROUP BY domain, source_name HAVING bool_or({any_of('sink_name', R.RENDER_SINKS)}) AND bool_or({EXFIL})))"""
T3 = f"""t3 AS (SELECT *, '{R.R3}' AS label FROM fx_rewritten WHERE trigger_context = 'AUTONOMOUS' AND sink_type IN ('Network', 'Navigation', 'Storage')
  AND domain IN (SELECT domain FROM fx_rewritten GROUP BY domain HAVING bool_or(trigger_context = 'EVENT_DRIVEN') AND bool_or(trigger_context = 'AUTONOMOUS')))"""
_DEVICE = "(starts_with(source_name, 'screen.') OR starts_with(source_name, 'navigator.'))"
T5 = f"""t5 AS (SELECT r.*, CASE WHEN {tracker(_D)} THEN '{R.R5_CERTAIN}' WHEN {_VAGUE} AND has_tracker THEN '{R.R5_LIKELY}' END AS label
  FROM fx_rewritten r LEFT JOIN fx_trackers t ON r.domain = t.domain WHERE {EXFIL} AND NOT {_DEVICE}
  AND NOT ({first_party('r.domain', _D)} AND {_LISTED}) AND {any_of('source_name', R.SENSITIVE_SOURCES)})"""
T6 = f"t6 AS (SELECT *, '{R.R5_FINGERPRINT}' AS label FROM fx_rewritten WHERE {EXFIL} AND {_DEVICE} AND NOT {_OWN})"


def _threat(t: str, n: int, party_sql: str) -> str:
    return f"SELECT {t}.domain, {n} AS grp, route_id, label, trigger_context, source_name AS source, sink_name AS sink, destination_url AS destination, {party_sql} AS party FROM {t} WHERE label IS NOT NULL"


_PLAIN = party("domain", _D, "sink_type")
THREATS = f"""threats AS ({_threat('t4', 0, _PLAIN)} UNION ALL {_threat('t1', 1, "'Unknown (WCC Isolated)'")} UNION ALL {_threat('t2', 2, "'3rd-Party (Parasitic)'")}
  UNION ALL {_threat('t3', 3, _PLAIN)} UNION ALL {_threat('t5', 4, f"CASE WHEN label = '{R.R5_CERTAIN}' THEN 'Confirmed 3rd-Party Tracker (Semantic)' ELSE '3rd-Party (Domain-level Evidence)' END")}
  UNION ALL {_threat('t6', 5, "'3rd-Party/Unknown'")})"""
_NEW = "CASE WHEN contains(a.label, x.label) THEN a.label ELSE a.label || ' | ' || x.label END"
_NOW = f"string_split({_NEW}, ' | ')"
_LABEL = f"""CASE WHEN list_contains({_NOW}, '{R.R4}') AND list_contains({_NOW}, '{R.R4_DYNAMIC}')
  THEN array_to_string(list_sort(list_distinct(list_filter({_NOW}, lambda v: v <> '{R.R4_DYNAMIC}'))), ' | ') ELSE {_NEW} END"""
_BETTER = f"(a.destination = '{R.DYNAMIC}' AND x.destination <> '{R.DYNAMIC}')"
MERGED = f"""merged AS (SELECT g.domain, m.label AS threat_type, trigger_context, source, sink, m.destination AS destination, m.party AS party,
    CASE WHEN coalesce(observed_trackers, '') = '' THEN 'None' ELSE observed_trackers END AS observed_trackers
  FROM (SELECT domain, source, sink, arg_min(trigger_context, grp * 100000000 + route_id) AS trigger_context,
      list_reduce(list({{'label': label, 'destination': destination, 'party': party, 'domain': domain, 'sink': sink}} ORDER BY grp, route_id), lambda a, x: {{
        'label': {_LABEL}, 'destination': CASE WHEN {_BETTER} THEN x.destination ELSE a.destination END,
        'party': CASE WHEN {_BETTER} AND NOT contains(a.party, 'WCC Isolated') AND NOT contains(a.party, 'Confirmed 3rd-Party') THEN {party('x.domain', 'x.destination', 'x.sink')} ELSE a.party END,
        'domain': x.domain, 'sink': x.sink}}) AS m
    FROM threats GROUP BY domain, source, sink, {normal('destination')}) g LEFT JOIN fx_trackers t ON g.domain = t.domain)"""


def _numbers(col: str) -> str:
    cases = " ".join(f"WHEN '{label}' THEN {n}" for label, n, _ in R.LABELS)
    return f"list_sort(list_distinct(list_transform(string_split({col}, ' | '), lambda v: CASE v {cases} END)))"


SCORED = f"""scored AS (SELECT * REPLACE (CASE WHEN contains(threat_type, '{R.R1}') AND contains(party, 'WCC Isolated') THEN
      CASE WHEN contains(destination, 'CNAME Cloaked') THEN '1st-Party (CNAME Cloaked)'
        WHEN contains(destination, 'Hybrid Reconstructed') AND {first_party('domain', 'destination')} THEN '1st-Party (Hybrid)'
        WHEN contains(threat_type, 'Semantic_CrossValidation (Rule 5)') OR contains(destination, 'Predicted 3rd-Party') OR contains(destination, 'Hybrid Reconstructed') THEN '3rd-Party (WCC Isolated)'
        ELSE party END ELSE party END AS party),
    greatest(1, least(5, least(3, len({_numbers('threat_type')})) + (trigger_context = 'AUTONOMOUS')::INT + {any_of('destination', ('Predicted 3rd-Party', 'Hybrid Reconstructed', 'CNAME Cloaked'))}::INT)) AS confidence,
    {_numbers('threat_type')}[1] AS min_rule FROM merged)"""
ALL_THREATS = f"{REWRITE}, {T4}, {T1}, {T2}, {T3}, {T5}, {T6}, {THREATS}, {MERGED}, {SCORED}"
NUMBERS = _numbers
