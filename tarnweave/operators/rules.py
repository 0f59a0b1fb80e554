"""Route rewriting and the five rule families.

routes: domain, route_id, source_name, sink_name, sink_type, trigger_context, destination_url,
path_nodes, path_length. netlog: domain, ord, url. Everything is keyed by domain; a domain's
facts (contexts, trackers, the cloaked target) are aggregated first and joined, so a hot domain
is never gathered in one row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import registries as R
from .common import checkpoint, numbered
from ..functions import urls as U


def inferred_source(sink: Column, nodes: Column, length: Column) -> Column:
    """A label for a source that the analysis could not name."""
    short = (length <= 2) & (F.size(F.array_except(nodes, F.array(*map(F.lit, R.SHORT_PATH_NODES)))) == 0)
    return (
        F.when(F.contains(sink, F.lit("LoadFrameInst")), "Inferred: Indirect Frame Property (DOM Obfuscated)")
        .when(F.contains(sink, F.lit("createElement")), "Inferred: Dynamic Element Property")
        .when(sink == "document.cookie", "Inferred: Opaque Cookie Source")
        .when(sink == "sessionStorage.setItem", "Inferred: Opaque Storage Source")
        .when(short, "Inferred: Indirect Prop Access (2-hop)")
        .otherwise("Inferred: Unresolved Source (Engine Limit)")
    )


def infer_sources(routes: DataFrame) -> DataFrame:
    blank = F.trim(F.coalesce("source_name", F.lit(""))) == ""
    return routes.withColumn("source_name", F.when(blank, inferred_source(F.col("sink_name"), F.col("path_nodes"), F.col("path_length"))).otherwise(F.col("source_name")))


def fragments(url: Column) -> Column:
    """The constant parts of a destination with holes, those of two letters or more."""
    return F.filter(F.split(url, r"\{VAR\}"), lambda f: F.length(F.trim(f)) >= 2)


#: Letters of a gram, and of one of a destination whose parts are all shorter; URLs of one domain that are all tried for each destination.
GRAM, SHORT_GRAM, URLS = 6, 2, 1 << 10


def _grams(text: Column, size: Column) -> Column:
    return F.when(F.length(text) >= size, F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substr(text, i, size))).otherwise(F.array().cast("array<string>"))


def candidates(open_: DataFrame, urls: DataFrame) -> DataFrame:
    """domain, destination_url, parts, url, ord: the URLs of a domain that have the rarest gram of a destination's parts. open_: domain,
    destination_url, parts; urls: domain, url, ord, a URL once.

    An inverted index of the grams that are asked: a gram that no URL has rules the destination out, and of the others the
    one in the fewest URLs is looked up. Grams are joined by hash; a collision gives a candidate that does not hold.
    """
    size = F.when(F.exists("parts", lambda f: F.length(f) >= GRAM), GRAM).otherwise(SHORT_GRAM)
    open_ = open_.withColumn("size", size)
    key = lambda gram: F.xxhash64("domain", "size", gram).alias("h")
    own = F.array_distinct(F.flatten(F.transform("parts", lambda f: _grams(f, F.col("size")))))
    asked = open_.select("domain", "destination_url", "size", F.explode(own).alias("gram")).select("domain", "destination_url", key("gram"))
    urls = urls.withColumn("u", F.xxhash64("domain", "url"))
    held = urls.join(open_.select("domain", "size").distinct(), "domain").select("domain", "size", "u", F.explode(F.array_distinct(_grams(F.col("url"), F.col("size")))).alias("gram"))
    held = held.select(key("gram"), "u").join(asked.select("h").distinct(), "h", "left_semi")
    found = asked.join(held.groupBy("h").agg(F.count(F.lit(1)).alias("n")), "h", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = found.groupBy("domain", "destination_url").agg(F.min_by("h", F.struct("n", "h")).alias("h"), F.min("n").alias("n")).where("n > 0").drop("n")
    return rarest.join(held, "h").drop("h").join(urls, ["domain", "u"]).drop("u").join(open_.drop("size"), ["domain", "destination_url"])


def hybrid_targets(routes: DataFrame, netlog: DataFrame, tried: int = URLS) -> DataFrame:
    """For each distinct destination with holes of a domain: the first logged URL with all its parts. Where a domain has more
    than `tried` logged URLs, candidates are looked up by rare grams; else all of them are tried for each destination."""
    open_ = routes.where(F.contains("destination_url", F.lit(R.HOLE)) & ~U.is_cookie(F.col("destination_url")))
    open_ = open_.select("domain", "destination_url").distinct().withColumn("parts", fragments(F.col("destination_url"))).where(F.size("parts") > 0)
    most = netlog.groupBy("domain").count().agg(F.max("count")).first()[0] or 0
    urls = netlog.groupBy("domain", "url").agg(F.min("ord").alias("ord"))
    met = candidates(open_, urls) if most > tried else open_.join(netlog, "domain")
    return met.where(F.forall("parts", lambda f: F.contains("url", f))).groupBy("domain", "destination_url").agg(F.min_by("url", "ord").alias("hybrid_url"))


def cloaked_targets(netlog: DataFrame) -> DataFrame:
    """For each domain: the first logged URL on its own hosts whose host names a tracker."""
    own = U.is_first_party(F.col("domain"), F.col("url"), affiliated=False)
    return netlog.where(own & U.has_tracker(U.netloc(F.col("url")))).groupBy("domain").agg(F.min_by("url", "ord").alias("cloaked_url"))


def rewrite_routes(routes: DataFrame, netlog: DataFrame) -> DataFrame:
    """Sources inferred, destinations reconstructed; clean_url is the destination without notes."""
    rows = infer_sources(routes)
    dest = F.col("destination_url")
    eligible = U.is_unresolved(dest) & ~U.is_cookie(dest)
    rows = rows.join(hybrid_targets(rows, netlog), ["domain", "destination_url"], "left").join(cloaked_targets(netlog), "domain", "left")
    note = F.when(F.col("hybrid_url").isNotNull(), F.concat("hybrid_url", F.lit(R.HYBRID_NOTE))).when(eligible & F.col("cloaked_url").isNotNull(), F.concat("cloaked_url", F.lit(R.PREDICTED_NOTE)))
    clean = F.coalesce("hybrid_url", F.when(eligible, F.col("cloaked_url")), dest)
    return rows.withColumn("clean_url", clean).withColumn("destination_url", F.coalesce(note, dest)).drop("hybrid_url", "cloaked_url")


def tracker_domains(netlog: DataFrame) -> DataFrame:
    """domain, has_tracker, observed_trackers: third-party tracker hosts in a site's log, sorted."""
    foreign = U.has_tracker(F.col("url")) & ~U.is_first_party(F.col("domain"), F.col("url"))
    hosts = F.collect_set(F.when(foreign, U.netloc(F.col("url"))))
    return netlog.groupBy("domain").agg(F.max(foreign).alias("has_tracker"), F.array_join(F.array_sort(hosts), " | ").alias("observed_trackers"))


def _exfil(col: str = "sink_type") -> Column:
    return F.col(col).isin(*R.EXFIL_SINKS)


def evasion_label() -> Column:
    """Rule 4: null if the route does not break it."""
    dest = F.col("destination_url")
    own, listed, vague = U.is_first_party(F.col("domain"), dest), U.has_whitelist(dest), U.is_unresolved(dest)
    label = F.when(listed & own, F.lit(None)).when(vague, R.R4_DYNAMIC).when(listed, R.R4_CAMOUFLAGE).otherwise(R.R4)
    return F.when(F.contains("sink_name", F.lit(R.EVASION)) & _exfil(), label)


def evasion(routes: DataFrame) -> DataFrame:
    return routes.withColumn("label", evasion_label()).where("label is not null")


def _quiet() -> Column:
    return (F.size("path_nodes") > 0) & ~F.arrays_overlap("path_nodes", F.array(*map(F.lit, R.UI_NODES)))


def _device() -> Column:
    return reduce(lambda a, b: a | b, [F.startswith("source_name", F.lit(p)) for p in R.FINGERPRINT_PREFIXES])


def _render() -> Column:
    return U.any_of(F.col("sink_name"), R.RENDER_SINKS) | (F.col("sink_type") == "Render")


def _named_source() -> Column:
    return F.when(F.coalesce("source_name", F.lit("")) == "", "[Dynamic_Source]").otherwise(F.col("source_name"))


def isolated(routes: DataFrame) -> DataFrame:
    """Rule 1, before rows that rule 4 names already are taken out."""
    return routes.where(_exfil() & _quiet()).withColumn("label", F.lit(R.R1))


def isolated_only(routes: DataFrame) -> DataFrame:
    """Rule 1 without routes whose domain, source, sink and destination rule 4 names. Rule 4 reads
    no more than these of an exfiltrating route, so a route can tell by itself."""
    return isolated(routes).where(evasion_label().isNull())


def _shared_sources(routes: DataFrame) -> DataFrame:
    """domain, __source of sources that feed a rendering and an exfiltrating sink."""
    facts = routes.groupBy("domain", _named_source().alias("__source")).agg(F.max(_render()).alias("r"), F.max(_exfil()).alias("n"))
    return facts.where("r and n").select("domain", "__source")


def parasitic(routes: DataFrame) -> DataFrame:
    """Rule 2: a source that feeds both a rendering and an exfiltrating sink of its domain."""
    rows = routes.where(_exfil()).withColumn("__source", _named_source())
    return rows.join(_shared_sources(routes), ["domain", "__source"], "left_semi").drop("__source").withColumn("label", F.lit(R.R2))


def _mixed_domains(routes: DataFrame, handlers: DataFrame | None) -> DataFrame:
    facts = routes.groupBy("domain").agg(F.max(F.col("trigger_context") == "EVENT_DRIVEN").alias("event"), F.max(F.col("trigger_context") == "AUTONOMOUS").alias("auto"))
    if handlers is not None:
        facts = facts.join(handlers, "domain", "left").withColumn("event", F.col("event") | (F.coalesce("event_driven_functions", F.lit(0)) > 0))
    return facts.where("event and auto").select("domain")


def _self_starting() -> Column:
    return (F.col("trigger_context") == "AUTONOMOUS") & (_exfil() | (F.col("sink_type") == "Storage"))


def dual_context(routes: DataFrame, handlers: DataFrame | None = None) -> DataFrame:
    """Rule 3: self-starting routes of domains that also have event-driven code. handlers:
    domain, event_driven_functions."""
    return routes.where(_self_starting()).join(_mixed_domains(routes, handlers), "domain", "left_semi").withColumn("label", F.lit(R.R3))


def _semantic_label(has_tracker: Column) -> Column:
    dest = F.col("destination_url")
    open_ = _exfil() & ~_device() & ~(U.is_first_party(F.col("domain"), dest) & U.has_whitelist(dest)) & U.any_of(F.col("source_name"), R.SENSITIVE_SOURCES)
    return F.when(open_, F.when(U.has_tracker(dest), R.R5_CERTAIN).when(U.is_unresolved(dest) & F.coalesce(has_tracker, F.lit(False)), R.R5_LIKELY))


def semantic(routes: DataFrame, trackers: DataFrame) -> DataFrame:
    """Rule 5, destinations: trackers: domain, has_tracker."""
    rows = routes.join(trackers.select("domain", "has_tracker"), "domain", "left")
    return rows.withColumn("label", _semantic_label(F.col("has_tracker"))).where("label is not null").drop("has_tracker")


def _leak() -> Column:
    return _exfil() & _device() & ~U.is_first_party(F.col("domain"), F.col("destination_url"))


def fingerprinting(routes: DataFrame) -> DataFrame:
    """Rule 5, device attributes that leave the first party."""
    return routes.where(_leak()).withColumn("label", F.lit(R.R5_FINGERPRINT))


#: Rules by name: functions of rewritten routes and the network log, which give routes with a label. More can be added.
RULES: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "evasion": lambda routes, netlog: evasion(routes),
    "isolated_exfiltration": lambda routes, netlog: isolated_only(routes),
    "parasitic_branch": lambda routes, netlog: parasitic(routes),
    "dual_execution_context": lambda routes, netlog: dual_context(routes),
    "semantic_crossvalidation": lambda routes, netlog: semantic(routes, tracker_domains(netlog)),
    "fingerprinting_leak": lambda routes, netlog: fingerprinting(routes),
}


def run_rules(routes: DataFrame, netlog: DataFrame, names: list[str] | None = None) -> DataFrame:
    """domain, route_id, rule, label of the named rules, or of all."""
    out = None
    for name in names or list(RULES):
        if name not in RULES:
            raise KeyError(f"no rule {name!r}; there are {', '.join(RULES)}")
        part = RULES[name](routes, netlog).select("domain", "route_id", F.lit(name).alias("rule"), "label")
        out = part if out is None else out.unionByName(part)
    return out


def threats(routes: DataFrame, netlog: DataFrame, handlers: DataFrame | None = None) -> DataFrame:
    """All threat rows of rewritten routes: domain, seq, label, trigger_context, source, sink,
    destination, observed_trackers, party. seq orders the rows of a domain.

    The facts of domains and of their sources are joined once; each route then names all its
    labels in one pass.
    """
    found = tracker_domains(netlog)
    rows = routes.withColumn("__source", _named_source())
    rows = rows.join(_shared_sources(routes).withColumn("__shared", F.lit(True)), ["domain", "__source"], "left")
    rows = rows.join(_mixed_domains(routes, handlers).withColumn("__mixed", F.lit(True)), "domain", "left").join(found, "domain", "left")
    rows = rows.withColumns({"__r4": evasion_label(), "__r5": _semantic_label(F.col("has_tracker")), "__party": U.party(F.col("domain"), F.col("destination_url"), F.col("sink_type"))})

    def item(group: int, test: Column, label: Column, party: Column) -> Column:
        return F.when(test, F.struct(F.lit(group).alias("rule_group"), label.alias("label"), party.alias("party")))

    plain, r4, r5 = F.col("__party"), F.col("__r4"), F.col("__r5")
    items = F.array(
        item(0, r4.isNotNull(), r4, plain),
        item(1, _exfil() & _quiet() & r4.isNull(), F.lit(R.R1), F.lit("Unknown (WCC Isolated)")),
        item(2, _exfil() & F.col("__shared"), F.lit(R.R2), F.lit("3rd-Party (Parasitic)")),
        item(3, _self_starting() & F.col("__mixed"), F.lit(R.R3), plain),
        item(4, r5.isNotNull(), r5, F.when(r5 == R.R5_CERTAIN, "Confirmed 3rd-Party Tracker (Semantic)").otherwise("3rd-Party (Domain-level Evidence)")),
        item(5, _leak(), F.lit(R.R5_FINGERPRINT), F.lit("3rd-Party/Unknown")),
    )
    rows = rows.withColumn("x", F.explode(F.array_compact(items)))
    return rows.select(
        "domain", F.struct(F.col("x.rule_group"), F.col("route_id")).alias("seq"), "x.label", "trigger_context",
        F.when(F.coalesce("source_name", F.lit("")) == "", "Unknown").otherwise(F.col("source_name")).alias("source"),
        F.col("sink_name").alias("sink"), F.coalesce("destination_url", F.lit(R.DYNAMIC)).alias("destination"),
        F.when(F.coalesce("observed_trackers", F.lit("")) == "", "None").otherwise(F.col("observed_trackers")).alias("observed_trackers"), F.col("x.party").alias("party"),
    )


def with_key(rows: DataFrame) -> DataFrame:
    """rows with the normal destination by which threats are merged."""
    return rows.withColumn("key_dest", U.normal_destination(F.col("destination")))


def merge_threats(rows: DataFrame) -> DataFrame:
    """One row for each (domain, source, sink, normal destination), folded in seq order."""
    # a label, party and destination of the same text add nothing when folded again: keep the first of each
    rows = with_key(rows)
    kind = rows.schema["seq"].dataType
    places = [F.col("seq")[f] for f in kind.names] if isinstance(kind, StructType) else [F.col("seq")]
    # first the least last place beside equal other columns, as a number needs no sorting of all findings; little is left for the rest
    *outer, last = (p.alias(f"__p{n}") for n, p in enumerate(places))
    keys = ["domain", "source", "sink", "key_dest", "label", "destination", "party"]
    names = [f"__p{n}" for n in range(len(places))]
    rows = rows.select(*keys, "trigger_context", "observed_trackers", *outer, last).groupBy(*keys, "trigger_context", "observed_trackers", *names[:-1]).agg(F.min(names[-1]).alias(names[-1]))
    rows = rows.groupBy(*keys).agg(F.min(F.struct(F.struct(*names).alias("seq"), "trigger_context", "observed_trackers")).alias("first"))
    return fold_threats(rows).drop("key_dest")


def fold_threats(rows: DataFrame) -> DataFrame:
    """The merged row, with its key_dest, of what each threat is made of: a row for each label, destination and party, with the first
    finding of it (first: seq, trigger_context, observed_trackers)."""
    item = F.struct(F.col("first.seq").alias("seq"), "label", "destination", "party", F.col("first.trigger_context").alias("trigger_context"), F.col("first.observed_trackers").alias("observed_trackers"))
    groups = rows.groupBy("domain", "source", "sink", "key_dest").agg(F.array_sort(F.collect_list(item)).alias("all"))
    text = "struct<label:string,destination:string,party:string>"

    def fold(acc, x):
        label = F.when(F.contains(acc["label"], x["label"]), acc["label"]).otherwise(F.concat(acc["label"], F.lit(" | "), x["label"]))
        now = F.transform(F.split(label, r" \| "), F.trim)
        clash = F.array_contains(now, R.R4) & F.array_contains(now, R.R4_DYNAMIC)
        label = F.when(clash, F.array_join(F.array_sort(F.array_distinct(F.filter(now, lambda v: v != R.R4_DYNAMIC))), " | ")).otherwise(label)
        better = (acc["destination"] == R.DYNAMIC) & (x["destination"] != R.DYNAMIC)
        fixed = F.contains(acc["party"], F.lit("WCC Isolated")) | F.contains(acc["party"], F.lit("Confirmed 3rd-Party"))
        # the sink's name, not its type, is what the party is found anew with
        party = F.when(better & ~fixed, U.party(F.col("domain"), x["destination"], F.col("sink"))).otherwise(acc["party"])
        return F.struct(label.alias("label"), F.when(better, x["destination"]).otherwise(acc["destination"]).alias("destination"), party.alias("party"))

    first = F.element_at("all", 1)
    start = F.struct(first["label"].alias("label"), first["destination"].alias("destination"), first["party"].alias("party")).cast(text)
    out = groups.withColumn("m", F.aggregate(F.slice("all", 2, 1 << 30), start, fold))
    return out.select("key_dest", "domain", F.col("m.label").alias("threat_type"), first["trigger_context"].alias("trigger_context"), "source", "sink", F.col("m.destination").alias("destination"), first["observed_trackers"].alias("observed_trackers"), F.col("m.party").alias("party"))


def rule_numbers(threat_type: Column) -> Column:
    """Distinct rule numbers of joined labels, sorted."""
    table = F.create_map(*[x for label, n, _ in R.LABELS for x in (F.lit(label), F.lit(n))])
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(F.split(threat_type, r" \| "), lambda v: F.try_element_at(table, F.trim(v))))))


def confidence(threat_type: Column, context: Column, destination: Column) -> Column:
    """1 to 5: up to three rules, self-starting, destination confirmed."""
    known = U.any_of(destination, ("Predicted 3rd-Party", "Hybrid Reconstructed", "CNAME Cloaked"))
    score = F.least(F.size(rule_numbers(threat_type)), F.lit(3)) + (context == "AUTONOMOUS").cast("int") + known.cast("int")
    return F.greatest(F.lit(1), F.least(score, F.lit(5)))


def refined_party() -> Column:
    dest, threat = F.col("destination"), F.col("threat_type")
    open_ = F.contains(threat, F.lit(R.R1)) & F.contains("party", F.lit("WCC Isolated"))
    hybrid = F.contains(dest, F.lit("Hybrid Reconstructed"))
    return F.when(
        open_,
        F.when(F.contains(dest, F.lit("CNAME Cloaked")), "1st-Party (CNAME Cloaked)")
        .when(hybrid & U.is_first_party(F.col("domain"), dest), "1st-Party (Hybrid)")
        .when(F.contains(threat, F.lit("Semantic_CrossValidation (Rule 5)")) | F.contains(dest, F.lit("Predicted 3rd-Party")) | hybrid, "3rd-Party (WCC Isolated)")
        .otherwise(F.col("party")),
    ).otherwise(F.col("party"))


def classify(routes: DataFrame, netlog: DataFrame, handlers: DataFrame | None = None) -> DataFrame:
    """Routes and logs in, scored and merged threats out; min_rule and domain give their order."""
    # stored, as routes and their sites' and sources' facts all come from it
    merged = merge_threats(threats(checkpoint(rewrite_routes(routes, netlog)), netlog, handlers))
    scored = merged.withColumn("confidence", confidence(F.col("threat_type"), F.col("trigger_context"), F.col("destination")))
    scored = scored.withColumn("party", refined_party())
    return scored.withColumn("min_rule", F.coalesce(F.element_at(rule_numbers(F.col("threat_type")), 1), F.lit(99)))


def final_stats(merged: DataFrame) -> DataFrame:
    """statistic, cases: each statistic once for each merged row; total_malicious: domains."""
    table = F.create_map(*[x for label, _, stat in R.LABELS for x in (F.lit(label), F.lit(stat))])
    stats = F.array_distinct(F.array_compact(F.transform(F.split("threat_type", r" \| "), lambda v: F.try_element_at(table, F.trim(v)))))
    per = merged.select(F.explode(stats).alias("statistic")).groupBy("statistic").agg(F.count(F.lit(1)).alias("cases"))
    return per.unionByName(merged.agg(F.countDistinct("domain").alias("cases")).select(F.lit("total_malicious").alias("statistic"), "cases"))


def context_histogram(routes: DataFrame, handlers: DataFrame | None = None) -> DataFrame:
    """domain, autonomous, event_driven, context (Mixed if both are there). With handlers (domain, event_driven_functions) also unknown (routes
    of no known context) and event_driven_functions, which count as event-driven code too; sites without routes have a row if they have handlers."""
    count = lambda kind: F.count_if(F.col("trigger_context") == kind)
    per = routes.groupBy("domain").agg(count("AUTONOMOUS").alias("autonomous"), count("EVENT_DRIVEN").alias("event_driven"), F.count(F.lit(1)).alias("__all"))
    event = F.col("event_driven") > 0
    if handlers is not None:
        more = handlers.groupBy("domain").agg(F.coalesce(F.sum("event_driven_functions"), F.lit(0)).alias("event_driven_functions"))
        per = per.join(more, "domain", "full").fillna(0, ["autonomous", "event_driven", "__all", "event_driven_functions"])
        per, event = per.withColumn("unknown", F.col("__all") - F.col("autonomous") - F.col("event_driven")), event | (F.col("event_driven_functions") > 0)
    return per.drop("__all").withColumn("context", F.when((F.col("autonomous") > 0) & event, "Mixed (Dual Context)").otherwise("Single Context"))


def missing_logs(routes: DataFrame, netlog: DataFrame) -> DataFrame:
    """domain, warning: sites with routes but without a network log, whose destinations cannot be compared."""
    lost = routes.select("domain").distinct().join(netlog.select("domain").distinct(), "domain", "left_anti")
    return lost.withColumn("warning", F.concat(F.lit("network log not found for "), "domain"))


def domain_rules(merged: DataFrame) -> DataFrame:
    """domain, rules: R1,R3 and the like."""
    each = merged.select("domain", F.explode(rule_numbers(F.col("threat_type"))).alias("rule")).distinct()
    return each.groupBy("domain").agg(F.array_join(F.transform(F.array_sort(F.collect_list("rule")), lambda n: F.concat(F.lit("R"), n.cast("string"))), ",").alias("rules"))


def _equals(k: int):
    return lambda v: v == k


def domain_summary(merged: DataFrame) -> DataFrame:
    """Per domain: labels of each rule, routes, highest confidence, third party confirmed."""
    table = F.create_map(*[x for label, n, _ in R.LABELS for x in (F.lit(label), F.lit(n))])
    numbers = F.array_compact(F.transform(F.split("threat_type", r" \| "), lambda v: F.try_element_at(table, F.trim(v))))
    rows = merged.withColumn("n", numbers)
    counts = [F.sum(F.size(F.filter("n", _equals(k)))).cast("long").alias(f"rule_{k}") for k in range(1, 6)]
    return rows.groupBy("domain").agg(*counts, F.count(F.lit(1)).alias("total_routes"), F.max("confidence").alias("max_confidence"), F.max(F.contains("party", F.lit("3rd-Party"))).alias("third_party"))


def with_order(merged: DataFrame) -> DataFrame:
    """A position for each row in the report's order, numbered range by range."""
    rows = numbered(merged, [F.col(c) for c in ("min_rule", "domain", "source", "sink", "destination")], "position")
    return rows.withColumn("position", (F.col("position") + 1).cast("int"))
