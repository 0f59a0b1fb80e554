"""Column functions on URLs and parties."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import registries as R


def any_of(col: Column, keywords) -> Column:
    """Does a string contain one of some keywords? One scan of the string."""
    return col.rlike("|".join(re.escape(k) for k in keywords))


def netloc(url: Column) -> Column:
    """The authority part of a URL, lower-case; '' without a scheme. Works where a URL parser fails."""
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def bare_domain(domain: Column) -> Column:
    return F.lower(F.replace(domain, F.lit("www."), F.lit("")))


def within(host: Column, base: Column) -> Column:
    return (host == base) | F.endswith(host, F.concat(F.lit("."), base))


def is_first_party(domain: Column, url: Column, affiliated: bool = True) -> Column:
    """Is url on the domain, a subdomain of it or, if wanted, an affiliate's?"""
    host, base = netloc(url), bare_domain(domain)
    own = within(host, base)
    if affiliated:
        table = F.create_map(*[x for k, v in R.AFFILIATES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
        own = own | F.coalesce(F.exists(F.try_element_at(table, base), lambda a: within(host, a)), F.lit(False))
    return F.coalesce((url != R.DYNAMIC) & F.startswith(url, F.lit("http")) & own, F.lit(False))


def has_tracker(url: Column) -> Column:
    return any_of(F.lower(url), R.TRACKER_KEYWORDS)


def has_whitelist(url: Column) -> Column:
    return any_of(F.lower(url), R.WHITELIST_KEYWORDS)


def is_cookie(url: Column) -> Column:
    return any_of(url, R.COOKIE_MARKS)


def is_unresolved(url: Column) -> Column:
    return (url == R.DYNAMIC) | F.contains(url, F.lit(R.HOLE))


def normal_destination(url: Column) -> Column:
    """Destinations that are not known for sure become one."""
    vague = url.isNull() | (url == "") | is_unresolved(url) | any_of(url, ("Predicted", "Hybrid Reconstructed", "CNAME Cloaked"))
    return F.when(vague, F.lit(R.DYNAMIC)).otherwise(url)


def party(domain: Column, url: Column, sink_type: Column) -> Column:
    """One party label for a destination; the first that holds."""
    own = is_first_party(domain, url)
    return (
        F.when(F.contains(url, F.lit("CNAME Cloaked")), "1st-Party (CNAME Cloaked)")
        .when(F.contains(url, F.lit("Hybrid Reconstructed")), F.when(own, "1st-Party (Hybrid)").otherwise("3rd-Party (Identified)"))
        .when((sink_type == "Storage") | is_cookie(url), "Local (Cookie/Storage)")
        .when(is_unresolved(url), "Unknown (Obfuscated)")
        .otherwise(F.when(own, "1st-Party").otherwise("3rd-Party/Unknown"))
    )
