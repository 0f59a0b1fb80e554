"""Text preparation of captured scripts and pages, and small formatters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What stands before each captured file.
SEPARATOR = "// ==========================================\n"
BANNER = "// [FILE] Source:"


def scrubbed(text: Column) -> Column:
    """NUL, its escape, U+FFFD and all beyond the basic plane become _."""
    out = F.replace(F.replace(F.replace(text, F.lit("\0"), F.lit("_")), F.lit("\\u0000"), F.lit("_")), F.lit("�"), F.lit("_"))
    return F.regexp_replace(out, r"[\x{10000}-\x{10FFFF}]", "_")


def escaped_separators(text: Column) -> Column:
    """U+2028 and U+2029, which end lines in scripts, as escapes."""
    return F.replace(F.replace(text, F.lit(" "), F.lit("\\u2028")), F.lit(" "), F.lit("\\u2029"))


def repaired(text: Column, probes: tuple[str, ...]) -> Column:
    """UTF-8 that was read as Latin-1 is read again, if a probe word then appears."""
    again = F.encode(text, "ISO-8859-1").cast("string")
    odd = text.rlike("[ìíï]") & ~text.rlike(r"[^\x00-\xFF]")
    found = F.lit(False)
    for p in probes:
        found = found | F.contains(again, F.lit(p))
    return F.when(odd, F.when(F.is_valid_utf8(again) & found, again).otherwise(text)).otherwise(text)


def charset(content_type: Column) -> Column:
    """Charset by content type."""
    c = F.lower(content_type)
    return F.when(c.rlike("euc-kr|ks_c_5601"), "EUC-KR").when(F.contains(c, F.lit("cp949")), "CP949").otherwise("UTF-8")


@F.pandas_udf(StringType())
def _decoded(content: pd.Series, name: pd.Series) -> pd.Series:
    """The session's own decoder does not know the Korean charsets."""
    names = {"EUC-KR": "euc_kr", "CP949": "cp949", "UTF-8": "utf-8"}

    def one(data, charset_):
        if data is None:
            return None
        text = data.decode(names[charset_], "replace")
        if charset_ == "UTF-8" and "\ufffd" in text:  # once more, kept if it is clean
            again = data.decode("euc_kr", "replace")
            return text if "\ufffd" in again else again
        return text

    return pd.Series([one(d, c) for d, c in zip(content, name)], dtype=object)


def decoded(content: Column, content_type: Column) -> Column:
    """Captured bytes as text: by the charset of the content type; UTF-8 that is damaged is read once more as
    EUC-KR, and that is kept if nothing in it is damaged."""
    return _decoded(content, charset(content_type))


#: Longer scripts are not transformed.
TRANSFORMED = 250_000


def is_transformable(text: Column, below: int = TRANSFORMED) -> Column:
    """Scripts that are not empty and short enough to be beautified and transpiled."""
    return has_code(text) & (F.length(text) < below)


def has_code(text: Column) -> Column:
    """Scripts that are not blank."""
    return F.coalesce(F.trim(text), F.lit("")) != ""


def crawl_outcome(scripts: DataFrame, domains: DataFrame) -> DataFrame:
    """domain, scripts, status: a site is a success with at least one script, also sites without any row count.
    scripts: domain. domains: all that were asked for."""
    n = scripts.groupBy("domain").agg(F.count(F.lit(1)).alias("scripts"))
    rows = domains.select("domain").distinct().join(n, "domain", "left").select("domain", F.coalesce("scripts", F.lit(0)).cast("long").alias("scripts"))
    return rows.withColumn("status", F.when(F.col("scripts") > 0, "success").otherwise("fail"))


def allow_listed(rows: DataFrame, listed: DataFrame, key: str, order: str, top: int = 100_000) -> DataFrame:
    """rows whose key is among the first `top` of a list; all of them if the list is empty."""
    first = listed.orderBy(order).limit(top).select(key).distinct()
    return rows if first.isEmpty() else rows.join(first, key, "left_semi")


def is_script(content_type: Column, url: Column) -> Column:
    return F.contains(F.coalesce(content_type, F.lit("")), F.lit("javascript")) | F.endswith(url, F.lit(".js"))


def safe_name(url: Column, moment: Column | None = None) -> Column:
    """File name of a captured script; with the moment of its capture (a timestamp) also that, in milliseconds, so that a script
    that is captured again gets a name of its own. A URL that ends in a slash is script.js."""
    name = F.regexp_extract(url, r"([^/?#]*)(?:[?#].*)?$", 1)
    if moment is not None:
        name = F.when(name == "", "script.js").otherwise(name)
    name = F.regexp_replace(name, r"(?i)[^a-z0-9.]", "_")
    return name if moment is None else F.concat(name, F.lit("_"), F.unix_millis(moment.cast("timestamp")).cast("string"), F.lit(".js"))


def wrapped(body: Column) -> Column:
    return F.concat(F.lit(";(function(){try{\n"), body, F.lit("\n}catch(e){}})()"))


def split_banners(texts: DataFrame) -> DataFrame:
    """texts: key, text. key, part, source_url, body; the first part only if it is not blank."""
    mark = SEPARATOR + BANNER
    rows = texts.select("key", F.posexplode(F.split("text", _quoted(mark), -1)).alias("part", "chunk"))
    url = F.when(F.col("part") > 0, F.trim(F.substring_index("chunk", "\n", 1)))
    body = F.when(F.col("part") > 0, F.expr("substring(chunk, instr(chunk, '\n'))")).otherwise(F.col("chunk"))
    return rows.select("key", "part", url.alias("source_url"), body.alias("body")).where((F.col("part") > 0) | (F.trim(F.regexp_replace("body", r"\s+", "")) != ""))


def _quoted(s: str) -> str:
    return "\\Q" + s + "\\E"


def join_parts(parts: DataFrame) -> DataFrame:
    """parts: key, part, source_url, body. One wrapped text for each key, in order of part."""
    line = F.when(F.col("source_url").isNull(), wrapped(F.col("body"))).otherwise(F.concat(F.lit(SEPARATOR + BANNER), "source_url", F.lit("\n" + SEPARATOR), wrapped(F.col("body"))))
    rows = parts.select("key", F.struct("part", line.alias("line")).alias("x")).groupBy("key").agg(F.array_sort(F.collect_list("x")).alias("all"))
    return rows.select("key", F.array_join(F.transform("all", lambda x: x["line"]), "\n").alias("text"))


def inline_scripts(pages: DataFrame) -> DataFrame:
    """pages: page_id, html. page_id, no, code of each inline script that is not empty."""
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<script[^>]*>(.*?)</script>"), 1)).alias("no", "code"))
    return rows.where(F.trim("code") != "")


def human_size(n: Column, largest: str = "GiB") -> Column:
    """1536 (1.5 KiB). largest: MiB or GiB."""
    tenths = lambda x: F.floor(x * 10 + 0.5) / 10  # noqa: E731  halves go up
    unit = lambda k, name: F.format_string(f"%d (%.1f {name})", n, tenths(n / float(1 << (10 * k))))
    small = F.when(n < 1024, n.cast("string")).when(n < 1 << 20, unit(1, "KiB"))
    return small.otherwise(unit(2, "MiB")) if largest == "MiB" else small.when(n < 1 << 30, unit(2, "MiB")).otherwise(unit(3, "GiB"))


def human_time(seconds: Column) -> Column:
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), F.floor(seconds % 60)
    return F.when(h > 0, F.format_string("%dh %dm %ds", h, m, s)).when(m > 0, F.format_string("%dm %ds", m, s)).otherwise(F.format_string("%ds", s))


def slug(label: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(label)), r"\s+", "-")


def domain_of_path(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/wholepage\.js$", 1)
