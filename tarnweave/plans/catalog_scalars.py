"""Catalogue: texts of numbers and dates, escapes, wide integers, constant operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import js as J
from . import fixtures as X
from .registry import query

_C = F.col


def _events(spark, d):
    return X.table(spark, d, "events")


@query("number_texts", """SELECT event_id, printf('%.2f', x) AS fixed, regexp_replace(printf('%.3e', x), 'e([+-])0*([0-9])', 'e\\1\\2') AS exponential,
  CASE WHEN abs(x) >= 1 THEN printf('%.' || (4 - floor(log10(abs(x)))::INT) || 'f', x) ELSE printf('%.' || (4 - floor(log10(abs(x)))::INT) || 'f', x) END AS precise
  FROM (SELECT event_id, value / 7 + 0.011 AS x FROM events)""")
def number_texts(spark, d):
    x = _C("value") / 7 + 0.011
    return _events(spark, d).select("event_id", J.to_fixed(x, F.lit(2)).alias("fixed"), J.to_exponential(x, F.lit(3)).alias("exponential"), J.to_precision(x, F.lit(5)).alias("precise"))


@query("radix_text", "SELECT event_id, CASE WHEN n < 0 THEN '-' ELSE '' END || lower(to_base(abs(n), 16)) AS hex, CASE WHEN n < 0 THEN '-' ELSE '' END || lower(to_base(abs(n), 36)) AS wide, to_base(abs(n), 2) AS bits FROM (SELECT event_id, event_id * 977 - 3000000 AS n FROM events)")
def radix_text(spark, d):
    n = _C("event_id") * 977 - 3000000
    return _events(spark, d).select("event_id", J.to_radix(n, 16).alias("hex"), J.to_radix(n, 36).alias("wide"), J.to_radix(F.abs(n), 2).alias("bits"))


@query("date_iso", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso, epoch_us(ts) // 1000 AS ms, epoch_us(date_trunc('day', ts)) // 1000 AS day, epoch_us(ts) // 1000 - 19800000 AS shifted FROM events")
def date_iso(spark, d):
    iso = J.iso_text(_C("ts").cast("timestamp"))
    offset = F.concat(F.substring(iso, 1, 23), F.lit("+05:30"))
    return _events(spark, d).select("event_id", iso.alias("iso"), J.parse_iso(iso).alias("ms"), J.parse_iso(F.substring(iso, 1, 10)).alias("day"), J.parse_iso(offset).alias("shifted"))


@query("date_setters", """SELECT event_id, epoch_us(date_trunc('month', ts) + to_days((event_id % 70)::INT - 10 - 1) + (ts - date_trunc('day', ts))) // 1000 AS set_day,
  epoch_us(make_timestamp(year(ts), 1, 1, 0, 0, 0.0) + to_months((event_id % 40)::INT - 15) + to_days(day(ts)::INT - 1) + (ts - date_trunc('day', ts))) // 1000 AS set_month FROM events""")
def date_setters(spark, d):
    ms, k = F.floor(F.unix_micros(_C("ts").cast("timestamp")) / 1000), _C("event_id")
    return _events(spark, d).select("event_id", J.set_date_parts(ms, day=k % 70 - 10).alias("set_day"), J.set_date_parts(ms, month=k % 40 - 15).alias("set_month"))


_ESCAPE = """array_to_string(list_transform(string_split(t, ''), lambda c: CASE WHEN regexp_full_match(c, '[A-Za-z0-9@*_+./-]') THEN c WHEN unicode(c) < 256 THEN printf('%%%02X', unicode(c)) WHEN unicode(c) < 65536 THEN printf('%%u%04X', unicode(c))
  ELSE printf('%%u%04X', ((unicode(c) - 65536) // 1024 + 55296)::INT) || printf('%%u%04X', ((unicode(c) - 65536) % 1024 + 56320)::INT) END), '')"""


@query("escape_text", f"SELECT doc_id, md5({_ESCAPE}) AS escaped, md5(t) AS back FROM (SELECT doc_id, text || '😀한é' AS t FROM documents)")
def escape_text(spark, d):
    t = J.escaped(F.concat("text", F.lit("😀한é")))
    return X.table(spark, d, "documents").select("doc_id", F.md5(t).alias("escaped"), F.md5(J.unescaped(t)).alias("back"))


@query("encode_uri", """SELECT doc_id, md5(e) AS encoded, md5(t) AS back, md5(replace(t, ' ', '%2F')) AS kept FROM (SELECT doc_id, t, list_reduce([';', '/', '?', ':', '@', '&', '=', '+', '$', ',', '#', '!', '''', '(', ')', '*'], lambda s, c: replace(s, printf('%%%02X', ascii(c)), c), url_encode(t)) AS e
  FROM (SELECT doc_id, replace(text, '%', '') AS t FROM documents))""")
def encode_uri(spark, d):
    t = F.replace(_C("text"), F.lit("%"), F.lit(""))
    return X.table(spark, d, "documents").select("doc_id", F.md5(J.encode_uri(t)).alias("encoded"), F.md5(J.decode_uri(J.encode_uri(t))).alias("back"), F.md5(J.decode_uri(F.replace(J.encode_uri(t), F.lit("%20"), F.lit("%2F")))).alias("kept"))


@query("wide_integers", """SELECT event_id, (CASE WHEN u >= 4611686018427387904 THEN u - 9223372036854775808 ELSE u END)::DECIMAL(38,0) AS signed, (((x % 4294967296) + 4294967296) % 4294967296)::DECIMAL(38,0) AS unsigned
  FROM (SELECT event_id, x, ((x % 9223372036854775808) + 9223372036854775808) % 9223372036854775808 AS u FROM (SELECT event_id, (event_id::HUGEINT - 700) * 1234567890123456789012345::HUGEINT AS x FROM events))""")
def wide_integers(spark, d):
    x = ((_C("event_id") - 700).cast("decimal(10,0)") * F.lit("1234567890123456789012345").cast("decimal(25,0)")).cast("decimal(38,0)")
    return _events(spark, d).select("event_id", J.as_int_n(x, 63).alias("signed"), J.as_uint_n(x, 32).alias("unsigned"))


_OPS = ("+", "-", "*", "/", "%", "<", "<=", ">", ">=", "===", "!==", "&", "|", "^", "<<", ">>", ">>>")
_I32 = lambda x: f"(CASE WHEN ({x} % 4294967296 + 4294967296) % 4294967296 >= 2147483648 THEN ({x} % 4294967296 + 4294967296) % 4294967296 - 4294967296 ELSE ({x} % 4294967296 + 4294967296) % 4294967296 END)"


@query("constant_fold", f"""SELECT event_id, (CASE op WHEN '+' THEN a + b WHEN '-' THEN a - b WHEN '*' THEN a * b WHEN '/' THEN CASE WHEN b <> 0 THEN a::DOUBLE / b WHEN a = 0 THEN 'nan'::DOUBLE WHEN a > 0 THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END WHEN '%' THEN CASE WHEN b = 0 THEN 'nan'::DOUBLE ELSE a % b END
  WHEN '<' THEN (a < b)::INT WHEN '<=' THEN (a <= b)::INT WHEN '>' THEN (a > b)::INT WHEN '>=' THEN (a >= b)::INT WHEN '===' THEN (a = b)::INT WHEN '!==' THEN (a <> b)::INT
  WHEN '&' THEN a & b WHEN '|' THEN a | b WHEN '^' THEN xor(a, b) WHEN '<<' THEN {_I32('(a * power(2, (b + 64) % 32)::BIGINT)')} WHEN '>>' THEN floor(a / power(2, (b + 64) % 32)) ELSE floor(((a + 4294967296) % 4294967296) / power(2, (b + 64) % 32)) END)::DOUBLE AS value,
  (CASE event_id % 4 WHEN 0 THEN -a WHEN 1 THEN a WHEN 2 THEN -1 - a ELSE (a = 0)::INT END)::DOUBLE AS unary
  FROM (SELECT event_id, [{', '.join(repr(o) for o in _OPS)}][event_id % {len(_OPS)} + 1] AS op, event_id % 1001 - 500 AS a, (event_id // 7) % 41 - 20 AS b FROM events)""")
def constant_fold(spark, d):
    k = _C("event_id")
    # whole-number division: a ratio rounds large ids up
    a, b = k % 1001 - 500, F.expr("event_id div 7") % 41 - 20
    unary = J.folded_unary(X._pick(("-", "+", "~", "!"), k % 4), a)
    # operands of the SQL are whole numbers, whose zero has no sign but as a ratio
    op, plain = X._pick(_OPS, k % len(_OPS)), lambda v: F.when(v == 0, 0.0).otherwise(v)
    value = J.folded(op, a, b)
    return _events(spark, d).select("event_id", F.when(op == "/", value).otherwise(plain(value)).alias("value"), plain(unary).alias("unary"))


@query("shortest_numbers", "SELECT p_partkey, p_partkey * 3 || '' AS whole, CASE WHEN p_partkey < 10 THEN p_partkey || '.5e-7' ELSE '0.' || lpad(p_partkey || '5', 8, '0') END AS small, p_partkey || '.25' AS plain FROM part WHERE p_partkey > 0")
def shortest_numbers(spark, d):
    k = _C("p_partkey")
    return X.table(spark, d, "part").where("p_partkey > 0").select(k, J.number_text((k * 3).cast("double")).alias("whole"), J.number_text((k * 10 + 5) / 1e8).alias("small"), J.number_text(k + 0.25).alias("plain"))
