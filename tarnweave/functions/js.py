"""Column functions with the semantics of the script language's built-ins, where SQL's differ."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


def js_slice(s: Column, start: int, end: int | None = None) -> Column:
    """slice(start, end): negative places count from the end."""
    n = F.length(s)
    place = lambda i: F.greatest(n + i, F.lit(0)) if i < 0 else F.least(F.lit(i), n)
    a, b = place(start), n if end is None else place(end)
    return F.substring(s, a + 1, F.greatest(b - a, F.lit(0)))


def js_substring(s: Column, start: int, end: int) -> Column:
    """substring(start, end): negative places are 0, swapped places are put right."""
    a, b = sorted((max(start, 0), max(end, 0)))
    return F.substring(s, a + 1, b - a)


def at(s: Column, i: int) -> Column:
    """One letter; null beyond the ends."""
    n = F.length(s)
    place = n + i if i < 0 else F.lit(i)
    return F.when((place >= 0) & (place < n), F.substring(s, place + 1, F.lit(1)))


def index_of(s: Column, part: str) -> Column:
    return F.instr(s, part) - 1


def last_index_of(s: Column, part: str) -> Column:
    back = F.instr(F.reverse(s), part[::-1])
    return F.when(back == 0, F.lit(-1)).otherwise(F.length(s) - back - len(part) + 1)


def pad_start(s: Column, n: int, fill: str = " ") -> Column:
    """Never cuts, unlike lpad."""
    return F.when(F.length(s) >= n, s).otherwise(F.lpad(s, n, fill))


def pad_end(s: Column, n: int, fill: str = " ") -> Column:
    return F.when(F.length(s) >= n, s).otherwise(F.rpad(s, n, fill))


def replace_first(s: Column, part: str, new: str) -> Column:
    i = F.instr(s, part)
    return F.when(i == 0, s).otherwise(F.concat(F.substring(s, F.lit(1), i - 1), F.lit(new), F.substring(s, i + len(part), F.length(s))))


def js_round(x: Column) -> Column:
    """Halves go up, also negative ones."""
    return F.floor(x + 0.5)


def trunc(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))


def to_int32(x: Column) -> Column:
    """A whole number modulo 2 ** 32, signed."""
    m = F.pmod(x.cast("long"), F.lit(1 << 32))
    return F.when(m >= 1 << 31, m - (1 << 32)).otherwise(m).cast("int")


def imul(a: Column, b: Column) -> Column:
    """The low 32 bits of a product, signed."""
    a, b = to_int32(a).cast("long"), to_int32(b).cast("long")
    return to_int32(F.pmod(a, F.lit(1 << 16)) * b + F.pmod(F.floor(a / float(1 << 16)) * b, F.lit(1 << 16)) * (1 << 16))


def clz32(x: Column) -> Column:
    u = F.pmod(x.cast("long"), F.lit(1 << 32))
    return F.when(u == 0, F.lit(32)).otherwise(32 - F.length(F.bin(u)))


def fround(x: Column) -> Column:
    return x.cast("float").cast("double")


def parse_int(s: Column, radix: int = 10) -> Column:
    """Leading whole number of a text; null if there is none."""
    digits = F.regexp_extract(F.trim(s), r"^([+-]?\d+)" if radix == 10 else r"(?i)^([+-]?[0-9a-z]+)", 1)
    if radix == 10:
        return F.when(digits != "", digits.try_cast("long"))
    return F.when(digits != "", F.conv(digits, radix, 10).try_cast("long"))


def parse_float(s: Column) -> Column:
    found = F.regexp_extract(F.trim(s), r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.when(found != "", found.try_cast("double"))


def make_date(year: Column, month: Column, day: Column) -> Column:
    """Milliseconds of a UTC date; months from 0, overflow is carried on."""
    months = year * 12 + month
    first = F.make_date(F.floor(months / 12).cast("int"), (F.pmod(months, F.lit(12)) + 1).cast("int"), F.lit(1))
    return F.unix_date(F.date_add(first, (day - 1).cast("int"))).cast("long") * 86_400_000


def encode_uri_component(s: Column) -> Column:
    """Percent encoding with %20 for spaces; !'()* stay."""
    out = F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))
    for code, c in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(c))
    return out


def base64_text(s: Column) -> Column:
    """Base64 of a text's UTF-8 in one line; SQL's breaks lines after 76 letters."""
    return F.replace(F.base64(F.encode(s, "UTF-8")), F.lit("\r\n"), F.lit(""))


def decode_uri_component(s: Column) -> Column:
    return F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B")))


def find_first(a: Column, test) -> Column:
    return F.try_element_at(F.filter(a, test), F.lit(1))


def find_last(a: Column, test) -> Column:
    return F.try_element_at(F.filter(a, test), F.lit(-1))


def index_in(a: Column, x) -> Column:
    return F.coalesce(F.array_position(a, x), F.lit(0)) - 1


def with_at(a: Column, i: int, x) -> Column:
    """A copy with one place changed."""
    return F.transform(a, lambda v, n: F.when(n == i, F.lit(x)).otherwise(v))


def spliced(a: Column, start: int, count: int, new: Column) -> Column:
    n = F.size(a)
    return F.concat(F.slice(a, 1, F.least(F.lit(start), n)), new, F.slice(a, start + count + 1, F.greatest(n - start - count, F.lit(0))))


@F.pandas_udf(StringType())
def from_code_points(codes: pd.Series) -> pd.Series:
    """Text of an array of code points; SQL's chr stops at 255."""
    return codes.map(lambda c: None if c is None else "".join(chr(int(x)) for x in c))


@F.pandas_udf(StringType())
def normalised_nfc(s: pd.Series) -> pd.Series:
    import unicodedata

    return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(DoubleType())
def number_from_bits(s: pd.Series) -> pd.Series:
    """number:<16 hex digits> to the double of these bits."""
    import struct

    return s.map(lambda t: struct.unpack(">d", bytes.fromhex(t.removeprefix("number:").removeprefix("0x").rjust(16, "0")))[0] if t is not None else None)


@F.pandas_udf(StringType())
def to_fixed(x: pd.Series, digits: pd.Series) -> pd.Series:
    """Exact value of the number, rounded with halves away from zero; SQL's formats round its shortest text."""
    from decimal import ROUND_HALF_UP, Decimal, localcontext

    def one(v, n):
        if pd.isna(v) or pd.isna(n):
            return None
        if abs(v) >= 1e21:
            return _shortest(v)
        with localcontext() as c:
            c.prec = 60
            text = f"{Decimal(abs(v)).quantize(Decimal(1).scaleb(-int(n)), ROUND_HALF_UP):f}"
        return "-" + text if v < 0 and text.strip("0.") else text

    return pd.Series([one(v, n) for v, n in zip(x, digits)], dtype=object)


def _digits(v: float, n: int) -> tuple[str, int]:
    """The n leading digits of a number above zero, rounded as in to_fixed, and the place of the first."""
    from decimal import ROUND_HALF_UP, Decimal, localcontext

    d = Decimal(v)
    with localcontext() as c:
        c.prec, c.rounding = n, ROUND_HALF_UP
        d = +d
    digits = "".join(map(str, d.as_tuple().digits))[:n].ljust(n, "0")
    return digits, d.adjusted()


def _exponential(v: float, n: int) -> str:
    digits, e = ("0" * n, 0) if v == 0 else _digits(abs(v), n)
    return ("-" if v < 0 else "") + digits[0] + ("." + digits[1:] if n > 1 else "") + f"e{'+' if e >= 0 else '-'}{abs(e)}"


def _shortest(v: float) -> str:
    """The shortest text that reads back as the number."""
    if v != v:
        return "NaN"
    if v in (float("inf"), float("-inf")):
        return "Infinity" if v > 0 else "-Infinity"
    if v == int(v) and abs(v) < 1 << 53:
        return str(int(v))
    mantissa, _, e = f"{abs(v)!r}".partition("e")
    whole, _, part = mantissa.partition(".")
    digits, point = (whole + part).lstrip("0"), len(whole) + int(e or 0) - (len(whole + part) - len((whole + part).lstrip("0")))
    digits = digits.rstrip("0")
    sign = "-" if v < 0 else ""
    if -6 < point <= 21:
        if point <= 0:
            return f"{sign}0.{'0' * -point}{digits}"
        return sign + (digits.ljust(point, "0") if len(digits) <= point else f"{digits[:point]}.{digits[point:]}")
    e = point - 1
    return f"{sign}{digits[0]}{'.' + digits[1:] if len(digits) > 1 else ''}e{'+' if e >= 0 else '-'}{abs(e)}"


@F.pandas_udf(StringType())
def to_exponential(x: pd.Series, digits: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else _exponential(v, int(n) + 1) for v, n in zip(x, digits)], dtype=object)


@F.pandas_udf(StringType())
def to_precision(x: pd.Series, digits: pd.Series) -> pd.Series:
    """Plain as long as the first digit stands at most that many places before the point, and seven behind it."""

    def one(v, n):
        if pd.isna(v):
            return None
        d, e = ("0" * n, 0) if v == 0 else _digits(abs(v), n)
        if e < -6 or e >= n:
            return _exponential(v, n)
        text = d if e == n - 1 else f"{d[: e + 1]}.{d[e + 1 :]}" if e >= 0 else "0." + "0" * (-e - 1) + d
        return "-" + text if v < 0 else text

    return pd.Series([one(v, int(n)) for v, n in zip(x, digits)], dtype=object)


@F.pandas_udf(StringType())
def number_text(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if pd.isna(v) else _shortest(v))


def to_radix(n: Column, radix: int) -> Column:
    """A whole number in another base, small letters."""
    text = F.lower(F.conv(F.abs(n).cast("string"), 10, radix))
    return F.when(n < 0, F.concat(F.lit("-"), text)).otherwise(text)


def iso_text(ts: Column) -> Column:
    """UTC, to the millisecond; null for what is no time."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def parse_iso(s: Column) -> Column:
    """Milliseconds of an ISO text: a day alone is UTC; with a time, Z or an offset; null for other texts."""
    good = s.rlike(r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:\d{2})?)?$")
    whole = F.regexp_replace(s, r"(T\d{2}:\d{2})(Z|[+-]\d{2}:\d{2})?$", "$1:00$2")  # without seconds
    return F.when(good, F.floor(F.unix_micros(F.when(good, whole).try_cast("timestamp")) / 1000))


def set_date_parts(ms: Column, *, year: Column | None = None, month: Column | None = None, day: Column | None = None) -> Column:
    """Milliseconds with some parts changed; months from 0, overflow is carried on, the time of day stays."""
    days = F.floor(ms / 86_400_000)
    date = F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int"))
    parts = (F.year(date) if year is None else year, F.month(date) - 1 if month is None else month, F.day(date) if day is None else day)
    return make_date(*parts) + ms - days * 86_400_000


#: What encodeURI leaves besides the letters that encodeURIComponent leaves.
RESERVED = ";/?:@&=+$,#"


def encode_uri(s: Column) -> Column:
    out = encode_uri_component(s)
    for c in RESERVED:
        out = F.replace(out, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return out


def decode_uri(s: Column) -> Column:
    """Escapes of reserved letters stay as they are."""
    codes = "|".join(f"{ord(c):02X}|{ord(c):02x}" for c in RESERVED)
    return decode_uri_component(F.regexp_replace(s, f"%({codes})", "%25$1"))


class _Escapes(dict):
    """By code point, made when first asked: itself, %XX, %uXXXX or two of these."""

    def __missing__(self, n: int) -> str:
        c, above = chr(n), n - 0x10000
        if n < 128 and (c.isalnum() or c in "@*_+-./"):
            out = c
        elif n < 0x10000:
            out = f"%{n:02X}" if n < 256 else f"%u{n:04X}"
        else:
            out = f"%u{(above >> 10) + 0xD800:04X}%u{(above & 1023) + 0xDC00:04X}"
        self[n] = out
        return out


class _Units(dict):
    """By escape, made when first asked: its unit."""

    def __missing__(self, escape: str) -> str:
        self[escape] = out = chr(int(escape.lstrip("%u"), 16))
        return out


_ESCAPES, _UNITS = _Escapes(), _Units()
#: Different letters of a text that are replaced one after the other; more of them letter by letter.
_FEW = 48


@F.pandas_udf(StringType())
def escaped(s: pd.Series) -> pd.Series:
    """Letters, digits and @*_+-./ stay, units below 256 become %XX, others %uXXXX."""

    def one(t):
        odd = [c for c in set(t) if _ESCAPES[ord(c)] != c]
        if len(odd) > _FEW:
            return t.translate(_ESCAPES)
        for c in sorted(odd, key=lambda c: c != "%"):  # the others' escapes hold % and letters that stay
            t = t.replace(c, _ESCAPES[ord(c)])
        return t

    return s.map(lambda t: None if t is None else one(t))


@F.pandas_udf(StringType())
def unescaped(s: pd.Series) -> pd.Series:
    import re

    code = re.compile(r"%u[0-9A-Fa-f]{4}|%[0-9A-Fa-f]{2}")
    pair = re.compile(r"[\ud800-\udfff]")

    def one(t):
        found, out = set(code.findall(t)), t
        # units that are part of no escape can be put in one after the other; the rest at once
        plain = [e for e in found if _UNITS[e] not in "%u0123456789ABCDEFabcdef"]
        if len(found) <= _FEW:
            for e in plain:
                out = out.replace(e, _UNITS[e])
        if len(found) > min(_FEW, len(plain)):
            out = code.sub(lambda m: _UNITS[m.group()], out)
        # units of one letter come as two
        return out.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace") if pair.search(out) else out

    return s.map(lambda t: None if t is None else one(t))


def _power(bits: int) -> Column:
    return F.lit(str(1 << bits)).cast("decimal(38,0)")


def as_uint_n(x: Column, bits: int) -> Column:
    """A whole number of up to 38 digits modulo 2 ** bits; bits up to 126."""
    return F.pmod(x.cast("decimal(38,0)"), _power(bits)).cast("decimal(38,0)")


def as_int_n(x: Column, bits: int) -> Column:
    """The same, signed."""
    m = as_uint_n(x, bits)
    return F.when(m >= _power(bits - 1), m - _power(bits)).otherwise(m).cast("decimal(38,0)")


def folded(op: Column, left: Column, right: Column) -> Column:
    """Constant numbers under a binary operator, as a double; null where the operator has no such value.
    Comparisons give 1 or 0, bit operators work on 32 bits, a division by zero gives an infinity."""
    a, b = left.cast("double"), right.cast("double")
    x, y = to_int32(a), to_int32(b)
    by = F.pmod(y, F.lit(32))
    u = F.pmod(x.cast("long"), F.lit(1 << 32))
    flag = lambda c: c.cast("int").cast("double")
    shifted = lambda f, v: F.call_function(f, v, by).cast("double")
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    ratio = F.when(b != 0, F.try_divide(a, b)).when((a == 0) | F.isnan(a), nan).otherwise(F.signum(a) * inf)
    table = {
        "+": a + b, "-": a - b, "*": a * b, "/": ratio, "%": F.when(b == 0, nan).otherwise(F.try_mod(a, b)),
        "<": flag(a < b), "<=": flag(a <= b), ">": flag(a > b), ">=": flag(a >= b), "===": flag(a == b), "!==": flag(a != b),
        "&": x.bitwiseAND(y).cast("double"), "|": x.bitwiseOR(y).cast("double"), "^": x.bitwiseXOR(y).cast("double"),
        "<<": shifted("shiftleft", x), ">>": shifted("shiftright", x), ">>>": shifted("shiftright", u),
    }
    out = F.lit(None).cast("double")
    for name, value in table.items():
        out = F.when(op == name, value).otherwise(out)
    return out


def folded_unary(op: Column, value: Column) -> Column:
    """A constant number under -, +, ~ or !."""
    v = value.cast("double")
    flag = ((v == 0) | F.isnan(v)).cast("int").cast("double")
    return F.when(op == "-", -v).when(op == "+", v).when(op == "~", (-1 - to_int32(v).cast("long")).cast("double")).when(op == "!", flag)


def locale_compare(a: Column, b: Column, locale: str = "UNICODE") -> Column:
    """localeCompare: -1, 0 or 1 by the collation of a language, or of none in particular; null beside a null."""
    x, y = F.collate(a, locale), F.collate(b, locale)
    return F.when(x < y, -1).when(x > y, 1).when(x == y, 0)
