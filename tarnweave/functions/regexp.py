"""Patterns of the script language, translated to the session's, and all their matches with places and groups.

What differs between the two is written out: line ends, the dot, words and their edges, white space, named groups and references to them,
classes, escapes, braces that are no quantifier. The flags i, m, s, u, y hold; g is what `matches` does and `first_match` does not.

Places count code points (`utf16_place` gives units); letters beyond the basic plane are one letter with and without the flag u. A group that took no part
reads as an empty text, groups keep what an earlier turn of a loop found, and a look-behind must have a greatest length.
A reference to a group that has not begun matches nothing, as it should. Patterns that are not valid raise ValueError.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Line ends, letters of words, white space.
_ENDS, _WORD = r"\n\r\x{2028}\x{2029}", "A-Za-z0-9_"
_SPACE = r"\t\n\x0B\f\r\x20\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_CLASS = {"d": "0-9", "w": _WORD, "s": _SPACE}
_CONTROL = {"t": r"\t", "n": r"\n", "v": r"\x0B", "f": r"\f", "r": r"\r"}
_QUANTIFIER = re.compile(r"\{[0-9]+(?:,[0-9]*)?\}")
_GROUP = re.compile(r"\(\?<([A-Za-z_$ª-\U0010ffff][\w$]*)>")
#: Letters that no text has; where one has them, it is read with U+FFFD instead.
_OPEN, _BETWEEN, _CLOSE = "\ufdd0", "\ufdd1", "\ufdd2"


def _literal(code: int) -> str:
    c = chr(code)
    return c if c.isalnum() and code < 128 else f"\\x{{{code:X}}}"


class _Translation:
    def __init__(self, pattern: str, flags: str):
        if set(flags) - set("dgimsuy") or len(set(flags)) < len(flags):
            raise ValueError(f"flags {flags!r}")
        self.p, self.i, self.flags = pattern, 0, flags
        self.names, self.count = self._groups()
        self.begun = 0

    def _groups(self) -> tuple[dict[str, int], int]:
        """Numbers of the named groups, and how many groups there are."""
        names, n, i, inside = {}, 0, 0, False
        while i < len(self.p):
            c = self.p[i]
            if c == "\\":
                i += 1
            elif inside:
                inside = c != "]"
            elif c == "[":
                inside = True
            elif c == "(":
                named = _GROUP.match(self.p, i)
                if named:
                    n += 1
                    if names.setdefault(named[1], n) != n:
                        raise ValueError(f"group {named[1]} comes twice")
                elif self.p[i + 1 : i + 2] != "?":
                    n += 1
            i += 1
        return names, n

    def _take(self, regex: str) -> re.Match | None:
        m = re.compile(regex).match(self.p, self.i)
        if m:
            self.i = m.end()
        return m

    def _code(self) -> str | None:
        """An escape that stands for one letter, behind the backslash."""
        if m := self._take("x([0-9A-Fa-f]{2})"):
            return _literal(int(m[1], 16))
        if m := self._take("u([dD][89abAB][0-9A-Fa-f]{2})\\\\u([dD][c-fC-F][0-9A-Fa-f]{2})"):
            return _literal(0x10000 + ((int(m[1], 16) & 0x3FF) << 10) + (int(m[2], 16) & 0x3FF))
        if "u" in self.flags and (m := self._take(r"u\{([0-9A-Fa-f]+)\}")):
            if int(m[1], 16) > 0x10FFFF:
                raise ValueError("an escape beyond the last letter")
            return _literal(int(m[1], 16))
        if m := self._take("u([0-9A-Fa-f]{4})"):
            return _literal(int(m[1], 16))
        if m := self._take("c([A-Za-z])"):
            return _literal(ord(m[1]) % 32)
        if m := self._take("0(?![0-9])"):
            return r"\x00"
        if m := self._take("[tnvfr]"):
            return _CONTROL[m[0]]
        return None

    def _property(self) -> str | None:
        if "u" not in self.flags:
            return None
        m = self._take(r"([pP])\{(?:(Script|sc|General_Category|gc)=)?(\w+)\}")
        if not m:
            return None
        name = m[3]
        if m[2] in ("Script", "sc") or name in ("Alphabetic", "Uppercase", "Lowercase", "White_Space", "Ideographic"):
            name = "Is" + name
        return f"\\{m[1]}{{{name}}}"

    def _identity(self) -> str:
        c = self.p[self.i]
        self.i += 1
        if "u" in self.flags and c not in "^$\\.*+?()[]{}|/-":
            raise ValueError(f"escape of {c!r}")
        return _literal(ord(c))

    def _escape(self) -> str:
        if self.i >= len(self.p):
            raise ValueError("a backslash at the end")
        if m := self._take("[dws]"):
            return f"[{_CLASS[m[0]]}]"
        if m := self._take("[DWS]"):
            return f"[^{_CLASS[m[0].lower()]}]"
        if self._take("b"):
            return f"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))"
        if self._take("B"):
            return f"(?:(?<=[{_WORD}])(?=[{_WORD}])|(?<![{_WORD}])(?![{_WORD}]))"
        number = None
        if self.names and (m := self._take(r"k<([^>]*)>")):
            if m[1] not in self.names:
                raise ValueError(f"no group {m[1]}")
            number = self.names[m[1]]
        elif (m := re.compile("[1-9][0-9]*").match(self.p, self.i)) and int(m[0]) <= self.count:
            number, self.i = int(m[0]), m.end()
        if number is not None:
            return f"(?:\\{number})" if number <= self.begun else "(?:)"
        if m := self._take("([0-3][0-7]{0,2}|[4-7][0-7]?)"):
            if "u" in self.flags:
                raise ValueError("an octal escape")
            return _literal(int(m[1], 8))
        return self._property() or self._code() or self._identity()

    def _class(self) -> str:
        out, negated = "", bool(self._take(r"\^"))
        while True:
            if self.i >= len(self.p):
                raise ValueError("a class without an end")
            c = self.p[self.i]
            self.i += 1
            if c == "]":
                break
            if c == "-":
                # between two letters a range, else the letter itself
                out += "-" if out and not out.endswith("]") and self.p[self.i : self.i + 1] not in ("]", "") and not re.compile(r"\\[dwsDWSpP]").match(self.p, self.i) and self.ranged else r"\-"
                self.ranged = False
                continue
            self.ranged = True
            if c != "\\":
                out += _literal(ord(c))
            elif m := self._take("[dws]"):
                out, self.ranged = out + f"[{_CLASS[m[0]]}]", False
            elif m := self._take("[DWS]"):
                out, self.ranged = out + f"[^{_CLASS[m[0].lower()]}]", False
            elif self._take("b"):
                out += r"\x08"
            elif self._take("-"):
                out += r"\-"
            elif (found := self._property()) is not None:
                out, self.ranged = out + found, False
            else:
                out += self._code() or self._identity()
        if not out:
            return r"[\x{0}-\x{10FFFF}]" if negated else "(?!)"
        return f"[{'^' if negated else ''}{out}]"

    def whole(self) -> str:
        out = []
        while self.i < len(self.p):
            c = self.p[self.i]
            quantifier = _QUANTIFIER.match(self.p, self.i)
            named = _GROUP.match(self.p, self.i)
            self.i += 1
            if c == "\\":
                out.append(self._escape())
            elif c == "[":
                self.ranged = False
                out.append(self._class())
            elif named or (c == "(" and self.p[self.i : self.i + 1] != "?"):
                self.i = named.end() if named else self.i
                self.begun += 1
                out.append("(")
            elif c == "(":
                m = self._take(r"\?(?::|=|!|<=|<!)")
                if not m:
                    raise ValueError("a group of no known kind")
                out.append("(" + m[0])
            elif c == ".":
                out.append(r"[\x{0}-\x{10FFFF}]" if "s" in self.flags else f"[^{_ENDS}]")
            elif c == "^":
                out.append(f"(?:\\A|(?<=[{_ENDS}]))" if "m" in self.flags else r"\A")
            elif c == "$":
                out.append(f"(?:\\z|(?=[{_ENDS}]))" if "m" in self.flags else r"\z")
            elif quantifier:
                self.i = quantifier.end()
                out.append(quantifier[0])
            elif c in "*+?|)":
                out.append(c)
            elif c in "{}]" and "u" in self.flags:
                raise ValueError(f"{c!r} by itself")
            else:
                out.append(_literal(ord(c)))
        text = "".join(out)
        text = f"(?iu:{text})" if "i" in self.flags else text
        return rf"\G(?:{text})" if "y" in self.flags else text


def translate(pattern: str, flags: str = "") -> str:
    """The pattern as the session's engine reads it."""
    return _Translation(pattern, flags).whole()


def groups(pattern: str) -> tuple[dict[str, int], int]:
    """Numbers of the named groups, and how many groups there are."""
    t = _Translation(pattern, "")
    return t.names, t.count


def test(text: Column, pattern: str, flags: str = "") -> Column:
    """Whether a text has a match."""
    return text.rlike(translate(pattern, flags))


def replace_all(text: Column, pattern: str, new: str, flags: str = "g") -> Column:
    """Every match replaced; `new` may name groups: $1, $<name>, $& for the match, $$ for a dollar sign."""
    names, count = groups(pattern)

    def part(m: re.Match) -> str:
        if m[1] is not None:
            return "$0" if m[1] == "&" else "\\$"
        if m[2] is not None:
            return f"${names[m[2]]}" if m[2] in names else ""
        if 0 < int(m[3]) <= count:
            return f"${int(m[3])}"
        # of two digits the first may be a group's number
        return f"${m[3][0]}\\{m[3][1]}" if len(m[3]) == 2 and 0 < int(m[3][0]) <= count else "\\$" + m[3]

    parts = re.split(r"(\$[&$]|\$<[^>]*>|\$[0-9]{1,2})", new)
    made = [part(re.match(r"\$(?:([&$])|<([^>]*)>|([0-9]{1,2}))", x)) if k % 2 else x.replace("\\", "\\\\").replace("$", "\\$") for k, x in enumerate(parts)]
    # a digit behind a group's number would be read as part of it
    text_ = "".join(x + ("\\" if x.startswith("$") and k + 1 < len(made) and made[k + 1][:1].isdigit() else "") for k, x in enumerate(made))
    return F.regexp_replace(text, translate(pattern, flags), text_)


def matches(rows: DataFrame, text: str, pattern: str, flags: str = "g") -> DataFrame:
    """A row for each match in each row's text: the columns of rows but the text, and no (from 1), start, end, match, groups. Without the
    flag g only the first. Rows without a match, or with a null text, give none."""
    _, count = groups(pattern)
    clean = F.translate(F.col(f"`{text}`"), _OPEN + _BETWEEN + _CLOSE, "\ufffd" * 3)
    # after each match its groups, and what follows up to the next
    marked = F.regexp_replace(clean, translate(pattern, flags), _OPEN + _BETWEEN.join(f"${k}" for k in range(count + 1)) + _CLOSE)
    rest = [c for c in rows.columns if c != text]
    # numbered before they are split: each row has one number
    rows = rows.where(F.col(f"`{text}`").isNotNull()).select("*", F.monotonically_increasing_id().alias("__row"))
    pieces = rows.select("__row", *[F.col(f"`{c}`") for c in rest], F.posexplode(F.split(marked, _OPEN, -1)).alias("no", "__piece"))
    found = F.split("__piece", _CLOSE, 2)
    pieces = pieces.withColumn("__found", F.when(F.col("no") > 0, F.split(F.get(found, 0), _BETWEEN, -1)))
    size = F.when(F.col("no") > 0, F.length(F.get("__found", 0)) + F.length(F.get(found, 1))).otherwise(F.length("__piece"))
    pieces = pieces.withColumn("__size", size).drop("__piece")
    start = F.coalesce(F.sum("__size").over(Window.partitionBy("__row").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.withColumn("start", start.cast("long")).where("no > 0" if "g" in flags else "no = 1")
    match = F.get("__found", 0)
    return pieces.select(*[F.col(f"`{c}`") for c in rest], "no", "start", (F.col("start") + F.length(match)).alias("end"), match.alias("match"), F.slice("__found", 2, max(count, 1)).alias("groups"))


def utf16_length(text: Column) -> Column:
    """Units of UTF-16: letters beyond the basic plane are two."""
    return F.floor(F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def utf16_place(text: Column, place: Column) -> Column:
    """The place in units of a place in code points."""
    return utf16_length(F.substr(text, F.lit(1), place.cast("int")))


def utf16_slice(text: Column, start: int, end: int | None = None) -> Column:
    """slice(start, end) by units; half of a letter that is cut through reads as U+FFFD."""
    n = utf16_length(text)
    place = lambda i: F.greatest(n + i, F.lit(0)) if i < 0 else F.least(F.lit(i), n)
    a, b = place(start), n if end is None else place(end)
    units = F.substr(F.encode(text, "UTF-16BE"), (2 * a + 1).cast("int"), (2 * F.greatest(b - a, F.lit(0))).cast("int"))
    return _from_units(units)


def _from_units(units: Column) -> Column:
    """Units as text: a half at either end gives U+FFFD. Halves elsewhere cannot come from a text."""
    digits = F.hex(units)
    head, tail = digits.rlike("^D[C-F]"), digits.rlike("^(?:.{4})*D[89AB]..$")
    body = F.substr(digits, F.when(head, 5).otherwise(1), F.length(digits) - F.when(head, 4).otherwise(0) - F.when(tail, 4).otherwise(0))
    return F.concat(F.when(head, "\ufffd").otherwise(""), F.decode(F.unhex(body), "UTF-16BE"), F.when(tail, "\ufffd").otherwise(""))


def utf16_index_of(text: Column, part: str) -> Column:
    """The first place of a part, in units; -1 if there is none."""
    at = F.instr(text, part)
    return F.when(at == 0, F.lit(-1).cast("long")).otherwise(utf16_place(text, at - 1))


def utf16_code_at(text: Column, i: int) -> Column:
    """The unit at a place; null beyond the ends."""
    return F.when(utf16_length(text) > i, F.conv(F.hex(F.substr(F.encode(text, "UTF-16BE"), F.lit(2 * i + 1), F.lit(2))), 16, 10).cast("int")) if i >= 0 else F.lit(None).cast("int")
