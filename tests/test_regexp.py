"""Patterns of the script language: expected places and groups are those of the language itself."""

import pytest
from pyspark.sql import functions as F

from tarnweave.functions import regexp as R

#: pattern, flags, text, matches as start, end, groups
CASES = [
    ("a", "g", "xaxa", [(1, 2), (3, 4)]), ("ab*c", "", "abbc", [(0, 4)]), ("(ab)*c", "", "ababc", [(0, 5, "ab")]), ("cd((e)fg)hi", "", "abcdefghijk", [(2, 9, "efg", "e")]),
    ("^abc", "", "xabc", []), ("^abc", "gm", "x\nabc\rabc", [(2, 5), (6, 9)]), ("abc$", "", "abc\n", []), ("abc$", "m", "abc x", [(0, 3)]), ("a.c", "g", "a\u0085c a\nc", [(0, 3)]), ("a.c", "s", "a\nc", [(0, 3)]),
    ("ab{3,5}c", "", "abbbbbc", [(0, 7)]), ("ab{3,5}c", "", "abbbbbbc", []), ("tour|to|tournament", "", "tournament", [(0, 4)]), ("(tour|to|t)+$", "", "tourtoto", [(0, 8, "to")]), ("a{,3}", "", "xa{,3}", [(1, 6)]), ("x{", "", "x{", [(0, 2)]),
    (r"(?<y>\d{4})-(?<m>\d\d)", "g", "2024-05 1999-12", [(0, 7, "2024", "05"), (8, 15, "1999", "12")]), (r"(?<q_$>['\"])x\k<q_$>", "", "'x\" \"x\"", [(4, 7, '"')]), (r"\k<a>", "", "k<a>", [(0, 4)]), (r"\1(a)", "", "a", [(0, 1, "a")]), (r"(a)\1", "", "aa", [(0, 2, "a")]), (r"(a)\2", "", "a\x02", [(0, 2, "a")]),
    (r"\bfoo\b", "g", "foo éfoo foo_ foo", [(0, 3), (5, 8), (14, 17)]), (r"\Boo", "", "oo foo", [(4, 6)]), (r"\s", "g", "a b᠎c﻿", [(1, 2), (5, 6)]), (r"[\s\d-x]+", "", "q1 -x", [(1, 5)]), (r"\w+", "g", "é_a1", [(1, 4)]),
    ("[^]", "g", "a\n", [(0, 1), (1, 2)]), ("[]", "g", "a", []), ("[a&&b]+", "", "x&ab", [(1, 4)]), ("[[a]+", "", "x[a[", [(1, 4)]), (r"[\b]", "", "a\x08", [(1, 2)]), ("[a-c-e]+", "", "xb-ed", [(1, 4)]), ("[-a]+", "", "b-a", [(1, 3)]), (r"[\]x]+", "", "a]x", [(1, 3)]),
    (r"A\x42\cJ\0", "", "AB\n\x00", [(0, 4)]), (r"😀", "", "x😀", [(1, 2)]), (r"\u{1F600}", "u", "x😀", [(1, 2)]), (r"\u{3}", "", "uuu", [(0, 3)]), (r"^.$", "u", "😀", [(0, 1)]), (r"\p{Lu}\p{Script=Greek}", "u", "aÉα", [(1, 3)]), (r"\-\/\#", "", "-/#", [(0, 3)]), (r"\07", "", "\x07", [(0, 1)]),
    ("É", "i", "é", [(0, 1)]), ("a", "gy", "aaba", [(0, 1), (1, 2)]), ("b", "y", "ab", []), ("a*", "g", "aab", [(0, 2), (2, 2), (3, 3)]), ("", "g", "ab", [(0, 0), (1, 1), (2, 2)]), ("(?<=a)b(?=c)(?!d)", "g", "abc bbc", [(1, 2)]), ("(?<!a)b", "g", "ab b", [(3, 4)]), ("(x)|(y)", "g", "yx", [(0, 1, "", "y"), (1, 2, "x", "")]), ("(a*)*", "", "b", [(0, 0, "")]), ("#", "g", "a#b #", [(1, 2), (4, 5)]),
    ("a﷐?", "g", "a﷐b", [(0, 1)]),
]


@pytest.mark.parametrize("batch", range(0, len(CASES), 10))
def test_matches(spark, batch):
    for pattern, flags, text, want in CASES[batch : batch + 10]:
        df = spark.createDataFrame([(1, text), (2, None)], "id long, t string")
        got = [(r["start"], r["end"], *r["groups"]) for r in R.matches(df, "t", pattern, flags).orderBy("no").collect()]
        assert got == want, (pattern, flags, text)
        if want:
            assert df.where(R.test(F.col("t"), pattern, flags)).count() == 1


@pytest.mark.parametrize("pattern, flags", [("[a", ""), ("(?a)", ""), ("a", "x"), ("a", "gg"), (r"\k<b>(?<a>x)", ""), (r"(?<a>x)(?<a>y)", ""), ("\\", ""), (r"\q", "u"), ("{", "u"), (r"\u{110000}", "u"), (r"\01", "u")])
def test_patterns_that_are_not_valid(pattern, flags):
    with pytest.raises(ValueError):
        R.translate(pattern, flags)


def test_replacements(spark):
    df = spark.createDataFrame([("2024-05 x",)], "t string")
    made = [R.replace_all(F.col("t"), r"(?<y>\d+)-(\d+)", new) for new in ("$2/$<y>", "[$&]$$1", "$1\\0", "$9$<no>", "$10")]
    assert list(df.select(*made).first()) == ["05/2024 x", "[2024-05]$1 x", "2024\\0 x", "$9 x", "20240 x"]


UTF16 = ["", "abc", "a😀b😀", "😀", "é\U0010ffffz", "x" * 50 + "😀" * 3]


def test_units(spark):
    units = lambda s: s.encode("utf-16-be", "surrogatepass")
    df = spark.createDataFrame([(s,) for s in UTF16], "t string")
    t = F.col("t")
    spans = [(0, 2), (1, 3), (2, None), (-3, -1), (-1, None), (3, 1), (0, 100)]
    got = {r["t"]: r for r in df.select("t", R.utf16_length(t).alias("n"), R.utf16_index_of(t, "b").alias("i"), R.utf16_code_at(t, 1).alias("c"), *[R.utf16_slice(t, a, b).alias(f"s{k}") for k, (a, b) in enumerate(spans)]).collect()}
    for s in UTF16:
        u = [units(s)[i : i + 2] for i in range(0, len(units(s)), 2)]
        assert got[s]["n"] == len(u) and got[s]["i"] == (-1 if "b" not in s else len(units(s[: s.index("b")])) // 2) and got[s]["c"] == (int.from_bytes(u[1]) if len(u) > 1 else None)
        for k, (a, b) in enumerate(spans):
            part = b"".join(u[a:b] if not (a == 3 and b == 1) else [])
            # a half of a letter, at either end
            assert got[s][f"s{k}"] == "".join("\ufffd" if 0xD800 <= ord(c) < 0xE000 else c for c in part.decode("utf-16-be", "surrogatepass"))
