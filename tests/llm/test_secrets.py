import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import urllib.parse
import zlib

import pytest
import zstandard

from tarnweave.llm.secrets import find, secret_digest, secret_spans

from .data import documents, odd_rows

SECRET = "password=abcd1234efgh"
B64 = lambda x: base64.b64encode(x).decode()


@pytest.mark.parametrize("encoded", [
    urllib.parse.quote(SECRET), urllib.parse.quote(urllib.parse.quote(SECRET)), "".join(f"\\u{ord(c):04x}" for c in SECRET), B64(SECRET.encode()),
    B64(B64(SECRET.encode()).encode()), B64(gzip.compress(SECRET.encode())), urllib.parse.quote(B64(gzip.compress(B64(SECRET.encode()).encode())) + "=", safe=""),
])
def test_layers(encoded):
    text = f"é see {encoded} there"
    base, spans, layers = find(text)
    assert base == [] and layers >= 1
    assert any(kind == "assign" and text[a:b] in encoded and b - a > 8 for a, b, kind in spans)


WHOLE = b"the config has password=hunter2hunter2 set"
WRAP = lambda x, n: "\n".join(x[i : i + n] for i in range(0, len(x), n))
NOISE = bytes(range(33, 120)) * 3


@pytest.mark.parametrize("before", ["/v1/", "x/", "ab/", "abc/", "data-", "data_", "https://h.com/get/", "Zm9v", "q", "qr", "qrs"])
@pytest.mark.parametrize("inner", [WHOLE, gzip.compress(WHOLE), zlib.compress(WHOLE), B64(gzip.compress(WHOLE)).encode()])
def test_letters_before_a_stretch(before, inner):
    text = f"é {before}{B64(inner)} there"
    base, spans, layers = find(text)
    assert base == [] and layers >= 1 and any(kind == "assign" and a <= 2 + len(before) and b == len(text) - 6 for a, b, kind in spans)


@pytest.mark.parametrize("end", ["\n", "\r\n", "\n  "])
@pytest.mark.parametrize("n", [64, 76])
@pytest.mark.parametrize("data", [NOISE[:40] + b" password=hunter2hunter2 ", gzip.compress(random.Random(1).randbytes(200).hex(" ").encode() + b" password=hunter2hunter2 ")])
def test_stretches_go_on_over_line_breaks(data, n, end):
    wrapped = WRAP(B64(data), n).replace("\n", end)
    text = f"head:\n\n{wrapped}\n\ntail"
    assert "\n" in wrapped and (7, len(text) - 6, "assign") in find(text)[1]


def test_a_secret_within_a_line_is_listed_once():
    text = WRAP(B64(b"password=hunter2hunter2 " + b"x" * 100), 76)
    assert [s for s in find(text)[1] if s[2] == "assign"] == [(0, 76, "assign")]


@pytest.mark.parametrize("data", [b"\xff" + WHOLE, WHOLE + b" \xe9t\xe9", gzip.compress(b"\xff" + WHOLE), WHOLE.decode().encode("utf-16"), WHOLE.decode().encode("utf-16-le"), WHOLE.decode().encode("utf-16-be"), b"\x00\x01" * 60 + WHOLE])
def test_layers_that_are_not_utf8(data):
    text = f"é {B64(data)} there"
    assert (2, len(text) - 6, "assign") in find(text)[1]


def test_damaged_content_is_read_up_to_the_damage():
    data = gzip.compress(WHOLE + random.Random(1).randbytes(4000))
    text = "é " + B64(data[:-900])
    assert (2, len(text), "assign") in find(text)[1]
    assert find("é " + B64(b"\x1f\x8b\x08" + b"\xff" * 60))[1] == []


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, zstandard.ZstdCompressor().compress])
def test_what_bursts_is_read_in_steps(pack):
    import resource

    bomb = pack(b"0" * 60_000_000 + b" " + WHOLE)
    text = "é " + B64(pack(bomb))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert {s[2] for s in find(text)[1] if s[:2] == (2, len(text))} >= {"assign", "hex"}
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 60_000
    assert not any(s[2] == "assign" for s in find(text, limit=1 << 20)[1])


ENCODERS = {
    "url": lambda x: "".join(f"%{c:02X}" for c in x.encode()), "unicode": lambda x: "".join(f"\\u{ord(c):04x}" for c in x), "entity": lambda x: "".join(f"&#{ord(c)};" for c in x),
    "base64": lambda x: B64(x.encode()), "gzip": lambda x: B64(gzip.compress(x.encode())), "zlib": lambda x: B64(zlib.compress(x.encode())), "zstd": lambda x: B64(zstandard.ZstdCompressor().compress(x.encode())),
}


@pytest.mark.parametrize("outer", ENCODERS)
@pytest.mark.parametrize("inner", ENCODERS)
def test_each_nesting_of_two(inner, outer):
    """Escapes map letter by letter, base64 and compressed layers as a whole."""
    clear, unit = "the config has password=hunter2hunter2 set", {"url": 3, "unicode": 6}
    code = ENCODERS[inner](clear)
    text = "é " + ENCODERS[outer](code) + " end"
    a, b = clear.index("password"), clear.index(" set")
    if inner == "entity":
        a, b = (len(ENCODERS[inner](clear[:x])) for x in (a, b))
    elif inner in unit:
        a, b = a * unit[inner], b * unit[inner]
    else:
        a, b = 0, len(code.rstrip("=")) if outer in unit or outer == "entity" else len(code)
    if outer == "entity":
        a, b = (len(ENCODERS[outer](code[:x])) for x in (a, b))
    elif outer in unit:
        a, b = a * unit[outer], b * unit[outer]
    else:
        a, b = 0, len(ENCODERS[outer](code))
    got = [s for s in find(text)[1] if s[2] == "assign"]
    assert len(got) == 1 and got[0][0] == 2 + a and abs(got[0][1] - 2 - b) <= 2 * 6


def test_what_has_no_secret_opens_no_layer():
    r = random.Random(2)
    assert find(" ".join(B64(r.randbytes(300)) for _ in range(200)))[1:] == ([], 0)


def test_cycles_end():
    text = "%2525" * 50 + " " + "A" * 400
    assert find(text)[2] < 60


def brute(text):
    text, out = text or "", []
    for kind, p, g, n in (("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32)):
        out += [(m.start(), ("assign", "access", "hex").index(kind), kind, m.end()) for m in re.finditer(p, text, re.ASCII) if len(m[g]) >= n]
    return sorted(out)


def test_base_spans(spark):
    texts = [None, "", "token = \"" + "ab" * 20 + "\" AKIA" + "Z" * 14 + " Secret:'x' PASSWD:12345678", "ſecret=12345678 api-key=12345678 apikey:abcdefgh_", "a" * 31 + "g" + "f" * 32, "token=token=abcdefgh"]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + odd_rows()
    got = sorted(map(tuple, secret_digest(documents(spark, rows)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256").collect()), key=repr)
    want = []
    for i, t, _ in rows:
        spans = brute(t)
        n = [sum(1 for s in spans if s[2] == k) for k in ("assign", "access", "hex")]
        want.append((i, *n, hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans).encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_operator_returns_the_texts(spark):
    text = "x " + B64(SECRET.encode())
    r = secret_spans(documents(spark, [(1, text, "s")])).first()
    assert r["base"] == [] and r["layers"] == 1 and r["spans"][0]["found"] == text[2:]
    assert secret_digest(documents(spark, [])).count() == 0


def test_long_texts(spark):
    text = "word " * 400_000 + SECRET + " " + B64(SECRET.encode()) + " " + "f" * 3_000_000
    r = secret_digest(documents(spark, [(1, text, "s")])).first()
    assert (r["n_assign"], r["n_access"], r["n_hex"]) == (1, 0, 1) and r["spans"].count("assign") == 2


PACKERS = {"gzip": gzip.compress, "zlib": zlib.compress, "zstd": zstandard.ZstdCompressor().compress, "bzip2": bz2.compress, "xz": lzma.compress, "deflate": lambda x: zlib.compress(x)[2:-4]}


@pytest.mark.parametrize("pack", PACKERS)
def test_each_compression(pack):
    text = "é " + B64(PACKERS[pack](WHOLE))
    assert [s for s in find(text)[1] if s[2] == "assign"] == [(2, len(text), "assign")]


def hidden(size):
    """Words that do not compress away, a secret behind them."""
    r = random.Random(size)
    return " ".join(str(r.getrandbits(40)) for _ in range(size // 13)).encode() + b" " + WHOLE


@pytest.mark.parametrize("outer, inner, size", [(o, i, n) for o, i in (("gzip", "gzip"), ("zstd", "plain"), ("gzip", "url"), ("zlib", "lines")) for n in (200_000, 3_000_000)] + [("gzip", "gzip", 20_000_000)])
def test_nothing_is_lost_by_size(outer, inner, size):
    data = hidden(size)
    code = {"gzip": lambda: B64(gzip.compress(data, 1)), "plain": lambda: B64(data), "lines": lambda: WRAP(B64(zlib.compress(data, 1)), 76).replace("\n", "\r\n"), "url": lambda: urllib.parse.quote(B64(gzip.compress(data, 1)), safe="")}[inner]()
    text = "é " + B64(PACKERS[outer](b"see " + code.encode() + b" there")) + " end"
    assert [s for s in find(text)[1] if s[2] == "assign"] == [(2, len(text) - 4, "assign")]


def test_three_long_layers():
    data = hidden(4_000_000)
    for pack in (gzip.compress, zlib.compress, bz2.compress):
        data = B64(pack(data)).encode()
    assert [s for s in find("é " + data.decode())[1] if s[2] == "assign"] == [(2, 2 + len(data), "assign")]


def test_content_that_holds_itself_ends():
    from tarnweave.llm.secrets import _Budget, _Inflated

    head = gzip.compress(b"x" * 100)
    inner = _Inflated(head, False, _Budget(None), frozenset({b"x" * 64}))
    assert list(inner.feed(head)) == [] and inner.steps is None


def test_what_was_cut_is_told(spark):
    text = "é " + B64(gzip.compress(hidden(300_000)))
    docs = documents(spark, [(1, text, "s"), (2, "plain", "s")])
    assert [r["cut"] for r in secret_digest(docs, limit=100_000).orderBy("doc_id").collect()] == [True, False]
    assert [(r["cut"], "assign" in r["spans"]) for r in secret_digest(docs, limit=None).orderBy("doc_id").collect()] == [(False, True), (False, False)]
