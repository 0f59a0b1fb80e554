"""Secret scans with a recursive decoding worklist.

A text is scanned for secrets; then each encoded stretch in it (URL escapes, Unicode escapes,
base64, and compressed bytes inside base64) is unwrapped into a layer, which is scanned in turn
and searched for further encoded stretches, until no new layer appears. Layers that were seen
before (by digest) are not opened again, so the worklist ends. Spans found in a layer are mapped
back to the outermost text: URL and Unicode escapes letter by letter, base64 and compressed
layers to the whole stretch that encodes them. Spans count code points, the end is exclusive.

A stretch of base64 is read at each of its four alignments and also joined across single line
breaks, and compressed bytes (gzip, zlib, Zstandard, bzip2, xz) are looked for at each place of the decoded bytes, raw deflate
at their start, so letters before an encoded secret do not hide it. What is not printable UTF-8 at the first alignment is read as
Latin-1 and UTF-16.

Decoded content that is longer than a step is read in windows of a step that overlap, each a layer. What is encoded in it and goes on over a
window's end is a stream: its decoders stay open from window to window, one inside the other, so that no size hides a secret and only
windows are held in memory. (Base64 in UTF-16 is read within windows only.)

Edge cases: a null text counts as empty and has no spans; a layer read as Latin-1, as UTF-16 or at
another alignment counts as a layer only if it has a secret; compressed content is read up to where it is damaged, and no further
where it holds itself; it ends after `limit` bytes for each stretch that holds it (`INFLATED`, 1 GiB, if not given; None: no limit), which
the column `cut` tells; a span found both plainly and in a layer is listed once, and a secret that a
line of a joined stretch has by itself is listed for that line. Rows that repeat an id
give a row each; other columns are never read.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
#: Decoded content is read in windows of so many bytes that overlap by so many; compressed content ends after so many.
STEP, OVERLAP, INFLATED = 1 << 20, 1 << 16, 1 << 30
_ASSIGN = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
_HEXES = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:={1,2}|%3[dD](?:%3[dD])?)?")
#: Base64 letters over several lines.
_JOINED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++)++(?:={1,2}|%3[dD](?:%3[dD])?)?")
_BREAK = re.compile(r"\r?\n[\x20\t]*")
#: Where compressed bytes may begin: gzip, Zstandard, zlib, bzip2, xz.
_MAGIC = re.compile(rb"\x1f\x8b\x08|\x28\xb5\x2f\xfd|\x78[\x01\x5e\x9c\xda]|BZh[1-9]1AY|\xfd7zXZ\x00")
#: Base64 letters over lines, with a line break behind them; what goes on with them.
_RUN = re.compile(rb"[A-Za-z0-9+/_-]++(?:\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++)*+(?:\r?\n[\x20\t]*+|\r)?+")
_ON = re.compile(rb"(?:[A-Za-z0-9+/_-]++|\r?\n[\x20\t]*+)*+")
_BLANK = re.compile(rb"(?:\r|\r?\n[\x20\t]*)\Z")
#: Escapes in bytes; an escaped escape sign, however often.
_URL_BYTES = re.compile(rb"%(?:25)*([0-9A-Fa-f]{2})")
_SIGN = re.compile(rb"(\\)u005[cC](?:u005[cC])*(?=u)|(&)#38;(?:#38;)*(?=#)")
#: Without one of these, bytes have neither a secret nor an encoded stretch (of 16 base64 letters).
_HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key", b"%", b"\\u", b"\\x", b"&#")
#: Bytes as kinds: a base64 letter, s space, n and r line break, x other.
_KIND = bytes(ord("a" if chr(b).isascii() and (chr(b).isalnum() or chr(b) in "+/_-") else "s" if b in (9, 32) else "n" if b == 10 else "r" if b == 13 else "x") for b in range(256))
_PLAIN = bytes(b for b in range(256) if b in (9, 10, 13) or 32 <= b < 127)
_WIDE = re.compile(rb"(?:[\x20-\x7e]\x00){8}")
#: Quick tests: without one of these, a text has none of what the patterns above look for.
_ANY_WORD = re.compile(r"(?:password|passwd|secret|token|api_?key)", re.IGNORECASE | re.ASCII)

Span = tuple[int, int, str]


def scan(text: str) -> list[Span]:
    """Secrets in one layer: start, end, kind; leftmost and not overlapping, kind by kind."""
    out = []
    if (":" in text or "=" in text) and _ANY_WORD.search(text):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return out


class Layer:
    """Text with its place in the outermost text: runs of letters that map one to one, and
    stretches that map as a whole. pieces: (start here, start outside, end outside, one to one)."""

    def __init__(self, text: str, pieces: list[tuple[int, int, int, bool]], stray: bool = False, streamed: tuple[bool, bool, bool] = (False, False, False)):
        # stray: read on suspicion; without a secret it is no layer
        # streamed: whether a stream reads its escapes, the base64 at its start, that at its end
        self.text, self.pieces, self.stray, self.streamed = text, pieces, stray, streamed
        self.starts = [p[0] for p in pieces]

    def place(self, start: int, end: int) -> tuple[int, int]:
        a = self.pieces[bisect_right(self.starts, start) - 1]
        b = self.pieces[bisect_right(self.starts, end - 1) - 1]
        lo = a[1] + (start - a[0]) if a[3] else a[1]
        hi = b[1] + (end - b[0]) if b[3] else b[2]
        return lo, hi


def _printable(data: bytes) -> str | None:
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    odd = len(data.translate(None, _PLAIN)) if text.isascii() else sum(1 for c in text if not (c.isprintable() or c in "\t\r\n"))
    return text if text and odd * 10 <= len(text) else None


def _hint(data: bytes) -> bool:
    low = data.lower()
    return any(x in low for x in _HINTS) or b"a" * 16 in data.translate(_KIND)


def _engine(head: bytes, raw: bool = False):
    """What inflates content that begins so, a step at a time; None for other content. raw: as deflate without a header."""
    if raw or head[:2] == b"\x1f\x8b" or (len(head) > 2 and head[0] & 15 == 8 and (head[0] << 8 | head[1]) % 31 == 0):
        engine = zlib.decompressobj(-15 if raw else 47)

        def steps(part: bytes):
            while part and not engine.eof:
                yield engine.decompress(part, STEP)
                part = engine.unconsumed_tail

        return steps
    if head[:3] == b"BZh" or head[:6] == b"\xfd7zXZ\x00":
        other = bz2.BZ2Decompressor() if head[:1] == b"B" else lzma.LZMADecompressor(memlimit=1 << 27)

        def chunks(part: bytes):
            while not other.eof and (part or not other.needs_input):
                yield other.decompress(part, STEP)
                part = b""

        return chunks
    if head[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        engine_ = zstandard.ZstdDecompressor(max_window_size=1 << 27).decompressobj()
        # a few bytes at a time: Zstandard tells no bound for what comes out of more
        return lambda part: (engine_.decompress(part[i : i + 64]) for i in range(0, len(part), 64))
    return None


class _Budget:
    """What may still be inflated for one stretch."""

    def __init__(self, limit: int | None):
        self.left, self.cut = limit, False

    def take(self, n: int) -> bool:
        if self.left is not None:
            self.left -= n
            self.cut |= self.left <= 0
        return not self.cut


class _Inflated:
    """Compressed bytes, fed in parts; their content is fed on."""

    def __init__(self, head: bytes, stray: bool, budget: _Budget, heads: frozenset, raw: bool = False):
        self.steps, self.budget, self.stray = _engine(head, raw), budget, stray
        self.heads, self.inner = heads | {head[:64]}, None

    def feed(self, part: bytes):
        if not self.steps:
            return
        steps = self.steps(part)
        while True:
            try:
                out = next(steps, None)
            except Exception as e:  # noqa: BLE001  what stands behind the damage cannot be read
                if not isinstance(e, (zlib.error, ValueError, MemoryError, OSError, EOFError, lzma.LZMAError)) and type(e).__name__ != "ZstdError":
                    raise
                self.steps = None
                return
            if out is None:
                return
            if out:
                if self.inner is None:
                    if out[:64] in self.heads:  # content that holds itself
                        self.steps = None
                        return
                    self.inner = _Bytes(True, self.stray, self.budget, self.heads)
                yield from self.inner.feed(out)
                if not self.budget.take(len(out)):
                    self.steps = None
                    return

    def close(self):
        if self.inner is not None:
            yield from self.inner.close()


class _Bytes:
    """Decoded bytes, fed in parts: read as text, and inflated from each place where compressed bytes may begin. Gives the texts
    found: text, whether stray, what is streamed. first: read at the first alignment."""

    def __init__(self, first: bool, stray: bool, budget: _Budget, heads: frozenset = frozenset()):
        self.first, self.stray, self.budget, self.heads = first, stray, budget, heads
        self.open, self.held, self.plain, self.begun = [], b"", None, False

    def feed(self, data: bytes):
        for lo in range(0, len(data), STEP):
            yield from self._feed(data[lo : lo + STEP], False)

    def _feed(self, data: bytes, last: bool):
        data = self.held + data
        # a magic number may go on in the next part
        stop = len(data) if last else max(0, len(data) - 64)
        self.held = data[stop:]
        if not stop:
            return
        ahead, data = data, data[:stop]
        packed = False
        for inflated in self.open:
            yield from inflated.feed(data)
        if not self.begun:
            packed = _engine(ahead) is not None
            if not packed and _deflated(ahead):
                self.open.append(deflated := _Inflated(ahead, True, self.budget, self.heads, True))
                yield from deflated.feed(data)
            self.plain = _Windows(self.first and not packed, self.stray, self.budget, self.heads)
        for m in [m for m in _MAGIC.finditer(ahead) if m.start() < stop] + ([None] if packed and not _MAGIC.match(ahead) else []):
            at = m.start() if m else 0
            inflated = _Inflated(ahead[at:], self.stray or at > 0 or self.begun, self.budget, self.heads)
            if inflated.steps:
                yield from inflated.feed(data[at:])
                if inflated.steps:
                    self.open.append(inflated)
                else:
                    yield from inflated.close()
        self.begun = True
        for inflated in [x for x in self.open if not x.steps]:
            self.open.remove(inflated)
            yield from inflated.close()
        yield from self.plain.feed(data)

    def close(self):
        yield from self._feed(b"", True)
        for inflated in self.open:
            yield from inflated.close()
        if self.plain:
            yield from self.plain.close()


class _Windows:
    """Content fed in parts, read as texts in windows that overlap. Escapes, and base64 that goes on over a window's end, are streams."""

    def __init__(self, first: bool, stray: bool, budget: _Budget, heads: frozenset, escapes: bool = True):
        self.first, self.stray, self.budget, self.heads, self.escapes = first, stray, budget, heads, escapes
        self.held, self.seen, self.long = b"", 0, False
        self.run, self.blank = None, b""
        self.clear, self.rest = None, b""

    def feed(self, data: bytes):
        self.held += data
        while len(self.held) >= STEP:
            yield from self._window(self.held[:STEP], False)
            self.held, self.seen = self.held[STEP - OVERLAP :], OVERLAP

    def close(self):
        if len(self.held) > self.seen or not self.long:
            yield from self._window(self.held, True)
        yield from self._end_run()
        if self.clear:
            yield from self.clear.feed(self.rest)
            yield from self.clear.close()

    def _end_run(self):
        if self.run:
            for decoder in self.run:
                yield from decoder.close()
        self.run = None

    def _window(self, window: bytes, last: bool):
        self.long |= not last
        before = self.run is not None
        if self.long:
            fresh = window[self.seen :]
            if self.escapes:
                yield from self._unescape(window, fresh)
            if self.run:
                fresh = self.blank + fresh
                on = _ON.match(fresh).end()
                self.blank = b"" if on < len(fresh) or last or not (m := _BLANK.search(fresh)) else m.group()
                for decoder in self.run:
                    yield from decoder.feed(fresh[: on - len(self.blank)])
                if on < len(fresh) and not self.blank:
                    yield from self._end_run()
            if not self.run and not last:
                kinds, found = window.translate(_KIND), None
                for found in _RUN.finditer(window, max(kinds.rfind(b"x"), kinds.rfind(b"as")) + 1):
                    pass
                if found and found.end() == len(window) and found.start() < len(window) - OVERLAP:
                    self.blank = m.group() if (m := _BLANK.search(found.group())) else b""
                    self.run = [_Base64(skip, self.budget, self.heads) for skip in range(4)]
                    for decoder in self.run:
                        yield from decoder.feed(found.group()[: len(found.group()) - len(self.blank)])
        streamed = (self.clear is not None, before, self.run is not None)
        for text, stray in _texts(window, self.first):
            yield text, stray or self.stray, streamed

    def _unescape(self, window: bytes, fresh: bytes):
        if not self.clear:
            if not (b"%" in window and _URL_BYTES.search(window) or b"\\" in window or b"&#" in window):
                return
            self.clear, fresh = _Windows(self.first, self.stray, self.budget, self.heads, False), window
        fresh = self.rest + fresh
        sign = max(fresh.rfind(c) for c in (b"%", b"\\", b"&"))
        stop = sign if sign >= max(0, len(fresh) - 12) else len(fresh)
        fresh, self.rest = fresh[:stop], fresh[stop:]
        old = None
        while fresh != old:
            old, fresh = fresh, _URL_BYTES.sub(lambda m: bytes.fromhex(m[1].decode()), fresh)
            if b"\\" in fresh or b"&#" in fresh:
                fresh = _SIGN.sub(lambda m: m[1] or m[2], fresh)
                fresh = _ESCAPE.sub(_escape, fresh.decode("utf-8", "surrogateescape")).encode("utf-8", "surrogateescape")
        yield from self.clear.feed(fresh)


class _Base64:
    """A stretch of base64 at one alignment, fed in parts, line breaks among them."""

    def __init__(self, skip: int, budget: _Budget, heads: frozenset):
        self.skip, self.held, self.inner = skip, b"", _Bytes(skip == 0, skip > 0, budget, heads)

    def feed(self, part: bytes):
        letters = self.held + part.translate(_TO_BASE64, b"\r\n\x20\t")
        n = min(self.skip, len(letters))
        self.skip, letters = self.skip - n, letters[n:]
        stop = len(letters) // 4 * 4
        self.held = letters[stop:]
        if stop:
            yield from self.inner.feed(binascii.a2b_base64(letters[:stop]))

    def close(self):
        if len(self.held) > 1:
            yield from self.inner.feed(binascii.a2b_base64(self.held + b"=" * (-len(self.held) % 4)))
        yield from self.inner.close()


_TO_BASE64 = bytes.maketrans(b"-_", b"+/")


def _deflated(data: bytes) -> bool:
    """Whether bytes that are no text begin like deflate without a header."""
    if len(data) < 16 or data[0] & 6 == 6 or data.isascii():
        return False
    try:
        return len(zlib.decompressobj(-15).decompress(data[:256], 64)) >= 16
    except zlib.error:
        return False


def _from_base64(found: str, skip: int = 0) -> bytes | None:
    body = found.split("%")[0].rstrip("=").replace("-", "+").replace("_", "/")[skip:]
    if len(body) % 4 == 1:
        body = body[:-1]
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _texts(data: bytes, first: bool) -> list[tuple[str, bool]]:
    """The readings of decoded bytes, and whether each is a stray one."""
    new = _printable(data) if first else None
    if new is not None:
        return [(new, False)]
    out = [(data.decode("latin-1"), True)] if _hint(data) else []
    if b"\0" in data and _WIDE.search(data):
        # at an odd place, also the other byte order of plain letters
        out += [(data[i:].decode("utf-16-le", "replace"), True) for i in (0, 1)]
    return out


def _decoded(found: str, budget: _Budget):
    """The readings of a stretch of base64, at its four alignments, one after the other: text, whether stray, what is streamed."""
    for skip in range(4):
        data = _from_base64(found, skip)
        if not data:
            continue
        if len(data) < STEP and not _MAGIC.search(data) and _engine(data) is None and not _deflated(data):
            for text, stray in _texts(data, skip == 0):
                yield text, stray or skip > 0, (False, False, False)
        else:
            whole = _Bytes(skip == 0, skip > 0, budget)
            yield from whole.feed(data)
            yield from whole.close()


def _mapped(layer: Layer, found: list[tuple[int, int, str]]) -> Layer:
    """A layer with some parts of it, (start, end, text), replaced."""
    text, pieces, n, i = [], [], 0, 0

    def keep(a: int, b: int) -> None:
        nonlocal n
        while a < b:
            k = bisect_right(layer.starts, a) - 1
            stop = min(b, layer.starts[k + 1] if k + 1 < len(layer.starts) else b)
            piece = layer.pieces[k]
            pieces.append((n, piece[1] + a - piece[0], piece[2], True) if piece[3] else (n, piece[1], piece[2], False))
            text.append(layer.text[a:stop])
            n, a = n + stop - a, stop

    for a, b, new in found:
        keep(i, a)
        lo, hi = layer.place(a, b)
        if new:
            pieces.append((n, lo, hi, False))
            text.append(new)
            n += len(new)
        i = b
    keep(i, len(layer.text))
    return Layer("".join(text), pieces, layer.stray, layer.streamed)


def _url_parts(m: re.Match) -> list[tuple[int, int, str]]:
    """A run of URL escapes, letter by letter."""
    out, data, i = [], bytes.fromhex(m.group().replace("%", "")), 0
    while i < len(data):
        size = 1 if data[i] < 0x80 else 2 if data[i] >> 5 == 6 else 3 if data[i] >> 4 == 14 else 4
        try:
            new = data[i : i + size].decode("utf-8")
        except UnicodeDecodeError:
            new, size = "\ufffd", 1
        out.append((m.start() + 3 * i, m.start() + 3 * min(i + size, len(data)), new))
        i += size
    return out


def _escape(m: re.Match) -> str:
    number = next(g for g in m.groups()[:4] if g) if not m.group(5) else m.group(5)
    code = int(number, 10 if m.group(5) else 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"


def unwrap(layer: Layer, limit: int | None, cuts: list[bool]):
    """The layers that are encoded in a layer, each decoded by one step, one after the other. cuts gets an entry for each stretch
    that ended at the limit."""
    text, (escapes, head, tail) = layer.text, layer.streamed
    if "%" in text and not escapes:
        parts = [p for m in _HEXES.finditer(text) for p in _url_parts(m)]
        if parts:
            yield _mapped(layer, parts)
    if not escapes and ("\\u" in text or "\\x" in text or "&#" in text):
        parts = [(e.start(), e.end(), _escape(e)) for e in _ESCAPE.finditer(text)]
        if parts:
            yield _mapped(layer, parts)
    stretches = [(m.start(), m.end(), m.group()) for m in _BASE64.finditer(text)]
    if "\n" in text:
        stretches += [(m.start(), m.end(), bare) for m in _JOINED.finditer(text) if len(bare := _BREAK.sub("", m.group())) >= 16]
    for a, b, found in stretches:
        if (head and a == 0) or (tail and b == len(text)):
            continue
        budget = _Budget(limit)
        for new, stray, streamed in _decoded(found, budget):
            yield Layer(new, [(0, *layer.place(a, b), False)], stray, streamed)
        if budget.cut:
            cuts.append(True)


def _narrowest(found: set[tuple[int, int, str, str]]) -> set[Span]:
    """Without the spans that hold a narrower one of the same secret."""
    same, out = {}, set()
    for a, b, kind, secret in found:
        same.setdefault((kind, secret), []).append((a, -b))
    for (kind, _), spans in same.items():
        end = None
        for a, b in sorted(spans, reverse=True):  # from the last start on, the narrower first
            if end is None or -b < end:
                out.add((a, -b, kind))
                end = -b
    return out


def find(text: str | None, limit: int | None = INFLATED) -> tuple[list[Span], list[Span], int]:
    """Base spans, all spans (both by start, then kind), and the number of layers opened."""
    return find_all(text, limit)[:3]


def find_all(text: str | None, limit: int | None = INFLATED) -> tuple[list[Span], list[Span], int, bool]:
    """As find, and whether content was cut at the limit."""
    text, cuts = text or "", []
    base = sorted(scan(text), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    if not text:
        return [], [], 0, False
    # the worklist: of each open layer those that are still to come, the innermost first
    todo, seen, added, opened = [unwrap(Layer(text, [(0, 0, len(text), True)]), limit, cuts)], set(), set(), 0
    while todo:
        layer = next(todo[-1], None)
        if layer is None:
            todo.pop()
            continue
        mark = (hashlib.sha256(layer.text.encode("utf-8", "surrogatepass")).digest(), layer.pieces[0][1] if layer.pieces else -1)
        if not layer.text or mark in seen or layer.text == text:
            continue
        seen.add(mark)
        hits = scan(layer.text)
        opened += bool(hits) or not layer.stray
        added.update((*layer.place(a, b), kind, layer.text[a:b]) for a, b, kind in hits)
        todo.append(unwrap(layer, limit, cuts))
    added = _narrowest(added)
    every = sorted(set(base) | added, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return base, every, opened, bool(cuts)


def _line(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, limit: int | None = INFLATED) -> DataFrame:
    """A row for each row of docs: id_col, base and all spans as arrays of (kind, start, end,
    found), the number of decoded layers, and whether content was cut at the limit. found: the text of the span."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("found", pa.string())])

    def run(batches):
        for whole in batches:
            base, every, opened, cut = [], [], [], []
            for value in whole.column(1):
                text = value.as_py()
                b, e, n, c = find_all(text, limit)
                base.append([(k, i, j, text[i:j]) for i, j, k in b])
                every.append([(k, i, j, text[i:j]) for i, j, k in e])
                opened.append(n)
                cut.append(c)
            as_items = [pa.array([[dict(zip(("kind", "start", "end", "found"), s)) for s in v] for v in x], type=pa.list_(item)) for x in (base, every)]
            yield pa.RecordBatch.from_arrays([whole.column(0), *as_items, pa.array(opened, type=pa.int64()), pa.array(cut, type=pa.bool_())], names=["doc_id", "base", "spans", "layers", "cut"])

    spans = "array<struct<kind:string,start:bigint,end:bigint,found:string>>"
    out = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, base {spans}, spans {spans}, layers bigint, cut boolean")
    return out.withColumnRenamed("doc_id", id_col)


def secret_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, limit: int | None = INFLATED) -> DataFrame:
    """A row for each row of docs: id_col, n_assign, n_access, n_hex, base_sha256, spans, layers, cut."""
    found = secret_spans(docs, id_col, text_col, limit=limit)

    def line(col: str):
        return F.array_join(F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(f"`{id_col}`", *[count(k) for k in KINDS], F.sha2(line("base"), 256).alias("base_sha256"), line("spans").alias("spans"), "layers", "cut")
