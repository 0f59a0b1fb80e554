import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tarnweave.llm import repeats
from tarnweave.llm.repeats import drop_repeats, parse, repeats_digest, sort_to_depth

from .data import documents, odd_rows, prose


def brute(texts, k):
    data = [(t or "").encode() for t in texts]
    places = Counter(t[i : i + k] for t in data for i in range(len(t) - k + 1))
    out = []
    for t in data:
        mark = bytearray(len(t))
        for i in range(len(t) - k + 1):
            if places[t[i : i + k]] > 1:
                mark[i : i + k] = b"\1" * k
        kept = bytes(c for c, m in zip(t, mark) if not m)
        out.append((len(t), sum(mark), sum(1 for i, m in enumerate(mark) if m and not (i and mark[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    r = random.Random(9)
    shared = prose(5, 90)
    rows = odd_rows()
    for i in range(20, 50):
        words = prose(i, 60).split()
        if i % 3:
            at = r.randrange(len(words))
            words[at:at] = shared.split()[r.randrange(0, 8) : r.randrange(50, 90)]
        rows.append((i, " ".join(words), "a"))
    copy = prose(3, 200).split()
    for i in range(50, 60):
        copy[r.randrange(200)] = f"edit{i}"
        rows.append((i, " ".join(copy), "b"))
    return rows + [(60, "x" * 700, "a"), (61, "ab" * 300, "a"), (62, "z" * 199, "a"), (63, "é" * 150, "a"), (64, "q" * 200, "a")]


@pytest.mark.parametrize("k,group", [(200, 8192), (200, 1), (64, 8192)])
def test_like_brute_force(spark, k, group):
    """group 1: every shared trigger goes the way of the crowded ones."""
    rows = corpus()
    got = sorted((tuple(r) for r in repeats_digest(documents(spark, rows).repartition(3), k=k, group_phrases=group).collect()), key=repr)
    want = sorted(((i, *b) for (i, _, _), b in zip(rows, brute([t for _, t, _ in rows], k))), key=repr)
    assert got == want


def test_ranks_are_suffix_order():
    r = np.random.default_rng(2)
    buf = r.integers(97, 100, 400).astype(np.uint8)
    buf[250:390] = buf[20:160]
    rank, data = sort_to_depth(buf, 40), buf.tobytes()
    n = len(buf) - 40
    assert sorted(range(n), key=lambda i: (rank[i], i)) == sorted(range(n), key=lambda i: (data[i : i + 40], i))
    assert all((rank[i] == rank[j]) == (data[i : i + 40] == data[j : j + 40]) for i in range(n) for j in (0, i // 2, min(i + 230, n - 1)))


def test_kept_bytes(spark):
    text = prose(8, 500)
    docs = documents(spark, [(1, text, "a"), (2, prose(9, 40) + text[:1200] + prose(10, 40), "b"), (3, None, "c")])
    rows = {r["doc_id"]: r for r in drop_repeats(docs).collect()}
    for i, t in ((1, text), (2, prose(9, 40) + text[:1200] + prose(10, 40)), (3, "")):
        kept, at = b"", 0
        for s in rows[i]["spans"]:
            kept += t.encode()[at : s["start"]]
            at = s["end"]
        assert bytes(rows[i]["kept"]) == kept + t.encode()[at:]
    assert repeats_digest(documents(spark, [])).count() == 0


def strings(batches, k=200):
    """Each k-byte string's row and place, with the trigger it belongs to."""
    out = {}
    for buf, sizes, rows, places in repeats._groups(batches, k):
        start, run, trigger = parse(buf, sizes, k)
        ends = np.cumsum(sizes)
        for s, n, t in zip(start, run, trigger):
            text = int(np.searchsorted(ends, s, side="right"))
            for i in range(n):
                key = (rows[text], int(s + i - (ends - sizes)[text] + places[text]))
                assert key not in out
                out[key] = int(t)
    return out


def test_long_texts_in_pieces_give_the_same_triggers(monkeypatch):
    texts = [prose(1, 900).encode(), b"short", prose(2, 300).encode(), b"", b"y" * 2500, prose(1, 900).encode()]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, type=pa.binary())], names=["row", "text"])
    whole = strings([batch])
    assert len(whole) == sum(max(0, len(t) - 199) for t in texts)
    monkeypatch.setattr(repeats, "PIECE", 1000)
    assert strings([batch.slice(0, 2), batch.slice(2)]) == whole
    by_text: dict = {}
    for (row, place), trigger in whole.items():
        by_text.setdefault(texts[row][place : place + 200], set()).add(trigger)
    assert all(len(t) == 1 for t in by_text.values())
