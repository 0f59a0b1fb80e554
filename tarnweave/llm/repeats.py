"""Suffix-array dedup of repeated byte strings, by prefix-free parsing.

Removes every byte that is covered by a string of `K` bytes that starts anywhere else as well.

Parsing: a rolling hash of `TRIGGER` bytes is taken at each place, and each K-byte string belongs
to the trigger inside it with the least hash (the first of several). Strings of consecutive
starts with the same trigger make up a phrase, which overlaps the next one by K - 1 bytes, so
each K-byte string lies in one phrase, and equal strings have equal triggers at the same place.
Dictionary: the distinct phrases. Parse: the phrases of each document. A phrase whose trigger is
found once in all texts has no repeated string and is dropped; one that is found twice repeats
as a whole. What is left are phrases that are found once but share their trigger with others:
the suffixes of the dictionary's phrases with that trigger are sorted to depth K, by prefix
doubling, and the strings that are equal to another one are repeated. Mapped back through the
parse, this gives corpus order to depth K; no order beyond K is needed, as phrases overlap by
K - 1 bytes.

Triggers with more than `GROUP_PHRASES` distinct phrases are not sorted in one task: each of
their K-byte strings is dealt out by its 128-bit hash and counted instead.

Edge cases: a null text counts as empty; texts under K bytes have no repeats; rows that repeat
an id or a text count as places of their own, a row each; very long texts are parsed in pieces
that overlap by K - 1 bytes. Other columns are never read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import store

K, TRIGGER = 200, 32
#: Bytes parsed at once; below 2 ** 22.
PIECE = 1 << 21
GROUP_PHRASES, SORT_BYTES = 8192, 1 << 20


def _loads(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as numbers whose order is that of the bytes."""
    n = len(buf) - 7
    out = np.empty(n, dtype=np.uint64)
    for k in range(8):
        m = len(range(k, n, 8))
        out[k::8] = buf[k : k + 8 * m].view(">u8")
    return out


def _trigger_hash(buf: np.ndarray) -> np.ndarray:
    u = _loads(buf)
    n = len(buf) - TRIGGER + 1
    h = u[:n] * np.uint64(0x9E3779B97F4A7C15)
    for at, c in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9), (24, 0xD6E8FEB86659FD93)):
        h ^= h >> np.uint64(29)
        h += u[at : at + n] * np.uint64(c)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def _least_in_window(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values, from running minima within blocks."""
    n = len(key) - width + 1
    blocks = np.full(-(-len(key) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    blocks[: len(key)] = key
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def parse(buf: np.ndarray, sizes: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of texts that stand one after the other in buf: start in buf, number of k-byte
    strings, trigger hash. Texts are at least k bytes long."""
    h = _trigger_hash(buf)
    mask = np.uint64((1 << 22) - 1)
    least = _least_in_window((h & ~mask) | np.arange(len(h), dtype=np.uint64), k - TRIGGER + 1) & mask
    step = np.zeros(len(buf) + 1, dtype=np.int8)
    ends = np.cumsum(sizes)
    step[ends - sizes] += 1
    step[ends - k + 1] -= 1
    starts = np.flatnonzero(np.cumsum(step[:-1]))
    at = least[starts]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    return starts[first], np.diff(np.append(first, len(starts))), h[at[first].astype(np.int64)]


def _groups(batches, k: int):
    """Texts in groups of bounded size: buf, sizes, row of each text (or piece), place in the text."""
    parts, sizes, rows, places, held = [], [], [], [], 0
    for b in batches:
        col = b.column(1)
        offsets = np.frombuffer(col.buffers()[1], dtype=np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        data = np.frombuffer(col.buffers()[2] or b"", dtype=np.uint8)
        for row, lo, hi in zip(b.column(0).to_pylist(), offsets[:-1], offsets[1:]):
            at = lo
            while hi - at >= k:
                stop = min(hi, at + PIECE)
                parts.append(data[at:stop].copy())
                sizes.append(stop - at)
                rows.append(row)
                places.append(at - lo)
                held += stop - at
                if held >= PIECE // 2:
                    yield np.concatenate(parts), np.array(sizes), rows, np.array(places)
                    parts, sizes, rows, places, held = [], [], [], [], 0
                at = stop - k + 1 if stop < hi else hi
    if parts:
        yield np.concatenate(parts), np.array(sizes), rows, np.array(places)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row: a key of id and text, the same in each scan; rows that repeat both share it, and what is found in them."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    row = F.unhex(F.md5(F.concat(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")), F.lit("|"), text)))
    return docs.select(row.alias("row"), text.cast("binary").alias("text"), F.col(f"`{id_col}`").alias("doc_id"))


def _trigger_counts(k: int):
    def run(batches):
        for buf, sizes, _, _ in _groups(batches, k):
            found, n = np.unique(parse(buf, sizes, k)[2], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["trigger", "n"])

    return run


def _phrases(k: int):
    def run(batches):
        for buf, sizes, rows, places in _groups(batches, k):
            start, run_, trigger = parse(buf, sizes, k)
            data, hash_ = buf.tobytes(), xxhash.xxh3_64_intdigest
            phrase = np.fromiter((hash_(data[s : s + r + k - 1]) for s, r in zip(start.tolist(), run_.tolist())), dtype=np.uint64, count=len(start))
            ends = np.cumsum(sizes)
            text = np.searchsorted(ends, start, side="right")
            place = start - (ends - sizes)[text] + places[text]
            yield pa.RecordBatch.from_arrays(
                [pa.array(trigger.view(np.int64)), pa.array(phrase.view(np.int64)), pa.array(rows, type=pa.binary()).take(pa.array(text)), pa.array(place), pa.array(run_.astype(np.int32))],
                names=["trigger", "phrase", "row", "start", "run"],
            )

    return run


def sort_to_depth(buf: np.ndarray, k: int = K) -> np.ndarray:
    """Rank of the k bytes from each place on (places that reach over the end: any rank), equal
    for equal strings and in byte order: prefix doubling from eight bytes up."""
    buf = np.concatenate([buf, np.zeros(k + 8, dtype=np.uint8)])
    rank, depth = np.unique(_loads(buf), return_inverse=True)[1].astype(np.int64), 8
    while depth < k:
        step = min(depth, k - depth)
        top = int(rank.max()) + 1
        rank, depth = np.unique(rank[:-step] * top + rank[step:], return_inverse=True)[1].astype(np.int64), depth + step
    return rank


def _repeated_in(phrases: list[bytes], weights: list[int], k: int) -> list[np.ndarray]:
    """For each phrase, which of its k-byte strings stand elsewhere in the phrases as well."""
    buf = np.frombuffer(b"".join(phrases), dtype=np.uint8)
    rank = sort_to_depth(buf, k)
    sizes = np.array([len(p) for p in phrases])
    at = np.concatenate([np.arange(e - s, e - k + 1) for s, e in zip(sizes, np.cumsum(sizes))])
    places = np.bincount(rank[at], weights=np.repeat(weights, sizes - k + 1), minlength=int(rank.max()) + 1)
    return np.split(places[rank[at]] >= 2, np.cumsum(sizes - k + 1)[:-1])


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2])]


_MARK = "row binary, start long, run int"


def _marks(rows: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate((pa.binary(), pa.int64(), pa.int32()))], names=["row", "start", "run"])


def _sorted_marks(k: int):
    """Rows come by trigger. Whole triggers are sorted together up to SORT_BYTES; strings of
    different triggers are never equal."""

    def run(batches):
        held, size, last = [], 0, None

        def settle():
            flags = _repeated_in([h[4] for h in held], [h[1] for h in held], k)
            return _marks([(h[2], h[3] + a, n) for h, f in zip(held, flags) if h[1] == 1 for a, n in _runs(f)])

        for b in batches:
            for row in zip(*[b.column(i).to_pylist() for i in range(5)]):
                if size > SORT_BYTES and row[0] != last:
                    yield settle()
                    held, size = [], 0
                held.append(row)
                size, last = size + len(row[4]), row[0]
        if held:
            yield settle()

    return run


def _cut_phrases(k: int):
    def run(batches):
        for b in batches:
            for text, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = wanted
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x["trigger"] for x in w], type=pa.int64()), pa.array([x["n"] for x in w], type=pa.int64()), pa.array([x["row"] for x in w], type=pa.binary()),
                        pa.array([x["start"] for x in w], type=pa.int64()), pa.array([text[x["start"] : x["start"] + x["run"] + k - 1] for x in w], type=pa.binary()),
                    ],
                    names=["trigger", "n", "row", "start", "text"],
                )

    return run


def _cut_strings(k: int):
    def run(batches):
        for b in batches:
            for text, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out = [(xxhash.xxh3_128_digest(text[s : s + k]), x["n"], x["row"], s) for x in wanted for s in range(x["start"], x["start"] + x["run"])]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], type=t) for i, t in enumerate((pa.binary(), pa.int64(), pa.binary(), pa.int64()))], names=["string", "n", "row", "start"])

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, k: int = K, group_phrases: int = GROUP_PHRASES) -> tuple[DataFrame, DataFrame]:
    """The texts (row: a key, text, doc_id) and, for keys that have any, starts of repeated k-byte
    strings: row, marks (array of first start and number of starts)."""
    texts = _texts(docs, id_col, text_col)
    plain = texts.select("row", "text")
    # stored, so that the join below deals both sides anew and a hot trigger can be split
    shared = store(plain.mapInArrow(_trigger_counts(k), "trigger long, n long").groupBy("trigger").agg(F.sum("n").alias("n")).where("n > 1").select("trigger"), "triggers")
    # the same plan at every size: shared triggers are hashed, phrases are not sorted
    parsed = store(plain.mapInArrow(_phrases(k), "trigger long, phrase long, row binary, start long, run int").join(shared.hint("shuffle_hash"), "trigger", "left_semi"), "phrases")
    dictionary = store(parsed.groupBy("trigger", "phrase").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "start", "run")).alias("one")), "dictionary")
    whole = parsed.join(dictionary.where("n > 1").select("trigger", "phrase").hint("shuffle_hash"), ["trigger", "phrase"], "left_semi").select("row", "start", "run")
    sizes = dictionary.groupBy("trigger").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    open_ = dictionary.join(sizes, "trigger").select("trigger", "n", "k", F.col("one.row").alias("row"), F.col("one.start").alias("start"), F.col("one.run").alias("run"))

    def texts_with(wanted: DataFrame) -> DataFrame:
        asked = wanted.groupBy("row").agg(F.collect_list(F.struct("trigger", "n", "row", "start", "run")).alias("wanted"))
        return plain.join(asked.hint("shuffle_hash"), "row").select("text", "wanted")

    cut = texts_with(open_.where(F.col("k") <= group_phrases)).mapInArrow(_cut_phrases(k), "trigger long, n long, row binary, start long, text binary")
    by_trigger = cut.repartition("trigger").sortWithinPartitions("trigger")
    marks = whole.unionByName(by_trigger.mapInArrow(_sorted_marks(k), _MARK))
    if not sizes.where(F.col("k") > group_phrases).isEmpty():
        strings = texts_with(open_.where(F.col("k") > group_phrases)).mapInArrow(_cut_strings(k), "string binary, n long, row binary, start long")
        many = strings.groupBy("string").agg(F.sum("n").alias("places")).where("places > 1")
        # strings that start one after the other are one mark
        found = strings.where("n = 1").join(many, "string", "left_semi").select("row", "start")
        found = found.withColumn("gap", F.col("start") - F.row_number().over(Window.partitionBy("row").orderBy("start")))
        marks = marks.unionByName(found.groupBy("row", "gap").agg(F.min("start").alias("start"), F.count(F.lit(1)).cast("int").alias("run")).drop("gap"))
    # stored, so that the shuffle of the texts that were cut is gone before the texts are dealt again
    return texts, store(marks.groupBy("row").agg(F.collect_list(F.struct("start", "run")).alias("marks")), "marks")


def _cut(marks, k: int) -> list[tuple[int, int]]:
    """Removed byte runs (start, end), maximal and in order."""
    out: list[list[int]] = []
    for a, n in sorted((m["start"], m["run"]) for m in marks):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], a + n - 1 + k)
        else:
            out.append([a, a + n - 1 + k])
    return [(a, b) for a, b in out]


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, k: int = K, group_phrases: int = GROUP_PHRASES, with_text: bool = True) -> DataFrame:
    """A row for each row of docs: id_col, n_bytes, spans (removed byte runs), kept_sha256, and
    kept, the remaining bytes, on request."""
    texts, marks = repeated_spans(docs, id_col, text_col, k=k, group_phrases=group_phrases)
    kind = texts.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for b in batches:
            sizes, spans, kept, digest = [], [], [], []
            for text, m in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                cut = _cut(m or [], k)
                at, rest = 0, []
                for lo, hi in cut:
                    rest.append(text[at:lo])
                    at = hi
                rest = b"".join([*rest, text[at:]])
                sizes.append(len(text))
                spans.append([{"start": lo, "end": hi} for lo, hi in cut])
                digest.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest if with_text else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, type=pa.int64()), pa.array(spans, type=span), pa.array(digest), pa.array(kept, type=pa.binary())], names=["doc_id", "n_bytes", "spans", "kept_sha256", "kept"])

    rows = texts.join(marks.hint("shuffle_hash"), "row", "left").select("doc_id", "text", "marks")
    out = rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept_sha256 string, kept binary").withColumnRenamed("doc_id", id_col)
    return out if with_text else out.drop("kept")


def repeats_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """A row for each row of docs: id_col, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = drop_repeats(docs, id_col, text_col, with_text=False, **options)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return rows.select(f"`{id_col}`", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
