"""Language-model scoring by cross-entropy difference.

A target and a background bigram model share one vocabulary (words found at least `min_count`
times in the background), order and smoothing; a document scores as the mean, over its words, of
the target model's loss less the background model's. Low scores are like the target. The
background is every document; the target is the documents whose label says so. A document that a
model has counted is left out of that model's counts while it is scored.

Counting and scoring work on chunks of whole documents, which are read and stored once. A chunk sends
each of its distinct words and word pairs once, as a sorted list of hashes with counts, to the
partition of that hash; the partition sums all chunks and sends each chunk the totals of what it
asked for. So a word that is everywhere costs a row for each chunk, not for each place; nothing is
broadcast, and the totals are those of all documents. A sender has at most 2 ** `FAN_BITS` receivers: where
there are more partitions, rows go by the first bits of their hashes to nodes that merge those of
about as many senders and pass them on by the next bits, and the totals come back the same way, so
rows grow in proportion to the corpus (times the number of steps).

p(w | v) = mix * c(v w) / c(v) + (1 - mix) * (c(w) + add) / (T + add * (V + 1)); words outside
the vocabulary are one word; after such a word, and at the start, only the second term counts.

Edge cases: a null or empty text has no words and scores 0; ids may be null or repeat, a row each;
labels that are null or without a document are ignored, of several the largest counts; without
target documents the target model is uniform; empty tables give empty results.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store

#: Characters of a chunk (a longer document is a chunk of its own) and of a hash partition.
CHUNK_CHARS, PART_CHARS = 6_000_000, 12_000_000
#: A sender's receivers, and a node's senders, as a power of two.
FAN_BITS = 8
MIN_COUNT, MIX, ADD = 2, 0.6, 0.5


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def _pack_words(words: list[str], tokens: np.ndarray, ends: np.ndarray) -> bytes:
    """Words and the texts' tokens, small: frequent words get small numbers, whose bytes are
    stored place by place."""
    order = np.argsort(-np.bincount(tokens, minlength=len(words)), kind="stable")
    rank = np.empty(len(words), dtype=np.uint32)
    rank[order] = np.arange(len(words), dtype=np.uint32)
    planes = rank[tokens].view(np.uint8).reshape(-1, 4).T
    text = np.frombuffer("\n".join(words[i] for i in order).encode("utf-8", "surrogatepass"), dtype=np.uint8)
    return _pack(text, np.array([len(words)]), *planes, ends)


def _unpack_words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words; the words as numbers; the end of each text."""
    text, n, *planes, ends = _unpack(data)
    words = text.tobytes().split(b"\n")[: int(n[0])]
    types = np.fromiter((xxhash.xxh64_intdigest(w, 7) for w in words), dtype=np.uint64, count=len(words))
    return types, np.stack(planes, axis=1).reshape(-1).view(np.uint32).astype(np.int64), ends


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays)] + [x for a in arrays for x in (len(a), ord(a.dtype.char))], dtype=np.int64)
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _unpack(data: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(data, dtype=np.int64, count=1)[0])
    head, at, out = np.frombuffer(data, dtype=np.int64, count=1 + 2 * n)[1:], 8 * (1 + 2 * n), []
    for size, char in head.reshape(n, 2):
        kind = np.dtype(chr(char))
        out.append(np.frombuffer(data, dtype=kind, count=int(size), offset=at))
        at += int(size) * kind.itemsize
    return out


def _shrink(counts: np.ndarray) -> np.ndarray:
    top = int(counts.max()) if len(counts) else 0
    return counts.astype(np.uint8 if top < 256 else np.uint32 if top < 1 << 32 else np.uint64)


def _pack_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 64-bit keys as gaps of six bytes, where all gaps fit, else of eight."""
    gaps = np.diff(keys, prepend=keys[:1])
    wide = len(gaps) and int(gaps.max()) >> 48
    raw = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)
    return keys[:1].copy(), np.ascontiguousarray(raw if wide else raw[:, :6]).reshape(-1)


def _unpack_keys(first: np.ndarray, raw: np.ndarray, n: int) -> np.ndarray:
    if n == 0:
        return np.empty(0, dtype=np.uint64)
    full = np.zeros((n, 8), dtype=np.uint8)
    width = len(raw) // n
    full[:, :width] = raw.reshape(n, width)
    return first[0] + np.cumsum(full.reshape(-1).view("<u8"), dtype=np.uint64)


def _chunks(batches, size_of):
    """Rows in chunks of whole documents: chunk number, list of rows."""
    base, seq, held, chars = TaskContext.get().partitionId() << 24, 0, [], 0
    for b in batches:
        for row in zip(*[b.column(i).to_pylist() for i in range(b.num_columns)]):
            held.append(row)
            chars += size_of(row)
            if chars >= CHUNK_CHARS:
                yield base | seq, held
                seq, held, chars = seq + 1, [], 0
    if held:
        yield base | seq, held


class Chunk:
    """Words of some documents as numbers, and the keys of its distinct words and word pairs."""

    def __init__(self, types: np.ndarray, tokens: np.ndarray, ends: np.ndarray):
        self.types, self.tokens, self.ends = types, tokens.astype(np.int64), ends.astype(np.int64)
        self.doc = np.repeat(np.arange(len(ends)), np.diff(self.ends, prepend=0))
        inner = np.ones(len(tokens), dtype=bool)
        starts = np.concatenate([[0], self.ends[:-1]]) if len(ends) else np.empty(0, dtype=np.int64)
        inner[starts[starts < len(tokens)]] = False
        self.at = np.flatnonzero(inner)
        v, w = self.tokens[self.at - 1], self.tokens[self.at]
        n = max(1, len(types))
        pairs, self.pair = np.unique(v * n + w, return_inverse=True)
        self.n_pairs = len(pairs)
        # the lowest bit tells words (1) from pairs (0)
        one = _mix(types) | np.uint64(1)
        two = _mix(types[pairs // n] * np.uint64(0x9E3779B97F4A7C15) + (_mix(types[pairs % n]) ^ np.uint64(0x2545F4914F6CDD1D))) & ~np.uint64(1)
        keys = np.concatenate([one, two])
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def counts(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the sorted keys, in all documents and in those that are target (a flag each)."""
        flag = target[self.doc]
        words = [np.bincount(t, minlength=len(self.types)) for t in (self.tokens, self.tokens[flag])]
        pairs = [np.bincount(p, minlength=self.n_pairs) for p in (self.pair, self.pair[flag[self.at]])]
        return tuple(np.concatenate([a, b])[self.order] for a, b in zip(words, pairs))

    def losses(self, totals: tuple[np.ndarray, np.ndarray], target: np.ndarray, stats: dict, min_count: int, mix: float, add: float) -> tuple[np.ndarray, np.ndarray]:
        """Summed loss of each document under the target and the background model."""
        back = np.empty_like(self.order)
        back[self.order] = np.arange(len(self.order))
        n, docs = len(self.types), len(self.ends)
        every = [t.astype(np.int64)[back] for t in totals]
        known = every[0][:n] >= min_count
        size = np.diff(self.ends, prepend=0)
        _, inverse, own = np.unique(self.doc * max(1, n) + self.tokens, return_inverse=True, return_counts=True)
        own_word = own[inverse]
        _, inverse, own = np.unique(self.doc[self.at] * max(1, self.n_pairs) + self.pair, return_inverse=True, return_counts=True)
        own_pair = own[inverse]
        own_unknown = np.bincount(self.doc[~known[self.tokens]], minlength=docs)
        v = self.tokens[self.at - 1]
        out = []
        for m in (1, 0):
            inside = target if m else np.ones(docs, dtype=bool)
            counted = inside[self.doc]
            tokens, vocabulary, in_vocabulary = stats["tokens"][m], stats["vocabulary"], stats["known"][m]
            count = every[m][:n][self.tokens] - own_word * counted
            rare = tokens - in_vocabulary - (own_unknown * inside)[self.doc]
            p = (np.where(known[self.tokens], count, rare) + add) / ((tokens - (size * inside)[self.doc]) + add * (vocabulary + 1))
            seen = count[self.at - 1] + 0.0
            both = every[m][n:][self.pair] - own_pair * counted[self.at]
            use = known[v] & (seen > 0)
            w = p[self.at]
            likely = np.where(known[self.tokens[self.at]], both / np.maximum(seen, 1), 0.0)
            p[self.at] = np.where(use, mix * np.minimum(likely, 1.0) + (1 - mix) * w, w)
            out.append(np.bincount(self.doc, weights=-np.log(p), minlength=docs))
        return out[0], out[1]


def _mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def read_words(texts) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words; the texts' words as their numbers; the end of each text."""
    number: dict = defaultdict()
    number.default_factory = number.__len__
    parts, ends, n = [], [], 0
    for text in texts:
        words = words_of(text)
        parts.append(np.fromiter(map(number.__getitem__, words), dtype=np.int32, count=len(words)))
        n += len(words)
        ends.append(n)
    return list(number), np.concatenate(parts) if parts else np.empty(0, dtype=np.int32), np.array(ends, dtype=np.int64)


def _flags(numbers, docs: int) -> np.ndarray:
    out = np.zeros(docs, dtype=bool)
    out[np.array(numbers or [], dtype=np.int64)] = True
    return out


def _blob(keys: np.ndarray, every: np.ndarray, some: np.ndarray) -> bytes:
    return _pack(*_pack_keys(keys), _shrink(every), _shrink(some))


def _unblob(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first, raw, every, some = _unpack(data)
    return _unpack_keys(first, raw, len(every)), every.astype(np.int64), some.astype(np.int64)


_ASKED, _TOLD = "part long, src long, asked binary", "part long, src long, told binary"


def _dealt(src: int, keys: np.ndarray, every: np.ndarray, some: np.ndarray, bits: int):
    """Rows of sorted keys, one for each value of their first bits."""
    part = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), dtype=np.int64)
    cuts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(keys))
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        yield int(part[lo]), src, _blob(keys[lo:hi], every[lo:hi], some[lo:hi])


def _rows(found, names: tuple[str, str, str]) -> pa.Table:
    found = list(found)
    return pa.table({n: pa.array([f[i] for f in found], type=pa.binary() if i == 2 else pa.int64()) for i, n in enumerate(names)})


def _merged(table: pa.Table) -> tuple[list[int], np.ndarray, np.ndarray, list[np.ndarray], list[int]]:
    """Of rows by sender: the senders, their distinct keys, where each row's keys are among them, the sums, and where rows end."""
    table = table.sort_by("src")
    asked = [_unblob(x) for x in table.column("asked").to_pylist()]
    distinct, inverse = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
    sums = [np.bincount(inverse, weights=np.concatenate([a[i] for a in asked]), minlength=len(distinct)).astype(np.int64) for i in (1, 2)]
    return table.column("src").to_pylist(), distinct, inverse, sums, np.cumsum([len(a[0]) for a in asked])[:-1].tolist()


def _answers(part: int, senders: list[int], inverse: np.ndarray, totals: list[np.ndarray], cuts: list[int]):
    for src, every, some in zip(senders, *[np.split(t[inverse], cuts) for t in totals]):
        yield part, src, _pack(_shrink(every), _shrink(some))


def _merge(bits: int):
    """A node: the sums of its senders, dealt by the next step's bits."""

    def run(table: pa.Table) -> pa.Table:
        _, keys, _, sums, _ = _merged(table)
        return _rows(_dealt(table.column("node")[0].as_py(), keys, *sums, bits), ("part", "src", "asked"))

    return run


def steps_of(parts: int) -> list[int]:
    """How many of a hash's first bits tell its receiver at each step."""
    bits = max(0, int(parts - 1).bit_length())
    return [*range(FAN_BITS, bits, FAN_BITS), bits]


def corpus_totals(asked: DataFrame, senders: int, steps: list[int], min_count: int) -> DataFrame:
    """asked: part, src, asked: the chunks' keys with their counts, dealt by the first step's bits.
    told: part, src, told: the counts in all chunks of the keys of each row; src -1: each part's statistics."""
    levels = []
    for n, bits in enumerate(steps[1:], 1):
        nodes = -(-senders >> FAN_BITS) or 1
        asked = store(asked.withColumn("node", F.pmod(F.xxhash64("src"), F.lit(nodes))), f"asked{n}")
        levels.append(asked)

        asked, senders = asked.groupBy("part", "node").applyInArrow(_merge(bits), _ASKED), nodes

    def answer(table: pa.Table) -> pa.Table:
        src, keys, inverse, totals, cuts = _merged(table)
        part = table.column("part")[0].as_py()
        word = (keys & np.uint64(1)).astype(bool)
        known = word & (totals[0] >= min_count)
        stats = np.array([known.sum(), *[t[word].sum() for t in totals], *[t[known].sum() for t in totals]], dtype=np.int64)
        return _rows([*_answers(part, src, inverse, totals, cuts), (part, -1, _pack(stats))], ("part", "src", "told"))

    told = store(asked.groupBy("part").applyInArrow(answer, _TOLD), "totals")
    stats = told.where("src = -1")
    for n in range(len(levels) - 1, -1, -1):
        width = steps[n + 1] - steps[n]

        def back(rows: pa.Table, totals: pa.Table) -> pa.Table:
            if rows.num_rows == 0:
                return _rows([], ("part", "src", "told"))
            src, keys, inverse, _, cuts = _merged(rows)
            got = [_unpack(t) for t in totals.sort_by("part").column("told").to_pylist()]
            both = [np.concatenate([g[i].astype(np.int64) for g in got]) for i in (0, 1)]
            return _rows(_answers(rows.column("part")[0].as_py(), src, inverse, both, cuts), ("part", "src", "told"))

        up = told.where("src >= 0").withColumn("above", F.shiftright("part", width))
        told = store(levels[n].groupBy("part", "node").cogroup(up.groupBy("above", "src")).applyInArrow(back, _TOLD), f"told{n}")
    return told.where("src >= 0").unionByName(stats)


def cross_entropy_difference(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_count: int = MIN_COUNT, mix: float = MIX, add: float = ADD) -> DataFrame:
    """docs: the documents, all of them background. targets: the ids of target documents. A row
    for each row of docs: id_col, n_words, target_loss, background_loss (per word), score."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType
    id_type = kind.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_id = to_arrow_type(kind)
    wanted = targets.select(F.col(f"`{id_col}`").alias("target_id")).where("target_id is not null").distinct().withColumn("target_key", F.xxhash64("target_id"))
    # rows without an id are dealt by their text; the same plan at every size: targets are hashed, texts are not sorted
    rows = rows.withColumn("key", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")))
    rows = rows.join(wanted.hint("shuffle_hash"), (F.col("key") == F.col("target_key")) & (F.col("doc_id") == F.col("target_id")), "left")
    rows = rows.select("doc_id", "text", F.col("target_id").isNotNull().alias("hit"))

    def read(batches):
        for chunk, held in _chunks(batches, lambda r: len(r[1] or "")):
            words = _pack_words(*read_words(r[1] for r in held))
            ids, hits, chars = [r[0] for r in held], [n for n, r in enumerate(held) if r[2]], sum(len(r[1] or "") for r in held)
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk]), pa.array([ids], type=pa.list_(arrow_id)), pa.array([words], type=pa.binary()), pa.array([hits], type=pa.list_(pa.int32())), pa.array([chars])],
                names=["chunk", "ids", "words", "target", "chars"],
            )

    chunks = store(rows.mapInArrow(read, f"chunk long, ids array<{id_type}>, words binary, target array<int>, chars long"), "chunks")
    chars, n_chunks = chunks.agg(F.sum("chars"), F.count(F.lit(1))).first()
    steps = steps_of(-(-(chars or 1) // PART_CHARS))

    def ask(batches):
        for b in batches:
            for chunk, words, target in zip(*[b.column(i).to_pylist() for i in range(3)]):
                c = Chunk(*_unpack_words(words))
                for row in _dealt(chunk, c.keys, *c.counts(_flags(target, len(c.ends))), steps[0]):
                    yield from _rows([row], ("part", "src", "asked")).to_batches()

    told = corpus_totals(chunks.select("chunk", "words", "target").mapInArrow(ask, _ASKED), n_chunks, steps, min_count)
    numbers = [f"s{i}" for i in range(5)]

    def stated(batches):
        for b in batches:
            rows = np.array([_unpack(x)[0] for x in b.column(0).to_pylist()], dtype=np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows.T], names=numbers)

    totals = told.where("src = -1").select("told").mapInArrow(stated, ", ".join(f"{c} long" for c in numbers))
    sums = [x or 0 for x in totals.agg(*[F.sum(c) for c in numbers]).first()]
    stats = {"vocabulary": int(sums[0]), "tokens": (int(sums[1]), int(sums[2])), "known": (int(sums[3]), int(sums[4]))}

    def finish(words: pa.Table, totals: pa.Table) -> pa.Table:
        names = {"doc_id": arrow_id, "n_words": pa.int64(), "target_loss": pa.float64(), "background_loss": pa.float64()}
        if words.num_rows == 0:
            return pa.table({k: pa.array([], type=t) for k, t in names.items()})
        c = Chunk(*_unpack_words(words.column("words")[0].as_py()))
        got = [_unpack(t) for t in totals.sort_by("part").column("told").to_pylist()]
        both = tuple(np.concatenate([g[i].astype(np.int64) for g in got]) if got else np.empty(0, dtype=np.int64) for i in (0, 1))
        target = _flags(words.column("target")[0].as_py(), len(c.ends))
        losses = c.losses(both, target, stats, min_count, mix, add)
        size = np.diff(c.ends, prepend=0)
        per = [x / np.maximum(size, 1) for x in losses]
        ids = words.column("ids").combine_chunks().flatten()
        return pa.table({k: pa.array(v, type=t) if not isinstance(v, pa.Array) else v for (k, t), v in zip(names.items(), (ids, size, *per))})

    words = chunks.select("chunk", "ids", "words", "target")
    out = words.groupBy("chunk").cogroup(told.where("src >= 0").groupBy("src")).applyInArrow(finish, f"doc_id {id_type}, n_words long, target_loss double, background_loss double")
    return out.select(F.col("doc_id").alias(id_col), "n_words", "target_loss", "background_loss", (F.col("target_loss") - F.col("background_loss")).alias("score"))
