"""Ranked lexical search over shards of documents in an order found by recursive graph bisection.

Documents and terms are a bipartite graph. Bisection halves the documents so that terms gather on one side: documents change sides in pairs
while the expected cost of the terms' gaps falls, then each half is halved. The upper halvings are fitted on a bounded sample, and
every document descends them to a part by the terms it has; a part is dealt into groups of about `group_docs`, each of which one task
bisects with all its documents down to shards of at most `shard_docs`. So alike documents share a shard, and the largest share that a
term can have of a score (its impact) is small in most shards.

A shard is a row: its documents, and for each term postings with impacts and the largest of them. An item's bound in a shard is the weighted sum of
these. Shards are visited by falling bound: the `first` ones, then `then` more, then all others whose bound is not less than the
score of the item's k-th document so far; where no bound reaches that, no shard is left out that matters, ties included. Results map back
to the documents' ids. The statistics (N, L, df, n) count all documents and terms; postings are only kept of terms that the items ask.

Items come in blocks of at most `block_terms` terms (or one item), by which what tasks and the driver hold is bounded.

Edge cases: a null or empty text has no terms; an item without terms or without a document above 0 has no rows; ids may be null (a document's
null id is the last of its ties) or repeat: each row of an item and each row of a document counts by itself, so that an item's ranks may
repeat with its id. Empty tables give empty results; other columns are never read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import store

#: Documents of a group and of a shard; shards visited first, and then, by each item; terms of a block (an item counts ITEM_COST more).
GROUP_DOCS, SHARD_DOCS, FIRST, THEN, BLOCK_TERMS, ITEM_COST = 8192, 256, 8, 64, 1 << 20, 64
#: The sample of the upper halvings, terms of one of its documents, numbers that terms share there; rounds of one halving; items scored at once.
SAMPLE_DOCS, SAMPLE_TERMS, FEATURES, ROUNDS, TOGETHER = 8192, 512, 1 << 14, 10, 256

#: Bytes of terms: digits, letters (A-Z lower-cased) and all beyond ASCII; others separate.
_TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TERM_BYTES).split()


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values))


def _csr(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """starts and values of a column of lists."""
    at = column.offsets.to_numpy().astype(np.int64)
    return at - at[0], column.values.to_numpy()[at[0] : at[-1]]


def _ranges(starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the values of some rows, and for each the number of its row among these."""
    sizes = starts[rows + 1] - starts[rows]
    own = np.repeat(np.arange(len(rows)), sizes)
    return np.arange(len(own)) + np.repeat(starts[rows] - (np.cumsum(sizes) - sizes), sizes), own


def halve(own: np.ndarray, terms: np.ndarray, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """For each of n documents whether it goes to the second half; own, terms: document and term of each posting."""
    seen = np.zeros(int(terms.max(initial=-1)) + 1, dtype=np.int64)
    seen[terms] = 1
    terms = (np.cumsum(seen) - 1)[terms]
    n0, n1 = n // 2, n - n // 2
    second, degree = np.arange(n) >= n0, np.bincount(terms)

    def cost(a, b):
        return a * np.log2(n0 / (a + 1)) + b * np.log2(n1 / (b + 1))

    for _ in range(rounds):
        there = second[own]
        d1 = np.bincount(terms[there], minlength=len(degree))
        d0 = degree - d1
        now = cost(d0, d1)
        over, back = now - cost(np.maximum(d0 - 1, 0), d1 + 1), now - cost(d0 + 1, np.maximum(d1 - 1, 0))
        gain = np.bincount(own, np.where(there, back[terms], over[terms]), minlength=n)
        left, right = (x[np.argsort(-gain[x], kind="stable")] for x in (np.flatnonzero(~second), np.flatnonzero(second)))
        swaps = int((gain[left] + gain[right[:n0]] > 1e-9).sum())
        if not swaps:
            break
        second[left[:swaps]], second[right[:swaps]] = True, False
    return second


def bisected(starts: np.ndarray, terms: np.ndarray, most: int) -> list[np.ndarray]:
    """All documents in their new order, as shards of at most `most`."""
    todo, out = [np.arange(len(starts) - 1)], []
    while todo:
        docs = todo.pop()
        if len(docs) <= most:
            out.append(docs)
            continue
        places, own = _ranges(starts, docs)
        second = halve(own, terms[places], len(docs))
        todo += [docs[second], docs[~second]]
    return out


@dataclass
class Tree:
    """weights: for each node, by level, what a term speaks for the second half."""

    levels: int
    weights: np.ndarray

    def part(self, starts: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """The part, 0 to 2^levels - 1, of each document."""
        n = len(starts) - 1
        own, node = np.repeat(np.arange(n), np.diff(starts)), np.zeros(n, dtype=np.int64)
        for _ in range(self.levels):
            node = 2 * node + 1 + (np.bincount(own, self.weights[node[own], terms % FEATURES], minlength=n) > 0)
        return node - (2**self.levels - 1)


def fit_tree(sample: list[list[int]], levels: int) -> Tree:
    """The upper halvings of a sample of documents, each a list of terms."""
    starts = np.concatenate([[0], np.cumsum([len(t) for t in sample], dtype=np.int64)]).astype(np.int64)
    terms = np.array([x for t in sample for x in t], dtype=np.int64) % FEATURES
    levels = max(0, min(levels, int(math.log2(max(1, len(sample) / 64)))))
    tree, held = Tree(levels, np.zeros((2**levels - 1, FEATURES), dtype=np.float32)), {0: np.arange(len(sample))}
    for node in range(2**levels - 1):
        docs = held.pop(node)
        places, own = _ranges(starts, docs)
        second = halve(own, terms[places], len(docs))
        d0, d1 = (np.bincount(terms[places][second[own] == s], minlength=FEATURES) for s in (False, True))
        tree.weights[node] = np.where(d0 + d1 > 0, np.log2((d1 + 1) / second.sum()) - np.log2((d0 + 1) / (~second).sum()), 0)
        held[2 * node + 1], held[2 * node + 2] = docs[~second], docs[second]
    return tree


def forward(docs: DataFrame, id_col: str, text_col: str, number: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), and the numbers (from 0) and counts of the terms that `number` holds (from 1)."""

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b, n, found, counts, ends = whole.slice(lo, 256), [], [], [], [0]
                for text in b.column(1).cast(pa.binary()):
                    terms = terms_of(text.as_py())
                    held = [t for t in map(number.get, terms) if t]
                    ids, tf = np.unique(np.array(held, dtype=np.int32), return_counts=True)
                    n.append(len(terms))
                    found.append(ids - 1)
                    counts.append(tf.astype(np.int32))
                    ends.append(ends[-1] + len(ids))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, type=pa.int64()), _lists(np.concatenate(found), np.array(ends)), _lists(np.concatenate(counts), np.array(ends))], names=["doc_id", "n", "terms", "counts"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return store(rows.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<int>"), "forward")


def _shards(total: int, length: int, shard_docs: int):
    """The shards of a group of documents. total, length: N and L."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("doc_id")
        starts, terms = _csr(group.column("terms").combine_chunks())
        counts = _csr(group.column("counts").combine_chunks())[1].astype(np.int64)
        m = np.array([50 + 50 * n * total // length for n in group.column("n").to_pylist()], dtype=np.int64)
        own = np.repeat(np.arange(len(m)), np.diff(starts))
        impacts = (1_000_000_000 * counts // (1000 * counts + 20 * m[own])).astype(np.int32)
        ids, rows = group.column("doc_id"), []
        for nth, docs in enumerate(bisected(starts, terms, shard_docs)):
            places, local = _ranges(starts, docs)
            order = np.argsort(terms[places], kind="stable")
            places, local = places[order], local[order]
            held, first = np.unique(terms[places], return_index=True)
            rows.append((group.column("grp")[0].as_py() << 20 | nth, ids.take(pa.array(docs)).to_pylist(), held, np.append(first, len(places)).astype(np.int32), local.astype(np.int32), impacts[places], np.maximum.reduceat(impacts[places], first)))
        kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 5]
        return pa.table({name: pa.array(v, type=k) for name, v, k in zip(("shard", "doc_ids", "terms", "starts", "docs", "impacts", "tops"), zip(*rows), kinds)})

    return run


def build_index(fwd: DataFrame, total: int, length: int, *, group_docs: int = GROUP_DOCS, shard_docs: int = SHARD_DOCS, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """A row for each shard of the documents that hold a term: shard, doc_ids, terms, starts, docs, impacts, tops."""
    rows = fwd.where(F.size("terms") > 0)
    n = rows.count()
    levels = math.ceil(math.log2(max(1, n / group_docs)))
    picked = rows.select("doc_id", "n", F.slice("terms", 1, SAMPLE_TERMS).alias("t"), F.xxhash64("doc_id", "n", "terms").alias("h"))
    # somewhat more than the sample by hash, so that tasks do not each send a whole sample
    picked = picked.where(F.pmod("h", F.lit(1 << 32)) < int(1.5 * sample_docs * (1 << 32) / max(n, 1))).orderBy("h", "doc_id", "n", "t").limit(sample_docs)
    tree = fit_tree([r["t"] for r in picked.collect()] if levels else [], levels)

    def route(batches):
        for b in batches:
            starts, terms = _csr(b.column(2))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.part(starts, terms))], names=["doc_id", "n", "terms", "counts", "part"])

    rows = store(rows.mapInArrow(route, "doc_id long, n long, terms array<int>, counts array<int>, part long"), "parts")
    held = {r["part"]: -(-r["count"] // group_docs) for r in rows.groupBy("part").count().collect()}  # a row a part, of at most 128
    begin, at = [0] * 2**tree.levels, 0
    for p in sorted(held):
        begin[p], at = at, at + held[p]
    pick = lambda values: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("part").cast("int") + 1)
    grp = pick(begin) + F.pmod(F.xxhash64(F.monotonically_increasing_id()), pick([held.get(p, 1) for p in range(len(begin))]))
    shards = rows.withColumn("grp", grp).groupBy("grp").applyInArrow(_shards(total, length, shard_docs), "shard long, doc_ids array<long>, terms array<int>, starts array<int>, docs array<int>, impacts array<int>, tops array<int>")
    return store(shards, "shards")


@dataclass
class Asked:
    """The items of a block: their terms one after the other, with weights."""

    starts: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    vocabulary: int

    def bounds(self, terms: np.ndarray, tops: np.ndarray) -> np.ndarray:
        """What no document of a shard exceeds, for each item."""
        top = np.zeros(self.vocabulary, dtype=np.int64)
        top[terms] = tops
        return np.add.reduceat(self.weights * top[self.terms], self.starts[:-1])

    def scores(self, items: np.ndarray, terms: np.ndarray, starts: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n: int, exact: bool) -> np.ndarray:
        """A row for each of some items, a column for each of the n documents of a shard."""
        at = np.full(self.vocabulary, -1, dtype=np.int64)
        at[terms] = np.arange(len(terms))
        places, item = _ranges(self.starts, items)
        lists = at[self.terms[places]]
        some = lists >= 0
        posting, nth = _ranges(starts, lists[some])
        cell, value = item[some][nth] * n + docs[posting], self.weights[places][some][nth] * impacts[posting]
        if not exact:
            return np.bincount(cell, value, minlength=len(items) * n).astype(np.int64).reshape(-1, n)
        out = np.zeros(len(items) * n, dtype=np.int64)
        np.add.at(out, cell, value)
        return out.reshape(-1, n)


def _highest(index: DataFrame, asked: Asked, most: int) -> np.ndarray:
    """For each item its `most` highest bounds, falling; 0 where there are fewer."""

    def run(batches):
        best = np.zeros((len(asked.starts) - 1, most), dtype=np.int64)
        for b in batches:
            for terms, tops in zip(b.column(0), b.column(1)):
                own = asked.bounds(terms.values.to_numpy(), tops.values.to_numpy())
                better = own > best[:, -1]
                best[better, -1] = own[better]
                best[better] = -np.sort(-best[better], axis=1)
        item, nth = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(item, type=pa.int64()), pa.array(best[item, nth], type=pa.int64())], names=["item", "bound"])

    rows = index.select("terms", "tops").mapInArrow(run, "item long, bound long").withColumn("nth", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"))))
    out = np.zeros((len(asked.starts) - 1, most), dtype=np.int64)
    for r in rows.where(F.col("nth") <= most).toLocalIterator():  # `most` rows an item of the block
        out[r["item"], r["nth"] - 1] = r["bound"]
    return out


def _visit(index: DataFrame, asked: Asked, low: np.ndarray, high: np.ndarray, need: np.ndarray, k: int) -> DataFrame:
    """item, doc_id, score: the k best of what a task has seen in shards with a bound of low to below high, none below need."""

    def run(batches):
        held: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for ids, terms, starts, docs, impacts, tops in zip(*b.columns):
                terms, starts, docs, impacts, tops = (c.values.to_numpy() for c in (terms, starts, docs, impacts, tops))
                bounds, null = asked.bounds(terms, tops), np.asarray(ids.values.is_null())
                visitors, ids = np.flatnonzero((bounds >= np.maximum(low, 1)) & (bounds < high)), ids.values.fill_null(0).to_numpy()
                for lo in range(0, len(visitors), TOGETHER):
                    items = visitors[lo : lo + TOGETHER]
                    scores = asked.scores(items, terms, starts.astype(np.int64), docs, impacts, len(ids), bool((bounds[items] >= 1 << 53).any()))
                    for item, own in zip(items.tolist(), scores):
                        old = held.get(item)
                        floor = max(1, int(need[item]), int(old[0][-1]) if old is not None and len(old[0]) == k else 1)
                        at = np.flatnonzero(own >= floor)
                        if len(at):
                            new = [own[at], null[at], ids[at]]
                            new = new if old is None else [np.concatenate(x) for x in zip(old, new)]
                            order = np.lexsort((new[2], new[1], -new[0]))[:k]
                            held[item] = [x[order] for x in new]
        for item, (score, null, ids) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), item)), pa.array(ids, mask=null), pa.array(score)], names=["item", "doc_id", "score"])

    return store(index.select("doc_ids", "terms", "starts", "docs", "impacts", "tops").mapInArrow(run, "item long, doc_id long, score long"), "found")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: DataFrame, asked: Asked, k: int, *, first: int = FIRST, then: int = THEN, visits: list | None = None) -> DataFrame:
    """item (its number in the block), rank, doc_id, score: the k best documents of each item. visits, if given, gets for each
    round the bounds from which shards are visited."""
    tops = _highest(index, asked, first + then + 1)
    n = len(asked.starts) - 1
    high, need, found = np.full(n, (1 << 63) - 1), np.ones(n, dtype=np.int64), None
    for upto in (first, first + then, None):
        low = need if upto is None else np.maximum(tops[:, upto - 1], need)
        if visits is not None:
            visits.append(low)
        new = _visit(index, asked, low, high, need, k)
        found, high = new if found is None else found.union(new), np.minimum(high, low)
        last = _best(found, k).where(F.col("rank") == k).select("item", "score").toLocalIterator()  # at most a row an item of the block
        for r in last:
            need[r["item"]] = r["score"]
        if upto is None or (tops[:, upto] < need).all():
            break
    return _best(found, k).select("item", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, k: int = 50, block_terms: int = BLOCK_TERMS, first: int = FIRST, then: int = THEN, **options) -> DataFrame:
    """The k documents with the highest scores above 0 for each row of items: item_id, rank, doc_id, score."""
    spark = docs.sparkSession

    def split(batches):
        for b in batches:
            terms = [sorted(set(terms_of(t.as_py()))) for t in b.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(terms, type=pa.list_(pa.binary()))], names=["row", "item_id", "terms"])

    rows = items.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{item_col}`").cast("long").alias("item_id"), F.col(f"`{item_text_col}`").cast("string").alias("text"))
    rows = store(rows.mapInArrow(split, "row long, item_id long, terms array<binary>").where(F.size("terms") > 0), "items")
    blocks = -(-int(rows.agg(F.sum(F.size("terms") + ITEM_COST)).first()[0] or 0) // block_terms)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in range(blocks):
        mine = rows.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).orderBy("row").collect()  # about block_terms terms
        if mine:
            out = out.union(_ranked_block(docs, mine, id_col, text_col, k, first, then, options))
    return out


def _ranked_block(docs: DataFrame, items: list, id_col: str, text_col: str, k: int, first: int, then: int, options: dict) -> DataFrame:
    names = sorted({bytes(t) for r in items for t in r["terms"]})
    fwd = forward(docs, id_col, text_col, {t: i for i, t in enumerate(names, 1)})
    total, length = fwd.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    spark = docs.sparkSession
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if not total:
        return out
    weights = np.zeros(len(names), dtype=np.int64)
    for r in fwd.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():  # a row a term of the block
        weights[r["t"]] = math.floor(1000 * math.log((2 * total + 2) / (2 * r["count"] + 1)))
    number = {t: i for i, t in enumerate(names)}
    starts = np.concatenate([[0], np.cumsum([len(r["terms"]) for r in items])]).astype(np.int64)
    terms = np.array([number[bytes(t)] for r in items for t in r["terms"]], dtype=np.int64)
    index = build_index(fwd, total, length, **options)
    if index.isEmpty():
        return out
    found = search(index, Asked(starts, terms, weights[terms], len(names)), k, first=first, then=then)
    ids = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(items)], "item long, item_id long")
    return found.join(ids, "item").select("item_id", "rank", "doc_id", "score")
