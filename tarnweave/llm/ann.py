"""Approximate nearest neighbours with score-aware (anisotropic) product quantisation.

Vectors fall into coarse cells, about as many as the square root of their number. Of what is left of a vector x beside its cell's centre c, r = x - c,
the length is kept and the direction is cut into pairs of components, each coded in four bits, so that small rests are told as well as large ones.
Euclidean nearness is turned into a maximum inner product: (q - c).r - |r|^2 / 2 - |q - c|^2 / 2. Codes and codebooks are chosen for the score-aware
loss |e|^2 + (eta - 1) (e.r)^2 / |r|^2, which weighs the part of the error e that is parallel
to r, as that part moves the inner products that matter. A query looks up one table of 16 values
for each code (two codes at a time); products of coded rests with their centres are kept with the codes; the `rerank` best by codes over all its cells are fetched and
reranked exactly, in double precision, on the original vectors.

Codebooks and centres are fitted on a sample of at most `train_rows` vectors (or 32 for each cell, at most MOST_TRAIN); all vectors are indexed. How many cells a query looks into
and how many vectors are reranked is measured on the whole index: the true neighbours of `TRIALS` queries are found by one exact
pass, and a second one counts what the codes put before them. The trials are taken in turn from queries of all distances to their centres, by powers of two, and
what is enough for each of these groups is taken, so that few queries that are unlike most vectors count as well.

Cells are dealt to parts of about `part_rows` vectors, a large cell to several, and the queries that look into a part to blocks of
about `block`; a part, as codes without vectors, meets each block in a task: one plan at every size, in which
no cell, however full, is held in one task. So that a query does not get `rerank` vectors from every part, its nearness to the sample tells a floor that
about AMPLE times as many of all vectors reach; a part gives those that do, and its k best in any case. Vectors are shuffled once, to meet what is reranked.

Edge cases: vectors that are null, all zero, of another length than most, or that hold null or
non-finite components take no part, nor do rows with a null id; a query never finds its own row, but
other rows of its id; each of several rows with a query's id is a query, so that its ranks repeat; ties
go to the smaller id; a query looks into further cells until they hold as many others as are reranked; with fewer candidates than that, all are
returned. Empty
tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import store

ETA, CENTROIDS, TRAIN_ROWS, RERANK = 4.0, 16, 8192, 512
#: Queries and vectors that meet in one task; cells and sample at most; queries that are tried, of so many at most; shares of their neighbours that probes and codes find.
BLOCK, PART_ROWS, CELLS, MOST_TRAIN, TRIALS, ASKED, FOUND, TOLD = 1024, 16_384, 4096, 1 << 17, 64, 2048, 0.99, 0.98
AMPLE = 1.5


@dataclass
class Quantiser:
    """books: for each pair of components, 16 centroids."""

    books: np.ndarray
    eta: float = ETA

    def encode(self, x: np.ndarray, rounds: int = 2, toward: np.ndarray | None = None) -> np.ndarray:
        """Codes, a row for each vector: each pair of components in turn takes the centroid with
        the least score-aware loss, given the others. toward: the whole vectors, where x is what is left of them."""
        m = len(self.books)
        toward = x if toward is None else toward
        parts, ahead = _pairs(x), _pairs(toward)
        weight = (self.eta - 1) / np.maximum((toward * toward).sum(axis=1), 1e-30)
        gap = parts[:, :, None, :] - self.books[None]
        plain, along = (gap * gap).sum(axis=3), (gap * ahead[:, :, None, :]).sum(axis=3)
        codes = plain.argmin(axis=2)
        rows = np.arange(len(x))
        total = np.take_along_axis(along, codes[:, :, None], axis=2)[:, :, 0].sum(axis=1)
        for _ in range(rounds):
            for j in range(m):
                rest = total - along[rows, j, codes[:, j]]
                codes[:, j] = (plain[:, j] + weight[:, None] * (rest[:, None] + along[:, j]) ** 2).argmin(axis=1)
                total = rest + along[rows, j, codes[:, j]]
        return codes.astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.books[np.arange(len(self.books))[None, :], codes].reshape(len(codes), -1)


def _pairs(x: np.ndarray) -> np.ndarray:
    if x.shape[1] % 2:
        x = np.hstack([x, np.zeros((len(x), 1), dtype=x.dtype)])
    return x.reshape(len(x), -1, 2)


def fit(x: np.ndarray, eta: float = ETA, rounds: int = 8, seed: int = 3, toward: np.ndarray | None = None) -> Quantiser:
    """Codebooks from sample vectors: coding and least-squares centroids take turns. toward: as for encode."""
    x = np.asarray(x, dtype=np.float64)
    toward = x if toward is None else np.asarray(toward, dtype=np.float64)
    parts, ahead, rng = _pairs(x), _pairs(toward), np.random.default_rng(seed)
    m = parts.shape[1]
    books = np.zeros((m, CENTROIDS, 2))
    for j in range(m):
        start = parts[rng.permutation(len(x))[:CENTROIDS], j]
        books[j, : len(start)] = start
    q = Quantiser(books, eta)
    weight = (eta - 1) / np.maximum((toward * toward).sum(axis=1), 1e-30)
    for _ in range(rounds):
        codes = q.encode(x, 1, toward)
        gap = parts - q.decode(codes).reshape(parts.shape)
        along = (gap * ahead).sum(axis=2)
        total = along.sum(axis=1)
        for j in range(m):
            p, a, rest = parts[:, j], ahead[:, j], total - along[:, j]
            outer = np.eye(2)[None] + weight[:, None, None] * a[:, :, None] * a[:, None, :]
            right = p + (weight * (rest + (a * p).sum(axis=1)))[:, None] * a
            for c in range(CENTROIDS):
                at = codes[:, j] == c
                if at.any():
                    q.books[j, c] = np.linalg.solve(outer[at].sum(axis=0), right[at].sum(axis=0))
    return q


def _matrix(column, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype=np.float64).reshape(-1, dim)


def usable(vectors: DataFrame, id_col: str, vector_col: str, dim: int | None) -> tuple[DataFrame, int]:
    """vec_id, embedding of the rows that take part, and their length."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.where(finite & F.exists("embedding", lambda v: v != 0))
    if dim is None:
        top = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
        dim = top["d"] if top else 1
    return rows.where(F.size("embedding") == dim), dim


@dataclass
class Cells:
    """Coarse cells: the nearest of `centres`; a query looks into its `probes` nearest cells."""

    centres: np.ndarray
    probes: int

    def order(self, x: np.ndarray) -> np.ndarray:
        """Cells of each vector, nearest first."""
        return np.argsort(self._gap(x), axis=1, kind="stable")

    def of(self, x: np.ndarray) -> np.ndarray:
        return self._gap(x).argmin(axis=1)

    def _gap(self, x: np.ndarray) -> np.ndarray:
        return (self.centres * self.centres).sum(axis=1) - 2 * x @ self.centres.T


def fit_cells(x: np.ndarray, *, most: int = 256, k: int = 10, found: float = FOUND, rounds: int = 8, seed: int = 3) -> Cells:
    """Cells from sample vectors by k-means. As many are probed as it takes to find the share
    `found` of the sample's true neighbours: few where vectors form clusters, all where they do not."""
    x = np.unique(np.asarray(x, dtype=np.float64), axis=0)
    rng = np.random.default_rng(seed)
    x = x[rng.permutation(len(x))]
    cells = Cells(x[: max(1, min(most, len(x) // 32))].copy(), 1)
    for _ in range(rounds):
        at = cells.of(x)
        order = np.argsort(at, kind="stable")
        held, first = np.unique(at[order], return_index=True)
        cells.centres[held] = np.add.reduceat(x[order], first, axis=0) / np.diff(np.append(first, len(x)))[:, None]
    asked = x[:512]
    place = np.argsort(cells.order(asked), axis=1)  # of each cell in each vector's order
    gap = (x * x).sum(axis=1) - 2 * asked @ x.T
    gap[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    near = np.argsort(gap, axis=1, kind="stable")[:, : min(k, max(len(x) - 1, 0))]
    if near.size:
        cells.probes = _enough(place[np.arange(len(asked))[:, None], cells.of(x)[near]], found) + 1
    return cells


def _enough(needed: np.ndarray, share: float) -> int:
    """What is enough for this share of all that is needed."""
    needed = np.sort(needed.reshape(-1))
    return int(needed[min(len(needed) - 1, int(np.ceil(share * len(needed))))])


def build_index(rows: DataFrame, dim: int, *, train_rows: int = TRAIN_ROWS, eta: float = ETA) -> tuple[DataFrame, Quantiser | None, Cells | None, np.ndarray]:
    """A table of row (a number), vec_id, embedding, cell, codes (two to a byte), the rest's length and what its nearness is less by; the quantiser; the cells; the sample."""
    rows = store(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "embedding"), "vectors")
    n = rows.count()
    most = max(16, min(CELLS, int(n**0.5)))
    wanted = max(train_rows, min(MOST_TRAIN, 32 * most))
    # somewhat more than the sample by hash, so that tasks do not each send a whole sample
    h = F.xxhash64("row", "vec_id")
    some = rows.where(F.pmod(h, F.lit(1 << 32)) < int(1.5 * wanted * (1 << 32) / max(n, 1)))
    sample = some.orderBy(h, "row").limit(wanted).select("embedding").collect()
    if not sample:
        return rows, None, None, np.zeros((0, dim))
    x = np.array([r[0] for r in sample], dtype=np.float64).reshape(-1, dim)
    cells = fit_cells(x, most=most)
    distinct = np.unique(x, axis=0)
    q = fit(_rests(cells, distinct)[2], eta)

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                b = whole.slice(lo, 2048)
                v = _matrix(b.column(2), dim)
                cell, packed, size, less = _coded(q, cells, v)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array([r.tobytes() for r in packed], type=pa.binary()), pa.array(size), pa.array(less)], names=["row", "vec_id", "embedding", "cell", "codes", "size", "less"])

    return store(rows.mapInArrow(run, "row long, vec_id long, embedding array<double>, cell int, codes binary, size double, less double"), "index"), q, cells, x


def _rests(cells: Cells, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cell of each vector, and the length and direction of what is left beside its centre."""
    cell = cells.of(x)
    rest = x - cells.centres[cell]
    size = np.sqrt((rest * rest).sum(axis=1))
    return cell, size, rest / np.maximum(size, 1e-300)[:, None]


def _coded(q: Quantiser, cells: Cells, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each vector the cell, the codes (two to a byte), the rest's length, and what its nearness is less by."""
    cell, size, way = _rests(cells, x)
    codes = q.encode(way)
    less = size * (cells.centres[cell] * q.decode(codes)[:, : x.shape[1]]).sum(axis=1) + size * size / 2
    codes = np.hstack([codes, np.zeros((len(codes), codes.shape[1] % 2), dtype=np.uint8)])
    return cell, (codes[:, 0::2] | codes[:, 1::2] << 4).astype(np.uint8), size, less


def _tables(q: Quantiser, query: np.ndarray) -> np.ndarray:
    """Inner products of a query with all pairs of two codes: a row of 256 for each byte."""
    one = (q.books * _pairs(query[None])[0][:, None, :]).sum(axis=2)
    if len(one) % 2:
        one = np.vstack([one, np.zeros((1, CENTROIDS))])
    return (one[1::2, :, None] + one[0::2, None, :]).reshape(-1, 256)


def _away(cells: Cells, queries: np.ndarray) -> np.ndarray:
    """Half the squared distance of each query to every centre, negative."""
    return queries @ cells.centres.T - (queries * queries).sum(axis=1)[:, None] / 2 - (cells.centres * cells.centres).sum(axis=1) / 2


def _codes(column) -> np.ndarray:
    """A row for each byte of the codes, a column for each vector."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype=np.uint8).reshape(len(values), -1).T.copy()


def _near(tables: np.ndarray, away: np.ndarray, codes: np.ndarray, cell: np.ndarray, size: np.ndarray, less: np.ndarray) -> np.ndarray:
    """Nearness by codes. away: of the query from every centre."""
    near = np.zeros(len(cell))
    for sums, code in zip(tables, codes):
        near += sums[code]
    return near * size + away[cell] - less


def pick_trials(cells: Cells, queries: np.ndarray, most: int = TRIALS) -> tuple[np.ndarray, np.ndarray]:
    """Queries that are tried, and their groups: taken in turn from groups by the power of two of the distance to the centre."""
    group = np.frexp(_rests(cells, queries)[1])[1]
    turn = np.zeros(len(queries), dtype=np.int64)
    for g in np.unique(group):
        turn[group == g] = np.arange((group == g).sum())
    chosen = np.lexsort((group, turn))[:most]
    return queries[chosen], group[chosen]


def _calibrate(index: DataFrame, q: Quantiser, cells: Cells, asked: np.ndarray, dim: int, k: int, group: np.ndarray) -> tuple[int, int]:
    """Cells to probe and vectors to rerank, so that in each group the shares FOUND and TOLD of the true neighbours of some vectors are found: by one
    exact pass over the index, and one that counts what codes put before these neighbours."""
    columns, names = "cell int, codes binary, size double, less double", ["cell", "codes", "size", "less"]

    def exact(batches):
        held: list[tuple[np.ndarray, ...] | None] = [None] * len(asked)
        for b in batches:
            v, cell, size, less = _matrix(b.column(0), dim), b.column(1).to_numpy(), b.column(3).to_numpy(), b.column(4).to_numpy()
            codes = np.array([np.frombuffer(c, dtype=np.uint8) for c in b.column(2).to_pylist()])
            for i, a in enumerate(asked):
                gap = ((v - a) ** 2).sum(axis=1)
                # the vector itself and its copies are found by any way
                at = np.flatnonzero(gap > 0)
                at = at[np.argsort(gap[at], kind="stable")[:k]]
                new = gap[at], cell[at], codes[at], size[at], less[at]
                new = new if held[i] is None else tuple(np.concatenate(x) for x in zip(held[i], new))
                best = np.argsort(new[0], kind="stable")[:k]
                held[i] = tuple(x[best] for x in new)
        for i, h in enumerate(held):
            if h is not None and len(h[0]):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h[0]), i)), pa.array(h[0]), pa.array(h[1]), pa.array([c.tobytes() for c in h[2]], type=pa.binary()), pa.array(h[3]), pa.array(h[4])], names=["i", "gap", *names])

    best: dict[int, list] = {}
    for r in index.select("embedding", *names).mapInArrow(exact, f"i long, gap double, {columns}").toLocalIterator():  # k rows a task and trial
        best.setdefault(r["i"], []).append((r["gap"], r["cell"], bytes(r["codes"]), r["size"], r["less"]))
    trials = {i: sorted(v)[:k] for i, v in best.items()}
    if not trials:
        return 1, k
    order, tables, away = np.argsort(cells.order(asked), axis=1), [_tables(q, a) for a in asked], _away(cells, asked)
    places = {i: order[i, [cell for _, cell, _, _, _ in v]] for i, v in trials.items()}
    groups = [[i for i in trials if group[i] == g] for g in np.unique(group[list(trials)])]
    probes = max(_enough(np.concatenate([places[i] for i in g]), FOUND) for g in groups) + 1
    wanted = {}
    for i, v in trials.items():
        _, cell, codes, size, less = zip(*v)
        wanted[i] = np.sort(_near(tables[i], away[i], np.array([np.frombuffer(c, dtype=np.uint8) for c in codes]).T, np.array(cell), np.array(size), np.array(less)))

    def count(batches):
        before = {i: np.zeros(len(w), dtype=np.int64) for i, w in wanted.items()}
        for b in batches:
            cell, codes, size, less = b.column(0).to_numpy(), _codes(b.column(1)), b.column(2).to_numpy(), b.column(3).to_numpy()
            for i, w in wanted.items():
                near = np.sort(_near(tables[i], away[i], codes, cell, size, less))
                before[i] += len(near) - np.searchsorted(near, w, side="left")
        for i, n in before.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), i)), pa.array(np.arange(len(n))), pa.array(n)], names=["i", "j", "n"])

    counts = index.select(*names).mapInArrow(count, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()  # k rows a trial
    before = {i: [r["n"] for r in counts if r["i"] == i] for i in trials}
    return probes, max(_enough(np.concatenate([before[i] for i in g]), TOLD) for g in groups) + 1


def deal_cells(sizes: list[int], part_rows: int) -> tuple[list[int], list[int]]:
    """The first part and the number of parts of each cell: whole cells share a part as long as they fit, a large one has parts of its own."""
    first, pieces, at, room = [], [], 0, part_rows
    for n in sizes:
        need = max(1, -(-n // part_rows))
        if n > room:
            at, room = at + 1, part_rows
        first.append(at)
        pieces.append(need)
        at, room = at + need - 1, room - n if need == 1 else 0
    return first, pieces


def _scan(q: Quantiser, cells: Cells, most: int, k: int, dim: int):
    """The best by codes of a part for each query of a block, of the cells that it looks into: at most `most` that reach the query's floor, at least k."""

    def run(part: pa.Table, block: pa.Table) -> pa.Table:
        out = {"asked": [], "row": [], "vec_id": [], "near": []}
        if part.num_rows and block.num_rows:
            order = np.argsort(part.column("cell").to_numpy(), kind="stable")
            row, vec, cell, size, less = (part.column(c).to_numpy()[order] for c in ("row", "vec_id", "cell", "size", "less"))
            codes = _codes(part.column("codes"))[:, order]
            held, first = np.unique(cell, return_index=True)
            ends = dict(zip(held.tolist(), zip(first.tolist(), np.append(first[1:], len(cell)).tolist())))
            queries = _matrix(block.column("vector").combine_chunks(), dim)
            for own, mine, floor, v, away in zip(block.column("asked").to_pylist(), block.column("cells").to_pylist(), block.column("floor").to_pylist(), queries, _away(cells, queries)):
                at = np.concatenate([np.arange(*ends[c]) for c in mine if c in ends] or [np.arange(0)])
                at = at[row[at] != own]
                near = _near(_tables(q, v), away, codes[:, at], cell[at], size[at], less[at])
                best = np.lexsort((vec[at], -near))[: max(k, min(most, int((near >= floor).sum())))]
                out["asked"].append(np.full(len(best), own))
                out["row"].append(row[at[best]])
                out["vec_id"].append(vec[at[best]])
                out["near"].append(near[best])
        kinds = {"asked": pa.int64(), "row": pa.int64(), "vec_id": pa.int64(), "near": pa.float64()}
        return pa.table({c: pa.array(np.concatenate(v) if v else [], type=kinds[c]) for c, v in out.items()})

    return run


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, every: int = 100, k: int = 10, rerank: int = RERANK, block: int = BLOCK, part_rows: int = PART_ROWS, train_rows: int = TRAIN_ROWS, eta: float = ETA, dim: int | None = None) -> DataFrame:
    """The k nearest found of each vector whose id is divisible by `every`: query_id, rank,
    vec_id, score (Euclidean distance). At least `rerank` vectors are reranked for each query."""
    rows, dim = usable(vectors, id_col, vector_col, dim)
    index, q, cells, sample = build_index(rows, dim, train_rows=train_rows, eta=eta)
    if q is None:
        return index.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    queries = index.where(F.col("vec_id") % every == 0).orderBy(F.xxhash64("row", "vec_id"), "row").limit(ASKED).select("embedding").collect()
    if queries:
        trials, group = pick_trials(cells, np.array([r[0] for r in queries], dtype=np.float64).reshape(-1, dim))
        cells.probes, needed = _calibrate(index, q, cells, trials, dim, k, group)
    else:
        needed = k
    rerank = max(rerank, needed, k)

    held = {r["cell"]: r["count"] for r in index.groupBy("cell").count().collect()}  # a row for each cell
    sizes = np.array([held.get(c, 0) for c in range(len(cells.centres))])
    first, pieces = deal_cells(sizes.tolist(), part_rows)

    # the sample as codes; how many of it reach a query's floor
    own, codes, size, less = _coded(q, cells, sample)
    codes = codes.T.copy()
    reach = min(len(sample), max(1, int(np.ceil(AMPLE * rerank * len(sample) / max(1, sizes.sum())))))

    def probe(batches):
        for b in batches:
            queries = _matrix(b.column(2), dim)
            floors = [np.partition(_near(_tables(q, v), away, codes, own, size, less), len(own) - reach)[len(own) - reach] for v, away in zip(queries, _away(cells, queries))]
            order = cells.order(queries).astype(np.int32)
            # as many more cells as it takes to hold as many others as are reranked
            most = np.maximum(cells.probes, (np.cumsum(sizes[order], axis=1) <= rerank).sum(axis=1) + 1)
            looked = [o[:n] for o, n in zip(order, most)]
            parts = [np.unique(np.concatenate([np.arange(first[c], first[c] + pieces[c]) for c in o])) for o in looked]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(looked, type=pa.list_(pa.int32())), pa.array(parts, type=pa.list_(pa.int64())), pa.array(floors, type=pa.float64())], names=["asked", "query_id", "vector", "cells", "parts", "floor"])

    asked = index.where(F.col("vec_id") % every == 0).select(F.col("row").alias("asked"), F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    asked = store(asked.mapInArrow(probe, "asked long, query_id long, vector array<double>, cells array<int>, parts array<bigint>, floor double"), "asked")
    visits = asked.select("asked", "vector", "cells", "floor", F.explode("parts").alias("part"))
    blocks = {r["part"]: -(-r["count"] // block) for r in visits.groupBy("part").count().collect()}  # a row for each part
    pick = lambda values, c: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), c.cast("int") + 1)
    n_blocks = pick([blocks.get(p, 0) for p in range(first[-1] + pieces[-1])], F.col("part"))
    part = pick(first, F.col("cell")) + F.pmod(F.xxhash64("row"), pick(pieces, F.col("cell")))
    scanned = index.select("row", "vec_id", "cell", "codes", "size", "less", part.alias("part"))
    # each part meets each block of the queries that look into it, in a task of its own
    scanned = scanned.select("*", F.explode(F.when(n_blocks > 0, F.sequence(F.lit(0).cast("long"), n_blocks - 1))).alias("block"))
    visits = visits.select("*", F.pmod(F.xxhash64("asked"), n_blocks).alias("block"))
    key = ["part", "block"]
    found = scanned.groupBy(*key).cogroup(visits.groupBy(*key)).applyInArrow(_scan(q, cells, rerank, k, dim), "asked long, row long, vec_id long, near double")
    order = Window.partitionBy("asked").orderBy(F.desc("near"), "vec_id")
    found = found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= rerank).select("asked", "row", "vec_id")
    found = found.join(index.select("row", "embedding"), "row").join(asked.select("asked", "query_id", "vector"), "asked")
    squares = F.aggregate(F.zip_with("embedding", "vector", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    found = found.select("asked", "query_id", "vec_id", F.sqrt(squares).alias("score"))
    order = Window.partitionBy("asked").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
