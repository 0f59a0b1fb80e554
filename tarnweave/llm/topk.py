"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Components are turned into integers, floor(scale * x). Vectors are dealt into parts of about `part_rows`, queries into blocks of about
`block`, and each part meets each block in a task. A part holds a list for each dimension, sorted; a query reads it from the top
where its own component is positive and from the bottom where it is negative. All lists are read in step, `first` entries at first
and twice as many each time. What a list has not shown yet lies between the last entry read and the list's far end, so that every
vector has a lower and an upper bound of its score: with the last entry read f, a component x counts as max(x, f) from above (from
the top; min(x, f) from the bottom), and from below as x if it was read and as the far end if not. The k-th largest lower bound is
what a vector must reach: those whose upper bound is less are outsiders. A query stops once at most `open_rows` vectors are left, or at
the lists' ends, and then the scores of these are resolved in full. Bounds are exact integers (in doubles only where all
sums stay below 2^53, as Python integers otherwise), so no tie is lost.

Edge cases: vectors that are null or hold null or non-finite components take no part; zero and empty vectors do. A shorter vector
has zeros for the components it lacks. A row with a null id is a candidate, the last of its ties, but no query. A query never
finds its own row, but other rows of its id; each of several rows with a query's id is a query, so that its ranks repeat. Ties go to
the smaller id; with fewer than k candidates all are returned. A score outside a long's range counts as the nearest long. Empty
tables give empty results; columns other than the id and the vector are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

#: Queries and vectors that meet in one task; queries that read together; entries read at first; vectors left at which a query stops.
BLOCK, PART_ROWS, TOGETHER, FIRST, OPEN_ROWS = 1024, 16_384, 128, 256, 64
_LEAST = -(1 << 63)


def _integers(column: pa.Array, scale: int) -> np.ndarray:
    """A row of integers for each vector, with zeros behind the shorter ones: int64 where they fit, else Python integers."""
    at, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(at)
    fits = not len(flat) or float(np.abs(flat).max()) < 2.0**53 / scale
    whole = np.floor(flat * scale).astype(np.int64) if fits else np.array([int(np.floor(v * scale)) if abs(v) < 2.0**60 else int(v) * scale for v in flat.tolist()], dtype=object)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), dtype=whole.dtype)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(at[0], at[-1]) - np.repeat(at[:-1], sizes)] = whole[at[0] : at[-1]]
    return out


def _padded(x: np.ndarray, dim: int) -> np.ndarray:
    return np.hstack([x, np.zeros((len(x), dim - x.shape[1]), dtype=x.dtype)])


def best(x: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, *, first: int = FIRST, open_rows: int = OPEN_ROWS, read: list | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the rows of x that may be among its k best, with their scores: all of the k best and what ties with them. own:
    the row of x that is the query itself, or -1. read, if given, gets the number of entries that each query read from a list."""
    dim = max(x.shape[1], queries.shape[1])
    x, queries = _padded(x, dim), _padded(queries, dim)
    most = max(1, dim) * max(1, int(np.abs(x).max(initial=0))) * max(1, int(np.abs(queries).max(initial=0)))
    kind, least = (np.float64, -np.inf) if most < 1 << 53 else (object, -2 * most)
    x, queries = x.astype(kind), queries.astype(kind)
    lists = np.sort(x, axis=0)  # read from the bottom; from the top the other way round
    up, down, left, out = np.maximum(queries, 0), np.minimum(queries, 0), np.arange(len(queries)), [None] * len(queries)
    depth = min(first, len(x))
    while len(left):
        top, bottom = lists[-depth], lists[depth - 1]
        high = up[left] @ np.maximum(x, top).T + down[left] @ np.minimum(x, bottom).T
        low = high if depth == len(x) else up[left] @ np.where(x >= top, x, lists[0]).T + down[left] @ np.where(x <= bottom, x, lists[-1]).T
        for bounds in (high, low):
            mine = np.flatnonzero(own[left] >= 0)
            bounds[mine, own[left][mine]] = least
        need = np.partition(low, len(x) - k, axis=1)[:, len(x) - k] if len(x) > k else np.full(len(left), least, dtype=kind)
        need = np.where(need > _LEAST, np.minimum(need, ~_LEAST), least)  # scores outside a long's range are ties
        may = high >= need[:, None]
        done = (may.sum(axis=1) <= max(k, open_rows)) | (depth == len(x))
        for i in np.flatnonzero(done):
            rows = np.flatnonzero(may[i])
            rows = rows[rows != own[left[i]]]
            out[left[i]] = rows, x[rows] @ queries[left[i]]
            if read is not None:
                read.append(depth)
        left, depth = left[~done], min(2 * depth, len(x))
    return out


def _search(k: int, scale: int):
    """The k best of a part for each query of a block."""

    def run(part: pa.Table, block: pa.Table) -> pa.Table:
        out = {"asked": [], "query_id": [], "vec_id": [], "score": []}
        if part.num_rows and block.num_rows:
            row, ids = part.column("row").to_numpy(), part.column("vec_id").to_pylist()
            order = np.argsort(row, kind="stable")
            x, queries = (_integers(t.column(c).combine_chunks(), scale) for t, c in ((part, "vector"), (block, "query")))
            asked, query_id = block.column("asked").to_numpy(), block.column("query_id").to_pylist()
            at = np.searchsorted(row[order], asked)
            found = order[np.minimum(at, len(row) - 1)]
            own = np.where(row[found] == asked, found, -1)
            for lo in range(0, len(asked), TOGETHER):
                some = slice(lo, lo + TOGETHER)
                for i, (rows, scores) in enumerate(best(x, queries[some], own[some], k), lo):
                    top = sorted((-max(_LEAST, min(int(s), ~_LEAST)), ids[r] is None, ids[r] or 0) for r, s in zip(rows.tolist(), scores.tolist()))[:k]
                    out["asked"] += [int(asked[i])] * len(top)
                    out["query_id"] += [query_id[i]] * len(top)
                    out["vec_id"] += [None if null else v for _, null, v in top]
                    out["score"] += [-s for s, _, _ in top]
        return pa.table({c: pa.array(v, type=pa.int64()) for c, v in out.items()})

    return run


def top_products(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, every: int = 50, k: int = 5, scale: int = 256, block: int = BLOCK, part_rows: int = PART_ROWS) -> DataFrame:
    """The k highest inner products of each vector whose id is divisible by `every`: query_id, rank, vec_id, score."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vector").isNotNull() & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    rows = checkpoint(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "vector"))
    query = F.col("vec_id") % every == 0
    n = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(query).alias("queries")).first()
    parts, blocks = max(1, -(-n["rows"] // part_rows)), max(1, -(-n["queries"] // block))
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.lit(n))
    every_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asked = rows.where(query).select(F.col("row").alias("asked"), F.col("vec_id").alias("query_id"), F.col("vector").alias("query"), dealt(blocks).alias("block"), every_of(parts).alias("part"))
    key = ["part", "block"]
    rows = rows.select("*", dealt(parts).alias("part"), every_of(blocks).alias("block"))
    found = rows.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(_search(k, scale), "asked long, query_id long, vec_id long, score long")
    order = Window.partitionBy("asked").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
