"""Mixing sources to target weights with cube-method balanced sampling.

Each source gets a target number of words: shares of the mix by weight, none above
`max_repeats` times what the source has (the excess is shared again by weight until none is
above). A document of a source is then due target / source size copies. The whole part is taken
outright; the fractional part is sampled by the cube method. Its flight phase moves the
fractional probabilities along the null space of the two balancing constraints (words,
documents), so that both totals of a source stay exactly as they are while at least one document
reaches 0 or 1. Each move is led by the longest document that is still fractional, and balanced by
the `WINDOW` next ones, so that the documents left to the end are the shortest.

A source's documents fly in blocks of about `block_rows`. While a source has several blocks, each
stops at its `HAND_ON` shortest fractional documents; these are dealt to fewer blocks and fly on.
The last block of a source flies until at most two documents are fractional. The landing phase
rounds these two by the linear programme over their four outcomes, which keeps either's
probability and, of all such, has the least expected square error in words and documents. So the
inclusion probability of every document is the one due, and what a source's sample is depends on its
target and its own documents only.

Edge cases: a null text has size 0; a document without words is taken 0 times and takes no part
in the flight; a null source is a source of its own, the last one; rows that repeat an id are
documents of their own, and equal rows are told apart by a number, so they are dealt to all blocks; an
empty table gives an empty mix. Other columns are never read by `mix`; `mixed_documents` keeps them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, checkpoint, numbered, repeated, row_hash

WEIGHTS = (5, 2, 1)
#: Documents of one flight; those that a block of several hands on; those that balance a move.
BLOCK_ROWS, HAND_ON, WINDOW = 4096, 64, 64
#: Fractional documents that the last flight of a source leaves at most: one for each constraint.
CONSTRAINTS = 2
_EPS = 1e-9


def word_count(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def source_targets(sizes: DataFrame, *, weights=WEIGHTS, total_share: float = 1.5, max_repeats: float = 2.0) -> DataFrame:
    """sizes: source, size, n (rows). A row for each source: src_no, source, source_size, n_docs
    (with words), target.

    The targets are found by filling to a level: sources whose cap is below their share at the
    level are full, which raises the level of the others, until no more are full.
    """
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("n_docs"))
    per = numbered(per, [F.col("source").asc_nulls_last()], "src_no")
    w = F.array(*[F.lit(float(x)) for x in weights])
    per = per.withColumn("w", F.element_at(w, (F.col("src_no") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
    per = checkpoint(per)
    level = 0.0
    while True:
        full = F.col("cap") < F.col("w") * F.lit(level)
        r = per.agg(F.sum("source_size"), F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(~full, F.col("w")).otherwise(0.0))).first()
        now = ((r[0] or 0) * total_share - r[1]) / r[2] if r[2] else float("inf")
        if now <= level * (1 + 1e-12):
            break
        level = now
        if level == float("inf"):
            break
    return per.select("src_no", "source", "source_size", "n_docs", F.least(F.col("cap"), F.col("w") * F.lit(level)).alias("target"))


def _direction(s: np.ndarray, p: np.ndarray) -> np.ndarray:
    """A move in the null space of (1, s) for fractional p, sorted by falling s: the first leads,
    and the others balance it in proportion to the room they have; where they cannot, as all are of
    one other size, two of them change places."""
    out = np.zeros(len(s))
    rest, room = s[1:] - s[0], p[1:] * (1 - p[1:])
    total = room.sum()
    mean = (room @ rest) / total
    spread = room @ (rest - mean) ** 2
    if spread > 1e-12 * max(1.0, mean * mean) * total:
        # v = room * (a + b * (rest - mean)) with sum -1 and sum of v * rest 0
        out[0], out[1:] = 1.0, room * (mean * (rest - mean) / spread - 1 / total)
    elif abs(mean) < 0.5:
        out[0], out[1:] = 1.0, -room / total
    else:
        out[1], out[2] = 1.0, -1.0
    return out


def flight(sizes, probs, coin, leave: int = CONSTRAINTS) -> np.ndarray:
    """Probabilities after the flight phase: all but at most `leave` are 0 or 1; sum(p) and
    sum(p * size) are as before. coin() gives numbers in [0, 1)."""
    sizes, p = np.asarray(sizes, dtype=np.float64), np.array(probs, dtype=np.float64)
    p[p <= _EPS], p[p >= 1 - _EPS] = 0.0, 1.0
    order = np.argsort(-sizes, kind="stable")
    order = order[(p[order] > 0) & (p[order] < 1)]
    held, at = order[: WINDOW + 1], WINDOW + 1
    left = len(order)
    while left > max(leave, CONSTRAINTS):
        q, v = p[held], _direction(sizes[held], p[held])
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(v > 0, (1 - q) / v, np.where(v < 0, -q / v, np.inf)).min()
            down = np.where(v > 0, q / v, np.where(v < 0, (q - 1) / v, np.inf)).min()
        q = q + (up if coin() * (up + down) < down else -down) * v
        q[q <= _EPS], q[q >= 1 - _EPS] = 0.0, 1.0
        p[held] = q
        open_ = held[(q > 0) & (q < 1)]
        done = len(held) - len(open_)
        left -= done
        held, at = np.concatenate([open_, order[at : at + done]]), at + done
    return p


def landing(probs, coin) -> np.ndarray:
    """Fractional probabilities rounded, two at a time. With p + q <= 1 not both are taken, else at
    least one is: of the ways that keep both probabilities, the one that errs least."""
    p = np.array(probs, dtype=np.float64)
    todo = list(np.flatnonzero((p > 0) & (p < 1)))
    while len(todo) > 1:
        a, b, u = todo.pop(), todo.pop(), coin()
        both = max(0.0, p[a] + p[b] - 1)
        x, y = p[a], p[b]
        p[a] = float(u < x)
        p[b] = float(u < both or x <= u < x + y - both)
    for a in todo:
        p[a] = float(coin() < p[a])
    return p


def _coin(seed: int):
    """Numbers in [0, 1) from a 64-bit multiplicative generator; the same for the same seed."""
    state = (seed * 2862933555777941757 + 3037000493) & 0xFFFFFFFFFFFFFFFF

    def draw() -> float:
        nonlocal state
        state = (state * 6364136223846793005 + 1442695040888963407) & 0xFFFFFFFFFFFFFFFF
        return (state >> 11) / 9007199254740992.0

    for _ in range(4):
        draw()
    return draw


def _fly(seed: int, level: int, hand_on: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("ord", "ascending")])
        first = {c: table.column(c)[0].as_py() for c in ("src_no", "block", "blocks", "mark")}
        # the source's place among the others must not matter, so the coin knows it by its name
        coin = _coin(seed ^ level << 56 ^ first["block"] << 32 ^ first["mark"] & 0xFFFFFFFF)
        last = first["blocks"] <= 1
        p = flight(table.column("size").to_numpy(), table.column("p").to_numpy(), coin, CONSTRAINTS if last else hand_on)
        if last:
            p = landing(p, coin)
        done = (p == 0) | (p == 1)
        whole = table.column("copies").to_numpy()
        new = {"p": pa.array(np.where(done, -1.0, p)), "copies": pa.array(np.where(done, whole + (p == 1), whole).astype(np.int32))}
        return pa.table({c: new.get(c, table.column(c)) for c in table.column_names})

    return run


def _sampled(units: DataFrame, keys: list[str], targets: DataFrame, block_rows: int, seed: int) -> DataFrame:
    """units: keys, source, size, mark (a hash), n (equal rows). A row for each of the n: keys,
    source, size, source_size, target, copies."""
    rows = repeated(units, "n", ["mark"])
    rows = rows.join(targets.withColumnRenamed("source", "__src"), F.col("source").eqNullSafe(F.col("__src")))
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(due + F.lit(_EPS)).cast("int")
    part = F.when((F.col("size") == 0) | (due - whole <= _EPS), F.lit(-1.0)).otherwise(due - whole)
    rows = rows.withColumn("ord", F.xxhash64(F.lit(seed), "mark", "size", "nth")).withColumn("blocks", F.greatest(F.ceil(F.col("n_docs") / block_rows), F.lit(1)).cast("long"))
    state = rows.select(
        *keys, "src_no", F.pmod("ord", "blocks").alias("block"), "blocks", "ord", F.xxhash64(F.col("source").cast("string")).alias("mark"), "size",
        F.when(F.col("size") == 0, F.lit(0)).otherwise(whole).alias("copies"), part.alias("p"),
    )
    schema, settled, flying, level = state.schema, [state.where("p < 0")], state.where("p >= 0"), 0
    blocks = targets.agg(F.max(F.ceil(F.col("n_docs") / block_rows))).first()[0] or 0
    hand_on = min(HAND_ON, block_rows // 4)
    while True:
        flown = flying.groupBy("src_no", "block").applyInArrow(_fly(seed, level, hand_on), schema)
        if blocks <= 1:
            settled.append(flown)
            break
        flown, level = checkpoint(flown), level + 1
        settled.append(flown.where("p < 0"))
        fewer = lambda n: F.ceil(n * hand_on / block_rows).cast("long")
        flying = flown.where("p >= 0").withColumn("blocks", fewer(F.col("blocks"))).withColumn("block", F.pmod(F.xxhash64("ord"), F.greatest("blocks", F.lit(1))))
        blocks = -(-blocks * hand_on // block_rows)
    out = settled[0]
    for part_ in settled[1:]:
        out = out.unionByName(part_)
    return out.join(targets, "src_no").select(*keys, "source", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights=WEIGHTS, total_share: float = 1.5, max_repeats: float = 2.0, block_rows: int = BLOCK_ROWS, seed: int = 17) -> DataFrame:
    """A row for each row of docs: id_col, source, size, source_size, target, copies, taken (words)."""
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{source_col}`").alias("source"), word_count(text).alias("size"), row_hash([F.col(f"`{id_col}`"), text]).alias("mark"))
    units = checkpoint(rows.groupBy("__id", "source", "size", "mark").agg(F.count(F.lit(1)).alias("n")))
    targets = checkpoint(source_targets(units, weights=weights, total_share=total_share, max_repeats=max_repeats))
    out = _sampled(units, ["__id"], targets, block_rows, seed)
    return out.select(F.col("__id").alias(id_col), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights=WEIGHTS, total_share: float = 1.5, max_repeats: float = 2.0, block_rows: int = BLOCK_ROWS, seed: int = 17) -> DataFrame:
    """The mix itself: each row of docs as often as the sample takes it; all columns stay as they are.

    Rows that are equal in all columns are counted, sampled as rows of their own, and written as
    often as they are taken together.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    marked = docs.withColumn("__tw_a", row_hash(columns)).withColumn("__tw_b", row_hash(columns, 1))
    rows = marked.select("__tw_a", "__tw_b", F.col(f"`{source_col}`").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size"))
    units = checkpoint(rows.groupBy("__tw_a", "__tw_b", "source", "size").agg(F.count(F.lit(1)).alias("n")).withColumn("mark", F.col("__tw_a")))
    targets = checkpoint(source_targets(units, weights=weights, total_share=total_share, max_repeats=max_repeats))
    copies = _sampled(units, ["__tw_a", "__tw_b"], targets, block_rows, seed).groupBy("__tw_a", "__tw_b").agg(F.sum("copies").alias("__tw_n")).where("__tw_n > 0")
    # equal rows become one before they are dealt out; the join then finds them in place
    taken = marked.dropDuplicates(["__tw_a", "__tw_b"]).join(copies, ["__tw_a", "__tw_b"])
    return taken.withColumn("__tw_nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__tw_n")))).select(*columns)
