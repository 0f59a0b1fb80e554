"""Packing documents into token-budget batches of optimal length buckets.

Documents are cut into sequences of at most `max_length` words (nothing is dropped). Over the
global histogram of sequence lengths, which has at most max_length entries, dynamic programming
chooses the bucket boundaries with the least padding. Inside each bucket, sequences form batches
of floor(token_budget / boundary) sequences. A bucket is dealt into groups of about `group_words`
words by a hash of id, text and a number among equal rows, so that no bucket and no repeated row, however
hot, is numbered in one task; each group has one batch that is not full at most.

Edge cases: documents without words (also null texts) give no sequence; rows that repeat an id, or
id and text, are packed like any others; with fewer distinct lengths than buckets each length is a bucket; an
empty table gives no batches.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, checkpoint, repeated, row_hash
from .mixing import word_count

MAX_LENGTH, BUCKETS, TOKEN_BUDGET, GROUP_WORDS = 2048, 16, 16_384, 4_000_000


def optimal_boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """The upper ends of at most `buckets` buckets that hold all lengths with the least padding.

    best[k][j]: least cost of the first j lengths in k buckets, where a bucket costs its upper
    end times its number of sequences. The cost meets the quadrangle inequality, so the best cut
    moves one way and each layer is filled by divide and conquer.
    """
    lengths = np.array(sorted(histogram), dtype=np.int64)
    n = len(lengths)
    if n == 0:
        return []
    counts = np.concatenate([[0], np.cumsum([histogram[int(x)] for x in lengths])]).astype(np.float64)
    k = min(buckets, n)
    best = lengths * counts[1:]
    best = np.concatenate([[0.0], best])
    cuts = []
    for _ in range(1, k):
        nxt, cut = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
        nxt[0] = 0.0
        stack = [(1, n, 0, n - 1)]
        while stack:
            lo, hi, a, b = stack.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(a, min(mid - 1, b) + 1)
            cost = best[i] + lengths[mid - 1] * (counts[mid] - counts[i])
            at = int(np.argmin(cost))
            nxt[mid], cut[mid] = cost[at], i[at]
            stack += [(lo, mid - 1, a, int(i[at])), (mid + 1, hi, int(i[at]), b)]
        cuts.append(cut)
        best = nxt
    ends, j = [], n
    for cut in reversed(cuts):
        if j == 0:
            break
        ends.append(int(lengths[j - 1]))
        j = int(cut[j])
    if j:
        ends.append(int(lengths[j - 1]))
    return sorted(set(ends))


def length_histogram(sequences: DataFrame) -> dict[int, int]:
    """Of sequences that are found n times each; at most max_length entries."""
    return {r["length"]: r["n"] for r in sequences.groupBy("length").agg(F.sum("n").alias("n")).collect()}


def sequences_of(docs: DataFrame, id_col: str, text_col: str, max_length: int, *, words: bool = False) -> DataFrame:
    """A row for each sequence: doc_id, chunk, first_word, length, key and salt (hashes of id and chunk,
    and of the text; and text, on request)."""
    out = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("__tw_text"))
    if words:
        out = out.withColumn("__tw_words", F.filter(F.split(F.coalesce("__tw_text", F.lit("")), SPACE), lambda w: w != ""))
        out = out.withColumn("__tw_n", F.size("__tw_words").cast("long"))
    else:
        out = out.withColumn("__tw_n", word_count(F.col("__tw_text")))
    out = out.where("__tw_n > 0").withColumn("first_word", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__tw_n") - 1, F.lit(max_length).cast("long"))))
    cols = ["doc_id", (F.col("first_word") / max_length).cast("int").alias("chunk"), "first_word", F.least(F.col("__tw_n") - F.col("first_word"), F.lit(max_length)).cast("int").alias("length"), row_hash([F.col("doc_id"), (F.col("first_word") / max_length).cast("int")]).alias("key"), F.xxhash64("__tw_text").alias("salt")]
    if words:
        cols.append(F.array_join(F.slice("__tw_words", (F.col("first_word") + 1).cast("int"), max_length), " ").alias("text"))
    return out.select(*cols)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, max_length: int = MAX_LENGTH, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET, group_words: int = GROUP_WORDS, with_text: bool = False) -> DataFrame:
    """A row for each sequence: id_col, chunk, first_word, length, bucket (its upper end), batch,
    slot, padding (and text, on request). A batch holds bucket * sequences <= token_budget, or
    one sequence where the budget is less than the bucket."""
    plain = sequences_of(docs, id_col, text_col, max_length)
    # equal rows become one with their number
    plain = checkpoint(plain.groupBy(*plain.columns).agg(F.count(F.lit(1)).alias("n")))
    histogram = length_histogram(plain)
    ends = optimal_boundaries(histogram, buckets)
    if not ends:
        ends = [max_length]
    bounds = F.array(*[F.lit(e) for e in ends])
    per_bucket = [sum(n for x, n in histogram.items() if (ends[i - 1] if i else 0) < x <= e) for i, e in enumerate(ends)]
    groups = F.array(*[F.lit(max(1, -(-n * e // group_words))) for n, e in zip(per_bucket, ends)])
    capacity = F.array(*[F.lit(max(1, token_budget // e)) for e in ends])
    rows = repeated(plain, "n", ["key", "salt"])
    rows = rows.withColumn("__tw_b", (F.size(F.filter(bounds, lambda e: e < F.col("length"))) + 1).cast("int"))
    rows = rows.withColumn("__tw_h", F.xxhash64("key", "salt", "nth")).withColumn("__tw_g", F.pmod(F.col("__tw_h"), F.element_at(groups, F.col("__tw_b"))))
    order = Window.partitionBy("__tw_b", "__tw_g").orderBy("__tw_h", "doc_id", "chunk", "nth")
    rows = rows.withColumn("__tw_r", F.row_number().over(order) - 1).withColumn("bucket", F.element_at(bounds, F.col("__tw_b")))
    cap = F.element_at(capacity, F.col("__tw_b"))
    batch = F.format_string("%d-%d-%d", F.col("bucket"), F.col("__tw_g"), F.floor(F.col("__tw_r") / cap).cast("long"))
    out = rows.select("doc_id", "chunk", "first_word", "length", "bucket", batch.alias("batch"), (F.col("__tw_r") % cap).cast("int").alias("slot"), (F.col("bucket") - F.col("length")).cast("int").alias("padding"), "key", "salt")
    if with_text:
        # equal rows become one before their text is dealt out; the join then finds it in place
        texts = sequences_of(docs, id_col, text_col, max_length, words=True).select("key", "salt", "text").dropDuplicates(["key", "salt"])
        out = out.join(texts, ["key", "salt"])
    return out.drop("key", "salt").withColumnRenamed("doc_id", id_col)
