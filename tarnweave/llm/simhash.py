"""SimHash near-dedup with deletion-variant signatures.

A fingerprint has 64 bits; two are linked at 4 or fewer differing bits. Cut into three segments
(22, 21, 21 bits), a linked pair has a segment that differs by at most one bit: either a segment
is the same, or all three differ and at least two of them by exactly one bit, so one of the first
two does. Hence 3 + 22 + 21 signatures index a fingerprint: each whole segment, and each
one-wildcard variant (one bit deleted) of the first two segments. Equal signatures are joined
and each pair of a bucket is verified on the full fingerprints.

Fingerprints are made distinct first, so exact copies cost one entry. Where many fingerprints
are indexed, signatures get further exact pieces of the other segments (see `signatures`), so
that buckets of unrelated fingerprints stay small. A bucket hands on a spanning forest of its
links, never all pairs. A bucket of more than `bucket_rows` fingerprints is not held in one
task: its members are linked by an exact second way, in which each fingerprint lists the points
within 2 bits of it, and two fingerprints are linked if and only if they share a point.
Components come from alternating large-star and small-star steps.

Near copies of a similarity of 0.8 or more differ in more bits than four as a rule, so `drop_near_copies` takes `COPIES` fingerprints
of a text over five-word shingles, each from a mixing of its own of the shingles' hashes, and links texts that any of
them links. A pair of five-word similarity 0.95 is linked by one with a probability of about 0.5, by one of four of 0.93; at 0.88
of 0.14 and 0.44, and at 0.6, which is no near copy, of 0.001 and 0.005.

Edge cases: texts without words (also null texts) have fingerprint zero and are linked like any
other; a text of fewer words than a shingle is one shingle; null ids are never the smallest
unless all ids of a component are null; rows that repeat an id or a text give a row each; empty
tables give empty results. Other columns are never read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, row_hash

SHINGLE, DISTANCE, BITS = 4, 4, 64
#: Of near copies in a stage: words of a shingle, fingerprints of a text.
STAGE_SHINGLE, COPIES = 5, 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
BUCKET_ROWS = 8192
#: Signatures that a task makes.
TASK_ROWS = 1_000_000
#: Signatures are not made longer than about this.
MOST_BITS = 40
_CHUNK = 1 << 15


def _mixed(h: np.ndarray, copies: int) -> np.ndarray:
    """A row for each hash: the hash itself and further mixings of it."""
    out = np.empty((len(h), copies), dtype=np.uint64)
    out[:, 0] = h
    for k in range(1, copies):
        x = h + np.uint64(0x9E3779B97F4A7C15 * k & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = x ^ (x >> np.uint64(31))
    return out


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of a whole text."""
    return int(several(text, shingle, 1)[0])


def several(text: str | None, shingle: int, copies: int) -> np.ndarray:
    """Unsigned fingerprints of a whole text, the first from the hashes themselves."""
    # of bytes, lower() changes A-Z only and split() parts at 0x20 and 0x09 to 0x0D only
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if n == 0:
        return np.zeros(copies, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        return _mixed(np.array([digest(b" ".join(words), 42)], dtype=np.uint64), copies)[0]
    joined, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1)
    starts, ends = [0, *ends[: n - shingle].tolist()], (ends[shingle - 1 :] - 1).tolist()
    total, counts = n - shingle + 1, np.zeros(BITS * copies, dtype=np.int64)
    for lo in range(0, total, _CHUNK):
        hi = min(lo + _CHUNK, total)
        h = np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts[lo:hi], ends[lo:hi])), dtype="<u8", count=hi - lo)
        bits = np.unpackbits(_mixed(h, copies).view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > total, bitorder="little").view("<u8")


def _digest(text: Column) -> Column:
    return F.coalesce(F.sha2(text, 256), F.lit("null"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, *, copies: int = 0, digest: bool = False) -> DataFrame:
    """id_col as doc_id, fp (the fingerprint's 64 bits as a signed long) or, for several copies, fp0, fp1 ..., and on request
    digest (of the text)."""
    names = [f"fp{k}" for k in range(copies)] or ["fp"]

    def run(batches):
        for b in batches:
            fps = np.array([several(t.as_py(), shingle, len(names)) for t in b.column(1)], dtype=np.uint64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(np.ascontiguousarray(c).view(np.int64)) for c in fps.T], *b.columns[2:]], names=["doc_id", *names, *more])

    text = F.col(f"`{text_col}`").cast("string")
    more = ["digest"] if digest else []
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), *[_digest(text).alias(c) for c in more])
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {', '.join(f'{n} long' for n in names)}" + "".join(f", {c} string" for c in more))


def signatures(n: int, occupancy: int = 64) -> list[int]:
    """The bit masks that index n fingerprints: a signature is the bits under a mask.

    With few fingerprints, the segments and their one-wildcard variants. Else each is joined
    with exact pieces of the other bits: of m pieces at most d can differ, so every choice of
    m - d pieces out of m must be indexed, for d the distance left to the other bits. m grows
    until a bucket of unrelated fingerprints has at most `occupancy` members on average.
    """
    base = []
    for at, size in SEGMENTS:
        segment = ((1 << size) - 1) << at
        base.append((segment, segment, DISTANCE))
    for at, size in SEGMENTS[:2]:
        segment = ((1 << size) - 1) << at
        base += [(segment & ~(1 << (at + b)), segment, DISTANCE - 1) for b in range(size)]
    out = []
    for mask, segment, left in base:
        rest = [b for b in range(BITS) if not segment >> b & 1]

        def length(pieces: int) -> int:
            return bin(mask).count("1") + len(rest) * (pieces - left) // pieces  # noqa: B023

        pieces = left
        while n >> length(pieces) > occupancy and length(pieces) < MOST_BITS:
            pieces += 1
        cut = [rest[i * len(rest) // pieces : (i + 1) * len(rest) // pieces] for i in range(pieces)]
        for chosen in itertools.combinations(cut, pieces - left):
            out.append(mask | sum(1 << b for piece in chosen for b in piece))
    return out


def _links(fps: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints, searched breadth first."""
    left, out = fps, []
    while len(left) > 1:
        root, frontier, left = left[0], left[:1], left[1:]
        while len(frontier) and len(left):
            near = np.zeros(len(left), dtype=bool)
            step = max(1, (1 << 20) // len(left))
            for i in range(0, len(frontier), step):
                near |= (np.bitwise_count(frontier[i : i + step, None] ^ left[None, :]) <= DISTANCE).any(axis=0)
            frontier, left = left[near], left[~near]
            out += [(int(root), int(x)) for x in frontier]
    return out


def _bucket_links(batches):
    """Of lists of fingerprints and, on request, the number k that a list has."""
    for b in batches:
        lists = b.column(0)
        offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
        sizes = np.diff(offsets)
        two, more = np.flatnonzero(sizes == 2), np.flatnonzero(sizes > 2)
        x, y = values[offsets[two]], values[offsets[two] + 1]
        near = np.bitwise_count(x ^ y) <= DISTANCE
        src, dst, at = [x[near]], [y[near]], [two[near]]
        for i in more:
            found = _links(values[offsets[i] : offsets[i + 1]])
            if found:
                found = np.array(found, dtype=np.uint64)
                src.append(found[:, 0])
                dst.append(found[:, 1])
                at.append(np.full(len(found), i))
        k = [c.take(pa.array(np.concatenate(at))) for c in b.columns[1:]]
        yield pa.RecordBatch.from_arrays([*k, *[pa.array(np.concatenate(v).view(np.int64)) for v in (src, dst)]], names=["k"][: len(k)] + ["src", "dst"])


def _ball() -> list[int]:
    """All masks of at most DISTANCE / 2 bits, as signed longs."""
    out = [sum(1 << b for b in c) for r in range(DISTANCE // 2 + 1) for c in itertools.combinations(range(BITS), r)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in out]


def fingerprint_links(fps: DataFrame, *, by: tuple[str, ...] = (), bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """fps: distinct fp. src, dst: links, or pairs that are connected by links of a bucket; their
    connected components are those of all links. by: () or ("k",), a number of fps and links; only fps of the same are linked."""
    n = fps.count()
    masks = signatures(n)
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    # so many rows a task that none has to spill them
    fps = fps.repartition(max(1, -(-n * len(masks) // TASK_ROWS)), "fp")
    keys = fps.select(*by, "fp", F.posexplode(F.array(*[F.lit(m) for m in signed])).alias("no", "mask"))
    keys = keys.select(*by, F.xxhash64(*by, "no", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "fp")
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_rows)
    crowded = checkpoint(sizes.select("key"))
    small = keys if crowded.isEmpty() else keys.join(crowded, "key", "left_anti")
    lists = small.groupBy("key", *by).agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps", *by)
    links = lists.mapInArrow(_bucket_links, ", ".join([*[f"{c} int" for c in by], "src long, dst long"]))
    if not crowded.isEmpty():
        dense = keys.join(crowded, "key", "left_semi").select(*by, "fp").distinct()
        points = dense.select(*by, "fp", F.explode(F.array(*[F.lit(m) for m in _ball()])).alias("mask")).select(*by, "fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("point"))
        hubs = points.groupBy(*by, "point").agg(F.min("fp").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
        links = links.unionByName(points.join(hubs, [*by, "point"]).where("fp <> hub").select(*by, F.col("hub").alias("src"), F.col("fp").alias("dst")).distinct())
    return links.distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component), for the nodes of src, dst."""
    edges = checkpoint(links.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    before = None
    while True:
        # large star: the larger neighbours of a node move to the smallest in its neighbourhood
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # stored, so that the join deals both sides anew and a node with many neighbours can be split
        least = checkpoint(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its smaller neighbours move to the smallest of them
        large = checkpoint(large)
        least = checkpoint(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = checkpoint(small.distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == now:
            return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
        before = now


def _members(reps: DataFrame, bucket_rows: int) -> DataFrame:
    """reps: a row for each fp. reps with root, the smallest fp of its component."""
    roots = components(fingerprint_links(reps.select("fp"), bucket_rows=bucket_rows))
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "fp")
    return reps.join(roots, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))


def _grouped(reps: DataFrame, copies: int, bucket_rows: int) -> DataFrame:
    """reps: row (a number), fp0, fp1 ..., rep. row, root: of rows that any of their fingerprints links; a row by itself has
    none. Rows meet at the fingerprints that they share or that are linked, which are nodes too."""
    node = lambda k, x: F.struct(k.alias("k"), F.col(x).alias("x"))
    own = reps.select("row", F.posexplode(F.array(*[f"fp{k}" for k in range(copies)])).alias("k", "fp"))
    sizes = checkpoint(own.groupBy("k", "fp").agg(F.count(F.lit(1)).alias("n")))
    links = checkpoint(fingerprint_links(sizes.select("k", "fp"), by=("k",), bucket_rows=bucket_rows))
    met = sizes.where("n > 1").select("k", "fp").unionByName(links.select("k", F.explode(F.array("src", "dst")).alias("fp"))).distinct()
    edges = links.select(node(F.col("k"), "src").alias("src"), node(F.col("k"), "dst").alias("dst"))
    edges = edges.unionByName(own.join(met, ["k", "fp"]).select(node(F.lit(-1), "row").alias("src"), node(F.col("k"), "fp").alias("dst")))
    roots = components(edges)
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    return roots.where("node.k < 0").select(F.col("node.x").alias("row"), "root")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """A row for each row of docs: id_col, fingerprint (16 hex digits), component_id (the
    smallest id reachable over links)."""
    rows = checkpoint(fingerprints(docs, id_col, text_col))
    reps = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    members = _members(reps, bucket_rows)
    ids = members.groupBy("root").agg(F.min("rep").alias("component_id"))
    labels = checkpoint(members.join(ids, "root").select("fp", "component_id"))
    return rows.join(labels, "fp").select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = STAGE_SHINGLE, copies: int = COPIES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """docs with exactly one row of each group; all columns stay.

    That with the smallest id stays, of repeated ids that with the least digest of its text; a
    row with a null id only if no row of the group has an id; of rows equal in id and text that with the least hash of all columns,
    however the rows are laid out.
    """
    names = [f"fp{k}" for k in range(copies)]
    rows = fingerprints(docs, id_col, text_col, shingle, copies=copies, digest=True)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    reps = checkpoint(rows.groupBy(*names).agg(F.min(order).alias("rep")).withColumn("row", F.monotonically_increasing_id()))
    groups = reps.join(_grouped(reps, copies, bucket_rows), "row", "left")
    alone = F.struct(F.lit(-1).alias("k"), F.col("row").alias("x"))
    kept = groups.groupBy(F.coalesce("root", alone).alias("root")).agg(F.min("rep").alias("rep"))

    def key(digest: Column, doc_id: Column) -> Column:
        return F.concat_ws("|", digest, doc_id.cast("string"))  # a null id adds nothing

    kept = kept.select(key(F.col("rep.digest"), F.col("rep.doc_id")).alias("__tw_key"))
    docs_ = docs.withColumn("__tw_key", key(_digest(F.col(f"`{text_col}`").cast("string")), F.col(f"`{id_col}`")))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    one = docs_.join(kept, "__tw_key", "left_semi").groupBy("__tw_key").agg(F.min_by(F.struct(*columns), row_hash(columns)).alias("__tw_row"))
    return one.select(*[F.col("__tw_row").getField(c).alias(c) for c in docs.columns])
