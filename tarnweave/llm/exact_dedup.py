"""Exact dedup with a log-structured merge index of text digests, in DataFrame operations only.

Ingest tasks fill memtables of `memtable_rows` entries (digest, id); each is flushed as a sorted
run. Compaction merges `fanout` runs into one of the next level, level by level, until one run is
left; an entry of it has the smallest identifier and the number of rows of its digest, and the
runs that were merged are retired (the first ones stay, as the log of all rows). Each level has
a filter: a bitmap over hashes of its digests, of at most `filter_bits` bits. Digests with more
than one row are hits, and a filter of the hits is probed by all rows: only those that it lets
through can be copies, so only their texts are dealt out, to be verified byte by byte. Where the
smallest and the largest text of a digest differ (a collision) its rows are grouped by text instead.

A filter has a fixed greatest size, so it may be broadcast; when a table has very many hits it lets
more rows through, and results stay the same.

Edge cases: a null text counts as empty. A null id is never the smallest unless all ids of a
group are null. Every input row gives one output row; of rows that repeat the kept id and text
exactly one is marked kept. Empty tables give empty results. Columns other than id and text are
never read; `drop_exact_copies` keeps of a group the row with the smallest id, of several such the one
with the least hash of all its columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, remove, row_hash, store, work_path

_DIGEST, _ID, _TEXT, _ROW = "__tw_digest", "__tw_id", "__tw_text", "__tw_row"
#: Entries of a memtable (a power of two); runs that are merged at once; bits of a filter at most.
MEMTABLE_ROWS, FANOUT, FILTER_BITS = 1 << 16, 256, 1 << 26
#: Fixed value: bits of one bitmap of the session's bitmap functions.
_BITMAP = 32_768


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, " ")


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class Filter:
    """A bitmap over hashes of digests. rows: bucket, bits; at most `bits` / 8 bytes in all, so it
    may be broadcast."""

    def __init__(self, rows: DataFrame, bits: int):
        self.rows, self.bits = rows, bits

    @staticmethod
    def place(bits: int) -> Column:
        return F.pmod(F.xxhash64(F.col(_DIGEST)), F.lit(bits)) + 1

    @classmethod
    def of(cls, digests: DataFrame, bits: int, name: str) -> Filter:
        place = cls.place(bits)
        rows = digests.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit"))
        return cls(store(rows.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")), name), bits)

    def mark(self, rows: DataFrame, name: str) -> DataFrame:
        """rows with a column `name`: false if the row's digest is surely not in the filter."""
        place = self.place(self.bits)
        rows = rows.withColumn("__tw_bucket", F.bitmap_bucket_number(place)).withColumn("__tw_bit", F.bitmap_bit_position(place))
        # at most FILTER_BITS / 8 bytes
        mine = F.broadcast(self.rows.select(F.col("bucket").alias("__tw_bucket"), F.col("bits").alias("__tw_bits")))
        octet = F.conv(F.hex(F.expr("substring(__tw_bits, cast(__tw_bit div 8 + 1 as int), 1)")), 16, 10).cast("int")
        bit = octet.bitwiseAND(F.expr("shiftleft(1, cast(__tw_bit % 8 as int))")) != 0
        return rows.join(mine, "__tw_bucket", "left").withColumn(name, F.coalesce(bit, F.lit(False))).drop("__tw_bucket", "__tw_bit", "__tw_bits")


class DigestIndex:
    """Log-structured merge index over the texts of a table.

    digest can be replaced in tests, to force collisions.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, *, memtable_rows: int = MEMTABLE_ROWS, fanout: int = FANOUT, filter_bits: int = FILTER_BITS, digest=sha256_digest):
        if memtable_rows & (memtable_rows - 1):
            raise ValueError("memtable_rows must be a power of two")
        self.spark = spark
        self.path = path or work_path(spark, "digest-index")
        self.memtable_rows, self.fanout, self.filter_bits, self.digest = memtable_rows, fanout, filter_bits, digest
        self.flushes = self.levels = 0

    def digested(self, text: Column) -> Column:
        return self.digest(normalised(text))

    def _bits(self, rows: int) -> int:
        """Sixteen bits a digest, in whole bitmaps, up to filter_bits."""
        return max(_BITMAP, min(self.filter_bits, -(-16 * rows // _BITMAP) * _BITMAP))

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("append").parquet(f"{self.path}/{name}")
        return self.spark.read.parquet(f"{self.path}/{name}")

    def flush(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Add the rows of docs as sorted runs: run, digest, id."""
        self.flushes += 1
        # the upper bits of the row number tell the task, so no memtable spans two of them
        memtable = F.shiftright(F.monotonically_increasing_id(), self.memtable_rows.bit_length() - 1)
        entries = docs.select(F.lit(self.flushes).alias("batch"), memtable.alias("run"), self.digested(F.col(f"`{text_col}`")).alias(_DIGEST), F.col(f"`{id_col}`").alias(_ID))
        return self._write(entries.sortWithinPartitions("run", _DIGEST, _ID), "runs")

    def log(self) -> DataFrame:
        """The runs as they were flushed: batch, run, digest, id."""
        return self.spark.read.parquet(f"{self.path}/runs")

    def compact(self) -> DataFrame:
        """Merge runs level by level; the last one: a row for each digest with the smallest id and
        the number of rows."""
        level = self.log().select(F.xxhash64("batch", "run").alias("run"), _DIGEST, F.col(_ID).alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
        left = self.log().select("batch", "run").distinct().count()
        while True:
            left, before = max(1, -(-left // self.fanout)), self.levels
            self.levels += 1
            merged = level.groupBy(F.pmod("run", F.lit(left)).alias("run"), _DIGEST).agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
            level = self._write(merged.sortWithinPartitions("run", _DIGEST), f"level{self.levels}")
            if before and self.levels > 1:
                remove(self.spark, f"{self.path}/level{before}")
            if left == 1:
                return level

    def rows(self) -> DataFrame:
        """A row for each digest and id, with its number of rows."""
        return self.log().groupBy(_DIGEST, _ID).agg(F.count(F.lit(1)).alias("__tw_copies"))

    def level(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/level{self.levels}")

    def level_filter(self) -> Filter:
        """Of all digests of the index."""
        return Filter.of(self.level(), self._bits(self.level().count()), "level-filter")

    def hit_filter(self) -> Filter:
        """Of the digests that more than one row has."""
        hits = self.level().where("group_size > 1")
        return Filter.of(hits, self._bits(hits.count()), "hit-filter")

    def find(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Rows of further docs whose digest the index has: id_col, keep_id. Rows that the level's
        filter rules out are not looked up."""
        asked = docs.select(F.col(f"`{id_col}`"), self.digested(F.col(f"`{text_col}`")).alias(_DIGEST))
        asked = self.level_filter().mark(asked, "__tw_maybe").where("__tw_maybe").drop("__tw_maybe")
        return asked.join(self.level().select(_DIGEST, "keep_id"), _DIGEST).select(f"`{id_col}`", "keep_id")


def _clashing(texts: DataFrame) -> DataFrame:
    """texts: digest, text. Digests that stand for more than one text, found by comparing the bytes of all hits."""
    return texts.groupBy(_DIGEST).agg(F.min(_TEXT).alias("lo"), F.max(_TEXT).alias("hi")).where("lo <> hi").select(_DIGEST)


def _index(docs: DataFrame, id_col: str, text_col: str, options: dict) -> DigestIndex:
    index = DigestIndex(docs.sparkSession, **options)
    index.flush(docs, id_col, text_col)
    index.compact()
    return index


def _split_collisions(rows: DataFrame, clashing: DataFrame) -> DataFrame:
    """Rows of digests that stand for several texts, grouped by the text itself."""
    each = rows.join(clashing, _DIGEST, "left_semi").groupBy(_DIGEST, _TEXT, _ID).agg(F.count(F.lit(1)).alias("__tw_copies"))
    groups = each.groupBy(_DIGEST, _TEXT).agg(F.min(_ID).alias("keep_id"), F.sum("__tw_copies").alias("group_size"))
    return each.join(groups, [_DIGEST, _TEXT]).select(_DIGEST, _ID, "__tw_copies", "keep_id", "group_size", F.sha2(_TEXT, 256).alias("text_sha256"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """A row for each row of docs: id_col, keep_id, group_size, kept, text_sha256."""
    index = _index(docs, id_col, text_col, options)
    texts = docs.select(F.col(f"`{id_col}`").alias(_ID), normalised(F.col(f"`{text_col}`")).alias(_TEXT)).withColumn(_DIGEST, index.digest(F.col(_TEXT)))
    maybe = index.hit_filter().mark(texts, "__tw_maybe").where("__tw_maybe").drop("__tw_maybe")
    clashing = store(_clashing(maybe), "clashing")
    sha = F.lower(F.hex(_DIGEST)) if index.digest is sha256_digest else F.lit(None).cast("string")
    rows, plain = index.rows(), [_DIGEST, _ID, "__tw_copies", "keep_id", "group_size"]
    if clashing.isEmpty():
        out = rows.join(index.level(), _DIGEST).select(*plain, sha.alias("text_sha256"))
    else:
        out = rows.join(clashing, _DIGEST, "left_anti").join(index.level(), _DIGEST).select(*plain, sha.alias("text_sha256")).unionByName(_split_collisions(maybe, clashing))
    out = out.withColumn("__tw_nth", F.explode(F.sequence(F.lit(1), F.col("__tw_copies"))))
    kept = F.col(_ID).eqNullSafe(F.col("keep_id")) & (F.col("__tw_nth") == 1)
    return out.select(F.col(_ID).alias(id_col), "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the rows that exact_groups drops; all columns stay as they are.

    Rows that the filter of hits rules out have no copy and stay where they are; the others are
    dealt out by digest.
    """
    index = _index(docs, id_col, text_col, options)
    marked = index.hit_filter().mark(docs.withColumn(_DIGEST, index.digested(F.col(f"`{text_col}`"))), "__tw_maybe")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # the same rows in the same types, so that both parts can be read back as one
    maybe = store(marked.where("__tw_maybe").select(_DIGEST, F.struct(*columns).alias(_ROW)), "maybe-copies")
    of = lambda c: F.col(_ROW).getField(c)
    maybe = maybe.withColumn(_TEXT, normalised(of(text_col)))
    keys = [_DIGEST] if _clashing(maybe).isEmpty() else [_DIGEST, _TEXT]
    order = F.struct(of(id_col).isNull(), of(id_col), row_hash([of(c) for c in docs.columns]))
    best = maybe.groupBy(*keys).agg(F.min_by(_ROW, order).alias(_ROW)).select(*[of(c).alias(c) for c in docs.columns])
    return marked.where(~F.col("__tw_maybe")).select(*columns).unionByName(best)
