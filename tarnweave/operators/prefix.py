"""Running sums, maxima and last values along the rows of a key, however many rows it has.

Where a key's rows fit into one task, a window does it. Beyond `KEY_ROWS` rows of one key the rows are dealt out in ranges of (key, order), so that
a key spans as many tasks as it needs: each range is scanned by itself, what its part of a key comes to is carried to the ranges
behind it, and the carry is added. A range has at most two keys that go on in another one, so the table of carries has no more than
two rows a task and is broadcast. Results are the same either way.

Keys and order columns may be null (nulls come first); rows equal in key and order come in any order, so the order should tell them apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

KEY_ROWS = 1 << 22
_FIRST, _ROW = Window.unboundedPreceding, Window.currentRow


class Ordered:
    """rows along `order` for each key of `by`; every method adds a column."""

    def __init__(self, rows: DataFrame, by: list[str], order: list[str], *, key_rows: int = KEY_ROWS, tasks: int | None = None):
        self.by, self.order = by, order
        largest = rows.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
        self.split = largest > key_rows
        if self.split:
            place = [F.col(f"`{c}`") for c in (*by, *order)]
            rows = rows.repartitionByRange(tasks, *place) if tasks else rows.repartitionByRange(*place)
            rows = checkpoint(rows.withColumn("__task", F.spark_partition_id()))
        self._rows = rows
        self.window = Window.partitionBy(*(["__task"] if self.split else []), *by).orderBy(*order)

    @property
    def rows(self) -> DataFrame:
        return self._rows.drop("__task")

    def _carried(self, total: Column, over) -> DataFrame:
        """What the ranges before (or behind) a range give each key that has several: __on, __c."""
        parts = self._rows.groupBy("__task", *self.by).agg(total.alias("__t"))
        key = Window.partitionBy(*self.by) if self.by else Window.partitionBy()
        parts = parts.withColumn("__n", F.count(F.lit(1)).over(key)).where("__n > 1").withColumn("__c", over(key.orderBy("__task")))
        return parts.select(F.struct("__task", *self.by).alias("__on"), "__c").where(F.col("__c").isNotNull())

    def _add(self, name: str, local: Column, total: Column, over, combine) -> Ordered:
        rows = self._rows.withColumn(name, local)
        if self.split:
            # at most two rows a task
            carried = F.broadcast(self._carried(total, over))
            rows = rows.join(carried, F.struct("__task", *self.by).eqNullSafe(F.col("__on")), "left")
            rows = rows.withColumn(name, combine(F.col(name), F.col("__c"))).drop("__on", "__c", "__v")
        self._rows = rows.drop("__v")
        return self

    def _running(self, name: str, value: Column, run, total, over, combine, before: bool) -> Ordered:
        self._rows = self._rows.withColumn("__v", value)
        return self._add(name, run(F.col("__v")).over(self.window.rowsBetween(_FIRST, -1 if before else _ROW)), total, lambda w: over(F.col("__t")).over(w.rowsBetween(_FIRST, -1)), combine)

    def sum(self, name: str, value: Column, before: bool = False) -> Ordered:
        """The sum of the rows so far; before: without the row itself, and 0 for the first."""
        both = lambda a, c: F.coalesce(a, F.lit(0)) + F.coalesce(c, F.lit(0)) if before else F.coalesce(a + c, a, c)
        out = self._running(name, value, F.sum, F.sum("__v"), F.sum, both, before)
        if before:
            out._rows = out._rows.withColumn(name, F.coalesce(name, F.lit(0)))
        return out

    def max(self, name: str, value: Column, before: bool = False) -> Ordered:
        return self._running(name, value, F.max, F.max("__v"), F.max, lambda a, c: F.greatest(a, c), before)

    def last(self, name: str, value: Column, before: bool = False) -> Ordered:
        """The last value so far that is not null."""
        latest = F.max_by("__v", F.when(F.col("__v").isNotNull(), F.struct(*self.order)))
        return self._running(name, value, lambda c: F.last(c, ignorenulls=True), latest, lambda c: F.last(c, ignorenulls=True), lambda a, c: F.coalesce(a, c), before)

    def previous(self, name: str, value: Column) -> Ordered:
        """A struct with the value v of the row before, null or not; null for the first row."""
        return self.last(name, F.struct(value.alias("v")), before=True)

    def next(self, name: str, value: Column) -> Ordered:
        """A struct with the value v of the next row, null or not; null for the last row."""
        self._rows = self._rows.withColumn("__v", F.struct(value.alias("v")))
        return self._add(name, F.lead("__v").over(self.window), F.min_by("__v", F.struct(*self.order)), lambda w: F.lead("__t").over(w), lambda a, c: F.coalesce(a, c))

    def number(self, name: str) -> Ordered:
        """From 1."""
        return self.sum(name, F.lit(1).cast("long"))
