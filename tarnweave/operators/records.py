"""Trace records: one record gives several, with fresh ids, and ids are made dense by first sight, inside values and lists too.

A record has the columns of RECORD; trace and ord tell its place. A value is a text `kind:rest`; of an object, a property name and a string
the rest is an id (in version 2 a string's rest is the text itself). Places and ids count over whole traces, of any length: records
are counted range by range (prefix.Ordered), so no trace is held in one task.

Edge cases: null columns are keys that a record lacks; a null list has no entries, a null entry of a list stays null; an empty table gives
an empty one; records of one trace must differ in ord. An id that is no whole number counts as none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint
from .prefix import Ordered

#: Ids of all traces that are held by each task; more of them are joined.
TABLE_IDS = 1 << 16

#: Keys that hold an id, in the order in which they are read; keys that hold a value; lists of values.
ID_KEYS = ("objID", "functionID", "hostObjectID", "propNamesID", "propID", "propNameID")
VALUE_KEYS = ("value", "retval")
LIST_KEYS = ("args", "properties")
#: Record types whose property name becomes a record of its own.
NAMED_HOST = ("CreateHostFunctionRecord",)
NAMED_STRING = ("GetPropertyRecord", "SetPropertyRecord", "HasPropertyRecord")
NAMED_NATIVE = ("GetPropertyNativeRecord", "SetPropertyNativeRecord")
STRING_RECORD, NAME_RECORD = "CreateStringRecord", "CreatePropNameIDRecord"

RECORD = "trace long, ord long, type string, objID long, functionID long, hostObjectID long, propNamesID long, propID long, propNameID long, propName string, functionName string, encoding string, chars string, value string, retval string, thisArg string, args array<string>, properties array<string>"
_NEWS = "array<struct<type:string,chars:string>>"


def _kind(v: Column, *kinds: str) -> Column:
    """Whether a value is of one of these kinds; not null."""
    test = F.lit(False)
    for k in kinds:
        test = test | F.startswith(v, F.lit(k + ":"))
    return F.coalesce(test, F.lit(False))


def _rest(v: Column) -> Column:
    return F.substr(v, F.instr(v, ":") + 1)


def _id_of(v: Column, *kinds: str) -> Column:
    return F.when(_kind(v, *kinds), _rest(v).try_cast("long"))


def _largest_id() -> Column:
    held = [F.transform(F.array(*[F.col(c) for c in VALUE_KEYS]), lambda v: _id_of(v, "object"))]
    held += [F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda v: _id_of(v, "object")) for c in LIST_KEYS]
    return F.array_max(F.concat(F.array(*ID_KEYS), *held))


def upgrade(records: DataFrame, **options) -> DataFrame:
    """Records of version 2 in version 3: names and texts of strings become records of their own, which stand before the record that
    uses them and have ids above all of the trace; the texts give way to these ids. ord counts the new records of a trace from 0."""
    new = lambda kind, chars: F.struct(F.lit(kind).alias("type"), F.coalesce(chars, F.lit("")).alias("chars"))
    host, native, plain = (F.coalesce(F.col("type").isin(*t), F.lit(False)) for t in (NAMED_HOST, NAMED_NATIVE, NAMED_STRING))
    none = F.array().cast(_NEWS)
    named = F.when(host, F.array(new(NAME_RECORD, F.col("functionName")))).when(plain, F.array(new(STRING_RECORD, F.col("propName")))).when(native, F.array(new(NAME_RECORD, F.col("propName")))).otherwise(none)
    texts = lambda values: F.transform(F.filter(values, lambda v: _kind(v, "string")), lambda v: new(STRING_RECORD, _rest(v)))
    entries = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    rows = records.withColumn("__named", named)
    for c in VALUE_KEYS:
        rows = rows.withColumn(f"__{c}", texts(F.array(c)))
    for c in LIST_KEYS:
        rows = rows.withColumn(f"__{c}", texts(entries(c)))
    groups = ["__named", *[f"__{c}" for c in (*VALUE_KEYS, *LIST_KEYS)]]
    rows = rows.withColumn("__news", F.concat(*groups)).withColumn("__n", F.size("__news").cast("long"))
    o = Ordered(rows, ["trace"], ["ord"], **options).sum("__before", F.col("__n"), before=True).number("__nth")
    largest = records.groupBy("trace").agg(F.coalesce(F.max(_largest_id()), F.lit(0).cast("long")).alias("__most"))
    largest = largest.withColumn("__most", F.greatest("__most", F.lit(0)))
    rows = o.rows.join(largest.withColumnRenamed("trace", "__trace"), F.col("trace").eqNullSafe(F.col("__trace"))).drop("__trace")
    rows = rows.withColumn("__id", F.col("__most") + 1 + F.col("__before")).withColumn("__place", F.col("__before") + F.col("__nth") - 1)
    # where each group's ids begin
    begin = F.col("__id")
    for g in groups:
        rows = rows.withColumn(f"{g}_at", begin)
        begin = F.col(f"{g}_at") + F.size(g)
    renewed = {c: F.when(_kind(F.col(c), "string"), F.concat(F.lit("string:"), F.col(f"__{c}_at").cast("string"))).otherwise(F.col(c)) for c in VALUE_KEYS}

    def relisted(c: str) -> Column:
        def entry(v, i):
            earlier = F.size(F.filter(F.slice(F.col(c), F.lit(1), i), lambda x: _kind(x, "string")))
            return F.when(_kind(v, "string"), F.concat(F.lit("string:"), (F.col(f"__{c}_at") + earlier).cast("string"))).otherwise(v)

        return F.transform(F.col(c), entry)

    renewed |= {c: relisted(c) for c in LIST_KEYS}
    renewed["propID"] = F.when(plain, F.col("__named_at")).otherwise(F.col("propID"))
    renewed["propNameID"] = F.when(host | native, F.col("__named_at")).otherwise(F.col("propNameID"))
    own = rows.select(*[renewed.get(c, F.col(c)).alias(c) if c != "ord" else (F.col("__place") + F.col("__n")).alias("ord") for c in records.columns])
    made = rows.select("trace", "__place", "__id", F.posexplode("__news").alias("__k", "__new"))
    fresh = {"trace": F.col("trace"), "ord": F.col("__place") + F.col("__k"), "type": F.col("__new.type"), "objID": F.col("__id") + F.col("__k"), "encoding": F.lit("UTF-8"), "chars": F.col("__new.chars")}
    return own.unionByName(made.select(*[(fresh[c] if c in fresh else F.lit(None)).cast(records.schema[c].dataType).alias(c) for c in records.columns]))


def _mentions() -> Column:
    """All ids of a record in the order in which they are read: id, and of a record that makes a property name its text."""
    makes = F.coalesce(F.col("type") == NAME_RECORD, F.lit(False))
    item = lambda i, chars=None: F.struct(i.cast("long").alias("id"), (F.lit(None) if chars is None else chars).cast("string").alias("chars"), F.lit(chars is not None).alias("makes"))
    kinds = ("object", "propNameID", "string")
    keys = F.when(makes, F.array(item(F.col("objID"), F.col("chars")))).otherwise(F.array(*[item(F.col(c)) for c in ID_KEYS]))
    values = F.concat(F.array(*VALUE_KEYS), F.coalesce(F.col("args"), F.array().cast("array<string>")), F.array("thisArg"))
    return F.filter(F.concat(keys, F.transform(values, lambda v: item(_id_of(v, *kinds)))), lambda x: x["id"].isNotNull())


def normalise(records: DataFrame, whole: DataFrame, **options) -> DataFrame:
    """Records with the ids of a trace made dense: 0 for the global object (whole: trace, globalObjID), then 1, 2 ... by first
    sight. Property names made with the same text share the id of the first, unless they were seen before they were made."""
    seen = records.select("trace", "ord", F.posexplode(_mentions()).alias("__k", "__x")).select("trace", "ord", "__k", "__x.*")
    # the least place of each kind of mention first, by hash, so that only few are sorted; stored, as numbers and leaders both come from it
    least = seen.groupBy("trace", "id", "__k", "makes", "chars").agg(F.min("ord").alias("ord"))
    first = checkpoint(least.groupBy("trace", "id").agg(F.min(F.struct("ord", "__k", "makes", "chars")).alias("f")).select("trace", "id", "f.*"))
    first = first.join(whole.select(F.col("trace").alias("__t"), "globalObjID"), F.col("trace").eqNullSafe(F.col("__t")), "left").drop("__t")
    others = first.where(~F.col("id").eqNullSafe(F.col("globalObjID"))).drop("globalObjID")
    # one leader for each text that made a name first; every other id leads itself. A text may be made very often: no window by text
    made = F.col("makes") & F.col("chars").isNotNull()
    by_text = others.where(made).groupBy("trace", "chars").agg(F.min_by("id", F.struct("ord", "__k")).alias("leader")).select(F.col("trace").alias("__t"), F.col("chars").alias("__c"), "leader")
    led = others.join(by_text, F.col("trace").eqNullSafe(F.col("__t")) & made & (F.col("chars") == F.col("__c")), "left").withColumn("leader", F.coalesce("leader", "id")).drop("__t", "__c")
    numbers = Ordered(led.where("leader = id").select("trace", "ord", "__k", F.col("id").alias("leader")), ["trace"], ["ord", "__k"], **options).number("normal").rows
    numbers = numbers.select(F.col("trace").alias("__t"), F.col("leader").alias("__l"), "normal")
    led = led.join(numbers, F.col("trace").eqNullSafe(F.col("__t")) & (F.col("leader") == F.col("__l"))).select("trace", "id", "normal")
    zero = whole.where("globalObjID is not null").select("trace", F.col("globalObjID").alias("id"), F.lit(0).cast("long").alias("normal"))
    table = checkpoint(led.unionByName(zero).select(F.col("trace").alias("__t"), F.col("id").alias("__i"), "normal"))
    if table.count() <= TABLE_IDS:
        table = F.broadcast(table)
    # each record gets the ids it mentions, as a map of its own
    held = seen.select("trace", "ord", "id").join(table, F.col("trace").eqNullSafe(F.col("__t")) & (F.col("id") == F.col("__i")))
    maps = held.groupBy("trace", "ord").agg(F.map_from_entries(F.collect_set(F.struct("id", "normal"))).alias("__map")).select(F.col("trace").alias("__t"), F.col("ord").alias("__o"), "__map")
    rows = records.join(maps, F.col("trace").eqNullSafe(F.col("__t")) & F.col("ord").eqNullSafe(F.col("__o")), "left").drop("__t", "__o")
    of = lambda i: F.try_element_at("__map", i)

    def value(v: Column) -> Column:
        i = _id_of(v, "object", "propNameID", "string")
        return F.when(i.isNotNull(), F.concat(F.substring_index(v, ":", 1), F.lit(":"), of(i).cast("string"))).otherwise(v)

    makes = F.coalesce(F.col("type") == NAME_RECORD, F.lit(False))
    renewed = {c: of(F.col(c)) if c == "objID" else F.when(makes, F.col(c)).otherwise(of(F.col(c))) for c in ID_KEYS}
    renewed |= {c: value(F.col(c)) for c in (*VALUE_KEYS, "thisArg")} | {"args": F.transform("args", value)}
    return rows.select(*[renewed.get(c, F.col(c)).alias(c) for c in records.columns])
