"""Trace records like a plain walk over them."""

import json
import random

import pytest

from tarnweave.operators import records as O
from tarnweave.sources import readers

COLUMNS = [c.split(" ")[0] for c in O.RECORD.split(", ")]
WAYS = [{}, {"key_rows": 0, "tasks": 6}]


def mixed(n, seed):
    r = random.Random(seed)
    ids = lambda: r.choice([None, r.randrange(12), r.randrange(100)])
    value = lambda: r.choice([None, "undefined:", "object:%d" % r.randrange(40), "propNameID:%d" % r.randrange(20), "number:0x1", "plain", "object:x"])
    out = []
    for i in range(n):
        kind = r.choice([*O.NAMED_HOST, *O.NAMED_STRING, *O.NAMED_NATIVE, O.NAME_RECORD, "CallRecord", "ReturnRecord", None])
        rec = dict.fromkeys(COLUMNS) | {"trace": r.choice([1, 1, 1, 2, None]), "ord": i, "type": kind, "objID": ids(), "functionID": ids(), "propName": r.choice([None, "a", "b"]), "functionName": r.choice([None, "f"]), "chars": r.choice([None, "x", "y"]) if kind == O.NAME_RECORD else None}
        rec |= {"value": value(), "retval": value(), "thisArg": value(), "args": r.choice([None, [], [value() for _ in range(r.randrange(5))]]), "properties": r.choice([None, [value() for _ in range(2)]])}
        out.append(rec)
    return out


def texts(recs, seed):
    """Some values are strings, with their texts."""
    r = random.Random(seed)
    turn = lambda v: r.choice(["string:t:%d" % r.randrange(9), "string:", v])
    return [x | {c: turn(x[c]) for c in O.VALUE_KEYS} | {c: x[c] and [turn(v) for v in x[c]] for c in O.LIST_KEYS} for x in recs]


def number(v, *kinds):
    kind, _, rest = (v or "").partition(":")
    return int(rest) if kind in kinds and rest.isdigit() else None


def walk_upgrade(recs):
    out = []
    for trace in {x["trace"] for x in recs}:
        own = sorted((x for x in recs if x["trace"] == trace), key=lambda x: x["ord"])
        held = [i for x in own for i in [*(x[c] for c in O.ID_KEYS), *(number(v, "object") for v in [*(x[c] for c in O.VALUE_KEYS), *(v for c in O.LIST_KEYS for v in x[c] or [])])] if i is not None]
        free, new = max([0, *held]) + 1, []

        def make(kind, chars):
            nonlocal free
            new.append(dict.fromkeys(COLUMNS) | {"trace": trace, "type": kind, "objID": free, "encoding": "UTF-8", "chars": chars or ""})
            free += 1
            return free - 1

        def turned(v):
            return f"string:{make(O.STRING_RECORD, v[7:])}" if v and v.startswith("string:") else v

        for x in own:
            x = dict(x)
            if x["type"] in O.NAMED_HOST:
                x["propNameID"] = make(O.NAME_RECORD, x["functionName"])
            elif x["type"] in O.NAMED_STRING:
                x["propID"] = make(O.STRING_RECORD, x["propName"])
            elif x["type"] in O.NAMED_NATIVE:
                x["propNameID"] = make(O.NAME_RECORD, x["propName"])
            for c in O.VALUE_KEYS:
                x[c] = turned(x[c])
            for c in O.LIST_KEYS:
                x[c] = x[c] and [turned(v) for v in x[c]]
            new.append(x)
        out += [x | {"ord": i} for i, x in enumerate(new)]
    return out


def walk_normalise(recs, whole):
    out = []
    for trace in {x["trace"] for x in recs}:
        normal, by_text = {whole[trace]: 0} if whole.get(trace) is not None else {}, {}
        count = 0

        def of(i):
            nonlocal count
            if i not in normal:
                count += 1
                normal[i] = count
            return normal[i]

        def value(v):
            i = number(v, "object", "propNameID", "string")
            return v if i is None else f"{v.split(':')[0]}:{of(i)}"

        for x in sorted((x for x in recs if x["trace"] == trace), key=lambda x: x["ord"]):
            x = dict(x)
            if x["type"] == O.NAME_RECORD:
                if x["objID"] is not None:
                    if x["objID"] not in normal and x["chars"] is not None:
                        if x["chars"] in by_text:
                            normal[x["objID"]] = by_text[x["chars"]]
                        else:
                            by_text[x["chars"]] = of(x["objID"])
                    x["objID"] = of(x["objID"])
            else:
                for c in O.ID_KEYS:
                    x[c] = x[c] if x[c] is None else of(x[c])
            for c in O.VALUE_KEYS:
                x[c] = value(x[c])
            x["args"] = x["args"] and [value(v) for v in x["args"]]
            x["thisArg"] = value(x["thisArg"])
            out.append(x)
    return out


def rows(recs):
    return sorted((tuple(str(x[c]) for c in COLUMNS) for x in recs))


def table(spark, recs):
    return spark.createDataFrame([tuple(x[c] for c in COLUMNS) for x in recs], O.RECORD).repartition(3)


@pytest.mark.parametrize("options", WAYS)
def test_upgrade_like_a_walk(spark, options):
    recs = texts(mixed(200, 1), 2)
    assert rows(r.asDict() for r in O.upgrade(table(spark, recs), **options).collect()) == rows(walk_upgrade(recs))


@pytest.mark.parametrize("options", WAYS)
def test_normalise_like_a_walk(spark, options):
    recs, whole = mixed(250, 3), {1: 5, 2: None, None: 7}
    got = O.normalise(table(spark, recs), spark.createDataFrame(list(whole.items()), "trace long, globalObjID long"), **options)
    assert rows(r.asDict() for r in got.collect()) == rows(walk_normalise(recs, whole))


def test_files_from_end_to_end(spark, tmp_path):
    trace = [{"type": "CreateHostFunctionRecord", "objID": 3, "functionName": "go"}, {"type": "SetPropertyRecord", "objID": 3, "propName": "p", "value": "string:a b"}, {"type": "CallRecord", "functionID": 3, "args": ["string:x", "object:9"], "other": 1}]
    (tmp_path / "t.json").write_text(json.dumps({"version": 2, "globalObjID": 9, "trace": trace}))
    recs, whole = readers.trace_records(spark, str(tmp_path))
    new = O.upgrade(recs).orderBy("ord").collect()
    assert [(r["type"], r["objID"], r["chars"]) for r in new[:3]] == [(O.NAME_RECORD, 10, "go"), ("CreateHostFunctionRecord", 3, None), (O.STRING_RECORD, 11, "p")]
    assert [(r["value"], r["args"]) for r in new[3:]] == [(None, None), ("string:12", None), (None, None), (None, ["string:13", "object:9"])] and new[4]["propID"] == 11 and new[1]["propNameID"] == 10
    dense = O.normalise(O.upgrade(recs), whole).orderBy("ord").collect()
    assert [r["objID"] for r in dense[:3]] == [1, 2, 3] and dense[-1]["args"] == ["string:5", "object:0"]
    assert O.upgrade(recs.where("false")).count() == 0 and O.normalise(recs.where("false"), whole).count() == 0
