"""The operators of the general problems against brute force, with nulls, repeats, ties and clashing names."""

import json
import random

from pyspark.sql import functions as F

from conftest import rows
from loomdex.functions.numbers import fits
from loomdex.operators.cell_diff import uncancelled
from loomdex.operators.orphans import orphan_references
from loomdex.operators.shred import field_table, rejected, shred, struct_table
from loomdex.operators.wide import attributes, widen
from loomdex.plans.index_diff import field_differences


def test_uncancelled_keeps_nulls_and_counts_repeats_once(spark):
    a = spark.createDataFrame([(1, "x", None), (1, "x", None), (2, None, "v"), (3, "z", "1")], "k int, f string, v string")
    b = spark.createDataFrame([(1, "x", None), (3, "z", "2"), (3, "z", "2")], "k int, f string, v string")
    assert rows(uncancelled(a, b, ["k", "f", "v"])) == sorted([(2, None, "v", 1), (3, "z", "1", 1), (3, "z", "2", 2)], key=repr)
    assert uncancelled(a.limit(0), b.limit(0), ["k", "f", "v"]).count() == 0


def test_field_differences(spark):
    schema = "file_id long, path string, type string, value string, side string"
    left = [(1, "a", "INT", "5", ""), (1, "b", "int", "007", ""), (1, "c", "int", "x", ""), (1, "d", "float", "1e1", ""), (1, "e", "int", None, ""), (1, "l", "int", "1", ""),
            (9, "lonely", "int", "1", ""), (1, "h", "byte", "300", ""), (1, "i", "int64", "9007199254740993", "")]
    right = [(51, "a", "int", "5", ""), (51, "b", "int", " 7 ", ""), (51, "c", "int", "y", ""), (51, "d", "int", "10", ""), (51, "e", "int", "", ""), (51, "r", "int", "1", ""),
             (51, "r", "int", "1", ""), (51, "h", "byte", "0300", ""), (51, "i", "int64", "9007199254740992", "")]
    pairs = spark.createDataFrame([(1, 51)], "left_id long, right_id long")
    got = rows(field_differences(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), pairs))
    want = [(1, "c", "value", "differs"), (1, "d", "type", "differs"), (1, "e", "value", "differs"), (1, "l", "", "left_only"), (1, "r", "", "right_only"),
            (1, "h", "value", "differs"), (1, "i", "value", "differs")]
    assert got == sorted(want, key=repr)


def test_fits(spark):
    yes = [("byte", "0"), ("byte", "255"), ("byte", "-0"), ("byte", "007"), ("char", "-128"), ("word", " 65535 "), ("int", "-2147483648"), ("dword64", "18446744073709551615"),
           ("int64", "-9223372036854775808"), ("float", "-1.5e3"), ("float", "3"), ("double", "1E-2"), ("int", "0" * 50 + "1")]
    no = [("byte", "256"), ("byte", "-1"), ("char", "128"), ("word", "65536"), ("int", "2147483648"), ("dword64", "18446744073709551616"), ("int64", "9223372036854775808"),
          ("int", "1.0"), ("int", "+1"), ("int", "1 000"), ("float", "inf"), ("float", "nan"), ("float", "1e"), ("float", "1,5"), ("resref", "1"), ("int", None), ("int", "")]
    df = spark.createDataFrame([(*x, True) for x in yes] + [(*x, False) for x in no], "k string, v string, want boolean")
    assert df.where(fits(F.col("k"), F.col("v")) != F.col("want")).collect() == []


def test_widen_against_brute_force(spark):
    rng = random.Random(1)
    labels = [("Cost", "dword"), ("COST", "int"), ("Name", "cexostring"), ("Weight", "float"), ("misfits", "resref"), ("Big", "dword64")]
    data = []
    for e in range(300):
        for label, kind in rng.sample(labels, rng.randint(1, 6)):
            value = rng.choice(["1", " 2 ", "x", "", None, "3.5", "-7", "99999999999"])
            data += [(e, label, kind, value, "clash")] * rng.randint(1, 3)
    data += [(None, "Cost", "dword", "1", ""), (5, None, "int", "1", "")] + [(7, "Cost", "dword", "1", "")] * 5000
    df = spark.createDataFrame(data, "file_id long, label string, type string, value string, rest string")
    wide = widen(df, attributes(df, reserved=("file_id", "misfits", "rest")))
    assert wide.columns == ["file_id", "Big", "Cost", "misfits_", "Name", "Weight", "misfits", "rest"]
    got = {r["file_id"]: r for r in wide.collect()}
    assert set(got) == {d[0] for d in data if d[0] is not None and d[1]}

    def fit(kind, v):
        if v is None:
            return False
        v = v.strip()
        if kind == "float":
            return v in ("1", "2", "3.5", "-7", "99999999999")
        low, high = {"dword": (0, 2**32 - 1), "int": (-(2**31), 2**31 - 1), "dword64": (0, 2**64 - 1)}[kind]
        return v.lstrip("-").isdigit() and low <= int(v) <= high

    for e in range(300):
        own = {d[1:4] for d in data if d[0] == e and d[1]}
        bad = {label for label, kind, v in own if kind in ("dword", "int", "float", "dword64") and v and v.strip() and not fit(kind, v)}
        assert set(got[e]["misfits"] or []) == bad, e
        names = {v for label, kind, v in own if label == "Name"}
        assert got[e]["Name"] is None or got[e]["Name"] in names
        whole = {int(v) for label, kind, v in own if label.lower() == "cost" and fit(kind, v)}
        assert (got[e]["Cost"] in whole) if whole else got[e]["Cost"] is None
    assert widen(df.limit(0), []).count() == 0


def test_widen_keeps_the_value_that_fits_of_two_spellings(spark):
    df = spark.createDataFrame(
        [(1, "Name", "cexostring", "x"), (1, "NAME", "cexostring", None), (2, "NAME", "cexostring", "b"), (2, "name", "cexostring", "a"), (3, "Cost", "int", "z"), (3, "COST", "int", "5"), (3, "cost", "int", "y")],
        "file_id long, label string, type string, value string",
    )
    got = {r["file_id"]: r.asDict() for r in widen(df, attributes(df)).collect()}
    assert (got[1]["NAME"], got[2]["NAME"], got[3]["COST"], got[3]["misfits"]) == ("x", "a", 5, ["Cost", "cost"])


def test_wide_tables_hold_every_attribute_typed(spark, monkeypatch):
    from loomdex.operators import wide

    monkeypatch.setattr(wide, "BLOCK_AREA", 30)
    data = [(e, f"a{i:03}", "int", str(e * i)) for e in range(40) for i in range(25) if (e + i) % 3]
    df = spark.createDataFrame(data, "file_id long, label string, type string, value string")
    tables = wide.wide_tables(df, attributes(df), columns=10)
    assert [len(t.columns) - 3 for t in tables] == [10, 10, 5] and all(kind == "bigint" for t in tables for c, kind in t.dtypes if c[0] == "a")
    got = {(r["file_id"], c): str(r[c]) for t in tables for r in t.collect() for c in t.columns if c[0] == "a" and r[c] is not None}
    assert got == {(e, c): v for e, c, _, v in data}
    assert {(r["file_id"], c): str(r[c]) for r in widen(df, attributes(df)).collect() for c in r.asDict() if c[0] == "a" and r[c] is not None} == got


def test_widen_keeps_attributes_beyond_the_dictionary(spark):
    df = spark.createDataFrame([(1, "A", "int", "1"), (1, "B", "int", "2")], "file_id long, label string, type string, value string")
    only = [a for a in attributes(df) if a.fold == "a"]
    assert [r.asDict() for r in widen(df, only).collect()] == [{"file_id": 1, "A": 1, "misfits": [], "rest": {"b": "2"}}]


def walk(node, path=""):
    """Brute force: (path, parent) of all structs and (path, parent, label, type, value) of all leaves."""
    structs, leaves = [], []
    for label, f in node.items():
        if label.startswith("__") or not isinstance(f, dict) or "type" not in f:
            continue
        at, v = (f"{path}/{label}" if path else label), f.get("value")
        if f["type"] in ("struct", "list"):
            many = f["type"] == "list"
            items = [v] if isinstance(v, dict) else v if many and isinstance(v, list) else []
            for i, x in enumerate(items):
                if isinstance(x, dict):
                    p = f"{at}[{i}]" if many else at
                    structs.append((p, path))
                    a, b = walk(x, p)
                    structs += a
                    leaves += b
        else:
            leaves.append((at, path, label, f["type"], v if isinstance(v, str) else None if v is None else json.dumps(v, ensure_ascii=False, sort_keys=True)))
    return structs, leaves


def tree(rng, depth=0):
    out = {"__struct_id": 1} if rng.random() < 0.5 else {}
    for label in rng.sample(["A", "B", "C D", "Ü", "E"], rng.randint(0, 4)):
        kind = rng.choice(["int", "text", "struct", "list", "list", "cexolocstring"]) if depth < 8 else "int"
        if kind == "struct":
            v = tree(rng, depth + 1) if rng.random() < 0.9 else None
        elif kind == "list":
            v = rng.choice([None, tree(rng, depth + 1), [tree(rng, depth + 1) if rng.random() < 0.95 else 3 for _ in range(rng.randint(0, 3))]])
        else:
            v = {"int": rng.choice([1, None]), "text": rng.choice(["x", "", "ü"]), "cexolocstring": {"0": "t", "4": "u"}}[kind]
        out[label] = {"type": kind, "value": v}
    return out


def test_shred_rebuilds_what_a_walk_finds(spark):
    rng = random.Random(2)
    bodies = [(i, json.dumps(tree(rng), indent=rng.choice([None, 1]))) for i in range(200)]
    bodies = [(i, rng.choice(["", "\ufeff", "\n  "]) + b + rng.choice(["", "\n"])) for i, b in bodies]
    damaged = [(1000, None), (1001, ""), (1002, '{"a": {"type": "int", "val'), (1003, "[1]"), (1004, '{"a": NaN}'), (1005, "[" * 200_000), (1006, " ")]
    deep = "{}"
    for _ in range(150):
        deep = '{"L": {"type": "list", "value": [' + deep + "]}}"
    df = spark.createDataFrame(bodies + damaged + [(2000, deep)], "file_id long, body string").withColumn("record", F.lit("clash"))
    levels = shred(df, "file_id", "body").cache()
    want_s, want_f = [], []
    for i, b in [*bodies, (2000, deep)]:
        s, f = walk(json.loads(b.strip().strip("\ufeff").strip()))
        want_s += [(i, *x) for x in s]
        want_f += [(i, *x) for x in f]
    assert rows(struct_table(levels)) == sorted(want_s, key=repr)
    assert rows(field_table(levels)) == sorted(want_f, key=repr)
    assert dict(rows(rejected(df, "file_id", "body"))) == {1000: "null", 1001: "empty", 1002: "not_json", 1003: "not_object", 1004: "not_json", 1005: "not_json", 1006: "empty"}


def test_shred_bodies_deeper_than_python_frames(spark):
    body = '{"Leaf": {"type": "int", "value": 7}}'
    for _ in range(1200):
        body = '{"S": {"type": "struct", "value": ' + body + "}}"
    leaf = '{"L": {"type": "any", "value": ' + "[" * 3000 + "]" * 3000 + "}}"
    df = spark.createDataFrame([(1, body), (2, leaf)], "file_id long, body string")
    levels = shred(df, "file_id", "body")
    assert {r["path"].count("/") for r in struct_table(levels).where("record = 1").collect()} == set(range(1200))
    assert [(r["label"], r["value"]) for r in field_table(levels).where("record = 1").collect()] == [("Leaf", "7")]
    shown = {r["record"] for r in levels.select("record").distinct().collect()}
    gone = {r["record"] for r in rejected(df, "file_id", "body").collect()}
    assert shown | gone == {1, 2} and not shown & gone


def test_orphans_against_brute_force(spark):
    import datetime as dt

    rng = random.Random(3)
    day = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(days=rng.randint(0, 200)) if rng.random() < 0.95 else None
    refs = [(i, rng.choice([f"k{rng.randint(0, 80)}", "hot", None]), day()) for i in range(2000)]
    parents = [(f"k{rng.randint(0, 60)}", rng.random() < 0.3, day()) for _ in range(60)] + [("k0", None, None)]
    got = rows(orphan_references(
        spark.createDataFrame(refs, "id long, key string, at timestamp").withColumn("removed", F.lit(1)),
        spark.createDataFrame(parents, "key string, removed boolean, since timestamp"), ["key"], "at").select("id", "state", "period"))
    want = []
    for i, k, at in refs:
        if k is None:
            continue
        own = [p for p in parents if p[0] == k]
        live = [p for p in own if not p[1]]
        state = "missing" if not own else "deleted" if not live else None
        if live and at is not None and all(p[2] is not None for p in live) and min(p[2] for p in live) > at:
            state = "late"
        if state:
            want.append((i, state, at and at.strftime("%Y-%m")))
    assert got == sorted(want, key=repr)
    assert {s for _, s, _ in want} == {"missing", "deleted", "late"}
