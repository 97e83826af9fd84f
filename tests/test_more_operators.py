import random

from pyspark.sql import functions as F

from conftest import rows
from loomdex.operators import changes, scripts, spatial, tables

SOURCE = '''// Gives a reward.
/* second
 line */
#include "inc_Common"
int Helper(object o, string s = "x, (y)") { return GetLocalInt(o, s); }
void Proto(int n);
void main()
{
    // SetLocalInt(o, "not this", 1);
    SetLocalInt(OBJECT_SELF, "quest" + IntToString(3), 1); DelayCommand(1.0, ExecuteScript("scr_a", GetTag("b\\"c")));
    string s = "lone";
}
'''


def test_lexer():
    assert list(scripts.literals(SOURCE)) == [(5, "Helper", 1, "x, (y)", False), (10, "SetLocalInt", 1, "quest", True), (10, "ExecuteScript", 0, "scr_a", False), (10, "GetTag", 0, 'b\\"c', False), (11, None, 0, "lone", False)]
    main, lines, includes, functions, calls, digest, header = scripts.facts(SOURCE)
    assert main and lines == 13 and includes == ["inc_common"] and functions == ["Helper", "main"] and header == "Gives a reward.\nsecond\n line"
    assert dict(calls)["GetLocalInt"] == 1 and "Proto" not in functions
    assert digest == scripts.facts(SOURCE.replace("    ", "\t").replace("// Gives a reward.", ""))[5]
    assert list(scripts.literals('"' + '\\"' * 40_000)) != [] and list(scripts.literals("/* never closed")) == []


def test_script_operators(spark):
    d = spark.createDataFrame([(1, SOURCE), (2, None), (3, "")], "id long, text string")
    assert scripts.script_literals(d, "id", "text").count() == 5
    assert {r["script"]: r["has_main"] for r in scripts.script_facts(d, "id", "text").collect()} == {1: True, 3: False}
    load = scripts.include_load(spark.createDataFrame([("a", 1), ("b", 10), ("c", 100)], "script string, n long"), spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "b")], "src string, dst string"))
    assert dict(rows(load)) == {"a": 111, "b": 110, "c": 110}


def test_spatial(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    df = spark.createDataFrame([(1, 1.0, 1.0, square), (2, 5.0, 1.0, square), (3, 1.0, 1.0, square[:2]), (4, None, 1.0, square), (5, 1.0, 1.0, None), (6, 1.0, 1.0, [])], "id int, x double, y double, p array<struct<x:double,y:double>>")
    assert rows(df.select("id", spatial.inside(F.col("x"), F.col("y"), F.col("p")))) == [(1, True), (2, False), (3, False), (4, None), (5, None), (6, False)]
    rng = random.Random(1)
    star = [(0.0, 0.0), (9.0, 1.0), (3.0, 3.0), (8.0, 8.0), (1.0, 5.0)]
    pts = [(i, rng.uniform(-1, 10), rng.uniform(-1, 10)) for i in range(200)]

    def brute(x, y):
        odd = False
        for (ax, ay), (bx, by) in zip(star, star[1:] + star[:1], strict=True):
            if (ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax):
                odd = not odd
        return odd

    poly = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in star])
    got = dict(rows(spark.createDataFrame(pts, "id int, x double, y double").select("id", spatial.inside(F.col("x"), F.col("y"), poly))))
    assert got == {i: brute(x, y) for i, x, y in pts}
    b = spark.createDataFrame([(1, 0.5, 5.0), (2, 9.5, 9.5), (3, 5.0, 5.0), (4, 5.0, 0.1)], "id int, x double, y double")
    assert dict(rows(b.select("id", spatial.border_side(F.col("x"), F.col("y"), F.lit(10.0), F.lit(10.0), 1.0)))) == {1: "west", 2: "east", 3: None, 4: "south"}
    near = spatial.nearest(spark.createDataFrame([("a", 1, 0.0, 0.0), ("b", 2, 0.0, 0.0)], "g string, id int, x double, y double"), spark.createDataFrame([("a", 7, 3.0, 4.0), ("a", 6, 3.0, 4.0), ("a", 5, 9.0, 9.0)], "g string, oid int, x double, y double"), ["g"], "id", "oid")
    assert rows(near) == [("a", 1, 6, 5.0)]


def test_tables(spark):
    c = [("t", "hak", 1, r, str(r), col, v) for r, col, v in [(0, "A", "1"), (0, "B", None), (1, "A", "2"), (1, "B", "x")]]
    c += [("t", "mod", 2, r, str(r), col, v) for r, col, v in [(0, "a", "1"), (0, "b", None), (1, "a", "3"), (1, "b", "x"), (2, "a", "9"), (2, "b", None)]]
    c += [("t", "old", 3, r, str(r), col, v) for r, col, v in [(0, "A", "1"), (0, "B", None), (1, "A", "2"), (1, "B", "x")]] + [("u", "hak", 1, 0, "5", "A", "q")]
    df = spark.createDataFrame(c, "name string, source string, rank int, row long, label string, col string, value string")
    got = {r["source"]: (r["winner"], r["missing_rows"], r["changed"], r["added_rows"], r["kind"]) for r in tables.conflicts(df).collect()}
    assert got == {"mod": ("hak", 1, 1, 0, "stale"), "old": ("hak", 0, 0, 0, "duplicate")}
    assert rows(tables.label_drift(df)) == [("u", 0, "5")]
    assert rows(tables.wide(df.where("source = 'hak'"), "t", ["a", "B"]).select("row", "a", "B")) == [(0, "1", None), (1, "2", "x")]
    assert rows(tables.dangling(df, "A", spark.createDataFrame([(1,), (2,), (3,)], "id int"), "id")) == [("t", 2, "9"), ("u", 0, "q")]
    assert tables.label_drift(tables.renumbered(df)).count() == 0


def test_changes(spark):
    state = spark.createDataFrame([("a", "1"), ("b", None), ("c", "3")], "node string, v string")
    sheet = spark.createDataFrame([("a", "2"), ("b", " x "), ("c", "3"), ("d", "1"), ("a", "2"), ("b", ""), ("e", None)], "node string, v string")
    plan = changes.plan_values(state, sheet, ["node"], "v")
    assert {(r["node"], r["verdict"]) for r in plan.collect()} == {("a", "set"), ("b", "twice"), ("c", "same"), ("d", "unknown"), ("e", "unknown")}
    assert rows(changes.apply_values(state, plan, ["node"], "v")) == [("a", "2"), ("b", None), ("c", "3")]
    d = changes.plan_deletions(spark.createDataFrame([("a", "Safe"), ("b", "Review"), ("c", "Safe as group")], "node string, status string"), spark.createDataFrame([("a", "Yes"), ("b", "y"), ("c", ""), ("d", "1"), ("e", "perhaps")], "node string, delete string"))
    assert {r["node"]: r["verdict"] for r in d.collect()} == {"a": "delete", "b": "refused", "c": "keep", "d": "unknown", "e": "unclear"}
