"""Operators on places, holders, groups and patterns against brute force; writers and readers there and back."""

import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import rows
from loomdex.operators import duplicates, graph, spatial, text
from loomdex.sources import formats, readers, writers


def test_nearest_against_brute_force(spark):
    rng = random.Random(1)
    points = [(rng.randint(0, 3), f"p{i}", rng.choice([rng.uniform(0, 50), rng.uniform(-900, 900)]), rng.uniform(0, 50)) for i in range(80)]
    others = [(rng.randint(0, 2), f"o{i}", rng.uniform(0, 50), rng.uniform(0, 50)) for i in range(60)] + [(0, "far", 5000.0, 5000.0), (1, "none", None, 1.0)]
    others += [(g, n + "x", x, y) for g, n, x, y in others[:5]]  # ties: the least id
    points += [points[0], (0, "null", None, 1.0)]
    p, o = spark.createDataFrame(points, "g int, id string, x double, y double"), spark.createDataFrame(others, "g int, oid string, x double, y double")
    got = {(r["g"], r["id"]): (r["other"], round(r["distance"], 6)) for r in spatial.nearest(p, o, ["g"], "id", "oid", 4.0).collect()}
    want = {}
    for g, i, x, y in points:
        near = [((x - b) ** 2 + (y - c) ** 2, n) for h, n, b, c in others if h == g and b is not None and x is not None]
        if near:
            d, n = min(near)
            want[g, i] = (n, round(d**0.5, 6))
    assert got == want
    assert spatial.nearest(p.limit(0), o, ["g"], "id", "oid").count() == 0 and spatial.nearest(p, o.limit(0), ["g"], "id", "oid").count() == 0


def test_breadcrumbs_end_at_cycles_and_ten(spark):
    e = [("a", "b", "contains"), ("b", "c", "contains"), ("z", "c", "contains"), ("x", "y", "contains"), ("y", "x", "contains"), ("q", "c", "name_ref"), ("s", "s", "contains")]
    e += [(f"n{i:02}", f"n{i + 1:02}", "contains") for i in range(14)]
    got = {r["node"]: (r["depth"], r["trail"]) for r in graph.breadcrumbs(spark.createDataFrame(e, "src string, dst string, kind string"), ("contains",)).collect()}
    assert got["c"] == (2, "a > b > c") and got["x"] == (1, "y > x") and got["b"] == (1, "a > b") and "s" not in got
    assert got["n14"][0] == 10 and got["n05"] == (5, " > ".join(f"n{i:02}" for i in range(6)))


def test_first_edges(spark):
    e = spark.createDataFrame([("r", "a", "k2"), ("r", "b", "k1"), ("a", "c", "k0"), ("b", "c", "k1"), ("u", "c", "a")], "src string, dst string, kind string")
    d = spark.createDataFrame([("r", 0), ("a", 1), ("b", 1), ("c", 2)], "node string, depth int")
    assert rows(graph.first_edges(e, d)) == [("a", "r", "k2"), ("b", "r", "k1"), ("c", "a", "k0")]


def test_subsets(spark):
    g = spark.createDataFrame([("s", 1), ("s", 2), ("s", 2), ("t", 1), ("t", 9), ("u", None), (None, 1)], "group string, member int")
    of = spark.createDataFrame([("x", 1), ("x", 2), ("x", 3), ("y", 1), ("z", 9)], "group string, member int")
    assert rows(duplicates.subsets(g, of)) == [("s", "x")]
    assert duplicates.subsets(g.limit(0), of).count() == 0


def test_joined_labels(spark):
    df = spark.createDataFrame([("a", x) for x in "edcbaaa"] + [("b", "x"), ("b", None), ("c", None)], "k string, v string")
    assert rows(text.joined_labels(df, ["k"], "v")) == [("a", "a; b; c; d; …", 5), ("b", "x", 1)]


def test_globs_against_brute_force(spark):
    names = ["q_rats", "Q_bats", "q.x", "q_", "other", "x[1]", None, "q_rats"]
    patterns = ["q_*", "q?x", "*", "?_*s", "x[1]", "none*", None, "q.x"]
    got = {(r["name"], r["pattern"]) for r in text.match_globs(spark.createDataFrame([(n,) for n in names], "n string"), "n", spark.createDataFrame([(p,) for p in patterns], "p string"), "p").collect()}
    regex = lambda p: "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in p)
    assert got == {(n, p) for n in names for p in patterns if n and p and re.fullmatch(regex(p), n, re.I | re.S)}


@pytest.mark.parametrize("leaves", [
    [], [("A", "byte", "7")], [("S/B", "int", "-3"), ("S/C", "float", "1.5"), ("Tag", "cexostring", "größe")], [("L[0]/X", "resref", "ab"), ("L[1]/M[0]/Y", "dword64", "18446744073709551615"), ("V", "vector", "1 2 3"), ("B", "void", "00ff")],
])
def test_trees_there_and_back(leaves):
    read = [(p, t, v) for p, _, t, v in formats.tree_leaves(writers.tree_bytes(leaves))]
    assert sorted(read) == sorted(leaves)


def test_archives_tables_and_strings_there_and_back():
    entries = [("a", "nss", b"12"), ("b", "uti", b"")]
    data = writers.archive_bytes(entries)
    assert [(n, e, data[at : at + size]) for n, e, at, size, _ in formats.archive_entries(data)] == entries
    assert formats.string_table(writers.string_table_bytes({0: "x", 3: "ü"})) == [(0, "x"), (3, "ü")] and formats.string_table(writers.string_table_bytes({})) == []
    cells = formats.table_cells(writers.table_text(["A", "B c"], [("0", ["1", None]), ("1", ["two words", "x"])]))
    assert cells == [(0, "0", "A", "1"), (0, "0", "B c", None), (1, "1", "A", "two words"), (1, "1", "B c", "x")]


def test_packed_trees_split_large_files(spark, monkeypatch):
    monkeypatch.setattr(writers, "PART", 50)
    data = [(1, f"L[{i}]/N", "int", str(i)) for i in range(500)] + [(2, "A", "int", None), (3, "A", "int", "5"), (None, "A", "int", "1")]
    made = writers.pack_trees(spark.createDataFrame(data, "file_id long, path string, type string, value string"))
    read = readers.parse_trees(made)
    assert read.where("error IS NOT NULL").count() == 0
    got = rows(read.select(F.substring_index("path", "/", 1).cast("int").alias("f"), F.col("value").cast("int")))
    assert sorted(got) == sorted([(1, i) for i in range(500)] + [(3, 5)])
