"""Graph operators against brute force on small graphs with cycles, self edges and diamonds."""

import os
import random

import pytest
from conftest import rows
from loomdex.operators import graph
from loomdex.plans import findings, module_graph
from loomdex.operators.components import components
from loomdex.operators.precedence import conflicts, shadowed, winners
from pyspark.sql import functions as F


def make(spark, edges):
    return spark.createDataFrame(edges, "src string, dst string, kind string")


def brute_reach(edges, start):
    seen, todo = {start: 0}, [start]
    for x in todo:
        for s, d, _ in edges:
            if s == x and d not in seen:
                seen[d] = seen[x] + 1
                todo.append(d)
    return seen


def random_graph(seed, n=30, m=45):
    rng = random.Random(seed)
    return [(f"script:{rng.randrange(n)}", f"script:{rng.randrange(n)}", rng.choice(["include", "name_ref"])) for _ in range(m)]


def test_reachable_paths_closure(spark):
    e = random_graph(1)
    df = make(spark, e)
    root = spark.createDataFrame([("script:1",), ("script:999",)], "node string")
    want = brute_reach(e, "script:1") | {"script:999": 0}
    assert dict(rows(graph.reachable(df, root))) == want
    p = {r[0]: r for r in rows(graph.paths(df, root))}
    assert {k: v[1] for k, v in p.items()} == want
    assert all(len(v[2].split(" > ")) == v[1] + 1 for v in p.values())
    some = graph.reachable(df, root, avoid=F.col("node") == "script:1")
    assert rows(some) == [("script:1", 0), ("script:999", 0)]
    pairs = set(rows(graph.closure(df)))
    nodes = {x for s, d, _ in e for x in (s, d)}
    want = set()
    for x in nodes:
        for s, d, _ in e:
            if s == x:
                want |= {(x, y) for y in brute_reach(e, d)}
    assert pairs == want


def test_strong_components_and_cycles(spark):
    for seed in range(2):
        e = random_graph(seed + 5, 25, 50)
        nodes = {x for s, d, _ in e for x in (s, d)}
        reach = {x: {y for s, d, _ in e if s == x for y in brute_reach(e, d)} for x in nodes}
        want = {(x, min(y for y in nodes if y in reach[x] and x in reach[y])) for x in nodes if x in reach[x]}
        assert set(rows(graph.strong_components(make(spark, e)))) == want
    assert graph.strong_components(make(spark, [("a:1", "a:2", "include")])).count() == 0


def test_components_on_a_long_chain_and_hub(spark):
    e = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(500)] + [(5, 5), (None, 3)]
    df = spark.createDataFrame(e, "a long, b long")
    got = dict(rows(components(df, "a", "b")))
    assert got == {i: 0 for i in range(201)} | {1000: 1000} | {1001 + i: 1000 for i in range(500)}
    assert components(df.limit(0), "a", "b").count() == 0


def test_impact_rules(spark):
    e = [("script:a", "script:inc", "include"), ("area:1", "script:a", "event_script"), ("script:b", "script:a", "name_ref"), ("script:c", "script:b", "execute_script"),
         ("inst:1", "bp:x", "template"), ("area:2", "bp:x", "name_ref"), ("script:inc", "script:inc", "include"), ("dlg:d", "script:b", "name_ref")]
    starts = spark.createDataFrame([(x,) for x in ("script:inc", "bp:x", "script:b", "area:1")], "node string")
    hard = graph.impact(make(spark, e), starts)
    assert rows(hard) == sorted([("script:inc", "script:a", "carrier"), ("script:inc", "area:1", "carrier"), ("bp:x", "inst:1", "placed"), ("script:b", "script:c", "carrier")])
    levels = {r[0]: r[1] for r in rows(graph.judge(hard, starts))}
    assert levels == {"script:inc": "Medium", "bp:x": "Low", "script:b": "Low", "area:1": "None"}


def test_impact_of_variables_and_dead_starts(spark):
    e = [("var:v", "script:set", "var_set"), ("script:read", "var:v", "var_read"), ("dlg:d", "script:read", "dlg_script"), ("script:set", "script:inc", "include"),
         ("area:live", "script:read", "event_script"), ("area:dead", "script:x", "event_script"), ("script:y", "script:x", "include"), ("var:w", "script:w", "var_set"),
         ("inst:1", "bp:p", "template"), ("2da:a", "2da:b", "name_ref"), ("area:live", "script:z", "name_ref"), ("bp:q", "bp:p", "inventory"), ("script:set", "script:read", "include")]
    names = ("script:set", "script:inc", "script:x", "script:w", "bp:p", "2da:b", "script:read", "area:live")
    starts = spark.createDataFrame([(x,) for x in names], "node string")
    df = make(spark, e)
    got = rows(graph.impact(df, starts))
    assert [r for r in got if r[2] == "soft"] == sorted([("script:set", n, "soft") for n in ("var:v", "script:read", "dlg:d", "area:live")] + [("script:inc", n, "soft") for n in ("var:v", "script:read", "dlg:d", "area:live")]
        + [("script:w", "var:w", "soft"), ("script:read", "var:v", "soft")])
    soft_only = {r[0]: r[1:3] for r in rows(graph.judge(graph.impact(df, starts), starts))}
    assert soft_only["script:set"] == ("Low", 0) and soft_only["script:w"] == ("None", 0) and soft_only["script:x"] == ("Medium", 2)
    live = spark.createDataFrame([("area:live",), ("script:read",), ("script:set",), ("var:w",)], "node string")
    levels = {r[0]: r[1:3] for r in rows(graph.judge(graph.impact(df, starts), starts, live))}
    assert levels == {
        "script:set": ("Low", 0), "script:inc": ("Low", 1), "script:x": ("None", 2), "script:w": ("None", 0), "bp:p": ("None", 1), "2da:b": ("Low", 1),
        "script:read": ("Medium", 3), "area:live": ("None", 0),
    }


def test_chain_and_status(spark):
    e = make(spark, [("a", "b", "include"), ("b", "c", "include"), ("a", "c", "include"), ("x", "y", "include"), ("y", "x", "include")])
    e = e.unionByName(make(spark, [("p", "x", "include"), ("q", "p", "include")]))
    d = dict(rows(graph.longest_chain(e)))
    assert d == {"a": 2, "b": 1, "c": 0, "x": 0, "y": 0, "p": 1, "q": 2}  # x and y count as one
    s = spark.createDataFrame([("a", "Review"), ("b", "Safe as group"), ("c", "Safe as group"), ("x", "Safe")], "node string, status string")
    assert dict(rows(graph.spread_status(s, e, "Review", "Safe as group", "Review"))) == {"a": "Review", "b": "Review", "c": "Review", "x": "Safe"}


def test_chains_have_no_longest_length(spark):
    d = dict(rows(graph.longest_chain(make(spark, [(f"n{i:02}", f"n{i + 1:02}", "include") for i in range(66)]))))
    assert d == {f"n{i:02}": 66 - i for i in range(67)}


def test_precedence(spark):
    c = spark.createDataFrame([(1, "a", 5, "s1", "x"), (2, "a", 3, "s2", "y"), (3, "b", 1, "s1", None), (4, None, 1, "s1", "x"), (5, None, 0, "s3", "x")], "id long, k string, rank int, src string, body string")
    assert {r[0] for r in rows(winners(c, ["k"], [F.asc("rank"), F.asc("id")]).select("id"))} == {2, 3, 5}
    assert rows(shadowed(c, ["k"], [F.asc("rank"), F.asc("id")], "id").select("id", "winner", "place")) == [(1, 2, 2), (4, 5, 2)]
    assert rows(conflicts(c, ["k"], "src", "body")) == [("a", 2, 2, "s1 | s2")]


def test_missing_reference_keeps_the_whole_name(spark, monkeypatch):
    names = ["x" * 100 + end for end in ("a", "b")]
    e = make(spark, [("script:a", f"missing:{n}", "include") for n in names])
    monkeypatch.setattr(module_graph, "edges", lambda *_: e)
    monkeypatch.setattr(module_graph, "missing_nodes", lambda *_: e)
    assert [r[3] for r in rows(findings.missing_reference(spark, ""))] == [f"include {n}" for n in names]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_issues_hold_cycles(spark, monkeypatch):
    e = make(spark, [("script:a", "script:b", "include"), ("script:b", "script:a", "include"), ("script:c", "script:a", "include")])
    monkeypatch.setattr(module_graph, "edges", lambda *_: e)
    found = findings.issues(spark, "/root/testdata/sf0.001").where("category = 'include_cycle'")
    assert rows(found) == [("error", "include_cycle", n, "script:a") for n in ("script:a", "script:b")]
