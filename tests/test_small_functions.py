import re
import struct

import pytest
from pyspark.sql import functions as F

from conftest import rows
from loomdex.functions import scalars
from loomdex.operators import graph, scripts, text
from loomdex.sources import formats, readers


def test_scalars(spark):
    d = spark.createDataFrame([(0, 500.0), (1, 2048.0), (2, 5e6), (3, None)], "id int, n double")
    assert dict(rows(d.select("id", scalars.readable_bytes(F.col("n"))))) == {0: "500 B", 1: "2.0 KB", 2: "4.8 MB", 3: None}
    assert dict(rows(d.select("id", scalars.readable_seconds(F.col("n"))))) == {0: "8 min", 1: "34 min", 2: "1388 h 53 min", 3: None}
    w = spark.createDataFrame([("On",), (" 0 ",), ("maybe",), (None,)], "v string")
    assert [r[0] for r in w.select(scalars.switched(F.col("v"))).collect()] == [True, False, None, None]
    c = spark.createDataFrame([("255",), ("16711680",), ("x",)], "v string")
    assert [r[0] for r in c.select(scalars.colour(F.col("v"))).collect()] == ["#FF0000", "#0000FF", None]
    s = spark.createDataFrame([("10",), ("9",), ("b",), ("a",)], "v string").orderBy(*scalars.natural(F.col("v")))
    assert [r[0] for r in s.collect()] == ["9", "10", "a", "b"]
    assert [r[0] for r in spark.createDataFrame([("abcdef",), ("abc",)], "v string").select(scalars.short(F.col("v"), 4)).collect()] == ["abc…", "abc"]


@pytest.mark.parametrize(("glob", "yes", "no"), [("src/**/*.{nss,json}", ["src/a.nss", "src/x/y/b.json"], ["src/a.txt", "a.nss"]), ("*.u?i", ["a.uti"], ["x/a.uti", "a.utti"]), ("a.b", ["a.b"], ["aXb"])])
def test_globs(glob, yes, no):
    p = re.compile(scalars.glob_pattern(glob))
    assert all(p.match(x) for x in yes) and not any(p.match(x) for x in no)


def test_bytecode(spark, tmp_path):
    body = b"\x04\x03" + struct.pack(">i", -7) + b"\x04\x05" + struct.pack(">H", 3) + b"abc" + b"\x05\x00\x00\x01\x02" + b"\x0b\x24\x00\x08" + b"\x20\x00"
    data = b"NCS V1.0\x42" + struct.pack(">I", 13 + len(body)) + body
    assert formats.bytecode(data) == (True, [-7], ["abc"])
    assert formats.bytecode(data[:-3])[0] is False and formats.bytecode(data + b"\xff\xff")[0] is False
    with pytest.raises(ValueError):
        formats.bytecode(b"junk")
    (tmp_path / "a.ncs").write_bytes(data)
    c = readers.read_bytecode(spark, str(tmp_path)).select(F.lit("a").alias("script"), "texts")
    lit = spark.createDataFrame([("a", "abc"), ("a", "changed"), ("b", "x y z")], "script string, literal string")
    assert rows(readers.stale_bytecode(c, lit)) == [("a", 1)]


def test_typed_literals_suffixes_and_diffs(spark):
    lit = spark.createDataFrame([(1, 1, "ExecuteScript", 0, "scr_a", False), (1, 2, "Foo", 0, "Sword_1", False), (1, 3, None, 0, "nothing", False)], scripts.LITERALS)
    names = spark.createDataFrame([("item", "sword_1"), ("tag", "SWORD_1")], "kind string, name string")
    assert rows(scripts.typed_literals(lit, names).select("literal", "kind", "certain")) == [("Sword_1", "item", False), ("scr_a", "script", True)]
    n = spark.createDataFrame([("chest_ud",), ("ud",), (None,)], "n string")
    assert rows(text.suffix_link(n, "n", spark.createDataFrame([("_UD",), ("ud",)], "s string"), "s", 2)) == [("chest_ud", "_ud"), ("chest_ud", "ud"), ("ud", "ud")]
    p = spark.createDataFrame([(1, "a\nb\nc", "a\nx\nc\nd"), (2, "same", "same"), (3, None, "new")], "id long, a string, b string")
    assert rows(text.line_diff(p, "id", "a", "b")) == [(1, 0, "-", "b"), (1, 1, "+", "x"), (1, 2, "+", "d"), (3, 0, "+", "new")]


def test_layout(spark):
    links = spark.createDataFrame([("a", "b", 1, 0), ("b", "c", 0, 2), ("x", "w", -1, 0), ("a", "c", 5, 5)], "src string, dst string, dx long, dy long")
    assert rows(graph.layout(links)) == [("a", "a", 0, 0), ("b", "a", 1, 0), ("c", "a", 5, 5), ("w", "w", 0, 0), ("x", "w", 1, 0)]
