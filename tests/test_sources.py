import sqlite3
import struct

import pytest

import builders
from conftest import rows
from loomdex.sources import formats, readers, sinks


def test_tree_leaves():
    leaves = formats.tree_leaves(builders.item_file())
    assert leaves == [("Tag", "Tag", "cexostring", "tag"), ("Cost", "Cost", "dword", "250"), ("Weight", "Weight", "float", "1.25"), ("Name", "Name", "cexolocstring", "Sword"),
                      ("ItemList[0]/Res", "Res", "resref", "ab_1"), ("ItemList[1]/Res", "Res", "resref", "xy")]
    assert formats.tree_strings(builders.item_file()) == [("Name", 0xFFFFFFFF, {0: "Sword", 4: "Größ"})]


@pytest.mark.parametrize("data", [b"", b"UTI V3.2", builders.item_file()[:80], b"UTI V3.2" + struct.pack("<12I", *[0xFFFFFFFF] * 12)])
def test_damaged_trees_are_refused(data):
    with pytest.raises(ValueError):
        formats.tree_leaves(data)


def test_tree_bombs_are_refused():
    n = 40  # every struct lists the next one twice
    structs = [(0, i, 1) for i in range(n)] + [(0, 0, 0)]
    lists = [x for i in range(n) for x in (2, i + 1, i + 1)]
    data = builders.tree_file(structs, [(15, 0, 12 * i) for i in range(n)], ["L"], lists=lists)
    with pytest.raises(ValueError):
        formats.tree_leaves(data)


def test_orientations_and_vectors():
    blob = struct.pack("<7f", 0.0, 1.0, 0.5, -2.0, 1.5, 2.25, -3.0)
    data = builders.tree_file([(0, 0, 3)], [(16, 0, 0), (17, 1, 16), (5, 2, 0xFFFFFFFF)], ["Turn", "Place", "N"], blob, [0, 1, 2])
    assert formats.tree_leaves(data) == [("Turn", "Turn", "orientation", "0 1 0.5 -2"), ("Place", "Place", "vector", "1.5 2.25 -3"), ("N", "N", "int", "-1")]


def test_shared_blobs_are_bounded():
    blob = struct.pack("<I", 1 << 16) + b"x" * (1 << 16)  # every one of many fields points at the same large text
    n = 4000
    data = builders.tree_file([(0, 0, n)], [(10, 0, 0)] * n, ["L"], blob, range(n))
    with pytest.raises(ValueError):
        formats.tree_leaves(data)
    few = builders.tree_file([(0, 0, 3)], [(10, 0, 0)] * 3, ["L"], blob, range(3))
    assert [len(x[3]) for x in formats.tree_leaves(few)] == [1 << 16] * 3


def test_trees_nested_too_deep_are_refused():
    chain = lambda n: builders.tree_file([(0, i, 1) for i in range(n)], [(14, 0, i + 1) for i in range(n - 1)] + [(5, 0, 7)], ["S"])
    assert formats.tree_leaves(chain(150))[0][0].count("/") == 149
    with pytest.raises(ValueError):
        formats.tree_leaves(chain(300))


def script(*code):
    body = b"".join(code)
    return b"NCS V1.0B" + struct.pack(">I", 13 + len(body)) + body


def test_constants_and_jumps_of_bytecode():
    text = lambda kind, s: bytes([4, kind]) + struct.pack(">H", len(s)) + s
    ok = script(bytes([4, 3]) + struct.pack(">i", -5), text(5, b"abc"), text(0x17, b'{"a":1}'), bytes([0x1D, 0]) + struct.pack(">i", 6), bytes([0x20, 0]))
    assert formats.bytecode(ok) == (True, [-5], ["abc", '{"a":1}'])
    astray = script(bytes([0x1D, 0]) + struct.pack(">i", 3), bytes([0x20, 0]))
    assert formats.bytecode(astray)[0] is False


def test_archive_entries():
    data = builders.archive([("Scr_A", 2009, b"void main(){}"), ("..\\x", 2025, b"zz"), ("gone", 0xFFFF, b""), ("odd", 4242, b"1")])
    assert [(a, b, d, e) for a, b, _, d, e in formats.archive_entries(data)] == [("scr_a", "nss", 13, False), ("invalid_name_1", "uti", 2, False), ("odd", "t4242", 1, False)]
    with pytest.raises(ValueError):
        formats.archive_entries(data[:16] + struct.pack("<I", 10**9) + data[20:])


def test_table_cells():
    text = '2DA V2.0\r\nDEFAULT: x\r\n\r\n  LABEL  "Two words"\r\n0 a "b c"\r\n\r\n1 ****\r\n2 it\'s d extra\r\n'
    assert formats.table_cells(text) == [(0, "0", "LABEL", "a"), (0, "0", "Two words", "b c"), (1, "1", "LABEL", None), (1, "1", "Two words", None), (2, "2", "LABEL", "it's"), (2, "2", "Two words", "d")]
    with pytest.raises(ValueError):
        formats.table_cells("nope")


def test_string_table_install_dbase_dump_settings():
    assert formats.string_table(builders.string_table(["Häuser", None, ""])) == [(0, "Häuser"), (2, "")]
    assert formats.install_names(builders.install_index([("NW_A", 2010), ("b", 2025)])) == ["b.uti", "nw_a.ncs"]
    columns, data = formats.dbase_rows(builders.dbase([("NAME", "C", 8), ("N", "N", 4)], [("one", 1), ("two", 2), ("x", "")], deleted={1}))
    assert columns == [("NAME", "C"), ("N", "N")] and data == [["one", "1"], ["x", None]]
    dump = "-- c\nINSERT INTO `loot` VALUES (3,'it''s, (ok)','x'),\n (NULL,'a\\'b',''); INSERT INTO t (a) VALUES (1);"
    assert list(formats.dump_rows(dump)) == [("loot", 0, ["3", "it's, (ok)", "x"]), ("loot", 1, [None, "a'b", ""]), ("t", 0, ["1"])]
    assert formats.sections("; c\nk=v\n[A]\nx = 1=2\n") == [("", "k", "v"), ("A", "x", "1=2")]
    assert formats.settings('[a.b]\nport = 5\non = true\npassword = "p"\n', "settings.toml") == [("a.b.port", "5"), ("a.b.on", "true"), ("a.b.password", "***")]
    assert formats.settings("# c\nexport A='1'\nAPI_TOKEN=z", "x.env") == [("A", "1"), ("API_TOKEN", "***")]


def test_readers_isolate_damage(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.uti").write_bytes(builders.item_file())
    (tmp_path / "sub" / "b.uti").write_bytes(b"junk")
    (tmp_path / "m.mod").write_bytes(builders.archive([("s", 2009, b"x" * 10)]))
    (tmp_path / "t.2da").write_bytes(b"2DA V2.0\n\nA\n0 \xe4\n")
    (tmp_path / "d.tlk").write_bytes(builders.string_table(["zero", "one"]))
    (tmp_path / "m.mdl").write_text("newmodel m\nsetsupermodel m C_Base\n bitmap Tex_A\n texture0 tex_b\n bitmap NULL\n")
    df = readers.read_trees(spark, str(tmp_path), "*.uti")
    assert df.where("error IS NULL").count() == 6 and df.where("error IS NOT NULL").count() == 1
    assert readers.read_tree_strings(spark, str(tmp_path), "a.uti").first()["entries"] == {0: "Sword", 4: "Größ"}
    assert rows(readers.read_archives(spark, str(tmp_path), "*.mod", contents=True).select("resref", "ext", "bytes", "body")) == [("s", "nss", 10, bytearray(b"x" * 10))]
    assert rows(readers.read_tables(spark, str(tmp_path)).select("row", "label", "col", "value")) == [(0, "0", "A", "ä")]
    assert rows(readers.read_models(spark, str(tmp_path)).select("supermodel", "textures")) == [("c_base", ["tex_a", "tex_b"])]
    assert {r["ext"] for r in readers.listing(spark, str(tmp_path)).collect()} == {"uti", "mod", "2da", "tlk", "mdl"}
    assert readers.content_manifest(spark, str(tmp_path), "*.uti").count() == 2
    base = readers.read_string_tables(spark, str(tmp_path))
    refs = spark.createDataFrame([(0,), (1 + (1 << 24),), (7,), (0xFFFFFFFF,)], "strref long")
    assert rows(readers.overlay_strings(refs, base, base)) == sorted([(0, "zero"), (1 + (1 << 24), "one"), (7, None), (0xFFFFFFFF, None)], key=repr)


def test_sqlite_source(spark, tmp_path):
    path = str(tmp_path / "x.sqlite")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE bank(owner TEXT, gold INT)")
        db.executemany("INSERT INTO bank VALUES (?, ?)", [(f"o{i}", i) for i in range(100)] + [(None, None)])
    readers.register(spark)
    df = spark.read.format("sqlite").option("path", path).option("table", "bank").load()
    assert df.count() == 101 and df.where("gold = '7'").first()["owner"] == "o7"


def test_upload_and_sinks(spark, tmp_path):
    (tmp_path / "u.csv").write_text("\ufeffgroup,note\n1,'=SUM(A1)\n2,\"a, b\"\n", encoding="utf-8")
    up = readers.read_upload(spark, str(tmp_path / "u.csv"), ["group"])
    assert rows(up) == [("1", "=SUM(A1)"), ("2", "a, b")]
    with pytest.raises(ValueError):
        readers.read_upload(spark, str(tmp_path / "u.csv"), ["merge"])
    out = spark.createDataFrame([("=1+1", [1, 2], {"k": 1}), (None, None, None)], "a string, b array<int>, c map<string,int>")
    sinks.write_csv(out, str(tmp_path / "o"))
    back = spark.read.option("header", "true").option("escape", '"').csv(str(tmp_path / "o"))
    assert ("'=1+1", "1; 2", '{"k":1}') in rows(back)
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert rows(sinks.upsert(t, new, ["id"])) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(sinks.insert_ignore(t, new, ["id"])) == [(1, "a"), (2, "b"), (3, "d")]
    m = spark.createDataFrame([("x", 5)], "name string, bytes long")
    for s in ("s1", "s2", "s1"):
        sinks.write_snapshot(m, str(tmp_path / "snap"), s)
    assert rows(sinks.snapshots(spark, str(tmp_path / "snap"))) == [("s1", 1, 5), ("s2", 1, 5)]
    r = sinks.report({"t": t}, cap=1)
    assert r["t"]["total"] == 2 and r["t"]["truncated"] and len(r["t"]["rows"]) == 1
