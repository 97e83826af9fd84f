import json

from pyspark.sql import functions as F

from conftest import rows
from loomdex.operators import rules, text
from loomdex.operators.duplicates import case_twins, near_names, same_key, signature
from loomdex.sources.readers import register
from loomdex.streaming import logs

LINES = [
    "E [00:40:16] ScriptVM (nwsvmachinecommands.cpp:264:ReportError): Script error: ms_onmodload OID: 00000000, Tag: chest, ERROR: IP OUT OF CODE SEGMENT",
    "E [00:41:16] ScriptVM (nwsvmachinecommands.cpp:264:ReportError): Script error: MS_OnModLoad OID: 00000001, Tag: , ERROR: IP OUT OF CODE SEGMENT",
    "E [00:40:16] ScriptVM (scriptvmcore.cpp:2189:RunScript): script ms_onmodload at level 0 on object 0x00000000 took 57830 us, error: -646",
    "E [00:40:37] (twodimarray.cpp:940:Load2DArray): Failed to demand gosslulncomm.2da",
    "[Mon Jan 01 10:00:01] Warning: 5 players",
    "[Mon Jan 01 10:00:02] Warning: 17 players",
    "[CHAT WINDOW TEXT] [Mon] error everywhere",
    "all is well",
    "",
    None,
]


def test_log_groups(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(LINES)], "seq int, value string")
    g = {(r["kind"], r["subject"], r["signature"]): r for r in logs.group(logs.parse(df), "seq").collect()}
    assert set(g) == {("script_error", "ms_onmodload", "ERROR: IP OUT OF CODE SEGMENT"), ("script_stopped", "ms_onmodload", "-#"), ("missing_resource", "gosslulncomm.2da", ""), ("warning", "", "Warning: # players")}
    e = g["script_error", "ms_onmodload", "ERROR: IP OUT OF CODE SEGMENT"]
    assert (e["count"], e["first_seen"], e["last_seen"], e["tags"], e["severity"]) == (2, "00:40:16", "00:41:16", ["chest"], "error")
    assert g["warning", "", "Warning: # players"]["severity"] == "warning"


def test_log_groups_as_a_stream(spark, tmp_path):
    register(spark)
    lines = [x for x in LINES if x] + [f"Script error: many OID: 1, Tag: t{i % 14}, ERROR: BAD {i}" for i in range(60)]
    log = tmp_path / "a.log"
    latest = {}

    def keep(batch, _):
        latest.update({(r["kind"], r["subject"], r["signature"]): (r["count"], r["first_seen"], r["last_seen"], r["example"], sorted(r["tags"])) for r in batch.collect()})

    for part in (lines[:30], lines[30:]):
        with log.open("a") as f:
            f.write("\n".join(part) + "\n")
        s = spark.readStream.format("tail").option("path", str(log)).load()
        q = logs.group_stream(s).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()
    batch = logs.group(logs.parse(spark.createDataFrame(list(enumerate(lines)), "seq int, value string")), "seq")
    want = {(r["kind"], r["subject"], r["signature"]): (r["count"], r["first_seen"], r["last_seen"], r["example"], sorted(r["tags"])) for r in batch.collect()}
    assert set(latest) == set(want) and {k: v[0] for k, v in latest.items()} == {k: v[0] for k, v in want.items()}
    many = latest["script_error", "many", "ERROR: BAD #"]
    assert many[0] == 60 and len(many[4]) == 10 and set(many[4]) <= {f"t{i}" for i in range(14)}


def test_tail_reads_exactly_the_new_lines(spark, tmp_path):
    register(spark)
    log, out = tmp_path / "a.log", tmp_path / "out"

    def run():
        s = spark.readStream.format("tail").option("path", str(tmp_path / "*.log")).load()
        q = s.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()
        return sorted(r[0] for r in spark.read.parquet(str(out)).collect())

    log.write_text("one\ntwo\nhal")
    assert run() == ["one", "two"]
    with log.open("a") as f:
        f.write("f\nthree\n")
    assert run() == ["half", "one", "three", "two"]
    log.write_text("new\n")
    assert run() == ["half", "new", "one", "three", "two"]


def test_text_operators(spark):
    d = spark.createDataFrame([(1, "a lamp\r\nSword_01 here\n"), (2, None), (3, ""), (4, "x" * 100_000 + " sword_01")], "id int, text string")
    assert rows(text.grep(d, "id", "text", "(?i)sword").select("id", "line")) == [(1, 2), (4, 1)]
    n = spark.createDataFrame([("SWORD_01",), (None,)], "name string")
    assert rows(text.link_names(d, "id", "text", n, "name")) == [(1, "sword_01"), (4, "sword_01")]
    v = spark.createDataFrame([("old lamp",), ("lamps",), ("LAMP,lamp lamp",), (None,)], "value string")
    assert rows(text.replace_plan(v, "value", "lamp", "torch").select("after")) == [("old torch",), ("torch,torch torch",)]
    r = spark.createDataFrame([("a", "b"), ("a", "b")], "old string, new string")
    assert rows(text.rewrite(spark.createDataFrame([("a", 1), ("c", 2), (None, 3)], "k string, n int"), "k", r).select("n", "k", "changed")) == [(1, "b", True), (2, "c", False), (3, None, False)]
    s = spark.createDataFrame([("key_red_1",), ("key_red_2",), ("key_blue_1",), ("lone",), (None,)], "name string")
    assert dict(rows(text.name_sets(s, "name", 2, 2))) == {"key_red_1": "key_red", "key_red_2": "key_red", "key_blue_1": None, "lone": None}


def test_name_sets_of_many_names_and_digits(spark):
    many = {f"at_{'forest' if k % 2 else 'for'}{chr(97 + k // 26)}{chr(97 + k % 26)}": None for k in range(100)}  # at: too many; at_fo: too
    some = {f"at_cave{c}x": "atcave" for c in "abc"} | {f"Q_Rats{k}": "q" for k in (1, 2)} | {"hut.one": "hut", "HUT/two": "hut", "/hut:3_": "hut"}
    plain = {"DUKESARMY": "dukes", "DukesWizard": "dukes", "abcd": None, "abc_d": None, "rats1": "rats", "rats2": "rats", "7": None, "_": None, "": None}
    want = many | some | plain
    s = spark.createDataFrame([(x,) for x in want] * 2 + [(None,)], "name string")
    assert dict(rows(text.name_sets(s, "name"))) == want


def test_duplicates(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 3), (None, 4), (None, 5)], "k string, id int")
    assert rows(same_key(df, ["k"], "id")) == [("a", 1, 2), ("a", 2, 2)]
    sig = dict(rows(signature(spark.createDataFrame([(1, "p", "v"), (1, "q", None), (2, "q", None), (2, "p", "v"), (2, "p", "v"), (3, "p", "w")], "e int, p string, v string"), "e", ["p", "v"])))
    assert sig[1] == sig[2] != sig[3]
    n = spark.createDataFrame([("abcdef",), ("abcdeg",), ("abcde",), ("xabcdef",), ("abdcef",), (None,)], "n string")
    assert rows(near_names(n, "n", 6)) == [("abcdef", "abcdeg"), ("abcdef", "xabcdef")]
    assert rows(case_twins(spark.createDataFrame([("Ab",), ("aB",), ("c",), (None,)], "n string"), "n")) == [("ab", "Ab | aB", 2)]


def test_rules(spark):
    i = spark.createDataFrame([("error", "c", "n1", "has 5"), ("error", "c", "n2", "has 6"), ("warning", "d", "n1", "x")], "severity string, category string, node string, detail string")
    live = spark.createDataFrame([("n1",)], "node string")
    assert [r[0] for r in rows(rules.downgrade_unused(i, live, ("c",)).select("severity"))] == ["error", "info", "warning"]
    acc = spark.createDataFrame([("c", "n1", "has 99")], "category string, node string, detail string")
    assert rules.without_accepted(i, acc).count() == 2
    top = {(r["category"], r["node"]): r["hidden"] for r in rules.cap_per_category(i, 1).collect()}
    assert top == {("c", "n1"): 1, ("d", "n1"): 0}


def test_facts(spark):
    import os

    import pytest

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test data")
    from loomdex.api import Facts

    f = Facts(spark, "/root/testdata/sf0.001", limit=5)
    assert f.summary()["total"] >= 5
    some = f.edges.first()
    assert f.who_uses(some.dst)["total"] >= 1 and f.uses(some.src)["total"] >= 1
    assert f.impact(some.dst)["level"] in ("None", "Low", "Medium", "High", "Critical")
    assert f.grep("void main")["total"] >= 0
    assert json.dumps(f.issues("parse_error"))
    for bad in (lambda: f.grep("("), lambda: f.issues("nope"), lambda: f.uses(" "), lambda: f.script(1, 5, 2)):
        with pytest.raises(ValueError):
            bad()


def test_tail_reads_ranges_whole_lines_once(tmp_path, monkeypatch):
    from loomdex.streaming import tail

    monkeypatch.setattr(tail, "RANGE", 7)
    monkeypatch.setattr(tail, "BACK", 5)
    log = tmp_path / "a.log"
    lines_ = ["one", "", "a much longer line", "x", "ünd", "y" * 30]
    log.write_bytes("\n".join(lines_).encode() + b"\nnot yet done")
    reader = tail.TailReader(str(tmp_path / "*.log"))
    end = reader.latestOffset()
    parts = reader.partitions({}, end)
    assert len(parts) > 5 and [v for p in parts for v, _ in reader.read(p)] == lines_
    with log.open("ab") as f:
        f.write(b"\r\nlast\n")
    later = reader.latestOffset()
    assert [v for p in reader.partitions(end, later) for v, _ in reader.read(p)] == ["not yet done", "last"]
    log.write_text("anew\n")
    assert [v for p in reader.partitions(later, reader.latestOffset()) for v, _ in reader.read(p)] == ["anew"]


def test_replacing_takes_signs_as_they_are(spark):
    from loomdex.operators.text import replace_plan

    df = spark.createDataFrame([("a.b here",), ("aXb here",), ("50%_x",), ("say A.B",), ("xa.b",), (None,)], "v string")
    assert {r["v"]: r["after"] for r in replace_plan(df, "v", "a.b", "$1\\").collect()} == {"a.b here": "$1\\ here", "say A.B": "say $1\\"}
    assert [r["after"] for r in replace_plan(df, "v", "50%_x", "y").collect()] == ["y"]


def test_kinds_of_log_lines(spark):
    lines = {
        "I [10:00:00] Loader (a.cpp:1:F): Couldn't open file walls_01.tga": ("missing_resource", "walls_01.tga"), "gate_open.nss(12): ERROR: UNKNOWN TOKEN": ("compile_error", "gate_open"),
        "NWNX_Thing (x): WARN odd": ("nwnx", "nwnx_thing"), "Resource lamp_9 not found": ("missing_resource", "lamp_9"), "an Exception came": ("error", ""), "no errors here": None,
        "[Mon 1 Jan 10:00:00] [CHAT] error": None, "Script mill_a, OID: 1f, Tag: Door, ERROR: TOO MANY INSTRUCTIONS": ("script_error", "mill_a"), "   ": None,
    }
    got = {r["value"]: (r["kind"], r["subject"]) for r in logs.parse(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert got == {k: v for k, v in lines.items() if v}
    one = logs.parse(spark.createDataFrame([("Script mill_a, OID: 1f, Tag: Door, ERROR: A, B",)], "value string")).first()
    assert (one["tag"], one["message"], one["severity"], one["ts"]) == ("Door", "ERROR: A, B", "error", None)
