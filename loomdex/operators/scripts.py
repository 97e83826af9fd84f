"""Script sources taken apart: a lexer that knows strings, comments and nesting, and what follows from its tokens."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.operators import graph

#: One pass over the text: each alternative starts with another character, so no position is tried twice.
_TOKEN = re.compile(r'//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:[^"\\\n]|\\.)*"?|#include[ \t]*"[^"\n]*"|[A-Za-z_]\w*|0[xX][0-9A-Fa-f]+|[0-9][0-9.]*|\s+|.', re.S)
_TYPES = frozenset({"void", "int", "float", "string", "object", "vector", "location", "effect", "event", "itemproperty", "talent", "struct", "json", "action"})
_WORDS = frozenset({"if", "else", "while", "for", "do", "switch", "case", "return", "break", "continue", "default", "const"})

LITERALS = "script bigint, line int, func string, place int, literal string, joined boolean"
_LITERALS = pa.schema([("script", pa.int64()), ("line", pa.int32()), ("func", pa.string()), ("place", pa.int32()), ("literal", pa.string()), ("joined", pa.bool_())])
FACTS = "script bigint, has_main boolean, lines int, includes array<string>, functions array<string>, calls map<string,int>, norm_hash string, header string"
_FACTS = pa.schema([
    ("script", pa.int64()), ("has_main", pa.bool_()), ("lines", pa.int32()), ("includes", pa.list_(pa.string())), ("functions", pa.list_(pa.string())),
    ("calls", pa.map_(pa.string(), pa.int32())), ("norm_hash", pa.string()), ("header", pa.string()),
])


def lex(source: str) -> Iterator[tuple[int, str, str]]:
    """(line, kind, text): kinds are comment, text, include, word, number and sign; white space is left out."""
    line = 1
    for m in _TOKEN.finditer(source):
        t = m.group()
        c = t[0]
        kind = ("comment" if t[:2] in ("//", "/*") else "text" if c == '"' else "include" if t.startswith("#include") else "word" if c.isalpha() or c == "_"
                else "number" if c.isdigit() else "space" if t.isspace() else "sign")
        if kind != "space":
            yield line, kind, t
        line += t.count("\n")


def literals(source: str) -> Iterator[tuple[int, str | None, int, str, bool]]:
    """(line, function called with it or None, place among its arguments from 0, literal, is it joined with something else)."""
    tokens = [t for t in lex(source) if t[1] != "comment"]
    calls: list[list] = []  # open brackets: [function or None, place]
    for i, (line, kind, t) in enumerate(tokens):
        if t == "(":
            before = tokens[i - 1] if i else (0, "", "")
            calls.append([before[2] if before[1] == "word" and before[2] not in _WORDS else None, 0])
        elif t == ")" and calls:
            calls.pop()
        elif t == "," and calls:
            calls[-1][1] += 1
        elif kind == "text":
            near = {tokens[i - 1][2] if i else "", tokens[i + 1][2] if i + 1 < len(tokens) else ""}
            yield line, calls[-1][0] if calls else None, calls[-1][1] if calls else 0, t[1:].removesuffix('"'), "+" in near


def facts(source: str) -> tuple:
    """has_main, lines, includes, functions defined, calls by name, hash of the code without comments and spaces, header comment."""
    tokens = list(lex(source))
    code = [t for t in tokens if t[1] != "comment"]
    defined, calls, depth = [], {}, 0
    for i, (_, kind, t) in enumerate(code):
        depth += (t == "{") - (t == "}")
        if kind == "word" and i + 1 < len(code) and code[i + 1][2] == "(" and t not in _WORDS:
            if depth == 0 and i and (code[i - 1][2] in _TYPES or code[i - 1][1] == "word"):
                close, open_ = i + 2, 1
                while close < len(code) and open_:
                    open_ += (code[close][2] == "(") - (code[close][2] == ")")
                    close += 1
                if close < len(code) and code[close][2] == "{":
                    defined.append(t)
            else:
                calls[t] = calls.get(t, 0) + 1
    header = []
    for line, kind, t in tokens:
        if kind != "comment":
            break
        header.append(t.strip("/* \t\n").strip())
    includes = [t.split('"')[1].lower() for _, kind, t in code if kind == "include"]
    return ("main" in defined, source.count("\n") + 1, list(dict.fromkeys(includes)), defined, sorted(calls.items()), hashlib.sha1(" ".join(t for _, _, t in code).encode()).hexdigest(), "\n".join(h for h in header if h))


def _run(sources: DataFrame, id_col: str, text: str, make, schema: pa.Schema, ddl: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *r) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t is not None for r in make(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return sources.select(F.col(id_col).cast("bigint"), F.col(text).cast("string")).mapInArrow(run, ddl)


def script_literals(sources: DataFrame, id_col: str, text: str) -> DataFrame:
    """LITERALS of every source; NULL sources have none."""
    return _run(sources, id_col, text, literals, _LITERALS, LITERALS)


def script_facts(sources: DataFrame, id_col: str, text: str) -> DataFrame:
    """FACTS of every source that isn't NULL."""
    return _run(sources, id_col, text, lambda t: [facts(t)], _FACTS, FACTS)


def include_load(declared: DataFrame, includes: DataFrame) -> DataFrame:
    """(script, load): identifiers a script declares itself and through all it includes, each file once.

    ``declared``: (script, n); ``includes``: (src, dst).
    """
    pairs = graph.closure(includes).select(F.col("start").alias("script"), F.col("node").alias("part")).where("script <> part")
    own = declared.select("script", F.col("script").alias("part"))
    n = declared.select(F.col("script").alias("part"), "n")
    return own.unionByName(pairs).distinct().join(n, "part").groupBy("script").agg(F.sum("n").alias("load"))


#: What kind of thing the text argument of an engine function names, by function and place.
NAMED_BY = {
    ("ExecuteScript", 0): "script", ("SetEventScript", 2): "script", ("CreateItemOnObject", 0): "item", ("CreateObject", 1): "blueprint", ("GetObjectByTag", 0): "tag",
    ("GetWaypointByTag", 0): "tag", ("GetNearestObjectByTag", 0): "tag", ("GetItemPossessedBy", 1): "tag", ("ActionStartConversation", 1): "conversation",
    ("AddJournalQuestEntry", 0): "quest", ("SetLocalInt", 1): "variable", ("GetLocalInt", 1): "variable", ("SetLocalString", 1): "variable",
    ("GetLocalString", 1): "variable", ("Get2DAString", 0): "table",
}


def typed_literals(literals: DataFrame, names: DataFrame) -> DataFrame:
    """``literals`` with ``kind`` and ``certain``: by the function they are passed to, else by a known name (kind, name) that they
    equal, letter case aside; of several kinds the least. Others are left out."""
    table = F.create_map(*[x for (f, n), k in NAMED_BY.items() for x in (F.lit(f"{f}/{n}"), F.lit(k))])
    known = names.groupBy(F.lower("name").alias("__name")).agg(F.min("kind").alias("__kind"))
    typed = literals.withColumn("__typed", F.try_element_at(table, F.concat_ws("/", "func", F.col("place").cast("string"))))
    j = typed.join(known, F.lower("literal") == F.col("__name"), "left")
    return j.withColumn("kind", F.coalesce("__typed", "__kind")).withColumn("certain", F.col("__typed").isNotNull()).where("kind IS NOT NULL").drop("__typed", "__name", "__kind")
