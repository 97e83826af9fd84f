"""Columnar shredding of nested records, and flat tables from the level sequences.

A record is a tree of structs. Every leaf path (labels without list indexes) is a column; so is the presence of each
struct. A column of a record is three sequences: repetition levels (which list went on: 0 a new record), definition levels
(how much of the path exists) and values. Flat tables are rebuilt from these sequences alone: the repetition levels count
the list indexes, the definition levels tell which rows exist, and the labels give path and parent path.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = "record bigint, labels array<string>, lists array<boolean>, leaf string, type string, rep array<smallint>, def array<smallint>, vals array<string>"
_LEVELS_ARROW = pa.schema([
    ("record", pa.int64()), ("labels", pa.list_(pa.string())), ("lists", pa.list_(pa.bool_())), ("leaf", pa.string()), ("type", pa.string()),
    ("rep", pa.list_(pa.int16())), ("def", pa.list_(pa.int16())), ("vals", pa.list_(pa.string())),
])


class _Group:
    """A struct type met in a record: its columns (leaves by label and type) and its nested groups (by label and kind)."""

    __slots__ = ("labels", "lists", "top", "reps", "leaves", "groups", "rep", "defs")

    def __init__(self, labels: tuple[str, ...], lists: tuple[bool, ...]):
        self.labels, self.lists = labels, lists
        self.reps = sum(lists)
        self.top = len(lists)  # each step is defined or not; an empty list is a step that isn't
        self.leaves: dict[tuple[str, str], tuple[list[int], list[int], list]] = {}
        self.groups: dict[tuple[str, bool], _Group] = {}
        self.rep: list[int] = []
        self.defs: list[int] = []


def _fields(node: dict):
    for label, field in node.items():
        if label.startswith("__") or not isinstance(field, dict) or not isinstance(kind := field.get("type"), str):
            continue
        yield label, kind, field.get("value")


def _items(kind: str, value) -> tuple[bool, list] | None:
    """(is it a list, its structs; None where an item isn't one), or None for a leaf."""
    kind = kind.lower()
    if kind == "struct":
        return False, [value] if isinstance(value, dict) else []
    if kind == "list":
        return True, [x if isinstance(x, dict) else None for x in value] if isinstance(value, list) else [value] if isinstance(value, dict) else []
    return None


def _columns(node: dict, group: _Group) -> None:
    """First pass: the columns that a record has."""
    todo = [(node, group)]
    while todo:
        node, group = todo.pop()
        for label, kind, value in _fields(node):
            nested = _items(kind, value)
            if nested is None:
                group.leaves.setdefault((label, kind.lower()), ([], [], []))
                continue
            many, structs = nested
            inner = group.groups.get((label, many))
            if inner is None:
                inner = group.groups[label, many] = _Group((*group.labels, label), (*group.lists, many))
            todo += [(x, inner) for x in structs if x is not None]


def _write(root: dict, top: _Group) -> None:
    """Second pass: one entry in each column of ``top`` and below for each of its occurrences, also for the absent ones."""
    todo: list[tuple[dict | None, _Group, int, int]] = [(root, top, 0, 0)]
    while todo:
        node, group, rep, defined = todo.pop()
        group.rep.append(rep)
        group.defs.append(defined)
        fields = {}
        nested: dict[tuple[str, bool], list] = {}
        if node is not None:
            for label, kind, value in _fields(node):
                found = _items(kind, value)
                if found is None:
                    fields[label, kind.lower()] = value
                else:
                    nested[label, found[0]] = found[1]
        for key, (reps, defs, values) in group.leaves.items():
            reps.append(rep)
            if key in fields:
                value = fields[key]
                defs.append(defined + 1)
                values.append(value if isinstance(value, str) else None if value is None else json.dumps(value, ensure_ascii=False, sort_keys=True))
            else:
                defs.append(defined)
                values.append(None)
        below: list[tuple[dict | None, _Group, int, int]] = []
        for (label, many), inner in group.groups.items():
            structs = nested.get((label, many))
            if not structs:
                below.append((None, inner, rep, defined))
            else:
                # an item that is no struct takes an index and defines nothing
                below += [(x, inner, rep if i == 0 else inner.reps, defined + 1 if x is not None else defined) for i, x in enumerate(structs)]
        todo += reversed(below)  # in order of occurrence


def _shred(body: str) -> _Group:
    def refuse(x):
        raise ValueError(x)

    root = json.loads(body.strip().strip("\ufeff").strip(), parse_constant=refuse)
    if not isinstance(root, dict):
        raise ValueError("no object")
    group = _Group((), ())
    _columns(root, group)
    _write(root, group)
    return group


def shred(records: DataFrame, id_col: str, body_col: str) -> DataFrame:
    """The columns (schema LEVELS) of every record whose body is whole JSON with an object at its root.

    leaf '' is the presence of the struct at ``labels``. Records that are NULL, empty, cut off, no object or nested deeper
    than the JSON parser goes have no columns (see ``rejected``). Byte order marks and blanks around a body do no harm.
    Of keys repeated in an object the last counts. Every record is shredded by itself; nothing is shuffled.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for record, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    todo = [_shred(body)]
                except (ValueError, RecursionError, AttributeError):
                    continue
                while todo:
                    g = todo.pop()
                    rows.append((record, g.labels, g.lists, "", "struct", g.rep, g.defs, None))
                    rows += [(record, g.labels, g.lists, label, kind, *seq) for (label, kind), seq in g.leaves.items()]
                    todo += g.groups.values()
                if len(rows) > 20_000:
                    yield _batch(rows, _LEVELS_ARROW)
                    rows = []
            if rows:
                yield _batch(rows, _LEVELS_ARROW)

    return records.select(F.col(id_col).cast("bigint"), F.col(body_col).cast("string")).mapInArrow(run, LEVELS)


def rejected(records: DataFrame, id_col: str, body_col: str) -> DataFrame:
    """(record, why): the records that shred() leaves out; why is null, empty, not_json, not_object or
    too_deep (a leaf whose value can't be written again as JSON)."""
    def why(body):
        if body is None:
            return "null"
        text = body.strip().strip("\ufeff").strip()
        if not text:
            return "empty"
        try:
            if not isinstance(json.loads(text, parse_constant=lambda x: 1 / 0), dict):
                return "not_object"
        except (ValueError, RecursionError, ZeroDivisionError):
            return "not_json"
        if text.count("{") + text.count("[") < 500:  # not deep
            return None
        try:
            _shred(text)
        except RecursionError:
            return "too_deep"
        return None

    def run(batches):
        for b in batches:
            reasons = [why(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(reasons, pa.string())], ["record", "why"])

    return records.select(F.col(id_col).cast("bigint").alias("record"), F.col(body_col)).mapInArrow(run, "record bigint, why string").where("why IS NOT NULL")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _paths(labels: list[str], lists: list[bool], rep: list[int], defs: list[int], need: int) -> Iterator[tuple[int, str, str]]:
    """(entry, path, parent path) of the struct at ``labels`` for each entry with its whole path defined."""
    depth = [i for i, many in enumerate(lists) if many]
    index = [0] * len(depth)
    for e, (r, d) in enumerate(zip(rep, defs, strict=True)):
        if r:
            index[r - 1] += 1
        index[r:] = [0] * (len(depth) - r)
        if d < need:
            continue
        steps = list(labels)
        for at, i in zip(depth, index, strict=True):
            steps[at] += f"[{i}]"
        yield e, "/".join(steps), "/".join(steps[:-1])


def struct_table(levels: DataFrame) -> DataFrame:
    """(record, path, parent_path): every struct below the root, from the level sequences of the presence columns."""
    schema = pa.schema([("record", pa.int64()), ("path", pa.string()), ("parent_path", pa.string())])

    def run(batches):
        for b in batches:
            rows = []
            for record, labels, lists, rep, defs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows += [(record, path, parent) for _, path, parent in _paths(labels, lists, rep, defs, len(labels))]
            yield _batch(rows, schema)

    return levels.where((F.col("leaf") == "") & (F.size("labels") > 0)).select("record", "labels", "lists", "rep", "def").mapInArrow(run, "record bigint, path string, parent_path string")


def field_table(levels: DataFrame) -> DataFrame:
    """(record, path, parent_path, label, type, value): every leaf, from the level sequences of its column; texts of other
    JSON kinds (numbers, maps of texts) are their JSON."""
    schema = pa.schema([("record", pa.int64()), *((x, pa.string()) for x in ("path", "parent_path", "label", "type", "value"))])

    def run(batches):
        for b in batches:
            rows = []
            for record, labels, lists, leaf, kind, rep, defs, values in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for e, parent, _ in _paths(labels, lists, rep, defs, len(labels) + 1):
                    rows.append((record, f"{parent}/{leaf}" if parent else leaf, parent, leaf, kind, values[e]))
            yield _batch(rows, schema)

    return levels.where(F.col("leaf") != "").mapInArrow(run, "record bigint, path string, parent_path string, label string, type string, value string")
