"""Writers of the formats that ``formats`` reads: rows in, bytes out. What is written reads back as it was."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.sources.formats import CODEPAGE, FIELD_TYPES, NO_STRREF, PACKING, RESOURCE_TYPES

_STEP = re.compile(r"([^/\[\]]+)(?:\[(\d+)\])?")
TYPE_IDS = {ext: n for n, ext in RESOURCE_TYPES.items()}
#: Leaves that one written tree holds at most; more of one file go to further parts.
PART = 20_000


def _bytes(text: str) -> bytes:
    return text.encode(CODEPAGE, "replace")


class _Node:
    """A struct to be written: leaves (label, type, value) and what is nested under a label."""

    def __init__(self):
        self.leaves: list[tuple[str, str, str]] = []
        self.structs: dict[str, _Node] = {}
        self.lists: dict[str, dict[int, _Node]] = {}


def tree_bytes(leaves: Iterable[tuple[str, str, str]], kind: bytes = b"GFF ") -> bytes:
    """A tree file (GFF V3.2) of (path, type, value) leaves. List items are numbered anew, in the order of their numbers."""
    root = _Node()
    for path, type_, value in leaves:
        node = root
        steps = _STEP.findall(path)
        for label, number in steps[:-1]:
            node = node.lists.setdefault(label, {}).setdefault(int(number), _Node()) if number else node.structs.setdefault(label, _Node())
        node.leaves.append((steps[-1][0], type_, value))
    nodes, fields, labels, blob, numbers, lists = [root], [], {}, bytearray(), [], []
    structs: list[tuple[int, int, int]] = []

    def label(name: str) -> int:
        return labels.setdefault(name[:16], len(labels))

    def stored(raw: bytes) -> int:
        at = len(blob)
        blob.extend(raw)
        return at

    at = 0
    while at < len(nodes):
        node, own = nodes[at], []
        for name, type_, value in node.leaves:
            form = PACKING.get(type_)
            if form:
                parts = [float(x) if form[-1] in "fd" else int(x) for x in value.split()]
                raw = struct.pack(f"<{form}", *parts)
                word = struct.unpack("<I", raw.ljust(4, b"\0"))[0] if len(raw) <= 4 else stored(raw)
            elif type_ == "resref":
                word = stored(struct.pack("<B", len(_bytes(value)[:255])) + _bytes(value)[:255])
            elif type_ == "cexolocstring":
                body = struct.pack("<4I", NO_STRREF, 1, 0, len(_bytes(value))) + _bytes(value)
                word = stored(struct.pack("<I", len(body)) + body)
            else:
                raw = bytes.fromhex(value) if type_ == "void" else _bytes(value)
                word = stored(struct.pack("<I", len(raw)) + raw)
            own.append((FIELD_TYPES.index(type_), label(name), word))
        for name, inner in node.structs.items():
            own.append((FIELD_TYPES.index("struct"), label(name), len(nodes)))
            nodes.append(inner)
        for name, items in node.lists.items():
            own.append((FIELD_TYPES.index("list"), label(name), 4 * len(lists)))
            lists += [len(items), *range(len(nodes), len(nodes) + len(items))]
            nodes += [items[k] for k in sorted(items)]
        structs.append((0xFFFFFFFF if at == 0 else at, len(fields) if len(own) == 1 else 4 * len(numbers), len(own)))
        if len(own) != 1:
            numbers += range(len(fields), len(fields) + len(own))
        fields += own
        at += 1
    blocks = [
        b"".join(struct.pack("<3I", *s) for s in structs), b"".join(struct.pack("<3I", *f) for f in fields), b"".join(_bytes(x).ljust(16, b"\0") for x in labels), bytes(blob),
        struct.pack(f"<{len(numbers)}I", *numbers), struct.pack(f"<{len(lists)}I", *lists),
    ]
    head, start = [], 56
    for b, width in zip(blocks, (12, 12, 16, 1, 1, 1), strict=True):
        head += [start, len(b) // width]
        start += len(b)
    return kind + b"V3.2" + struct.pack("<12I", *head) + b"".join(blocks)


def archive_bytes(entries: Iterable[tuple[str, str, bytes]], kind: bytes = b"ERF ") -> bytes:
    """An archive (ERF V1.0) of (resref, ext, body) entries."""
    entries = list(entries)
    names = b"".join(struct.pack("<16sIHH", _bytes(name)[:16], k, TYPE_IDS.get(ext, 0), 0) for k, (name, ext, _) in enumerate(entries))
    places, at = [], 160 + len(names) + 8 * len(entries)
    for _, _, body in entries:
        places.append(struct.pack("<2I", at, len(body)))
        at += len(body)
    head = kind + b"V1.0" + struct.pack("<9I", 0, 0, len(entries), 160, 160, 160 + len(names), 0, 0, NO_STRREF)
    return head.ljust(160, b"\0") + names + b"".join(places) + b"".join(body for _, _, body in entries)


def string_table_bytes(texts: dict[int, str], language: int = 0) -> bytes:
    """A string table (TLK V3.0); numbers without a text have none."""
    count = max(texts, default=-1) + 1
    rows, body = [], bytearray()
    for k in range(count):
        raw = _bytes(texts[k]) if k in texts else b""
        rows.append(struct.pack("<I16s4If", 1 if k in texts else 0, b"", 0, 0, len(body), len(raw), 0.0))
        body += raw
    return b"TLK V3.0" + struct.pack("<3I", language, count, 20 + 40 * count) + b"".join(rows) + bytes(body)


def table_text(columns: list[str], rows: Iterable[tuple[str, list[str | None]]]) -> str:
    """A 2DA table of (label, values) rows; NULLs are ****, values with spaces are quoted."""
    def cell(v: str | None) -> str:
        return "****" if v is None or v == "" else f'"{v}"' if re.search(r"\s", v) else v

    return "\n".join(["2DA V2.0", "", " ".join(map(cell, columns)), *(" ".join([cell(label), *map(cell, values)]) for label, values in rows), ""])


def pack_trees(leaves: DataFrame, file: str = "file_id") -> DataFrame:
    """(path, content): the (file, path, type, value) leaves as tree files. path is <file>/<part>: the leaves of one file are dealt
    out by the first step of their path, so that no task holds more of a large file than its share.

    Rows with a NULL are left out; the task of a part gets its rows in order and gives a tree out every PART leaves.
    """
    d = leaves.select(F.col(file).cast("string").alias("file"), "path", "type", "value").dropna()
    d = d.withColumn("part", F.pmod(F.xxhash64(F.regexp_extract("path", r"^[^/]*", 0)), F.lit(16)))
    d = d.repartition("file", "part").sortWithinPartitions("file", "part", "path")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str, str]] = []
        of, number = None, 0

        def give() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{of[0]}/{of[1]}.{number}"]), pa.array([tree_bytes(held)], pa.binary())], ["path", "content"])

        for batch in batches:
            for f, p, t, v, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if of != (f, k) or len(held) >= PART:
                    if held:
                        yield give()
                    held, number = [], 0 if of != (f, k) else number + 1
                    of = (f, k)
                held.append((p, t, v))
        if held:
            yield give()

    return d.mapInArrow(pack, "path string, content binary")
