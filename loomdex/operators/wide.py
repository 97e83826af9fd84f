"""Entity-attribute-value rows into one wide row per entity, with typed columns.

Entities are hash-bucketed by a shuffle and sorted within the bucket. Each bucket is read as Arrow batches: entities and
attributes are dictionary-encoded to row and column numbers, the values of each type are scattered into one numpy matrix by
(row, column), and the matrices leave as Arrow columns. The rows of a hot entity are combined to one per attribute before
they are bucketed, so no entity is larger than its attributes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.functions.numbers import as_double, fits, is_blank, is_integer_type, is_numeric_type, plain_digits

#: Widest table made; further attributes go to further tables (``wide_tables``). The dictionary of attributes is held by the driver.
MAX_COLUMNS = 4096
#: Cells gathered, and cells of the matrix (entities times attributes) made at a time.
BLOCK_CELLS, BLOCK_AREA = 200_000, 4_000_000


@dataclass(frozen=True)
class Attribute:
    """A column of the wide table: the attribute's folded name, the column's name, and bigint, double or string."""

    fold: str
    column: str
    kind: str


def attributes(eav: DataFrame, label: str = "label", kind: str = "type", reserved: tuple[str, ...] = ()) -> list[Attribute]:
    """The dictionary of all attributes, from all rows, in the order of their folded names.

    Labels that differ in letter case are one attribute, named by its most frequent spelling (ties: the least). Whole
    numbers only give bigint, numbers double, anything else (also dword64, which bigint can't hold) string. A name that
    collides with a reserved one gets a trailing underscore.
    """
    k = F.lower(kind)
    spelled = eav.where(F.col(label).isNotNull()).groupBy(label).agg(
        F.count("*").alias("n"),
        F.bit_or(F.when(is_integer_type(k) & (k != "dword64"), 1).when(is_numeric_type(k) & (k != "dword64"), 2).otherwise(4)).alias("kinds"),
    )
    top = spelled.groupBy(F.lower(label).alias("fold")).agg(
        F.sum("n").alias("n"), F.bit_or("kinds").alias("kinds"), F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias("column")
    )
    rows = top.collect()  # a row per attribute: the schema of the result
    used, out = {x.lower() for x in reserved}, []
    for r in sorted(rows, key=lambda r: r["fold"]):
        name = re.sub(r"[\s`.]", "_", r["column"]) or "_"
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(Attribute(r["fold"], name, "bigint" if r["kinds"] == 1 else "double" if r["kinds"] in (2, 3) else "string"))
    return out


def _scatter(names: pa.Array, codes: dict[str, int], dictionary: list[Attribute], block: pa.Table, schema: pa.Schema) -> pa.RecordBatch:
    entity = block["entity"].to_numpy()
    starts = np.flatnonzero(np.r_[True, entity[1:] != entity[:-1]])
    rows = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(entity)]))
    folded = names.dictionary_encode()
    code = np.array([codes.get(x, -1) for x in folded.dictionary.to_pylist()], np.int64)[folded.indices.to_numpy()]
    n = len(starts)
    kinds = np.array([{"bigint": 0, "double": 1, "string": 2}[a.kind] for a in dictionary] or [0])
    slots = np.zeros(len(dictionary), np.int64)  # place of an attribute among those of its type
    for k in range(3):
        slots[kinds[: len(dictionary)] == k] = np.arange(int((kinds[: len(dictionary)] == k).sum()))
    sizes = [int((kinds[: len(dictionary)] == k).sum()) for k in range(3)]
    values = [np.zeros((n, sizes[0]), np.int64), np.zeros((n, sizes[1]), np.float64), np.full((n, sizes[2]), None, object)]
    known = [np.zeros((n, sizes[k]), bool) for k in range(2)]
    ok = code >= 0
    for k, column in enumerate(("whole", "real", "value")):
        here = ok & (kinds[np.where(ok, code, 0)] == k)
        if k < 2:
            here &= block[column].combine_chunks().is_valid().to_numpy(zero_copy_only=False)
        at = np.flatnonzero(here)
        if not len(at):
            continue
        cells = block[column].combine_chunks().take(pa.array(at))
        values[k][rows[at], slots[code[at]]] = cells.to_numpy(zero_copy_only=False)
        if k < 2:
            known[k][rows[at], slots[code[at]]] = True
    out = [pa.array(entity[starts])]
    for a, k, s in zip(dictionary, kinds, slots, strict=False):
        out.append(pa.array(values[k][:, s], schema.field(len(out)).type, mask=None if k == 2 else ~known[k][:, s]))
    labels, texts = block["misfits"].combine_chunks(), block["value"].combine_chunks()
    # what does not fit its type, and attributes beyond the dictionary: lists per entity, by offsets over the sorted rows
    sizes_of = pa.compute.fill_null(pa.compute.list_value_length(labels), 0).to_numpy()
    ends = np.r_[0, np.cumsum(sizes_of)]
    bounds = np.r_[starts, len(entity)]
    out.append(pa.ListArray.from_arrays(pa.array(ends[bounds], pa.int32()), labels.flatten()))
    away = np.flatnonzero(~ok & names.is_valid().to_numpy(zero_copy_only=False))
    counts = np.bincount(rows[away], minlength=n)
    out.append(pa.MapArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), names.take(pa.array(away)), texts.take(pa.array(away))))
    return pa.RecordBatch.from_arrays([x.cast(f.type) if x.type != f.type else x for x, f in zip(out, schema, strict=True)], schema=schema)


def widen(eav: DataFrame, dictionary: list[Attribute], entity: str = "file_id", label: str = "label", kind: str = "type", value: str = "value") -> DataFrame:
    """One row per entity: ``entity``, a typed column per attribute, ``misfits`` and ``rest``.

    ``misfits`` lists the labels, as written, of numeric cells that are neither NULL nor blank and don't fit their own type;
    such a cell is NULL in a number column (as is a blank one) and keeps its text in a string column. Of several values of
    one attribute the one that fits comes first, then the least text. Rows without entity or label are left out: they
    belong to no cell. Attributes that the dictionary lacks are kept, folded, in the map ``rest``. An empty input gives an
    empty table; extra columns are dropped.
    """
    k, v = F.lower(kind), F.col(value)
    fit = fits(k, v)
    bad = is_numeric_type(k) & ~is_blank(v) & ~fit
    cells = eav.where(F.col(entity).isNotNull() & F.col(label).isNotNull()).select(
        F.col(entity).cast("bigint").alias("entity"), F.lower(label).alias("fold"), F.col(label).alias("label"), bad.alias("bad"),
        F.struct((~fit).alias("late"), v.isNull().alias("none"), F.col(value).alias("value"),
                 F.when(fit, plain_digits(v).try_cast("bigint")).alias("whole"), F.when(fit, as_double(v)).alias("real")).alias("cell"),
    )
    # one row per cell, combined before the shuffle: repeats, spellings and conflicting values of a hot entity never pile up
    cells = cells.groupBy("entity", "fold").agg(F.min("cell").alias("cell"), F.array_sort(F.collect_set(F.when(F.col("bad"), F.col("label")))).alias("misfits"))
    cells = cells.select("entity", "fold", "cell.value", "cell.whole", "cell.real", "misfits")
    bucketed = cells.repartition("entity").sortWithinPartitions("entity", "fold")
    fields = [pa.field(entity, pa.int64())]
    arrow = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
    fields += [pa.field(a.column, arrow[a.kind]) for a in dictionary]
    fields += [pa.field("misfits", pa.list_(pa.string())), pa.field("rest", pa.map_(pa.string(), pa.string()))]
    schema = pa.schema(fields)
    codes = {a.fold: i for i, a in enumerate(dictionary)}

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        held, size = [], 0

        def emit(last: bool):
            nonlocal held, size
            begin = 0
            block = pa.Table.from_batches(held)
            ids = block["entity"].to_numpy()
            end = len(ids) if last else int(np.searchsorted(ids, ids[-1], "left"))  # the last entity may go on
            held, size = block.slice(end).to_batches(), len(ids) - end
            starts = np.flatnonzero(np.r_[True, ids[1:end] != ids[: end - 1]]) if end else []
            for cut in np.r_[starts[:: max(1, BLOCK_AREA // max(1, len(dictionary)))], end] if end else []:
                if cut:
                    done = block.slice(begin, cut - begin).combine_chunks()
                    yield _scatter(done["fold"].combine_chunks(), codes, dictionary, done, schema)
                begin = cut

        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.num_rows
            if size >= BLOCK_CELLS:
                yield from emit(False)
        if size:
            yield from emit(True)

    types = {"bigint": "bigint", "double": "double", "string": "string"}
    ddl = ", ".join([f"`{entity}` bigint", *(f"`{a.column}` {types[a.kind]}" for a in dictionary), "misfits array<string>", "rest map<string,string>"])
    return bucketed.mapInArrow(buckets, ddl)


def wide_tables(eav: DataFrame, dictionary: list[Attribute], entity: str = "file_id", label: str = "label", kind: str = "type", value: str = "value", columns: int = MAX_COLUMNS) -> list[DataFrame]:
    """``widen`` as several tables of at most ``columns`` attributes each, all typed, with one row per entity that has any of them."""
    parts = [dictionary[i : i + columns] for i in range(0, len(dictionary), columns)] or [[]]
    if len(parts) == 1:
        return [widen(eav, dictionary, entity, label, kind, value)]
    fold = F.lower(label)
    return [widen(eav.where(fold.between(p[0].fold, p[-1].fold)), p, entity, label, kind, value) for p in parts]
