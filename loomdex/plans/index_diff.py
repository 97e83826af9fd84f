"""Problem 1: two indexes of the same modules, compared file by file and field by field."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions.numbers import as_double, fits, is_integer_type, plain_digits
from loomdex.operators.cell_diff import BOTH, LEFT, RIGHT, matched_keys, uncancelled, unpivot
from loomdex.plans.session import table


def _keyed(files: DataFrame, side: str) -> DataFrame:
    """id, key and compared fields of one side; a file without source or path matches nothing but stays on its side."""
    rel = F.regexp_replace(F.lower(F.translate("relpath", "\\", "/")), r"^(\./)+", "")
    lone = F.when(F.col("source_id").isNull() | F.col("relpath").isNull(), F.concat(F.lit(side), F.col("id").cast("string")))
    return files.select("id", "source_id", rel.alias("rel"), lone.alias("lone"), F.lower("sha256").alias("sha256"), "size", "status")


KEY = ["source_id", "rel", "lone"]


def file_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """(file_id, col, side): unmatched files with an empty col, matched ones with each differing column."""
    compared = ("sha256", "size", "status")
    cells = [unpivot(f, KEY, {"": F.lit("")} | {c: F.col(c) for c in compared}, ["id"]) for f in (left, right)]
    rest = uncancelled(*cells, [*KEY, "field", "value"], ["id"])
    fields = rest.groupBy(*KEY, "field").agg(F.bit_or("side").alias("side"), F.min("id_l").alias("l"), F.min("id_r").alias("r"))
    found = fields.where((F.col("field") == "") | (F.col("side") == BOTH))
    name = F.when(F.col("side") == LEFT, "left_only").when(F.col("side") == RIGHT, "right_only").otherwise("differs")
    return found.select(F.coalesce("l", "r").alias("file_id"), F.col("field").alias("col"), name.alias("side"))


def _leaf_cells(fields: DataFrame, file_id) -> DataFrame:
    kind = F.lower("type")
    return fields.select(file_id.alias("file_id"), "path", kind.alias("kind"), "value")


def field_differences(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """(file_id, path, col, side) of the leaves of matched files.

    A leaf is one cell: key (file, path), value (type, text). Cells equal on both sides cancel in the first grouping.
    What is left is grouped by (file, path) and judged; numbers are compared only there.
    """
    right_named = right.join(pairs, right["file_id"] == pairs["right_id"]).select(F.col("left_id").alias("file_id"), "path", "type", "value")
    rest = uncancelled(_leaf_cells(left, F.col("file_id")), _leaf_cells(right_named, F.col("file_id")), ["file_id", "path", "kind", "value"])
    fit = fits(F.col("kind"), F.col("value"))
    whole = is_integer_type(F.col("kind"))
    rest = rest.select(
        "file_id", "path", "side",
        F.struct("kind", "value", F.when(fit & whole, plain_digits(F.col("value"))).alias("digits"), F.when(fit, as_double(F.col("value"))).alias("real")).alias("cell"),
    )
    at = lambda side: F.when(F.col("side") == side, F.col("cell"))
    cells = rest.groupBy("file_id", "path").agg(
        F.bit_or("side").alias("side"),
        F.min(at(LEFT)).alias("l"), F.max(at(LEFT)).alias("l2"), F.min(at(RIGHT)).alias("r"), F.max(at(RIGHT)).alias("r2"),
    )
    # leaves of files without a match are all left over on the left side; they belong to the file, not here
    cells = cells.join(pairs.select(F.col("left_id").alias("file_id")), "file_id", "left_semi")
    l, r = F.col("l"), F.col("r")
    exact = ~l["value"].eqNullSafe(r["value"])
    numbers = F.when(l["digits"].isNotNull() & r["digits"].isNotNull(), l["digits"] != r["digits"]).otherwise(l["real"] != r["real"])
    value_differs = F.when(l["real"].isNotNull() & r["real"].isNotNull(), numbers).otherwise(exact)
    # more than one value of a cell on one side, none of which the other side has
    value_differs = value_differs | ~l["value"].eqNullSafe(F.col("l2")["value"]) | ~r["value"].eqNullSafe(F.col("r2")["value"])
    kind_differs = ~l["kind"].eqNullSafe(r["kind"])
    both = F.col("side") == BOTH
    found = F.array(
        F.when(F.col("side") == LEFT, F.struct(F.lit("").alias("col"), F.lit("left_only").alias("side"))),
        F.when(F.col("side") == RIGHT, F.struct(F.lit("").alias("col"), F.lit("right_only").alias("side"))),
        F.when(both & kind_differs, F.struct(F.lit("type").alias("col"), F.lit("differs").alias("side"))),
        F.when(both & value_differs, F.struct(F.lit("value").alias("col"), F.lit("differs").alias("side"))),
    )
    return cells.select("file_id", "path", F.explode(F.array_compact(found)).alias("f")).select("file_id", "path", "f.col", "f.side")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file and field on which the two indexes disagree; see the operators for nulls, repeats and empty tables."""
    left, right = _keyed(table(spark, sf_dir, "files"), "l"), _keyed(table(spark, sf_dir, "files_mirror"), "r")
    pairs = matched_keys(left, right, KEY, "id")
    files = file_differences(left, right).select(F.lit("files").alias("tbl"), "file_id", F.lit("").alias("path"), "col", "side")
    fields = field_differences(table(spark, sf_dir, "gff_fields"), table(spark, sf_dir, "gff_fields_mirror"), pairs)
    return files.unionByName(fields.select(F.lit("gff_fields").alias("tbl"), "file_id", "path", "col", "side"))
