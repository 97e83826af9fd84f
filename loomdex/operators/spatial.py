"""Positions in areas, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.plans.session import cut


def inside(x: Column, y: Column, polygon: Column) -> Column:
    """Whether a point lies in a polygon (array of structs x, y): an odd number of its sides pass to the right. False for fewer
    than three corners; NULL points or polygons give NULL."""
    n = F.size(polygon)
    sides = F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)

    def crosses(i: Column) -> Column:
        a, b = F.get(polygon, i), F.get(polygon, F.pmod(i + 1, F.greatest(n, F.lit(1))))
        straddles = (a["y"] > y) != (b["y"] > y)
        at = a["x"] + (y - a["y"]) / F.when(b["y"] == a["y"], F.lit(None)).otherwise(b["y"] - a["y"]) * (b["x"] - a["x"])
        return F.coalesce(straddles & (x < at), F.lit(False))

    odd = F.pmod(F.size(F.filter(sides, crosses)), F.lit(2)) == 1
    return F.when(x.isNull() | y.isNull() | polygon.isNull(), F.lit(None)).otherwise((n >= 3) & odd)


def border_side(x: Column, y: Column, width: Column, height: Column, margin: float) -> Column:
    """The nearest border, west before east before south before north on ties; NULL beyond ``margin``."""
    gaps = {"west": x, "east": width - x, "south": y, "north": height - y}
    least = F.least(*gaps.values())
    out = F.lit("north")
    for name in ("south", "east", "west"):
        out = F.when(gaps[name] == least, name).otherwise(out)
    return F.when(least <= margin, out)


def nearest(points: DataFrame, others: DataFrame, group: list[str], id_col: str, other_id: str, cell: float = 1.0) -> DataFrame:
    """(group, id, other, distance): for each point the nearest of ``others`` in its group; ties: least id.

    Both sides have x and y; rows without are left out, and so are points of groups without others. Points look into the
    nine squares of side ``cell`` around them; those that find nothing within one side look again into squares twice as large, until
    none is left. Choose ``cell`` so that a square holds few others: pairs are formed only of what shares nine squares.
    """
    o = cut(others.where("x IS NOT NULL AND y IS NOT NULL").select(*group, F.col(other_id).alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy")).distinct())
    left = points.where("x IS NOT NULL AND y IS NOT NULL").select(*group, id_col, "x", "y").distinct()
    left = cut(left.join(o.select(*group).distinct(), group, "left_semi"))
    out, side = None, float(cell)
    while not left.isEmpty():
        square = lambda c, d=0, side=side: F.floor(F.col(c) / side) + d
        near = left.withColumn("i", F.explode(F.array(*[square("x", d) for d in (-1, 0, 1)]))).withColumn("j", F.explode(F.array(*[square("y", d) for d in (-1, 0, 1)])))
        met = near.join(o.withColumn("i", square("ox")).withColumn("j", square("oy")), [*group, "i", "j"])
        d = F.sqrt((F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy")))
        best = met.groupBy(*group, id_col, "x", "y").agg(F.min(F.struct(d.alias("distance"), F.col("other"))).alias("m"))
        done = cut(best.where(F.col("m.distance") <= side).select(*group, id_col, "x", "y", "m.other", "m.distance"))
        out = done if out is None else out.unionByName(done)
        left = cut(left.join(done.select(*group, id_col, "x", "y"), [*group, id_col, "x", "y"], "left_anti"))
        side *= 2
    if out is None:
        out = left.join(o, group).withColumn("distance", F.lit(0.0))
    return out.groupBy(*group, id_col).agg(F.min(F.struct("distance", "other")).alias("m")).select(*group, id_col, "m.other", "m.distance")
