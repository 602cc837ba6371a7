"""Spans and points met through cells, so that a file with a million spans never meets all its pairs.

Numbers are cut into cells of every power of two. A span is the union of at most two cells of each width, and a
point lies in one cell of each width, so a point is in a span exactly if one of its cells is one of the span's. What is asked of the
spans over a point (the first, the latest, whether there is one) is aggregated for each cell before the join, map-side too: the
join is an equi join whose right side has one row a cell, and its rows are points times widths, however many spans lie over a point.

Null borders, and spans that end before they begin, hold nothing. Keys are compared as in joins: a null key meets nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.sources.work import dealt


def span_cells(lo: Column, hi: Column) -> Column:
    """The cells (width: its power of two, cell) whose disjoint union is lo..hi, both included."""
    lo, end = lo.cast("long"), hi.cast("long") + 1
    widths = F.sequence(F.lit(0), F.when(end > lo, F.floor(F.log2((end - lo).cast("double"))).cast("int")))

    def at(k: Column) -> Column:
        a, b = -F.call_function("shiftright", -lo, k), F.call_function("shiftright", end, k)  # borders in cells of this width, rounded inwards
        left = F.when((a < b) & (a % 2 != 0), F.struct(k.alias("width"), a.alias("cell")))
        right = F.when((a < b) & (b % 2 != 0), F.struct(k.alias("width"), (b - 1).alias("cell")))
        return F.array(left, right)

    return F.array_compact(F.flatten(F.transform(widths, at)))


def _met(points: DataFrame, cells: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Distinct (keys, at) of points with every row of cells (keys, width, cell, ...) that holds them; only widths that a key's spans have are tried."""
    widths = cells.groupBy(*keys).agg(F.collect_set("width").alias("_widths"))
    x = points.select(*keys, F.col(at)).distinct().join(widths, keys).select(*keys, at, F.explode("_widths").alias("width"))
    return x.withColumn("cell", F.call_function("shiftright", F.col(at).cast("long"), F.col("width"))).join(cells, [*keys, "width", "cell"])


def least_holding(points: DataFrame, spans: DataFrame, keys: list[str], at: str, lo: str, hi: str, value: Column) -> DataFrame:
    """(keys, at, least): for each distinct point that a span holds, the least `value` of the spans over it."""
    cells = spans.select(*keys, value.alias("_v"), F.explode(span_cells(F.col(lo), F.col(hi))).alias("_c"))
    cells = cells.groupBy(*keys, F.col("_c.width").alias("width"), F.col("_c.cell").alias("cell")).agg(F.min("_v").alias("_v"))
    return _met(points, cells, keys, at).groupBy(*keys, at).agg(F.min("_v").alias("least"))


def least_overlapping(left: DataFrame, right: DataFrame, keys: list[str], lo: str, hi: str, a: str, b: str, value: Column) -> DataFrame:
    """(keys, lo, hi, least): for each distinct span of left that one of right (keys, a, b) shares a number with, the least `value` of those.

    Two spans overlap if the left one begins in the right one, or the right one begins in the left one; both are questions of
    points and cells, the second with the points' values in the cells around them.
    """
    left = left.select(*keys, lo, hi).where(F.col(lo) <= F.col(hi)).distinct()
    right = right.select(*keys, a, b, value.alias("_v")).where(F.col(a) <= F.col(b))
    begins = least_holding(left, right, keys, lo, a, b, F.col("_v"))
    begins = left.join(begins, [*keys, lo]).select(*keys, lo, hi, "least")
    cells = left.select(*keys, lo, hi, F.explode(span_cells(F.col(lo), F.col(hi))).alias("_c")).select(*keys, lo, hi, "_c.width", "_c.cell")
    widths = cells.groupBy(*keys).agg(F.collect_set("width").alias("_widths"))
    starts = right.groupBy(*keys, a).agg(F.min("_v").alias("_v")).join(widths, keys).select(*keys, a, "_v", F.explode("_widths").alias("width"))
    starts = starts.groupBy(*keys, "width", F.call_function("shiftright", F.col(a).cast("long"), F.col("width")).alias("cell")).agg(F.min("_v").alias("least"))
    within = cells.join(starts, [*keys, "width", "cell"]).select(*keys, lo, hi, "least")
    return begins.unionByName(within).groupBy(*keys, lo, hi).agg(F.min("least").alias("least"))


def greatest_covering(needs: DataFrame, spans: DataFrame, keys: list[str], lo: str, hi: str, a: str, b: str, value: Column) -> DataFrame:
    """(keys, lo, hi, greatest): for each distinct lo..hi of needs that a span a..b covers whole, the greatest `value` of such spans.

    In a cell that holds lo, the spans that reach hi are those with a larger end, so a running maximum from the farthest
    end down answers all needs of the cell at once. A cell's rows are distinct ends, not spans or needs.

    Spans are dealt out and equal ones are one before their cells are made, and cells are dealt out once for all that follows: a
    task has a fixed share of the spans and not those of a part of a file or of so many packed bytes, of which cells are many times as many.
    """
    needs = dealt(needs.select(*keys, lo, hi).where(F.col(lo) <= F.col(hi)), *keys, lo, hi).distinct()
    spans = dealt(spans.select(*keys, F.col(a).alias("_a"), F.col(b).alias("_end"), value.alias("_v")), *keys, "_a", "_end").groupBy(*keys, "_a", "_end").agg(F.max("_v").alias("_v"))
    cells = spans.select(*keys, "_end", "_v", F.explode(span_cells(F.col("_a"), F.col("_end"))).alias("_c"))
    cells = cells.select(*keys, "_c.width", "_c.cell", "_end", "_v")
    widths = cells.groupBy(*keys).agg(F.collect_set("width").alias("_widths"))
    asked = needs.join(widths, keys).select(*keys, lo, hi, F.explode("_widths").alias("width"))
    asked = asked.withColumn("cell", F.call_function("shiftright", F.col(lo).cast("long"), F.col("width")))
    ends = asked.select(*keys, "width", "cell", F.col(hi).alias("_end"))
    where = [*keys, "width", "cell"]
    rows = cells.withColumn("_asks", F.lit(False)).unionByName(ends.withColumn("_asks", F.lit(True)), allowMissingColumns=True)
    rows = dealt(rows, *where).groupBy(*where, "_end", "_asks").agg(F.max("_v").alias("_v"))
    far = Window.partitionBy(*where).orderBy(F.desc("_end"), "_asks").rowsBetween(Window.unboundedPreceding, 0)
    best = rows.withColumn("_v", F.max("_v").over(far)).where("_asks and _v is not null").select(*where, F.col("_end").alias(hi), "_v")
    return dealt(asked, *where, hi).join(dealt(best, *where, hi), [*where, hi]).groupBy(*keys, lo, hi).agg(F.max("_v").alias("greatest"))
