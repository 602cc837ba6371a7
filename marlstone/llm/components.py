"""Connected components of a link table, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm._work import Work


def components(edges: DataFrame, work: Work) -> DataFrame:
    """(id, component) for every id that is not the smallest of its component.

    edges: columns a, b (comparable, either order, self links and repeats allowed, nulls ignored). Ids that
    are absent from the result are their own component. Each round hooks every id to its smallest
    neighbour below it, jumps pointers until the trees are flat and contracts the links; hubs are
    aggregated before the shuffle and only met in joins that AQE can split.
    """
    left = work.save(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi").distinct())
    labels = None
    while not left.isEmpty():
        parent = work.save(left.groupBy(F.col("hi").alias("v")).agg(F.min("lo").alias("p")))
        while True:
            up = parent.select(F.col("v").alias("p"), F.col("p").alias("q"))
            flat = work.save(parent.join(up, "p", "left").select("v", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")))
            work.drop(parent)
            parent = flat
            if parent.where("moved").isEmpty():
                break
            parent = parent.drop("moved")
        parent = parent.drop("moved")
        if labels is None:
            labels = parent
        else:
            over = parent.select(F.col("v").alias("p"), F.col("p").alias("q"))
            fresh = parent.join(labels.select("v"), "v", "left_anti")
            labels = work.save(labels.join(over, "p", "left").select("v", F.coalesce("q", "p").alias("p")).unionByName(fresh))
        lo = parent.select(F.col("v").alias("lo"), F.col("p").alias("lo2"))
        hi = parent.select(F.col("v").alias("hi"), F.col("p").alias("hi2"))
        new = left.join(lo, "lo", "left").join(hi, "hi", "left").select(F.coalesce("lo2", "lo").alias("x"), F.coalesce("hi2", "hi").alias("y"))
        new = work.save(new.where("x <> y").select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).distinct())
        work.drop(left)
        left = new
    if labels is None:
        return left.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
    return labels.select(F.col("v").alias("id"), F.col("p").alias("component"))
