"""Connected components by contraction, for link tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm._common import store_rows


def _jumped(parent: DataFrame) -> DataFrame:
    """Pointers followed once; ``moved`` where that led further."""
    up = parent.select(F.col("vertex").alias("root"), F.col("root").alias("above"))
    return parent.join(up, "root").select("vertex", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved"))


def connected_components(links: DataFrame) -> DataFrame:
    """(vertex, component) for the vertices of ``links`` (a, b); a component is named by one of its vertices.

    Each round hooks every vertex to its least neighbour, follows those pointers to their roots and
    replaces links by links between roots, until none is left. Hot vertices are met only by partial
    minima and by plain equi-joins, which adaptive execution can split. Nothing is collected. Rounds are
    written as tables: a checkpoint would carry on the planner's size estimates, which joins multiply.
    ``links`` is read a few times and should be a written table itself.
    """
    links = links.select("a", "b").filter(F.col("a") != F.col("b"))
    mapping = None
    while mapping is None or links.count():
        both = links.union(links.select(F.col("b"), F.col("a")))
        parent = both.groupBy(F.col("a").alias("vertex")).agg(F.least(F.min("b"), F.first("a")).alias("root"))
        parent = store_rows(_jumped(parent), "parents")
        while parent.filter("moved").count():
            parent = store_rows(_jumped(_jumped(parent.select("vertex", "root")).select("vertex", "root")), "parents")
        parent = parent.select("vertex", "root")
        step = parent.select(F.col("vertex").alias("root"), F.col("root").alias("above"))
        mapping = parent if mapping is None else store_rows(mapping.join(step, "root", "left").select("vertex", F.coalesce("above", "root").alias("root")), "components")
        left = parent.select(F.col("vertex").alias("a"), F.col("root").alias("ra"))
        right = parent.select(F.col("vertex").alias("b"), F.col("root").alias("rb"))
        rest = links.join(left, "a").join(right, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).filter(F.col("a") != F.col("b"))
        if not rest.limit(1).count():
            break
        links = store_rows(rest.distinct(), "links")
    return mapping.select("vertex", F.col("root").alias("component"))
