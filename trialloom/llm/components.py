"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialloom.llm.common import Scratch


def connected_components(links: DataFrame, a: str, b: str, scratch: Scratch) -> DataFrame:
    """Rows (node, component) for every node of a link, component being the
    smallest node reachable.

    Each round points every node at its smallest neighbour, shortens the chains
    of pointers by joining them with themselves, and replaces links by links
    between what their ends point at. Links within one node vanish; when none
    are left the rounds' pointers are composed. Rounds grow with the logarithm
    of the graph. All tables are written, none is collected. Links with a null
    end and links from a node to itself are ignored; repeated links and links in
    both directions count once; no links give no rows.
    """
    ends = links.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y"))
    ends = scratch.table(ends.where(F.col(a) .isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct(), "links")
    pointers: list[DataFrame] = []
    while not ends.isEmpty():
        both = ends.select(F.col("x").alias("node"), F.col("y").alias("to")).unionByName(ends.select(F.col("y").alias("node"), F.col("x").alias("to")))
        points = scratch.table(both.groupBy("node").agg(F.least("node", F.min("to")).alias("to")), "points")
        while True:
            over = points.select(F.col("node").alias("to"), F.col("to").alias("next"))
            jumped = scratch.table(points.join(over, "to").select("node", F.col("next").alias("to"), (F.col("to") != F.col("next")).alias("moved")), "jumped")
            still = jumped.where("moved").isEmpty()
            points = jumped.select("node", "to")
            if still:
                break
        pointers.append(points)
        px = points.select(F.col("node").alias("x"), F.col("to").alias("px"))
        py = points.select(F.col("node").alias("y"), F.col("to").alias("py"))
        moved = ends.join(px, "x").join(py, "y").where("px <> py")
        ends = scratch.table(moved.select(F.greatest("px", "py").alias("x"), F.least("px", "py").alias("y")).distinct(), "links")
    if not pointers:
        return ends.select(F.col("x").alias("node"), F.col("y").alias("component"))
    out = pointers[0]
    for later in pointers[1:]:
        later = later.select(F.col("node").alias("to"), F.col("to").alias("next"))
        out = out.join(later, "to", "left").select("node", F.coalesce("next", "to").alias("to"))
    return scratch.table(out.select("node", F.col("to").alias("component")), "components")
