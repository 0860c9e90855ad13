"""Connected components of a link table by contraction, on Spark joins only.

Each round hooks every node to its smallest neighbour (or itself, if it is smaller), follows
the pointers to their roots, each time to three times the distance, and replaces the links by
links between roots. The rounds needed grow with the logarithm of the node count. Every round is
written to the shared folder, so no lineage grows and no executor's loss costs more than a round;
nothing else is written, as each file has the JVM start processes (for its folder, itself and its
checksum) where Hadoop's native library is missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from greenscan.llm.common import written


def _roots(hooks: DataFrame) -> DataFrame:
    """(node, up) with every ``up`` replaced by the end of its chain."""
    while True:
        second = hooks.select(F.col("node").alias("up"), F.col("up").alias("mid"))
        third = hooks.select(F.col("node").alias("mid"), F.col("up").alias("top"))
        # pointers lead to smaller nodes, so where the third step moves none, all are at their ends
        hooks = written(hooks.join(second, "up").join(third, "mid").select(
            "node", F.col("top").alias("up"), (F.col("top") != F.col("mid")).alias("moved")), "hooks")
        if hooks.where("moved").isEmpty():
            return hooks.select("node", "up")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (u, v): the smallest node reachable; a written
    table. Links may repeat, point either way, and join a node with itself. They are read
    several times, so a caller gives written ones."""
    spark = links.sparkSession
    label = None
    cur = links.select("u", "v")
    while not cur.isEmpty():
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooks = written(both.groupBy(F.col("u").alias("node"))
                        .agg(F.least(F.col("u"), F.min("v")).alias("up")), "hooks")
        top = _roots(hooks)
        if label is None:
            label = top.select("node", F.col("up").alias("component"))
        else:
            moved = top.select(F.col("node").alias("component"), "up")
            label = written(label.join(moved, "component", "left").select(
                "node", F.coalesce("up", "component").alias("component")), "labels")
        a = top.select(F.col("node").alias("u"), F.col("up").alias("ru"))
        b = top.select(F.col("node").alias("v"), F.col("up").alias("rv"))
        cur = written(cur.join(a, "u").join(b, "v").where("ru <> rv")
                      .select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), "links")
    return label if label is not None else spark.createDataFrame([], "node long, component long")
