"""Connected components of a graph given as links, without holding any of it on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertrail.llm.common import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of `links` reaches.

    Contraction by random order: in each round every node follows the neighbour that comes first in an order drawn for
    the round, if that comes before itself, and then the one that this one follows; what follows the same node becomes
    one node, and links within it vanish. Orders by hash leave short chains and merge a constant share of the nodes, so
    that rounds grow with the logarithm of the number of nodes, whatever the graph's shape, and each works on what is
    left only. What is shuffled is a row for each link and node; a node that very many rows name is only summed up (with
    map-side combine) or the many-rows side of an equi-join, which adaptive execution splits. Each round's results are
    written to the shared folder: lineage ends there. A link of a node to itself, repeated links and links in both
    directions do no harm; null ends are left out.
    """
    ways = F.array(F.struct(F.col(a).alias("u"), F.col(b).alias("v")), F.struct(F.col(b).alias("u"), F.col(a).alias("v")))
    pairs = links.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.explode(ways).alias("w")).select("w.u", "w.v")
    left = stored(pairs.distinct(), "links")
    roots = left.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    turn = 0
    while True:
        turn += 1
        order = lambda c: F.xxhash64(F.col(c), F.lit(turn))  # noqa: B023, E731
        first = left.groupBy("u").agg(F.min(order("v")).alias("p"), F.min_by("v", order("v")).alias("v"))
        step = stored(first.select("u", F.when(F.col("p") < order("u"), F.col("v")).otherwise(F.col("u")).alias("f")), "steps")
        two = stored(step.join(step.select(F.col("u").alias("f"), F.col("f").alias("g")), "f").select("u", "g"), "jumps")
        roots = stored(roots.join(two.select(F.col("u").alias("root"), "g"), "root", "left").select("node", F.coalesce("g", "root").alias("root")), "roots")
        moved = left.join(two.select(F.col("u").alias("v"), F.col("g").alias("gv")), "v").select("u", "gv").distinct()
        moved = moved.join(two, "u").filter("g <> gv").select(F.col("g").alias("u"), F.col("gv").alias("v"))
        left = stored(moved.distinct(), "links")
        if left.limit(1).count() == 0:
            break
    least = roots.groupBy("root").agg(F.min("node").alias("component"))
    return roots.join(least, "root").select("node", "component")
