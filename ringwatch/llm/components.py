"""Connected components of a link table by repeated contraction.

In each round every node moves to the neighbour (or itself) of smallest random rank, the
links are renamed to the nodes' new places, and links inside one place go. A round leaves a
constant fraction of the places that still have links, whatever the shape of the graph, so
chains and stars of any size need logarithmically many rounds. Links, nodes and places stay
in tables; the driver only learns how many links are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringwatch.llm.base import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node that has a link; ``root`` is one node of its component.

    Links may repeat, stand in either direction or lead from a node to itself; rows with a
    null end are no links. An empty table gives an empty result.
    """
    live = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    live = stored(live.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    places = None
    turn = 0
    while live.limit(1).count():
        turn += 1
        ends = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = F.struct(F.xxhash64("b", F.lit(turn)).alias("h"), F.col("b").alias("node"))
        own = F.struct(F.xxhash64("a", F.lit(turn)).alias("h"), F.col("a").alias("node"))
        moves = ends.groupBy("a").agg(F.min(rank).alias("best"))
        moves = stored(moves.select("a", F.least(own, F.col("best"))["node"].alias("to")), "moves")
        if places is None:
            places = moves.select(F.col("a").alias("node"), F.col("to").alias("root"))
        else:
            step = moves.select(F.col("a").alias("root"), "to")
            places = places.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
            places = stored(places, "places")
        left = moves.select("a", F.col("to").alias("ta"))
        right = moves.select(F.col("a").alias("b"), F.col("to").alias("tb"))
        live = live.join(left, "a").join(right, "b").where("ta <> tb")
        live = stored(live.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "links")
    if places is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return places
