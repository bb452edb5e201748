"""Connected components of a graph of links, by rounds of contraction.

In each round every node joins the least of itself and its neighbours, links are renamed and
those within one node go; what is left is written to the shared folder.  Rounds alternate
between the order of ids and a random order, in which long paths lose a part of their nodes
each round, so the number of rounds grows with the logarithm of the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(links: DataFrame) -> DataFrame:
    """links (u long, v long) -> node, component: the smallest node that links lead to.

    Repeated links, both directions and loops are allowed; rows with a null end are not links.
    A node with loops only is not in the result.
    """
    names: list[DataFrame] = []
    edges = materialize(links.filter("u <> v").select(F.least("u", "v").cast("long").alias("u"), F.greatest("u", "v").cast("long").alias("v")).distinct(), "links")
    turn = 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        if turn % 2:  # by a random order that changes from round to round
            least = (
                both.groupBy("u")
                .agg(F.min(F.struct(F.xxhash64("v", F.lit(turn)).alias("key"), F.col("v").alias("name"))).alias("near"))
                .select("u", F.least("near", F.struct(F.xxhash64("u", F.lit(turn)).alias("key"), F.col("u").alias("name")))["name"].alias("to"))
            )
        else:
            least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("to"))
        least = materialize(least, "merge")
        names.append(least)
        one = edges.join(least, "u").select(F.col("to").alias("a"), F.col("v").alias("u"))
        two = one.join(least, "u").select("a", F.col("to").alias("b")).filter("a <> b")
        edges = materialize(two.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "links")
        turn += 1
    if not names:
        return links.select(F.col("u").cast("long").alias("node"), F.col("u").cast("long").alias("component")).limit(0)
    out = names.pop()
    while names:  # where each earlier name has ended up
        later = out.select(F.col("u").alias("to"), F.col("to").alias("end"))
        out = names.pop().join(later, "to", "left").select("u", F.coalesce("end", "to").alias("to"))
        out = materialize(out, "named")
    least = out.groupBy("to").agg(F.min("u").alias("component"))
    return materialize(out.join(materialize(least, "least"), "to").select(F.col("u").alias("node"), "component"), "components")
