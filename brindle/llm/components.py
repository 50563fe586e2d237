"""Connected components of a link table, wholly distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, durable


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """links (a long, b long) -> node, component: the smallest node that can be reached, for every node with a link; a table
    of its own.

    Alternates two star steps: every node's larger neighbours, then its smaller ones, link to the smallest
    neighbour. Each round works on at most as many links as it got, is written to the shared folder, and the rounds
    (logarithmic in the longest path) end when the links no longer change. Links to itself and repeated links count for
    nothing; rows with a null are left out; an empty table gives none.

    Only the number of links and a 64-bit checksum of them reach the driver. That two rounds agree in both by chance
    while links still change, at odds of one in 2^64 a round, would end them early; more than `rounds` rounds raise.
    """
    edges = durable(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    sign = lambda d: tuple(d.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    before = sign(edges)
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        new = durable(small.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct(), "links")
        now = sign(new)
        drop(edges)
        edges = new
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = durable(out.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
    drop(edges)
    return out
