"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import written


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return r["n"], r["x"]


def connected_components(edges: DataFrame) -> DataFrame:
    """``id, component`` (the smallest id reachable) of every id in ``edges`` (a, b).

    A step only takes minima per id, which combine map-side, and joins them
    back, so an id with very many edges is an ordinary skewed join; the number
    of steps grows with the logarithm of the component size.
    """
    cur = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    state = _state(cur)
    while state[0]:
        # large star: the neighbours above each id point to its smallest neighbour
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        big = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: each id and its neighbours below point to the smallest of them
        low = big.groupBy("a").agg(F.min("b").alias("m"))
        small = big.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b") \
            .unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        cur = written(small, "cc")
        before, state = state, _state(cur)
        if state == before:
            break
    return cur.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id") \
        .unionByName(cur.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
