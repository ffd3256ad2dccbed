"""Connected components by large-star and small-star rounds: a distributed union-find on DataFrames alone.

Every round replaces an edge list by one with the same components in which nodes hang closer to their smallest member. The
rounds end when the list no longer changes; it is then a set of stars. Each round is written to the shared folder, so
lineage stays short. Joins are on node ids; a node with very many edges is split by adaptive execution, and minima are
pre-aggregated per task.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.llm.text import written


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); the component is its smallest node. NULL ends are left out."""
    spark = edges.sparkSession
    own = written(edges.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", spark)
    before = _fingerprint(own)
    while True:
        both = own.unionByName(own.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(lowest, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter(F.col("a") != F.col("b")).distinct()
        best = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(best, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter(F.col("a") != F.col("b"))
        own = written(small.unionByName(best.select("a", F.col("m").alias("b"))).distinct(), "edges", spark)
        after = _fingerprint(own)
        if after == before:
            break
        before = after
    roots = own.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return own.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
