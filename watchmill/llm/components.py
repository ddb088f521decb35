"""Connected components of a graph whose edges are a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from watchmill.llm.common import materialize

#: Copies of each node's minimum, so that the edges of a hub are joined in that many places.
SALTS = 8


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges (a, b) with the least node ``m`` near ``a``; the join key is salted against hubs.

    Node and salt are hashed to one long: a broadcast table with one long as its key takes the room of its rows, with several
    keys a whole page of memory, which every executor keeps for each round. Nodes that only share a hash are told apart.
    """
    copies = least.withColumn("salt", F.explode(F.array(*(F.lit(i) for i in range(SALTS)))))
    copies = copies.select(F.xxhash64("a", "salt").alias("place"), F.col("a").alias("of"), "m")
    dealt = edges.withColumn("place", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")))
    # As an equality this would be a second key.
    return dealt.join(copies, "place").where(F.col("a").bitwiseXOR(F.col("of")) == 0).select("a", "b", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return _with_least(both.where("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = _with_least(edges, least).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b) of type long; a component is named by its least node.

    Alternates large and small stars until nothing changes. Each round is written to the shared folder. Loops and links with
    a null end are left out; no links give no rows.
    """
    straight = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    edges, before = materialize(straight, "links"), None
    while True:
        seen = Observation()
        following = _small_star(_large_star(edges)).observe(
            seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")
        )
        edges = materialize(following, "stars")
        state = (seen.get["n"], seen.get["sum"])
        if state == before or state[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before = state
