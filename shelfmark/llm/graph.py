"""Connected components of an edge table, in DataFrame operations only."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.session import materialize


#: A graph of at most so many edges (some 20 MB) is worked on in one task per round, which spares
#: it the shuffles; the result is the same.
ONE_TASK_EDGES = 500_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; the component is its smallest node.

    ``edges`` has two columns of one orderable type; direction, repeats and loops do not
    matter, rows with a null end are ignored. Alternates two steps until nothing
    changes, a number of rounds that grows like the logarithm of the longest path:
    each node links its larger neighbours to the smallest one it sees, then its smaller
    neighbours. Neighbours are never gathered: a hub is a minimum with partial aggregation
    and a join whose large side Spark can split. Every round is a written table.
    """
    a, b = edges.columns
    edges = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = materialize(edges.distinct(), "edges")
    before = _state(edges)
    while True:
        one_task = before[0] <= ONE_TASK_EDGES
        if one_task:
            edges = edges.coalesce(1)
        # not a union, which has two partitions and would be shuffled again
        ways = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
        both = edges.select(F.explode(ways).alias("e")).select("e.u", "e.v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        larger = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        larger = larger.distinct()
        least = larger.groupBy("u").agg(F.min("v").alias("m"))
        smaller = larger.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = smaller.unionByName(least.withColumnRenamed("m", "v"))
        edges = materialize((edges.coalesce(1) if one_task else edges).distinct(), "edges")
        now = _state(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
