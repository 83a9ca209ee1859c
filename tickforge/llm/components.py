"""Connected components by alternating large-star and small-star steps on DataFrames.

(Kiveris et al., 2014.) Links stay in Spark; every step is cut off by a written table. The smallest member
names a component. A node with a large share of all links is dealt to several tasks.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import spread_join, written


def components(links: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """(node, component) of every node with a link to another one; nulls and links to itself count for nothing."""
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges, seen = written(edges, name), None
    while True:
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if tuple(state) == seen or not state.n:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = tuple(state)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = spread_join(both, low, ["u"], 2 * state.n, "v").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, name)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, low, ["u"], state.n, "v").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(low.withColumnRenamed("m", "v")).distinct(), name)
