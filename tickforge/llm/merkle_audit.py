"""Merkle fixity audit of record files and their replicas.

Records are ordered by key. A leaf is a key with the bytes and the SHA-256 of its record; where several records
share a key, its digest covers their number and the sums of their digests, so that none is listed. SEGMENT
consecutive keys make a segment, whose digest covers its leaves with their offset ranges inside it; FAN segments or
nodes make a node, up to one root (and one more for keys below 0). Roots of two replicas are compared, then only
the children of nodes that differ, down to the leaves that do. Each group has at most SEGMENT or FAN members, so
no task sees more, and what is compared shrinks with the damage.

Findings: `corrupt` (other records), `missing` (not in the replica), `extra` (only there). Records with a null key
can't be ordered and stand outside the tree; they are compared as one leaf, whose finding has a null key. A null record
counts as empty. Empty tables have no root; against one, every record of the other side is missing or extra.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

SEGMENT = 256
FAN = 64


class Tree:
    """The written levels of a replica's tree. Level 0 has the segments, level k the nodes of height k."""

    def __init__(self, records: DataFrame, key: str = "key", digest: Column | None = None, size: Column | None = None, record: str = "record"):
        """From a column of records, or from their digests (SHA-256 in hexadecimal) and sizes."""
        body = F.coalesce(F.col(record).cast("binary"), F.lit(b"")) if digest is None else None
        leaves = records.select(F.col(key).cast("long").alias("key"), (F.octet_length(body) if size is None else size).cast("long").alias("size"), (F.sha2(body, 256) if digest is None else digest).alias("digest"))
        part = lambda k: F.conv(F.substring("digest", 16 * k + 1, 16), 16, 10).cast("decimal(20,0)")
        leaves = leaves.groupBy("key").agg(F.count(F.lit(1)).alias("records"), F.sum("size").alias("size"), F.min("digest").alias("digest"), F.concat_ws("+", *(F.sum(part(k)).cast("string") for k in range(4))).alias("all"))
        several = F.sha2(F.concat_ws(":", F.col("records").cast("string"), F.col("all")).cast("binary"), 256)
        leaves = leaves.withColumn("digest", F.when(F.col("records") > 1, several).otherwise(F.col("digest"))).drop("all")
        self.leaves = written(leaves.withColumn("node", F.floor(F.col("key") / SEGMENT)), "merkle-leaves")
        self.levels = [self._above(self.leaves.where("key IS NOT NULL"), "key")]

    @staticmethod
    def _above(children: DataFrame, order: str) -> DataFrame:
        """Nodes of one level: digest over (place, offset, size, digest) of the children, and their bytes."""
        members = F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), F.col("digest").alias("d"), F.col("size").alias("n"))))
        rows = children.groupBy("node").agg(members.alias("m"))
        # offsets inside the node, from the sizes of the children before
        line = F.aggregate("m", F.struct(F.lit(0).cast("long").alias("n"), F.lit("").alias("s")), lambda a, x: F.struct((a["n"] + x["n"]).alias("n"), F.concat(a["s"], F.lit("|"), x["at"].cast("string"), F.lit(":"), a["n"].cast("string"), F.lit("+"), x["n"].cast("string"), F.lit(":"), x["d"]).alias("s")))
        rows = rows.select("node", line.alias("x")).select(F.col("node").alias("name"), F.col("x.n").alias("size"), F.sha2(F.col("x.s").cast("binary"), 256).alias("digest"))
        return written(rows.withColumn("node", F.floor(F.col("name") / FAN)), "merkle-level")

    def grow(self, levels: int) -> "Tree":
        while len(self.levels) < levels:
            self.levels.append(self._above(self.levels[-1], "name"))
        return self

    def span(self) -> tuple[int, int] | None:
        r = self.levels[0].agg(F.min("name"), F.max("name")).first()
        return None if r[0] is None else (r[0], r[1])

    def starts(self) -> DataFrame:
        """(name, start) of every segment: bytes before it, summed up level by level."""
        down = self.levels[-1].select("name", (F.sum("size").over(Window.orderBy("name")) - F.col("size")).alias("start"))  # two roots at most
        for level in reversed(self.levels[:-1]):
            before = F.sum("size").over(Window.partitionBy("node").orderBy("name")) - F.col("size")
            parent = down.select(F.col("name").alias("node"), F.col("start").alias("base"))
            down = level.withColumn("before", before).join(parent, "node").select("name", (F.col("base") + F.col("before")).alias("start"))
        return down


def _levels(*spans: tuple[int, int] | None) -> int:
    found = [s for s in spans if s]
    if not found:
        return 1
    low, high, n = min(a for a, _ in found), max(b for _, b in found), 1
    while low != high and (low, high) != (-1, 0):  # keys below 0 have a root of their own
        low, high, n = low // FAN, high // FAN, n + 1
    return n


def offsets(tree: Tree) -> DataFrame:
    """(key, digest, size, records, start) of every leaf: `start` counts the bytes before it in key order."""
    before = F.sum("size").over(Window.partitionBy("node").orderBy("key")) - F.col("size")
    starts = tree.starts().select(F.col("name").alias("node"), F.col("start").alias("base"))
    keyed = tree.leaves.where("key IS NOT NULL").withColumn("before", before)
    return keyed.join(starts, "node").select("key", "digest", "size", "records", (F.col("base") + F.col("before")).alias("start"))


def descend(good: Tree, replica: Tree) -> tuple[DataFrame, list[int]]:
    """(node) of the segments that differ, found from the roots down, and how many nodes were compared on each level."""
    levels = _levels(good.span(), replica.span())
    good.grow(levels)
    replica.grow(levels)
    wrong, compared = None, []
    for a, b in zip(reversed(good.levels), reversed(replica.levels), strict=True):
        if wrong is not None:
            a, b = (x.join(wrong, "node", "left_semi") for x in (a, b))
        pair = a.select("name", F.col("digest").alias("x")).join(b.select("name", F.col("digest").alias("y")), "name", "full")
        pair = written(pair.select(F.col("name").alias("node"), (~F.col("x").eqNullSafe(F.col("y"))).alias("wrong")), "merkle-compared")
        compared.append(pair.count())
        wrong = pair.where("wrong").select("node")
        if wrong.isEmpty():
            break
    return wrong, compared


def findings(good: Tree, replica: Tree, segments: DataFrame) -> DataFrame:
    """(key, status) of the keys of these segments whose records differ, and of the records without a key."""
    own = segments.unionByName(segments.sparkSession.createDataFrame([(None,)], segments.schema)).withColumnRenamed("node", "segment")
    listed = lambda t, name: t.leaves.join(own, F.col("node").eqNullSafe(F.col("segment")), "left_semi").select(F.col("key").alias(f"k_{name}"), F.col("digest").alias(name), F.col("records").alias(f"n_{name}"))
    pair = listed(good, "x").join(listed(replica, "y"), F.col("k_x").eqNullSafe(F.col("k_y")), "full")
    pair = pair.where(~(F.col("x").eqNullSafe(F.col("y")) & F.col("n_x").eqNullSafe(F.col("n_y"))))
    return pair.select(F.coalesce("k_x", "k_y").alias("key"), F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "extra").otherwise("corrupt").alias("status"))


def audit(good: Tree, replica: Tree) -> DataFrame:
    """(key, status) of every key whose records differ."""
    return findings(good, replica, descend(good, replica)[0])
