"""The flagship query: book features of event samples."""

from pyspark.sql import DataFrame, SparkSession

from tickforge.operators import lob as ops
from tickforge.operators import sampling
from tickforge.plans.catalog import EVERY, lob


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw and derived features of every EVERY-th book of a day: 48 columns."""
    fired = sampling.every(lob(spark, sf_dir), EVERY).where("fires")
    return fired.select("day", "seq", "ts_ns", *(c.alias(n) for n, c in (ops.raw() | ops.derived()).items()))
