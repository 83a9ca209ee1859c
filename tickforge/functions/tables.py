"""Intermediate tables that several branches of a plan read."""

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame


@functools.cache
def _temporary() -> str:
    """Where spark.checkpoint.dir is unset, as in tests: a folder that goes with the process."""
    path = tempfile.mkdtemp(prefix="tickforge-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def materialized(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder named by spark.checkpoint.dir (a temporary one where it is unset) and read again,
    so that branches don't repeat the work and a lost executor loses none of it."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _temporary()
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame, by) -> DataFrame:
    """Rows dealt by columns to as many partitions as the session sets. A number that is given isn't merged by adaptive plans,
    which else put 64 MB of compressed rows, gigabytes once they are sorted, into one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def merged(left: DataFrame, right: DataFrame, by, how: str = "inner") -> DataFrame:
    """A join of two tables that grow with the input, by sorting both: whatever size is expected of one, it isn't sent
    to the driver for a broadcast."""
    return dealt(left, by).hint("merge").join(dealt(right, by).hint("merge"), [*by], how)
