"""Session settings, the shared work folder and worker-side caches of the text operators."""

import atexit
import ctypes
import functools
import shutil
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch; texts of a batch are held in memory together.
ARROW_ROWS = 512
#: Bits of a membership bitmap, at most (16 MB).
MAX_BITMAP_BITS = 1 << 27
#: Members of a bitmap at most: with more, it would let most rows through, and a join does the work.
MAX_MEMBERS = MAX_BITMAP_BITS // 4
#: Rows of a key that a join keeps together, and keys of more rows than that, each at most.
KEY_ROWS, HOT_KEYS = 256, 10_000


def tune(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _temporary() -> str:
    """Where spark.checkpoint.dir is unset, as in tests: a folder that goes with the process."""
    path = tempfile.mkdtemp(prefix="tickforge-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; a temporary one only where that is unset and all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _temporary()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder, read again. Lost executors lose nothing of it."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], total: int, salt: str | list[str], how: str = "inner", sizes: DataFrame | None = None) -> DataFrame:
    """`many` JOIN `one`, where `one` has a row a key. Rows of a hot key, one with more than `total` / HOT_KEYS of
    the `total` rows, are dealt by the columns `salt` to several tasks, and its row of `one` is copied to each.

    Fewer than HOT_KEYS keys are hot, whatever the size of `many`, so their list can be broadcast. `sizes`: the
    number `rows` of each key in `many`, or at least of the hot ones, where it is known."""
    limit = max(KEY_ROWS, total // HOT_KEYS)
    sizes = many.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")) if sizes is None else sizes
    hot = F.broadcast(sizes.where(F.col("rows") > limit).select(*keys, F.ceil(F.col("rows") / limit).cast("int").alias("__parts")))
    many = many.join(hot, keys, "left").withColumn("__salt", F.pmod(F.xxhash64(*([salt] if isinstance(salt, str) else salt)), F.coalesce("__parts", F.lit(1))).cast("int")).drop("__parts")
    one = one.join(hot, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return many.join(one, [*keys, "__salt"], how).drop("__salt")


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker process, whatever the task."""
    name = "_tickforge_worker_cache"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
        sys.modules[name].held = {}
    return sys.modules[name].held


def cached(key: tuple, make: Callable):
    held = worker_cache()
    if key not in held:
        held[key] = make()
    return held[key]


def lean(run: Callable) -> Callable:
    """A function over batches that gives freed memory back at its end: workers wait for later stages with it."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only in some C libraries
            if trim:
                trim(0)

    return wrapped


def texts_of(column: pa.Array) -> list[str]:
    """Whole texts; a null text counts as an empty one."""
    return ["" if t is None else t for t in column.to_pylist()]


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of about `limit` bytes of text, or one row where that alone is longer."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.binary_length(batch.column(batch.schema.get_field_index(column))).fill_null(0).to_numpy(zero_copy_only=False)
        total, at = np.cumsum(size, dtype=np.int64), 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(total, limit + (total[at - 1] if at else 0), side="right")))
            yield batch.slice(at, end - at)
            at = end


def bitmap_of(hashes: DataFrame, column: str, n: int) -> np.ndarray:
    """Membership bitmap over 64-bit hashes, of a size fixed by `n` and capped at MAX_BITMAP_BITS.

    Bits are merged in Spark, so the driver gets at most one long for 64 bits of the bitmap.
    """
    bits = 1 << 16
    while bits < 16 * n and bits < MAX_BITMAP_BITS:
        bits *= 2
    at = F.pmod(F.col(column), F.lit(bits)).cast("long")
    words = hashes.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("v"))
    got = words.toArrow()
    out = np.zeros(bits >> 6, np.int64)
    out[got.column("w").to_numpy()] = got.column("v").to_numpy()
    return out.view(np.uint64)


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes.view(np.uint64) & np.uint64(64 * len(bitmap) - 1)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
