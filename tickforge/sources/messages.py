"""Order messages from files: Parquet, in-memory rows, and DBN files as a Spark data source."""

import re
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "day date, seq long, ts_ns long, action string, side string, order_id long, price long, size long"


def parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def from_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rows (order_id, action, side, price, size, ts_ns) in arrival order; a missing time counts as 0."""
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, order_id long, action string, side string, price long, size long, ts_ns long")
    frame = frame.withColumn("ts_ns", F.coalesce("ts_ns", F.lit(0)))
    return frame.withColumn("day", F.to_date(F.timestamp_micros((F.col("ts_ns") / 1000).cast("long"))))


def day_of_path(path: Column) -> Column:
    """The first eight digits of a path that begin with 20, as a date."""
    return F.to_date(F.regexp_extract(path, r"(20\d{6})", 1), "yyyyMMdd")


def day_name(path: str) -> str:
    m = re.search(r"20\d{6}", path)
    return m[0] if m else Path(path).stem


def hot_path(path: str) -> str:
    """The decompressed file beside a compressed one, where there is one."""
    plain = path.removesuffix(".zst")
    return plain if plain != path and Path(plain).exists() else path


def trading_days(spark: SparkSession, start: str, end: str, exclude: list[str] = ()) -> DataFrame:
    """(day): the weekdays from start to end, without the excluded ones."""
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("day"))
    days = days.where(~F.dayofweek("day").isin(1, 7))
    gone = spark.createDataFrame([(d,) for d in exclude], "d string").select(F.to_date("d").alias("day"))
    return days.join(gone, "day", "left_anti")


MBO_RECORD = 0xA0


#: Bytes of a DBN file that are unpacked and decoded at a time.
CHUNK = 1 << 22


def dbn_records(stream) -> Iterator["np.ndarray"]:  # noqa: F821
    """The order messages of a DBN file, compressed or not, read and unpacked a chunk at a time."""
    import numpy as np

    head = stream.read(4)
    if head == b"\x28\xb5\x2f\xfd":
        import zstandard

        stream.seek(0)
        stream = zstandard.ZstdDecompressor().stream_reader(stream)
        head = stream.read(4)
    if head[:3] != b"DBN":
        raise ValueError("not a DBN file")

    def exactly(n: int) -> bytes:
        out = b""
        while len(out) < n and (more := stream.read(n - len(out))):
            out += more
        return out

    exactly(int.from_bytes(exactly(4), "little"))
    # The public record layout, little-endian
    kind = np.dtype([("length", "u1"), ("rtype", "u1"), ("publisher", "<u2"), ("instrument", "<u4"), ("ts_event", "<u8"), ("order_id", "<u8"), ("price", "<i8"), ("size", "<u4"), ("flags", "u1"), ("channel", "u1"), ("action", "S1"), ("side", "S1"), ("ts_recv", "<u8"), ("ts_in_delta", "<i4"), ("sequence", "<u4")])
    rest = b""
    while data := stream.read(CHUNK):
        data, at, parts = rest + data, 0, []
        whole = len(data) // kind.itemsize * kind.itemsize
        rows = np.frombuffer(data[:whole], kind)
        if (rows["length"] == kind.itemsize // 4).all():
            rest = data[whole:]
            yield rows[rows["rtype"] == MBO_RECORD]
            continue
        while at < len(data):
            size = 4 * data[at]
            if size < 16:
                raise ValueError("broken record")
            if at + size > len(data):
                break
            if data[at + 1] == MBO_RECORD:
                parts.append(data[at : at + size])
            at += size
        rest = data[at:]
        yield np.frombuffer(b"".join(parts), kind)
    if rest:
        raise ValueError("the file ends inside a record")


def read_dbn(data: bytes) -> "np.ndarray":  # noqa: F821
    """The order messages of a DBN file's bytes."""
    import io

    import numpy as np

    parts = list(dbn_records(io.BytesIO(data)))
    return np.concatenate(parts) if parts else np.zeros(0)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class DbnReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths]

    def read(self, partition: _File) -> Iterator["pa.RecordBatch"]:  # noqa: F821
        import datetime

        import numpy as np
        import pyarrow as pa

        found = re.search(r"20\d{6}", partition.path)
        day = datetime.datetime.strptime(found[0], "%Y%m%d").date() if found else None
        begin = 0
        with open(hot_path(partition.path), "rb") as stream:
            for rows in dbn_records(stream):
                ts = np.where(rows["ts_event"] == np.iinfo(np.uint64).max, 0, rows["ts_event"]).astype(np.int64)
                if day is None and len(ts):
                    day = datetime.date(1970, 1, 1) + datetime.timedelta(int(ts[0] // 86_400_000_000_000))
                for i in range(0, len(rows), 100_000):
                    r = rows[i : i + 100_000]
                    arrays = [pa.array([day] * len(r), pa.date32()), pa.array(np.arange(begin, begin + len(r))), pa.array(ts[i : i + len(r)]), pa.array(r["action"].astype("U1")), pa.array(r["side"].astype("U1")), pa.array(r["order_id"].astype(np.int64)), pa.array(r["price"].copy()), pa.array(r["size"].astype(np.int64))]
                    begin += len(r)
                    yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in SCHEMA.split(", ")])


class DbnSource(DataSource):
    """spark.dataSource.register(DbnSource); spark.read.format("dbn").load(path): a file, or a folder of .dbn and .dbn.zst."""

    @classmethod
    def name(cls) -> str:
        return "dbn"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DbnReader:
        path = Path(self.options["path"])
        return DbnReader(sorted(str(p) for p in path.iterdir() if re.search(r"\.dbn(\.zst)?$", p.name)) if path.is_dir() else [str(path)])
