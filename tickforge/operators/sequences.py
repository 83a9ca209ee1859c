"""Sliding windows of samples, kept as indices until they are written."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.functions.frames import DAY, gathered, last_rows, ordered
from tickforge.functions.tables import dealt


def check(window: int, stride: int) -> None:
    if window < 1 or not 1 <= stride <= window:
        raise ValueError("1 <= stride <= window")


def ends(samples: DataFrame, window: int, stride: int, order: str = "sample_idx", time: str = "ts_ns", keys: tuple[str, ...] = DAY) -> DataFrame:
    """(keys, seq_id, end_idx, start_ts, end_ts, duration_ns, length): sample i ends a window where
    i >= window - 1 and i - (window - 1) is a multiple of the stride."""
    check(window, stride)
    first = F.first(time).over(last_rows(window, order, keys))
    rows = samples.select(*keys, F.col(order).alias("end_idx"), first.alias("start_ts"), F.col(time).alias("end_ts"))
    at = F.col("end_idx") - (window - 1)
    rows = rows.where((at >= 0) & (at % stride == 0))
    return rows.select(*keys, (at / stride).cast("long").alias("seq_id"), "end_idx", "start_ts", "end_ts", (F.col("end_ts") - F.col("start_ts")).alias("duration_ns"), F.lit(window).alias("length"))


def offsets(samples: DataFrame, window: int, stride: int, order: str = "sample_idx", keys: tuple[str, ...] = DAY) -> DataFrame:
    """(keys, seq_id, offset, sample_idx) of every member: one row a sample and window that it is in."""
    check(window, stride)
    i = F.col(order)
    sizes = samples.groupBy(*keys).agg(F.max(order).alias("__last"))
    rows = samples.select(*keys, i.alias("sample_idx")).join(sizes, [*keys]).withColumnRenamed("__last", "__l")
    low, high = (F.expr(x) for x in (f"greatest(0L, CAST(ceil((sample_idx - {window - 1}) / {stride}) AS BIGINT))", f"least(CAST(floor(sample_idx / {stride}) AS BIGINT), CAST(floor((__l - {window - 1}) / {stride}) AS BIGINT))"))
    rows = rows.withColumn("__lo", low).withColumn("__hi", high).where("__hi >= __lo")
    return rows.select(*keys, F.explode(F.sequence("__lo", "__hi")).alias("seq_id"), "sample_idx").withColumn("offset", F.col("sample_idx") - F.col("seq_id") * stride)


def materialize(samples: DataFrame, columns: list[str], window: int, stride: int, order: str = "sample_idx", keys: tuple[str, ...] = DAY, kept: tuple[str, ...] = ()) -> DataFrame:
    """(keys, seq_id, features, kept...): arrays of `window` feature vectors; for sinks, as rows repeat window / stride times.
    `kept`: columns of a sequence's last sample; where one is null, the sequence is left out.

    Sequences are cut out of blocks of samples, so that nothing is joined and no sample is sent more than once."""
    width_check(samples, columns)
    check(window, stride)
    rows = dealt(samples.select(*keys, F.col(order).alias("sample_idx"), *kept, F.array(*(F.col(c).cast("double") for c in columns)).alias("__v")), keys)
    after = F.col("sample_idx") - (window - 1)
    ends_here = (after >= 0) & (after % stride == 0)
    for c in kept:
        ends_here = ends_here & F.col(c).isNotNull()
    found = gathered(rows, ends_here, F.struct("sample_idx", "__v"), F.row_number().over(ordered("sample_idx", keys)), window, "__m", keys, {"__v"})
    members = F.filter("__m", lambda m: m["sample_idx"] >= after)
    return found.select(*keys, (after / stride).cast("long").alias("seq_id"), members["__v"].alias("features"), *kept)


def flat(features) -> "F.Column":
    """A sequence [T][F] as one array."""
    return F.flatten(features)


def duration_seconds() -> "F.Column":
    """Of a row of `ends`."""
    return F.col("duration_ns") / 1e9


def average_interval() -> "F.Column":
    """Mean seconds between the samples of a row of `ends`; 0 for one sample."""
    return F.when(F.col("length") > 1, duration_seconds() / (F.col("length") - 1)).otherwise(0.0)


def statistics(samples: DataFrame, window: int, stride: int, max_buffer: int | None = None, order: str = "sample_idx", keys: tuple[str, ...] = DAY) -> DataFrame:
    """(keys, pushed, sequences, buffered, utilisation): samples, windows, and how full a buffer of `max_buffer` samples
    (a window's, unless given) would be at the end."""
    check(window, stride)
    room = max_buffer or window
    n = F.max(order) + 1
    made = F.greatest(F.floor((n - window) / stride) + 1, F.lit(0)).cast("long")
    return samples.groupBy(*keys).agg(n.alias("pushed"), made.alias("sequences"), F.least(n, F.lit(room)).alias("buffered"), (F.least(n, F.lit(room)) / room).alias("utilisation"))


def width_check(samples: DataFrame, columns: list[str]) -> None:
    """Raises where a feature column is missing."""
    if missing := [c for c in columns if c not in samples.columns]:
        raise ValueError(f"missing features {missing}")


def multiscale(samples: DataFrame, scales: dict[str, tuple[int, int]], stride: int = 1, order: str = "sample_idx", keys: tuple[str, ...] = DAY) -> DataFrame:
    """Window ends of decimated samples: {scale: (decimation, window)}; each scale counts its own samples."""
    parts = []
    for name, (d, window) in scales.items():
        part = samples.where(F.col(order) % d == 0).withColumn(order, (F.col(order) / d).cast("long"))
        parts.append(ends(part, window, stride, order, keys=keys).withColumn("scale", F.lit(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def horizon_aware(horizon: int, base: int = 100, factor: float = 10.0, low: int = 50, high: int = 5000) -> tuple[int, int]:
    """(window, stride) for a prediction horizon."""
    window = min(max(max(base, int(horizon * factor + 0.5)), low), high)
    return window, max(window // 100, 1)
