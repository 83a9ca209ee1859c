"""Books and event samples of a stream of messages, a state for each day."""

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickforge.contract import LEVELS
from tickforge.operators.book import Book

KEYED = "seq long, ts_ns long, late boolean, bid_px array<long>, bid_sz array<long>, ask_px array<long>, ask_sz array<long>, best_bid long, best_ask long"


def snapshots(messages: DataFrame, every: int = 1, levels: int = LEVELS, watermark: str = "1 hour", keys: tuple[str, ...] = ("day",)) -> DataFrame:
    """A snapshot after every `every`-th valid message of a key, whose last column is the day, in append mode.

    Messages of a day have to arrive in order of seq over the batches; one at or below the last seq changes
    nothing and comes out as a row with `late` set, so that it can be counted. State of a day is dropped when
    the watermark has passed its end."""

    schema = ", ".join([*(f"{k} string" for k in keys), KEYED])

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        book, n, last = Book(), 0, -1
        if state.exists:
            book.orders, book.sizes, book.prices, n, last = pickle.loads(state.get[0])
        rows = []
        for x in pd.concat(list(frames)).sort_values("seq", kind="stable").itertuples():
            if x.seq <= last:
                rows.append((*key, x.seq, x.ts_ns, True, None, None, None, None, None, None))
                continue
            last = x.seq
            book.apply(x.action, x.side, x.order_id, x.price, x.size)
            n += 1
            if n % every == 0:
                rows.append((*key, x.seq, x.ts_ns, False, *book.top(levels)))
        state.update((pickle.dumps((book.orders, book.sizes, book.prices, n, last)),))
        end = int(pd.Timestamp(key[-1]).value // 1_000_000) + 86_400_000
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
        for c in ("best_bid", "best_ask"):
            out[c] = out[c].astype("Int64")
        yield out

    valid = messages.where("NOT (coalesce(order_id, 0) = 0 OR coalesce(size, 0) = 0 OR coalesce(price, 0) <= 0)")
    valid = valid.withColumns({k: F.col(k).cast("string") for k in keys}).withColumn("at", F.timestamp_micros((F.col("ts_ns") / 1000).cast("long"))).withWatermark("at", watermark)
    return valid.groupBy(*keys).applyInPandasWithState(run, schema, "state binary", "append", GroupStateTimeout.EventTimeTimeout)


def session_counts(messages: DataFrame, width: str = "5 minutes", watermark: str = "10 minutes") -> DataFrame:
    """Messages, volume and trades of event-time windows, for monitoring a stream."""
    at = F.timestamp_micros((F.col("ts_ns") / 1000).cast("long"))
    rows = messages.withColumn("at", at).withWatermark("at", watermark)
    return rows.groupBy(F.window("at", width), "side").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("volume"), F.sum(F.when(F.col("action") == "T", 1).otherwise(0)).alias("trades"))
