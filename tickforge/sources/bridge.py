"""Order events, book snapshots and prices made from an `events` table by integer arithmetic."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickforge.contract import LEVELS, TICK
from tickforge.functions.tables import dealt

BASE = 100_000_000_000


def _events(events: DataFrame, text_day: bool) -> DataFrame:
    """`text_day`: days as text from the start, so that windows before and after share one partitioning."""
    day = F.date_format("ts", "yyyy-MM-dd") if text_day else F.to_date("ts")
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    return events.select(day.alias("day"), F.col("event_id").alias("seq"), ns.alias("ts_ns"), "user_id", "event_type", "value")


def mbo(events: DataFrame, text_day: bool = False) -> DataFrame:
    """(day, seq, ts_ns, action, side, order_id, price, size)."""
    return _events(events, text_day).select("day", "seq", "ts_ns", *_message())


def _message() -> "list[F.Column]":
    action = F.when(F.col("event_type").isin("view", "signup"), "A").when(F.col("event_type") == "click", "M").when(F.col("event_type") == "error", "C").when(F.col("event_type") == "purchase", "T").otherwise("N")
    step = (1 + (F.col("seq") * 37) % 10) * TICK
    bid = F.col("user_id") % 2 == 0
    return [action.alias("action"), F.when(bid, "B").otherwise("A").alias("side"), (F.col("user_id") + 1).alias("order_id"), F.when(bid, BASE - step).otherwise(BASE + step).cast("long").alias("price"), (1 + F.floor("value")).cast("long").alias("size")]


def _levels(make) -> "F.Column":
    return F.array(*(make(i).cast("long") for i in range(LEVELS)))


def lob(events: DataFrame, text_day: bool = False, messages: bool = False) -> DataFrame:
    """(day, seq, ts_ns, bid_px, bid_sz, ask_px, ask_sz, best_bid, best_ask): ten levels each side, with
    the columns of `mbo` if wanted."""
    s, off = F.col("seq"), (F.col("seq") % 20 - 10) * TICK
    out = _events(events, text_day).select(
        "day", "seq", "ts_ns", *(_message() if messages else ()),
        _levels(lambda i: BASE + off - (i + 1) * TICK).alias("bid_px"),
        _levels(lambda i: (100 + 7 * s + 50 * i) % 500 + 100).alias("bid_sz"),
        _levels(lambda i: BASE + off + (i + 1) * TICK).alias("ask_px"),
        _levels(lambda i: (150 + 11 * s + 30 * i) % 400 + 100).alias("ask_sz"),
    )
    return out.withColumn("best_bid", F.col("bid_px")[0]).withColumn("best_ask", F.col("ask_px")[0])


def lob_edge(events: DataFrame, text_day: bool = False, messages: bool = False) -> DataFrame:
    """The book with empty ask sides, locked and crossed quotes, and emptied deep levels."""
    s, b = F.col("seq"), lob(events, text_day, messages)
    bid0 = F.col("bid_px")[0]
    ask = F.when(s % 97 == 0, _levels(lambda i: F.lit(0))).when(s % 89 == 0, _levels(lambda i: bid0 + i * TICK)).when(s % 83 == 0, _levels(lambda i: bid0 + (i - 1) * TICK)).otherwise(F.col("ask_px"))
    b = b.withColumn("ask_px", ask).withColumn("ask_sz", F.when(s % 97 == 0, _levels(lambda i: F.lit(0))).otherwise(F.col("ask_sz")))
    for c in ("bid_px", "bid_sz", "ask_px", "ask_sz"):
        b = b.withColumn(c, F.when(s % 7 == 0, F.transform(c, lambda x, i: F.when(i >= 6, F.lit(0).cast("long")).otherwise(x))).otherwise(F.col(c)))
    return b.withColumn("best_bid", F.nullif(F.col("bid_px")[0], F.lit(0))).withColumn("best_ask", F.nullif(F.col("ask_px")[0], F.lit(0)))


def both(events: DataFrame, text_day: bool = False) -> DataFrame:
    """The messages and the book of `lob_edge` behind each."""
    return lob_edge(events, text_day, messages=True)


def mids(events: DataFrame, text_day: bool = False) -> DataFrame:
    """(day, t, p_nanos, p): a price a row, t counted from 0 in each day."""
    e = dealt(_events(events, text_day), ["day"])
    nanos = (F.lit(BASE) + F.round(F.col("value") * 100).cast("long") * 1_000_000).alias("p_nanos")
    t = (F.row_number().over(Window.partitionBy("day").orderBy("seq")) - 1).cast("long")
    return e.select("day", t.alias("t"), nanos).withColumn("p", F.col("p_nanos") / 1e9)
