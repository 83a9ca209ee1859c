"""Queries over the driver's tables, one for each operator, each with the SQL that states the same result.

An entry has the result's key, whole-number and double columns; both sides round doubles alike, smaller ones to more
places, so that each keeps its leading digits: to six places from 0.1, to nine from 0.0001, to twelve below. A part of
HALF over a half moves exact ties. Windows are sized for a few hundred events a day.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.sources import bridge

FAST, MEDIUM, SLOW = 20, 100, 300
EVERY, WINDOW, STRIDE = 10, 20, 5
HALF = 0.5003
#: (least absolute value, scale)
PLACES = ((0.1, 1e6), (1e-4, 1e9), (0.0, 1e12))

E = """e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_id AS seq, epoch_us(ts) * 1000 AS ts_ns, user_id, event_type, value FROM events)"""
MBO = E + """, mbo AS (SELECT day, seq, ts_ns,
  CASE WHEN event_type IN ('view', 'signup') THEN 'A' WHEN event_type = 'click' THEN 'M' WHEN event_type = 'error' THEN 'C' WHEN event_type = 'purchase' THEN 'T' ELSE 'N' END AS action,
  CASE WHEN user_id % 2 = 0 THEN 'B' ELSE 'A' END AS side, user_id + 1 AS order_id,
  CAST(CASE WHEN user_id % 2 = 0 THEN 100000000000 - (1 + (seq * 37) % 10) * 10000000 ELSE 100000000000 + (1 + (seq * 37) % 10) * 10000000 END AS BIGINT) AS price,
  CAST(1 + floor(value) AS BIGINT) AS size FROM e)"""
LOB = E + """, lob AS (SELECT *, bid_px[1] AS best_bid, ask_px[1] AS best_ask FROM (SELECT day, seq, ts_ns,
  list_transform(range(0, 10), lambda i: 100000000000 + (seq % 20 - 10) * 10000000 - (i + 1) * 10000000) AS bid_px,
  list_transform(range(0, 10), lambda i: (100 + 7 * seq + 50 * i) % 500 + 100) AS bid_sz,
  list_transform(range(0, 10), lambda i: 100000000000 + (seq % 20 - 10) * 10000000 + (i + 1) * 10000000) AS ask_px,
  list_transform(range(0, 10), lambda i: (150 + 11 * seq + 30 * i) % 400 + 100) AS ask_sz FROM e))"""
EDGE = LOB + """, edge AS (SELECT *, nullif(bid_px[1], 0) AS best_bid, nullif(ask_px[1], 0) AS best_ask FROM (SELECT day, seq, ts_ns,
  CASE WHEN seq % 7 = 0 THEN list_transform(range(0, 10), lambda i: CASE WHEN i >= 6 THEN 0 ELSE bid_px[i + 1] END) ELSE bid_px END AS bid_px,
  CASE WHEN seq % 7 = 0 THEN list_transform(range(0, 10), lambda i: CASE WHEN i >= 6 THEN 0 ELSE bid_sz[i + 1] END) ELSE bid_sz END AS bid_sz,
  CASE WHEN seq % 7 = 0 THEN list_transform(range(0, 10), lambda i: CASE WHEN i >= 6 THEN 0 ELSE ask_px[i + 1] END) ELSE ask_px END AS ask_px,
  CASE WHEN seq % 7 = 0 THEN list_transform(range(0, 10), lambda i: CASE WHEN i >= 6 THEN 0 ELSE ask_sz[i + 1] END) ELSE ask_sz END AS ask_sz
  FROM (SELECT day, seq, ts_ns, bid_px, bid_sz,
    CASE WHEN seq % 97 = 0 THEN list_transform(range(0, 10), lambda i: 0) WHEN seq % 89 = 0 THEN list_transform(range(0, 10), lambda i: bid_px[1] + i * 10000000) WHEN seq % 83 = 0 THEN list_transform(range(0, 10), lambda i: bid_px[1] + (i - 1) * 10000000) ELSE ask_px END AS ask_px,
    CASE WHEN seq % 97 = 0 THEN list_transform(range(0, 10), lambda i: 0) ELSE ask_sz END AS ask_sz FROM lob)))"""
MIDS = E + """, mids AS (SELECT day, seq, row_number() OVER (PARTITION BY day ORDER BY seq) - 1 AS t, count(*) OVER (PARTITION BY day) AS n,
  (100000000000 + CAST(round(value * 100) AS BIGINT) * 1000000) / 1e9 AS p FROM e)"""


def rounded(c: Column, fine: bool = True) -> Column:
    at = lambda scale: F.floor(c * scale + HALF) / scale
    first, second, last = PLACES
    if not fine:
        return at(first[1])
    return F.when(F.abs(c) >= first[0], at(first[1])).when(F.abs(c) >= second[0], at(second[1])).otherwise(at(last[1]))


def rounded_sql(c: str, fine: bool = True) -> str:
    at = lambda scale: f"floor({c} * {scale:.0e} + {HALF}) / {scale:.0e}"
    first, second, last = PLACES
    if not fine:
        return at(first[1])
    return f"CASE WHEN abs({c}) >= {first[0]:e} THEN {at(first[1])} WHEN abs({c}) >= {second[0]:e} THEN {at(second[1])} ELSE {at(last[1])} END"


@dataclass
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    keys: list[str]
    longs: list[str]
    doubles: list[str]
    fine: bool = True  # False: six places for all, where values are of order one and come out of differences

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        out = self.run(spark, sf_dir)
        out = out.select(*self.keys, *self.longs, *(F.col(c).cast("double").alias(c) for c in self.doubles))
        return out.select(*(F.col(k).cast("string").alias(k) for k in self.keys), *(F.col(c).cast("long").alias(c) for c in self.longs), *(rounded(F.col(c), self.fine).alias(c) for c in self.doubles))

    @property
    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        with_, _, body = self.sql.rpartition("\n---\n")
        cols = [f"CAST({k} AS VARCHAR) AS {k}" for k in self.keys] + [f'CAST("{c}" AS BIGINT) AS "{c}"' for c in self.longs]
        cols += [f"{rounded_sql(f'CAST({c} AS DOUBLE)', self.fine)} AS {c}" for c in self.doubles]
        return f"WITH RECURSIVE {with_}, result AS ({body}) SELECT {', '.join(cols)} FROM result"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _view(make):
    def view(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(events(spark, sf_dir), text_day=True)

    return view


mbo, lob, edge, both, mids = (_view(x) for x in (bridge.mbo, bridge.lob, bridge.lob_edge, bridge.both, bridge.mids))
