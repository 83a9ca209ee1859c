"""Queries of snapshot features."""

from pyspark.sql import functions as F

from tickforge.contract import RAW
from tickforge.operators import flow, lob as ops
from tickforge.plans.catalog import EDGE, LOB, MBO, Query, edge, lob, mbo

KEYS = ["day"]


def _all(view, columns, where=None):
    def run(spark, sf_dir):
        x = view(spark, sf_dir)
        x = x.where(where) if where else x
        return x.select("day", "seq", *(c.alias(n) for n, c in columns().items()))

    return run


def _sql(table: str, columns: dict[str, str], where: str = "true") -> str:
    return f"\n---\nSELECT day, seq, {', '.join(f'{x} AS {n}' for n, x in columns.items())} FROM {table} WHERE {where}"


def _query(view, with_, table, make, columns, longs=(), where=None) -> Query:
    return Query(_all(view, make, where), with_ + _sql(table, columns, where or "true"), KEYS, ["seq", *longs], [c for c in columns if c not in longs])


M = "((best_bid + best_ask) / 2e0 / 1e9)"
BV, AV = "list_sum(bid_sz)", "list_sum(ask_sz)"
MICRO = f"(CASE WHEN ask_sz[1] + bid_sz[1] > 0 THEN (best_bid / 1e9 * ask_sz[1] + best_ask / 1e9 * bid_sz[1]) / (ask_sz[1] + bid_sz[1]) ELSE {M} END)"
raw = {f"{s}_{k}_{i}": f"CASE WHEN {s}_px[{i + 1}] > 0 THEN {s}_px[{i + 1}] / 1e9 ELSE 0 END" if k == "price" else f"{s}_sz[{i + 1}]" for s in ("ask", "bid") for k in ("price", "size") for i in range(10)}
raw = {n: raw[n] for n in RAW}
normal = {f"{s}_{k}_{i}": f"CASE WHEN {M} IS NULL OR {s}_px[{i + 1}] <= 0 THEN 0 ELSE ({s}_px[{i + 1}] / 1e9 - {M}) / {M} END" if k == "price" else f"CASE WHEN {M} IS NULL THEN 0 ELSE {s}_sz[{i + 1}] / CASE WHEN {BV} + {AV} = 0 THEN 1e0 ELSE CAST({BV} + {AV} AS DOUBLE) END END" for s in ("ask", "bid") for k in ("price", "size") for i in range(10)}
derived = {
    "mid_price": M, "spread": "(best_ask - best_bid) / 1e9", "spread_bps": f"CASE WHEN {M} <= 0 THEN 0 ELSE (best_ask - best_bid) / 1e9 / {M} * 1e4 END", "total_bid_volume": BV, "total_ask_volume": AV,
    "volume_imbalance": f"CASE WHEN {BV} + {AV} = 0 THEN 0 ELSE CAST({BV} - {AV} AS DOUBLE) / ({BV} + {AV}) END", "weighted_mid_price": MICRO, "price_impact": f"abs({M} - {MICRO})",
}
depth = {f"{s}_levels": f"len(list_filter({s}_sz, lambda x: x > 0))" for s in ("bid", "ask")} | {
    f"{s}_mean_ticks": f"CASE WHEN best_{s} IS NULL OR len(list_filter({s}_sz, lambda x: x > 0)) = 0 THEN 0 ELSE list_avg(list_transform(list_filter(range(1, 11), lambda i: {s}_sz[i] > 0), lambda i: abs(best_{s} - {s}_px[i]) / 1e7)) END" for s in ("bid", "ask")
}
_v5 = lambda s: f"list_sum({s}_sz[1:5])"
analytics = {
    "spread": "(best_ask - best_bid) / 1e9", "microprice": MICRO, "depth_imbalance": f"CASE WHEN {_v5('bid')} + {_v5('ask')} = 0 THEN 0 ELSE CAST({_v5('bid')} - {_v5('ask')} AS DOUBLE) / ({_v5('bid')} + {_v5('ask')}) END",
    "vwap_bid": f"CASE WHEN {_v5('bid')} = 0 THEN 0 ELSE list_sum(list_transform(range(1, 6), lambda i: bid_px[i] / 1e9 * bid_sz[i])) / {_v5('bid')} END", "vwap_ask": f"CASE WHEN {_v5('ask')} = 0 THEN 0 ELSE list_sum(list_transform(range(1, 6), lambda i: ask_px[i] / 1e9 * ask_sz[i])) / {_v5('ask')} END",
    "bid_volume": _v5("bid"), "ask_volume": _v5("ask"), "active_bid": "len(list_filter(bid_sz, lambda x: x > 0))", "active_ask": "len(list_filter(ask_sz, lambda x: x > 0))",
    "is_valid": "CASE WHEN best_bid < best_ask THEN 1 ELSE 0 END", "is_crossed": "CASE WHEN best_bid > best_ask THEN 1 ELSE 0 END", "is_locked": "CASE WHEN best_bid = best_ask THEN 1 ELSE 0 END",
}
ti = {"spread": "(best_ask - best_bid) / 1e9", "mid_price": M} | {f"ask_gap_{i}": f"(ask_px[{i + 2}] - ask_px[{i + 1}]) / 1e9" for i in range(9)} | {f"bid_gap_{i}": f"(bid_px[{i + 1}] - bid_px[{i + 2}]) / 1e9" for i in range(9)}
fdepth = {f"{s}_cum_volume_{i}": f"list_sum({s}_sz[1:{i + 1}])" for s in ("bid", "ask") for i in range(10)} | {f"{s}_cum_distance_{i}": f"list_sum(list_transform({s}_px[1:{i + 1}], lambda x: {g} * (x - {s}_px[1]))) / 1e9" for s, g in (("bid", -1), ("ask", 1)) for i in range(10)}


def _ratio(x: str, y: str, empty: str = "0") -> str:
    return f"CASE WHEN {y} = 0 THEN {empty} ELSE CAST({x} AS DOUBLE) / {y} END"


# -- flow
W = "(PARTITION BY day ORDER BY seq)"
SIDE = lambda s, i, better: f"CASE WHEN {s}_px[{i}] {'>' if better else '<'} lag({s}_px[{i}]) OVER {W} THEN {s}_sz[{i}] WHEN {s}_px[{i}] {'<' if better else '>'} lag({s}_px[{i}]) OVER {W} THEN -lag({s}_sz[{i}]) OVER {W} ELSE {s}_sz[{i}] - lag({s}_sz[{i}]) OVER {W} END"
FLOW = f""", f AS (SELECT *, CASE WHEN best_bid IS NOT NULL AND lag(best_bid) OVER {W} IS NOT NULL THEN {SIDE("bid", 1, True)} END AS e_bid,
  CASE WHEN best_ask IS NOT NULL AND lag(best_ask) OVER {W} IS NOT NULL THEN {SIDE("ask", 1, False)} END AS e_ask, bid_sz[1] + ask_sz[1] AS depth,
  coalesce(lag(best_bid) OVER {W} <> best_bid OR lag(best_ask) OVER {W} <> best_ask OR lag(bid_sz[1]) OVER {W} <> bid_sz[1] OR lag(ask_sz[1]) OVER {W} <> ask_sz[1], false) AS changed,
  best_bid IS NOT NULL AND best_ask IS NOT NULL AND lag(best_bid) OVER {W} IS NOT NULL AND lag(best_ask) OVER {W} IS NOT NULL AS quoted,
  (ts_ns - first(ts_ns) OVER {W}) / 1e9 AS elapsed FROM edge)"""
SIGNED = "CASE WHEN m.action = 'T' THEN CASE WHEN m.side = 'A' THEN m.size ELSE -m.size END ELSE 0 END"
RUN = "(PARTITION BY day ORDER BY seq ROWS UNBOUNDED PRECEDING)"


def _cumulative(spark, sf_dir):
    trades = mbo(spark, sf_dir).where("action = 'T'").select("day", "seq", F.when(F.col("side") == "A", F.col("size")).otherwise(-F.col("size")).alias("signed"))
    return flow.cumulative(edge(spark, sf_dir), trades)


CUMULATIVE = EDGE + MBO.removeprefix(MBO[: MBO.index(", mbo AS")]) + FLOW + f""", g AS (SELECT f.*, {SIGNED} AS signed FROM f JOIN mbo m USING (day, seq))
---
SELECT day, seq, sum(coalesce(e_bid, 0)) OVER {RUN} AS ofi_bid, sum(coalesce(e_ask, 0)) OVER {RUN} AS ofi_ask, sum(coalesce(e_bid, 0) - coalesce(e_ask, 0)) OVER {RUN} AS ofi,
  {_ratio("bid_sz[1] - ask_sz[1]", "(bid_sz[1] + ask_sz[1])")} AS queue_imbalance, {_ratio(f"{BV} - {AV}", f"({BV} + {AV})")} AS depth_imbalance,
  {_ratio(f"sum(signed) OVER {RUN}", f"sum(abs(signed)) OVER {RUN}")} AS trade_imbalance,
  CASE WHEN elapsed = 0 THEN 0 ELSE sum(CASE WHEN e_bid <> 0 THEN 1 ELSE 0 END) OVER {RUN} / elapsed END AS arrival_rate_bid,
  CASE WHEN elapsed = 0 THEN 0 ELSE sum(CASE WHEN e_ask <> 0 THEN 1 ELSE 0 END) OVER {RUN} / elapsed END AS arrival_rate_ask FROM g"""

_level = lambda s, i, better: f"coalesce(CASE WHEN {s}_px[{i}] = 0 AND lag({s}_px[{i}]) OVER {W} = 0 THEN 0 WHEN lag({s}_px[{i}]) OVER {W} = 0 THEN {s}_sz[{i}] WHEN {s}_px[{i}] = 0 THEN -lag({s}_sz[{i}]) OVER {W} ELSE {SIDE(s, i, better)} END, 0)"
LEVELS = EDGE + f""", l AS (SELECT day, seq, {", ".join(f"{_level('bid', i + 1, True)} - {_level('ask', i + 1, False)} AS e{i}" for i in range(10))} FROM edge)
---
SELECT day, seq, {", ".join(f"sum(e{i}) OVER {RUN} AS ofi_level_{i}" for i in range(10))}, sum({" + ".join(f"e{i}" for i in range(10))}) OVER {RUN} AS mlofi,
  {" + ".join(f"sum(e{i}) OVER {RUN} / {i + 1}e0" for i in range(10))} AS mlofi_weighted FROM l"""

_ts = {"d_mid": "m", "d_spread": "s", "d_relative_spread": "rs", "d_bid_ask_ratio": "ba"}
SENSITIVE = LOB + f""", x AS (SELECT *, {M} AS m, (best_ask - best_bid) / 1e9 AS s, CAST({BV} AS DOUBLE) AS b, CAST({AV} AS DOUBLE) AS a, (ts_ns - lag(ts_ns) OVER {W}) / 1e9 AS d0 FROM lob),
y AS (SELECT *, s / m AS rs, CASE WHEN a = 0 THEN 1 ELSE b / a END AS ba, CASE WHEN d0 > 0 THEN d0 ELSE 1e0 END AS dt FROM x)
---
SELECT day, seq, {", ".join(f"coalesce(({c} - lag({c}) OVER {W}) / dt, 0) AS {n}" for n, c in _ts.items())}, abs(coalesce((m - lag(m) OVER {W}) / dt, 0)) AS abs_d_mid, b + a AS total_volume, b AS bid_volume, a AS ask_volume,
  rs AS relative_spread, ba AS bid_ask_ratio, {", ".join(f"coalesce((ask_px[{i + 1}] - lag(ask_px[{i + 1}]) OVER {W}) / 1e9 / dt, 0) AS d_ask_price_{i}" for i in range(10))} FROM y"""
SENSITIVE_COLUMNS = ["d_mid", "d_spread", "abs_d_mid", "total_volume", "bid_volume", "ask_volume", "relative_spread", "d_relative_spread", "bid_ask_ratio", "d_bid_ask_ratio", *(f"d_ask_price_{i}" for i in range(10))]

# -- impact
IMPACT = ["vwap", "best", "slippage", "slippage_bps", "fill_ratio", "cost"]
IMPACT_LONGS = ["levels_used", "filled", "requested", "can_fill"]


def _impact(side: str, quantities: list[int]):
    def run(spark, sf_dir):
        x = edge(spark, sf_dir).withColumn("q", F.explode(F.array(*(F.lit(q) for q in quantities))))
        return x.select("day", "seq", *(c.alias(n) for n, c in ops.impact(side, F.col("q")).items()))

    return run


def _impact_sql(side: str, quantities: list[int]) -> str:
    s, slip = ("ask", "vwap - best") if side == "buy" else ("bid", "best - vwap")
    return EDGE + f""", q AS (SELECT day, seq, coalesce(best_{s}, 0) / 1e9 AS best, unnest({quantities}) AS requested, {s}_px AS px, list_transform(range(1, 11), lambda i: CASE WHEN {s}_px[i] > 0 THEN {s}_sz[i] ELSE 0 END) AS sz FROM edge),
t AS (SELECT *, list_transform(range(1, 11), lambda i: greatest(least(sz[i], requested - coalesce(list_sum(sz[1:i - 1]), 0)), 0)) AS taken FROM q),
u AS (SELECT *, list_sum(taken) AS filled, list_sum(list_transform(range(1, 11), lambda i: px[i] / 1e9 * taken[i])) AS cost, len(list_filter(taken, lambda x: x > 0)) AS levels_used FROM t),
v AS (SELECT *, CASE WHEN filled = 0 THEN 0 ELSE cost / filled END AS vwap FROM u),
w AS (SELECT *, CASE WHEN filled = 0 THEN 0 ELSE {slip} END AS slippage FROM v)
---
SELECT day, seq, vwap, best, slippage, CASE WHEN best = 0 THEN 0 ELSE slippage / best END * 1e4 AS slippage_bps, levels_used, filled, requested, CAST(filled AS DOUBLE) / requested AS fill_ratio, cost, CASE WHEN filled >= requested THEN 1 ELSE 0 END AS can_fill FROM w"""


def _liquidity(spark, sf_dir):
    parts = [edge(spark, sf_dir).select("day", "seq", F.lit(b).alias("bps"), *(c.alias(n) for n, c in ops.liquidity(b).items())) for b in (3, 7, 15)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


LIQUIDITY = EDGE + f"""
---
SELECT day, seq, bps, CASE WHEN {M} IS NULL THEN 0 ELSE coalesce(list_sum(list_transform(range(1, 11), lambda i: CASE WHEN bid_px[i] > 0 AND bid_px[i] / 1e9 >= {M} * (1 - bps / 1e4) THEN bid_sz[i] ELSE 0 END)), 0) END AS bid_volume,
  CASE WHEN {M} IS NULL THEN 0 ELSE coalesce(list_sum(list_transform(range(1, 11), lambda i: CASE WHEN ask_px[i] > 0 AND ask_px[i] / 1e9 <= {M} * (1 + bps / 1e4) THEN ask_sz[i] ELSE 0 END)), 0) END AS ask_volume
FROM (SELECT *, unnest([3, 7, 15]) AS bps FROM edge)"""

def _imbalances():
    from tickforge.functions import books

    return {"queue_imbalance": books.imbalance(1), **{f"depth_imbalance_{n}": books.imbalance(n) for n in (3, 5, 10)}}


def _validity():
    from tickforge.functions import books

    return {"book_valid": books.valid().cast("int")}


_of = lambda n: _ratio(f"list_sum(bid_sz[1:{n}]) - list_sum(ask_sz[1:{n}])", f"(list_sum(bid_sz[1:{n}]) + list_sum(ask_sz[1:{n}]))")
IMBALANCES = {"queue_imbalance": _of(1), **{f"depth_imbalance_{n}": _of(n) for n in (3, 5, 10)}}
SAMPLES = LOB + f"""
---
SELECT day, seq, {", ".join(f"{x} AS {n}" for n, x in (raw | derived).items())} FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY seq) AS rn FROM lob) WHERE rn % 10 = 0"""


def _samples(spark, sf_dir):
    from tickforge.plans.flagship import samples

    return samples(spark, sf_dir)


QUOTED = "best_bid IS NOT NULL AND best_ask IS NOT NULL"
QUERIES = {
    "samples48": Query(_samples, SAMPLES, KEYS, ["seq"], [*raw, *derived]),
    "imbalances": _query(edge, EDGE, "edge", _imbalances, IMBALANCES),
    "book_valid": _query(edge, EDGE, "edge", _validity, {"book_valid": "CASE WHEN best_bid < best_ask THEN 1 ELSE 0 END"}, ["book_valid"]),
    "lob_raw": _query(edge, EDGE, "edge", ops.raw, raw),
    "lob_normalized": _query(edge, EDGE, "edge", ops.normalized, normal),
    "derived": _query(edge, EDGE, "edge", ops.derived, derived, where=QUOTED),
    "depth_features": _query(edge, EDGE, "edge", ops.depth, depth, ["bid_levels", "ask_levels"]),
    "book_analytics": _query(edge, EDGE, "edge", ops.analytics, analytics, ["bid_volume", "ask_volume", "active_bid", "active_ask", "is_valid", "is_crossed", "is_locked"]),
    "fi2010_ti": _query(lob, LOB, "lob", ops.fi2010_insensitive, ti),
    "fi2010_ts": Query(lambda spark, d: ops.fi2010_sensitive(lob(spark, d))[0], SENSITIVE, KEYS, ["seq"], SENSITIVE_COLUMNS),
    "fi2010_depth": _query(edge, EDGE, "edge", ops.fi2010_depth, fdepth),
    "orderflow_cum": Query(_cumulative, CUMULATIVE, KEYS, ["seq", "ofi_bid", "ofi_ask", "ofi"], ["queue_imbalance", "depth_imbalance", "trade_imbalance", "arrival_rate_bid", "arrival_rate_ask"]),
    "mlofi": Query(lambda spark, d: flow.multi_level(edge(spark, d)), LEVELS, KEYS, ["seq", "mlofi", *(f"ofi_level_{i}" for i in range(10))], ["mlofi_weighted"]),
    "impact_buy": Query(_impact("buy", [800]), _impact_sql("buy", [800]), KEYS, ["seq", *IMPACT_LONGS], IMPACT),
    "impact_sell": Query(_impact("sell", [800]), _impact_sql("sell", [800]), KEYS, ["seq", *IMPACT_LONGS], IMPACT),
    "impact_sizes": Query(_impact("buy", [50, 1000, 9000]), _impact_sql("buy", [50, 1000, 9000]), KEYS, ["seq", *IMPACT_LONGS], IMPACT),
    "liquidity_bps": Query(_liquidity, LIQUIDITY, KEYS, ["seq", "bps", "bid_volume", "ask_volume"], []),
}
