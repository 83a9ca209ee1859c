"""Queries of message windows, order lives, signals, samplers and experimental groups."""

from pyspark.sql import functions as F

from tickforge.operators import book, experimental, flow, mbo as ops, sampling, signals
from tickforge.plans.books import BV, AV, FLOW, RUN, W, _ratio
from tickforge.plans.catalog import EDGE, EVERY, FAST, LOB, MBO, MEDIUM, MIDS, SLOW, Query, both, edge, lob, mbo, mids

KEYS = ["day"]
ONLY_MBO = MBO.removeprefix(MBO[: MBO.index(", mbo AS")])


def frame(n: int) -> str:
    return f"(PARTITION BY day ORDER BY seq ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def cnt(a: str, s: str, n: int = MEDIUM) -> str:
    return f"sum(CASE WHEN action = '{a}' AND side = '{s}' THEN 1 ELSE 0 END) OVER {frame(n)}"


DUR = "greatest((ts_ns - first(ts_ns) OVER (PARTITION BY day ORDER BY seq)) / 1e9, 0.001e0)"
COUNTS = MBO + f""", c AS (SELECT *, {DUR} AS duration, {", ".join(f"{cnt(a, s)} AS {a}{s}" for a in "ACT" for s in "BA")},
  {cnt("A", "B", FAST)} AS fb, {cnt("A", "A", FAST)} AS fa, {cnt("A", "B", SLOW)} AS sb, {cnt("A", "A", SLOW)} AS sa FROM mbo)"""
RATES = {f"{n}_rate_{s}": f"{a}{x} / duration" for n, a in (("add", "A"), ("cancel", "C"), ("trade", "T")) for s, x in (("bid", "B"), ("ask", "A"))}
_net = lambda x, y: f"(({x}) - ({y})) / (({x}) + ({y}) + 1e-8)"
NETS = {"net_order_flow": _net("AB", "AA"), "net_cancel_flow": _net("CA", "CB"), "net_trade_flow": _net("TA", "TB"), "aggressive_order_ratio": "(TB + TA) / (AB + AA + TB + TA + 1e-8)"}
REGIME = {"flow_regime_indicator": f"greatest(least({_net('fb', 'fa')} / greatest(abs({_net('sb', 'sa')}), 0.01e0), 10e0), -10e0)"}
CTA = {"cancel_to_add_ratio": "CASE WHEN AB + AA = 0 THEN CASE WHEN CB + CA = 0 THEN 1e0 ELSE 10e0 END ELSE least(CAST(CB + CA AS DOUBLE) / (AB + AA), 10e0) END"}


def _flow(spark, sf_dir):
    return ops.flow_features(mbo(spark, sf_dir), MEDIUM, FAST, SLOW)


def _counted(columns: dict[str, str]) -> Query:
    return Query(_flow, f"{COUNTS}\n---\nSELECT day, seq, {', '.join(f'{x} AS {n}' for n, x in columns.items())} FROM c", KEYS, ["seq"], list(columns))


SIZES = MBO + f""", z AS (SELECT *, list(size) OVER {frame(MEDIUM)} AS sz, list(side) OVER {frame(MEDIUM)} AS sd, avg(size) OVER {frame(MEDIUM)} AS mean, stddev_pop(size) OVER {frame(MEDIUM)} AS std, {DUR} AS duration, row_number() OVER {W} AS rn FROM mbo),
p AS (SELECT *, list_sort(sz) AS so, len(sz) AS n FROM z),
q AS (SELECT *, so[CAST(floor(n * 1 / 4) AS INT) + 1] AS size_p25, so[CAST(floor(n * 2 / 4) AS INT) + 1] AS size_p50, so[CAST(floor(n * 3 / 4) AS INT) + 1] AS size_p75, so[CAST(floor(n * 9 / 10) AS INT) + 1] AS size_p90 FROM p),
r AS (SELECT *, coalesce(list_sum(list_transform(range(1, n + 1), lambda i: CASE WHEN sz[i] > size_p90 AND sd[i] = 'B' THEN sz[i] ELSE 0 END)), 0) AS lb, coalesce(list_sum(list_transform(range(1, n + 1), lambda i: CASE WHEN sz[i] > size_p90 AND sd[i] = 'A' THEN sz[i] ELSE 0 END)), 0) AS la,
  len(list_filter(sz, lambda x: x > size_p90)) AS large FROM q)"""
MOMENTS = {
    "size_zscore": "(size - mean) / (std + 1e-8)",
    "size_skewness": "CASE WHEN n < 3 OR std < 1e-10 THEN 0 ELSE list_avg(list_transform(sz, lambda x: pow((x - mean) / std, 3))) END",
    "size_concentration": "list_sum(list_transform(sz, lambda x: CAST(x AS DOUBLE) * x)) / pow(CAST(list_sum(sz) AS DOUBLE), 2)",
}
LARGE = {"large_order_ratio": "CAST(large AS DOUBLE) / n", "large_order_frequency": "large / duration", "large_order_imbalance": "(lb - la) / (lb + la + 1e-8)"}


FIRED = f"rn % {EVERY} = 0"


def _fires():
    """Every EVERY-th message: order statistics are given where a sample is taken."""
    from tickforge.functions.frames import ordered

    return F.row_number().over(ordered()) % EVERY == 0


def _at_samples(make):
    """A query over the messages at which `make` gives what it gathers."""
    return lambda s, d: make(mbo(s, d).withColumn("fires", _fires()), F.col("fires"))


def _sized(columns: dict[str, str], longs: list[str]) -> Query:
    return Query(_at_samples(lambda m, at: ops.size_features(m, MEDIUM, at)), f"{SIZES}\n---\nSELECT day, seq, {', '.join(f'{x} AS {n}' for n, x in columns.items())} FROM r WHERE {FIRED}", KEYS, ["seq", *longs], [c for c in columns if c not in longs])


FLOWVOL = MBO + f""", g AS (SELECT *, list(CASE WHEN action = 'A' THEN CASE WHEN side = 'B' THEN 1 ELSE -1 END ELSE 0 END) OVER {frame(MEDIUM)} AS g, row_number() OVER {W} AS rn FROM mbo),
h AS (SELECT *, len(g) AS n, len(g) // 10 AS k FROM g),
x AS (SELECT *, list_transform(range(0, 10), lambda i: list_sum(CASE WHEN i < 9 THEN g[k * i + 1 : k * i + k] ELSE g[k * 9 + 1 : n] END) / (len(list_filter(CASE WHEN i < 9 THEN g[k * i + 1 : k * i + k] ELSE g[k * 9 + 1 : n] END, lambda v: v <> 0)) + 1e-8)) AS x FROM h WHERE n >= 50)
---
SELECT h.day, h.seq, CASE WHEN h.n < 50 THEN 0 ELSE list_stddev_pop(x.x) END AS order_flow_volatility FROM h LEFT JOIN x USING (day, seq) WHERE h.{FIRED}"""

HHI = f"{_ratio('list_sum(list_transform(list_concat(bid_sz, ask_sz), lambda x: CAST(x AS DOUBLE) * x))', f'pow(CAST({BV} + {AV} AS DOUBLE), 2)')}"
TICKS = {f"depth_ticks_{s}": f"CASE WHEN best_{s} IS NULL THEN 0 ELSE {_ratio(f'list_sum(list_transform(range(1, 11), lambda i: CASE WHEN {s}_px[i] > 0 THEN (abs(best_{s} - {s}_px[i]) // 10000000) * {s}_sz[i] ELSE 0 END))', f'list_sum(list_transform(range(1, 11), lambda i: CASE WHEN {s}_px[i] > 0 THEN {s}_sz[i] ELSE 0 END))')} END" for s in ("bid", "ask")}

# -- order lives
ONE = "(PARTITION BY day, order_id ORDER BY seq ROWS UNBOUNDED PRECEDING)"
LIFE = "(PARTITION BY day, order_id, life ORDER BY seq ROWS UNBOUNDED PRECEDING)"
NEXT = "(PARTITION BY day, order_id, life ORDER BY seq)"
def lives_sql(kept: int = MEDIUM) -> str:
    return MBO + f""", a AS (SELECT *, sum(CASE WHEN action = 'A' THEN 1 ELSE 0 END) OVER {ONE} AS life FROM mbo),
b AS (SELECT *, first(ts_ns) OVER {LIFE} AS created, first(size) OVER {LIFE} AS original, sum(CASE WHEN action = 'T' THEN size ELSE 0 END) OVER {LIFE} AS sold, least(sum(CASE WHEN action = 'M' THEN 1 ELSE 0 END) OVER {LIFE}, 255) AS mods,
  max(CASE WHEN action = 'C' THEN 1 ELSE 0 END) OVER {LIFE} AS cancelled, sum(CASE WHEN action = 'T' THEN 1 ELSE 0 END) OVER {LIFE} AS trades, min(CASE WHEN action = 'T' THEN ts_ns END) OVER {LIFE} AS first_fill FROM a),
c AS (SELECT *, life > 0 AND (cancelled = 1 OR sold >= original) AS over FROM b),
d AS (SELECT *, coalesce(lag(over) OVER {NEXT}, false) OR life = 0 AS dead FROM c),
lives AS (SELECT *, over AND NOT dead AS ends FROM d),
whole AS (SELECT day, order_id, life, any_value(created) AS created, min(CASE WHEN ends THEN seq END) AS end_seq, min(seq) AS begin_seq, min(CASE WHEN action = 'T' AND NOT dead THEN seq END) AS fill_seq, min(CASE WHEN action = 'T' AND NOT dead THEN ts_ns END) AS fill_ts FROM lives WHERE life > 0 GROUP BY day, order_id, life),
spans AS (SELECT *, least(coalesce(end_seq, 9000000000000000), coalesce(lead(begin_seq) OVER (PARTITION BY day, order_id ORDER BY life), 9000000000000000)) AS stop_seq FROM whole),
act AS (SELECT m.day, m.seq, m.ts_ns, count(s.order_id) AS active_order_count, coalesce(avg((m.ts_ns - s.created) / 1e9), 0) AS avg_order_age,
  coalesce(avg(CASE WHEN s.fill_seq <= m.seq THEN (s.fill_ts - s.created) / 1e9 END), 0) AS avg_time_to_first_fill
  FROM mbo m LEFT JOIN spans s ON s.day = m.day AND s.begin_seq <= m.seq AND s.stop_seq > m.seq GROUP BY m.day, m.seq, m.ts_ns),
done AS (SELECT day, seq, avg(mods) OVER w AS ms, avg(CAST(least(sold, original) AS DOUBLE) / original) OVER w AS fr, quantile_cont((ts_ns - created) / 1e9, 0.5) OVER w AS ml FROM lives WHERE ends WINDOW w AS (PARTITION BY day ORDER BY seq ROWS BETWEEN {kept - 1} PRECEDING AND CURRENT ROW)),
j AS (SELECT act.*, coalesce(last(ms IGNORE NULLS) OVER {RUN}, 0) AS modification_score, coalesce(last(fr IGNORE NULLS) OVER {RUN}, 0) AS avg_fill_ratio, coalesce(last(ml IGNORE NULLS) OVER {RUN}, 0) AS median_order_lifetime FROM act LEFT JOIN done USING (day, seq))"""


def lifecycle_sql(kept: int = MEDIUM) -> str:
    return lives_sql(kept) + """
---
SELECT *, CASE WHEN active_order_count > 0 THEN avg_fill_ratio * least(modification_score / 10, 1) ELSE 0 END AS iceberg_proxy FROM j"""


LIVES, LIFECYCLE = lives_sql(), lifecycle_sql()


# -- signals
def interval_sql(books: str = EDGE + ONLY_MBO) -> str:
    """`books`: tables `mbo`, and `edge` with the book behind each message."""
    return books + FLOW + f""", n AS (SELECT *, row_number() OVER {W} AS rn FROM f),
em AS (SELECT *, CASE WHEN rn % {EVERY} = 0 AND best_bid IS NOT NULL AND best_ask IS NOT NULL THEN 1 ELSE 0 END AS em FROM n),
iv AS (SELECT *, sum(em) OVER {RUN} - em AS sample_idx, sum(CASE WHEN changed THEN 1 ELSE 0 END) OVER {RUN} AS warm FROM em),
sums AS (SELECT day, sample_idx, sum(CASE WHEN quoted THEN e_bid - e_ask ELSE 0 END) AS true_ofi, avg(depth) AS ad, sum(CASE WHEN best_bid >= best_ask THEN 1 ELSE 0 END) AS invalidity_delta FROM iv GROUP BY day, sample_idx),
sam AS (SELECT iv.*, true_ofi, ad, invalidity_delta FROM iv JOIN sums USING (day, sample_idx) WHERE em = 1)"""


INTERVAL = interval_sql()
FLOWSIG = {"true_ofi": "true_ofi", "depth_norm_ofi": "CASE WHEN ad <= 1e-10 THEN 0 ELSE true_ofi / ad END", "mbo_ready": "CASE WHEN warm >= 100 THEN 1 ELSE 0 END", "dt_seconds": f"coalesce((ts_ns - lag(ts_ns) OVER {W}) / 1e9, 0)", "invalidity_delta": "invalidity_delta"}


def _emitted(spark, sf_dir):
    rows = sampling.every(flow.contributions(edge(spark, sf_dir)), EVERY)
    return signals.flow_signals(rows, F.col("fires") & F.col("best_bid").isNotNull() & F.col("best_ask").isNotNull())


def _signals14(spark, sf_dir):
    from tickforge.operators import lob as book_ops

    rows = flow.contributions(ops.flow_features(both(spark, sf_dir), MEDIUM, FAST, SLOW))
    x = signals.flow_signals(rows, _fires() & F.col("best_bid").isNotNull() & F.col("best_ask").isNotNull())
    return x.withColumns(book_ops.derived() | ops.book_features()).withColumns(signals.combined())


def regime_sql(ts: str) -> str:
    minute = f"(((ts_ns // 60000000000) - CASE WHEN (ts_ns // 86400000000000) % 365 >= 70 AND (ts_ns // 86400000000000) % 365 < 307 THEN 240 ELSE 300 END) % 1440)"
    return f"CASE WHEN {minute} < 570 OR {minute} >= 960 THEN 4 WHEN {minute} < 585 THEN 0 WHEN {minute} < 630 THEN 1 WHEN {minute} < 930 THEN 2 ELSE 3 END".replace("ts_ns", ts)


from tickforge.plans.books import derived as _derived  # noqa: E402

_part = lambda x, y: f"CASE WHEN abs({x} + {y}) <= 1e-10 THEN 0 ELSE ({x} - {y}) / ({x} + {y}) END"
def signals_sql(books: str = EDGE + ONLY_MBO) -> str:
    out = interval_sql(books) + COUNTS.removeprefix(COUNTS[: COUNTS.index(", c AS")]) + f""", full_ AS (SELECT sam.*, {", ".join(f"{x} AS {n}" for n, x in FLOWSIG.items() if n not in ("true_ofi", "invalidity_delta"))},
  {", ".join(f"{x} AS {n}" for n, x in _derived.items() if n in ("mid_price", "weighted_mid_price", "total_bid_volume", "total_ask_volume"))}, {HHI} AS hhi, {", ".join(f"{x} AS {n}" for n, x in TICKS.items())} FROM sam),
k AS (SELECT full_.*, {", ".join(f"{x} AS {n}" for n, x in RATES.items())} FROM full_ JOIN c USING (day, seq) ) 
---
SELECT day, seq, sample_idx, true_ofi, depth_norm_ofi, trade_rate_ask - trade_rate_bid AS executed_pressure, (weighted_mid_price - mid_price) / mid_price * 1e4 AS signed_mp_delta_bps, {_part("trade_rate_ask", "trade_rate_bid")} AS trade_asymmetry,
  {_part("cancel_rate_ask", "cancel_rate_bid")} AS cancel_asymmetry, CASE WHEN (total_bid_volume + total_ask_volume) / 2e0 <= 1 THEN hhi ELSE hhi / ln((total_bid_volume + total_ask_volume) / 2e0) END AS fragility_score,
  {_part("depth_ticks_bid", "depth_ticks_ask")} AS depth_asymmetry, CASE WHEN best_bid < best_ask THEN 1 ELSE 0 END AS book_valid, {regime_sql("ts_ns")} AS time_regime, mbo_ready, dt_seconds, invalidity_delta, 2.2e0 AS schema_version FROM k"""
    return out.replace("FROM full_ JOIN c USING (day, seq) ) ", "FROM full_ JOIN (SELECT day, seq, duration, AB, AA, CB, CA, TB, TA FROM c) USING (day, seq))")


SIG14 = signals_sql()
SEASON = """(ts_ns % 86400000000000) / 60e9 - CASE WHEN (ts_ns // 86400000000000) % 365 BETWEEN 70 AND 307 THEN 810 ELSE 870 END"""


def _seasonality(spark, sf_dir):
    x = mbo(spark, sf_dir).withColumns(signals.seasonality(F.col("ts_ns")))
    return x.withColumn("label", signals.bucket_label(F.col("time_bucket")))


SEASONAL = MBO + f""", x AS (SELECT *, {SEASON} AS m FROM mbo), y AS (SELECT *, greatest(least(m, 390e0), 0e0) AS minutes_since_open, greatest(least(390e0 - m, 390e0), 0e0) AS minutes_until_close FROM x),
z AS (SELECT *, minutes_since_open / 390e0 AS session_progress, CAST(least(floor(minutes_since_open / 15), 25) AS BIGINT) AS time_bucket FROM y)
---
SELECT *, printf('%02d:%02d-%02d:%02d', (570 + time_bucket * 15) // 60, (570 + time_bucket * 15) % 60, (585 + time_bucket * 15) // 60, (585 + time_bucket * 15) % 60) AS label FROM z"""

# -- experimental
LOTS = MBO + f""", add_ AS (SELECT day, seq, CASE WHEN count(*) OVER w < 2 THEN 1 ELSE stddev_pop(size) OVER w / avg(size) OVER w END AS cv FROM mbo WHERE action = 'A' WINDOW w AS (PARTITION BY day ORDER BY seq ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
x AS (SELECT m.*, cv, sum(CASE WHEN action = 'A' THEN 1 ELSE 0 END) OVER {frame(200)} AS a, sum(CASE WHEN action = 'A' AND size % 100 = 0 THEN 1 ELSE 0 END) OVER {frame(200)} AS r, sum(CASE WHEN action = 'A' AND size < 100 THEN 1 ELSE 0 END) OVER {frame(200)} AS o FROM mbo m LEFT JOIN add_ USING (day, seq))
---
SELECT day, seq, {_ratio("r", "a")} AS round_lot_ratio, {_ratio("o", "a")} AS odd_lot_ratio, coalesce(last(cv IGNORE NULLS) OVER {RUN}, 1) AS size_clustering FROM x"""
SWEEP = MBO + f""", t AS (SELECT day, seq, CASE WHEN price <> lag(price) OVER {W} THEN 1 ELSE 0 END AS s FROM mbo WHERE action = 'T'),
x AS (SELECT m.day, m.seq, count(s) OVER {frame(200).replace("day ORDER BY seq", "m.day ORDER BY m.seq")} AS t, coalesce(sum(s) OVER {frame(200).replace("day ORDER BY seq", "m.day ORDER BY m.seq")}, 0) AS n FROM mbo m LEFT JOIN t USING (day, seq))
---
SELECT day, seq, CASE WHEN t <= 1 THEN 0 ELSE least(1, CAST(n AS DOUBLE) / (t - 1)) END AS sweep_ratio FROM x"""
MODCANCEL = MBO + f""", a AS (SELECT *, sum(CASE WHEN action = 'A' THEN 1 ELSE 0 END) OVER {ONE} AS life FROM mbo),
b AS (SELECT *, max(CASE WHEN action = 'M' THEN 1 ELSE 0 END) OVER {LIFE} AS md FROM a),
c AS (SELECT *, sum(CASE WHEN action = 'C' THEN 1 ELSE 0 END) OVER {frame(200)} AS c, sum(CASE WHEN action = 'C' AND md = 1 THEN 1 ELSE 0 END) OVER {frame(200)} AS cm FROM b)
---
SELECT day, seq, {_ratio("cm", "c")} AS mod_before_cancel FROM c"""
VOL = """, r AS (SELECT day, t AS sample_idx, ln(p / lag(p) OVER (PARTITION BY day ORDER BY t)) AS r FROM mids),
q AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY sample_idx) AS i, coalesce(stddev_pop(r) OVER (PARTITION BY day ORDER BY sample_idx ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) * 2430 AS f,
  coalesce(stddev_pop(r) OVER (PARTITION BY day ORDER BY sample_idx ROWS BETWEEN 499 PRECEDING AND CURRENT ROW), 0) * 2430 AS s, list(r) OVER (PARTITION BY day ORDER BY sample_idx ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS x FROM r WHERE abs(r) < 0.1e0),
q2 AS (SELECT *, list_transform(x, lambda v: v - list_avg(x)) AS d FROM q),
q3 AS (SELECT *, list_sum(list_transform(d, lambda v: v * v)) AS den, list_sum(list_transform(range(1, len(d)), lambda k: d[k] * d[k + 1])) AS num FROM q2),
rd AS (SELECT day, sample_idx, f, lag(f) OVER (PARTITION BY day ORDER BY sample_idx) AS f0, stddev_pop(CASE WHEN f > 1e-10 THEN f END) OVER (PARTITION BY day ORDER BY sample_idx ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS vv FROM q WHERE i % 10 = 0),
j AS (SELECT m.day, m.t AS sample_idx, q3.f, q3.s, CASE WHEN q3.f IS NULL THEN NULL WHEN len(x) < 10 OR abs(den) <= 1e-10 THEN 0 ELSE num / den END AS ac, CASE WHEN rd.f IS NULL THEN NULL WHEN rd.f0 IS NULL OR abs(rd.f0) <= 1e-10 THEN 0 ELSE (rd.f - rd.f0) / rd.f0 END AS mo, CASE WHEN rd.f IS NULL THEN NULL ELSE coalesce(vv, 0) END AS vv
  FROM mids m LEFT JOIN q3 ON q3.day = m.day AND q3.sample_idx = m.t LEFT JOIN rd ON rd.day = m.day AND rd.sample_idx = m.t),
k AS (SELECT day, sample_idx, coalesce(last(f IGNORE NULLS) OVER w, 0) AS realized_vol_fast, coalesce(last(s IGNORE NULLS) OVER w, 0) AS realized_vol_slow, coalesce(last(ac IGNORE NULLS) OVER w, 0) AS return_autocorr, coalesce(last(mo IGNORE NULLS) OVER w, 0) AS vol_momentum, coalesce(last(vv IGNORE NULLS) OVER w, 0) AS vol_of_vol FROM j WINDOW w AS (PARTITION BY day ORDER BY sample_idx ROWS UNBOUNDED PRECEDING))
---
SELECT *, CASE WHEN realized_vol_slow <= 1e-10 THEN 1 ELSE realized_vol_fast / realized_vol_slow END AS vol_ratio FROM k"""
PATIENCE = LIVES + f""", pw AS (SELECT day, seq, list_sort(list_filter(list(CASE WHEN action = 'A' THEN size END) OVER (PARTITION BY day ORDER BY seq ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING), lambda x: x IS NOT NULL)) AS w FROM mbo),
p9 AS (SELECT day, seq, CASE WHEN w IS NULL OR len(w) = 0 THEN 1000 ELSE w[CAST(floor(len(w) * 9 / 10) AS INT) + 1] END AS p90 FROM pw),
fl AS (SELECT l.day, l.seq, l.side, avg((l.ts_ns - l.created) / 1e9) OVER (PARTITION BY l.day, l.side ORDER BY l.seq ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS pt FROM lives l JOIN p9 USING (day, seq) WHERE NOT dead AND action = 'T' AND trades = 1 AND original >= p90),
jj AS (SELECT m.day, m.seq, CASE WHEN m.side = 'B' THEN pt END AS pb, CASE WHEN m.side = 'A' THEN pt END AS pa FROM mbo m LEFT JOIN fl USING (day, seq))
---
SELECT day, seq, coalesce(last(pb IGNORE NULLS) OVER {RUN}, 0) AS fill_patience_bid, coalesce(last(pa IGNORE NULLS) OVER {RUN}, 0) AS fill_patience_ask FROM jj"""

# -- samplers
TARGET, GAP = 1500, 1_000_000
VOLUME = MBO + f""", n AS (SELECT *, row_number() OVER {W} AS rn FROM mbo),
v AS (SELECT day, rn, size AS acc, CAST(NULL AS BIGINT) AS last_ts, ts_ns, size >= {TARGET} AS fires FROM n WHERE rn = 1
  UNION ALL SELECT n.day, n.rn, CASE WHEN v.fires THEN 0 ELSE v.acc END + n.size, CASE WHEN v.fires THEN v.ts_ns ELSE v.last_ts END, n.ts_ns,
    CASE WHEN v.fires THEN 0 ELSE v.acc END + n.size >= {TARGET} AND (CASE WHEN v.fires THEN v.ts_ns ELSE v.last_ts END IS NULL OR n.ts_ns - CASE WHEN v.fires THEN v.ts_ns ELSE v.last_ts END >= {GAP}) FROM v JOIN n ON n.day = v.day AND n.rn = v.rn + 1)"""


def _volume(spark, sf_dir):
    return sampling.by_volume(mbo(spark, sf_dir), TARGET, GAP)


ROLL = """, r AS (SELECT day, t, p, ln(p / lag(p) OVER (PARTITION BY day ORDER BY t)) AS r FROM mids),
rv AS (SELECT day, t, count(r) OVER w AS n_returns, avg(r) OVER w AS mean_return, CASE WHEN count(r) OVER w >= 2 THEN greatest(stddev_samp(r) OVER w, 1e-10) END AS volatility FROM r WINDOW w AS (PARTITION BY day ORDER BY t ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))"""
ADAPT = MIDS + ROLL + """, k AS (SELECT *, CASE WHEN volatility IS NOT NULL THEN count(volatility) OVER (PARTITION BY day ORDER BY t) END AS k FROM rv),
bs AS (SELECT day, quantile_cont(volatility, 0.5) AS base, max(k) AS got FROM k WHERE k <= 100 GROUP BY day)
---
SELECT day, t, CAST(CASE WHEN k > 100 AND got >= 100 AND base >= 1e-10 THEN greatest(1, round(greatest(least(volatility / base, 2e0), 0.5e0) * 1000)) ELSE 1000 END AS BIGINT) AS threshold FROM k JOIN bs USING (day)"""


def _reconstruct(spark, sf_dir):
    x = book.reconstruct(ops.system_filter(mbo(spark, sf_dir)))
    return x.withColumns({"bid_size": x.bid_sz[0], "ask_size": x.ask_sz[0]})


# -- the book behind each message, from the state that each order has until its next message
STATES = MBO + """, am AS (SELECT *, sum(CASE WHEN action IN ('A', 'M') THEN 1 ELSE 0 END) OVER (PARTITION BY day, order_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS g FROM mbo WHERE action IN ('A', 'M', 'C', 'T')),
os AS (SELECT day, seq, first(side) OVER p AS side, first(price) OVER p AS price, first(seq) OVER p AS entry, greatest(first(size) OVER p - sum(CASE WHEN action IN ('C', 'T') THEN size ELSE 0 END) OVER p, 0) AS rest,
  lead(seq) OVER (PARTITION BY day, order_id ORDER BY seq) AS until_ FROM am WHERE g > 0 WINDOW p AS (PARTITION BY day, order_id, g ORDER BY seq ROWS UNBOUNDED PRECEDING))"""
REBUILT = STATES + """, lv AS (SELECT day, side, price, seq, sum(d) OVER (PARTITION BY day, side, price ORDER BY seq) AS sz, lead(seq) OVER (PARTITION BY day, side, price ORDER BY seq) AS nx
  FROM (SELECT day, seq, side, price, sum(d) AS d FROM (SELECT day, seq, side, price, rest AS d FROM os UNION ALL SELECT day, until_, side, price, -rest FROM os WHERE until_ IS NOT NULL) GROUP BY ALL)),
bk AS (SELECT m.day, m.seq, m.ts_ns, list(l.price ORDER BY l.price DESC) FILTER (WHERE l.side = 'B') AS bp, list(l.sz ORDER BY l.price DESC) FILTER (WHERE l.side = 'B') AS bs, list(l.price ORDER BY l.price) FILTER (WHERE l.side = 'A') AS ap, list(l.sz ORDER BY l.price) FILTER (WHERE l.side = 'A') AS az
  FROM mbo m LEFT JOIN lv l ON l.day = m.day AND l.seq <= m.seq AND (l.nx IS NULL OR l.nx > m.seq) AND l.sz > 0 GROUP BY m.day, m.seq, m.ts_ns),
edge AS (SELECT day, seq, ts_ns, """ + ", ".join(f"list_transform(range(1, 11), lambda i: CAST(coalesce({x}[i], 0) AS BIGINT)) AS {n}" for n, x in (("bid_px", "bp"), ("bid_sz", "bs"), ("ask_px", "ap"), ("ask_sz", "az"))) + """, bp[1] AS best_bid, ap[1] AS best_ask FROM bk)"""
QUEUES = STATES + """, al AS (SELECT m.day, m.seq, o.side, o.price, o.entry, o.rest FROM mbo m JOIN os o ON o.day = m.day AND o.seq <= m.seq AND (o.until_ IS NULL OR o.until_ > m.seq) WHERE o.rest > 0),
rk AS (SELECT *, row_number() OVER (PARTITION BY day, seq, side, price ORDER BY entry) - 1 AS place, coalesce(sum(rest) OVER (PARTITION BY day, seq, side, price ORDER BY entry ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM al),
sd AS (SELECT day, seq, side, avg(place) AS place, sum(ahead) AS ahead, count(*) AS n FROM rk GROUP BY day, seq, side)
---
SELECT m.day, m.seq, coalesce(avg(sd.place), 0) AS avg_queue_position, coalesce(CAST(sum(sd.ahead) AS DOUBLE) / sum(sd.n), 0) AS queue_size_ahead FROM mbo m LEFT JOIN sd USING (day, seq) GROUP BY m.day, m.seq"""
# a count that never falls below 0 is its running sum less the least running sum so far
CLUSTERING = MBO + """, ps AS (SELECT day, price, seq, sum(CASE action WHEN 'A' THEN 1 ELSE -1 END) OVER (PARTITION BY day, price ORDER BY seq) AS s FROM mbo WHERE action IN ('A', 'C')),
pc AS (SELECT day, price, seq, s - least(0, min(s) OVER (PARTITION BY day, price ORDER BY seq)) AS c, lead(seq) OVER (PARTITION BY day, price ORDER BY seq) AS nx FROM ps)
---
SELECT m.day, m.seq, CASE WHEN coalesce(sum(c), 0) = 0 THEN 0 ELSE CAST(max(c) AS DOUBLE) / sum(c) END AS price_clustering FROM mbo m LEFT JOIN pc ON pc.day = m.day AND pc.seq <= m.seq AND (pc.nx IS NULL OR pc.nx > m.seq) GROUP BY m.day, m.seq"""

_exp = lambda f, *names: Query(lambda s, d: f(mbo(s, d)), None, KEYS, ["seq"], list(names))


def _with(q: Query, sql: str) -> Query:
    q.sql = sql
    return q


QUERIES = {
    "mbo_rates": _counted(RATES),
    "mbo_netflow": _counted(NETS),
    "mbo_regime": _counted(REGIME),
    "mbo_cancel_add": _counted(CTA),
    "mbo_size_pct": _sized({f"size_p{p}": f"size_p{p}" for p in (25, 50, 75, 90)}, []),
    "mbo_size_moments": _sized(MOMENTS, []),
    "mbo_large": _sized(LARGE, []),
    "mbo_flow_vol": Query(_at_samples(lambda m, at: ops.flow_volatility(m, MEDIUM, at)), FLOWVOL, KEYS, ["seq"], ["order_flow_volatility"]),
    "mbo_hhi": Query(lambda s, d: edge(s, d).withColumns(ops.book_features()), f"{EDGE}\n---\nSELECT day, seq, {HHI} AS level_concentration FROM edge", KEYS, ["seq"], ["level_concentration"]),
    "mbo_depth_ticks": Query(lambda s, d: edge(s, d).withColumns(ops.book_features()), f"{EDGE}\n---\nSELECT day, seq, {', '.join(f'{x} AS {n}' for n, x in TICKS.items())} FROM edge", KEYS, ["seq"], list(TICKS)),
    "mbo_lifecycle": Query(lambda s, d: ops.order_features(mbo(s, d), MEDIUM), LIFECYCLE, KEYS, ["seq"], ["modification_score", "iceberg_proxy", "median_order_lifetime", "avg_fill_ratio"]),
    "mbo_active": Query(lambda s, d: ops.order_features(mbo(s, d), MEDIUM), LIFECYCLE, KEYS, ["seq", "active_order_count"], ["avg_order_age", "avg_time_to_first_fill"]),
    "ofi_samples": Query(_emitted, INTERVAL + f"\n---\nSELECT day, seq, sample_idx, {', '.join(f'{x} AS {n}' for n, x in FLOWSIG.items())} FROM sam", KEYS, ["seq", "sample_idx"], list(FLOWSIG)),
    "signals14": Query(_signals14, SIG14, KEYS, ["seq", "sample_idx"], ["true_ofi", "depth_norm_ofi", "executed_pressure", "signed_mp_delta_bps", "trade_asymmetry", "cancel_asymmetry", "fragility_score", "depth_asymmetry", "book_valid", "time_regime", "mbo_ready", "dt_seconds", "invalidity_delta", "schema_version"]),
    "time_regime": Query(lambda s, d: mbo(s, d).withColumn("time_regime", signals.time_regime(F.col("ts_ns"))), f"{MBO}\n---\nSELECT day, seq, {regime_sql('ts_ns')} AS time_regime FROM mbo", KEYS, ["seq", "time_regime"], []),
    "time_regime_tz": Query(lambda s, d: mbo(s, d).withColumn("minute", signals.eastern_minutes(F.col("ts_ns"), "America/New_York")), f"{MBO}\n---\nSELECT day, seq, date_part('hour', l) * 60 + date_part('minute', l) AS minute FROM (SELECT day, seq, timezone('America/New_York', timezone('UTC', make_timestamp(ts_ns // 1000))) AS l FROM mbo)", KEYS, ["seq", "minute"], []),
    "exp_seasonality": Query(_seasonality, SEASONAL, [*KEYS, "label"], ["seq", "time_bucket"], ["minutes_since_open", "minutes_until_close", "session_progress"]),
    "exp_lots": _with(_exp(experimental.lots, "round_lot_ratio", "odd_lot_ratio", "size_clustering"), LOTS),
    "exp_sweep": _with(_exp(experimental.sweeps, "sweep_ratio"), SWEEP),
    "exp_mod_cancel": _with(_exp(experimental.mod_before_cancel, "mod_before_cancel"), MODCANCEL),
    "exp_fill_patience": _with(_exp(experimental.fill_patience, "fill_patience_bid", "fill_patience_ask"), PATIENCE),
    "exp_price_clustering": _with(_exp(experimental.price_clustering, "price_clustering"), CLUSTERING),
    "exp_vol": Query(lambda s, d: experimental.volatility(mids(s, d).withColumnsRenamed({"t": "sample_idx", "p": "mid"})), MIDS + VOL, KEYS, ["sample_idx"], ["realized_vol_fast", "realized_vol_slow", "vol_ratio", "vol_momentum", "return_autocorr", "vol_of_vol"]),
    "sample_event": Query(lambda s, d: sampling.every(mbo(s, d), EVERY).where("fires"), f"{MBO}\n---\nSELECT day, seq, size FROM (SELECT *, row_number() OVER {W} AS rn FROM mbo) WHERE rn % {EVERY} = 0", KEYS, ["seq", "size"], []),
    "sample_volume": Query(lambda s, d: _volume(s, d).where("fires"), VOLUME + "\n---\nSELECT n.day, n.seq, n.size FROM v JOIN n ON n.day = v.day AND n.rn = v.rn WHERE fires", KEYS, ["seq", "size"], []),
    "sample_volume_stats": Query(lambda s, d: sampling.volume_statistics(_volume(s, d)), VOLUME + "\n---\nSELECT n.day, sum(CASE WHEN fires THEN 1 ELSE 0 END) AS samples, sum(n.size) AS volume, CAST(sum(n.size) AS DOUBLE) / nullif(sum(CASE WHEN fires THEN 1 ELSE 0 END), 0) AS avg_volume FROM v JOIN n ON n.day = v.day AND n.rn = v.rn GROUP BY n.day", KEYS, ["samples", "volume"], ["avg_volume"]),
    "rolling_vol": Query(lambda s, d: sampling.rolling_volatility(mids(s, d), 50), MIDS + ROLL + "\n---\nSELECT * FROM rv", KEYS, ["t", "n_returns"], ["mean_return", "volatility"]),
    "sample_adaptive": Query(lambda s, d: sampling.adaptive_threshold(mids(s, d), 50), ADAPT, KEYS, ["t", "threshold"], []),
    "book_reconstruct": Query(_reconstruct, REBUILT + "\n---\nSELECT day, seq, best_bid, best_ask, bid_sz[1] AS bid_size, ask_sz[1] AS ask_size FROM edge", KEYS, ["seq", "best_bid", "best_ask", "bid_size", "ask_size"], []),
}
