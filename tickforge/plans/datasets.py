"""Queries of sequences, labels, alignment, normalisers, tensors, checks and calibration."""

from pyspark.sql import functions as F

from tickforge.operators import align, labels, normalize, sequences, tensors
from tickforge.plans.messages import QUEUES
from tickforge.plans.catalog import EDGE, MBO, MIDS, STRIDE, WINDOW, Query, edge, lob, mbo, mids

KEYS = ["day"]
K, H, THETA = 5, 10, 0.001
HORIZONS = [10, 5, 20, 10]


def rows(a: int, b: int) -> str:
    name = lambda x: "CURRENT ROW" if x == 0 else f"{abs(x)} {'PRECEDING' if x < 0 else 'FOLLOWING'}"
    return f"(PARTITION BY day ORDER BY t ROWS BETWEEN {name(a)} AND {name(b)})"


def _samples(spark, sf_dir):
    return mids(spark, sf_dir).select("day", F.col("t").alias("sample_idx"), (F.col("t") * 1_000_000_000).alias("ts_ns"), "p")


SAMPLES = MIDS + ", s AS (SELECT day, t AS sample_idx, t * 1000000000 AS ts_ns, p, n FROM mids)"
CLASS = lambda pct, up, down: f"CASE WHEN {pct} > {up} THEN 1 WHEN {pct} < -({down}) THEN -1 ELSE 0 END"


def tlob_sql(k: int, h: int, name: str) -> str:
    return f"{name} AS (SELECT day, t, n, (nx - ps) / ps AS pct FROM (SELECT *, avg(p) OVER {rows(-k, 0)} AS ps, avg(p) OVER {rows(h - k, h)} AS nx FROM mids) WHERE t >= {k} AND t < n - {h} - {k})"


TLOB = MIDS + ", " + tlob_sql(K, H, "c") + f", l AS (SELECT day, t, pct, {CLASS('pct', THETA, THETA)} AS label FROM c)"
MULTI = MIDS + "".join(f", {tlob_sql(K, h, f'c{h}')}" for h in (5, 10, 20)) + ", c AS (" + " UNION ALL ".join(f"SELECT {h} AS horizon, day, t, pct FROM c{h}" for h in (5, 10, 20)) + ")"


def multi_sql(threshold: str, window: int | None = None) -> str:
    tail = f"WHERE t > e - {window}" if window else ""
    return MULTI + f""", ends AS (SELECT *, max(t) OVER (PARTITION BY day, horizon) AS e FROM c), th AS (SELECT day, horizon, {threshold} AS threshold FROM ends {tail} GROUP BY day, horizon),
m AS (SELECT c.*, threshold, {CLASS('pct', 'threshold', 'threshold')} AS label FROM c JOIN th USING (day, horizon))"""


def _multi(**more):
    return lambda s, d: labels.multi_horizon(mids(s, d), K, HORIZONS, **more)


def _spreads(spark, sf_dir):
    return mids(spark, sf_dir).select("day", "t", ((F.col("t") % 7 + 1) * 0.0005).alias("spread"))


SPREAD = MULTI + f""", th AS (SELECT day, avg((t % 7 + 1) * 0.0005e0) * 1.5e0 AS threshold FROM (SELECT *, max(t) OVER (PARTITION BY day) AS e FROM mids) WHERE t > e - 50 GROUP BY day),
m AS (SELECT c.*, threshold, {CLASS('pct', 'threshold', 'threshold')} AS label FROM c JOIN th USING (day))"""
FIXED = MULTI + f", m AS (SELECT *, {THETA}e0 AS threshold, {CLASS('pct', THETA, THETA)} AS label FROM c)"
ALL = "\n---\nSELECT * FROM m"
MULTI_COLUMNS = (KEYS, ["horizon", "t", "label"], ["pct", "threshold"])

UP, DOWN = 0.01, 0.015
OPP = MIDS + f""", o AS (SELECT * FROM (SELECT day, t, n, (max(p) OVER {rows(1, H)} - p) / p AS max_return, (min(p) OVER {rows(1, H)} - p) / p AS min_return FROM mids) WHERE t < n - {H}),
l AS (SELECT *, CASE WHEN max_return > {UP} AND min_return < -{DOWN} THEN CASE WHEN max_return >= abs(min_return) THEN 1 ELSE -1 END WHEN max_return > {UP} THEN 1 WHEN min_return < -{DOWN} THEN -1 ELSE 0 END AS label, CASE WHEN max_return > {UP} AND min_return < -{DOWN} THEN 1 ELSE 0 END AS conflict FROM o)"""
PT, SL, BH, HOLD = 0.02, 0.012, 8, 1


def barrier_sql(pt: str, sl: str, join: str = "", late: str = "1") -> str:
    return f""", f AS (SELECT m.day, t, n, p, {pt} AS pt, {sl} AS sl, list(p) OVER (PARTITION BY m.day ORDER BY t ROWS BETWEEN 1 FOLLOWING AND {BH} FOLLOWING) AS f FROM mids m {join}),
g AS (SELECT *, list_filter(range({HOLD + 1}, {BH + 1}), lambda i: f[i] >= p * (1 + pt))[1] AS u, list_filter(range({HOLD + 1}, {BH + 1}), lambda i: f[i] <= p * (1 - sl))[1] AS d FROM f WHERE t < n - {BH}),
b AS (SELECT *, CASE WHEN u IS NOT NULL AND (d IS NULL OR u <= d) THEN 'profit' WHEN d IS NOT NULL THEN 'stop' ELSE 'timeout' END AS hit, coalesce(least(u, d), {BH}) AS exit_offset FROM g),
x AS (SELECT *, (f[exit_offset] - p) / p AS exit_return FROM b), l AS (SELECT *, CASE hit WHEN 'profit' THEN 2 WHEN 'stop' THEN 0 ELSE {late} END AS label FROM x)"""


BARRIER = MIDS + barrier_sql(f"{PT}e0", f"{SL}e0")
HALF = MIDS + barrier_sql(f"{PT}e0", f"{SL}e0", late="CASE WHEN exit_return >= pt / 2 THEN 2 WHEN exit_return <= -sl / 2 THEN 0 ELSE 1 END")
REF = 0.02
SCALE = f", r AS (SELECT day, t, ln(p / lag(p) OVER (PARTITION BY day ORDER BY t)) AS r FROM mids), sc AS (SELECT day, greatest(least(stddev_samp(r) / {REF}e0, 3e0), 0.3e0) AS scale FROM r GROUP BY day)"
SCALED = MIDS + SCALE + barrier_sql(f"scale * {PT}e0", f"scale * {SL}e0", "JOIN sc ON sc.day = m.day")
BARRIER_COLUMNS = ([*KEYS, "hit"], ["t", "label", "exit_offset"], ["exit_return"])
MAG = MIDS + f""", m AS (SELECT day, t, n, avg(p) OVER {rows(-2, 0)} AS entry, lead(p, {H}) OVER (PARTITION BY day ORDER BY t) AS pe, max(p) OVER {rows(1, H)} AS mx, min(p) OVER {rows(1, H)} AS mn, avg(p) OVER {rows(1, H)} AS av, stddev_pop(p) OVER {rows(1, H)} AS sd, list(p) OVER {rows(1, H)} AS f FROM mids),
g AS (SELECT day, t, entry, (pe - entry) / entry AS point_return, (mx - entry) / entry AS max_return, (mn - entry) / entry AS min_return, (av - entry) / entry AS mean_return, sd / entry AS std_return, list_position(f, mx) AS time_to_max, list_position(f, mn) AS time_to_min FROM m WHERE t >= 2 AND t < n - {H})"""
MAG_DOUBLES = ["entry", "point_return", "max_return", "min_return", "mean_return", "std_return"]
COUNT = lambda v: f"sum(CASE WHEN label = {v} THEN 1 ELSE 0 END)"
_most, _least = f"greatest({COUNT(-1)}, {COUNT(0)}, {COUNT(1)})", f"least({COUNT(-1)}, {COUNT(0)}, {COUNT(1)})"


def _magnitude(s, d):
    return labels.magnitude(mids(s, d), H, 2)


# -- sequences
COLUMNS = ["p", "q"]


def _vectors(s, d):
    return _samples(s, d).withColumn("q", F.col("sample_idx") * 0.5)


SEQ = SAMPLES + f""", z AS (SELECT day, sample_idx AS end_idx, first(ts_ns) OVER (PARTITION BY day ORDER BY sample_idx ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS start_ts, ts_ns AS end_ts FROM s),
q AS (SELECT *, (end_idx - {WINDOW - 1}) // {STRIDE} AS seq_id, end_ts - start_ts AS duration_ns, {WINDOW} AS length FROM z WHERE end_idx >= {WINDOW - 1} AND (end_idx - {WINDOW - 1}) % {STRIDE} = 0)"""
SEQ_COLUMNS = ["seq_id", "end_idx", "start_ts", "end_ts", "duration_ns", "length"]
OFFSETS = SEQ + f", o AS (SELECT q.day, seq_id, k AS \"offset\", seq_id * {STRIDE} + k AS sample_idx FROM q, range(0, {WINDOW}) AS g(k))"
SCALES = {"fast": (1, 10), "medium": (2, 15), "slow": (4, 20)}
MULTISCALE = SAMPLES + "\n---\n" + " UNION ALL ".join(
    f"SELECT day, '{n}' AS scale, i - {w - 1} AS seq_id, i AS end_idx, ts - s AS duration_ns FROM (SELECT day, sample_idx // {k} AS i, ts_ns AS ts, first(ts_ns) OVER (PARTITION BY day ORDER BY sample_idx ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS s FROM s WHERE sample_idx % {k} = 0) WHERE i >= {w - 1}"
    for n, (k, w) in SCALES.items()
)

# -- normalisers


def _z(window=None):
    return lambda s, d: normalize.z_score(mids(s, d), "p", window)


def z_sql(frame: str) -> str:
    return MIDS + f"\n---\nSELECT day, t, CASE WHEN count(p) OVER w < 2 THEN 0 ELSE (p - avg(p) OVER w) / greatest(stddev_pop(p) OVER w, 1e-8) END AS p_z FROM mids WINDOW w AS (PARTITION BY day ORDER BY t ROWS BETWEEN {frame} AND CURRENT ROW)"


ROLLING = MIDS + """, d AS (SELECT day, count(p) AS n0, sum(p) AS s0, sum(p * p) AS q0 FROM mids GROUP BY day),
w AS (SELECT day, sum(n0) OVER x AS n1, sum(s0) OVER x AS s1, sum(q0) OVER x AS q1 FROM d WINDOW x AS (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
---
SELECT day, t, CASE WHEN n1 IS NULL THEN p ELSE (p - s1 / n1) / greatest(sqrt(greatest(q1 / n1 - (s1 / n1) * (s1 / n1), 0)), 1e-8) END AS p_z FROM mids JOIN w USING (day)"""
TWO = [f"{s}_{k}_{i}" for s in ("ask", "bid") for k in ("price", "size") for i in (0, 1)]


def _book_samples(s, d):
    from tickforge.operators import lob as ops

    raw = ops.raw()
    x = lob(s, d).select("day", "seq", *(raw[c].alias(c) for c in TWO))
    from pyspark.sql import Window

    return x.withColumn("sample_idx", (F.row_number().over(Window.partitionBy("day").orderBy("seq")) - 1).cast("long")).drop("seq")


def _normal(strategy: str, ask_side: bool = False):
    def run(s, d):
        w = normalize.window_weights(_book_samples(s, d), WINDOW, STRIDE)
        return normalize.apply(w, normalize.statistics(w, TWO, strategy, ask_side=ask_side), TWO, strategy=strategy)

    return run


from tickforge.plans.catalog import LOB  # noqa: E402

BOOKS = LOB + f""", bs AS (SELECT day, row_number() OVER (PARTITION BY day ORDER BY seq) - 1 AS sample_idx, {", ".join(f"{s}_px[{i + 1}] / 1e9 AS {s}_price_{i}, CAST({s}_sz[{i + 1}] AS DOUBLE) AS {s}_size_{i}" for s in ("ask", "bid") for i in (0, 1))} FROM lob),
wt AS (SELECT *, greatest(least(sample_idx // {STRIDE}, (max(sample_idx) OVER (PARTITION BY day) - {WINDOW - 1}) // {STRIDE}) - greatest(CAST(ceil((sample_idx - {WINDOW - 1}) / {STRIDE}e0) AS BIGINT), 0) + 1, 0) AS weight FROM bs)"""


def moments_sql(table: str, pools: list[list[str]]) -> str:
    """Tables `mo` and `st`: weighted means m<k> of each pool of columns by day, and second moments q<k> about them."""
    of = lambda k, ms, x: f"({' + '.join(f'sum(weight * {x(k, m)})' for m in ms)}) / ({len(ms)} * sum(weight))"
    means = ", ".join(f"{of(k, ms, lambda _, m: m)} AS m{k}" for k, ms in enumerate(pools))
    away = ", ".join(f"{of(k, ms, lambda k, m: f'({m} - m{k}) * ({m} - m{k})')} AS q{k}, any_value(m{k}) AS m{k}" for k, ms in enumerate(pools))
    return f"mo AS (SELECT day, {means} FROM {table} GROUP BY day), st AS (SELECT day, {away} FROM {table} JOIN mo USING (day) GROUP BY day)"


def scaled_sql(column: str, k: int) -> str:
    return f"({column} - m{k}) / (CASE WHEN q{k} <= 1e-8 THEN 1 ELSE sqrt(q{k}) END + 1e-8)"


def other_sql(value: str) -> str:
    """`value`: of the column x by its day's mean m, and least and greatest value a and b in any window."""
    each = ", ".join(f"sum(weight * {c}) / sum(weight) AS m_{c}, min(CASE WHEN weight > 0 THEN {c} END) AS a_{c}, max(CASE WHEN weight > 0 THEN {c} END) AS b_{c}" for c in TWO)
    return BOOKS + f""", st AS (SELECT day, {each} FROM wt GROUP BY day)
---
SELECT day, sample_idx, weight, {", ".join(value.format(x=c, m=f"m_{c}", a=f"a_{c}", b=f"b_{c}") + f" AS {c}" for c in TWO)} FROM wt JOIN st USING (day)"""


UNIT = "CASE WHEN {b} <= {a} THEN 0 ELSE greatest(least(({x} - {a}) / ({b} - {a}), 1), 0) END"
OTHERS = {"percentage": "CASE WHEN abs({m}) > 1e-8 THEN ({x} - {m}) / {m} ELSE 0 END", "min_max": UNIT, "min_max_signed": f"{UNIT} * 2 - 1", "bilinear": "({x} - {m}) / 0.5e0"}


def normal_sql(pools: dict[str, list[str]], ask_side: bool = False) -> str:
    place = {c: k for k, ms in enumerate(pools.values()) for c in ms}
    if ask_side:
        place |= {c: place[c.replace("bid", "ask")] for c in TWO}
    return BOOKS + f""", {moments_sql("wt", list(pools.values()))}
---
SELECT day, sample_idx, weight, {", ".join(f"{scaled_sql(c, place[c])} AS {c}" for c in TWO)} FROM wt JOIN st USING (day)"""


POOLS = {
    "z": {c: [c] for c in TWO},
    "market": {f"{k}_{i}": [f"{s}_{k}_{i}" for s in ("ask", "bid")] for k in ("price", "size") for i in (0, 1)},
    "global": {k: [c for c in TWO if k in c] for k in ("price", "size")},
}


def _simple(s, d):
    x = mids(s, d)
    return x.withColumns({"pct": normalize.percentage(F.col("p"), 101.0), "bilinear": normalize.bilinear(F.col("p"), 101.0, 2.0), "unit": normalize.min_max(F.col("p"), 100.5, 103.0), "signed": normalize.min_max(F.col("p"), 100.5, 103.0, True)})


def _global_vector(s, d):
    x = s.read.parquet(f"{d}/embeddings.parquet")
    v = normalize.global_z(F.transform("embedding", lambda e: e.cast("double")))
    return x.select("vec_id", F.posexplode(v).alias("i", "z"))


# -- tensors


def _tensor(layout: str):
    def run(s, d):
        from tickforge.operators import lob as ops

        raw = ops.raw()
        x = _book_samples(s, d).select("day", "sample_idx")
        from pyspark.sql import Window

        full = lob(s, d).withColumn("sample_idx", (F.row_number().over(Window.partitionBy("day").orderBy("seq")) - 1).cast("long")).select("day", "sample_idx", *(raw[c].alias(c) for c in raw))
        seq = sequences.materialize(x.join(full, ["day", "sample_idx"]), list(raw), 4, 4)
        seq = seq.withColumn("x", tensors.reshape(F.col("features"), layout, 10, 4, 3, 4))
        out = seq.select("day", "seq_id", F.posexplode("x").alias("step", "x"))
        if layout == "image":
            out = out.select("day", "seq_id", "step", F.posexplode("x").alias("c", "x"))
        out = out.select("day", "seq_id", "step", *(["c"] if layout == "image" else []), F.posexplode("x").alias("a", "x"))
        return out.select("day", "seq_id", "step", *(["c"] if layout == "image" else []), "a", F.posexplode("x").alias("b", "value"))

    return run


FLAT = LOB + f""", bs AS (SELECT day, row_number() OVER (PARTITION BY day ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY day) AS n, list_concat(list_concat(list_transform(ask_px, lambda x: x / 1e9), list_transform(ask_sz, lambda x: CAST(x AS DOUBLE))), list_concat(list_transform(bid_px, lambda x: x / 1e9), list_transform(bid_sz, lambda x: CAST(x AS DOUBLE)))) AS v FROM lob),
ft AS (SELECT day, i // 4 AS seq_id, i % 4 AS step, unnest(range(0, 40)) AS k, unnest(v) AS value FROM bs WHERE (i // 4) * 4 + 3 < n)
---
"""
TENSORS = {
    "deeplob": FLAT + "SELECT day, seq_id, step, k // 10 AS a, k % 10 AS b, value FROM ft",
    "hlob": FLAT + "SELECT day, seq_id, step, k % 10 AS a, k // 10 AS b, value FROM ft",
    "image": FLAT + "SELECT day, seq_id, step, k // 12 AS c, (k % 12) // 4 AS a, k % 4 AS b, value FROM ft UNION ALL SELECT day, seq_id, step, (k + 40) // 12, ((k + 40) % 12) // 4, (k + 40) % 4, 0 FROM ft WHERE k < 8",
}

# -- checks
RULES = {
    "crossed": ("error", "best_bid > best_ask"), "locked": ("warning", "best_bid = best_ask"), "missing_quote": ("warning", "best_bid IS NULL OR best_ask IS NULL"),
    "bid_order": ("error", "len(list_filter(range(1, 10), lambda i: bid_px[i] <> 0 AND bid_px[i + 1] <> 0 AND bid_px[i] <= bid_px[i + 1])) > 0"),
    "ask_order": ("error", "len(list_filter(range(1, 10), lambda i: ask_px[i] <> 0 AND ask_px[i + 1] <> 0 AND ask_px[i] >= ask_px[i + 1])) > 0"),
    "price_range": ("warning", "best_bid / 1e9 NOT BETWEEN 1e-4 AND 1e6 OR best_ask / 1e9 NOT BETWEEN 1e-4 AND 1e6"), "size_limit": ("warning", "list_max(list_concat(bid_sz, ask_sz)) > 1000000000"),
    "wide_spread": ("warning", "(best_ask - best_bid) / ((best_ask + best_bid) / 2e0) * 1e4 > 1000"),
}
VALIDATE = EDGE + "\n---\n" + " UNION ALL ".join(f"SELECT '{n}' AS rule, '{lv}' AS level, coalesce(sum(CASE WHEN {t} THEN 1 ELSE 0 END), 0) AS n FROM edge" for n, (lv, t) in RULES.items())


def _nan_rows(s, d):
    x = mids(s, d)
    return x.select("day", F.when(F.col("t") % 50 == 3, float("nan")).otherwise(F.col("p")).alias("f0"), F.when(F.col("t") % 70 == 9, float("inf")).otherwise(F.col("p")).alias("f1"), F.col("p").alias("f2"))


QUANTILES = [0.05 * i for i in range(1, 20)]
MOVE = MIDS + f", r AS (SELECT abs(p2 / p - 1) AS r FROM (SELECT p, lead(p, {H}) OVER (PARTITION BY day ORDER BY t) AS p2 FROM mids) WHERE p2 IS NOT NULL)"
SPLIT = "sp AS (SELECT day, CASE WHEN i <= round(n * 0.7) THEN 'train' WHEN i <= round(n * 0.7) + round(n * 0.15) THEN 'val' ELSE 'test' END AS split FROM (SELECT day, row_number() OVER (ORDER BY day) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT day FROM e)))"


def _splits(s, d):
    return align.split_days(mids(s, d).select("day").distinct(), 0.7, 0.15)


def _aligned(s, d):
    wide = labels.shared_horizons(mids(s, d), K, HORIZONS, value=THETA)
    return align.align(sequences.ends(_samples(s, d), WINDOW, STRIDE), wide, WINDOW, STRIDE)


INTERSECT = FIXED + ", hz AS (SELECT day, t, max(CASE WHEN horizon = 5 THEN label END) AS label_5, max(CASE WHEN horizon = 10 THEN label END) AS label_10, max(CASE WHEN horizon = 20 THEN label END) AS label_20 FROM m GROUP BY day, t HAVING count(*) = 3)"
BARRIER_STATS = BARRIER + f"""\n---\nSELECT day, count(*) AS total, {COUNT(0)} AS stops, {COUNT(1)} AS timeouts, {COUNT(2)} AS profits, avg(CASE WHEN label = 2 THEN exit_offset END) AS avg_time_profit, avg(CASE WHEN label = 0 THEN exit_offset END) AS avg_time_stop, avg(exit_return) AS avg_exit, avg(CASE WHEN label = 2 THEN exit_return END) AS avg_profit, avg(CASE WHEN label = 0 THEN exit_return END) AS avg_loss,
  CAST({COUNT(2)} AS DOUBLE) / nullif({COUNT(0)} + {COUNT(2)}, 0) AS win_rate, avg(CASE WHEN label <> 1 THEN 1e0 ELSE 0e0 END) AS decisive_rate FROM l GROUP BY day"""


def _barrier(s, d, **more):
    return labels.triple_barrier(mids(s, d), BH, PT, SL, HOLD, **more)


def _queues(s, d):
    from tickforge.operators import queue

    return queue.queue_features(mbo(s, d))


QUERIES = {
    "queue_positions": Query(_queues, QUEUES, KEYS, ["seq"], ["avg_queue_position", "queue_size_ahead"]),
    "label_tlob": Query(lambda s, d: labels.tlob(mids(s, d), K, H, THETA), TLOB + "\n---\nSELECT * FROM l", KEYS, ["t", "label"], ["pct"]),
    "tlob_counts": Query(lambda s, d: labels.tlob(mids(s, d), K, H, THETA).groupBy("day", "label").agg(F.count("t").alias("n")), TLOB + "\n---\nSELECT day, label, count(*) AS n FROM l GROUP BY day, label", KEYS, ["label", "n"], []),
    "label_deeplob_cur": Query(lambda s, d: labels.deeplob(mids(s, d), H, THETA), MIDS + f", c AS (SELECT day, t, n, (avg(p) OVER {rows(1, H)} - p) / p AS pct FROM mids)\n---\nSELECT day, t, pct, {CLASS('pct', THETA, THETA)} AS label FROM c WHERE t < n - {H}", KEYS, ["t", "label"], ["pct"]),
    "label_deeplob_past": Query(lambda s, d: labels.deeplob(mids(s, d), H, THETA, True), MIDS + f", c AS (SELECT day, t, n, avg(p) OVER {rows(1, H)} / avg(p) OVER {rows(-(H - 1), 0)} - 1 AS pct FROM mids)\n---\nSELECT day, t, pct, {CLASS('pct', THETA, THETA)} AS label FROM c WHERE t >= {H - 1} AND t < n - {H}", KEYS, ["t", "label"], ["pct"]),
    "label_multi_fixed": Query(_multi(value=THETA), FIXED + ALL, *MULTI_COLUMNS),
    "label_multi_quantile": Query(_multi(strategy="quantile", value=0.3, window=100), multi_sql("quantile_cont(abs(pct), 0.7)", 100) + ALL, *MULTI_COLUMNS),
    "label_multi_dynamic": Query(_multi(strategy="dynamic", value=2.0), multi_sql("avg(abs(pct)) / 2e0") + ALL, *MULTI_COLUMNS),
    "label_multi_spread": Query(lambda s, d: labels.multi_horizon(mids(s, d), K, HORIZONS, "spread", 1.5, 50, _spreads(s, d)), SPREAD + ALL, *MULTI_COLUMNS),
    "label_opportunity": Query(lambda s, d: labels.opportunity(mids(s, d), H, UP, DOWN), OPP + "\n---\nSELECT * FROM l", KEYS, ["t", "label", "conflict"], ["max_return", "min_return"]),
    "label_barrier": Query(_barrier, BARRIER + "\n---\nSELECT * FROM l", *BARRIER_COLUMNS),
    "label_barrier_half": Query(lambda s, d: _barrier(s, d, timeout="half"), HALF + "\n---\nSELECT * FROM l", *BARRIER_COLUMNS),
    "label_barrier_volscaled": Query(lambda s, d: labels.triple_barrier_scaled(mids(s, d), BH, PT, SL, REF, min_hold=HOLD), SCALED + "\n---\nSELECT * FROM l", *BARRIER_COLUMNS),
    "label_magnitude": Query(_magnitude, MAG + "\n---\nSELECT * FROM g", KEYS, ["t", "time_to_max", "time_to_min"], MAG_DOUBLES),
    "label_primary_return": Query(lambda s, d: _magnitude(s, d).withColumns(labels.return_facts()), MAG + "\n---\nSELECT day, t, CASE WHEN abs(max_return) >= abs(min_return) THEN max_return ELSE min_return END AS dominant_return, max_return - min_return AS return_range, CASE WHEN abs(max_return) >= abs(min_return) THEN 1 ELSE 0 END AS is_bullish, CASE WHEN abs(max_return) >= abs(min_return) THEN 0 ELSE 1 END AS is_bearish FROM g", KEYS, ["t", "is_bullish", "is_bearish"], ["dominant_return", "return_range"]),
    "stats_trend": Query(lambda s, d: labels.class_statistics(_multi(value=THETA)(s, d), ["day", "horizon"]), FIXED + f"\n---\nSELECT day, horizon, count(*) AS total, {COUNT(-1)} AS down, {COUNT(0)} AS stable, {COUNT(1)} AS up, avg(pct) AS mean_change, stddev_pop(pct) AS std_change, min(pct) AS min_change, max(pct) AS max_change, CASE WHEN {_most} < 0.5 * count(*) THEN 1 ELSE 0 END AS is_balanced, CASE WHEN {_least} < 0.1 * count(*) THEN 1 ELSE 0 END AS has_minority, CAST({_most} AS DOUBLE) / nullif({_least}, 0) AS imbalance_ratio, CASE WHEN {COUNT(1)} = {_most} THEN 1 WHEN {COUNT(0)} = {_most} THEN 0 ELSE -1 END AS majority FROM m GROUP BY day, horizon", KEYS, ["horizon", "total", "down", "stable", "up", "is_balanced", "has_minority", "majority"], ["mean_change", "std_change", "min_change", "max_change", "imbalance_ratio"]),
    "stats_multi": Query(lambda s, d: labels.summary(_multi(value=THETA)(s, d)).withColumn("horizon", F.coalesce("horizon", F.lit(-1))), FIXED + f"\n---\nSELECT coalesce(horizon, -1) AS horizon, count(*) AS total, {COUNT(-1)} AS down, {COUNT(0)} AS stable, {COUNT(1)} AS up FROM m GROUP BY ROLLUP (horizon)", [], ["horizon", "total", "down", "stable", "up"], []),
    "stats_opportunity": Query(lambda s, d: labels.opportunity_statistics(labels.opportunity(mids(s, d), H, UP, DOWN), ["day"]), OPP + f"\n---\nSELECT day, count(*) AS total, {COUNT(-1)} AS big_down, {COUNT(0)} AS none, {COUNT(1)} AS big_up, sum(conflict) AS conflicts, avg(max_return) AS avg_max, avg(min_return) AS avg_min, max(max_return) AS peak_max, min(min_return) AS peak_min, avg(CASE WHEN label <> 0 THEN 1e0 ELSE 0e0 END) AS opportunity_rate, CASE WHEN {COUNT(1)} + {COUNT(-1)} < 0.01 * count(*) THEN 1 ELSE 0 END AS is_severe FROM l GROUP BY day", KEYS, ["total", "big_down", "none", "big_up", "conflicts", "is_severe"], ["avg_max", "avg_min", "peak_max", "peak_min", "opportunity_rate"]),
    "stats_barrier": Query(lambda s, d: labels.barrier_statistics(_barrier(s, d), ["day"]), BARRIER_STATS, KEYS, ["total", "stops", "timeouts", "profits"], ["avg_time_profit", "avg_time_stop", "avg_exit", "avg_profit", "avg_loss", "win_rate", "decisive_rate"]),
    "balance_warnings": Query(lambda s, d: align.balance_warnings(labels.barrier_statistics(_barrier(s, d), ["day"])), BARRIER + f"\n---\nSELECT day, CASE WHEN {COUNT(1)} > 0.8 * count(*) THEN 1 ELSE 0 END AS warn_timeouts, CASE WHEN {COUNT(2)} < 0.05 * count(*) THEN 1 ELSE 0 END AS warn_profits, CASE WHEN {COUNT(0)} < 0.05 * count(*) THEN 1 ELSE 0 END AS warn_stops, CASE WHEN {COUNT(0)} = 0 OR {COUNT(2)} / ({COUNT(0)} * 1e0) NOT BETWEEN 0.2 AND 5 THEN 1 ELSE 0 END AS warn_ratio FROM l GROUP BY day", KEYS, ["warn_timeouts", "warn_profits", "warn_stops", "warn_ratio"], []),
    "stats_magnitude": Query(lambda s, d: labels.magnitude_statistics(_magnitude(s, d), ["day"]), MAG + "\n---\nSELECT day, count(*) AS total, avg(point_return) AS mean, stddev_pop(point_return) AS std, avg(pow((point_return - mu) / sd, 3)) AS skew, avg(max_return) AS avg_max, avg(min_return) AS avg_min, avg(CASE WHEN point_return > 0 THEN 1e0 ELSE 0e0 END) AS positive_rate FROM (SELECT *, avg(point_return) OVER (PARTITION BY day) AS mu, stddev_pop(point_return) OVER (PARTITION BY day) AS sd FROM g) GROUP BY day", KEYS, ["total"], ["mean", "std", "skew", "avg_max", "avg_min", "positive_rate"]),
    "seq_index": Query(lambda s, d: sequences.ends(_samples(s, d), WINDOW, STRIDE), SEQ + "\n---\nSELECT * FROM q", KEYS, SEQ_COLUMNS, []),
    "seq_statistics": Query(lambda s, d: sequences.statistics(_samples(s, d), WINDOW, STRIDE, 100), SAMPLES + f"\n---\nSELECT day, count(*) AS pushed, CAST(greatest(floor((count(*) - {WINDOW}) / {STRIDE}) + 1, 0) AS BIGINT) AS sequences, least(count(*), 100) AS buffered, least(count(*), 100) / 100e0 AS utilisation FROM s GROUP BY day", KEYS, ["pushed", "sequences", "buffered"], ["utilisation"]),
    "seq_intervals": Query(lambda s, d: sequences.ends(_samples(s, d), WINDOW, STRIDE).select("day", "seq_id", sequences.duration_seconds().alias("duration"), sequences.average_interval().alias("interval")), SEQ + f"\n---\nSELECT day, seq_id, duration_ns / 1e9 AS duration, duration_ns / 1e9 / {WINDOW - 1} AS interval FROM q", KEYS, ["seq_id"], ["duration", "interval"]),
    "seq_offsets": Query(lambda s, d: sequences.offsets(_samples(s, d), WINDOW, STRIDE), OFFSETS + "\n---\nSELECT * FROM o", KEYS, ["seq_id", "offset", "sample_idx"], []),
    "seq_features": Query(lambda s, d: sequences.materialize(_vectors(s, d), COLUMNS, WINDOW, STRIDE).select("day", "seq_id", F.posexplode("features").alias("offset", "v")).select("day", "seq_id", "offset", F.col("v")[0].alias("p"), F.col("v")[1].alias("q")), OFFSETS + "\n---\nSELECT o.day, seq_id, \"offset\", p, o.sample_idx * 0.5e0 AS q FROM o JOIN s USING (day, sample_idx)", KEYS, ["seq_id", "offset"], ["p", "q"]),
    "multiscale": Query(lambda s, d: sequences.multiscale(_samples(s, d), SCALES), MULTISCALE, [*KEYS, "scale"], ["seq_id", "end_idx", "duration_ns"], []),
    "horizon_intersect": Query(lambda s, d: labels.shared_horizons(mids(s, d), K, HORIZONS, value=THETA), INTERSECT + "\n---\nSELECT * FROM hz", KEYS, ["t", "label_5", "label_10", "label_20"], []),
    "align_join": Query(_aligned, INTERSECT + ", " + SEQ[SEQ.index("s AS (SELECT day, t AS sample_idx") :] + f"\n---\nSELECT q.day, seq_id, t, label_5, label_10, label_20 FROM q JOIN hz ON hz.day = q.day AND hz.t = seq_id * {STRIDE} + {WINDOW - 1}", KEYS, ["seq_id", "t", "label_5", "label_10", "label_20"], []),
    "norm_zscore": Query(_z(), z_sql("UNBOUNDED PRECEDING"), KEYS, ["t"], ["p_z"], fine=False),
    "norm_zscore_window": Query(_z(30), z_sql("29 PRECEDING"), KEYS, ["t"], ["p_z"], fine=False),
    "norm_rolling_day": Query(lambda s, d: normalize.rolling_days(mids(s, d), "p", 3), ROLLING, KEYS, ["t"], ["p_z"]),
    "norm_simple": Query(_simple, MIDS + "\n---\nSELECT day, t, (p - 101) / 101 AS pct, (p - 101) / (2 * 0.01e0) AS bilinear, greatest(least((p - 100.5e0) / 2.5e0, 1e0), 0e0) AS unit, greatest(least((p - 100.5e0) / 2.5e0, 1e0), 0e0) * 2 - 1 AS signed FROM mids", KEYS, ["t"], ["pct", "bilinear", "unit", "signed"]),
    "norm_global_vector": Query(_global_vector, "v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings)\n---\nSELECT vec_id, unnest(range(0, len(x))) AS i, unnest(list_transform(x, lambda y: (y - list_avg(x)) / greatest(list_stddev_pop(x), 1e-10))) AS z FROM v", [], ["vec_id", "i"], ["z"]),
    **{f"norm_export_{n}": Query(_normal(n), normal_sql(p), KEYS, ["sample_idx", "weight"], TWO) for n, p in POOLS.items()},
    **{f"norm_export_{n}": Query(_normal(n), other_sql(x), KEYS, ["sample_idx", "weight"], TWO, fine=False) for n, x in OTHERS.items()},
    "norm_export_ask_side": Query(_normal("z", True), normal_sql(POOLS["z"], True), KEYS, ["sample_idx", "weight"], TWO),
    **{f"tensor_{n}": Query(_tensor(n), q, KEYS, ["seq_id", "step", *(["c"] if n == "image" else []), "a", "b"], ["value"]) for n, q in TENSORS.items()},
    "split_days": Query(_splits, MIDS + ", " + SPLIT + "\n---\nSELECT * FROM sp", [*KEYS, "split"], [], []),
    "label_check": Query(lambda s, d: align.label_check(labels.tlob(mids(s, d), K, H, THETA), -1, 1), TLOB + "\n---\nSELECT label, count(*) AS n, 0 AS out_of_range FROM l GROUP BY label", [], ["label", "n", "out_of_range"], []),
    "validate_lob": Query(lambda s, d: align.validate_books(edge(s, d)), VALIDATE, ["rule", "level"], ["n"], []),
    "spread_check": Query(lambda s, d: align.spread_check(edge(s, d)), EDGE + "\n---\nSELECT g / t AS positive_share, CASE WHEN g / t >= 0.99 THEN 1 ELSE 0 END AS passed FROM (SELECT CAST(sum(len(list_filter(range(1, 11), lambda i: ask_px[i] > bid_px[i]))) AS DOUBLE) AS g, count(*) * 10 AS t FROM edge)", [], ["passed"], ["positive_share"]),
    "validate_ts": Query(lambda s, d: align.validate_timestamps(mbo(s, d)), MBO + "\n---\nSELECT day, sum(CASE WHEN g < 0 THEN 1 ELSE 0 END) AS n_backward, sum(CASE WHEN g > 60 THEN 1 ELSE 0 END) AS n_gaps, max(g) AS max_gap FROM (SELECT day, (ts_ns - lag(ts_ns) OVER (PARTITION BY day ORDER BY seq)) / 1e9 AS g FROM mbo) GROUP BY day", KEYS, ["n_backward", "n_gaps"], ["max_gap"]),
    "nan_scan": Query(lambda s, d: align.non_finite(_nan_rows(s, d), ["f0", "f1", "f2"]), MIDS + "\n---\nSELECT 'f0' AS feature, sum(CASE WHEN t % 50 = 3 THEN 1 ELSE 0 END) AS n_nan, 0 AS n_inf FROM mids UNION ALL SELECT 'f1', 0, sum(CASE WHEN t % 70 = 9 THEN 1 ELSE 0 END) FROM mids UNION ALL SELECT 'f2', 0, 0", ["feature"], ["n_nan", "n_inf"], []),
    "calib_movement": Query(lambda s, d: align.movement(mids(s, d), H, QUANTILES), MOVE + "\n---\nSELECT count(*) AS n, avg(r * 1e4) AS mean_bps, stddev_pop(r * 1e4) AS std_bps, " + ", ".join(f"quantile_cont(r * 1e4, {q:.2f}) AS p{round(q * 100)}" for q in QUANTILES) + " FROM r", [], ["n"], ["mean_bps", "std_bps", *(f"p{round(q * 100)}" for q in QUANTILES)]),
    "calib_barriers": Query(lambda s, d: align.calibrate(mids(s, d), H, 0.2, 0.2, 2.0), MOVE + "\n---\nSELECT quantile_cont(r, 0.6) AS base, quantile_cont(r, 0.6) * sqrt(2) AS profit, quantile_cont(r, 0.6) / sqrt(2) AS stop FROM r", [], [], ["base", "profit", "stop"]),
    "calib_daily": Query(lambda s, d: align.daily_scales(mids(s, d), _splits(s, d)), MIDS + ", " + SPLIT + ", r AS (SELECT day, t, ln(p / lag(p) OVER (PARTITION BY day ORDER BY t)) AS r FROM mids), dv AS (SELECT day, stddev_samp(r) AS volatility FROM r GROUP BY day), rf AS (SELECT quantile_cont(volatility, 0.5) AS reference FROM dv JOIN sp USING (day) WHERE split = 'train')\n---\nSELECT day, split, volatility, reference, greatest(least(volatility / reference, 3e0), 0.3e0) AS scale FROM dv JOIN sp USING (day), rf", [*KEYS, "split"], [], ["volatility", "reference", "scale"]),
}
