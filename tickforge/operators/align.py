"""Labels and sequences put together, splits of days, checks of labels and values."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickforge.functions.frames import DAY, ordered
from tickforge.functions.tables import dealt, merged


def intersect_horizons(labels: DataFrame, horizons: list[int], keys: tuple[str, ...] = DAY) -> DataFrame:
    """(keys, t, label_h...) of the t that every horizon has a label for."""
    labels = dealt(labels, [*keys, "t"])
    return labels.groupBy(*keys, "t").agg(*(F.max(F.when(F.col("horizon") == h, F.col("label"))).alias(f"label_{h}") for h in horizons)).dropna()


def align(sequences: DataFrame, labels: DataFrame, window: int, stride: int, keys: tuple[str, ...] = DAY) -> DataFrame:
    """Sequences with the label of their last sample; those without one are dropped."""
    return merged(sequences.withColumn("t", F.col("seq_id") * stride + (window - 1)), labels, [*keys, "t"])


def split_days(days: DataFrame, train: float, val: float) -> DataFrame:
    """(day, split): chronological shares, rounded; one row a day, so the whole list is small."""
    w = Window.orderBy("day")
    x = days.select("day").distinct().withColumns({"__i": F.row_number().over(w), "__n": F.count(F.lit(1)).over(Window.partitionBy())})
    a, b = F.round(F.col("__n") * train), F.round(F.col("__n") * val)
    return x.select("day", F.when(F.col("__i") <= a, "train").when(F.col("__i") <= a + b, "val").otherwise("test").alias("split"))


def label_check(labels: DataFrame, low: int, high: int) -> DataFrame:
    """Rows and rows out of the encoding's range, by label."""
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum((~F.col("label").between(low, high)).cast("long")).alias("out_of_range"))


def non_finite(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, n_nan, n_inf) of every feature column, in one pass."""
    inf = float("inf")
    stats = rows.agg(*(F.sum(F.isnan(c).cast("long")).alias(f"nan_{c}") for c in columns), *(F.sum((F.abs(c) == inf).cast("long")).alias(f"inf_{c}") for c in columns))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.coalesce(f"nan_{c}", F.lit(0)).alias("n_nan"), F.coalesce(f"inf_{c}", F.lit(0)).alias("n_inf")) for c in columns)))
    return stats.select(pairs.alias("x")).select("x.*")


def spread_check(books: DataFrame, least: float = 0.99) -> DataFrame:
    """Share of levels with an ask above its bid, and whether it is enough."""
    ok = F.zip_with("ask_px", "bid_px", lambda a, b: (a > b).cast("int"))
    x = books.select(F.aggregate(ok, F.lit(0), lambda s, v: s + v).alias("good"), F.size("ask_px").alias("n"))
    return x.agg((F.sum("good") / F.sum("n")).alias("positive_share")).withColumn("passed", (F.col("positive_share") >= least).cast("int"))


#: rule: (level, test that a good book passes)
def book_rules() -> dict[str, tuple[str, Column]]:
    bid, ask = F.col("best_bid") / 1e9, F.col("best_ask") / 1e9
    ordered_side = lambda side, down: F.aggregate(F.zip_with(F.slice(f"{side}_px", 1, F.size(f"{side}_px") - 1), F.slice(f"{side}_px", 2, F.size(f"{side}_px") - 1), lambda a, b: ((b == 0) | (a == 0) | ((a > b) if down else (a < b))).cast("int")), F.lit(1), lambda s, v: s * v) == 1
    return {
        "crossed": ("error", ~F.coalesce(bid > ask, F.lit(False))),
        "locked": ("warning", ~F.coalesce(bid == ask, F.lit(False))),
        "missing_quote": ("warning", bid.isNotNull() & ask.isNotNull()),
        "bid_order": ("error", ordered_side("bid", True)),
        "ask_order": ("error", ordered_side("ask", False)),
        "price_range": ("warning", F.coalesce(bid, F.lit(1.0)).between(1e-4, 1e6) & F.coalesce(ask, F.lit(1.0)).between(1e-4, 1e6)),
        "size_limit": ("warning", ~F.exists(F.concat("bid_sz", "ask_sz"), lambda x: x > 1_000_000_000)),
        "wide_spread": ("warning", F.coalesce((ask - bid) / ((ask + bid) / 2) * 1e4 <= 1000, F.lit(True))),
    }


def validate_books(books: DataFrame) -> DataFrame:
    """(rule, level, n): how many books break each rule."""
    rules = book_rules()
    x = books.agg(*(F.sum((~test).cast("long")).alias(name) for name, (_, test) in rules.items()))
    return x.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(level).alias("level"), F.coalesce(n, F.lit(0)).alias("n")) for n, (level, _) in rules.items()))).alias("x")).select("x.*")


def validate_timestamps(rows: DataFrame, max_gap_s: float = 60.0, keys: tuple[str, ...] = DAY) -> DataFrame:
    """(keys, n_backward, n_gaps, max_gap) of the times of each day."""
    gap = (F.col("ts_ns") - F.lag("ts_ns").over(ordered(keys=keys))) / 1e9
    x = rows.select(*keys, gap.alias("__g"))
    return x.groupBy(*keys).agg(F.coalesce(F.sum((F.col("__g") < 0).cast("long")), F.lit(0)).alias("n_backward"), F.coalesce(F.sum((F.col("__g") > max_gap_s).cast("long")), F.lit(0)).alias("n_gaps"), F.max("__g").alias("max_gap"))


def balance_warnings(statistics: DataFrame) -> DataFrame:
    """Flags of barrier statistics: too many timeouts, rare hits, lopsided hits."""
    n = F.col("total")
    ratio = F.col("profits") / F.nullif(F.col("stops"), F.lit(0))
    return statistics.withColumns({"warn_timeouts": (F.col("timeouts") / n > 0.8).cast("int"), "warn_profits": (F.col("profits") / n < 0.05).cast("int"), "warn_stops": (F.col("stops") / n < 0.05).cast("int"), "warn_ratio": F.coalesce(~ratio.between(0.2, 5.0), F.lit(True)).cast("int")})


#: Of ranks, by which the brackets of quantiles are found.
ACCURACY = 10_000


def exact_quantiles(rows: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """One row with `q`, the exact linear quantiles of a column without nulls; null without rows.

    Approximate quantiles, whose ranks are off by less than 1 / ACCURACY of all, bracket each wanted one. Only the
    values inside the brackets are put in order, bracket by bracket, so no task holds all values."""
    n = rows.count()
    at = [min(max(s + d * (2 / ACCURACY + 2 / max(n, 1)), 0.0), 1.0) for s in shares for d in (-1, 1)]
    found = rows.agg(F.percentile_approx(column, F.array(*(F.lit(x) for x in at)), F.lit(ACCURACY)).alias("v")).first()
    if not n:
        return rows.sparkSession.createDataFrame([(None,)], "q array<double>")
    brackets = [(k, found.v[2 * k], found.v[2 * k + 1]) for k in range(len(shares))]
    x = F.col(column)
    below = rows.agg(*(F.count(F.when(x < low, 1)).alias(f"b{k}") for k, low, _ in brackets)).first()
    inside = F.explode(F.filter(F.array(*(F.when(x.between(low, high), F.lit(k)) for k, low, high in brackets)), lambda k: k.isNotNull()))
    counts = rows.select(x.alias("x"), inside.alias("k")).groupBy("k", "x").agg(F.count(F.lit(1)).alias("c"))
    counts = counts.withColumn("upto", F.sum("c").over(Window.partitionBy("k").orderBy("x")))
    ranks = [share * (n - 1) for share in shares]
    facts = F.array(*(F.struct(F.lit(int(r) - below[k]).alias("a"), F.lit(min(int(r) + 1, n - 1) - below[k]).alias("b")) for k, r in enumerate(ranks)))
    held = counts.withColumn("f", facts[F.col("k")])
    has = lambda r: F.max(F.when((F.col("upto") > F.col(f"f.{r}")) & (F.col("upto") - F.col("c") <= F.col(f"f.{r}")), F.col("x")))
    ends = held.groupBy("k").agg(has("a").alias("a"), has("b").alias("b"))
    part = F.array(*(F.lit(r - int(r)) for r in ranks))[F.col("k")]
    out = ends.withColumn("v", F.col("a") + part * (F.col("b") - F.col("a")))
    return out.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("q"))


def movement(prices: DataFrame, h: int, quantiles: list[float], keys: tuple[str, ...] = DAY) -> DataFrame:
    """Mean, deviation and linear percentiles of absolute h-step returns in basis points."""
    r = prices.select(F.abs(F.lead("p", h).over(ordered("t", keys)) / F.col("p") - 1).alias("x")).where("x IS NOT NULL").select((F.col("x") * 1e4).alias("x"))
    whole = r.agg(F.count("x").alias("n"), F.avg("x").alias("mean_bps"), F.stddev_pop("x").alias("std_bps"))
    return whole.withColumn("one", F.pmod("n", F.lit(1))).join(exact_quantiles(r, "x", quantiles).withColumn("one", F.lit(0).cast("long")), "one", "left").select("n", "mean_bps", "std_bps", *(F.col("q")[i].alias(f"p{round(x * 100)}") for i, x in enumerate(quantiles)))


def calibrate(prices: DataFrame, h: int, profit_rate: float, stop_rate: float, reward: float, keys: tuple[str, ...] = DAY) -> DataFrame:
    """Barriers that prices reach at about the wanted rates, with a wanted ratio of reward to risk."""
    r = prices.select(F.abs(F.lead("p", h).over(ordered("t", keys)) / F.col("p") - 1).alias("x")).where("x IS NOT NULL")
    base = exact_quantiles(r, "x", [1.0 - (profit_rate + stop_rate)]).select(F.col("q")[0].alias("base"))
    return base.select("base", (F.col("base") * reward**0.5).alias("profit"), (F.col("base") / reward**0.5).alias("stop"))


def daily_scales(prices: DataFrame, splits: DataFrame, floor: float = 0.3, cap: float = 3.0, keys: tuple[str, ...] = DAY) -> DataFrame:
    """(day, split, volatility, reference, scale): each day against the median volatility of the training days."""
    r = prices.withColumn("__r", F.log(F.col("p") / F.lag("p").over(ordered("t", keys))))
    days = r.groupBy(*keys).agg(F.stddev_samp("__r").alias("volatility")).join(splits, "day")
    ref = days.where("split = 'train'").agg(F.percentile("volatility", 0.5).alias("reference"))
    return days.crossJoin(F.broadcast(ref)).withColumn("scale", F.greatest(F.least(F.col("volatility") / F.col("reference"), F.lit(cap)), F.lit(floor)))
