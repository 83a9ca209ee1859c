"""Labels from the prices of a day: (keys, t, p). All are frames over the prices, and drop the t that they lack prices for."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickforge.functions.frames import DAY, ordered


def _frame(a: int, b: int, keys) -> "F.WindowSpec":
    return ordered("t", keys).rowsBetween(a, b)


def _counted(prices: DataFrame, keys) -> DataFrame:
    from pyspark.sql import Window

    return prices.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))


def _class(pct: Column, up: Column | float, down: Column | float | None = None) -> Column:
    up = up if isinstance(up, Column) else F.lit(up)
    down = up if down is None else down if isinstance(down, Column) else F.lit(down)
    return F.when(pct > up, 1).when(pct < -down, -1).otherwise(0)


def tlob_change(prices: DataFrame, k: int, h: int, keys: tuple[str, ...] = DAY) -> DataFrame:
    """(keys, t, pct): mean of [t+h-k, t+h] against mean of [t-k, t], for t in [k, n-h-k)."""
    x = _counted(prices, keys).withColumns({"__past": F.avg("p").over(_frame(-k, 0, keys)), "__next": F.avg("p").over(_frame(h - k, h, keys))})
    x = x.where((F.col("t") >= k) & (F.col("t") < F.col("__n") - h - k))
    return x.select(*keys, "t", ((F.col("__next") - F.col("__past")) / F.col("__past")).alias("pct"))


def tlob(prices: DataFrame, k: int, h: int, threshold: float, keys: tuple[str, ...] = DAY) -> DataFrame:
    return tlob_change(prices, k, h, keys).withColumn("label", _class(F.col("pct"), threshold))


def deeplob(prices: DataFrame, k: int, threshold: float, past: bool = False, keys: tuple[str, ...] = DAY) -> DataFrame:
    """Mean of the next k prices against the current price, or against the mean of the last k."""
    base = F.avg("p").over(_frame(-(k - 1), 0, keys)) if past else F.col("p")
    x = _counted(prices, keys).withColumns({"__base": base, "__next": F.avg("p").over(_frame(1, k, keys))})
    x = x.where((F.col("t") >= (k - 1 if past else 0)) & (F.col("t") < F.col("__n") - k))
    x = x.select(*keys, "t", ((F.col("__next") - F.col("__base")) / F.col("__base")).alias("pct"))
    return x.withColumn("label", _class(F.col("pct"), threshold))


def horizons_of(horizons: list[int]) -> list[int]:
    return sorted({h for h in horizons if h > 0})


def _horizons(prices: DataFrame, k: int, horizons: list[int], strategy: str, value: float, window: int | None, spreads: DataFrame | None, fallback: float, keys: tuple[str, ...]) -> tuple[DataFrame, list[int]]:
    """A row a price with the structs h<h> (horizon, pct, threshold, label), null where a horizon lacks prices. All are frames over
    one partitioning by `keys`; only the spreads of a day are joined, a row a key."""
    from pyspark.sql import Window

    at, day, t = horizons_of(horizons), Window.partitionBy(*keys), F.col("t")
    x = prices.select(*keys, "t", "p").withColumns({"__past": F.avg("p").over(_frame(-k, 0, keys)), **{f"__next{h}": F.avg("p").over(_frame(h - k, h, keys)) for h in at}})
    x = _counted(x, keys)
    there = {h: (t >= k) & (t < F.col("__n") - h - k) for h in at}
    x = x.withColumns({f"__pct{h}": F.when(there[h], (F.col(f"__next{h}") - F.col("__past")) / F.col("__past")) for h in at})
    if strategy == "fixed" or strategy == "spread" and spreads is None:
        limit = {h: F.lit(float(value if strategy == "fixed" else fallback)) for h in at}
    elif strategy == "spread":
        last = spreads.groupBy(*keys).agg(F.max("t").alias("__end"))
        tail = spreads.join(last, [*keys]).where(t > F.col("__end") - window) if window else spreads
        x = x.join(tail.groupBy(*keys).agg((F.avg("spread") * value).alias("__spread")), [*keys], "left")
        limit = {h: F.coalesce("__spread", F.lit(float(fallback))) for h in at}
    else:
        tail = there
        if window:
            x = x.withColumns({f"__end{h}": F.max(F.when(there[h], t)).over(day) for h in at})
            tail = {h: there[h] & (t > F.col(f"__end{h}") - window) for h in at}
        changes = {h: F.when(tail[h], F.abs(f"__pct{h}")) for h in at}
        x = x.withColumns({f"__limit{h}": (F.percentile(changes[h], 1.0 - value).over(day) if strategy == "quantile" else F.avg(changes[h]).over(day) / value) for h in at})
        limit = {h: F.col(f"__limit{h}") for h in at}
    one = lambda h: F.struct(F.lit(h).alias("horizon"), F.col(f"__pct{h}").alias("pct"), limit[h].alias("threshold"), _class(F.col(f"__pct{h}"), limit[h]).alias("label"))
    return x.select(*keys, "t", *(F.when(there[h], one(h)).alias(f"h{h}") for h in at)), at


def multi_horizon(prices: DataFrame, k: int, horizons: list[int], strategy: str = "fixed", value: float = 0.002, window: int | None = None, spreads: DataFrame | None = None, fallback: float = 0.002, keys: tuple[str, ...] = DAY) -> DataFrame:
    """(keys, horizon, t, pct, threshold, label) of each horizon. Thresholds of a day and horizon:

    fixed: `value`; quantile: the 1 - `value` quantile of the last `window` absolute changes; dynamic: mean
    absolute change by `value`; spread: mean of the day's last `window` relative spreads (keys, t, spread) times
    `value`, or `fallback` without any."""
    x, at = _horizons(prices, k, horizons, strategy, value, window, spreads, fallback, keys)
    x = x.select(*keys, "t", F.explode(F.array(*(f"h{h}" for h in at))).alias("x")).where("x IS NOT NULL")
    return x.select(*keys, "x.horizon", "t", "x.pct", "x.threshold", "x.label")


def shared_horizons(prices: DataFrame, k: int, horizons: list[int], strategy: str = "fixed", value: float = 0.002, window: int | None = None, spreads: DataFrame | None = None, fallback: float = 0.002, keys: tuple[str, ...] = DAY) -> DataFrame:
    """(keys, t, label_<h>...) of the t that every horizon labels: `multi_horizon` and `align.intersect_horizons` in one,
    which turns no rows into columns."""
    x, at = _horizons(prices, k, horizons, strategy, value, window, spreads, fallback, keys)
    return x.select(*keys, "t", *(F.col(f"h{h}.label").alias(f"label_{h}") for h in at)).dropna()


def opportunity(prices: DataFrame, h: int, up: float, down: float | None = None, conflict: str = "larger", keys: tuple[str, ...] = DAY) -> DataFrame:
    """(keys, t, label, max_return, min_return, conflict): the extremes of the next h prices against thresholds."""
    down = up if down is None else down
    x = _counted(prices, keys).withColumns({"max_return": (F.max("p").over(_frame(1, h, keys)) - F.col("p")) / F.col("p"), "min_return": (F.min("p").over(_frame(1, h, keys)) - F.col("p")) / F.col("p")})
    x = x.where(F.col("t") < F.col("__n") - h)
    high, low = F.col("max_return") > up, F.col("min_return") < -down
    both = {"larger": F.when(F.col("max_return") >= F.abs("min_return"), 1).otherwise(-1), "up": F.lit(1), "down": F.lit(-1), "ambiguous": F.lit(0)}[conflict]
    return x.select(*keys, "t", F.when(high & low, both).when(high, 1).when(low, -1).otherwise(0).alias("label"), "max_return", "min_return", (high & low).cast("int").alias("conflict"))


def triple_barrier(prices: DataFrame, h: int, profit: float | Column, stop: float | Column, min_hold: int = 0, timeout: str = "timeout", keys: tuple[str, ...] = DAY) -> DataFrame:
    """(keys, t, label, hit, exit_offset, exit_return): the first offset in (min_hold, h] at a barrier.

    label 0 stop, 1 timeout, 2 profit; timeouts may be labelled by the `sign` of the last return or by `half`
    barriers. `profit` and `stop` may be columns of `prices`."""
    pt, sl = (x if isinstance(x, Column) else F.lit(float(x)) for x in (profit, stop))
    x = _counted(prices, keys).withColumns({"__f": F.collect_list("p").over(_frame(1, h, keys)), "__pt": pt, "__sl": sl}).where(F.col("t") < F.col("__n") - h)
    ahead = F.slice("__f", min_hold + 1, h)
    where = lambda test: F.array_position(F.transform(ahead, lambda v: test(v).cast("int")), 1)
    x = x.withColumns({"__u": where(lambda v: v >= F.col("p") * (1 + F.col("__pt"))), "__d": where(lambda v: v <= F.col("p") * (1 - F.col("__sl")))})
    up = (F.col("__u") > 0) & ((F.col("__d") == 0) | (F.col("__u") <= F.col("__d")))
    x = x.withColumn("hit", F.when(up, "profit").when(F.col("__d") > 0, "stop").otherwise("timeout"))
    x = x.withColumn("exit_offset", F.when(up, F.col("__u") + min_hold).when(F.col("__d") > 0, F.col("__d") + min_hold).otherwise(h).cast("long"))
    x = x.withColumn("exit_return", (F.element_at("__f", F.col("exit_offset").cast("int")) - F.col("p")) / F.col("p"))
    r = F.col("exit_return")
    late = {"timeout": F.lit(1), "sign": F.when(r > 0, 2).when(r < 0, 0).otherwise(1), "half": F.when(r >= F.col("__pt") / 2, 2).when(r <= -F.col("__sl") / 2, 0).otherwise(1)}[timeout]
    label = F.when(F.col("hit") == "profit", 2).when(F.col("hit") == "stop", 0).otherwise(late)
    return x.select(*keys, "t", label.alias("label"), "hit", "exit_offset", "exit_return")


def volatility_scale(prices: DataFrame, reference: float, floor: float = 0.3, cap: float = 3.0, keys: tuple[str, ...] = DAY) -> DataFrame:
    """(keys, scale): the day's deviation of log returns against a reference, within bounds."""
    r = prices.withColumn("__r", F.log(F.col("p") / F.lag("p").over(ordered("t", keys))))
    return r.groupBy(*keys).agg(F.greatest(F.least(F.stddev_samp("__r") / reference, F.lit(cap)), F.lit(floor)).alias("scale"))


def triple_barrier_scaled(prices: DataFrame, h: int, profit: float, stop: float, reference: float, keys: tuple[str, ...] = DAY, **more) -> DataFrame:
    """Barriers scaled by the day's volatility; days without one keep theirs."""
    scale = F.coalesce(F.col("scale"), F.lit(1.0))
    return triple_barrier(prices.join(volatility_scale(prices, reference, keys=keys), [*keys], "left"), h, scale * profit, scale * stop, keys=keys, **more)


def risk_reward(profit: float, stop: float) -> tuple[float, float]:
    """(reward by risk, break-even win rate)."""
    r = profit / stop
    return r, 1 / (1 + r)


def magnitude(prices: DataFrame, h: int, smooth: int = 0, max_h: int | None = None, keys: tuple[str, ...] = DAY) -> DataFrame:
    """Returns over the next h prices against the price, or the mean of the last smooth + 1, for t in [smooth, n - max_h)."""
    ahead = _frame(1, h, keys)
    x = _counted(prices, keys).withColumns({"entry": F.avg("p").over(_frame(-smooth, 0, keys)) if smooth else F.col("p"), "__f": F.collect_list("p").over(ahead), "__max": F.max("p").over(ahead), "__min": F.min("p").over(ahead), "__avg": F.avg("p").over(ahead), "__std": F.stddev_pop("p").over(ahead), "__end": F.lead("p", h).over(ordered("t", keys))})
    x = x.where((F.col("t") >= smooth) & (F.col("t") < F.col("__n") - (max_h or h)))
    ret = lambda c: (F.col(c) - F.col("entry")) / F.col("entry")
    return x.select(*keys, "t", "entry", ret("__end").alias("point_return"), ret("__max").alias("max_return"), ret("__min").alias("min_return"), ret("__avg").alias("mean_return"), (F.col("__std") / F.col("entry")).alias("std_return"), F.array_position("__f", F.col("__max")).alias("time_to_max"), F.array_position("__f", F.col("__min")).alias("time_to_min"))


def primary_return(kind: str) -> Column:
    """One return of a magnitude row: point, max, min, mean, or dominant (the larger extreme)."""
    if kind == "dominant":
        return F.when(F.abs("max_return") >= F.abs("min_return"), F.col("max_return")).otherwise(F.col("min_return"))
    return F.col(f"{kind}_return")


def return_facts() -> dict[str, Column]:
    up = F.abs("max_return") >= F.abs("min_return")
    return {"dominant_return": primary_return("dominant"), "return_range": F.col("max_return") - F.col("min_return"), "is_bullish": up.cast("int"), "is_bearish": (~up).cast("int")}


# -- statistics


def _share(test: Column) -> Column:
    return F.avg(test.cast("double"))


def class_statistics(labels: DataFrame, by: list[str]) -> DataFrame:
    """Counts, moments of pct, and balance of the trend classes; a class over half makes them unbalanced, one
    under a tenth is a minority."""
    n = F.count(F.lit(1))
    c = {name: F.sum((F.col("label") == v).cast("long")) for name, v in (("down", -1), ("stable", 0), ("up", 1))}
    most, least = F.greatest(*c.values()), F.least(*c.values())
    return labels.groupBy(*by).agg(
        n.alias("total"), *(x.alias(k) for k, x in c.items()), F.avg("pct").alias("mean_change"), F.stddev_pop("pct").alias("std_change"), F.min("pct").alias("min_change"), F.max("pct").alias("max_change"),
        (most / n < 0.5).cast("int").alias("is_balanced"), (least / n < 0.1).cast("int").alias("has_minority"), (most / F.nullif(least, F.lit(0))).alias("imbalance_ratio"),
        F.when(c["up"] == most, 1).when(c["stable"] == most, 0).otherwise(-1).alias("majority"),
    )


def summary(labels: DataFrame, keys: tuple[str, ...] = DAY) -> DataFrame:
    """Class counts of every horizon and, with a null horizon, of all."""
    counts = [F.sum((F.col("label") == v).cast("long")).alias(k) for k, v in (("down", -1), ("stable", 0), ("up", 1))]
    return labels.rollup("horizon").agg(F.count(F.lit(1)).alias("total"), *counts)


def opportunity_statistics(labels: DataFrame, by: list[str]) -> DataFrame:
    c = {k: F.sum((F.col("label") == v).cast("long")) for k, v in (("big_down", -1), ("none", 0), ("big_up", 1))}
    n = F.count(F.lit(1))
    return labels.groupBy(*by).agg(n.alias("total"), *(x.alias(k) for k, x in c.items()), F.sum("conflict").cast("long").alias("conflicts"), F.avg("max_return").alias("avg_max"), F.avg("min_return").alias("avg_min"), F.max("max_return").alias("peak_max"), F.min("min_return").alias("peak_min"), _share(F.col("label") != 0).alias("opportunity_rate"), ((c["big_up"] + c["big_down"]) / n < 0.01).cast("int").alias("is_severe"))


def barrier_statistics(labels: DataFrame, by: list[str]) -> DataFrame:
    c = {k: F.sum((F.col("label") == v).cast("long")) for k, v in (("stops", 0), ("timeouts", 1), ("profits", 2))}
    decided = F.nullif(c["stops"] + c["profits"], F.lit(0))
    of = lambda v, x: F.avg(F.when(F.col("label") == v, F.col(x)))
    return labels.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *(x.alias(k) for k, x in c.items()), of(2, "exit_offset").alias("avg_time_profit"), of(0, "exit_offset").alias("avg_time_stop"), F.avg("exit_return").alias("avg_exit"), of(2, "exit_return").alias("avg_profit"), of(0, "exit_return").alias("avg_loss"), (c["profits"] / decided).alias("win_rate"), _share(F.col("label") != 1).alias("decisive_rate"))


def magnitude_statistics(returns: DataFrame, by: list[str]) -> DataFrame:
    return returns.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.avg("point_return").alias("mean"), F.stddev_pop("point_return").alias("std"), F.skewness("point_return").alias("skew"), F.avg("max_return").alias("avg_max"), F.avg("min_return").alias("avg_min"), _share(F.col("point_return") > 0).alias("positive_rate"))
