"""Features over windows of the last messages, and the life of orders.

Windows count messages. Counts and sums come from differences of running sums; order statistics, which need
the window itself, are given for sampled rows only. All operators add columns in one partitioning by `keys`, without
joins; the windows of samples are cut out of blocks of messages. Rates divide by the time since the day's first message
(`span=False`), or by the time that the window spans.
"""

from bisect import bisect_left, insort
from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickforge.contract import DIVISION_GUARD, NANO, TICK
from tickforge.functions import books
from tickforge.functions.frames import DAY, among, carried, gathered, last_rows, moving_count, moving_sums, ordered, running


def system_filter(messages: DataFrame) -> DataFrame:
    """Only messages of an order with a size and a price."""
    return messages.where("NOT (coalesce(order_id, 0) = 0 OR coalesce(size, 0) = 0 OR coalesce(price, 0) <= 0)")


def duration(window: int, span: bool = False, keys: tuple[str, ...] = DAY) -> Column:
    w = last_rows(window, keys=keys) if span else ordered(keys=keys).rowsBetween(Window.unboundedPreceding, 0)
    return F.greatest((F.col("ts_ns") - F.first("ts_ns").over(w)) / 1e9, F.lit(0.001))


def _counts(messages: DataFrame, window: int, prefix: str, keys: tuple[str, ...]) -> DataFrame:
    is_ = lambda a, s: ((F.col("action") == a) & (F.col("side") == s)).cast("int")
    return moving_count(messages, {f"{prefix}{a}{s}": (is_(a, s), window) for a in "ACT" for s in "BA"}, keys=keys)


def flow_features(messages: DataFrame, medium: int = 1000, fast: int = 100, slow: int = 5000, span: bool = False, keys: tuple[str, ...] = DAY) -> DataFrame:
    """Adds rates, net flows, the aggressive ratio, the flow regime and the cancel to add ratio."""
    m = _counts(messages, medium, "__m", keys)
    m = moving_count(m, {f"__{k}A{s}": (((F.col("action") == "A") & (F.col("side") == s)).cast("int"), n) for k, n in (("f", fast), ("s", slow)) for s in "BA"}, keys=keys)
    m = m.withColumn("duration", duration(medium, span, keys))
    c = lambda a, s, k="m": F.col(f"__{k}{a}{s}")
    net = lambda x, y: (x - y) / (x + y + DIVISION_GUARD)
    adds, cancels, trades = (c(a, "B") + c(a, "A") for a in "ACT")
    out = {f"{n}_rate_{s}": c(a, x) / F.col("duration") for n, a in (("add", "A"), ("cancel", "C"), ("trade", "T")) for s, x in (("bid", "B"), ("ask", "A"))}
    fast_net, slow_net = (net(c("A", "B", k), c("A", "A", k)) for k in "fs")
    regime = fast_net / F.greatest(F.abs(slow_net), F.lit(0.01))
    out |= {
        "net_order_flow": net(c("A", "B"), c("A", "A")),
        "net_cancel_flow": net(c("C", "A"), c("C", "B")),
        "net_trade_flow": net(c("T", "A"), c("T", "B")),
        "aggressive_order_ratio": trades / (adds + trades + DIVISION_GUARD),
        "flow_regime_indicator": F.greatest(F.least(regime, F.lit(10.0)), F.lit(-10.0)),
        "cancel_to_add_ratio": F.when(adds == 0, F.when(cancels == 0, 1.0).otherwise(10.0)).otherwise(F.least(cancels / F.nullif(adds, F.lit(0)), F.lit(10.0))),
    }
    m = m.withColumns(out)
    return m.drop(*(x for x in m.columns if x.startswith("__")))


def windows(messages: DataFrame, window: int, at: Column, keys: tuple[str, ...] = DAY, drop: set[str] | frozenset = frozenset()) -> DataFrame:
    """The rows where `at` holds, without the columns `drop`, with `window`, the (size, side, action) of the last
    messages up to each."""
    return gathered(messages, at, F.struct("size", "side", "action"), F.row_number().over(ordered(keys=keys)), window, "window", keys, drop)


def _total(values: Column, of) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + of(x))


def size_features(messages: DataFrame, window: int, at: Column, span: bool = False, keys: tuple[str, ...] = DAY) -> DataFrame:
    """The rows where `at` holds with percentiles (sorted sizes at the floor index), moments, concentration and large
    orders of the window."""
    return size_columns(windows(messages.withColumn("duration", duration(window, span, keys)), window, at, keys)).drop("window")


def size_columns(m: DataFrame) -> DataFrame:
    """Adds the size features to rows with `window` and `duration`."""
    n, size, z = F.col("__n"), F.col("size"), F.col("window")
    m = m.withColumns({"__s": F.array_sort(F.col("window.size")), "__n": F.size("window")})
    at_ = lambda num, den: F.element_at("__s", (F.floor(n * num / den) + 1).cast("int"))
    m = m.withColumns({f"size_p{p}": at_(num, den).cast("double") for p, num, den in ((25, 1, 4), (50, 1, 2), (75, 3, 4), (90, 9, 10))})
    m = m.withColumns({"__mean": _total(F.col("__s"), lambda x: x) / n, "__large": F.filter(z, lambda x: x["size"] > F.col("size_p90"))})
    m = m.withColumn("__std", F.sqrt(_total(F.col("__s"), lambda x: (x - F.col("__mean")) * (x - F.col("__mean"))) / n))
    volume = lambda side: F.aggregate(F.filter("__large", lambda x: x["side"] == side), F.lit(0).cast("long"), lambda a, x: a + x["size"])
    cubes = _total(F.col("__s"), lambda x: F.pow((x - F.col("__mean")) / F.col("__std"), F.lit(3.0))) / n
    whole, squares = _total(F.col("__s"), lambda x: x), _total(F.col("__s"), lambda x: x.cast("double") * x)
    m = m.withColumns({
        "size_zscore": (size - F.col("__mean")) / (F.col("__std") + DIVISION_GUARD),
        "large_order_ratio": F.size("__large") / n,
        "size_skewness": F.when((n < 3) | (F.col("__std") < 1e-10), 0.0).otherwise(cubes),
        "size_concentration": squares / (whole * whole),
        "large_order_frequency": F.size("__large") / F.col("duration"),
        "large_order_imbalance": (volume("B") - volume("A")) / (volume("B") + volume("A") + DIVISION_GUARD),
    })
    return m.drop("__s", "__n", "__mean", "__std", "__large")


def flow_volatility(messages: DataFrame, window: int, at: Column, chunks: int = 10, least: int = 50, keys: tuple[str, ...] = DAY) -> DataFrame:
    """The rows where `at` holds with order_flow_volatility: deviation of the adds' imbalance over ten parts of the
    window, the last with what remains; 0 for fewer than `least` messages."""
    return flow_volatility_column(windows(messages, window, at, keys), chunks, least).drop("window")


def flow_volatility_column(m: DataFrame, chunks: int = 10, least: int = 50) -> DataFrame:
    """Adds order_flow_volatility to rows with `window`."""
    sign = lambda x: F.when(x["action"] == "A", F.when(x["side"] == "B", 1).when(x["side"] == "A", -1).otherwise(0)).otherwise(0)
    m = m.withColumn("__g", F.transform("window", sign)).withColumn("__n", F.size("__g"))
    step = F.floor(F.col("__n") / chunks).cast("int")
    parts = []
    for k in range(chunks):
        part = F.slice("__g", (step * k + 1).cast("int"), step if k < chunks - 1 else (F.col("__n") - step * k).cast("int"))
        up, any_ = F.aggregate(part, F.lit(0), lambda a, x: a + x), F.size(F.filter(part, lambda x: x != 0))
        parts.append(up / (any_ + DIVISION_GUARD))
    m = m.withColumn("__x", F.when(F.col("__n") >= least, F.array(*parts)))
    m = m.withColumn("__mean", _total(F.col("__x"), lambda v: v) / chunks)
    var = _total(F.col("__x"), lambda v: (v - F.col("__mean")) * (v - F.col("__mean"))) / chunks
    return m.withColumn("order_flow_volatility", F.when(F.col("__x").isNull(), 0.0).otherwise(F.sqrt(var))).drop("__g", "__n", "__x", "__mean")


def _whole_ticks(best: Column, tick: int):
    return lambda p: F.floor(F.abs(best - p) / tick).cast("long")


def book_features(levels: int = 10, tick: int = TICK) -> dict[str, Column]:
    """Concentration of sizes over both sides, and size-weighted whole ticks from the best price of each side."""
    sizes = F.concat("bid_sz", "ask_sz")
    whole = books.total(sizes).cast("double")
    squares = F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x * x)
    out = {"level_concentration": books.ratio(squares, whole * whole)}
    for side in ("bid", "ask"):
        best = F.col(f"best_{side}")
        there = F.zip_with(f"{side}_px", f"{side}_sz", lambda p, s: F.when(p > 0, s).otherwise(F.lit(0)).cast("long"))
        ticks = F.transform(f"{side}_px", _whole_ticks(best, tick))
        out[f"depth_ticks_{side}"] = F.when(best.isNull(), 0.0).otherwise(books.ratio(books.total(F.zip_with(ticks, there, lambda t, s: t * s)), books.total(there)))
    return out


def lifecycles(messages: DataFrame, keys: tuple[str, ...] = DAY) -> DataFrame:
    """Adds the state of each message's order to the messages of known orders, by windows over each order.

    An Add begins a life, and replaces one that is under way; a Cancel ends it, and so does an eviction, or a Trade that takes
    the rest of its size. A Modify is counted, up to 255, and leaves the size alone. Messages of orders that
    aren't alive stay without a life. Columns: life (its number, null outside), created, original, filled,
    mods, fills_before, begins, ends, replaced (the creation of a life that this Add replaces)."""
    by = [*keys, "order_id"]
    w = Window.partitionBy(*by).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    m = messages.withColumn("life", F.sum((F.col("action") == "A").cast("int")).over(w))
    one = Window.partitionBy(*by, "life").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    trade = F.when(F.col("action") == "T", F.col("size")).otherwise(0)
    m = m.withColumns({"created": F.first("ts_ns").over(one), "original": F.first("size").over(one), "__sold": F.sum(trade).over(one), "mods": F.least(F.sum((F.col("action") == "M").cast("int")).over(one), F.lit(255)), "__cancelled": F.max(F.col("action").isin("C", EVICT).cast("int")).over(one), "__trades": F.sum((F.col("action") == "T").cast("int")).over(one)})
    m = m.withColumn("__over", (F.col("life") > 0) & ((F.col("__cancelled") == 1) | (F.col("__sold") >= F.col("original"))))
    was = Window.partitionBy(*by, "life").orderBy("seq")
    m = m.withColumn("__dead", F.coalesce(F.lag("__over").over(was), F.lit(False)) | (F.col("life") == 0))
    alone = Window.partitionBy(*by).orderBy("seq")
    begins = F.col("action") == "A"
    before = lambda c: F.lag(c).over(alone)
    alive_before = F.coalesce((before("life") > 0) & ~before("__over"), F.lit(False))
    m = m.withColumns({
        "begins": begins, "ends": F.col("__over") & ~F.col("__dead"),
        "filled": F.least("__sold", "original"),
        "replaced": F.when(begins & alive_before, before("created")),
        "replaced_fill": F.when(begins & alive_before & (before("__trades") > 0), F.lit(True)),
        "fills_before": F.col("__trades") - (F.col("action") == "T").cast("int"),
        "fills": F.col("__trades"),
    })
    first_fill = F.min(F.when(F.col("action") == "T", F.col("ts_ns"))).over(one)
    m = m.withColumn("first_fill", first_fill)
    m = m.withColumn("replaced_ttf", F.when(F.col("replaced_fill"), F.lag("first_fill").over(alone) - F.lag("created").over(alone)))
    return m.withColumn("life", F.when(~F.col("__dead"), F.col("life"))).drop("__sold", "__cancelled", "__trades", "__over", "__dead", "replaced_fill")


EVICT = "E"


def evictions(limit: int = 50_000, batch: int = 5_000, age_ns: int = 3_600_000_000_000, every: int = 1_000):
    """A state for a fold: at every `every`-th message, where more than `limit` orders are active, the ids of the
    `batch` lowest-numbered ones that are older than `age_ns`."""

    class State:
        fields = [T.StructField("evicted", T.ArrayType(T.LongType()))]

        def __init__(self):
            self.seen, self.active = 0, {}  # order: [created, rest]

        def __call__(self, given: dict) -> dict:
            out, active = [], self.active
            for action, order, size, ts in zip(*(given[c].to_pylist() for c in ("action", "order_id", "size", "ts_ns")), strict=True):
                gone = None
                if action == "A":
                    active[order] = [ts, size]
                elif action == "C":
                    active.pop(order, None)
                elif action == "T" and order in active:
                    active[order][1] -= size
                    if active[order][1] <= 0:
                        del active[order]
                self.seen += 1
                if self.seen % every == 0 and len(active) > limit:
                    gone = sorted(o for o, (created, _) in active.items() if created < ts - age_ns)[:batch]
                    for o in gone:
                        del active[o]
                out.append(gone)
            return {"evicted": pa.array(out, pa.list_(pa.int64()))}

    return State


def with_evictions(messages: DataFrame) -> DataFrame:
    """Messages with a row of the action EVICT for each order in `evicted`, behind the message that evicts it. For
    that `seq` is doubled; see `without_evictions`."""
    rows = messages.withColumn("seq", F.col("seq") * 2)
    left = {"seq": F.col("seq") + 1, "action": F.lit(EVICT), "order_id": F.col("__order"), "size": F.lit(0).cast(messages.schema["size"].dataType)}
    extra = rows.where("size(evicted) > 0").withColumn("__order", F.explode("evicted")).withColumns(left)
    if "fires" in messages.columns:
        extra = extra.withColumn("fires", F.lit(False))
    return rows.unionByName(extra.drop("__order")).drop("evicted")


def without_evictions(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("action") != EVICT).withColumn("seq", (F.col("seq") / 2).cast("long"))


def order_features(messages: DataFrame, kept: int = 1000, keys: tuple[str, ...] = DAY) -> DataFrame:
    """Adds active_order_count, avg_order_age, avg_time_to_first_fill, and the means over the last `kept`
    orders that ended: modification_score, avg_fill_ratio, median_order_lifetime, iceberg_proxy."""
    m = order_columns(lifecycles(messages, keys), kept, keys)
    lives = F.sort_array(F.collect_list("lifetime").over(among("ended", kept, keys)))
    m = m.withColumn("__l", carried(F.when(F.col("ends"), middle(lives)), keys=keys))
    return m.withColumn("median_order_lifetime", F.coalesce("__l", F.lit(0.0))).drop("__l", "ended", "lifetime")


def median_lifetimes(kept: int = 1000, at: tuple[str, ...] = ("fires",)):
    """A state for a fold over the rows of `order_columns`: median_order_lifetime of the last `kept` orders that ended, where the
    first of the columns `at` is true and the others aren't null. The lives are kept in order: a message costs a place among them."""

    class State:
        fields = [T.StructField("median_order_lifetime", T.DoubleType())]

        def __init__(self):
            self.last, self.ordered = deque(), []

        def __call__(self, given: dict) -> dict:
            last, lives, out = self.last, self.ordered, []
            wanted = zip(given[at[0]].to_pylist(), *(given[c].is_valid().to_pylist() for c in at[1:]), strict=True)
            for life, want in zip(given["lifetime"].to_pylist(), wanted, strict=True):
                if life is not None:
                    last.append(life)
                    insort(lives, life)
                    if len(last) > kept:
                        del lives[bisect_left(lives, last.popleft())]
                n = len(lives)
                out.append(((lives[(n - 1) // 2] + lives[n // 2]) / 2 if n else 0.0) if all(want) else None)
            return {"median_order_lifetime": pa.array(out, pa.float64())}

    return State


def middle(values: Column) -> Column:
    """The median of a sorted array; null if it is empty."""
    n = F.size(values)
    return F.when(n > 0, (F.element_at(values, (F.floor((n - 1) / 2) + 1).cast("int")) + F.element_at(values, (F.floor(n / 2) + 1).cast("int"))) / 2)


def order_columns(m: DataFrame, kept: int = 1000, keys: tuple[str, ...] = DAY) -> DataFrame:
    """Adds the order features but the median to the rows of `lifecycles`, with `ended`, the number of orders that ended
    so far, and `lifetime`, in seconds, of those that end here."""
    m = m.withColumn("__day", F.first("ts_ns").over(ordered(keys=keys)))
    since = lambda c: F.col(c) - F.col("__day")
    lives, begins, ends = F.col("life").isNotNull(), F.col("begins"), F.col("ends")
    new = (begins & F.col("replaced").isNull()).cast("int")
    filled_now = lives & (F.col("action") == "T") & (F.col("fills_before") == 0) & ~ends
    gone = ends & (F.col("fills") > F.when(F.col("action") == "T", 1).otherwise(0))  # had a fill while it was active
    ttf = F.col("first_fill") - F.col("created")
    m = m.withColumns({
        "__n": new - ends.cast("int"),
        "__c": F.when(begins, since("ts_ns")).otherwise(0) - F.when(begins, F.coalesce(since("replaced"), F.lit(0))).otherwise(0) - F.when(ends, since("created")).otherwise(0),
        "__fn": filled_now.cast("int") - gone.cast("int") - F.col("replaced_ttf").isNotNull().cast("int"),
        "__ft": F.when(filled_now, ttf).otherwise(0) - F.when(gone, ttf).otherwise(0) - F.coalesce("replaced_ttf", F.lit(0)),
    })
    m = m.withColumns({"active_order_count": running(F.col("__n"), keys=keys), "__cs": running(F.col("__c"), keys=keys), "__fns": running(F.col("__fn"), keys=keys), "__fts": running(F.col("__ft"), keys=keys), "ended": running(ends.cast("int"), keys=keys)})
    n = F.col("active_order_count")
    m = m.withColumns({"avg_order_age": books.ratio(n * since("ts_ns") - F.col("__cs"), n) / 1e9, "avg_time_to_first_fill": books.ratio(F.col("__fts"), F.col("__fns")) / 1e9})
    m = moving_sums(m, {"__mods": F.when(ends, F.col("mods")), "__fill": F.when(ends, F.col("filled") / F.col("original"))}, "ended", kept, "seq", keys)
    done = F.least(F.col("ended"), F.lit(kept))
    m = m.withColumns({"modification_score": books.ratio(F.col("__mods"), done), "avg_fill_ratio": books.ratio(F.greatest(F.col("__fill"), F.lit(0.0)), done), "lifetime": F.when(ends, (F.col("ts_ns") - F.col("created")) / 1e9)})
    m = m.withColumn("iceberg_proxy", F.when(n > 0, F.col("avg_fill_ratio") * F.least(F.col("modification_score") / 10, F.lit(1.0))).otherwise(0.0))
    return m.drop(*(c for c in m.columns if c.startswith("__")))
