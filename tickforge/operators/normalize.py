"""Normalisers: frames over the values of a day or of days, and the per-day normaliser of exports."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickforge.functions.frames import DAY, last_rows, ordered

LEAST_STD = 1e-8


def percentage(x: Column, reference: Column | float) -> Column:
    ref = reference if isinstance(reference, Column) else F.lit(float(reference))
    ref = F.greatest(ref, F.lit(1e-6))
    return (x - ref) / ref


def bilinear(x: Column, mid: Column | float = 100.0, scale: float = 1.0, tick: float = 0.01) -> Column:
    return (x - (mid if isinstance(mid, Column) else F.lit(float(mid)))) / (scale * tick)


def min_max(x: Column, low: Column | float, high: Column | float, signed: bool = False) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))
    y = F.when(high <= low, 0.0).otherwise(F.greatest(F.least((x - low) / F.nullif(high - low, F.lit(0.0)), F.lit(1.0)), F.lit(0.0)))
    return y * 2 - 1 if signed else y


def z_score(rows: DataFrame, column: str, window: int | None = None, order: str = "t", keys: tuple[str, ...] = DAY) -> DataFrame:
    """Adds <column>_z: against the values so far, or the last `window`; 0 before the second value."""
    w = last_rows(window, order, keys) if window else ordered(order, keys).rowsBetween(Window.unboundedPreceding, 0)
    std = F.greatest(F.stddev_pop(column).over(w), F.lit(LEAST_STD))
    return rows.withColumn(f"{column}_z", F.when(F.count(column).over(w) < 2, 0.0).otherwise((F.col(column) - F.avg(column).over(w)) / std))


def rolling_days(rows: DataFrame, column: str, days: int, day: str = "day") -> DataFrame:
    """Adds <column>_z by the pooled mean and deviation of the `days` days before; unchanged on the first."""
    sums = rows.groupBy(day).agg(F.count(column).alias("__n"), F.sum(column).alias("__s"), F.sum(F.col(column) * F.col(column)).alias("__q"))
    w = Window.orderBy(day).rowsBetween(-days, -1)  # one row a day
    sums = sums.select(day, *(F.sum(c).over(w).alias(c) for c in ("__n", "__s", "__q")))
    mean = F.col("__s") / F.col("__n")
    std = F.greatest(F.sqrt(F.greatest(F.col("__q") / F.col("__n") - mean * mean, F.lit(0.0))), F.lit(LEAST_STD))
    sums = sums.select(day, mean.alias("__m"), std.alias("__d"))
    return rows.join(sums, day).withColumn(f"{column}_z", F.when(F.col("__m").isNull(), F.col(column)).otherwise((F.col(column) - F.col("__m")) / F.col("__d"))).drop("__m", "__d")


def global_z(vector: Column) -> Column:
    """An array by its own mean and deviation (1e-10 at least)."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    bound = lambda value, body: F.transform(F.array(value), body)[0]  # noqa: E731  value is worked out once
    n = F.size(vector)
    centred = bound(total(vector) / n, lambda m: F.transform(vector, lambda x: x - m))
    return bound(centred, lambda c: bound(F.greatest(F.sqrt(total(F.transform(c, lambda x: x * x)) / n), F.lit(1e-10)), lambda s: F.transform(c, lambda x: x / s)))


def window_weights(samples: DataFrame, window: int, stride: int, order: str = "sample_idx", keys: tuple[str, ...] = DAY) -> DataFrame:
    """Adds `weight`: in how many windows a sample is. Statistics over all steps of all windows are weighted sums."""
    last = samples.groupBy(*keys).agg(F.max(order).alias("__l"))
    low = F.greatest(F.ceil((F.col(order) - (window - 1)) / stride), F.lit(0))
    high = F.least(F.floor(F.col(order) / stride), F.floor((F.col("__l") - (window - 1)) / stride))
    return samples.join(F.broadcast(last), [*keys]).withColumn("weight", F.greatest(high - low + 1, F.lit(0)).cast("long")).drop("__l")


#: strategy: which columns share one mean and deviation, given (kind, level) of raw columns.
def pool_of(strategy: str, name: str, side: str, kind: str, level: str) -> str:
    if strategy == "global":
        return kind
    if strategy == "market":
        return f"{kind}_{level}"
    return name


def _pools(columns: list[str], strategy: str | dict[str, str], ask_side: bool = False) -> list[tuple[list[str], list[str]]]:
    """(columns that give a statistic, columns that it is for)."""
    out: dict[str, tuple[list[str], list[str]]] = {}
    for c in columns:
        kind_of = strategy if isinstance(strategy, str) else strategy[c]
        side, kind, level = c.split("_") if c.count("_") == 2 and c[:3] in ("ask", "bid") else ("", c, "")
        name = pool_of(kind_of, c, side, kind, level) if level else c
        if level and ask_side and kind_of not in ("market", "global"):
            name = f"{kind}_{level}"
        sources, targets = out.setdefault(name, ([], []))
        targets.append(c)
        if not (level and ask_side and kind_of not in ("market", "global") and side == "bid"):
            sources.append(c)
    return list(out.values())


def statistics(weighted: DataFrame, columns: list[str], strategy: str | dict[str, str] = "z", keys: tuple[str, ...] = DAY, ask_side: bool = False) -> DataFrame:
    """(keys, mean_<column>, std_<column>, low_<column>, high_<column>): weighted, population; a variance of 1e-8 or
    less gives a deviation of 1; extremes are those of the samples in any window.

    z and the others: each column; market: ask and bid of a level and kind pooled; global: all prices, and all sizes,
    pooled. A key without a window has none. `strategy` may be given for each column. `ask_side`: columns that aren't pooled take the ask's."""
    w = F.col("weight")
    pools = _pools(columns, strategy, ask_side)
    of = lambda x: [(sum((F.sum(w * x(k, c)) for c in ms), F.lit(0.0)) / F.nullif(F.sum(w) * len(ms), F.lit(0))).alias(f"__{k}") for k, (ms, _) in enumerate(pools)]
    edge = lambda f, g, ms: g(*xs) if len(xs := [f(F.when(w > 0, F.col(c))) for c in ms]) > 1 else xs[0]
    extremes = [x.alias(f"{n}{k}") for k, (ms, _) in enumerate(pools) for n, x in (("__l", edge(F.min, F.least, ms)), ("__h", edge(F.max, F.greatest, ms)))]
    means = weighted.groupBy(*keys).agg(*of(lambda _, c: F.col(c)), *extremes).withColumnsRenamed({f"__{k}": f"__m{k}" for k in range(len(pools))})
    # the second moments about the means: prices vary by far less than they are
    away = lambda k, c: (F.col(c) - F.col(f"__m{k}")) * (F.col(c) - F.col(f"__m{k}"))
    kept = [f"{n}{k}" for k in range(len(pools)) for n in ("__m", "__l", "__h")]
    both = weighted.join(F.broadcast(means), [*keys]).groupBy(*keys).agg(*of(away), *(F.first(n).alias(n) for n in kept))
    out = {}
    for k, (_, targets) in enumerate(pools):
        for c in targets:
            out |= {f"mean_{c}": F.col(f"__m{k}"), f"std_{c}": F.when(F.col(f"__{k}") <= 1e-8, 1.0).otherwise(F.sqrt(f"__{k}")), f"low_{c}": F.col(f"__l{k}"), f"high_{c}": F.col(f"__h{k}")}
    return both.select(*keys, *(x.alias(n) for n, x in out.items()))


def applied(c: str, strategy: str, bilinear_scale: float = 50.0) -> Column:
    """A column by the statistics beside it."""
    mean, x = F.col(f"mean_{c}"), F.col(c)
    if strategy == "percentage":
        return F.when(F.abs(mean) > 1e-8, (x - mean) / mean).otherwise(0.0)
    if strategy in ("min_max", "min_max_signed"):
        return min_max(x, F.col(f"low_{c}"), F.col(f"high_{c}"), strategy == "min_max_signed")
    if strategy == "bilinear":
        return (x - mean) / (bilinear_scale * 0.01)
    return (x - mean) / (F.col(f"std_{c}") + LEAST_STD)


def apply(samples: DataFrame, stats: DataFrame, columns: list[str], keys: tuple[str, ...] = DAY, strategy: str | dict[str, str] = "z", bilinear_scale: float = 50.0) -> DataFrame:
    """Columns by their day's statistics; all others, as signals, stay as they are."""
    kind = lambda c: strategy if isinstance(strategy, str) else strategy[c]
    joined = samples.join(F.broadcast(stats), [*keys])
    return joined.select(*(applied(c, kind(c), bilinear_scale).alias(c) if c in columns else F.col(c) for c in samples.columns))
