"""Ordered frames of a day."""

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

DAY = ("day",)


def ordered(order: str = "seq", keys: tuple[str, ...] = DAY) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def running(x: Column, order: str = "seq", keys: tuple[str, ...] = DAY) -> Column:
    """Sum from the first row of the day."""
    return F.sum(x).over(ordered(order, keys).rowsBetween(Window.unboundedPreceding, 0))


def last_rows(n: int, order: str = "seq", keys: tuple[str, ...] = DAY) -> WindowSpec:
    """The current row and the n - 1 before it."""
    return ordered(order, keys).rowsBetween(-(n - 1), 0)


def moving_count(df, columns: dict[str, tuple[Column, int]], order: str = "seq", keys: tuple[str, ...] = DAY):
    """Adds integer sums over the last n rows: {name: (values, n)}.

    As differences of running sums, so a wide frame costs as little as a narrow one."""
    w = ordered(order, keys)
    sums = {name: f"__run_{name}" for name in columns}
    df = df.withColumns({sums[n]: running(x, order, keys) for n, (x, _) in columns.items()})
    df = df.withColumns({n: F.col(sums[n]) - F.coalesce(F.lag(sums[n], k).over(w), F.lit(0)) for n, (_, k) in columns.items()})
    return df.drop(*sums.values())


def among(index: str, n: int, keys: tuple[str, ...] = DAY) -> WindowSpec:
    """The rows of the last n counts of `index`, a running count of some of the rows."""
    return ordered(index, keys).rangeBetween(-(n - 1), 0)


def moving_sums(df, columns: dict[str, Column], index: str, n: int, order: str, keys: tuple[str, ...] = DAY):
    """Adds sums of values (null counts as nothing) over the rows of the last n counts of `index`.

    As differences of running sums: the sum up to the row, less that up to the row where the index was n lower."""
    w = ordered(index, keys).rangeBetween(Window.unboundedPreceding, -n)
    df = df.withColumns({f"__run_{c}": running(F.coalesce(x, F.lit(0)), order, keys) for c, x in columns.items()})
    df = df.withColumns({c: F.col(f"__run_{c}") - F.coalesce(F.last(f"__run_{c}").over(w), F.lit(0)) for c in columns})
    return df.drop(*(f"__run_{c}" for c in columns))


def carried(x: Column, order: str = "seq", keys: tuple[str, ...] = DAY) -> Column:
    """The last value that isn't null, up to the row."""
    return F.last(x, ignorenulls=True).over(ordered(order, keys).rowsBetween(Window.unboundedPreceding, 0))


def gathered(rows, at: Column, item: Column, place: Column, n: int, name: str, keys: tuple[str, ...] = DAY, drop=frozenset()):
    """The rows where `at` holds with the array `name` of the last n items up to each.

    `place`: how many items there are up to a row, with its own; `item` is null on rows without one. Rows are put
    into blocks of n items, which hold their items once; a row that is wanted cuts its array out of its block and
    the one before, so that no item is gathered anew for each row, and nothing is joined."""
    rows = rows.withColumns({"__i": place.cast("long") - 1, "__at": at})
    left = [c for c in rows.columns if c not in drop and c != "__at"]
    wanted, own = F.when(F.col("__at"), F.struct(*left)), F.struct("__i", item.alias("m"))
    blocks = rows.withColumn("__block", F.floor(F.col("__i") / n)).groupBy(*keys, "__block")
    blocks = blocks.agg(F.sort_array(F.collect_list(F.when(item.isNotNull(), own))).alias("__m"), F.collect_list(wanted).alias("__w"))
    none = F.slice("__m", 1, 0)
    blocks = blocks.withColumn("__b", F.coalesce(F.lag("__m").over(Window.partitionBy(*keys).orderBy("__block")), none)).where(F.size("__w") > 0)
    out = blocks.select(*keys, "__m", "__b", F.explode("__w").alias("__w"))
    upto = (F.col("__w.__i") % n + 1).cast("int")
    rest = F.greatest(F.least(F.size("__b"), F.lit(n) - upto), F.lit(0))
    old = F.when(rest > 0, F.slice("__b", F.size("__b") - rest + 1, rest)).otherwise(none)
    found = F.when(F.col("__w.__i") >= 0, F.concat(old, F.slice("__m", F.lit(1), upto))).otherwise(none)
    return out.select(*(F.col(c) if c in keys else F.col(f"__w.{c}").alias(c) for c in left if c != "__i"), found["m"].alias(name))
