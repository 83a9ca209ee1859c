"""Features of single book snapshots: raw, normalised, derived, depth and FI-2010 groups, impact and liquidity."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickforge.contract import LEVELS, NANO, TICK
from tickforge.functions import books
from tickforge.functions.frames import DAY, ordered


def raw(levels: int = LEVELS) -> dict[str, Column]:
    """Prices in dollars (0 for empty levels) and sizes, grouped ask prices, ask sizes, bid prices, bid sizes."""
    out = {}
    for side in ("ask", "bid"):
        for i in range(levels):
            px = F.col(f"{side}_px")[i]
            out[f"{side}_price_{i}"] = F.when(px > 0, px / float(NANO)).otherwise(0.0)
        for i in range(levels):
            out[f"{side}_size_{i}"] = F.coalesce(F.col(f"{side}_sz")[i], F.lit(0)).cast("double")
    return out


def normalized(levels: int = LEVELS) -> dict[str, Column]:
    """Prices as distances from the mid, sizes as shares of all sizes; all 0 without a mid."""
    m = books.mid()
    sizes = books.total(F.col("bid_sz"), levels) + books.total(F.col("ask_sz"), levels)
    sizes = F.when(sizes == 0, 1).otherwise(sizes)
    none = m.isNull() | (m == 0)
    out = {}
    for side in ("ask", "bid"):
        for i in range(levels):
            px = F.col(f"{side}_px")[i]
            out[f"{side}_price_{i}"] = F.when(none | (px <= 0), 0.0).otherwise((px / float(NANO) - m) / m)
        for i in range(levels):
            out[f"{side}_size_{i}"] = F.when(none, 0.0).otherwise(F.col(f"{side}_sz")[i] / sizes)
    return out


def derived(levels: int = LEVELS) -> dict[str, Column]:
    """The eight derived features; the row needs both quotes."""
    b, a = books.total(F.col("bid_sz"), levels), books.total(F.col("ask_sz"), levels)
    m, s = books.mid(), books.spread()
    return {
        "mid_price": m,
        "spread": s,
        "spread_bps": F.when(m <= 0, 0.0).otherwise(s / m * 1e4),
        "total_bid_volume": b.cast("double"),
        "total_ask_volume": a.cast("double"),
        "volume_imbalance": books.ratio(b - a, b + a),
        "weighted_mid_price": books.microprice(),
        "price_impact": F.abs(m - books.microprice()),
    }


def depth(tick: int = TICK) -> dict[str, Column]:
    """Active levels of each side, and their mean distance from the best price in ticks."""
    out = {f"{s}_levels": books.active_levels(s).cast("long") for s in ("bid", "ask")}
    for s in ("bid", "ask"):
        best = F.col(f"best_{s}")
        pairs = F.filter(F.zip_with(f"{s}_px", f"{s}_sz", lambda p, n: F.when(n > 0, F.abs(best - p) / float(tick))), lambda x: x.isNotNull())
        out[f"{s}_mean_ticks"] = F.when(best.isNull() | (F.size(pairs) == 0), 0.0).otherwise(F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x) / F.size(pairs))
    return out


def analytics(levels: int = 5) -> dict[str, Column]:
    """Spread, microprice, imbalance, side prices weighted by size, and state of the book."""
    return {
        "spread": books.spread(), "microprice": books.microprice(), "depth_imbalance": books.imbalance(levels),
        "vwap_bid": books.vwap("bid", levels), "vwap_ask": books.vwap("ask", levels),
        "bid_volume": books.total(F.col("bid_sz"), levels), "ask_volume": books.total(F.col("ask_sz"), levels),
        "active_bid": books.active_levels("bid").cast("long"), "active_ask": books.active_levels("ask").cast("long"),
        "is_valid": books.valid().cast("int"), "is_crossed": books.crossed().cast("int"), "is_locked": books.locked().cast("int"),
    }


def fi2010_insensitive(levels: int = LEVELS) -> dict[str, Column]:
    """Spread, mid, and the gaps between neighbouring levels of each side."""
    out = {"spread": books.spread(), "mid_price": books.mid()}
    out |= {f"ask_gap_{i}": (F.col("ask_px")[i + 1] - F.col("ask_px")[i]) / float(NANO) for i in range(levels - 1)}
    return out | {f"bid_gap_{i}": (F.col("bid_px")[i] - F.col("bid_px")[i + 1]) / float(NANO) for i in range(levels - 1)}


def fi2010_sensitive(df: DataFrame, levels: int = LEVELS, keys: tuple[str, ...] = DAY) -> tuple[DataFrame, list[str]]:
    """Adds derivatives by time against the row before: dt is 1 second for a first row or one that isn't later."""
    w = ordered(keys=keys)
    b, a = books.total(F.col("bid_sz"), levels).cast("double"), books.total(F.col("ask_sz"), levels).cast("double")
    df = df.withColumns({"__m": books.mid(), "__s": books.spread(), "__b": b, "__a": a, "__dt0": (F.col("ts_ns") - F.lag("ts_ns").over(w)) / 1e9})
    df = df.withColumns({"__rs": books.ratio(F.col("__s"), F.col("__m")), "__ba": books.ratio(F.col("__b"), F.col("__a"), 1.0), "__dt": F.when(F.col("__dt0") > 0, F.col("__dt0")).otherwise(1.0)})
    rate = lambda c: F.coalesce((F.col(c) - F.lag(c).over(w)) / F.col("__dt"), F.lit(0.0))
    out = {"d_mid": rate("__m"), "d_spread": rate("__s"), "abs_d_mid": F.abs(rate("__m")), "total_volume": F.col("__b") + F.col("__a"), "bid_volume": F.col("__b"), "ask_volume": F.col("__a"), "relative_spread": F.col("__rs"), "d_relative_spread": rate("__rs"), "bid_ask_ratio": F.col("__ba"), "d_bid_ask_ratio": rate("__ba")}
    for i in range(levels):
        px = F.col("ask_px")[i]
        out[f"d_ask_price_{i}"] = F.coalesce((px - F.lag(px).over(w)) / float(NANO) / F.col("__dt"), F.lit(0.0))
    return df.withColumns(out).drop("__m", "__s", "__b", "__a", "__dt0", "__rs", "__ba", "__dt"), list(out)


def fi2010_depth(levels: int = LEVELS) -> dict[str, Column]:
    """Cumulative volumes, and cumulative distances from the best price, by level."""
    out = {}
    for side in ("bid", "ask"):
        for i in range(levels):
            out[f"{side}_cum_volume_{i}"] = books.total(F.col(f"{side}_sz"), i + 1).cast("double")
    for side, sign in (("bid", -1), ("ask", 1)):
        best = F.col(f"{side}_px")[0]
        for i in range(levels):
            prices = books.total(F.col(f"{side}_px"), i + 1)
            out[f"{side}_cum_distance_{i}"] = sign * (prices - (i + 1) * best) / float(NANO)
    return out


def impact(side: str, quantity: Column, levels: int = LEVELS) -> dict[str, Column]:
    """What a market order of `quantity` meets: buy orders take asks, sell orders take bids."""
    book = "ask" if side == "buy" else "bid"
    px, sz = (F.col(f"{book}_{k}") for k in ("px", "sz"))
    before, cost, used = F.lit(0).cast("long"), F.lit(0.0), F.lit(0)
    for i in range(levels):
        there = F.when(px[i] > 0, sz[i]).otherwise(F.lit(0))
        here = F.greatest(F.least(there, quantity - before), F.lit(0))
        cost, used, before = cost + px[i] / float(NANO) * here, used + (here > 0).cast("int"), before + there
    taken = F.least(before, quantity)
    best = F.coalesce(F.col(f"best_{book}"), F.lit(0)) / float(NANO)
    price = books.ratio(cost, taken)
    slip = F.when(taken == 0, 0.0).otherwise(price - best if side == "buy" else best - price)
    return {
        "vwap": price, "best": best, "slippage": slip, "slippage_bps": books.ratio(slip, best) * 1e4, "levels_used": used.cast("long"),
        "filled": taken.cast("long"), "requested": quantity.cast("long"), "fill_ratio": books.ratio(taken, quantity), "cost": cost, "can_fill": (taken >= quantity).cast("int"),
    }


def liquidity(bps: float) -> dict[str, Column]:
    """Bid and ask volume within `bps` of the mid."""
    m = books.mid()
    inside = lambda side, low: F.aggregate(F.zip_with(f"{side}_px", f"{side}_sz", lambda p, s: F.when((p > 0) & ((p / float(NANO) >= m * (1 - bps / 1e4)) if low else (p / float(NANO) <= m * (1 + bps / 1e4))), s).otherwise(F.lit(0))), F.lit(0).cast("long"), lambda a, x: a + x)
    return {"bid_volume": F.when(m.isNull(), 0).otherwise(inside("bid", True)).cast("long"), "ask_volume": F.when(m.isNull(), 0).otherwise(inside("ask", False)).cast("long")}
