"""Feature layout and numeric constants of the exported dataset."""

SCHEMA_VERSION = 2.2
LEVELS = 10
STABLE_FEATURES = 98
EXPERIMENTAL_FEATURES = 18
FULL_FEATURES = STABLE_FEATURES + EXPERIMENTAL_FEATURES
COMPARE_EPS = 1e-10
DIVISION_GUARD = 1e-8
NANO = 1_000_000_000
TICK = 10_000_000
#: Positions that hold categories, never normalised.
CATEGORICAL = (92, 93, 94, 97)
CATEGORICAL_EXPERIMENTAL = (*CATEGORICAL, 115)

# Feature names in index order.
RAW = [f"{kind}_{i}" for kind in ("ask_price", "ask_size", "bid_price", "bid_size") for i in range(LEVELS)]
DERIVED = ["mid_price", "spread", "spread_bps", "total_bid_volume", "total_ask_volume", "volume_imbalance", "weighted_mid_price", "price_impact"]
MBO = """add_rate_bid add_rate_ask cancel_rate_bid cancel_rate_ask trade_rate_bid trade_rate_ask net_order_flow
net_cancel_flow net_trade_flow aggressive_order_ratio order_flow_volatility flow_regime_indicator size_p25 size_p50
size_p75 size_p90 size_zscore large_order_ratio size_skewness size_concentration avg_queue_position queue_size_ahead
orders_per_level level_concentration depth_ticks_bid depth_ticks_ask large_order_frequency large_order_imbalance
modification_score iceberg_proxy avg_order_age median_order_lifetime avg_fill_ratio avg_time_to_first_fill
cancel_to_add_ratio active_order_count""".split()
SIGNALS = """true_ofi depth_norm_ofi executed_pressure signed_mp_delta_bps trade_asymmetry cancel_asymmetry fragility_score
depth_asymmetry book_valid time_regime mbo_ready dt_seconds invalidity_delta schema_version""".split()
INSTITUTIONAL = "round_lot_ratio odd_lot_ratio size_clustering price_clustering mod_before_cancel sweep_ratio fill_patience_bid fill_patience_ask".split()
VOLATILITY = "realized_vol_fast realized_vol_slow vol_ratio vol_momentum return_autocorr vol_of_vol".split()
SEASONALITY = "minutes_since_open minutes_until_close session_progress time_bucket".split()
EXPERIMENTAL = [*INSTITUTIONAL, *VOLATILITY, *SEASONALITY]
FEATURES = [*RAW, *DERIVED, *MBO, *SIGNALS, *EXPERIMENTAL]
assert len(FEATURES) == FULL_FEATURES


def feature_count(levels: int = LEVELS, derived: bool = True, mbo: bool = True, signals: bool = True, experimental: int = 0) -> int:
    return 4 * levels + 8 * derived + 36 * mbo + 14 * signals + experimental
