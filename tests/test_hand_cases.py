"""Small cases worked out by hand."""

import pytest
from pyspark.sql import functions as F
from tickforge.functions.frames import last_rows
from tickforge.operators import align, book, experimental, flow, labels, lob, mbo, normalize, queue, sampling, sequences

DAY = "2025-01-06"


def messages(spark, rows, step_ns=1_000_000_000):
    """Rows (action, side, order_id, price, size), one a second."""
    return spark.createDataFrame([(DAY, i, i * step_ns, *r) for i, r in enumerate(rows)], "day string, seq long, ts_ns long, action string, side string, order_id long, price long, size long")


def prices(spark, values):
    return spark.createDataFrame([(DAY, i, float(v)) for i, v in enumerate(values)], "day string, t long, p double")


def sizes(spark, values):
    return messages(spark, [("A", "B", i + 1, 100, v) for i, v in enumerate(values)])


def one_book(spark, bids, asks):
    pad = lambda x, k: [v[k] for v in x] + [0] * (10 - len(x))
    row = (DAY, 0, 0, pad(bids, 0), pad(bids, 1), pad(asks, 0), pad(asks, 1), bids[0][0] if bids else None, asks[0][0] if asks else None)
    return spark.createDataFrame([row], "day string, seq long, ts_ns long, bid_px array<long>, bid_sz array<long>, ask_px array<long>, ask_sz array<long>, best_bid long, best_ask long")


def test_volume_sampler_loses_the_overshoot(spark):
    got = sampling.by_volume(sizes(spark, [60, 60, 60, 30, 20]), 100, 0).where("fires").collect()
    assert sorted(r.seq for r in got) == [1, 4]


def test_volume_sampler_waits_for_the_interval(spark):
    got = sampling.by_volume(sizes(spark, [100, 100, 100]), 100, 1_500_000_000).where("fires").collect()
    assert sorted(r.seq for r in got) == [0, 2]


def test_event_sampler(spark):
    got = sampling.every(sizes(spark, range(1, 9)), 3).where("fires").collect()
    assert sorted(r.seq for r in got) == [2, 5]


def test_order_flow_imbalance(spark):
    quotes = [(100, 10, 101, 20), (100, 15, 101, 20), (100.5, 7, 101, 20 - 0), (100.5, 7, 101, 12)]
    rows = [(DAY, i, i, [int(b * 1e9)], [bs], [int(a * 1e9)], [s], int(b * 1e9), int(a * 1e9)) for i, (b, bs, a, s) in enumerate(quotes)]
    x = spark.createDataFrame(rows, "day string, seq long, ts_ns long, bid_px array<long>, bid_sz array<long>, ask_px array<long>, ask_sz array<long>, best_bid long, best_ask long")
    got = flow.contributions(x).agg(F.sum(F.col("e_bid") - F.col("e_ask")).alias("ofi"), F.avg("depth").alias("depth")).first()
    assert got.ofi == 20 and got.depth == 27.75


def test_size_percentiles_use_the_floor_index(spark):
    got = mbo.size_features(sizes(spark, range(1, 11)), 100, F.lit(True)).where("seq = 9").first()
    assert (got.size_p25, got.size_p50, got.size_p75, got.size_p90) == (3, 6, 8, 10)


@pytest.mark.parametrize("cancels, adds, want", [(0, 0, 1.0), (5, 0, 10.0), (30, 2, 10.0), (3, 4, 0.75)])
def test_cancel_to_add(spark, cancels, adds, want):
    rows = [("C", "B", 1, 100, 1)] * cancels + [("A", "B", 1, 100, 1)] * adds + [("M", "B", 1, 100, 1)]
    got = mbo.flow_features(messages(spark, rows), 100, 10, 200).orderBy(F.desc("seq")).first()
    assert got.cancel_to_add_ratio == want


def test_depth_ticks(spark):
    x = one_book(spark, [(100_000_000_000 - i * 10_000_000, 100) for i in range(4)], [(100_010_000_000, 100)])
    got = x.select(*(c.alias(n) for n, c in mbo.book_features().items())).first()
    assert got.depth_ticks_bid == 1.5 and got.depth_ticks_ask == 0


def test_tlob(spark):
    got = labels.tlob(prices(spark, range(1, 7)), 1, 2, 0.01).orderBy("t").collect()
    assert [r.t for r in got] == [1, 2] and all(r.label == 1 for r in got)
    assert got[0].pct == pytest.approx((3.5 - 1.5) / 1.5) and got[1].pct == pytest.approx((4.5 - 2.5) / 2.5)


def test_deeplob(spark):
    got = labels.deeplob(prices(spark, [100, 102, 104]), 2, 0.01).collect()
    assert [(r.t, round(r.pct, 12)) for r in got] == [(0, 0.03)]


def test_opportunity_conflict(spark):
    for rule, want in (("larger", -1), ("up", 1), ("down", -1), ("ambiguous", 0)):
        assert labels.opportunity(prices(spark, [100, 102, 97]), 2, 0.01, conflict=rule).first().label == want


def test_triple_barrier(spark):
    got = labels.triple_barrier(prices(spark, [100, 101, 99.4, 103]), 3, 0.02, 0.005).first()
    assert (got.label, got.hit, got.exit_offset, round(got.exit_return, 12)) == (0, "stop", 2, -0.006)
    both = labels.triple_barrier(prices(spark, [100, 103, 103]), 2, 0.02, 0.005).first()
    assert (both.label, both.exit_offset) == (2, 1)
    late = labels.triple_barrier(prices(spark, [100, 100.1, 100.2]), 2, 0.02, 0.005, timeout="sign").first()
    assert (late.label, late.hit) == (2, "timeout")


def test_sequence_ends(spark):
    x = spark.createDataFrame([(DAY, i, i) for i in range(8)], "day string, sample_idx long, ts_ns long")
    assert [r.end_idx for r in sequences.ends(x, 3, 2).orderBy("seq_id").collect()] == [2, 4, 6]
    with pytest.raises(ValueError):
        sequences.ends(x, 2, 3)


def test_horizon_aware_and_risk():
    assert [sequences.horizon_aware(h) for h in (10, 100, 1000)] == [(100, 1), (1000, 10), (5000, 50)]
    assert labels.risk_reward(0.02, 0.01) == (2.0, pytest.approx(1 / 3))


def test_day_split(spark):
    days = spark.createDataFrame([(f"2025-01-0{i}",) for i in range(1, 8)], "day string")
    got = [r.split for r in align.split_days(days, 0.7, 0.15).orderBy("day").collect()]
    assert got == ["train"] * 5 + ["val"] + ["test"]


def test_buy_impact(spark):
    x = one_book(spark, [(99_990_000_000, 100)], [(100_000_000_000, 100), (100_010_000_000, 100)])
    got = x.select(*(c.alias(n) for n, c in lob.impact("buy", F.lit(150)).items())).first()
    assert got.cost == pytest.approx(15_000.50) and got.vwap == pytest.approx(15_000.5 / 150) and got.levels_used == 2 and got.can_fill == 1
    far = x.select(*(c.alias(n) for n, c in lob.impact("sell", F.lit(500)).items())).first()
    assert far.filled == 100 and far.fill_ratio == 0.2 and far.can_fill == 0


def test_order_life(spark):
    x = messages(spark, [("A", "B", 7, 100, 100), ("T", "B", 7, 100, 40), ("M", "A", 99, 100, 1), ("C", "B", 7, 100, 60)])
    got = mbo.order_features(x).orderBy("seq").collect()
    assert [r.active_order_count for r in got] == [1, 1, 1, 0]
    assert got[3].median_order_lifetime == 3 and got[3].avg_fill_ratio == 0.4 and got[3].modification_score == 0
    assert got[1].avg_time_to_first_fill == 1 and got[2].avg_order_age == 2


def test_replaced_and_exhausted_orders(spark):
    rows = [("A", "B", 1, 100, 10), ("T", "B", 1, 100, 3), ("A", "B", 1, 100, 5), ("T", "B", 1, 100, 9), ("C", "B", 1, 100, 1), ("T", "B", 2, 100, 4)]
    got = mbo.order_features(messages(spark, rows)).orderBy("seq").collect()
    assert [r.active_order_count for r in got] == [1, 1, 1, 0, 0, 0]
    assert got[2].avg_time_to_first_fill == 0 and got[3].avg_fill_ratio == 1.0 and got[5].avg_fill_ratio == 1.0


def test_z_score_needs_two(spark):
    got = normalize.z_score(prices(spark, [5, 7]), "p").orderBy("t").collect()
    assert got[0].p_z == 0 and got[1].p_z == pytest.approx(1)


def test_book_rebuild(spark):
    rows = [("A", "B", 1, 100, 10), ("A", "B", 2, 99, 5), ("A", "A", 3, 101, 7), ("M", "B", 1, 98, 4), ("C", "A", 3, 101, 2), ("T", "A", 3, 101, 9), ("C", "B", 42, 99, 1), ("R", "B", 0, 0, 0)]
    got = book.reconstruct(messages(spark, rows), 3).orderBy("seq").collect()
    assert got[2].bid_px == [100, 99, 0] and got[2].bid_sz == [10, 5, 0] and (got[2].best_bid, got[2].best_ask) == (100, 101)
    assert got[3].bid_px == [99, 98, 0] and got[3].bid_sz == [5, 4, 0]
    assert got[4].ask_sz == [5, 0, 0] and got[5].best_ask is None and got[6].best_bid == 99
    assert got[7].best_bid is None and got[7].bid_px == [0, 0, 0]


def test_price_clustering_as_plain_counts(spark):
    import random

    r = random.Random(3)
    rows = [(r.choice("AAACM"), r.choice("BA"), r.randint(1, 9), r.randint(1, 4), 5) for _ in range(300)]
    counts, want = {}, []
    for a, _, _, p, _ in rows:
        counts[p] = max(0, counts.get(p, 0) + (a == "A") - (a == "C"))
        total = sum(counts.values())
        want.append(max(counts.values()) / total if total else 0.0)
    got = [x.price_clustering for x in experimental.price_clustering(messages(spark, rows)).orderBy("seq").collect()]
    assert got == want


def test_mirrored_books_flip_directional_features(spark):
    x = one_book(spark, [(99_990_000_000, 300), (99_980_000_000, 10)], [(100_010_000_000, 100)])
    y = one_book(spark, [(99_990_000_000, 100)], [(100_010_000_000, 300), (100_020_000_000, 10)])
    a, b = (z.select(lob.derived()["volume_imbalance"].alias("v"), (lob.derived()["weighted_mid_price"] - lob.derived()["mid_price"]).alias("w")).first() for z in (x, y))
    assert a.v == -b.v > 0 and a.w == pytest.approx(-b.w)


def test_a_day_alone_gives_the_same_and_order_of_rows_does_not_matter(spark):
    import random

    r = random.Random(1)
    rows = [(r.choice("AAMCT"), r.choice("BA"), r.randint(1, 20), r.randint(90, 110), r.randint(1, 50)) for _ in range(200)]
    one = messages(spark, rows)
    two = one.unionByName(one.withColumn("day", F.lit("2025-01-07"))).repartition(5, "size")
    cols = ["seq", "add_rate_bid", "net_order_flow", "flow_regime_indicator"]
    a = mbo.flow_features(one, 50, 10, 100).select(*cols).orderBy("seq").collect()
    b = mbo.flow_features(two, 50, 10, 100).where("day = '2025-01-07'").select(*cols).orderBy("seq").collect()
    assert a == b


def test_queue_positions(spark):
    rows = [("A", "B", 1, 100, 10), ("A", "B", 2, 100, 5), ("A", "B", 3, 100, 2), ("T", "B", 1, 100, 4), ("C", "B", 1, 100, 6), ("M", "B", 2, 100, 5)]
    got = queue.queue_features(messages(spark, rows)).orderBy("seq").collect()
    assert [r.avg_queue_position for r in got] == [0, 0.5, 1, 1, 0.5, 0.5]
    assert [round(r.queue_size_ahead, 6) for r in got] == [0, 5, round(25 / 3, 6), round(17 / 3, 6), 2.5, 1]


def test_windows_of_sampled_rows_as_frames(spark):
    import random

    r = random.Random(2)
    x = messages(spark, [(r.choice("AACMT"), r.choice("BA"), r.randint(1, 9), 100, r.randint(1, 300)) for _ in range(257)])
    x = x.unionByName(x.where("seq < 30").withColumn("day", F.lit("2025-01-07")))
    for window in (1, 7, 60, 400):
        at = F.col("seq") % 13 == 4
        frame = F.collect_list(F.struct("size", "side", "action")).over(last_rows(window))
        framed = x.withColumns({"duration": mbo.duration(window), "window": frame})
        for op, columns in ((mbo.size_features, mbo.size_columns), (mbo.flow_volatility, mbo.flow_volatility_column)):
            got = op(x, window, at)
            assert columns(framed).where(at).select(*got.columns).orderBy("day", "seq").collect() == got.orderBy("day", "seq").collect()


def test_shared_horizons_are_those_of_every_horizon(spark):
    from tickforge.operators import align, labels

    prices = spark.createDataFrame([(f"d{n}", t, 100.0 + (t * 7 % 5) - n) for n in (3, 9, 40) for t in range(n)], "day string, t long, p double")
    for more in ({"value": 0.001}, {"strategy": "quantile", "value": 0.3, "window": 10}, {"strategy": "quantile", "value": 0.3}, {"strategy": "dynamic", "value": 2.0}):
        long = labels.multi_horizon(prices, 2, [4, 2, 4], **more)
        assert {(r.day, r.horizon): r.n for r in long.groupBy("day", "horizon").agg(F.count("t").alias("n")).collect()} == {("d9", 2): 3, ("d9", 4): 1, ("d40", 2): 34, ("d40", 4): 32}
        wide = labels.shared_horizons(prices, 2, [4, 2, 4], **more)
        assert sorted(wide.collect()) == sorted(align.intersect_horizons(long, [2, 4]).collect()) and wide.count() == 33
