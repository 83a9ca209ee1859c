import json
import random
import struct

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from tickforge import batch, config, contract, registry
from tickforge.__main__ import main
from tickforge.functions.tables import materialized
from tickforge.operators import export, tensors
from tickforge.plans import dataset
from tickforge.sources import messages as sources


def rows(days=2, n=700):
    r = random.Random(5)
    out = []
    for d in range(days):
        t, mid = (20_000 + d) * 86_400_000_000_000 + 52_300_000_000_000, 100.0
        for i in range(n):
            t += r.randint(1, 2_000_000_000)
            mid += r.choice((-0.01, 0, 0.01))
            side = r.choice("BA")
            price = round((mid + (r.randint(1, 12) * 0.01) * (1 if side == "A" else -1)) * 100) * 10_000_000
            out.append((f"2024-10-0{4 + d}", d * n + i, t, r.choice("AAAAACMT"), side, r.randint(1, 300), price, r.randint(1, 30) * 10))
    return out


@pytest.fixture(scope="module")
def stream(spark):
    return spark.createDataFrame(rows(), "day string, seq long, ts_ns long, action string, side string, order_id long, price long, size long")


def made(**more):
    c = config.Builder().with_trading_signals().mbo_window(50).event_sampling(7).window(10, 5).experiment("t").build()
    c.features.fast_window, c.features.slow_window = 10, 200
    c.labels = config.Labels(horizons=[3, 5], smoothing=2, threshold=0.0001)
    for k, v in more.items():
        setattr(c, k, v)
    return c


def test_stable_and_full_layouts(spark, stream):
    c = made()
    s = dataset.samples(stream, c)
    assert s.columns[5:] == contract.FEATURES[:98] and c.features.count() == 98
    bad = s.select(*(F.sum((F.isnan(x) | F.col(x).isNull() | (F.abs(x) == float("inf"))).cast("int")).alias(x) for x in s.columns[5:])).first()
    assert not any(bad)
    one = s.where("day = '2024-10-05'").orderBy("sample_idx").collect()
    alone = dataset.samples(stream.where("day = '2024-10-05'").repartition(3), c).orderBy("sample_idx").collect()
    assert [r.sample_idx for r in one] == list(range(len(one))) and one == alone
    assert {r.book_valid for r in one} <= {0.0, 1.0} and {r.schema_version for r in one} == {2.2}
    c.features.experimental = True
    assert dataset.feature_names(c) == contract.FEATURES and c.features.count() == 116
    assert dataset.samples(stream, c).columns[5:] == contract.FEATURES


def test_samplers_and_aligned_sequences(spark, stream, tmp_path):
    for s in (config.Sampling("volume", volume_threshold=400), config.Sampling("volume", volume_threshold=400, adaptive=True, volatility_window=10, calibration=20)):
        assert dataset.samples(stream, made(sampling=s)).count() > 20
    c = made()
    s = materialized(dataset.samples(stream, c), "samples")
    x = dataset.aligned(s, c)
    got = export.numpy_days(x, str(tmp_path / "out"), ["label_3", "label_5"], c).collect()
    assert {r.day for r in got} == {"2024-10-04", "2024-10-05"} and all(r.n_features == 98 for r in got)
    for r in got:
        seq, lab = (np.load(tmp_path / "out" / f"{r.day}_{k}.npy") for k in ("sequences", "labels"))
        assert seq.dtype == np.float32 and lab.dtype == np.int8 and seq.shape == (r.n_sequences, 10, 98) and lab.shape == (len(seq), 2)
        assert np.isfinite(seq).all() and set(np.unique(lab)) <= {-1, 0, 1}
        about = json.loads((tmp_path / "out" / f"{r.day}_metadata.json").read_text())
        assert about["label_encoding"]["1"] == "up" and sum(about["labeling"]["label_distribution"].values()) == lab.size
    assert abs(np.load(tmp_path / "out" / "2024-10-04_sequences.npy")[:, :, 0].mean()) < 1
    for strategy in ("deeplob", "opportunity", "triple_barrier"):
        c.labels = config.Labels(strategy=strategy, horizons=[3], threshold=0.0002, profit=0.0004, stop=0.0004)
        assert dataset.label_rows(s, c).count() > 50
    c.labels = config.Labels(strategy="triple_barrier", horizons=[3], volatility_reference=0.0002)
    assert dataset.label_rows(s, c).count() > 50


def test_config_round_trip_and_validation(tmp_path):
    c = made(sequences=config.Sequences(20, 5, {"fast": [1, 10]}))
    for name in ("c.toml", "c.json"):
        c.save(str(tmp_path / name))
        assert config.Dataset.load(str(tmp_path / name)) == c
    for bad in ({"features": {"levels": 0}}, {"features": {"signals": True, "mbo": False}}, {"sampling": {"strategy": "time"}}, {"sequences": {"window": 5, "stride": 6}}, {"labels": {"horizon": 0}}, {"split": {"train": 0.9, "val": 0.2}}, {"nothing": {}}, {"labels": {"nothing": 1}}, {"normalization": "x"}, {"data": {"dates": ["x"]}}):
        with pytest.raises(config.ConfigError):
            config.Dataset.from_dict(bad)
    days = config.Data(symbol="ABC", path="/d", start="2025-01-03", end="2025-01-08", exclude=["2025-01-07"])
    assert [d.isoformat() for d in days.days()] == ["2025-01-03", "2025-01-06", "2025-01-08"]
    assert days.file(days.days()[0]) == "/d/ABC/20250103.parquet"
    assert config.Dataset.for_horizon(100).sequences == config.Sequences(1000, 10)
    for name, make in config.PRESETS.items():
        assert make().validate().features.count() == {"fi2010": 48, "lit": 80, "minimal": 20, "full": 84}.get(name, 40)
    for make in config.LABEL_PRESETS.values():
        make().validate()
    assert "98 features" in config.Builder().with_trading_signals().summary()


def test_registry():
    full = registry.full()
    assert full.names == contract.FEATURES and len(registry.fi2010()) == 120 and len(registry.complete_book()) == 136
    assert full.by_name("true_ofi").index == 84 and full.indices("derived") == list(range(40, 48)) and "mid_price" in full
    assert [f.name for f in full.by_category("seasonality")][-1] == "time_bucket" and full.by_name("ask_price_3").level == 3


def test_sources(spark, tmp_path):
    head = b"DBN\x02" + struct.pack("<I", 12) + b"x" * 12
    record = lambda i, rtype=0xA0: struct.pack("<BBHIQQqIBBccQiI", 14, rtype, 1, 2, 1_736_000_000_000_000_000 + i, i + 1, 100_000_000_000 + i, 10 + i, 0, 0, b"A", b"B", 0, 0, i)
    other = struct.pack("<BBHIQ", 4, 0x12, 1, 2, 5)
    body = head + record(0) + other + record(1) + record(2)
    (tmp_path / "x-20250106.dbn.zst").write_bytes(zstandard.ZstdCompressor().compress(body))
    (tmp_path / "x-20250107.dbn").write_bytes(head + record(5) + record(6, 0xA1))
    spark.dataSource.register(sources.DbnSource)
    got = spark.read.format("dbn").load(str(tmp_path)).orderBy("day", "seq").collect()
    assert [(str(r.day), r.order_id, r.size, r.action, r.side) for r in got] == [("2025-01-06", 1, 10, "A", "B"), ("2025-01-06", 2, 11, "A", "B"), ("2025-01-06", 3, 12, "A", "B"), ("2025-01-07", 6, 15, "A", "B")]
    with pytest.raises(ValueError):
        sources.read_dbn(b"nothing")
    assert sources.hot_path(str(tmp_path / "x-20250107.dbn.zst")) == str(tmp_path / "x-20250107.dbn")
    assert sources.day_name("/a/b-20250107.dbn") == "20250107" and sources.day_name("/a/2025-01-07.dbn") == "2025-01-07"
    assert [str(r.day) for r in sources.trading_days(spark, "2025-01-03", "2025-01-07", ["2025-01-06"]).orderBy("day").collect()] == ["2025-01-03", "2025-01-07"]
    mem = sources.from_rows(spark, [(1, "A", "B", 5, 6, None), (2, "A", "B", 5, 6, 86_400_000_000_000)]).collect()
    assert [(r.seq, r.ts_ns, str(r.day)) for r in mem] == [(0, 0, "1970-01-01"), (1, 86_400_000_000_000, "1970-01-02")]
    assert spark.createDataFrame([("/x/a-20250107.dbn",)], "p string").select(sources.day_of_path(F.col("p")).cast("string").alias("d")).first().d == "2025-01-07"


def test_tensor_layouts(spark):
    v = [[float(i) for i in range(8)]] * 2
    x = spark.createDataFrame([(v,)], "s array<array<double>>")
    get = lambda *a: x.select(tensors.reshape(F.col("s"), *a).alias("t")).first().t
    assert get("flat", 2) == v and get("deeplob", 2)[0] == [[0, 1], [2, 3], [4, 5], [6, 7]] and get("hlob", 2)[1] == [[0, 2, 4, 6], [1, 3, 5, 7]]
    assert get("image", 2, 1, 3, 3)[0] == [[[0, 1, 2], [3, 4, 5], [6, 7, 0]]]
    with pytest.raises(ValueError):
        tensors.reshape(F.col("s"), "cube", 2)


def test_batch_modes(spark):
    def work(session, day):
        if day == "b":
            raise ValueError("no such day")
        return session.range(5).count()

    seen = []
    out = batch.run(spark, ["a", "b", "c"], work, fail_fast=False, progress=lambda p: seen.append(p.percent))
    assert out.by_day() == [("a", 5), ("c", 5)] and "no such day" in out.errors["b"] and seen[-1] == 100
    out = batch.run(spark, ["b", *"acdefgh"], work, parallel=1)
    assert len(out.errors) > 1 and "ValueError" in out.errors["b"]
    token = batch.CancellationToken()
    token.cancel()
    assert len(batch.run(spark, ["a"], work, token=token).errors) == 1


def test_command_line(spark, stream, tmp_path):
    assert main(["--generate-config", str(tmp_path / "multi.toml")]) == 0
    assert config.Dataset.load(str(tmp_path / "multi.toml")).labels.all_horizons == [10, 20, 30, 50, 100]
    for d in ("2024-10-04", "2024-10-05"):
        stream.where(F.col("day") == d).write.parquet(str(tmp_path / "in" / "T" / (d.replace("-", "") + ".parquet")))
    c = made(data=config.Data("T", str(tmp_path / "in"), dates=["2024-10-04", "2024-10-05", "2024-10-06"]), output=str(tmp_path / "out"), split=config.Split(0.5, 0.5))
    c.save(str(tmp_path / "c.toml"))
    with pytest.raises(dataset.Invalid, match="level spreads"):  # prices at random cross
        main(["--config", str(tmp_path / "c.toml")])
    c.least_spreads = 0.1
    c.save(str(tmp_path / "c.toml"))
    assert main(["--config", str(tmp_path / "c.toml")]) == 0
    facts = json.loads((tmp_path / "out" / "2024-10-05_normalization.json").read_text())
    assert facts["std_ask_price_0"] > 0 and facts["mean_ask_price_0"] == facts["mean_bid_price_0"]
    assert json.loads((tmp_path / "out" / "2024-10-05_horizons.json").read_text())["horizons"] == [3, 5]
    got = json.loads((tmp_path / "out" / "manifest.json").read_text())
    assert set(got["splits"]) == {"train", "val"} and (tmp_path / "out" / "2024-10-05_sequences.npy").exists()
    assert main([]) == 2


def test_returns_are_written_as_they_are(spark, stream, tmp_path):
    c = made(labels=config.Labels(strategy="magnitude", horizons=[3, 5]))
    s = materialized(dataset.samples(stream, c), "samples")
    x = materialized(dataset.aligned(s, c), "aligned")
    got = export.numpy_days(x, str(tmp_path / "out"), ["label_3", "label_5"], c).collect()
    for r in got:
        want = np.array([[a.label_3, a.label_5] for a in x.where(F.col("day") == r.day).orderBy("seq_id").collect()], np.float32)
        written = np.load(tmp_path / "out" / f"{r.day}_labels.npy")
        assert written.dtype == np.float32 and np.array_equal(written, want) and np.abs(written).max() > 0
    with pytest.raises(ValueError, match="one byte"):
        export.label_array([np.array([0.5, 1.0])], False)
    with pytest.raises(ValueError, match="one byte"):
        export.label_array([np.array([300])], False)


def test_symbols_of_a_day_are_apart(spark, stream):
    c = made()
    both = stream.withColumn("symbol", F.lit("X")).unionByName(stream.withColumn("symbol", F.lit("Y")).withColumn("price", F.col("price") * 2))
    keys = ("symbol", "day")
    s = materialized(dataset.samples(both, c, keys=keys), "samples")
    one = dataset.samples(stream, c).drop("day").orderBy("seq").collect()
    assert s.where("symbol = 'X'").drop("symbol", "day").orderBy("seq").collect() == one
    assert s.where("symbol = 'Y'").count() == len(one)
    x = dataset.aligned(s, c, keys)
    assert x.groupBy("symbol", "day").count().count() == 4


def test_scales_replace_the_sequences(spark, stream):
    c = made(sequences=config.Sequences(10, 5, {"fast": [1, 8], "slow": [3, 6]}), normalization=config.Normalization(*["none"] * 4))
    s = materialized(dataset.samples(stream, c), "samples")
    wanted = {(r.day, r.t) for r in dataset.label_rows(s, c).collect()}
    values = {(r.day, r.sample_idx): r.mid_price for r in s.collect()}
    got = dataset.aligned(s, c).collect()
    want = {(n, day, (t // d) - (w - 1)) for n, (d, w) in c.sequences.scales.items() for day, t in wanted if t % d == 0 and t // d >= w - 1}
    assert {(r.scale, r.day, r.seq_id) for r in got} == want and len(got) == len(want)
    for r in got[:50]:
        d, w = c.sequences.scales[r.scale]
        assert [v[40] for v in r.features] == [values[r.day, (r.seq_id + k) * d] for k in range(w)]


def test_stale_orders_are_evicted(spark):
    """Against a plain tracker: the oldest ids of those that are too old go at every n-th message."""
    from tickforge.operators import mbo

    r = random.Random(3)
    data, t = [], 0
    for i in range(600):
        t += r.randint(1, 100)
        data.append(("d", i, t, r.choice("AAAACTM"), "B", r.randint(1, 150), 100, r.randint(1, 9)))
    messages = spark.createDataFrame(data, "day string, seq long, ts_ns long, action string, side string, order_id long, price long, size long")
    limit, batch, age, every = 20, 5, 2000, 10
    active, want, gone = {}, {}, 0
    for day, seq, ts, action, _, order, _, size in data:
        if action == "A":
            active[order] = [ts, size]
        elif action == "C":
            active.pop(order, None)
        elif action == "T" and order in active:
            active[order][1] -= size
            if active[order][1] <= 0:
                del active[order]
        if (seq + 1) % every == 0 and len(active) > limit:
            for o in sorted(o for o, (made_at, _) in active.items() if made_at < ts - age)[:batch]:
                del active[o]
                gone += 1
        want[seq] = len(active)
    from tickforge.functions.folds import fold

    rows = mbo.with_evictions(fold(messages, [mbo.evictions(limit, batch, age, every)]))
    got = mbo.without_evictions(mbo.order_columns(mbo.lifecycles(rows)))
    counted = {x.seq: x.active_order_count for x in got.collect()}
    assert gone > 20 and set(counted) == set(want)
    late = {s: n for s, n in counted.items() if (s + 1) % every}  # an eviction counts from the next message on
    assert all(want[s] == n for s, n in late.items())


def test_normalisation_strategies(spark):
    from tickforge.operators import normalize

    data = [("d", i, float(1 + i % 7), float(2 + i % 5), float(i % 3), 1) for i in range(60)]
    rows = spark.createDataFrame(data, "day string, sample_idx long, ask_price_0 double, bid_price_0 double, x double, weight long")
    columns = ["ask_price_0", "bid_price_0", "x"]
    a, b, x = (np.array([r[k] for r in data]) for k in (2, 3, 4))
    want = {
        "percentage": lambda v: (v - v.mean()) / v.mean(), "min_max": lambda v: (v - v.min()) / (v.max() - v.min()), "min_max_signed": lambda v: 2 * (v - v.min()) / (v.max() - v.min()) - 1,
        "bilinear": lambda v: (v - v.mean()) / 0.5, "z": lambda v: (v - v.mean()) / (v.std() + 1e-8),
    }
    for name, f in want.items():
        got = normalize.apply(rows, normalize.statistics(rows, columns, name), columns, strategy=name).orderBy("sample_idx").collect()
        for c, v in zip(columns, (a, b, x), strict=True):
            assert np.allclose([r[c] for r in got], f(v)), (name, c)
    short = rows.unionByName(rows.where("sample_idx < 3").withColumns({"day": F.lit("short"), "weight": F.lit(0)}))
    got = normalize.apply(short, normalize.statistics(short, columns, "market"), columns).groupBy("day").agg(F.count("x").alias("n")).collect()
    assert {r.day: r.n for r in got} == {"d": 60, "short": 0}
    mixed = {"ask_price_0": "z", "bid_price_0": "z", "x": "min_max"}
    got = normalize.apply(rows, normalize.statistics(rows, columns, mixed, ask_side=True), columns, strategy=mixed).orderBy("sample_idx").collect()
    assert np.allclose([r.bid_price_0 for r in got], (b - a.mean()) / (a.std() + 1e-8)) and np.allclose([r.x for r in got], want["min_max"](x))
    for name in config.NORMALIZATIONS:
        c = config.Dataset(normalization=name).validate()
        assert config.Dataset.from_dict(c.to_dict()) == c and c.normalization.applied == (name not in ("none", "raw", "tlob_paper"))


def test_sequence_facts(spark):
    from tickforge.operators import sequences

    rows = spark.createDataFrame([("d", i, i * 2_000_000_000) for i in range(25)], "day string, sample_idx long, ts_ns long")
    assert tuple(sequences.statistics(rows, 10, 5, 20).first()) == ("d", 25, 4, 20, 1.0)
    one = sequences.ends(rows, 10, 5).select(sequences.duration_seconds().alias("s"), sequences.average_interval().alias("i")).first()
    assert (one.s, one.i) == (18.0, 2.0)
    with pytest.raises(ValueError, match="missing"):
        sequences.materialize(rows, ["nothing"], 10, 5)


def test_tensors_are_written(spark, stream, tmp_path):
    for layout, shape in (("deeplob", (10, 4, 10)), ("image", (10, 3, 4, 10))):
        c = made(tensor=layout)
        x = dataset.aligned(materialized(dataset.samples(stream, c), "samples"), c)
        export.numpy_days(x, str(tmp_path / layout), ["label_3", "label_5"], c).collect()
        assert np.load(tmp_path / layout / "2024-10-04_sequences.npy").shape[1:] == shape


def test_experiments_and_label_presets(tmp_path):
    assert len(config.EXPERIMENTS) == 23
    for name, make in config.EXPERIMENTS.items():
        assert main(["--generate-config", str(tmp_path / f"{name}.toml"), "--experiment", name]) == 0
        assert config.Dataset.load(str(tmp_path / f"{name}.toml")) == make().validate()
    c = config.LABEL_PRESETS["barrier_per_horizon"]()
    assert [c.barriers(h) for h in c.all_horizons] == [(0.002, 0.0015), (0.005, 0.003), (0.01, 0.005)]
    with pytest.raises(config.ConfigError):
        config.Dataset.from_dict({"labels": {"horizons": [1, 2], "profits": [0.1]}})


def test_output(spark, stream):
    from tickforge.plans.output import Output

    out = Output.of(stream, made())
    assert out.feature_count == 98 and out.lob_levels is None
    assert out.format_as("hlob").count() == out.sequences().count() > 0
    got = out.multi_horizon_labels(config.Labels(horizons=[2, 4, 6], smoothing=1, threshold=0.0001))
    assert got.columns == ["day", "t", "label_2", "label_4", "label_6"] and got.count() > 50


def test_exact_quantiles(spark):
    from tickforge.operators import align

    r = np.random.default_rng(1)
    for x in (r.normal(size=5000), r.integers(0, 5, 3000).astype(float), np.array([3.0]), np.zeros(0)):
        shares = [0.0, 0.003, 0.25, 0.5, 0.9, 1.0]
        rows = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(3)
        got = align.exact_quantiles(rows, "x", shares).first().q
        assert (got is None) == (len(x) == 0) and (got is None or np.allclose(got, np.quantile(x, shares)))
