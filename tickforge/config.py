"""Configuration of a dataset: dataclasses, presets, validation, TOML and JSON."""

import dataclasses
import datetime
import json
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from tickforge import contract
from tickforge.operators.sequences import horizon_aware

GROUPS = ("institutional", "volatility", "seasonality")


class ConfigError(ValueError):
    pass


def _need(test: bool, what: str) -> None:
    if not test:
        raise ConfigError(what)


@dataclass
class Features:
    levels: int = 10
    derived: bool = True
    mbo: bool = True
    signals: bool = True
    queue: bool = False
    experimental: bool = False
    groups: list[str] = field(default_factory=list)
    mbo_window: int = 1000
    fast_window: int = 100
    slow_window: int = 5000
    #: Active orders above which stale ones are evicted from the order statistics; 0: never.
    max_orders: int = 50_000
    tick: int = contract.TICK

    @property
    def active_groups(self) -> list[str]:
        return [g for g in GROUPS if self.experimental and (not self.groups or g in self.groups)]

    def count(self) -> int:
        sizes = {"institutional": 8, "volatility": 6, "seasonality": 4}
        return contract.feature_count(self.levels, self.derived, self.mbo, self.signals, sum(sizes[g] for g in self.active_groups))

    def validate(self) -> None:
        _need(1 <= self.levels <= 50, "levels must be 1 to 50")
        _need(self.max_orders >= 0, "max_orders must not be below 0")
        _need(self.tick > 0, "tick must be above 0")
        _need(not self.signals or (self.derived and self.mbo and self.levels == 10), "signals need derived and mbo features and 10 levels")
        _need(not self.queue or self.mbo, "queue tracking needs mbo features")
        _need(not self.experimental or self.mbo, "experimental features need mbo features")
        _need(set(self.groups) <= set(GROUPS), f"unknown groups in {self.groups}")


@dataclass
class Sampling:
    strategy: str = "volume"
    event_count: int = 100
    volume_threshold: int = 1000
    min_interval_ns: int = 1_000_000
    adaptive: bool = False
    volatility_window: int = 1000
    calibration: int = 100
    low: float = 0.5
    high: float = 2.0

    def validate(self) -> None:
        _need(self.strategy in ("event", "volume", "multiscale"), f"sampling strategy {self.strategy} isn't available")
        _need(self.event_count > 0 and self.volume_threshold > 0, "sampling counts must be above 0")
        _need(self.volatility_window >= 2 and self.calibration > 0 and 0 < self.low <= self.high, "bad adaptive sampling")


@dataclass
class Sequences:
    window: int = 100
    stride: int = 10
    scales: dict[str, list[int]] = field(default_factory=dict)

    def validate(self) -> None:
        _need(self.window >= 1 and 1 <= self.stride <= self.window, "1 <= stride <= window")
        _need(all(len(x) == 2 and min(x) >= 1 for x in self.scales.values()), "scales need (decimation, window)")


@dataclass
class Labels:
    strategy: str = "tlob"
    horizon: int = 10
    horizons: list[int] = field(default_factory=list)
    smoothing: int = 5
    threshold: float = 0.002
    threshold_kind: str = "fixed"
    threshold_window: int = 1000
    profit: float = 0.005
    stop: float = 0.003
    profits: list[float] = field(default_factory=list)
    stops: list[float] = field(default_factory=list)
    min_hold: int = 0
    timeout: str = "timeout"
    conflict: str = "larger"
    down_threshold: float | None = None
    volatility_reference: float | None = None

    #: Range and names of the classes of each strategy.
    @property
    def encoding(self) -> dict[int, str]:
        return {"triple_barrier": {0: "stop", 1: "timeout", 2: "profit"}, "opportunity": {-1: "big_down", 0: "none", 1: "big_up"}}.get(self.strategy, {-1: "down", 0: "stable", 1: "up"})

    @property
    def all_horizons(self) -> list[int]:
        return sorted({h for h in (self.horizons or [self.horizon]) if h > 0})

    def barriers(self, horizon: int) -> tuple[float, float]:
        """Profit and stop of a horizon."""
        at = self.all_horizons.index(horizon)
        return self.profits[at] if self.profits else self.profit, self.stops[at] if self.stops else self.stop

    def validate(self) -> None:
        for given in (self.profits, self.stops):
            _need(not given or len(given) == len(self.all_horizons) and min(given) > 0, "per-horizon barriers need one value above 0 for each horizon")
        _need(self.strategy in ("tlob", "deeplob", "opportunity", "triple_barrier", "magnitude"), f"unknown labels {self.strategy}")
        _need(bool(self.all_horizons), "a horizon above 0 is needed")
        _need(self.threshold_kind in ("fixed", "spread", "quantile", "dynamic"), f"unknown threshold {self.threshold_kind}")
        _need(self.threshold > 0 and self.profit > 0 and self.stop > 0, "thresholds must be above 0")
        _need(self.timeout in ("timeout", "sign", "half") and self.conflict in ("larger", "up", "down", "ambiguous"), "unknown timeout or conflict rule")
        _need(all(self.min_hold < h for h in self.all_horizons), "min_hold must be below the horizons")


@dataclass
class Split:
    train: float = 0.7
    val: float = 0.15

    def validate(self) -> None:
        _need(0 < self.train <= 1 and 0 <= self.val <= 1 and self.train + self.val <= 1 + 1e-9, "split shares must add up to 1 at most")


@dataclass
class Data:
    symbol: str = ""
    path: str = ""
    template: str = "{symbol}/{date}.parquet"
    dates: list[str] = field(default_factory=list)
    start: str = ""
    end: str = ""
    exclude: list[str] = field(default_factory=list)

    def file(self, day: datetime.date) -> str:
        return f"{self.path}/" * bool(self.path) + self.template.format(symbol=self.symbol, date=day.strftime("%Y%m%d"))

    def days(self) -> list[datetime.date]:
        """The listed dates, or the weekdays of the range without the excluded ones."""
        if self.dates:
            return [datetime.date.fromisoformat(d) for d in self.dates]
        if not self.start:
            return []
        first, last = (datetime.date.fromisoformat(d) for d in (self.start, self.end or self.start))
        days = (first + datetime.timedelta(i) for i in range((last - first).days + 1))
        return [d for d in days if d.weekday() < 5 and d.isoformat() not in self.exclude]

    def validate(self) -> None:
        try:
            days = self.days()
        except ValueError as bad:
            raise ConfigError(str(bad)) from bad
        _need(days == sorted(days), "dates must be in order")


@dataclass
class Normalization:
    """The strategy of each group of columns; signals and experimental features always stay as they are."""

    prices: str = "market"
    sizes: str = "market"
    derived: str = "z"
    mbo: str = "z"
    bilinear_scale: float = 50.0
    #: Statistics of price and size levels from the ask side only, applied to both sides; else each column's own.
    ask_side: bool = False

    @property
    def applied(self) -> bool:
        return {self.prices, self.sizes, self.derived, self.mbo} != {"none"}

    def strategies(self) -> dict[str, str]:
        """The strategy of each column of the contract that has one."""
        out = {n: self.prices if "_price_" in n else self.sizes for n in contract.RAW}
        out |= dict.fromkeys(contract.DERIVED, self.derived) | dict.fromkeys(contract.MBO, self.mbo)
        return {n: s for n, s in out.items() if s != "none"}

    def validate(self) -> None:
        for part in (self.prices, self.sizes, self.derived, self.mbo):
            _need(part in NORMALIZERS, f"unknown normalisation {part}")
        _need(self.derived not in ("market",) and self.mbo not in ("market",), "only price and size levels can be pooled by level")
        _need(self.bilinear_scale > 0, "the bilinear scale must be above 0")


NORMALIZERS = ("none", "z", "market", "global", "percentage", "min_max", "min_max_signed", "bilinear")
#: Named combinations of strategies for prices, sizes, derived and message features.
NORMALIZATIONS = {
    "none": ("none", "none", "none", "none"),
    "z": ("z", "z", "z", "z"),
    "market": ("market", "market", "z", "z"),
    "global": ("global", "global", "z", "z"),
    "raw": ("none", "none", "none", "none"),
    "tlob_paper": ("none", "none", "none", "none"),
    "tlob_repo": ("global", "global", "none", "none"),
    "deeplob": ("z", "z", "none", "none"),
    "lobench": ("global", "global", "global", "global"),
    "fi2010": ("z", "z", "z", "none"),
}


@dataclass
class Dataset:
    name: str = "dataset"
    data: Data = field(default_factory=Data)
    features: Features = field(default_factory=Features)
    sampling: Sampling = field(default_factory=Sampling)
    sequences: Sequences = field(default_factory=Sequences)
    labels: Labels = field(default_factory=Labels)
    split: Split = field(default_factory=Split)
    normalization: Normalization = field(default_factory=Normalization)
    tensor: str = "flat"
    #: Share of level spreads above 0 without which an export stops.
    least_spreads: float = 0.99
    output: str = ""

    def __post_init__(self):
        if isinstance(self.normalization, str):
            _need(self.normalization in NORMALIZATIONS, f"unknown normalisation {self.normalization}")
            self.normalization = Normalization(*NORMALIZATIONS[self.normalization])

    def validate(self) -> "Dataset":
        for f in dataclasses.fields(self):
            part = getattr(self, f.name)
            if hasattr(part, "validate"):
                part.validate()
        _need(self.tensor in ("flat", "deeplob", "hlob", "image"), f"unknown tensor layout {self.tensor}")
        return self

    def to_dict(self) -> dict:
        return dataclasses.asdict(self)

    @classmethod
    def from_dict(cls, given: dict) -> "Dataset":
        parts = {f.name: f.type for f in dataclasses.fields(cls)}
        if unknown := set(given) - set(parts):
            raise ConfigError(f"unknown sections {sorted(unknown)}")
        try:
            return cls(**{k: parts[k](**v) if isinstance(v, dict) else v for k, v in given.items()}).validate()
        except TypeError as bad:
            raise ConfigError(str(bad)) from bad

    def save(self, path: str) -> None:
        text = json.dumps(self.to_dict(), indent=2) if path.endswith(".json") else to_toml(self.to_dict())
        Path(path).write_text(text)

    @classmethod
    def load(cls, path: str) -> "Dataset":
        text = Path(path).read_text()
        return cls.from_dict(json.loads(text) if path.endswith(".json") else tomllib.loads(text))

    @classmethod
    def for_horizon(cls, horizon: int, **more) -> "Dataset":
        window, stride = horizon_aware(horizon)
        return cls(sequences=Sequences(window, stride), labels=Labels(horizon=horizon), **more)


def to_toml(given: dict) -> str:
    """TOML of a dict of plain values, lists and tables; None is left out."""
    value = lambda v: json.dumps(v, ensure_ascii=False) if not isinstance(v, dict) else "{" + ", ".join(f"{k} = {json.dumps(x)}" for k, x in v.items()) + "}"
    lines = [f"{k} = {value(v)}" for k, v in given.items() if not isinstance(v, dict) and v is not None]
    for k, v in given.items():
        if isinstance(v, dict):
            lines += ["", f"[{k}]", *(f"{n} = {value(x)}" for n, x in v.items() if x is not None)]
    return "\n".join(lines) + "\n"


#: Presets of features, sequences and labels by name.
PRESETS = {
    "deeplob": lambda: Dataset("deeplob", features=Features(derived=False, mbo=False, signals=False)),
    "tlob": lambda: Dataset("tlob", features=Features(derived=False, mbo=False, signals=False)),
    "translob": lambda: Dataset("translob", features=Features(derived=False, mbo=False, signals=False)),
    "fi2010": lambda: Dataset("fi2010", features=Features(mbo=False, signals=False)),
    "lit": lambda: Dataset("lit", features=Features(levels=20, derived=False, mbo=False, signals=False)),
    "minimal": lambda: Dataset("minimal", features=Features(levels=5, derived=False, mbo=False, signals=False), sequences=Sequences(50, 10)),
    "full": lambda: Dataset("full", features=Features(signals=False)),
}
LABEL_PRESETS = {
    "default": lambda: Labels(horizon=10, smoothing=5, threshold=0.002),
    "hft": lambda: Labels(horizon=10, smoothing=5, threshold=0.0002),
    "short": lambda: Labels(horizon=50, smoothing=10, threshold=0.002),
    "medium": lambda: Labels(horizon=100, smoothing=20, threshold=0.005),
    "fi2010": lambda: Labels(horizon=10, smoothing=10, threshold=0.002),
    "multi_tlob": lambda: Labels(horizons=[1, 3, 5, 10, 30, 50], smoothing=5, threshold=0.002),
    "multi_hft": lambda: Labels(horizons=[5, 10, 20], smoothing=3, threshold=0.0002),
    "opportunity_medium": lambda: Labels(strategy="opportunity", horizon=50, threshold=0.005),
    "opportunity_whale": lambda: Labels(strategy="opportunity", horizon=100, threshold=0.01),
    "opportunity_extreme": lambda: Labels(strategy="opportunity", horizon=200, threshold=0.02),
    "barrier_scalping": lambda: Labels(strategy="triple_barrier", horizon=20, profit=0.002, stop=0.0015),
    "barrier_intraday": lambda: Labels(strategy="triple_barrier", horizon=100, profit=0.005, stop=0.003),
    "barrier_swing": lambda: Labels(strategy="triple_barrier", horizon=500, profit=0.01, stop=0.005),
    "barrier_per_horizon": lambda: Labels(strategy="triple_barrier", horizons=[20, 100, 500], profits=[0.002, 0.005, 0.01], stops=[0.0015, 0.003, 0.005]),
    "multi_fi2010": lambda: Labels(horizons=[10, 20, 30, 50, 100], smoothing=5, threshold=0.002),
    "multi_deeplob": lambda: Labels(horizons=[10, 20, 50, 100], smoothing=5, threshold=0.002),
    "spread_adaptive": lambda: Labels(threshold_kind="spread", threshold=1.0, threshold_window=1000),
    "balanced": lambda: Labels(threshold_kind="quantile", threshold=0.33),
    "dynamic": lambda: Labels(threshold_kind="dynamic", threshold=2.0),
    "returns": lambda: Labels(strategy="magnitude", horizons=[10, 50, 100]),
    "barrier_symmetric": lambda: Labels(strategy="triple_barrier", profit=0.004, stop=0.004),
}


def _experiment(name: str, labels: str, normalization: str = "market", experimental: bool = False, scales: dict | None = None, **more) -> Dataset:
    return Dataset(name, features=Features(experimental=experimental), labels=LABEL_PRESETS[labels](), normalization=normalization, sequences=Sequences(scales=scales or {}), **more)


#: Configurations to start an experiment from, by name.
EXPERIMENTS = {
    "98feat": lambda: _experiment("98feat", "default"),
    "98feat_multi_horizon": lambda: _experiment("98feat_multi_horizon", "multi_fi2010"),
    "116feat": lambda: _experiment("116feat", "default", experimental=True),
    "116feat_multi_horizon": lambda: _experiment("116feat_multi_horizon", "multi_fi2010", experimental=True),
    "84feat": lambda: Dataset("84feat", features=Features(signals=False), labels=LABEL_PRESETS["default"]()),
    "extended_horizons": lambda: _experiment("extended_horizons", "multi_tlob"),
    "hft": lambda: _experiment("hft", "multi_hft", sampling=Sampling("event", event_count=10)),
    "balanced": lambda: _experiment("balanced", "balanced"),
    "spread_adaptive": lambda: _experiment("spread_adaptive", "spread_adaptive"),
    "adaptive_sampling": lambda: _experiment("adaptive_sampling", "default", sampling=Sampling(adaptive=True)),
    "bigmoves": lambda: _experiment("bigmoves", "opportunity_whale"),
    "triple_barrier": lambda: _experiment("triple_barrier", "barrier_intraday"),
    "triple_barrier_horizons": lambda: _experiment("triple_barrier_horizons", "barrier_per_horizon"),
    "triple_barrier_volscaled": lambda: _with_reference(_experiment("triple_barrier_volscaled", "barrier_intraday")),
    "returns": lambda: _experiment("returns", "returns"),
    "deeplob": lambda: Dataset("deeplob", features=Features(derived=False, mbo=False, signals=False), labels=LABEL_PRESETS["multi_deeplob"](), normalization="deeplob", tensor="deeplob"),
    "tlob_raw": lambda: Dataset("tlob_raw", features=Features(derived=False, mbo=False, signals=False), labels=LABEL_PRESETS["multi_tlob"](), normalization="tlob_paper"),
    "tlob_repo": lambda: Dataset("tlob_repo", features=Features(derived=False, mbo=False, signals=False), labels=LABEL_PRESETS["multi_tlob"](), normalization="tlob_repo"),
    "lobench": lambda: _experiment("lobench", "multi_fi2010", "lobench"),
    "fi2010": lambda: Dataset("fi2010", features=Features(mbo=False, signals=False), labels=LABEL_PRESETS["multi_fi2010"](), normalization="fi2010"),
    "hlob": lambda: Dataset("hlob", features=Features(derived=False, mbo=False, signals=False), labels=LABEL_PRESETS["default"](), tensor="hlob"),
    "multi_scale": lambda: _experiment("multi_scale", "default", scales={"fast": [1, 100], "medium": [2, 500], "slow": [4, 1000]}),
    "multi_symbol": lambda: _experiment("multi_symbol", "multi_fi2010", data=Data(template="{date}.parquet")),
}


def _with_reference(c: Dataset, reference: float = 0.02) -> Dataset:
    c.labels.volatility_reference = reference
    return c


class Builder:
    """Fluent construction of a Dataset."""

    def __init__(self, preset: str | None = None):
        self.config = PRESETS[preset]() if preset else Dataset(features=Features(derived=False, mbo=False, signals=False))

    def _set(self, part: str, **values) -> "Builder":
        for k, v in values.items():
            setattr(getattr(self.config, part), k, v)
        return self

    def lob_levels(self, n: int) -> "Builder":
        return self._set("features", levels=n)

    def with_derived_features(self) -> "Builder":
        return self._set("features", derived=True)

    def with_mbo_features(self) -> "Builder":
        return self._set("features", mbo=True)

    def with_trading_signals(self) -> "Builder":
        return self._set("features", derived=True, mbo=True, signals=True)

    def with_experimental(self, *groups: str) -> "Builder":
        return self._set("features", mbo=True, experimental=True, groups=list(groups))

    def mbo_window(self, n: int) -> "Builder":
        return self._set("features", mbo_window=n)

    def tick_size(self, nanos: int) -> "Builder":
        return self._set("features", tick=nanos)

    def window(self, n: int, stride: int) -> "Builder":
        return self._set("sequences", window=n, stride=stride)

    def with_horizon_aware(self, horizon: int) -> "Builder":
        return self.window(*horizon_aware(horizon))

    def volume_sampling(self, n: int) -> "Builder":
        return self._set("sampling", strategy="volume", volume_threshold=n)

    def event_sampling(self, n: int) -> "Builder":
        return self._set("sampling", strategy="event", event_count=n)

    def min_sample_interval_ns(self, n: int) -> "Builder":
        return self._set("sampling", min_interval_ns=n)

    def with_adaptive_sampling(self, **values) -> "Builder":
        return self._set("sampling", adaptive=True, **values)

    def with_multiscale(self, scales: dict[str, list[int]] | None = None) -> "Builder":
        return self._set("sequences", scales=scales or {"fast": [1, 100], "medium": [2, 500], "slow": [4, 1000]})

    def with_normalization(self, preset: str) -> "Builder":
        self.config.normalization = Normalization(*NORMALIZATIONS[preset])
        return self

    def with_labels(self, preset: str) -> "Builder":
        self.config.labels = LABEL_PRESETS[preset]()
        return self

    def tensor(self, layout: str) -> "Builder":
        self.config.tensor = layout
        return self

    def experiment(self, name: str) -> "Builder":
        self.config.name = name
        return self

    def build(self) -> Dataset:
        return self.config.validate()

    def feature_count(self) -> int:
        return self.config.features.count()

    def summary(self) -> str:
        c = self.config
        return f"{c.name}: {c.features.count()} features, {c.sampling.strategy} sampling, windows of {c.sequences.window} by {c.sequences.stride}"
