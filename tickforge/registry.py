"""Named feature schemas: lookup by name, position and category."""

from dataclasses import dataclass, field

from tickforge import contract


@dataclass(frozen=True)
class FeatureDef:
    name: str
    index: int
    category: str
    description: str = ""
    paper: str = ""
    level: int | None = None


#: Category and literature of each group of names, in index order.
GROUPS = (
    ("raw_lob", contract.RAW, ""),
    ("derived", contract.DERIVED, "Stoikov 2018"),
    ("mbo", contract.MBO, ""),
    ("signal", contract.SIGNALS, "Cont, Kukanov and Stoikov 2014"),
    ("institutional", contract.INSTITUTIONAL, ""),
    ("volatility", contract.VOLATILITY, "Andersen and Bollerslev 1998"),
    ("seasonality", contract.SEASONALITY, ""),
)
FI2010_INSENSITIVE = ["spread", "mid_price", *(f"{s}_gap_{i}" for s in ("ask", "bid") for i in range(9))]
FI2010_SENSITIVE = ["d_mid", "d_spread", "abs_d_mid", "total_volume", "bid_volume", "ask_volume", "relative_spread", "d_relative_spread", "bid_ask_ratio", "d_bid_ask_ratio", *(f"d_ask_price_{i}" for i in range(10))]
FI2010_DEPTH = [f"{s}_cum_{k}_{i}" for k in ("volume", "distance") for s in ("bid", "ask") for i in range(10)]
ORDER_FLOW = ["ofi", "ofi_bid", "ofi_ask", "queue_imbalance", "trade_imbalance", "depth_imbalance", "arrival_rate_bid", "arrival_rate_ask"]


@dataclass
class Schema:
    features: list[FeatureDef] = field(default_factory=list)
    version: float = contract.SCHEMA_VERSION

    def add(self, category: str, names: list[str], paper: str = "") -> "Schema":
        for n in names:
            level = int(n.rpartition("_")[2]) if n.rpartition("_")[2].isdigit() else None
            self.features.append(FeatureDef(n, len(self.features), category, n.replace("_", " "), paper, level))
        return self

    def __len__(self) -> int:
        return len(self.features)

    def __contains__(self, name: str) -> bool:
        return any(f.name == name for f in self.features)

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.features]

    def by_name(self, name: str) -> FeatureDef:
        return next(f for f in self.features if f.name == name)

    def by_category(self, category: str) -> list[FeatureDef]:
        return [f for f in self.features if f.category == category]

    def indices(self, category: str) -> list[int]:
        return [f.index for f in self.by_category(category)]


def raw_names(levels: int) -> list[str]:
    return [f"{s}_{k}_{i}" for s in ("ask", "bid") for k in ("price", "size") for i in range(levels)]


def stable() -> Schema:
    out = Schema()
    for category, names, paper in GROUPS[:4]:
        out.add(category, list(names), paper)
    return out


def full() -> Schema:
    out = stable()
    for category, names, paper in GROUPS[4:]:
        out.add(category, list(names), paper)
    return out


def fi2010() -> Schema:
    """Raw levels and the three hand-crafted groups of Ntakaris et al. (2018): 120 features."""
    return Schema().add("raw_lob", raw_names(10)).add("fi2010_insensitive", FI2010_INSENSITIVE).add("fi2010_sensitive", FI2010_SENSITIVE).add("fi2010_depth", FI2010_DEPTH)


def complete_book() -> Schema:
    """FI-2010 groups with order flow and derived features: 136."""
    return fi2010().add("order_flow", ORDER_FLOW).add("derived", list(contract.DERIVED))


def minimal(levels: int = 10) -> Schema:
    return Schema().add("raw_lob", raw_names(levels))


PRESETS = {"stable": stable, "full": full, "fi2010": fi2010, "complete_book": complete_book, "minimal": minimal}
