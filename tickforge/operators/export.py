"""Sinks: Parquet by day, and NumPy files of a day with their metadata."""

import datetime
import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge import contract
from tickforge.config import Dataset
from tickforge.operators import tensors


def parquet(rows: DataFrame, path: str, day: str = "day") -> None:
    rows.write.partitionBy(day).parquet(path)


def check_width(columns: list[str]) -> str | None:
    """A warning for widths other than those of the contract."""
    if len(columns) in (contract.STABLE_FEATURES, contract.FULL_FEATURES):
        return None
    return f"{len(columns)} features; the contract has {contract.STABLE_FEATURES} or {contract.FULL_FEATURES}"


def store_of(path: str) -> tuple:
    """The file system of a path or URI, and the path in it. A path without a scheme is a folder that the driver and
    all executors share, as on one machine or a mounted file system."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def exists(path: str) -> bool:
    from pyarrow import fs

    store, at = store_of(path)
    return store.get_file_info(at).type != fs.FileType.NotFound


def save(path: str, data: bytes) -> None:
    store, at = store_of(path)
    store.create_dir(at.rpartition("/")[0], recursive=True)
    with store.open_output_stream(at) as f:
        f.write(data)


def metadata(config: Dataset, name: str, n_sequences: int, shape: list[int], distribution: dict, symbol: str = "") -> dict:
    encoding = {str(k): v for k, v in config.labels.encoding.items()} if config.labels.strategy != "magnitude" else {}
    n = config.normalization
    return {
        "day": name, "schema_version": contract.SCHEMA_VERSION, "n_sequences": n_sequences, "window_size": config.sequences.window, "stride": config.sequences.stride, "n_features": config.features.count(), "shape": shape,
        "label_strategy": config.labels.strategy, "horizons": config.labels.all_horizons, "label_encoding": encoding, "labeling": {"label_encoding": encoding, "label_distribution": {str(k): v for k, v in distribution.items()}},
        "normalization": {"strategy": {"prices": n.prices, "sizes": n.sizes, "derived": n.derived, "mbo": n.mbo}, "applied": n.applied}, "tensor": config.tensor, "provenance": {"name": config.name, "symbol": symbol or config.data.symbol},
    }


def horizons_json(config: Dataset) -> dict:
    c = config.labels
    return {"horizons": c.all_horizons, "smoothing": c.smoothing, "strategy": c.strategy, "threshold": {"kind": c.threshold_kind, "value": c.threshold, "window": c.threshold_window}, "barriers": [list(c.barriers(h)) for h in c.all_horizons] if c.strategy == "triple_barrier" else []}


def label_array(columns: list, real: bool):
    """Labels as float32 where they are returns, else int8; a label that int8 can't hold is an error."""
    import numpy as np

    y = np.stack([np.asarray(c) for c in columns], axis=1) if columns else np.zeros((0, 0), np.int8)
    out = y.astype(np.float32 if real else np.int8)
    if not real and (out != y).any():
        raise ValueError("labels that aren't whole numbers of one byte")
    return out[:, 0] if len(columns) == 1 else out


def numpy_days(sequences: DataFrame, path: str, labels: list[str], config: Dataset, keys: tuple[str, ...] = ("day",), statistics: DataFrame | None = None) -> DataFrame:
    """Write <key>_sequences.npy (float32, in the configured layout), <key>_labels.npy (int8, or float32 for returns),
    <key>_metadata.json, and with several horizons <key>_horizons.json, of each key to a shared folder, one task a
    key; returns (day, n_sequences, n_features, md5) of what was written, `day` naming the key.

    `sequences`: keys, seq_id, features and label columns, and `scale` if there are several. A key's file needs its
    rows together; keys are the unit of the format, and the only thing that a task gathers. `statistics`, of which
    there is a row a key, go into <key>_normalization.json."""
    given, layout, by = config.to_dict(), config.tensor, [*keys, *(["scale"] if "scale" in sequences.columns else [])]
    levels = config.features.levels
    real = config.labels.strategy == "magnitude"
    values = sequences.select(*by, "seq_id", tensors.reshape(F.col("features"), layout, levels, *tensors.image_size(config.features.count(), levels)).alias("x") if layout != "flat" else F.col("features").alias("x"), *labels)
    if statistics is not None:
        facts = F.to_json(F.struct(*(c for c in statistics.columns if c not in keys)))
        values = values.join(statistics.select(*keys, facts.alias("__facts")), [*keys])

    def run(table):
        import io

        import numpy as np
        import pyarrow as pa

        rows = table.sort_by("seq_id")
        x = np.array(rows.column("x").to_pylist(), np.float32)
        y = label_array([rows.column(c).to_numpy() for c in labels], real)
        name = "_".join(str(rows.column(k)[0].as_py()) for k in by)
        made = Dataset.from_dict(given)
        digest = hashlib.md5()
        seen, counts = np.unique(y, return_counts=True) if not real else ((), ())
        symbol = str(rows.column("symbol")[0].as_py()) if "symbol" in by else ""
        about = metadata(made, name, len(x), list(x.shape), dict(zip(map(int, seen), map(int, counts), strict=True)), symbol)
        for suffix, data in (("sequences.npy", x), ("labels.npy", y)):
            buffer = io.BytesIO()
            np.save(buffer, data)
            digest.update(buffer.getvalue())
            save(f"{path}/{name}_{suffix}", buffer.getvalue())
        save(f"{path}/{name}_metadata.json", json.dumps(about, indent=2).encode())
        if len(made.labels.all_horizons) > 1:
            save(f"{path}/{name}_horizons.json", json.dumps(horizons_json(made), indent=2).encode())
        if "__facts" in rows.column_names:
            save(f"{path}/{name}_normalization.json", rows.column("__facts")[0].as_py().encode())
        return pa.table({"day": [name], "n_sequences": pa.array([len(x)], pa.int64()), "n_features": pa.array([made.features.count()], pa.int64()), "md5": [digest.hexdigest()]})

    return values.groupBy(*by).applyInArrow(run, "day string, n_sequences long, n_features long, md5 string")


def manifest(config: Dataset, files: DataFrame, splits: dict[str, str], now: datetime.datetime | None = None) -> dict:
    """What was written, by split; `files` has a row a day."""
    text = json.dumps(config.to_dict(), sort_keys=True)
    days = {r["day"]: {"n_sequences": r["n_sequences"], "md5": r["md5"]} for r in files.collect()}
    out: dict = {"name": config.name, "schema_version": contract.SCHEMA_VERSION, "config_md5": hashlib.md5(text.encode()).hexdigest(), "created": (now or datetime.datetime.now(datetime.UTC)).isoformat(), "splits": {}}
    for d in sorted(days):
        out["splits"].setdefault(next((v for k, v in splits.items() if k in d), "train"), []).append({"day": d, **days[d]})
    return out
