"""python -m tickforge --config FILE | --generate-config FILE [--experiment NAME]: export a dataset, or write a configuration to start from."""

import argparse
import functools
import json
import re


from tickforge.config import to_toml


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tickforge", description=__doc__)
    parser.add_argument("--config")
    parser.add_argument("--generate-config")
    parser.add_argument("--experiment", help="what the generated configuration starts from")
    given = parser.parse_args(args)
    from tickforge.config import EXPERIMENTS, LABEL_PRESETS, Dataset

    if given.generate_config:
        config = EXPERIMENTS[given.experiment]() if given.experiment else Dataset()
        if not given.experiment and "multi" in given.generate_config:
            config.labels = LABEL_PRESETS["multi_fi2010"]()
        config.save(given.generate_config)
        return 0
    if not given.config:
        parser.print_help()
        return 2
    from pyspark.sql import SparkSession

    config = Dataset.load(given.config)
    spark = SparkSession.builder.getOrCreate()
    print(json.dumps(export(spark, config), indent=2))
    return 0


def messages(spark, config):
    """The messages of the configured days that there are files of: Parquet, or DBN by the template's ending. With
    a column `symbol`, symbols of a day are kept apart."""
    from tickforge.operators import export as sinks
    from tickforge.sources.messages import DbnSource

    files = [f for f in map(config.data.file, config.data.days()) if sinks.exists(f)]
    if not files:
        raise FileNotFoundError("no file of the configured days")
    if not re.search(r"\.dbn(\.zst)?$", files[0]):
        return spark.read.parquet(*files)
    spark.dataSource.register(DbnSource)
    parts = [spark.read.format("dbn").load(f) for f in files]
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


def export(spark, config) -> dict:
    """Check and write the configured days as NumPy files below the output folder, by split, with a manifest."""
    from tickforge.functions.tables import materialized
    from tickforge.operators import align, export as sinks
    from tickforge.plans import dataset

    given = messages(spark, config)
    keys = ("symbol", "day") if "symbol" in given.columns else ("day",)
    rows = materialized(dataset.samples(given, config, keys=keys), "samples")
    warnings = dataset.check(rows, config, dataset.label_rows(rows, config, keys))
    splits = {str(r.day): r.split for r in align.split_days(rows.select("day").distinct(), config.split.train, config.split.val).collect()}
    sequences = dataset.aligned(rows, config, keys)
    stats = None
    if config.normalization.applied and not config.sequences.scales:
        stats = dataset.day_statistics(rows, config, config.sequences.window, config.sequences.stride, keys)[1]
    labels = [c for c in sequences.columns if c.startswith("label_")]
    out = sinks.manifest(config, sinks.numpy_days(sequences, config.output, labels, config, keys, stats), splits)
    out["warnings"] = warnings
    sinks.save(f"{config.output}/manifest.json", json.dumps(out, indent=2).encode())
    sinks.save(f"{config.output}/config.toml", to_toml(config.to_dict()).encode())
    return out


if __name__ == "__main__":
    raise SystemExit(main())
