"""What a run over messages gives, with the ways to look at it."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.config import Dataset, Labels
from tickforge.functions.frames import DAY
from tickforge.functions.tables import materialized
from tickforge.operators import tensors
from tickforge.plans import dataset


@dataclass
class Output:
    """Samples of a run, written once."""

    samples: DataFrame
    config: Dataset
    keys: tuple[str, ...] = DAY

    @classmethod
    def of(cls, messages: DataFrame, config: Dataset, keys: tuple[str, ...] = DAY) -> "Output":
        return cls(materialized(dataset.samples(messages, config, keys=keys), "samples"), config, keys)

    @property
    def feature_count(self) -> int:
        return self.config.features.count()

    @property
    def lob_levels(self) -> int | None:
        """The levels of a row that has nothing but levels; None for others."""
        f = self.config.features
        return f.levels if self.feature_count == 4 * f.levels else None

    def sequences(self) -> DataFrame:
        """(keys, seq_id, features, label_<h>...), normalised and aligned."""
        return dataset.aligned(self.samples, self.config, self.keys)

    def format_as(self, layout: str) -> DataFrame:
        """The sequences in a tensor layout."""
        levels = self.config.features.levels
        size = tensors.image_size(self.feature_count, levels)
        return self.sequences().withColumn("features", tensors.reshape(F.col("features"), layout, levels, *size))

    def multi_horizon_labels(self, labels: Labels | None = None) -> DataFrame:
        """(keys, t, label_<h>...) of the samples that every horizon labels."""
        c = Dataset.from_dict(self.config.to_dict())
        c.labels = labels or c.labels
        return dataset.label_rows(self.samples, c, self.keys)
