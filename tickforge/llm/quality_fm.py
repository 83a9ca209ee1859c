"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

    y = w0 + sum_j w_j x_j + 1/2 sum_f [ (sum_j v_jf x_j)^2 - sum_j v_jf^2 x_j^2 ]

so pairwise interactions of all features cost a sum over the features. Words are lower-cased in A-Z, hashed to
2^BUCKET_BITS buckets, counted and scaled to unit length; statistics are standardised by the training rows.
The model is fitted by Adam, with updates of the features of a batch only, on at most `max_train` labelled
documents, chosen by a hash of doc_id, one text each; its size is fixed by BUCKET_BITS and FACTORS, whatever the corpus.

Null or empty texts are scored from their statistics. A null n_chars counts as missing. Labels that are null
are left out, several of a document count as their mean; without labels of both kinds the score is their mean, or
0.5. Of rows that repeat a doc_id, the fit takes the text with the lowest hash; scores are for each row. An empty table gives an empty result. Other columns are kept by `classify`; one named `score`
is replaced.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import wordhash
from .shared import by_bytes, lean, tune

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
FACTORS = 8
EPOCHS, BATCH, RATE, DECAY = 8, 128, 0.02, 1e-5
#: Labelled rows used for training at most.
MAX_TRAIN = 8000
SLICE_BYTES = 1 << 20

_CLASSES = {
    "upper": [*range(65, 91)],
    "lower": [*range(97, 123)],
    "digit": [*range(48, 58)],
    "symbol": [ord(c) for c in "#*$%&|<>"],
    "mark": [ord(c) for c in "!?"],
    "stop": [ord(c) for c in ".,;:"],
    "other": [ord(c) for c in "\"'()+-/=@[\\]^_`{}~"],
    "line": [10],
    "high": [*range(128, 256)],
}
CLASS = np.zeros((len(_CLASSES), 256), bool)
for _k, _v in enumerate(_CLASSES.values()):
    CLASS[_k, _v] = True
STATISTICS = len(_CLASSES) + 7


def features(column: pa.Array, n_chars: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets and values of all texts, where each text's begin (one more for the end), and statistics."""
    data, at = wordhash.utf8(column)
    starts, ends, first = wordhash.words(data, at)
    h = wordhash.hashes(data, starts, ends, lower=True)
    bucket = (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    size, n = np.maximum(np.diff(at), 1), np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    key, count = np.unique(doc * BUCKETS + bucket, return_counts=True)
    owner = key >> BUCKET_BITS
    value = count / np.sqrt(np.bincount(owner, count.astype(float) ** 2, len(n)))[owner]
    begin = np.searchsorted(owner, np.arange(len(n) + 1))
    share = [np.diff(np.concatenate(([0], np.cumsum(CLASS[k][data])))[at]) / size for k in range(len(CLASS))]
    length = np.bincount(doc, ends - starts, len(n))
    bare = np.bincount(doc, ~(CLASS[0] | CLASS[1] | CLASS[8])[data[ends - 1]] if len(ends) else None, len(n))
    pairs, pair_at = wordhash.ngrams(h, first, 3)
    same = np.array([1 - len(np.unique(pairs[a:b])) / max(b - a, 1) for a, b in zip(pair_at[:-1], pair_at[1:], strict=True)])
    chars = n_chars.to_numpy(zero_copy_only=False).astype(float)
    known = ~np.isnan(chars)
    words = np.maximum(n, 1)
    rest = [np.log1p(n), length / words, bare / words, np.diff(begin) / words, same, np.log1p(np.where(known, np.maximum(chars, 0), 0)), known]
    return key & (BUCKETS - 1), value, begin, np.stack([*share, *rest], axis=1).astype(np.float64)


class Machine:
    """A fitted model; linear weights and factors of words come before those of statistics."""

    def __init__(self, bias: float, weights: np.ndarray, factors: np.ndarray, mean: np.ndarray, scale: np.ndarray):
        self.bias, self.weights, self.factors, self.mean, self.scale = bias, weights, factors, mean, scale

    def standard(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -4, 4)

    def raw(self, j: np.ndarray, x: np.ndarray, begin: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """y, and the factor sums of each row. z: standardised statistics."""
        n = len(begin) - 1
        owner = np.repeat(np.arange(n), np.diff(begin))
        v = self.factors[j] * x[:, None]
        vz = self.factors[BUCKETS:]
        sums = np.stack([np.bincount(owner, v[:, f], n) for f in range(FACTORS)], axis=1) + z @ vz
        squares = np.bincount(owner, (v * v).sum(axis=1), n) + (z * z) @ (vz * vz).sum(axis=1)
        linear = np.bincount(owner, self.weights[j] * x, n) + z @ self.weights[BUCKETS:]
        return self.bias + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), sums

    def scores(self, column: pa.Array, n_chars: pa.Array) -> np.ndarray:
        j, x, begin, stats = features(column, n_chars)
        return 1 / (1 + np.exp(-np.clip(self.raw(j, x, begin, self.standard(stats))[0], -30, 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], stats: np.ndarray, y: np.ndarray, seed: int = 1) -> Machine:
    """Fit on rows of (buckets, values), their statistics and labels 0 or 1."""
    rng = np.random.default_rng(seed)
    width = BUCKETS + STATISTICS
    mean = stats.mean(axis=0) if len(y) else np.zeros(STATISTICS)
    scale = np.maximum(stats.std(axis=0), 1e-3) if len(y) else np.ones(STATISTICS)
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    model = Machine(float(np.log(rate / (1 - rate))), np.zeros(width), np.zeros((width, FACTORS)), mean, scale)
    if not len(y) or len(np.unique(y)) < 2:
        return model
    model.factors = rng.normal(0, 0.02, (width, FACTORS))
    z_all = model.standard(stats)
    both = np.concatenate([model.weights[:, None], model.factors], axis=1)
    first, second, bias_m, bias_v, step = np.zeros_like(both), np.zeros_like(both), 0.0, 0.0, 0
    fixed = np.arange(BUCKETS, width)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for i in range(0, len(y), BATCH):
            pick, step = order[i : i + BATCH], step + 1
            j = np.concatenate([rows[k][0] for k in pick])
            x = np.concatenate([rows[k][1] for k in pick])
            begin = np.cumsum([0, *(len(rows[k][0]) for k in pick)])
            z = z_all[pick]
            model.weights, model.factors = both[:, 0], both[:, 1:]
            out, sums = model.raw(j, x, begin, z)
            error = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[pick]) / len(pick)
            owner = np.repeat(np.arange(len(pick)), np.diff(begin))
            ex = error[owner] * x
            used, place = np.unique(j, return_inverse=True)
            own = ex[:, None] * sums[owner] - (ex * x)[:, None] * model.factors[j]
            words = [np.bincount(place, v, len(used)) for v in (ex, *own.T)]
            stats_v = (error[:, None] * z).T @ sums - ((error[:, None] * z * z).sum(axis=0))[:, None] * model.factors[BUCKETS:]
            at = np.concatenate((used, fixed))
            grad = DECAY * both[at] + np.concatenate((np.stack(words, axis=1), np.concatenate(((error @ z)[:, None], stats_v), axis=1)))
            first[at] = 0.9 * first[at] + 0.1 * grad
            second[at] = 0.99 * second[at] + 0.01 * grad * grad
            both[at] -= RATE * (first[at] / (1 - 0.9**step)) / (np.sqrt(second[at] / (1 - 0.99**step)) + 1e-6)
            g = float(error.sum())
            bias_m, bias_v = 0.9 * bias_m + 0.1 * g, 0.99 * bias_v + 0.01 * g * g
            model.bias -= RATE * (bias_m / (1 - 0.9**step)) / (np.sqrt(bias_v / (1 - 0.99**step)) + 1e-6)
    model.weights, model.factors = both[:, 0].astype(np.float32), both[:, 1:].astype(np.float32)
    return model


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Machine:
    """A model from at most `max_train` labelled rows that aren't held out; only their features reach the driver."""
    tune(docs.sparkSession)
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    chosen = known.groupBy(F.col("doc_id").alias("label_id")).agg(F.avg(F.col("quality").cast("double")).alias("y"))
    chosen = chosen.orderBy(F.xxhash64("label_id"), "label_id").limit(max_train)
    sample = _plain(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    # one text of each label, so that an id that many rows repeat stays one row
    sample = sample.groupBy("label_id", "y").agg(F.min_by(F.struct("text", "n_chars"), F.xxhash64("text", "n_chars")).alias("x")).select("x.text", "x.n_chars", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", SLICE_BYTES):
            j, x, begin, stats = features(batch.column(0), batch.column(1))
            parts = [slice(a, b) for a, b in zip(begin[:-1], begin[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([j[p].astype("<i4").tobytes() for p in parts], pa.binary()), pa.array([x[p].astype("<f4").tobytes() for p in parts], pa.binary()), pa.array(list(stats), pa.list_(pa.float64())), batch.column(2)], names=["j", "x", "stats", "y"])

    got = sample.mapInArrow(lean(run), "j binary, x binary, stats array<double>, y double").toArrow()
    got = got.take(pc.sort_indices(got, [("y", "ascending"), ("j", "ascending"), ("x", "ascending")]))
    rows = [(np.frombuffer(j, "<i4").astype(np.int64), np.frombuffer(x, "<f4").astype(float)) for j, x in zip(got.column("j").to_pylist(), got.column("x").to_pylist(), strict=True)]
    stats = np.array(got.column("stats").to_pylist(), float).reshape(len(rows), STATISTICS)
    return train(rows, stats, (got.column("y").to_numpy() > 0.5).astype(float))


def _plain(docs: DataFrame) -> DataFrame:
    chars = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.select("doc_id", F.col("text"), chars.alias("n_chars"))


def classify(docs: DataFrame, model: Machine, into: str = "score") -> DataFrame:
    """The documents with `score`, or a column named otherwise, the probability of label 1."""
    tune(docs.sparkSession)
    columns = [c for c in docs.columns if c != into]
    n_chars = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    given = docs.select(*columns, F.col("text"), n_chars).toDF(*(f"c{k}" for k in range(len(columns))), "text", "n_chars")
    schema = T.StructType([*docs.select(*columns).schema.fields, T.StructField(into, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", SLICE_BYTES):
            score = model.scores(batch.column(len(columns)), batch.column(len(columns) + 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(columns))), pa.array(score)], names=[*columns, into])

    return given.mapInArrow(lean(run), schema)
