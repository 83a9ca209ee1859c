"""Near-duplicates: MinHash bands propose pairs, odd sketches screen them, full shingle sets confirm them.

1. Each document's set of distinct word shingles (64-bit hashes, words lower-cased in A-Z) gives 160 MinHash
   values, 32 band keys of 5 values each, and an odd sketch: every (i, value i) flips one of 512 bits, so the
   population count of two sketches' XOR estimates how many of the values differ.
2. Equal sets are merged first; only one document of each goes on.
3. In every bucket each member is held against one leader, the smallest doc_id. A pair within the size ratio
   and the sketch's bound is confirmed on full sets. Links give components.
4. Buckets that still hold more than one component are searched in blocks, bounded by members and by shingles, those
   outside the bucket's largest component against all: pairs of members of different components are screened by sketches, and full sets are brought only to the
   members with a pair that passes. Pairs are confirmed in memory, and only links that join two
   components come out, at most one less than a block pair's members. No pair of a bucket is left out, a pair is
   looked at in the first bucket that it shares, and pairs of one component, which can't change the result, are
   never looked at. Large buckets of one leader, mostly the same members, are searched once, as one group.

A set is known by its document's id and a signature, so rows that repeat a doc_id don't mix. Rows of a hot bucket,
leader or node of the graph are dealt to several tasks.

At a similarity of 0.8 a pair shares no band with probability (1 - 0.8^5)^32 = 3e-6, and its sketches differ in
more than MAX_ODD bits with less (5.8 standard deviations); both fall steeply above. Bands are set for
similarities of 0.8 or more.

Texts that are null or without words have an empty set and are linked with nothing. Rows with a null doc_id are
returned with a null component, kept. Rows that repeat a doc_id with another text have shingles of their own and count as one document for the links.
An empty table gives an empty result; other columns are ignored.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .components import components
from .shared import MAX_MEMBERS, bitmap_of, by_bytes, in_bitmap, lean, spread_join, tune, written

BANDS, ROWS, BITS = 32, 5, 512
VALUES = BANDS * ROWS
#: XOR bits of two sketches at most; 57 are expected at a similarity of 0.8, with a deviation of 9.5.
MAX_ODD = 112
#: Members of a bucket, minor ones of it, and shingles in a block, about.
BLOCK, MINOR_BLOCK, BLOCK_SHINGLES = 128, 256, 1 << 19
SLICE_BYTES = 1 << 20

_RANDOM = np.random.default_rng(77)
FACTORS = _RANDOM.integers(0, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _RANDOM.integers(0, 1 << 63, VALUES, dtype=np.uint64)


def shingle_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, at = wordhash.utf8(column)
    starts, ends, first = wordhash.words(data, at)
    grams, begin = wordhash.ngrams(wordhash.hashes(data, starts, ends, lower=True), first, n)
    return [np.unique(grams[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)]


def min_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """A row of MinHash values for each set; the sets aren't empty."""
    flat = np.concatenate(sets)
    begin = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((VALUES, len(sets)), np.uint64)
    for i in range(VALUES):
        out[i] = np.minimum.reduceat(flat * FACTORS[i] + SHIFTS[i], begin)
    return out.T


def band_keys(values: np.ndarray) -> np.ndarray:
    keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(values), 1))
    for r in range(ROWS):
        keys = wordhash.mix(keys * np.uint64(3) + values[:, r::ROWS])
    return keys


def odd_sketches(values: np.ndarray) -> np.ndarray:
    """BITS parities of each row, as 64-bit words."""
    place = wordhash.mix(values + np.arange(VALUES, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) & np.uint64(BITS - 1)
    flat = place.astype(np.int64) + BITS * np.arange(len(values))[:, None]
    odd = np.bincount(flat.ravel(), minlength=BITS * len(values)) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(values), BITS), axis=1).view(np.uint64)


def first_signature(s: np.ndarray) -> int:
    """Sum of a set's hashes; with the doc_id it names a set."""
    return int(s.sum().view(np.int64))


def similarity_of(odd_bits: int) -> float:
    """The similarity that `odd_bits` bits of the XOR of two sketches stand for."""
    return 1 - np.log(max(1 - 2 * odd_bits / BITS, 1e-9)) / np.log(1 - 2 / BITS) / (2 * VALUES)


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n, sig1, sig2, sketch, bands); the last four are null where a text has no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", SLICE_BYTES):
            sets = shingle_sets(batch.column(1), n)
            full = [i for i, s in enumerate(sets) if len(s)]
            rows: list = [None] * len(sets)
            some = [sets[i] for i in full]
            sig: list = [[None] * len(sets), [None] * len(sets)]
            sketch, bands = rows[:], rows[:]
            if some:
                values = min_hashes(some)
                for i, s, x, y in zip(full, some, odd_sketches(values).view(np.int64), band_keys(values).view(np.int64), strict=True):
                    sig[0][i], sig[1][i] = first_signature(s), int(wordhash.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum().view(np.int64))
                    sketch[i], bands[i] = x, y
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(x, pa.int64()) for x in sig), *(pa.array(x, pa.list_(pa.int64())) for x in (sketch, bands))],
                names=["doc_id", "n", "sig1", "sig2", "sketch", "bands"],
            )

    return docs.mapInArrow(lean(run), "doc_id long, n long, sig1 long, sig2 long, sketch array<long>, bands array<long>")


def _sets_of(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(id, sig, set) of the documents with a set whose doc_id is in `ids`, and of some others."""
    count = ids.count()
    if few := count <= MAX_MEMBERS:
        bitmap = bitmap_of(ids.select(F.xxhash64("id").alias("h")), "h", count)
    else:
        docs = docs.join(ids, F.col("doc_id") == F.col("id"), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", SLICE_BYTES):
            if few:
                batch = batch.filter(pa.array(in_bitmap(bitmap, batch.column(2).to_numpy())))
            sets = shingle_sets(batch.column(1), n) if batch.num_rows else []
            some = pa.array([i for i, s in enumerate(sets) if len(s)], pa.int64())
            if len(some):
                sets = [s for s in sets if len(s)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(some), pa.array([first_signature(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "sig", "set"])

    found = docs.where("doc_id IS NOT NULL").withColumn("h", F.xxhash64("doc_id")).mapInArrow(lean(run), "id long, sig long, set binary")
    return found.dropDuplicates(["id", "sig"])  # equal rows


def _named(df: DataFrame, k: str, **columns: str) -> DataFrame:
    return df.select(F.col("id").alias(k), F.col("sig").alias(f"sig_{k}"), *(F.col(c).alias(f"{n}_{k}") for n, c in columns.items()))


def confirmed(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    every = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    sets = written(_sets_of(docs, written(every, "ids"), n), "sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x)) if len(y) else 0
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_a = pairs.join(_named(sets, "a", set="set"), ["a", "sig_a"])
    with_b = _to_leaders(with_a, _named(sets, "b", set="set"), pairs)
    return with_b.select("a", "b", "set_a", "set_b").mapInArrow(lean(run), "a long, b long").distinct()


def _to_leaders(pairs: DataFrame, facts: DataFrame, plain: DataFrame) -> DataFrame:
    """Pairs with the facts of b; those of a leader of many are dealt to several tasks. `plain`: the same pairs."""
    sizes = plain.groupBy("b", "sig_b").agg(F.count(F.lit(1)).alias("rows"))
    return spread_join(pairs, facts, ["b", "sig_b"], plain.count(), "a", sizes=sizes)


def _screened(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs within the size ratio whose sketches are near enough."""
    odd = sum((F.bit_count(F.col("s_a")[i].bitwiseXOR(F.col("s_b")[i])) for i in range(BITS // 64)), F.lit(0))
    sizes = F.lit(100) * F.least("n_a", "n_b") >= F.lit(percent) * F.greatest("n_a", "n_b")
    both = _to_leaders(pairs.join(_named(reps, "a", n="n", s="sketch"), ["a", "sig_a"]), _named(reps, "b", n="n", s="sketch"), pairs)
    return both.where(sizes & (odd <= MAX_ODD)).select("a", "sig_a", "b", "sig_b")


def _blocks(members: DataFrame) -> DataFrame:
    """(h, of, m, major, rows, columns, copies) of the groups h of members (h, id, n, c) that hold several components.

    `of` is the leader. Pairs of two members of the largest component, `major`, needn't be looked at, so a group is
    searched in `rows` blocks of the others, its minor members, by `columns` blocks of all; `copies` rows travel."""
    parts = members.groupBy("h", "c").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("size"), F.min("id").alias("of"))
    groups = parts.groupBy("h").agg(F.max(F.struct("m", "c", "size")).alias("top"), F.sum("m").alias("m"), F.sum("size").alias("size"), F.min("of").alias("of"), F.count(F.lit(1)).alias("k")).where("k > 1")
    blocks = lambda m, size, n: F.greatest(F.ceil(m / n), F.ceil(size / BLOCK_SHINGLES)).cast("int")
    groups = groups.withColumn("minor", F.col("m") - F.col("top.m"))
    groups = groups.withColumn("rows", blocks(F.col("minor"), F.col("size") - F.col("top.size"), MINOR_BLOCK)).withColumn("columns", blocks(F.col("m"), F.col("size"), BLOCK))
    return groups.select("h", "of", "m", F.col("top.c").alias("major"), "rows", "columns", F.expr("minor * columns + m * rows").alias("copies"))


def _mixed(reps: DataFrame, labels: DataFrame, total: int) -> DataFrame:
    """(h, rows, columns, minor, id, sig, c, band) of the members of buckets that hold several components.

    The near copies of a text meet in most of its bands. So buckets of more than one block that have the same leader
    become one group, `h` the leader and `band` -1, where fewer rows travel for it than for the buckets one by one."""
    named = reps.join(labels.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("c", F.coalesce("component", "id"))
    keys = named.select("id", "sig", "n", "c", F.posexplode("bands").alias("band", "h"))
    buckets = written(_blocks(keys), "buckets")
    both = spread_join(keys, buckets.drop("m", "copies"), ["h"], total, "id", sizes=buckets.select("h", F.col("m").alias("rows")))
    members = written(both.withColumn("minor", F.col("c") != F.col("major")).drop("major"), "mixed-buckets")
    columns = ["h", "rows", "columns", "minor", "id", "sig", "c", "band"]
    large = F.expr("rows * columns > 1")
    apart = buckets.where(large).groupBy(F.col("of").alias("h")).agg(F.sum("copies").alias("apart"))
    if apart.isEmpty():
        return members.select(columns)

    once = written(members.where(large).select(F.col("of").alias("h"), "id", "sig", "n", "c").distinct(), "members-of-leaders")
    groups = written(_blocks(once).join(apart, "h").where("copies < apart"), "groups")
    whole = spread_join(once, groups.select("h", "rows", "columns", "major"), ["h"], once.count(), "id", sizes=groups.select("h", F.col("m").alias("rows")))
    whole = whole.withColumn("minor", F.col("c") != F.col("major")).withColumn("band", F.lit(-1))
    rest = spread_join(members.where(large), groups.select("of"), ["of"], members.count(), "id", "left_anti")
    return written(members.where(~large).select(columns).unionByName(rest.select(columns)).unionByName(whole.select(columns)), "mixed-groups")


def _pairs_of(table: pa.Table, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of a block of minor members by one of all: each member i of the former, and those of the latter that pass the
    size ratio and the sketch's bound, share no earlier band with it, and are of another component. The components
    are `c` of the moment, so what the caller unites while it iterates isn't looked at again."""
    band, ids, c, size = (table.column(i).to_numpy() for i in ("band", "id", "c", "n"))
    row, minor = (table.column(i).to_numpy(zero_copy_only=False) for i in ("row", "minor"))
    sketch, bands = (np.array(table.column(i).to_pylist(), np.int64).view(np.uint64) for i in ("sketch", "bands"))
    earlier = bands[:, : max(band[0], 0)]  # none for a leader's group: its buckets aren't searched themselves
    two = np.flatnonzero(~row)
    c = c.copy()
    for i in np.flatnonzero(row):
        near = two[(c[two] != c[i]) & (~minor[two] | (ids[two] > ids[i]))]
        near = near[100 * np.minimum(size[near], size[i]) >= percent * np.maximum(size[near], size[i])]
        near = near[np.bitwise_count(sketch[near] ^ sketch[i]).sum(axis=1, dtype=np.int64) <= MAX_ODD]
        near = near[~(earlier[near] == earlier[i]).any(axis=1)]
        if len(near):
            for j in (yield i, near, c):
                c[c == max(c[i], c[j])] = min(c[i], c[j])


def _between(members: DataFrame, reps: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) that join the components of buckets' members, by blocks of a bucket or of a leader's group.

    Sketches alone travel first; full sets go only to the blocks where a member has a pair that passes the screen."""
    place = ["band", "h", "x", "y"]
    cell = lambda n: F.pmod(F.xxhash64("id", "sig"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    kept = ("h", "band", "id", "sig", "c", "minor")
    across = members.where("minor").select(*kept, F.lit(True).alias("row"), cell("rows").alias("x"), every("columns").alias("y"))
    down = members.select(*kept, F.lit(False).alias("row"), every("rows").alias("x"), cell("columns").alias("y"))
    facts = reps.select("id", "sig", "n", "sketch", "bands")
    schema = "h long, band int, x int, y int, row boolean, minor boolean, id long, sig long, c long, n long, sketch array<long>, bands array<long>"
    columns = [c.split()[0] for c in schema.split(", ")]

    def screen(table: pa.Table) -> pa.Table:
        hit = np.zeros(len(table), bool)
        for i, near, _ in _steps(_pairs_of(table, percent)):
            hit[i] = hit[near] = True
        return table.filter(pa.array(hit)).select(columns)

    near = written(across.unionByName(down).join(facts, ["id", "sig"]).select(*columns).groupBy(*place).applyInArrow(screen, schema), "screened-members")
    ids = written(near.select("id").distinct(), "ids")
    with_sets = near.join(_sets_of(docs, ids, n), ["id", "sig"])

    def run(table: pa.Table) -> pa.Table:
        ids, size = table.column("id").to_numpy(), table.column("n").to_numpy()
        held = [np.frombuffer(v.as_buffer(), np.uint64) for v in table.column("set")]
        flat, begin = np.concatenate(held), np.cumsum(size) - size
        links, steps, joined = [], _pairs_of(table, percent), None
        while True:
            try:
                i, near, c = steps.send(joined)
            except StopIteration:
                break
            joined, root = [], {int(c[i])}
            for at in range(0, len(near), 64):  # full sets, a few at a time
                part = near[at : at + 64]
                first = np.cumsum(size[part]) - size[part]
                there = flat[np.repeat(begin[part] - first, size[part]) + np.arange(size[part].sum())]
                own_set = held[i]
                found = own_set[np.minimum(np.searchsorted(own_set, there), len(own_set) - 1)] == there
                both = np.add.reduceat(found, first, dtype=np.int64)
                for j in part[100 * both >= percent * (size[part] + size[i] - both)]:
                    if int(c[j]) not in root:
                        root.add(int(c[j]))
                        joined.append(j)
                        links.append((max(ids[i], ids[j]), min(ids[i], ids[j])))
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return with_sets.groupBy(*place).applyInArrow(run, "a long, b long").where("a <> b").distinct()


def _steps(pairs: Iterator) -> Iterator:
    """The pairs of a generator that nothing is sent to."""
    joined = None
    while True:
        try:
            yield pairs.send(joined)
        except StopIteration:
            return
        joined = []


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The components after more links between documents."""
    total = links.count()
    for k in ("a", "b"):
        found = labels.select(F.col("node").alias(k), F.col("component").alias(f"c_{k}"))
        links = spread_join(links, found, [k], total, "b" if k == "a" else "a", "left").withColumn(f"c_{k}", F.coalesce(f"c_{k}", k))
        links = written(links, "links-between")
    again = components(links, "c_a", "c_b").select(F.col("node").alias("component"), F.col("component").alias("c"))
    every = labels.unionByName(again.select(F.col("component").alias("node"), "component")).distinct()
    every = spread_join(every, again, ["component"], every.count(), "node", "left").select("node", F.coalesce("c", "component").alias("component"))
    # a component's own name may stand both alone and inside the component that it joined
    return written(every.groupBy("node").agg(F.min("component").alias("component")), "joined")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): component_id is the smallest doc_id reachable by links, and
    `kept` tells the document that has it."""
    tune(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    all_ = written(signatures(docs, n), "signatures")
    some = all_.where("doc_id IS NOT NULL AND sig1 IS NOT NULL")
    reps = some.groupBy("sig1", "sig2", "n").agg(F.min("doc_id").alias("id"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    reps = written(reps.withColumn("sig", F.col("sig1")), "representatives")

    keys = reps.select(F.col("id").alias("a"), F.col("sig").alias("sig_a"), F.explode("bands").alias("h"))
    total = BANDS * reps.count()
    leaders = keys.groupBy("h").agg(F.min(F.struct("a", "sig_a")).alias("l"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    leaders = written(leaders.select("h", F.col("l.a").alias("b"), F.col("l.sig_a").alias("sig_b"), "rows"), "leaders")
    pairs = spread_join(keys, leaders.drop("rows"), ["h"], total, "a", sizes=leaders).where("a <> b").select("a", "sig_a", "b", "sig_b").distinct()
    pairs = written(_screened(written(pairs, "proposed"), reps, percent), "pairs")
    labels = components(confirmed(pairs, docs, n, percent))

    mixed = _mixed(reps, labels, total)
    if not mixed.isEmpty():
        labels = _joined(labels, written(_between(mixed, reps, docs, n, percent), "links"))
    groups = reps.join(labels.withColumnRenamed("node", "id"), "id", "left").select("sig1", "sig2", "n", F.coalesce("component", "id").alias("component_id"))
    out = all_.select("doc_id", "n", "sig1", "sig2").join(groups, ["sig1", "sig2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
