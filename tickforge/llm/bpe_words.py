"""Byte-level BPE by a global shuffle of distinct words, and decoding by the token-byte table.

Pre-tokens are exploded with their positions in blocks: a block lists its distinct words, and its
texts as positions in that list. Only the lists travel: words are dealt by hash, each distinct word
is encoded once, its ids go back to every block that lists it, and the blocks put their texts
together by position. What moves is a few bytes a word of a block, whatever its number of
occurrences, so that a frequent word is no hot key.

Decoding joins the token-byte table, which is broadcast up to MAX_TABLE bytes, so that neither ids nor tokens are
shuffled; with a larger one, the ids are exploded with their positions and joined by a shuffle.

A null text counts as an empty one and gives no ids. Rows with equal or null doc_id stay rows of
their own. An empty table gives an empty result. Other columns are ignored.
"""

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cached, lean, texts_of, tune, written

#: Bytes of text of a block at most, unless one text is longer.
BLOCK_BYTES = 32 << 20
#: Bytes of a token table that is broadcast at most.
MAX_TABLE = 16 << 20
PACKS = "kind int, block long, bucket int, payload binary, doc_ids array<long>, counts array<long>"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    return cached(("tiktoken", path, pattern), lambda: tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={}))


def _bytes_of(x: np.ndarray) -> bytes:
    """32-bit integers: how many, those below 255 as a byte each, the planes of the others' bytes behind them."""
    x = x.astype("<u4")
    small = np.minimum(x, 255).astype(np.uint8)
    large = np.ascontiguousarray(x[x >= 255].view(np.uint8).reshape(-1, 4).T)
    return np.uint32(len(x)).tobytes() + small.tobytes() + large.tobytes()


def _ints_of(data: bytes) -> tuple[np.ndarray, int]:
    """The integers, and where their bytes end."""
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    out = np.frombuffer(data, np.uint8, n, 4).astype(np.uint32)
    large = np.flatnonzero(out == 255)
    planes = np.frombuffer(data, np.uint8, 4 * len(large), 4 + n).reshape(4, -1)
    out[large] = np.ascontiguousarray(planes.T).view("<u4").ravel()
    return out, 4 + n + 4 * len(large)


def pack_ints(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=6).compress(_bytes_of(x))


def unpack_ints(data: bytes) -> np.ndarray:
    return _ints_of(zstandard.ZstdDecompressor().decompress(data))[0]


def renumbered(uses: np.ndarray) -> tuple[np.ndarray, int]:
    """New numbers of words by how often each is used: those used again by falling use, then those used once in
    their order; and the number of the first of the latter."""
    again = np.flatnonzero(uses > 1)
    order = np.concatenate((again[np.argsort(-uses[again], kind="stable")], np.flatnonzero(uses <= 1)))
    out = np.empty(len(uses), np.int64)
    out[order] = np.arange(len(uses))
    return out, len(again)


def pack_places(numbers: np.ndarray, once: int, next_: int) -> bytes:
    """Word numbers; words used once come in the order of their numbers, from `next_` on, and are stored as 0."""
    return pack_ints(np.concatenate(([next_], np.where(numbers >= once, 0, numbers + 1))))


def unpack_places(data: bytes) -> np.ndarray:
    x = unpack_ints(data).astype(np.int64)
    return np.where(x[1:] == 0, x[0] + np.cumsum(x[1:] == 0) - 1, x[1:] - 1)


def pack_words(words: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=9).compress(_bytes_of(np.fromiter(map(len, words), np.uint32, len(words))) + b"".join(words))


def unpack_words(data: bytes) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(data)
    sizes, at = _ints_of(data)
    ends = at + np.cumsum(sizes, dtype=np.int64)
    return [data[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]


def _explode(pattern: str, id_col: str, text_col: str, buckets: int):
    columns = ["kind", "block", "bucket", "payload", "doc_ids", "counts"]
    schema = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])

    def row(*values) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(columns, values, strict=True))], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        block, held, local, texts_held = TaskContext.get().partitionId() << 32, 0, {}, []

        def ended() -> Iterator[pa.RecordBatch]:
            """The block's texts by word numbers, its words dealt to buckets, and the bucket of each word."""
            uses = np.zeros(len(local), np.int64)
            for numbers, _, _ in texts_held:
                uses += np.bincount(numbers, minlength=len(local))
            new, once = renumbered(uses)
            next_ = once
            for numbers, ids, counts in texts_held:
                numbers = new[numbers]
                yield row(0, block, None, pack_places(numbers, once, next_), ids, counts)
                next_ += int((numbers >= once).sum())
            texts_held.clear()
            words: list = [b""] * len(local)
            for w, k in zip(local, new.tolist(), strict=True):
                words[k] = w.encode()
            local.clear()
            dealt: list[list[bytes]] = [[] for _ in range(buckets)]
            order = np.empty(len(words), np.uint32)
            for k, w in enumerate(words):
                order[k] = to = xxhash.xxh3_64_intdigest(w) % buckets
                dealt[to].append(w)
            yield row(2, block, None, pack_ints(order), None, None)
            for to, part in enumerate(dealt):
                if part:
                    yield row(1, block, to, pack_words(part), None, None)

        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(id_col)).to_pylist()
            texts = texts_of(batch.column(batch.schema.get_field_index(text_col)))
            at = 0
            while at < len(texts):
                put, stream, counts, first = local.setdefault, [], [], at
                while at < len(texts) and (held < BLOCK_BYTES or not held):
                    found = find(texts[at])
                    stream += [put(w, len(local)) for w in found]
                    counts.append(len(found))
                    held += len(texts[at]) + 1
                    at += 1
                texts_held.append((np.array(stream, np.int32), ids[first:at], counts))
                if held >= BLOCK_BYTES:
                    yield from ended()
                    block, held = block + 1, 0
        if texts_held:
            yield from ended()

    return run


def _encode_buckets(path: str, pattern: str):
    """Word lists, those of one bucket together, into lists of ids; a word is encoded once in a bucket."""
    schema = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known, now = encoding(path, pattern).encode_ordinary, {}, None
        for batch in batches:
            payloads = []
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if bucket != now:
                    known, now = {}, bucket
                words = unpack_words(data.as_py())
                for w in words:
                    if w not in known:
                        known[w] = array("I", encode(w.decode())).tobytes()
                ids = [known[w] for w in words]
                sizes = np.fromiter(map(len, ids), np.uint32, len(ids)) >> np.uint32(2)
                payloads.append(pack_ints(np.concatenate((np.array([len(ids)], np.uint32), sizes, np.frombuffer(b"".join(ids), "<u4")))))
            yield pa.RecordBatch.from_arrays([pa.array([1] * len(payloads), pa.int32()), batch.column(1), batch.column(0), pa.array(payloads, pa.binary())], schema=schema)

    return run


class _Block:
    """Ids of a block's words by number. `order` has the bucket of each word; the words of one bucket keep the
    order of their numbers, so a stable sort by bucket tells where each word's ids are."""

    def __init__(self, order: np.ndarray, parts: dict[int, np.ndarray]):
        names = sorted(parts)
        sizes = np.concatenate([parts[k][1 : 1 + parts[k][0]] for k in names] or [np.zeros(0, np.uint32)])
        self.flat = np.concatenate([parts[k][1 + parts[k][0] :] for k in names] or [np.zeros(0, np.uint32)])
        place = np.empty(len(order), np.int32)
        place[np.argsort(order, kind="stable")] = np.arange(len(order), dtype=np.int32)
        self.size = sizes[place].astype(np.int32)
        self.begin = (np.cumsum(sizes, dtype=np.int64) - sizes)[place].astype(np.int32)

    def ids(self, numbers: np.ndarray) -> bytes:
        if not len(numbers):
            return b""
        size = self.size[numbers]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.begin[numbers] - ends + size, size) + np.arange(ends[-1])].tobytes()


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts by position, block by block; a block's bucket list and ids come before its texts."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("token_ids", pa.list_(pa.int32()))])
    now, order, parts, block = None, np.zeros(0, np.uint32), {}, None
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}
            if row["block"] != now:
                now, order, parts, block = row["block"], np.zeros(0, np.uint32), {}, None
            if row["kind"] == 2:
                order = unpack_ints(row["payload"])
            elif row["kind"] == 1:
                parts[row["bucket"]] = unpack_ints(row["payload"])
            else:
                if block is None:
                    block, parts = _Block(order, parts), {}
                numbers, at, out = unpack_places(row["payload"]), 0, []
                for n in row["counts"]:
                    out.append(block.ids(numbers[at : at + n]))
                    at += n
                ends = np.cumsum([0, *(len(x) // 4 for x in out)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(out), "<i4")))
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(out, pa.binary()), lists], schema=schema)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, token_ids): ids as little-endian unsigned 32-bit integers and as an array, as the BPE of
    `ranks_path` gives them for each match of `pattern`."""
    tune(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # in proportion to the input, so that a bucket's words stay as many at any size
    buckets = max(16, 2 * (1 + (docs.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0] or 0)))
    packs = written(docs.mapInArrow(lean(_explode(pattern, "doc_id", "text", buckets)), PACKS), "pretokens")
    words = packs.where("kind = 1").select("bucket", "block", "payload").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    coded = words.mapInArrow(lean(_encode_buckets(ranks_path, pattern)), "kind int, block long, bucket int, payload binary")
    back = packs.where("kind <> 1").unionByName(coded, allowMissingColumns=True)
    ordered = back.repartition(buckets, "block").sortWithinPartitions("block", F.col("kind").desc())
    return ordered.mapInArrow(lean(_assemble), "doc_id long, ids binary, token_ids array<int>")


def token_table(spark: SparkSession, ranks_path: str) -> tuple[DataFrame, int]:
    """(id, token) of a vocabulary, and its size in bytes."""
    ranks = read_ranks(ranks_path)
    rows = pa.table({"id": pa.array(ranks.values(), pa.int32()), "token": pa.array(ranks.keys(), pa.binary())})
    return spark.createDataFrame(rows), rows.nbytes


def decode(coded: DataFrame, ranks_path: str, ids_col: str = "token_ids") -> DataFrame:
    """Adds `decoded`, the bytes of the ids (an array), by a join with the token-byte table; an id that isn't in it
    is an error. Null ids give null bytes.

    Up to MAX_TABLE bytes the table is broadcast as one row, the array of its tokens by id, so that a document's ids
    are looked up where they are. A larger one is joined with the exploded ids, put together again by position."""
    spark, columns = coded.sparkSession, [c for c in coded.columns if c != "decoded"]
    table, size = token_table(spark, ranks_path)
    # bytes travel as a string, which neither join nor cast looks into
    text = F.col("token").cast("string")
    unknown = F.raise_error(F.lit("an id is not in the vocabulary")).cast("string")
    names = {c: f"c{k}" for k, c in enumerate(columns)}
    given, ids = coded.select(*(F.col(c).alias(n) for c, n in names.items())), names[ids_col]
    if size <= MAX_TABLE:
        last = table.agg(F.max("id")).first()[0]
        every = spark.range(last + 1).select(F.col("id").cast("int").alias("i")).join(table, F.col("i") == F.col("id"), "left")
        row = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", text.alias("t")))), lambda x: x["t"]).alias("tokens")).withColumn("one", F.lit(0))
        row = written(row, "tokens")
        joined = given.withColumn("one", F.pmod(F.size(ids), F.lit(1))).join(F.broadcast(row), "one", "left")
        token = lambda i: F.coalesce(F.when((i >= 0) & (i <= last), F.col("tokens")[i]), unknown)
        out = joined.withColumn("decoded", F.array_join(F.transform(ids, token), "").cast("binary"))
    else:
        rows = written(given.withColumn("row", F.monotonically_increasing_id()), "coded")
        each = rows.select("row", F.posexplode(ids).alias("at", "id")).join(table, "id", "left").select("row", "at", F.coalesce(text, unknown).alias("t"))
        whole = each.groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "t"))), lambda x: x["t"]), "").cast("binary").alias("b"))
        out = rows.join(whole, "row", "left").withColumn("decoded", F.when(F.col(ids).isNotNull(), F.coalesce("b", F.lit(b""))))
    return out.select(*(F.col(n).alias(c) for c, n in names.items()), "decoded")
