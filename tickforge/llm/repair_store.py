"""Token ids in shards compressed by a Re-Pair grammar.

Documents are put in ascending doc_id order by range, cut into shards of about SHARD_TOKENS ids, and each
shard gets a grammar of its own: frequent neighbouring pairs are replaced by nonterminals, round after round,
until no pair stands MIN_COUNT times. Pairs never cross the end of a document. A round replaces all pairs that
are the most frequent of their neighbourhood at once, which is Re-Pair's greedy order up to ties and counts
updated once a round. The first rounds count pairs in hashed bins; where a round shortens the shard by less
than EXACT_GAIN, the later ones count exactly, and only the pairs that may still be frequent.

File format: Parquet rows (part, shard, n_tokens, doc_ids, payload). A payload is little-endian:
    "RPG1" | u32 documents, rules, symbols, first nonterminal
    u32 left[rules], right[rules], expansion length[rules]
    u32 symbol offset[documents + 1], u32 id count[documents]
    u8 plane[3][symbols]
Expansion lengths let a reader find position i of a document without expanding what stands before it.

Null texts count as empty: the end id only. Equal doc_ids are ordered by a hash of their text, and so dealt to
several tasks; null ones come first. An empty table gives no shards and an empty result. Other columns are ignored.
"""

import json
import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cached, lean, texts_of, tune, work_dir

SHARD_TOKENS = 1 << 20
#: A rule takes 12 bytes and a replacement saves 3.
MIN_COUNT = 6
#: A round that shortens the shard by less than this part is the last one that counts in bins.
EXACT_GAIN = 0.06
BINS = 18
#: Distinct pieces and pre-tokens whose ids a worker remembers, of each.
MAX_KNOWN = 1_500_000
#: Rows of a batch of read documents, and shards whose places are broadcast at most.
PACK_ROWS, MAX_BROADCAST = 512, 100_000
SHARDS = "part int, shard int, n_tokens long, doc_ids array<long>, payload binary"


class Characters(dict):
    """For str.translate: the printable characters that stand for each character's bytes in a byte-level vocabulary."""

    def __init__(self):
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.bytes = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}

    def __missing__(self, code: int) -> str:
        self[code] = out = "".join(self.bytes[b] for b in chr(code).encode())
        return out


class Known(dict):
    """Ids of pieces, as bytes, worked out when first asked for."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key: str) -> bytes | None:
        if len(self) >= MAX_KNOWN:
            self.clear()
        self[key] = out = self.make(key)
        return out


class PieceEncoder:
    """Ids of whole texts by the tokenizers library, for each distinct space-separated piece once.

    The byte-level split always begins a pre-token at a space between two characters that aren't white space,
    so the pieces of such a text can be split apart, and the library's BPE model works on single pre-tokens.
    A text with a piece that is empty or has white space at an end, or that may hold an added token, goes
    through the library whole, as do all texts where the file asks for other steps than these.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.added = [x.content for x in self.whole.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            steps = json.load(f)
        split = steps.get("pre_tokenizer") or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
        self.apart = plain and not steps.get("normalizer") and steps["model"].get("type") == "BPE" and not steps["model"].get("ignore_merges")
        self.find = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        self.characters = Characters()
        self.tokenize, self.space = self.whole.model.tokenize, self.characters[32]
        self.token, self.piece = Known(lambda w: self._ids(w.translate(self.characters))), Known(self._piece)

    def _ids(self, characters: str) -> bytes:
        return array("I", [t.id for t in self.tokenize(characters)]).tobytes()

    def _piece(self, p: str) -> bytes | None:
        """The ids of a space and a piece; None where the piece can't be taken apart from its neighbours."""
        if p.isalpha():
            return self._ids(self.space + (p if p.isascii() else p.translate(self.characters)))
        if p[:-1].isalpha() and p[-1] in ".,;:!?":
            return self.piece[p[:-1]] + self.token[p[-1]]
        if not p or p[0].isspace() or p[-1].isspace():
            return None
        left, line, right = p.partition("\n")
        if line and left and right and not left[-1].isspace() and not right[0].isspace():
            return self.piece[left] + self.token["\n"] + self._head(right)
        return b"".join(map(self.token.__getitem__, self.find(" " + p)))

    def _head(self, p: str) -> bytes | None:
        """The ids of a piece that no space stands before: a text's first, or one behind a line break."""
        return None if not p or p[0].isspace() or p[-1].isspace() else b"".join(map(self.token.__getitem__, self.find(p)))

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        out: list = [b""] * len(texts)
        rest = []
        for i, t in enumerate(texts):
            if t and self.apart and not any(a in t for a in self.added):
                pieces = t.split(" ")
                parts = [self._head(pieces[0]), *map(self.piece.__getitem__, pieces[1:])]
                try:
                    out[i] = b"".join(parts)
                    continue
                except TypeError:  # a None among them
                    pass
            if t:
                rest.append(i)
        if rest:
            for i, e in zip(rest, self.whole.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, "<u4").tobytes()
        return out


def binned(s: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin of the pair at each position, and how many pairs each bin has."""
    at = ((s[:-1] * np.uint32(0x9E3779B1) ^ s[1:] * np.uint32(0x85EBCA77)) * np.uint32(0xC2B2AE3D) >> np.uint32(32 - BINS)).astype(np.int64)
    count = np.bincount(at, minlength=1 << BINS)
    count -= np.bincount(at[last[:-1]], minlength=1 << BINS)
    return at, count


def round_by_bins(s: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions whose pairs to replace, the number of each one's pair, and the pairs; of a bin one pair at most."""
    at, count = binned(s, last)
    rank = (np.minimum(count, (1 << 32 - BINS) - 1) << BINS | np.arange(1 << BINS)).astype(np.uint32)[at]
    rank[last[:-1]] = 0
    pick = rank >= np.uint32(MIN_COUNT << BINS)
    pick[1:] &= rank[1:] > rank[:-1]
    pick[:-1] &= rank[:-1] >= rank[1:]
    i = np.flatnonzero(pick)
    bin_, key = at[i], s[i].astype(np.uint64) << np.uint64(32) | s[i + 1]
    one = np.zeros(1 << BINS, np.uint64)
    one[bin_] = key
    same = one[bin_] == key  # the others of a bin wait for a later round
    i, bin_ = i[same], bin_[same]
    often = np.flatnonzero(np.bincount(bin_, minlength=1 << BINS) >= MIN_COUNT)
    name = np.zeros(1 << BINS, np.int64)
    name[often] = 1 + np.arange(len(often))
    named = name[bin_]
    return i[named > 0], named[named > 0] - 1, one[often]


def round_exactly(s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As round_by_bins, from the pairs at the positions `at` only; and those positions whose pairs are frequent.

    A pair counts as often as it can be replaced. The most frequent one is replaced everywhere, so a round
    without a rule means that no pair at these positions is frequent."""
    pairs, pair = np.unique(s[at].astype(np.uint64) << np.uint64(32) | s[at + 1], return_inverse=True)
    run = np.zeros(len(at), bool)  # a symbol three times in a row: the pair overlaps the one before
    run[1:] = (at[1:] == at[:-1] + 1) & (pair[1:] == pair[:-1])
    free = ~run
    if run.any():
        index = np.arange(len(at))
        free = (index - np.maximum.accumulate(np.where(run, 0, index))) % 2 == 0
    count = np.bincount(pair[free], minlength=len(pairs))
    rank = np.empty(len(pairs), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(pairs))
    frequent = count[pair] >= MIN_COUNT
    at, pair, free = at[frequent], pair[frequent], free[frequent]
    r, pick = rank[pair], free.copy()
    beside = at[1:] == at[:-1] + 1
    pick[1:] &= ~beside | (r[1:] >= r[:-1])
    pick[:-1] &= ~beside | (r[:-1] >= r[1:])
    i, pair = at[pick], pair[pick]
    often = np.bincount(pair, minlength=len(pairs)) >= MIN_COUNT
    i, pair = i[often[pair]], pair[often[pair]]
    return i, (np.cumsum(often) - 1)[pair], pairs[often], at


def compress(docs: list[np.ndarray]) -> bytes:
    """The payload of a shard."""
    sizes = np.array([len(x) for x in docs], np.int64)
    s = np.concatenate(docs).astype(np.uint32) if len(docs) else np.zeros(0, np.uint32)
    last = np.zeros(len(s), bool)
    last[np.cumsum(sizes)[sizes > 0] - 1] = True
    first = int(s.max()) + 1 if len(s) else 0
    rules_left, rules_right, rules = [], [], 0
    open_ = None  # from the first exact round on: whether the pair at a position may be frequent
    while len(s) >= 2 * MIN_COUNT:
        if open_ is None:
            i, named, pairs = round_by_bins(s, last)
            exact = len(i) < EXACT_GAIN * len(s)
        else:
            i, named, pairs, at = round_exactly(s, np.flatnonzero(open_ & ~last))
            if not len(i):
                break
            # Counts of known pairs only fall, and new ones hold a new symbol.
            open_[:] = False
            open_[at] = open_[i] = True
            open_[i[i > 0] - 1] = True
        rules_left.append((pairs >> np.uint64(32)).astype(np.uint32))
        rules_right.append(pairs.astype(np.uint32))
        s[i] = (first + rules + named).astype(np.uint32)
        rules += len(pairs)
        last[i] = last[i + 1]
        keep = np.ones(len(s), bool)
        keep[i + 1] = False
        if open_ is not None:
            open_ = open_[keep]
        s, last = s[keep], last[keep]
        if open_ is None and exact and len(s) > 1:
            bins, count = binned(s, last)
            open_ = np.append(count[bins] >= MIN_COUNT, False)
    left, right = (np.concatenate(x) if x else np.zeros(0, np.uint32) for x in (rules_left, rules_right))
    length = np.ones(first + rules, np.int64)
    done = 0
    for x, y in zip(rules_left, rules_right, strict=True):
        length[first + done : first + done + len(x)] = length[x] + length[y]
        done += len(x)
    ends = np.flatnonzero(last) + 1
    offsets = np.zeros(len(docs) + 1, np.int64)
    offsets[1:][sizes > 0] = ends
    offsets = np.maximum.accumulate(offsets)
    planes = s.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T if len(s) else np.zeros((3, 0), np.uint8)
    assert first + rules < 1 << 24
    return b"".join([b"RPG1", struct.pack("<4I", len(docs), rules, len(s), first), *(x.astype("<u4").tobytes() for x in (left, right, length[first:], offsets, sizes)), np.ascontiguousarray(planes).tobytes()])


class Shard:
    """A payload, with access to single documents and ranges of ids."""

    def __init__(self, payload: bytes):
        if payload[:4] != b"RPG1":
            raise ValueError("not a grammar shard")
        docs, rules, n, self.first = struct.unpack_from("<4I", payload, 4)
        x = np.frombuffer(payload, "<u4", 3 * rules + 2 * docs + 1, 20)
        self.left, self.right, self.length = x[:rules], x[rules : 2 * rules], x[2 * rules : 3 * rules].astype(np.int64)
        self.offsets, self.sizes = x[3 * rules : 3 * rules + docs + 1].astype(np.int64), x[3 * rules + docs + 1 :].astype(np.int64)
        planes = np.frombuffer(payload, np.uint8, 3 * n, 20 + 4 * len(x)).reshape(3, n).astype(np.uint32)
        self.symbols = planes[0] | planes[1] << np.uint32(8) | planes[2] << np.uint32(16)

    def lengths(self, s: np.ndarray) -> np.ndarray:
        return np.where(s < self.first, 1, self.length[np.maximum(s.astype(np.int64) - self.first, 0)]) if len(self.length) else np.ones(len(s), np.int64)

    def expand(self, s: np.ndarray) -> np.ndarray:
        """The ids below symbols, a level of the grammar at a time."""
        while len(rule := np.flatnonzero(s >= self.first)):
            twice = np.ones(len(s), np.int64)
            twice[rule] = 2
            at = np.cumsum(twice) - twice
            out, k = np.empty(len(s) + len(rule), np.uint32), s[rule] - np.uint32(self.first)
            out[at] = s
            out[at[rule]], out[at[rule] + 1] = self.left[k], self.right[k]
            s = out
        return s

    def document(self, i: int) -> np.ndarray:
        return self.expand(self.symbols[self.offsets[i] : self.offsets[i + 1]])

    def ids(self, i: int, begin: int, end: int) -> np.ndarray:
        """Ids begin to end of document i; symbols outside the range aren't expanded."""
        s = self.symbols[self.offsets[i] : self.offsets[i + 1]]
        ends = np.cumsum(self.lengths(s))
        a, b = np.searchsorted(ends, begin, side="right"), np.searchsorted(ends, end, side="left") + 1
        skip = begin - (int(ends[a - 1]) if a else 0)
        return self.expand(s[a:b])[skip : skip + max(0, end - begin)]

    def documents(self) -> list[np.ndarray]:
        """All documents: every rule is expanded once, and its ids are copied to where it stands."""
        if not len(self.sizes):
            return []
        rules = self.expand(np.arange(self.first, self.first + len(self.length), dtype=np.uint32))
        flat = np.concatenate((np.arange(self.first, dtype=np.uint32), rules))
        size = np.concatenate((np.ones(self.first, np.int64), self.length))
        begin = np.cumsum(size) - size
        n = size[self.symbols]
        ends = np.cumsum(n)
        ids = flat[np.repeat((begin[self.symbols] - ends + n).astype(np.int32), n) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)]
        return np.split(ids, np.cumsum(self.sizes)[:-1])


def write(docs: DataFrame, tokenizer_path: str, path: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of every whole text as shards to `path`, in ascending doc_id order of (part, shard, place)."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = cached(("pieces", tokenizer_path), lambda: PieceEncoder(tokenizer_path))
        part, shard, names, held, n = TaskContext.get().partitionId(), 0, [], [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([n], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([compress(held)], pa.binary())], names=["part", "shard", "n_tokens", "doc_ids", "payload"])

        for batch in batches:
            tail = b"" if end_id is None else struct.pack("<I", end_id)
            for doc, ids in zip(batch.column(0).to_pylist(), encode(texts_of(batch.column(1))), strict=True):
                names.append(doc)
                held.append(np.frombuffer(ids + tail, "<u4"))
                n += len(held[-1])
                if n >= SHARD_TOKENS:
                    yield row()
                    shard, names, held, n = shard + 1, [], [], 0
        if names:
            yield row()

    ordered = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(lean(run), SHARDS).write.parquet(path)


def _documents(spark, path: str, run, schema: str) -> DataFrame:
    """What `run` makes of the rows (first, doc_ids, payload) of the shards at `path`; `first` counts the ids before.

    It comes from the shards' sizes: summed up inside each part, and over the parts, of which there are as many as
    tasks wrote the files. A list of up to MAX_BROADCAST shards is broadcast, so that payloads stay where they are."""
    shards = spark.read.schema(SHARDS).parquet(path)
    sizes = shards.select("part", "shard", "n_tokens")
    inside = sizes.withColumn("inside", F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens"))
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    starts = inside.join(before, "part").select("part", "shard", (F.col("inside") + F.col("before")).alias("first"))
    starts = F.broadcast(starts) if sizes.count() <= MAX_BROADCAST else starts
    return shards.join(starts, ["part", "shard"]).select("first", "doc_ids", "payload").mapInArrow(lean(run), schema)


def _expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, list[np.ndarray]]]:
    """(doc_ids, starts, ids) of each shard, PACK_ROWS documents at a time."""
    for batch in batches:
        for first, names, payload in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            ids = Shard(payload).documents()
            start = first + np.cumsum([0, *map(len, ids)])[:-1]
            for k in range(0, len(ids), PACK_ROWS):
                yield names[k : k + PACK_ROWS], start[k : k + PACK_ROWS], ids[k : k + PACK_ROWS]


def read(spark, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document of the shards at `path`; start counts the ids before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, start, ids in _expanded(batches):
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(start, pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())], names=["doc_id", "start", "ids"])

    return _documents(spark, path, run, "doc_id long, start long, ids binary")


def facts(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the shards at `path`, whose ids stay with the reader:
    the CRC-32 is that of the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, start, ids in _expanded(batches):
            rows = [names, start, [len(x) for x in ids], [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _documents(spark, path, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store(docs: DataFrame, tokenizer_path: str, end_id: int | None = None) -> str:
    """Write to a new shared folder; returns its path."""
    path = work_dir(docs.sparkSession, "repair")
    write(docs, tokenizer_path, path, end_id)
    return path
