"""Benchmark decontamination by templates.

Words become template tokens: numbers, units behind numbers (also those written against them), and names (runs of
capitalised words inside a sentence) turn into typed placeholders, all others into their lower-case form without
punctuation at the ends. Windows of WINDOW tokens of documents and benchmark items are joined by hash. A window
keeps the values of its placeholders, so that the matches of a document with an item can be checked for consistent
slots: on one alignment, every value of the item has to stand for one value of the document. A re-parameterised
question passes with other values, while text that only shares the template's frame does not. Beside the templates,
windows of the plain words in lower case are joined, so that copies in other case, and items of hardly anything
but names and numbers, are found as well.

A document leaks an item when matches of one alignment cover `least_tokens` of its tokens or `least_share` of
them, and the slots of the widest such alignment are consistent. Items of fewer than WINDOW tokens are looked for as a whole; those of fewer
than `least_item` tokens are not looked for, none with 1. Template windows with fewer than `least_words` words that
aren't placeholders don't count.

Documents' windows are screened by a bitmap of the benchmark's windows, or not at all where those are too many;
the join itself is exact, whatever the size of the benchmark. Its windows are broadcast up to MAX_BROADCAST rows;
beyond, frequent windows are dealt to several tasks. Null texts have no window; rows with a null doc_id or item_id
are not reported; rows that repeat an id count as one. Empty tables give an empty result; other columns are
ignored.
"""

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .shared import MAX_MEMBERS, bitmap_of, by_bytes, in_bitmap, lean, spread_join, tune, written
from .unit_dedup import capitalised, lowered

WINDOW = 8
LEAST_TOKENS = 13
LEAST_SHARE = 0.5
LEAST_ITEM = 5
LEAST_WORDS = 3
SLICE_BYTES = 1 << 20
#: Windows of a benchmark that are broadcast at most.
MAX_BROADCAST = 200_000
#: The kinds of windows.
TEMPLATE, PLAIN = 0, 1
NUMBER, UNIT, NAME = (np.uint64(0x1000 + k) for k in range(3))

#: Units of measure and currency that may follow a number.
UNITS = """% percent km m cm mm mile miles ft feet inch inches yard yards kg g mg t ton tons lb lbs oz l ml liter
liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks
month months year years $ € £ usd eur gbp dollar dollars cent cents euro euros pound pounds °c °f degrees kmh
km/h mph w kw kwh v a hz khz mhz ghz b kb mb gb tb""".split()

UNIT_SET = frozenset(UNITS)
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
LETTER_OR_SIGN = LETTER.copy()
LETTER_OR_SIGN[[ord(c) for c in "%$"]] = True
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[ord(c) for c in "!\"'()*+,-./:;<=>?@[\\]^_`{|}~"]] = True
DECIMAL = np.zeros(256, bool)
DECIMAL[[ord(c) for c in ".,"]] = True
STOP = np.zeros(256, bool)
STOP[[ord(c) for c in ".!?:"]] = True


@functools.cache
def _unit_hashes() -> np.ndarray:
    data, at = wordhash.utf8(pa.array(UNITS))
    return np.unique(wordhash.hashes(data, *wordhash.words(data, at)[:2]))


def stripped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words without punctuation at the ends; a word of nothing else stays as it is."""
    s, e = starts.copy(), ends.copy()
    for edge, step, byte in ((s, 1, 0), (e, -1, -1)):
        open_ = np.flatnonzero(PUNCTUATION[data[edge + byte]])
        while len(open_):
            edge[open_] += step
            open_ = open_[(s[open_] < e[open_]) & (PUNCTUATION[data[np.clip(edge[open_] + byte, 0, len(data) - 1)]])]
    none = s >= e
    return np.where(none, starts, s), np.where(none, ends, e)


def with_units_apart(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words, a unit that is written against a number as a word of its own."""
    some = np.flatnonzero(DIGIT[raw[starts]] & LETTER_OR_SIGN[raw[ends - 1]] | PUNCTUATION[raw[starts]] | PUNCTUATION[raw[ends - 1]] & DIGIT[raw[starts]])
    s, e = stripped(raw, starts[some], ends[some])
    keep = DIGIT[raw[s]] & LETTER_OR_SIGN[raw[e - 1]] & (e - s <= 40)
    cuts = []
    for a, b in zip(s[keep].tolist(), e[keep].tolist(), strict=True):
        word = raw[a:b].tobytes()
        rest = word.lstrip(b"0123456789.,")
        if rest.lower().decode(errors="replace").lower() in UNIT_SET:
            cuts.append(b - len(rest))
    if not cuts:
        return starts, ends
    return np.sort(np.concatenate((starts, cuts))), np.sort(np.concatenate((ends, cuts)))


class Tokens:
    """Tokens of a column of texts: `token` hashes, `value` hashes, `slot` flags, first and last bytes, and the
    `first` token of each text; of the kind TEMPLATE or PLAIN."""

    def __init__(self, token, value, slot, starts, ends, first):
        self.token, self.value, self.slot, self.starts, self.ends, self.first = token, value, slot, starts, ends, first

    @functools.cached_property
    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Running sums of the tokens times powers, from which any window's hash comes, and the inverse powers."""
        powers, inverse = wordhash.powers(len(self.token) + 1)
        return np.concatenate(([np.uint64(0)], np.cumsum(wordhash.mix(self.token) * powers[:-1]))), inverse

    def windows(self, n: int, whole: bool, kind: int, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, text and first token of each window of n tokens; `whole`: only texts of just n tokens."""
        size = np.diff(self.first)
        count = np.where(size == n if whole else size >= n, size - n + 1, 0)
        begin = np.concatenate(([0], np.cumsum(count)))
        text = np.repeat(np.arange(len(size)), count)
        start = self.first[text] + np.arange(begin[-1]) - begin[text]
        if kind == TEMPLATE:
            words = np.concatenate(([0], np.cumsum(~self.slot)))
            good = words[start + n] - words[start] >= min(least_words, n)
            text, start = text[good], start[good]
        total, inverse = self.sums
        h = wordhash.mix((total[start + n] - total[start]) * inverse[start] + np.uint64(n + 1000 * kind))
        return h, text, start

    def slots(self, start: int, n: int) -> list[int]:
        at = start + np.flatnonzero(self.slot[start : start + n])
        return self.value.view(np.int64)[at].tolist()


def tokens(column: pa.Array) -> tuple[dict[int, Tokens], np.ndarray, np.ndarray]:
    """The template tokens and the plain words of a column of texts, where each text begins, and characters before each byte."""
    raw, at = wordhash.utf8(column)
    starts, ends, _ = wordhash.words(raw, at)
    if len(starts):
        starts, ends = with_units_apart(raw, starts, ends)
    first, m = np.searchsorted(starts, at), len(starts)
    s, e = stripped(raw, starts, ends)
    value = wordhash.hashes(lowered(raw), s, e)
    plain = Tokens(value, value, np.zeros(m, bool), starts, ends, first)
    chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    if not m:
        return {TEMPLATE: plain, PLAIN: plain}, at, chars
    digits, letters, breaks = (np.concatenate(([0], np.cumsum(x))) for x in (DIGIT[raw], LETTER[raw], raw == 10))
    number = (digits[e] > digits[s]) & (letters[e] == letters[s])
    opens = np.ones(m, bool)
    opens[1:] = STOP[raw[ends[:-1] - 1]] | (breaks[starts[1:]] > breaks[ends[:-1]])
    opens[first[:-1][first[:-1] < m]] = True
    before = np.concatenate(([False], number[:-1])) & ~opens
    unit = before & np.isin(value, _unit_hashes())
    name = capitalised(raw, s) & ~opens & ~number & ~unit
    goes_on = name & np.concatenate(([False], name[:-1]))
    head = np.flatnonzero(~goes_on)
    place = np.arange(m) - head[np.cumsum(~goes_on) - 1]
    run = np.add.reduceat(wordhash.mix(value * np.uint64(3) + place.astype(np.uint64)), head)
    token = np.select([number, unit, name], [np.full(m, k, np.uint64) for k in (NUMBER, UNIT, NAME)], value)[head]
    template = Tokens(token, np.where(name[head], run, value[head]), (number | unit | name)[head], starts[head], ends[np.append(head[1:], m) - 1], np.searchsorted(head, first))
    return {TEMPLATE: template, PLAIN: plain}, at, chars


SCHEMA = "id long, kind int, h long, n int, pos int, size int, slots array<long>, begin long, end long"
_ARROW = pa.schema([("id", pa.int64()), ("kind", pa.int32()), ("h", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("size", pa.int32()), ("slots", pa.list_(pa.int64())), ("begin", pa.int64()), ("end", pa.int64())])


def windows_of(texts: DataFrame, sizes: list[tuple[int, int]], items: bool, least_words: int, bitmap: np.ndarray | None = None) -> DataFrame:
    """Windows of each (kind, number of tokens) with id, hash, place, the text's size in tokens, slot values and code
    point offsets.

    `items`: windows of sizes below WINDOW only for texts of just that size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", SLICE_BYTES):
            both, at, chars = tokens(batch.column(1))
            ids, rows = batch.column(0).to_pylist(), []
            for kind, n in sizes:
                t = both[kind]
                h, text, start = t.windows(n, items and n < WINDOW, kind, least_words)
                if bitmap is not None:
                    keep = in_bitmap(bitmap, h)
                    h, text, start = h[keep], text[keep], start[keep]
                for x, i, s in zip(h.view(np.int64).tolist(), text.tolist(), start.tolist(), strict=True):
                    origin = int(chars[at[i]])
                    rows.append((ids[i], kind, x, n, s - int(t.first[i]), int(t.first[i + 1] - t.first[i]), t.slots(s, n), int(chars[t.starts[s]]) - origin, int(chars[t.ends[s + n - 1]]) - origin))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_ARROW), _ARROW, strict=True)], schema=_ARROW)

    return texts.where("id IS NOT NULL AND text IS NOT NULL").select("id", "text").mapInArrow(lean(run), SCHEMA)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", least_tokens: int = LEAST_TOKENS, least_share: float = LEAST_SHARE, least_item: int = LEAST_ITEM, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, item_id, start, end, n_tokens, item_tokens, exact): the widest alignment of each document and
    item that leaks; offsets are code points of the document."""
    tune(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col("text"))
    every = [(kind, n) for kind in (TEMPLATE, PLAIN) for n in range(min(least_item, WINDOW), WINDOW + 1)]
    items = written(windows_of(items, every, True, least_words), "benchmark-windows")
    n = items.count()
    sizes = sorted((r.kind, r.n) for r in items.select("kind", "n").distinct().collect())  # two for each size at most
    hits = windows_of(docs, sizes, False, least_words, bitmap_of(items, "h", n) if n <= MAX_MEMBERS else None)
    item = items.select("kind", "h", "n", F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), F.col("size").alias("item_tokens"), F.col("slots").alias("item_slots")).distinct()
    if n <= MAX_BROADCAST:
        both = hits.join(F.broadcast(item), ["kind", "h", "n"])
    else:
        hits = written(hits, "benchmark-hits")
        both = spread_join(hits, item, ["kind", "h", "n"], hits.count(), ["id", "pos"])
    lined = both.groupBy(F.col("id").alias("doc_id"), "item_id", "kind", "item_tokens", (F.col("pos") - F.col("item_pos")).alias("shift"))
    covered = F.array_distinct(F.flatten(F.collect_list(F.sequence("item_pos", F.col("item_pos") + F.col("n") - 1))))
    values = F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("item_slots", "slots"))))
    lined = lined.agg(F.size(covered).alias("n_tokens"), values.alias("values"), F.min("begin").alias("start"), F.max("end").alias("end"))
    consistent = F.size("values") == F.size(F.array_distinct(F.transform("values", lambda x: x["item_slots"])))
    enough = (F.col("n_tokens") >= least_tokens) | (F.col("n_tokens") >= least_share * F.col("item_tokens"))
    exact = ~F.exists("values", lambda x: x["item_slots"] != x["slots"])
    kept = lined.where(enough).withColumns({"consistent": consistent, "exact": exact})
    best = F.struct("n_tokens", "consistent", "exact", (-F.col("start")).alias("s"), "end", "item_tokens")
    out = kept.groupBy("doc_id", "item_id").agg(F.max(best).alias("x")).where("x.consistent")
    return out.select("doc_id", "item_id", (-F.col("x.s")).alias("start"), "x.end", "x.n_tokens", "x.item_tokens", "x.exact")
