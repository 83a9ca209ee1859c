"""Substring dedup by hashing normalised units of lines and paragraphs.

A text's units begin at line breaks, after sentence ends and at capitalised words; what is longer than LONG_WORDS
words is cut before the words that their hash chooses. So a passage that was put into the middle of a line still
falls into the same units as its source, whatever the script; where no sentence or capital bounds it, the words
up to the next cut stay at its edges. Ideographs and kana count as words. Words are normalised (lower case
in ASCII and Latin-1, white space ignored). Hashed to 128 bits and grouped globally are windows of units, the
shortest of `run_words` words or more from each unit on and up to each unit's end, and whole lines of `line_words`
words or more that are shorter than a window; without `run_words` (None), whole lines alone, of any length from
`line_words` on. The occurrence of the lowest rank (doc_id, then position) is the
one to keep; others go, unless they overlap it. So every run of units of `run_words` words or more that stood
together earlier goes whole, as the windows inside it cover it, and nothing goes only because its units occur
one by one. The removed ranges are given as offsets in code points of the original text.

Texts that are null are returned as they are, without removed ranges. Rows with a null doc_id have no rank:
they stay whole and remove nothing. Rows that repeat a doc_id count as one document's, and each loses only
what its own text repeats. An empty table gives an empty result. Other columns are kept; a column named `removed` is replaced.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import wordhash
from .shared import MAX_MEMBERS, bitmap_of, by_bytes, in_bitmap, lean, tune, written

#: Words of a repeated run, and of a repeated whole line, that go at least.
RUN_WORDS = LINE_WORDS = 20
#: A unit of more words is cut before each word that its hash chooses, one in CHOSEN.
LONG_WORDS, CHOSEN = 16, 8
SLICE_BYTES = 1 << 20
REMOVED = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))

STOPS, CLOSERS = ".!?…。！？؟۔।", "\"')]”’»"


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the Latin-1 capitals, byte for byte."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    if len(data) > 1:
        capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[capital] += 32
    return out


def capitalised(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether words begin with a Latin-1, Greek or Cyrillic capital."""
    b = data[starts]
    after = data[np.minimum(starts + 1, len(data) - 1)] if len(data) else b
    out = ((b >= 65) & (b <= 90)) | ((b == 0xC3) & (after >= 0x80) & (after <= 0x9E) & (after != 0x97))
    return out | ((b == 0xCE) & (after >= 0x86) & (after <= 0xAB)) | ((b == 0xD0) & (after >= 0x80) & (after <= 0xAF))


def ends_with(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, characters: str) -> np.ndarray:
    """The length in bytes of the one of the characters that each word ends with, or 0."""
    out = np.zeros(len(ends), np.int64)
    for c in map(str.encode, characters):
        at = np.flatnonzero((data[ends - 1] == c[-1]) & (ends - starts >= len(c)))
        for k in range(2, len(c) + 1):
            at = at[data[ends[at] - k] == c[-k]]
        out[at] = len(c)
    return out


def sentence_ends(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether words end with a stop, or with a stop and a closing quote or bracket."""
    out = ends_with(data, starts, ends, STOPS) > 0
    closer = ends_with(data, starts, ends, CLOSERS)
    at = np.flatnonzero((closer > 0) & (ends - closer > starts))
    out[at] = ends_with(data, starts[at], ends[at] - closer[at], STOPS) > 0
    return out


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As wordhash.words, with each ideograph and kana, written without spaces, as a word of its own."""
    starts, ends, first = wordhash.words(data, at)
    alone = np.flatnonzero((data >= 0xE3) & (data <= 0xE9))
    if len(alone):
        cuts = np.setdiff1d(np.concatenate((alone, alone + 3)), np.concatenate((starts, ends)))
        starts, ends = np.sort(np.concatenate((starts, cuts))), np.sort(np.concatenate((ends, cuts)))
        first = np.searchsorted(starts, at)
    return starts, ends, first


def digests(h: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit digests of the words begin to end of each window, from prefix sums over the words' hashes."""
    powers, inverse = (np.concatenate(([np.uint64(1)], np.multiply.accumulate(np.full(len(h), p)))) for p in (wordhash.PRIME, wordhash.INVERSE))
    size, out = (end - begin).astype(np.uint64), []
    for k in (np.uint64(1 << 40), np.uint64(3 << 50)):
        total = np.concatenate(([np.uint64(0)], np.cumsum(wordhash.mix(h ^ k) * powers[:-1])))
        out.append(wordhash.mix(wordhash.mix((total[end] - total[begin]) * inverse[begin]) + size))
    return out


class Units:
    """The units of a column of texts: `first` word of each (one more for the end), `line` numbers, and `begin`,
    the index of each text's first unit (one more for the end)."""

    def __init__(self, column: pa.Array):
        self.data, self.at = wordhash.utf8(column)
        self.starts, self.ends, text_first = words(self.data, self.at)
        m = len(self.starts)
        self.hashes = wordhash.hashes(lowered(self.data), self.starts, self.ends)
        if not m:
            self.first, self.line, self.begin = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(len(self.at), np.int64)
            return
        breaks = np.concatenate(([0], np.cumsum(self.data == 10)))
        new_line = np.ones(m, bool)
        new_line[1:] = breaks[self.starts[1:]] > breaks[self.ends[:-1]]
        new_text = np.zeros(m + 1, bool)
        new_text[text_first] = True
        new_line |= new_text[:m]
        new = new_line | capitalised(self.data, self.starts)
        new[1:] |= sentence_ends(self.data, self.starts[:-1], self.ends[:-1])
        size = np.diff(np.append(np.flatnonzero(new), m))
        new |= np.repeat(size > LONG_WORDS, size) & (self.hashes % np.uint64(CHOSEN) == 0)
        self.first = np.concatenate((np.flatnonzero(new), [m]))
        self.line = np.cumsum(new_line)[self.first[:-1]]
        self.begin = np.searchsorted(self.first[:-1], text_first)

    def windows(self, run_words: int | None = RUN_WORDS, line_words: int = LINE_WORDS) -> tuple[np.ndarray, ...]:
        """(text, first unit, end unit, digests) of the windows and of the lines shorter than a window."""
        text = np.repeat(np.arange(len(self.begin) - 1), np.diff(self.begin))
        unit = np.arange(len(text))
        if run_words:
            to = np.searchsorted(self.first, self.first[:-1] + run_words)
            start = np.searchsorted(self.first, self.first[1:] - run_words, side="right") - 1
            ahead = to <= self.begin[1:][text]
            back = start >= self.begin[:-1][text]
            back[back] = to[start[back]] != unit[back] + 1  # not those that are windows ahead as well
        else:
            to = start = unit
            ahead = back = np.zeros(len(unit), bool)
        line = np.flatnonzero(np.diff(self.line, prepend=-1))
        line_end = np.append(line, len(unit))[1:]
        n = self.first[line_end] - self.first[line]
        short = (n >= line_words) & (n < (run_words or len(self.starts) + 1))
        a = np.concatenate((unit[ahead], start[back], line[short]))
        b = np.concatenate((to[ahead], unit[back] + 1, line_end[short]))
        return text[a], a, b, *digests(self.hashes, self.first[a], self.first[b])


def windows_of(docs: DataFrame, run_words: int | None, line_words: int, bitmap: np.ndarray | None = None) -> DataFrame:
    """(d1, d2, doc_id, span, text_hash) of every window, or of those whose d1 the bitmap has.

    A span is the window's first unit in its text, shifted by 32 bits, and the number of its units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", SLICE_BYTES):
            u = Units(batch.column(1))
            text, a, b, one, two = u.windows(run_words, line_words)
            one, two = one.view(np.int64), two.view(np.int64)
            if bitmap is not None:
                keep = in_bitmap(bitmap, one)
                text, a, b, one, two = text[keep], a[keep], b[keep], one[keep], two[keep]
            span = a - u.begin[text] << 32 | b - a
            ids, marks = (batch.column(k).to_numpy()[text] for k in (0, 2))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (one, two, ids, span, marks)], names=["d1", "d2", "doc_id", "span", "text_hash"])

    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").withColumn("text_hash", F.xxhash64("text")).mapInArrow(lean(run), "d1 long, d2 long, doc_id long, span long, text_hash long")


def ranges_to_remove(u: Units, text: int, spans: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges of a text of which the windows `spans` occur earlier."""
    a, b = u.begin[text], u.begin[text + 1]
    line = u.line[a:b]
    step = np.zeros(b - a + 1, np.int64)
    np.add.at(step, spans >> 32, 1)
    np.add.at(step, (spans >> 32) + (spans & 0xFFFFFFFF), -1)
    drop = np.cumsum(step)[:-1] > 0
    out = []
    edges = np.flatnonzero(np.diff(np.concatenate(([0], drop.astype(np.int8), [0]))))
    for i, j in zip(edges[::2], edges[1::2], strict=True):
        start, end = int(u.starts[u.first[a + i]]), int(u.ends[u.first[a + j] - 1])
        if j < b - a:  # the white space behind goes along, unless it holds the line break of what stands before
            inside_line = i > 0 and line[i] == line[i - 1]
            if line[j] == line[j - 1] or not inside_line:
                end = int(u.starts[u.first[a + j]])
        else:
            end = int(u.at[text + 1])
        out.append((start, end))
    return out


def dedup(docs: DataFrame, run_words: int | None = RUN_WORDS, line_words: int = LINE_WORDS, id_col: str = "doc_id", text_col: str = "text", into: str = "removed") -> DataFrame:
    """The documents with repeated units taken out of their texts, and `removed`, or a column named otherwise, the
    ranges taken out."""
    tune(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rank = F.struct("doc_id", "span")
    found = windows_of(plain, run_words, line_words).groupBy("d1", "d2").agg(F.min(rank).alias("first"), F.max(rank).alias("last"))
    several = written(found.where("first <> last").select("d1", "d2", "first"), "repeated-windows")
    n = several.count()
    apart = "doc_id <> first.doc_id OR shiftright(span, 32) >= shiftright(first.span, 32) + (first.span & 4294967295)"
    bitmap = bitmap_of(several, "d1", n) if n <= MAX_MEMBERS else None
    later = windows_of(plain, run_words, line_words, bitmap).join(several, ["d1", "d2"]).where(apart)
    places = later.groupBy("doc_id", "text_hash").agg(F.collect_set("span").alias("repeated"))
    columns = [c for c in docs.columns if c != into]
    schema = T.StructType([*docs.select(*columns).schema.fields, T.StructField(into, REMOVED)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, where = batch.column(columns.index(text_col)), batch.column(len(columns))
            out, removed = texts.to_pylist(), [[] if t.is_valid else None for t in texts]
            hit = [i for i in range(batch.num_rows) if where[i].is_valid and texts[i].is_valid]
            for i in hit:
                u = Units(texts.slice(i, 1))
                cuts = ranges_to_remove(u, 0, where.slice(i, 1).flatten().to_numpy())
                if cuts:
                    chars = np.concatenate(([0], np.cumsum((u.data & 0xC0) != 0x80)))
                    removed[i] = [{"start": int(chars[a]), "end": int(chars[b])} for a, b in cuts]
                    parts, at = [], 0
                    for r in removed[i]:
                        parts.append(out[i][at : r["start"]])
                        at = r["end"]
                    out[i] = "".join([*parts, out[i][at:]])
            arrays = [batch.column(k) for k in range(len(columns))]
            arrays[columns.index(text_col)] = pa.array(out, pa.string())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(removed, kind)], names=[*columns, into])

    at = "__doc" if "__doc" not in docs.columns else "__doc_"
    places = places.select(F.col("doc_id").alias(at), F.col("text_hash").alias(f"{at}_text"), F.col("repeated").alias(f"{at}_repeated"))
    same = (F.col(id_col).cast("long") == F.col(at)) & (F.xxhash64(text_col) == F.col(f"{at}_text"))
    both = docs.select(*columns).join(places, same, "left").drop(at, f"{at}_text")
    return both.mapInArrow(lean(run), schema)
