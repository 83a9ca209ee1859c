"""Token counts: batch encoding in Arrow functions that return lengths only.

Batches are balanced by bytes; a longer text is cut at safe boundaries: before a single space that stands
between characters other than spaces. No piece of the vocabulary has the word mark behind another character
(checked when the model is loaded), so no merge crosses such a place, and the mark that the library puts
before each part stands for the space that was left out. Without that property texts stay whole.

Null texts count as empty: 0 bytes, 0 tokens. Rows with equal or null doc_id stay rows of their own; an empty
table gives an empty result; other columns are ignored.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import by_bytes, cached, lean, texts_of, tune

#: Bytes of text given to the library at a time, and characters of a part of a long text.
BATCH_BYTES = 1 << 20
PART_CHARS = 1 << 16
MARK = "▁"
SAFE = re.compile(f"(?<=[^ {MARK}]) (?=[^ {MARK}])")


def parts_of(text: str, size: int = PART_CHARS) -> list[str]:
    """The parts of a text of at least `size` characters each, but the last; their counts add up to the text's."""
    out, at = [], 0
    while len(text) - at > size and (m := SAFE.search(text, at + size - 1)):
        out.append(text[at : m.start()])
        at = m.end()
    return [*out, text[at:]]


def counter(path: str):
    """A function from texts to their numbers of tokens, and whether parts of a text may be counted apart."""
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
        plain = sp.normalize(f"a  b {MARK}") == f"{MARK}a{MARK}{MARK}b{MARK}{MARK}"
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)], plain and not any(MARK in p.lstrip(MARK) for p in pieces)
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return lambda texts: [len(x) for x in t.encode_batch_fast(texts, add_special_tokens=False)], False


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every whole text, by the tokenizer file at `path`."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, safe = cached(("counter", path), lambda: counter(path))
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            column = batch.column(batch.schema.get_field_index("text"))
            cut = [parts_of(t) if safe else [t] for t in texts_of(column)]
            sizes = np.zeros(sum(map(len, cut)), np.int64)
            parts = [p for x in cut for p in x]
            at = 0
            while at < len(parts):  # a long text's parts go in batches of their own
                end, held = at, 0
                while end < len(parts) and (held < BATCH_BYTES or end == at):
                    held += len(parts[end])
                    end += 1
                sizes[at:end] = count(parts[at:end])
                at = end
            n = np.add.reduceat(sizes, np.cumsum([0, *map(len, cut[:-1])]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_length(column).fill_null(0).cast(pa.int64()), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), "doc_id long, n_bytes long, n_tokens long")
