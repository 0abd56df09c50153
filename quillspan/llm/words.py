"""Words of whole texts in Arrow batches: all words of a batch at once, exact, without a Python object per word.

A word is a maximal run of digits, letters A-Z and a-z (lower-cased) and characters beyond ASCII. Every byte
of such a character is beyond ASCII in UTF-8, so the rule holds byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: What each byte becomes inside a word; 0 ends a word.
LOWERED = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], dtype=np.uint8)


class Words(NamedTuple):
    words: pa.Array  # lower-cased words of all texts in order, as binary
    first: np.ndarray  # number of each text's first word, and the number of all words
    start: np.ndarray  # first byte of each word in ``raw``
    end: np.ndarray  # byte after it
    raw: np.ndarray  # bytes of all texts
    offsets: np.ndarray  # first byte of each text in ``raw``, and the number of bytes


def split_words(texts: pa.Array) -> Words:
    """The words of a batch of texts; a null text has none."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    offsets = offsets - offsets[0]
    low = LOWERED[raw]
    inside = low != 0
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(raw))]  # words of neighbouring texts do not join
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    bounds = np.zeros(len(start) + 1, dtype=np.int64)
    np.cumsum(end - start, out=bounds[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(low[inside])])
    return Words(words, np.searchsorted(start, offsets), start, end, raw, offsets)


def words_of(text: str | None) -> list[bytes]:
    """The words of one text."""
    return split_words(pa.array([text], pa.string())).words.to_pylist()


def ids_of(words: pa.Array, vocabulary: pa.Array) -> np.ndarray:
    """Number of each word in the vocabulary, -1 where it is not there. Words are compared whole."""
    return pc.fill_null(pc.index_in(words, value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def item_blocks(items: DataFrame, item_id: str, text: str, limit: int) -> Iterator[list[tuple[Any, list[bytes]]]]:
    """The rows of a query table as lists of (id, words), each of about ``limit`` words at most.

    The driver holds one list and one partition at a time; a single item beyond the limit is a list of its own.
    """
    block: list[tuple[Any, list[bytes]]] = []
    size = 0
    for row in items.select(item_id, text).toLocalIterator():
        words = words_of(row[1])
        if block and size + len(words) > limit:
            yield block
            block, size = [], 0
        block.append((row[0], words))
        size += len(words)
    if block:
        yield block


def batches_of(column: str, batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Every batch with the words of one of its columns."""
    for batch in batches:
        if batch.num_rows:
            yield batch, split_words(batch.column(batch.schema.get_field_index(column)))
