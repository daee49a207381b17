"""Vectorised word splitting of Arrow text batches, shared by the operators that run in Arrow tasks.

Texts stay in one contiguous UTF-8 buffer per chunk; words are index ranges of that buffer, so no Python
string is made per word.  A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: Text bytes handled at once; a longer single text makes a chunk of its own.
CHUNK_BYTES = 1 << 20


def _table(separators: Iterable[int], lower: bool) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    table[list(separators)] = 0
    return table


#: Words between blanks (space, tab, line feed, vertical tab, form feed, carriage return), unchanged.
#: A NUL byte is a word character there, so it is kept apart from the separator mark by `Words`.
BLANK = (32, *range(9, 14))
PLAIN = _table(BLANK, lower=False)
PLAIN_LOWER = _table(BLANK, lower=True)
#: ASCII letters and digits, lower-cased, and everything outside ASCII.
ALNUM_LOWER = _table([*range(0, 48), *range(58, 65), *range(91, 97), *range(123, 128)], lower=True)


@dataclass
class Words:
    """Words of a chunk of texts.

    data: the mapped bytes of all texts; doc_at: byte offset of each text, and the end;
    start, end: byte range of each word; first: index of the first word of each text, and the word count.
    """

    data: np.ndarray
    doc_at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    @property
    def per_doc(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.per_doc)

    def joined(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All words with one space after each, and where each word starts and ends in that."""
        size = self.end - self.start
        ends = np.cumsum(size + 1) - 1
        starts = ends - size
        out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 32, dtype=np.uint8)
        inside = np.zeros(len(self.data) + 1, dtype=np.int8)
        inside[self.start] += 1
        inside[self.end] -= 1
        source = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        target = np.ones(len(out), dtype=bool)
        target[ends] = False
        out[target] = self.data[source]
        return out.tobytes(), starts, ends

    def ids(self) -> tuple[np.ndarray, list[bytes]]:
        """The number of each word in a list of the chunk's distinct words, and that list."""
        if not len(self):
            return np.zeros(0, dtype=np.int64), []
        joined, starts, _ = self.joined()
        at = np.append(starts, len(joined)).astype(np.int64)
        array = pa.Array.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(at), pa.py_buffer(joined)])
        coded = array.dictionary_encode()
        return coded.indices.to_numpy().astype(np.int64), [w[:-1] for w in coded.dictionary.to_pylist()]

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit hashes of each word: its length, then eight bytes after the other of all words at once."""
        data = np.append(self.data, np.zeros(8, np.uint8))
        lanes = np.ndarray((len(data) - 7,), np.dtype("<u8"), data, strides=(1,))
        size = self.end - self.start
        out = [mixed(size.astype(np.uint64) * odd) for odd in ODDS]
        left = np.flatnonzero((size > 0) & (size <= LONG_WORD))
        at = 0
        while len(left):
            block = lanes[self.start[left] + at] & MASKS[np.minimum(size[left] - at, 8)]
            for one, odd in zip(out, ODDS):
                one[left] = mixed((one[left] ^ block) * odd)
            at += 8
            left = left[size[left] > at]
        for k in np.flatnonzero(size > LONG_WORD):
            word = self.data[self.start[k] : self.end[k]].tobytes()
            for one, seed in zip(out, (1, 2)):
                one[k] = xxhash.xxh64_intdigest(word, seed)
        return out[0], out[1]


#: Longer words (in bytes) are hashed one by one.
LONG_WORD = 1024
ODDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every one of x, and no two x have the same."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the offset of each text, nulls as empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, at, data = texts.buffers()
    at = np.frombuffer(at, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if at is not None and len(texts) else np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def split_words(texts: pa.Array, table: np.ndarray) -> Words:
    raw, at = buffers(texts)
    data = table[raw]
    word = (data != 0) | (raw == 0) if table[0] == 0 and table[1] == 1 else data != 0
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[at] = True
    before = np.empty_like(word)
    before[:1] = False
    before[1:] = word[:-1]
    after = np.empty_like(word)
    after[-1:] = False
    after[:-1] = word[1:]
    start = np.flatnonzero(word & (~before | edge[:-1]))
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    return Words(data, at, start, end, np.searchsorted(start, at))


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that each holds at most `most` text bytes or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = buffers(batch.column(text))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
            yield batch.slice(i, j - i)
            i = j
    pa.default_memory_pool().release_unused()  # workers are kept for other tasks
