"""Vectorised word and window hashing over Arrow string batches.

Every operator that needs word identities works on the UTF-8 bytes of a whole
batch at once: words are located with a byte class table, and their 64-bit
identities come from eight bytes at a time, so no Python object per word is
made. Separators are ASCII, which never occur inside a
multi-byte UTF-8 sequence, hence byte positions are safe word bounds.
"""

from __future__ import annotations

import ctypes
import functools
import unicodedata
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes of text handled at once, which need about 60 times as much memory; one longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Bytes of an Arrow batch between the JVM and Python, and the setting that bounds them.
BATCH_BYTES, BATCH_LIMIT = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"

_U = np.uint64
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: `[^\x20\x09-\x0D]+`
WORD_CLASS = ~_WHITE
#: ASCII letters and digits
ALNUM_CLASS = np.array([b < 128 and chr(b).isalnum() for b in range(256)])
IDENTITY = np.arange(256, dtype=np.uint8)
LOWER_AZ = IDENTITY.copy()
LOWER_AZ[65:91] += 32


class Words(NamedTuple):
    """Words of several documents: byte spans, 64-bit identities, and the index of each document's first word."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole 64-bit word."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


class _Keys:
    """Independent odd keys by position, grown on demand."""

    def __init__(self, seed: int) -> None:
        self.seed, self.known = _U(seed), np.zeros(0, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.known) < n:
            at = np.arange(1, max(n, 1 << 12) + 1, dtype=np.uint64)
            self.known = mix(at * _U(0x9E3779B97F4A7C15) + self.seed) | _U(1)
        return self.known[:n]


#: Keeps the first so many bytes of eight.
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class Hasher:
    """One independent family of word and window identities.

    A word is taken eight bytes at a time: each eight are mixed with the key of
    their place, and the results summed, so words of up to eight bytes never
    share an identity with one as long, and longer ones only by chance. (A
    polynomial modulo 2**64 has words that agree under any base.) Windows sum
    the words times the key of their place.
    """

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.bytes = _Keys(int(rng.integers(1 << 40, 1 << 62)))
        self.words = _Keys(int(rng.integers(1 << 40, 1 << 62)))

    def spans(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Identity of each byte span."""
        if not len(start):
            return np.zeros(0, np.uint64)
        padded = np.concatenate((data, np.zeros(8, np.uint8)))
        eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
        size = end - start
        many = np.maximum((size + 7) >> 3, 1)
        if int(many.max()) == 1:
            total = mix(eights[start] & _FIRST_BYTES[size] ^ self.bytes.upto(1)[0])
        else:
            first = np.cumsum(many) - many
            place = np.arange(int(many.sum())) - np.repeat(first, many)
            left = np.minimum(np.repeat(size, many) - 8 * place, 8)
            value = eights[np.repeat(start, many) + 8 * place] & _FIRST_BYTES[left]
            total = np.add.reduceat(mix(value ^ self.bytes.upto(int(many.max()))[place]), first)
        return mix(total + size.astype(np.uint64) * _U(0x9E3779B97F4A7C15))

    def windows(self, words: np.ndarray, size: int) -> np.ndarray:
        """Identity of the run of ``size`` words at each position; the last ``size - 1`` positions are left out."""
        n = len(words) - size + 1
        if n < 1:
            return np.zeros(0, np.uint64)
        by = self.words.upto(size)
        total = np.full(n, size, np.uint64)
        for k in range(size):
            total += words[k : k + n] * by[k]
        return mix(total)

    def run(self, words: np.ndarray) -> int:
        """Identity of a whole sequence, comparable with ``windows`` of that size."""
        by = self.words.upto(len(words))
        return int(mix(np.array([(words * by).sum(dtype=np.uint64) + _U(len(words))], np.uint64))[0])


HASH = Hasher(20240501)
HASH_2 = Hasher(77003311)


Batches = Iterator[pa.RecordBatch]


def _trim() -> None:
    """Have the C library give free memory back to the system, where it can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def batchwise(df: DataFrame, run: Callable[[Batches], Batches], schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow`` with bounded memory.

    Batches are bounded in bytes, not only in rows, as texts differ much in
    length (a limit set in the session stays). At the end of a task its memory
    goes back to the system: a worker is used again by later tasks and waits
    while the JVM works, and what it kept of its last task would count against
    the executor all the while.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_LIMIT, None) is None:
        conf.set(BATCH_LIMIT, str(BATCH_BYTES))

    def tidy(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()

    return df.mapInArrow(tidy, schema)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a string array; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Pieces of a batch of about ``limit`` bytes of text each, with their bytes and offsets."""
    if not batch.num_rows:
        return
    data, off = text_bytes(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def find_words(data: np.ndarray, off: np.ndarray, klass: np.ndarray = WORD_CLASS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and the first word of each document."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = klass[data]
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    cut = off[(off > 0) & (off < len(data))]
    begins[cut] = inside[1:-1][cut]
    ends[cut - 1] = inside[1:-1][cut - 1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, off)


def words_of(data: np.ndarray, off: np.ndarray, klass: np.ndarray = WORD_CLASS, fold: np.ndarray | None = None, hasher: Hasher = HASH) -> Words:
    """Words of a chunk; ``fold`` maps bytes before hashing (spans still point into ``data``)."""
    start, end, first = find_words(data, off, klass)
    return Words(start, end, hasher.spans(data if fold is None else fold[data], start, end), first)


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, number of bytes and value of each character of UTF-8 text."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    size = np.diff(np.append(lead, len(data)))
    code = data[lead].astype(np.int64)
    for n, keep in ((2, 0x1F), (3, 0x0F), (4, 0x07)):
        rows = np.flatnonzero(size == n)
        value = code[rows] & keep
        for k in range(1, n):
            value = (value << 6) | (data[lead[rows] + k] & 0x3F)
        code[rows] = value
    return lead, size, code


#: Scripts written without spaces, whose characters are tokens each, as ranges of code points.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x2FDF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))


@functools.cache
def character_table() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: 0 between tokens, 1 within them, 2 a token of its own; and its lower case where that is one character."""
    kind, lower = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.int32)
    for c in (*range(0xD800), *range(0xE000, 0x110000)):
        x = chr(c)
        if x.isalnum() or (c > 0x2FF and unicodedata.category(x)[0] == "M"):
            kind[c] = 1
            if len(x.lower()) == 1:
                lower[c] = ord(x.lower())
    for a, b in UNSPACED:
        kind[a : b + 1][kind[a : b + 1] > 0] = 2
    return kind, lower


def tokens_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Identities of the tokens of a chunk, in lower case, and the first one of each document.

    A token is a run of letters, digits and marks of any script, or one
    character of a script that is written without spaces.
    """
    folded = LOWER_AZ[data]
    if not (data >= 0x80).any():
        start, end, first = find_words(data, off, ALNUM_CLASS)
        return HASH.spans(folded, start, end), first
    table, lower = character_table()
    lead, size, code = code_points(data)
    kind, small = table[code], lower[code].astype(np.int64)
    changed = np.flatnonzero((small != code) & (code >= 0x80))
    for n, low, high, mark in ((2, 0x80, 0x7FF, 0xC0), (3, 0x800, 0xFFFF, 0xE0)):
        rows = changed[(size[changed] == n) & (small[changed] >= low) & (small[changed] <= high)]
        for k in range(n):
            bits = small[rows] >> (6 * (n - 1 - k))
            folded[lead[rows] + k] = (bits | mark) if k == 0 else (bits & 0x3F | 0x80)
    head = np.zeros(len(lead) + 1, bool)  # characters at which a document begins
    head[np.searchsorted(lead, off)] = True
    cut = head.copy()
    cut[1:-1] |= (kind[1:] != 1) | (kind[:-1] != 1)
    begins, ends = (kind > 0) & cut[:-1], (kind > 0) & cut[1:]
    ends[-1:] = kind[-1:] > 0
    start = lead[begins]
    return HASH.spans(folded, start, (lead + size)[ends]), np.searchsorted(start, off)


def window_starts(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a window of ``size`` words fits into its document, and the document of each."""
    n = np.diff(first)
    fits = np.maximum(n - size + 1, 0)
    doc = np.repeat(np.arange(len(n)), fits)
    base = np.concatenate(([0], np.cumsum(fits)))[:-1]
    return np.arange(int(fits.sum())) - np.repeat(base, fits) + np.repeat(first[:-1], fits), doc


def as_long(x: np.ndarray) -> pa.Array:
    """Unsigned identities as Spark's signed long."""
    return pa.array(x.view(np.int64), pa.int64())
