"""Count-min sketch whose cells are merged and tested in place, range by range.

Texts are packed once into blocks (``pack``), each a row of a written table, so
that a text has a fixed address and later passes read compressed rows. Every
block sketches its identities: the sorted distinct cells they fall into, and
how often if more than once. The cells are cut into ranges of their high bits;
each range's partial sketches go to one task, which adds them up and returns to
every block the merged count at the block's own cells (``estimates``). A count
is never less than the true one, as collisions only add to it.

There are ``LOAD`` cells or more for each expected identity at any input size,
so the share of distinct identities that look repeated stays small; nothing is
collected or broadcast. A partial sketch costs about two bytes an identity (cell
gaps are Golomb-Rice coded), the reply about a bit. An identity comes once from
each block, so frequent ones don't crowd their range.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import durable
from .textkernel import batchwise, chunks

#: Text of a block; one longer text is a block of its own.
BLOCK_BYTES = 4 << 20
#: Most rows of a block, so that a block and a row fit one address.
ROW_BITS = 20
#: Cells for each expected identity, at least.
LOAD = 8
#: Cells of a range at least, which are also those that a task counts at once, and at most.
RANGE, WIDEST = 1 << 24, 1 << 27
#: Identities that a block should have in a range, so that messages don't cost more than cells.
DENSE = 4096


# --- blocks


def to_bytes(batch: pa.RecordBatch) -> bytes:
    """Rows as compressed bytes."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return zstandard.ZstdCompressor(level=1).compress(memoryview(sink.getvalue()))


def from_bytes(data: memoryview | bytes) -> pa.RecordBatch:
    raw = zstandard.ZstdDecompressor().decompressobj().decompress(data)
    with pa.ipc.open_stream(raw) as rows:
        return rows.read_all().combine_chunks().to_batches()[0]


def pack(rows: DataFrame, text: str) -> DataFrame:
    """(block, size, rows): ``rows`` in blocks of about ``BLOCK_BYTES`` of text, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        held: list[pa.RecordBatch] = []
        size = count = 0

        def out() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([size], pa.int64()), pa.array([to_bytes(whole)], pa.binary())], ["block", "size", "rows"])

        for batch in batches:
            for at in range(0, batch.num_rows, 1 << ROW_BITS):
                for piece, data, _ in chunks(batch.slice(at, 1 << ROW_BITS), text, BLOCK_BYTES // 4):
                    if held and (size + len(data) > BLOCK_BYTES or count + piece.num_rows > 1 << ROW_BITS):
                        yield out()
                        block, held, size, count = block + 1, [], 0, 0
                    held.append(piece)
                    size, count = size + len(data), count + piece.num_rows
        if held:
            yield out()

    return durable(rows.transform(batchwise, run, "block long, size long, rows binary"))


def volume(blocks: DataFrame) -> int:
    """Bytes of all texts."""
    return int(blocks.select(F.coalesce(F.sum("size"), F.lit(0))).first()[0])


# --- sorted numbers as bytes


def pack_sorted(x: np.ndarray) -> bytes:
    """Sorted numbers by Golomb-Rice coded gaps: count, parameter, unary parts, low parts."""
    if not len(x):
        return b""
    gap = np.diff(x.astype(np.int64), prepend=0)
    k = max(0, int(np.log2(max(1.0, float(x[-1]) / len(x)))))
    high = np.cumsum((gap >> k) + 1)
    unary = np.zeros(int(high[-1]), bool)
    unary[high - 1] = True
    low = (gap[:, None] >> np.arange(k)) & 1 if k else np.zeros((len(x), 0), np.int64)
    return np.array([len(x), k], np.int64).tobytes() + np.packbits(unary).tobytes() + np.packbits(low.astype(bool)).tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.int64)
    n, k = np.frombuffer(data, np.int64, 2).tolist()
    bits = -(-n * k // 8)
    raw = np.frombuffer(data, np.uint8, offset=16)
    high = np.diff(np.flatnonzero(np.unpackbits(raw[: len(raw) - bits])), prepend=-1) - 1
    low = np.unpackbits(raw[len(raw) - bits :], count=n * k).reshape(n, k)
    value = high.astype(np.int64) << k
    for j in range(k):
        value += low[:, j].astype(np.int64) << j
    return np.cumsum(value)


# --- the sketch


class Cells:
    """How identities map to cells, and cells to ranges, for so many identities and blocks."""

    def __init__(self, expected: int, blocks: int) -> None:
        self.bits = max(16, int(LOAD * expected - 1).bit_length() if expected else 16)
        dense = int(LOAD * DENSE * max(1, blocks) - 1).bit_length()
        self.range_bits = min(self.bits, max(RANGE.bit_length() - 1, dense), WIDEST.bit_length() - 1)

    def of(self, h: np.ndarray) -> np.ndarray:
        return h >> np.uint64(64 - self.bits)

    def split(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges that sorted cells fall into, and the bounds of each."""
        part = cells >> np.uint64(self.range_bits)
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
        return part[first].astype(np.int64), np.append(first, len(part))


def counted(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and their counts."""
    h = np.sort(h)
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    return h[first], np.diff(np.append(first, len(h)))


def order_of(x: np.ndarray, bits: int) -> np.ndarray:
    """Stable order of numbers below 2**``bits``; sorting number and place in one is several times faster."""
    places = max(1, len(x) - 1).bit_length()
    if bits + places > 64:
        return np.argsort(x, kind="stable")
    both = np.sort(x << np.uint64(places) | np.arange(len(x), dtype=np.uint64))
    return (both & np.uint64((1 << places) - 1)).astype(np.int64)


def level_of(count: np.ndarray) -> np.ndarray:
    """Counts on a scale of quarters of a factor of two: 0 is one, 4 is two."""
    return np.minimum(255, np.round(4 * np.log2(np.maximum(count, 1)))).astype(np.uint8)


def partial_sketch(cells: Cells, block: int, h: np.ndarray) -> pa.RecordBatch:
    """(part, block, cells, again, counts) of each range that a block's identities fall into."""
    distinct, count = counted(cells.of(h))
    parts, bounds = cells.split(distinct)
    inner = np.uint64((1 << cells.range_bits) - 1)
    rows = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        again = np.flatnonzero(count[a:b] > 1)
        rows.append((pack_sorted(distinct[a:b] & inner), pack_sorted(again), count[a:b][again].astype(np.uint32).tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(np.full(len(parts), block), pa.int64()), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(3))], ["part", "block", "cells", "again", "counts"])


def merge_range(cells: Cells, messages: list[tuple[int, bytes, bytes, bytes]]) -> Iterator[tuple[int, np.ndarray]]:
    """(block, levels of the merged counts at its cells) of one range."""
    at, counts = [], []
    for _, packed, again, many in messages:
        at.append(unpack_sorted(packed).astype(np.uint32))
        counts.append((unpack_sorted(again), np.frombuffer(many, np.uint32)))
    levels = [np.zeros(len(x), np.uint8) for x in at]
    step = min(RANGE, 1 << cells.range_bits)
    total = np.zeros(step, np.uint32)
    for low in range(0, 1 << cells.range_bits, step):
        bounds = [np.searchsorted(x, (low, low + step)) for x in at]
        total[:] = 0
        for x, (a, b), (again, many) in zip(at, bounds, counts, strict=True):
            more = np.ones(b - a, np.uint32)
            inside = slice(*np.searchsorted(again, (a, b)))
            more[again[inside] - a] = many[inside]
            total[x[a:b] - np.uint32(low)] += more
        for x, (a, b), out in zip(at, bounds, levels, strict=True):
            out[a:b] = level_of(total[x[a:b] - np.uint32(low)])
    for (block, *_), out in zip(messages, levels, strict=True):
        yield block, out


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Messages (all columns but the first) of each value of the first column, by which they are sorted."""
    part, held = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for p, *row in zip(*columns, strict=True):
            if p != part and held:
                yield part, held
                held = []
            part = p
            held.append(tuple(row))
    if held:
        yield part, held


def estimates(blocks: DataFrame, identities: Callable[[pa.RecordBatch], np.ndarray], cells: Cells) -> DataFrame:
    """(block, levels): for every block the merged levels of its sorted distinct cells, compressed.

    ``identities`` gives the 64-bit identities of a block's rows.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield partial_sketch(cells, block, identities(from_bytes(rows.as_buffer())))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, messages in by_part(batches):
            squeeze = zstandard.ZstdCompressor(level=1)
            for block, levels in merge_range(cells, messages):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([part], pa.int64()), pa.array([squeeze.compress(levels)], pa.binary())], ["block", "part", "levels"])

    messages = blocks.select("block", "rows").transform(batchwise, sketch, "part long, block long, cells binary, again binary, counts binary")
    replies = messages.repartition("part").sortWithinPartitions("part").transform(batchwise, merge, "block long, part long, levels binary")
    return replies.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("part", "levels"))).alias("levels"))


def read_levels(replies: list[dict] | None) -> np.ndarray:
    """Levels of a block's sorted distinct cells from its replies."""
    loose = zstandard.ZstdDecompressor()
    found = [np.frombuffer(loose.decompress(r["levels"]), np.uint8) for r in replies or []]
    return np.concatenate(found) if found else np.zeros(0, np.uint8)


def levels_at(cells: Cells, h: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The level of each identity of a block."""
    c = cells.of(h)
    order = order_of(c, cells.bits)
    new = np.zeros(len(c), np.int64)
    new[1:] = c[order[1:]] != c[order[:-1]]
    out = np.empty(len(c), np.uint8)
    out[order] = levels[np.cumsum(new)]
    return out
