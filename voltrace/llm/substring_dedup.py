"""Removal of passages that repeat across documents, with a count-min prefilter.

Words are runs of anything but ASCII white space; a window is ``size``
consecutive words. A window is a repeat if its word sequence also starts in a
document with a smaller id; every word that a repeat covers is removed.

1. Texts are packed into blocks, and each block sketches its window identities.
   The merged count-min sketch overestimates their counts, so no repeat is lost
   (``sketch``); every block gets the estimates of its own windows back.
2. Only windows estimated to occur twice go on. A block sends each of them once,
   as a 96-bit identity with the least id that has it in the block, to the task
   of its range of identities. That task groups them exactly and answers which
   of them start in a smaller document of another block.
3. The answers return to their blocks, and the covered words are dropped.

Blocks carry all columns, so results need no join with ``docs``. A window of
any number of documents reaches its group as one entry a block, so no group
outgrows a task however often its text is copied.

Edge cases: null and empty texts have no words; a null id neither counts nor
loses words; rows with equal ids and unequal texts are judged each, rows that
repeat whole get equal results; texts shorter than a window stay whole, texts
of any length are taken whole; clashing result columns are replaced, others
kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sketch
from .sentencepiece_bpe import take_runs
from .textkernel import HASH, HASH_2, Words, batchwise, chunks, find_words, window_starts

SIZE = 13
#: Names of the text and the id within a block.
_TEXT, _DOC = "__text", "__doc"


class Scan(NamedTuple):
    """A block's pieces with their words, and its windows: identities, word index in the block, and id."""

    pieces: list[tuple[pa.RecordBatch, np.ndarray, Words]]
    h1: np.ndarray
    h2: np.ndarray
    at: np.ndarray
    doc: np.ndarray


def scan_block(batch: pa.RecordBatch, size: int, second: bool = True) -> Scan:
    """Words and windows of a block; windows of rows without an id are left out."""
    pieces, h1, h2, at, doc = [], [], [], [], []
    words = 0
    for piece, data, off in chunks(batch, _TEXT):
        start, end, first = find_words(data, off)
        w = Words(start, end, HASH.spans(data, start, end), first)
        ids = piece.column(piece.schema.get_field_index(_DOC))
        where, row = window_starts(first, size)
        named = np.array(ids.is_valid())[row]
        where, row = where[named], row[named]
        h1.append(HASH.windows(w.hash, size)[where])
        if second:
            h2.append((HASH_2.windows(HASH_2.spans(data, start, end), size)[where] >> np.uint64(32)).astype(np.uint32))
            at.append(where + words)
            doc.append(ids.fill_null(0).to_numpy()[row])
            pieces.append((piece, data, w))
        words += len(start)
    return Scan(pieces, *(np.concatenate(x) if x else np.zeros(0, t) for x, t in ((h1, np.uint64), (h2, np.uint32), (at, np.int64), (doc, np.int64))))


class Entries(NamedTuple):
    """A block's windows estimated to repeat, in order of identity, and its distinct ones: index of the first, least id."""

    window: np.ndarray
    first: np.ndarray
    least: np.ndarray


def entries_of(s: Scan, levels: np.ndarray) -> Entries:
    may = np.flatnonzero(levels > 0)
    window = may[np.argsort(s.h1[may], kind="stable")]
    h1, h2 = s.h1[window], s.h2[window]
    new = np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))) if len(window) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return Entries(window, first, np.minimum.reduceat(s.doc[window], first) if len(first) else np.zeros(0, np.int64))


def message(s: Scan, e: Entries, block: int, part_bits: int) -> pa.RecordBatch:
    """(part, block, h1, h2, docs, which): the distinct windows of a block for each range of identities."""
    h1, h2 = s.h1[e.window[e.first]], s.h2[e.window[e.first]]
    part = h1 >> np.uint64(64 - part_bits)
    cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
    inner = np.uint64((1 << (64 - part_bits)) - 1)
    rows = []
    for a, b in zip(cut, np.append(cut[1:], len(part)), strict=True):
        docs, which = np.unique(e.least[a:b], return_inverse=True)
        rows.append((sketch.pack_sorted(h1[a:b] & inner), h2[a:b].tobytes(), docs.tobytes(), which.astype(np.uint16 if len(docs) <= 1 << 16 else np.uint32).tobytes()))
    return pa.RecordBatch.from_arrays(
        [pa.array(part[cut].astype(np.int64)), pa.array(np.full(len(cut), block), pa.int64()), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(4))], ["part", "block", "h1", "h2", "docs", "which"]
    )


def group_exactly(messages: list[tuple[int, bytes, bytes, bytes, bytes]]) -> Iterator[tuple[int, bytes]]:
    """(block, bit of each of its entries: a smaller id has the window) of one range."""
    h1 = [sketch.unpack_sorted(m[1]) for m in messages]
    docs = []
    for h, (_, _, _, table, which) in zip(h1, messages, strict=True):
        known = np.frombuffer(table, np.int64)
        docs.append(known[np.frombuffer(which, np.uint16 if len(which) == 2 * len(h) else np.uint32)])
    sizes = [len(h) for h in h1]
    h, g, d = np.concatenate(h1), np.concatenate([np.frombuffer(m[2], np.uint32) for m in messages]), np.concatenate(docs)
    order = np.lexsort((g, h))
    h, g = h[order], g[order]
    first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (g[1:] != g[:-1]))))
    least = np.repeat(np.minimum.reduceat(d[order], first), np.diff(np.append(first, len(h))))
    smaller = np.empty(len(h), bool)
    smaller[order] = least < d[order]
    for (block, *_), bits in zip(messages, np.split(smaller, np.cumsum(sizes)[:-1]), strict=True):
        yield block, np.packbits(bits).tobytes()


def remove_repeats(docs: DataFrame, size: int = SIZE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without ``text`` but with ``n_words``, ``n_removed`` and ``kept`` (the kept words joined by one space)."""
    names = ("n_words", "n_removed", "kept")
    rest = [c for c in docs.columns if c not in (text, *names)]
    blocks = sketch.pack(docs.select(*rest, F.col(text).alias(_TEXT), F.col(doc_id).cast("long").alias(_DOC)), _TEXT)
    cells = sketch.Cells(sketch.volume(blocks) // 6, blocks.count())
    part_bits = max(1, cells.bits - cells.range_bits + 2)
    estimated = sketch.estimates(blocks, lambda rows: scan_block(rows, size, second=False).h1, cells)
    known = blocks.select("block", "rows").join(estimated, "block", "left")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, rows, levels in zip(*batch.columns, strict=True):
                s = scan_block(sketch.from_bytes(rows.as_buffer()), size)
                e = entries_of(s, sketch.levels_at(cells, s.h1, sketch.read_levels(levels.as_py())))
                if len(e.first):
                    yield message(s, e, block.as_py(), part_bits)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, messages in sketch.by_part(batches):
            found = list(group_exactly(messages))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int64()), pa.array([part] * len(found), pa.int64()), pa.array([x for _, x in found], pa.binary())], ["block", "part", "bits"])

    sent = known.transform(batchwise, candidates, "part long, block long, h1 binary, h2 binary, docs binary, which binary").repartition("part").sortWithinPartitions("part")
    answers = sent.transform(batchwise, answer, "block long, part long, bits binary").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("part", "bits"))).alias("answers"))
    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField("n_words", T.LongType(), False), T.StructField("n_removed", T.LongType(), False), T.StructField("kept", T.StringType(), False)])

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, levels, found in zip(*batch.columns, strict=True):
                s = scan_block(sketch.from_bytes(rows.as_buffer()), size)
                e = entries_of(s, sketch.levels_at(cells, s.h1, sketch.read_levels(levels.as_py())))
                gone = covered(s, e, part_bits, found.as_py() or [], size)
                base = 0
                for piece, data, w in s.pieces:
                    yield without(piece, data, w, gone[base : base + len(w.start)], rest, names)
                    base += len(w.start)

    return known.join(answers, "block", "left").select("rows", "levels", "answers").transform(batchwise, drop, schema)


def covered(s: Scan, e: Entries, part_bits: int, answers: list[dict], size: int) -> np.ndarray:
    """Words of a block that a repeat covers."""
    words = sum(len(w.start) for _, _, w in s.pieces)
    begins = np.zeros(words + 1, bool)
    if len(e.first):
        part = s.h1[e.window[e.first]] >> np.uint64(64 - part_bits)
        sizes = np.diff(np.append(np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))), len(part)))
        smaller = np.concatenate([np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=n) for a, n in zip(answers, sizes, strict=True)])
        many = np.diff(np.append(e.first, len(e.window)))
        repeat = np.repeat(smaller.astype(bool), many) | (s.doc[e.window] > np.repeat(e.least, many))
        begins[s.at[e.window[repeat]]] = True
    total = np.concatenate((np.zeros(size, np.int64), np.cumsum(begins[:-1])))
    return total[size:] > total[:-size]


def without(piece: pa.RecordBatch, data: np.ndarray, w: Words, gone: np.ndarray, rest: list[str], names: tuple[str, ...]) -> pa.RecordBatch:
    """The rows of a piece with their remaining words, which are copied with one byte in front of each, a space but for a text's first."""
    start, length = w.start[~gone], (w.end - w.start)[~gone]
    count = np.concatenate(([0], np.cumsum(~gone)))[w.first]
    padded = np.concatenate((np.array([0x20], np.uint8), data))
    idx = np.stack((start, start + length + 1), 1).reshape(-1)
    out, _ = take_runs(padded, np.append(idx, len(padded)), np.arange(0, len(idx), 2))
    at = np.concatenate(([0], np.cumsum(length + 1)))
    out[at[:-1]] = 0x20
    some = np.diff(count) > 0
    out = np.delete(out, at[count[:-1][some]])
    out_off = at[count] - np.concatenate(([0], np.cumsum(some)))
    kept = pa.StringArray.from_buffers(piece.num_rows, pa.py_buffer(out_off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(out)))
    n = np.diff(w.first)
    return pa.RecordBatch.from_arrays([*(piece.column(piece.schema.get_field_index(c)) for c in rest), pa.array(n, pa.int64()), pa.array(n - np.diff(count), pa.int64()), kept], [*rest, *names])
