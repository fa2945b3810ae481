"""Benchmark decontamination with spaced seeds.

Tokens are runs of letters, digits and marks of any script, folded to lower
case, so markup and punctuation around words don't matter; characters of
scripts without spaces are tokens each. A spaced seed is a fixed mask over a
span of tokens; only the tokens under its ones are hashed, so a hit survives
substitutions at the ignored places; short items have short masks, which miss
no stretch that verification would take. Test and training hashes are joined per
batch: a bit table lets few positions through, a sorted lookup settles them.
Around each hit the item and the document are aligned without gaps and the
longest stretch is found in which at least ``AGREE`` of the tokens are equal;
a document is contaminated if such a stretch covers ``COVER`` of the item (or
``LEAST`` tokens of a longer one).

The seed table of the benchmark is broadcast in blocks of at most
``BLOCK_TOKENS`` tokens. A benchmark of one block, as usual, takes one pass
without any shuffle; a larger one takes a pass for each block, so what is
broadcast never grows with either table.

Edge cases: null and empty texts and items match nothing; items of one or two
tokens are matched by a seed of all of them; texts of any length are searched
whole; of equally good stretches the first one found is reported; repeated items
each match; repeated documents each match; extra columns are ignored; a null
document or item id is reported as null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import batchwise, chunks, mix, text_bytes, tokens_of

#: Fixed masks, with the sizes of items that they serve. Of tokens of which a
#: share of 0.8 agrees, the first and last among them, three in a row do from
#: six tokens on, and of five the pairs around the middle or three in a row.
SHORT = 14
MASKS = (("11101001111", SHORT, None), ("110100110111", SHORT, None), ("11010110001111", SHORT, None), ("11111", SHORT, None), ("1011", SHORT, 3 * SHORT), ("111", 3, SHORT - 1), ("11011", 5, 5))
#: Share of equal tokens in a matched stretch.
AGREE = 0.8
#: Share of an item's tokens that a stretch must cover.
COVER = 0.5
#: A stretch of so many tokens counts in an item of any length.
LEAST = 13
#: Shortest stretch that counts at all, unless the item is shorter.
SHORTEST = 8
BLOCK_TOKENS = 2_000_000
_BITS = 1 << 24


@dataclass(frozen=True)
class SeedTable:
    """Seeds of one block of benchmark items."""

    hashes: np.ndarray  # sorted
    item: np.ndarray
    place: np.ndarray
    bits: np.ndarray
    tokens: np.ndarray
    first: np.ndarray
    ids: list[int | None]
    masks: tuple[str, ...]


def seeds(tokens: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """Hash under ``mask`` at each position at which it fits."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, salt + 1, np.uint64)
    for k, use in enumerate(mask):
        if use == "1":
            h = h * np.uint64(0x9E3779B97F4A7C15) + tokens[k : k + n]
    return mix(h)


def build_table(ids: list[int | None], texts: list[str | None]) -> SeedTable:
    data, off = text_bytes(pa.array(texts, pa.string()))
    tokens, first = tokens_of(data, off)
    size = np.diff(first)
    masks = (*MASKS, ("1", 1, 1), ("11", 2, 2))
    hashes, item, place = [], [], []
    for k, (mask, low, high) in enumerate(masks):
        h = seeds(tokens, mask, k)
        at = np.arange(len(h))
        own = np.searchsorted(first, at, "right") - 1
        fits = at + len(mask) <= first[own + 1]
        fits &= (size[own] >= low) & (size[own] <= (high or size[own]))
        hashes.append(h[fits])
        item.append(own[fits])
        place.append((at - first[own])[fits])
    h, item, place = (np.concatenate(x) for x in (hashes, item, place))
    order = np.argsort(h, kind="stable")
    bits = np.zeros(_BITS, bool)
    bits[h & np.uint64(_BITS - 1)] = True
    return SeedTable(h[order], item[order], place[order], bits, tokens, first, ids, tuple(m for m, _, _ in masks))


def best_stretch(equal: np.ndarray, agree: float = AGREE) -> tuple[int, int]:
    """Longest stretch that begins and ends with an equal token and in which at least ``agree`` of the tokens are."""
    gain = np.where(equal, 1 - agree, -agree)
    total = np.concatenate(([0.0], np.cumsum(gain)))
    # ends at j, begins at the first i with total[i] <= total[j]: prefix minima fall, so bisect them
    low = np.minimum.accumulate(total)
    begin = np.searchsorted(-low, -(total + 1e-9), "left")
    size = np.arange(len(total)) - begin
    j = int(np.argmax(size))
    i = int(begin[j])
    if j <= i:
        return 0, 0
    at = np.flatnonzero(equal[i:j])
    return (i + int(at[0]), i + int(at[-1]) + 1) if len(at) else (0, 0)


def _promising(table: SeedTable, tokens: np.ndarray, first: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Pairs (document, item, shift) with as many equal tokens as the shortest stretch that counts must have."""
    doc, item, shift = pairs.T
    size = table.first[item + 1] - table.first[item]
    equal = np.zeros(len(pairs), np.int64)
    for j in range(int(size.max()) if len(size) else 0):
        at = shift + j
        live = np.flatnonzero((j < size) & (at >= first[doc]) & (at < first[doc + 1]))
        equal[live] += tokens[at[live]] == table.tokens[table.first[item[live]] + j]
    need = np.maximum(np.minimum(size, SHORTEST), np.minimum(COVER * size, LEAST))
    return equal >= np.ceil(AGREE * need - 1e-9)


def match(table: SeedTable, tokens: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """(document, item, first token, end, equal tokens, item tokens) of the best stretch for each pair that counts."""
    doc, item, shift = [], [], []
    for k, mask in enumerate(table.masks):
        h = seeds(tokens, mask, k)
        at = np.flatnonzero(table.bits[h & np.uint64(_BITS - 1)])
        a, b = np.searchsorted(table.hashes, h[at], "left"), np.searchsorted(table.hashes, h[at], "right")
        at, a, b = at[b > a], a[b > a], b[b > a]
        own = np.searchsorted(first, at, "right") - 1
        fits = at + len(mask) <= first[own + 1]
        at, a, b, own = at[fits], a[fits], b[fits], own[fits]
        many = b - a
        rows = np.repeat(a, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        doc.append(np.repeat(own, many))
        item.append(table.item[rows])
        shift.append(np.repeat(at, many) - table.place[rows])
    pairs = np.unique(np.stack((np.concatenate(doc), np.concatenate(item), np.concatenate(shift)), 1), axis=0)
    pairs = pairs[_promising(table, tokens, first, pairs)]
    best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    for d, i, s in pairs.tolist():
        a, b = int(table.first[i]), int(table.first[i + 1])
        lo, hi = max(s, int(first[d])), min(s + b - a, int(first[d + 1]))
        equal = tokens[lo:hi] == table.tokens[a + lo - s : a + hi - s]
        x, y = best_stretch(equal)
        size, whole = y - x, b - a
        if size >= min(whole, SHORTEST) and (size >= COVER * whole or size >= LEAST):
            got = (int(equal[x:y].sum()), lo + x - int(first[d]), lo + y - int(first[d]), whole)
            if (d, i) not in best or got[0] > best[(d, i)][0]:
                best[(d, i)] = got
    return [(d, i, x, y, n, whole) for (d, i), (n, x, y, whole) in sorted(best.items())]


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """(doc_id, item_id, first_token, end_token, n_equal, n_item): a row for each document and item that overlap."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(text).alias("text")).where(F.length("text") > 0)
    volume = int(items.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    blocks = max(1, -(-volume // (4 * BLOCK_TOKENS)))
    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    out = None
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).toArrow()
        held = spark.sparkContext.broadcast(build_table(block.column("id").to_pylist(), block.column("text").to_pylist()))
        found = source.transform(batchwise, _scan(held), "doc_id long, item_id long, first_token long, end_token long, n_equal long, n_item long")
        out = found if out is None else out.unionAll(found)
    return out.withColumnsRenamed({"doc_id": doc_id, "item_id": item_id})


def _scan(held):
    names = ["doc_id", "item_id", "first_token", "end_token", "n_equal", "n_item"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in batches:
            for piece, data, off in chunks(batch):
                rows = match(table, *tokens_of(data, off)) if len(table.hashes) else []
                if rows:
                    doc, item, *rest = zip(*rows, strict=True)
                    ids = piece.column(0).take(pa.array(doc))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([table.ids[i] for i in item], pa.int64()), *(pa.array(x, pa.int64()) for x in rest)], names)

    return run


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """``docs`` without the rows that overlap with an item; found row by row, so no join is needed."""
    spark = docs.sparkSession
    found = docs
    items = benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(text).alias("text")).where(F.length("text") > 0)
    volume = int(items.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    blocks = max(1, -(-volume // (4 * BLOCK_TOKENS)))
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).toArrow()
        held = spark.sparkContext.broadcast(build_table(block.column("id").to_pylist(), block.column("text").to_pylist()))
        found = found.transform(batchwise, _keep(held, text), docs.schema)
    return found


def _keep(held, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in batches:
            for piece, data, off in chunks(batch, text):
                keep = np.ones(piece.num_rows, bool)
                for d, *_ in match(table, *tokens_of(data, off)) if len(table.hashes) else []:
                    keep[d] = False
                yield piece.filter(pa.array(keep))

    return run
