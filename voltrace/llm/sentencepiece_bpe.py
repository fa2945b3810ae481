"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A batch's text is cut into segments at the start of every run of spaces. That
is exact because no piece of such a vocabulary holds a word mark after another
character (checked when the model is read). Equal segments of a batch are
merged once. All segments merge together in rounds on flat numpy arrays: the
best pair rank of each segment by a segmented minimum, all its leftmost pairs
of that rank merged at once, then compaction of the arrays; segments in which
no pair remains leave. A merge that makes a pair as good as the round's own
ends the round for its segment, for the library would take that pair next; so
the order of merges is the library's. Long segments are first cut between
characters that no piece has next to each other, across which nothing merges.

Edge cases: null and empty texts give no ids and an empty decoded text;
characters outside the vocabulary become byte pieces; other columns are kept;
equal ranks merge from the left; texts and unbroken strings of any length are
encoded whole; repeated rows give repeated results; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .textkernel import HASH, batchwise, chunks, code_points

MARK = "▁"
#: Segments with more characters than this are cut where nothing can merge; shorter ones aren't worth the search.
LONG_SEGMENT = 64
#: Bytes of text merged at once: larger pieces share more equal segments.
CHUNK = 2 << 20
_NONE = np.int32(2**31 - 1)


@dataclass(frozen=True)
class BpeTables:
    """A model's vocabulary as arrays. Symbols below ``unknown`` are piece ids."""

    keys: np.ndarray  # sorted left * unknown + right
    ranks: np.ndarray
    merged: np.ndarray
    chars: np.ndarray  # sorted code points that are pieces
    char_ids: np.ndarray
    byte_ids: np.ndarray
    piece_bytes: np.ndarray
    piece_off: np.ndarray
    inner: np.ndarray  # sorted pairs of characters that are neighbours in a piece
    unknown: int


def read_model(path: str) -> BpeTables:
    """Tables of a SentencePiece BPE model file with byte fallback and identity normalisation."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm = model.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix or not model.trainer_spec.byte_fallback:
        raise ValueError("only byte-fallback BPE models with identity normalisation and a leading word mark are supported")
    plain = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
    if any(p.type in (4, 5) for p in model.pieces):
        raise ValueError("models with user-defined or unused pieces are not supported")
    if any(c not in plain for p in plain for c in p) or any(MARK in p.lstrip(MARK) for p in plain):
        raise ValueError("a piece has a character that is no piece, or an inner word mark")
    order = {s: k for k, s in enumerate(sorted({model.pieces[i].score for i in plain.values()}, reverse=True))}
    n = len(model.pieces)
    pairs = [(plain[p[:k]] * n + plain[p[k:]], order[model.pieces[i].score], i) for p, i in plain.items() for k in range(1, len(p)) if p[:k] in plain and p[k:] in plain]
    pairs.sort()
    single = sorted((0x20 if p == MARK else ord(p), i) for p, i in plain.items() if len(p) == 1)
    text = [b""] * n
    byte_ids = np.zeros(256, np.int32)
    for i, p in enumerate(model.pieces):
        if p.type == 1:
            text[i] = p.piece.replace(MARK, " ").encode()
        elif p.type == 6:
            value = int(p.piece[1:-1], 16)
            text[i], byte_ids[value] = bytes([value]), i
    return BpeTables(
        *(np.array([x[k] for x in pairs], t) for k, t in enumerate((np.int64, np.int32, np.int32))),
        np.array([c for c, _ in single], np.int64),
        np.array([i for _, i in single], np.int32),
        byte_ids,
        np.frombuffer(b"".join(text), np.uint8),
        np.concatenate(([0], np.cumsum([len(x) for x in text]))),
        np.array(sorted({plain[a] * n + plain[b] for p in plain for a, b in zip(p, p[1:], strict=False)}), np.int64),
        n,
    )


def take_runs(flat: np.ndarray, off: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``which`` of ``flat`` one after another, and their lengths."""
    size = off[which + 1] - off[which]
    base = np.cumsum(size) - size
    return flat[np.repeat(off[which] - base, size) + np.arange(int(size.sum()))], size


def _pairs(t: BpeTables, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank and merged piece of each pair; no rank where it isn't in the vocabulary."""
    key = left.astype(np.int64) * t.unknown + right
    at = np.minimum(np.searchsorted(t.keys, key), len(t.keys) - 1)
    hit = (t.keys[at] == key) & (left < t.unknown) & (right < t.unknown)
    return np.where(hit, t.ranks[at], _NONE), t.merged[at]


def _cut_long(t: BpeTables, sym: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """Segments, with long ones cut between characters that are neighbours in no piece."""
    sizes = np.bincount(seg) if len(seg) else np.zeros(0, np.int64)
    at = np.flatnonzero((sizes > LONG_SEGMENT)[seg[1:]] & (seg[1:] == seg[:-1]))
    key = sym[at].astype(np.int64) * t.unknown + sym[at + 1]
    known = t.inner[np.minimum(np.searchsorted(t.inner, key), len(t.inner) - 1)] == key
    cut = np.concatenate(([0], seg[1:] != seg[:-1])).astype(np.int64) if len(seg) else np.zeros(0, np.int64)
    cut[at[~known | (sym[at] == t.unknown) | (sym[at + 1] == t.unknown)] + 1] = 1
    return np.cumsum(cut)


def _together(t: BpeTables, at: np.ndarray, best: np.ndarray, cur: np.ndarray, own: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Of the places of their segments' best rank those to merge in this round."""
    if (own[at[1:]] != own[at[:-1]]).all():
        return at
    # of overlapping pairs every other one, from the left
    chained = np.concatenate(([False], (at[1:] == at[:-1] + 1) & (own[at[1:]] == own[at[:-1]])))
    start = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
    at = at[(np.arange(len(at)) - start) % 2 == 0]
    group = own[at]
    first = np.concatenate(([True], group[1:] != group[:-1]))
    if first.all():
        return at
    many = np.flatnonzero(~(first & np.append(first[1:], True)))  # in segments with several places
    p, m = at[many], new[at[many]]
    same = np.concatenate(([False], (p[1:] == p[:-1] + 2) & (own[p[1:]] == own[p[:-1]])))
    left = np.where(same, np.concatenate((m[:1], m[:-1])), cur[np.maximum(p - 1, 0)])
    has_left = (p > 0) & (own[np.maximum(p - 1, 0)] == own[p])
    after = np.minimum(p + 2, len(cur) - 1)
    has_right = (p + 2 < len(cur)) & (own[after] == own[p])
    limit = best[p]
    stops = (has_left & (_pairs(t, left, m)[0] <= limit)) | (has_right & (_pairs(t, m, cur[after])[0] <= limit))
    if not stops.any():
        return at
    before = np.cumsum(stops) - stops
    head = np.maximum.accumulate(np.where(first[many], np.arange(len(many)), 0))
    keep = np.ones(len(at), bool)
    keep[many[before > before[head]]] = False
    return at[keep]


def merge_segments(t: BpeTables, sym: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """Merge symbols within segments until no pair remains.

    ``sym`` gets the merged pieces in place; returns the kept positions in order.
    """
    done = []
    pos = np.arange(len(sym))
    cur, own = sym.copy(), _cut_long(t, sym, seg)
    rank = np.full(len(pos), _NONE, np.int32)
    new = np.zeros(len(pos), np.int32)
    if len(pos) > 1:
        inner = np.flatnonzero(own[1:] == own[:-1])
        rank[inner], new[inner] = _pairs(t, cur[inner], cur[inner + 1])
    while len(pos):
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        size = np.diff(np.append(first, len(pos)))
        best = np.minimum.reduceat(rank, first)
        if (best == _NONE).any():
            out = np.repeat(best == _NONE, size)
            sym[pos[out]] = cur[out]
            done.append(pos[out])
            stay = ~out
            pos, cur, own, rank, new = pos[stay], cur[stay], own[stay], rank[stay], new[stay]
            size, best = size[best != _NONE], best[best != _NONE]
        if not len(pos):
            break
        best = np.repeat(best, size)
        at = _together(t, np.flatnonzero(rank == best), best, cur, own, new)
        cur[at] = new[at]
        stay = np.ones(len(pos), bool)
        stay[at + 1] = False
        at = at - np.arange(len(at))  # of the merged symbols after compaction: one goes for each earlier merge
        pos, cur, own, rank, new = pos[stay], cur[stay], own[stay], rank[stay], new[stay]
        for left in (at, at[at > 0] - 1):
            ok = left + 1 < len(pos)
            ok[ok] = own[left[ok]] == own[left[ok] + 1]
            rank[left] = _NONE
            rank[left[ok]], new[left[ok]] = _pairs(t, cur[left[ok]], cur[left[ok] + 1])
        # a pair across a border never has a rank, so segments stay apart
    return np.sort(np.concatenate(done)) if done else np.zeros(0, np.int64)


def encode_segments(t: BpeTables, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of UTF-8 segments (spaces stand for word marks), and their offsets."""
    lead, size, code = code_points(data)
    if not len(lead):
        return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
    at = np.minimum(np.searchsorted(t.chars, code), len(t.chars) - 1)
    sym = np.where(t.chars[at] == code, t.char_ids[at], t.unknown).astype(np.int32)
    seg = np.searchsorted(off, lead, "right") - 1
    kept = merge_segments(t, sym, seg)
    sym, seg, lead, size = sym[kept], seg[kept], lead[kept], size[kept]
    odd = sym == t.unknown
    many = np.where(odd, size, 1)
    ids = np.repeat(sym, many)
    if odd.any():
        inner = np.arange(len(ids)) - np.repeat(np.cumsum(many) - many, many)
        byte = np.repeat(odd, many)
        ids[byte] = t.byte_ids[data[np.repeat(lead, many)[byte] + inner[byte]]]
    counts = np.bincount(seg, many, len(off) - 1).astype(np.int64)
    return ids, np.concatenate(([0], np.cumsum(counts)))


def encode_chunk(t: BpeTables, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids and decoded bytes of the documents of a chunk, each with offsets."""
    n = len(off) - 1
    full = np.diff(off) > 0
    # the leading word mark of every text that isn't empty
    starts = off[:-1][full]
    data = np.insert(data, starts, 0x20)
    off = off + np.concatenate(([0], np.cumsum(full)))
    space = data == 0x20
    head = space.copy()
    head[1:] &= ~space[:-1]
    head[off[:-1][full]] = True
    start = np.flatnonzero(head)
    end = np.append(start[1:], len(data))[: len(start)]
    names = HASH.spans(data, start, end)
    codes, _ = pd.factorize(names)
    unique = int(codes.max()) + 1 if len(codes) else 0
    first = np.zeros(unique, np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    raw, size = take_runs(data, np.append(start, len(data)), first)
    ids, ids_off = encode_segments(t, raw, np.concatenate(([0], np.cumsum(size))))
    text, text_size = take_runs(t.piece_bytes, t.piece_off, ids)
    text_off = np.concatenate(([0], np.cumsum(text_size)))[ids_off]
    seg_first = np.searchsorted(start, off)
    all_ids, id_size = take_runs(ids, ids_off, codes)
    doc_ids = np.concatenate(([0], np.cumsum(id_size)))[seg_first]
    out, out_size = take_runs(text, text_off, codes)
    doc_out = np.concatenate(([0], np.cumsum(out_size)))[seg_first]
    has = np.diff(doc_out) > 0
    out = np.delete(out, doc_out[:-1][has])  # decoding takes the leading mark away
    doc_out = doc_out - np.concatenate(([0], np.cumsum(has)))
    assert len(doc_ids) == n + 1
    return all_ids, doc_ids, out, doc_out


def encode_decode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with piece ids of every whole text and the text decoded from them.

    No begin or end ids, no sampling. ``text`` is dropped from the result (it
    can be kept under another name); clashing ``ids`` or ``decoded`` columns
    are replaced.
    """
    spark = docs.sparkSession
    tables = spark.sparkContext.broadcast(read_model(model_path))  # bounded by the vocabulary
    rest = [c for c in docs.columns if c not in (text, ids, decoded)]
    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False), T.StructField(decoded, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            if pa.compute.any(pa.compute.match_substring(column, MARK)).as_py():
                batch = batch.set_column(batch.schema.get_field_index(text), text, pa.compute.replace_substring(column, MARK, " "))
            for piece, data, off in chunks(batch, text, CHUNK):
                got, got_off, out, out_off = encode_chunk(t, data, off)
                arrays = [piece.column(piece.schema.get_field_index(c)) for c in rest]
                arrays += [pa.ListArray.from_arrays(pa.array(got_off, pa.int32()), pa.array(got, pa.int32())), pa.StringArray.from_buffers(len(off) - 1, pa.py_buffer(out_off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(out)))]
                yield pa.RecordBatch.from_arrays(arrays, [*rest, ids, decoded])

    return docs.select(*rest, text).transform(batchwise, run, schema)
