"""Exact similarity join on word shingles with grouped prefixes.

A document's set holds its distinct shingles of ``size`` words (the whole
sequence if it has fewer). Documents link when their sets' Jaccard similarity
is at least ``percent`` / 100; the result names for each document its set size
and the least id of its connected component.

1. Rows with equal sets are one class, found by a 128-bit set identity.
2. Shingles get a fixed global order: by their document frequency as a merged
   count-min sketch estimates it (``sketch``), then by hash. Any fixed order is
   right; this one keeps frequent passages out of prefixes. Two sets that link
   share a shingle within their prefixes, of ``n - ceil(percent * n / 100) + 1``
   shingles, and one estimated to occur once can't be shared, so only the
   others are indexed.
3. Classes with the same size and the same prefix form a group. Groups are
   indexed by prefix shingle; pairs of groups pass a size filter and a
   positional filter, and only then expand to their members, which are verified
   on their real sets.
4. Links are only needed as far as they connect. The members of a group are
   first held against one of them, its representative; then in ``PIVOT_ROUNDS``
   rounds each group's representative against that of one other group, with
   which it shares most shingles. Verified links give components. Then all that
   is still apart follows: pairs of groups that share a shingle, unless all
   their members are in one component. After that no pair that could link is
   untested, and no similarity group was expanded to all its pairs.

Edge cases: null or empty texts have no set, link with nothing and are their
own component; rows with a null id get their size, link with nothing and have
a null component; equal rows are in one component, and so are rows of equal
similarity (ties need no order); rows with equal ids and unequal texts are
judged each; texts of any length are taken whole; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sketch
from .components import connected_components, durable
from .textkernel import HASH, HASH_2, LOWER_AZ, as_long, batchwise, chunks, mix, window_starts, words_of

SIZE = 5
PERCENT = 80
#: Buckets of the filter on documents whose texts a round needs.
SPOTS = 1 << 20
#: Rounds in which groups are held against pivots only.
PIVOT_ROUNDS = 2
_U = np.uint64


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle identities of each document, flat, and offsets."""
    w = words_of(data, off, fold=LOWER_AZ)
    at, doc = window_starts(w.first, size)
    h = HASH.windows(w.hash, size)[at]
    count = np.bincount(doc, minlength=len(off) - 1)
    ends = np.cumsum(count)
    words = np.diff(w.first)
    out: list[np.ndarray] = []
    for k in range(len(off) - 1):
        if count[k]:
            s = np.sort(h[ends[k] - count[k] : ends[k]])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif words[k]:
            out.append(np.array([HASH.run(w.hash[w.first[k] : w.first[k + 1]])], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate(([0], np.cumsum([len(x) for x in out]))).astype(np.int64)


def _set_identity(flat: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent order-free identities of each set."""
    out = []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(flat ^ _U(salt)))))
        out.append(mix(run[off[1:]] - run[off[:-1]] + np.diff(off).astype(np.uint64)))
    return out[0], out[1]


def prefix_length(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return n - -(-n * percent // 100) + 1


def block_sets(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of a block's rows, flat, with offsets; both identities of each set; and the rows that stand for the sets of the block."""
    flats, sizes = [], []
    for _, data, off in chunks(batch):
        flat, at = shingle_sets(data, off, size)
        flats.append(flat)
        sizes.append(np.diff(at))
    flat, at = np.concatenate(flats), np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype(np.int64)
    s1, s2 = _set_identity(flat, at)
    able = np.flatnonzero((np.diff(at) > 0) & np.array(batch.column(0).is_valid()))
    order = able[np.lexsort((s2[able], s1[able]))]
    new = np.ones(len(order), bool)
    new[1:] = (s1[order[1:]] != s1[order[:-1]]) | (s2[order[1:]] != s2[order[:-1]])
    return flat, at, s1, s2, np.sort(order[new])


def _flat_of(flat: np.ndarray, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    size = at[rows + 1] - at[rows]
    base = np.cumsum(size) - size
    return flat[np.repeat(at[rows] - base, size) + np.arange(int(size.sum()))]


def _index(known: DataFrame, cells: sketch.Cells, size: int, percent: int) -> DataFrame:
    """(x, y, n, s1, s2, g1, g2, entry).

    A document's row: id, text key, set size, set identity, and the identity of
    its group if it stands for its set in its block. An entry's row: shingle,
    position and weight (see ``_entries``), set size, and group.
    """
    names = ["x", "y", "n", "s1", "s2", "g1", "g2", "entry"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed, replies in zip(*batch.columns, strict=True):
                rows = sketch.from_bytes(packed.as_buffer())
                flat, at, s1, s2, picked = block_sets(rows, size)
                n = np.diff(at)
                mine = _flat_of(flat, at, picked)
                level = sketch.levels_at(cells, mine, sketch.read_levels(replies.as_py()))
                rank = (level.astype(np.uint64) << _U(56)) | (mine >> _U(8))
                ends = np.cumsum(n[picked])
                g1, g2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                toks, own, places = [], [], []
                seen: set[tuple[int, int]] = set()
                for k, b in zip(picked.tolist(), ends.tolist(), strict=True):
                    a = b - int(n[k])
                    p = int(prefix_length(n[k], percent))
                    r = rank[a:b]
                    top = np.argpartition(r, p - 1)[:p] if p < b - a else np.arange(b - a)
                    top = top[np.lexsort((mine[a:b][top], r[top]))]
                    chosen = mine[a:b][top]
                    g1[k], g2[k] = HASH.run(np.append(chosen, _U(b - a))), HASH_2.run(np.append(chosen, _U(b - a)))
                    group = (int(g1[k]), int(g2[k]))
                    if group not in seen:
                        seen.add(group)
                        shared = np.flatnonzero(level[a:b][top])
                        toks.append(chosen[shared])
                        own.append(np.full(len(shared), k))
                        places.append(shared << 10 | 1000 * len(shared) // p)
                none = np.ones(len(n), bool)
                none[picked] = False
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(n, pa.int64()), as_long(s1), as_long(s2), *(pa.array(g.view(np.int64), pa.int64(), mask=none) for g in (g1, g2)), pa.array(np.zeros(len(n), bool))], names
                )
                tok, j, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (toks, own, places))
                if len(tok):
                    yield pa.RecordBatch.from_arrays([as_long(tok), pa.array(place, pa.int64()), pa.array(n[j], pa.int64()), *(pa.nulls(len(j), pa.int64()),) * 2, as_long(g1[j]), as_long(g2[j]), pa.array(np.ones(len(j), bool))], names)

    return known.select("rows", "levels").transform(batchwise, run, "x long, y long, n long, s1 long, s2 long, g1 long, g2 long, entry boolean")


def _verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that link, verified on whole sets.

    The texts of the classes in a pair are joined to it; for a class in very
    many pairs the join is split by adaptive execution.
    """
    spot = F.pmod(F.xxhash64("doc", "key"), F.lit(SPOTS))
    wanted = durable(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes.select("node", "doc", "key"), "node"))
    # most documents are in no pair; a table of at most SPOTS numbers keeps their texts out of the shuffle
    near = docs.withColumn("spot", spot).join(F.broadcast(wanted.select(spot.alias("spot")).distinct()), "spot", "left_semi")
    texts = durable(near.join(wanted, ["doc", "key"]).select("node", "text").dropDuplicates(["node"]))
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[int, np.ndarray] = {}
        held = 0
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = np.zeros(len(a), bool)
            for k in range(len(a)):
                sets = []
                for node, column in ((a[k], 2), (b[k], 3)):
                    if node not in cache:
                        raw = np.frombuffer(batch.column(column)[k].as_buffer(), np.uint8)
                        if held > 4_000_000:
                            cache, held = {}, 0
                        cache[node] = shingle_sets(raw, np.array([0, len(raw)]), size)[0]
                        held += len(cache[node])
                    sets.append(cache[node])
                x, y = sets
                both_of = np.concatenate((x, y))
                both_of.sort(kind="stable")
                common = int((both_of[1:] == both_of[:-1]).sum())
                keep[k] = 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    return durable(both.select("a", "b", "text_a", "text_b").transform(batchwise, run, "a long, b long"))


def _close(percent: int, n_a: str, n_b: str, pos_a: str, pos_b: str) -> Column:
    """Sizes and positions of a common shingle with which a pair can still link."""
    need = F.ceil(F.lit(percent) * (F.col(n_a) + F.col(n_b)) / F.lit(100.0 + percent))
    return (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & (F.least(F.col(n_a) - F.col(pos_a), F.col(n_b) - F.col(pos_b)) >= need)


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _labelled(docs: DataFrame, size: int, percent: int, text: str, doc_id: str) -> DataFrame:
    """(doc, key, n, component, component_id) of every row; ``component`` is null without an id or words."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(text).alias("key"), F.col(text).alias("text"))
    blocks = sketch.pack(source, "text")
    cells = sketch.Cells(sketch.volume(blocks) // 6, blocks.count())

    def shingles(rows: pa.RecordBatch) -> np.ndarray:
        flat, at, _, _, picked = block_sets(rows, size)
        return _flat_of(flat, at, picked)

    known = blocks.select("block", "rows").join(sketch.estimates(blocks, shingles, cells), "block", "left")
    index = durable(_index(known, cells, size, percent))
    rows = index.where("NOT entry").select(F.col("x").alias("doc"), F.col("y").alias("key"), "n", "s1", "s2", "g1", "g2")

    # classes get numbers; a group goes by that of its representative
    stands = rows.where("g1 IS NOT NULL").groupBy("s1", "s2").agg(F.min(F.struct("doc", "key")).alias("d"), F.first("n").alias("n"), F.first("g1").alias("g1"), F.first("g2").alias("g2"))
    classes = durable(stands.select(F.monotonically_increasing_id().alias("node"), "s1", "s2", "d.doc", "d.key", "n", "g1", "g2"))
    groups = durable(classes.groupBy("g1", "g2").agg(F.min("node").alias("gid"), F.count("*").alias("members")))
    members = durable(classes.select("node", "g1", "g2").join(groups.where("members > 1").select("g1", "g2", "gid"), ["g1", "g2"], "left").select("node", F.coalesce("gid", "node").alias("gid")))
    entries = index.where("entry").groupBy(F.col("x").alias("tok"), "g1", "g2").agg(F.first("n").alias("n"), F.min(F.shiftright("y", 10)).alias("pos"), F.min(F.col("y").bitwiseAND(1023)).alias("w"))
    shared = entries.groupBy("tok").agg(F.count("*").alias("groups")).where("groups > 1")
    entries = durable(entries.join(shared.select("tok"), "tok").join(groups.select("g1", "g2", "gid"), ["g1", "g2"]).select("tok", "gid", "n", "pos", "w"))

    # the members of a group against its representative
    tested = durable(members.where("node <> gid").select(F.col("gid").alias("a"), F.col("node").alias("b")))
    links = _verify(tested, classes, source, size, percent)
    for r in range(PIVOT_ROUNDS):
        # each group's representative against that of the one pivot it shares most shingles with
        labels = durable(connected_components(links))
        now = entries.join(labels.withColumnRenamed("node", "gid"), "gid", "left").withColumn("component", F.coalesce("component", "gid"))
        # first the group with the fewest shingles of its own, which is what others are copies of; then any
        order = F.struct("w", "gid") if r == 0 else F.struct(F.xxhash64("gid", F.lit(r)), "gid")
        pivots = now.groupBy("tok").agg(F.max(F.struct(order.alias("o"), "n", "pos", "component")).alias("p"), F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most")
        pivots = pivots.select("tok", F.col("p.o.gid").alias("b"), F.col("p.n").alias("n_b"), F.col("p.pos").alias("pos_b"), F.col("p.component").alias("c_b"))
        near = now.join(pivots, "tok").where((F.col("component") != F.col("c_b")) & _close(percent, "n", "n_b", "pos", "pos_b")).groupBy("gid", "b").agg(F.count("*").alias("k"))
        pairs = _ordered(near.groupBy(F.col("gid").alias("a")).agg(F.max(F.struct("k", "b")).alias("top")).select("a", F.col("top.b").alias("b")))
        pairs = durable(pairs.join(tested, ["a", "b"], "left_anti"))
        links, tested = links.unionAll(_verify(pairs, classes, source, size, percent)), tested.unionAll(pairs)

    # what is still apart, whole: a group is of one component, or mixed
    labels = durable(connected_components(links))
    placed = durable(members.join(labels, "node", "left").select("node", "gid", F.coalesce("component", "node").alias("component")))
    state = placed.groupBy("gid").agg(F.min("component").alias("least"), F.max("component").alias("most")).select("gid", F.when(F.col("least") == F.col("most"), F.col("least")).alias("component"))
    mixed = state.where("component IS NULL").select("gid")
    now = entries.select("tok", "gid", "n", "pos").join(state, "gid")
    sizes = now.groupBy("tok", "component").agg(F.count("*").alias("k"))
    main = sizes.groupBy("tok").agg(F.max(F.struct(F.col("component").isNotNull(), "k", "component")).alias("top"), F.count("*").alias("parts"), F.count_if(F.col("component").isNull()).alias("mixed")).where("parts > 1 OR mixed > 0")
    apart = durable(now.join(main.select("tok", F.col("top.component").alias("main")), "tok"))
    outside = ~F.col("component").eqNullSafe(F.col("main")) | F.col("component").isNull()
    minor = apart.where(outside).select("tok", F.col("gid").alias("g_a"), F.col("n").alias("n_a"), F.col("pos").alias("pos_a"), F.col("component").alias("c_a"))
    other = apart.select("tok", F.col("gid").alias("g_b"), "n", "pos", "component", outside.alias("outside"))
    unlike = F.coalesce(F.col("c_a") != F.col("component"), F.lit(True))
    open_groups = minor.join(other, "tok").where(unlike & (~F.col("outside") | (F.col("g_a") < F.col("g_b"))) & _close(percent, "n_a", "n", "pos_a", "pos"))
    open_groups = open_groups.select("g_a", "g_b").distinct().unionAll(mixed.select(F.col("gid").alias("g_a"), F.col("gid").alias("g_b")))
    side = lambda k: placed.select(F.col("gid").alias(f"g_{k}"), F.col("node").alias(k), F.col("component").alias(f"c_{k}"))
    expanded = open_groups.join(side("a"), "g_a").join(side("b"), "g_b").where("c_a <> c_b")
    last = durable(_ordered(expanded).join(tested, ["a", "b"], "left_anti"))
    links = links.unionAll(_verify(last, classes, source, size, percent))

    final = classes.select("s1", "s2", "node", "doc").join(connected_components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = final.groupBy("component").agg(F.min("doc").alias("component_id"))
    by_class = final.join(names, "component").select("s1", "s2", "component", "component_id")
    # rows without words or id are in no class, and don't meet in the join
    able = rows.where("n > 0 AND doc IS NOT NULL").join(by_class, ["s1", "s2"]).select("doc", "key", "n", "component", "component_id")
    return able.unionAll(rows.where("n = 0 OR doc IS NULL").select("doc", "key", "n", F.lit(None).cast("long"), F.col("doc")))


def join_components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id) of every row; ``text_key`` is xxhash64 of the text."""
    return _labelled(docs, size, percent, text, doc_id).select(F.col("doc").alias(doc_id), F.col("key").alias("text_key"), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each component: that of the least id, and of the least text key among equal ids.

    Of rows with the same id and text that of the least hash over all columns
    stays. Rows without an id or without words all stay.
    """
    found = durable(_labelled(docs, size, percent, text, doc_id))
    best = found.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("doc", "key")).alias("m"))
    chosen = best.select(F.col("m.doc").alias("__id"), F.col("m.key").alias("__key"), F.lit(True).alias("__one"))
    free = found.where("component IS NULL AND doc IS NOT NULL").select(F.col("doc").alias("__id"), F.col("key").alias("__key"), F.lit(False).alias("__one")).distinct()
    keyed = docs.withColumn("__key", F.xxhash64(text)).withColumn("__id", F.col(doc_id).cast("long"))
    first = F.row_number().over(Window.partitionBy("__id", "__key").orderBy(F.xxhash64(*docs.columns)))
    kept = keyed.join(chosen.unionAll(free), ["__id", "__key"]).withColumn("__row", first).where("NOT __one OR __row = 1")
    return kept.select(*docs.columns).unionAll(docs.where(F.col(doc_id).cast("long").isNull()))
