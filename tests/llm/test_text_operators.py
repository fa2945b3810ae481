"""Exactness of word hashing, tokenisation, passage removal and similarity against plain Python."""

import hashlib
import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voltrace.llm import components, jaccard_join, sentencepiece_bpe, sketch, substring_dedup, textkernel
from voltrace.llm.queries import default_tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_words_and_windows_equal_where_texts_are():
    texts = ["a bb a bb\nccc", "", None, " é\ta bb  a ", "bb", "x" * 5000]
    data, off = textkernel.text_bytes(pa.array(texts))
    w = textkernel.words_of(data, off)
    flat = [x for t in texts for x in WORD.findall(t or "")]
    assert np.diff(w.first).tolist() == [len(WORD.findall(t or "")) for t in texts]
    assert [bytes(data[a:b]).decode() for a, b in zip(w.start, w.end, strict=True)] == flat
    for i, j in combinations(range(len(flat)), 2):
        assert (w.hash[i] == w.hash[j]) == (flat[i] == flat[j])
    h = textkernel.HASH.windows(w.hash, 2)
    at, doc = textkernel.window_starts(w.first, 2)
    assert doc.tolist() == [0, 0, 0, 0, 3, 3, 3] and h[at][0] == h[at][2] == h[at][5] and h[at][1] == h[at][6]
    assert textkernel.HASH.run(w.hash[:2]) == int(h[0])


def test_chunks_cover_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["ab" * k if k % 7 else None for k in range(100)])], ["text"])
    got = [p.column(0).to_pylist() for p, _, _ in textkernel.chunks(batch, limit=50)]
    assert sum(got, []) == batch.column(0).to_pylist() and len(got) > 5
    assert list(textkernel.chunks(batch.slice(0, 0))) == []


def thue_morse(n):
    x = "a"
    while len(x) < n:
        x += x.translate({97: 98, 98: 97})
    return x[:n]


def test_structured_words_have_unlike_identities():
    for n in (512, 1024, 2048, 4096):
        w = thue_morse(n)
        data, off = textkernel.text_bytes(pa.array([w, w.translate({97: 98, 98: 97}), w[8:16] + w[:8] + w[16:]]))
        for hasher in (textkernel.HASH, textkernel.HASH_2):
            assert len(set(textkernel.words_of(data, off, hasher=hasher).hash.tolist())) == len({w, w.translate({97: 98, 98: 97}), w[8:16] + w[:8] + w[16:]})


def test_sorted_numbers_and_order():
    rng = np.random.default_rng(1)
    for x in ([], [0], [5], [0, 0, 3], [0, 255, 510], np.sort(rng.choice(10**6, 300)), np.sort(rng.integers(0, 1 << 62, 500))):
        x = np.array(x, np.int64)
        assert np.array_equal(sketch.unpack_sorted(sketch.pack_sorted(x)), x)
    h = rng.integers(0, 1 << 20, 999, dtype=np.uint64)
    for bits in (20, 60):
        assert np.array_equal(sketch.order_of(h, bits), np.argsort(h, kind="stable"))


def merged(cells, parts):
    """Levels that each of the identity arrays gets back."""
    messages = {}
    for k, h in enumerate(parts):
        for row in sketch.partial_sketch(cells, k, h).to_pylist():
            messages.setdefault(row["part"], []).append(tuple(row.values())[1:])
    back = {k: [] for k in range(len(parts))}
    for part in sorted(messages):
        for block, levels in sketch.merge_range(cells, messages[part]):
            back[block].append(levels)
    return [sketch.levels_at(cells, h, np.concatenate(back[k]) if back[k] else np.zeros(0, np.uint8)) for k, h in enumerate(parts)]


@pytest.mark.parametrize("step", [1 << 24, 1 << 12])  # one count array a range, or many
def test_sketch_overestimates_and_keeps_filtering(monkeypatch, step):
    monkeypatch.setattr(sketch, "RANGE", step)
    rng = np.random.default_rng(2)
    for n in (1000, 200_000):  # the share of distinct identities that pass doesn't grow with the input
        distinct = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        twice = distinct[: n // 10]
        parts = [*np.array_split(distinct, 7), twice, np.zeros(0, np.uint64), np.repeat(twice[:5], 3)]
        cells = sketch.Cells(n, len(parts))
        got = merged(cells, parts)
        truth = dict(zip(*np.unique(np.concatenate(parts), return_counts=True), strict=True))
        for h, level in zip(parts, got, strict=True):
            assert all(x >= y for x, y in zip(level.tolist(), sketch.level_of(np.array([truth[v] for v in h.tolist()])).tolist(), strict=True))
        alone = np.concatenate(got[:7])[n // 10 :]
        assert (alone > 0).mean() < 0.15


def test_blocks_keep_every_row(spark, docs, monkeypatch):
    monkeypatch.setattr(sketch, "BLOCK_BYTES", 200)
    rows = [(k, "w" * (k % 50)) for k in range(100)] + [(None, None), (100, "x" * 5000)]
    blocks = sketch.pack(docs(rows), "text").collect()
    got = [(r["doc_id"], r["text"]) for b in blocks for r in sketch.from_bytes(b.rows).to_pylist()]
    assert sorted(got, key=str) == sorted(rows, key=str) and len({b.block for b in blocks}) == len(blocks) > 10
    assert sum(b.size for b in blocks) == sum(len(t or "") for _, t in rows)


# --- tokens


def test_tokens_equal_the_library(spark, docs):
    spm = pytest.importorskip("sentencepiece")
    lib = spm.SentencePieceProcessor(model_file=default_tokenizer())
    rng = random.Random(4)
    letters = "ab  \n\tèß漢字😀\x00the ing 0123.,▁-"
    texts = [None, "", " ", "  a", "<s> </s>", "aaaa" * 700, "ab" * 3000, "".join(rng.choice("aeinrst") for _ in range(4000)), "".join(rng.choice("AZaz09+/") for _ in range(4000)), "=" * 999 + "-" * 77, "漢字的是" * 300, "a " * 200 + thue_morse(2048), "b " + thue_morse(2048).translate({97: 98, 98: 97}),  "▁▁x", *("".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(400))]
    got = sentencepiece_bpe.encode_decode(docs(list(enumerate(texts))), default_tokenizer()).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        want = lib.encode(t or "")
        assert list(r.ids) == want and r.decoded == lib.decode(want)
    assert sentencepiece_bpe.encode_decode(docs([]), default_tokenizer()).count() == 0


# --- passages


def removed(rows, size=13):
    """Brute force: n_words, n_removed and kept text of every row."""
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - size + 1):
            if i is not None and first[tuple(w[k : k + size])] < i:
                gone |= set(range(k, k + size))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def test_passages_against_brute_force(docs, prose):
    hot = prose(30, 99)
    rows = [(k, prose(40, k) + (" " + hot if k % 2 else "") + "\n" + prose(20, k + 1000)) for k in range(40)]
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, "a " * 60), (103, "b " + "a " * 40), (104, None), (105, ""), (106, "short text"), (None, rows[5][1]), (107, " ".join(rows[7][1].split()[5:25])), (100, prose(30, 7)), (108, hot + " " + hot)]
    w = thue_morse(2048)  # two long words that a polynomial hash would take for one
    rows += [(200, "a b c d e f g h i j k l " + w), (201, "a b c d e f g h i j k l " + w.translate({97: 98, 98: 97})), (202, prose(30_000, 9)), (203, prose(30_000, 9) + " end")]
    rows += [(300 + k, prose(20, 300)) for k in range(200)]
    rows.append(rows[0])
    got = substring_dedup.remove_repeats(docs(rows))
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()), key=str) == removed(rows)
    assert "ids" in got.columns and substring_dedup.remove_repeats(docs([])).count() == 0


# --- similarity


def component_of(rows, percent=80):
    sets = {}
    for k, (i, t) in enumerate(rows):
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[k] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sets, 2):
        n = len(sets[a] & sets[b])
        if sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            parent[find(a)] = find(b)
    least = defaultdict(list)
    for k in sets:
        least[find(k)].append(rows[k][0])
    return sorted(((rows[k][0], len(sets[k]), None if rows[k][0] is None else min(least[find(k)])) for k in sets), key=str)


def edited(text, edits, seed):
    rng = random.Random(seed)
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)


def test_similarity_against_brute_force(docs, prose):
    base, hot = prose(150, 5), prose(12, 77)
    rows = [(k, edited(base, 1 + k % 5, k)) for k in range(45)]  # about half of these pairs link
    rows += [(100 + k, base) for k in range(5)] + [(200 + k, prose(60, k) + " " + hot) for k in range(20)]
    rows += [(300, "a b c"), (301, "A b C"), (302, "a b d"), (303, None), (304, ""), (305, "  "), (None, base), (306, base.upper()), (307, prose(60, 3) + " " + hot), (300, "a b c")]
    rows += [(400 + k, " ".join(base.split()[: 150 - 8 * k])) for k in range(8)]  # a chain
    got = jaccard_join.join_components(docs(rows))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == component_of(rows)


def test_similarity_of_hard_cases(docs, prose):
    w = thue_morse(2048)
    head = " ".join(f"h{k}" for k in range(8))
    rows = [(1, f"{head} {w}"), (2, f"{head} {w.translate({97: 98, 98: 97})}")]  # unlike only in a long word
    rows += [(10 + k, f"of the in that {k} light") for k in range(300)]  # short, with frequent words
    hot = "this passage is in very many documents that are not alike"
    rows += [(1000 + k, f"{hot} {prose(3, k)}") for k in range(300)]
    chain = [f"c{k}" for k in range(400)]
    rows += [(2000 + k, " ".join(chain[k * 4 : k * 4 + 60])) for k in range(80)]  # each links with the next only
    rows += [(3000, prose(20_000, 11)), (3001, edited(prose(20_000, 11), 50, 1))]
    got = jaccard_join.join_components(docs(rows))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == component_of(rows)


def test_groups_of_equal_prefix(docs):
    # the first shingles in the order are in two texts each, the rest in many: sizes and prefixes agree, the sets don't
    tail = lambda k: " ".join(f"t{(k + j) % 12}" for j in range(14))
    rows = [(100 * g + k, " ".join(f"g{g}x{j}" for j in range(12)) + " " + tail(k)) for g in range(6) for k in range(12)]
    rows += [(5000 + k, tail(k) + " " + tail(k + 3)) for k in range(12) for _ in range(9)]
    got = jaccard_join.join_components(docs(rows))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == component_of(rows)


def test_similarity_of_nothing(docs):
    assert jaccard_join.join_components(docs([])).count() == 0
    assert [(r.doc_id, r.component_id) for r in jaccard_join.join_components(docs([(1, None), (2, "")])).orderBy("doc_id").collect()] == [(1, 1), (2, 2)]


def test_keep_one(docs, prose):
    base = prose(80, 1)
    rows = [(5, base), (3, base), (3, base), (9, edited(base, 1, 2)), (7, prose(80, 2)), (8, None), (None, base), (None, None), (3, ""), (3, None), (3, prose(80, 4)), (8, "")]
    want = [(3, base), (7, prose(80, 2)), (8, None), (None, base), (None, None), (3, ""), (3, None), (3, prose(80, 4)), (8, "")]
    assert sorted(((r.doc_id, r.text) for r in jaccard_join.keep_one(docs(rows)).collect()), key=str) == sorted(want, key=str)


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 3), (10, 11), (7, 7), (11, 10), (None, 4)] + [(k, k + 1) for k in range(20, 40)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 10: 10, 11: 10, 7: 7} | {k: 20 for k in range(20, 41)}
    assert components.connected_components(links.where("a > 1000")).count() == 0


def test_kept_digest_is_of_the_kept_text(spark, docs):
    from voltrace.llm import queries

    got = substring_dedup.remove_repeats(docs([(1, "a  b\tc")])).select(F.sha2(F.col("kept").cast("binary"), 256).alias("h")).first()
    assert got.h == hashlib.sha256(b"a b c").hexdigest() and "op5_substring_dedup" in queries.QUERIES


def test_arrow_batches_are_bounded_in_bytes_and_a_set_limit_stays(spark):
    texts = spark.range(40, numPartitions=1).select("id", F.repeat(F.lit("x"), 1_000_000).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    limit = textkernel.BATCH_LIMIT
    before = spark.conf.get(limit, None)
    try:
        spark.conf.unset(limit)
        n = [r.n for r in texts.transform(textkernel.batchwise, sizes, "n long").collect()]
        assert sum(n) == 40 and max(n) <= textkernel.BATCH_BYTES // 1_000_000 + 1
        spark.conf.set(limit, "2m")
        n = [r.n for r in texts.transform(textkernel.batchwise, sizes, "n long").collect()]
        assert sum(n) == 40 and max(n) <= 3 and spark.conf.get(limit) == "2m"
    finally:
        if before is None:
            spark.conf.unset(limit)
        else:
            spark.conf.set(limit, before)
