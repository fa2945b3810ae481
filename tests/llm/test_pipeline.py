"""The pipeline against a brute-force version on a small corpus."""

import hashlib
import importlib
import re

import pytest
from test_models_and_scans import base_of
from test_text_operators import component_of

from voltrace.llm import pii
from voltrace.llm.queries import default_tokenizer

pipeline = importlib.import_module("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(prose):
    en, de = "the and river stone light paper that with".split(), "der und fluss stein licht papier nicht auch".split()
    rows = [(k, prose(60, k, de if k % 3 == 0 else en)) for k in range(40)]
    item = prose(25, 500)
    rows += [(50, rows[4][1]), (51, rows[4][1] + " end"), (52, f"{rows[5][1]} {item}"), (53, None), (54, ""), (55, "12 34 !!"), (56, f"{rows[6][1][::-1]} mail a@b.co or 1.2.3.4 now"), (57, rows[7][1] + " + 1")]
    return rows, item


@pytest.fixture
def folder(spark, tmp_path, prose):
    rows, item = corpus(prose)
    full = [(i, t, "de" if i % 3 == 0 else "en", "s", len(t) if t is not None else None) for i, t in rows]
    spark.createDataFrame(full, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages_and_result(spark, folder, prose):
    import sentencepiece

    rows, item = corpus(prose)
    assert [n for n, _ in pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "personal_data", "tokens"]
    kept = [(i, t) for i, t in rows if t and re.search(r"[^\W\d_]", t)]
    kept = [kept[[k for k, _ in kept].index(i)] for i, _, c in component_of(kept) if i == c]
    kept = [(i, t) for i, t in kept if item not in t]
    want = {}
    lib = sentencepiece.SentencePieceProcessor(model_file=default_tokenizer())
    for i, t in kept:
        for start, kind, end in reversed(base_of(t)):
            t = f"{t[:start]}[{pii.KINDS[kind].upper()}]{t[end:]}"
        want[i] = hashlib.sha256(",".join(map(str, lib.encode(t))).encode()).hexdigest()
    assert {r.doc_id: r.ids_sha256 for r in pipeline.run(spark, folder).collect()} == want
    assert 50 not in want and 51 not in want and 52 not in want and 56 in want


def test_stages_keep_the_columns_and_pass_empty_tables(spark, folder):
    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in pipeline.STAGES:
        got = stage(spark, empty, folder)
        assert got.count() == 0
        if name != "tokens":
            assert got.dtypes == empty.dtypes
