"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; every run of characters that are no letters becomes one
boundary symbol; n-grams of 1 to 3 symbols are hashed into a fixed number of
buckets. Fitting counts buckets by language in Spark and brings one row per
(language, bucket) to the driver, at most ``languages * BUCKETS``. The matrix
of log probabilities is broadcast (bounded by the same figure), and a batch is
scored by gathering matrix rows for all its n-grams and summing them document
by document.

Edge cases: a null text, an empty one or one without a letter is ``und`` with
score 0; null languages are not learned from; with nothing to learn from every
text is ``und``; ties between languages go to the first by name; a null id
counts as not held out; extra columns are kept, ``lang_pred`` and ``score`` are
replaced if they exist.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkernel import batchwise, mix

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: About this many documents are learned from; a documented bound, not a cap on what is scored.
FIT_DOCS = 40_000
#: Added to every count.
SMOOTHING = 0.5
#: Evidence of longer texts is scaled to so many n-grams before it becomes a score.
EVIDENCE = 60.0
#: Characters handled at once.
PIECE = 1 << 19
UNKNOWN = "und"

_LETTER = np.array([chr(c).isalpha() for c in range(0x10000)])


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    log_prob: np.ndarray  # (BUCKETS, languages)
    prior: np.ndarray


def _symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts (0 for a boundary), the first of each text, and whether it has a letter."""
    low = [(t or "").lower() for t in texts]
    code = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    off = np.concatenate(([1], 2 + np.cumsum([len(t) + 1 for t in low]) - 1)).astype(np.int64)
    letter = np.zeros(len(code), bool)
    base = code < 0x10000
    letter[base] = _LETTER[code[base]]
    for c in np.unique(code[~base]):
        letter[code == c] = chr(c).isalpha()
    many = np.concatenate(([0], np.cumsum(letter)))
    has = many[off[1:] - 1] > many[off[:-1]]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first character behind a letter is a boundary
    keep[off[:-1] - 1] = True  # each text begins with one
    place = np.concatenate(([0], np.cumsum(keep)))
    return np.where(letter, code, 0)[keep], place[off - 1], has


def buckets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams ordered by text, the first of each text, and whether the text has a letter."""
    sym, first, has = _symbols(texts)
    s = sym.astype(np.uint64)
    out = np.empty((len(s), len(ORDERS)), np.uint16)
    for k, n in enumerate(ORDERS):
        h = np.full(len(s), n, np.uint64)
        for j in range(n):
            part = np.zeros(len(s), np.uint64)
            part[j:] = s[: len(s) - j] if j else s
            for d in range(j):  # a text's first grams reach back to its boundary, never into the text before
                part[first[:-1][first[:-1] + d < len(s)] + d] = 0
            h = h * np.uint64(0x100000001B3) + part
        out[:, k] = mix(h) & np.uint64(BUCKETS - 1)
    return out[: first[-1]].reshape(-1), first * len(ORDERS), has  # a boundary behind the last text is left out


def _pieces(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    texts = batch.column(batch.schema.get_field_index(column)).to_pylist()
    at = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= PIECE or k + 1 == len(texts):
            yield batch.slice(at, k + 1 - at), texts[at : k + 1]
            at, size = k + 1, 0


def fit(docs: DataFrame, learn: Column, fit_docs: int = FIT_DOCS, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> LanguageModel:
    """Learn from the rows where ``learn`` holds and text and language aren't null.

    If there are more than ``fit_docs`` of them, about that many are chosen by
    a hash of the id.
    """
    labelled = docs.where(learn & F.col(lang).isNotNull())
    total = labelled.select(F.count("*")).first()[0]
    share = min(1.0, fit_docs / max(1, total))
    chosen = labelled.where(F.col(text).isNotNull()).where(F.pmod(F.xxhash64(doc_id), F.lit(1 << 20)) < F.lit(int(np.ceil(share * (1 << 20)))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, texts in _pieces(batch, text):
                names = piece.column(piece.schema.get_field_index(lang)).to_pylist()
                got, first, _ = buckets(texts)
                size = np.diff(first)
                for name in sorted(set(names)):
                    n = np.bincount(got[np.repeat(np.array([x == name for x in names]), size)], minlength=BUCKETS)
                    at = np.flatnonzero(n)
                    docs_of = sum(x == name for x in names)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * (len(at) + 1)), pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(n[at], docs_of), pa.int64())], ["lang", "bucket", "n"])

    rows = chosen.select(text, lang).transform(batchwise, count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = rows.column("lang").to_pylist()
    languages = sorted(set(names))
    where = np.array([languages.index(x) for x in names], np.int64)
    at, n = rows.column("bucket").to_numpy(), rows.column("n").to_numpy()
    counts, prior = np.zeros((BUCKETS, len(languages))), np.zeros(len(languages))
    counts[at[at >= 0], where[at >= 0]] = n[at >= 0]
    prior[where[at < 0]] = n[at < 0]
    log_prob = np.log(counts + SMOOTHING) - np.log(counts.sum(0) + SMOOTHING * BUCKETS)
    return LanguageModel(languages, log_prob.astype(np.float32), np.log(prior / max(1.0, prior.sum())) if len(languages) else prior)


def score_texts(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Predicted language and score of each text."""
    n = len(texts)
    if not model.languages:
        return [UNKNOWN] * n, np.zeros(n)
    got, first, has = buckets(texts)
    total = np.empty((n, len(model.languages)))
    for k in range(len(model.languages)):
        run = np.concatenate(([0.0], np.cumsum(model.log_prob[:, k][got], dtype=np.float64)))
        total[:, k] = run[first[1:]] - run[first[:-1]]
    size = np.maximum(np.diff(first), 1)
    evidence = total * np.minimum(1.0, EVIDENCE / size)[:, None] + model.prior
    best = np.argmax(total + model.prior, 1)
    p = np.exp(evidence - evidence.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    return [model.languages[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)], np.where(has, p[np.arange(n), best], 0.0)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", drop_text: bool = False) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1) from the whole text."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS * languages floats
    rest = [c for c in docs.columns if c not in ("lang_pred", "score") and not (drop_text and c == text)]
    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, texts in _pieces(batch, text):
                names, score = score_texts(held.value, texts)
                yield pa.RecordBatch.from_arrays([piece.column(piece.schema.get_field_index(c)) for c in rest] + [pa.array(names, pa.string()), pa.array(score, pa.float64())], [*rest, "lang_pred", "score"])

    return docs.select(*dict.fromkeys([*rest, text])).transform(batchwise, run, schema)


def remainder(doc_id: str, divisor: int) -> Column:
    """crc32 of the id as text modulo ``divisor``; null ids stay null."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(divisor))
