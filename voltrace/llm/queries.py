"""The registered query of each operator, over whole tables, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard_join, language_id, license_scan, pii, quality, sentencepiece_bpe, substring_dedup, topk, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def default_tokenizer() -> str:
    """The public 32k BPE model installed beside the libraries."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every licence that a document states, with the wording that differs."""
    return license_scan.scan_licenses(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from labels whose crc32 remainder by 4 isn't 2."""
    docs, labels = _read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels")
    held_out = F.coalesce(language_id.remainder("doc_id", 4) == 2, F.lit(False))
    model = quality.fit(docs, labels.where(~held_out))
    got = quality.score(docs, model)
    return got.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products of every 50th vector id among all other vectors."""
    return topk.top_k(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 50 == 0)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5
"""


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those whose crc32 remainder by 5 isn't 0."""
    docs = _read(spark, sf_dir, "documents")
    held_out = F.coalesce(language_id.remainder("doc_id", 5) == 0, F.lit(False))
    model = language_id.fit(docs, ~held_out)
    got = language_id.predict(docs.select("doc_id", "text"), model, drop_text=True)
    return got.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of what remains of every document without passages that a smaller id also has."""
    got = substring_dedup.remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, w, p, array_to_string(w[p:p+12], ' ') AS seq
  FROM d, unnest(generate_series(1, len(w) - 12)) AS t(p) WHERE len(w) >= 13
), least AS (
  SELECT seq, min(doc_id) AS doc FROM win GROUP BY seq HAVING count(DISTINCT doc_id) > 1
), gone AS (
  SELECT DISTINCT win.doc_id, q FROM win JOIN least ON win.seq = least.seq AND win.doc_id > least.doc, unnest(generate_series(p, p + 12)) AS t(q)
), words AS (
  SELECT d.doc_id, q, w[q] AS word FROM d, unnest(generate_series(1, len(w))) AS t(q)
), kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.q) AS text, count(*) AS n
  FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.q = gone.q WHERE gone.q IS NULL GROUP BY words.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixity audit of the archives of all pages against a replica with planted faults.

    In the replica, pages whose id leaves 13 by 97 have a changed last
    character, and those whose id leaves 100 by 211 are lost, so records
    behind them in the archive are moved.
    """
    pages = _read(spark, sf_dir, "pages")
    a = warc.layout(warc.to_records(pages))
    changed = F.concat(F.expr("substring(html, 1, length(html) - 1)"), F.lit("~"))
    replica = pages.where(F.coalesce(F.col("page_id") % 211 != 100, F.lit(True))).withColumn("html", F.when((F.col("page_id") % 97 == 13) & (F.length("html") > 0), changed).otherwise(F.col("html")))
    return warc.audit(a, warc.layout(warc.to_records(replica))).select("page_id", "archive", "seq", "offset", "length", "digest", "status", "root")


OP6_SQL = """
WITH p AS (
  SELECT page_id, page_id // 1024 AS archive, coalesce(html, '') AS html, url, md5(page_id || '|' || coalesce(url, '')) AS m FROM pages
), r AS (
  SELECT page_id, archive, html, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:uuid:' || m[1:8] || '-' || m[9:12] || '-' || m[13:16] || '-' || m[17:20] || '-' || m[21:32] || '>' || chr(13) || chr(10)
    || 'WARC-Date: 2024-01-01T00:00:00Z' || chr(13) || chr(10) || CASE WHEN url IS NULL THEN '' ELSE 'WARC-Target-URI: ' || url || chr(13) || chr(10) END
    || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(html)) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM p
), l AS (
  SELECT *, sha256(record) AS digest, octet_length(encode(record)) AS length, row_number() OVER w - 1 AS seq,
    coalesce(sum(octet_length(encode(record))) OVER (PARTITION BY archive ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
    coalesce(sum(CASE WHEN page_id % 211 = 100 THEN 1 ELSE 0 END) OVER (PARTITION BY archive ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lost
  FROM r WINDOW w AS (PARTITION BY archive ORDER BY page_id)
), t0 AS (SELECT archive, seq, sha256(start::BIGINT || ':' || length || ':' || digest) AS h FROM l),
t1 AS (SELECT archive, seq // 16 AS seq, sha256(string_agg(h, '' ORDER BY seq)) AS h FROM t0 GROUP BY archive, seq // 16),
t2 AS (SELECT archive, seq // 16 AS seq, sha256(string_agg(h, '' ORDER BY seq)) AS h FROM t1 GROUP BY archive, seq // 16),
t3 AS (SELECT archive, sha256(string_agg(h, '' ORDER BY seq)) AS root FROM t2 GROUP BY archive)
SELECT page_id, l.archive, CAST(seq AS BIGINT) AS seq, CAST(start AS BIGINT) AS "offset", CAST(length AS BIGINT) AS length, digest,
  CASE WHEN page_id % 211 = 100 THEN 'missing' WHEN page_id % 97 = 13 AND html <> '' THEN 'corrupt' WHEN lost > 0 THEN 'moved' ELSE 'ok' END AS status, root
FROM l JOIN t3 ON l.archive = t3.archive
"""


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that overlaps with a benchmark item, with the item and the overlap."""
    return decontaminate.contaminated(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document under Jaccard similarity 0.8 of 5-word shingles."""
    return jaccard_join.join_components(_read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p+4], ' ') AS g FROM d, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS t(p) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(x, y) AS (SELECT a, b FROM both_ways UNION SELECT reach.x, both_ways.b FROM reach JOIN both_ways ON reach.y = both_ways.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.y, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN (SELECT x, min(y) AS y FROM reach GROUP BY x) r ON d.doc_id = r.x
"""


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    return token_digests(_read(spark, sf_dir, "documents"), default_tokenizer())


def token_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text."""
    got = sentencepiece_bpe.encode_decode(docs.select("doc_id", "text"), model_path)
    return got.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def _is_kind(k: int) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == k


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the personal data in every document."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    got = pii.find(docs, pii.fit(docs)).select("doc_id", "base", "spans")
    counts = [F.size(F.filter("base", _is_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)]
    names = F.array(*(F.lit(n) for n in pii.KINDS))
    base = F.array_join(F.transform("base", lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return got.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), spans.alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_quality": op2_quality,
    "op3_topk": op3_topk,
    "op4_language_id": op4_language_id,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_warc": op6_warc,
    "op7_decontaminate": op7_decontaminate,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_pii": op10_pii,
}

ORACLE_SQL: dict[str, str] = {
    "op3_topk": OP3_SQL,
    "op5_substring_dedup": OP5_SQL,
    "op6_warc": OP6_SQL,
    "op8_jaccard_join": OP8_SQL,
}
