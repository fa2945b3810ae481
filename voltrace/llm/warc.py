"""Web archives and their Merkle fixity audit.

Pages become WARC records, and records are laid out in archives of bounded
size, ordered by id, so every record has an offset. A record's leaf hashes its
offset, length and digest; ``FANOUT`` neighbours, an ordered range of offsets,
hash into a node, up to one root for an archive. Two replicas are compared by
their roots; only below roots that differ are the next levels joined, down to
the records. Those are then told apart: corrupt, missing, extra, or moved
(whole, but at another offset because a record before it went).

All of it is DataFrame expressions, except writing and parsing archive files.

Edge cases: null ids are spread over archives of their own by a hash, a range
of ids with very many rows is dealt into several archives; a null url has no
target line, null html is an empty block; equal ids are ordered by digest and
all kept; other columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import durable
from .textkernel import batchwise

#: Ids of an archive.
SPAN = 1024
FANOUT = 16
#: Most ranges of ids with too many rows for one archive that are broadcast.
CROWDED = 50_000
#: Levels above the leaves for an archive of SPAN records.
LEVELS = 3
DATE = "2024-01-01T00:00:00Z"


def record_text(page_id: Column, url: Column, html: Column) -> Column:
    """The WARC record of a page."""
    body = F.coalesce(html, F.lit(""))
    name = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("")), F.coalesce(url, F.lit(""))).cast("binary"))
    uuid = F.concat_ws("-", *(F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    target = F.when(url.isNull(), F.lit("")).otherwise(F.concat(F.lit("WARC-Target-URI: "), url, F.lit("\r\n")))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:"), uuid, F.lit(f">\r\nWARC-Date: {DATE}\r\n"), target)
    return F.concat(head, F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def to_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", span: int = SPAN) -> DataFrame:
    """(archive, part, page_id, record): the record of every page and where it belongs."""
    archive = F.floor(F.col(page_id) / span).cast("long")
    known = pages.select(archive.alias("archive"), F.col(page_id).cast("long").alias("page_id"), record_text(F.col(page_id), F.col(url), F.col(html)).alias("record"))
    crowded = pages.groupBy(archive.alias("__a")).agg(F.count("*").alias("n")).where(F.col("__a").isNull() | (F.col("n") > 4 * span))
    parts = crowded.select("__a", F.ceil(F.col("n") / span).alias("__n"))
    # ranges of ids that crowd are few as a rule, so the records needn't move; beyond a checked number they do
    if parts.limit(CROWDED + 1).count() <= CROWDED:
        parts = F.broadcast(parts)
    dealt = known.join(parts, F.col("archive").eqNullSafe(F.col("__a")), "left")
    part = F.when(F.col("__n") > 1, F.pmod(F.xxhash64("record"), F.col("__n"))).otherwise(F.lit(0))
    return dealt.select(F.coalesce("archive", F.lit(-1)).alias("archive"), part.cast("long").alias("part"), "page_id", "record")


def layout(records: DataFrame) -> DataFrame:
    """(archive, part, page_id, seq, offset, length, digest): the place and the digest of every record."""
    slim = records.select("archive", "part", "page_id", F.octet_length("record").cast("long").alias("length"), F.sha2(F.col("record").cast("binary"), 256).alias("digest"))
    w = Window.partitionBy("archive", "part").orderBy(F.col("page_id").asc_nulls_first(), "digest")
    before = F.coalesce(F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return slim.select("archive", "part", "page_id", (F.row_number().over(w) - 1).cast("long").alias("seq"), before.alias("offset"), "length", "digest")


def tree(places: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """Levels of (archive, part, idx, hash, offset, end), leaves first, roots last; each above the leaves is a table made once from the one below."""
    leaf = F.sha2(F.concat_ws(":", F.col("offset").cast("string"), F.col("length").cast("string"), F.col("digest")).cast("binary"), 256)
    out = [places.select("archive", "part", F.col("seq").alias("idx"), leaf.alias("hash"), "offset", (F.col("offset") + F.col("length")).alias("end"))]
    for level in range(levels):
        children = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash"))), lambda c: c["hash"]), "")
        # the last level takes all that is left, so that an archive of any size has one root
        group = F.lit(0).cast("long") if level == levels - 1 else F.floor(F.col("idx") / FANOUT).cast("long")
        out.append(durable(out[-1].groupBy("archive", "part", group.alias("up")).agg(F.sha2(children.cast("binary"), 256).alias("hash"), F.min("offset").alias("offset"), F.max("end").alias("end")).withColumnRenamed("up", "idx")))
    return out


def differing_leaves(a: list[DataFrame], b: list[DataFrame]) -> DataFrame:
    """(archive, part, idx) of leaves that differ between two replicas' trees, found from the roots down.

    Below the roots a level is read only under nodes that differ; the nodes
    found are a table before the next level is opened, and without any the
    descent ends.
    """
    top, levels = None, len(a) - 1
    for level, (x, y) in reversed(list(enumerate(zip(a, b, strict=True)))):
        up = F.lit(0).cast("long") if level == levels - 1 else F.floor(F.col("idx") / FANOUT).cast("long")
        if top is not None:  # only children of nodes that differ
            x, y = (z.withColumn("up", up).join(top, ["archive", "part", "up"], "left_semi") for z in (x, y))
        x, y = x.select("archive", "part", "idx", F.col("hash").alias("h1")), y.select("archive", "part", "idx", F.col("hash").alias("h2"))
        bad = durable(x.join(y, ["archive", "part", "idx"], "full").where(~F.col("h1").eqNullSafe(F.col("h2"))).select("archive", "part", "idx"))
        if bad.isEmpty():
            return bad
        top = bad.withColumnRenamed("idx", "up") if level else bad
    return top


def audit(a: DataFrame, b: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The records of replica ``a`` (and what only ``b`` has) with a ``status`` and the root of their archive.

    ``a`` and ``b`` are layouts. Records are matched by archive, id and their
    rank among equal ids.
    """
    # layouts are small beside the pages; kept, every level of the trees starts from them and not from the pages
    a, b = durable(a), durable(b)
    mine_tree, other_tree = tree(a, levels), tree(b, levels)
    bad = differing_leaves(mine_tree, other_tree)
    some = bad.select("archive", "part").distinct()
    key = ["archive", "part", "page_id", "copy"]
    rank = F.row_number().over(Window.partitionBy("archive", "part", "page_id").orderBy("seq")).alias("copy")
    # only archives that differ have their records ranked among equal ids
    left = a.join(some, ["archive", "part"], "left_semi").select("*", rank).join(bad.withColumnRenamed("idx", "seq"), ["archive", "part", "seq"], "left_semi").select(*(F.col(c).alias(f"a_{c}") for c in (*key, "seq", "digest")))
    right = b.join(some, ["archive", "part"], "left_semi").select("*", rank).join(bad.withColumnRenamed("idx", "seq"), ["archive", "part", "seq"], "left_semi").select(*key, "seq", "offset", "length", "digest")
    same = (F.col("archive") == F.col("a_archive")) & (F.col("part") == F.col("a_part")) & F.col("page_id").eqNullSafe(F.col("a_page_id")) & (F.col("copy") == F.col("a_copy"))
    both = left.join(right, same, "full")
    status = F.when(F.col("archive").isNull(), "missing").when(F.col("a_archive").isNull(), "extra").when(F.col("digest") != F.col("a_digest"), "corrupt").otherwise("moved")
    found = both.withColumn("status", status)
    roots = mine_tree[-1].select("archive", "part", F.col("hash").alias("root"))
    # a record is told by its place in its archive
    mine = found.where("status <> 'extra'").select(F.col("a_archive").alias("archive"), F.col("a_part").alias("part"), F.col("a_seq").alias("seq"), "status")
    kept = a.join(mine, ["archive", "part", "seq"], "left").select("archive", "part", "page_id", "seq", "offset", "length", "digest", F.coalesce("status", F.lit("ok")).alias("status"))
    extra = found.where("status = 'extra'").select("archive", "part", "page_id", "seq", "offset", "length", "digest", "status")
    return kept.unionByName(extra).join(roots, ["archive", "part"], "left")


def archives(records: DataFrame) -> DataFrame:
    """(archive, part, content): whole archive files, of bounded size, in the order of ``layout``."""
    digest = F.sha2(F.col("record").cast("binary"), 256)
    order = F.struct(F.col("page_id").isNotNull().alias("has"), F.coalesce("page_id", F.lit(0)).alias("id"), digest.alias("digest"), "record")
    return records.groupBy("archive", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda r: r["record"]), "").cast("binary").alias("content"))


def write_archives(records: DataFrame, path: str) -> None:
    """Write each archive to ``path`` (a folder that all executors share), one gzip member a record."""

    def write(rows) -> None:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(path)
        system.create_dir(base, recursive=True)
        for row in rows:
            name = f"{base}/{row.archive:012d}-{row.part:06d}.warc.gz"
            with system.open_output_stream(name, compression=None) as out:  # the members below are the compression
                for _, _, raw in split_records(bytes(row.content)):
                    out.write(gzip.compress(raw, mtime=0))

    archives(records).foreachPartition(write)


def split_records(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, raw record) of each record of an archive."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode().split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        stop = end + 4 + int(headers["Content-Length"]) + 4
        if not lines[0].startswith("WARC/") or content[stop - 4 : stop] != b"\r\n\r\n":
            raise ValueError(f"no WARC record at offset {at}")
        yield at, headers, content[at:stop]
        at = stop


def read_archives(files: DataFrame) -> DataFrame:
    """(path, offset, url, html) of every record of ``binaryFile`` rows (path, content), compressed or not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                rows = [(path, at, h.get("WARC-Target-URI"), r[r.index(b"\r\n\r\n") + 4 : -4].decode()) for at, h, r in split_records(raw)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], ["path", "offset", "url", "html"])

    return files.select("path", "content").transform(batchwise, run, "path string, offset long, url string, html string")
