"""Versioned snapshots: staged writes, a manifest with checksums, one rename to publish."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import os
import tempfile
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import OBSERVATIONS

VERSION = 1


@dataclass(frozen=True)
class Artifact:
    path: str
    source_id: str
    source_url: str
    retrieved_at: str
    row_count: int
    sha256: str


def sha256_path(path: Path) -> str:
    """SHA-256 of a file, or of the names and digests of a folder's data files in order."""
    total = hashlib.sha256()
    if path.is_dir():
        for f in sorted(p for p in path.rglob("*") if p.is_file() and not p.name.startswith((".", "_"))):
            total.update(f"{f.relative_to(path)}:{sha256_path(f)}\n".encode())
        return total.hexdigest()
    with path.open("rb") as f:
        while block := f.read(1 << 20):
            total.update(block)
    return total.hexdigest()


def write_text(path: Path, text: str) -> None:
    """Atomic: a flushed temporary file in the same folder takes the name."""
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def write_json(path: Path, payload: object) -> None:
    write_text(path, json.dumps(payload, sort_keys=True, indent=2) + "\n")


class _Staged:
    """A folder that takes its final name when the block ends well, and keeps a note of what went wrong if not."""

    def __init__(self, root: Path, name: str, note: Mapping[str, object]) -> None:
        self.target, self.folder, self.note = root / name, root / f".{name}.staging", note

    def __enter__(self) -> Path:
        taken = [p for p in (self.target, self.folder) if p.exists()]
        if taken:
            raise FileExistsError(f"{taken[0]} exists")
        self.folder.mkdir(parents=True)
        return self.folder

    def __exit__(self, kind: type | None, error: BaseException | None, _trace: object) -> None:
        if kind is None:
            self.folder.rename(self.target)
        elif issubclass(kind, Exception):
            write_json(self.folder / "FAILED.json", {**self.note, "dataset_status": "failed", "error_type": kind.__name__, "error": str(error)})


def publish(root: Path, snapshot_id: str, generated_at: dt.datetime, fill: Callable[[Path], Sequence[Artifact]], status: str = "complete") -> Path:
    """Have ``fill`` write a snapshot's files, add the manifest, and publish both at once under the id.

    An existing snapshot or unfinished one is refused.
    """
    if not snapshot_id.strip():
        raise ValueError("a snapshot needs an id")
    about = {"snapshot_id": snapshot_id, "generated_at": generated_at.isoformat()}
    stage = _Staged(root, snapshot_id, about)
    with stage as folder:
        written = [asdict(a) for a in fill(folder)]
        write_json(folder / "manifest.json", {"schema_version": VERSION, "dataset_status": status, "artifacts": written, **about})
    return stage.target


def write_observations(obs: DataFrame, staging: Path, name: str, source_id: str, source_url: str, retrieved_at: dt.datetime) -> Artifact:
    """Observations as Parquet, partitioned by metric so that a metric's readers skip the others."""
    path = staging / "curated" / name
    obs.write.partitionBy("metric_id").parquet(str(path))
    rows = obs.sparkSession.read.parquet(str(path)).count()  # from the footers
    return Artifact(str(path.relative_to(staging)), source_id, source_url, retrieved_at.isoformat(), rows, sha256_path(path))


def read_observations(spark: SparkSession, snapshot: Path, name: str) -> DataFrame:
    manifest = read_manifest(snapshot)
    if not any(a["path"] == f"curated/{name}" for a in manifest["artifacts"]):
        raise ValueError(f"no {name} in {snapshot}")
    return spark.read.parquet(str(snapshot / "curated" / name))


#: The interchange document: one JSON object with all observations. Names are the format's.
_DOCUMENT = "schema_version int, observations array<struct<id: string, metric_id: string, entity_id: string, period_start: string, period_end: string, value: double, unit: string, source: struct<id: string, url: string, publisher: string>, retrieved_at: string, vintage: string, kind: string, quality_flags: array<string>>>"


def write_document(obs: DataFrame, path: Path) -> None:
    """Observations in input order as one JSON document, streamed a partition at a time."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX")
    period = lambda c: F.when(F.col("period_precision") == "date", F.date_format(c, "yyyy-MM-dd")).when(F.col("period_precision") == "local", F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(iso(c))
    rows = obs.orderBy("ord").select(F.to_json(F.struct("id", "metric_id", "entity_id", period("period_start").alias("period_start"), period("period_end").alias("period_end"), "value", "unit", "source", iso("retrieved_at").alias("retrieved_at"), "vintage", "kind", "quality_flags")).alias("row"))
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f".{path.name}.part")
    with part.open("w", encoding="utf-8") as f:
        f.write(f'{{"schema_version": {VERSION}, "observations": [')
        for k, r in enumerate(rows.toLocalIterator()):
            f.write((",\n" if k else "\n") + r.row)
        f.write("]}\n")
    part.replace(path)


def read_document(spark: SparkSession, path: Path | str) -> DataFrame:
    """Observations of a JSON document; an unknown version or a bad period fails the read."""
    raw = spark.read.schema(_DOCUMENT).json(str(path), multiLine=True)
    rows = raw.select(F.when(F.col("schema_version") == VERSION, F.col("observations")).otherwise(F.raise_error(F.lit("unsupported observation document"))).alias("all")).select(F.posexplode("all").alias("ord", "o")).select(F.col("ord").cast("long").alias("ord"), "o.*")
    text = F.col("period_start")
    zoned = text.rlike("(Z|[+-][0-9]{2}:?[0-9]{2})$")
    precision = F.when(F.length(text) == 10, "date").when(zoned, "instant").otherwise("local")
    stamp = lambda c: F.coalesce(F.try_to_timestamp(F.col(c)), F.raise_error(F.concat(F.lit("bad time: "), F.coalesce(F.col(c), F.lit("none")))))
    rows = rows.withColumns({"period_precision": precision, **{c: stamp(c) for c in ("period_start", "period_end", "retrieved_at")}})
    return rows.withColumn("day", F.to_date("period_start")).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in OBSERVATIONS.fields))


def read_manifest(snapshot: Path) -> Mapping[str, object]:
    manifest = json.loads((snapshot / "manifest.json").read_text(encoding="utf-8"))
    if manifest.get("schema_version") != VERSION:
        raise ValueError("unsupported schema version")
    return manifest


def verify(snapshot: Path) -> list[str]:
    """Paths of artifacts whose checksum no longer holds."""
    return [a["path"] for a in read_manifest(snapshot)["artifacts"] if sha256_path(snapshot / a["path"]) != a["sha256"]]


def latest(root: Path) -> Path:
    """The snapshot of the greatest name."""
    found = sorted(p for p in root.iterdir() if not p.name.startswith(".") and (p / "manifest.json").exists())
    if not found:
        raise ValueError(f"no snapshot in {root}")
    return found[-1]
