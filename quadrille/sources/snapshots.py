"""Registration of raw snapshots: validate, copy, write a manifest, never overwrite."""

from __future__ import annotations

import json
import shutil
import tempfile
import urllib.request
from dataclasses import asdict, dataclass, field
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

from ..functions.tags import manifest_violations

SCHEMA = "provider string, city string, snapshot_id string, source_name string, source_url string, download_date string, source_crs string, license string, bbox array<double>, files array<string>, schema_version string"


@dataclass
class Manifest:
    provider: str
    city: str
    snapshot_id: str
    source_name: str
    source_url: str
    download_date: str
    source_crs: str
    license: str
    bbox: list[float]
    files: list[str] = field(default_factory=list)
    schema_version: str = "raw-source/v1"

    @property
    def folder(self) -> str:
        return "/".join((self.provider, self.city, self.snapshot_id))


def problems(spark: SparkSession, manifests: DataFrame) -> DataFrame:
    return manifests.withColumn("problems", manifest_violations())


def load(spark: SparkSession, path: str) -> DataFrame:
    """Manifests below ``path`` (a file or a glob) with their ``problems``."""
    return problems(spark, spark.read.schema(SCHEMA).option("multiLine", True).json(path))


def names(source: Path) -> list[str]:
    return sorted(p.name for p in source.iterdir() if p.is_file()) if source.is_dir() else [source.name]


def register(spark: SparkSession, root: Path, manifest: Manifest, source: Path | None = None) -> Path:
    """Copy a bundle below ``root`` and write its manifest last; an existing snapshot is an error.

    Everything is staged beside the target and renamed, so a failure leaves nothing behind.
    """
    found = names(Path(source)) if source is not None else manifest.files
    if manifest.files and sorted(manifest.files) != found:
        raise ValueError(f"the bundle holds {found}, the manifest says {sorted(manifest.files)}")
    manifest = Manifest(**{**asdict(manifest), "files": found})
    bad = problems(spark, spark.createDataFrame([asdict(manifest)], SCHEMA)).first()["problems"]
    if bad:
        raise ValueError("; ".join(bad))
    target = Path(root) / manifest.folder
    if target.exists():
        raise FileExistsError(str(target))
    target.parent.mkdir(parents=True, exist_ok=True)
    stage = Path(tempfile.mkdtemp(prefix=".stage-", dir=target.parent))
    try:
        if source is not None:
            for f in sorted(Path(source).iterdir()) if Path(source).is_dir() else [Path(source)]:
                if f.is_file():
                    shutil.copy2(f, stage / f.name)
        (stage / "manifest.json").write_text(json.dumps(asdict(manifest), ensure_ascii=False, indent=2), encoding="utf-8")
        stage.rename(target)
    except BaseException:
        shutil.rmtree(stage, ignore_errors=True)
        raise
    return target


def download(spark: SparkSession, root: Path, manifest: Manifest, url: str, timeout: float = 120) -> Path:
    """Fetch one file (host side), then register it."""
    name = Path(urlparse(url).path).name
    if not name:
        raise ValueError("the address names no file")
    with tempfile.TemporaryDirectory() as d:
        with urllib.request.urlopen(url, timeout=timeout) as r, open(Path(d) / name, "wb") as f:
            shutil.copyfileobj(r, f)
        return register(spark, root, manifest, Path(d) / name)
