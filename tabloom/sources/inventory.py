"""What a folder holds: source references, their content ids, duplicates; and immutable snapshots."""

from __future__ import annotations

import hashlib
import os
import re
import shutil
import unicodedata
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DELIMITED, WORKBOOKS = (".csv", ".tsv"), (".xlsx", ".xlsm")
SUPPORTED = DELIMITED + WORKBOOKS
_UNSAFE = re.compile(r"[^\w.\-]+")


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """(path, sha256, length, source_id, duplicate_of) of the supported files below ``root``.

    Content is hashed on the executors; nothing but the listing comes together.
    Lock files, hidden files and unsupported ones are left out; of equal content
    the first path is the source and the others are its duplicates.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.element_at(F.split("path", "/"), -1)
    kept = files.where(~name.startswith("~$") & ~name.startswith(".") & name.rlike(r"(?i)\.(?:csv|tsv|xlsx|xlsm)$"))
    hashed = kept.select("path", F.sha2("content", 256).alias("sha256"), "length")
    first = F.min("path").over(Window.partitionBy("sha256"))
    return hashed.select("path", "sha256", "length", F.concat(F.substring("sha256", 1, 12), F.lit("/")).alias("source_id"), F.when(first != F.col("path"), first).alias("duplicate_of"))


def select_sources(listing: DataFrame, only: str | None = None, limit: int | None = None) -> DataFrame:
    """Sources that aren't duplicates, whose path or id contains ``only``, in order of path; a limit is the caller's wish."""
    df = listing.where("duplicate_of IS NULL")
    if only:
        df = df.where(F.col("path").contains(only) | F.col("source_id").contains(only))
    df = df.orderBy("path")
    return df.limit(limit) if limit is not None else df


def safe_id(source_id: str) -> str:
    """A readable file name of a source id, at most 120 bytes and a hash that tells it apart."""
    text = _UNSAFE.sub("_", unicodedata.normalize("NFC", source_id)).strip("_.")
    raw = text.encode()[:120].decode("utf-8", "ignore")
    return f"{raw}-{hashlib.sha256(source_id.encode()).hexdigest()[:8]}"


def digest(path: str | Path) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


class SnapshotStore:
    """Copies of inputs by content; a copy whose content changed is refused."""

    def __init__(self, folder: str | Path):
        self.folder = Path(folder)

    def capture(self, path: str | Path) -> Path:
        sha = digest(path)
        to = self.folder / sha[:2] / sha
        if not to.exists():
            to.parent.mkdir(parents=True, exist_ok=True)
            staged = to.with_suffix(".new")
            shutil.copyfile(path, staged)
            if digest(staged) != sha:
                staged.unlink()
                raise ValueError(f"{path} changed while it was copied")
            os.chmod(staged, 0o600)
            os.replace(staged, to)
        return to

    def verify(self, sha: str) -> Path:
        path = self.folder / sha[:2] / sha
        if digest(path) != sha:
            raise ValueError(f"the snapshot {sha} was changed")
        return path
