"""Committed generations: outputs are staged, verified, renamed and only then named by a manifest.

A generation is a folder of Parquet tables and small JSON documents. Readers
follow the manifest, so a run that is lost leaves nothing half visible. One
writer at a time: a lock is refused, not waited for, and taken over from a dead
process of this machine.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import socket
import time
from contextlib import contextmanager
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators.ledger import merge_totals
from tabloom.plans.compile import first_wins

REQUIRED = ("statements", "rejects", "entities", "coverage", "claims")
MANIFEST = "manifest.json"


class Locked(RuntimeError):
    """Another run writes to the workspace."""


def durable_write(path: Path, text: str, mode: int = 0o600) -> None:
    """A small file, whole or not at all."""
    path.parent.mkdir(parents=True, exist_ok=True)
    staged = path.with_name(path.name + ".new")
    with open(staged, "w") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.chmod(staged, mode)
    os.replace(staged, path)


@dataclass
class Clock:
    """Seconds per stage of a run."""

    stages: dict[str, float] = field(default_factory=dict)

    @contextmanager
    def stage(self, name: str):
        began = time.monotonic()
        try:
            yield
        finally:
            self.stages[name] = self.stages.get(name, 0.0) + time.monotonic() - began


def failure_code(error: BaseException) -> str:
    """A value-free code of where an error was raised."""
    at = error.__traceback__
    while at and at.tb_next:
        at = at.tb_next
    where = f"{type(error).__name__}@{Path(at.tb_frame.f_code.co_filename).name}:{at.tb_lineno}" if at else type(error).__name__
    return hashlib.sha256(where.encode()).hexdigest()[:12]


class Workspace:
    def __init__(self, root: str | Path):
        self.root = Path(root)
        if set(str(root)) & set("#?$\t\r\n"):
            raise ValueError("a workspace path may not hold # ? $ or control characters")

    @contextmanager
    def lock(self):
        path = self.root / ".lock"
        self.root.mkdir(parents=True, exist_ok=True)
        me = {"host": socket.gethostname(), "pid": os.getpid()}
        try:
            fd = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o600)
        except FileExistsError:
            held = json.loads(path.read_text() or "{}")
            if held.get("host") != me["host"] or os.path.exists(f"/proc/{held.get('pid')}"):
                raise Locked(f"{self.root} is written by {held}") from None
            path.unlink()
            fd = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o600)
        with os.fdopen(fd, "w") as f:
            json.dump(me, f)
        try:
            yield
        finally:
            path.unlink(missing_ok=True)

    def manifest(self) -> dict:
        try:
            return json.loads((self.root / MANIFEST).read_text())
        except FileNotFoundError:
            return {"sources": {}, "aggregate": None}

    def commit(self, name: str, tables: dict[str, DataFrame], documents: dict[str, dict | str], required: tuple[str, ...] = REQUIRED) -> int:
        """Writes one source's generation; the manifest names it last."""
        now = self.manifest()
        at = now["sources"].get(name, {}).get("generation", 0) + 1
        staged, final = self.root / "staging" / f"{name}-{at}", self.root / "generations" / name / str(at)
        shutil.rmtree(staged, ignore_errors=True)
        for t, df in tables.items():
            df.write.mode("overwrite").parquet(str(staged / t))
        for d, body in documents.items():
            durable_write(staged / d, body if isinstance(body, str) else json.dumps(body, ensure_ascii=False, sort_keys=True))
        missing = [t for t in required if not (staged / t / "_SUCCESS").exists()]
        if missing:
            raise ValueError(f"not staged: {missing}")
        final.parent.mkdir(parents=True, exist_ok=True)
        os.rename(staged, final)
        now["sources"][name] = {"generation": at, "tables": sorted(tables), "documents": sorted(documents)}
        now["aggregate"] = None  # stale until it is published again
        durable_write(self.root / MANIFEST, json.dumps(now, sort_keys=True), 0o644)
        return at

    def path(self, name: str) -> Path:
        return self.root / "generations" / name / str(self.manifest()["sources"][name]["generation"])

    def read(self, spark: SparkSession, table: str) -> DataFrame | None:
        """A table over all committed sources, with the source's rank."""
        parts = [spark.read.parquet(str(self.path(n) / table)).withColumn("source_rank", F.lit(k)) for k, n in enumerate(sorted(self.manifest()["sources"]))]
        out = None
        for p in parts:
            out = p if out is None else out.unionByName(p, allowMissingColumns=True)
        return out

    def publish(self, spark: SparkSession) -> dict:
        """The corpus of all committed sources: entities of which the first row wins, and merged totals. Only counts are published."""
        entities, totals = self.read(spark, "entities"), self.read(spark, "totals")
        whole = first_wins(entities.withColumn("properties", F.to_json("properties")), ["source_rank", "schema"])
        whole.write.mode("overwrite").parquet(str(self.root / "aggregate" / "entities"))
        by_schema = {r["schema"]: r["count"] for r in spark.read.parquet(str(self.root / "aggregate" / "entities")).groupBy("schema").count().collect()}
        summary = {"entities": by_schema, "totals": merge_totals(totals.drop("source_rank")).first().asDict() if totals is not None else None}
        now = self.manifest()
        now["aggregate"] = {"sources": {n: s["generation"] for n, s in now["sources"].items()}}
        durable_write(self.root / "aggregate" / "summary.json", json.dumps(summary, sort_keys=True), 0o644)
        durable_write(self.root / MANIFEST, json.dumps(now, sort_keys=True), 0o644)
        return summary

    def retain(self, keep: int = 2) -> list[str]:
        """Removes generations before the last ``keep`` of each source, and what was staged; gives their paths."""
        gone = []
        for name, s in self.manifest()["sources"].items():
            for p in (self.root / "generations" / name).iterdir():
                if int(p.name) <= s["generation"] - keep:
                    shutil.rmtree(p)
                    gone.append(str(p))
        shutil.rmtree(self.root / "staging", ignore_errors=True)
        return sorted(gone)
