"""A source from file to committed graph: read, profile, plan, execute, account, commit."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators import ledger as L
from tabloom.operators.layout import Frame
from tabloom.plans import compile as P
from tabloom.plans.facts import profile_frame
from tabloom.plans.model import Plan
from tabloom.plans.validate import Context, propose, validate
from tabloom.sources.inventory import digest, safe_id
from tabloom.sources.reader import frames
from tabloom.sources.store import Clock, Workspace, failure_code


def execute(frame: DataFrame, plan: Plan, source: P.Source, headers: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """All tables of one plan over one frame. The normalised rows feed each of them and are kept while they do."""
    rows = P.normalised(frame, plan).persist()
    long = P.facts(rows, plan, source)
    claims, cover = L.claim_ledger(rows, long, plan), L.coverage(frame, rows, plan)
    return {
        "statements": P.statements(long, plan, source, headers, {b.column: "rule" for b in plan.bindings}),
        "rejects": P.rejects(long),
        "entities": P.entities(long, P.references(rows, plan, source), P.declared_ids(rows, plan, source)),
        "coverage": cover,
        "claims": claims,
        "totals": L.totals(cover, claims),
        "rows": rows,
    }


def run_frame(frame: Frame, workspace: Workspace, source: P.Source, refinement: str = "rules", overrides: dict | None = None) -> dict:
    clock = Clock()
    with clock.stage("profile"):
        facts = profile_frame(frame.rows, frame.columns)
    with clock.stage("plan"):
        plan = validate(propose(frame.rows, facts), Context(frame.rows, facts), refinement, overrides)
    name = safe_id(source.source_id + source.sheet)
    documents = {"plan.json": plan.to_json(), "mapping.json": P.mapping_document(plan, source), "decisions.json": json.dumps([asdict(d) for d in plan.decisions], ensure_ascii=False), "profile.json": json.dumps([asdict(f) for f in facts], ensure_ascii=False)}
    if not plan.bindings:
        summary = {"source": name, "declined": "no column fits a property", "seconds": clock.stages}
        workspace.commit(name, {}, documents | {"summary.json": summary}, required=())
        return summary
    with clock.stage("execute"):
        tables = execute(frame.rows, plan, source, {c["id"]: c["header"] or "" for c in frame.columns})
        rows = tables.pop("rows")
        # Only counts leave a run.
        total = tables["totals"].first().asDict()
        by_schema = {r["schema"]: r["count"] for r in tables["entities"].groupBy("schema").count().collect()}
        summary = {"source": name, "entities": by_schema, "totals": total, "columns": len(frame.columns), "bound": len({b.column for b in plan.bindings}), "seconds": clock.stages}
        workspace.commit(name, tables, documents | {"summary.json": summary})
        rows.unpersist()
    return summary


def run_path(spark: SparkSession, path: str, workspace: Workspace, refinement: str = "rules") -> list[dict]:
    """Every sheet of a file; one that fails doesn't keep the others from being committed."""
    out, sha = [], digest(path)
    with workspace.lock():
        for sheet, frame in frames(spark, path).items():
            source = P.Source(f"{sha[:12]}/", path, sheet, sha, "run")
            try:
                out.append(run_frame(frame, workspace, source, refinement))
            except Exception as error:  # noqa: BLE001
                out.append({"source": safe_id(source.source_id + sheet), "failure": failure_code(error)})
    return out


def summary_table(spark: SparkSession, summaries: list[dict]) -> DataFrame:
    """Entities by source and schema with sums over sources and over all (ROLLUP)."""
    rows = [(s["source"], k, n) for s in summaries for k, n in s.get("entities", {}).items()]
    df = spark.createDataFrame(rows, "source string, schema string, entities long")
    return df.rollup("source", "schema").agg(F.sum("entities").alias("entities"))
