"""Runs held against gold answers: column, subject, entity and edge verdicts with their own denominators."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.plans.ontology import Ontology, default

# Verdicts of a column, the best first.
VERDICTS = ("AGREE", "BOTH-DEFENSIBLE", "STRETCHED", "KEY-ONLY", "PIPELINE-WRONG", "MISSED")
#: Share by which the number of instances may differ.
TOLERANCE = 0.05


def column_verdicts(gold: DataFrame, bound: DataFrame, keys: DataFrame) -> DataFrame:
    """Per gold column the best verdict of its bindings.

    ``gold`` (source_id, column, prop, accepted array of further defensible properties),
    ``bound`` (source_id, column, prop), ``keys`` (source_id, column): columns that are only keys.
    """
    run = bound.select("source_id", "column", F.col("prop").alias("got"))
    key = keys.select("source_id", "column", F.lit(True).alias("is_key")).distinct()
    both = gold.join(run, ["source_id", "column"], "left").join(key, ["source_id", "column"], "left")
    verdict = (
        F.when(F.col("prop").isNull() & F.col("got").isNotNull(), "STRETCHED")
        .when(F.col("prop").isNull(), "AGREE")
        .when(F.col("got") == F.col("prop"), "AGREE")
        .when(F.array_contains("accepted", F.col("got")), "BOTH-DEFENSIBLE")
        .when(F.col("got").isNotNull(), "PIPELINE-WRONG")
        .when(F.col("is_key"), "KEY-ONLY")
        .otherwise("MISSED")
    )
    rank = F.array_position(F.array(*map(F.lit, VERDICTS)), F.col("verdict"))
    judged = both.withColumn("verdict", verdict)
    return judged.groupBy("source_id", "column").agg(F.min_by("verdict", F.struct(rank, F.coalesce("got", F.lit("")))).alias("verdict"))


def verdict_totals(verdicts: DataFrame) -> DataFrame:
    """Counts per verdict and the share of agreement among judged columns; null where none was judged."""
    counts = [F.count_if(F.col("verdict") == v).alias(v.lower().replace("-", "_")) for v in VERDICTS]
    n = F.count(F.lit(1))
    agree = F.count_if(F.col("verdict").isin("AGREE", "BOTH-DEFENSIBLE"))
    return verdicts.agg(n.alias("columns"), *counts, F.try_divide(agree.cast("double"), n).alias("agree_share"))


def subject_verdict(gold: str, accepted: list[str], got: str | None) -> str:
    return "SUBJECT-AGREE" if got == gold else "SUBJECT-ACCEPTABLE" if got in accepted else "SUBJECT-WRONG"


@dataclass
class GoldEntity:
    key: str
    schema: str
    keys: list[str] = field(default_factory=list)
    instances: int | None = None


def _likeness(gold: GoldEntity, run: GoldEntity, onto: Ontology) -> float:
    schema = 2.0 if gold.schema == run.schema else 1.0 if onto.is_a(gold.schema, run.schema) or onto.is_a(run.schema, gold.schema) else 0.0
    keys = len(set(gold.keys) & set(run.keys)) / len(set(gold.keys) | set(run.keys)) if gold.keys or run.keys else 1.0
    return schema * (1 + keys) if schema else 0.0


def entity_verdicts(gold: list[GoldEntity], run: list[GoldEntity], onto: Ontology | None = None) -> list[dict]:
    """Pairs of best likeness, each used once; verdicts on schema, keys and number of instances. Plans are small."""
    onto = onto or default()
    scored = sorted(((-_likeness(g, r, onto), i, j) for i, g in enumerate(gold) for j, r in enumerate(run)), key=lambda x: x)
    taken: dict[int, int] = {}
    for s, i, j in scored:
        if s < 0 and i not in taken and j not in taken.values():
            taken[i] = j
    out = []
    for i, g in enumerate(gold):
        r = run[taken[i]] if i in taken else None
        if r is None:
            out.append({"gold": g.key, "run": None, "verdict": "ENTITY-MISSING", "keys": None, "instances": None})
            continue
        verdict = "ENTITY-AGREE" if r.schema == g.schema else "ENTITY-GENERALISED" if onto.is_a(g.schema, r.schema) else "ENTITY-WRONG"
        near = None if g.instances is None or r.instances is None else abs(r.instances - g.instances) <= TOLERANCE * g.instances
        out.append({"gold": g.key, "run": r.key, "verdict": verdict, "keys": set(g.keys) == set(r.keys), "instances": near})
    return out


def edge_verdicts(gold: list[tuple[str, str, str]], run: list[tuple[str, str, str]], pairs: dict[str, str]) -> list[dict]:
    """Edges (schema, source, target): first those with both ends, then by schema alone; each used once."""
    left, out = list(run), []
    for schema, a, b in gold:
        exact = next((e for e in left if e == (schema, pairs.get(a), pairs.get(b))), None)
        out.append([(schema, a, b), exact])
        if exact:
            left.remove(exact)
    result = []
    for want, exact in out:
        loose = None if exact else next((e for e in left if e[0] == want[0]), None)
        if loose:
            left.remove(loose)
        result.append({"gold": want, "run": exact or loose, "verdict": "EDGE-AGREE" if exact else "EDGE-ENDS-DIFFER" if loose else "EDGE-MISSING"})
    return result + [{"gold": None, "run": e, "verdict": "EDGE-EXTRA"} for e in left]


def validate_gold(doc: dict, onto: Ontology | None = None) -> list[str]:
    """What is wrong with a gold answer; an empty list if nothing is."""
    onto, wrong = onto or default(), []
    for name in ("source", "answer"):
        if name not in doc:
            wrong.append(f"no {name}")
    answer = doc.get("answer", {})
    keys = [e.get("key") for e in answer.get("entities", [])]
    if len(keys) != len(set(keys)):
        wrong.append("two entities of one key")
    for e in answer.get("entities", []):
        if e.get("schema") not in onto.schemata:
            wrong.append(f"no schema {e.get('schema')}")
    for c in answer.get("columns", []):
        if c.get("prop") and onto.prop(c["prop"]) is None:
            wrong.append(f"no property {c['prop']}")
    for e in answer.get("edges", []):
        wrong += [f"no entity {e.get(x)}" for x in ("source", "target") if e.get(x) not in keys]
    return wrong


def compare_arms(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs' column verdicts as a cube: how often each pair of verdicts occurs, with all margins."""
    both = a.select("source_id", "column", F.col("verdict").alias("verdict_a")).join(b.select("source_id", "column", F.col("verdict").alias("verdict_b")), ["source_id", "column"])
    return both.cube("verdict_a", "verdict_b").agg(F.count(F.lit(1)).alias("columns"))
