"""An optional local model beside the rules: prompts from statistics, closed answers, a cache that replays.

Only a loopback address is spoken to. A prompt holds column statistics and
samples, never rows; an answer is taken only as far as the closed grammar of its
stage allows. Every answer is kept under a hash of all that could change it, so
a run can be replayed without the model.
"""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass, field
from pathlib import Path
from urllib.parse import urlsplit
from urllib.request import Request, urlopen

from tabloom.plans.facts import ColumnFacts
from tabloom.plans.model import Binding, Decision, Entity, Plan
from tabloom.plans.ontology import Ontology
from tabloom.plans.shortlist import Candidate, shortlist

STAGES = ("structure", "binding", "repair")
CHUNK = 20


def describe(c: ColumnFacts) -> str:
    """A column in one line: names, fill, distinctness, shapes, detectors, samples."""
    names = " / ".join(x for x in (c.group, c.header, c.label) if x) or "(no header)"
    shapes = ", ".join(f"{s} {share:.0%}" for s, share in c.shapes[:3])
    rates = ", ".join(f"{k} {v:.0%}" for k, v in sorted(c.detectors.items(), key=lambda x: (-x[1], x[0]))[:4])
    return f"{c.id}: {names}; filled {c.fill_rate:.0%}, distinct {c.distinct_ratio:.0%}; shapes {shapes or '-'}; reads as {rates or '-'}; samples {' | '.join(c.samples[:5]) or '-'}"


def structure_prompt(columns: list[ColumnFacts], schemata: list[str]) -> str:
    return "\n".join(["[structure] Which things does a row of this table describe, and which columns tell them apart?", *map(describe, columns), "Schemata: " + ", ".join(schemata)])


def binding_prompt(columns: list[ColumnFacts], candidates: dict[str, list[Candidate]], plan: Plan) -> str:
    lines = ["[binding] Which property does each column hold? Answer none where no candidate fits.", "Entities: " + ", ".join(f"{e.key} ({e.schema})" for e in plan.entities)]
    for c in columns:
        lines += [describe(c), "  candidates: " + (", ".join(x.qname for x in candidates[c.id]) or "none")]
    return "\n".join(lines)


def repair_prompt(refused: list[Decision]) -> str:
    return "\n".join(["[repair] These answers were refused. Give others or none.", *(f"{d.column}: {d.prop} on {d.entity}: {d.reason}" for d in refused)])


def stage_of(prompt: str) -> str | None:
    return next((s for s in STAGES if prompt.startswith(f"[{s}]")), None)


def structure_grammar(columns: list[ColumnFacts], schemata: list[str]) -> dict:
    ids = {"enum": [c.id for c in columns]}
    entity = {"type": "object", "properties": {"key": {"type": "string"}, "schema": {"enum": schemata}, "keys": {"type": "array", "items": ids}}, "required": ["key", "schema", "keys"]}
    return {"type": "object", "properties": {"subject": {"enum": schemata}, "entities": {"type": "array", "items": entity}}, "required": ["subject", "entities"]}


def binding_grammar(candidates: dict[str, list[Candidate]], plan: Plan) -> dict:
    one = lambda c: {"type": "object", "properties": {"prop": {"enum": [*[x.qname for x in candidates[c]], "none"]}, "entity": {"enum": [e.key for e in plan.entities]}}, "required": ["prop", "entity"]}
    return {"type": "object", "properties": {c: one(c) for c in candidates}, "required": []}


def prune(value: object, grammar: dict) -> object:
    """A free answer cut down to its grammar; None where nothing of it fits."""
    if "enum" in grammar:
        return value if value in grammar["enum"] else None
    if grammar.get("type") == "array":
        kept = [prune(v, grammar["items"]) for v in value] if isinstance(value, list) else []
        return [v for v in kept if v is not None]
    if grammar.get("type") == "object":
        if not isinstance(value, dict):
            return None
        out = {k: p for k, g in grammar["properties"].items() if k in value and (p := prune(value[k], g)) is not None}
        return out if all(k in out for k in grammar.get("required", [])) else None
    return value if isinstance(value, str) else None


class NotLocal(ValueError):
    """The model's address isn't of this machine."""


@dataclass
class LocalModel:
    url: str
    cache: Path
    replay: bool = False
    identity: str = ""
    seed: int = 1
    max_tokens: int = 3000
    timeout: float = 120.0
    counters: dict[str, dict[str, int]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if urlsplit(self.url).hostname not in ("127.0.0.1", "localhost", "::1"):
            raise NotLocal(self.url)
        self.cache = Path(self.cache)

    def ask(self, prompt: str, grammar: dict) -> object:
        """The pruned answer of a stage; from the cache if it was given before."""
        stage = stage_of(prompt) or "other"
        count = self.counters.setdefault(stage, {"live": 0, "replayed": 0})
        body = {"prompt": prompt, "json_schema": grammar, "seed": self.seed, "temperature": 0.0, "n_predict": self.max_tokens}
        key = hashlib.sha256(json.dumps([self.identity, body], ensure_ascii=False, sort_keys=True).encode()).hexdigest()
        path = self.cache / key[:2] / f"{key}.json"
        if path.exists():
            count["replayed"] += 1
            text = json.loads(path.read_text())["content"]
        elif self.replay:
            raise LookupError(f"no answer is kept for this {stage} prompt")
        else:
            count["live"] += 1
            request = Request(f"{self.url.rstrip('/')}/completion", json.dumps(body).encode(), {"Content-Type": "application/json"})
            with urlopen(request, timeout=self.timeout) as answer:  # noqa: S310 - a loopback address, checked above
                text = json.loads(answer.read())["content"]
            path.parent.mkdir(parents=True, exist_ok=True)
            staged = path.with_suffix(".new")
            staged.write_text(json.dumps({"content": text}))
            os.replace(staged, path)
        try:
            return prune(json.loads(text), grammar)
        except json.JSONDecodeError:
            return None


def propose_with(model: LocalModel, columns: list[ColumnFacts], onto: Ontology) -> Plan:
    """Structure first, then bindings in chunks; what the model leaves out stays unmapped. The rules check all of it."""
    schemata = [s for s in onto.concrete() if onto.schemata[s].edge is None]
    got = model.ask(structure_prompt(columns, schemata), structure_grammar(columns, schemata)) or {"subject": "Thing", "entities": []}
    plan = Plan(got["subject"], [Entity(e["key"], e["schema"], e["keys"]) for e in got["entities"]])
    near = list(dict.fromkeys(e.schema for e in plan.entities))
    for at in range(0, len(columns), CHUNK):
        part = columns[at : at + CHUNK]
        listed = {c.id: shortlist(c, onto, near) for c in part} if near else {}
        answer = (model.ask(binding_prompt(part, listed, plan), binding_grammar(listed, plan)) if listed else None) or {}
        for c in part:
            x = answer.get(c.id)
            e = plan.entity(x["entity"]) if x else None
            name = x["prop"].partition(":")[2] if x else ""
            prop = onto.props(e.schema).get(name) if e else None
            if prop:
                plan.bindings.append(Binding(c.id, f"{e.schema}:{name}", e.key, prop.type, "the model's choice"))
                plan.decisions.append(Decision(c.id, f"{e.schema}:{name}", e.key, "accepted", "", "model"))
            else:
                plan.decisions.append(Decision(c.id, None, None, "unmapped", "", "model"))
    return plan
