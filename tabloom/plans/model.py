"""The mapping plan: what a table's columns become. It is small and lives on the driver."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field


@dataclass
class Selection:
    """Rows whose raw cell equals a value, verbatim."""

    column: str
    value: str


@dataclass
class Entity:
    key: str
    schema: str
    keys: list[str] = field(default_factory=list)
    filter: Selection | None = None


@dataclass
class Relation:
    key: str
    schema: str
    source: str
    target: str
    keys: list[str] = field(default_factory=list)


@dataclass
class Binding:
    column: str
    prop: str
    entity: str
    type_name: str
    why: str = ""
    replica: bool = False


@dataclass
class Attachment:
    """An entity-typed property: ``entity``'s ``prop`` refers to ``target``."""

    entity: str
    prop: str
    target: str


@dataclass
class Decision:
    column: str
    prop: str | None
    entity: str | None
    verdict: str
    reason: str = ""
    decided_by: str = "rule"


@dataclass
class Plan:
    subject: str
    entities: list[Entity] = field(default_factory=list)
    edges: list[Relation] = field(default_factory=list)
    bindings: list[Binding] = field(default_factory=list)
    attachments: list[Attachment] = field(default_factory=list)
    decisions: list[Decision] = field(default_factory=list)

    def entity(self, key: str) -> Entity | None:
        return next((e for e in self.entities if e.key == key), None)

    def edge(self, key: str) -> Relation | None:
        return next((e for e in self.edges if e.key == key), None)

    def column_types(self) -> dict[str, str]:
        """A column is canonicalised once, under the type of its last binding."""
        return {b.column: b.type_name for b in self.bindings}

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Plan:
        d = json.loads(text)
        return cls(
            d["subject"],
            [Entity(e["key"], e["schema"], e["keys"], Selection(**e["filter"]) if e.get("filter") else None) for e in d["entities"]],
            [Relation(**e) for e in d["edges"]],
            [Binding(**b) for b in d["bindings"]],
            [Attachment(**a) for a in d["attachments"]],
            [Decision(**x) for x in d["decisions"]],
        )
