"""What headers say of parties and their relations: role words, groups of columns, levels."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Mapping
from dataclasses import dataclass

from tabloom.plans.facts import ColumnFacts
from tabloom.plans.model import Attachment, Binding, Decision, Entity, Plan, Relation
from tabloom.plans.ontology import Ontology
from tabloom.plans.shortlist import fold_text, spellings_of

@dataclass(frozen=True)
class RoleWords:
    """What the headers at hand call parties: configuration of the caller.

    ``roles``: words by the relation and the end that the named party is (a property as ``Schema:prop``);
    ``levels``: words of organisational levels, the coarsest first.
    """

    roles: Mapping[tuple[str, str], tuple[str, ...]]
    levels: tuple[str, ...] = ()

    def spelled(self) -> list[tuple[str, str, str]]:
        """(word, relation, side), the longest word first."""
        return sorted(((w, r, s) for (r, s), ws in self.roles.items() for w in ws), key=lambda x: (-len(x[0]), x[1], x[2]))


#: Words of the registers that this project is tried on.
DEFAULT_WORDS = RoleWords(
    {
        ("Debt", "source"): ("боржник", "debtor"),
        ("Debt", "target"): ("стягувач", "кредитор", "creditor"),
        ("Ownership", "source"): ("власник", "власниця", "holder", "owner"),
        ("Directorship", "source"): ("директор", "управитель", "manager"),
        ("ContractAward", "source"): ("підрядник", "виконавець робіт", "contractor"),
        ("Employment", "target"): ("роботодавець", "employer"),
        ("Employment", "source"): ("працівник", "employee"),
        ("Membership", "target"): ("членство в", "member of"),
        ("Vehicle:operator", "target"): ("перевізник", "carrier"),
        ("Organization:parent", "source"): ("структурний підрозділ", "subsidiary"),
    },
    ("управління", "відділ", "сектор", "бригада"),
)


@dataclass(frozen=True)
class Role:
    relation: str
    side: str
    word: str


def _has(text: str, word: str) -> int:
    m = re.search(rf"(?<!\w){re.escape(word)}(?!\w)", text)
    return m.start() if m else -1


def roles_in(text: str | None, words: RoleWords = DEFAULT_WORDS) -> list[Role]:
    """Role words of a text in its order, the longest first where they overlap, one per relation."""
    folded, taken, out = fold_text(text), [], []
    for word, relation, side in words.spelled():
        at = _has(folded, word)
        if at >= 0 and not any(a < at + len(word) and at < b and (b - a) > len(word) for a, b in taken) and relation not in {r.relation for _, r in out}:
            taken.append((at, at + len(word)))
            out.append((at, Role(relation, side, word)))
    return [r for _, r in sorted(out, key=lambda x: (x[0], x[1].relation))]


def role_of(column: ColumnFacts, words: RoleWords = DEFAULT_WORDS) -> Role | None:
    for text in (column.header, column.label, column.group):
        found = roles_in(text, words)
        if found:
            return found[0]
    return None


def role_keyed(entity: Entity, facts: Mapping[str, ColumnFacts], words: RoleWords = DEFAULT_WORDS) -> bool:
    """Whether a key column's texts name a role: such an entity is a party that the row names, never the row itself."""
    return any(role_of(facts[k], words) is not None for k in entity.keys if k in facts)


def share_prefix_group(groups: Mapping[str, list[str]], a: Entity, b: Entity, facts: Mapping[str, ColumnFacts], words: RoleWords = DEFAULT_WORDS) -> bool:
    """Whether two entities are keyed within one group of columns and neither is a party by its role: they are one thing."""
    if role_keyed(a, facts, words) or role_keyed(b, facts, words):
        return False
    return any(set(a.keys) & set(ids) and set(b.keys) & set(ids) and set(a.keys) | set(b.keys) <= set(ids) for ids in groups.values())


def level_rank(header: str | None, words: RoleWords = DEFAULT_WORDS) -> int | None:
    """How fine an organisational level a header names; None if none."""
    folded = fold_text(header)
    ranks = [k for k, w in enumerate(words.levels) if _has(folded, w) >= 0]
    return max(ranks) if ranks else None


def prefix_groups(columns: list[ColumnFacts]) -> dict[str, list[str]]:
    """Columns whose field-name headers share their first words: prefix -> column ids."""
    tokens = {c.id: [t for t in re.split(r"[_.\-]+", (c.header or "").lower()) if t] for c in columns if c.header and " " not in c.header.strip()}
    by_first: dict[str, list[str]] = defaultdict(list)
    for cid, t in tokens.items():
        if len(t) > 1:
            by_first[t[0]].append(cid)
    out = {}
    for ids in by_first.values():
        if len(ids) > 1:
            prefix = tokens[ids[0]][:-1]
            for cid in ids[1:]:
                n = 0
                while n < min(len(prefix), len(tokens[cid]) - 1) and prefix[n] == tokens[cid][n]:
                    n += 1
                prefix = prefix[:n]
            out["_".join(prefix)] = ids
    return out


def nearest_in_range(at: int, entities: list[tuple[str, int]]) -> str | None:
    """The entity whose column is nearest; none at a tie."""
    if not entities:
        return None
    ranked = sorted((abs(i - at), key) for key, i in entities)
    return None if len(ranked) > 1 and ranked[0][0] == ranked[1][0] else ranked[0][1]


def _unique(plan: Plan, key: str) -> str:
    used = {e.key for e in plan.entities} | {e.key for e in plan.edges}
    out, n = key, 2
    while out in used:
        out, n = f"{key}_{n}", n + 1
    return out


def party_schema(c: ColumnFacts) -> str | None:
    if c.rate("legal_name", "org_name") >= 0.5 and c.rate("legal_name", "org_name") > c.rate("proper_name"):
        return "Organization"
    if c.rate("proper_name") >= 0.5:
        return "Person"
    return "LegalEntity" if c.text_share >= 0.5 else None


def declare_parties(plan: Plan, columns: list[ColumnFacts], words: RoleWords = DEFAULT_WORDS) -> None:
    """Columns of names whose header names a role become parties of their own, keyed and named on them."""
    used = {b.column for b in plan.bindings} | {k for e in plan.entities for k in e.keys}
    for c in columns:
        role = role_of(c, words)
        if role is None or c.id in used:
            continue
        schema = "Organization" if level_rank(c.header, words) is not None else party_schema(c)
        if schema is None or c.text_share < 0.5:
            continue
        key = _unique(plan, role.word.split()[0])
        plan.entities.append(Entity(key, schema, [c.id]))
        plan.bindings.append(Binding(c.id, f"{schema}:name", key, "name", "the header names a party"))
        plan.decisions.append(Decision(c.id, f"{schema}:name", key, "accepted", "the header names a party"))


def declare_places(plan: Plan, columns: list[ColumnFacts], onto: Ontology) -> None:
    """A column that spells a city, of words, is an address if nothing else is bound to it."""
    used = {b.column for b in plan.bindings}
    for c in columns:
        if c.id not in used and fold_text(c.header) in spellings_of(onto, "Address", "city") and c.text_share >= 0.9:
            key = _unique(plan, "place")
            plan.entities.append(Entity(key, "Address", [c.id]))
            plan.bindings.append(Binding(c.id, "Address:city", key, "string", "the header spells a city"))


def declare_address_block(plan: Plan, columns: list[ColumnFacts], onto: Ontology) -> None:
    """Three or more address fields, a street or post name among them, make one address."""
    used = {b.column for b in plan.bindings}
    found = [(c.id, p) for c in columns for p in ("street", "city", "region", "postalCode", "country") if c.id not in used and fold_text(c.header) in spellings_of(onto, "Address", p)]
    if len(found) >= 3 and any(p in ("street", "postalCode") for _, p in found):
        key = _unique(plan, "address")
        plan.entities.append(Entity(key, "Address", [c for c, _ in found]))
        for c, p in found:
            plan.bindings.append(Binding(c, f"Address:{p}", key, onto.props("Address")[p].type, "a block of address fields"))


def name_from_key(plan: Plan, columns: list[ColumnFacts], onto: Ontology) -> None:
    """A party keyed on one column of words that nothing names is named by it."""
    facts = {c.id: c for c in columns}
    for e in plan.entities:
        named = any(b.entity == e.key and b.prop.endswith(":name") for b in plan.bindings)
        if not named and len(e.keys) == 1 and e.keys[0] in facts and facts[e.keys[0]].text_share >= 0.9 and (onto.is_party(e.schema) or e.schema in ("Position", "Vehicle")):
            plan.bindings.append(Binding(e.keys[0], f"{e.schema}:name", e.key, "name", "the key is the name"))


def id_from_key(plan: Plan, columns: list[ColumnFacts], floor: float = 0.5) -> None:
    """A person keyed on one unbound column of codes has it as an identity number."""
    facts = {c.id: c for c in columns}
    for e in plan.entities:
        if e.schema == "Person" and len(e.keys) == 1 and e.keys[0] in facts:
            c = facts[e.keys[0]]
            if c.text_share < 0.1 and c.distinct_ratio >= floor and not any(b.column == c.id for b in plan.bindings):
                plan.bindings.append(Binding(c.id, "Person:idNumber", e.key, "identifier", "the key is a code"))


def bind_by_detector(plan: Plan, columns: list[ColumnFacts], onto: Ontology) -> None:
    """Unbound phone and mail columns go to the party whose header shares a word, else to the row's party."""
    used = {b.column for b in plan.bindings}
    facts = {c.id: c for c in columns}
    parties = [e for e in plan.entities if onto.is_party(e.schema)]
    for c in columns:
        kind = "email" if c.rate("email") >= 0.8 else "phone" if c.rate("phone_ua", "phone_ru") >= 0.8 else None
        if kind is None or c.id in used or not parties:
            continue
        words = set(re.findall(r"\w{3,}", fold_text(c.header)))
        shared = [e for e in parties if any(words & set(re.findall(r"\w{3,}", fold_text(facts[k].header))) for k in e.keys if k in facts)]
        holder = shared[0] if len(shared) == 1 else parties[0]
        plan.bindings.append(Binding(c.id, f"{holder.schema}:{kind}", holder.key, kind, "the values are contacts"))


def _position(plan: Plan, key: str, facts: dict[str, ColumnFacts]) -> int:
    e = plan.entity(key)
    return min((facts[k].index for k in e.keys if k in facts), default=0) if e else 0


def derive_relations(plan: Plan, columns: list[ColumnFacts], onto: Ontology, words: RoleWords = DEFAULT_WORDS) -> None:
    """Each party's role words state an edge or an entity property to its counterpart on the row."""
    facts = {c.id: c for c in columns}
    row = next((e for e in plan.entities if not any(role_of(facts[k], words) for k in e.keys if k in facts)), None)
    for e in list(plan.entities):
        role = next((role_of(facts[k], words) for k in e.keys if k in facts and role_of(facts[k], words)), None)
        if role is None or role.relation == "Debt":
            continue
        relation, _, prop = role.relation.partition(":")
        if prop:
            holders = [x for x in plan.entities if x.key != e.key and onto.is_a(x.schema, relation)] if role.side == "target" else [e]
            targets = [e] if role.side == "target" else [x for x in plan.entities if x.key != e.key and onto.is_a(x.schema, relation)]
            if len(holders) == 1 == len(targets):
                plan.attachments.append(Attachment(holders[0].key, prop, targets[0].key))
            continue
        edge = onto.schemata[relation].edge
        own, other = (edge.source_range, edge.target_range) if role.side == "source" else (edge.target_range, edge.source_range)
        if not onto.specialise(e.schema, own):
            continue
        fits = [x for x in plan.entities if x.key != e.key and onto.is_a(x.schema, other)]
        at = _position(plan, e.key, facts)
        counter = row.key if row in fits else fits[0].key if len(fits) == 1 else nearest_in_range(at, [(x.key, _position(plan, x.key, facts)) for x in fits])
        if counter is None or any({r.source, r.target} == {e.key, counter} and r.schema == relation for r in plan.edges):
            continue
        source, target = (e.key, counter) if role.side == "source" else (counter, e.key)
        plan.edges.append(Relation(_unique(plan, relation.lower()), relation, source, target))


def derive_debts(plan: Plan, columns: list[ColumnFacts], onto: Ontology, words: RoleWords = DEFAULT_WORDS) -> None:
    """Debtor to creditor; without a creditor the nearest body that has no role."""
    facts = {c.id: c for c in columns}
    role = {e.key: next((role_of(facts[k], words) for k in e.keys if k in facts and role_of(facts[k], words)), None) for e in plan.entities}
    debtors = [k for k, r in role.items() if r and r.relation == "Debt" and r.side == "source"]
    creditors = [k for k, r in role.items() if r and r.relation == "Debt" and r.side == "target"]
    for d in debtors:
        bodies = [(k, _position(plan, k, facts)) for k, r in role.items() if r is None and k != d and onto.is_party(plan.entity(k).schema)]
        c = creditors[0] if len(creditors) == 1 else nearest_in_range(_position(plan, d, facts), bodies)
        if c and not any(r.schema == "Debt" for r in plan.edges):
            plan.edges.append(Relation(_unique(plan, "debt"), "Debt", d, c))


def bind_edge_properties(plan: Plan, columns: list[ColumnFacts], onto: Ontology, words: RoleWords = DEFAULT_WORDS) -> None:
    """An unbound column whose header, without the ends' words, spells one property of one relation."""
    used = {b.column for b in plan.bindings} | {k for e in plan.entities for k in e.keys}
    for c in columns:
        if c.id in used:
            continue
        header = fold_text(c.header)
        for w, *_ in words.spelled():
            header = re.sub(rf"(?<!\w){re.escape(w)}(?!\w)", " ", header)
        header = " ".join(header.split())
        fits = [(r, p) for r in plan.edges for p in onto.props(r.schema).values() if header in spellings_of(onto, r.schema, p.name)]
        if len(fits) == 1:
            r, p = fits[0]
            plan.bindings.append(Binding(c.id, f"{r.schema}:{p.name}", r.key, p.type, "the header spells a property of the relation"))
