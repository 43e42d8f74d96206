"""The gate between a proposed and an executable plan: a fixed order of rules over metadata.

Data questions of a whole stage are asked in one Spark job (acceptance of all
bindings, hits of all filters), never one job per column.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.canonical import FREE_TYPES
from tabloom.operators import statistics as S
from tabloom.plans import roles as R
from tabloom.plans.compile import evidence, key_columns
from tabloom.plans.facts import ColumnFacts
from tabloom.plans.model import Attachment, Binding, Decision, Entity, Plan, Relation, Selection
from tabloom.plans.ontology import MERGEABLE, Ontology, default
from tabloom.plans.shortlist import Candidate, candidate_pairs, contradicts, fold_text, identifier_keys, is_machinery, is_stray, subject_vote

# Shares of values that must canonicalise, by type; all others accept any.
ACCEPT = {"date": 0.9, "phone": 0.9, "email": 0.9, "url": 0.9, "country": 0.9, "gender": 0.9, "identifier": 0.8, "checksum": 0.8, "topic": 0.9, "language": 0.9, "ip": 0.9, "mimetype": 0.9}
KEY_FILL, KEY_DISTINCT, NESTING, VALUES_PER_KEY = 0.9, 0.5, 0.9, 2


@dataclass
class Context:
    frame: DataFrame
    columns: list[ColumnFacts]
    onto: Ontology = field(default_factory=default)
    words: R.RoleWords = R.DEFAULT_WORDS
    strengths: dict[tuple[str, str, str], float] = field(default_factory=dict)
    #: Acceptance by column and type, as far as it was asked; the frame stays the same.
    shares: dict[tuple[str, str], float] = field(default_factory=dict)

    def facts(self, column: str) -> ColumnFacts | None:
        return next((c for c in self.columns if c.id == column), None)


def propose(frame: DataFrame, columns: list[ColumnFacts], onto: Ontology | None = None, mode: str = "heuristic") -> Plan:
    """A plan from statistics alone: a subject, its key, a binding per column that fits one property."""
    onto = onto or default()
    live = [c for c in columns if not is_stray(c) and not is_machinery(c.header)]
    kinds = kind_selections(frame, live, onto)
    subject = kinds[0][2] if kinds else subject_vote(live, onto)
    keys = identifier_keys(live)[:1] or [c.id for c in sorted(live, key=lambda c: (-c.identification, c.index)) if c.fill_rate >= KEY_FILL and c.identification >= 0.99][:1]
    plan = Plan(subject)
    if kinds:
        for column, value, schema in kinds:
            plan.entities.append(Entity(value.lower(), schema, list(keys), Selection(column, value)))
    else:
        plan.entities.append(Entity(subject.lower(), subject, list(keys)))
    for c in live:
        pick: Candidate | None = candidate_pairs([c], onto, subject, mode)[c.id]
        if pick is None:
            plan.decisions.append(Decision(c.id, None, None, "unmapped", "no property, or several alike"))
            continue
        for e in plan.entities:
            own = onto.props(e.schema).get(pick.prop.name)
            if own:
                plan.bindings.append(Binding(c.id, f"{e.schema}:{own.name}", e.key, own.type, "header and values"))
                plan.decisions.append(Decision(c.id, f"{e.schema}:{own.name}", e.key, "accepted", "header and values"))
        if not any(b.column == c.id for b in plan.bindings) and pick.schema != subject:
            plan.decisions.append(Decision(c.id, pick.qname, None, "unmapped", "no entity of the schema"))
    return plan


def kind_selections(frame: DataFrame, columns: list[ColumnFacts], onto: Ontology) -> list[tuple[str, str, str]]:
    """A column all of whose few values are concrete schemata: (column, value, schema) for each."""
    for c in columns:
        if 2 <= c.distinct <= 12 and c.fill_rate >= KEY_FILL and c.distinct < c.filled:
            values = [r[0] for r in frame.select(S.cell(c.id)).distinct().limit(13).collect() if r[0]]
            if values and all(v in onto.schemata and not onto.schemata[v].abstract for v in values):
                return [(c.id, v, v) for v in sorted(values)]
    return []


# -- rules ---------------------------------------------------------------------
def resolve_entity_keys(plan: Plan, ctx: Context) -> None:
    """Names used twice get a number; keys given as headers become column ids."""
    seen: dict[str, int] = {}
    for e in plan.entities:
        seen[e.key] = seen.get(e.key, 0) + 1
        if seen[e.key] > 1:
            e.key = f"{e.key}_{seen[e.key]}"
    heads: dict[str, list[str]] = {}
    for c in ctx.columns:
        if c.header:
            heads.setdefault(fold_text(c.header), []).append(c.id)
    known = {c.id for c in ctx.columns}
    for e in [*plan.entities, *plan.edges]:
        e.keys = [k if k in known else heads.get(fold_text(k), [k])[0] if len(heads.get(fold_text(k), [])) == 1 else k for k in e.keys]
        e.keys = [k for k in e.keys if k in known]


def refuse_columns(plan: Plan, ctx: Context) -> None:
    """Bindings on machinery, stray and twin columns go."""
    heads: dict[str, str] = {}
    pairs = []
    for c in ctx.columns:
        h = fold_text(c.header)
        if h and h in heads:
            pairs.append((heads[h], c.id))
        elif h:
            heads[h] = c.id
    twins = {r["b"] for r in S.twin_columns(ctx.frame, pairs).where("twin").collect()} if pairs else set()
    for b in list(plan.bindings):
        c = ctx.facts(b.column)
        why = "no such column" if c is None else "spreadsheet machinery" if is_machinery(c.header) else "a stray column" if is_stray(c) else "a copy of another column" if b.column in twins else None
        if why:
            plan.bindings.remove(b)
            plan.decisions.append(Decision(b.column, b.prop, b.entity, "rejected", why))


def check_bindings(plan: Plan, ctx: Context) -> None:
    """Property known and carried, unit in keeping, values of the type; one job for all acceptance shares."""
    items = {x.key: x for x in (*plan.entities, *plan.edges)}
    pairs = sorted({(b.column, b.type_name) for b in plan.bindings if b.type_name not in FREE_TYPES and ctx.facts(b.column)} - set(ctx.shares))
    if pairs:
        numeric = evidence(ctx.frame, plan) if any(t == "date" for _, t in pairs) else {}
        ctx.shares |= {(r["column"], r["type"]): r["share"] for r in S.acceptance(ctx.frame, pairs, numeric, most=0).collect()}
    shares = ctx.shares
    for b in list(plan.bindings):
        item, prop, c = items.get(b.entity), ctx.onto.prop(b.prop), ctx.facts(b.column)
        share = shares.get((b.column, b.type_name), 1.0)
        own_filter = isinstance(item, Entity) and item.filter and item.filter.column == b.column
        why = (
            "no such entity" if item is None
            else "no such property" if prop is None
            else "the entity's schema doesn't carry it" if prop.name not in ctx.onto.props(item.schema)
            else "an entity may not bind its own selection" if own_filter
            else "the header's unit contradicts it" if contradicts(c.header, prop.name)
            else f"{share:.2f} of its values are of the type" if share < ACCEPT.get(b.type_name, 0.0)
            else "a person's name that reads as organisations" if item.schema == "Person" and prop.name == "name" and c.rate("legal_name") >= 0.5
            else None
        )
        if why:
            plan.bindings.remove(b)
            plan.decisions.append(Decision(b.column, b.prop, b.entity, "rejected", why))
        else:
            ctx.strengths[(b.column, b.entity, b.prop)] = share * c.filled


def resolve_claims(plan: Plan, ctx: Context) -> None:
    """One column per entity and property, the strongest, unless the property's type merges."""
    best: dict[tuple[str, str], Binding] = {}
    for b in plan.bindings:
        if b.type_name in MERGEABLE:
            continue
        now = best.get((b.entity, b.prop))
        rank = lambda x: (-ctx.strengths.get((x.column, x.entity, x.prop), 0.0), ctx.facts(x.column).index)
        if now is None or rank(b) < rank(now):
            best[(b.entity, b.prop)] = b
    for b in list(plan.bindings):
        if b.type_name not in MERGEABLE and best[(b.entity, b.prop)] is not b:
            plan.bindings.remove(b)
            plan.decisions.append(Decision(b.column, b.prop, b.entity, "rejected", "another column claims the property"))


def check_filters(plan: Plan, ctx: Context) -> None:
    """A filter without hits ends its entity, one that all rows meet is none; hits of all filters in one job."""
    wanted = [e for e in plan.entities if e.filter]
    known = {c.id for c in ctx.columns}
    for e in [e for e in wanted if e.filter.column not in known]:
        e.filter = None
        wanted.remove(e)
    if not wanted:
        return
    sums = [x for n, e in enumerate(wanted) for x in (F.count_if(F.col(e.filter.column) == e.filter.value).alias(f"h{n}"), F.count(F.col(e.filter.column)).alias(f"n{n}"))]
    got = ctx.frame.agg(*sums).first()
    for n, e in enumerate(wanted):
        if got[f"h{n}"] == 0:
            plan.entities.remove(e)
            plan.decisions.append(Decision(e.filter.column, None, e.key, "rejected", "no row has the value"))
        elif got[f"h{n}"] == got[f"n{n}"]:
            e.filter = None


def floor_keys(plan: Plan, ctx: Context) -> None:
    """Key columns below the fill floor go; a keyless entity takes its identifier, else its name, else a refused key back."""
    for e in plan.entities:
        kept = [k for k in e.keys if ctx.facts(k) and (ctx.facts(k).fill_rate >= KEY_FILL or len(e.keys) == 1 and ctx.onto.is_party(e.schema))]
        refused = [k for k in e.keys if k not in kept and ctx.facts(k)]
        for k in set(e.keys) - set(kept):
            plan.decisions.append(Decision(k, None, e.key, "rejected", "a key must be filled"))
        e.keys = kept
        if e.keys or not (refused or ctx.onto.is_party(e.schema)):
            continue
        if ctx.onto.is_party(e.schema):
            e.keys = proposed_key(plan, ctx, e)
        for back in (reinstated_key, reinstated_by_dependence):
            if not e.keys and refused:
                e.keys = back(plan, ctx, e, refused)
                plan.decisions += [Decision(k, None, e.key, "accepted", "the entity has no better key") for k in e.keys]


def proposed_key(plan: Plan, ctx: Context, e: Entity) -> list[str]:
    """The well-filled column bound to the entity as identifier, else as name; the most distinct of several."""
    own = [b for b in plan.bindings if b.entity == e.key and b.type_name in ("identifier", "name") and ctx.facts(b.column).fill_rate >= KEY_FILL]
    own.sort(key=lambda b: (b.type_name != "identifier", -ctx.facts(b.column).distinct, ctx.facts(b.column).index))
    return [own[0].column] if own else []


def reinstated_key(plan: Plan, ctx: Context, e: Entity, refused: list[str]) -> list[str]:
    """Of the keys refused for their fill the most distinct one that is bound to the entity as identifier or name."""
    typed = {b.column for b in plan.bindings if b.entity == e.key and b.type_name in ("identifier", "name")}
    fits = sorted((k for k in refused if k in typed), key=lambda k: (-ctx.facts(k).distinct_ratio, ctx.facts(k).index))
    return fits[:1]


def reinstated_by_dependence(plan: Plan, ctx: Context, e: Entity, refused: list[str]) -> list[str]:
    """A refused key that determines the entity's name and is determined by it, where both are filled."""
    name = next((b.column for b in plan.bindings if b.entity == e.key and b.prop.endswith(":name")), None)
    for k in sorted(refused, key=lambda k: ctx.facts(k).index):
        if name and name != k:
            got = S.one_to_one(ctx.frame, [k], name).first()
            if got["one_to_one"] and got["pairs"] > 1:
                return [k]
    return []


def resolve_subject_contradiction(plan: Plan, ctx: Context) -> None:
    """A plan of one entity that is neither a kind of its subject nor the other way round also reads the row as the subject."""
    if len(plan.entities) != 1 or plan.subject not in ctx.onto.schemata:
        return
    only = plan.entities[0]
    if ctx.onto.is_a(only.schema, plan.subject) or ctx.onto.is_a(plan.subject, only.schema) or ctx.onto.schemata[plan.subject].abstract:
        return
    second = Entity(R._unique(plan, plan.subject.lower()), plan.subject, list(only.keys))
    plan.entities.append(second)
    for b in [b for b in plan.bindings if b.entity == only.key]:
        own = ctx.onto.props(second.schema).get(b.prop.partition(":")[2])
        if own:
            plan.bindings.append(Binding(b.column, f"{second.schema}:{own.name}", second.key, own.type, "the row read as its subject"))


def split_folded_parties(plan: Plan, ctx: Context) -> None:
    """Two role-worded name columns on one party that mostly differ are two parties."""
    for e in list(plan.entities):
        named = [b for b in plan.bindings if b.entity == e.key and b.prop.endswith(":name") and ctx.facts(b.column) and R.role_of(ctx.facts(b.column), ctx.words)]
        if len(named) == 2:
            share = S.disagreement(ctx.frame, named[0].column, named[1].column).first()["differ_share"]
            if share is not None and share > 0.5:
                second = Entity(R._unique(plan, f"{e.key}_other"), e.schema, [named[1].column])
                plan.entities.append(second)
                named[1].entity = second.key


def split_redacted_key(plan: Plan, ctx: Context) -> None:
    """A code column mostly redacted: its redacted rows are told apart by name instead."""
    for e in list(plan.entities):
        c = ctx.facts(e.keys[0]) if len(e.keys) == 1 else None
        if c is None or c.sentinel_share < 0.5 or e.filter:
            continue
        top = ctx.frame.groupBy(S.cell(c.id).alias("v")).count().where("v IS NOT NULL").orderBy(F.desc("count"), "v").first()
        name = next((b.column for b in plan.bindings if b.entity == e.key and b.prop.endswith(":name")), None)
        if top and name:
            person = (ctx.facts(name).rate("proper_name") >= 0.8) if ctx.facts(name) else False
            twin = Entity(R._unique(plan, f"{e.key}_redacted"), "Person" if person else e.schema, [name], Selection(c.id, top["v"]))
            plan.entities.append(twin)
            plan.bindings.append(Binding(name, f"{twin.schema}:name", twin.key, "name", "the code is redacted", replica=True))


def specialise_coded_party(plan: Plan, ctx: Context) -> None:
    """A legal entity keyed on company codes is an organisation."""
    for e in plan.entities:
        if e.schema == "LegalEntity" and len(e.keys) == 1 and ctx.facts(e.keys[0]) and ctx.facts(e.keys[0]).rate("edrpou") >= 0.9:
            _become(plan, e, "Organization")


def _become(plan: Plan, e: Entity, schema: str) -> None:
    for b in plan.bindings:
        if b.entity == e.key:
            b.prop = f"{schema}:{b.prop.partition(':')[2]}"
    e.schema = schema


def declare_contract(plan: Plan, ctx: Context) -> None:
    """A supplier beside procurement words makes a contract, keyed on its link or else the row."""
    words = " ".join(fold_text(c.header) for c in ctx.columns)
    supplier = any(r.relation == "ContractAward" for c in ctx.columns for r in R.roles_in(c.header, ctx.words))
    if supplier and re.search(r"закупівл|procurement|договор|contract|cpv", words) and not any(e.schema == "Contract" for e in plan.entities):
        link = next((c.id for c in ctx.columns if c.rate("url") >= 0.9 and c.fill_rate >= KEY_FILL), None)
        plan.entities.append(Entity(R._unique(plan, "contract"), "Contract", [link] if link else []))


def declare_identification(plan: Plan, ctx: Context) -> None:
    """The single certificate-number column is a document of the row's party."""
    found = [c for c in ctx.columns if re.search(r"(?:номер|№|серія|number).*(?:свідоцтв|сертифікат|посвідчен|паспорт|certificate)|(?:свідоцтв|сертифікат|certificate)\S*\s+(?:номер|№|number|no)", fold_text(c.header))]
    if len(found) == 1 and found[0].text_share < 0.5 and not any(b.column == found[0].id for b in plan.bindings):
        key = R._unique(plan, "identification")
        plan.entities.append(Entity(key, "Identification", [found[0].id]))
        plan.bindings.append(Binding(found[0].id, "Identification:number", key, "identifier", "the number of a certificate"))


def attach_identification_holder(plan: Plan, ctx: Context) -> None:
    """A document's holder: the party that the row itself is, else the only party, else the owner of the only asset; at doubt none."""
    facts = {c.id: c for c in ctx.columns}
    for e in [e for e in plan.entities if e.schema == "Identification" and not any(a.entity == e.key for a in plan.attachments)]:
        parties = [x for x in plan.entities if ctx.onto.is_party(x.schema)]
        rows = [x for x in parties if not R.role_keyed(x, facts, ctx.words)]
        owners = sorted({r.source for r in plan.edges if r.schema == "Ownership"})
        assets = [x for x in plan.entities if ctx.onto.is_a(x.schema, "Asset") and not ctx.onto.is_party(x.schema)]
        holder = rows[0].key if len(rows) == 1 else parties[0].key if len(parties) == 1 else owners[0] if len(owners) == 1 == len(assets) else None
        if holder:
            plan.attachments.append(Attachment(e.key, "holder", holder))
        else:
            plan.decisions.append(Decision(e.keys[0] if e.keys else "", "Identification:holder", e.key, "declined", "no single holder"))


def level_tree(plan: Plan, ctx: Context) -> dict[str, str]:
    """The parent of each organisation that a level column names.

    Of the coarser levels whose values a finer one (nearly) determines, the parent is the one of most values, then the most
    consistent, then the leftmost. Where none does, the names are relative (``2nd section``): the organisation is told
    apart by the nearest coarser level's key beside its own. All pairs are asked in one job.
    """
    facts = {c.id: c for c in ctx.columns}
    levels = [(R.level_rank(facts[e.keys[0]].header, ctx.words), e) for e in plan.entities if len(e.keys) == 1 and e.keys[0] in facts and ctx.onto.is_a(e.schema, "Organization")]
    levels = sorted([(r, e) for r, e in levels if r is not None], key=lambda x: (x[0], facts[x[1].keys[0]].index))
    pairs = [(b, a) for rb, b in levels for ra, a in levels if ra < rb]
    if not pairs:
        return {}
    asked = [S.nested(ctx.frame, b.keys[0], a.keys[0], NESTING).withColumn("pair", F.lit(k)) for k, (b, a) in enumerate(pairs)]
    answers = asked[0]
    for other in asked[1:]:
        answers = answers.unionByName(other)
    got = {r["pair"]: r for r in answers.collect()}  # a row per pair of level columns
    parents: dict[str, str] = {}
    for rank, b in levels:
        fits = [(-got[k]["outer_values"], -got[k]["share"], facts[a.keys[0]].index, a) for k, (x, a) in enumerate(pairs) if x is b and got[k]["nested"]]
        coarser = [a for r, a in levels if r < rank]
        if fits:
            parents[b.key] = min(fits, key=lambda x: x[:3])[3].key
        elif coarser:
            parents[b.key] = coarser[-1].key
    for b, a in [(b, a) for _, b in reversed(levels) for _, a in levels if parents.get(b.key) == a.key]:
        if not got[next(k for k, p in enumerate(pairs) if p[0] is b and p[1] is a)]["nested"]:
            b.keys = [*a.keys, *b.keys]
    return parents


def nest_organisations(plan: Plan, ctx: Context) -> None:
    """Attachments to parents instead of edges: those within the tree go, and those to an ancestor of what they also join."""
    parents = level_tree(plan, ctx)
    if not parents:
        return
    plan.attachments += [Attachment(child, "parent", parent) for child, parent in parents.items()]

    def above(key: str) -> set[str]:
        out: set[str] = set()
        while key in parents and key not in out:
            key = parents[key]
            out.add(key)
        return out

    tree = set(parents) | set(parents.values())
    inside = [r for r in plan.edges if r.source in tree and r.target in tree]
    outside = [r for r in plan.edges if r not in inside]
    implied = [
        r for r in outside
        if any(o is not r and o.schema == r.schema and ((o.source == r.source and r.target in above(o.target)) or (o.target == r.target and r.source in above(o.source))) for o in outside)
    ]
    plan.edges = [r for r in outside if r not in implied]


def merge_group_twins(plan: Plan, ctx: Context) -> None:
    """Two entities of one schema, filter and key are one."""
    seen: dict[tuple, Entity] = {}
    for e in list(plan.entities):
        mark = (e.schema, tuple(e.keys), (e.filter.column, e.filter.value) if e.filter else None)
        if e.keys and mark in seen:
            _rename(plan, e.key, seen[mark].key)
            plan.entities.remove(e)
        else:
            seen[mark] = e
    groups, facts = R.prefix_groups(ctx.columns), {c.id: c for c in ctx.columns}
    for k, a in enumerate(list(plan.entities)):
        for b in list(plan.entities)[k + 1 :]:
            if a in plan.entities and b in plan.entities and a.schema == b.schema and a.filter == b.filter and R.share_prefix_group(groups, a, b, facts, ctx.words):
                better = sorted((a, b), key=lambda e: (-max(facts[c].identification for c in e.keys), plan.entities.index(e)))
                _rename(plan, better[1].key, better[0].key)
                plan.entities.remove(better[1])


def _rename(plan: Plan, old: str, new: str) -> None:
    for b in plan.bindings:
        b.entity = new if b.entity == old else b.entity
    for r in plan.edges:
        r.source, r.target = new if r.source == old else r.source, new if r.target == old else r.target
    for a in plan.attachments:
        a.entity, a.target = new if a.entity == old else a.entity, new if a.target == old else a.target


def bind_group_members(plan: Plan, ctx: Context) -> None:
    """An unbound member of a prefix group whose rest spells one property of the group's entity."""
    used = {b.column for b in plan.bindings}
    for prefix, ids in R.prefix_groups(ctx.columns).items():
        holders = [e for e in plan.entities if set(e.keys) & set(ids)] or [e for e in plan.entities if any(b.entity == e.key and b.column in ids for b in plan.bindings)]
        if len(holders) != 1:
            continue
        for cid in ids:
            rest = fold_text(ctx.facts(cid).header)[len(prefix) :].strip(" _")
            fits = [p for p in ctx.onto.props(holders[0].schema).values() if p.type != "entity" and rest in R.spellings_of(ctx.onto, holders[0].schema, p.name)]
            if cid not in used and len(fits) == 1:
                plan.bindings.append(Binding(cid, f"{holders[0].schema}:{fits[0].name}", holders[0].key, fits[0].type, "a member of the group"))


def rehome_varying(plan: Plan, ctx: Context) -> None:
    """A property that varies under its holder's commonest key belongs to the row's entity."""
    row = next((e for e in plan.entities if not e.keys), None)
    for b in list(plan.bindings):
        e = plan.entity(b.entity)
        if row is None or e is None or e is row or len(e.keys) != 1 or b.column in e.keys or b.type_name in MERGEABLE:
            continue
        if b.prop.partition(":")[2] in ctx.onto.props(row.schema):
            got = S.values_under_modal_key(ctx.frame, e.keys[0], b.column).first()
            if got and (got["values"] or 0) > VALUES_PER_KEY:
                b.entity, b.prop = row.key, f"{row.schema}:{b.prop.partition(':')[2]}"


def spelled_property_beats_relation(plan: Plan, ctx: Context) -> None:
    """A column bound to a relation whose header spells one property of one party goes to that party."""
    relations = {r.key for r in plan.edges}
    parties = [e for e in plan.entities if ctx.onto.is_party(e.schema)]
    for b in [b for b in plan.bindings if b.entity in relations and ctx.facts(b.column)]:
        header = fold_text(ctx.facts(b.column).header)
        fits = [(e, p) for e in parties for p in ctx.onto.props(e.schema).values() if p.type != "entity" and header and header in R.spellings_of(ctx.onto, e.schema, p.name)]
        if len(fits) == 1:
            e, p = fits[0]
            plan.decisions.append(Decision(b.column, b.prop, b.entity, "rejected", "the header spells a property of a party"))
            b.entity, b.prop, b.type_name, b.why = e.key, f"{e.schema}:{p.name}", p.type, "the header spells a property of the party"


def key_relation_on_record(plan: Plan, ctx: Context) -> None:
    """The single relation of a row is told apart by the only unused column of (nearly) unique, not ordinal, numbers."""
    used = {b.column for b in plan.bindings} | {k for x in (*plan.entities, *plan.edges) for k in x.keys}
    free = [c for c in ctx.columns if c.id not in used and c.distinct_ratio >= 0.99 and c.fill_rate >= KEY_FILL and c.rate("numeric") >= 0.99]
    if len(plan.edges) == 1 and len(free) == 1 and not S.is_ordinal(ctx.frame, free[0].id).first()["ordinal"]:
        r = plan.edges[0]
        r.keys = [free[0].id]
        if "recordId" in ctx.onto.props(r.schema):
            plan.bindings.append(Binding(free[0].id, f"{r.schema}:recordId", r.key, "identifier", "the record's number"))


def dissolve_relation_things(plan: Plan, ctx: Context) -> None:
    """An entity of an edge's schema without ends folds into the one edge of that schema."""
    for e in list(plan.entities):
        edges = [r for r in plan.edges if r.schema == e.schema]
        if ctx.onto.schemata.get(e.schema) and ctx.onto.schemata[e.schema].edge and len(edges) == 1:
            _rename(plan, e.key, edges[0].key)
            plan.entities.remove(e)


def check_edges(plan: Plan, ctx: Context) -> None:
    """Edges whose ends are missing, out of range (and can't be specialised) or never on one row go."""
    for r in list(plan.edges):
        a, b = plan.entity(r.source), plan.entity(r.target)
        edge = ctx.onto.schemata[r.schema].edge if r.schema in ctx.onto.schemata else None
        why = "no such relation" if edge is None else "an end is missing" if a is None or b is None else None
        if why is None:
            x, y = ctx.onto.specialise(a.schema, edge.source_range), ctx.onto.specialise(b.schema, edge.target_range)
            if not x or not y:
                why = "an end is out of range"
            elif a.filter and b.filter and (a.filter.column, a.filter.value) != (b.filter.column, b.filter.value):
                why = "the ends are never on one row"
            else:
                for e, s in ((a, x), (b, y)):
                    if e.schema != s:
                        _become(plan, e, s)
        if why:
            plan.edges.remove(r)
            plan.decisions.append(Decision(",".join(key_columns(plan, a)) if a else "", None, r.key, "rejected", why))
    seen = set()
    for r in list(plan.edges):
        if (r.schema, r.source, r.target) in seen:
            plan.edges.remove(r)
        seen.add((r.schema, r.source, r.target))


def remove_empty(plan: Plan, ctx: Context) -> None:
    """Entities that nothing is bound to and nothing refers to go, and whatever hung on them."""
    held = {b.entity for b in plan.bindings} | {x for r in plan.edges for x in (r.source, r.target)} | {a.target for a in plan.attachments} | {a.entity for a in plan.attachments}
    plan.entities = [e for e in plan.entities if e.key in held]
    keys = {e.key for e in plan.entities}
    plan.edges = [r for r in plan.edges if r.source in keys and r.target in keys]
    alive = keys | {r.key for r in plan.edges}
    plan.bindings = [b for b in plan.bindings if b.entity in alive]
    plan.attachments = list({(a.entity, a.prop, a.target): a for a in plan.attachments if a.entity in keys and a.target in keys}.values())


def effective_subject(plan: Plan, ctx: Context) -> None:
    """The declared subject if an entity of the plan is one, else the best identified entity with bindings."""
    if any(ctx.onto.is_a(e.schema, plan.subject) for e in plan.entities):
        return
    rank = lambda e: (max((ctx.facts(k).identification for k in e.keys if ctx.facts(k)), default=0.0), sum(b.entity == e.key for b in plan.bindings), e.schema)
    if plan.entities:
        plan.subject = max(plan.entities, key=rank).schema


def apply_overrides(plan: Plan, overrides: dict[str, dict], ctx: Context) -> None:
    """An analyst's last word per column; it outranks rules, not the ontology."""
    for column, o in overrides.items():
        plan.bindings = [b for b in plan.bindings if b.column != column]
        if o["action"] == "bind":
            e = next((x for x in (*plan.entities, *plan.edges) if x.key == o["entity"]), None)
            prop = ctx.onto.prop(o["prop"])
            if e is None or prop is None or prop.name not in ctx.onto.props(e.schema):
                plan.decisions.append(Decision(column, o["prop"], o["entity"], "rejected", "the ontology has no such property there", "analyst"))
                continue
            plan.bindings.append(Binding(column, f"{e.schema}:{prop.name}", e.key, prop.type, "decided by an analyst"))
        plan.decisions.append(Decision(column, o.get("prop"), o.get("entity"), "accepted" if o["action"] == "bind" else "rejected", "", "analyst"))


ADDITIVE = (
    lambda p, c: R.declare_parties(p, c.columns, c.words), lambda p, c: R.declare_address_block(p, c.columns, c.onto), lambda p, c: R.declare_places(p, c.columns, c.onto),
    split_folded_parties, declare_contract, split_redacted_key, specialise_coded_party, declare_identification, merge_group_twins,
)
LATER = (
    lambda p, c: R.name_from_key(p, c.columns, c.onto), lambda p, c: R.id_from_key(p, c.columns, KEY_DISTINCT), bind_group_members,
    lambda p, c: R.bind_by_detector(p, c.columns, c.onto),
)
LAST = (
    nest_organisations, lambda p, c: R.derive_relations(p, c.columns, c.onto, c.words), lambda p, c: R.derive_debts(p, c.columns, c.onto, c.words), key_relation_on_record,
    lambda p, c: R.bind_edge_properties(p, c.columns, c.onto, c.words), spelled_property_beats_relation, dissolve_relation_things, attach_identification_holder,
)


def validate(plan: Plan, ctx: Context, refinement: str = "rules", overrides: dict[str, dict] | None = None) -> Plan:
    """The plan after all rules; with ``refinement="none"`` nothing is added, only checked. Decisions tell why."""
    steps = [resolve_entity_keys, refuse_columns]
    steps += [resolve_subject_contradiction] if refinement == "rules" else ()
    steps += ADDITIVE if refinement == "rules" else ()
    steps += [check_bindings]
    steps += (*LATER, check_bindings) if refinement == "rules" else ()
    steps += [resolve_claims, floor_keys, check_filters]
    steps += (rehome_varying, *LAST, check_bindings) if refinement == "rules" else ()
    steps += [check_edges]
    for step in steps:
        step(plan, ctx)
    if overrides:
        apply_overrides(plan, overrides, ctx)
    remove_empty(plan, ctx)
    effective_subject(plan, ctx)
    return plan


def unfalsifiable(plan: Plan) -> float:
    """Share of bindings under types that accept any text."""
    return sum(b.type_name in FREE_TYPES for b in plan.bindings) / len(plan.bindings) if plan.bindings else 0.0


__all__ = ["Context", "Relation", "propose", "validate", "apply_overrides"]
