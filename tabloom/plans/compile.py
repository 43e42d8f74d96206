"""A mapping plan as DataFrames: normalised rows, statements, rejects, entities.

One scan feeds everything. A row carries a verdict per bound column, a raw flag
per selection and an id per entity and edge; statements are one explode over
the plan's claims, so that a value keeps the cell it came from and no join has
to find it again. Rows, ids and values never meet on the driver.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions import canonical as C
from tabloom.functions import text as X
from tabloom.operators.instants import CORROBORATION
from tabloom.plans.model import Entity, Plan, Relation
from tabloom.plans.ontology import MERGEABLE, Ontology, default

ROW = "_row"


@dataclass(frozen=True)
class Source:
    """Where a frame came from; goes into every statement."""

    source_id: str
    file: str = ""
    sheet: str = ""
    sha256: str = ""
    run_id: str = "run"


def key_value(column: str) -> Column:
    """A cell as it enters a key: only its white space is collapsed; null is ''."""
    return F.coalesce(X.collapse(F.col(column)), F.lit(""))


def key_columns(plan: Plan, item: Entity | Relation) -> list[str]:
    """Key columns of an entity, or of an edge: those of its ends and its own, sorted."""
    if isinstance(item, Entity):
        return item.keys or [ROW]
    ends = [plan.entity(item.source), plan.entity(item.target)]
    own = [c for e in ends if e for c in key_columns(plan, e)] + item.keys
    return sorted(set(own))


def selection(plan: Plan, item: Entity | Relation, onto: Ontology) -> Column:
    """The rows that an entity or an edge is built from.

    An entity with a filter: rows whose cell equals it. Without: all rows, but a
    thing that is no party is read on the filtered rows only where the plan has
    filters and no party without one. An edge: rows both ends select.
    """
    if isinstance(item, Relation):
        ends = [e for e in (plan.entity(item.source), plan.entity(item.target)) if e]
        return reduce(lambda a, b: a & b, [selection(plan, e, onto) for e in ends], F.lit(True))
    if item.filter:
        return F.coalesce(F.col(item.filter.column) == F.lit(item.filter.value), F.lit(False))
    filters = {(e.filter.column, e.filter.value) for e in plan.entities if e.filter}
    whole_party = any(onto.is_party(e.schema) for e in plan.entities if not e.filter)
    if filters and not whole_party and not onto.is_party(item.schema):
        return reduce(lambda a, b: a | b, [F.coalesce(F.col(c) == F.lit(v), F.lit(False)) for c, v in sorted(filters)])
    return F.lit(True)


def declared_selection(plan: Plan, item: Entity | Relation) -> Column:
    """The rows that the plan itself gives to an entity or an edge."""
    if isinstance(item, Relation):
        ends = [e for e in (plan.entity(item.source), plan.entity(item.target)) if e]
        return reduce(lambda a, b: a & b, [declared_selection(plan, e) for e in ends], F.lit(True))
    return F.coalesce(F.col(item.filter.column) == F.lit(item.filter.value), F.lit(False)) if item.filter else F.lit(True)


def entity_id(plan: Plan, item: Entity | Relation, source_id: str) -> Column:
    """A stable id of source, plan key and key values; null where all key values are empty."""
    keys = [F.col(ROW).cast("string") if c == ROW else key_value(c) for c in key_columns(plan, item)]
    body = keys[0] if len(keys) == 1 else X.composite(*keys)
    return F.when(body != "", F.sha1(F.concat(F.lit(f"{source_id}\x00{item.key}\x00"), body)))


def evidence(frame: DataFrame, plan: Plan) -> dict[str, bool]:
    """Whether the bare numbers of each date column are dates; one aggregate over the frame."""
    columns = sorted(c for c, t in plan.column_types().items() if t == "date")
    if not columns:
        return {}
    sums = []
    for c in columns:
        v = X.strip(F.col(c))
        n = v.try_cast("int")
        dated = (v.rlike(r"^\d{4}$") & n.between(1850, 2100)) | (v.rlike(r"^\d{5}$") & n.between(1, 80000))
        sums += [F.count_if(v.rlike(r"^\d+$")).alias(f"{c}_n"), F.count_if(dated).alias(f"{c}_d")]
    row = frame.agg(*sums).first()
    return {c: row[f"{c}_n"] > 0 and row[f"{c}_d"] / row[f"{c}_n"] >= CORROBORATION for c in columns}


def normalised(frame: DataFrame, plan: Plan, numeric: dict[str, bool] | None = None) -> DataFrame:
    """_row and the plan's columns, each bound one beside its verdict ``c__is``. One select."""
    numeric = evidence(frame, plan) if numeric is None else numeric
    types = plan.column_types()
    used = {*types, *(c for e in plan.entities for c in e.keys), *(c for e in plan.edges for c in e.keys), *(e.filter.column for e in plan.entities if e.filter)}
    used &= set(frame.columns)
    bound = [C.canonical(F.col(c), t, F.lit(numeric.get(c, False)) if t == "date" else None).alias(f"{c}__is") for c, t in sorted(types.items()) if c in used]
    return frame.select(ROW, *sorted(used - {ROW}), *bound)


def claims(plan: Plan, onto: Ontology) -> list[dict]:
    """The plan's bindings as claims: column, plan entity, property, types."""
    types = plan.column_types()
    out = []
    for b in plan.bindings:
        prop = onto.prop(b.prop)
        out.append({
            "column": b.column, "entity": b.entity, "prop": b.prop.partition(":")[2], "qname": b.prop, "type": b.type_name,
            "canonical_type": types[b.column], "matchable": bool(prop and prop.matchable), "format": prop.format if prop else None,
        })
    # Of several columns for one property of a type that doesn't merge, the last one is read.
    last = {(c["entity"], c["prop"]): i for i, c in enumerate(out)}
    for i, c in enumerate(out):
        c["read"] = c["type"] in MERGEABLE or last[(c["entity"], c["prop"])] == i
    return out


def facts(rows: DataFrame, plan: Plan, source: Source, onto: Ontology | None = None) -> DataFrame:
    """The long form: a row per (row, claim, value), accepted or refused, with its cell.

    stage is null for a statement, ``normalize`` for a refused cell or part,
    ``emit`` for a value that no entity could hold; ``declared`` says whether
    the plan gives the row to the entity, ``selected`` whether it is built there.
    """
    onto = onto or default()
    items = {x.key: x for x in (*plan.entities, *plan.edges)}
    # Ids and selections are computed once per row and entity, whatever is bound to it.
    rows = rows.withColumns({f"__id_{k}": entity_id(plan, x, source.source_id) for k, x in items.items()} | {f"__sel_{k}": selection(plan, x, onto) for k, x in items.items()})
    structs = []
    for n, c in enumerate(claims(plan, onto)):
        item = items.get(c["entity"])
        if item is None or f"{c['column']}__is" not in rows.columns:
            continue
        got = F.col(f"{c['column']}__is")
        eid = F.col(f"`__id_{item.key}`")
        parts = C.parts_of(got["value"], c["type"])
        fits = (lambda p, fmt=c["format"]: p.rlike(C.FORMATS[fmt]) if fmt in C.FORMATS else F.lit(True))
        value = lambda p: F.struct(
            p.alias("value"),
            F.when(eid.isNull(), "no entity in this row").when(F.lit(not c["read"]), "another column is read for this property").when(~fits(p), f"not of the format {c['format']}").alias("reason"),
            F.when(eid.isNull() | F.lit(not c["read"]) | ~fits(p), "emit").alias("stage"),
        )
        accepted = F.when(got["ok"], F.transform(parts, value))
        refused_parts = F.transform(got["refused"], lambda p: F.struct(p["part"].alias("value"), p["reason"].alias("reason"), F.lit("normalize").alias("stage")))
        refused = F.when(~got["ok"], F.array(F.struct(F.col(c["column"]).alias("value"), got["reason"].alias("reason"), F.lit("normalize").alias("stage"))))
        empty = F.array().cast("array<struct<value:string,reason:string,stage:string>>")
        values = F.concat(F.coalesce(accepted, empty), F.coalesce(refused, empty), F.coalesce(refused_parts, empty))
        structs.append(F.struct(
            F.lit(n).alias("claim"), F.lit(c["column"]).alias("column"), F.lit(c["entity"]).alias("entity"), F.lit(item.schema).alias("schema"), F.lit(c["prop"]).alias("prop"),
            F.lit(c["type"]).alias("type"), F.lit(c["canonical_type"]).alias("canonical_type"), F.lit(c["matchable"]).alias("matchable"), eid.alias("entity_id"),
            declared_selection(plan, item).alias("declared"), F.col(f"`__sel_{item.key}`").alias("selected"), F.col(c["column"]).alias("value_raw"), got["canonicalizer"].alias("canonicalizer"), values.alias("values"),
        ))
    if not structs:
        raise ValueError("the plan has no binding on a column of the frame")
    per_claim = rows.select(ROW, F.explode(F.array(*structs)).alias("c")).where(F.size("c.values") > 0)
    return per_claim.select(ROW, "c.*", F.explode("c.values").alias("v")).select(
        F.col(ROW).alias("row"), "claim", "column", "entity", "schema", "prop", "type", "canonical_type", "matchable", "entity_id", "declared", "selected",
        "value_raw", "canonicalizer", F.col("v.value").alias("value"), F.col("v.reason").alias("reason"), F.col("v.stage").alias("stage"),
    )


def statements(long: DataFrame, plan: Plan, source: Source, headers: dict[str, str] | None = None, decided_by: dict[str, str] | None = None) -> DataFrame:
    """One row per emitted value and the cell that holds it."""
    lookup = lambda m: F.element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), F.col("column")) if m else F.lit(None).cast("string")
    return long.where("selected AND stage IS NULL").select(
        "entity_id", "schema", "prop", "value", "value_raw", F.lit(source.file).alias("file"), F.lit(source.sheet).alias("sheet"), F.col("column").alias("column_id"),
        lookup(headers).alias("header"), "row", F.lit(source.sha256).alias("sha256"), F.lit(source.run_id).alias("run_id"), lookup(decided_by).alias("decided_by"), "canonicalizer", "matchable",
    )


def rejects(long: DataFrame) -> DataFrame:
    return long.where("selected AND stage IS NOT NULL").select("row", "column", "prop", "entity", "value", "reason", "canonicalizer", "stage")


def references(rows: DataFrame, plan: Plan, source: Source, onto: Ontology | None = None) -> DataFrame:
    """(entity_id, schema, prop, value) of edge ends and attachments: ids of the same row, no join."""
    onto = onto or default()
    out = []
    for e in plan.edges:
        edge = onto.schemata[e.schema].edge if e.schema in onto.schemata else None
        ends = [(edge.source, e.source), (edge.target, e.target)] if edge else []
        for prop, key in ends:
            item = plan.entity(key)
            if item:
                both = selection(plan, e, onto)
                out.append(F.struct(F.when(both, entity_id(plan, e, source.source_id)).alias("entity_id"), F.lit(e.schema).alias("schema"), F.lit(prop).alias("prop"), entity_id(plan, item, source.source_id).alias("value")))
    for a in plan.attachments:
        holder, target = plan.entity(a.entity), plan.entity(a.target)
        if holder and target:
            both = selection(plan, holder, onto) & selection(plan, target, onto)
            out.append(F.struct(F.when(both, entity_id(plan, holder, source.source_id)).alias("entity_id"), F.lit(holder.schema).alias("schema"), F.lit(a.prop).alias("prop"), entity_id(plan, target, source.source_id).alias("value")))
    if not out:
        return rows.select(*[F.lit(None).cast("string").alias(c) for c in ("entity_id", "schema", "prop", "value")]).limit(0)
    return rows.select(F.explode(F.array(*out)).alias("r")).select("r.*").where("entity_id IS NOT NULL AND value IS NOT NULL").distinct()


def names_mentioned(long: DataFrame, refs: DataFrame, edge_schemata: list[str]) -> DataFrame:
    """(entity_id, schema, prop, value): the names of an edge's ends as its ``namesMentioned``; derived, so without a cell.

    One join of the edges' ends with the names of entities, both distinct before they are shuffled.
    """
    own = long.where("selected AND stage IS NULL AND prop = 'name'").select(F.col("entity_id").alias("end"), F.col("value").alias("name")).distinct()
    ends = refs.where(F.col("schema").isin(edge_schemata)).select("entity_id", "schema", F.col("value").alias("end"))
    return ends.join(own, "end").select("entity_id", "schema", F.lit("namesMentioned").alias("prop"), F.col("name").alias("value")).distinct()


def declared_ids(rows: DataFrame, plan: Plan, source: Source, onto: Ontology | None = None) -> DataFrame:
    """(entity_id, schema, entity): every entity and edge that the rows make, distinct."""
    onto = onto or default()
    made = [
        F.struct(F.when(selection(plan, x, onto), entity_id(plan, x, source.source_id)).alias("entity_id"), F.lit(x.schema).alias("schema"), F.lit(x.key).alias("entity"))
        for x in (*plan.entities, *plan.edges)
    ]
    return rows.select(F.explode(F.array(*made)).alias("m")).select("m.*").where("entity_id IS NOT NULL").distinct()


def entities(long: DataFrame, refs: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Entities merged by id: STRUCT<id, schema, MAP<prop, sorted distinct values>>.

    Two aggregates with map-side combine, first by (id, prop, value), so that an
    id which a third of all rows share is thinned out before its values meet.
    """
    own = long.where("selected AND stage IS NULL").select("entity_id", "schema", "prop", "value")
    distinct = own.unionByName(refs).distinct()
    props = distinct.groupBy("entity_id", "schema", "prop").agg(F.array_sort(F.collect_list("value")).alias("values"))
    merged = props.groupBy("entity_id", "schema").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("prop", "values")))).alias("properties"))
    if ids is None:
        return merged.withColumnRenamed("entity_id", "id")
    every = ids.select("entity_id", "schema").distinct()
    empty = F.create_map().cast("map<string,array<string>>")
    return every.join(merged, ["entity_id", "schema"], "left").select(F.col("entity_id").alias("id"), "schema", F.coalesce("properties", empty).alias("properties"))


def first_wins(parts: DataFrame, order: list[str], by: str = "id") -> DataFrame:
    """Of the rows of one id across sources the first whole row, in the given total order; one aggregate, no sort."""
    rest = [c for c in parts.columns if c != by]
    best = parts.groupBy(by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return best.select(by, *[F.col(f"row.{c}").alias(c) for c in rest])


def mapping_document(plan: Plan, source: Source, onto: Ontology | None = None) -> str:
    """The plan as a mapping document (JSON, which YAML readers take as well)."""
    onto = onto or default()
    queries: dict[str, dict] = {}
    for e in plan.entities:
        where = {e.filter.column: e.filter.value} if e.filter else {}
        q = queries.setdefault(json.dumps(where, ensure_ascii=False), {"filters": where, "entities": {}})
        props = {c["prop"]: {"column": c["column"], **({"split": C.JOIN} if c["type"] in C.MULTIVALUE else {})} for c in claims(plan, onto) if c["entity"] == e.key and c["read"]}
        q["entities"][e.key] = {"schema": e.schema, "keys": key_columns(plan, e), "key_literal": f"{e.key}\x00", "properties": props}
    for r in plan.edges:
        # An edge is read on the rows that both ends select: in the query of the end with a filter, if one has any.
        ends = [e for e in (plan.entity(r.source), plan.entity(r.target)) if e]
        own = next(({e.filter.column: e.filter.value} for e in ends if e.filter), {})
        q = queries.setdefault(json.dumps(own, ensure_ascii=False), {"filters": own, "entities": {}})
        q["entities"][r.key] = {"schema": r.schema, "keys": key_columns(plan, r), "key_literal": f"{r.key}\x00", "source": r.source, "target": r.target}
    return json.dumps({source.source_id: {"queries": list(queries.values())}}, ensure_ascii=False, indent=1, sort_keys=True)
