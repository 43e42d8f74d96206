"""The accounting of a run: every cell of every column ends up somewhere, exactly once.

All of it is aggregates over the long form of ``plans.compile.facts`` and one
pass over the frame; loss is reported (shortfall), never netted against excess.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions import canonical as C
from tabloom.functions import text as X
from tabloom.plans import compile as P
from tabloom.plans.model import Plan
from tabloom.plans.ontology import Ontology, default


def claim_ledger(rows: DataFrame, long: DataFrame, plan: Plan, onto: Ontology | None = None) -> DataFrame:
    """Per (column, plan entity, property): expected, emitted, rejected, shortfall, over_emission.

    Expected counts the rows that the plan declares, split under the claim's own type.
    """
    onto = onto or default()
    listed = P.claims(plan, onto)
    items = {x.key: x for x in (*plan.entities, *plan.edges)}
    structs = []
    for n, c in enumerate(listed):
        got, item = F.col(f"{c['column']}__is"), items[c["entity"]]
        parts = F.when(got["ok"], F.size(C.parts_of(got["value"], c["type"]))).otherwise(1) + F.coalesce(F.size(got["refused"]), F.lit(0))
        here = P.declared_selection(plan, item) & got.isNotNull()
        structs.append(F.struct(F.lit(n).alias("claim"), F.when(here, parts).otherwise(0).cast("long").alias("expected")))
    expected = rows.select(F.explode(F.array(*structs)).alias("c")).groupBy("c.claim").agg(F.sum("c.expected").alias("expected"))
    got = long.where("selected").groupBy("claim").agg(F.count_if(F.col("stage").isNull()).alias("emitted"), F.count_if(F.col("stage").isNotNull()).alias("rejected"))
    filters = lambda key: [items[key].filter.column] if getattr(items[key], "filter", None) else []
    names = rows.sparkSession.createDataFrame(
        [(n, c["column"], c["entity"], c["qname"], c["type"], c["canonical_type"], filters(c["entity"])) for n, c in enumerate(listed)],
        "claim int, column string, entity string, prop string, type string, canonical_type string, filters array<string>",
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    joined = names.join(expected, "claim", "left").join(got, "claim", "left").select("column", "entity", "prop", "type", "canonical_type", "filters", zero("expected"), zero("emitted"), zero("rejected"))
    sent = F.col("emitted") + F.col("rejected")
    return joined.withColumns({"shortfall": F.greatest(F.lit(0), F.col("expected") - sent), "over_emission": F.greatest(F.lit(0), sent - F.col("expected"))})


def coverage(frame: DataFrame, rows: DataFrame, plan: Plan, onto: Ontology | None = None) -> DataFrame:
    """Per column of the frame: status, role and where its values went.

    values = offered + rejected + declined + structural + outside_selection + unaccounted.
    """
    onto = onto or default()
    items = {x.key: x for x in (*plan.entities, *plan.edges)}
    bound: dict[str, list] = {}
    for b in plan.bindings:
        bound.setdefault(b.column, []).append(items[b.entity])
    keys = {c for x in items.values() for c in x.keys}
    filters = {e.filter.column for e in plan.entities if e.filter}
    decided: dict[str, str] = {d.column: d.verdict for d in plan.decisions}
    columns = [c for c in frame.columns if c != P.ROW]
    sums: list[Column] = []
    for c in columns:
        filled = F.coalesce(X.strip(F.col(c)) != "", F.lit(False))
        one = F.when(filled, 1).otherwise(0)
        if c in bound:
            got = F.col(f"{c}__is")
            good = F.coalesce(F.when(got["ok"], F.size(C.parts_of(got["value"], plan.column_types()[c]))), F.lit(0))
            bad = F.when(got.isNull(), 0).when(~got["ok"], 1).otherwise(F.coalesce(F.size(got["refused"]), F.lit(0)))
            covered = reduce(lambda a, b: a | b, [P.declared_selection(plan, x) for x in bound[c]])
            inside = F.when(filled & covered, 1).otherwise(0)
            sums += [F.sum(one * (good + bad)), F.sum(inside * good), F.sum(inside * bad), F.lit(0), F.lit(0), F.sum((one - inside) * (good + bad))]
        else:
            structural = c in keys | filters
            declined = not structural and decided.get(c) in ("rejected", "declined", "unmapped")
            n, none = F.sum(one), F.lit(0)
            sums += [n, none, none, n if declined else none, n if structural else none, none]
    fields = ("values", "offered", "rejected", "declined", "structural", "outside_selection")
    named = [F.coalesce(s.cast("long"), F.lit(0).cast("long")).alias(f"{c}|{f}") for (c, f), s in zip(((c, f) for c in columns for f in fields), sums, strict=True)]
    # The rows hold each bound column beside its verdict, the frame the others: neither has to find the other's rows.
    own = [x for k, x in enumerate(named) if columns[k // len(fields)] in bound]
    rest = [x for k, x in enumerate(named) if columns[k // len(fields)] not in bound]
    parts = [t.agg(*x) for t, x in ((rows, own), (frame, rest)) if x]
    totals = reduce(lambda a, b: a.crossJoin(b), parts)  # one row each

    def status(c: str) -> tuple[str, str | None]:
        if c in bound:
            return "bound", "key" if c in keys else None
        if c in keys | filters:
            return "structural", "key" if c in keys else "filter"
        return {"rejected": "dropped", "accepted": "dropped", "unmapped": "unmapped", "declined": "unmapped"}.get(decided.get(c), "undecided"), None

    structs = [
        F.struct(F.lit(c).alias("column"), F.lit(status(c)[0]).alias("status"), F.lit(status(c)[1]).cast("string").alias("role"), *[F.col(f"`{c}|{f}`").alias(f) for f in fields]) for c in columns
    ]
    long = totals.select(F.explode(F.array(*structs)).alias("c")).select("c.*")
    placed = F.col("offered") + F.col("rejected") + F.col("declined") + F.col("structural") + F.col("outside_selection")
    return long.withColumn("unaccounted", F.col("values") - placed)


def totals(cover: DataFrame, claims: DataFrame) -> DataFrame:
    """The sums of both ledgers and whether the accounting holds."""
    fields = ("values", "offered", "rejected", "declined", "structural", "outside_selection", "unaccounted")
    c = cover.agg(*[F.sum(f).alias(f) for f in fields], F.bool_and(reduce(lambda a, b: a & b, [F.col(f) >= 0 for f in fields])).alias("c_ok"))
    closes = (F.col("expected") + F.col("over_emission") == F.col("emitted") + F.col("rejected") + F.col("shortfall")) & (F.col("over_emission") == 0)
    k = claims.agg(
        *[F.sum(f).alias(f"claims_{f}") for f in ("expected", "emitted", "rejected", "shortfall", "over_emission")], F.coalesce(F.bool_and(closes), F.lit(True)).alias("k_ok")
    )
    return c.crossJoin(k).withColumn("accounting_valid", F.col("c_ok") & F.col("k_ok")).drop("c_ok", "k_ok")  # one row each


def merge_totals(parts: DataFrame) -> DataFrame:
    """Totals across sources: sums, never netted, and the conjunction of the flags."""
    sums = [F.sum(c).alias(c) for c, t in parts.dtypes if t == "bigint"]
    return parts.agg(*sums, F.bool_and("accounting_valid").alias("accounting_valid"))


def reject_tally(rejected: DataFrame) -> DataFrame:
    """Rejects in total and by reason, column and stage in one pass (GROUPING SETS)."""
    view = rejected.select("reason", "column", "stage")
    grouped = view.groupingSets([[], ["reason"], ["column"], ["stage"]], "reason", "column", "stage").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))
    return grouped.select(F.element_at(F.create_map(F.lit(7), F.lit("total"), F.lit(3), F.lit("reason"), F.lit(5), F.lit("column"), F.lit(6), F.lit("stage")), F.col("level").cast("int")).alias("by"), F.coalesce("reason", "column", "stage").alias("value"), "n")


def unfalsifiable_share(long: DataFrame) -> DataFrame:
    """The share of statements under types that accept any text."""
    return long.where("selected AND stage IS NULL").agg(F.count(F.lit(1)).alias("statements"), F.avg(F.col("type").isin(*sorted(C.FREE_TYPES)).cast("double")).alias("unfalsifiable_share"))


def instances(ids: DataFrame) -> DataFrame:
    """Distinct ids per plan entity."""
    return ids.groupBy("entity", "schema").agg(F.count_distinct("entity_id").alias("instances"))
