"""Queries of the general data problems (p1, p2, p3, p6) over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators import instants, packed, profile, records
from tabloom.session import cut, scratch, table

#: Rows up to which a register of sources or columns counts as small.
SMALL = 10_000
CELLS = [f"c{k}" for k in range(14)]
PACKED = ("c5", "c7", "c8", "c12")
LOAD = ["source_id", "load_no"]


def _records(spark: SparkSession, d: str) -> DataFrame:
    return records.with_source_grammar(table(spark, d, "raw_records"), table(spark, d, "sources"), fixed_rows=SMALL)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    df = _records(spark, d)
    got = records.parse_records(df, "raw_text", F.col("__field_sep"), F.col("__column_types"), ["record_id"], failures_only=True)
    return got.where("part_no = 0").select("record_id", "reason")


def p1_typed(spark: SparkSession, d: str) -> DataFrame:
    df = _records(spark, d)
    got = records.parse_records(df, "raw_text", F.col("__field_sep"), F.col("__column_types"), ["record_id", "source_id", "line_no"])
    return got.select("record_id", "source_id", "line_no", "part_no", "ok", "reason", "error_field", "error_at", "typed")


def p1_by_source(spark: SparkSession, d: str) -> DataFrame:
    got = p1_typed(spark, d).where("part_no = 0")
    return got.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("records"),
        *[F.count_if(F.col("reason") == r).alias(f"{r}_failures") for r in ("quoting", "columns", "value")],
    )


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """Every date cell beside its source's zone and its column's evidence."""
    cells = table(spark, d, "canon_cells").select("cell_id", "source_id", "column_id", "value_raw")
    zones = table(spark, d, "sources").select("source_id", "zone_name")
    if zones.limit(SMALL + 1).count() <= SMALL:
        zones = F.broadcast(zones)
    kinds = instants.numeric_kinds(cells, "value_raw", ["source_id", "column_id"])
    return cells.join(zones, "source_id", "left").join(kinds, ["source_id", "column_id"], "left")


def p2_canonical(spark: SparkSession, d: str) -> DataFrame:
    got = instants.canonical_instants(
        _cells(spark, d), "value_raw", F.col("zone_name"), F.col("days_kind"), F.col("unix_kind"), ["cell_id", "source_id"]
    )
    return got


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_canonical(spark, d).where("canon_ok").select("cell_id", "canon_value")


def _store(spark: SparkSession, d: str) -> profile.ValueCountStore:
    """The value-count tables of the registers: every load's rows as a delta of its key (source_id, load_no)."""
    store = profile.ValueCountStore(spark, scratch(spark, "value-counts"))
    store.apply(profile.value_counts(table(spark, d, "frame_rows"), LOAD, CELLS))
    return store


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return _store(spark, d).read()


def _usual_shapes(spark: SparkSession, d: str) -> DataFrame:
    recorded = table(spark, d, "column_profile")
    usual = recorded.select("source_id", "column_id", F.get("shapes", F.lit(0))["shape"].alias("usual_shape"))
    return F.broadcast(usual) if usual.limit(SMALL + 1).count() <= SMALL else usual


def p3_departures(spark: SparkSession, d: str) -> DataFrame:
    got = profile.profiles(_counts(spark, d), LOAD, _usual_shapes(spark, d))
    return profile.departures(got, ["source_id"]).drop("buckets")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_departures(spark, d).where("departs").select("source_id", "load_no", "column_id")


def _figures(got: DataFrame) -> DataFrame:
    return got.select(
        *LOAD, "column_id", "row_count", "filled", "distinct_values", "min_len", "max_len",
        *[F.round(c, 6).alias(c) for c in ("fill_rate", "distinct_ratio", "modal_share", "entropy")],
    )


def p3_profile(spark: SparkSession, d: str) -> DataFrame:
    return _figures(profile.profiles(_counts(spark, d), LOAD))


def p3_deltas(spark: SparkSession, d: str) -> DataFrame:
    """The profile after two deltas: each source's last load is added, its load 1 taken back; only these are computed again."""
    rows = table(spark, d, "frame_rows")
    last = rows.groupBy("source_id").agg(F.max("load_no").alias("load_no"))
    if last.limit(SMALL + 1).count() <= SMALL:
        last = F.broadcast(last)
    store = profile.ValueCountStore(spark, scratch(spark, "value-counts"))
    store.apply(profile.value_counts(rows.join(last, LOAD, "left_anti"), LOAD, CELLS))
    before = cut(profile.profiles(store.read(), LOAD))
    store.apply(profile.value_counts(rows.join(last, LOAD, "left_semi"), LOAD, CELLS))
    store.apply(profile.value_counts(rows.where("load_no = 1"), LOAD, CELLS, sign=-1))
    touched = last.select(*LOAD).unionByName(rows.where("load_no = 1").select(*LOAD).distinct())
    return _figures(profile.refreshed(before, store, touched))


def p3_shapes(spark: SparkSession, d: str) -> DataFrame:
    got = profile.top_shapes(_counts(spark, d), LOAD, 5)
    return got.select("source_id", "load_no", "column_id", F.posexplode("shapes").alias("place", "s")).select(
        "source_id", "load_no", "column_id", (F.col("place") + 1).alias("place"), F.col("s.shape").alias("shape"), F.round("s.share", 6).alias("share")
    )


def _packed_cells(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "frame_rows").select("row_id", "source_id", *PACKED)
    # A column's type is the same in all loads of a source; sources holds it, and has one row per source.
    kinds = table(spark, d, "sources").select("source_id", F.col("column_types").alias("__types"))
    if kinds.limit(SMALL + 1).count() <= SMALL:
        kinds = F.broadcast(kinds)
    typed = rows.join(kinds, "source_id", "left")
    long = typed.select("row_id", "__types", F.expr("stack(4, " + ", ".join(f"'{c}', {c}" for c in PACKED) + ") AS (column_id, cell)"))
    index = F.substring("column_id", 2, 9).cast("int")
    return long.where("cell IS NOT NULL").select("row_id", "column_id", "cell", F.get("__types", index).alias("type_name"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    got = packed.split_packed(_packed_cells(spark, d), "cell", "type_name", ["row_id", "column_id"], least=2)
    return got.select("row_id", "column_id", "part_no", "part_text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_typed, p1_by_source, p2_found, p2_canonical, p3_found, p3_departures, p3_profile, p3_deltas, p3_shapes, p6_found)
}

_LONG = " UNION ALL ".join(f"SELECT source_id, load_no, 'c{k}' AS column_id, nullif(trim(c{k}, ' ' || chr(9) || chr(13) || chr(10) || chr(160) || chr(8199) || chr(8239) || chr(12288)), '') AS value FROM frame_rows" for k in range(14))
_PROFILE = f"""WITH v AS ({_LONG}), g AS (SELECT source_id, load_no, column_id, value, count(*) AS n FROM v GROUP BY ALL)
SELECT source_id, load_no, column_id, CAST(sum(n) AS BIGINT) AS row_count, CAST(coalesce(sum(n) FILTER (WHERE value IS NOT NULL), 0) AS BIGINT) AS filled, count(value) AS distinct_values,
CAST(min(length(value)) AS INTEGER) AS min_len, CAST(max(length(value)) AS INTEGER) AS max_len, round(CAST(coalesce(sum(n) FILTER (WHERE value IS NOT NULL), 0) AS DOUBLE) / sum(n), 6) AS fill_rate,
round(CAST(count(value) AS DOUBLE) / sum(n) FILTER (WHERE value IS NOT NULL), 6) AS distinct_ratio, round(CAST(max(n) FILTER (WHERE value IS NOT NULL) AS DOUBLE) / sum(n) FILTER (WHERE value IS NOT NULL), 6) AS modal_share,
round(ln(sum(n) FILTER (WHERE value IS NOT NULL)) - sum(n * ln(n)) FILTER (WHERE value IS NOT NULL) / sum(n) FILTER (WHERE value IS NOT NULL), 6) AS entropy FROM g GROUP BY source_id, load_no, column_id"""
ORACLE: dict[str, str] = {
    "p3_profile": _PROFILE,
    "p3_deltas": f"SELECT * FROM ({_PROFILE}) WHERE load_no <> 1",
}
