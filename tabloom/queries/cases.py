"""Queries of operators that need a plan, a review log or written cases, with SQL that can fail.

Those over tables read them whole. Where an operator's meaning is a list of cases (detectors, canonical forms,
verdicts of plans), the query runs the operator over the written cases and the SQL lists what must come out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions import canonical as C
from tabloom.functions import detectors as D
from tabloom.functions import text as X
from tabloom.operators import layout as LY
from tabloom.operators import ledger as L
from tabloom.operators import profile as PR
from tabloom.operators import review as RV
from tabloom.operators import scoring as Z
from tabloom.operators import statistics as S
from tabloom.pipeline import summary_table
from tabloom.plans import compile as P
from tabloom.plans import validate as V
from tabloom.plans.facts import ColumnFacts
from tabloom.plans.model import Binding, Entity, Plan, Selection
from tabloom.plans.ontology import default
from tabloom.session import table
from tabloom.streaming import arrivals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def text(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


# -- detectors and canonical values by cases ---------------------------------------------
DETECTED = {
    "05.11.1967": "date", "2020-02-30": "", "31-12-1999": "date", "+380 44 123 45 67": "phone_ua", "044 123-45-67": "phone_ua", "+7 (912) 000-11-22": "phone_ru", "8 912 000 11 22": "phone_ru",
    "ann@mail.test": "email", "ann@mail": "", "https://host.test/a": "url", "ftp://host.test": "", "00032129": "edrpou,numeric", "00032128": "numeric", "3184710691": "inn_ru,numeric,rnokpp", "7707083893": "inn_ru,numeric",
    "112-233-445 95": "snils_ru", "ж": "gender_code", "Male": "gender_code", "Україна": "country", "PL": "country", "-12,5": "numeric", "1.2.3": "",
    "Заквітна Мотря": "proper_name", "заквітна мотря": "", "ТОВ Чебрець": "legal_name,org_name,proper_name", "Thistle Trading Ltd": "legal_name,org_name,proper_name", "Міський суд Озерянки": "org_name", "«Чебрець»": "legal_name,org_name",
}
_CHECKED = ["date", "phone_ua", "phone_ru", "email", "url", "edrpou", "rnokpp", "inn_ru", "snils_ru", "gender_code", "country", "numeric", "proper_name", "legal_name", "org_name"]


@query("SELECT * FROM (VALUES " + ", ".join(f"({text(k)}, {text(v)})" for k, v in DETECTED.items()) + ") AS t(value, detectors)")
def detector_cases(spark, d):
    """Which detectors take each written value."""
    df = spark.createDataFrame([(k,) for k in DETECTED], "value string")
    hits = F.array_compact(F.array(*[F.when(D.DETECTORS[n](F.col("value")), n) for n in _CHECKED]))
    return df.select("value", F.array_join(F.array_sort(hits), ",").alias("detectors"))


CANONICAL = [
    ("phone", "+380441234567", True, "+380441234567", "phone", 0), ("phone", "044 123-45-67; 067 000 11 22", True, "+380441234567;+380670001122", "phonex2", 0),
    ("phone", "0441234567, 1234568", True, "+380441234567;+380441234568", "phonex2", 0), ("phone", "0441234567; невідомий", True, "+380441234567", "phonex1of2", 1), ("phone", "0441234567, невідомий", False, None, "phone", 0),
    ("identifier", "AB 12", True, "AB12", "identifier", 0), ("identifier", "A1; B2", True, "A1;B2", "identifierx2", 0), ("identifier", "one two three", False, None, "identifier", 0),
    ("email", "Ann@MAIL.test", True, "Ann@mail.test", "email", 0), ("email", "ann@mail.test bob@mail.test", True, "ann@mail.test;bob@mail.test", "emailx2", 0), ("email", "ann", False, None, "email", 0),
    ("url", "www.Host.test/a", True, "http://www.host.test/a", "url", 0), ("language", "UK", True, "uk", "language", 0), ("language", "ukrainian", False, None, "language", 0),
    ("ip", "10.0.0.255", True, "10.0.0.255", "ip", 0), ("ip", "10.0.0.256", False, None, "ip", 0), ("topic", "crime.fin", True, "crime.fin", "topic", 0), ("mimetype", "Text/HTML", True, "text/html", "mimetype", 0),
    ("gender", "Жін.", True, "female", "gender", 0), ("country", "ua", False, None, "country", 0), ("country", "UA", True, "ua", "country", 0),
    ("date", "05.11.1967", True, "1967-11-05", "date", 0), ("date", "05.11.67 | 06.11.67", True, "1967-11-05;1967-11-06", "datex2", 0), ("date", "2020-01-01 10:00+02:00", True, "2020-01-01T08:00:00", "date", 0),
    ("name", "Ann  Lee ; Bo", True, "Ann Lee;Bo", "namex2", 0), ("string", " a  b;c ", True, "a b;c", "whitespace", 0), ("text", None, None, None, None, None),
]


@query(
    "SELECT CAST(no AS INTEGER) AS no, ok, value, canonicalizer, refused FROM (VALUES "
    + ", ".join(f"({k}, {'NULL' if c[2] is None else str(c[2]).lower()}, {text(c[3])}, {text(c[4])}, {'NULL' if c[5] is None else c[5]})" for k, c in enumerate(CANONICAL)) + ") AS t(no, ok, value, canonicalizer, refused)"
)
def canonical_cases(spark, d):
    """Verdicts on written cells of every type: packs, completed phones, partial refusals."""
    parts = []
    for t in sorted({c[0] for c in CANONICAL}):
        df = spark.createDataFrame([(k, c[1]) for k, c in enumerate(CANONICAL) if c[0] == t], "no int, cell string").select("no", C.canonical(F.col("cell"), t).alias("r"))
        parts.append(df)
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df)
    refused = F.when(F.col("r").isNotNull(), F.coalesce(F.size("r.refused"), F.lit(0)))
    return out.select("no", "r.ok", "r.value", "r.canonicalizer", refused.alias("refused"))


@query("""SELECT p_partkey, regexp_matches(v, '^Q[1-9][0-9]*$') AS wikidata, regexp_matches(w, '^(IMO)?[0-9]{7}$') AS imo, true AS other FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Q' || p_partkey WHEN 1 THEN 'Q0' ELSE CAST(p_partkey AS VARCHAR) END AS v, CASE p_partkey % 2 WHEN 0 THEN 'IMO' ELSE '' END || lpad(CAST(p_partkey AS VARCHAR), 7, '1') AS w FROM part)""")
def property_formats(spark, d):
    k, s = F.col("p_partkey"), F.col("p_partkey").cast("string")
    v = F.when(k % 3 == 0, F.concat(F.lit("Q"), s)).when(k % 3 == 1, F.lit("Q0")).otherwise(s)
    w = F.concat(F.when(k % 2 == 0, F.lit("IMO")).otherwise(""), F.lpad(s, 7, "1"))
    return table(spark, d, "part").select("p_partkey", C.format_accepts(v, "wikidata").alias("wikidata"), C.format_accepts(w, "imo").alias("imo"), C.format_accepts(v, None).alias("other"))


# -- statistics ---------------------------------------------------------------------------
_WHITE = "' ' || chr(9) || chr(13) || chr(10) || chr(160) || chr(8199) || chr(8239) || chr(12288)"
_PLACEHOLDERS = ", ".join(text(x) for x in X.PLACEHOLDERS)
_LONG = " UNION ALL ".join(f"SELECT 'c{k}' AS column_id, nullif(trim(c{k}, {_WHITE}), '') AS value FROM frame_rows" for k in range(14))


@query(f"""WITH g AS (SELECT column_id, value, count(*) AS n FROM ({_LONG}) WHERE value IS NOT NULL GROUP BY ALL),
r AS (SELECT * FROM g WHERE NOT (lower(value) IN ({_PLACEHOLDERS}) OR regexp_matches(value, '^\\*{{3,}}$'))),
h AS (SELECT column_id, sum(n) AS n, sum(n) FILTER (regexp_matches(value, '^-?[0-9]+([.,][0-9]+)?$')) AS "numeric", sum(n) FILTER (regexp_matches(value, '^[^@\\s]+@[^@\\s.]+\\.[^@\\s]+$')) AS email,
sum(n) FILTER (regexp_matches(value, '^\\p{{Lu}}[\\p{{L}}''’ʼ-]+([ \\t\\n\\r]+\\p{{Lu}}[\\p{{L}}''’ʼ-]+){{1,3}}$')) AS proper_name FROM r GROUP BY column_id),
u AS (SELECT column_id, 'numeric' AS detector, "numeric" / n AS rate FROM h UNION ALL SELECT column_id, 'email', email / n FROM h UNION ALL SELECT column_id, 'proper_name', proper_name / n FROM h)
SELECT column_id, detector, round(CAST(rate AS DOUBLE), 6) AS rate FROM u WHERE rate > 0""")
def detector_rates(spark, d):
    """Shares of the registers' values that detectors take, on distinct values."""
    cells = [f"c{k}" for k in range(14)]
    counts = PR.value_counts(table(spark, d, "frame_rows").withColumn("k", F.lit(0)), ["k"], cells).drop("k")
    got = S.detector_rates(counts, ["numeric", "email", "proper_name"])
    return got.select("column_id", F.explode("detectors").alias("detector", "rate")).select("column_id", "detector", F.round(F.col("rate").cast("double"), 6).alias("rate"))


def _codes(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_partkey").cast("string")
    v = F.when(k % 5 == 0, F.concat(F.lit("AB "), s)).when(k % 5 == 1, F.concat(F.lit("no code "), k % 9)).when(k % 5 == 2, F.lit("-")).when(k % 5 == 3, F.concat(s, F.lit("; X"), s)).otherwise(F.lit(None))
    return table(spark, d, "part").select(k.cast("long").alias("_row"), v.alias("c0"), F.lit("n/a").alias("c1"), F.lit(None).cast("string").alias("c2"))


@query("""WITH r AS (SELECT 'no code ' || (p_partkey % 9) AS v, min(p_partkey) AS first FROM part WHERE p_partkey % 5 = 1 GROUP BY ALL), f AS (SELECT v, first FROM r ORDER BY first LIMIT 5), n AS (SELECT count(*) FILTER (p_partkey % 5 IN (0, 3)) AS ok, count(*) FILTER (p_partkey % 5 = 1) AS bad FROM part)
SELECT 'c0' AS "column", 'identifier' AS type, round(CAST(ok AS DOUBLE) / (ok + bad), 6) AS share, bad AS refused, (SELECT string_agg(v, '|' ORDER BY first) FROM f) AS refused_values FROM n
UNION ALL SELECT 'c1', 'identifier', 0.0, 0, '' UNION ALL SELECT 'c2', 'identifier', 1.0, 0, '' UNION ALL SELECT 'c0', 'name', 1.0, 0, ''""")
def acceptance_shares(spark, d):
    got = S.acceptance(_codes(spark, d), [("c0", "identifier"), ("c1", "identifier"), ("c2", "identifier"), ("c0", "name")])
    return got.select("column", "type", F.round("share", 6).alias("share"), "refused", F.array_join("refused_values", "|").alias("refused_values"))


@query(f"""SELECT column_id, round(avg(CASE WHEN regexp_matches(value, '\\p{{L}}{{2}}') AND length(regexp_replace(value, '[^\\p{{L}}]', '', 'g')) > length(regexp_replace(value, '[^\\p{{Nd}}]', '', 'g')) THEN 1.0 ELSE 0.0 END), 6) AS text_share FROM ({_LONG}) WHERE value IS NOT NULL GROUP BY column_id""")
def text_shares(spark, d):
    cells = [f"c{k}" for k in range(14)]
    got = S.text_share(table(spark, d, "frame_rows").select(F.col("row_id").alias("_row"), *cells), cells)
    return got.select("column_id", F.round("text_share", 6).alias("text_share"))


@query("""SELECT round(avg(CASE WHEN c_custkey % 3 = 0 THEN 1.0 ELSE 0.0 END), 6) AS differ_share FROM customer""")
def name_disagreement(spark, d):
    k = F.col("c_custkey")
    other = F.when(k % 3 == 0, F.concat("c_mktsegment", F.lit(" x"))).when(k % 3 == 1, F.lower("c_mktsegment")).otherwise(F.concat(F.lit(" "), "c_mktsegment"))
    f = table(spark, d, "customer").select(k.cast("long").alias("_row"), F.col("c_mktsegment").alias("c0"), other.alias("c1"))
    return S.disagreement(f, "c0", "c1").select(F.round(F.col("differ_share").cast("double"), 6).alias("differ_share"))


@query("""SELECT 'c0' AS column_id, round(CAST(count(*) FILTER (p_partkey % 4 <> 0) AS DOUBLE) / count(*), 6) AS fill_rate FROM part WHERE p_partkey % 10 <> 0 UNION ALL SELECT 'c1', 1.0""")
def record_fill(spark, d):
    """Fill over records, without the rows that are furniture."""
    p = table(spark, d, "part")
    frame = p.select(F.col("p_partkey").cast("long").alias("_row"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_name")).alias("c0"), F.col("p_brand").alias("c1"))
    furniture = p.select(F.col("p_partkey").cast("long").alias("index"), F.when(F.col("p_partkey") % 10 == 0, "sparse").otherwise("title").alias("kind"))
    return S.record_fill(frame, furniture, ["c0", "c1"]).select("column_id", F.round("fill_rate", 6).alias("fill_rate"))


@query("""SELECT 'c0' AS column_id, '***' AS modal_value, round(CAST(count(*) FILTER (o_orderkey % 5 < 3) AS DOUBLE) / count(*), 6) AS modal_share FROM orders""")
def redacted_columns(spark, d):
    k = F.col("o_orderkey")
    df = table(spark, d, "orders").select(F.when(k % 5 < 3, "***").otherwise(k.cast("string")).alias("c0"), F.when(k % 5 < 2, "***").otherwise(k.cast("string")).alias("c1"), F.lit(0).alias("k"))
    return S.redaction(PR.value_counts(df, ["k"], ["c0", "c1"]).drop("k")).select("column_id", "modal_value", F.round("modal_share", 6).alias("modal_share"))


@query("""WITH g AS (SELECT c_mktsegment AS v, count(*) AS n FROM customer WHERE c_custkey % 4 <> 0 GROUP BY ALL), t AS (SELECT count(*) AS d, sum(n) AS f, max(n) AS m FROM g), c AS (SELECT count(*) AS n FROM customer)
SELECT 'c0' AS column_id, round(greatest(d / f, (d - 1) / (f - m)) * f / n, 6) AS identification FROM t, c UNION ALL SELECT 'c1', 1.0""")
def key_identification(spark, d):
    df = table(spark, d, "customer").select(F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("c0"), F.col("c_custkey").cast("string").alias("c1"), F.lit(0).alias("k"))
    counts = PR.value_counts(df, ["k"], ["c0", "c1"])
    both = PR.profiles(counts, ["k"]).drop("k", "modal_share").join(S.modal(counts.drop("k")), "column_id")
    return S.key_identification(both).select("column_id", F.round("identification", 6).alias("identification"))


# -- a plan with packs, refusals, formats and selections -------------------------------------
SRC = P.Source("suppliers/", "supplier.parquet", "", "1" * 64, "run")
PACKS = Plan(
    "Person",
    [Entity("person", "Person", ["c0"], Selection("c2", "Person")), Entity("org", "Organization", ["c0"], Selection("c2", "Organization"))],
    [],
    [Binding("c1", "Person:idNumber", "person", "identifier"), Binding("c1", "Organization:registrationNumber", "org", "identifier"), Binding("c3", "Person:wikidataId", "person", "identifier")],
)
#: good and bad parts of c1 and of c3 of a supplier, and its kind.
_SUPPLIERS = """WITH s AS (SELECT s_suppkey AS k, CASE s_suppkey % 3 WHEN 0 THEN 'Person' WHEN 1 THEN 'Organization' ELSE 'Vessel' END AS kind,
CASE s_suppkey % 4 WHEN 0 THEN 2 WHEN 3 THEN 0 ELSE 1 END AS good, CASE s_suppkey % 4 WHEN 1 THEN 1 ELSE 0 END AS bad, s_suppkey % 2 = 0 AND s_suppkey > 0 AS formed FROM supplier)"""


def _suppliers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    k, s = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    c1 = F.when(k % 4 == 0, F.concat(F.lit("A"), s, F.lit("; B"), s)).when(k % 4 == 1, F.concat(F.lit("A"), s, F.lit(";nocode"))).when(k % 4 == 2, F.concat(F.lit("C"), s))
    kind = F.when(k % 3 == 0, "Person").when(k % 3 == 1, "Organization").otherwise("Vessel")
    c3 = F.when(k % 2 == 0, F.concat(F.lit("Q"), s)).otherwise(F.concat(F.lit("9"), s))
    frame = table(spark, d, "supplier").select(k.cast("long").alias("_row"), s.alias("c0"), c1.alias("c1"), kind.alias("c2"), c3.alias("c3"))
    rows = P.normalised(frame, PACKS, {})
    return frame, rows, P.facts(rows, PACKS, SRC)


@query(_SUPPLIERS + """ SELECT entity, prop, CAST(sum(e) AS BIGINT) AS expected, CAST(sum(g) AS BIGINT) AS emitted, CAST(sum(b) AS BIGINT) AS rejected, CAST(0 AS BIGINT) AS shortfall FROM (
SELECT 'person' AS entity, 'Person:idNumber' AS prop, good + bad AS e, good AS g, bad AS b FROM s WHERE kind = 'Person' UNION ALL SELECT 'org', 'Organization:registrationNumber', good + bad, good, bad FROM s WHERE kind = 'Organization'
UNION ALL SELECT 'person', 'Person:wikidataId', 1, CASE WHEN formed THEN 1 ELSE 0 END, CASE WHEN formed THEN 0 ELSE 1 END FROM s WHERE kind = 'Person') GROUP BY ALL""")
def pack_claims(spark, d):
    """Claims of packed cells under selections: every part expected is emitted or rejected."""
    _, rows, long = _suppliers(spark, d)
    return L.claim_ledger(rows, long, PACKS).select("entity", "prop", "expected", "emitted", "rejected", "shortfall")


_COVER = """ SELECT 'c0' AS "column", 'structural' AS status, count(*) AS "values", 0 AS offered, 0 AS rejected, count(*) AS structural, 0 AS outside_selection, 0 AS unaccounted FROM s
UNION ALL SELECT 'c1', 'bound', CAST(sum(good + bad) AS BIGINT), CAST(sum(good) FILTER (kind <> 'Vessel') AS BIGINT), CAST(sum(bad) FILTER (kind <> 'Vessel') AS BIGINT), 0, CAST(sum(good + bad) FILTER (kind = 'Vessel') AS BIGINT), 0 FROM s
UNION ALL SELECT 'c2', 'structural', count(*), 0, 0, count(*), 0, 0 FROM s
UNION ALL SELECT 'c3', 'bound', count(*), count(*) FILTER (kind = 'Person'), 0, 0, count(*) FILTER (kind <> 'Person'), 0 FROM s"""


@query(_SUPPLIERS + _COVER)
def pack_coverage(spark, d):
    """Where the parts of every column went: offered, rejected, structural, outside all selections."""
    frame, rows, _ = _suppliers(spark, d)
    return L.coverage(frame, rows, PACKS).select("column", "status", "values", "offered", "rejected", "structural", "outside_selection", "unaccounted")


@query(_SUPPLIERS + """ SELECT 'emit' AS stage, 'c3' AS "column", 'not of the format wikidata' AS reason, count(*) AS n FROM s WHERE kind = 'Person' AND NOT formed
UNION ALL SELECT 'normalize', 'c1', 'no digit and no code', CAST(sum(bad) AS BIGINT) FROM s WHERE kind <> 'Vessel'""")
def stage_rejects(spark, d):
    """Refused parts of packed cells and values that aren't of their property's format."""
    *_, long = _suppliers(spark, d)
    return P.rejects(long).groupBy("stage", "column", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(_SUPPLIERS + """ SELECT 'person' AS entity, k AS "row", 'A' || k AS value, 'c1' AS "column" FROM s WHERE kind = 'Person' AND k % 4 IN (0, 1) UNION ALL SELECT 'person', k, 'B' || k, 'c1' FROM s WHERE kind = 'Person' AND k % 4 = 0
UNION ALL SELECT 'person', k, 'C' || k, 'c1' FROM s WHERE kind = 'Person' AND k % 4 = 2 UNION ALL SELECT 'person', k, 'Q' || k, 'c3' FROM s WHERE kind = 'Person' AND formed""")
def pack_values(spark, d):
    """One statement per part, each with the cell it came from, of the persons' rows."""
    *_, long = _suppliers(spark, d)
    return long.where("selected AND stage IS NULL AND entity = 'person'").select("entity", "row", "value", "column")


@query(_SUPPLIERS + """, c AS (""" + _COVER + """), e AS (SELECT good, bad, kind, formed FROM s)
SELECT true AS accounting_valid, 2 * (SELECT CAST(sum("values") AS BIGINT) FROM c) AS "values", 2 * (SELECT CAST(sum(offered) AS BIGINT) FROM c) AS offered, 2 * (SELECT CAST(sum(rejected) AS BIGINT) FROM c) AS rejected,
2 * (SELECT CAST(sum(good) FILTER (kind <> 'Vessel') + count(*) FILTER (kind = 'Person' AND formed) AS BIGINT) FROM e) AS claims_emitted""")
def merged_totals(spark, d):
    """The totals of two sources, here of the same suppliers twice, added up."""
    frame, rows, long = _suppliers(spark, d)
    one = L.totals(L.coverage(frame, rows, PACKS), L.claim_ledger(rows, long, PACKS))
    return L.merge_totals(one.unionByName(one)).select("accounting_valid", "values", "offered", "rejected", "claims_emitted")


@query(_SUPPLIERS + """, c AS (""" + _COVER + """) SELECT true AS accounting_valid, CAST(sum("values") AS BIGINT) AS "values", CAST(sum(offered) AS BIGINT) AS offered, CAST(sum(rejected) AS BIGINT) AS rejected, CAST(sum(structural) AS BIGINT) AS structural, CAST(sum(outside_selection) AS BIGINT) AS outside_selection FROM c""")
def accounting(spark, d):
    frame, rows, long = _suppliers(spark, d)
    got = L.totals(L.coverage(frame, rows, PACKS), L.claim_ledger(rows, long, PACKS))
    return got.select("accounting_valid", "values", "offered", "rejected", "structural", "outside_selection")


@query(_SUPPLIERS + """ SELECT count(*) + CAST(0 AS BIGINT) AS statements, 0.0 AS unfalsifiable_share FROM (SELECT unnest(range(CASE WHEN kind = 'Vessel' THEN 0 ELSE good END + CASE WHEN kind = 'Person' AND formed THEN 1 ELSE 0 END)) FROM s)""")
def unfalsifiable(spark, d):
    *_, long = _suppliers(spark, d)
    return L.unfalsifiable_share(long)


# -- layout, streams, corpus -----------------------------------------------------------------
@query("""SELECT (SELECT count(*) FROM frame_rows) AS rows, 0 AS header_row, (SELECT column_headers[1] FROM sources WHERE len(column_headers) = 14 ORDER BY source_id LIMIT 1) AS first_header""")
def layout_of_a_register(spark, d):
    """The registers' rows under the headers of the first of them as one raw grid, laid out again: its records and its header."""
    heads = table(spark, d, "sources").where(F.size("column_headers") == 14).agg(F.min_by("column_headers", "source_id").alias("h")).first()["h"]
    rows = table(spark, d, "frame_rows").select(F.col("row_id").cast("long").alias("_row"), F.array(*[f"c{k}" for k in range(14)]).alias("cells"))
    grid = spark.createDataFrame([(0, heads)], "_row long, cells array<string>").unionByName(rows)
    got = LY.build_frame(grid)
    return got.rows.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.lit(got.header.row).alias("header_row"), F.lit(got.columns[0]["header"]).alias("first_header"))


@query("""SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS rows FROM events GROUP BY ALL""")
def daily_windows(spark, d):
    """The windowed counts of the stream, over all events at once."""
    return arrivals.window_counts(table(spark, d, "events"), "ts", ["event_type"])


@query("""SELECT source_id AS source, schema, CAST(sum(n) AS BIGINT) AS entities FROM (SELECT source AS source_id, coalesce(lang, '-') AS schema, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY ALL) GROUP BY ROLLUP (source_id, schema)""")
def corpus_rollup(spark, d):
    """Sources' summaries (a small document each) as one table with its margins."""
    got = table(spark, d, "documents").where("source IS NOT NULL").groupBy("source", F.coalesce("lang", F.lit("-")).alias("schema")).count().collect()
    summaries: dict[str, dict] = {}
    for r in got:
        summaries.setdefault(r["source"], {"source": r["source"], "entities": {}})["entities"][r["schema"]] = r["count"]
    return summary_table(spark, list(summaries.values()))


# -- ontology and planning -------------------------------------------------------------------
_PARENTS = ", ".join(f"({text(s.name)}, {text(p)})" for s in default().schemata.values() for p in s.parents)
_NAMES = ", ".join(f"({text(s)})" for s in default().schemata)


@query(f"""WITH RECURSIVE p(child, parent) AS (VALUES {_PARENTS}), n(name) AS (VALUES {_NAMES}), a(child, ancestor) AS (SELECT name, name FROM n UNION SELECT a.child, p.parent FROM a JOIN p ON a.ancestor = p.child) SELECT child, ancestor FROM a WHERE ancestor IN (SELECT name FROM n)""")
def ontology_closure(spark, d):
    return default().closure_table(spark)


_OWN = ", ".join(f"({text(s.name)}, {text(p.name)}, {str(p.matchable).lower()})" for s in default().schemata.values() for p in s.own.values())


@query(f"""WITH RECURSIVE p(child, parent) AS (VALUES {_PARENTS}), n(name) AS (VALUES {_NAMES}), a(child, ancestor) AS (SELECT name, name FROM n UNION SELECT a.child, p.parent FROM a JOIN p ON a.ancestor = p.child), o(schema, prop, matchable) AS (VALUES {_OWN})
SELECT a.child AS schema, count(DISTINCT o.prop) AS props FROM a JOIN o ON a.ancestor = o.schema GROUP BY a.child""")
def ontology_props(spark, d):
    """How many properties each schema carries, inherited ones included."""
    return default().prop_table(spark).groupBy("schema").agg(F.count_distinct("name").alias("props"))


@query("""WITH c AS (SELECT entity_key, prop, column_id, count(*) AS strength FROM decisions WHERE prop IS NOT NULL AND entity_key IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY entity_key, prop ORDER BY strength DESC, CAST(substr(column_id, 2) AS INTEGER)) AS r FROM c) SELECT entity_key, prop, column_id FROM r WHERE r = 1""")
def claims_winner(spark, d):
    """The columns that keep a property which several claim: the planner's rule over the decisions' claims (a row per column and property)."""
    got = table(spark, d, "decisions").where("prop IS NOT NULL AND entity_key IS NOT NULL").groupBy("entity_key", "prop", "column_id").count().collect()
    columns = [ColumnFacts(c, int(c[1:])) for c in sorted({r["column_id"] for r in got})]
    plan = Plan("Person", [Entity(e, "Person") for e in sorted({r["entity_key"] for r in got})], [], [Binding(r["column_id"], r["prop"], r["entity_key"], "date") for r in got])
    ctx = V.Context(None, columns, strengths={(r["column_id"], r["entity_key"], r["prop"]): float(r["count"]) for r in got})
    V.resolve_claims(plan, ctx)
    return spark.createDataFrame([(b.entity, b.prop, b.column) for b in plan.bindings], "entity_key string, prop string, column_id string")


# -- review and scoring ------------------------------------------------------------------------
@query("""WITH e AS (SELECT source_id, decision_id AS seq, CASE WHEN decision_id % 97 = 0 THEN 'approve' WHEN decision_id % 97 = 1 AND length(source_id) % 2 = 0 THEN 'reopen' WHEN verdict = 'unmapped' THEN 'note' ELSE 'bind' END AS action FROM decisions),
r AS (SELECT source_id, count(*) FILTER (action = 'bind') AS revision FROM e GROUP BY ALL), m AS (SELECT source_id, arg_max(action, seq) AS action, arg_max(seq, seq) AS seq FROM e WHERE action IN ('approve', 'reopen') GROUP BY ALL)
SELECT s.source_id, CASE WHEN m.action IS NULL OR m.action = 'reopen' THEN 'pending' WHEN m.seq % 2 = 0 THEN 'approved' ELSE 'stale' END AS state, coalesce(r.revision, 0) AS revision FROM sources s LEFT JOIN r USING (source_id) LEFT JOIN m USING (source_id)""")
def review_states(spark, d):
    """pending, approved or stale by the last mark of each source; even marks were given for the present revision."""
    k = F.col("decision_id")
    action = F.when(k % 97 == 0, "approve").when((k % 97 == 1) & (F.length("source_id") % 2 == 0), "reopen").when(F.col("verdict") == "unmapped", "note").otherwise("bind")
    e = table(spark, d, "decisions").select("source_id", k.alias("seq"), action.alias("action"), F.lit(1).cast("long").alias("generation"), F.lit(None).cast("string").alias("column"))
    now = RV.override_revision(e)
    e = e.join(now, "source_id").withColumn("revision", F.when(F.col("seq") % 2 == 0, F.col("revision")).otherwise(F.col("revision") - 1))
    current = table(spark, d, "sources").select("source_id", F.lit(1).cast("long").alias("generation"))
    return RV.review_state(e, current).select("source_id", "state", "revision")


@query("""SELECT column_id AS "column", row_count, bindings, verdict, override, candidates FROM (SELECT column_id, max(row_count) AS row_count FROM column_profile GROUP BY ALL) p
LEFT JOIN (SELECT column_id, count(DISTINCT prop) FILTER (prop IS NOT NULL) AS bindings, arg_max(verdict, decision_id) AS verdict, nullif(arg_max(coalesce(prop, ''), decision_id) FILTER (verdict = 'accepted'), '') AS override, count(DISTINCT header) FILTER (header IS NOT NULL) AS candidates FROM decisions GROUP BY ALL) d USING (column_id)""")
def review_cards(spark, d):
    """One card per column: profile, bindings, last decision, override, candidates."""
    df = table(spark, d, "decisions")
    profile = table(spark, d, "column_profile").groupBy(F.col("column_id").alias("column")).agg(F.max("row_count").alias("row_count"))
    bound = df.where("prop IS NOT NULL").select(F.col("column_id").alias("column"), F.lit("e").alias("entity"), "prop").distinct()
    last = df.select(F.col("column_id").alias("column"), "verdict", "reason", "decided_by", F.col("decision_id").alias("seq"))
    events = df.where("verdict = 'accepted'").select(F.lit("s").alias("source_id"), F.col("decision_id").alias("seq"), F.lit("bind").alias("action"), F.col("column_id").alias("column"), F.lit(None).cast("string").alias("entity"), F.coalesce("prop", F.lit("")).alias("prop"), F.lit("").alias("actor"))
    listed = df.where("header IS NOT NULL").select(F.col("column_id").alias("column"), F.lit(1).alias("rank"), F.col("header").alias("qname"), F.lit(1.0).alias("score")).distinct()
    got = RV.cards(profile, bound, last, events, listed)
    none = lambda c: F.when(F.col("decision").isNotNull(), F.coalesce(F.size(c), F.lit(0)))
    return got.select("column", "row_count", none("bindings").alias("bindings"), "decision.verdict", F.nullif("override.prop", F.lit("")).alias("override"), none("candidates").alias("candidates"))


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "decisions").select(F.col("decision_id").cast("string").alias("column"), "source_id", "prop", "header", "verdict", "column_id")
    gold = df.select("source_id", "column", "prop", F.array(F.coalesce("header", F.lit(""))).alias("accepted"))
    got = F.when(F.col("verdict") == "accepted", F.col("prop")).when(F.col("verdict") == "rejected", F.col("header")).when(F.col("verdict") == "declined", F.lit("other"))
    bound = df.select("source_id", "column", got.alias("prop")).where("prop IS NOT NULL")
    return Z.column_verdicts(gold, bound, df.where("column_id IN ('c2', 'c4')").select("source_id", "column"))


_VERDICTS = """WITH v AS (SELECT source_id, prop, header, column_id, CASE verdict WHEN 'accepted' THEN prop WHEN 'rejected' THEN header WHEN 'declined' THEN 'other' END AS got FROM decisions),
j AS (SELECT source_id, CASE WHEN prop IS NULL AND got IS NOT NULL THEN 'STRETCHED' WHEN prop IS NULL OR got = prop THEN 'AGREE' WHEN got = header THEN 'BOTH-DEFENSIBLE' WHEN got IS NOT NULL THEN 'PIPELINE-WRONG' WHEN column_id IN ('c2', 'c4') THEN 'KEY-ONLY' ELSE 'MISSED' END AS verdict FROM v)"""


@query(_VERDICTS + " SELECT source_id, verdict, count(*) AS n FROM j GROUP BY ALL")
def score_verdicts(spark, d):
    """Every decision's property as gold, what its verdict made of it as run."""
    return _verdicts(spark, d).groupBy("source_id", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query(_VERDICTS + """ SELECT count(*) AS columns, count(*) FILTER (verdict = 'AGREE') AS agree, count(*) FILTER (verdict = 'STRETCHED') AS stretched, count(*) FILTER (verdict = 'PIPELINE-WRONG') AS pipeline_wrong, count(*) FILTER (verdict = 'KEY-ONLY') AS key_only, count(*) FILTER (verdict = 'MISSED') AS missed,
round(CAST(count(*) FILTER (verdict IN ('AGREE', 'BOTH-DEFENSIBLE')) AS DOUBLE) / count(*), 6) AS agree_share FROM j""")
def score_totals(spark, d):
    return Z.verdict_totals(_verdicts(spark, d)).select("columns", "agree", "stretched", "pipeline_wrong", "key_only", "missed", F.round("agree_share", 6).alias("agree_share"))


@query("""SELECT * FROM (VALUES ('a', 'x', 'ENTITY-AGREE', true, true), ('b', 'y', 'ENTITY-GENERALISED', false, false), ('c', NULL, 'ENTITY-MISSING', NULL, NULL)) AS t(gold, run, verdict, keys, instances)""")
def entity_verdict_cases(spark, d):
    """Entities of a gold answer paired with those of a run: schema, keys, instances within five in a hundred."""
    E = Z.GoldEntity
    got = Z.entity_verdicts([E("a", "Person", ["c0"], 100), E("b", "Company", ["c1"], 40), E("c", "Vessel", ["c9"], 1)], [E("y", "Organization", ["c1", "c2"], 43), E("x", "Person", ["c0"], 104)])
    return spark.createDataFrame([(r["gold"], r["run"], r["verdict"], r["keys"], r["instances"]) for r in got], "gold string, run string, verdict string, keys boolean, instances boolean")


@query("""SELECT * FROM (VALUES ('Ownership', 'EDGE-AGREE'), ('Debt', 'EDGE-ENDS-DIFFER'), ('Membership', 'EDGE-MISSING'), (NULL, 'EDGE-EXTRA')) AS t(gold, verdict)""")
def edge_verdict_cases(spark, d):
    got = Z.edge_verdicts([("Ownership", "a", "b"), ("Debt", "a", "b"), ("Membership", "a", "b")], [("Debt", "y", "x"), ("Ownership", "x", "y"), ("Family", "x", "y")], {"a": "x", "b": "y"})
    return spark.createDataFrame([(r["gold"][0] if r["gold"] else None, r["verdict"]) for r in got], "gold string, verdict string")


@query("""SELECT * FROM (VALUES ('Person', 'SUBJECT-AGREE'), ('Company', 'SUBJECT-ACCEPTABLE'), (NULL, 'SUBJECT-WRONG')) AS t(got, verdict)""")
def subject_verdict_cases(spark, d):
    return spark.createDataFrame([(g, Z.subject_verdict("Person", ["Company"], g)) for g in ("Person", "Company", None)], "got string, verdict string")
