"""Queries that show each operator on the driver's tables, and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
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
from tabloom.plans import compile as P
from tabloom.plans import facts as FA
from tabloom.plans import shortlist as SH
from tabloom.plans import validate as V
from tabloom.plans.model import Attachment, Binding, Decision, Entity, Plan, Relation, Selection
from tabloom.plans.ontology import default
from tabloom.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def as_frame(df: DataFrame, row: str, columns: list[str]) -> DataFrame:
    """A table as a frame: _row and text columns c0, c1, ... ."""
    return df.select(F.col(row).cast("long").alias("_row"), *[F.col(c).cast("string").alias(f"c{k}") for k, c in enumerate(columns)])


def _stable(t: str, cols: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_id, CAST({c} AS VARCHAR) AS value FROM {t}" for c in cols)


# -- profiling -------------------------------------------------------------------
CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]


def _customer_counts(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "customer").select(*[F.col(c).cast("string").alias(c) for c in CUSTOMER]).withColumn("k", F.lit(0))
    return PR.value_counts(df, ["k"], CUSTOMER).drop("k")


_CUSTOMER_LONG = _stable("customer", CUSTOMER)


@query(f"""WITH v AS ({_CUSTOMER_LONG}), g AS (SELECT column_id, value, count(*) AS n FROM v GROUP BY ALL)
SELECT column_id, CAST(sum(n) AS BIGINT) AS row_count, CAST(sum(CASE WHEN value IS NOT NULL THEN n ELSE 0 END) AS BIGINT) AS filled, count(value) AS distinct_values,
CAST(min(length(value)) AS INTEGER) AS min_len, CAST(max(length(value)) AS INTEGER) AS max_len, round(CAST(max(n) AS DOUBLE) / sum(n), 6) AS modal_share,
round(CAST(count(value) AS DOUBLE) / sum(n), 6) AS distinct_ratio, round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 6) AS entropy FROM g GROUP BY column_id""")
def column_profile(spark, d):
    got = PR.profiles(_customer_counts(spark, d), [])
    return got.select("column_id", "row_count", "filled", "distinct_values", "min_len", "max_len", *[F.round(c, 6).alias(c) for c in ("modal_share", "distinct_ratio", "entropy")])


@query("""WITH s AS (SELECT regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(p_name, '[0-9]', '#', 'g'), '[A-Za-z]', 'L', 'g'), '#', 'd'), 'L{9,}', 'L+', 'g'), 'd{9,}', 'd+', 'g') AS shape FROM part)
SELECT shape, count(*) AS n FROM s GROUP BY shape""")
def value_shapes(spark, d):
    return table(spark, d, "part").groupBy(X.shape("p_name").alias("shape")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH v AS ({_CUSTOMER_LONG}), g AS (SELECT column_id, value, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY ALL)
SELECT column_id, round(CAST(max(n) AS DOUBLE) / sum(n), 6) AS modal_share, max_by(value, (n, value)) AS modal_value, round(CASE WHEN sum(n) > max(n) THEN CAST(count(*) - 1 AS DOUBLE) / (sum(n) - max(n)) ELSE 0.0 END, 6) AS distinct_ex_modal FROM g GROUP BY column_id""")
def modal_values(spark, d):
    got = S.modal(_customer_counts(spark, d))
    return got.select("column_id", F.round("modal_share", 6).alias("modal_share"), "modal_value", F.round("distinct_ex_modal", 6).alias("distinct_ex_modal"))


@query()
def column_samples(spark, d):
    return S.samples(_customer_counts(spark, d)).select("column_id", F.array_join("samples", "|").alias("samples"))


_CELLS = " UNION ALL ".join(f"SELECT 'c{k}' AS column_id, source_id, load_no, trim(c{k}, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) AS value FROM frame_rows" for k in (1, 2, 4, 10, 11))


@query(f"""WITH v AS ({_CELLS}), f AS (SELECT * FROM v WHERE value <> '')
SELECT source_id, load_no, column_id, count(*) AS filled, count(*) FILTER (lower(value) IN ('-','--','—','?','n/a','na','n.a.','null','none','nil','unknown','not available','не вказано','не визначено','невідомо','немає','відсутній','відсутня','відсутнє','нет','не указано','0000-00-00','00.00.0000') OR regexp_matches(value, '^\\*{{3,}}$')) AS sentinels FROM f GROUP BY ALL""")
def sentinel_counts(spark, d):
    cols = [f"c{k}" for k in (1, 2, 4, 10, 11)]
    counts = PR.value_counts(table(spark, d, "frame_rows"), ["source_id", "load_no"], cols).where("value IS NOT NULL")
    return counts.groupBy("source_id", "load_no", "column_id").agg(F.sum("n").alias("filled"), F.coalesce(F.sum(F.when(X.is_placeholder("value"), F.col("n"))), F.lit(0)).alias("sentinels"))


_EDR = """WITH k AS (SELECT o_orderkey, lpad(CAST((o_orderkey * 7919 + 30000000) % 100000000 AS VARCHAR), 8, '0') AS v FROM orders),
x AS (SELECT o_orderkey, v, CAST(v AS INTEGER) BETWEEN 30000000 AND 60000000 AS mid, [CAST(substr(v, i, 1) AS INTEGER) FOR i IN range(1, 9)] AS g FROM k),
s AS (SELECT *, (CASE WHEN mid THEN g[1]*7+g[2]*1+g[3]*2+g[4]*3+g[5]*4+g[6]*5+g[7]*6 ELSE g[1]*1+g[2]*2+g[3]*3+g[4]*4+g[5]*5+g[6]*6+g[7]*7 END) % 11 AS a,
(CASE WHEN mid THEN g[1]*9+g[2]*3+g[3]*4+g[4]*5+g[5]*6+g[6]*7+g[7]*8 ELSE g[1]*3+g[2]*4+g[3]*5+g[4]*6+g[5]*7+g[6]*8+g[7]*9 END) % 11 AS b FROM x)"""


@query(_EDR + " SELECT o_orderkey, v AS code, (CASE WHEN a = 10 THEN b ELSE a END) = g[8] AS valid FROM s")
def checksum_company_code(spark, d):
    v = F.lpad(((F.col("o_orderkey") * 7919 + 30000000) % 100000000).cast("string"), 8, "0")
    return table(spark, d, "orders").select("o_orderkey", v.alias("code"), D.edrpou(v).alias("valid"))


@query("""WITH k AS (SELECT o_orderkey, lpad(CAST((o_orderkey * 104729 + 1000000007) % 10000000000 AS VARCHAR), 10, '0') AS v FROM orders),
x AS (SELECT *, [CAST(substr(v, i, 1) AS INTEGER) FOR i IN range(1, 11)] AS g FROM k)
SELECT o_orderkey, ((((-g[1]+5*g[2]+7*g[3]+9*g[4]+4*g[5]+6*g[6]+10*g[7]+5*g[8]+7*g[9]) % 11) + 11) % 11) % 10 = g[10] AS valid FROM x""")
def checksum_tax_number(spark, d):
    v = F.lpad(((F.col("o_orderkey") * 104729 + 1000000007) % 10000000000).cast("string"), 10, "0")
    return table(spark, d, "orders").select("o_orderkey", D.rnokpp(v).alias("valid"))


@query("""WITH k AS (SELECT o_orderkey, lpad(CAST((o_orderkey * 15485863 + 7) % 100000000000 AS VARCHAR), 11, '0') AS v FROM orders),
x AS (SELECT *, [CAST(substr(v, i, 1) AS INTEGER) FOR i IN range(1, 12)] AS g FROM k), s AS (SELECT *, 9*g[1]+8*g[2]+7*g[3]+6*g[4]+5*g[5]+4*g[6]+3*g[7]+2*g[8]+g[9] AS t FROM x)
SELECT o_orderkey, (CASE WHEN t < 100 THEN t WHEN t IN (100, 101) THEN 0 WHEN t % 101 = 100 THEN 0 ELSE t % 101 END) = g[10]*10+g[11] AS valid FROM s""")
def checksum_insurance_number(spark, d):
    v = F.lpad(((F.col("o_orderkey") * 15485863 + 7) % 100000000000).cast("string"), 11, "0")
    return table(spark, d, "orders").select("o_orderkey", D.snils(v).alias("valid"))


# -- scalar functions ----------------------------------------------------------------
@query("""WITH v AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%d.%m.%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%d-%b-%Y') WHEN 3 THEN strftime(o_orderdate, '%d/%m/%y') ELSE '31.02.' || strftime(o_orderdate, '%Y') END AS v, o_orderdate FROM orders)
SELECT o_orderkey, o_orderkey % 5 <> 4 AS ok, CASE WHEN o_orderkey % 5 <> 4 THEN strftime(o_orderdate, '%Y-%m-%d') END AS value FROM v""")
def canonical_dates(spark, d):
    k, at = F.col("o_orderkey") % 5, F.col("o_orderdate")
    v = F.when(k == 0, F.date_format(at, "dd.MM.yyyy")).when(k == 1, F.date_format(at, "yyyy-MM-dd")).when(k == 2, F.date_format(at, "dd-MMM-yyyy")).when(k == 3, F.date_format(at, "dd/MM/yy")).otherwise(F.concat(F.lit("31.02."), F.date_format(at, "yyyy")))
    got = table(spark, d, "orders").select("o_orderkey", C.canonical(v, "date").alias("r"))
    return got.select("o_orderkey", F.col("r.ok").alias("ok"), F.col("r.value").alias("value"))


@query("""WITH v AS (SELECT c_custkey, lpad(CAST(c_custkey % 1000000000 AS VARCHAR), 9, '0') AS n FROM customer)
SELECT c_custkey, c_custkey % 3 <> 2 AS ok, CASE WHEN c_custkey % 3 <> 2 THEN '+380' || n END AS value FROM v""")
def canonical_phones(spark, d):
    n, k = F.lpad((F.col("c_custkey") % 1000000000).cast("string"), 9, "0"), F.col("c_custkey") % 3
    v = F.when(k == 0, F.concat(F.lit("+380 ("), F.substring(n, 1, 2), F.lit(") "), F.substring(n, 3, 9))).when(k == 1, F.concat(F.lit("тел.: 0"), n)).otherwise(F.concat(F.lit("+1"), n))
    got = table(spark, d, "customer").select("c_custkey", C.canonical(v, "phone").alias("r"))
    return got.select("c_custkey", F.col("r.ok").alias("ok"), F.col("r.value").alias("value"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'AB' || CAST(p_partkey AS VARCHAR) WHEN 1 THEN CAST(p_partkey AS VARCHAR) || '77' WHEN 2 THEN NULL ELSE 'XYZW' END AS value FROM part""")
def canonical_identifiers(spark, d):
    s, k = F.col("p_partkey").cast("string"), F.col("p_partkey") % 4
    v = F.when(k == 0, F.concat(F.lit("AB "), s)).when(k == 1, F.concat(s, F.lit("-7/7"))).when(k == 2, F.concat(F.lit("no code "), s)).otherwise(F.lit("XY-ZW"))
    return table(spark, d, "part").select("p_partkey", C.canonical(v, "identifier")["value"].alias("value"))


@query("""SELECT s_suppkey, 'S' || CAST(s_suppkey AS VARCHAR) || '@mail.test' AS email, CASE s_nationkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' END AS gender, CASE s_nationkey % 2 WHEN 0 THEN 'ua' ELSE 'pl' END AS country, 'http://host.test/' AS url FROM supplier""")
def canonical_contacts(spark, d):
    df, k = table(spark, d, "supplier"), F.col("s_nationkey")
    mail = F.concat(F.lit(" S"), F.col("s_suppkey").cast("string"), F.lit("@MAIL.test"))
    sex = F.when(k % 3 == 0, "Чол.").when(k % 3 == 1, "ж").otherwise("?")
    land = F.when(k % 2 == 0, "Україна").otherwise("PL")
    got = {"email": C.canonical(mail, "email"), "gender": C.canonical(sex, "gender"), "country": C.canonical(land, "country"), "url": C.canonical(F.lit("HTTP://Host.test"), "url")}
    return df.select("s_suppkey", *[v["value"].alias(n) for n, v in got.items()])


@query("""SELECT doc_id, trim(regexp_replace(lower(source), '_', ' ', 'g')) AS folded FROM documents""")
def folded_headers(spark, d):
    return table(spark, d, "documents").select("doc_id", X.fold_header("source").alias("folded"))


@query("""WITH v AS (SELECT DISTINCT n_nationkey, CAST(n_nationkey AS VARCHAR) AS a, CAST(n_regionkey AS VARCHAR) AS b FROM nation)
SELECT n_nationkey, length(a) || ':' || a || '|' || length(b) || ':' || b || '|' AS body, sha1('src/' || chr(0) || 'k' || chr(0) || length(a) || ':' || a || '|' || length(b) || ':' || b || '|') AS id FROM v""")
def composite_keys(spark, d):
    body = X.composite(F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string"))
    return table(spark, d, "nation").select("n_nationkey", body.alias("body"), F.sha1(F.concat(F.lit("src/\x00k\x00"), body)).alias("id"))


@query("""SELECT register_id, CAST(sum(len(string_split(t, ';'))) AS BIGINT) AS parts, count(*) AS cells FROM (SELECT register_id, lang || ';' || source AS t FROM documents WHERE lang IS NOT NULL) GROUP BY register_id""")
def unpacked_values(spark, d):
    df = table(spark, d, "documents").where("lang IS NOT NULL").select("register_id", F.concat_ws(";", "lang", "source").alias("t"))
    got = df.select("register_id", C.canonical(F.col("t"), "name")["value"].alias("v"))
    return got.groupBy("register_id").agg(F.sum(F.size(C.parts_of(F.col("v"), "name"))).alias("parts"), F.count(F.lit(1)).alias("cells"))


# -- statistics of columns and pairs ----------------------------------------------------
@query("""WITH p AS (SELECT DISTINCT n_nationkey AS i, n_regionkey AS o FROM nation) SELECT (SELECT max(c) FROM (SELECT count(*) c FROM p GROUP BY i)) = 1 AND (SELECT max(c) FROM (SELECT count(*) c FROM p GROUP BY o)) = 1 AS one_to_one, (SELECT count(*) FROM p) AS pairs""")
def functional_dependency(spark, d):
    return S.one_to_one(as_frame(table(spark, d, "nation"), "n_nationkey", ["n_nationkey", "n_regionkey"]), ["c0"], "c1")


@query("""WITH g AS (SELECT p_brand AS i, p_type AS o, count(*) AS n FROM part GROUP BY ALL), m AS (SELECT i, max(n) AS top, sum(n) AS n FROM g GROUP BY i)
SELECT round(CAST(sum(top) AS DOUBLE) / sum(n), 6) AS share, count(*) AS inner_values, (SELECT count(DISTINCT o) FROM g) AS outer_values FROM m""")
def nested_levels(spark, d):
    got = S.nested(as_frame(table(spark, d, "part"), "p_partkey", ["p_brand", "p_type"]), "c0", "c1")
    return got.select(F.round("share", 6).alias("share"), "inner_values", "outer_values")


@query("""WITH g AS (SELECT o_custkey, count(DISTINCT o_orderpriority) AS d FROM orders GROUP BY o_custkey) SELECT median(d) AS median_values, max(d) AS most_values, count(*) AS keys FROM g""")
def values_per_key(spark, d):
    return S.values_per_key(as_frame(table(spark, d, "orders"), "o_orderkey", ["o_custkey", "o_orderpriority"]), ["c0"], "c1")


@query("""WITH g AS (SELECT o_custkey, count(*) AS rows, count(DISTINCT o_orderstatus) AS v, min(o_orderkey) AS first FROM orders GROUP BY o_custkey) SELECT CAST(o_custkey AS VARCHAR) AS key, rows, v AS values FROM g ORDER BY rows DESC, first LIMIT 1""")
def values_under_modal_key(spark, d):
    return S.values_under_modal_key(as_frame(table(spark, d, "orders"), "o_orderkey", ["o_custkey", "o_orderstatus"]), "c0", "c1")


@query("""SELECT 'c0' AS a, 'c1' AS b, round(avg(CASE WHEN l_returnflag = l_linestatus THEN 1.0 ELSE 0.0 END), 6) AS equal_share, avg(CASE WHEN l_returnflag = l_linestatus THEN 1.0 ELSE 0.0 END) >= 0.9 AS twin FROM lineitem""")
def twin_columns(spark, d):
    got = S.twin_columns(as_frame(table(spark, d, "lineitem"), "l_orderkey", ["l_returnflag", "l_linestatus"]), [("c0", "c1")])
    return got.select("a", "b", F.round("equal_share", 6).alias("equal_share"), "twin")


@query("""SELECT 'r_regionkey' AS name, bool_and(d IS NULL OR d = 1) AS ordinal FROM (SELECT r_regionkey - lag(r_regionkey) OVER (ORDER BY r_regionkey) AS d FROM region)
UNION ALL SELECT 'o_custkey', bool_and(d IS NULL OR d = 1) FROM (SELECT o_custkey - lag(o_custkey) OVER (ORDER BY o_orderkey) AS d FROM orders)""")
def row_ordinals(spark, d):
    a = S.is_ordinal(as_frame(table(spark, d, "region"), "r_regionkey", ["r_regionkey"]), "c0").select(F.lit("r_regionkey").alias("name"), "ordinal")
    return a.unionByName(S.is_ordinal(as_frame(table(spark, d, "orders"), "o_orderkey", ["o_custkey"]), "c0").select(F.lit("o_custkey").alias("name"), "ordinal"))


@query("""SELECT 'event_type' AS column_id, event_type AS value, count(*) AS n FROM events GROUP BY ALL""")
def kind_columns(spark, d):
    df = table(spark, d, "events").select("event_type", F.col("event_id").cast("string").alias("event_id"), F.lit(0).alias("k"))
    counts = PR.value_counts(df, ["k"], ["event_type", "event_id"]).drop("k")
    return S.kind_columns(counts, df.count())


@query()
def phone_pack_rates(spark, d):
    return S.pack_rates(table(spark, d, "frame_rows").select(F.col("row_id").alias("_row"), "c5"), "c5")


# -- execution of a plan ---------------------------------------------------------------
SRC = P.Source("customers/", "customer.parquet", "", "0" * 64, "run")
PLAN = Plan(
    "Person",
    [Entity("person", "Person", ["c0"]), Entity("nation", "PublicBody", ["c2"])],
    [Relation("membership", "Membership", "person", "nation")],
    [Binding("c1", "Person:name", "person", "name"), Binding("c3", "Person:position", "person", "string"), Binding("c4", "PublicBody:name", "nation", "name")],
    [Attachment("person", "parent", "nation")],
    [Decision("c5", None, None, "unmapped")],
)


def _customers(spark: SparkSession, d: str) -> DataFrame:
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return as_frame(c.join(n, c.c_nationkey == n.n_nationkey), "c_custkey", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment", "n_name", "c_acctbal"])


def _long(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    frame = _customers(spark, d)
    rows = P.normalised(frame, PLAN, {})
    return frame, rows, P.facts(rows, PLAN, SRC)


_IDS = """WITH c AS (SELECT *, sha1('customers/' || chr(0) || 'person' || chr(0) || c_custkey) AS pid, sha1('customers/' || chr(0) || 'nation' || chr(0) || n_nationkey) AS nid,
sha1('customers/' || chr(0) || 'membership' || chr(0) || length(CAST(c_custkey AS VARCHAR)) || ':' || c_custkey || '|' || length(CAST(n_nationkey AS VARCHAR)) || ':' || n_nationkey || '|') AS mid FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@query(_IDS + """ SELECT pid AS entity_id, 'Person' AS schema, 'name' AS prop, c_name AS value, 'c1' AS column_id, c_custkey AS row FROM c UNION ALL SELECT pid, 'Person', 'position', c_mktsegment, 'c3', c_custkey FROM c
UNION ALL SELECT nid, 'PublicBody', 'name', n_name, 'c4', c_custkey FROM c""")
def statements(spark, d):
    *_, long = _long(spark, d)
    return P.statements(long, PLAN, SRC).select("entity_id", "schema", "prop", "value", "column_id", "row")


@query(_IDS + """, v AS (SELECT pid AS id, 'Person' AS schema, 'name' AS prop, c_name AS value FROM c UNION SELECT pid, 'Person', 'position', c_mktsegment FROM c UNION SELECT pid, 'Person', 'parent', nid FROM c UNION SELECT nid, 'PublicBody', 'name', n_name FROM c
UNION SELECT mid, 'Membership', 'member', pid FROM c UNION SELECT mid, 'Membership', 'organization', nid FROM c), p AS (SELECT id, schema, prop, string_agg(value, '|' ORDER BY value) AS vs FROM v GROUP BY ALL)
SELECT id, schema, string_agg(prop || '=' || vs, ',' ORDER BY prop) AS properties FROM p GROUP BY id, schema""")
def entity_merge(spark, d):
    _, rows, long = _long(spark, d)
    got = P.entities(long, P.references(rows, PLAN, SRC))
    flat = F.transform(F.array_sort(F.map_entries("properties")), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "|")))
    return got.select("id", "schema", F.array_join(flat, ",").alias("properties"))


@query(_IDS + """ SELECT mid AS entity_id, 'namesMentioned' AS prop, c_name AS value FROM c UNION SELECT mid, 'namesMentioned', n_name FROM c""")
def names_mentioned(spark, d):
    """Memberships under the names of their two ends."""
    _, rows, long = _long(spark, d)
    return P.names_mentioned(long, P.references(rows, PLAN, SRC), ["Membership"]).select("entity_id", "prop", "value")


@query("""SELECT 'Person' AS schema, 'person' AS entity, count(DISTINCT c_custkey) AS instances FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'PublicBody', 'nation', count(DISTINCT c_nationkey) FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'Membership', 'membership', count(*) FROM (SELECT DISTINCT c_custkey, c_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey)""")
def instances(spark, d):
    _, rows, _ = _long(spark, d)
    return L.instances(P.declared_ids(rows, PLAN, SRC))


_N = "(SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey)"


@query(f"""SELECT 'c1' AS "column", 'bound' AS status, {_N} AS "values", {_N} AS offered, 0 AS declined, 0 AS structural, 0 AS unaccounted UNION ALL SELECT 'c3', 'bound', {_N}, {_N}, 0, 0, 0 UNION ALL SELECT 'c4', 'bound', {_N}, {_N}, 0, 0, 0
UNION ALL SELECT 'c0', 'structural', {_N}, 0, 0, {_N}, 0 UNION ALL SELECT 'c2', 'structural', {_N}, 0, 0, {_N}, 0 UNION ALL SELECT 'c5', 'unmapped', {_N}, 0, {_N}, 0, 0""")
def coverage_ledger(spark, d):
    frame, rows, _ = _long(spark, d)
    return L.coverage(frame, rows, PLAN).select("column", "status", "values", "offered", "declined", "structural", "unaccounted")


@query(f"""SELECT 'person' AS entity, 'Person:name' AS prop, {_N} AS expected, {_N} AS emitted, 0 AS rejected, 0 AS shortfall UNION ALL SELECT 'person', 'Person:position', {_N}, {_N}, 0, 0 UNION ALL SELECT 'nation', 'PublicBody:name', {_N}, {_N}, 0, 0""")
def claim_ledger(spark, d):
    _, rows, long = _long(spark, d)
    return L.claim_ledger(rows, long, PLAN).select("entity", "prop", "expected", "emitted", "rejected", "shortfall")


EVENTS = Plan(
    "Person",
    [Entity("click", "Note", ["c0"], Selection("c1", "click")), Entity("view", "Event", ["c0"], Selection("c1", "view"))],
    [],
    [Binding("c2", "Note:description", "click", "text"), Binding("c2", "Event:startDate", "view", "date")],
)


def _events(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "events").withColumn("day", F.when(F.col("event_id") % 7 == 0, F.lit("31.02.2020")).otherwise(F.date_format("ts", "dd.MM.yyyy")))
    return P.normalised(as_frame(df, "event_id", ["event_id", "event_type", "day"]), EVENTS, {})


@query("""WITH e AS (SELECT event_id, event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d') END AS v FROM events WHERE event_type IN ('click', 'view'))
SELECT event_type AS entity, count(v) AS emitted, count(*) - count(v) AS rejected FROM e GROUP BY event_type""")
def row_blocs(spark, d):
    long = P.facts(_events(spark, d), EVENTS, SRC).where("selected")
    return long.groupBy("entity").agg(F.count_if(F.col("stage").isNull()).alias("emitted"), F.count_if(F.col("stage").isNotNull()).alias("rejected"))


@query("""WITH r AS (SELECT 'not a real date' AS reason, 'c2' AS col, 'normalize' AS stage FROM events WHERE event_type IN ('click', 'view') AND event_id % 7 = 0), g AS (SELECT reason, col, stage, count(*) AS n, grouping(reason, col, stage) AS l FROM r GROUP BY GROUPING SETS ((), (reason), (col), (stage)))
SELECT CASE l WHEN 7 THEN 'total' WHEN 3 THEN 'reason' WHEN 5 THEN 'column' ELSE 'stage' END AS "by", coalesce(reason, col, stage) AS value, n FROM g""")
def reject_tally(spark, d):
    return L.reject_tally(P.rejects(P.facts(_events(spark, d), EVENTS, SRC)))


@query("""SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents WHERE text IS NOT NULL) WHERE r = 1""")
def first_wins(spark, d):
    df = table(spark, d, "documents").where("text IS NOT NULL").select("text", "doc_id", "source")
    return P.first_wins(df, ["doc_id"], by="text").select("doc_id", "source")


# -- planning, review and scoring over tables ------------------------------------------------
@query("""SELECT source_id, column_id, prop FROM (SELECT *, row_number() OVER (PARTITION BY source_id, column_id ORDER BY decided_at DESC, decision_id DESC) AS r FROM decisions WHERE verdict <> 'unmapped') WHERE r = 1 AND verdict <> 'declined'""")
def override_log(spark, d):
    df = table(spark, d, "decisions")
    seq = F.struct("decided_at", "decision_id")
    action = F.when(F.col("verdict") == "declined", "clear").when(F.col("verdict") == "unmapped", "note").otherwise("bind")
    ev = df.select("source_id", seq.alias("seq"), action.alias("action"), F.col("column_id").alias("column"), F.lit(None).cast("string").alias("entity"), "prop", F.col("decided_by").alias("actor"))
    return RV.overrides(ev).select("source_id", F.col("column").alias("column_id"), "prop")


@query("""SELECT source_id, count(*) FILTER (WHERE verdict = 'accepted') AS revision FROM decisions GROUP BY source_id""")
def override_revisions(spark, d):
    ev = table(spark, d, "decisions").select("source_id", F.when(F.col("verdict") == "accepted", "bind").otherwise("note").alias("action"))
    return RV.override_revision(ev)


# -- layout and planning over the registers --------------------------------------------------
def _register(spark: SparkSession, d: str) -> tuple[DataFrame, list[dict]]:
    """All rows of the registers as one frame; they share one layout, whose headers the first source has."""
    rows = table(spark, d, "frame_rows")
    heads = table(spark, d, "sources").where(F.size("column_headers") == 14).agg(F.min_by("column_headers", "source_id").alias("h")).first()["h"]
    frame = rows.select(F.col("row_id").cast("long").alias("_row"), *[f"c{k}" for k in range(14)])
    return frame, [{"id": f"c{k}", "index": k, "header": h, "label": None, "group": None} for k, h in enumerate(heads)]


@query()
def planned_bindings(spark, d):
    """The statistical plan of the registers after all rules."""
    frame, columns = _register(spark, d)
    facts = FA.profile_frame(frame, columns)
    plan = V.validate(V.propose(frame, facts), V.Context(frame, facts))
    rows = [(b.column, b.prop, b.entity, b.type_name, b.why) for b in plan.bindings]
    return spark.createDataFrame(rows, "column string, prop string, entity string, type_name string, why string")


@query()
def candidate_ranking(spark, d):
    """The best five properties of every column of every source, by header."""
    onto, rows = default(), []
    for r in table(spark, d, "sources").select("source_id", "column_headers").collect():  # a row per source
        for k, h in enumerate(r["column_headers"]):
            for place, c in enumerate(SH.shortlist(FA.ColumnFacts(f"c{k}", k, h), onto, ["Person", "Organization", "Company", "Address", "Debt"], 5), 1):
                rows.append((r["source_id"], c.column, place, c.qname, round(c.score, 6)))
    return spark.createDataFrame(rows, "source_id string, column string, place int, qname string, score double")


@query()
def register_accounting(spark, d):
    """The registers planned, executed and accounted for, end to end."""
    frame, columns = _register(spark, d)
    facts = FA.profile_frame(frame, columns)
    plan = V.validate(V.propose(frame, facts), V.Context(frame, facts))
    rows = P.normalised(frame, plan)
    long = P.facts(rows, plan, SRC)
    return L.totals(L.coverage(frame, rows, plan), L.claim_ledger(rows, long, plan))
