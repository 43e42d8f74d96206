"""Records, instants, profiles and packed cells: defined results for odd input, and brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tabloom.functions import canonical as C
from tabloom.functions import text as X
from tabloom.operators import instants as T
from tabloom.operators import packed as K
from tabloom.operators import profile as P
from tabloom.operators import records as R

TYPES = ["identifier", "name", "date", "number", "gender", "email"]


def reasons(*texts, sep=";", types=TYPES):
    g = R.RecordGrammar(sep, types)
    return [g.row(t).reason for t in texts]


def test_records_by_the_first_reason():
    good = "12345678;Іван;01.02.2000;-1,5;Ч;a@b.c"
    assert reasons(good, f"{good}\r\n", ' 12345678 ; "Іван" ;2000-02-01;7;f;-', "12345678;\"А;\"\"Б\"\" \n В\";n/a;NULL;;Не вказано") == [None] * 4
    assert reasons("12345678;\"Іван;1", "12345678;\"Іван\"x;1", '"1234"5678"') == ["quoting"] * 3
    assert reasons(None, "", "   ", "\n", "12345678;Іван", good + ";") == ["columns"] * 6
    assert reasons(*(good.replace(a, b) for a, b in (("12345678", "1234567"), ("12345678", "-"), ("Іван", "***"), ("Іван", "-"), ("01.02", "31.02"), ("-1,5", "1,5,0"), ("-1,5", "+1"), ("Ч", "х"), ("a@b.c", "a@b"), ("a@b.c", "a b@c.d")))) == ["value"] * 10
    assert R.RecordGrammar(";", TYPES).row('12345678;І"ва"н;01.02.2000;1;m;a@b.c').reason is None
    assert reasons("12345678\tІван\t", sep="\t", types=["identifier", "name", "date"]) == [None]


def test_a_broken_quote_costs_one_record():
    g = R.RecordGrammar(";", ["identifier", "name"])
    text = "\n".join(f"{i:08d};Ім'я {i}" for i in range(200))
    broken = text.replace("Ім'я 50", '"Ім\'я 50').replace("Ім'я 120", '"Ім" я')
    got = list(g.blob(broken))
    assert sum(r.reason is None for r in got) == 198 and [r.reason for r in got if r.reason] == ["quoting", "quoting"]
    assert all(broken[r.start : r.start + 8].isdigit() for r in got) and list(g.blob("")) == list(g.blob(None)) == []


def test_a_stream_with_known_starts_gives_what_its_rows_give(spark):
    rng, g = random.Random(5), R.RecordGrammar(";", ["identifier", "name"])
    for _ in range(300):
        texts = ["".join(rng.choice('";\n 1а') for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 6))]
        starts = [sum(len(t) + 1 for t in texts[:k]) for k in range(len(texts))]
        got = {r.start: r for r in g.blob("\n".join(texts), starts)}
        for at, text in zip(starts, texts, strict=True):
            own = g.row(text)
            assert (got[at].reason, got[at].values, got[at].error_field) == (own.reason, own.values, own.error_field), texts
    text = '12345678;"broken\n87654321;Оля\n12;Іра\n11111111;"Ян"'
    df = spark.createDataFrame([(1, text), (2, "22222222;Ева"), (3, None)], "id long, t string")
    got = R.parse_records(df, "t", F.lit(";"), F.array(F.lit("identifier"), F.lit("name")), ["id"]).collect()
    assert [(r["id"], r["part_no"], r["reason"], r["typed"]) for r in got] == [
        (1, 0, "quoting", None), (1, 1, None, ["87654321", "Оля"]), (1, 2, "value", None), (1, 3, None, ["11111111", "Ян"]), (2, 0, None, ["22222222", "Ева"]), (3, 0, "columns", None),
    ]


def test_closing_quotes_are_where_the_grammar_finds_them():
    import re

    rng, quoted = random.Random(6), re.compile(r'"((?:[^"]|"")*+)"')
    for _ in range(500):
        text = "".join(rng.choice('""a\n') for _ in range(rng.randint(1, 12)))
        marks = R._Quotes(text)
        for at, ch in enumerate(text):
            if ch == '"':
                m = quoted.match(text, at)
                assert marks.closing(at) == (m.end() - 1 if m else None), (text, at)


def test_recovery_scans_no_text_twice():
    import time

    g = R.RecordGrammar(";", ["identifier", "name"])
    text = '12345678;"a\n' + '"x;y\n' * 40_000 + "87654321;Оля"
    began = time.time()
    got = list(g.blob(text))
    assert time.time() - began < 20 and got[-1].values == ["87654321", "Оля"]


def test_parsing_tables_keeps_clashing_columns_and_unknown_sources(spark):
    df = spark.createDataFrame([(1, "12345678;Іван", "s", "x"), (2, None, "s", None), (3, "a", "t", "y")], "record_id long, raw_text string, source_id string, reason_ string")
    sources = spark.createDataFrame([("s", ";", ["identifier", "name"])], "source_id string, field_sep string, column_types array<string>")
    joined = R.with_source_grammar(df, sources)
    got = R.parse_records(joined, "raw_text", F.col("__field_sep"), F.col("__column_types"), ["record_id", "reason_"]).orderBy("record_id").collect()
    assert [(r["record_id"], r["ok"], r["reason"]) for r in got] == [(1, True, None), (2, False, "columns"), (3, False, "source")]
    assert R.parse_records(joined.limit(0), "raw_text", F.col("__field_sep"), F.col("__column_types"), ["record_id"]).count() == 0
    long = "12345678;" + "я" * 200_000
    assert R.RecordGrammar(";", ["identifier", "name"]).row(long).reason is None


def test_every_written_form():
    kyiv = "Europe/Kyiv"
    cases = {
        "18.06.2008": "2008-06-18", " 22-08-2004 ": "2004-08-22", "09/27/1970": "1970-09-27", "1/4/1970": "1970-04-01", "27.12.66": "1966-12-27", "01.02.29": "2029-02-01", "25-May-1939": "1939-05-25",
        "2013-01-16": "2013-01-16", "23 листопада 1962 р.": "1962-11-23", "8 січня 1970 року": "1970-01-08", "24 травня 2008, 22:14": "2008-05-24T19:14:00Z", "04.02.2010 00:15": "2010-02-03T22:15:00Z",
        "2017-12-24 09:50 CET": "2017-12-24T08:50:00Z", "Sat, 25 Aug 2012 19:54:28 -0500": "2012-08-26T00:54:28Z", "05/03/2021 07:03 PM": "2021-03-05T17:03:00Z", "05/03/2021 12:03 AM": "2021-03-04T22:03:00Z",
        "2014-09-11T15:59:11.999+05:45": "2014-09-11T10:14:11Z", "2023-03-18T01:23:32[Europe/Lisbon]": "2023-03-18T01:23:32Z", "2009-12-12T15:49Z": "2009-12-12T15:49:00Z", "2020-01-01T00:00:00-03": "2020-01-01T03:00:00Z",
    }
    for text, want in cases.items():
        assert T.canonical_instant(text, kyiv) == (want, None), text
    for text in ("", None, "n/a", "31.02.2000", "1939-00-10", "10:30", "t=01:55", "2020-01-01T25:00:00Z", "2020-01-01T10:61:00Z", "2020-01-01T10:00:00+14:30", "28.03.2021 03:30", "2021-10-31 03:30", "2020-01-01 10:00 XYZ", "1995 or so", "0000-00-00"):
        assert T.canonical_instant(text, kyiv)[0] is None, text
    assert T.canonical_instant("2020-01-01 10:00", None)[0] is None and T.canonical_instant("2020-01-01 10:00", "No/Where")[0] is None


def test_bare_numbers_need_their_column(spark):
    assert [T.canonical_instant(x, None, True, False)[0] for x in ("1997", "1849", "29481", "80001", "123")] == ["1997", None, "1980-09-17", None, None]
    assert [T.canonical_instant(x, None, False, True)[0] for x in ("1723125723", "1405546685735", "1997")] == ["2024-08-08T14:02:03Z", "2014-07-16T21:38:05Z", None]
    rows = [("a", "c", str(1900 + i)) for i in range(95)] + [("a", "c", "7")] * 5 + [("b", "c", "1990")] * 9 + [("b", "c", "7")] + [("d", "c", None)]
    df = spark.createDataFrame(rows, "s string, c string, v string")
    got = {r["s"]: (r["days_kind"], r["unix_kind"]) for r in T.numeric_kinds(df, "v", ["s", "c"]).collect()}
    assert got == {"a": (True, False), "b": (False, False), "d": (False, False)}


def test_day_arithmetic_agrees_with_the_calendar():
    rng = random.Random(3)
    for _ in range(3000):
        day = dt.date.fromordinal(rng.randint(1, 3_652_059))
        n = T.days_from_civil(day.year, day.month, day.day)
        assert n == day.toordinal() - 719163 and T.civil_from_days(n) == (day.year, day.month, day.day)


def test_values_are_taken_apart_outside_quotes():
    t = {k: K.Tokenizer(r) for k, r in K.RULES.items()}
    assert t["phone"].values('"(05485) 7-92-57","067 1 2"\n+7 99 ; ; 8/9|') == ["(05485) 7-92-57", "067 1 2", "+7 99", "8", "9"]
    assert t["email"].values("a@b.c  d@e.f, ,g@h.i / a@b.c") == ["a@b.c", "d@e.f", "g@h.i", "a@b.c"]
    assert t["identifier"].values("AB 1234; BK-1/22|5") == ["AB 1234", "BK-1/22", "5"]
    assert t["name"].values('"ТОВ А; філія 2"; КП Б / В, Г') == ["ТОВ А; філія 2", "КП Б / В, Г"]
    assert t["name"].values('КП "А; Б" ; В') == ['КП "А; Б"', "В"] and t["name"].values('А "; Б') == ['А "', "Б"]
    assert t["json_list"].values("[1,2], (a, b), c\\,d") == ["[1,2]", "(a, b)", "c\\,d"]
    assert t["name"].values(None) == t["name"].values(" ;; ") == t["name"].values('""') == []


def test_packed_tables_keep_order_and_repeats(spark):
    df = spark.createDataFrame([(1, "a;b;a", "name"), (2, None, "name"), (3, "x", "name"), (4, "p;q", None), (5, ";".join("v" * 1 for _ in range(5000)), "name")], "row_id long, cell string, kind string")
    got = K.split_packed(df, "cell", "kind", ["row_id"], least=2)
    assert [(r["part_no"], r["part_text"]) for r in got.where("row_id = 1").orderBy("part_no").collect()] == [(1, "a"), (2, "b"), (3, "a")]
    assert got.groupBy("row_id").count().orderBy("row_id").collect() == [(1, 3), (5, 5000)]
    assert K.split_packed(df, "cell", "kind", ["row_id"]).where("row_id IN (3, 4)").count() == 2
    assert K.split_packed(df.limit(0), "cell", "kind", ["row_id"]).count() == 0


def loads(spark, n=6, rows=60):
    rng, out = random.Random(5), []
    for load in range(n):
        for i in range(rows):
            odd = load == 3
            out.append(("s", load, f"{rng.randint(1, 28):02d}.0{rng.randint(1, 9)}.19{rng.randint(40, 99)}", None if odd and i % 2 else f"{10 + i % 40}.50", "x" if odd else f"v{i}", None))
    return spark.createDataFrame(out, "source_id string, load_no int, c0 string, c1 string, c2 string, c3 string")


def test_profiles_equal_brute_force_and_odd_loads_stand_out(spark):
    df = loads(spark)
    counts = P.value_counts(df, ["source_id", "load_no"], ["c0", "c1", "c2", "c3"])
    got = {(r["load_no"], r["column_id"]): r for r in P.profiles(counts, ["source_id", "load_no"]).collect()}
    for (load, c), r in got.items():
        values = [x[c] for x in df.where(F.col("load_no") == load).collect()]
        filled = [v for v in values if v]
        assert (r["row_count"], r["filled"], r["distinct_values"]) == (len(values), len(filled), len(set(filled)))
        if filled:
            assert r["modal_share"] == pytest.approx(max(map(filled.count, filled)) / len(filled))
        else:
            assert r["modal_share"] is None and r["fill_rate"] == 0.0
    off = P.departures(P.profiles(counts, ["source_id", "load_no"]), ["source_id"]).where("departs").collect()
    assert {(r["load_no"], r["column_id"]) for r in off} == {(3, "c1"), (3, "c2")}
    assert P.profiles(P.value_counts(df.limit(0), ["source_id", "load_no"], ["c0"]), ["source_id", "load_no"]).count() == 0


def test_signed_deltas_keep_the_counts(spark, tmp_path):
    df = loads(spark)
    store = P.ValueCountStore(spark, str(tmp_path / "counts"))
    assert store.read() is None
    for load in range(4):
        store.apply(P.value_counts(df.where(F.col("load_no") == load), ["source_id"], ["c0", "c1"]))
    store.apply(P.value_counts(df.where("load_no = 1"), ["source_id"], ["c0", "c1"], sign=-1))
    want = P.value_counts(df.where("load_no IN (0, 2, 3)"), ["source_id"], ["c0", "c1"])
    key = lambda d: sorted((r["column_id"], r["value"] or "", r["n"]) for r in d.collect())
    assert len(store.segments()) == 5 and key(store.read()) == key(want)
    store.compact()
    assert len(store.segments()) == 1 and key(store.read()) == key(want)


def test_a_delta_refreshes_what_it_touches(spark, tmp_path):
    rows = [(s, load, f"{s}{i % 7}", None if i % 3 else "x") for s in "ab" for load in range(3) for i in range(20 + load)]
    df = spark.createDataFrame(rows, "source_id string, load_no int, c0 string, c1 string")
    by, cols = ["source_id", "load_no"], ["c0", "c1"]
    store = P.ValueCountStore(spark, str(tmp_path / "counts"))
    store.apply(P.value_counts(df.where("load_no < 2"), by, cols))
    before = P.profiles(store.read(), by)
    store.apply(P.value_counts(df.where("load_no = 2"), by, cols))
    store.apply(P.value_counts(df.where("load_no = 0"), by, cols, sign=-1))
    got = P.refreshed(before, store, df.where("load_no <> 1").select(*by).distinct()).collect()
    want = P.profiles(P.value_counts(df.where("load_no > 0"), by, cols), by).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 8


def test_a_large_catalogue_of_shapes_gives_the_same_shares(spark):
    df = spark.createDataFrame([("s", v) for v in ("AB-12", "CD-3456", "абв", "A" * 12, "12", None)], "source_id string, c0 string")
    usual = spark.createDataFrame([("s", "c0", "LL-dd")], "source_id string, column_id string, usual_shape string")
    counts = P.value_counts(df, ["source_id"], ["c0"])
    got = [P.profiles(counts, ["source_id"], usual, branches=b).select("shape_share", "outline_share").first() for b in (1000, 0)]
    assert got[0] == got[1] == (0.2, 0.4)


def test_shapes_and_their_patterns(spark):
    values = ["Іваненко Іван", "AB-12345678901", "", "ß١", "a.b", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r["s"] for r in df.select(X.shape("v").alias("s")).collect()]
    assert got == ["CCCCCCCC CCCC", "LL-d+", "", "Ld", "L.L", None]
    for v, s in zip(values, got, strict=True):
        if v:
            one = spark.createDataFrame([(v,)], "v string")
            assert one.where(F.col("v").rlike(P.shape_pattern(s, runs=False))).count() == 1


def test_canonical_values_by_type(spark):
    cases = [("date", "17.09.1980", "1980-09-17"), ("date", "2020-01-01T23:30:00+02:00", "2020-01-01T21:30:00"), ("date", "30.02.2000", None), ("phone", "тел.: 067-123-45-67", "+380671234567"), ("phone", "(044) 234-56-78; 234-56-79", "+380442345678;+380442345679"),
             ("identifier", "AB 123456", "AB123456"), ("identifier", "вул. Садова", None), ("country", "Польща; UA", "pl;ua"), ("email", "A@B.Com", "A@b.com"), ("url", "https://a.b", "https://a.b/"), ("gender", "Ч.", "male"), ("name", " А  Б ", "А Б"), ("date", "1.1.2000|zz", "2000-01-01")]
    for kind, text, want in cases:
        got = spark.createDataFrame([(text,)], "v string").select(C.canonical(F.col("v"), kind).alias("r")).first()["r"]
        assert got["value"] == want and got["ok"] == (want is not None), (kind, text)
    C.register("shout", lambda v: F.struct(F.upper(v).alias("value"), F.lit(None).cast("string").alias("reason")))
    assert spark.createDataFrame([("a",)], "v string").select(C.canonical(F.col("v"), "shout")["value"].alias("x")).first()["x"] == "A"


def test_the_filter_of_packed_cells_drops_none_that_splits(spark):
    from tabloom.operators import packed

    rows = [(name, f"ann{sep}bob{sep}2") for name, rule in packed.RULES.items() for sep in rule.separators]
    rows += [("email", "ann@mail.test bob@mail.test"), ("email", "x20@mail.test"), ("name", "ann bob, cy"), ("other", "a;b")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, t string, c string")
    want = set()
    for i, (t, c) in enumerate(rows):
        parts = packed.Tokenizer(packed.RULES.get(t, packed.PackRule(""))).values(c)
        want |= {(i, k, p) for k, p in enumerate(parts, 1)} if len(parts) > 1 else set()
    got = {tuple(r) for r in packed.split_packed(df, "c", "t", ["id"], least=2).collect()}
    assert got == want and len({i for i, _, _ in got}) == sum(len(r.separators) for r in packed.RULES.values()) + 1
