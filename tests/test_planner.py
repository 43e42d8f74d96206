from tabloom.operators import layout as L
from tabloom.plans import compile as P
from tabloom.plans import roles as R
from tabloom.plans import shortlist as H
from tabloom.plans import validate as V
from tabloom.plans.facts import profile_frame
from tabloom.plans.model import Binding, Entity, Plan, Selection
from tabloom.plans.ontology import default

ONTO = default()


def built(spark, rows):
    grid = spark.createDataFrame([(i, [None if c is None else str(c) for c in r]) for i, r in enumerate(rows)], "_row int, cells array<string>")
    f = L.build_frame(grid)
    return f, profile_frame(f.rows, f.columns)


def people(n=12):
    names = ["Довгопалий Нестор Юхимович", "Заквітна Мотря Гордіївна", "Тихолоз Килина Панасівна", "Верболіз Овсій Хомич"]
    rows = [["ПІБ", "Дата народження", "Електронна пошта", "Примітка"]]
    for i in range(n):
        rows.append([f"{names[i % 4]}", f"{1 + i:02d}.03.19{60 + i}", f"p{i}@mail.test", "" if i % 3 else "так"])
    return rows


def test_ontology_closure_and_specialisation(spark):
    assert ONTO.is_a("Company", "LegalEntity") and ONTO.is_a("Company", "Asset") and not ONTO.is_a("Person", "Organization")
    assert ONTO.prop("Person:email").type == "email" and ONTO.prop("Person:nothing") is None
    assert ONTO.specialise("Person", "LegalEntity") == "Person" and ONTO.specialise("Note", "LegalEntity") is None
    assert ONTO.closure_table(spark).where("child = 'Vessel'").count() == len(ONTO.ancestors("Vessel"))
    assert ("Ownership" in {e.schema for e, _, _ in ONTO.valid_edges(["Person", "Vessel"])})
    assert ONTO.prop_table(spark).where("qname = 'Vessel:flag'").first()["type"] == "country"


def test_header_similarity_units_and_roles():
    assert H.token_set_ratio("дата народження", "народження дата") == 1.0 and H.token_set_ratio("", "x") == 0.0
    assert H.declared_unit("Довжина, м") == "length" and H.contradicts("Довжина, м", "amount") and not H.contradicts("Сума, грн", "amount")
    assert H.is_machinery("Unnamed: 3") and not H.is_machinery("Назва")
    assert [r.relation for r in R.roles_in("Власник / перевізник")] == ["Ownership", "Vehicle:operator"]
    assert R.nearest_in_range(3, [("a", 2), ("b", 4)]) is None and R.nearest_in_range(3, [("a", 1), ("b", 4)]) == "b"
    assert H.label_of({"Thing:name": "Назва"}, ONTO, "Person:name") == "Назва"


def test_facts_hold_detectors_samples_and_shapes(spark):
    _, facts = built(spark, people())
    by = {c.header: c for c in facts}
    assert by["Дата народження"].rate("date") == 1.0 and by["Електронна пошта"].rate("email") == 1.0
    assert by["ПІБ"].rate("proper_name") == 1.0 and len(by["Дата народження"].samples) == 5
    assert by["Примітка"].fill_rate == 4 / 12 and by["Дата народження"].shapes[0][0] == "dd.dd.dddd"


def test_a_proposed_plan_runs(spark):
    f, facts = built(spark, people())
    plan = V.validate(V.propose(f.rows, facts), V.Context(f.rows, facts))
    props = {b.prop for b in plan.bindings}
    assert plan.subject == "Person" and {"Person:birthDate", "Person:email"} <= props
    src = P.Source("s/")
    norm = P.normalised(f.rows, plan)
    assert P.statements(P.facts(norm, plan, src), plan, src).count() >= 36


def test_bindings_are_checked_against_values(spark):
    f, facts = built(spark, people())
    plan = Plan("Person", [Entity("p", "Person", ["c2"])], [], [Binding("c0", "Person:birthDate", "p", "date"), Binding("c1", "Person:birthDate", "p", "date"), Binding("c2", "Person:nothing", "p", "email"), Binding("c3", "Person:notes", "p", "text")])
    got = V.validate(plan, V.Context(f.rows, facts), refinement="none")
    assert [(b.column, b.prop) for b in got.bindings] == [("c1", "Person:birthDate"), ("c3", "Person:notes")]
    assert {d.column for d in got.decisions if d.verdict == "rejected"} == {"c0", "c2"}


def test_parties_and_relations_come_from_headers(spark):
    rows = [["Назва судна", "Власник", "Директор"]] + [[f"Судно Альфа-{i}", f"ТОВ Чебрець {'АБВГД'[i % 5]}{'їжа'[i % 3]}", "Гарбузняк Лука Юхимович" if i % 2 else "Заквітна Мотря Гордіївна"] for i in range(10)]
    f, facts = built(spark, rows)
    plan = Plan("Vessel", [Entity("vessel", "Vessel", ["c0"])], [], [Binding("c0", "Vessel:name", "vessel", "name")])
    got = V.validate(plan, V.Context(f.rows, facts))
    assert ("Ownership", "власник", "vessel") in {(r.schema, r.source, r.target) for r in got.edges}
    assert any(b.entity == "директор" for b in got.bindings) or any(e.schema == "Person" for e in got.entities)


def test_filters_kinds_and_overrides(spark):
    rows = [["name", "kind"]] + [[f"Назва {i} слово", "Person" if i % 2 else "Vessel"] for i in range(10)]
    f, facts = built(spark, rows)
    ctx = V.Context(f.rows, facts)
    plan = V.propose(f.rows, facts)
    assert {(e.schema, e.filter.value) for e in plan.entities} == {("Person", "Person"), ("Vessel", "Vessel")}
    bad = Plan("Person", [Entity("p", "Person", ["c0"], Selection("c1", "none")), Entity("v", "Vessel", ["c0"], Selection("c1", "Vessel"))], [], [Binding("c0", "Vessel:name", "v", "name")])
    got = V.validate(bad, ctx, refinement="none", overrides={"c0": {"action": "bind", "entity": "v", "prop": "Vessel:alias"}})
    assert [e.key for e in got.entities] == ["v"] and [b.prop for b in got.bindings] == ["Vessel:alias"]


def test_samples_equal_the_plain_definition(spark):
    import random
    from collections import Counter

    from tabloom.operators import statistics as S

    rng = random.Random(9)
    counts = Counter("".join(rng.choice("ab1") for _ in range(rng.randint(1, 5))) for _ in range(400))
    df = spark.createDataFrame([("c0", v, n) for v, n in counts.items()] + [("c0", None, 7)], "column_id string, value string, n long")
    shape = {v: "".join("d" if c == "1" else "L" for c in v) for v in counts}
    of_shape = Counter()
    for v, n in counts.items():
        of_shape[shape[v]] += n
    rows = [v for v in sorted(counts, key=lambda v: (len(v), v)) for _ in range(counts[v])]
    chosen = []
    for k in range(5):
        part = Counter(rows[k * len(rows) // 5 : (k + 1) * len(rows) // 5])
        free = [v for v in part if v not in chosen]
        if free:
            chosen.append(min(free, key=lambda v: (-part[v], -of_shape[shape[v]], v)))
    assert S.samples(df).first()["samples"] == chosen


def facts_of(**columns):
    from tabloom.plans.facts import ColumnFacts

    return [ColumnFacts(cid, k, **f) for k, (cid, f) in enumerate(columns.items())]


def test_roles_groups_and_contradictions_need_no_data():
    cols = facts_of(c0={"header": "agent_name", "distinct_ratio": 0.5, "fill_rate": 1.0}, c1={"header": "agent_code", "distinct_ratio": 1.0, "fill_rate": 1.0}, c2={"header": "owner"})
    by, ctx = {c.id: c for c in cols}, V.Context(None, cols)
    a, b, c = Entity("a", "Person", ["c0"]), Entity("b", "Person", ["c1"]), Entity("c", "Person", ["c2"])
    assert R.role_keyed(c, by) and not R.role_keyed(a, by)
    groups = R.prefix_groups(cols)
    assert R.share_prefix_group(groups, a, b, by) and not R.share_prefix_group(groups, a, c, by)
    plan = Plan("Person", [a, b, c], [], [Binding("c0", "Person:name", "a", "name")])
    V.merge_group_twins(plan, ctx)
    assert [e.key for e in plan.entities] == ["b", "c"] and plan.bindings[0].entity == "b"
    odd = Plan("Vessel", [Entity("p", "Person", ["c0"])], [], [Binding("c0", "Person:name", "p", "name")])
    V.resolve_subject_contradiction(odd, ctx)
    assert [(e.key, e.schema) for e in odd.entities] == [("p", "Person"), ("vessel", "Vessel")] and odd.bindings[1].prop == "Vessel:name"
    same = Plan("LegalEntity", [Entity("p", "Person", ["c0"])])
    V.resolve_subject_contradiction(same, ctx)
    assert len(same.entities) == 1


def test_refused_keys_come_back_where_nothing_is_better(spark):
    cols = facts_of(c0={"header": "code", "fill_rate": 0.5, "distinct_ratio": 1.0}, c1={"header": "name", "fill_rate": 0.6, "distinct_ratio": 0.9})
    frame = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, None, "z")], "_row long, c0 string, c1 string")
    ctx = V.Context(frame, cols)
    plan = Plan("Vessel", [Entity("v", "Vessel", ["c0"])], [], [Binding("c0", "Vessel:imoNumber", "v", "identifier")])
    V.floor_keys(plan, ctx)
    assert plan.entities[0].keys == ["c0"] and plan.decisions[-1].verdict == "accepted"
    plan = Plan("Vessel", [Entity("v", "Vessel", ["c0"])], [], [Binding("c1", "Vessel:name", "v", "name")])
    V.floor_keys(plan, ctx)
    assert plan.entities[0].keys == ["c0"]
    plan = Plan("Vessel", [Entity("v", "Vessel", ["c0"])], [], [])
    V.floor_keys(plan, ctx)
    assert plan.entities[0].keys == []


def test_levels_form_a_tree_and_relative_names_are_told_apart(spark):
    rows = [(i, f"U{i % 2}", f"V{i % 4}", f"S{i % 3}") for i in range(24)]
    frame = spark.createDataFrame(rows, "_row long, c0 string, c1 string, c2 string")
    cols = facts_of(c0={"header": "Управління"}, c1={"header": "Відділ"}, c2={"header": "Сектор"})
    plan = Plan("Organization", [Entity(k, "Organization", [c]) for k, c in (("u", "c0"), ("v", "c1"), ("s", "c2"))], [R_edge("e", "u", "v")])
    V.nest_organisations(plan, V.Context(frame, cols))
    assert {(a.entity, a.target) for a in plan.attachments} == {("v", "u"), ("s", "v")} and plan.edges == []
    assert {e.key: e.keys for e in plan.entities} == {"u": ["c0"], "v": ["c1"], "s": ["c1", "c2"]}


def R_edge(key, a, b):
    from tabloom.plans.model import Relation

    return Relation(key, "Ownership", a, b)


def test_spelled_properties_holders_and_blocs(spark):
    cols = facts_of(c0={"header": "name"}, c1={"header": "Email"}, c2={"header": "owner"})
    ctx = V.Context(None, cols)
    plan = Plan("Vessel", [Entity("p", "Person", ["c0"]), Entity("i", "Identification", ["c1"])], [R_edge("own", "p", "i")], [Binding("c1", "Ownership:recordId", "own", "identifier")])
    V.spelled_property_beats_relation(plan, ctx)
    V.attach_identification_holder(plan, ctx)
    assert (plan.bindings[0].entity, plan.bindings[0].prop) == ("p", "Person:email") and [(a.entity, a.prop, a.target) for a in plan.attachments] == [("i", "holder", "p")]
    two = Plan("Vessel", [Entity("p", "Person", ["c0"]), Entity("q", "Person", ["c0"]), Entity("i", "Identification", ["c1"])])
    V.attach_identification_holder(two, ctx)
    assert not two.attachments and two.decisions[-1].verdict == "declined"
    from tabloom.plans.facts import bloc_profiles

    f = spark.createDataFrame([(1, "a", "x"), (2, "b", None), (3, "b", "y")], "_row long, c0 string, c1 string")
    got = bloc_profiles(f, [{"id": c, "index": k, "header": c, "label": None, "group": None} for k, c in enumerate(("c0", "c1"))], [("c0", "a"), ("c0", "b")])
    assert [got["c0", v][1].fill_rate for v in "ab"] == [1.0, 0.5]


def test_each_column_and_type_is_judged_once_and_by_value(spark, monkeypatch):
    from tabloom.operators import statistics as S

    rows = [(5 * 10**9 + k, f" p{k % 3}@mail.test" if k % 4 else "none@", f"{k % 28 + 1:02d}.03.1960" if k % 5 else None) for k in range(40)] + [(1, "-", "no date")]
    df = spark.createDataFrame(rows, "_row long, c0 string, c1 string")
    pairs = [("c0", "email"), ("c0", "name"), ("c1", "date")]
    few, all_ = ({(r["column"], r["type"]): (r["share"], r["refused"]) for r in S.acceptance(df, pairs, most=m).collect()} for m in (0, 5))
    assert few == all_ and few[("c0", "email")] == (0.75, 10)
    asked, plain = [], S.acceptance
    monkeypatch.setattr(S, "acceptance", lambda frame, pairs, *a, **k: asked.extend(pairs) or plain(frame, pairs, *a, **k))
    f, facts = built(spark, people())
    V.validate(V.propose(f.rows, facts), V.Context(f.rows, facts))
    assert asked and len(asked) == len(set(asked)) and not {t for _, t in asked} & {"name", "string", "text"}


def test_detectors_accept_what_their_plain_definitions_do(spark):
    from pyspark.sql import functions as F

    from tabloom.functions import canonical as C
    from tabloom.functions import detectors as D

    odd = [None, "", "Аб", "А Б", "Аб Вг", "Аб\u0085 Вг", "Аб Вг\u2028", "А\u0085 Вг", "Аб Вг Дд Ее Єє", "Аб  О’Ж-к", "аб Вг", "м....", "чоловіча.", "UA", "ua", "Україна", "uk", "05.11.1967", "2024-1-2", "٣.11.1967", "1967"]
    odd += ["00032129", "3184710691", "7707083893", "112-233-445 95", "11223344595x", "500100732259", "(ТОВ) «Аб»", "Аб ltd.", "ltd", "Аб в тов в"]
    words = lambda v: F.split(v, r"\s+")
    plain = {
        "date": lambda v: C.date(v)["value"].isNotNull(), "gender_code": lambda v: C.gender(v)["value"].isNotNull(), "country": lambda v: C.country(v)["value"].isNotNull(),
        "edrpou": D.edrpou, "rnokpp": D.rnokpp, "inn_ru": D.inn, "snils_ru": D.snils,
        "proper_name": lambda v: (v != "") & ~v.rlike(r"\p{Nd}") & F.size(words(v)).between(2, 4) & F.forall(words(v), lambda w: (F.length(w) >= 2) & w.rlike(r"^\p{Lu}[\p{L}'’ʼ\-]*$")),
    }
    df = spark.createDataFrame([(v,) for v in odd], "v string")
    for name, old in plain.items():
        got = df.select("v", F.coalesce(D.DETECTORS[name](F.col("v")), F.lit(False)).alias("new"), F.coalesce(old(F.col("v")), F.lit(False)).alias("old")).collect()
        assert [r["v"] for r in got if r["new"] != r["old"]] == [], name
