import json
import os

import pytest

from tabloom import cli
from tabloom.operators import review as R
from tabloom.operators import scoring as Z
from tabloom.pipeline import run_path, summary_table
from tabloom.plans import compile as P
from tabloom.plans.model import Binding, Entity, Plan
from tabloom.sources.store import Locked, Workspace, failure_code
from tabloom.streaming import arrivals


def test_a_file_becomes_a_committed_graph(spark, tmp_path):
    names = ["Довгопалий Нестор Юхимович", "Заквітна Мотря Гордіївна", "Тихолоз Килина Панасівна"]
    lines = ["ПІБ;Дата народження;Електронна пошта"] + [f"{names[i % 3]};0{1 + i}.03.196{i};p{i}@mail.test" for i in range(9)]
    (tmp_path / "in.csv").write_text("\n".join(lines))
    w = Workspace(tmp_path / "work")
    got = run_path(spark, str(tmp_path / "in.csv"), w)
    assert got[0]["totals"]["accounting_valid"] and sum(got[0]["entities"].values()) >= 3
    assert not any(n.split()[0] in json.dumps(got, ensure_ascii=False) for n in names)
    assert w.publish(spark)["totals"]["accounting_valid"]
    assert w.read(spark, "statements").count() > 9 and w.manifest()["aggregate"]
    assert summary_table(spark, got).where("source IS NULL").count() == 1
    assert w.retain() == []


def test_one_writer_at_a_time_and_dead_locks_go(tmp_path):
    w = Workspace(tmp_path)
    with w.lock(), pytest.raises(Locked), w.lock():
        pass
    (tmp_path / ".lock").write_text(json.dumps({"host": os.uname().nodename, "pid": 2**22 + 1}))
    with w.lock():
        pass
    with pytest.raises(ValueError):
        Workspace(tmp_path / "a#b")


def test_failures_have_codes_without_values():
    try:
        int("secret")
    except ValueError as e:
        assert len(failure_code(e)) == 12 and "secret" not in failure_code(e)


def events(spark, rows):
    return spark.createDataFrame([(s, n, a, c, e, p, g, v, "x", None) for s, n, a, c, e, p, g, v in rows], R.SCHEMA)


def test_the_last_word_counts_and_approval_goes_stale(spark):
    log = events(spark, [("s", 1, "bind", "c0", "p", "Person:name", 1, 0), ("s", 2, "bind", "c0", "p", "Person:alias", 1, 0), ("s", 3, "bind", "c1", "p", "Person:email", 1, 0), ("s", 4, "clear", "c1", None, None, 1, 0), ("s", 5, "approve", None, None, None, 1, 4), ("t", 1, "approve", None, None, None, 1, 0), ("t", 2, "reopen", None, None, None, 1, 0)])
    assert [(r["column"], r["prop"]) for r in R.overrides(log).collect()] == [("c0", "Person:alias")]
    now = spark.createDataFrame([("s", 1), ("t", 1), ("u", 1)], "source_id string, generation long")
    assert {r["source_id"]: r["state"] for r in R.review_state(log, now).collect()} == {"s": "approved", "t": "pending", "u": "pending"}
    later = spark.createDataFrame([("s", 2)], "source_id string, generation long")
    assert R.review_state(log, later).first()["state"] == "stale"
    R.check_approval(4, log, "s")
    with pytest.raises(R.ApprovalRefused):
        R.check_approval(3, log, "s")


def test_verdicts_and_their_denominators(spark):
    gold = spark.createDataFrame([("s", "c0", "Person:name", ["Person:alias"]), ("s", "c1", "Person:email", []), ("s", "c2", None, []), ("s", "c3", "Person:phone", []), ("s", "c4", "Person:idNumber", [])], "source_id string, column string, prop string, accepted array<string>")
    bound = spark.createDataFrame([("s", "c0", "Person:alias"), ("s", "c1", "Person:email"), ("s", "c1", "Person:name"), ("s", "c2", "Person:notes"), ("s", "c3", "Person:email")], "source_id string, column string, prop string")
    keys = spark.createDataFrame([("s", "c4")], "source_id string, column string")
    got = Z.column_verdicts(gold, bound, keys)
    assert {r["column"]: r["verdict"] for r in got.collect()} == {"c0": "BOTH-DEFENSIBLE", "c1": "AGREE", "c2": "STRETCHED", "c3": "PIPELINE-WRONG", "c4": "KEY-ONLY"}
    assert Z.verdict_totals(got).first()["agree_share"] == 0.4
    assert Z.verdict_totals(got.limit(0)).first()["agree_share"] is None
    assert Z.compare_arms(got, got).where("verdict_a IS NULL AND verdict_b IS NULL").first()["columns"] == 5


def test_entities_are_paired_greedily_and_edges_in_two_passes():
    E = Z.GoldEntity
    got = Z.entity_verdicts([E("a", "Person", ["c0"], 100), E("b", "Company", ["c1"])], [E("x", "LegalEntity", ["c1"]), E("y", "Person", ["c0"], 104)])
    assert [(g["run"], g["verdict"]) for g in got] == [("y", "ENTITY-AGREE"), ("x", "ENTITY-GENERALISED")] and got[0]["instances"]
    edges = Z.edge_verdicts([("Ownership", "a", "b"), ("Debt", "a", "b")], [("Ownership", "y", "x"), ("Debt", "x", "y"), ("Family", "x", "y")], {"a": "y", "b": "x"})
    assert [e["verdict"] for e in edges] == ["EDGE-AGREE", "EDGE-ENDS-DIFFER", "EDGE-EXTRA"]
    assert Z.validate_gold({"source": {}, "answer": {"entities": [{"key": "a", "schema": "Nope"}]}}) == ["no schema Nope"]
    assert Z.subject_verdict("Person", ["LegalEntity"], "LegalEntity") == "SUBJECT-ACCEPTABLE"


def test_statements_stream_once(spark, tmp_path):
    plan = Plan("Person", [Entity("p", "Person", ["c0"])], [], [Binding("c0", "Person:name", "p", "name")])
    rows = spark.createDataFrame([(1, "Іван", "2024-01-01 00:00:00"), (1, "Іван", "2024-01-01 00:00:00"), (2, "Ольга", "2024-01-02 00:00:00")], "_row int, c0 string, at string")
    rows.selectExpr("_row", "c0", "cast(at as timestamp) at").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("_row int, c0 string, at timestamp").parquet(str(tmp_path / "in"))
    q = arrivals.write_batches(arrivals.statement_stream(stream, plan, P.Source("s/"), "at", ["_row"]), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted(r["value"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["Іван", "Ольга"]


def test_the_command_line(capsys, tmp_path):
    assert cli.main(["version"]) == 0 and capsys.readouterr().out.strip()
    (tmp_path / "g.json").write_text("{}")
    assert cli.main(["gold", str(tmp_path / "g.json")]) == 3
