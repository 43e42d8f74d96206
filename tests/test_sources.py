import zipfile

import pytest

from tabloom.operators import layout as L
from tabloom.sources import delimited as S
from tabloom.sources import inventory as I
from tabloom.sources import reader, workbook as W

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def write_book(path, rows, merges=(), extra=None):
    def cell(r, c, v):
        ref = f"{chr(65 + c)}{r + 1}"
        return f'<c r="{ref}"><v>{v}</v></c>' if isinstance(v, (int, float)) else f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'

    body = "".join(f'<row r="{r + 1}">' + "".join(cell(r, c, v) for c, v in enumerate(row) if v is not None) + "</row>" for r, row in enumerate(rows))
    merged = f"<mergeCells>{''.join(f'<mergeCell ref=\"{m}\"/>' for m in merges)}</mergeCells>" if merges else ""
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://x/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {NS}><sheetData>{body}</sheetData>{merged}</worksheet>")
        for name, text in (extra or {}).items():
            z.writestr(name, text)


def test_separator_and_encoding_are_found(spark, tmp_path):
    assert S.sniff_encoding("Ї".encode()) == "utf-8" and S.sniff_encoding("﻿a".encode()) == "utf-8-sig"
    assert S.sniff_encoding("Привіт".encode("cp1251")) == "cp1251"
    assert S.sniff_encoding("ї".encode() * 100001) == "utf-8"
    assert S.sniff_separator("a;b;c\n1,5;2;3\n4;5,5;6\n") == ";" and S.sniff_separator("abc\n") == ","
    assert S.repaired_header([["a,b"], ["1", "2"], ["3", "4"]], ";") == ["a", "b"]
    p = tmp_path / "x.csv"
    p.write_bytes("Назва;Сума\n\"А; \"\"Б\"\"\";1,5\n\n Ґ ;\"два\nрядки\"\n".encode("cp1251"))
    got = [r["cells"] for r in S.read_grid(spark, str(p)).orderBy("_row").collect()]
    assert got == [["Назва", "Сума"], ['А; "Б"', "1,5"], ["Ґ", "два\nрядки"]]


def test_inventory_marks_duplicates_and_skips_locks(spark, tmp_path):
    for name, text in (("a.csv", "1"), ("b.csv", "1"), ("~$c.csv", "2"), (".d.csv", "3"), ("e.txt", "4"), ("f.TSV", "5")):
        (tmp_path / name).write_text(text)
    got = {r["path"].rsplit("/", 1)[1]: r for r in I.inventory(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.csv", "b.csv", "f.TSV"}
    assert got["b.csv"]["duplicate_of"].endswith("a.csv") and got["a.csv"]["duplicate_of"] is None
    assert I.select_sources(I.inventory(spark, str(tmp_path)), "f.").count() == 1
    assert I.safe_id("ab/лист 1") != I.safe_id("ab/лист_1")


def test_snapshots_are_verified(tmp_path):
    p = tmp_path / "in"
    p.write_text("x")
    store = I.SnapshotStore(tmp_path / "s")
    copy = store.capture(p)
    assert store.verify(copy.name) == copy == store.capture(p)
    copy.chmod(0o600)
    copy.write_text("y")
    with pytest.raises(ValueError):
        store.verify(copy.name)


def test_workbooks_become_frames(spark, tmp_path):
    p = str(tmp_path / "b.xlsx")
    write_book(p, [["Звіт за рік", None, None], [None, None, None], ["Назва", "Код", "Сума"], ["Перше", 12345678, 1.0], [None, 87654321, 2.5], ["Третє", 11112222, 3], ["Всього", None, 6.5]], ["A1:C1", "A4:A5"])
    f = reader.frames(spark, p)["One"]
    assert f.header.row == 2 and [c["header"] for c in f.columns] == ["Назва", "Код", "Сума"]
    rows = [(r["_row"], r["c0"], r["c1"], r["c2"]) for r in f.rows.orderBy("_row").collect()]
    assert rows == [(3, "Перше", "12345678", "1"), (4, "Перше", "87654321", "2.5"), (5, "Третє", "11112222", "3"), (6, "Всього", None, "6.5")]
    kinds = {r["index"]: r["kind"] for r in f.furniture.collect()}
    assert kinds[0] == "title" and kinds[6] == "totals"


def test_hostile_archives_are_refused(tmp_path):
    p = str(tmp_path / "b.xlsx")
    write_book(p, [["a"]], extra={"xl/x.xml": "<!DOCTYPE a>"})
    with pytest.raises(W.RefusedArchive):
        W.preflight(p)
    write_book(p, [["a"]])
    W.preflight(p)
    with pytest.raises(W.RefusedArchive):
        W.preflight(p, W.LIMITS | {"members": 1})


def test_two_header_rows_and_repeats(spark):
    rows = [["name", "birth"], ["Прізвище", "Дата народження"], ["Іваненко", "01.01.1980"], ["name", "birth"], [None, None], ["Петренко", "02.02.1990"]]
    grid = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "_row int, cells array<string>")
    f = L.build_frame(grid)
    assert (f.header.row, f.header.label_row) == (0, 1) and f.columns[0]["label"] == "Прізвище"
    assert [r["_row"] for r in f.rows.orderBy("_row").collect()] == [2, 5]
    assert {r["kind"] for r in f.furniture.collect()} == {"repeat_header", "blank"}


def test_a_register_is_laid_out_whatever_its_row_numbers(spark, tmp_path):
    from tabloom.queries.cases import QUERIES

    heads, names = [f"head {k}" for k in range(14)], ", ".join(f"c{k} string" for k in range(14))
    spark.createDataFrame([("s", heads)], "source_id string, column_headers array<string>").write.parquet(str(tmp_path / "sources.parquet"))
    rows = [(n, *[f"{n + k}" for k in range(14)]) for n in (1, 2, 2**31, 5 * 10**9)] + [(5 * 10**9 + 1, *heads), (5 * 10**9 + 2, " ", *[None] * 13), (5 * 10**9 + 3, "total", *["7"] * 13), (5 * 10**9 + 4, "x", *[None] * 13)]
    spark.createDataFrame(rows, f"row_id long, {names}").write.parquet(str(tmp_path / "frame_rows.parquet"))
    got = QUERIES["layout_of_a_register"](spark, str(tmp_path)).first()
    assert got.asDict() == {"rows": 6, "header_row": 0, "first_header": "head 0"}


def test_furniture_is_told_by_the_row_alone(spark):
    rows = [["name", "sum", "more"], ["a", "1", "2"], ["name", "sum", "more"], ["\u00a0", None, " "], ["total", "1", "2"], [" b\t", None, None], [None, "3", "\u3000d"]]
    grid = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "_row long, cells array<string>")
    for drop, left in ((False, [1, 4, 5, 6]), (True, [1, 6])):
        f = L.build_frame(grid, drop_furniture=drop)
        assert [r["_row"] for r in f.rows.orderBy("_row").collect()] == left
        assert {(r["index"], r["kind"]) for r in f.furniture.collect()} == {(2, "repeat_header"), (3, "blank"), (4, "totals"), (5, "sparse")}
    assert [(r["c0"], r["c2"]) for r in L.build_frame(grid).rows.where("_row >= 5").orderBy("_row").collect()] == [("b", None), (None, "d")]


def test_an_empty_grid_is_an_empty_frame(spark):
    grid = spark.createDataFrame([], "_row int, cells array<string>")
    f = L.build_frame(grid)
    assert f.rows.count() == 0 and f.header.row is None


def test_files_are_read_on_behind_broken_quotes(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text('11111111;Іван;1\n22222222;"Петро;2\n33333333;Ольга;3\n44444444;"Ан\nна";4\n5;x\n')
    got = [(r["ok"], r["reason"], list(r["typed"]) if r["typed"] else None) for r in S.read_recovering(spark, str(p), ";", ["identifier", "name", "number"]).collect()]
    assert got == [(True, None, ["11111111", "Іван", "1"]), (False, "quoting", None), (True, None, ["33333333", "Ольга", "3"]), (True, None, ["44444444", "Ан\nна", "4"]), (False, "columns", None)]


def test_a_file_is_as_wide_as_its_widest_row(spark, tmp_path):
    p = tmp_path / "w.csv"
    lines = ["name;sum"] + [f"n{k};{k}" for k in range(80)] + ['"a; ""b""\nc";1;;"late; remark";x;', "z;2"]
    p.write_text("\n".join(lines) + "\n")
    got = [r["cells"] for r in S.read_grid(spark, str(p)).orderBy("_row").collect()]
    assert {len(r) for r in got} == {6} and len(got) == 83
    assert got[81] == ['a; "b"\nc', "1", None, "late; remark", "x", None] and got[82] == ["z", "2", None, None, None, None]
    rows = reader.frames(spark, str(p))[""].rows.where("c3 IS NOT NULL").collect()
    assert [(r["c0"], r["c3"], r["c4"]) for r in rows] == [('a; "b"\nc', "late; remark", "x")]


def test_a_repaired_header_is_as_wide_as_the_rows(spark, tmp_path):
    p = tmp_path / "h.csv"
    p.write_text("name,sum\n" + "n;1\n" * 70 + "n;1;late\n")
    got = [r["cells"] for r in S.read_grid(spark, str(p)).orderBy("_row").collect()]
    assert got[0] == ["name", "sum", None] and got[1] == ["n", "1", None] and got[71] == ["n", "1", "late"]
