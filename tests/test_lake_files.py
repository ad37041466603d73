import csv
import io
import random
import zipfile

import pytest

from lakeweave.sources import lake_files as LF


@pytest.mark.parametrize("split", ["64", "1000000"])
def test_records_of_split_files_equal_a_plain_reader(spark, tmp_path, split):
    r = random.Random(5)
    want = {}
    for name in ("a.csv", "b.csv", "c d.csv"):
        head = ["k", "k", "x,y", 'q"q'][: r.randint(2, 4)]
        rows = [["".join(r.choice(["a", "é", ",", '"', "\n", "\r", " ", "long words "]) for _ in range(r.randint(0, 9))) for _ in range(r.randint(1, 5))] for _ in range(60)]
        out = io.StringIO(newline="")
        w = csv.writer(out, lineterminator=r.choice(["\n", "\r\n"]), quoting=csv.QUOTE_ALL)
        w.writerows([head, *rows])
        (tmp_path / name).write_bytes(("\ufeff" if name == "b.csv" else "").encode() + out.getvalue().encode())
        names = [c if c not in head[:i] else f"{c}_{i}" for i, c in enumerate(head)]
        want |= {(name, i, j, names[j]): v for i, row in enumerate(rows) for j, v in enumerate(row) if j < len(head)}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = LF.read_lake(spark, str(tmp_path)).collect()
        parts = LF.records(spark, str(tmp_path)).count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {(x.table_id, x.row_idx, x.col_idx, x.col): x.value for x in got} == want and parts == 183


def book(path, sheets, shared):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i, _ in enumerate(sheets)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><r><t>{s[:1]}</t></r><r><t>{s[1:]}</t></r></si>" for s in shared) + "</sst>")
        for i, cells in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {ns}><sheetData><row>" + "".join(cells) + "</row></sheetData></worksheet>")


def test_workbooks(spark, tmp_path):
    book(tmp_path / "one.xlsx", {
        "first": ['<c r="A1" t="s"><v>0</v></c>', '<c r="AB1" t="inlineStr"><is><t>wide</t></is></c>', '<c r="A2"><v>3.5</v></c>', '<c r="AB3" t="s"><v>1</v></c>', '<c r="A4"/>'],
        "other": ['<c r="A1" t="s"><v>1</v></c>', '<c r="A2" t="str"><v>x</v></c>', '<c r="B2"><v>9</v></c>'],
    }, ["name", "value"])
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    got = {(x.table_id, x.row_idx, x.col_idx, x.col, x.value) for x in LF.read_workbooks(spark, str(tmp_path)).collect()}
    assert got == {("one.xlsx#first", 0, 0, "name", "3.5"), ("one.xlsx#first", 1, 27, "wide", "value"), ("one.xlsx#other", 0, 0, "value", "x")}
