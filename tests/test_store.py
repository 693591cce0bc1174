"""The answer store, replaced documents, numbers of JSON columns, prompts."""

from __future__ import annotations

import hashlib
import json
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from calibra.functions.documents import flattened, parsed_prompt
from calibra.operators import answers
from calibra.sources import store, tables, workbooks

LINES = "key string, model string, condition string, rep int, latency_s double"


def lines(spark, n, model="m1"):
    return spark.createDataFrame([(f"k{i}", model, f"c{i % 2}", i % 3 + 1, float("nan") if i == 0 else i / 10) for i in range(n)], LINES)


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    for batch, df in ((0, lines(spark, 6)), (1, lines(spark, 4, "m2")), (0, lines(spark, 6)), (1, lines(spark, 4, "m2"))):
        store.append_batch(df, batch, path)
    read = store.answers_of(spark, path, ["m1", "m2"])
    assert read.count() == 10 and read.where("latency_s is null").count() == 2
    assert "NaN" not in "".join(p.read_text() for p in tmp_path.rglob("*.json"))


def test_streams_are_appended_once_and_resumed(spark, tmp_path):
    source, path, checkpoint = (str(tmp_path / x) for x in ("in", "store", "state"))
    for turn in range(2):
        lines(spark, 5, f"m{turn}").write.mode("append").json(source)
        store.append_stream(spark.readStream.schema(LINES).json(source), path, checkpoint).awaitTermination()
    store.append_stream(spark.readStream.schema(LINES).json(source), path, checkpoint).awaitTermination()
    assert store.answers_of(spark, path, ["m0", "m1"]).count() == 10


def test_what_is_there_is_listed_not_read(spark, tmp_path):
    path = str(tmp_path / "store")
    store.append_batch(lines(spark, 6).unionByName(lines(spark, 1, "m3")), 0, path)
    listing = store.discovered(spark, path)
    assert {(r["model"], r["condition"], tuple(r["reps"])) for r in store.available(listing).collect()} == {("m1", "c0", (1, 2, 3)), ("m1", "c1", (1, 2, 3)), ("m3", "c0", (1,))}
    asked = spark.createDataFrame([("m3",), ("m4",), ("m1",)], "model string")
    assert sorted(r["model"] for r in store.present(listing, asked).collect()) == ["m1", "m3"]
    some = store.answers_of(spark, path, ["m3"], ["c0"])
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*model[^\]]*m3", plan) and [r["key"] for r in some.collect()] == ["k0"]
    assert "content" not in listing._jdf.queryExecution().executedPlan().toString()


def test_a_document_is_replaced_at_once_and_tried_again(spark, tmp_path):
    path = str(tmp_path / "deep" / "result.json")
    store.replace_json(spark, {"b": float("nan"), "a": [1, {"z": 1, "c": float("inf")}]}, path)
    assert (tmp_path / "deep" / "result.json").read_text() == json.dumps({"a": [1, {"c": None, "z": 1}], "b": None}, indent=2)
    store.replace_json(spark, {"a": 2}, path)
    assert store.read_json(spark, path, "a int").first()["a"] == 2
    assert [p.name for p in (tmp_path / "deep").iterdir() if p.suffix == ".tmp"] == []
    (tmp_path / "taken").mkdir()
    (tmp_path / "taken" / "x").write_text("x")
    with pytest.raises(Exception):
        store.replace_json(spark, {}, str(tmp_path / "taken"), tries=2, wait=0.01)
    assert not list(tmp_path.glob("*.tmp"))


def test_scratch_needs_a_shared_folder(spark):
    assert store.scratch(spark, "x") != store.scratch(spark, "x")


def test_numbers_of_json_columns(spark):
    texts = ['{"b": [1, {"c": 2.5, "_d": 9}], "_x": {"y": 3}, "a": true, "n": null, "s": "7"}', "no json", None, "3", "[]", '{"": {"k": -1e3}}']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    want = {(i, label, value) for i, t in enumerate(texts) if t and t != "no json" for label, value in tables.flattened(t)}
    got = {tuple(r) for r in flattened(df, "text").collect()}
    assert {(i, label.lstrip("."), v) for i, label, v in got} == {(i, label.lstrip("."), v) for i, label, v in want} and len(got) == 4


def test_prompts(spark):
    texts = {
        "  Rate it.\nBe fair.\nA: good\n  and cheap \nB: bad\nConstraint: one letter\nAnswer:\nB: worse\nthan that  ": ("Rate it. Be fair. Answer:", {"A": "good and cheap", "B": "worse than that"}),
        "no sections\n\nat all": ("no sections  at all", {}),
        "AB: x\nab: y\nA1: z\nC:none": ("", {"AB": "x ab: y A1: z C:none"}),
        "Constraint: gone": ("", {}),
        "": ("", {}),
        None: None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", parsed_prompt(F.col("t")).alias("x"))
    assert {r["t"]: r["x"] and (r["x"]["instruction"], r["x"]["sections"]) for r in df.collect()} == texts


def workbook(path, sheets, shared=()):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/workbook.xml", f"<workbook {main}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels", "<R>" + "".join(f'<Relationship Id="r{i}" Target="{"/xl/" if i else ""}worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</R>")
        if shared:
            book.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si>{x}</si>" for x in shared) + "</sst>")
        for i, body in enumerate(sheets.values()):
            book.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")


def test_workbooks(spark, tmp_path):
    ratings = (
        '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="s"><v>1</v></c><c r="AA2" t="inlineStr"><is><t>wide </t></is></c></row>'
        '<row r="3"><c r="A3"><v>1.5</v></c><c r="B3" t="s"><v>2</v></c><c r="C3"><v>9</v></c><c r="AA3" t="b"><v>1</v></c></row><row><c><v>7</v></c><c t="str"><f>A4</f><v></v></c></row>'
    )
    workbook(tmp_path / "one.xlsx", {"ratings": ratings, "notes": '<row><c t="inlineStr"><is><r><t>no</t></r><r><t>te</t></r></is></c></row><row><c><v>3</v></c></row>', "none": ""}, ["<t>id</t>", "<t>name</t>", "<r><t>lo</t></r><r><t>w</t></r><rPh><t>x</t></rPh>"])
    workbook(tmp_path / "two.xlsx", {"ratings": '<row><c t="inlineStr"><is><t>id</t></is></c></row>'})
    found = workbooks.read_workbooks(spark, str(tmp_path))
    want = {("one.xlsx", "ratings", 0, "id", "1.5"), ("one.xlsx", "ratings", 0, "name", "low"), ("one.xlsx", "ratings", 0, "wide", "TRUE"), ("one.xlsx", "ratings", 1, "id", "7"), ("one.xlsx", "notes", 0, "note", "3")}
    assert {tuple(r) for r in found.collect()} == want
    table = workbooks.as_table(workbooks.read_workbooks(spark, str(tmp_path), ["ratings"]), ["id", "name"]).orderBy("row")
    assert [tuple(r) for r in table.collect()] == [("one.xlsx", "ratings", 0, "1.5", "low"), ("one.xlsx", "ratings", 1, "7", None)]
    (tmp_path / "bad.xlsx").write_text("no zip")
    with pytest.raises(Exception, match="zip"):
        workbooks.read_workbooks(spark, str(tmp_path)).collect()


def test_frozen_trees(spark):
    rows = [("a", i, f"t{i}") for i in range(0, 250, 3)] + [("a", 9, "again"), ("b", -7, None), ("b", 5, "")]
    df = spark.createDataFrame(rows, "c string, k long, body string")
    tree = answers.frozen_tree(df.repartition(5), ["c"], "body", "k", fan=10)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in tree.collect():
        level = sorted((k, digest(t or "")) for c, k, t in rows if c == r["c"])
        for fan in (10, 10, 10**9):
            level = [(c, digest("\n".join(d for k, d in level if k // fan == c))) for c in sorted({k // fan for k, _ in level})]
        assert fan and len({d for _, d in level}) >= 1
        assert r["rows"] == sum(c == r["c"] for c, _, _ in rows)
        if r["c"] == "a":
            assert r["sha256"] == level[0][1]
    again = answers.frozen_tree(df.where("k <> 5").unionByName(spark.createDataFrame([("d", 1, "x")], df.schema)), ["c"], "body", "k", fan=10)
    assert {tuple(r) for r in answers.replayed(tree, again, ["c"]).collect()} == {("a", "same"), ("b", "changed"), ("d", "new")}
    with pytest.raises(Exception, match="a frozen condition changed: b"):
        answers.extended(tree, again, ["c"]).collect()
    assert sorted(r["c"] for r in answers.extended(tree, again.where("c <> 'b'"), ["c"]).collect()) == ["a", "b", "d"]
