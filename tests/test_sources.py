"""Sources: permissive JSON, CSV rename, file ids."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from insight.sources.files import scan_csv, scan_json, scan_json_permissive, tag_file_id
from insight.sources.sinks import write_tagged


def test_permissive_keeps_corrupt_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1, "v": "x"}\n{"id": 2, "v": \n{"id": 3, "v": "z"}\n')
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType())])
    rows = sorted(scan_json_permissive(spark, str(tmp_path), schema).collect(), key=lambda r: str(r["id"]))
    assert [r["id"] for r in rows] == [1, 3, None]
    assert rows[2]["_corrupt_record"].startswith('{"id": 2')


def test_csv_rename_select(spark, tmp_path):
    (tmp_path / "x.csv").write_text("Item Title,Other,Item DOI\nT1,o,10.1/a\nT2,o,\n")
    df = scan_csv(spark, str(tmp_path), rename={"Item Title": "title", "Item DOI": "doi"})
    assert df.columns == ["title", "doi"]
    assert sorted((r["title"], r["doi"]) for r in df.collect()) == [("T1", "10.1/a"), ("T2", None)]


def test_file_ids_in_path_order(spark, tmp_path):
    for name, n in (("b.json", 2), ("a.json", 1), ("c.json", 3)):
        (tmp_path / name).write_text("".join(f'{{"x": {i}}}\n' for i in range(n)))
    df = scan_json(spark, str(tmp_path), T.StructType([T.StructField("x", T.LongType())]))
    tagged, files = tag_file_id(df, dimension=True)
    got = {r["path"].rsplit("/", 1)[-1]: r["file_name"] for r in files.collect()}
    assert got == {"a.json": 0, "b.json": 1, "c.json": 2}
    counts = {r["file_name"]: r["count"] for r in tagged.groupBy("file_name").count().collect()}
    assert counts == {0: 1, 1: 2, 2: 3}


def test_types_come_from_every_row(spark, tmp_path):
    from insight.sources.files import infer_types, scan_inferred_csv

    lines = ["flag,whole,real,when,text,blank,late,big,code,spaced"]
    for i in range(5000):
        lines.append(f"{'TRUE' if i % 2 else 'false'},{i - 7},{i / 4}e1,2024-03-0{i % 9 + 1}T10:00:00,a{i},,{i},{i},00{i}, {i} ")
    lines[4000] = "true,5,NaN,2024-03-01,7,,x,99999999999999999999,1d,"
    (tmp_path / "a.csv").write_text("\n".join(lines))
    df = scan_inferred_csv(spark, str(tmp_path / "a.csv"))
    assert dict(df.dtypes) == {"flag": "boolean", "whole": "bigint", "real": "double", "when": "timestamp_ntz", "text": "string",
                               "blank": "string", "late": "string", "big": "double", "code": "string", "spaced": "bigint"}
    rows = df.collect()
    assert len(rows) == 5000 and sum(r.late == "x" for r in rows) == 1 and sum(r.spaced is None for r in rows) == 1
    assert {r.blank for r in rows} == {None} and rows[0].when.isoformat() == "2024-03-01T10:00:00"
    assert infer_types(df.limit(0).selectExpr("cast(flag AS string) AS flag")) == {"flag": "string"}


def test_keys_that_no_schema_names(spark, tmp_path):
    from insight.operators import variants as V

    (tmp_path / "a.json").write_text('{"i": 1, "a": {"b": [1, {"c": true, "x y": null}], "e": {}}, "z": "q", "d": 1.50}\n\nno json\n'
                                     '{"i": 2, "other": [[1], []]}\n[1, 2]\nnull\n"s"\n')
    df = V.scan_documents(spark, str(tmp_path / "a.json")).selectExpr("*", "try_variant_get(document, '$.i', 'int') AS i", "1 AS path")
    assert [r.corrupt for r in df.filter("corrupt IS NOT NULL").collect()] == ["no json"]
    got = sorted([(r.i or 0, r.at, r.value, r.type) for r in V.leaves(df, "document", ["i"], path="at").collect()], key=str)
    assert [(i, p) for i, p, _, _ in got] == [(0, "$"), (0, "$"), (0, "$[0]"), (0, "$[1]"), (1, "$.a.b[0]"), (1, "$.a.b[1].c"),
                                              (1, "$.a.b[1].x y"), (1, "$.d"), (1, "$.i"), (1, "$.z"), (2, "$.i"), (2, "$.other[0][0]")]
    assert dict((p, v) for i, p, v, _ in got if i == 1)["$.a.b[1].x y"] is None
    schema = V.open_schema(df.filter("i IS NOT NULL"), "document")
    assert all(k in schema for k in ("other", "z"))
    assert V.leaves(df.filter("false"), "document", ["i"]).collect() == []


def test_write_tagged(spark, tmp_path):
    """Each row gives rows of several tables with columns of their own; null and empty lists give none."""
    df = spark.createDataFrame([(1, ["a", "b"], True), (2, [], False), (3, None, False)], "id long, tags array<string>, ok boolean")
    out = write_tagged(df, {
        "main": F.array(F.struct("id", "ok")),
        "tags": F.transform("tags", lambda t: F.struct(F.col("id"), t.alias("tag"))),
        "none": F.when(F.col("id") > 9, F.array(F.struct("id"))),
    }, str(tmp_path / "tables"))
    assert sorted(map(tuple, out["main"].collect())) == [(1, True), (2, False), (3, False)]
    assert sorted(map(tuple, out["tags"].collect())) == [(1, "a"), (1, "b")]
    assert out["none"].collect() == [] and out["none"].columns == ["id"]


def test_write_tagged_empty_input(spark, tmp_path):
    df = spark.createDataFrame([], "id long, table string")
    out = write_tagged(df, {"main": F.array(F.struct("id", "table"))}, str(tmp_path / "tables"))
    assert out["main"].collect() == [] and out["main"].columns == ["id", "table"]
