"""Bibliography text scan / render, normalisation, duplicate and overlap rules."""

from pyspark.sql import functions as F

from insight.operators import bibliography as B
from insight.sources.bibtex import render_entries, scan_bib

TEXT = "﻿" + """@article{key1,
  title = {{A Double Braced Title}},
  journal = {Journal One},
  year = {2019},
  DOI = {10.1000/ABC},
  author = {Doe, Jane and Roe, Richard}
}

@inproceedings{key2,
  title = {A title spread
           over two lines},
  booktitle = {Not the title},
  year = "2020",
  doi = {{10.1000/xyz}},
}
@book{key3,
 Title={No Identifier},
 year=2021,
 author={Solo, Han}}
"""


def test_scan_bib_fields(spark, tmp_path):
    p = tmp_path / "sample.bib"
    p.write_text(TEXT, encoding="utf-8")
    rows = {r["key"]: r for r in scan_bib(spark, str(p)).collect()}
    assert set(rows) == {"key1", "key2", "key3"}
    assert rows["key1"]["entry_type"] == "article"
    assert rows["key1"]["title"] == "A Double Braced Title"
    assert rows["key1"]["doi"] == "10.1000/ABC"           # upper-case field name
    assert rows["key1"]["author"] == "Doe, Jane and Roe, Richard"
    assert rows["key2"]["title"] == "A title spread over two lines"
    assert rows["key2"]["year"] == "2020"                 # quoted value
    assert rows["key2"]["doi"] == "10.1000/xyz"           # double braces
    assert rows["key2"]["author"] is None
    assert rows["key3"]["doi"] is None and rows["key3"]["year"] == "2021"
    assert rows["key3"]["title"] == "No Identifier"


def test_render_then_scan_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("article", "k1", "T one", None, "2001"), ("book", "k2", "T two", "J", None)],
                               "t string, k string, title string, journal string, year string")
    text = render_entries(df, "t", "k", {"title": "title", "journal": "journal", "year": "year"})
    assert "journal" not in text.filter("k = 'k1'").first()["value"]   # null field skipped
    path = str(tmp_path / "out")
    text.select("value").write.text(path)
    back = {r["key"]: r for r in scan_bib(spark, path).collect()}
    assert back["k1"]["title"] == "T one" and back["k1"]["journal"] is None
    assert back["k2"]["journal"] == "J" and back["k2"]["year"] is None


def test_normalize_defaults(spark):
    df = spark.createDataFrame([(None, None, None, None, None), ("T", "J", "x", "{10.1/a}", "A and B  and C")],
                               "title string, journal string, year string, doi string, author string")
    out = B.bib_normalize(df).collect()
    assert tuple(out[0]) == ("", "", 1900, "", "")
    assert tuple(out[1]) == ("T", "J", 1900, "10.1/a", "A; B; C")


def records(spark):
    rows = [("s1", 1, "d1"), ("s1", 2, "d1"), ("s1", 3, ""), ("s1", 4, ""), ("s2", 5, "d1"), ("s2", 6, "d2"),
            ("s2", 7, ""), ("s3", 8, "d9")]
    return spark.createDataFrame(rows, "db string, rec long, doi string")


def test_missing_key_keep_vs_collapse(spark):
    r = records(spark)
    keep = B.dedupe_first(r, ["db", "doi"], ["rec"], missing="keep")
    collapse = B.dedupe_first(r, ["db", "doi"], ["rec"], missing="collapse")
    assert sorted(x["rec"] for x in keep.collect()) == [1, 3, 4, 5, 6, 7, 8]
    assert sorted(x["rec"] for x in collapse.collect()) == [1, 3, 5, 6, 7, 8]
    dk = {x["db"]: x["duplicates"] for x in B.duplicate_count(r, "doi", group=["db"]).collect()}
    dc = {x["db"]: x["duplicates"] for x in B.duplicate_count(r, "doi", "collapse", group=["db"]).collect()}
    assert dk == {"s1": 1, "s2": 0, "s3": 0}
    assert dc == {"s1": 2, "s2": 0, "s3": 0}


def test_later_duplicates(spark):
    m = B.mark_later_duplicates(records(spark), ["doi"], ["db", "rec"])
    assert sorted(x["rec"] for x in m.filter("is_duplicate = 1").collect()) == [2, 5]


def test_overlap_matrix(spark):
    o = {(x["db1"], x["db2"]): (x["duplicates"], x["intersections"])
         for x in B.overlap_matrix(records(spark), "db", "doi").collect()}
    assert len(o) == 9
    assert o[("s1", "s1")] == (1, 1.0)
    assert o[("s1", "s2")] == (1, 1.0) and o[("s2", "s1")] == (1, 0.5)
    assert o[("s1", "s3")] == (0, 0.0)
    oc = {(x["db1"], x["db2"]): x["duplicates"]
          for x in B.overlap_matrix(records(spark), "db", "doi", missing="collapse").collect()}
    assert oc[("s1", "s2")] == 2                           # the blank key is shared too


def test_record_ids_unique(spark):
    df = spark.range(0, 3000).select(F.lit(2020).alias("year"), F.lit("article").alias("t"), "id")
    ids = B.record_ids(df, "year", "t", ["id"]).select("id").distinct().count()
    assert ids == 3000
    first = B.record_ids(df, "year", "t", ["id"]).filter("id = 'x'")
    assert first.count() == 0


def test_hot_key_third_of_rows(spark):
    """One DOI on a third of all rows: results stay exact and whole."""
    n = 30000
    df = spark.range(0, n).select(
        F.concat(F.lit("s"), (F.col("id") % 4).cast("string")).alias("db"), F.col("id").alias("rec"),
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("d"), (F.col("id") % 5000)
                                                                       .cast("string"))).alias("doi"))
    marked = B.mark_later_duplicates(df, ["doi"], ["db", "rec"])
    assert marked.count() == n
    firsts = marked.filter("is_duplicate = 0").count()
    assert firsts == df.select("doi").distinct().count()
    kept = B.dedupe_first(df, ["doi"], ["rec"])
    assert kept.filter("doi = 'HOT'").first()["rec"] == 0
    ov = {(r["db1"], r["db2"]): r["duplicates"] for r in B.overlap_matrix(df, "db", "doi").collect()}
    assert ov[("s0", "s0")] == df.filter("db = 's0'").select("doi").distinct().count()


def test_shared_keys(spark):
    r = records(spark)
    got = sorted(x[0] for x in B.shared_keys(r.filter("db = 's1'"), r.filter("db = 's2'"), "doi").collect())
    assert got == ["d1"]


def test_scan_skips_non_records(spark, tmp_path):
    p = tmp_path / "extra.bib"
    p.write_text('@comment{exported by a tool}\n@string{jn = "Journal"}\n@article{k9,\n  title = {The {RNA} World},\n}\n',
                 encoding="utf-8")
    rows = scan_bib(spark, str(p)).collect()
    assert [(r["key"], r["title"]) for r in rows] == [("k9", "The {RNA} World")]


def test_whole_records_keep_every_row(spark):
    """Full-width records: as many rows out as in, flags as row_number gives them, the same again."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from insight.operators import bibliography as B
    from insight.plans.bibliography import records

    rec = records(spark, "/root/testdata/sf0.01")
    n = rec.count()
    want = rec.filter("doi <> ''").withColumn("r", F.row_number().over(Window.partitionBy("doi").orderBy("db", "rec"))) \
        .filter("r > 1").count()
    for _ in range(2):
        out = B.mark_later_duplicates(rec, ["doi"], ["db", "rec"])
        assert out.count() == n and out.filter("is_duplicate = 1").count() == want
    ids = B.record_ids(rec.withColumn("document_type", F.lit("book")), "year", "document_type", ["db", "rec"])
    assert ids.select(F.substring_index("id", "_", -1)).distinct().count() == n


def test_blank_keys_collapse_alike(spark):
    from insight.operators import bibliography as B

    df = spark.createDataFrame([(1, "a"), (2, ""), (3, None), (4, "a"), (5, "b")], "rec long, doi string")
    kept = B.dedupe_first(df, ["doi"], ["rec"], missing="collapse")
    assert sorted(r.rec for r in kept.collect()) == [1, 2, 5]
    assert df.count() - kept.count() == B.duplicate_count(df, "doi", missing="collapse").first().duplicates
    flags = {r.rec: r.is_duplicate for r in B.mark_later_duplicates(df, ["doi"], ["rec"], missing="collapse").collect()}
    assert flags == {1: 0, 2: 0, 3: 1, 4: 1, 5: 0}


def test_entries_in_one_line_and_in_parentheses(spark, tmp_path):
    from insight.sources.bibtex import scan_bib

    (tmp_path / "a.bib").write_text(
        "@article{k1, title={A B}, year={2020}, doi={10.1/x}, author={X and Y}}\n"
        "@misc(k2, title = \"Q {R} S\", year = 1999)\n"
        "@book{k3,\n  title = {{Double} and {two {three}}},\n  note = {year = {1}},\n  year = 2001,\n  DOI = {10.2/y}\n}\n"
        "@comment{ignored, title={x}}\n"
        "@article{k4, title = {}, journal = {J, with comma}, }\n")
    rows = {r.key: r for r in scan_bib(spark, str(tmp_path / "a.bib")).collect()}
    assert set(rows) == {"k1", "k2", "k3", "k4"}
    assert (rows["k1"].title, rows["k1"].year, rows["k1"].doi, rows["k1"].author) == ("A B", "2020", "10.1/x", "X and Y")
    assert (rows["k2"].entry_type, rows["k2"].title, rows["k2"].year) == ("misc", "Q {R} S", "1999")
    assert (rows["k3"].title, rows["k3"].doi) == ("{Double} and {two {three}}", "10.2/y")
    assert (rows["k4"].title, rows["k4"].journal) == (None, "J, with comma")


def test_scan_bib_values_of_any_depth(spark, tmp_path):
    from insight.sources.bibtex import scan_bib

    (tmp_path / "deep.bib").write_text(
        '@article{a,\n  title = {{The {\\"{U}}ber}},\n  year = {2020},\n  journal = "A {{B {{C}} "x"}} D"\n}\n'
        '@article{b, title = {{The {\\"{U}}ber}}, journal = {}, year = {2021}}\n'
        '@article{c,\n  title = {a {b {c {d {e}}}}},\n  doi = {10.1/x}\n}\n')
    rows = {r.key: r for r in scan_bib(spark, str(tmp_path / "deep.bib")).collect()}
    assert (rows["a"].title, rows["a"].year, rows["a"].journal) == ('The {\\"{U}}ber', "2020", 'A {{B {{C}} "x"}} D')
    assert (rows["b"].title, rows["b"].year, rows["b"].journal) == ('The {\\"{U}}ber', "2021", None)
    assert (rows["c"].title, rows["c"].doi, rows["c"].author) == ("a {b {c {d {e}}}}", "10.1/x", None)


def test_scan_bib_follows_braces(spark, tmp_path):
    """Names inside values, indented and unbroken entries, lines that begin with @, joined and unclosed values."""
    (tmp_path / "a.bib").write_text(
        "\ufeff% exported by user@host.example {2020}\n"
        "@article{a,\n abstract = {see also doi = {10.9/fake}, year = {1} @misc{inner} },\n doi = {10.1/real},\n year = 2020\n}\n"
        "  @article{b, title = {Indented}, year = {2021}}\n"
        "@article{c,\n title = {A value\n@home with a line\n@ like this},\n doi = {10.3/c},\n}\n"
        '@article{d, title = "A" # " B" # jan, journal = "Q {"x"} S", note = {}, year = 1999 }@book{e,title={Same line}}\n'
        "@article{f, title = {lost brace, doi = {10.6/f},\n}\n"
        "@article{g, DOI = {10.7/g}, doi = {second}, title = {T}}\n"
        "@string{x = {y}}\n@preamble{ {z} }\n@Misc{ h , TITLE = {{{Deep}}}}\n@article{, title = {no key}}\n@misc{alone}\n", encoding="utf-8")
    rows = {r.key: r for r in scan_bib(spark, str(tmp_path / "a.bib")).collect()}
    assert set(rows) == {"a", "b", "c", "d", "e", "f", "g", "h", None, "alone"}
    assert (rows["a"].doi, rows["a"].year, rows["a"].title) == ("10.1/real", "2020", None)
    assert (rows["b"].title, rows["b"].year) == ("Indented", "2021")
    assert (rows["c"].title, rows["c"].doi) == ("A value @home with a line @ like this", "10.3/c")
    assert (rows["d"].title, rows["d"].journal, rows["d"].year) == ("A Bjan", 'Q {"x"} S', "1999")
    assert rows["e"].title == "Same line" and rows["e"].entry_type == "book"
    assert rows["f"].doi is None and rows["g"].doi == "10.7/g" and rows["g"].title == "T"
    assert (rows["h"].title, rows["h"].entry_type, rows[None].title, rows["alone"].title) == ("{Deep}", "misc", "no key", None)


def test_scan_bib_of_many_files(spark, tmp_path):
    """An unclosed entry at the end of one file takes nothing from the next; empty files have none."""
    for i in range(30):
        (tmp_path / f"{i:02d}.bib").write_text(f"@article{{k{i}, title = {{T {i}}}, note = {{open\n@ x\n" if i % 2 else
                                               f"@article{{k{i},\n title = {{T\n{i}}}\n}}\n" if i % 3 else "")
    rows = scan_bib(spark, str(tmp_path)).collect()
    assert sorted(r.title for r in rows) == sorted(f"T {i}" for i in range(30) if i % 2 or i % 3)


def test_approximate_overlap(spark):
    """Exact below the sketch's size; within its error beyond."""
    small = records(spark).unionByName(spark.createDataFrame([("empty", 9, None)], "db string, rec long, doi string"))
    exact = {(r.db1, r.db2): (r.duplicates, r.intersections) for r in B.overlap_matrix(small, "db", "doi").collect()}
    got = {(r.db1, r.db2): (r.duplicates, r.intersections) for r in B.approximate_overlap(small, "db", "doi").collect()}
    assert got == exact and len(got) == 16
    # 100,000 and 150,000 keys, 50,000 of them shared; a third of the rows repeat one key
    df = spark.range(375_000).selectExpr("IF(id % 5 < 2, 'a', 'b') AS db", "cast(IF(id % 3 = 0, 0, IF(id % 5 < 2, id, id + 100000)) AS string) AS doi")
    want = {(r.db1, r.db2): r.duplicates for r in B.overlap_matrix(df, "db", "doi").collect()}
    for r in B.approximate_overlap(df, "db", "doi", lg=12).collect():
        union = want["a", "a"] + want["b", "b"] - want["a", "b"] if r.db1 != r.db2 else want[r.db1, r.db2]
        assert abs(r.duplicates - want[r.db1, r.db2]) < 4 * (max(want[r.db1, r.db2], 1) * union / 2 ** 12) ** 0.5
