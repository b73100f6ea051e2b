"""Bibliography queries.

``bib``: one record per document; the database is the document's source and
the DOI a digest of the whole text, so exact copies across sources are shared
records.  ``bibtext``: one record per part, rendered as bibliography text,
written, and scanned back.  ``names``: part names run together in camel case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from insight.functions.columns import camel_split
from insight.operators import bibliography as B
from insight.plans.registry import register
from insight.plans.views import table
from insight.session import scratch_path
from insight.sources.bibtex import render_entries, scan_bib
from insight.sources.files import scan_csv, scan_inferred_csv
from insight.sources.sinks import write_csv, write_text

BIB_COLUMNS: list[tuple[str, str]] = [
    ("rec", "doc_id"),
    ("db", "source"),
    ("title", "'Record ' || cast(doc_id as string)"),
    ("journal", "CASE WHEN lang = 'es' THEN NULL ELSE 'Journal ' || upper(lang) END"),
    ("year", "CASE WHEN n_chars % 29 = 0 THEN NULL ELSE cast(1990 + n_chars % 30 as string) END"),
    ("doi", "CASE WHEN n_chars < 300 THEN NULL WHEN lang = 'de' THEN '{{10.' || md5(text) || '}}' "
            "ELSE '{10.' || md5(text) || '}' END"),
    ("author", "CASE WHEN lang = 'fr' THEN NULL ELSE 'Writer ' || source || ' and Editor ' || upper(lang) END"),
    ("document_type", "CASE lang WHEN 'en' THEN 'Article' WHEN 'de' THEN 'Chapter' WHEN 'fr' THEN 'Book' "
                      "ELSE 'Preprint' END"),
    ("volume", "cast(n_chars % 40 as double)"),
]

PART_COLUMNS: list[tuple[str, str]] = [
    ("entry_type", "CASE p_size % 3 WHEN 0 THEN 'book' WHEN 1 THEN 'article' ELSE 'incollection' END"),
    ("key", "'P' || cast(p_partkey as string)"),
    ("title", "p_name"),
    ("journal", "p_brand"),
    ("year", "cast(1990 + p_size as string)"),
    ("doi", "'10.5555/' || cast(p_partkey as string)"),
    ("author", "CASE WHEN p_size % 7 = 0 THEN NULL ELSE 'Maker ' || p_type || ' and Maker ' || p_brand END"),
]


def bib_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*[f"{e} AS {n}" for n, e in BIB_COLUMNS])


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.bib_normalize(bib_raw(spark, sf_dir), keep=["rec", "db"])


def part_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*[f"{e} AS {n}" for n, e in PART_COLUMNS], "p_size")


BIB_CTE = "WITH bib AS (SELECT " + ", ".join(
    f"{e.replace(' as string', ' AS VARCHAR')} AS {n}" for n, e in BIB_COLUMNS) + " FROM documents),\n" + """rec AS (
  SELECT rec, db, coalesce(title, '') AS title, coalesce(journal, '') AS journal,
    coalesce(TRY_CAST(year AS INTEGER), 1900) AS year, replace(replace(coalesce(doi, ''), '{', ''), '}', '') AS doi,
    coalesce(replace(author, ' and ', '; '), '') AS authors
  FROM bib)
"""
PART_CTE = "parts AS (SELECT " + ", ".join(
    f"{e.replace(' as string', ' AS VARCHAR')} AS {n}" for n, e in PART_COLUMNS) + ", p_size FROM part)\n"

_FIRST_SQL = """firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY db, doi ORDER BY rec) AS rn
  FROM rec WHERE doi <> '') WHERE rn = 1
  UNION ALL SELECT *, 1 AS rn FROM rec WHERE doi = '')"""


@register("bib_normalize", BIB_CTE + "SELECT * FROM rec")
def q_bib_normalize(spark, sf_dir):
    return records(spark, sf_dir)


@register("map_values", BIB_CTE + """SELECT rec, CASE document_type WHEN 'Chapter' THEN 'incollection'
  WHEN 'Book' THEN 'book' WHEN 'Article' THEN 'article' ELSE document_type END AS document_type,
  regexp_replace(CAST(volume AS VARCHAR), '\\.0$', '') AS volume FROM bib""")
def q_map_values(spark, sf_dir):
    return bib_raw(spark, sf_dir).select("rec", B.map_values("document_type", B.DOC_TYPES).alias("document_type"),
                                         B.strip_float_suffix("volume").alias("volume"))


# Publisher export headers -> record fields.
EXPORT_HEADERS = {"Item Title": "title", "Publication Title": "journal", "Journal Volume": "volume",
                  "Journal Issue": "number", "Item DOI": "doi", "Authors": "author", "Publication Year": "year",
                  "URL": "url", "Content Type": "document_type"}
_EXPORT_SQL = """SELECT title, journal, CAST(volume AS VARCHAR) AS volume, CAST(CAST(volume AS BIGINT) % 12 AS VARCHAR) AS number,
  doi, author, year, 'https://doi.example/' || CAST(rec AS VARCHAR) AS url, document_type FROM bib"""


def publisher_export(spark: SparkSession, sf_dir: str) -> str:
    """A publisher's CSV export of the records, with a column nobody reads; its path."""
    raw = bib_raw(spark, sf_dir).withColumns({
        "number": (F.col("volume").cast("bigint") % 12).cast("string"),
        "url": F.concat(F.lit("https://doi.example/"), F.col("rec").cast("string"))})
    path = scratch_path(spark, "publisher-export")
    write_csv(raw.select(*[F.col(dst).cast("string").alias(src) for src, dst in EXPORT_HEADERS.items()],
                         F.lit("x").alias("Publisher")), path)
    return path


@register("rename_select", BIB_CTE + _EXPORT_SQL)
def q_rename_select(spark, sf_dir):
    return scan_csv(spark, publisher_export(spark, sf_dir), rename=EXPORT_HEADERS)


@register("scan_typed_csv", BIB_CTE + """SELECT rec, title, CAST(TRY_CAST(year AS INTEGER) AS INTEGER) AS year, volume,
  volume > 20 AS late FROM bib""")
def q_scan_typed_csv(spark, sf_dir):
    """A CSV read with a declared schema: no inference pass, typed columns."""
    path = scratch_path(spark, "typed-csv")
    raw = bib_raw(spark, sf_dir).select("rec", "title", "year", "volume", (F.col("volume") > 20).alias("late"))
    write_csv(raw, path, gzip=True)
    return scan_csv(spark, path, schema=T.StructType([
        T.StructField("rec", T.LongType()), T.StructField("title", T.StringType()), T.StructField("year", T.IntegerType()),
        T.StructField("volume", T.DoubleType()), T.StructField("late", T.BooleanType())]))


# cells of every type; `mixed` is a number but for a few rows, so a sample would take it for one
_CELLS = ["doc_id AS id", "n_chars / 2.0 AS half", "n_chars > 1000 AS long_text", "cast('2024-01-01' AS date) AS day",
          "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id * 3 END AS gaps", "CASE WHEN doc_id % 97 = 96 THEN 'n/a' ELSE cast(doc_id AS string) END AS mixed",
          "cast(NULL AS string) AS nothing", "'' || source AS name"]


@register("scan_inferred_csv", """SELECT doc_id AS id, CAST(n_chars AS DOUBLE) / 2 AS half, n_chars > 1000 AS long_text,
  CAST('2024-01-01' AS TIMESTAMP) AS day, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id * 3 END AS gaps,
  CASE WHEN doc_id % 97 = 96 THEN 'n/a' ELSE CAST(doc_id AS VARCHAR) END AS mixed, CAST(NULL AS VARCHAR) AS nothing, source AS name
FROM documents""")
def q_scan_inferred_csv(spark, sf_dir):
    """A CSV whose column types come from all of its rows."""
    path = scratch_path(spark, "inferred-csv")
    write_csv(table(spark, sf_dir, "documents").selectExpr(*_CELLS), path)
    return scan_inferred_csv(spark, path)


@register("shared_keys", BIB_CTE + """SELECT doi FROM rec WHERE db = 'src0' AND doi <> ''
INTERSECT SELECT doi FROM rec WHERE db <> 'src0' AND doi <> ''""")
def q_shared_keys(spark, sf_dir):
    r = records(spark, sf_dir)
    return B.shared_keys(r.filter(F.col("db") == "src0"), r.filter(F.col("db") != "src0"), "doi")


def part_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = part_raw(spark, sf_dir).withColumn("db", F.lit("catalogue"))
    return B.bib_normalize(p, keep=["db"], authors="author")


@register("union_sources", BIB_CTE + ", " + PART_CTE + """SELECT db, title, journal, year, doi, authors FROM rec
UNION ALL SELECT 'catalogue' AS db, title, journal, CAST(year AS INTEGER) AS year, doi,
  coalesce(replace(author, ' and ', '; '), '') AS authors FROM parts""")
def q_union_sources(spark, sf_dir):
    cols = ["db", "title", "journal", "year", "doi", "authors"]
    return records(spark, sf_dir).select(*cols).unionByName(part_records(spark, sf_dir).select(*cols))


@register("dedupe_first", BIB_CTE + ", " + _FIRST_SQL + "\nSELECT db, rec, doi FROM firsts")
def q_dedupe_first(spark, sf_dir):
    return B.dedupe_first(records(spark, sf_dir), ["db", "doi"], ["rec"]).select("db", "rec", "doi")


@register("dedupe_union", BIB_CTE + ", " + _FIRST_SQL + """,
ranked AS (SELECT db, rec, doi, row_number() OVER (PARTITION BY doi ORDER BY db, rec) AS r FROM firsts)
SELECT db, rec, doi, CAST(CASE WHEN doi <> '' AND r > 1 THEN 1 ELSE 0 END AS INTEGER) AS is_duplicate
FROM ranked""")
def q_dedupe_union(spark, sf_dir):
    per_source = B.dedupe_first(records(spark, sf_dir), ["db", "doi"], ["rec"])
    return B.mark_later_duplicates(per_source, ["doi"], ["db", "rec"]).select("db", "rec", "doi", "is_duplicate")


@register("duplicate_counts", BIB_CTE + ", " + _FIRST_SQL + """
SELECT db AS scope, count(*) - count(DISTINCT doi) AS duplicates FROM rec WHERE doi <> '' GROUP BY db
UNION ALL SELECT 'combined', count(*) - count(DISTINCT doi) FROM firsts WHERE doi <> ''
UNION ALL SELECT 'raw', count(*) - count(DISTINCT doi) FROM rec WHERE doi <> ''""")
def q_duplicate_counts(spark, sf_dir):
    return B.duplicate_summary(records(spark, sf_dir), "db", "doi")


@register("duplicate_rows", BIB_CTE + """SELECT db, rec, doi FROM (SELECT db, rec, doi,
  row_number() OVER (PARTITION BY doi ORDER BY db, rec) AS rn FROM rec WHERE doi <> '') WHERE rn > 1""")
def q_duplicate_rows(spark, sf_dir):
    marked = B.mark_later_duplicates(records(spark, sf_dir), ["doi"], ["db", "rec"])
    return marked.filter(F.col("is_duplicate") == 1).select("db", "rec", "doi")


@register("duplicate_keys", BIB_CTE + """SELECT doi, count(*) AS n FROM rec WHERE doi <> '' GROUP BY doi
HAVING count(*) > 1""")
def q_duplicate_keys(spark, sf_dir):
    return B.duplicate_keys(records(spark, sf_dir), "doi")


_OVERLAP_SQL = BIB_CTE + """, k AS (SELECT DISTINCT db, doi FROM rec WHERE doi <> ''),
sz AS (SELECT db, count(*) AS n FROM k GROUP BY db),
sh AS (SELECT a.db AS db1, b.db AS db2, count(*) AS c FROM k a JOIN k b ON a.doi = b.doi GROUP BY 1, 2),
dbs AS (SELECT DISTINCT db FROM rec WHERE db IS NOT NULL)
SELECT x.db AS db1, y.db AS db2, coalesce(sh.c, 0) AS duplicates,
  round(CAST(coalesce(sh.c, 0) AS DOUBLE) / sz.n, 6) AS intersections
FROM dbs x CROSS JOIN dbs y LEFT JOIN sh ON sh.db1 = x.db AND sh.db2 = y.db LEFT JOIN sz ON sz.db = x.db"""


@register("overlap_matrix", _OVERLAP_SQL)
def q_overlap_matrix(spark, sf_dir):
    o = B.overlap_matrix(records(spark, sf_dir), "db", "doi")
    return o.select("db1", "db2", "duplicates", F.round("intersections", 6).alias("intersections"))


@register("overlap_sketch", _OVERLAP_SQL)
def q_overlap_sketch(spark, sf_dir):
    """The overlaps from one sketch a source; exact up to 65,536 keys in two sources, estimated beyond."""
    o = B.approximate_overlap(records(spark, sf_dir), "db", "doi")
    return o.select("db1", "db2", "duplicates", F.round("intersections", 6).alias("intersections"))


@register("record_id", BIB_CTE + """SELECT b.rec, CAST(r.year AS VARCHAR) || '_' || CASE b.document_type
  WHEN 'Chapter' THEN 'incollection' WHEN 'Book' THEN 'book' WHEN 'Article' THEN 'article' ELSE b.document_type END
  || '_' || lpad(CAST(row_number() OVER (ORDER BY b.db, b.rec) - 1 AS VARCHAR), 4, '0') AS id
FROM bib b JOIN rec r ON b.rec = r.rec""")
def q_record_id(spark, sf_dir):
    raw = bib_raw(spark, sf_dir).withColumn("document_type", B.map_values("document_type", B.DOC_TYPES))
    norm = B.bib_normalize(raw, keep=["rec", "db", "document_type"])
    return B.record_ids(norm, "year", "document_type", ["db", "rec"]).select("rec", "id")


@register("top_n", BIB_CTE + "SELECT rec, year, title FROM rec ORDER BY year DESC, rec LIMIT 50")
def q_top_n(spark, sf_dir):
    return B.top_n(records(spark, sf_dir), [F.desc("year"), F.asc("rec")], 50).select("rec", "year", "title")


# ------------------------------------------------------------- bibliography text

def _title_text() -> F.Column:
    """Title as written in the text: double-braced for large sizes, broken
    over lines for small ones."""
    t = F.col("title")
    return (F.when(F.col("p_size") > 25, F.concat(F.lit("{"), t, F.lit("}")))
            .when(F.col("p_size") < 5, F.regexp_replace(t, " ", "\n    "))
            .otherwise(t))


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = part_raw(spark, sf_dir)
    # the doi field is written upper-case for even sizes, lower-case otherwise
    upper = render_entries(p.filter(F.col("p_size") % 2 == 0), "entry_type", "key",
                           {"title": _title_text(), "journal": "journal", "year": "year", "DOI": "doi",
                            "author": "author"})
    lower = render_entries(p.filter(F.col("p_size") % 2 != 0), "entry_type", "key",
                           {"title": _title_text(), "journal": "journal", "year": "year", "doi": "doi",
                            "author": "author"})
    return upper.unionByName(lower)


def squeezed(df: DataFrame) -> DataFrame:
    """Every third entry on one line, every fifth one with a quoted journal and a note of nested braces."""
    line = F.regexp_replace("value", r"\s*\n\s*", " ")
    quoted = F.regexp_replace("value", r"journal = \{([^{}]*)\}", 'note = {a {b {c}}, year = {0}}, journal = "$1"')
    return df.withColumn("value", F.when(F.col("p_size") % 3 == 0, line).when(F.col("p_size") % 5 == 0, quoted)
                         .otherwise(F.col("value")))


def _render_sql(doi_field: str) -> str:
    title = ("CASE WHEN p_size > 25 THEN '{' || title || '}' WHEN p_size < 5 THEN replace(title, ' ', chr(10) || '    ') "
             "ELSE title END")
    lines = ["'@' || entry_type || '{' || key || ','",
             f"'  title = {{' || ({title}) || '}},'",
             "'  journal = {' || journal || '},'",
             "'  year = {' || year || '},'",
             f"'  {doi_field} = {{' || doi || '}},'",
             "CASE WHEN author IS NOT NULL THEN '  author = {' || author || '},' END",
             "'}'"]
    return "concat_ws(chr(10), " + ", ".join(lines) + ")"


@register("bib_render", "WITH " + PART_CTE + f"""SELECT key, CASE WHEN p_size % 2 = 0 THEN {_render_sql('DOI')}
  ELSE {_render_sql('doi')} END AS value FROM parts""")
def q_bib_render(spark, sf_dir):
    return rendered(spark, sf_dir).select("key", "value")


@register("bib_scan", "WITH " + PART_CTE + "SELECT entry_type, key, title, journal, year, doi, author FROM parts")
def q_bib_scan(spark, sf_dir):
    path = scratch_path(spark, "bibtext")
    write_text(squeezed(rendered(spark, sf_dir)), path)
    return scan_bib(spark, path)


@register("camel_split", """SELECT p_partkey, 'NL ' || array_to_string(list_transform(string_split(p_name, ' '),
  lambda w: upper(w[1]) || lower(w[2:])), ' ') AS name_parts FROM part""")
def q_camel_split(spark, sf_dir):
    """Run-together names, a run of capitals in front: ``NLGoldenPlum`` -> ``NL Golden Plum``."""
    p = table(spark, sf_dir, "part")
    run_together = F.concat(F.lit("NL"), F.array_join(F.transform(F.split("p_name", " "), lambda w: F.initcap(w)), ""))
    return p.select("p_partkey", F.array_join(camel_split(run_together), " ").alias("name_parts"))
