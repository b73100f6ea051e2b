"""Coded-survey queries on the ``matrix`` stand-in.

A "paper" is one customer's orders in one calendar year.  Its raw row is
written the way a hand-coded survey export looks: blank-padded cells, ``X`` /
``x`` / blank indicator cells, raw column names carrying ``3`` and ``_``, a
junk ``Spalte`` column, a comma-list cell.  Values are the five order
priorities, metrics the three order statuses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from insight.functions.columns import year_start_shift
from insight.operators import coding as C
from insight.operators import matrix as X
from insight.operators import trends as T
from insight.operators.joins import join_dimension
from insight.plans.registry import register
from insight.plans.views import landed, table

# Fixed values of the stand-in survey.
VALUES = ["Urgent", "High", "Medium", "Not Specified", "Low"]
METRICS = ["Status F", "Status_O", "Status P"]
GROUPS = {"Urgency": ["Urgent", "High"], "Routine": ["Medium"], "Deferred": ["Not Specified", "Low"]}
GROUP_NAMES = sorted(GROUPS)
FAMILIES = {"Settled": ["Status F"], "Open": ["Status_O", "Status P"]}
TYPE_MERGE = {"Building/Analysis": "Building", "Building/Review": "Building"}
THRESHOLDS = [0, 1, 3, 5, 10]
HALFLIFE_DAYS = 3 * T.DAYS_PER_YEAR
RARE_FLOOR = 2

# Raw survey columns as portable SQL over the per-paper aggregate `p`
# (o_custkey, y, c_mktsegment, n_name, n, mp, v1..v5, sf, so, sp, statuses).
RAW_COLUMNS: list[tuple[str, str]] = [
    ("ID", "'P' || cast(o_custkey as string) || '-' || cast(y as string)"),
    ("Title", "'Paper ' || cast(o_custkey as string) || '/' || cast(y as string)"),
    ("Year", "cast(y as int)"),
    ("Type of Paper3", "lower(c_mktsegment) || CASE WHEN n >= 3 THEN '/analysis' WHEN n = 2 THEN '/review' "
                       "ELSE '' END"),
    ("Platform3", "'  ' || n_name || ' '"),
    ("Diversity-Type3", "CASE WHEN n = 1 THEN NULL ELSE statuses || CASE WHEN n >= 5 THEN ',' || n_name "
                        "ELSE '' END END"),
    ("Not Relevant", "CASE WHEN mp < 20000 THEN 'X' ELSE '' END"),
    ("Hit-Rate", "CASE WHEN n >= 4 THEN 'x' END"),
    (" Urgent3", "CASE WHEN v1 = 1 THEN 'X' ELSE '' END"),
    ("High_3", "CASE WHEN v2 = 1 THEN ' X ' ELSE '' END"),
    ("Medium", "CASE WHEN v3 = 1 THEN 'x' END"),
    ("Not Specified 3", "CASE WHEN v4 = 1 THEN 'X' ELSE '' END"),
    ("Low", "CASE WHEN v5 = 1 THEN 'X' ELSE ' ' END"),
    ("Status F3", "CASE WHEN sf = 1 THEN 'X' ELSE '' END"),
    ("status_o", "CASE WHEN so = 1 THEN 'X' ELSE '' END"),
    ("STATUS P_3", "CASE WHEN sp = 1 THEN 'x' ELSE '' END"),
    ("Spalte1", "''"),
    ("Comment", "'orders: ' || cast(n as string)"),
]
# The names the raw columns must normalise to (junk column dropped).
NORMALISED = ["Id", "Title", "Year", "Type Of Paper", "Platform", "Diversity-Type", "Not Relevant", "Hit-Rate",
              "Urgent", "High", "Medium", "Not Specified", "Low", "Status F", "Status_O", "Status P", "Comment"]

_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def q(name: str) -> str:
    return '"' + name + '"'


def b(name: str) -> str:
    return "`" + name + "`"


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per (customer, year) aggregate of orders, then its customer and nation.
    Orders are aggregated before the joins, so the joins see one row per paper."""
    o = table(spark, sf_dir, "orders")
    flags = [F.max(F.when(F.col("o_orderpriority") == p, 1).otherwise(0)).alias(f"v{i + 1}")
             for i, p in enumerate(_PRIORITIES)]
    flags += [F.max(F.when(F.col("o_orderstatus") == s, 1).otherwise(0)).alias(f"s{s.lower()}")
              for s in ["F", "O", "P"]]
    per = (o.groupBy("o_custkey", F.year("o_orderdate").alias("y"))
           .agg(F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("mp"), *flags))
    # the sorted distinct statuses, from the flags (keeps the aggregation hash-based)
    per = per.withColumn("statuses", F.concat_ws(",", *[F.when(F.col(f"s{s.lower()}") == 1, F.lit(s))
                                                        for s in ["F", "O", "P"]]))
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nat = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = join_dimension(per, cust, per["o_custkey"] == cust["c_custkey"])
    return join_dimension(j, nat, j["c_nationkey"] == nat["n_nationkey"])


def survey_raw(spark: SparkSession, sf_dir: str, p: DataFrame | None = None) -> DataFrame:
    p = p if p is not None else papers(spark, sf_dir)
    return p.selectExpr(*[f"{e} AS {b(n)}" for n, e in RAW_COLUMNS])


def build_coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.coded_matrix(survey_raw(spark, sf_dir), type_merge=TYPE_MERGE)


def coded(spark: SparkSession, sf_dir: str, p: DataFrame | None = None) -> DataFrame:
    """The coded matrix, cleaned once per session (its indicator detection is a
    pass of its own) and landed; every survey analysis is a function of it."""
    return landed(spark, sf_dir, ["orders", "customer", "nation"], "survey-coded", build_coded)


def with_families(df: DataFrame) -> DataFrame:
    return C.family_sums(df, FAMILIES)


def molten(spark: SparkSession, sf_dir: str, cd: DataFrame | None = None) -> DataFrame:
    """Long (paper, value) rows with the value's group and the metric family sums."""
    wide = with_families(cd if cd is not None else coded(spark, sf_dir))
    long = C.unpivot(wide, ["Title", "Type Of Paper", "Platform", "Year", *FAMILIES], VALUES, "Value", "Mentions")
    return long.withColumn("Value Group", C.group_of("Value", GROUPS))


def group_sums(df: DataFrame) -> DataFrame:
    """Per paper: sum of the values of each group (aggregated before any unpivot)."""
    from insight.functions.columns import row_sum
    return df.withColumns({g: row_sum([F.col(b(c)) for c in cols]).cast("double") for g, cols in GROUPS.items()})


def by_year_group(spark: SparkSession, sf_dir: str, cd: DataFrame | None = None) -> DataFrame:
    return T.sum_by(molten(spark, sf_dir, cd), ["Year", "Value Group"], "Mentions")


def prescreen(spark: SparkSession, sf_dir: str, p: DataFrame | None = None) -> DataFrame:
    """All papers before screening (title, year moved by a year)."""
    p = p if p is not None else papers(spark, sf_dir)
    return p.select(
        F.expr("'Paper ' || cast(o_custkey as string) || '/' || cast(y as string)").alias("Title"),
        year_start_shift("y").alias("Year"))


# ----------------------------------------------------------------- DuckDB side

_P_SQL = """p AS (
  SELECT o.o_custkey, o.y, c.c_mktsegment, nn.n_name, o.n, o.mp, o.v1, o.v2, o.v3, o.v4, o.v5, o.sf, o.so, o.sp,
    o.statuses
  FROM (SELECT o_custkey, year(o_orderdate) AS y, count(*) AS n, min(o_totalprice) AS mp,
      max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS v1,
      max(CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS v2,
      max(CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1 ELSE 0 END) AS v3,
      max(CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 1 ELSE 0 END) AS v4,
      max(CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END) AS v5,
      max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS sf,
      max(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS so,
      max(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS sp,
      string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses
    FROM orders GROUP BY 1, 2) o
  JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation nn ON c.c_nationkey = nn.n_nationkey)"""

_TYPE_SQL = ("upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || "
             "CASE WHEN n >= 3 THEN '/Analysis' WHEN n = 2 THEN '/Review' ELSE '' END")

_CODED_SQL = f"""coded AS (
  SELECT 'P' || CAST(o_custkey AS VARCHAR) || '-' || CAST(y AS VARCHAR) AS "Id",
    'Paper ' || CAST(o_custkey AS VARCHAR) || '/' || CAST(y AS VARCHAR) AS "Title",
    make_date(CAST(y AS INTEGER) + 1, 1, 1) AS "Year",
    CASE WHEN ({_TYPE_SQL}) IN ('Building/Analysis', 'Building/Review') THEN 'Building'
      ELSE {_TYPE_SQL} END AS "Type Of Paper",
    n_name AS "Platform",
    CASE WHEN n = 1 THEN NULL ELSE statuses || CASE WHEN n >= 5 THEN ',' || n_name ELSE '' END END
      AS "Diversity-Type",
    CASE WHEN n >= 4 THEN 1.0 ELSE 0.0 END::DOUBLE AS "Hit-Rate",
    v1::DOUBLE AS "Urgent", v2::DOUBLE AS "High", v3::DOUBLE AS "Medium", v4::DOUBLE AS "Not Specified",
    v5::DOUBLE AS "Low", sf::DOUBLE AS "Status F", so::DOUBLE AS "Status_O", sp::DOUBLE AS "Status P",
    'orders: ' || CAST(n AS VARCHAR) AS "Comment"
  FROM p WHERE mp >= 20000)"""

_FAM_SQL = '"Status F" AS "Settled", "Status_O" + "Status P" AS "Open"'
_GROUP_CASE = ("CASE WHEN v IN ('Urgent', 'High') THEN 'Urgency' WHEN v IN ('Medium') THEN 'Routine' "
               "WHEN v IN ('Not Specified', 'Low') THEN 'Deferred' ELSE '' END")

_MOLTEN_SQL = "molten AS (" + "\n  UNION ALL ".join(
    f"""SELECT "Title", "Type Of Paper", "Platform", "Year", {_FAM_SQL}, '{v}' AS "Value", "{v}" AS "Mentions",
    {_GROUP_CASE.replace('v IN', f"'{v}' IN")} AS "Value Group" FROM coded""" for v in VALUES) + ")"

_GS_SQL = """gs AS (SELECT *, "Urgent" + "High" AS "Urgency", "Medium" AS "Routine",
  "Not Specified" + "Low" AS "Deferred" FROM coded)"""

_YG_SQL = 'yg AS (SELECT "Year", "Value Group", sum("Mentions") AS "Mentions" FROM molten GROUP BY 1, 2)'
_PRE_SQL = """pre AS (SELECT 'Paper ' || CAST(o_custkey AS VARCHAR) || '/' || CAST(y AS VARCHAR) AS "Title",
  make_date(CAST(y AS INTEGER) + 1, 1, 1) AS "Year" FROM p)"""

WITH_CODED = f"WITH {_P_SQL},\n{_CODED_SQL}\n"
WITH_MOLTEN = f"WITH {_P_SQL},\n{_CODED_SQL},\n{_MOLTEN_SQL}\n"
WITH_YG = f"WITH {_P_SQL},\n{_CODED_SQL},\n{_MOLTEN_SQL},\n{_YG_SQL}\n"
WITH_GS = f"WITH {_P_SQL},\n{_CODED_SQL},\n{_GS_SQL}\n"


def _corr_sql(cols: list[str], src: str, group: str = "") -> str:
    """Pairwise-complete Pearson correlation by the engine's own ``corr``; null where it is no number."""
    sel = []
    for x in cols:
        for y in cols:
            c = f'corr(CAST("{x}" AS DOUBLE), CAST("{y}" AS DOUBLE))'
            g = f"{group}, " if group else ""
            gb = f" GROUP BY {group}" if group else ""
            sel.append(f"SELECT {g}'{x}' AS a, '{y}' AS b, CASE WHEN isfinite({c}) THEN round({c}, 6) END AS corr "
                       f"FROM {src}{gb}")
    return "\n  UNION ALL ".join(sel)


def _cross_sql(left: list[str], right: list[str], src: str, group: str = "", a: str = "a", bb: str = "b",
               out: str = "cooc", extra: str = "") -> str:
    sel = []
    for x in left:
        for y in right:
            g = f"{group}, " if group else ""
            gb = f" GROUP BY {group}" if group else ""
            ex = extra.format(x=x, y=y)
            sel.append(f"""SELECT {g}'{x}' AS {a}, '{y}' AS {bb}, sum(CAST("{x}" AS DOUBLE) * CAST("{y}" AS DOUBLE))
    AS {out}{ex} FROM {src}{gb}""")
    return "\n  UNION ALL ".join(sel)


def _round(c: str, d: int = 6):
    return F.round(F.col(b(c)), d).alias(c)


# ---------------------------------------------------------------- the queries

@register("normalize_columns", f"WITH {_P_SQL}\nSELECT " + ", ".join(
    f"{e.replace(' as string', ' AS VARCHAR')} AS {q(nn)}"
    for (raw, e), nn in zip([rc for rc in RAW_COLUMNS if 'Spalte' not in rc[0]], NORMALISED)) + " FROM p")
def q_normalize_columns(spark, sf_dir):
    return C.normalize_columns(C.drop_marked_columns(survey_raw(spark, sf_dir), "Spalte"))


@register("coded_matrix", WITH_CODED + "SELECT * FROM coded")
def q_coded_matrix(spark, sf_dir):
    return coded(spark, sf_dir)


_RAW_ID = "'P' || CAST(o_custkey AS VARCHAR) || '-' || CAST(y AS VARCHAR)"


def raw_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The survey export before coding, trimmed and with clean names."""
    return C.normalize_columns(C.trim_strings(survey_raw(spark, sf_dir)))


@register("title_case_merge", f"""WITH {_P_SQL}
SELECT {_RAW_ID} AS "Id", CASE WHEN ({_TYPE_SQL}) IN ('Building/Analysis', 'Building/Review') THEN 'Building'
  ELSE {_TYPE_SQL} END AS "Type Of Paper" FROM p""")
def q_title_case_merge(spark, sf_dir):
    return raw_cells(spark, sf_dir).select("Id", C.title_case_merge("Type Of Paper", TYPE_MERGE).alias("Type Of Paper"))


@register("year_shift", f"""WITH {_P_SQL}
SELECT {_RAW_ID} AS "Id", make_date(CAST(y AS INTEGER) + 1, 1, 1) AS "Year" FROM p""")
def q_year_shift(spark, sf_dir):
    return raw_cells(spark, sf_dir).select("Id", year_start_shift("Year").alias("Year"))


@register("unpivot_values", WITH_MOLTEN + "SELECT * FROM molten")
def q_unpivot_values(spark, sf_dir):
    return molten(spark, sf_dir)


@register("group_mapping", WITH_MOLTEN + 'SELECT "Title", "Value", "Value Group" FROM molten')
def q_group_mapping(spark, sf_dir):
    return molten(spark, sf_dir).select("Title", "Value", "Value Group")


@register("family_sums", WITH_CODED + f'SELECT "Title", {_FAM_SQL} FROM coded')
def q_family_sums(spark, sf_dir):
    return with_families(coded(spark, sf_dir)).select("Title", *FAMILIES)


@register("sum_by_value", WITH_MOLTEN + """SELECT "Value", "Value Group", sum("Mentions") AS "Mentions"
FROM molten GROUP BY 1, 2""")
def q_sum_by_value(spark, sf_dir):
    return T.sum_by(molten(spark, sf_dir), ["Value", "Value Group"], "Mentions")


@register("sum_by_year", WITH_MOLTEN + 'SELECT "Year", sum("Mentions") AS "Mentions" FROM molten GROUP BY 1')
def q_sum_by_year(spark, sf_dir):
    return T.sum_by(molten(spark, sf_dir), ["Year"], "Mentions")


@register("sum_by_year_title_group", WITH_MOLTEN + """SELECT "Year", "Title", "Value Group", sum("Mentions") AS "Mentions"
FROM molten GROUP BY 1, 2, 3""")
def q_sum_by_year_title_group(spark, sf_dir):
    return T.sum_by(molten(spark, sf_dir), ["Year", "Title", "Value Group"], "Mentions")


@register("sum_by_year_group", WITH_YG + "SELECT * FROM yg")
def q_sum_by_year_group(spark, sf_dir):
    return by_year_group(spark, sf_dir)


_PPY_SQL = 'ppy AS (SELECT "Year", count("Title") AS "Papers" FROM coded GROUP BY 1)'


@register("papers_per_year", WITH_CODED + f", {_PPY_SQL} SELECT * FROM ppy")
def q_papers_per_year(spark, sf_dir):
    return T.count_by(coded(spark, sf_dir), "Year", "Title", "Papers")


@register("mentions_per_paper", WITH_YG + f""", {_PPY_SQL}
SELECT yg."Year", yg."Value Group", round(yg."Mentions" / ppy."Papers", 6) AS "Mentions"
FROM yg JOIN ppy ON yg."Year" = ppy."Year\"""")
def q_mentions_per_paper(spark, sf_dir):
    cd = coded(spark, sf_dir)
    ppy = T.count_by(cd, "Year", "Title", "Papers")
    return T.per_unit(by_year_group(spark, sf_dir, cd), ppy, "Year", "Mentions", "Papers") \
        .select("Year", "Value Group", _round("Mentions"))


@register("year_floor", WITH_CODED + f""", {_PRE_SQL}
SELECT "Title", "Year" FROM pre WHERE "Year" >= (SELECT min("Year") FROM coded)""")
def q_year_floor(spark, sf_dir):
    p = papers(spark, sf_dir)
    return T.at_least_min_of(prescreen(spark, sf_dir, p), "Year", coded(spark, sf_dir, p), "Year")


@register("period_split", WITH_YG + """, bound AS (SELECT CAST(max("Year") - INTERVAL 12 MONTH AS DATE) AS d FROM coded)
SELECT yg.*, 'complete' AS period FROM yg WHERE "Year" <= (SELECT d FROM bound)
UNION ALL SELECT yg.*, 'provisional' AS period FROM yg WHERE "Year" >= (SELECT d FROM bound)""")
def q_period_split(spark, sf_dir):
    cd = coded(spark, sf_dir)
    return T.period_split(by_year_group(spark, sf_dir, cd), "Year", cd, "Year")


@register("metric_use_by_year", WITH_CODED + """, fy AS (SELECT "Year", sum("Status F") AS s,
  sum("Status_O" + "Status P") AS o FROM coded GROUP BY 1)
SELECT "Year", 'Settled' AS "Metric Group", s AS "Mentions" FROM fy
UNION ALL SELECT "Year", 'Open' AS "Metric Group", o AS "Mentions" FROM fy""")
def q_metric_use_by_year(spark, sf_dir):
    sums = with_families(coded(spark, sf_dir)).groupBy("Year").agg(*[F.sum(f).alias(f) for f in FAMILIES])
    return C.unpivot(sums, ["Year"], list(FAMILIES), "Metric Group", "Mentions")


_TG_SQL = """tg AS (SELECT "Type Of Paper", "Value Group", sum("Mentions") AS m FROM molten
  WHERE "Mentions" > 0 GROUP BY 1, 2)"""


def type_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = molten(spark, sf_dir).filter(F.col("Mentions") > 0)
    return T.sum_by(m, ["Type Of Paper", "Value Group"], "Mentions")


@register("pivot_type_group", WITH_MOLTEN + f", {_TG_SQL}\nSELECT \"Type Of Paper\", " + ", ".join(
    f"sum(CASE WHEN \"Value Group\" = '{g}' THEN m END) AS \"{g}\"" for g in GROUP_NAMES)
    + " FROM tg GROUP BY 1")
def q_pivot_type_group(spark, sf_dir):
    return C.swap_pivot(type_group(spark, sf_dir), "Type Of Paper", "Value Group", "Mentions", GROUP_NAMES)


# The paper types of the stand-in after merging.
PAPER_TYPES = sorted(t for seg in ("Automobile", "Building", "Furniture", "Household", "Machinery")
                     for t in ([seg] if seg == "Building" else [seg, f"{seg}/Analysis", f"{seg}/Review"]))


@register("transpose_counts", WITH_MOLTEN + f", {_TG_SQL}\nSELECT \"Value Group\", " + ", ".join(
    f"sum(CASE WHEN \"Type Of Paper\" = '{t}' THEN m END) AS \"{t}\"" for t in PAPER_TYPES) + " FROM tg GROUP BY 1")
def q_transpose_counts(spark, sf_dir):
    return C.swap_pivot(type_group(spark, sf_dir), "Value Group", "Type Of Paper", "Mentions", PAPER_TYPES)


@register("share_by_type", WITH_MOLTEN + f", {_TG_SQL},\ntypes AS (SELECT DISTINCT \"Type Of Paper\" FROM tg),\n"
          + "grid AS (SELECT t.\"Type Of Paper\", g.\"Value Group\", coalesce(tg.m, 0) AS m FROM types t CROSS JOIN ("
          + " UNION ALL ".join(f"SELECT '{g}' AS \"Value Group\"" for g in GROUP_NAMES) + ") g "
          + "LEFT JOIN tg ON tg.\"Type Of Paper\" = t.\"Type Of Paper\" AND tg.\"Value Group\" = g.\"Value Group\")\n"
          + "SELECT \"Type Of Paper\", \"Value Group\", round(100.0 * m / sum(m) OVER (PARTITION BY \"Type Of Paper\"), 6)"
          + " AS share FROM grid")
def q_share_by_type(spark, sf_dir):
    wide = C.swap_pivot(type_group(spark, sf_dir), "Type Of Paper", "Value Group", "Mentions", GROUP_NAMES)
    long = C.unpivot(wide.na.fill(0.0, GROUP_NAMES), ["Type Of Paper"], GROUP_NAMES, "Value Group", "Mentions")
    return T.share_within(long, "Type Of Paper", "Mentions").select("Type Of Paper", "Value Group", _round("share"))


@register("columns_above_threshold", WITH_CODED + ", tot AS (" + " UNION ALL ".join(
    f"SELECT '{v}' AS \"column\", sum(\"{v}\") AS total FROM coded" for v in VALUES) + "),\nth AS ("
    + " UNION ALL ".join(f"SELECT CAST({float(t)} AS DOUBLE) AS threshold" for t in THRESHOLDS)
    + ")\nSELECT threshold, \"column\" FROM tot JOIN th ON total > threshold")
def q_columns_above_threshold(spark, sf_dir):
    return C.columns_above_threshold(coded(spark, sf_dir), VALUES, THRESHOLDS)


@register("corr_matrix", WITH_CODED + _corr_sql(VALUES, "coded"))
def q_corr_matrix(spark, sf_dir):
    return X.corr_long(coded(spark, sf_dir), VALUES).select("a", "b", _round("corr"))


# a wide matrix: values, metrics and their groups and families, some with missing cells and one constant
_WIDE_SQL = ("wide AS (SELECT *, CASE WHEN \"High\" = 1 THEN \"Urgent\" END AS \"Urgent If High\", 0.1 AS \"Constant\", "
             + '"Urgent" + "High" AS "Urgency", "Not Specified" + "Low" AS "Deferred", '
             + _FAM_SQL + " FROM coded)")
_WIDE_COLS = [*VALUES, *METRICS, "Hit-Rate", "Urgent If High", "Constant", "Urgency", "Deferred", *FAMILIES]


@register("corr_wide", WITH_CODED + ", " + _WIDE_SQL + "\n" + _corr_sql(_WIDE_COLS, "wide"))
def q_corr_wide(spark, sf_dir):
    wide = with_families(coded(spark, sf_dir)).withColumns({
        "Urgent If High": F.when(F.col("High") == 1, F.col("Urgent")), "Constant": F.lit(0.1),
        "Urgency": F.col("Urgent") + F.col("High"), "Deferred": F.col("`Not Specified`") + F.col("Low")})
    return X.corr_long(wide, _WIDE_COLS).select("a", "b", _round("corr"))


# 36 numbers of each document with missing cells and NaN, one of them constant
_GAPS = [f"g{i:02d}" for i in range(36)]


def _gap_cells(nan: str) -> list[str]:
    return [f"CASE WHEN (doc_id * 31 + {i * 7}) % 9 = 0 THEN NULL WHEN (doc_id * 17 + {i * 5}) % 23 = 0 THEN {nan} "
            + ("ELSE 0.1 END" if i == 20 else f"ELSE cast(n_chars * {i % 4} + (doc_id * {2 * i + 3}) % {50 + i} AS double) END")
            + f" AS {c}" for i, c in enumerate(_GAPS)]


@register("corr_missing", "WITH gaps AS MATERIALIZED (SELECT " + ", ".join(_gap_cells("NULL")) + " FROM documents)\n"
          + _corr_sql(_GAPS, "gaps"))
def q_corr_missing(spark, sf_dir):
    cells = table(spark, sf_dir, "documents").selectExpr(*_gap_cells("double('NaN')"))
    return X.corr_long(cells, _GAPS).select("a", "b", _round("corr"))


@register("corr_matrix_threshold", WITH_CODED + ", tot AS (" + " UNION ALL ".join(
    f"SELECT '{v}' AS c, sum(\"{v}\") AS total FROM coded" for v in VALUES) + "),\nth AS ("
    + " UNION ALL ".join(f"SELECT CAST({float(t)} AS DOUBLE) AS threshold" for t in THRESHOLDS) + "),\ncm AS ("
    + _corr_sql(VALUES, "coded") + ")\n"
    + "SELECT th.threshold, cm.a, cm.b, cm.corr FROM cm JOIN tot ta ON cm.a = ta.c JOIN tot tb ON cm.b = tb.c "
    + "JOIN th ON ta.total > th.threshold AND tb.total > th.threshold")
def q_corr_matrix_threshold(spark, sf_dir):
    cd = coded(spark, sf_dir)
    keep = C.columns_above_threshold(cd, VALUES, THRESHOLDS, name="column")
    cm = X.corr_long(cd, VALUES).select("a", "b", _round("corr"))
    ka = keep.select(F.col("threshold"), F.col("column").alias("a"))
    kb = keep.select(F.col("threshold").alias("t2"), F.col("column").alias("b"))
    j = cm.join(ka, "a").join(kb, "b").filter(F.col("threshold") == F.col("t2"))
    return j.select("threshold", "a", "b", "corr")


@register("corr_by_year", WITH_CODED + _corr_sql(VALUES, "coded", group='"Year"'))
def q_corr_by_year(spark, sf_dir):
    return X.corr_long(coded(spark, sf_dir), VALUES, group=["Year"]).select("Year", "a", "b", _round("corr"))


_GM_COLS = GROUP_NAMES + list(FAMILIES)


@register("group_metric_corr", WITH_CODED + """, gm AS (SELECT "Title",
  CAST(greatest("Urgent", "High") AS DOUBLE) AS "Urgency", CAST("Medium" AS DOUBLE) AS "Routine",
  CAST(greatest("Not Specified", "Low") AS DOUBLE) AS "Deferred", """ + _FAM_SQL + """ FROM coded)
""" + _corr_sql(_GM_COLS, "gm"))
def q_group_metric_corr(spark, sf_dir):
    cd = with_families(coded(spark, sf_dir))
    per_paper = cd.select("Title", *[F.greatest(*[F.col(b(c)) for c in cols]).cast("double").alias(g)
                                     if len(cols) > 1 else F.col(b(cols[0])).cast("double").alias(g)
                                     for g, cols in GROUPS.items()], *FAMILIES)
    return X.corr_long(per_paper, _GM_COLS).select("a", "b", _round("corr"))


_COOC_SQL = ("cy AS (" + _cross_sql(GROUP_NAMES, GROUP_NAMES, "gs", group='"Year"', a='"Value Group"',
                                     bb='"Complement"', out='"Cooc"') + ")")


def cooc_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.cross_products(group_sums(coded(spark, sf_dir)), GROUP_NAMES, GROUP_NAMES, group=["Year"],
                            a="Value Group", b="Complement", out="Cooc")


@register("cooccurrence_by_year", WITH_GS + ", " + _COOC_SQL + "\nSELECT * FROM cy")
def q_cooccurrence_by_year(spark, sf_dir):
    return cooc_by_year(spark, sf_dir)


@register("pairwise_long", WITH_GS + ", " + _COOC_SQL + """
SELECT *, "Value Group" || ' - ' || "Complement" AS "Combination" FROM cy WHERE "Value Group" <> "Complement\"""")
def q_pairwise_long(spark, sf_dir):
    c = cooc_by_year(spark, sf_dir).filter(F.col("Value Group") != F.col("Complement"))
    return c.withColumn("Combination", X.pair_label("Value Group", "Complement"))


# open groups: a customer's orders name their day and clerk-like codes; hundreds of groups, some held by a third of all
_OPEN_GROUPS = ("SELECT o_custkey AS r, 'day' || cast(o_orderkey % 300 AS string) AS g FROM orders UNION ALL "
                "SELECT o_custkey AS r, 'pri' || substr(o_orderpriority, 1, 1) AS g FROM orders UNION ALL "
                "SELECT o_custkey AS r, 'price' || cast(cast(floor(o_totalprice / 1000) AS int) AS string) AS g FROM orders")


@register("shared_rows_open", f"""WITH l AS (SELECT DISTINCT r, g FROM ({_OPEN_GROUPS}) WHERE r IS NOT NULL AND g IS NOT NULL)
SELECT x.g AS a, y.g AS b, count(*) AS n FROM l x JOIN l y ON x.r = y.r GROUP BY 1, 2""")
def q_shared_rows_open(spark, sf_dir):
    """Co-occurrence of groups that are listed nowhere, over customers."""
    o = table(spark, sf_dir, "orders")
    parts = [o.selectExpr("o_custkey AS r", "'day' || cast(o_orderkey % 300 AS string) AS g"),
             o.selectExpr("o_custkey AS r", "'pri' || substr(o_orderpriority, 1, 1) AS g"),
             o.selectExpr("o_custkey AS r", "'price' || cast(cast(floor(o_totalprice / 1000) AS int) AS string) AS g")]
    return X.shared_rows(parts[0].unionByName(parts[1]).unionByName(parts[2]), "r", "g", frequent=64)


_CROSS_SQL = ("vm AS (" + _cross_sql(VALUES, METRICS, "coded", a='"Value"', bb='"Metric"', out='"Cooc"',
                                      extra=', sum("{x}") AS vt, sum("{y}") AS mt') + ")")


def cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.cross_products(coded(spark, sf_dir), VALUES, METRICS, a="Value", b="Metric", out="Cooc", totals=True)


@register("cooccurrence_cross", WITH_CODED + ", " + _CROSS_SQL + '\nSELECT "Value", "Metric", "Cooc" FROM vm')
def q_cooccurrence_cross(spark, sf_dir):
    return cross(spark, sf_dir).select("Value", "Metric", "Cooc")


@register("cooccurrence_norm_value", WITH_CODED + ", " + _CROSS_SQL
          + '\nSELECT "Value", "Metric", round(CASE WHEN vt <> 0 THEN "Cooc" / vt END, 6) AS "Normed" FROM vm')
def q_cooccurrence_norm_value(spark, sf_dir):
    n = X.normalise_by(cross(spark, sf_dir), "Cooc", "Value_total", "Normed")
    return n.select("Value", "Metric", _round("Normed"))


@register("cooccurrence_norm_metric", WITH_CODED + ", " + _CROSS_SQL
          + '\nSELECT "Value", "Metric", round(CASE WHEN mt <> 0 THEN "Cooc" / mt END, 6) AS "Normed" FROM vm')
def q_cooccurrence_norm_metric(spark, sf_dir):
    n = X.normalise_by(cross(spark, sf_dir), "Cooc", "Metric_total", "Normed")
    return n.select("Value", "Metric", _round("Normed"))


# the moving average by its recurrence: both sums fade by 0.5^(gap/h) from row to row
_EWMA_SQL = f"""steps AS (SELECT "Year", "Value Group", "Mentions",
    row_number() OVER (PARTITION BY "Value Group" ORDER BY "Year") AS k,
    date_diff('day', lag("Year") OVER (PARTITION BY "Value Group" ORDER BY "Year"), "Year") AS gap FROM yg),
walk AS (SELECT "Year", "Value Group", "Mentions", k, CAST("Mentions" AS DOUBLE) AS top, CAST(1 AS DOUBLE) AS bottom
    FROM steps WHERE k = 1
  UNION ALL SELECT s."Year", s."Value Group", s."Mentions", s.k,
    w.top * pow(0.5, s.gap / {HALFLIFE_DAYS!r}) + s."Mentions", w.bottom * pow(0.5, s.gap / {HALFLIFE_DAYS!r}) + 1
    FROM walk w JOIN steps s ON s."Value Group" = w."Value Group" AND s.k = w.k + 1),
ew AS (SELECT "Year", "Value Group", "Mentions", top / bottom AS "Rolling" FROM walk)"""


def rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.ewma(by_year_group(spark, sf_dir), ["Value Group"], "Year", "Mentions", HALFLIFE_DAYS, out="Rolling")


@register("ewma", WITH_YG.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _EWMA_SQL
          + '\nSELECT "Year", "Value Group", "Mentions", round("Rolling", 6) AS "Rolling" FROM ew')
def q_ewma(spark, sf_dir):
    return rolling(spark, sf_dir).select("Year", "Value Group", "Mentions", _round("Rolling"))


@register("ewma_mean", WITH_YG.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _EWMA_SQL
          + '\nSELECT "Year", round(avg("Rolling"), 6) AS "Rolling" FROM ew GROUP BY 1')
def q_ewma_mean(spark, sf_dir):
    return rolling(spark, sf_dir).groupBy("Year").agg(F.round(F.avg("Rolling"), 6).alias("Rolling"))


# a series of documents: sources of very different size, several documents a day, missing values
_SERIES_HALFLIFE = 365
_SERIES = ["doc_id", "source", "{day} AS day", "CASE WHEN doc_id % 7 <> 3 THEN cast(n_chars AS double) END AS x"]


@register("ewma_documents", "WITH s AS (SELECT " + ", ".join(_SERIES).format(day="DATE '2015-01-01' + CAST(doc_id * 37 % 3000 AS INTEGER)")
          + f""" FROM documents), w AS (SELECT *, pow(2.0, date_diff('day', DATE '2015-01-01', day) / {_SERIES_HALFLIFE}.0) AS w FROM s)
SELECT doc_id, source, round(sum(x * w) OVER f / sum(CASE WHEN x IS NOT NULL THEN w END) OVER f, 4) AS rolling FROM w
WINDOW f AS (PARTITION BY source ORDER BY day, doc_id ROWS UNBOUNDED PRECEDING)""")
def q_ewma_documents(spark, sf_dir):
    series = table(spark, sf_dir, "documents").selectExpr(
        *[e.format(day="date_add(DATE'2015-01-01', cast(doc_id * 37 % 3000 AS int))") for e in _SERIES])
    out = T.ewma(series, ["source"], "day", "x", _SERIES_HALFLIFE, order=["doc_id"])
    return out.select("doc_id", "source", _round("rolling", 4))


@register("year_proportion", WITH_CODED + f", {_PRE_SQL}, {_PPY_SQL},\n"
          + """pf AS (SELECT "Year", count("Title") AS n FROM pre WHERE "Year" >= (SELECT min("Year") FROM coded)
  GROUP BY 1)
SELECT coalesce(ppy."Year", pf."Year") AS "Year", round(ppy."Papers" / pf.n * 100, 6) AS "Proportion"
FROM ppy FULL OUTER JOIN pf ON ppy."Year" = pf."Year\"""")
def q_year_proportion(spark, sf_dir):
    p = papers(spark, sf_dir)
    cd = coded(spark, sf_dir, p)
    post = T.count_by(cd, "Year", "Title", "Papers")
    pre = T.count_by(T.at_least_min_of(prescreen(spark, sf_dir, p), "Year", cd, "Year"), "Year", "Title", "Pre")
    return T.aligned_ratio(post, pre, "Year", "Papers", "Pre", "Proportion").select("Year", _round("Proportion"))


_EXPL_SQL = """ex AS (SELECT "Year", "Title", unnest(CASE WHEN "Diversity-Type" IS NULL THEN [NULL]
  ELSE string_split("Diversity-Type", ',') END) AS "Diversity-Type" FROM coded)"""


def exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.explode_list(coded(spark, sf_dir).select("Year", "Title", "Diversity-Type"), "Diversity-Type")


@register("exploded_by_year", WITH_CODED + ", " + _EXPL_SQL + """
SELECT "Year", "Diversity-Type", count("Title") AS "count" FROM ex WHERE "Diversity-Type" IS NOT NULL GROUP BY 1, 2""")
def q_exploded_by_year(spark, sf_dir):
    return C.counts_by(exploded(spark, sf_dir), ["Year", "Diversity-Type"], "Title")


@register("frequent_categories", WITH_CODED + ", " + _EXPL_SQL + """
SELECT "Diversity-Type", count(*) AS "count" FROM ex WHERE "Diversity-Type" IS NOT NULL GROUP BY 1
HAVING count(*) > 1""")
def q_frequent_categories(spark, sf_dir):
    return C.frequent_categories(exploded(spark, sf_dir), "Diversity-Type", 1, strict=True)


@register("rare_to_other", WITH_CODED + ", " + _EXPL_SQL + f""", cnt AS (SELECT "Diversity-Type" AS c, count(*) AS n
  FROM ex WHERE "Diversity-Type" IS NOT NULL GROUP BY 1)
SELECT "Title", "Year", CASE WHEN cnt.n < {RARE_FLOOR} THEN 'Other' ELSE "Diversity-Type" END AS "Diversity-Type"
FROM ex LEFT JOIN cnt ON ex."Diversity-Type" = cnt.c""")
def q_rare_to_other(spark, sf_dir):
    return C.rare_to_other(exploded(spark, sf_dir), "Diversity-Type", RARE_FLOOR).select(
        "Title", "Year", "Diversity-Type")


@register("type_counts", WITH_CODED + """SELECT "Type Of Paper", count(*) AS "count" FROM coded
WHERE "Type Of Paper" IS NOT NULL GROUP BY 1""")
def q_type_counts(spark, sf_dir):
    from insight.operators.events import value_counts
    return value_counts(coded(spark, sf_dir), "Type Of Paper")


@register("platform_counts", WITH_CODED + """SELECT "Platform", count(*) AS "count" FROM coded
WHERE "Platform" IS NOT NULL GROUP BY 1""")
def q_platform_counts(spark, sf_dir):
    from insight.operators.events import value_counts
    return value_counts(coded(spark, sf_dir), "Platform")
