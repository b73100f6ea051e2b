"""Nested-article queries on the ``nested`` stand-in.

One enriched article per document, built row by row: every paragraph of the
text (split on newlines, whole text) yields one external topic, category,
media topic, named entity and image person.  Nothing is grouped, so no
article is ever gathered from many rows.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from insight.operators import nested as N
from insight.operators import variants as V
from insight.plans.registry import register
from insight.plans.views import landed, table
from insight.session import scratch_path
from insight.sources.files import scan_json
from insight.sources.sinks import write_json

# Keys of the fixed-set score maps (prefix -> (map path, keys)).
USERNEED_KEYS = ["update_me", "educate_me", "give_me_perspective", "divert_me"]
TOPIC_KEYS = ["politics", "sports", "culture"]
SENSITIVE_KEYS = ["adult_content", "violence"]
SCORE_SETS = {
    "userneed_": ("enrichments.userneeds.scores", USERNEED_KEYS),
    "topic_": ("enrichments.ci_topics_v2", TOPIC_KEYS),
    "sensitive_topic_": ("enrichments.garm.categories", SENSITIVE_KEYS),
}
PERSON_FIELDS = ["age", "race", "gender"]

# paragraphs and part counts of the whole text, computed once per row in a
# projection below the struct builder (split sizes measured faster than
# replace / translate / regexp_count for counting)
_SPLITS = ["split(text, '\\n') AS __lines", "size(split(text, ' ')) AS __n_words",
           "size(split(text, '\\\\. ')) AS __n_sentences"]
_LINES = "__lines"
_N_LINES = "size(__lines)"
_N_WORDS = "__n_words"
_N_SENTENCES = "__n_sentences"
_NESTED_SQL = f"""named_struct(
  'brand', source,
  'title', 'Article ' || cast(doc_id as string),
  'text_cleaned', text,
  'authors', array(source, upper(lang)),
  'url', CASE WHEN lang = 'es' THEN NULL ELSE 'https://news.example/' || cast(doc_id as string) END,
  'section', named_struct('main_section', source, 'sub_section', CASE WHEN lang = 'en' THEN NULL ELSE lang END),
  'first_publication_ts', '2024-01-' || lpad(cast(doc_id % 28 + 1 as string), 2, '0') || 'T08:'
      || lpad(cast(doc_id % 60 as string), 2, '0') || ':00',
  'categories', array(lang, source),
  'source_keywords', array('kw' || cast(doc_id % 5 as string), 'kw' || cast(doc_id % 7 as string)),
  'published', n_chars > 200,
  'paywall', lang = 'de',
  'enrichments', named_struct(
    'num_words', cast({_N_WORDS} as int),
    'num_sentences', cast({_N_SENTENCES} as int),
    'raw_character_count', n_chars,
    'brand_safety', named_struct('is_brandsafe', lang <> 'es', 'confidence', cast(n_chars % 100 as double) / 100),
    'topics', transform({_LINES}, (l, i) -> named_struct('label', lang || '-' || cast(i as string),
        'id', cast(i as bigint), 'score', cast(length(l) as double),
        'wikiLink', 'https://wiki.example/' || cast(i as string), 'wikidataId', 'Q' || cast(i + 1 as string))),
    'categories', transform({_LINES}, (l, i) -> named_struct('label', source,
        'score', cast(length(l) as double) / 100, 'categoryId', 'c' || cast(i as string),
        'classifierId', 'clf-' || lang)),
    'semantics', named_struct(
      'media_topic_inquiry_results', transform({_LINES}, (l, i) -> named_struct(
          'media_topic', named_struct('id', 'mt' || cast(i as string), 'name', lang || '/' || source),
          'score', cast(length(l) as double), 'enabled', length(l) > 0)),
      'named_entity_inquiry_results', transform({_LINES}, (l, i) -> named_struct(
          'named_entity', CASE WHEN length(l) = 0 THEN NULL
              ELSE named_struct('name', source, 'type', lang) END,
          'score', cast(i as double), 'saliency', cast(length(l) as double) / 1000,
          'mentions', array(named_struct('begin', 0, 'end', length(l)), named_struct('begin', i, 'end', i + 1))))),
    'userneeds', named_struct('scores', map_filter(map(
        'update_me', cast({_N_LINES} as double) / 10,
        'educate_me', cast(n_chars as double) / 10000,
        'give_me_perspective', cast({_N_WORDS} as double) / 1000,
        'divert_me', CASE WHEN lang = 'fr' THEN NULL WHEN lang = 'en' THEN 0.5 ELSE 0.25 END), (k, v) -> v IS NOT NULL)),
    'ci_topics_v2', map_filter(map(
        'politics', cast(n_chars % 7 as double) / 7, 'sports', cast(n_chars % 11 as double) / 11,
        'culture', cast(n_chars % 13 as double) / 13,
        'misc', CASE WHEN lang = 'es' THEN 1.0 END), (k, v) -> v IS NOT NULL),
    'garm', named_struct('categories', map('adult_content', cast(n_chars % 3 as double) / 3,
        'violence', cast(n_chars % 5 as double) / 5)),
    'image_persons', CASE WHEN {_N_LINES} = 1 THEN NULL ELSE transform({_LINES}, (l, i) -> named_struct(
        'age', cast(20 + i * 5 as string), 'race', 'r' || cast(i % 3 as string),
        'gender', CASE WHEN i % 2 = 0 THEN 'f' ELSE 'm' END)) END))"""


def build_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw enriched articles (nested) from documents."""
    docs = table(spark, sf_dir, "documents").selectExpr("*", *_SPLITS)
    return docs.selectExpr(
        "cast(doc_id as string) AS article_id", "'cds-' || cast(doc_id as string) AS cds_content_id",
        "CASE WHEN n_chars > 1000 THEN 'True' ELSE 'False' END AS new_article",
        f"{_NESTED_SQL} AS enriched_article")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The enriched articles as a landed Parquet table: nested documents are
    written once (per source file version and session) and read back, so each
    query reads only the nested fields it uses (Parquet nested-column
    pruning) instead of rebuilding every child list of every article."""
    return landed(spark, sf_dir, ["documents"], "articles", build_articles)


def article_schema(spark: SparkSession, sf_dir: str) -> T.StructType:
    """The declared schema of the raw article (from the builder's plan -- no data pass)."""
    return build_articles(spark, sf_dir).schema


# ----------------------------------------------------------------- DuckDB side

_DOCS = "documents"
_PARA = f"""para AS (SELECT doc_id, lang, source, n_chars, unnest(string_split(text, chr(10))) AS l,
  unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS i FROM {_DOCS})
"""


@register("scan_nested_articles", """SELECT CAST(doc_id AS VARCHAR) AS article_id, source AS brand,
  n_chars > 200 AS published, CAST(len(string_split(text, chr(10))) AS INTEGER) AS n_topics FROM documents""")
def q_scan_nested_articles(spark, sf_dir):
    raw = build_articles(spark, sf_dir)
    path = scratch_path(spark, "articles-json")
    write_json(raw, path)
    back = scan_json(spark, path, raw.schema)
    return back.select("article_id", F.col("enriched_article.brand").alias("brand"),
                       F.col("enriched_article.published").alias("published"),
                       F.size("enriched_article.enrichments.topics").alias("n_topics"))


@register("article_flatten", """SELECT CAST(doc_id AS VARCHAR) AS article_id, 'cds-' || CAST(doc_id AS VARCHAR)
  AS cds_content_id, source AS brands, 'Article ' || CAST(doc_id AS VARCHAR) AS title, text,
  source || '|' || upper(lang) AS authors,
  CASE WHEN lang = 'es' THEN '' ELSE 'https://news.example/' || CAST(doc_id AS VARCHAR) END AS url,
  source AS main_section, CASE WHEN lang = 'en' THEN '' ELSE lang END AS sub_section,
  CAST(len(string_split(text, ' ')) AS INTEGER) AS num_words,
  CAST(len(string_split(text, '. ')) AS INTEGER) AS num_sentences, n_chars AS num_chars,
  make_timestamp(2024, 1, CAST(doc_id % 28 + 1 AS BIGINT), 8, CAST(doc_id % 60 AS BIGINT), 0)
    AS first_publication_timestamp,
  lang || '|' || source AS categories_generated,
  'kw' || CAST(doc_id % 5 AS VARCHAR) || '|kw' || CAST(doc_id % 7 AS VARCHAR) AS keywords_curated,
  lang <> 'es' AS brand_safety_is_brandsafe, CAST(n_chars % 100 AS DOUBLE) / 100 AS brand_safety_confidence
FROM documents""")
def q_article_flatten(spark, sf_dir):
    return N.article_table(articles(spark, sf_dir))


@register("flatten_struct", """SELECT CAST(doc_id AS VARCHAR) AS article_id, source AS meta_section_main_section,
  CASE WHEN lang = 'en' THEN NULL ELSE lang END AS meta_section_sub_section,
  lang <> 'es' AS meta_brand_safety_is_brandsafe, CAST(n_chars % 100 AS DOUBLE) / 100 AS meta_brand_safety_confidence,
  n_chars AS meta_counts_raw_character_count FROM documents""")
def q_flatten_struct(spark, sf_dir):
    a = articles(spark, sf_dir)
    e = "enriched_article"
    meta = F.struct(F.col(f"{e}.section").alias("section"),
                    F.col(f"{e}.enrichments.brand_safety").alias("brand_safety"),
                    F.struct(F.col(f"{e}.enrichments.raw_character_count").alias("raw_character_count"))
                    .alias("counts"))
    return N.flatten_struct(a.select("article_id", meta.alias("meta")))


@register("first_element", """SELECT CAST(doc_id AS VARCHAR) AS article_id,
  CASE WHEN len(string_split(text, chr(10))) > 1 THEN '20' END AS imgperson_age,
  CASE WHEN len(string_split(text, chr(10))) > 1 THEN 'r0' END AS imgperson_race,
  CASE WHEN len(string_split(text, chr(10))) > 1 THEN 'f' END AS imgperson_gender FROM documents""")
def q_first_element(spark, sf_dir):
    a = articles(spark, sf_dir).select("article_id", N.first_element("enriched_article.enrichments.image_persons")
                                       .alias("imgperson"))
    return N.flatten_struct(a)


_USERNEED_SQL = """CAST(len(string_split(text, chr(10))) AS DOUBLE) / 10 AS userneed_update_me,
  CAST(n_chars AS DOUBLE) / 10000 AS userneed_educate_me,
  CAST(len(string_split(text, ' ')) AS DOUBLE) / 1000 AS userneed_give_me_perspective,
  CAST(CASE WHEN lang = 'fr' THEN NULL WHEN lang = 'en' THEN 0.5 ELSE 0.25 END AS DOUBLE) AS userneed_divert_me"""


@register("map_to_columns", f"""SELECT CAST(doc_id AS VARCHAR) AS article_id, {_USERNEED_SQL},
  CAST(n_chars % 7 AS DOUBLE) / 7 AS topic_politics, CAST(n_chars % 11 AS DOUBLE) / 11 AS topic_sports,
  CAST(n_chars % 13 AS DOUBLE) / 13 AS topic_culture,
  CASE WHEN lang = 'es' THEN CAST(1.0 AS DOUBLE) END AS topic_misc,
  CAST(n_chars % 3 AS DOUBLE) / 3 AS sensitive_topic_adult_content,
  CAST(n_chars % 5 AS DOUBLE) / 5 AS sensitive_topic_violence FROM documents""")
def q_map_to_columns(spark, sf_dir):
    # topics are an open key set: every key present becomes a column
    sets = {**SCORE_SETS, "topic_": (SCORE_SETS["topic_"][0], None)}
    return N.score_tables(articles(spark, sf_dir), sets)


@register("contract_columns", f"""SELECT article_id, array_to_string(list_transform([userneed_update_me,
  userneed_educate_me, userneed_give_me_perspective, userneed_divert_me],
  lambda v: CASE WHEN v IS NULL THEN 'NA' ELSE printf('%.6f', v) END), ', ') AS userneed_values,
  'userneed_update_me, userneed_educate_me, userneed_give_me_perspective, userneed_divert_me' AS userneed_names
FROM (SELECT CAST(doc_id AS VARCHAR) AS article_id, {_USERNEED_SQL} FROM documents)""")
def q_contract_columns(spark, sf_dir):
    wide = N.score_tables(articles(spark, sf_dir), {"userneed_": SCORE_SETS["userneed_"]})
    cols = [f"userneed_{k}" for k in USERNEED_KEYS]
    values, names = N.contract(cols)
    # presented as text, as the reference writes it to a flat file
    text = F.transform(values, lambda v: F.when(v.isNull(), F.lit("NA")).otherwise(F.format_string("%.6f", v)))
    return wide.select("article_id", F.array_join(text, ", ").alias("userneed_values"),
                       names.alias("userneed_names"))


@register("filter_published", """SELECT CAST(doc_id AS VARCHAR) AS article_id FROM documents
WHERE n_chars > 200 AND NOT (lang = 'de')""")
def q_filter_published(spark, sf_dir):
    a = articles(spark, sf_dir)
    e = "enriched_article"
    return a.filter(F.col(f"{e}.published") & ~F.col(f"{e}.paywall")).select("article_id")


@register("filter_nonempty_array", """SELECT CAST(doc_id AS VARCHAR) AS article_id,
  CAST(len(string_split(text, chr(10))) AS INTEGER) AS n_persons FROM documents
WHERE len(string_split(text, chr(10))) > 1""")
def q_filter_nonempty_array(spark, sf_dir):
    arr = F.col("enriched_article.enrichments.image_persons")
    return articles(spark, sf_dir).filter(N.nonempty(arr)).select("article_id", F.size(arr).alias("n_persons"))


@register("explode_external_topics", "WITH " + _PARA + """SELECT CAST(doc_id AS VARCHAR) AS article_id,
  lang || '-' || CAST(i AS VARCHAR) AS label, CAST(i AS BIGINT) AS id, CAST(length(l) AS DOUBLE) AS score,
  'Q' || CAST(i + 1 AS VARCHAR) AS wikidataId FROM para""")
def q_explode_external_topics(spark, sf_dir):
    return N.explode_children(articles(spark, sf_dir), ["article_id"], "enriched_article.enrichments.topics",
                              drop=["wikiLink"])


@register("explode_internal_topics", "WITH " + _PARA + """SELECT CAST(doc_id AS VARCHAR) AS article_id,
  'mt' || CAST(i AS VARCHAR) AS id, lang || '/' || source AS name, CAST(length(l) AS DOUBLE) AS score FROM para""")
def q_explode_internal_topics(spark, sf_dir):
    a = articles(spark, sf_dir).select(
        "article_id", F.explode("enriched_article.enrichments.semantics.media_topic_inquiry_results").alias("t"))
    return a.select("article_id", "t.media_topic.*", "t.score")


@register("entity_mentions", "WITH " + _PARA + """SELECT CAST(doc_id AS VARCHAR) AS article_id,
  '0-' || CAST(length(l) AS VARCHAR) || ',' || CAST(i AS VARCHAR) || '-' || CAST(i + 1 AS VARCHAR) AS mentions,
  CASE WHEN length(l) = 0 THEN NULL ELSE source END AS name, CASE WHEN length(l) = 0 THEN NULL ELSE lang END AS type,
  CAST(i AS DOUBLE) AS score, CAST(length(l) AS DOUBLE) / 1000 AS saliency FROM para""")
def q_entity_mentions(spark, sf_dir):
    a = articles(spark, sf_dir).select(
        "article_id", F.explode("enriched_article.enrichments.semantics.named_entity_inquiry_results").alias("e"))
    return a.select("article_id", N.offsets_text("e.mentions").alias("mentions"),
                    F.col("e.named_entity.name").alias("name"), F.col("e.named_entity.type").alias("type"),
                    F.col("e.score").alias("score"), F.col("e.saliency").alias("saliency"))


@register("explode_categories", "WITH " + _PARA + """SELECT CAST(doc_id AS VARCHAR) AS article_id,
  source AS label, CAST(length(l) AS DOUBLE) / 100 AS score, 'c' || CAST(i AS VARCHAR) AS categoryId FROM para""")
def q_explode_categories(spark, sf_dir):
    return N.explode_children(articles(spark, sf_dir), ["article_id"], "enriched_article.enrichments.categories",
                              drop=["classifierId"])


@register("parallel_arrays", """SELECT CAST(doc_id AS VARCHAR) AS article_id, 'Article ' || CAST(doc_id AS VARCHAR)
  AS title, CASE WHEN lang = 'es' THEN NULL ELSE 'https://news.example/' || CAST(doc_id AS VARCHAR) END AS url,
  array_to_string(list_transform(generate_series(0, len(string_split(text, chr(10))) - 1),
    lambda i: CAST(20 + i * 5 AS VARCHAR)), '|') AS imgperson_age,
  array_to_string(list_transform(generate_series(0, len(string_split(text, chr(10))) - 1),
    lambda i: 'r' || CAST(i % 3 AS VARCHAR)), '|') AS imgperson_race,
  array_to_string(list_transform(generate_series(0, len(string_split(text, chr(10))) - 1),
    lambda i: CASE WHEN i % 2 = 0 THEN 'f' ELSE 'm' END), '|') AS imgperson_gender
FROM documents WHERE n_chars > 200 AND NOT (lang = 'de') AND len(string_split(text, chr(10))) > 1""")
def q_parallel_arrays(spark, sf_dir):
    e = "enriched_article"
    a = articles(spark, sf_dir)
    persons = F.col(f"{e}.enrichments.image_persons")
    kept = a.filter(F.col(f"{e}.published") & ~F.col(f"{e}.paywall") & N.nonempty(persons))
    arrays = N.parallel_arrays(persons, PERSON_FIELDS, "imgperson_")
    # presented as text, as the reference writes the review table to a flat file
    return kept.select("article_id", F.col(f"{e}.title").alias("title"), F.col(f"{e}.url").alias("url"),
                       *[F.array_join(c, "|").alias(f"imgperson_{f}") for c, f in zip(arrays, PERSON_FIELDS)])


def _lists_sql(parts: dict[str, str]) -> str:
    """Lists of one value a paragraph, as text."""
    lists = ",\n  ".join(f"array_to_string(list({e} ORDER BY i), '|') AS {n}" for n, e in parts.items())
    return "WITH " + _PARA + f"SELECT CAST(doc_id AS VARCHAR) AS article_id,\n  {lists}\nFROM para GROUP BY doc_id"


def _lists(spark, sf_dir, array, fields, prefix):
    columns = N.parallel_arrays(array, fields, prefix)
    text = [F.array_join(F.transform(c, lambda v: F.coalesce(v.cast("string"), F.lit("NA"))), "|").alias(f"{prefix}{f}")
            for c, f in zip(columns, fields)]
    return articles(spark, sf_dir).select("article_id", *text)


_E = "enriched_article.enrichments"
_S = f"{_E}.semantics"


@register("parallel_topics", _lists_sql({
    "topic_label": "lang || '-' || CAST(i AS VARCHAR)", "topic_id": "CAST(i AS VARCHAR)",
    "topic_score": "CAST(length(l) AS VARCHAR) || '.0'", "topic_wikiLink": "'https://wiki.example/' || CAST(i AS VARCHAR)",
    "topic_wikidataId": "'Q' || CAST(i + 1 AS VARCHAR)"}))
def q_parallel_topics(spark, sf_dir):
    return _lists(spark, sf_dir, F.col(f"{_E}.topics"), ["label", "id", "score", "wikiLink", "wikidataId"], "topic_")


@register("parallel_categories", _lists_sql({
    "category_label": "source", "category_score": "printf('%.6f', CAST(length(l) AS DOUBLE) / 100)",
    "category_categoryId": "'c' || CAST(i AS VARCHAR)", "category_classifierId": "'clf-' || lang"}))
def q_parallel_categories(spark, sf_dir):
    rows = F.transform(F.col(f"{_E}.categories"), lambda c: F.struct(
        c["label"].alias("label"), F.format_string("%.6f", c["score"]).alias("score"), c["categoryId"].alias("categoryId"),
        c["classifierId"].alias("classifierId")))
    return _lists(spark, sf_dir, rows, ["label", "score", "categoryId", "classifierId"], "category_")


@register("parallel_media_topics", _lists_sql({
    "media_id": "'mt' || CAST(i AS VARCHAR)", "media_name": "lang || '/' || source",
    "media_score": "CAST(length(l) AS VARCHAR) || '.0'", "media_enabled": "CAST(length(l) > 0 AS VARCHAR)"}))
def q_parallel_media_topics(spark, sf_dir):
    rows = F.transform(F.col(f"{_S}.media_topic_inquiry_results"), lambda t: F.struct(
        t["media_topic"]["id"].alias("id"), t["media_topic"]["name"].alias("name"), t["score"].alias("score"),
        t["enabled"].alias("enabled")))
    return _lists(spark, sf_dir, rows, ["id", "name", "score", "enabled"], "media_")


@register("parallel_entities", _lists_sql({
    "entity_name": "CASE WHEN length(l) = 0 THEN 'NA' ELSE source END",
    "entity_type": "CASE WHEN length(l) = 0 THEN 'NA' ELSE lang END", "entity_score": "CAST(i AS VARCHAR) || '.0'",
    "entity_saliency": "printf('%.6f', CAST(length(l) AS DOUBLE) / 1000)",
    "entity_mentions": "'0-' || CAST(length(l) AS VARCHAR) || ',' || CAST(i AS VARCHAR) || '-' || CAST(i + 1 AS VARCHAR)"}))
def q_parallel_entities(spark, sf_dir):
    rows = F.transform(F.col(f"{_S}.named_entity_inquiry_results"), lambda e: F.struct(
        e["named_entity"]["name"].alias("name"), e["named_entity"]["type"].alias("type"), e["score"].alias("score"),
        F.format_string("%.6f", e["saliency"]).alias("saliency"), N.offsets_text(e["mentions"]).alias("mentions")))
    return _lists(spark, sf_dir, rows, ["name", "type", "score", "saliency", "mentions"], "entity_")


@register("new_articles", """SELECT CAST(doc_id AS VARCHAR) AS article_id, 'Article ' || CAST(doc_id AS VARCHAR) AS title
FROM documents WHERE n_chars > 1000""")
def q_new_articles(spark, sf_dir):
    return N.article_table(articles(spark, sf_dir), new_only=True).select("article_id", "title")


# JSON lines with keys that depend on the row: no schema could name them all
_OPEN_JSON = ("'{\"id\": ' || cast(doc_id as string) || ', \"k' || cast(doc_id % 40 as string) || '\": {\"n\": ' || cast(n_chars as string) "
              "|| ', \"lang_' || coalesce(lang, 'none') || '\": [' || cast(doc_id % 3 as string) || ', {\"deep' || cast(doc_id % 7 as string) "
              "|| '\": true}]}, \"empty\": {}, ' || CASE WHEN doc_id % 10 = 0 THEN '\"nothing\": null, ' ELSE '' END "
              "|| '\"source\": \"' || coalesce(source, '') || '\"}'")


@register("undeclared_keys", f"""WITH j AS (SELECT doc_id, {_OPEN_JSON} AS j FROM documents)
SELECT j.doc_id AS id, t.fullkey AS path, json_extract_string(j.j, t.fullkey) AS value
FROM j, json_tree(j.j) t WHERE t.type NOT IN ('OBJECT', 'ARRAY')""")
def q_undeclared_keys(spark, sf_dir):
    """Every leaf of documents whose keys are declared nowhere."""
    path = scratch_path(spark, "open-json")
    table(spark, sf_dir, "documents").selectExpr(f"{_OPEN_JSON} AS value").write.text(path)
    docs = V.scan_documents(spark, path).select("document", F.expr("variant_get(document, '$.id', 'bigint')").alias("id"))
    return V.leaves(docs, "document", ["id"]).select("id", "path", "value")


@register("undeclared_key_counts", f"""WITH j AS (SELECT {_OPEN_JSON} AS j FROM documents)
SELECT t.key AS key, count(*) AS n FROM j, json_each(j.j) t GROUP BY 1""")
def q_undeclared_key_counts(spark, sf_dir):
    """How often each top-level key occurs, whatever keys there are."""
    docs = table(spark, sf_dir, "documents").selectExpr(f"parse_json({_OPEN_JSON}) AS document")
    return V.explode_object(docs, "document", []).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
