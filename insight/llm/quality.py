"""Quality rules: a threshold table compiled into one Spark projection.

Every rule is a ratio of two measures of a text with a least and a greatest
value.  The measures are built-in expressions over the text, its word list and
its line list, and :func:`verdicts` turns the table into one ``select``; no user
function and no shuffle.

Defined results: null text has no words, so every count is 0 and the base rule
``n_words < 50`` fails it; an empty table gives an empty one.  A ratio over an
empty denominator is 0.  Very long texts are measured whole.  Repeated rows are
measured alike, and rows that tie have nothing to do with each other.  Columns
other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from insight.llm.base import GAP, documents, let, register

#: frequent function words of English, German, Spanish and French (fixed values)
STOP_WORDS = [
    "the", "be", "to", "of", "and", "that", "have", "with", "is", "in", "it", "for", "was", "on", "are", "as",
    "der", "die", "das", "und", "ist", "von", "den", "zu", "nicht", "ein", "eine", "mit", "auf", "sich", "des", "dem",
    "el", "la", "los", "las", "de", "que", "y", "en", "un", "una", "por", "con", "para", "es", "del", "se",
    "le", "les", "et", "une", "du", "dans", "est", "pour", "qui", "sur", "pas", "au", "par", "ce",
]


@dataclass(frozen=True)
class Rule:
    """``least <= top / bottom <= most``; ``bottom`` None means the count itself."""

    name: str
    top: str
    bottom: str | None = None
    least: float | None = None
    most: float | None = None


#: the rules of the query; the base ones come from the contract
BASE_RULES = [
    Rule("length", "n_words", least=50),
    Rule("repeated_words", "n_repeat_words", "n_words", most=0.5),
]
RULES = [
    Rule("longest", "n_words", most=1_000_000),
    Rule("mean_word", "word_chars", "n_words", 2.5, 12),
    Rule("symbols", "n_symbols", "n_words", most=0.1),
    Rule("stop_words", "n_stop_words", least=2),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=0.5),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", most=0.3),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", most=0.9),
]


def repeat_words(words: Column, size: int = 3, hashed: Callable[..., Column] = F.xxhash64) -> Column:
    """Words inside a run of ``size`` words that the text holds twice or more.

    The runs' hashes are sorted with their positions; neighbours that agree mark
    repeated runs, and sorted positions give the covered words.  Up to 65,536
    words, hash and position share one long (48 and 16 bits), which sorts as a
    plain number; longer texts sort 64-bit hashes beside their positions.  Runs
    whose hashes agree are compared word by word; a text in which two different
    ones do is counted by sorting the runs themselves, so the count is exact.
    """
    def run(w, i):
        return [w if k == 0 else F.get(words, i + k) for k in range(size)]

    def runs(pairs):  # without those that would run over the end
        return F.sort_array(F.slice(pairs, 1, F.greatest(F.size(words) - (size - 1), F.lit(0))))

    low = F.lit(0xFFFF).cast("long")

    def repeated(sorted_runs, key, place, exact):
        """Sorted places of the runs whose neighbour has their key; ``exact`` instead where two such runs differ."""
        def differ(e, k):
            before = F.get(sorted_runs, k - 1)
            other = F.lit(False)
            for j in range(size):
                other = other | (F.get(words, place(before) + j) != F.get(words, place(e) + j))
            return (key(before) == key(e)) & other

        found = F.sort_array(F.transform(
            F.filter(sorted_runs, lambda e, k: (key(F.get(sorted_runs, k - 1)) == key(e)) | (key(F.get(sorted_runs, k + 1)) == key(e))),
            place))
        return found if exact is None else F.when(F.size(F.filter(sorted_runs, differ)) > 0, exact).otherwise(found)

    def beside(value):
        return runs(F.transform(words, lambda w, i: F.struct(value(w, i).alias("h"), i.alias("i"))))

    def of_struct(exact):
        return lambda s: repeated(s, lambda e: e["h"], lambda e: e["i"], exact)

    exact = let(beside(lambda w, i: F.array(*run(w, i))), of_struct(None))
    packed = F.transform(words, lambda w, i: F.shiftleft(hashed(*run(w, i)), 16).bitwiseOR(i.cast("long")))
    short = let(runs(packed), lambda s: repeated(
        s, lambda e: F.shiftright(e, 16), lambda e: e.bitwiseAND(low).cast("int"), exact))
    long = let(beside(lambda w, i: hashed(*run(w, i))), of_struct(exact))
    found = F.when(F.size(words) <= 0xFFFF, short).otherwise(long)
    start = F.struct(F.lit(0).alias("n"), F.lit(-size).alias("last"))
    return F.aggregate(
        found, start,
        lambda a, p: F.struct((a["n"] + F.least(F.lit(size), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of each text, all counts as long."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    lists = docs.select(
        "doc_id", text.alias("text"),
        F.when(F.length(bare) > 0, F.split(bare, GAP)).otherwise(F.array().cast("array<string>")).alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    words, lines, text = F.col("words"), F.col("lines"), F.col("text")
    counts = {
        "n_words": F.size(words),
        "word_chars": F.char_length(F.array_join(words, "")),
        "n_symbols": F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": repeat_words(words),
        "n_lines": F.size(lines),
        "n_stop_words": F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in STOP_WORDS]))),
        "n_ellipsis_lines": F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))),
        "n_bullet_lines": F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•][\x20\x09]"))),
    }
    return lists.select("doc_id", *[c.cast("long").alias(n) for n, c in counts.items()])


def passes(rule: Rule) -> Column:
    value = F.col(rule.top).cast("double")
    if rule.bottom:
        value = F.when(F.col(rule.bottom) == 0, F.lit(0.0)).otherwise(value / F.col(rule.bottom))
    ok = F.lit(True)
    if rule.least is not None:
        ok = ok & (value >= rule.least)
    if rule.most is not None:
        ok = ok & (value <= rule.most)
    return ok


def verdicts(measures: DataFrame, rules: list[Rule]) -> DataFrame:
    """The measures with ``failed``, the names of the rules that each text breaks."""
    broken = F.array_compact(F.array(*[F.when(~passes(r), F.lit(r.name)) for r in rules]))
    return measures.select("*", broken.alias("failed"))


def op7_sql() -> str:
    """The query in SQL, from the same tables of words and thresholds."""
    def ratio(r: Rule) -> str:
        v = r.top if r.bottom is None else f"(CASE WHEN {r.bottom} = 0 THEN 0 ELSE {r.top} / {r.bottom} END)"
        parts = [f"{v} >= {r.least}"] * (r.least is not None) + [f"{v} <= {r.most}"] * (r.most is not None)
        return " AND ".join(parts)

    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    ok = "\n    AND ".join(ratio(r) for r in RULES)
    failed = ", ".join(f"CASE WHEN NOT ({ratio(r)}) THEN '{r.name}' END" for r in BASE_RULES + RULES)
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
runs AS (
  SELECT doc_id, i, words[i:i + 2] AS run
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 2)) AS i FROM d WHERE len(words) >= 3)),
twice AS (SELECT doc_id, i FROM runs QUALIFY count(*) OVER (PARTITION BY doc_id, run) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT pos) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS pos FROM twice) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(words) AS n_words,
         length(regexp_replace(body, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(lines) AS n_lines,
         len(list_distinct(list_filter(words, lambda w: w IN ({stop})))) AS n_stop_words,
         len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines,
         len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•][\x20\x09]'))) AS n_bullet_lines
  FROM d LEFT JOIN covered ON d.doc_id = covered.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
    AND {ok} AS kept,
       list_filter([{failed}], lambda x: x IS NOT NULL) AS failed
FROM m
"""


@register("op7_quality_rules", op7_sql())
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = verdicts(measured(documents(spark, sf_dir)), BASE_RULES + RULES)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & (F.size("failed") == 0)).alias("kept"), "failed")
