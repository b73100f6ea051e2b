from collections import Counter

import brute
from pyspark.sql import functions as F

from insight.llm import quality as Q


def plain(text):
    text = text or ""
    w = brute.WORD.findall(text)
    lines = [x for x in text.split("\n") if brute.WORD.search(x)]
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))


def test_measures_match_plain_ones(make, rows):
    odd = [(-1, None), (-2, ""), (-3, " \t\n"), (-4, "a b c a b c a"), (-5, "x " * 70_000), (-6, "é ü # | \n\n é ü # | "),
           (-7, "a\x0bb\x0cc\rd"), (-8, "one"), (-8, "one")]
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
           for r in Q.measured(make(rows[:60] + odd)).collect()}
    for i, text in rows[:60] + odd:
        assert got[i] == plain(text), i


def test_rules_name_what_fails(make):
    text = "with that have was the " * 12 + "word "
    out = {r.doc_id: r.failed for r in Q.verdicts(Q.measured(make([(1, text), (2, "# " * 80), (3, None)])), Q.BASE_RULES + Q.RULES).collect()}
    assert out[1] == ["repeated_words"]
    assert "symbols" in out[2] and "stop_words" in out[2]
    assert "length" in out[3]


def test_empty_table(make):
    assert Q.measured(make([])).count() == 0


def test_runs_whose_hashes_agree_are_told_apart(make, rows):
    """With one hash for all runs, or one of a few, the counts stay those of the words."""
    texts = [(i, t) for i, t in rows[:25] if t is None or len(t) < 4000]
    texts += [(-4, "a b c a b c a"), (-5, "x y z p q r x y z s t u p q r"), (-6, "a b c d e f"), (-7, "a b"), (-8, ""), (-9, "e " * 70_000)]
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    df = make(texts).select("doc_id", words.alias("w"))
    one = Q.repeat_words(F.col("w"), hashed=lambda *run: F.octet_length(run[0]).cast("long") * 0)
    few = Q.repeat_words(F.col("w"), hashed=lambda *run: F.pmod(F.xxhash64(*run), F.lit(7)))
    want = {i: plain(t)[4] for i, t in texts}
    for n in (one, few):
        assert {r.doc_id: r.n for r in df.select("doc_id", n.alias("n")).collect()} == want
