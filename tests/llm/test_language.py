"""Code lengths against context trees of plain dictionaries, and held-out languages."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from insight.llm import language

EN = ["The house on the hill was old, and nobody lived there.", "She gave him the letter without a word of thanks.",
      "There is nothing like the smell of the sea in the morning."] * 3
DE = ["Das Haus auf dem Hügel war alt und niemand wohnte dort.", "Sie gab ihm den Brief ohne ein Wort des Dankes.",
      "Es gibt nichts Schöneres als den Geruch des Meeres am Morgen."] * 3


def plain_tree(texts, order):
    tree = defaultdict(Counter)
    for t in texts:
        b = b"\n" * order + lowered(t)
        for p in range(order, len(b)):
            for k in range(order + 1):
                tree[b[p - k:p]][b[p]] += 1
    return tree


def lowered(text):
    """A-Z as a-z, runs of other ASCII characters as one blank."""
    return re.sub(rb"[^a-z\x80-\xff]+", b" ", text.encode().lower())


def plain_bits(tree, context, byte):
    """One byte's code length with exclusion, by the definition."""
    bits, out = 0.0, set()
    for k in range(len(context), -1, -1):
        seen = {b: n for b, n in tree.get(context[len(context) - k:], {}).items() if b not in out}
        if not seen:
            continue
        whole = sum(seen.values()) + len(seen)
        if byte in seen:
            return bits + math.log2(whole / seen[byte])
        bits += math.log2(whole / len(seen))
        out |= set(seen)
    return bits + math.log2(256 - len(out))


def model_of(by_lang, order=3):
    trees = []
    for name in sorted(by_lang):
        grams = np.concatenate([g for g, _ in language.pieces(pa.array(by_lang[name]), order)])
        keys, n = np.unique(grams, return_counts=True)
        trees.append(language.Tree.of(keys, n, order))
    return language.Model(sorted(by_lang), trees, np.zeros(len(trees)), order)


@pytest.mark.parametrize("piece", [7, 1 << 21])
def test_lengths_equal_the_definition(monkeypatch, piece):
    monkeypatch.setattr(language, "PIECE", piece)
    order = 3
    model = model_of({"de": DE, "en": EN}, order)
    trees = [plain_tree(DE, order), plain_tree(EN, order)]
    texts = ["The sea", "", None, "Hügel ÄÖ \x00 漢字 thethe", "zzz", "  ", " a", "b ", " c!! 7d", DE[0]]
    got = model.lengths(pa.array(texts))
    for r, t in enumerate(texts):
        b = b"\n" * order + lowered(t or "")
        for k, tree in enumerate(trees):
            want = sum(plain_bits(tree, b[p - order:p], b[p]) for p in range(order, len(b)))
            assert got[r, k] == pytest.approx(want, rel=1e-9)


def test_predictions_of_a_context_sum_to_one():
    tree = model_of({"en": EN}, 4).trees[0]
    for context in (b"the ", b"\n\n\nt", b"qqqq", b"xthe", b"zzho"):
        head = int.from_bytes(context, "big") << 8
        assert np.exp2(-tree.bits(np.arange(256) + head)).sum() == pytest.approx(1.0, abs=1e-9)


def test_prediction_and_defined_results(session, spark):
    docs = spark.createDataFrame([(i, t, lang) for lang, ts in (("en", EN), ("de", DE)) for i, t in enumerate(ts)]
                                 + [(50, "x", None), (None, "Das ist gut.", "de"), (51, None, "en")], "doc_id long, text string, lang string")
    model = language.learn(docs, sample=4)
    assert model.names == ["de", "en"]
    tests = [(1, "The old letter of the house"), (2, "Der alte Brief auf dem Meer"), (3, None), (4, ""), (5, "123 !?"),
             (1, "The old letter of the house"), (None, "nobody was there"), (6, "Der Brief des Hauses. " * 200_000)]
    df = spark.createDataFrame(tests, "doc_id long, text string").selectExpr("*", "1 AS lang", "2 AS letters", "3 AS score", "4 AS source")
    rows = sorted([(r.doc_id or 0, r.lang_pred) for r in language.predicted(df, model).collect()])
    assert rows == [(0, "en"), (1, "en"), (1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (6, "de")]
    scores = {r.doc_id: r.score for r in language.predicted(df, model).collect()}
    assert scores[3] == scores[5] == 0.0 and all(0 <= s <= 1 for s in scores.values()) and scores[6] == 1.0


def test_nothing_to_learn(session, spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = language.learn(empty)
    assert model.names == []
    rows = language.predicted(spark.createDataFrame([(1, "some text")], "doc_id long, text string"), model).collect()
    assert [(r.lang_pred, r.score) for r in rows] == [("und", 0.0)]
    assert language.predicted(empty, model).collect() == []


def test_sample_is_bounded_and_whole_when_small(session, spark):
    docs = spark.range(500).selectExpr("id AS doc_id", "'the text of it' AS text", "IF(id % 50 = 0, 'de', 'en') AS lang")
    model = language.learn(docs, sample=20)
    tops = [int(t.total[0][0]) for t in model.trees]
    assert tops == [10 * 14, 20 * 14] and np.allclose(np.exp2(model.prior), [0.02, 0.98])


def test_held_out_accuracy(session, spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = language.op13_language_id(spark, sf_dir).join(docs.selectExpr("doc_id", "lang"), "doc_id").filter("held_out AND lang_pred <> 'und'").collect()
    assert len(rows) > 20 and np.mean([r.lang == r.lang_pred for r in rows]) >= 0.95
