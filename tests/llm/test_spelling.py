"""Spelling variants against every pair of words, counted plainly."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from insight.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_words(rows, one_in=31, least=7, least_count=2):
    n = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = low(run)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if h % one_in == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= least and c >= least_count}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(rows, times=10, **kw):
    words = plain_words(rows, **kw)
    out = {}
    for w, n in words.items():
        others = [v for v in words if v != w and near(v, w)]
        top = min(others, key=lambda v: (-words[v], v), default=None)
        form = top if top is not None and words[top] >= times * n else None
        out[w] = (form, n, len(others), words[form] if form else None)

    def root(w):
        while out[w][0] is not None:
            w = out[w][0]
        return w

    return {w: (f, root(w), n, k, m) for w, (f, n, k, m) in out.items()}


def got(df):
    rows = df.collect()
    found = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(found) == len(rows)
    return found


def test_small_table_equals_every_pair(session, spark, sf_dir, rows):
    del sf_dir
    subset = rows[:60]
    docs = spark.createDataFrame(subset, "doc_id long, text string")
    want = plain(subset)
    assert want and any(v[0] for v in want.values())
    assert got(spelling.variants(docs)) == want


@pytest.mark.parametrize("classes", [1, 3, 9])
def test_random_words_and_chains(session, spark, monkeypatch, classes):
    rng = np.random.default_rng(classes)
    letters = list("abcé×ÿ")
    texts = []
    for i in range(40):
        words = ["".join(rng.choice(letters, rng.integers(6, 9))) for _ in range(120)]
        texts.append((i, " ".join(words) + " 1 " + "-".join(words[:50])))
    texts += [(100, "abcabcab " * 2), (101, "abcabcaa " * 30), (102, "abcabcba " + "abcabaaa " * 400), (None, "Aaaaaaab aaaaaaab"),
              (5, None), (6, ""), (7, "x" * 300 + " " + "x" * 301 + (" " + "x" * 300) * 40 + " " + "x" * 301)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumnsRenamed({})
    monkeypatch.setattr(spelling, "PART", 64)  # large blocks in many parts
    found = got(spelling.variants(docs.selectExpr("*", "1 AS word", "2 AS n", "3 AS key", "4 AS root", "5 AS part"), classes=classes))
    want = plain(texts)
    assert found == want
    assert any(v[1] not in (w, v[0]) for w, v in want.items() if v[0])  # a chain of two


def test_lost_code_points_follow_the_hash():
    text = "Aaÿaéaazaaaaa Überraschung, naïveté×÷zz " + "b" * 70 + " " + "é" * 40
    rows = [(i, text) for i in range(300)] + [(None, text)]
    batch = pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows])], names=["doc_id", "text"])
    words = spelling.words_of(batch).to_pylist()
    assert {w: c for w, c in Counter(words).items() if c >= 2} == plain_words(rows)


def test_empty_table(session, spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(docs).collect() == []
    short = spark.createDataFrame([(1, "few words here"), (2, "singular")], "doc_id long, text string")
    assert spelling.variants(short).collect() == []
