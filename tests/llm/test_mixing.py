import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from insight.llm import mixing as M


def targets(sizes, weights=M.WEIGHTS, share=M.SHARE, most=M.MOST):
    """Rounds of sharing, as the contract tells them."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if most * sizes[s] < level * weight[s]}
        if not full:
            out |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= full
    return out


ROWS = [(i, " ".join(["w"] * random.Random(i).randint(0, 60)), ["b", "a", "é", None, "z", "hot", "hot", "hot"][i % 8]) for i in range(400)]


def test_targets_and_sizes(make):
    out = M.plan_mix(make(ROWS), block_docs=4).collect()
    assert len(out) == 400
    sizes = {}
    for _, t, s in ROWS:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = targets(sizes)
    taken = {}
    for r in out:
        assert r.size == len(ROWS[r.doc_id][1].split()) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert r.copies <= 2 and (r.size > 0 or r.copies == 0)
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
    for s, words in taken.items():
        assert abs(words - want[s]) <= 60, (s, words, want[s])


def test_reruns_agree_and_mix_holds_the_plan(make):
    docs = make(ROWS)
    plan = {r.doc_id: r.copies for r in M.plan_mix(docs, block_docs=4).collect()}
    out = M.mix(docs, 5, block_docs=4)
    assert out.columns == docs.columns
    one = [[r.doc_id for r in part] for part in out.rdd.glom().collect()]
    assert 1 < sum(bool(p) for p in one) <= 5
    counts = {}
    for part in one:
        for i in part:
            counts[i] = counts.get(i, 0) + 1
    assert counts == {i: c for i, c in plan.items() if c}
    assert one == [[r.doc_id for r in part] for part in M.mix(docs, 5, block_docs=4).rdd.glom().collect()]


def test_tree_keeps_quotas_and_deals_disjoint_stretches(session):
    quotas = session.createDataFrame([(0, 7), (1, 100), (2, 0), (3, 13)], "sid int, draws long")
    out = M.splitting_tree(quotas, 6, seed=3).collect()
    assert {s: sum(r.draws for r in out if r.sid == s) for s in (0, 1, 3)} == {0: 7, 1: 100, 3: 13}
    shard = {j: sum(r.draws for r in out if r.shard == j) for j in range(6)}
    assert max(shard.values()) - min(shard.values()) <= 3
    for s in (0, 1, 3):
        spans = sorted((r.first, r.first + r.draws) for r in out if r.sid == s)
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_tree_draws_without_replacement(session):
    """Left counts of many nodes follow the hypergeometric mean and variance."""
    rows = session.range(600).select(M.draw_left(
        F.col("id"), F.array(F.lit(12).cast("long"), F.lit(28).cast("long")), F.lit(20), 3).alias("left")).collect()
    left = [r.left[0] for r in rows]
    assert all(sum(r.left) == 20 for r in rows)
    mean, var = 20 * 12 / 40, 20 * 12 / 40 * 28 / 40 * 20 / 39
    assert abs(np.mean(left) - mean) < 4 * (var / 600) ** 0.5
    assert 0.8 * var < np.var(left) < 1.25 * var


def test_odd_tables(make):
    assert M.plan_mix(make([])).count() == 0
    assert M.mix(make([]), 3).count() == 0
    out = {r.doc_id: (r.size, r.source_size, r.target, r.copies) for r in M.plan_mix(make([(1, None, None), (2, "", None)])).collect()}
    assert out == {1: (0, 0, 0.0, 0), 2: (0, 0, 0.0, 0)}
    twice = M.mix(make([(1, "a b", "x"), (1, "a b", "x"), (None, "c", "y")]), 2).collect()
    assert all(r.text in ("a b", "c") for r in twice)


def test_taken_comes_from_the_dealt_draws(make, session, sf_dir, monkeypatch):
    """What the tree does not deal is not taken, by the registered query either."""
    docs = make(ROWS + ROWS[7:8] * 3)
    plan = sorted((r.doc_id, r.size, r.copies * r.size) for r in M.plan_mix(docs, block_docs=4).collect())
    assert sorted((r.doc_id, r.size, r.taken) for r in M.taken_words(docs, 5, block_docs=4).collect()) == plan
    whole = {r.doc_id: r.taken for r in M.op3_source_mixing(session, sf_dir).collect()}
    tree = M.splitting_tree
    monkeypatch.setattr(M, "splitting_tree", lambda *a: tree(*a).filter("shard > 0"))
    out = {r.doc_id: r.taken for r in M.op3_source_mixing(session, sf_dir).collect()}
    assert out.keys() == whole.keys() and 0 < sum(out.values()) < sum(whole.values())
