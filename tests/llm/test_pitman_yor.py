import math
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest

from insight.llm import pitman_yor as P


def words(text):
    return [*brute.WORD.findall(brute.lower_az(text or "")), None]


def check(out, docs):
    counts = Counter()
    for i, t in docs:
        if not P.seventh(i):
            counts.update(words(t))
    total, known = sum(counts.values()), len(counts)
    want = {}
    for i, t in docs:
        w = words(t)
        want[i] = (len(w), sum(counts[x] > 0 for x in w), sum(math.log10((counts[x] + 1) / (total + known + 1)) for x in w))
    assert len(out) == len(docs)
    for r in out:
        n, k, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, k, total, P.seventh(r.doc_id))
        assert r.base_score == pytest.approx(base)
        assert r.score < 0


def test_contract_and_held_out_gain(make, session, rows):
    odd = [(100_001, None), (100_002, ""), (100_003, "Rare zyzzyva"), (100_004, "the " * 70_000)]
    out = P.train_and_score(make(rows + odd), P.seventh).collect()
    check(out, rows + odd)
    held = {r.held_out: r for r in P.perplexity(session.createDataFrame(out)).collect()}
    assert held[True].perplexity < 0.7 * held[True].base_perplexity
    again = {r.doc_id: r.score for r in P.train_and_score(make(rows + odd), P.seventh).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score, rel=1e-9) for r in out)


def test_packs_and_spread_words_change_no_count(make, rows, monkeypatch):
    monkeypatch.setattr(P, "PACK", 500)
    monkeypatch.setattr(P, "PACK_ROWS", 3)
    monkeypatch.setattr(P, "HOT_SHARE", 1 / 50)
    check(P.train_and_score(make(rows[:50]), P.seventh).collect(), rows[:50])


def test_null_repeated_and_empty(make):
    out = P.train_and_score(make([(None, "a b"), (None, "a b"), (3, "a"), (3, "a")]), P.seventh).collect()
    assert {(r.doc_id, r.held_out, r.n_tokens, r.train_tokens) for r in out} == {(None, False, 3, 10), (3, P.seventh(3), 2, 10)}
    assert len(out) == 4
    assert P.train_and_score(make([]), P.seventh).count() == 0
    only_held = [i for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    out = P.train_and_score(make([(i, "a b") for i in only_held]), P.seventh).collect()
    assert [(r.n_known, r.train_tokens) for r in out] == [(0, 0)] * 2 and all(math.isfinite(r.score) for r in out)


def cell_and_model(texts):
    """One cell of all pairs, swept as the jobs do."""
    token, context, _ = P.tokens(pa.array(texts))
    cell, word, ctx, trained, event = P.distinct_pairs(token, context, np.ones(len(token)), np.zeros(0, np.uint64), 1)
    assert (word[event] == token).all() and (ctx[event] == context).all() and trained.sum() == len(token)
    (number, *arrays), = P.messages(cell, word, ctx, trained)
    cell = P.Cell.of_messages([P.message_arrays(dict(zip(("words", "counts", "met", "contexts", "trained"), arrays, strict=True)))])
    customers = np.bincount(cell.at, cell.count, len(cell.context)).astype(np.int64)
    none = np.zeros(0, np.int64)
    shared = P.Shared(len(cell.word), len(token), 0.7, 0.6, np.zeros(0, np.uint64), none)
    told = P.Told(customers, np.ones(len(cell.context), bool), [np.bincount(cell.at, minlength=len(cell.context))])
    parents = [P.Parent(len(cell.key), len(cell.word), none, none)]
    for _ in range(P.SWEEPS):
        *_, (tables, guests, opened) = P.sweeps(cell, shared, list(parents), told, 1)
        told.tables.append(np.bincount(cell.at, tables, len(cell.context)).astype(np.int64))
        parents.append(P.Parent(guests.sum(), opened.sum(), none, none))
    return cell, shared, parents, told


def test_probabilities_sum_to_one():
    """Over all known words and the unknown one, in all contexts."""
    cell, shared, parents, told = cell_and_model(["a b a c a b", "b c d the the the a", "x y a b"] * 5)
    p = P.Predictor.unpacked(P.Predictor(cell, shared, parents, told, 1).packed())
    at, count = p.counts(np.concatenate([cell.word, np.array([12345], np.uint64)]))
    assert count[-1] == 0 and count.sum() == shared.trained
    for context in range(len(cell.context)):
        assert (10 ** p.log10(at, np.full(len(at), context))).sum() == pytest.approx(1)


def test_seats_agree_with_a_plain_sampler():
    """Mean tables of each context over many seeds, against customers seated one after another in plain Python."""
    cell, shared, parents, told = cell_and_model(["a b a c a b", "b c a b a b", "c a b"] * 2)
    got = np.mean([next(P.sweeps(cell, shared, parents[:1], told, s))[0] for s in range(3000)], axis=0)
    base = (cell.dishes - shared.parent_discount) / (P.PARENT_STRENGTH + parents[0].customers) + shared.new_table(parents[0])
    rng = np.random.default_rng(5)
    for k in range(len(cell.key)):
        a = (P.STRENGTH + shared.discount * (told.tables[0][cell.at[k]] - 1)) * base[cell.of[k]]
        seen = []
        for _ in range(3000):
            t = 1
            for j in range(1, cell.count[k]):
                t += rng.random() < a / (a + j - shared.discount * t)
            seen.append(t)
        assert got[k] == pytest.approx(np.mean(seen), abs=0.06)


def test_a_context_of_one_cell_needs_no_telling():
    """The same seats, whether a cell is told its own contexts' tables or knows that nobody else has them."""
    cell, shared, parents, told = cell_and_model(["a b a c a b", "b c a b a b"] * 3)
    alone = P.Told(told.customers, np.zeros(len(cell.context), bool), [np.zeros(0, np.int64)] * len(told.tables))
    for x, y in zip(P.sweeps(cell, shared, parents[:-1], told, 1), P.sweeps(cell, shared, parents[:-1], alone, 1), strict=True):
        assert all((a == b).all() for a, b in zip(x, y, strict=True))


def test_totals_reach_cells_that_only_ask():
    """Context 2 is learned in one cell and met in a text held out in another: both are told its tables."""
    def ask(cell, context, customers):
        return (7, cell, P.squeezed("context", np.array(context, np.uint64)), *[P.squeezed("customers", np.array(customers))] * 2)

    asked = P._first_totals((pa.scalar(7),), P.table_of([ask(0, [1, 2, 3], [4, 5, 6]), ask(1, [2, 3, 9], [0, 1, 0])], P.ASKED))
    got = {r["cell"]: P.arrays_of(r, shared=np.bool_, customers=np.int64, tables=np.int64) for r in asked.to_pylist()}
    assert [x.tolist() for x in got[0]] == [[False, True, True], [4, 5, 7], [5, 7]]
    assert [x.tolist() for x in got[1]] == [[True, True, False], [5, 7, 0], [5, 7]]
    swept = P.table_of([(7, 0, P.squeezed("tables", np.array([3, 2])), None, None, None),
                        (7, 1, P.squeezed("tables", np.array([0, 1])), None, None, None)], P.SWEPT)
    told = {r["cell"]: P.arrays_of(r, tables=np.int64)[0].tolist() for r in P._next_totals((pa.scalar(7),), swept, asked).to_pylist()}
    assert told == {0: [3, 3], 1: [3, 3]}


def test_arrays_travel_whole():
    r = np.random.default_rng(1)
    for name, x in [("words", np.sort(r.integers(0, 2**64, 999, np.uint64))), ("key", np.sort(r.integers(-9, 2**62, 50))),
                    ("shared", r.random(9) < 0.5), ("here", r.random(33)), ("events", np.zeros(0, np.uint32))]:
        assert (P.unsqueezed(name, P.squeezed(name, x), x.dtype) == x).all()


def test_contexts_are_kept_apart_whatever_their_number(session, make):
    """Each word follows one context: with every context a restaurant of its own the next word is nearly sure."""
    docs = [(i, " ".join(f"c{k} w{k}" for k in range(200 * (i % 200), 200 * (i % 200) + 200))) for i in range(1600)]
    out = P.train_and_score(make(docs), P.seventh)
    (held,) = [r for r in P.perplexity(out).collect() if r.held_out]
    assert held.perplexity < 20 < 10_000 < held.base_perplexity


def test_spread_words_are_scored_as_others(make, rows, monkeypatch):
    """Only the draws differ when words are dealt to cells by their contexts."""
    score = {}
    for share in (2, 1 / 100):
        monkeypatch.setattr(P, "HOT_SHARE", share)
        score[share] = {r.doc_id: r.score for r in P.train_and_score(make(rows[:100]), P.seventh).collect()}
    assert all(score[2][i] == pytest.approx(score[1 / 100][i], rel=0.02) for i in score[2])


def test_seating_follows_the_chinese_restaurant():
    """Number of tables of one dish against the exact expectation of the sequential rule."""
    rng, d, a, c = np.random.default_rng(0), 0.6, 1.5, 20
    tables = P.seat(np.full(20_000, c), np.full(20_000, a), d, rng)
    dist = {1: 1.0}
    for j in range(1, c):
        new = {}
        for t, p in dist.items():
            q = a / (a + j - d * t)
            new[t] = new.get(t, 0) + p * (1 - q)
            new[t + 1] = new.get(t + 1, 0) + p * q
        dist = new
    mean = sum(t * p for t, p in dist.items())
    assert abs(tables.mean() - mean) < 0.05
    many = P.seat(np.array([100_000]), np.array([2.0]), d, rng)
    assert 1 <= many[0] <= 100_000
    assert P.seat(np.array([0, 1]), np.array([1.0, 1.0]), d, rng).tolist() == [0, 1]


def test_words_to_spread_come_from_the_whole_table(make):
    """A word that the first rows do not have, but a third of all tokens is."""
    docs = [(i, f"a{i} b{i} c{i} d{i}") for i in range(3000)] + [(3000 + i, "zz " * 25) for i in range(400)]
    (zz,) = np.unique(P.tokens(pa.array(["zz"]))[0][:1])
    assert zz in P.frequent(make(docs).coalesce(1))
    assert zz in P.frequent(make(docs).repartition(7))


def test_summary_keeps_frequent_words():
    r = np.random.default_rng(2)
    word, count, n, true = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, Counter()
    for _ in range(50):
        part = np.concatenate([r.integers(100, 10**6, 900), r.integers(0, 5, 100)]).astype(np.uint64)
        word, count = P.add_counts(word, count, part, 200)
        true.update(part.tolist())
        n += len(part)
    got = dict(zip(word.tolist(), count.tolist(), strict=True))
    assert len(got) <= 200
    assert all(true[w] - n / 200 <= got.get(w, 0) <= true[w] for w in true)


def test_spread_words_change_no_discount(make, rows, monkeypatch):
    seen, real = [], P.discount_of
    monkeypatch.setattr(P, "discount_of", lambda *a: seen.append(a) or real(*a))
    docs = make(rows[:60] + [(200_000, "once only twice twice")])
    for share in (2, 1 / 256):  # none, many
        monkeypatch.setattr(P, "HOT_SHARE", share)
        P.train_and_score(docs, P.seventh).count()
    assert seen[:2] == seen[2:]


def test_messages_about_contexts_follow_their_number(make, rows, monkeypatch):
    """A small table in many partitions sends no partitions x partitions messages; ranges change no score."""
    sent, real = [], P.landed

    def counted(df, name):
        out = real(df, name)
        if name == "totals":
            sent.append(out.count())
        return out

    monkeypatch.setattr(P, "landed", counted)
    few = {r.doc_id: r.score for r in P.train_and_score(make(rows[:60]), P.seventh).collect()}
    cells = 2 * 8
    assert len(sent) == P.SWEEPS and max(sent) <= cells
    monkeypatch.setattr(P, "RANGE", 1)
    many = {r.doc_id: r.score for r in P.train_and_score(make(rows[:60]), P.seventh).collect()}
    assert min(sent[P.SWEEPS:]) > cells and many == pytest.approx(few, rel=1e-9)
