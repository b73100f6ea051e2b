import random

import brute
import numpy as np
import pytest

from insight.llm import ngram_join as J


def varied(seed=1):
    """Groups of near copies of every similarity, chains, copies, short and odd texts."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = r.choices(vocabulary, k=60)
    out = []
    for _ in range(25):
        base = r.choices(vocabulary, k=r.randint(20, 200))
        for k in range(r.randint(1, 9)):
            words = list(base)
            for _ in range(k):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            if r.random() < 0.3:
                words = words + passage
            out.append(" ".join(words))
    out += [out[0].upper(), out[0], "a b", "A  B\n", "a b c d e", "a b c d e f", "a", "", None, " \t", passage and " ".join(passage)]
    ids = r.sample(range(10_000), len(out))
    return list(zip(ids, out, strict=True))


def results(df):
    return {r.doc_id: (r.n_elements, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("block, postings", [(J.BLOCK, J.POSTINGS), (300, J.POSTINGS), (J.BLOCK, 20), (300, 0)])
def test_components_equal_brute_force(make, monkeypatch, block, postings):
    """Also with small limits: groups in several blocks, clusters compared pivot by pivot."""
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "POSTINGS", postings)
    docs = varied(block + postings)
    assert results(J.join(make(docs))) == brute.similar_components(docs)


def test_small_table(make, rows):
    assert results(J.join(make(rows))) == brute.similar_components(rows)


def test_large_group_of_copies(make):
    """Exact and near copies of one text: one component, whatever their number."""
    r = random.Random(2)
    base = [f"w{r.randrange(900)}" for _ in range(80)]
    docs = [(i, " ".join(base)) for i in range(150)]
    for i in range(150, 300):
        words = list(base)
        words[r.randrange(80)] = "other"
        docs.append((i, " ".join(words)))
    assert results(J.join(make(docs))) == brute.similar_components(docs)


def test_null_and_repeated_ids(make):
    t = " ".join(f"t{i}" for i in range(30))
    out = J.join(make([(None, t), (5, t), (5, t), (None, "lone words here and there now"), (7, None)])).collect()
    got = sorted(((r.doc_id, r.component_id) for r in out), key=str)
    assert got == sorted([(None, 5), (5, 5), (5, 5), (None, None), (7, 7)], key=str)


def test_one_of_each_group_stays(make):
    docs = make(varied())
    keep = J.deduplicate(docs)
    assert keep.columns == docs.columns
    want = {i for i, (_, c) in brute.similar_components(varied()).items() if i == c}
    assert {r.doc_id for r in keep.collect()} == want


def test_empty_table(make):
    assert J.join(make([])).count() == 0
    assert J.deduplicate(make([])).count() == 0


def test_prefixes_of_linked_sets_share_what_is_asked():
    """Two sets over the threshold share at least the smaller number that either asks for."""
    r = np.random.default_rng(3)
    estimate = r.integers(0, 400, J.SKETCH).astype(np.uint32)
    for _ in range(300):
        n = int(r.integers(4, 400))
        x = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[: max(1, int(len(x) * r.uniform(0.8, 1)))], r.integers(0, 2**63, n // 12 + 1).astype(np.uint64)]))
        common = len(np.intersect1d(x, y))
        if 100 * common < 75 * (len(x) + len(y) - common):
            continue
        g, first = np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)])
        at, row, asked = J.prefixes(g, first, estimate, 230.0, 0.75)
        shared = np.intersect1d(g[at[row == 0]], g[at[row == 1]])
        assert len(shared) >= min(asked)


def test_forest_joins_what_links_join():
    r = random.Random(4)
    sets = []
    for _ in range(12):
        base = [r.randrange(10_000) for _ in range(60)]
        for _ in range(r.randint(1, 8)):
            s = set(base)
            for _ in range(r.randint(0, 14)):
                s.discard(r.choice(base))
                s.add(r.randrange(10_000))
            sets.append(np.array(sorted(s), np.uint64))

    def joined(pairs):
        f = J.Forest(len(sets))
        for a, b in pairs:
            f.join(a, b)
        return [f.root(i) for i in range(len(sets))]

    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * (k := len(np.intersect1d(sets[i], sets[j]))) >= 75 * (
        len(sets[i]) + len(sets[j]) - k)]
    size = np.array([len(s) for s in sets])

    def enough(common, x):
        return 100 * common >= 75 * (size + size[x] - common)

    assert joined(J.linked(sets, np.zeros(len(sets), int), enough)) == joined(pairs)
    side = np.array([i % 2 for i in range(len(sets))])
    across = [(i, j) for i, j in pairs if side[i] != side[j]]
    assert joined(J.linked(sets, side, enough)) == joined(across)


def test_components_of_chains(session):
    links = session.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 50), (100, 200)], "a long, b long")
    got = {r.node: r.root for r in J.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 100: 50, 200: 50}
