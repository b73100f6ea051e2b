import random

import brute

from insight.llm import substring_dedup as S


def varied(seed=1):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    passages = [r.choices(vocabulary, k=n) for n in (49, 50, 51, 80, 200)]
    out = []
    for _ in range(60):
        words = r.choices(vocabulary, k=r.randint(0, 120))
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            at = r.randint(0, len(words))
            words[at:at] = p[: r.randint(40, len(p))] if r.random() < 0.3 else p
        out.append((" " if r.random() < 0.7 else "  \n").join(words))
    out += [out[3], out[3], " ".join(["same"] * 130), " ".join(["same"] * 90), None, "", " \t ", " ".join(passages[0]), " ".join(passages[1])]
    return list(zip(r.sample(range(1000), len(out)), out, strict=True))


def results(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


def test_equal_brute_force(make):
    for seed in (1, 2):
        docs = varied(seed)
        assert results(S.remove_repeats(make(docs))) == brute.without_repeats(docs)


def test_large_groups_refined_by_joins(make):
    for seed in (4,):
        docs = varied(seed)
        assert results(S.remove_repeats(make(docs), limit=3)) == brute.without_repeats(docs)


def test_few_words_many_matches(make):
    r = random.Random(6)
    docs = [(i, " ".join(r.choices("ab", k=r.randint(0, 60)) + ["c"] * r.randint(0, 30))) for i in r.sample(range(500), 120)]
    for size, limit in ((5, 20), (20, 1000)):
        got = {i: n for i, (_, n, _) in results(S.remove_repeats(make(docs), size, limit)).items()}
        assert got == {i: n for i, (_, n, _) in brute.without_repeats(docs, size).items()}


def test_near_copies_of_one_text(make):
    r = random.Random(7)
    base = [f"u{r.randrange(3000)}" for _ in range(400)]
    docs = []
    for i in r.sample(range(1000), 80):
        words = list(base)
        for _ in range(r.randint(0, 9)):
            words[r.randrange(400)] = f"e{r.randrange(3)}"
        docs.append((i, " ".join(words)))
    for limit in (10, 1000):
        assert results(S.remove_repeats(make(docs), limit=limit)) == brute.without_repeats(docs)


def test_small_table(make, rows):
    assert results(S.remove_repeats(make(rows))) == brute.without_repeats(rows)


def test_long_texts_and_many_copies(make):
    r = random.Random(3)
    long = " ".join(f"v{r.randrange(9)}" for _ in range(30_000))
    docs = [(i, long) for i in range(40)] + [(99, long[5000:])]
    assert results(S.remove_repeats(make(docs))) == brute.without_repeats(docs)


def test_null_and_repeated_ids(make):
    t = " ".join(f"t{i}" for i in range(70))
    out = S.remove_repeats(make([(None, t), (5, t), (5, t), (6, "x " + t)])).collect()
    assert sorted(((r.doc_id, r.n_removed) for r in out), key=str) == sorted([(None, 0), (5, 0), (5, 0), (6, 70)], key=str)


def test_kept_text_and_spans(make):
    t = " ".join(f"t{i}" for i in range(70))
    docs = make([(1, t), (2, "a b  " + t + "\nc")])
    _, found = S.find_repeats(docs)
    (r,) = S.cut_texts(docs, found).collect()
    assert (r.doc_id, r.kept, [(x.first, x.end) for x in r.repeats]) == (2, "a b c", [(2, 72)])


def test_empty_table(make):
    assert S.remove_repeats(make([])).count() == 0
