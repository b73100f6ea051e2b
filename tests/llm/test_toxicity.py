import random

import numpy as np
import pyarrow as pa
import pytest

from insight.llm import toxicity as T


def corpus(n=400, seed=1):
    r = random.Random(seed)
    plain = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        sentences = [" ".join(r.choices(plain, k=8)) for _ in range(r.randint(1, 12))]
        toxic = i % 4 == 0
        if toxic:
            sentences[r.randrange(len(sentences))] += r.choice([" idiot", " morons", " moronic"]) + " you"
        docs.append((i, ". ".join(sentences) + "."))
        labels.append((i, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def fitted(make, session):
    docs, labels = corpus()
    frame = session.createDataFrame(labels, "doc_id long, toxic int")
    learned = frame.filter(~T.held_out())
    return docs, dict(labels), T.train(make(docs), learned)


def test_held_out_documents(make, fitted):
    docs, labels, model = fitted
    rows = T.scored(make(docs), model, ["doc_id"]).withColumn("held", T.held_out()).filter("held").collect()
    assert len(rows) > 50
    right = [r.predicted == labels[r.doc_id] for r in rows]
    assert np.mean(right) > 0.97


def test_offending_sentences_are_found(make, fitted):
    _, _, model = fitted
    text = "word1 word2 word3. Ä word4 IDIOT you! word5 word6."
    (r,) = T.scored(make([(1, text)]), model, ["doc_id"]).collect()
    assert [text.encode()[x.start:x.end].decode() for x in r.offending] == ["Ä word4 IDIOT you"]
    assert r.predicted == 1


def test_odd_texts(make, fitted):
    _, _, model = fitted
    clean = "word1 word2 word3 word4. " * 4000
    out = T.scored(make([(1, None), (2, ""), (3, "... \n"), (4, clean), (5, clean + "idiot you"), (5, clean + "idiot you"),
                         (6, "word9 " * 50_000)]), model, ["doc_id", "score_source"[:0] or "source"]).collect()
    got = {r.doc_id: (r.score, r.predicted) for r in out}
    assert len(out) == 7 and got[1] == got[2] == got[3] == (0.0, 0)
    assert got[4][1] == 0 and got[5][1] == 1 and got[6][1] == 0
    assert T.scored(make([]), model, ["doc_id"]).count() == 0


def test_without_labels_nothing_is_rejected(make, session):
    empty = session.createDataFrame([], "doc_id long, toxic int")
    docs = make(corpus(20)[0])
    model = T.train(docs, empty)
    assert T.clean(docs, model).count() == 20
    one_class = session.createDataFrame([(1, 0), (2, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    assert len(T.train(docs, one_class).feature) == 0


def test_clean_documents_joined_stay_clean(make, fitted):
    """A million words of documents that are each clean, of words that the model knows."""
    docs, labels, model = fitted
    clean = [t for i, t in docs if not labels[i]]
    scores = T.scored(make([(k, t) for k, t in enumerate(clean)]), model, ["doc_id"]).collect()
    fine = [clean[r.doc_id] for r in scores if r.score < 0.05]
    assert len(fine) > 0.9 * len(clean)
    text = "\n".join(fine)
    text = text * (1_000_000 // len(text.split()) + 1)
    (r,) = T.scored(make([(1, text)]), model, ["doc_id"]).collect()
    assert r.score < 0.5 and r.predicted == 0 and r.offending == []


def test_scores_are_the_noisy_or_of_the_sentences(make, fitted):
    """Each text against its sentences scored one by one, plainly."""
    docs, _, model = fitted
    texts = [t for _, t in docs[:40]] + ["word1 idiot you. word2 morons! word3", "nothing known here"]
    for r in T.scored(make(list(enumerate(texts))), model, ["doc_id"]).collect():
        left = 1.0
        for s in texts[r.doc_id].replace("!", ".").split("."):
            x = T.instances(pa.array([s]))
            known = [float(w) for f, w in zip(model.feature, model.weight) if f in set(x.feature.tolist())]
            p = 1 / (1 + np.exp(-(model.bias + sum(known)))) if len(x.feature) else 0.0
            left *= 1 - max(0.0, (p - T.LEAST) / (1 - T.LEAST))
        assert r.score == pytest.approx(1 - left, abs=1e-9)


def test_noisy_or():
    row, p = np.array([0, 0, 2]), np.array([0.5, 0.5, 0.1])
    assert T.noisy_or(row, p, 3) == pytest.approx([0.75, 0, 0.1])


def test_features_count_once_in_a_sentence():
    model = T.Model(np.sort(np.unique(T.instances(pa.array(["idiot"])).feature)), np.full(len(np.unique(T.instances(pa.array(["idiot"])).feature)), 2.0), -5.0)
    one, many = (model.sentence_scores(T.instances(pa.array([t])))[0] for t in ("idiot", "idiot idiot idiot"))
    assert one == pytest.approx(many)


def test_length_alone_is_not_toxic(make, fitted, session):
    """50,000 neutral sentences or lines: without known features, and by a model without weights."""
    _, _, model = fitted
    docs = make([(1, "qqq zzz. " * 50_000), (2, "qqq zzz\n" * 50_000), (3, "qqq zzz. " * 50_000 + "idiot you")])
    assert [(r.score, r.predicted) for r in T.scored(docs, model, ["doc_id"]).orderBy("doc_id").collect()][:2] == [(0.0, 0)] * 2
    assert [r.predicted for r in T.scored(docs, model, ["doc_id"]).orderBy("doc_id").collect()] == [0, 0, 1]
    without = T.train(docs, session.createDataFrame([], "doc_id long, toxic int"))
    assert T.clean(docs, without).count() == 3
