import random

import brute

from insight.llm import pii

PARTS = ["a", "@", ".", "b-", "1", "23", "4111111111111111", " ", "-", "+", "(", ")", "255", "256", "é", "x.y", "@z.q", "\n", "%"]


def test_base_spans_equal_the_patterns():
    anchors, r = pii.automaton(), random.Random(3)
    for _ in range(20_000):
        t = "".join(r.choice(PARTS) for _ in range(r.randint(0, 22)))
        found = pii.find(t, anchors)
        assert [f"{k}:{a}:{b}" for k in pii.BASE_KINDS for a, b in found[k]] == brute.personal(t)[1], repr(t)


def test_added_kinds():
    t = "IBAN: DE89 3704 0044 0532 0130 00, account no. 12345678; postgres://me:secret@db.example.com:5432/x iban DE00 1234"
    found = pii.find(t, pii.automaton())
    assert [t[a:b] for a, b in found["iban"]] == ["DE89 3704 0044 0532 0130 00"]
    assert [t[a:b] for a, b in found["account"]] == ["12345678"]
    assert [t[a:b] for a, b in found["login"]] == ["postgres://me:secret@db.example.com:5432"]


def test_table(make, rows):
    odd = [(-1, None), (-2, ""), (-3, "é" * 100_000 + " a@b.cd"), (None, "1.2.3.4"), (None, "1.2.3.4")]
    out = pii.detect(make(rows + odd)).collect()
    assert len(out) == len(rows) + 5
    texts = dict(rows + odd[:3])
    for r in out:
        counts, spans = brute.personal(texts[r.doc_id] if r.doc_id is not None else "1.2.3.4")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts
        assert r.base_sha256 == brute.sha256(",".join(spans))
        assert set(spans) <= set(r.spans.split(",")) | {""}
    assert pii.detect(make([])).count() == 0
