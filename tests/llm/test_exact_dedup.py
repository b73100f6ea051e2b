import brute
import pytest

from insight.llm import exact_dedup as E

ROWS = [(1, "Same Text"), (5, "same text"), (3, "SAME TEXT"), (2, None), (4, ""), (7, "other"), (7, "other"), (None, "other"),
        (None, "lonely"), (8, "Ä upper stays"), (9, "ä upper stays"), (10, "long " * 50_000)]


def test_decisions(session, make):
    out = E.decide(make(ROWS), E.new_index(session)).collect()
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in out), key=str)
    want = [(1, 5, 3, False), (5, 5, 3, True), (3, 5, 3, False), (2, 4, 2, False), (4, 4, 2, True), (7, 7, 3, True),
            (7, 7, 3, True), (None, 7, 3, False), (None, None, 1, True), (8, 8, 1, True), (9, 9, 1, True), (10, 10, 1, True)]
    assert got == sorted(want, key=str)
    assert {bytes(r.digest).hex() for r in out if r.doc_id == 5} == {brute.sha256("same text")}


def test_one_row_of_each_text_stays_with_its_columns(session, make):
    docs = make(ROWS)
    out = E.deduplicate(docs, E.new_index(session))
    assert out.columns == docs.columns
    assert sorted((str(r.doc_id) for r in out.collect())) == sorted(["5", "4", "7", "None", "8", "9", "10"])


def test_index_outlives_batches(session, make):
    index = E.new_index(session)
    first = {r.doc_id: r.kept for r in E.decide(make([(1, "a"), (2, "b")]), index).collect()}
    second = {r.doc_id: (r.keep_id, r.kept) for r in E.decide(make([(9, "a"), (3, "c")]), index).collect()}
    again = {r.doc_id: r.kept for r in E.decide(make([(1, "a"), (2, "b")]), index).collect()}
    assert first == again == {1: True, 2: True}
    assert second == {9: (1, False), 3: (3, True)}
    assert index.read().count() == 3
    # another session finds the same files
    reopened = E.DigestIndex(session, index.path, index.buckets)
    assert reopened.read().count() == 3


def test_reopened_index_keeps_its_buckets(session, make):
    """Opened by a session with another partition count, after the catalogue has forgotten it."""
    from insight.session import scratch_path

    path, rows = scratch_path(session, "index"), [(i, f"text {i}") for i in range(200)]
    first = E.DigestIndex(session, path, 4)
    E.decide(make(rows), first).count()
    first.drop()
    with pytest.raises(ValueError):
        E.DigestIndex(session, path, 7)
    again = E.DigestIndex(session, path)
    assert again.buckets == 4
    E.decide(make([(i + 1000, t) for i, t in rows]), again).count()
    assert again.read().count() == 200
    again.compact(7)
    E.decide(make(rows + [(900, "new")]), again).count()
    assert again.read().count() == 201 and again.buckets == 7


@pytest.mark.parametrize("cut", [-5, 5, 8, 99])
def test_two_appends_decide_alike(session, make, cut):
    whole = sorted(map(str, E.decide(make(ROWS), E.new_index(session)).collect()))
    index = E.new_index(session)
    assert sorted(map(str, E.decide(make(ROWS), index, cut).collect())) == whole
    assert index.read().count() == index.read().distinct().count() == 7


def test_empty_table(session, make):
    assert E.decide(make([]), E.new_index(session)).count() == 0
    assert E.deduplicate(make([]), E.new_index(session)).count() == 0
