import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from insight.llm import bpe


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.vocabulary())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.vocabulary())


PARTS = [" ", "  ", "\n", "\t", "a", "the", "ing", "'s", "'", "'ll", "1", "23", "é", "ß", "|", "&&", "...", "<|endoftext|>", " ",
         "　", "中", "🙂", "\x1c", "\x85", "Ð", "é", "re", "."]


def texts():
    r = random.Random(5)
    made = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 40))) for _ in range(1500)]
    return [*made, None, "", "a" * 3000, " " * 500, "ab" * 1000, "don't 's's ''s I'm we'll x'rex", "<|endoftext|>"]


def test_ids_equal_the_library(codec, library):
    import pyarrow as pa

    made = texts()
    ids, first = codec.encoder().column(pa.array(made))
    for k, t in enumerate(made):
        own = ids[first[k]:first[k + 1]]
        want = library.encode(t or "", add_special_tokens=False).ids
        assert own.tolist() == want, repr(t)
        assert codec.decode(own) == library.decode(want, skip_special_tokens=False)


def test_every_code_point(codec, library):
    """Each code point among letters, numbers, marks and blanks: the ids are the library's."""
    import pyarrow as pa

    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    step = 512
    made = ["".join(f"x{chr(c)}x1{chr(c)}1 !{chr(c)} {chr(c)}" for c in points[a:a + step]) for a in range(0, len(points), step)]
    for a in range(0, len(made), 100):
        part = made[a:a + 100]
        ids, first = codec.encoder().column(pa.array(part))
        for k, want in enumerate(library.encode_batch(part, add_special_tokens=False)):
            assert ids[first[k]:first[k + 1]].tolist() == want.ids, hex(points[(a + k) * step])


def test_a_column_of_the_made_name_is_replaced(session):
    docs = session.createDataFrame([(1, "Hello wörld", "x")], "doc_id long, text string, IDS string")
    (r,) = bpe.decode(bpe.encode(docs, bpe.vocabulary()).selectExpr("*", "1 AS Text"), bpe.vocabulary()).collect()
    assert r.asDict() == {"doc_id": 1, "text": "Hello wörld"}
    only = bpe.encode(docs.select("text"), bpe.vocabulary())
    assert only.columns == ["ids"] and only.limit(0).collect() == []


def test_memory_is_bounded_without_changing_results(codec, library, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(bpe, "MEMORY", 5)
    encoder = codec.encoder()
    for t in texts()[:60]:
        ids, _ = encoder.column(pa.array([t]))
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids


def test_broken_bytes_decode_as_the_library_does(codec, library):
    ids = library.encode("é🙂", add_special_tokens=False).ids[:-1]
    assert codec.decode(np.array(ids)) == library.decode(ids, skip_special_tokens=False)


def test_columns_round_trip(make):
    docs = make([(1, "Hello wörld"), (2, None), (None, ""), (1, "Hello wörld")])
    encoded = bpe.encode(docs, bpe.vocabulary())
    assert "ids" in encoded.columns and "text" not in encoded.columns
    out = bpe.decode(encoded, bpe.vocabulary())
    assert sorted((r.text for r in out.collect())) == ["", "", "Hello wörld", "Hello wörld"]
    assert bpe.round_trip(make([]), bpe.vocabulary()).count() == 0


def test_digests(make, rows, library):
    import hashlib

    got = {r.doc_id: r for r in bpe.round_trip(make(rows), bpe.vocabulary()).collect()}
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
