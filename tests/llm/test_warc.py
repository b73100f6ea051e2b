import hashlib

import pytest

from insight.llm import warc as A
from insight.session import scratch_path

BIG, SMALL = "x" * 1500, "tiny"
PAGES = [(1, "http://a/1", BIG), (2, "http://a/2", BIG), (9, "http://a b\n/9", BIG), (3, None, SMALL), (4, "http://a/4", SMALL),
         (5, "u", None), (6, "u", "WARC/1.0\r\nContent-Length: 9\r\n\r\n\r\n\r\nWARC/1.0\r\n" + "é\r\n\r\n" * 400),
         (None, "n", BIG), (7, "seven", "z" * 300_000), (7, "seven", "z" * 300_000)]


def through(session, rows):
    pages = session.createDataFrame(rows, "page_id long, url string, html string").withColumn("block", A.F.lit("clash"))
    archives = A.arc_of_pages(pages)
    path = scratch_path(session, "warc-test")
    A.write_warc(A.with_types(A.convert(archives), A.convert(archives, blocks=False)), path, file_records=3)
    return A.read_warc(session, path).collect()


def test_pages_through_archives(session):
    out = through(session, PAGES)
    got = {(r.page_id, r.payload_bytes): (r.payload_digest, r.record_type, r.refers_to) for r in out}
    assert len(out) == len(PAGES)
    for page_id, _, html in PAGES:
        data = (html or "").encode()
        digest, kind, refers = got[page_id, len(data)]
        assert digest == hashlib.sha1(data).hexdigest()
        assert (kind, refers) == (("revisit", 9) if html == BIG and page_id != 9 else ("response", None))
    assert {r.uri for r in out if r.page_id == 9} == {"http://a%20b%0A/9"}
    assert {r.date for r in out} == {"2020-01-01T00:00:00Z"}
    assert len({r.record_id for r in out}) == len(out)


def test_empty_table(session):
    assert through(session, []) == []


@pytest.mark.parametrize("version", [1, 2])
def test_header_lines_of_both_versions(version):
    body = b"HTTP/1.0 200 OK\r\n\r\nhello\nthere"
    blob = A.arc_header("f.arc", version) + A.arc_record(5, "http://x/", b"pay\nload", "f.arc", version)
    (fields, block), = A.parse_arc(blob)
    assert fields["url"] == "http://x/" and A.split_http(block)[1] == b"pay\nload"
    assert set(fields) == set(A.FIELDS_V1 if version == 1 else A.FIELDS_V2)
    assert A.split_http(body) == ("HTTP/1.0 200 OK", b"hello\nthere")


def test_damaged_archives_are_named():
    good = A.arc_header("f.arc", 1) + A.arc_record(5, "u", b"payload", "f.arc", 1)
    with pytest.raises(ValueError, match="cut off"):
        list(A.parse_arc(good[:-5]))
    with pytest.raises(ValueError, match="fields"):
        list(A.parse_arc(A.arc_header("f.arc", 2) + A.arc_record(5, "u", b"payload", "f.arc", 1)))
    with pytest.raises(ValueError, match="version"):
        list(A.parse_arc(b"filedesc://f 0.0.0.0 20200101 text/plain 2\n7 \n"))


def test_short_dates():
    assert A.warc_date("1997") == "1997-01-01T00:00:00Z"
    assert A.warc_date("20010203040506") == "2001-02-03T04:05:06Z"


def test_gzip_members_and_archive_rows(session):
    import gzip

    blob = gzip.compress(A.arc_header("f.arc", 1)) + gzip.compress(A.arc_record(5, "u", b"payload", "f.arc", 1))
    df = session.createDataFrame([("f.arc.gz", bytearray(blob))], "path string, content binary")
    (r,) = A.convert(df).collect()
    assert (r.page_id, r.payload_bytes, r.payload_digest) == (5, 7, hashlib.sha1(b"payload").hexdigest())


def test_equal_rows_of_several_tasks_have_ids_of_their_own(session):
    pages = session.createDataFrame([(1, "http://a/", "same")] * 10, "page_id long, url string, html string").repartition(5)
    rows = A.convert(A.arc_of_pages(pages)).collect()
    assert len({r.record_id for r in rows}) == 10


def test_a_cut_off_gzip_member_is_an_error():
    import gzip

    blob = gzip.compress(b"one" * 100) + gzip.compress(b"two" * 100)
    assert A.gunzip(blob) == b"one" * 100 + b"two" * 100
    with pytest.raises(ValueError, match="cut off"):
        A.gunzip(blob[:-6])
