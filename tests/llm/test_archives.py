import base64
import gzip
import hashlib

import pytest

from inkstream.llm import archives as a

SCHEMA = "page_id long, url string, html string, sha string, refers string, top long"
PAGES = [(1, "http://a/x y", "<p>one</p>"), (2, "http://b", "<p>one</p>"), (3, None, None), (4, "http://c", ""), (5, "http://d\n", "é" * 3000), (6, "http://e", "WARC/1.1\r\n\r\nHTTP/1.1 200\r\n\r\n"), (7, "http://f", "\r\n\r\n"), (8, "http://g", "<p>one</p>"), (8, "http://g", "<p>one</p>")]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("least", [0, 5])
def test_every_page_has_its_record(spark, version, least):
    back = a.read_archives(a.write_archives(pages(spark), least=least, version=version)).collect()
    assert len(back) == len(PAGES) and all(r.block_ok for r in back)
    body = {k: (h or "").encode() for k, _, h in PAGES}
    for r in back:
        k = int(r.page)
        equal = [i for i, b in body.items() if b == body[k]]
        top = max(equal)
        revisit = len(body[k]) >= least and k != top
        assert (r.record_type, r.refers_to) == (("revisit", str(top)) if revisit else ("response", None))
        assert r.payload_bytes == len(body[k])
        assert r.payload_digest == base64.b32encode(hashlib.sha1(body[k]).digest()).decode()
        if revisit:
            assert r.refers_to_id in {x.record_id for x in back if x.page == str(top)}


def test_many_equal_payloads_take_the_salted_join(spark, monkeypatch):
    monkeypatch.setattr(a, "BROADCAST_ROWS", 0)
    back = a.read_archives(a.write_archives(pages(spark, [(i, "u", str(i % 3)) for i in range(60)]))).collect()
    assert {int(r.page): r.refers_to and int(r.refers_to) for r in back} == {i: None if i >= 57 else 57 + i % 3 for i in range(60)}


def test_empty_table_and_null_ids(spark):
    assert a.read_archives(a.write_archives(pages(spark, []))).collect() == []
    back = a.read_archives(a.write_archives(pages(spark, [(None, "u", "x"), (None, "v", "x")]))).collect()
    assert [(r.page, r.record_type) for r in back] == [(None, "response")] * 2


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    records = [a.Record("http://a", "20240102030405", b"HTTP/1.0 200 OK\r\n\r\n", b"\n\nbody\n1 2 3 4 5\n"), a.Record("dns:a", "2024", b"", b"plain")]
    data = a.write_arc(records, version)
    assert [(r.url, r.date, r.head, r.payload) for r in a.read_arc(data)] == [(r.url, r.date, r.head, r.payload) for r in records]
    with pytest.raises(a.BadArchive):
        list(a.read_arc(data[:-8]))


def test_synthesised_fields():
    record = a.Record("http://a", "20240102030405", b"HTTP/1.0 200 OK\r\nX-Page-Id: 7\r\n\r\n", b"body")
    ((fields, block),) = a.read_warc(a.to_warc(record))
    assert fields["warc-date"] == "2024-01-02T03:04:05Z" and fields["warc-type"] == "response" and block.endswith(b"body")
    assert fields["warc-record-id"] == a.record_id("7", a.base32_sha1(b"body"))
    ((fields, block),) = a.read_warc(a.to_warc(record, "9"))
    assert fields["warc-profile"] == a.REVISIT_PROFILE and block == record.head and fields["warc-payload-length"] == "4"


def test_archives_are_readable_gzip(spark):
    rows = a.write_archives(pages(spark)).collect()
    assert sum(gzip.decompress(r.warc).count(b"WARC/1.1\r\nWARC-Type") for r in rows) == len(PAGES)


def test_ids_of_any_kind_come_back(spark):
    ids = [" a ", "b\r\nX: y", "c: d", "%41", "é\U0001f600", "", "\t", "100% sure", "x\x00y"]
    rows = [(i, "http://h", f"own {n}") for n, i in enumerate(ids)] + [(i, "http://h", "shared") for i in ids]
    back = a.read_archives(a.write_archives(spark.createDataFrame(rows, "page_id string, url string, html string"))).collect()
    top = max(ids)
    assert sorted((r.page, r.refers_to, r.record_type) for r in back if r.refers_to is not None) == sorted((i, top, "revisit") for i in ids if i != top)
    assert sorted(r.page for r in back if r.refers_to is None) == sorted([*ids, top])
    responses = {r.record_id for r in back if r.record_type == "response"}
    assert all(r.refers_to_id in responses and r.block_ok for r in back if r.record_type == "revisit")
