from __future__ import annotations

from pathlib import Path

from tillroll.llm import warc

SCHEMA = "page_id bigint, url string, html string, refers_to string, same string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "mine", "mine") for r in rows], SCHEMA)


ROWS = [
    (1, "http://a/1", "<p>copy</p>"),
    (2, "http://a/2", "<p>copy</p>"),
    (3, None, "<p>copy</p>"),
    (4, "http://a/\r\n4: x", None),
    (5, "http://a/5", ""),
    (6, "http://a/6", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 3),
    (7, "http://a/7", "é漢🙂" * 100_000),
    (8, "http://a/8", "alone"),
    (9, "u", "twice"),
    (9, "u", "twice"),
    (None, "u", "twice"),
    (None, "u", "never an id"),
    (None, "u", "never an id"),
]


def test_round_trip(spark, tmp_path):
    manifest = warc.write_archives(pages(spark, ROWS), folder=str(tmp_path))
    got = sorted(map(tuple, warc.read_archives(manifest).collect()), key=str)
    leader = {"<p>copy</p>": 3, "": 5, "twice": 9}
    expected = []
    for page_id, _, html in ROWS:
        payload = (html or "").encode()
        top = leader.get(html or "")
        other = top if top is not None and top != page_id else None
        kind = "response" if other is None else "revisit"
        expected.append((page_id, len(payload), warc.payload_digest(payload), kind, other))
    assert got == sorted(expected, key=str)


def test_small_payloads_are_responses(spark, tmp_path):
    manifest = warc.write_archives(pages(spark, ROWS), folder=str(tmp_path), min_revisit_bytes=1)
    kinds = {r["page_id"]: r["record_type"] for r in warc.read_archives(manifest).collect()}
    assert kinds[4] == kinds[5] == "response" and kinds[1] == "revisit"


def test_archive_begins_with_its_dictionary(spark, tmp_path):
    manifest = warc.write_archives(pages(spark, [(k, "u", f"<p>page {k}</p>" * 20) for k in range(500)]).coalesce(1), str(tmp_path))
    path = manifest.first()["path"]
    data = Path(path).read_bytes()
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_FRAME
    assert len(list(warc.records(path))) == 501  # and the file's own description
    assert len(data) < 500 * 120


def test_empty_table(spark):
    assert warc.read_archives(warc.write_archives(pages(spark, []))).collect() == []


def test_wrong_payload_is_noticed():
    import pytest

    head = {b"WARC-Type": b"response", b"WARC-Record-ID": b"<urn:page:1>", b"WARC-Payload-Digest": b"sha1:AAAA"}
    with pytest.raises(ValueError):
        warc._described(head, b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nab")
