import base64
import hashlib

import pytest

from vitalog.llm import warc

ROWS = [(1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>two</p>"), (3, "http://a/3", "<p>one</p>"), (4, None, None), (5, "http://a/5", ""),
        (6, "http://a/ 6\r\nX: y", "é" * 40_000), (7, "http://a/7", "a\r\n\r\nb WARC/1.1\r\n"), (None, "http://a/8", "<p>one</p>"),
        (None, "x", "alone"), (9, "http://a/9", "<p>two</p>"), (9, "http://a/9", "<p>two</p>")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "clash", "clash") for r in ROWS], "page_id long, url string, html string, digest string, path string")


def brute(least):
    first = {}
    for page_id, _, html in ROWS:
        known = [x for x in (first.get(html or ""), page_id) if x is not None]
        first[html or ""] = min(known, default=None)
    out = []
    for page_id, _, html in ROWS:
        data = (html or "").encode()
        revisit = len(data) >= least and first[html or ""] is not None and first[html or ""] != page_id
        out.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response",
                    first[html or ""] if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 1, 9, 11])
def test_round_trip(pages, least):
    got = warc.read(warc.write(pages, least_bytes=least)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect()), key=repr) == brute(least)


def test_chosen_records_come_back_with_their_payload(pages):
    index = warc.write(pages)
    got = {r["page_id"]: r for r in warc.read(index.filter("page_id IN (2, 3, 6)"), with_payload=True).collect()}
    assert set(got) == {2, 3, 6}
    assert bytes(got[6]["payload"]) == ("é" * 40_000).encode() and got[6]["url"] == "http://a/%206%0D%0AX:%20y"
    assert got[3]["payload"] is None and got[3]["refers_to"] == 1


def test_ranges_are_coalesced():
    places = [(0, 10), (10, 10), (25, 5), (100, 10), (105, 3)]
    assert list(warc.coalesced(places, gap=5, most=50)) == [(0, 30, [0, 1, 2]), (100, 110, [3, 4])]
    assert [r[2] for r in warc.coalesced(places, gap=1000, most=28)] == [[0, 1], [2], [3, 4]]
    assert list(warc.coalesced([])) == []


def test_damaged_payload_is_an_error():
    raw = warc.record(1, "u", b"body", "A" * 32, None, "1970-01-01T00:00:00Z")
    fields, http, payload = warc.parsed(raw)
    assert payload == b"body" and b"Content-Length: 4" in http and fields["warc-type"] == "response"


def test_empty_table(spark, pages):
    assert warc.read(warc.write(pages.limit(0))).collect() == []
