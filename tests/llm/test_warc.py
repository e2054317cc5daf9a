import base64
import hashlib
import io

import pytest
import zstandard

from circadia.llm import warc

PAGES = [(1, "http://a/", "x" * 500), (2, None, "x" * 500), (3, "http://b/ %\r\nü", "y"), (4, "u", None), (5, "u", ""), (None, "n", "x" * 500),
         (None, None, "alone"), (2, "again", "x" * 500), (9, "long", "é<p>" * 60_000), (10, "many", "z"), (11, "many", "z"), (12, "many", "z")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, payload int").repartition(3)


def test_round_trip(pages):
    manifest = warc.write_archives(pages)
    rows = warc.read_archives(manifest).collect()
    last = {}
    for page_id, _, html in PAGES:
        last[html or ""] = max(last.get(html or "", -1), -1 if page_id is None else page_id)
    expected = []
    for page_id, url, html in PAGES:
        raw = (html or "").encode()
        first = (-1 if page_id is None else page_id) == last[html or ""]
        expected.append((page_id, url, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(),
                         "response" if first else "revisit", None if first else last[html or ""], raw if first else None))
    got = [(r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in rows]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert warc.read_archives(warc.write_archives(pages.where("false"))).collect() == []


def test_short_payloads_are_not_revisited(pages):
    rows = warc.read_archives(warc.write_archives(pages, min_revisit_bytes=100)).collect()
    assert {r.record_type for r in rows if r.payload_bytes < 100} == {"response"}
    assert sum(r.record_type == "revisit" for r in rows) == 2


def archive(records, dictionary=True):
    frame, known = warc.dictionary_frame(records * 40 if dictionary else [])
    press = zstandard.ZstdCompressor(dict_data=known) if known else zstandard.ZstdCompressor()
    return frame + b"".join(press.compress(r) for r in records)


def test_frames_with_and_without_dictionary():
    records = [warc.to_record(i, f"u{i}", bytes([65 + i % 20]) * (i * 37), None, "1970-01-01T00:00:00Z") for i in range(50)]
    for dictionary in (True, False):
        raw = archive(records, dictionary)
        assert raw[:4] == bytes.fromhex("5d2a4d18")
        assert list(warc.frames(io.BytesIO(raw))) == records
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.frames(io.BytesIO(raw[:-3])))
    with pytest.raises(ValueError):
        list(warc.frames(io.BytesIO(raw[8:] + raw[:8])))


def test_records_are_validated():
    good = warc.to_record(1, "u", b"hello", None, "1970-01-01T00:00:00Z")
    assert warc.from_record(good)["payload"] == b"hello"
    for bad in (good[:-1], good.replace(b"hello", b"hellp"), good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"WARC-Type", b"WARC-Tipe"),
                good.replace(b"response\r\nWARC-R", b"metadata\r\nWARC-R"), good + b"x"):
        with pytest.raises(ValueError):
            warc.from_record(bad)
