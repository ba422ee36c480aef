"""Bundles: exact round trip, single frames, revisits."""

import hashlib

import pytest

from cairn.llm import warc

ROWS = [
    (1, "http://a/ b", "<p>x</p>"),
    (2, None, None),
    (3, "http://c", ""),
    (4, "http://d\r\nX: y", "é𝒳\r\n\r\nWARC/1.1\r\n" * 40000),
    (5, "http://e", "<p>x</p>"),
    (None, "http://f", "<p>x</p>"),
    (5, "http://e", "<p>x</p>"),
    (7, "http://g", "only"),
]


def test_round_trip(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "1 as payload", "2 as _sha", "3 as record_id")
    manifest = warc.write_bundles(df)
    got = warc.read_bundles(manifest).collect()
    assert len(got) == len(ROWS) == manifest.count()
    plain = {}
    for p, _, h in ROWS:
        plain.setdefault(p, set()).add((h or "").encode())
    for r in got:
        assert r.record_type in ("response", "revisit")
        if r.record_type == "response":
            assert bytes(r.payload) in plain[r.page_id] and r.payload_bytes == len(r.payload)
    kind = sorted((r.page_id if r.page_id is not None else -1, r.record_type, r.refers_to) for r in got)
    assert kind == [(-1, "response", None), (1, "revisit", None), (2, "response", None), (3, "revisit", 2), (4, "response", None), (5, "revisit", None), (5, "revisit", None), (7, "response", None)]


def test_identifiers_are_unique_and_refer(spark):
    rows = [(1, "u", "x"), (2, "u", "x"), (3, "u", "y"), (3, "u", "y"), (4, "u", "y"), (None, "u", "z"), (None, "u", "z"), (9, "u", "q")]
    manifest = warc.write_bundles(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    records = {}
    for r in manifest.collect():
        reader = warc.BundleReader(r.bundle)
        part = reader.frame(r.frame)[r.offset : r.offset + r.length]
        assert r.record_id not in records and f"WARC-Record-ID: {r.record_id}".encode() in part
        records[r.record_id] = part.decode()
    assert len(records) == len(rows)
    names = [line.split(": ")[1] for t in records.values() for line in t.split("\r\n") if line.startswith("WARC-Refers-To: ")]
    assert len(names) == 1 and "X-Page-ID: 1\r\n" in records[names[0]]  # page 4 names its page, of which there are two records


def test_bundles_are_read_in_many_tasks(spark):
    df = spark.createDataFrame([(i, "u", hashlib.sha512(str(i).encode()).hexdigest() * 700) for i in range(120)], "page_id long, url string, html string")
    found = warc.read_bundles(warc.write_bundles(df), with_payload=False)
    assert found.rdd.getNumPartitions() >= 4 and found.count() == 120


def test_one_record_needs_one_frame(spark):
    df = spark.createDataFrame([(i, "u", hashlib.sha512(str(i).encode()).hexdigest() * 300) for i in range(60)], "page_id long, url string, html string").coalesce(1)
    rows = warc.write_bundles(df).collect()
    assert len({(r.bundle, r.frame) for r in rows}) > 3
    r = next(x for x in rows if x.page_id == 41)
    reader = warc.BundleReader(r.bundle)
    part = reader.frame(r.frame)[r.offset : r.offset + r.length]
    (only,) = warc.parse_records(part)
    assert only["record_id"] == r.record_id and only["payload"].decode() == hashlib.sha512(b"41").hexdigest() * 300
    assert reader.frames[r.frame][:2] == (r.frame_start, r.frame_bytes)


def test_a_changed_payload_is_noticed():
    _, record = warc.build_record(1, "u", b"abc", None, False)
    with pytest.raises(ValueError):
        list(warc.parse_records(record.replace(b"abc", b"abd")))


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_bundles(warc.write_bundles(df)).count() == 0
