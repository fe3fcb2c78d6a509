import gzip
import hashlib
import random

import pytest

from textguard.llm import archives
from textguard.llm.scratch import new_folder


def expected(rows):
    held = [(page, (html or "").encode()) for page, _, html in rows]
    least = {}
    for page, payload in held:
        if len(payload) >= 100 and page is not None:
            least[payload] = min(page, least.get(payload, page))
    out, used = [], set()
    for page, payload in sorted(held, key=lambda x: (x[0] is None, x[0] or 0)):
        again = payload in least and payload in used
        used.add(payload)
        digest = hashlib.sha256(payload).hexdigest()
        out.append((page, len(payload), digest, "revisit" if again else "response", least[payload] if again else None))
    return sorted(out, key=repr)


def rows():
    rng = random.Random(1)
    same = "<p>" + "é\r\n\r\nWARC/1.1\r\n" * 30
    out = [(i, f"http://x/{i}", "".join(rng.choices("ab\r\n é<", k=rng.choice([0, 50, 99, 100, 3000])))) for i in range(80)]
    out += [(i, None, same) for i in (203, 201, 202, 201)] + [(300, "http://h/a b\nc\td?q=é%20%", same), (301, "u", None), (302, "", "short")]
    return out + [(303, "u", "short"), (None, "n", same), (304, "big", "x\n" * 3_000_000), (-5, "neg", "z" * 100), (6, "pos", "z" * 100)]


def test_round_trip(spark):
    frame = spark.createDataFrame(rows(), "page_id bigint, url string, html string").repartition(3)
    found = archives.convert_pages(frame).collect()
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found]
    assert sorted(got, key=repr) == expected(rows())
    assert len({r.record_id for r in found}) == len(rows()) and {r.warc_date for r in found} == {"2009-08-07T06:05:04Z"}
    urls = {r.page_id: r.url for r in found}
    assert urls[300] == "http://h/a b\nc\td?q=é%20%" and urls[201] == "urn:none"


def test_both_versions_are_parsed_by_declared_lengths(spark):
    for version in (1, 2):
        body = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nline\nhttp://fake 0 20000101 text/html 3\nrest\n\n"
        archive = archives.version_block("f.arc", version, "20010203040506") + b"\n"
        archive += archives.arc_header("http://a", "1.2.3.4", "2001020304", "text/html", 200, version, 9, "f.arc", len(body)) + body + b"\n"
        archive += archives.arc_header("dns:a", "1.2.3.4", "20010203", "text/dns", 200, version, 9, "f.arc", 4) + b"a\nb\n" + b"\n"
        first, second = archives.records(archive, "f.arc")
        assert (first.url, first.block, second.block, second.kind) == ("http://a", body, b"a\nb\n", "text/dns")
        frame = spark.createDataFrame([("f.arc", bytearray(archive))], "name string, archive binary")
        folder = new_folder(spark, "warc-test")
        archives.write_archives(archives.to_warc(frame), folder)
        made = {r.url: r for r in archives.read_archives(spark, folder).collect()}
        assert made["http://a"].record_type == "response" and made["dns:a"].record_type == "resource"
        assert made["http://a"].warc_date == "2001-02-03T04:00:00Z" and made["dns:a"].payload_bytes == 4
        with pytest.raises(ValueError, match="is cut"):
            list(archives.records(archive[:-3], "f.arc"))
    with pytest.raises(ValueError, match="no version block"):
        list(archives.records(b"http://a 0 0 t 3\n1 x", "f.arc"))


def test_blanks_in_urls_and_heads_with_line_feeds(spark):
    for version in (1, 2):
        body = b"HTTP/1.0 200 OK\nX-Record-Number: 7\nContent-Type: text/html\n\nfirst\r\n\r\nsecond"
        archive = archives.version_block("f.arc", version, "20010203040506") + b"\n"
        archive += archives.arc_header("http://a/b c  d", "1.2.3.4", "20010203", "text/html", 200, version, 9, "f.arc", len(body)) + body + b"\n"
        frame = spark.createDataFrame([("f.arc", bytearray(archive))], "name string, archive binary")
        folder = new_folder(spark, "warc-test")
        archives.write_archives(archives.to_warc(frame), folder)
        (made,) = archives.read_archives(spark, folder).collect()
        assert (made.url, made.record_type, made.page_id) == ("http://a/b c  d", "response", 7)
        assert made.payload_bytes == len(b"first\r\n\r\nsecond") and made.warc_date == "2001-02-03T00:00:00Z"


def test_archives_are_closed_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(archives, "WARC_BYTES", 10_000)
    frame = spark.createDataFrame([(i, "u", f"{i} " * 2000) for i in range(40)], "page_id bigint, url string, html string").repartition(2)
    folder = new_folder(spark, "warc-test")
    archives.write_archives(archives.to_warc(archives.pages_to_arc(frame)), folder)
    sizes = [len(gzip.decompress(r.content)) for r in spark.read.format("binaryFile").load(folder).collect()]
    assert len(sizes) > 10 and max(sizes) < 10_000 + 7_000
    assert archives.read_archives(spark, folder).count() == 40


def test_a_hot_payload_does_not_move_payloads_by_digest(spark):
    """With broadcasts off, payloads travel by the record's id; the digest moves narrow rows only."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        frame = spark.createDataFrame([(i, "u", "same " * 50) for i in range(30)], "page_id bigint, url string, html string")
        plan = archives.to_warc(archives.pages_to_arc(frame))._jdf.queryExecution().optimizedPlan().toString()
        joins = [line for line in plan.splitlines() if " Join " in f" {line.strip(' +-:')}"]
        assert len(joins) == 2 and "id#" in joins[0] and "digest#" in joins[1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_no_pages(spark):
    assert archives.convert_pages(spark.createDataFrame([], "page_id bigint, url string, html string, id string")).count() == 0
