"""Archives written and read back, held against the pages themselves."""

import base64
import gzip
import hashlib
import random
import urllib.parse
from collections import defaultdict

import pytest

from firnline.llm import warc
from firnline.llm.storage import Scratch

SCHEMA = "page_id long, url string, html string"


def slow(rows, least=0):
    groups = defaultdict(list)
    for i, u, h in rows:
        groups[(h or "").encode()].append((i is not None, i or 0, u is not None, u or ""))
    out = []
    for data, own in groups.items():
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        own.sort(reverse=True)
        for k, (has, i, _, _) in enumerate(own):
            revisit = k > 0 and len(data) >= least
            out.append((i if has else None, len(data), digest, "revisit" if revisit else "response", (own[0][1] if own[0][0] else None) if revisit else None))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=repr)


def made():
    rng = random.Random(4)
    hosts = ["a.example.com", "B.Example.com", "example.org", "10.0.0.1", "user:x@shop.example.net:8080"]
    rows = [(i, f"https://{rng.choice(hosts)}/p/{rng.randint(0, 40)}?q={rng.randint(0, 3)}#f", f"<p>{rng.randint(0, 90)} é</p>") for i in range(400)]
    rows += [(500 + i, "http://hot.example.com/", "same") for i in range(300)]
    rows += [(900, "http://x.example/a b\r\nX-Page-Id: 7", None), (901, None, ""), (None, "http://n.example", "null id"), (None, None, "null id"), (None, None, None)]
    rows += [(910, "http://t.example/", "twin")] * 5 + [(910, "http://s.example/", "twin"), (3, "http://s.example/", "twin")]
    rows += [(920, "http://long.example/ü", "long é " * 300_000), (-5, "not a url", "x\r\n\r\ny"), (930, "http://example.org", "\r\n\r\n"), (931, "//example.org?x=1", "tail\r\n\r\n")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, monkeypatch, least):
    monkeypatch.setattr(warc, "BLOCK_LINES", 9)
    rows = made()
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA + ", sha string, kind int").repartition(5)
    assert got(warc.archive_pages(df, least)) == slow(rows, least)


def test_records_by_host(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    rows = made()
    scratch = Scratch(spark, "warc")
    entries = warc.write_archives(spark.createDataFrame(rows, SCHEMA).repartition(3), scratch.path("archives"), scratch, archive_bytes=5000)
    assert entries.select("file").distinct().count() > 5
    shards = warc.build_index(entries, scratch.path("index"), scratch)
    ranges = spark.createDataFrame([("com,example,", "com,example,\x7f"), ("net,example,shop)/p/1", "net,example,shop)/p/1\x7f"), ("zz", "zzz"), (None, "b")], "low string, high string")
    records = warc.read_records(warc.find(shards, ranges), scratch.path("archives")).collect()

    def host(url):
        return (urllib.parse.urlsplit(url).hostname or "") if url and "://" in url else ""

    wanted = [r for r in rows if host(r[1]).endswith(".example.com") or (host(r[1]) == "shop.example.net" and urllib.parse.urlsplit(r[1]).path.startswith("/p/1"))]
    assert sorted(r.page_id for r in records) == sorted(r[0] for r in wanted)
    texts = {r[0]: r[2] for r in rows}
    assert all(r.payload.decode() == texts[r.page_id] for r in records if r.record_type == "response")
    assert all(r.payload is None for r in records if r.record_type == "revisit")


def test_archives_are_plain_gzip(spark):
    scratch = Scratch(spark, "warc")
    entries = warc.write_archives(spark.createDataFrame([(1, "http://a.example/x", "héllo"), (2, "http://a.example/y", "héllo")], SCHEMA).coalesce(1), scratch.path("archives"), scratch)
    files = {r.file for r in entries.collect()}
    raw = b"".join(gzip.open(f"{scratch.path('archives').removeprefix('file://')}/{f}").read() for f in sorted(files))
    assert raw.count(b"WARC/1.1\r\n") == 2 and raw.count("héllo".encode()) == 1
    ids = [line.split(b" ")[1] for line in raw.split(b"\r\n") if line.startswith(b"WARC-Record-ID")]
    refers = [line.split(b" ")[1] for line in raw.split(b"\r\n") if line.startswith(b"WARC-Refers-To:")]
    assert len(set(ids)) == 2 and len(refers) == 1 and refers[0] in ids


def test_damage_is_found():
    row = {"page_id": 1, "url": "http://a.example", "size": 3, "sha1": hashlib.sha1(b"abc").hexdigest(), "ref_page": None, "ref_uri": None}
    whole = warc.record("response", row, b"abc", "")
    assert warc.parsed(whole)["payload"] == b"abc"
    for broken in (whole[:-1], whole + b"x", warc.record("response", row, b"abd", ""), warc.record("response", row, b"abcd", "")):
        with pytest.raises(Exception):
            warc.parsed(broken)


def test_keys(spark):
    urls = ["HTTP://user@WWW.Example.com:80/A?b#c", "example.org", "http://10.0.0.1/x", None, "", "http://h.example?q=1", "http://h.example/a b\n"]
    found = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(warc.url_key(__import__("pyspark.sql.functions").sql.functions.col("u"))).collect()]
    assert found == ["com,example,www)/A?b", "org,example)/", "10.0.0.1)/x", ")/", ")/", "example,h)/?q=1", "example,h)/a%20b"]


def test_empty(spark):
    assert warc.archive_pages(spark.createDataFrame([], SCHEMA)).count() == 0
