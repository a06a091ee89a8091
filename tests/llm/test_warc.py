"""Archives written and read back, split at any byte."""

import gzip
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from exonloom.llm import warc

FIELDS = "page_id long, url string, html binary, payload string"


def round_trip(spark, rows, path, **options):
    pages = spark.createDataFrame(rows, FIELDS).repartition(3)
    warc.write_warc(warc.with_revisits(pages, "page_id", "url", F.col("html")), str(path), **options)
    return warc.read_warc(spark, str(path)).collect()


def rows_of(rng):
    big = bytes(rng.randrange(256) for _ in range(3000)) + warc.MAGIC * 40 + b"x" * 3000
    out = [(i, f"http://a/{i}%0A", bytes(rng.randrange(256) for _ in range(rng.randrange(3000))), "p") for i in range(40)]
    out += [(100 + i, "http://copy/\n", big, "p") for i in range(5)] + [(200 + i, None, b"small", "p") for i in range(3)]
    return out + [(300, "u", None, "p"), (301, "u", b"", "p"), (302, "u", b"\r\n\r\n" + warc.MAGIC, "p")]


@pytest.mark.parametrize(("level", "split"), [(6, None), (0, 700), (0, 97), (6, 1000)])
def test_round_trip_at_any_split(spark, tmp_path, level, split):
    rows = rows_of(random.Random(level))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        if split:
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = round_trip(spark, rows, tmp_path / "w", level=level)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(got) == len(rows)
    for r in got:
        k = int(r["record_id"].split(":")[-1])
        _, url, payload, _ = next(x for x in rows if x[0] == k)
        payload = payload or b""
        assert r["uri"] == url and r["payload_bytes"] == len(payload)
        assert r["payload_digest"] == hashlib.sha1(payload).hexdigest()
        again = 100 <= k < 104
        assert (r["record_type"], r["refers_to"]) == (("revisit", "urn:page:104") if again else ("response", None))
        assert r["payload"] == (None if again else payload)


def test_files_are_plain_gzip(spark, tmp_path):
    round_trip(spark, rows_of(random.Random(1)), tmp_path / "w")
    whole = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("part-*"))
    assert whole.count(b"WARC/1.1\r\n") >= 51


def test_foreign_archives_and_garbage(spark, tmp_path):
    record = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:1>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    torn = gzip.compress(record)[:-9]
    body = b"junk" + gzip.compress(b"not a record") + gzip.compress(record, mtime=5) + torn + gzip.compress(record.replace(b"x:1", b"x:2"))
    (tmp_path / "a.bin").write_bytes(body)
    (tmp_path / "empty.bin").write_bytes(b"")
    got = sorted((r["record_id"], r["record_type"], bytes(r["payload"])) for r in warc.read_warc(spark, str(tmp_path)).collect())
    assert got == [("urn:x:1", "resource", b"hello"), ("urn:x:2", "resource", b"hello")]


def test_large_records_end_in_an_empty_member():
    record = {"record_id": "urn:page:1", "uri": None, "record_type": "response", "refers_to": None, "payload_digest": "", "payload_bytes": 0, "payload": b"a" * (1 << 25)}
    packed = warc.member(record, 1) + b"\0"
    assert packed.endswith(zlib.compress(b"", wbits=31)[-8:]) and gzip.decompress(packed).count(b"a" * (1 << 25)) == 1


def test_null_and_repeated_keys_and_nothing(spark, tmp_path):
    body = b"z" * 1500
    rows = [(None, "u", body, ""), (7, "u", body, ""), (7, "u", body, ""), (3, "u", body, ""), (None, "v", b"y" * 1500, ""), (None, "v", b"y" * 1500, "")]
    got = sorted((r["record_id"], r["record_type"], r["refers_to"] or "") for r in round_trip(spark, rows, tmp_path / "w"))
    assert got == sorted(
        [("urn:page:null", "revisit", "urn:page:7"), ("urn:page:3", "revisit", "urn:page:7")] + [("urn:page:7", "response", "")] * 2
        + [("urn:page:null", "response", "")] * 2
    )
    assert round_trip(spark, [], tmp_path / "e") == []


def test_files_named_gz_are_refused(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(warc.gzip_member(b"WARC/1.1\r\n\r\n", 5))
    with pytest.raises(ValueError, match="gz"):
        warc.read_warc(spark, str(tmp_path))
