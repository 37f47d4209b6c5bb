"""Archives: round trips, revisits by brute force, the reader on files of other writers."""

import gzip
import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from gradelake.llm import warc

PAGES = "page_id long, url string, html string"


def rows():
    r = random.Random(2)
    bodies = ["x" * 99, "x" * 100, "é" * 50, "é" * 49 + "a", None, "", "\r\n\r\n" * 40, "WARC/1.1\r\nContent-Length: 9\r\n\r\n" * 9, "line\n" * 30, "no end of line" * 9, "\n", "big " * 300_000]
    bodies += [f"unique {i} " * 20 for i in range(30)]
    out = [(i, r.choice(["http://a/b", None, "http://x/\r\nInjected: 1", "http://ü/"]), r.choice(bodies)) for i in range(1, 200)]
    return out + [(None, "http://n", "x" * 100), (None, None, "only nulls" * 20), (None, None, "only nulls" * 20), (7, "http://again", "x" * 100), (-5, "u", None), *out[:3]]


def expected(pages):
    by = {}
    for p, _, html in pages:
        if p is not None:
            by.setdefault(html or "", []).append(p)
    out = []
    for p, _, html in pages:
        data = (html or "").encode()
        first = min(by.get(html or "", [None])) if len(data) >= 100 else None
        revisit = first is not None and first != p
        out.append((p, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(map(str, out))


def test_archive_by_brute_force_and_sql(spark):
    pages = spark.createDataFrame(rows(), PAGES)
    con = duckdb.connect()
    con.execute("CREATE TABLE pages(page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows())
    want = expected(rows())
    assert sorted(map(str, con.execute(warc.ARCHIVE_SQL).fetchall())) == want
    for p in (pages, pages.repartition(5).selectExpr("*", "1 as digest", "'k' as _key")):
        assert sorted(str(tuple(x)) for x in warc.archive_table(p).collect()) == want
    assert warc.archive_table(spark.createDataFrame([], PAGES)).count() == 0


def test_payloads_come_back_whole(spark, tmp_path):
    pages = spark.createDataFrame(rows(), PAGES)
    warc.write_archive(warc.marked(pages), str(tmp_path / "a"))
    got = warc.read_archive(spark, str(tmp_path / "a"), payloads=True)
    stored = {(r.page_id, bytes(r.payload)) for r in got.filter("record_type = 'response'").collect()}
    wanted = {(None if p is None else str(p), (h or "").encode()) for p, _, h in rows()}
    assert stored <= wanted and {x for _, x in stored} == {x for _, x in wanted}
    assert got.filter("record_type = 'revisit' and (payload is not null or refers_to_record is null)").count() == 0
    assert got.filter(F.col("url").contains("Injected: 1")).count() > 0  # the line break of the url is gone, its text isn't lost


def record(kind, url, block, **headers):
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:{url}>", f"WARC-Target-URI: {url}", *[f"{k.replace('_', '-')}: {v}" for k, v in headers.items()], f"Content-Length: {len(block)}"]
    return ("WARC/1.0\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def test_reader_takes_archives_of_other_writers(spark, tmp_path):
    body = b"<html>\xff\xfe not utf-8\r\n\r\nrest\n"
    http = b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\n" + body
    digest = "sha256:" + hashlib.sha256(body).hexdigest()
    members = [record("warcinfo", "info", b"software: x\r\n"), record("response", "http://a", http, Content_Type="application/http; msgtype=response", WARC_Payload_Digest="sha1:ABC"), record("revisit", "http://b", b"", WARC_Payload_Digest=digest, WARC_Refers_To="<urn:elsewhere>"), record("revisit", "http://c", b"", WARC_Payload_Digest="sha256:00")]
    (tmp_path / "one.warc.gz").write_bytes(b"".join(gzip.compress(m) for m in members))
    (tmp_path / "two.warc.gz").write_bytes(gzip.compress(record("resource", "http://d", b"abc")))
    got = {r.url: r for r in warc.resolved(warc.read_archive(spark, str(tmp_path))).collect()}
    assert len(got) == 5 and got["http://a"].payload_bytes == len(body) and got["http://a"].payload_digest == digest[7:]
    assert got["http://b"].original_bytes == len(body) and got["http://c"].original_bytes is None
    assert got["http://d"].payload_bytes == 3 and got["info"].payload_bytes == 13


@pytest.mark.parametrize("data", [record("response", "x", b"abc", WARC_Payload_Digest="sha256:11"), record("response", "x", b"abcdef")[:-9], b"nonsense\r\n"])
def test_broken_archives_are_errors(spark, tmp_path, data):
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(data))
    with pytest.raises(Exception, match="digest|within a record|no WARC record"):
        warc.read_archive(spark, str(tmp_path)).collect()


def test_hot_digest_and_bloom(spark):
    copies = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 == 0, F.lit("same page " * 30)).otherwise(F.concat(F.lit("page " * 30), "id")).alias("html"))
    got = warc.archive_table(copies)
    assert got.filter("record_type = 'revisit'").count() == 999 and got.filter("refers_to = 0").count() == 999 and got.count() == 3000
