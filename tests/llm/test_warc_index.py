import base64
import gzip
import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from cursus.llm import queries, warc_index

SF = "/root/testdata/sf0.001"
COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def brute(rows):
    last = {}
    for i, _, html in rows:
        key = html or ""
        last[key] = max((x for x in (i, last.get(key)) if x is not None), default=None)
    out = []
    for i, _, html in rows:
        raw, to = (html or "").encode(), last[html or ""]
        revisit = to is not None and to != i
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def capture(pages, **kw):
    return warc_index.index_archives(warc_index.write_archives(warc_index.plan_records(pages), **kw))


def of(index):
    return sorted((tuple(r) for r in index.select(*COLUMNS).collect()), key=str)


def test_loser_tree_merges_any_runs():
    rng = random.Random(5)
    for k in range(60):
        runs = [sorted(rng.randbytes(rng.randint(0, 2)) for _ in range(rng.randint(0, 9))) for _ in range(k % 13)]
        got = list(warc_index.merged(runs))
        assert [runs[r][i] for r, i in got] == sorted(x for r in runs for x in r)
        assert len(set(got)) == len(got)
        assert got == sorted(got, key=lambda p: (runs[p[0]][p[1]], p))  # equal keys in the order of runs


def test_url_keys():
    key = warc_index.url_key
    assert key("HTTP://user@www.Sub.Example.com:80/A/b?Q=1#frag") == "com,example,sub)/a/b?q=1"
    assert key("https://example.com:8443") == "com,example:8443)/"
    assert key("https://m.example.com./x") == "com,example,m)/x"
    assert key(None) == "" and key("not a url") == "not a url" and key("http://[::1") == "http://[::1"


def test_edge_rows(spark):
    rows = [(1, "http://a.example/x", "one"), (2, "http://a.example/x", "one"), (3, None, None), (4, "http://b.example/\r\nWARC-Type: x", ""),
            (5, "http://ü.example/é", "one"), (None, "http://a.example/x", "one"), (None, "http://a.example/", "alone"),
            (None, None, "alone"), (6, "x", "six\r\n\r\nWARC/1.1\r\n\r\n"), (6, "x", "six\r\n\r\nWARC/1.1\r\n\r\n"),
            (7, "y", "é" * 400_000), (-9, "z", "one"), (2**62, "z", "Zwei")]
    pages = pages_of(spark, rows).withColumn("digest", F.lit("x")).withColumn("record_type", F.lit(1)).withColumn("last", F.lit(2))
    assert of(capture(pages)) == brute(rows)
    assert of(capture(pages_of(spark, []))) == []


def test_short_payloads_are_responses(spark):
    rows = [(1, "a", "xx"), (2, "b", "xx"), (3, "c", "long enough"), (4, "d", "long enough")]
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc_index.plan_records(pages_of(spark, rows), least=5).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}


def test_the_index_is_in_global_order_and_finds_records(spark):
    rng = random.Random(8)
    rows = [(k, f"http://h{rng.randint(0, 5)}.example/{rng.randint(0, 40)}", rng.choice(["same", f"page {k}", ""])) for k in range(3000)]
    rows += [(10_000 + k, "http://hot.example/", f"hot {k % 3}") for k in range(1500)]
    pages = pages_of(spark, rows).repartition(7)
    archives = warc_index.write_archives(warc_index.plan_records(pages), most_records=100)
    assert archives.count() > 40
    old = warc_index.BLOCK
    try:
        warc_index.BLOCK = 16
        blocks = warc_index.capture_runs(archives)
        index = warc_index.merge_runs(warc_index.written(blocks, "runs"), per_range=300)
        found = sorted(index.collect(), key=lambda r: r.place)
    finally:
        warc_index.BLOCK = old
    assert len({r.range for r in found}) > 8
    assert [r.place for r in found] == list(range(len(rows)))
    want = sorted((warc_index.url_key(u), warc_index.EPOCH + i, i) for i, u, _ in rows)
    assert [(r.url_key, r.captured, r.page_id) for r in found] == want
    assert of(index) == brute(rows)
    html = {i: h for i, _, h in rows}
    for r in rng.sample(found, 200):
        with open(r.file.removeprefix("file:"), "rb") as f:
            f.seek(r.offset)
            record = gzip.decompress(f.read(r.length)).decode()
        assert f"WARC-Record-ID: <urn:x-capture:{r.page_id}>" in record and f"WARC-Type: {r.record_type}\r\n" in record
        body = record.split("\r\n\r\n", 2)[2]
        assert body == ("\r\n\r\n" if r.record_type == "revisit" else html[r.page_id] + "\r\n\r\n")


def test_times_of_pages(spark):
    rows = [(3, "http://a.example", "x"), (2, "http://a.example", "y"), (1, "http://a.example", "z")]
    pages = pages_of(spark, rows).withColumn("captured", F.timestamp_seconds(F.lit(1_700_000_000) - F.col("page_id")))
    got = [(r.page_id, r.captured) for r in sorted(capture(pages).collect(), key=lambda r: r.place)]
    assert got == [(i, 1_700_000_000 - i) for i in (3, 2, 1)]


def test_a_damaged_archive_is_an_error(spark, tmp_path):
    good = warc_index.record_bytes(1, "u", b"payload", 0, None, False)
    (tmp_path / "a.warc.gz").write_bytes(warc_index._member(good.replace(b"payload\r", b"Payload\r")))
    (o, n, fields, block), = warc_index.read_archive(str(tmp_path / "a.warc.gz"))
    with pytest.raises(ValueError, match="differ"):
        warc_index._entry("a", o, n, fields, block)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF}/pages.parquet')")
    sql = con.execute(queries.ORACLE_SQL["op11_warc_index"])
    assert [c[0] for c in sql.description] == COLUMNS
    got = of(queries.QUERIES["op11_warc_index"](spark, SF))
    assert sorted(sql.fetchall(), key=str) == got
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    assert got == brute(rows)
