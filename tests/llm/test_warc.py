import hashlib

from pyspark.sql import functions as F

from quillspark.llm import warc as A

SCHEMA = "page_id long, url string, html string, digest string, key string"
BIG = "z" * 2000


def pages(spark):
    rows = [(1, "http://a.b.com/x", BIG), (2, "http://A.b.com:80/x", BIG), (3, None, None), (4, "weird\nurl", BIG), (None, "http://a.b.com/x", "é" * 10), (5, "http://a.b.com/x", "é" * 10),
            (-6, "https://www.Q.org?y#f", BIG), (2, "http://a.b.com/x", BIG), (7, "", "\r\n\r\nWARC/1.1\r\n\r\n" * 90), (8, "http://a.b.com/long", "é" * 2_000_000), (None, "http://n", BIG)]
    rows += [(100 + k, f"http://host.org/{k % 7}", f"page {k}") for k in range(300)]
    return spark.createDataFrame([(*r, "d", "k") for r in rows], SCHEMA)


def test_round_trip_through_the_index(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK_LINES", 16)
    monkeypatch.setattr(A, "HELD_BYTES", 3000)
    table = pages(spark)
    captures, index = A.archive(table)
    key = A.capture_key(F.col("url"), F.col("page_id"))
    found = A.lookup(index, table.select(key.alias("low"), key.alias("high")))
    records = A.read_records(found).cache()
    rows = table.collect()
    assert records.count() == captures.count() == len(rows)
    html = {}
    for r in rows:
        html.setdefault(r["page_id"], set()).add((r["html"] or "").encode())
    for r in records.collect():
        if r["record_type"] == "response":
            assert bytes(r["payload"]) in html[r["page_id"]]
            assert hashlib.sha1(r["payload"]).hexdigest() == r["declared_digest"]
    sums = {(r["page_id"], r["payload_bytes"]): r for r in A.digests(records).collect()}
    for i, kind, refers in ((1, "revisit", 4), (2, "revisit", 4), (-6, "revisit", 4), (4, "response", None), (None, "response", None), (5, "response", None)):
        size = 20 if i == 5 else 2000
        assert (sums[i, size]["record_type"], sums[i, size]["refers_to"]) == (kind, refers)
    assert sums[3, 0]["payload_digest"] == hashlib.sha1(b"").hexdigest()
    assert sums[1, 2000]["payload_digest"] == hashlib.sha1(BIG.encode()).hexdigest()


def test_all_captures_of_a_url(spark, monkeypatch):
    monkeypatch.setattr(A, "HELD_ROWS", 7)
    table = pages(spark)
    _, index = A.archive(table)
    url = A.url_key(F.col("url"))
    wanted = spark.createDataFrame([("http://www.host.org/3#q",), ("http://none.org/",)], "url string")
    found = A.lookup(index, wanted.select(F.concat(url, F.lit(" ")).alias("low"), F.concat(url, F.lit("!")).alias("high")))
    assert found.count() == table.where("url = 'http://host.org/3'").count()


def test_empty_table(spark):
    table = pages(spark).limit(0)
    captures, index = A.archive(table)
    key = A.capture_key(F.col("url"), F.col("page_id"))
    assert captures.count() == index.count() == 0
    assert A.digests(A.read_records(A.lookup(index, table.select(key.alias("low"), key.alias("high"))))).count() == 0
