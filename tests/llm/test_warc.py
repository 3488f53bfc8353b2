import base64
import glob
import gzip
import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from waymesh.llm import queries
from waymesh.llm import warc as W


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.01/pages.parquet'")
    got = queries.QUERIES["op2_warc_round_trip"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(queries.ORACLES["op2_warc_round_trip"]).fetchall())


ROWS = [(1, "http://a/%0A?x", "é" * 600), (2, None, "é" * 600), (2, None, "é" * 600), (3, "u\r\nv", "é" * 499), (4, "w", "é" * 499), (5, "", None), (6, "z", ""), (None, "n", "é" * 600), (7, "y", "<p>" * 400_000)]


def test_round_trip_of_odd_rows(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumns({"payload": F.lit(1), "file": F.lit("x")})
    got = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in W.round_trip(df).collect()}
    assert got == {(1, 1200, "revisit", 2), (2, 1200, "response", None), (None, 1200, "revisit", 2), (3, 998, "response", None), (4, 998, "response", None), (5, 0, "response", None), (6, 0, "response", None), (7, 1_200_000, "response", None)}
    assert W.round_trip(df).count() == len(ROWS)
    assert W.round_trip(df.where("false")).collect() == []


@pytest.mark.parametrize("split", ["3k", "20k", "1m"])
def test_any_split_gives_every_record_once(spark, tmp_path, split):
    rng = random.Random(3)
    rows = [(i, f"u{i}", "".join(rng.choices("abcdefgh", k=rng.randint(0, 9000)))) for i in range(300)]
    path = str(tmp_path / "w")
    W.write_warc(W.with_revisits(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)), path)
    for f in glob.glob(path + "/part-*"):
        assert gzip.open(f).read().count(b"WARC/1.1\r\n") == 301
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = W.read_warc(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.page_id, r.url, r.payload.decode()) for r in got) == rows


def test_magic_inside_members(spark, tmp_path):
    """Stored (uncompressed) members full of the magic, so that ranges begin inside them."""
    (tmp_path / "w").mkdir()
    want, data = {}, b""
    for i in range(40):
        payload = (W.MAGIC + bytes([i])) * 700
        want[i] = payload
        fields = [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:page:{i}>"), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode())]
        data += gzip.compress(W._record(fields, b"HTTP/1.1 200 OK\r\n\r\n" + payload), compresslevel=0)
    (tmp_path / "w" / "a.warc.gz.raw").write_bytes(data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5k")
    try:
        got = {r.page_id: bytes(r.payload) for r in W.read_warc(spark, str(tmp_path / "w")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == want
