import base64
import hashlib

import duckdb
from pyspark.sql import Row
from pyspark.sql import functions as F

from tellmark.llm import warc as W


def parse(record: bytes):
    head, _, block = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    assert lines[0] == "WARC/1.1" and block.endswith(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = block[:-4]
    assert int(fields["Content-Length"]) == len(block)
    return fields, block.partition(b"\r\n\r\n")[2]


def test_round_trip_nulls_repeats_and_clashing_names(spark, tmp_path):
    rows = [(3, "u", "same"), (1, "v\r\nX: y", "same"), (2, None, None), (7, "w", ""), (5, "é", "ü" * 70000), (5, "é", "ü" * 70000), (None, "n", "same"), (None, "o", "alone")]
    df = spark.createDataFrame([Row(page_id=i, url=u, html=h, PAYLOAD=1, digest="x", first=0) for i, u, h in rows])
    path = f"file://{tmp_path}/a"
    W.write_archive(df, path)
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    found = W.read_archive(spark, path).withColumn("record", W.record_bytes()).collect()
    assert len(found) == len(rows) and all(r.verified for r in found)
    got = []
    for r in found:
        fields, body = parse(bytes(r.record))
        payload = bytes(r.payload)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert fields["WARC-Payload-Digest"] == "sha1:" + digest
        if fields["WARC-Type"] == "response":
            assert body == payload
        else:
            assert body == b"" and fields["WARC-Profile"] == W.PROFILE
        got.append((r.id, payload.decode(), fields["WARC-Type"], fields.get("WARC-Refers-To")))
    first = "<urn:page:1>"
    want = [
        (3, "same", "revisit", first), (1, "same", "response", None), (2, "", "response", None), (7, "", "revisit", "<urn:page:2>"),
        (5, "ü" * 70000, "response", None), (5, "ü" * 70000, "response", None), (None, "same", "revisit", first), (None, "alone", "response", None),
    ]
    assert sorted(got, key=str) == sorted(want, key=str)
    whole = {(r.id, bytes(r.record)) for r in found}
    records = W.read_records(spark, path).collect()
    assert {(r.id, bytes(r.record)) for r in records} == whole and len(records) == len(rows) and all(r.verified for r in records)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = W.read_records(spark, path)._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SelectedBucketsCount" in plan
    W.write_archive(df.limit(0), path + "0")
    assert W.read_records(spark, path + "0").count() == 0
    assert W.read_archive(spark, path + "0").count() == 0
    W.write_archive(df, path + "5", min_revisit=5)
    kinds = W.read_archive(spark, path + "5").select("id", W.field("WARC-Type")).collect()
    assert all(kind == "response" for _, kind in kinds)


def test_damage_is_seen(spark, tmp_path):
    df = spark.createDataFrame([Row(page_id=1, url="u", html="a"), Row(page_id=2, url="u", html="b")])
    path = f"file://{tmp_path}/a"
    W.write_archive(df, path)
    spoiled = spark.read.parquet(f"{path}/payloads").where("payload = X'61'").select("digest", F.encode(F.lit("z"), "UTF-8").alias("payload"))
    rows = spoiled.collect()
    spark.createDataFrame(rows, spoiled.schema).write.mode("overwrite").parquet(f"{path}/payloads")
    assert not any(r.verified for r in W.read_archive(spark, path).collect())


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = con.execute(W.ORACLES["op1_warc_archive"]).fetchall()
    assert sorted(map(tuple, W.op1_warc_archive(spark, sf).collect())) == sorted(want)
