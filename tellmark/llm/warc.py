"""Content-addressed web archive: payloads once by digest, exact record headers apart, records put together by joins.

An archive is two tables in one folder. ``payloads`` holds every different
payload once under its SHA-256; ``headers`` holds, for each record, the exact
bytes of its WARC header and of its HTTP header with the digest its block needs.
The first page of a payload is a response record, later ones revisit it.

Only digests are compared and shuffled to find copies. Payload bytes are shuffled
once, from the pages to the payload table. Both tables are bucketed by the page
that a row belongs to and the digest, so that records are read by a join that
moves nothing; of revisit records, whose blocks have no payload, only digests and
lengths meet. The copies of a hot payload are dealt over shares.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tellmark.llm.common import shared_dir, stored
from tellmark.session import table

#: Smaller payloads are never revisited.
MIN_REVISIT = 0
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes of a bucket, about, buckets at most, and shares that the copies of one payload are dealt over.
BUCKET_BYTES, MAX_BUCKETS, SHARES = 1 << 26, 100_000, 64
_HEADERS = "id bigint, slot bigint, digest binary, revisit boolean, warc_header binary, http_header binary"
_PAYLOADS = "slot bigint, digest binary, payload binary"
#: All records carry one date, so that an archive of the same pages is the same archive.
DATE = "1970-01-01T00:00:00Z"
_HEX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in bare upper-case base32, 40 bits (eight digits) at a time."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), _HEX32, _BASE32)


def record_id(page_id: Column) -> Column:
    """The record's name, made of the page's number."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def write_archive(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_revisit: int = MIN_REVISIT,
) -> None:
    """Write one record per row of ``pages`` to the archive in ``path``, which must not exist.

    The payload is the text in UTF-8, null being empty; a null url is an empty
    target. Of equal payloads of at least ``min_revisit`` bytes, rows of the
    smallest id are responses (all of them, if an id repeats) and others revisit
    that id; a null id is larger than any other. Other columns are left out.
    Line breaks in a url are percent-encoded, so that a header stays one line.
    """
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")).alias("url"),
        payload.alias("payload"),
        F.unhex(F.sha2(payload, 256)).alias("digest"),
    )
    slim = stored(
        rows.select("id", "url", F.octet_length("payload").cast("long").alias("size"), "digest", base32_sha1(F.col("payload")).alias("sha1"))
    )
    share = _share()
    # the least id in two steps, so that a hot digest's rows don't meet in one task
    parts = slim.groupBy("digest", share).agg(F.min("id").alias("least"), F.max("size").alias("size"))
    first = parts.groupBy("digest").agg(F.min("least").alias("first"), F.max("size").alias("size"))
    shares = parts.select("digest", "share").join(first.drop("size"), "digest")
    later = (F.col("size") >= min_revisit) & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    known = slim.withColumn("share", share).join(shares, ["digest", "share"]).withColumn("revisit", later)
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size"), F.lit("\r\n\r\n")
    )
    known = known.withColumn("http", http)
    block = F.octet_length("http") + F.when(F.col("revisit"), 0).otherwise(F.col("size"))
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id(F.col("id"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(
            F.col("revisit"), F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", record_id(F.col("first"))))
        ).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", block.cast("string")),
        F.lit("\r\n"),
    )
    buckets = min(MAX_BUCKETS, max(8, -(-(slim.agg(F.sum("size")).first()[0] or 0) // BUCKET_BYTES)))
    keys = ["slot", "digest"]
    headers = known.select(
        "id", _slot("id"), "digest", "revisit", F.encode(header, "UTF-8").alias("warc_header"), F.encode("http", "UTF-8").alias("http_header")
    )
    _write(headers.repartition(buckets, *keys), f"{path}/headers", buckets)
    # the page that holds a payload is found by its number, so that copies leave the job before they meet
    holders = first.select(_slot("first"), "digest").repartition(buckets, *keys)
    kept = rows.select(_slot("id"), "digest", "payload").repartition(buckets, *keys).join(holders, keys)
    _write(kept.groupBy(*keys).agg(F.max("payload").alias("payload")), f"{path}/payloads", buckets)
    pages.sparkSession.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(f"{path}/layout")


def _share() -> Column:
    return F.pmod(F.xxhash64("id", "url"), F.lit(SHARES)).alias("share")


def _slot(id_col: str) -> Column:
    """The number that a page's rows are dealt by; pages without an id are dealt by their payload."""
    return F.coalesce(F.col(id_col), F.xxhash64("digest")).alias("slot")


def _write(df: DataFrame, path: str, buckets: int) -> None:
    spark, name = df.sparkSession, f"archive_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, "slot", "digest")
    writer.saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay; the layout is kept beside them


def _bucketed(spark: SparkSession, path: str, columns: str, buckets: int) -> DataFrame:
    """The table in a folder as a bucketed one; the catalogue's entry isn't needed once the scan is resolved."""
    name = f"archive_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (slot, digest) INTO {buckets} BUCKETS LOCATION '{path}'")
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return found


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive as a WARC file has them: id, record and verified.

    A response record is put together in a join of two tables that are bucketed
    alike. ``verified`` says that the payload, for a revisit that of the record
    it refers to, has the SHA-256 it is stored under and the SHA-1 and length that
    the headers state. A response whose payload is missing has a null record.
    """
    buckets = spark.read.parquet(f"{path}/layout").first()[0]
    headers, payloads = (_bucketed(spark, f"{path}/{name}", c, buckets) for name, c in (("headers", _HEADERS), ("payloads", _PAYLOADS)))
    size = F.octet_length("payload").cast("long")
    facts = [size.alias("size"), (F.unhex(F.sha2("payload", 256)) == F.col("digest")).alias("sound"), base32_sha1(F.col("payload")).alias("sha1")]
    responses = headers.where("NOT revisit").join(payloads, ["slot", "digest"], "left").select("*", *facts)
    # copies refer to a digest: a payload's facts go to the shares that its copies are dealt over
    revisits = headers.where("revisit").withColumn("share", F.pmod(F.xxhash64("id"), F.lit(SHARES)))
    shares = revisits.select("digest", "share").distinct().join(payloads.select("digest", *facts), "digest", "left")
    copies = revisits.join(shares, ["digest", "share"]).withColumn("payload", F.lit(b""))
    stated = (field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("sha1"))) & (http_length() == F.col("size"))
    return responses.unionByName(copies.drop("share")).select(
        "id", record_bytes().alias("record"), F.coalesce(F.col("sound") & stated, F.lit(False)).alias("verified")
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The pages of an archive: id, warc_header, http_header, payload (of the record that a revisit refers to) and verified.

    Every copy gets its payload, so payloads are shuffled; ``read_records`` doesn't.
    ``verified`` says that the payload has the SHA-256 it is stored under and the
    SHA-1 and length that the headers state. A record whose payload is missing
    comes back with a null payload and is not verified.
    """
    headers, payloads = spark.read.schema(_HEADERS).parquet(f"{path}/headers"), spark.read.schema(_PAYLOADS).parquet(f"{path}/payloads")
    sound = payloads.withColumn("sound", F.unhex(F.sha2("payload", 256)) == F.col("digest")).withColumn(
        "sha1", base32_sha1(F.col("payload"))
    )
    joined = headers.join(sound.drop("slot"), "digest", "left")
    stated = (field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("sha1"))) & (
        http_length() == F.octet_length("payload")
    )
    return joined.select(
        "id", "warc_header", "http_header", "payload", F.coalesce(F.col("sound") & stated, F.lit(False)).alias("verified")
    )


def record_bytes() -> Column:
    """The record as a WARC file has it: header, block and two line ends; a revisit's block has no payload."""
    body = F.when(field("WARC-Type") == "revisit", F.encode(F.lit(""), "UTF-8")).otherwise(F.col("payload"))
    return F.concat("warc_header", "http_header", body, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def field(name: str) -> Column:
    """A header field's value; an empty string if the header lacks it."""
    return F.regexp_extract(F.decode("warc_header", "UTF-8"), rf"\n{name}: ([^\r\n]*)\r\n", 1)


def http_length() -> Column:
    return F.regexp_extract(F.decode("http_header", "UTF-8"), r"\nContent-Length: ([0-9]+)\r\n", 1).cast("long")


def parsed(record: Column) -> tuple[Column, Column, Column]:
    """A record's WARC header, its HTTP header and the number of bytes of its body."""
    parts = F.split(F.decode(record, "UTF-8"), "\r\n\r\n", 3)
    head, http = parts[0], parts[1]
    return head, http, F.octet_length(record) - F.octet_length(head) - F.octet_length(http) - 12


def op1_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, written, read back and parsed."""
    path = f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    write_archive(table(spark, sf_dir, "pages"), path)
    head, http, body = parsed(F.col("record"))
    read = read_records(spark, path).select("id", "verified", F.concat(head, F.lit("\r\n")).alias("head"), http.alias("http"), body.alias("body"))
    value = lambda name: F.regexp_extract("head", rf"\n{name}: ([^\r\n]*)\r\n", 1)
    length = F.regexp_extract("http", r"\nContent-Length: ([0-9]+)$", 1).cast("long")
    refers = F.regexp_extract(value("WARC-Refers-To"), r"^<urn:page:(-?[0-9]+)>$", 1)
    return read.select(
        F.col("id").alias("page_id"),
        F.when(value("WARC-Type") == "revisit", length).otherwise(F.col("body")).cast("long").alias("payload_bytes"),
        F.substring(value("WARC-Payload-Digest"), 6, 32).alias("payload_digest"),
        value("WARC-Type").alias("record_type"),
        F.when(refers != "", refers.cast("long")).alias("refers_to"),
        "verified",
    )


def _base32_in_duckdb(hexa: str) -> str:
    """DuckDB SQL for the base32 digits of 40 hexadecimal digits."""
    part = lambda k: f"CAST('0x' || substr({hexa}, {1 + 10 * k}, 10) AS BIGINT)"
    digit = lambda k, b: f"substr('{_BASE32}', 1 + CAST(({part(k)} >> {b}) & 31 AS INTEGER), 1)"
    return " || ".join(digit(k, b) for k in range(4) for b in range(35, -1, -5))


ORACLES = {
    "op1_warc_archive": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
q AS (SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS h,
             min(page_id) OVER (PARTITION BY payload) AS f FROM p)
SELECT page_id, payload_bytes, {_base32_in_duckdb('h')} AS payload_digest,
       CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> f THEN f END AS refers_to, TRUE AS verified
FROM q"""
}
QUERIES = {"op1_warc_archive": op1_warc_archive}
