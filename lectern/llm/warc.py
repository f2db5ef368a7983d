"""Content-addressed WARC archive.

Payload bytes are stored once under their SHA-256 in one table; the exact header bytes of every
record are kept in another. A record is rebuilt by joining the two. Equal digests are verified: a
second digest, and the byte count, must agree within each, or the archive isn't written. Payloads are read twice: once for their
digests, and once to store those that stay. export() makes .warc files of an archive.

Defined results: a null payload is empty; payloads under 100 bytes are always whole records; rows with
equal ids and equal payloads are a capture each, of which one is the response and the others revisit it; a null id counts as
the smallest and stays null; a null or unstated date is UNDATED; an empty table gives empty archives.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import NULL_ID, null_id, work_path, written

#: Equal payloads of at least so many bytes are stored as revisits of the first.
REVISIT_BYTES = 100
#: Records that share a payload are rebuilt in groups of at most so many.
SALT_ROWS = 5000

WARC_HEADER = "WARC/1.1\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:capture:%d>\r\nWARC-Target-URI: %s\r\nWARC-Date: %s\r\nWARC-Payload-Digest: sha256:%s\r\n%sContent-Type: application/http;msgtype=response\r\nContent-Length: %d\r\n\r\n"
#: Date of records whose capture isn't dated, since every record needs one.
UNDATED = "1970-01-01T00:00:00Z"
HTTP_HEADER = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


@dataclass(frozen=True)
class Archive:
    """Paths of an archive's tables."""

    payloads: str
    headers: str


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", date_col: str | None = None) -> Archive:
    """Store pages as WARC records; returns where. date_col: a timestamp of each capture."""
    spark = pages.sparkSession
    date = F.date_format(F.to_utc_timestamp(pages[date_col], spark.conf.get("spark.sql.session.timeZone")), "yyyy-MM-dd'T'HH:mm:ss'Z'") if date_col else F.lit(None).cast("string")
    rows = pages.select(
        F.coalesce(pages[id_col].cast("long"), F.lit(NULL_ID)).alias("id"),
        F.coalesce(F.regexp_replace(pages[url_col].cast("string"), r"[\r\n]", " "), F.lit("")).alias("url"),
        F.coalesce(date, F.lit(UNDATED)).alias("date"),
        F.coalesce(pages[body_col].cast("binary"), F.lit(b"")).alias("payload"),
    )
    path = work_path(spark, "warc")
    known = written(rows.select("id", "url", "date", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("bytes"), F.xxhash64("payload").alias("second")), "warc-known")
    groups = known.groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"), F.min("second").alias("a"), F.max("second").alias("b"), F.min("bytes").alias("c"), F.max("bytes").alias("d"))
    same = (F.col("a") == F.col("b")) & (F.col("c") == F.col("d"))
    groups = groups.withColumn("first_id", F.when(same, F.col("first_id")).otherwise(F.raise_error("two payloads have one SHA-256").cast("long")))
    groups = written(groups.select("digest", "first_id", "copies"), "warc-groups")

    # The payload that stays is that of the smallest id; rows that share this id but not the payload drop out by their digest.
    once = groups.select(F.col("first_id").alias("id"), "digest", "copies")
    kept = rows.select("id", "payload").join(once, "id").filter(F.sha2("payload", 256) == F.col("digest"))
    kept = kept.groupBy("id", "digest").agg(F.first("payload").alias("payload"), F.first("copies").alias("copies")).drop("id")
    kept.write.option("compression", "zstd").parquet(f"{path}/payloads")

    # Rows of one digest are many only where pages are copies: each side is narrow, and AQE splits such keys.
    joined = known.join(groups, "digest")
    # Of repeated rows with the smallest id only one is the response.
    again = joined.filter("id = first_id").select("*", F.row_number().over(_by("id", "digest")).alias("nth"))
    rest = joined.filter("id != first_id").select("*", F.lit(2).alias("nth"))
    whole = (F.col("bytes") < REVISIT_BYTES) | ((F.col("id") == F.col("first_id")) & (F.col("nth") == 1))
    kind = F.when(whole, "response").otherwise("revisit")
    http = F.format_string(HTTP_HEADER, F.col("bytes"))
    refers = F.when(whole, "").otherwise(F.format_string("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:capture:%d>\r\n", F.col("first_id")))
    length = F.length(http) + F.when(whole, F.col("bytes")).otherwise(F.lit(0))
    warc = F.format_string(WARC_HEADER, kind, F.col("id"), F.col("url"), F.col("date"), F.col("digest"), refers, length)
    heads = again.unionByName(rest).select("id", "digest", "copies", F.encode(warc, "UTF-8").alias("warc_header"), F.encode(http, "UTF-8").alias("http_header"))
    heads.write.option("compression", "zstd").parquet(f"{path}/headers")
    return Archive(f"{path}/payloads", f"{path}/headers")


def _by(*cols: str):
    from pyspark.sql import Window

    return Window.partitionBy(*cols).orderBy(*cols)


def records(spark: SparkSession, archive: Archive) -> DataFrame:
    """(id, record, capture) rebuilt: record has the bytes of the WARC record, capture those of the whole response.

    A payload with many records is dealt to groups of at most SALT_ROWS of them, so that none of them grows with its copies.
    """
    heads = spark.read.parquet(archive.headers)
    parts = lambda: F.ceil(F.col("copies") / SALT_ROWS).cast("int")
    # Dealt by numbers of their own, as ids may repeat.
    heads = heads.withColumn("salt", F.pmod(F.monotonically_increasing_id(), parts()).cast("int"))
    stored = spark.read.parquet(archive.payloads).withColumn("salt", F.explode(F.sequence(F.lit(0), parts() - 1)))
    both = heads.join(stored.drop("copies"), ["digest", "salt"])
    end = F.lit(b"\r\n\r\n")
    revisit = _text("warc_header").contains("\r\nWARC-Type: revisit\r\n")
    return both.select(
        "id",
        F.concat(F.col("warc_header"), F.col("http_header"), F.when(revisit, F.lit(b"")).otherwise(F.col("payload")), end).alias("record"),
        F.concat(F.col("http_header"), F.col("payload")).alias("capture"),
    )


def _text(name: str) -> Column:
    return F.decode(F.col(name), "UTF-8")


def read_archive(spark: SparkSession, archive: Archive) -> DataFrame:
    """Every record parsed from its bytes: id, payload, digest as computed here, type, refers_to.

    Fails where a record's stated digest isn't that of the payload read.
    """
    rows = records(spark, archive)
    at = F.position(F.lit(b"\r\n\r\n"), F.col("record"))
    head = F.decode(F.substring("record", F.lit(1), at - 1), "UTF-8")
    body_at = F.position(F.lit(b"\r\n\r\n"), F.col("capture")) + 4
    rows = rows.select("id", head.alias("head"), F.substring("capture", body_at, F.octet_length("capture")).alias("payload"))
    field = lambda name: F.regexp_extract("head", rf"\r\n{name}: ([^\r\n]*)", 1)
    rows = rows.select(
        "id", "payload", F.sha2("payload", 256).alias("payload_digest"), F.replace(field("WARC-Payload-Digest"), F.lit("sha256:")).alias("stated"), field("WARC-Type").alias("record_type"),
        F.regexp_extract(field("WARC-Refers-To"), r"<urn:capture:(-?\d+)>", 1).alias("refers"),
    )
    good = F.when(F.col("stated") == F.col("payload_digest"), F.col("payload_digest")).otherwise(F.raise_error("a record's payload has another digest").cast("string"))
    return rows.select("id", "payload", good.alias("payload_digest"), "record_type", F.when(F.col("refers") != "", F.col("refers").cast("long")).alias("refers_to"))


def export(spark: SparkSession, archive: Archive, path: str, codec: str = "none") -> None:
    """A folder of WARC files, the records of a task in each; with codec gzip compressed file by file.

    Records end with a line end, which the text writer puts behind each, so that files hold the records' bytes and no more.
    """
    record = F.col("record")
    records(spark, archive).select(F.substring(record, F.lit(1), F.octet_length(record) - 1).cast("string").alias("value")).write.option("lineSep", "\n").option("compression", codec).text(path)


def roundtrip(pages: DataFrame) -> DataFrame:
    """Archive pages, read the archive back and report each record."""
    rows = read_archive(pages.sparkSession, write_archive(pages))
    return rows.select(
        null_id(F.col("id")).alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest", "record_type", null_id(F.col("refers_to")).alias("refers_to")
    )


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS n, sha256(h) AS s FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY s) AS a, row_number() OVER (PARTITION BY s ORDER BY page_id) AS k FROM d)
SELECT page_id, n AS payload_bytes, s AS payload_digest,
  CASE WHEN n < 100 OR k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN n < 100 OR k = 1 THEN NULL ELSE a END AS refers_to
FROM m
"""
