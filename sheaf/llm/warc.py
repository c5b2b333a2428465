"""WARC archives whose repeated payloads are revisit records.

Records with equal payloads share a digest. Headers alone are shuffled by digest to find each
group's response, the record with the largest id that has its payload; every other record of the
group becomes a revisit that refers to it. Archives are then written with fresh headers, and payloads
of revisits are left out. Reading joins revisits to the responses they refer to.

Archives are written with Spark's own text writer, whose line separator is the end of a record, so
they go through any file system and a repeated task leaves no second copy. One file holds what one
task has, and is read as one cell; it is as large as a partition of the input.

Defined results: a null page is an empty payload; a null id comes before all others and is written
as an empty one; repeated rows with the largest id are all responses; payloads of fewer than
``least_bytes`` are all responses; a revisit without any response keeps its type and has no
``payload_bytes``; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.common import new_path, query, table

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"


def sha1_base32(text: Column) -> Column:
    """Five hexadecimal digits of the digest are four of base 32."""
    digest = F.sha1(text)
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(digest, i * 5 + 1, F.lit(5)), 16, 10).cast("int"))
    digit = lambda v, shift: F.substring(F.lit(_BASE32), F.shiftright(v, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1))
    return F.array_join(F.transform(groups, lambda v: F.concat(*(digit(v, s) for s in (15, 10, 5, 0)))), "")


def records_of(pages: DataFrame) -> DataFrame:
    """(id, uri, digest, payload_bytes, payload) of pages (page_id, url, html), all of them responses."""
    text = F.coalesce("html", F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("id"), F.coalesce("url", F.lit("")).alias("uri"),
        sha1_base32(text).alias("digest"), F.octet_length(text).cast("long").alias("payload_bytes"), text.alias("payload"))


def resolve_revisits(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``records`` with ``type`` and ``refers_to``. Records without payload are revisits already."""
    heads = records.select("id", "digest", "payload_bytes", F.col("payload").isNotNull().alias("full"))
    shared = heads.groupBy("digest").agg(
        F.count("*").alias("n"), F.max(F.when(F.col("full"), F.col("id"))).alias("response"),
        F.max("full").alias("any"),
    ).where("n > 1")
    # By id and digest, so that a payload with very many copies is not one group of the next join.
    known = heads.join(shared, "digest").select(
        F.col("id").alias("known_id"), F.col("digest").alias("known_digest"), "response", "any").distinct()
    joined = records.join(known, F.col("id").eqNullSafe(F.col("known_id")) & (F.col("digest") == F.col("known_digest")), "left")
    own = F.col("payload").isNotNull() & (
        F.col("any").isNull() | F.col("id").eqNullSafe(F.col("response")) | (F.coalesce("payload_bytes", F.lit(0)) < least_bytes))
    return joined.select(
        "id", "uri", "digest", "payload_bytes", F.when(own, F.col("payload")).alias("payload"),
        F.when(own, "response").otherwise("revisit").alias("type"), F.when(~own, F.col("response")).alias("refers_to"))


def _urn(id: str) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(id).cast("string"), F.lit("")), F.lit(">"))


def record_text(date: str = DATE) -> Column:
    """A record without its end, from the columns of ``resolve_revisits``."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    uri = F.regexp_replace("uri", r"[\x00-\x20\x7F]", "%20")
    body = F.coalesce("payload", F.lit(""))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, body)
    revisit = F.col("type") == "revisit"
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("type")), line("WARC-Record-ID", _urn("id")),
        line("WARC-Date", F.lit(date)), line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(_PROFILE)), line("WARC-Refers-To", _urn("refers_to")))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block)


def write_archives(resolved: DataFrame, path: str, compression: str = "gzip", date: str = DATE) -> None:
    resolved.select(record_text(date).alias("value")).write.option("lineSep", _END).option("compression", compression).text(path)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields, by lower-cased name, and block of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        fields = {}
        for row in data[at:end].split(b"\r\n")[1:]:
            name, _, value = row.partition(b":")
            fields[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
        start = end + 4
        at = start + int(fields["content-length"])
        yield fields, data[start:at]
        at += 4


READ = "id string, uri string, type string, digest string, payload_bytes long, payload_digest string, refers_to string, payload binary"


def _read(with_payload: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for data in frame["content"]:
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                rows, held = [], 0
                for f, block in parse_records(data):
                    payload = block.partition(b"\r\n\r\n")[2]
                    full = f["warc-type"] == "response"
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if full else None
                    urn = lambda v: None if v is None else v[len("<urn:page:"):-1] or None
                    rows.append((urn(f["warc-record-id"]), f.get("warc-target-uri"), f["warc-type"],
                                 f["warc-payload-digest"].partition(":")[2], len(payload) if full else None, digest,
                                 urn(f.get("warc-refers-to")), payload if full and with_payload else None))
                    held += len(payload)
                    if held > 8_000_000:
                        yield pd.DataFrame(rows, columns=[c.split()[0] for c in READ.split(", ")]).astype({"payload_bytes": "Int64"})
                        rows, held = [], 0
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in READ.split(", ")]).astype({"payload_bytes": "Int64"})

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all archives under a path; ``payload_digest`` is that of the bytes read."""
    files = spark.read.format("binaryFile").load(path).select("content")
    read = files.mapInPandas(_read(with_payload), READ)
    return read.withColumn("id", F.col("id").cast("long")).withColumn("refers_to", F.col("refers_to").cast("long"))


def follow_revisits(records: DataFrame) -> DataFrame:
    """Revisits with the size of the payload of the response they refer to."""
    originals = records.where("type = 'response' and id is not null").select(
        F.col("id").alias("original"), F.col("digest").alias("original_digest"), F.col("payload_bytes").alias("original_bytes")).distinct()
    revisits = records.where("type = 'revisit'").join(
        originals, (F.col("refers_to") == F.col("original")) & (F.col("digest") == F.col("original_digest")), "left")
    columns = ["id", "uri", "type", "digest", "refers_to"]
    return records.where("type = 'response'").select(*columns, "payload_bytes").unionByName(
        revisits.select(*columns, F.col("original_bytes").alias("payload_bytes")))


#: Payloads by themselves: digests of the given texts, the largest page of each, no archive.
CHECK = f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS last, list_transform(range(0, 8),
lambda i: CAST('0x' || hex[5 * i + 1:5 * i + 5] AS BIGINT)) AS groups FROM p)
SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes,
array_to_string(list_transform(groups, lambda g: '{_BASE32}'[(g >> 15) % 32 + 1] || '{_BASE32}'[(g >> 10) % 32 + 1]
|| '{_BASE32}'[(g >> 5) % 32 + 1] || '{_BASE32}'[g % 32 + 1]), '') AS payload_digest,
CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN page_id <> last THEN last END AS refers_to, regexp_replace(url, '[\\x00-\\x20\\x7F]', '%20', 'g') AS url FROM d"""


@query("op9_warc_revisits", CHECK)
def op9(spark, sf_dir):
    path = new_path(spark, "warc")
    write_archives(resolve_revisits(records_of(table(spark, sf_dir, "pages"))), path)
    return follow_revisits(read_archives(spark, path, with_payload=False)).select(
        F.col("id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), "refers_to", F.col("uri").alias("url"))
