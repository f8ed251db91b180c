"""WARC archives: revisit resolution, writing with fresh headers, and reading back.

Only slim headers (digest and id) are shuffled by payload digest. A digest that several records carry keeps its
smallest id as the original; the others become revisit records without a payload. The archives are written by Spark's
own text writer: a record is one "line" and the four bytes that end every WARC record are the line separator, so files
are committed like any other table, on any file system that Spark writes to. Reading splits the files at the version
line; pieces of a payload that happens to contain it are put together again by Content-Length, so memory holds one
record at a time.

Defined cases: a null payload is empty; a null id sorts after all others and is original only where no record with that
payload has an id; rows that tie on the smallest id of a payload are all written as responses; line breaks in a URL are
percent-encoded; a null URL leaves its header out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordermill.llm.common import kept_lineage_cut, prepare
from ordermill.session import scratch_path

VERSION = "WARC/1.1\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Below so many repeated digests (about 80 bytes each) the originals are broadcast, beyond it they are shuffled.
BROADCAST_ROWS = 200_000


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of a binary column in bare upper-case base32, without Python."""
    digest = F.sha1(payload)
    letters = []
    for at in range(8):  # five hexadecimal digits are four base32 letters
        five = F.conv(F.substring(digest, 1 + 5 * at, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(five, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def resolved(records: DataFrame, minimum: int = 0) -> DataFrame:
    """Records (id, url, payload) with payload_bytes, payload_digest, record_type and refers_to.

    Of equal payloads of at least ``minimum`` bytes the smallest id is a response and the others revisit it.
    """
    rows = records.select("id", "url", F.coalesce("payload", F.to_binary(F.lit(""), F.lit("utf-8"))).alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")) \
               .withColumn("payload_digest", base32_sha1(F.col("payload")))
    headers = rows.filter(F.col("payload_bytes") >= minimum).select("id", "payload_digest")
    first = headers.groupBy("payload_digest").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")) \
                   .filter("n > 1 and first_id is not null").select("payload_digest", "first_id")
    first = kept_lineage_cut(first)
    if first.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        first = F.broadcast(first)
    joined = rows.join(first, "payload_digest", "left")
    again = (F.col("payload_bytes") >= minimum) & F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    return joined.withColumn("record_type", F.when(again, "revisit").otherwise("response")) \
                 .withColumn("refers_to", F.when(again, F.col("first_id"))).drop("first_id")


def _record_uri(identity: Column, digest: Column) -> Column:
    """A URN made of the record's id and digest, the same in every run."""
    h = F.md5(F.concat_ws(" ", F.coalesce(identity.cast("string"), F.lit("null")), digest))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def write(rows: DataFrame, path: str, date: str, records_per_file: int = 20_000) -> None:
    """Writes the rows of ``resolved`` as gzipped WARC files, one record for each, with fresh headers."""
    safe = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    revisit = F.col("record_type") == "revisit"
    head = F.concat(
        F.lit(VERSION + "WARC-Type: "), F.col("record_type"),
        F.lit("\r\nWARC-Record-ID: "), _record_uri(F.col("id"), F.col("payload_digest")),
        F.lit(f"\r\nWARC-Date: {date}"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), safe), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.coalesce(F.concat(F.lit("\r\nX-Source-Id: "), F.col("id").cast("string")), F.lit("")),
        F.when(revisit, F.concat(
            F.lit("\r\nWARC-Refers-To: "), _record_uri(F.col("refers_to"), F.col("payload_digest")),
            F.lit("\r\nX-Refers-To-Id: "), F.col("refers_to").cast("string"),
            F.lit(f"\r\nWARC-Refers-To-Date: {date}\r\nWARC-Profile: {PROFILE}"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))).cast("string"), F.lit("\r\n\r\n"))
    body = F.when(revisit, F.to_binary(F.lit(""), F.lit("utf-8"))).otherwise(F.col("payload"))
    record = F.concat(head.cast("binary"), http.cast("binary"), body)
    # a cast from binary to string keeps the bytes as they are, and so does the text writer
    rows.select(record.cast("string").alias("value")).write.option("lineSep", END) \
        .option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records below ``path``: headers as a map, the HTTP header and the payload as bytes."""
    prepare(spark)
    lines = spark.read.option("lineSep", VERSION).text(path).select(
        F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_parts: list[bytes] = []
        file, missing = None, 0
        for batch in batches:
            out = []
            for part, name in zip(batch.column("value").to_pylist(), batch.column("file").to_pylist()):
                if name != file:
                    if open_parts:
                        raise ValueError(f"{file} ends within a record")
                    file = name
                if not open_parts and not part:
                    continue  # before the first version line
                open_parts.append(part)
                if len(open_parts) == 1:
                    missing = _length(part)
                else:
                    missing -= len(VERSION)
                missing -= len(part)
                if missing <= 0:
                    out.append(_record(VERSION.encode().join(open_parts)))
                    open_parts = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)
        if open_parts:
            raise ValueError(f"{file} ends within a record")
    return lines.mapInArrow(parsed, "headers map<string,string>, http binary, payload binary")


_SCHEMA = pa.schema([("headers", pa.map_(pa.string(), pa.string())), ("http", pa.binary()), ("payload", pa.binary())])


def _fields(part: bytes) -> tuple[dict[str, str], int]:
    """The headers of a record and where its block begins."""
    at = part.index(b"\r\n\r\n") + 4
    pairs = (line.split(": ", 1) for line in part[:at - 4].decode("utf-8", "replace").split("\r\n"))
    return {p[0]: p[1] for p in pairs if len(p) == 2}, at


def _length(part: bytes) -> int:
    """All bytes of the record that begins here, with headers and the end."""
    fields, at = _fields(part)
    return at + int(fields["Content-Length"]) + len(END)


def _record(whole: bytes) -> dict:
    fields, at = _fields(whole)
    block = whole[at:at + int(fields["Content-Length"])]
    http = block.index(b"\r\n\r\n") + 4
    return {"headers": list(fields.items()), "http": block[:http], "payload": block[http:]}


def archived(spark: SparkSession, records: DataFrame, date: str, minimum: int = 0, path: str | None = None) -> DataFrame:
    """Writes the archives and reads them back: a row for each record, revisits joined to their originals."""
    path = path or scratch_path(spark, "warc")
    write(resolved(records, minimum), path, date)
    rows = read(spark, path).select(
        F.col("headers")["X-Source-Id"].alias("id"), F.col("headers")["WARC-Type"].alias("record_type"),
        F.col("headers")["X-Refers-To-Id"].alias("refers_to"),
        F.substring(F.col("headers")["WARC-Payload-Digest"], 6, 32).alias("stated"),
        F.octet_length("payload").cast("long").alias("own_bytes"), base32_sha1(F.col("payload")).alias("own"))
    responses = rows.filter("record_type = 'response'")
    revisits = rows.filter("record_type = 'revisit'")
    # one original for each payload, so a payload that a third of all records share meets one row
    originals = responses.groupBy(F.col("own").alias("stated")).agg(F.min("own_bytes").alias("payload_bytes"))
    found = revisits.join(originals, "stated", "left")
    same = ["id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.select("id", F.col("own_bytes").alias("payload_bytes"), F.col("own").alias("payload_digest"),
                            "record_type", "refers_to") \
        .unionByName(found.select("id", "payload_bytes", F.col("stated").alias("payload_digest"), "record_type",
                                  "refers_to")).select(*same)
