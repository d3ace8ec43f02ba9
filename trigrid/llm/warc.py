"""Content-addressed WARC archive.

Payload bytes are stored once under their SHA-256, record headers apart from them exactly as they read
in the file, and original records come back by joining the two. The first of equal payloads (the
one with the largest page_id) is a ``response``; the others are ``revisit`` records that name it, as
long as the payload has at least 1000 bytes. Reading verifies every stored payload against its
digests, so a header can only meet the bytes it was written for.

:func:`write_archive` makes the two tables, :func:`records` joins them into the original records (header and
body, byte for byte), :func:`parse` reads records, from wherever they come, by their own lengths and digests,
and :func:`read_archive` is the two together, with revisits resolved by the record they refer to.
:func:`export_warc` writes plain WARC/1.1 text files, :func:`import_warc` reads such files.

Defined results: a null html is the empty payload; a null page_id is written as an empty record id,
never refers or is referred to, and is a response; rows with the same page_id and payload are
all responses when that id is the largest, and fully repeated rows give a record each; an empty table gives an empty
archive; payloads of any length are stored whole (a record must fit Spark's 2 GB a value); columns other than page_id, url and html are ignored; a null url is left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace

#: Payloads shorter than this are always written as responses.
MIN_REVISIT_BYTES = 1000
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _one_line(value: Column) -> Column:
    """Header values can't hold line ends."""
    return F.regexp_replace(value, "[\r\n]+", " ")


def _headers(date: str) -> Column:
    """The exact header block of a record, up to and with its empty line."""
    revisit = F.col("record_type") == "revisit"
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), "record_type"),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")),
        F.lit(f"WARC-Date: {date}"),
        F.when(F.col("url").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), _one_line(F.col("url")))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "sha1"),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF))


def write_archive(pages: DataFrame, ws: Workspace, name: str = "archive", date: str = "2000-01-01T00:00:00Z") -> None:
    """Write the tables ``<name>-headers`` (header, sha256, revisit) and ``<name>-payloads`` (sha256, payload)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8").alias("payload"))
    pages = pages.withColumns({"sha256": F.unhex(F.sha2("payload", 256)), "sha1": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    # One copy of each payload: copies on the same task merge before the shuffle.
    pages.select("sha256", "payload").dropDuplicates(["sha256"]).write.mode("overwrite").option("compression", "zstd").parquet(ws.path(f"{name}-payloads"))
    small = ws.keep(pages.select("page_id", "url", "sha256", "sha1", "payload_bytes"), f"{name}-index")
    latest = ws.keep(small.where(f"payload_bytes >= {MIN_REVISIT_BYTES}").groupBy("sha256").agg(F.max("page_id").alias("latest"), F.count("*").alias("n")).where("n > 1 AND latest IS NOT NULL").drop("n"), f"{name}-latest")
    heads = small.join(latest, "sha256", "left")
    heads = heads.withColumn("refers_to", F.when(F.col("page_id") != F.col("latest"), F.col("latest")))
    heads = heads.withColumn("record_type", F.when(F.col("refers_to").isNotNull(), "revisit").otherwise("response"))
    heads.select(_headers(date).alias("header"), "sha256", (F.col("record_type") == "revisit").alias("revisit")).write.mode("overwrite").option("compression", "zstd").parquet(ws.path(f"{name}-headers"))
    ws.drop(f"{name}-index", f"{name}-latest")


def records(ws: Workspace, name: str = "archive") -> DataFrame:
    """The records as they stand in a file: ``record`` (header, empty line, body; binary). Payloads go to the records
    that carry one, about one each; a payload that doesn't match its strong digest fails the job."""
    headers = ws.spark.read.parquet(ws.path(f"{name}-headers"))
    stored = ws.spark.read.parquet(ws.path(f"{name}-payloads"))
    true = F.sha2("payload", 256) == F.lower(F.hex("sha256"))
    stored = stored.select("sha256", F.when(true, F.col("payload")).otherwise(F.raise_error(F.lit("stored payload doesn't match its digest"))).alias("payload"))
    bare = headers.where("revisit").select(F.encode("header", "utf-8").alias("record"))
    full = headers.where("NOT revisit").join(stored, "sha256").select(F.concat(F.encode("header", "utf-8"), "payload").alias("record"))
    return full.unionByName(bare)


def _field(name: str, pattern: str) -> Column:
    """A header value; lines end in CRLF, so a value can't reach into another line."""
    found = F.regexp_extract("header", f"\r\n{name}: {pattern}\r\n", 1)
    return F.when(found != "", found)


def parse(found: DataFrame, payloads: bool = False) -> DataFrame:
    """Fields of records (``record``, binary): page_id, record_type, refers_to, url, the digest its header states, and
    its body's length. Fails on a body whose length or digest is not the one stated."""
    header = F.substring_index(F.decode("record", "utf-8"), "\r\n\r\n", 1)
    split = found.select("record", F.concat(header, F.lit("\r\n\r\n")).alias("header"))
    body = F.expr("substring(record, octet_length(header) + 1)")
    digest = _field("WARC-Payload-Digest", "sha1:([0-9a-f]{40})")
    size = F.octet_length("body").cast("long")
    fields = split.select("header", body.alias("body")).select(
        _field("WARC-Record-ID", "<urn:page:(-?[0-9]*)>").cast("long").alias("page_id"),
        _field("WARC-Type", "([a-z]+)").alias("record_type"),
        _field("WARC-Refers-To", "<urn:page:(-?[0-9]+)>").cast("long").alias("refers_to"),
        _field("WARC-Target-URI", "([^\r\n]*)").alias("url"),
        digest.alias("payload_digest"),
        F.when(size == _field("Content-Length", "([0-9]+)").cast("long"), size).otherwise(F.raise_error(F.lit("record is not as long as its header states"))).alias("body_bytes"),
        F.sha1("body").alias("true_digest"),
        *(["header", "body"] if payloads else []),
    )
    wrong = (F.col("record_type") == "response") & ~F.col("payload_digest").eqNullSafe(F.col("true_digest"))
    return fields.withColumn("payload_digest", F.when(wrong, F.raise_error(F.lit("record header doesn't match its payload"))).otherwise(F.col("payload_digest"))).drop("true_digest")


def resolved(fields: DataFrame, ws: Workspace) -> DataFrame:
    """Parsed records with ``payload_bytes``, the true length of the payload: a revisit's is that of the record it
    refers to, found by that record's id and the digest both state. Those records are written first, so that adaptive
    execution splits the revisits of one that very many refer to."""
    lengths = fields.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("body_bytes").alias("full_bytes"))
    wanted = fields.where("record_type = 'revisit'")
    # Rows with one id and payload are responses alike; one stands for them.
    lengths = lengths.join(wanted.select("refers_to").distinct(), "refers_to", "left_semi").dropDuplicates(["refers_to", "payload_digest"])
    lengths = ws.keep(lengths, "referred")
    back = wanted.join(lengths, ["refers_to", "payload_digest"], "left")
    found = F.coalesce("full_bytes", F.raise_error(F.lit("a revisit refers to no record")).cast("long"))
    back = back.select(*fields.columns, found.alias("payload_bytes"))
    return fields.where("record_type <> 'revisit'").withColumn("payload_bytes", F.col("body_bytes")).unionByName(back)


def read_archive(ws: Workspace, name: str = "archive") -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    fields = ws.keep(parse(records(ws, name)), f"{name}-fields")
    return resolved(fields, ws).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def export_warc(ws: Workspace, target: str, name: str = "archive") -> None:
    """Write the records as WARC/1.1 files under ``target``. Each record ends in two line ends, which
    is what the writer puts between lines; revisit records have no body."""
    records(ws, name).select(F.decode("record", "utf-8").alias("value")).write.mode("overwrite").option("lineSep", CRLF + CRLF).text(target)


def import_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records (``record``, binary) of WARC files, cut by the lengths their headers state. A file is one task's work."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                data, at = content.as_py(), 0
                while at < len(data):
                    end = data.find(b"\r\n\r\n", at) + 4
                    length = re.search(rb"\r\nContent-Length: (\d+)\r\n", data[at:end])
                    if end < 4 or not length or end + int(length[1]) > len(data):
                        raise ValueError("a record is cut off")
                    stop = end + int(length[1])
                    yield pa.RecordBatch.from_pydict({"record": pa.array([data[at:stop]], pa.binary())})
                    at = stop + 4

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "record binary")


def archive_pages(pages: DataFrame, ws: Workspace) -> DataFrame:
    """Write the archive of ``pages`` and read it back: one row per page."""
    write_archive(pages, ws)
    out = read_archive(ws).drop("url")
    ws.drop("archive-headers", "archive-payloads")
    return out
