"""WARC archives: writing, reading back, and revisit resolution.

Archives are written by Spark's text writer, one record a row with the record
separator as line end, gzipped; they are read back whole file by whole file
(``files_records`` bounds a file) and cut by Content-Length, so any file system
that Spark knows will do, and a payload may hold any bytes.

``resolve`` works on headers only: they are combined by (payload digest, length)
to find the record that stays (an aggregation with a map side, so a payload that
a third of the records share is one row a task), then joined back to name each
revisit's original; adaptive execution splits a hot digest there.  The revisits
are written to the shared folder, so that their size is known when the payloads
are joined with them: few of them are broadcast and payloads aren't shuffled.

Defined results: null payloads are empty; null url or id give an empty header; of
equal payloads the record with the largest id is the response, a null id last,
then the one that stands first in the archives; revisit records among the input
follow the response of their digest, and stay as they are if no record has the
payload; payloads under ``min_bytes`` are all responses; no records give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize

#: Values of the format (fixed values).
VERSION = "WARC/1.1"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEX32, RFC32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Date of records whose source has none.
DATE = "2000-01-01T00:00:00Z"
FILE_RECORDS = 2000

RECORDS = "file string, position long, warc_type string, record_id string, page_id long, target_uri string, date string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hexadecimal digits make four of base 32."""
    digits = F.sha1(payload)
    part = lambda i: F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0")
    return F.translate(F.concat(*[part(i) for i in range(8)]), HEX32, RFC32)


def _line(name: str, value: Column | str) -> Column:
    value = F.lit(value) if isinstance(value, str) else value
    # line ends inside a value would break the header
    return F.concat(F.lit(f"{name}: "), F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"[\r\n]+", " "), F.lit("\r\n"))


def record_id(page_id: Column, uri: Column) -> Column:
    name = F.sha1(F.concat_ws("\x00", F.coalesce(page_id.cast("string"), F.lit("")), F.coalesce(uri, F.lit(""))).cast("binary"))
    pick = lambda a, n: F.substring(name, a, n)
    return F.concat(F.lit("<urn:uuid:"), pick(1, 8), F.lit("-"), pick(9, 4), F.lit("-5"), pick(14, 3), F.lit("-a"), pick(18, 3), F.lit("-"), pick(21, 12), F.lit(">"))


def _record(rows: DataFrame) -> DataFrame:
    """Rows of the columns of RECORDS, refers_uri and refers_date, as the text of records."""
    revisit = F.col("warc_type") == "revisit"
    body = F.when(revisit, F.lit("").cast("binary")).otherwise(F.col("payload"))
    head = F.concat(
        F.lit(f"{VERSION}\r\n"),
        _line("WARC-Type", F.col("warc_type")),
        _line("WARC-Record-ID", F.col("record_id")),
        _line("WARC-Date", F.col("date")),
        _line("WARC-Target-URI", F.col("target_uri")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _line("X-Page-ID", F.col("page_id")),
        _line("X-Payload-Length", F.col("payload_bytes")),
        F.when(
            revisit,
            F.concat(
                _line("WARC-Profile", PROFILE),
                _line("WARC-Refers-To", F.col("refers_record")),
                _line("WARC-Refers-To-Target-URI", F.col("refers_uri")),
                _line("WARC-Refers-To-Date", F.col("refers_date")),
                _line("X-Refers-To-Page-ID", F.col("refers_to")),
            ),
        ).otherwise(F.lit("")),
        _line("Content-Type", "text/html; charset=utf-8"),
        _line("Content-Length", F.octet_length(body)),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(head.cast("binary"), body).cast("string").alias("value"))


def write_records(rows: DataFrame, path: str, file_records: int = FILE_RECORDS) -> None:
    writer = _record(rows).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", file_records)
    writer.text(path)


def write_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", file_records: int = FILE_RECORDS) -> None:
    """A response record for every page."""
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("target_uri"), payload.alias("payload"))
    none = F.lit(None).cast("string")
    write_records(
        rows.select(
            "*",
            F.lit("response").alias("warc_type"),
            record_id(F.col("page_id"), F.col("target_uri")).alias("record_id"),
            F.lit(DATE).alias("date"),
            base32_sha1(F.col("payload")).alias("payload_digest"),
            F.octet_length("payload").cast("long").alias("payload_bytes"),
            F.lit(None).cast("long").alias("refers_to"),
            none.alias("refers_record"),
            none.alias("refers_uri"),
            none.alias("refers_date"),
        ),
        path,
        file_records,
    )


def _records(content: bytes, skip_payload: bool) -> Iterator[tuple]:
    """(position, headers, payload) of the records of one gzipped file, inflated as it is read."""
    inflate = zlib.decompressobj(wbits=47)
    view, fed, held, base = memoryview(content), 0, bytearray(), 0

    def need(n: int) -> bool:
        nonlocal fed, inflate
        while len(held) < n:
            if inflate.eof and inflate.unused_data:
                rest, inflate = inflate.unused_data, zlib.decompressobj(wbits=47)
                held.extend(inflate.decompress(rest))
            elif fed < len(view):
                held.extend(inflate.decompress(view[fed : fed + (1 << 18)]))
                fed += 1 << 18
            else:
                return False
        return True

    while True:
        seen = 0
        while (end := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not need(seen + 1):
                if held.strip():
                    raise ValueError("the archive ends inside a record")
                return
        lines = bytes(held[:end]).decode("utf-8", "replace").split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
        length = int(headers["Content-Length"])
        if not need(end + 4 + length):
            raise ValueError("the archive ends inside a record")
        yield base, headers, None if skip_payload else bytes(held[end + 4 : end + 4 + length])
        need(end + 8 + length)
        size = min(len(held), end + 8 + length)
        del held[:size]
        base += size


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives below ``path``, with the columns of RECORDS."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: int(x) if x else None
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        names = [c.split(" ")[0] for c in RECORDS.split(", ")]

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for i in range(batch.num_rows):
                rows, size, file = [], 0, batch.column(0)[i].as_py()
                for position, h, payload in _records(batch.column(1)[i].as_py(), not payloads):
                    digest = h.get("WARC-Payload-Digest", "").removeprefix("sha1:")
                    rows.append((
                        file, position, h["WARC-Type"], h.get("WARC-Record-ID"), number(h.get("X-Page-ID")), h.get("WARC-Target-URI"), h.get("WARC-Date"),
                        digest, int(h.get("X-Payload-Length") or h["Content-Length"]), number(h.get("X-Refers-To-Page-ID")), payload,
                    ))
                    size += len(payload or b"")
                    if len(rows) >= 1000 or size >= 16 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInArrow(parse, RECORDS)


def resolve(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The revisits among ``headers``: file, position and the response that each refers to."""
    known = headers.select("file", "position", "warc_type", "record_id", "page_id", "target_uri", "date", "payload_digest", "payload_bytes")
    order = F.struct(
        (F.col("warc_type") == "revisit").alias("is_revisit"),
        F.col("page_id").isNull().alias("no_id"),
        (-F.col("page_id")).alias("order"),
        F.col("file").alias("of_file"),
        F.col("position").alias("of_position"),
        F.col("page_id").alias("refers_to"),
        F.col("record_id").alias("refers_record"),
        F.col("target_uri").alias("refers_uri"),
        F.col("date").alias("refers_date"),
    )
    large = known.where(F.col("payload_bytes") >= min_bytes)
    originals = large.groupBy("payload_digest", "payload_bytes").agg(F.min(order).alias("o"), F.count("*").alias("n")).where("n > 1 and not o.is_revisit")
    originals = originals.select("payload_digest", "payload_bytes", "o.*").drop("is_revisit", "no_id", "order")
    met = large.join(originals, ["payload_digest", "payload_bytes"]).where("not (file = of_file and position = of_position)")
    return met.select("file", "position", "refers_to", "refers_record", "refers_uri", "refers_date")


def deduplicate(spark: SparkSession, source: str, target: str, min_bytes: int = 0, file_records: int = FILE_RECORDS) -> None:
    """Write the archives of ``source`` to ``target`` with repeated payloads as revisits, all headers fresh."""
    revisits = materialize(resolve(read_records(spark, source, payloads=False), min_bytes), "warc-revisits")
    told = revisits.select(F.col("file").alias("r_file"), F.col("position").alias("r_position"), F.col("refers_to").alias("r_refers_to"), "refers_record", "refers_uri", "refers_date")
    rows = read_records(spark, source)
    joined = rows.join(told, (F.col("file") == F.col("r_file")) & (F.col("position") == F.col("r_position")), "left")
    is_revisit = F.col("r_file").isNotNull()
    write_records(
        joined.withColumn("warc_type", F.when(is_revisit, "revisit").otherwise(F.col("warc_type"))).withColumn("refers_to", F.when(is_revisit, F.col("r_refers_to")).otherwise(F.col("refers_to"))),
        target,
        file_records,
    )
