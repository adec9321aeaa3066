"""WARC: archives of one gzip stream each, their normalisation to one member a record, and reading.

A monolithic archive is what Spark's text writer makes of records under gzip: one stream for
the whole file, in which no record can be reached without inflating all before it. The normaliser
inflates every such stream once, in pieces of bounded size, writes each record as a gzip member of its own, and beside
the archive a sidecar of the members' offsets, by which readers seek to any range of records.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strandline.llm.common import open_store, replace_file, shared_folder
from strandline.plans.sizing import lookup_side

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:x-page:"
INDEX = "archive string, number long, offset long, size long"
RECORD = ("page_id long, payload_bytes long, payload_digest string, record_type string, "
          "refers_to long, uri string")
CHUNK = 1 << 20


def _header(value: Column) -> Column:
    """A header value on one line; line ends are percent-encoded."""
    return F.replace(F.replace(F.coalesce(value, F.lit("")), F.lit("\r"), F.lit("%0D")),
                     F.lit("\n"), F.lit("%0A"))


def _id(value: Column) -> Column:
    return F.concat(F.lit(f"<{ID_PREFIX}"), F.coalesce(value.cast("string"), F.lit("null")), F.lit(">"))


def plan_records(pages: DataFrame, key: str, payload: str, least: int) -> DataFrame:
    """Add digest, size and, for revisits, the page that holds the payload (``refers_to``).

    Only digest and key are grouped, combined map-side; the payloads themselves are not moved
    as long as the table of repeated digests fits a broadcast.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(
        F.col(key).cast("long").alias("__id"), body.alias("__body"),
        F.sha2(body.cast("binary"), 256).alias("__digest"),
        F.octet_length(body).cast("long").alias("__bytes"),
        *([F.col("url").alias("__url")] if "url" in pages.columns else [F.lit(None).alias("__url")]))
    repeated = rows.where(F.col("__bytes") >= least).groupBy("__digest").agg(
        F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n")).where(
        (F.col("__n") > 1) & F.col("__first").isNotNull()).drop("__n")
    joined = rows.join(lookup_side(repeated), "__digest", "left")
    refers = F.when((F.col("__bytes") >= least) & (F.col("__id") != F.col("__first")), F.col("__first"))
    return joined.withColumn("__refers", refers).drop("__first")


def record_text(planned: DataFrame) -> DataFrame:
    """One WARC record a row, as text without the two line ends that close it."""
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("__bytes").cast("string"), F.lit(CRLF + CRLF))
    revisit = F.col("__refers").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("__body")))
    fields = [
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        ("WARC-Record-ID", _id(F.col("__id"))),
        ("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        ("WARC-Target-URI", _header(F.col("__url"))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("__digest"))),
        ("Content-Type", F.lit("application/http;msgtype=response")),
        ("Content-Length", F.octet_length(block).cast("string")),
    ]
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)) for name, value in fields]
    extra = F.when(revisit, F.concat(
        F.lit(f"WARC-Profile: {PROFILE}{CRLF}WARC-Refers-To: "), _id(F.col("__refers")),
        F.lit(CRLF))).otherwise("")
    return planned.select(F.concat(F.lit(f"WARC/1.1{CRLF}"), *lines, extra, F.lit(CRLF), block)
                          .alias("value"))


def write_monolithic(pages: DataFrame, folder: str, key: str = "page_id", payload: str = "html",
                     least: int = 100, rows_per_file: int = 50_000) -> None:
    """Write the pages as archives of one gzip stream each, at most ``rows_per_file`` records long."""
    record_text(plan_records(pages, key, payload, least)).write.option(
        "lineSep", CRLF + CRLF).option("compression", "gzip").option(
        "maxRecordsPerFile", rows_per_file).text(folder)


class _Stream:
    """Bytes of a whole-file gzip stream, inflated as they are asked for."""

    def __init__(self, source):
        self.source, self.inflater = source, zlib.decompressobj(31)
        self.held, self.at, self.ended = bytearray(), 0, False

    def _more(self) -> bool:
        while not self.ended:
            packed = self.inflater.unconsumed_tail or self.source.read(CHUNK)
            if self.inflater.eof:
                packed = self.inflater.unused_data + packed
                if not packed:
                    break
                self.inflater = zlib.decompressobj(31)
            elif not packed:
                break
            plain = self.inflater.decompress(packed, CHUNK)
            if plain:
                del self.held[:self.at]
                self.at = 0
                self.held += plain
                return True
        self.ended = True
        return False

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with ``mark``; None at the end of the stream."""
        seen = self.at
        while (found := self.held.find(mark, seen)) < 0:
            behind = max(0, len(self.held) - self.at - len(mark) + 1)
            if not self._more():
                if len(self.held) > self.at:
                    raise ValueError("the archive ends inside a record's header")
                return None
            seen = self.at + behind
        end = found + len(mark)
        out = bytes(self.held[self.at:end])
        self.at = end
        return out

    def take(self, size: int) -> bytes:
        while len(self.held) - self.at < size:
            if not self._more():
                raise ValueError("the archive ends inside a record")
        out = bytes(self.held[self.at:self.at + size])
        self.at += size
        return out


def _fields(head: bytes) -> dict[bytes, bytes]:
    pairs = (line.split(b":", 1) for line in head.split(b"\r\n")[1:] if b":" in line)
    return {name.strip().lower(): value.strip() for name, value in pairs}


def _members(source):
    """Records of a monolithic stream, each with header, block and closing line ends."""
    stream = _Stream(source)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        body = stream.take(int(_fields(head)[b"content-length"]) + 4)
        yield head + body


def normalise(spark, monolithic: str, folder: str, level: int = 3) -> DataFrame:
    """Rewrite every archive below ``monolithic`` into ``folder``; returns the offset index.

    The index, written as one sidecar a file, is read back: ``archive``, ``number`` of the
    record in it, ``offset`` and ``size`` of its member. One task inflates one file, holding one
    record at a time.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(
        monolithic).select("path")

    def rewrite(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                target = f"{folder}/{path.rsplit('/', 1)[1].removesuffix('.txt.gz')}.warc.gz"
                index, place = io.StringIO(), [0, 0]

                def records(out, path=path, index=index, place=place, target=target):
                    store, local = open_store(_uri(path))
                    with store.open_input_stream(local, compression=None) as source:
                        for record in _members(source):
                            member = gzip.compress(record, level, mtime=0)
                            out.write(member)
                            index.write(f"{target},{place[0]},{place[1]},{len(member)}\n")
                            place[0] += 1
                            place[1] += len(member)

                replace_file(target, records)
                replace_file(target + ".idx",
                             lambda out, index=index: out.write(index.getvalue().encode()))
                yield pa.RecordBatch.from_pydict(
                    {"archive": [target], "records": [place[0]], "bytes": [place[1]]})

    done = files.mapInArrow(rewrite, "archive string, records long, bytes long")
    done.write.parquet(f"{folder}-done")
    return spark.read.schema(INDEX).option("pathGlobFilter", "*.idx").csv(folder)


def _uri(path: str) -> str:
    return "file:///" + path.removeprefix("file:").lstrip("/") if path.startswith("file:/") else path


def _page(value: bytes | None) -> int | None:
    found = value.decode().removeprefix(f"<{ID_PREFIX}").removesuffix(">") if value else "null"
    return None if found == "null" else int(found)


def parse_record(record: bytes) -> dict:
    """Fields of one record; a response's payload is measured and hashed anew."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[:int(fields[b"content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields[b"warc-type"].decode()
    size = int(_fields(http)[b"content-length"])
    digest = fields[b"warc-payload-digest"].decode().removeprefix("sha256:")
    if kind == "response":
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError("a response's payload differs from its header")
    return {"page_id": _page(fields[b"warc-record-id"]), "payload_bytes": size,
            "payload_digest": digest, "record_type": kind,
            "refers_to": _page(fields.get(b"warc-refers-to")),
            "uri": fields[b"warc-target-uri"].decode()}


def read_records(index: DataFrame, rows: int = 500) -> DataFrame:
    """Records at the places of an offset index, each member fetched and inflated alone.

    The index is dealt by archive and stretch of ``rows`` records, so that a long archive is
    read by many tasks.
    """
    dealt = index.repartition(F.col("archive"), F.floor(F.col("number") / rows)).sortWithinPartitions(
        "archive", "number")
    arrow = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()),
                       ("payload_digest", pa.string()), ("record_type", pa.string()),
                       ("refers_to", pa.int64()), ("uri", pa.string())])

    def read(batches):
        at, source = None, None
        for batch in batches:
            found = []
            for place in batch.to_pylist():
                if place["archive"] != at:
                    at = place["archive"]
                    store, path = open_store(at)
                    source = store.open_input_file(path)
                found.append(parse_record(gzip.decompress(
                    source.read_at(place["size"], place["offset"]))))
            yield pa.RecordBatch.from_pylist(found, schema=arrow)

    return dealt.mapInArrow(read, RECORD)


def archive_pages(pages: DataFrame, key: str = "page_id", payload: str = "html",
                  least: int = 100, folder: str | None = None) -> DataFrame:
    """Write pages to WARC archives, normalise these, and read every record back by its offset.

    Of pages with the same payload of at least ``least`` bytes, the one with the smallest key
    is a response and the others are revisits of it, without payload but with its size (in the
    HTTP header) and digest; smaller payloads are all responses. A null payload is empty, a null
    URL an empty header. A page without key is always a response, and never one others refer to.
    Rows that repeat the smallest key are responses too. Line ends in a URL are percent-encoded.
    Other columns of ``pages`` are not read. No pages give no records.
    """
    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "warc")
    write_monolithic(pages, f"{folder}/monolithic", key, payload, least)
    return read_records(normalise(spark, f"{folder}/monolithic", f"{folder}/records"))
