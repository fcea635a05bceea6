"""WARC archives in Zstandard frames with a dictionary of their own.

An archive is one binary: a skippable frame (magic 0x184D2A5D) holding a dictionary that was trained
on the archive's first records, then a frame for each record, so that every record can be read
alone. Records with equal payloads are written once: the one with the largest page id is the
response, the others are revisits that name it.

Archives are rows (archive, content) of a Parquet table in a shared store, so executors need no
local folder and a repeated task replaces its own output; export_archives() turns them into
.warc.zst files. Memory of a task: one archive of at most ARCHIVE_BYTES plus one record.

Defined cases: null html is an empty payload; null url gives no target header; a null page id is a
revisit where its payload has a page with an id, else a response; rows that repeat a page id and
payload are all responses (or all revisits); records too few or too short to train on are the
dictionary's content themselves; a very long payload is one record, held whole; empty table, no
archives; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, keyed, rows_of, ship, stored, work_dir

# Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVE_BYTES = 8 << 20
SAMPLE_BYTES = 1 << 20
DICT_BYTES = 32 << 10
LEVEL = 3
ARCHIVES = "archive string, content binary"
RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record; a revisit if refers_to is given."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive_info(name: str, date: str) -> bytes:
    """The record that describes an archive."""
    block = b"software: assayflow\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"]
    head += [f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record; ValueError if it is damaged."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    length = int(fields["Content-Length"])
    if not gap or not version.startswith("WARC/") or rest[length:] != b"\r\n\r\n":
        raise ValueError("damaged WARC record")
    return fields, rest[:length]


class ArchiveWriter:
    """Collects records into an archive, which opens with a description of itself; the first SAMPLE_BYTES
    of the records train its dictionary. Records too few or too short to train one are themselves
    taken as its content, up to DICT_BYTES."""

    def __init__(self, name: str, date: str) -> None:
        self.name = name
        self.waiting: list[bytes] = [archive_info(name, date)]
        self.waiting_size = 0
        self.out = bytearray()
        self.compressor: zstandard.ZstdCompressor | None = None
        self.records = 0

    def add(self, data: bytes) -> None:
        self.records += 1
        if self.compressor:
            self.out += self.compressor.compress(data)
            return
        self.waiting.append(data)
        self.waiting_size += len(data)
        if self.waiting_size >= SAMPLE_BYTES:
            self.start()

    def start(self) -> None:
        try:
            trained = zstandard.train_dictionary(min(DICT_BYTES, max(256, self.waiting_size // 10)), self.waiting, k=256, d=8)
        except zstandard.ZstdError:
            content = b"".join(self.waiting)[-DICT_BYTES:]
            trained = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw = trained.as_bytes()
        self.out += struct.pack("<II", SKIPPABLE, len(raw)) + raw
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=True)
        for data in self.waiting:
            self.out += self.compressor.compress(data)
        self.waiting.clear()

    def size(self) -> int:
        return len(self.out) if self.compressor else self.waiting_size

    def close(self) -> bytes:
        if not self.compressor:
            self.start()
        return bytes(self.out)


def read_archive(content: bytes, step: int = 1 << 14) -> Iterator[bytes]:
    """The records of an archive, one after the other, in bounded memory besides the content."""
    view, at, trained = memoryview(content), 0, None
    if len(content) >= 8 and struct.unpack_from("<I", content)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", content, 4)[0]
        trained = zstandard.ZstdCompressionDict(bytes(view[8 : 8 + size]))
        at = 8 + size
    decompressor = zstandard.ZstdDecompressor(dict_data=trained)
    rest = b""
    while rest or at < len(view):
        frame, parts = decompressor.decompressobj(), []
        while not frame.eof:
            if not rest:
                if at >= len(view):
                    raise ValueError("archive ends within a record")
                rest, at = bytes(view[at : at + step]), at + step
            parts.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else b""
        yield b"".join(parts)


def revisit_plan(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """page_id, url, html, refers_to. Payloads are compared by SHA-1 and length. Only digests that
    occur twice are joined back; a digest that many pages share is summed up before the shuffle,
    and the join may be split where it is skewed."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.withColumns({"digest": F.sha1(payload), "size": F.octet_length(payload)})
    twice = (
        rows.where(F.col("size") >= min_payload)
        .groupBy("digest", "size")
        .agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
        .where("n > 1 and last is not null")
        .select(F.col("digest").alias("d"), F.col("size").alias("s"), "last")
    )
    joined = rows.join(twice, (F.col("digest") == F.col("d")) & (F.col("size") == F.col("s")), "left")
    other = ~F.col("page_id").eqNullSafe(F.col("last"))
    return joined.select("page_id", "url", "html", F.when(other, F.col("last")).alias("refers_to"))


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    min_payload: int = 0, date: str = "2000-01-01T00:00:00Z",
) -> None:
    """Write the pages' archives as the Parquet table path (columns of ARCHIVES)."""
    plan = revisit_plan(keyed(pages, page_id=id_col, url=url_col, html=html_col), min_payload)
    plan = plan.withColumn("page_id", F.col("page_id").cast("long")).withColumn("refers_to", F.col("refers_to").cast("long"))
    schema = pa.schema([("archive", pa.string()), ("content", pa.binary())])
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0

        def opened() -> ArchiveWriter:
            return ArchiveWriter(f"part-{part:05d}-{number:05d}.warc.zst", date)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([writer.name]), pa.array([writer.close()], pa.binary())], schema=schema)

        writer = opened()
        for batch in batches:
            for ids, urls, htmls, refers in rows_of(batch, 64):
                for row in zip(ids, urls, htmls, refers, strict=True):
                    writer.add(record(row[0], row[1], (row[2] or "").encode("utf-8"), row[3], date))
                    if writer.size() >= ARCHIVE_BYTES:
                        yield done()
                        number += 1
                        writer = opened()
        if writer.records:
            yield done()

    plan.mapInArrow(run, ARCHIVES).write.mode("overwrite").parquet(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """RECORDS of all archives of a table. Every response's digest and length are computed from the
    payload and compared with its headers, and every revisit's with those of the response it names; a
    difference fails the job."""

    def run(contents: list):
        for content in contents:
            for data in read_archive(content):
                fields, block = parse_record(data)
                if fields["WARC-Type"] == "warcinfo":
                    continue
                page = int(fields["X-Page-ID"]) if "X-Page-ID" in fields else None
                digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
                refers = None
                if fields["WARC-Type"] == "response":
                    payload = block.partition(b"\r\n\r\n")[2]
                    if (digest, size) != (digest_of(payload), len(payload)):
                        raise ValueError(f"payload of page {page} is damaged")
                else:
                    refers = int(fields["X-Refers-To-Page"])
                yield page, size, digest, fields["WARC-Type"], refers

    schema = pa.schema(
        [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
         ("record_type", pa.string()), ("refers_to", pa.int64())]
    )
    records = stored(arrow_rows(spark.read.parquet(path).select("content"), run, schema, RECORDS, step=1), f"{work_dir(spark)}/records")
    named = records.where("record_type = 'response'").groupBy(
        F.col("page_id").alias("p"), F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b")
    ).agg(F.lit(True).alias("known"))
    same = (F.col("refers_to") == F.col("p")) & (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") == F.col("b"))
    lost = F.col("refers_to").isNotNull() & F.col("known").isNull()
    wrong = F.raise_error(F.concat(F.lit("no response for the revisit of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))
    kind = F.when(lost, wrong.cast("string")).otherwise(F.col("record_type")).alias("record_type")
    return records.join(named, same, "left").select("page_id", "payload_bytes", "payload_digest", kind, "refers_to")


def export_archives(spark: SparkSession, path: str, folder: str) -> int:
    """Write each archive as a file in a folder that all executors mount; the number of files."""

    def save(rows) -> None:
        import os

        os.makedirs(folder, exist_ok=True)
        for r in rows:
            with open(tmp := f"{folder}/.{r.archive}.{uuid.uuid4().hex}", "wb") as f:
                f.write(r.content)
            os.replace(tmp, f"{folder}/{r.archive}")

    ship(spark)
    archives = spark.read.parquet(path)
    archives.foreachPartition(save)
    return archives.count()
