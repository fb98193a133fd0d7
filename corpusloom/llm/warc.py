"""WARC archives: a writer, and a splittable reader over byte ranges.

Every record is a gzip member of its own. A read task is given a byte range; it looks for the gzip
magic, takes a place as a record's start only if the member decodes to a WARC header, and owns the
records that start inside its range, reading past its end to finish the last.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import arrow_batches, fresh_path, text_bytes, written

MAGIC = b"\x1f\x8b\x08"
#: Bytes of an archive that one read task is given, and of one read.
SPLIT, CHUNK = 8 << 20, 1 << 20
LEVEL = 3
EPOCH = "2024-01-01T00:00:00Z"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, owner: int | None, owner_url: str | None = None) -> bytes:
    """A gzip member with a response, or with a revisit (of ``owner``) that carries no payload."""
    uri = " ".join((url or "").split())
    lines = ["WARC/1.1", f"WARC-Type: {'response' if owner is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {uri}", f"WARC-Date: {EPOCH}", f"WARC-Payload-Digest: sha1:{digest32(payload)}", f"X-Payload-Length: {len(payload)}"]
    if owner is not None:
        lines += [f"WARC-Refers-To: <urn:page:{owner}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def plan(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, digest, owner): the page whose response a page revisits; null for responses.

    Pages of one payload of at least ``least`` bytes are responses but for all below the largest
    page_id; pages that repeat the largest page_id with the same payload stay responses. A page
    without a page_id revisits like others and is never revisited.
    """
    body = text_bytes("html")
    marks = pages.select(F.col("page_id").cast("long").alias("page_id"), F.unhex(F.sha1(body)).alias("digest"), (F.octet_length(body) >= least).alias("large"))
    marks = written(marks, "digests")
    owners = marks.where("large").groupBy("digest").agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1 and owner is not null").drop("n")
    return marks.where("large").join(owners, "digest").where("page_id is null or page_id < owner").select("page_id", "digest", "owner").distinct()


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url, html) below ``folder``; returns (path, size) of the archives.

    A task writes a draft and then renames it to a name that no other attempt has, so it never has to
    replace a file, which not every file system does. The archives that count are those returned; an
    attempt that was lost leaves a draft or an archive that nothing names. A record is made in memory,
    so a payload has to fit into a task a few times. Further columns are ignored; an empty table
    writes no archive.
    """
    arrow_batches(pages.sparkSession)
    revisits = written(plan(pages, least), "revisits").toDF("_id", "_digest", "owner")
    body = text_bytes("html")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("body"))
    rows = rows.join(revisits, rows["page_id"].eqNullSafe(revisits["_id"]) & (F.unhex(F.sha1("body")) == revisits["_digest"]), "left")

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        name = f"{task.partitionId():06d}-{uuid.uuid4().hex}"
        final, draft = f"{base}/pages-{name}.warc.gz", f"{base}/_{name}"
        size = 0
        out = None
        for batch in batches:
            for page_id, url, payload, owner in zip(*(batch.column(i).to_pylist() for i in range(4))):
                out = out or fs.open_output_stream(draft)
                member = record(page_id, url, payload, owner)
                out.write(member)
                size += len(member)
        if out:
            out.close()
            fs.move(draft, final)
            yield pa.RecordBatch.from_pydict({"path": [final], "size": [size]})

    return written(rows.select("page_id", "url", "body", "owner").mapInArrow(run, "path string, size long"), "archives")


class Source:
    """Reads a file in chunks from a position on; each byte is moved a bounded number of times."""

    def __init__(self, handle, at: int):
        self.handle, self.buffer, self.at = handle, bytearray(), at
        handle.seek(at)

    def more(self) -> bool:
        data = self.handle.read(CHUNK)
        self.buffer += data
        return bool(data)

    def skip(self, n: int) -> None:
        del self.buffer[:n]
        self.at += n


def member(source: Source) -> tuple[bytes, int] | None:
    """The decoded gzip member at the source's position and its length; None if there is none with a WARC header."""
    inflate, out, used, head = zlib.decompressobj(31), [], 0, b""
    while True:
        if used >= len(source.buffer) and not source.more():
            return None
        piece = bytes(source.buffer[used:])
        try:
            data = inflate.decompress(piece)
        except zlib.error:
            return None
        out.append(data)
        if len(head) < 5:
            head = b"".join(out)[:5]
            if len(head) >= 5 and head != b"WARC/":
                return None
        if inflate.eof:
            used += len(piece) - len(inflate.unused_data)
            return (b"".join(out), used) if head == b"WARC/" else None
        used += len(piece)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def records(handle, start: int, stop: int):
    """The members that start in [start, stop)."""
    source = Source(handle, start)
    while source.at < stop:
        found = source.buffer.find(MAGIC)
        if found < 0:
            keep = len(MAGIC) - 1
            if len(source.buffer) > keep:
                source.skip(len(source.buffer) - keep)
            if source.at >= stop or not source.more():
                return
            continue
        source.skip(found)
        if source.at >= stop:
            return
        got = member(source)
        if got is None:
            source.skip(1)
        else:
            yield got[0]
            source.skip(got[1])


def read_archives(spark: SparkSession, archives: DataFrame, folder: str, split: int = SPLIT) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload) of all records in (path, size) archives."""
    arrow_batches(spark)
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long")))
    ranges = archives.where("size > 0").select("path", begin.alias("start")).withColumn("stop", F.col("start") + split)
    ranges = ranges.repartition(max(1, spark.sparkContext.defaultParallelism * 2), "path", "start")

    def run(batches):
        fs, _ = filesystem(folder)
        for batch in batches:
            for path, start, stop in zip(*(c.to_pylist() for c in batch.columns)):
                rows: list[tuple] = []
                size = 0
                with fs.open_input_file(path) as handle:
                    for raw in records(handle, start, stop):
                        fields, block = parse(raw)
                        payload = block.partition(b"\r\n\r\n")[2]
                        name = fields["WARC-Record-ID"][10:-1]
                        owner = fields.get("WARC-Refers-To", "")[10:-1]
                        rows.append((int(name) if name else None, fields["WARC-Target-URI"], fields["WARC-Type"], int(owner) if owner else None, fields["WARC-Payload-Digest"][5:], int(fields["X-Payload-Length"]), payload if fields["WARC-Type"] == "response" else None))
                        size += len(payload)
                        if size > 4 << 20:
                            yield _batch(rows)
                            rows, size = [], 0
                yield _batch(rows)

    return ranges.mapInArrow(run, SCHEMA_DDL)


SCHEMA_DDL = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in _SCHEMA]
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _SCHEMA)], schema=_SCHEMA)


def checked(rows: DataFrame) -> DataFrame:
    """Fails where a response's payload is not what its header says."""
    hexes = F.sha1(F.coalesce("payload", F.lit(b"")))
    ok = (F.col("record_type") != "response") | ((F.octet_length("payload") == F.col("payload_bytes")) & (base32(hexes) == F.col("payload_digest")))
    return rows.withColumn("payload_digest", F.when(ok, F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("damaged record of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("?"))))))


def base32(hexes):
    """Upper-case base32 of 40 hexadecimal digits."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    out = []
    for group in range(8):
        value = F.conv(F.substring(hexes, 5 * group + 1, 5), 16, 10).cast("int")
        out += [F.substring(letters, F.shiftright(value, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def round_trip(pages: DataFrame, least: int = 0, split: int = SPLIT) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, written and read back.

    A null html is an empty payload and a null url an empty one; rows that repeat come back as often.
    A page without a page_id comes back without one. Payloads of any length are read in time linear in
    them; further columns are ignored and an empty table gives an empty result.
    """
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    rows = read_archives(spark, write_archives(pages, folder, least), folder, split)
    return checked(rows).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
