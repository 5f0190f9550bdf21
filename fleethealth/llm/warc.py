"""WARC archives: writing with revisits, and a splittable reader.

Method. The writer puts each record into a gzip member of its own. The reader cuts archives into byte
ranges, one task each; a task looks for the gzip magic number in its range, accepts a candidate if
what it inflates to starts with a WARC header, and owns the records whose member starts inside its
range, reading past the range's end to finish the last one.

Damage is an error, not a missing row. Once a member's content has begun with a WARC header, a member that is cut or doesn't
inflate, and a record whose header or length is wrong, raise DamagedArchive; so do bytes after a record that are
no gzip member, as archives are members end to end. What precedes the first record and isn't one is passed over.

Which record keeps a payload is settled before writing by a pre-aggregated maximum over the payload
digest, written before an equi-join that adaptive execution splits, so a payload with very many copies meets
no single task. Archives go to
the shared folder; a task writes under a name of its own attempt, and only names that finished
tasks returned are read.

Defined results: null html is an empty payload; null ids are written as such, count as the smallest,
and come back null; repeated rows of the largest id are all responses; a very long payload is one record,
which one task inflates and holds whole; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleethealth.llm.common import batched, rows_of, scratch, written

#: Payloads from this size on are stored once; bytes that a reading task scans.
LEAST_REVISIT, SPLIT_BYTES = 1000, 16 << 20
MAGIC = b"\x1f\x8b\x08"
_VERSION = b"WARC/1."
_GZIP_HEAD = 10
_CHUNK = 1 << 20


def decide(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, html, digest, refers_to: refers_to is null for a response."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "utf-8")))
    long = F.octet_length("html") >= least
    groups = rows.filter(long).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    refers = F.when(long & ~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    groups = written(groups, "payload-keepers")  # apart from the join, so that a digest with very many rows can be split
    return rows.join(groups, "digest", "left").select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record, not compressed. A revisit keeps the response's headers, with the payload's length."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        name, size = f"{base}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz", 0
        out = None
        for page_id, url, html, refers_to in rows_of(batches):
            if out is None:
                out = store.open_output_stream(name, compression=None)  # members are compressed already
            data = member(record(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to))
            out.write(data)
            size += len(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "bytes": [size]})

    return run


def write_archives(decided: DataFrame) -> DataFrame:
    """path, bytes of each archive; written once, as the rows of a finished job."""
    spark = decided.sparkSession
    folder = scratch(spark, "warc")
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder if "://" in folder or not folder.startswith("file:") else "file://" + folder[5:])
    store.create_dir(base)
    names = decided.select("page_id", "url", "html", "refers_to").mapInArrow(_writer(folder), "path string, bytes long")
    return written(names.withColumn("folder", F.lit(folder)), "warc-names")


def parse(data: bytes) -> tuple[dict[str, str], bytes] | None:
    """Headers (lower-case names) and block of a record, or None if it isn't one."""
    if not data.startswith(_VERSION):
        return None
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap:
        return None
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    length = fields.get("content-length", "")
    return (fields, rest[: int(length)]) if length.isdigit() and len(rest) >= int(length) else None


class DamagedArchive(ValueError):
    """A record begins, and can't be read whole."""


class Range:
    """Bytes of an archive from ``start`` on, fetched as needed."""

    def __init__(self, source, start: int):
        self.source, self.start, self.data = source, start, bytearray()
        source.seek(start)

    def upto(self, end: int) -> bytearray:
        """The bytes from start; at least as far as the place ``end``, if the archive has them."""
        while self.start + len(self.data) < end and (more := self.source.read(max(_CHUNK, end - self.start - len(self.data)))):
            self.data += more
        return self.data

    def inflate(self, at: int, follows: bool = False, begin_only: bool = False) -> tuple[bytes, int] | None:
        """Content of the member at a place, and the place after it, or None if no record's member is there.

        A member that ``follows`` a record has to inflate, whatever it holds; ``begin_only`` looks at its first bytes."""
        d, out, pos, accepted = zlib.decompressobj(31), [], at, False
        while not d.eof:
            data = self.upto(pos + 1)[pos - self.start : pos - self.start + _CHUNK]
            try:
                if not data:
                    raise zlib.error("the archive ends in it")
                out.append(d.decompress(data))
            except zlib.error as e:
                if accepted or follows and len(self.upto(at + _GZIP_HEAD)) >= at + _GZIP_HEAD - self.start:
                    raise DamagedArchive(f"the member at byte {at}: {e}") from e
                return None
            if not accepted:
                begun = b"".join(out)
                accepted = begun.startswith(_VERSION)
                if not begun.startswith(_VERSION[: len(begun)]):
                    return None  # settled by the first bytes
                if accepted and begin_only:
                    break
            pos += len(data) - len(d.unused_data)
        return (b"".join(out), pos) if accepted else None


def read_range(source, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records whose members start in [start, end)."""
    held, at, follows = Range(source, start), start, False
    while at < end:
        data = held.upto(min(end, at + _CHUNK) + len(MAGIC) - 1)
        found, size = data.find(MAGIC, at - start), len(data)
        if found < 0:
            at = max(at, start + size - len(MAGIC) + 1)
            if at >= end or len(held.upto(at + len(MAGIC) + 1)) == size:
                return
            continue
        at = start + found
        if at >= end:
            return
        got, follows = held.inflate(at, follows), False
        if not got:
            at += 1
            continue
        rec = parse(got[0])
        if not rec:
            raise DamagedArchive(f"the member at byte {at} has no whole record")
        yield rec
        at = got[1]
        after = held.upto(at + len(MAGIC))[at - start : at - start + len(MAGIC)]
        if after and after != MAGIC:
            raise DamagedArchive(f"no member begins at byte {at}, after a record")
        follows = bool(after)
    if follows:  # the next range takes it for whatever it finds
        held.inflate(at, follows, begin_only=True)


def splits(archives: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """folder, path, start, end: byte ranges that cover the archives."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long")))
    return archives.select("folder", "path", "bytes", starts.alias("start")).withColumn("end", F.least(F.col("start") + split_bytes, F.col("bytes"))).drop("bytes")


_RECORDS = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to_id", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def _reader(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def each():
            for folder, path, start, end in rows_of(batches):
                store, _ = fs.FileSystem.from_uri(folder)
                with store.open_input_file(path) as source:
                    for fields, block in read_range(source, start, end):
                        head, _, payload = block.partition(b"\r\n\r\n")
                        digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                        length = next(int(x.partition(b":")[2]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        if fields["warc-type"] == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
                            raise ValueError(f"the payload of {fields['warc-record-id']} in {path} is damaged")
                        yield fields["warc-record-id"], fields["warc-type"], fields["warc-target-uri"], fields.get("warc-refers-to"), digest, length, payload if with_payload else None

        yield from batched(each(), _RECORDS, 500)

    return run


def read_archives(archives: DataFrame, split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """record_id, record_type, target_uri, refers_to_id, payload_digest, payload_bytes, payload of every record."""
    ranges = splits(archives, split_bytes)
    spark: SparkSession = archives.sparkSession
    ranges = ranges.repartition(max(1, min(10_000, int(archives.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1))), "path", "start") if spark else ranges
    fields = "record_id string, record_type string, target_uri string, refers_to_id string, payload_digest string, payload_bytes long, payload binary"
    return ranges.select("folder", "path", "start", "end").mapInArrow(_reader(with_payload), fields)


def page_of(record_id: str):
    return F.nullif(F.regexp_extract(record_id, "^<urn:page:(-?[0-9]*)>$", 1), F.lit("")).cast("long")
