"""WARC archives: a writer with revisit records and a salvage reader.

The writer is a Spark map: each task writes its rows as gzip members, one a record, into archives of a bounded
size in the shared folder, and returns a manifest. The reader deals byte ranges of the archives to tasks; a
task handles the members that begin in its range. To find the first it searches for a member or version line
and checks it, and that is also how it recovers: when a record fails a check (inflation and its CRC, version
line, length, block digest), the reader searches for the next valid beginning, goes on from there, and logs
the bytes between as a quarantined gap.

Defined results: a null payload is empty; a null key is written as an empty id and reads back as null; of
records with equal payloads of at least ``REVISIT_FROM`` bytes those with the largest key are responses (all
of them, if the row is repeated) and the others revisits of it; an archive of no bytes has no records and no
gaps; an empty table gives no archives; other columns are left out; a payload or header block of any length is one
record, read by one task.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, new_path

REVISIT_FROM = 1000
#: An archive is closed at this size, and read in ranges of that one.
ARCHIVE_BYTES, RANGE_BYTES = 64_000_000, 8_000_000
READ = 1 << 18
#: Tasks that ranges are dealt to at most.
READERS = 20_000
#: A bare record's header block is looked for in so many bytes, then in twice as many, up to the end of the file.
HEADER = 1 << 16
#: The beginning of a gzip member and of a record, the epoch that records are dated.
MEMBER, VERSION, DATE = b"\x1f\x8b\x08", b"WARC/1.", "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "path string, start long, end long, kind string, record_type string, record_id string, refers_to string, uri string, payload_digest string, payload_bytes long, payload binary, problem string"
FIELDS = [x.split()[0] for x in SCHEMA.split(", ")]


def file_system(path: str):
    """Arrow's file system for a path or URI, and the path in it."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


def record(kind: str, key, uri: str | None, payload: bytes, digest: str, size: int, refers_to) -> bytes:
    """One record: headers, HTTP headers with the length of the full payload, and unless a revisit the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(key)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean(uri)}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{base32(digest)}", f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).hexdigest())}", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def name(key) -> str:
    return f"<urn:page:{'' if key is None else key}>"


def key_of(record_id: str | None) -> str | None:
    return (record_id or "")[10:-1] or None


def clean(uri: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri or "")


def base32(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def hex_of(header: str | None) -> str | None:
    """SHA-1 in hex from a digest header, in base 32 or hex."""
    value = (header or "").removeprefix("sha1:").strip()
    try:
        return value.lower() if re.fullmatch(r"[0-9a-fA-F]{40}", value) else base64.b32decode(value.upper()).hex() if value else None
    except binascii.Error:
        return None


def with_revisits(pages: DataFrame, key: str = "page_id", html: str = "html", least: int = REVISIT_FROM) -> DataFrame:
    """key, uri, payload, digest, size, record_type and refers_to of each page."""
    payload = F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("key"), F.col("url").alias("uri"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("size"), F.sha1(payload).alias("digest"))
    same = rows.where(F.col("size") >= least).groupBy("digest").agg(F.max("key").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = rows.join(same, "digest", "left").withColumn("revisit", F.coalesce((F.col("size") >= least) & ((F.col("key") < F.col("first")) | F.col("key").isNull()), F.lit(False)))
    return joined.select("key", "uri", F.when(~F.col("revisit"), F.col("payload")).alias("payload"), "digest", "size", F.when(F.col("revisit"), "revisit").otherwise("response").alias("record_type"), F.when(F.col("revisit"), F.col("first")).alias("refers_to"))


def write_warc(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, compress: bool = True) -> DataFrame:
    """Write rows as ``with_revisits`` has them; the manifest (path, size, records) is stored and returned.

    A task that runs again writes archives of other names; only those in the manifest are the result.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        out, size, n, path, made = None, 0, 0, "", []

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                made.append((path, size, n))
                out = None

        for batch in batches:
            for r in (x for k in range(0, batch.num_rows, 64) for x in batch.slice(k, 64).to_pylist()):
                if out is None:
                    file = f"{uuid.uuid4().hex}.warc{'.gz' * compress}"
                    path, size, n, out = f"{folder}/{file}", 0, 0, fs.open_output_stream(f"{base}/{file}", compression=None)
                data = record(r["record_type"], r["key"], r["uri"], r["payload"] or b"", r["digest"], r["size"], r["refers_to"])
                if compress:
                    z = zlib.compressobj(1, zlib.DEFLATED, 31)
                    data = z.compress(data) + z.flush()
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= archive_bytes:
                    close()
        close()
        columns = list(zip(*made, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "size", "records"])

    return materialize(rows.mapInArrow(run, "path string, size long, records long"), "manifest")


class Source:
    """A window on a file that moves forward: bytes at absolute places."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size, self.at, self.data = file, size, 0, b""

    def need(self, start: int, n: int) -> bytes:
        """At most ``n`` bytes from ``start``; fewer only at the end of the file."""
        n = max(0, min(n, self.size - start))
        if start < self.at or start > self.at + len(self.data):
            self.at, self.data = start, b""
        if start > self.at and start - self.at > READ:
            self.data, self.at = self.data[start - self.at :], start
        short = start + n - self.at - len(self.data)
        if short > 0:
            self.file.seek(self.at + len(self.data))
            self.data += self.file.read(max(short, READ))
        return self.data[start - self.at : start - self.at + n]


class Bad(Exception):
    """A check that a record failed."""


def inflate(src: Source, start: int) -> tuple[bytes, int]:
    """The content of the gzip member at ``start`` and where it ends; its CRC is checked on the way."""
    z, out, at = zlib.decompressobj(31), [], start
    while not z.eof:
        part = src.need(at, READ)
        if not part:
            raise Bad("member cut short")
        try:
            out.append(z.decompress(part))
        except zlib.error as e:
            raise Bad(f"member: {e}") from None
        at += len(part)
        if out[0] and not out[0].startswith(VERSION[: len(out[0])]):
            raise Bad("no version line in member")
    return b"".join(out), at - len(z.unused_data)


def parse_head(data: bytes) -> tuple[dict, int]:
    """Headers by lower-case name, and where the block begins."""
    end = data.find(b"\r\n\r\n")
    if not re.match(rb"WARC/1\.\d\r\n", data) or end < 0:
        raise Bad("no version line or no end of headers")
    head = {}
    for line in data[:end].split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        head[k.decode("latin-1").strip().lower()] = v.decode("utf-8", "replace").strip()
    if not head.get("content-length", "").isdigit():
        raise Bad("no content length")
    return head, end + 4


def bare_head(src: Source, start: int) -> bytes:
    """Bytes from ``start`` that hold the end of the headers, or all that follow if there is none."""
    n = HEADER
    while True:
        data = src.need(start, n)
        if len(data) < n or not data.startswith(VERSION) or b"\r\n\r\n" in data:
            return data
        n *= 2


def parse(head: dict, block: bytes, tail: bytes) -> dict:
    if len(block) != int(head["content-length"]) or tail != b"\r\n\r\n":
        raise Bad("length is not as said")
    own = hex_of(head.get("warc-block-digest"))
    if own and own != hashlib.sha1(block).hexdigest():
        raise Bad("block digest differs")
    payload, size = block, len(block)
    if head.get("content-type", "").startswith("application/http"):
        cut = block.find(b"\r\n\r\n")
        said = re.search(rb"(?im)^content-length:\s*(\d+)", block[: max(0, cut)])
        payload = block[cut + 4 :] if cut >= 0 else block
        size = int(said[1]) if said else len(payload)
    digest, kind = hex_of(head.get("warc-payload-digest")), head.get("warc-type")
    if kind == "revisit":
        payload = None
    elif digest and digest != hashlib.sha1(payload).hexdigest():
        raise Bad("payload digest differs")
    else:
        size = len(payload)
        digest = digest or hashlib.sha1(payload).hexdigest()
    return {"kind": "record", "record_type": kind, "record_id": head.get("warc-record-id"), "refers_to": head.get("warc-refers-to"), "uri": head.get("warc-target-uri"), "payload_digest": digest, "payload_bytes": size, "payload": payload}


def read_one(src: Source, start: int) -> tuple[dict, int]:
    """The record that begins at ``start``, a member or a bare one, and where it ends."""
    if src.need(start, 3) == MEMBER:
        data, end = inflate(src, start)
        head, at = parse_head(data)
        n = int(head["content-length"])
        return parse(head, data[at : at + n], data[at + n :]), end
    head, at = parse_head(bare_head(src, start))
    n = int(head["content-length"])
    if start + at + n + 4 > src.size:
        raise Bad("record cut short")
    data = src.need(start, at + n + 4)
    return parse(head, data[at : at + n], data[at + n : at + n + 4]), start + at + n + 4


def candidates(src: Source, start: int, stop: int) -> Iterator[int]:
    """Places from ``start`` and before ``stop`` where a member or a version line begins."""
    at = start
    while at < stop:
        part = src.need(at, READ + len(VERSION))
        for m in re.finditer(rb"\x1f\x8b\x08|WARC/1\.", part):
            if m.start() < READ and at + m.start() < stop:
                yield at + m.start()
        at += READ


def salvage(file, size: int, start: int, stop: int) -> Iterator[dict]:
    """Records that begin in a range, and gaps: bytes that belong to no valid record.

    A gap is logged by the range that holds the last valid record before it, up to the next valid beginning,
    wherever that is; the range that holds this beginning goes on there.
    """
    src, at = Source(file, size), start
    if start:
        at = next_valid(file, size, start, stop)
        if at == stop:
            return
    while at < size:
        try:
            found, end = read_one(src, at)
        except Bad as e:
            to = next_valid(file, size, at + 1, size)
            yield {"kind": "gap", "start": at, "end": to, "problem": str(e)}
            if to >= stop:
                return
            at = to
            continue
        if at >= stop:
            return
        yield found | {"start": at, "end": end}
        at = end


def next_valid(file, size: int, start: int, stop: int) -> int:
    """The first place from ``start`` on where a valid record begins, or ``stop``."""
    for c in candidates(Source(file, size), start, stop):
        try:
            read_one(Source(file, size), c)
        except Bad:
            continue
        return c
    return stop


def read_warc(archives: DataFrame, range_bytes: int = RANGE_BYTES, with_payload: bool = True) -> DataFrame:
    """Records and gaps of archives (path, size): ``kind`` tells which; see ``SCHEMA``.

    Archives that are not compressed are read as one range each, since a payload may hold records of its own.
    """
    step = F.when(F.col("path").endswith(".gz"), F.lit(range_bytes)).otherwise(F.col("size")).cast("long")
    ranges = archives.where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, step)).alias("at"), step.alias("step"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary(), pa.string()]
        for batch in batches:
            for r in batch.to_pylist():
                fs, path = file_system(r["path"])
                rows: list[dict] = []
                held = 0
                with fs.open_input_file(path) as file:
                    for x in salvage(file, r["size"], r["at"], min(r["size"], r["at"] + r["step"])):
                        rows.append({"path": r["path"], **x, "payload": x.get("payload") if with_payload else None})
                        held += len(rows[-1]["payload"] or b"")
                        if held > 8_000_000 or len(rows) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array([y.get(f) for y in rows], t) for f, t in zip(FIELDS, types, strict=True)], FIELDS)
                            rows, held = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([y.get(f) for y in rows], t) for f, t in zip(FIELDS, types, strict=True)], FIELDS)

    # a number that is given, not left to adaptive planning: the ranges are a few bytes each, what they name is not
    return ranges.repartition(max(1, min(ranges.count(), READERS))).mapInArrow(run, SCHEMA)


def find_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Archives (path, size) of a folder, for ``read_warc``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc*").load(folder)
    return files.select("path", F.col("length").alias("size"))


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write all pages, read the archives back: per record its key, size, digest, type and the key it refers to.

    Fails if fewer or more records are read than were written.
    """
    spark = pages.sparkSession
    manifest = write_warc(with_revisits(pages), new_path(spark, "warc"))
    back = read_warc(manifest, with_payload=False).where("kind = 'record'")
    key = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    rows = back.select(key("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", key("refers_to").alias("refers_to"))
    rows = materialize(rows, "records")
    written, read = manifest.agg(F.sum("records")).first()[0] or 0, rows.count()
    if written != read:
        raise ValueError(f"{written} records written, {read} read")
    return rows
