"""WARC files with revisit records, and a salvage reader that gets past damage.

The writer makes each record a gzip member of its own and notes in its manifest where some of them start; a file is
cut into ranges there and nowhere else, so a file of another tool is one task. A member may hold many records: all of
them are read. After a failed check (gzip CRC, version line, headers, Content-Length, digests of block and payload)
the reader searches for the next valid member or, inside a member and in uncompressed files, the next version line
with a valid record, goes on from there, and reports the bytes between as a row of kind ``gap``. So every byte
belongs to a record or a gap.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from . import storage
from .common import maybe_wanted, written

#: ``offset`` and ``length`` are those of the record or gap in the file or, in a compressed one, of its gzip member;
#: ``inner`` and ``inner_length`` then tell its place in the member's content.
READ_SCHEMA = (
    "kind string, file string, offset long, length long, inner long, inner_length long, reason string, warc_type string, record_id string, "
    "refers_to string, target_uri string, payload_bytes long, payload_digest string, payload binary"
)
_TYPES = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in READ_SCHEMA.split(", ")]
_NAMES = [x.split()[0] for x in READ_SCHEMA.split(", ")]
_NO_RECORD = [None] * 7
#: Headers and records above these lengths are gaps; members with longer content than ``WHOLE`` are read twice.
MOST_HEADERS, MOST_RECORD, WHOLE = 16 << 20, 1 << 30, 32 << 20
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [b"WARC/1.1"] + [f"{k}: {v}".encode() for k, v in headers] + [b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Damaged(ValueError):
    pass


def parse(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers (lower-case names), block and whole length of the record at the start of ``data``."""
    if not data.startswith((b"WARC/1.0\r\n", b"WARC/1.1\r\n")):
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise Damaged("headers do not end")
    headers = {}
    for line in data[10:end].split(b"\r\n"):
        k, colon, v = line.partition(b":")
        if not colon:
            raise Damaged("bad header line")
        headers[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    if not {"warc-type", "warc-record-id"} <= headers.keys() or not headers.get("content-length", "").isdigit():
        raise Damaged("required header missing")
    n = int(headers["content-length"])
    block = data[end + 4 : end + 4 + n]
    if len(block) < n or data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
        raise Damaged("block does not end where Content-Length says")
    return headers, block, end + 8 + n


def _row(headers: dict[str, str], block: bytes, file: str, offset: int, length: int, inner: int | None, inner_length: int | None) -> tuple:
    kind, digest, payload, size = headers["warc-type"], headers.get("warc-payload-digest"), None, None
    whole = headers.get("warc-block-digest")
    if whole and whole.lower().startswith("sha1:") and whole[5:].upper() != base32_sha1(block):
        raise Damaged("block digest differs")
    if kind in ("response", "resource"):
        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else block
        found, size = base32_sha1(payload), len(payload)
        if digest and digest.lower() != f"sha1:{found}".lower():
            raise Damaged("payload digest differs")
        digest = found
    elif digest:
        digest = digest.partition(":")[2]
        size = int(headers["x-payload-length"]) if headers.get("x-payload-length", "").isdigit() else None
    return ("record", file, offset, length, inner, inner_length, None, kind, headers["warc-record-id"], headers.get("warc-refers-to"), headers.get("warc-target-uri"), size, digest, payload)


class _Source:
    """The bytes of a file's range or of a gzip member's content, read forward; what was taken is let go.

    ``read`` gives the next bytes and b"" at the end; ``size`` is the number of all of them. A failed check ends the
    source early and stands in ``error``.
    """

    def __init__(self, read: Callable[[], bytes], size: int | None = None):
        self.read, self.size, self.held, self.at, self.error, self.done = read, size, bytearray(), 0, None, False

    def need(self, n: int) -> bool:
        """Whether the next ``n`` bytes are there; they are held then. Nothing is read if they cannot be."""
        if self.size is not None and n > self.size - self.at:
            return False
        while len(self.held) < n and not self.done:
            try:
                more = self.read()
            except Damaged as e:
                self.error, more = str(e), b""
            self.held += more
            self.done = not more
        return len(self.held) >= n

    def find(self, what: bytes, most: int) -> int:
        start = 0
        while (i := self.held.find(what, start)) < 0:
            start = max(0, len(self.held) - len(what) + 1)
            if start > most or not self.need(len(self.held) + 1):
                return -1
        return i

    def drop(self, n: int) -> None:
        while n > len(self.held):
            n -= len(self.held)
            self.at += len(self.held)
            self.held.clear()
            if not self.need(1):
                return
        del self.held[:n]
        self.at += n

    def seek(self, what: bytes) -> bool:
        """Drops what stands before the next place of ``what``, or everything if there is none."""
        while (i := self.held.find(what)) < 0:
            self.drop(max(0, len(self.held) - len(what) + 1))
            if not self.need(len(self.held) + 1):
                self.drop(len(self.held))
                return False
        self.drop(i)
        return True


def _record_length(source: _Source) -> int | None:
    """The length of the record at the start of a source by its headers; None if they are bad or above ``MOST_HEADERS``."""
    if not source.need(10) or not source.held.startswith((b"WARC/1.0\r\n", b"WARC/1.1\r\n")):
        return None
    end = source.find(b"\r\n\r\n", MOST_HEADERS)
    if end < 0:
        return None
    for line in bytes(source.held[10:end]).split(b"\r\n"):
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            return end + 8 + int(value)
    return None


def _whole(source: _Source) -> tuple[dict[str, str], bytes, int] | str:
    """The record at the start of a source, or why there is none."""
    size = _record_length(source)
    if size is not None and size > MOST_RECORD:
        return f"record of {size} bytes does not fit into a row"
    if size is not None and not source.need(size):
        return "block does not end where Content-Length says"
    try:
        return parse(bytes(source.held[: size or MOST_HEADERS]))
    except Damaged as e:
        return str(e)


def _records(source: _Source, file: str, offset: int, member: int | None, digests: bool = False) -> Iterator[tuple]:
    """Rows of the records and gaps in a source, one after the other, until it is used up.

    A record that fails its checks is a gap up to where its headers say that it ends, if a record or the end is there;
    else up to the next version line with a whole record. So a record that stands in the payload of a damaged one is
    not taken for one of the archive's own. ``member`` is the length of the gzip member, None in a plain file. With
    ``digests`` only records with a block digest are taken.
    """

    def place(at: int, n: int) -> tuple:
        return (offset + at, n, None, None) if member is None else (offset, member, at, n)

    def taken() -> tuple | str:
        found = _whole(source)
        if isinstance(found, str):
            return found
        headers, block, used = found
        if digests and not headers.get("warc-block-digest", "").lower().startswith("sha1:"):
            return "the member fails its check and the record has no digest"
        try:
            row = _row(headers, block, file, *place(source.at, used))
        except Damaged as e:
            return str(e)
        source.drop(used)
        return row

    def record_follows(n: int) -> bool:
        if n > MOST_RECORD:
            return source.size is not None and n <= source.size - source.at
        return source.need(n) and (not source.need(n + 1) or source.need(n + 7) and source.held[n : n + 7] == b"WARC/1.")

    while source.need(1):
        row = taken()
        if not isinstance(row, str):
            yield row
            continue
        start, size = source.at, _record_length(source)
        if size is not None and record_follows(size):
            source.drop(size)
        else:
            source.drop(1)
            while source.seek(b"WARC/1.") and isinstance(_whole(source), str):
                source.drop(1)
        yield ("gap", file, *place(start, source.at - start), row, *_NO_RECORD)


def _deflated(f: storage.Window, pos: int) -> int:
    """Where the deflated bytes of the gzip member at ``pos`` begin, after its header's optional fields."""
    head, at = f.get(pos, min(10, f.size - pos)), pos + 10
    if len(head) < 10 or head[:3] != b"\x1f\x8b\x08":
        return f.size
    flags = head[3]
    if flags & 4:
        at += 2 + int.from_bytes(f.get(at, 2), "little")
    for _ in range(bool(flags & 8) + bool(flags & 16)):
        at = 1 + max(f.find(b"\0", at), at)
    return at + 2 * bool(flags & 2)


def _inflate(f: storage.Window, pos: int, end: int, checked: bool = True) -> Callable[[], bytes]:
    """Reads the content of the gzip member at ``pos`` piece by piece; ``read.length`` is set once it has ended well.

    If not ``checked``, what can be unpacked comes out in small pieces, whatever the member's own sum says.
    """
    z, at, rest = zlib.decompressobj(31 if checked else -15), pos if checked else _deflated(f, pos), b""
    step = 1 << 16 if checked else 256

    def read() -> bytes:
        nonlocal at, rest
        while not z.eof:
            chunk, rest = rest or f.get(at, max(0, min(step, end - at))), b""
            if not chunk:
                raise Damaged("file ends inside a member")
            try:
                out = z.decompress(chunk, 1 << 20)
            except zlib.error as e:
                raise Damaged(str(e)) from None
            rest = z.unconsumed_tail
            at += len(chunk) - len(rest) - len(z.unused_data)
            if z.eof:
                read.length = at - pos
            if out:
                return out
        return b""

    read.length = None
    return read


def _member(f: storage.Window, file: str, pos: int, end: int) -> tuple[Iterator[tuple], int | None, str | None]:
    """Rows of the gzip member at ``pos``, its length (None if it is damaged) and what is wrong with it."""
    source = _Source(_inflate(f, pos, end))
    source.need(WHOLE)
    if not source.error and not source.held.startswith(b"WARC/1."):
        return iter(()), None, "member holds no WARC record"
    if source.done and not source.error:
        source.size = len(source.held)
        return _records(source, file, pos, source.read.length), source.read.length, None
    check, size, error = _inflate(f, pos, end), 0, source.error  # a long member is read to its end, and again for its records
    try:
        while not error and (piece := check()):
            size += len(piece)
    except Damaged as e:
        error = str(e)
    if error:
        return _records(_Source(_inflate(f, pos, end, False)), file, pos, None, True), None, error
    return _records(_Source(_inflate(f, pos, end), size), file, pos, check.length), check.length, None


def scan(f: storage.Window, file: str, start: int, end: int, compressed: bool) -> Iterator[tuple]:
    """Rows of the records and gaps in ``[start, end)``, a range that begins and ends where records (or the file) do.

    Nothing outside the range is looked at, so what is found does not depend on how a file was cut. Of a gzip member
    that fails its check, the records whose block digests agree are taken; one gap then covers the member's bytes, up
    to the next member that starts with a whole record.
    """
    if not compressed:
        at = start

        def read() -> bytes:
            nonlocal at
            chunk = f.get(at, max(0, min(1 << 20, end - at)))
            at += len(chunk)
            return chunk

        yield from _records(_Source(read, end - start), file, start, None)
        return
    pos = start
    while pos < end:
        rows, length, error = _member(f, file, pos, end)
        if error is None:
            yield from rows
            pos += length
            continue
        found = pos + 1
        while (found := f.find(b"\x1f\x8b\x08", found, end)) >= 0 and isinstance(_whole(_Source(_inflate(f, found, end))), str):
            found += 1
        found = end if found < 0 else found
        for row in rows:
            if row[0] == "record":
                yield ("record", file, pos, found - pos, row[2] - pos, row[3], *row[6:])
        yield ("gap", file, pos, found - pos, None, None, error, *_NO_RECORD)
        pos = found


@dataclass
class _Range(InputPartition):
    path: str
    start: int
    end: int

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


@dataclass
class _Written(WriterCommitMessage):
    files: list


class _WarcReader(DataSourceReader):
    def __init__(self, options):
        self.base = options["path"]
        self.range_bytes = int(options.get("rangeBytes", 16 << 20))
        self.batch_bytes = int(options.get("batchBytes", 8 << 20))

    def partitions(self):
        files = storage.archive_files(self.base, (".warc", ".warc.gz"))
        return [_Range(*x) for x in storage.known_ranges(files, self.range_bytes)] or [_Range("", 0, 0)]

    def read(self, partition):
        if not partition.path:
            return
        fs, _ = storage.filesystem(self.base)
        rows, held = [], 0
        size = fs.get_file_info(partition.path).size
        f = storage.Window(lambda: fs.open_input_file(partition.path), size)
        for row in scan(f, partition.path, partition.start, min(partition.end, size), partition.path.endswith(".gz")):
            rows.append(row)
            held += len(row[-1] or b"") + 300
            if held >= self.batch_bytes:
                yield self.batch(rows)
                rows, held = [], 0
        f.close()
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)


class _WarcWriter(DataSourceArrowWriter):
    """Takes rows (record_id, target_uri, payload, payload_bytes, payload_sha1 as hex, refers_to)."""

    def __init__(self, options, overwrite: bool):
        self.base, self.overwrite = options["path"], overwrite
        self.file_bytes, self.step = int(options.get("fileBytes", 256 << 20)), int(options.get("startEvery", 4 << 20))

    def write(self, iterator: Iterator[pa.RecordBatch]):
        fs, root = storage.filesystem(self.base)
        fs.create_dir(root, recursive=True)
        stem, files, out = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}", [], None

        def close():
            files.append({"name": name, "size": out.tell(), "starts": starts})
            out.close()

        name, starts = "", []
        for batch in iterator:
            for x in batch.to_pylist():
                if out is None:
                    starts = []
                    name = f"{stem}-{len(files):04d}.warc.gz"
                    out = fs.open_output_stream(storage.join(root, name), compression=None)
                digest = base64.b32encode(bytes.fromhex(x["payload_sha1"])).decode()
                uri = (x["target_uri"] or "").replace("\r", "%0D").replace("\n", "%0A")
                headers = [("WARC-Type", "revisit" if x["refers_to"] else "response"), ("WARC-Record-ID", x["record_id"]),
                           ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest}")]
                block = b"" if x["refers_to"] else HTTP_HEAD % x["payload_bytes"] + (x["payload"] or b"")
                headers.append(("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"))
                if uri:
                    headers.append(("WARC-Target-URI", uri))
                if x["refers_to"]:
                    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                                ("WARC-Refers-To", x["refers_to"]), ("X-Payload-Length", str(x["payload_bytes"]))]
                if out.tell() >= (starts[-1] if starts else 0) + self.step:
                    starts.append(out.tell())
                out.write(member(record(headers, block)))
                if out.tell() >= self.file_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        return _Written(files)

    def commit(self, messages):
        storage.write_manifest(self.base, [f for m in messages if m for f in m.files], self.overwrite)

    def abort(self, messages):
        fs, root = storage.filesystem(self.base)
        for f in [f for m in messages if m for f in m.files]:
            fs.delete_file(storage.join(root, f["name"]))


class Warc(DataSource):
    """``format("warc")``."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return READ_SCHEMA

    def reader(self, schema):
        return _WarcReader(self.options)

    def writer(self, schema, overwrite):
        return _WarcWriter(self.options, overwrite)


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def page_of(record_id: Column) -> Column:
    return F.regexp_extract(record_id, "^<urn:x-page:(.*)>$", 1).try_cast("bigint")


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Writes one record for each row of ``pages`` (page_id, url, html).

    Of rows with equal payloads of at least ``min_bytes`` bytes, those with the smallest page_id are
    response records, all others revisit records without a block that refer to it. A null html is an
    empty payload; a null page_id is larger than any other, and rows that share the smallest page_id
    and the payload are all responses. The smallest page_id of a payload comes from partial minima.
    Payloads that many rows have get it back by a broadcast; rows whose payload a bitmap tells to be their own are
    written where they are read; only the others, copies of a few, are shuffled. Other columns play no part.
    """
    pages.sparkSession.dataSource.register(Warc)
    rows = pages.select(
        "page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")
    ).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_sha1": F.sha1("payload")})
    sums = ["payload_sha1", "payload_bytes"]
    first = written(
        rows.where(F.col("payload_bytes") >= min_bytes).groupBy(*sums).agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1"), "first")
    hot = F.col("n") > max(1000, (first.agg(F.sum("n")).first()[0] or 0) // 100_000)  # at most 100,000 payloads
    rest = first.where(~hot).drop("n")
    known = rows.join(F.broadcast(first.where(hot).drop("n")), sums, "left")
    keys = written(rest.select(F.xxhash64(*sums).alias("key")), "keys")
    marked = maybe_wanted(known, F.xxhash64(*sums), keys, "maybe").withColumn("maybe", F.col("maybe") & F.col("first_id").isNull())
    found = marked.where(~F.col("maybe")).drop("maybe").unionByName(marked.where("maybe").drop("maybe", "first_id").join(rest, sums, "left"), allowMissingColumns=True)
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    (
        found
        .select(
            _urn(F.col("page_id")).alias("record_id"), F.col("url").alias("target_uri"),
            F.when(~again, F.col("payload")).alias("payload"), "payload_bytes", "payload_sha1",
            F.when(again, _urn(F.col("first_id"))).alias("refers_to"),
        )
        .write.format("warc").mode("append").save(path)
    )


def read_warc(spark: SparkSession, path: str, **options) -> DataFrame:
    """Rows of kind ``record`` and ``gap``; see ``READ_SCHEMA``. Reads .warc and .warc.gz files of a folder."""
    spark.dataSource.register(Warc)
    return spark.read.format("warc").options(**options).load(path)
