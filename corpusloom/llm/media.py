"""Media columns: payloads kept as images in archive directories, read by a custom Spark data source.

An archive is a ZIP file of PNG images (grey, 8 bits a sample, 64 samples a row). Planning lists
files only and cuts them into byte ranges. The task of a range reads the archive's central
directory, takes the members whose header starts inside the range and streams their payloads as
Arrow batches of bounded size. The archive is opened once a range and read ahead; each member is
checked by its own offset, and a retry opens the archive anew.
"""

from __future__ import annotations

import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from hashlib import sha256
from urllib.parse import quote
from dataclasses import dataclass

import numpy as np
import pandas as pd
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
from .common import free_name, quoted, vectorized

WIDTH = 64
PNG_HEAD = b"\x89PNG\r\n\x1a\n"
READ_SCHEMA = "archive string, offset long, member string, media binary, error string"


def padded(data: bytes) -> bytes:
    """Appends bytes 0 up to a positive multiple of 64."""
    return data + bytes(max(WIDTH, -(-len(data) // WIDTH) * WIDTH) - len(data))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(data: bytes, level: int = 6) -> bytes:
    """A grey PNG that holds the padded bytes as samples and the unpadded length as a text chunk."""
    rows = np.frombuffer(padded(data), np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # filter 0 before each row
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return (
        PNG_HEAD + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"Length\0%d" % len(data))
        + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")
    )


def decode_png(png: bytes) -> tuple[int, bytes]:
    """Unpadded length and padded samples of a PNG as ``encode_png`` writes it; raises ValueError else."""
    if png[:8] != PNG_HEAD:
        raise ValueError("no PNG")
    at, length, shape, parts = 8, None, None, []
    while at + 12 <= len(png):
        (n,) = struct.unpack_from(">I", png, at)
        kind, data = png[at + 4 : at + 8], png[at + 8 : at + 8 + n]
        if at + n + 12 > len(png) or zlib.crc32(kind + data) != struct.unpack_from(">I", png, at + 8 + n)[0]:
            raise ValueError(f"bad checksum of chunk {kind!r}")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", data)
        elif kind == b"tEXt" and data.startswith(b"Length\0"):
            length = int(data[7:])
        elif kind == b"IDAT":
            parts.append(data)
        at += n + 12
    if shape is None or shape[0] != WIDTH or shape[2:4] != (8, 0):
        raise ValueError("not a grey 8-bit image of 64 samples a row")
    data = zlib.decompress(b"".join(parts))
    if not shape[1] or len(data) != shape[1] * (WIDTH + 1):
        raise ValueError("another number of samples than the header says")
    lines = np.frombuffer(data, np.uint8).reshape(shape[1], WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    samples = lines[:, 1:].tobytes()
    return len(samples) if length is None else length, samples


def feature(samples: bytes) -> str:
    """Entropy in bits, mean, deviation and a 64-bit hash of the columns brighter than the image's mean."""
    a = np.frombuffer(samples, np.uint8)
    p = np.bincount(a, minlength=256) / len(a)
    entropy = -float((p[p > 0] * np.log2(p[p > 0])).sum())
    columns = a.reshape(-1, WIDTH).mean(axis=0)
    bits = sum(1 << i for i, x in enumerate(columns > a.mean()) if x)
    return f"entropy={abs(entropy):.4f};mean={a.mean():.3f};std={a.std():.3f};columns={bits:016x}"


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


class _MediaReader(DataSourceReader):
    def __init__(self, options):
        self.base = options["path"]
        self.range_bytes = int(options.get("rangeBytes", 64 << 20))
        self.batch_bytes = int(options.get("batchBytes", 8 << 20))
        self.batch_rows = int(options.get("batchRows", 2000))
        self.retries = int(options.get("retries", 3))

    def partitions(self):
        return [_Range(*x) for x in storage.byte_ranges(storage.archive_files(self.base, (".zip",)), self.range_bytes)] or [_Range("", 0, 0)]

    def member(self, f: storage.Window, info: zipfile.ZipInfo) -> tuple[bytes | None, str | None]:
        """One member by its offset, checked by its CRC; after ``retries`` failures its error."""
        error = None
        for attempt in range(self.retries):
            try:
                head = f.get(info.header_offset, 30)
                if len(head) < 30 or head[:4] != b"PK\3\4":
                    raise ValueError("no member header")
                raw = f.get(info.header_offset + 30 + sum(struct.unpack_from("<HH", head, 26)), info.compress_size)
                if info.flag_bits & 1 or info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                    return None, "ValueError: encrypted, or packed in another way than stored or deflated"
                data = zlib.decompress(raw, -15) if info.compress_type == zipfile.ZIP_DEFLATED else raw
                if len(data) != info.file_size or zlib.crc32(data) != info.CRC:
                    raise ValueError("bad checksum")
                return data, None
            except (OSError, ValueError, struct.error, zlib.error) as e:
                error = f"{type(e).__name__}: {e}"
                f.close()
                time.sleep(0.05 * attempt)
        return None, error

    def read(self, partition):
        if not partition.path:
            return
        fs, _ = storage.filesystem(self.base)
        names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
        types = [pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]
        for attempt in range(self.retries):
            try:
                with fs.open_input_file(partition.path) as f, zipfile.ZipFile(f) as z:
                    infos = sorted((i for i in z.infolist() if partition.start <= i.header_offset < partition.end and not i.is_dir()), key=lambda i: i.header_offset)
                    size = f.size()
                break
            except (zipfile.BadZipFile, OSError, ValueError, struct.error) as e:
                error = f"{type(e).__name__}: {e}"
                time.sleep(0.05 * attempt)
        else:
            if partition.start == 0:
                yield _batch([(partition.path, None, None, None, error)], names, types)
            return
        window = storage.Window(lambda: fs.open_input_file(partition.path), size)
        rows, held = [], 0
        for info in infos:
            data, error = self.member(window, info)
            rows.append((partition.path, info.header_offset, info.filename, data, error))
            held += len(data or b"")
            if held >= self.batch_bytes or len(rows) >= self.batch_rows:
                yield _batch(rows, names, types)
                rows, held = [], 0
        if rows:
            yield _batch(rows, names, types)
        window.close()


def _batch(rows, names, types) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def stored_name(name: str, most: int = 60_000) -> str:
    """A member's name as it stands in the archive: percent-encoded, but for letters, digits and ``_.-~``; what is longer
    than a ZIP name may be is cut and ends in the SHA-256 of the whole."""
    safe = quote(name, safe="", errors="replace")
    return safe if len(safe) <= most else f"{safe[:most]}~{sha256(name.encode('utf-8', 'replace')).hexdigest()}"


class _MediaWriter(DataSourceArrowWriter):
    """Takes rows ``(member string, payload binary)``; each task writes archives of its own, listed at commit."""

    def __init__(self, options, overwrite: bool):
        self.base, self.overwrite = options["path"], overwrite
        self.archive_bytes = int(options.get("archiveBytes", 128 << 20))
        self.archive_members = int(options.get("archiveMembers", 50_000))

    def write(self, iterator: Iterator[pa.RecordBatch]):
        fs, root = storage.filesystem(self.base)
        fs.create_dir(root, recursive=True)
        task, files, z, out, n = TaskContext.get(), [], None, None, 0
        stem = f"part-{task.partitionId():05d}-{uuid.uuid4().hex}"

        def close():
            z.close()
            size = out.tell()
            out.close()
            files.append({"name": name, "size": size, "members": n})

        name = ""
        for batch in iterator:
            for member, payload in zip(batch.column(0), batch.column(1)):
                if z is None:
                    name, n = f"{stem}-{len(files):04d}.zip", 0
                    out = fs.open_output_stream(storage.join(root, name))
                    z = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                z.writestr(f"{n:07d}-{stored_name(member.as_py())}.png", encode_png(payload.as_py() or b""))
                n += 1
                if n >= self.archive_members or out.tell() >= self.archive_bytes:
                    close()
                    z = None
        if z is not None:
            close()
        return _Written(files)

    def commit(self, messages):
        storage.write_manifest(self.base, [f for m in messages if m for f in m.files], self.overwrite)

    def abort(self, messages):
        fs, root = storage.filesystem(self.base)
        for f in [f for m in messages if m for f in m.files]:
            fs.delete_file(storage.join(root, f["name"]))


class MediaArchive(DataSource):
    """``format("media_archive")``: writes (member, payload) and reads (archive, offset, member, media, error)."""

    @classmethod
    def name(cls):
        return "media_archive"

    def schema(self):
        return READ_SCHEMA

    def reader(self, schema):
        return _MediaReader(self.options)

    def writer(self, schema, overwrite):
        return _MediaWriter(self.options, overwrite)


def write_media(rows: DataFrame, member: Column, payload: Column, path: str) -> None:
    """Writes one PNG member a row; a second call adds to the folder.

    A null payload is stored as an empty one, a null name as ``null``. Equal names (ties, repeated rows) are kept apart
    by a number before the name; slashes, blanks and long names are written as ``stored_name`` says. Other columns of
    ``rows`` play no part, so none can clash.
    """
    rows.sparkSession.dataSource.register(MediaArchive)
    rows.select(
        F.coalesce(member.cast("string"), F.lit("null")).alias("member"), payload.cast("binary").alias("payload")
    ).write.format("media_archive").mode("append").save(path)


def read_media(spark: SparkSession, path: str, **options) -> DataFrame:
    """One row a member: (archive, offset, member, media, error), whatever other tool wrote the archive. A member that
    stays unreadable has a null media and its error; an archive without a readable directory is one such row without an
    offset. An empty folder gives no rows."""
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(**options).load(path)


_FEATURES = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


@vectorized(_FEATURES + ", problem string")
def _features(media: pd.Series) -> pd.DataFrame:
    rows = []
    for png in media:
        if png is None:
            rows.append((None,) * 8)
            continue
        try:
            length, samples = decode_png(png)
            found = (length, len(samples), sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(png), sha256(png).hexdigest(), feature(samples), None)
        except (ValueError, struct.error, zlib.error) as e:
            found = (*[None] * 4, len(png), sha256(png).hexdigest(), None, f"{type(e).__name__}: {e}")
        rows.append(found)
    return pd.DataFrame(rows, columns=[x.split()[0] for x in _FEATURES.split(", ")] + ["problem"]).astype(
        {c: "Int64" for c in ("n_bytes", "payload_bytes", "tail_crc32", "media_bytes")})


def media_features(rows: DataFrame) -> DataFrame:
    """``rows`` as ``read_media`` returns them, with the decoded payload's digests and features in place of ``media``.

    Where the media is null they are null. Bytes that are no PNG of the writer's kind have the length and the digest of
    the stored form only and tell in ``error`` why. Equal media have equal features.
    """
    f = free_name(rows, "f")
    keep = [F.coalesce("error", F.col(f)["problem"]).alias("error") if c == "error" else F.col(quoted(c)) for c in rows.columns if c != "media"]
    return rows.withColumn(f, _features("media")).select(*keep, *[F.col(f)[x.split()[0]].alias(x.split()[0]) for x in _FEATURES.split(", ")])
