"""Files of the archive sources, by way of pyarrow's file systems (local, HDFS, S3, GCS by URI)."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import pyarrow.fs as pafs

#: Every commit writes one manifest of its own with this prefix, so that a second append adds to the first.
MANIFEST = "_members-"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def join(base: str, name: str) -> str:
    return f"{base.rstrip('/')}/{name}"


def _manifests(fs: pafs.FileSystem, root: str) -> list[str]:
    found = fs.get_file_info(pafs.FileSelector(root, recursive=False, allow_not_found=True))
    return sorted(f.path for f in found if f.is_file and f.base_name.startswith(MANIFEST) and f.base_name.endswith(".json"))


def _listed(fs: pafs.FileSystem, manifest: str) -> list[dict]:
    with fs.open_input_stream(manifest) as f:
        return json.loads(f.read())


def write_manifest(base: str, files: list[dict], overwrite: bool = False) -> None:
    """Lists the files of the tasks that committed; files that a lost attempt left behind are in no manifest.

    With ``overwrite`` the manifests of earlier commits go, and the files that they list.
    """
    fs, root = filesystem(base)
    fs.create_dir(root, recursive=True)
    before = _manifests(fs, root) if overwrite else []
    with fs.open_output_stream(join(root, f"{MANIFEST}{uuid.uuid4().hex}.json")) as out:
        out.write(json.dumps(sorted(files, key=lambda f: f["name"])).encode())
    for manifest in before:
        gone = [x["name"] for x in _listed(fs, manifest)]
        fs.delete_file(manifest)
        for name in gone:
            if fs.get_file_info(join(root, name)).type == pafs.FileType.File:
                fs.delete_file(join(root, name))


def archive_files(base: str, suffixes: tuple[str, ...]) -> list[dict]:
    """``path``, ``size`` and what else the manifests say of each file; a folder that another tool wrote is listed."""
    fs, root = filesystem(base)
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.File:
        return [{"path": root, "size": info.size}]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(base)
    if manifests := _manifests(fs, root):
        return [x | {"path": join(root, x["name"])} for m in manifests for x in _listed(fs, m)]
    found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
    return sorted(({"path": f.path, "size": f.size} for f in found if f.is_file and f.path.endswith(suffixes)), key=lambda x: x["path"])


def byte_ranges(files: list[dict], target: int) -> list[tuple[str, int, int]]:
    """Cuts every file into ranges of about ``target`` bytes; the plan grows with files, not with members."""
    out = []
    for f in files:
        size, n = f["size"], max(1, -(-f["size"] // target))
        cuts = [size * i // n for i in range(n)] + [max(size, 1)]
        out += [(f["path"], a, b) for a, b in zip(cuts, cuts[1:]) if b > a]
    return out


def known_ranges(files: list[dict], target: int) -> list[tuple[str, int, int]]:
    """Like ``byte_ranges``, but cut only where the manifest says that a record starts; other files are one range each."""
    out = []
    for f in files:
        cuts = [0]
        for start in f.get("starts", ()):
            if start - cuts[-1] >= target:
                cuts.append(start)
        out += [(f["path"], a, b) for a, b in zip(cuts, [*cuts[1:], max(f["size"], 1)])]
    return out


class Window:
    """Byte windows of a file that is opened once; only the part in use is held, and reads go ahead by ``step``."""

    def __init__(self, open_file: Callable[[], object], size: int, step: int = 1 << 20):
        self.open_file, self.size, self.step, self.at, self.buf, self.f = open_file, size, step, 0, b"", None

    def get(self, pos: int, n: int) -> bytes:
        if not (self.at <= pos and pos + n <= self.at + len(self.buf)):
            if self.f is None:
                self.f = self.open_file()
            self.f.seek(pos)
            self.at, self.buf = pos, self.f.read(max(0, min(max(n, self.step), self.size - pos)))
        return self.buf[pos - self.at : pos - self.at + n]

    def find(self, what: bytes, pos: int, end: int | None = None) -> int:
        """The first place from ``pos`` on, before ``end``, where ``what`` stands whole; -1 if none."""
        end = self.size if end is None else min(end, self.size)
        while pos < end:
            chunk = self.get(pos, min(self.step, end - pos))
            i = chunk.find(what)
            if i >= 0:
                return pos + i
            if pos + len(chunk) >= end or not chunk:
                return -1
            pos += max(1, len(chunk) - len(what) + 1)
        return -1

    def close(self) -> None:
        """Forgets the handle and what was read; the next ``get`` opens the file anew."""
        if self.f is not None:
            self.f.close()
        self.f, self.buf = None, b""
