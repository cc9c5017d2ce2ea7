"""Archives as a Python data source: members as rows, new archives as a stream, and bundles that are published as a whole.

    spark.dataSource.register(ArchiveSource)
    spark.read.format("archives").load(path)          # path, archive, member, kind, size, sha256, content
    spark.readStream.format("archives").load(path)    # archives that came since, by time and name
    df.write.format("archives").mode("append").option("version", "7").save(path)   # rows (member, content)

A read plans one task for about PART bytes of an archive's members; filters on the
archive's or member's name, kind and size leave members out before any is opened. A
write's task fills an archive in a staging folder, under the name of its attempt; the
commit moves the archives of the successful attempts and then writes the manifest,
without which readers do not see the version. So a lost attempt, or a failed job, leaves
nothing published. Paths are those of pyarrow's file systems (local, hdfs, s3, ...),
since planning and tasks run without a session.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith, WriterCommitMessage,
)

#: Bytes of members in a task, and of the largest member that is read.
PART, MAX_MEMBER = 32 << 20, 100 << 20
SCHEMA = "archive string, member string, kind string, size bigint, sha256 string, content binary, error string"
MANIFEST, STAGING = "manifest.json", "_staging"


def file_system(path: str):
    """(file system, path in it) of an address or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[int, str]]:
    """(time in nanoseconds, name) of the archives below a path, the oldest first; those of versions without a manifest are left out."""
    from pyarrow import fs

    system, base = file_system(path)
    found = system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)) if system.get_file_info(base).type == fs.FileType.Directory else [system.get_file_info(base)]
    files = [f for f in found if f.type == fs.FileType.File]
    published = {f.path.rpartition("/")[0] for f in files if f.path.endswith(f"/{MANIFEST}")}
    out = []
    for f in files:
        folder = f.path.rpartition("/")[0]
        if f.path.lower().endswith((".zip", ".epub", ".docx", ".pptx", ".xlsx")) and f"/{STAGING}/" not in f.path and ("/version=" not in f.path or folder in published):
            out.append((f.mtime_ns or 0, f.path))
    return sorted(out)


class Seekable(io.RawIOBase):
    """A file of a pyarrow file system as zipfile wants it."""

    def __init__(self, file):
        self.file = file

    def readable(self):
        return True

    def seekable(self):
        return True

    def read(self, n=-1):
        return self.file.read(None if n is None or n < 0 else n)

    def seek(self, offset, whence=0):
        return self.file.seek(offset, whence)

    def tell(self):
        return self.file.tell()


def kind_of(name: str) -> str:
    return name.rpartition("/")[2].rpartition(".")[2].lower() if "." in name.rpartition("/")[2] else ""


@dataclass
class Members(InputPartition):
    """Some members of an archive: their names; None for an archive that cannot be read, with the reason."""

    path: str
    archive: str
    names: list[str] | None
    error: str | None = None

    def __post_init__(self):
        self.value = (self.path, self.archive)


_TESTS = {
    EqualTo: lambda v, x: v == x, In: lambda v, x: v in x, GreaterThan: lambda v, x: v > x, GreaterThanOrEqual: lambda v, x: v >= x, LessThan: lambda v, x: v < x, LessThanOrEqual: lambda v, x: v <= x,
    StringStartsWith: lambda v, x: v.startswith(x), StringEndsWith: lambda v, x: v.endswith(x),
}


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.limit = int(options.get("maxMember", MAX_MEMBER))
        self.part = int(options.get("partBytes", PART))
        self.tests: list[tuple[str, object, object]] = []

    def pushFilters(self, filters: list[Filter]):
        """Tests of names, kind and size are made here, before anything is read; Spark makes the others."""
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in ("archive", "member", "kind", "size"):
                self.tests.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def wanted(self, archive: str, info: zipfile.ZipInfo | None) -> bool:
        known = {"archive": archive} | ({} if info is None else {"member": info.filename, "kind": kind_of(info.filename), "size": info.file_size})
        return all(c in known and _TESTS[t](known[c], v) for c, t, v in self.tests)

    def plan(self, archives: list[str]) -> list[Members]:
        system, base = file_system(self.path)
        out = []
        for archive in archives:
            try:
                with system.open_input_file(archive) as f:
                    infos = [i for i in zipfile.ZipFile(Seekable(f)).infolist() if not i.is_dir() and self.wanted(archive, i)]
            except (zipfile.BadZipFile, OSError, ValueError) as e:
                if self.wanted(archive, None):
                    out.append(Members(self.path, archive, None, f"no archive: {type(e).__name__}"))
                continue
            held, size = [], 0
            for i in infos:
                if held and size + i.file_size > self.part:
                    out.append(Members(self.path, archive, held))
                    held, size = [], 0
                held.append(i.filename)
                size += i.file_size
            if held:
                out.append(Members(self.path, archive, held))
        return out

    def partitions(self) -> list[Members]:
        return self.plan([name for _, name in listed(self.path)])

    def read(self, partition: Members | None) -> Iterator[tuple]:
        if partition is None:  # there are none
            return
        if partition.names is None:
            yield partition.archive, None, None, None, None, None, partition.error
            return
        system, _ = file_system(partition.path)
        with system.open_input_file(partition.archive) as f, zipfile.ZipFile(Seekable(f)) as z:
            for name in partition.names:
                info = z.getinfo(name)
                row = partition.archive, name, kind_of(name), info.file_size
                if info.file_size > self.limit:
                    yield *row, None, None, "too large"
                    continue
                try:
                    content = z.read(info)
                except Exception as e:  # one member's damage is its own result
                    yield *row, None, None, f"damaged: {type(e).__name__}"
                    continue
                yield *row, hashlib.sha256(content).hexdigest(), content, None


class ArchiveStream(DataSourceStreamReader, ArchiveReader):
    """New archives in the order of (time, name); an offset is the last one that was read."""

    def __init__(self, options: dict):
        ArchiveReader.__init__(self, options)

    def initialOffset(self) -> dict:
        return {"time": -1, "name": ""}

    def latestOffset(self) -> dict:
        found = listed(self.path)
        return {"time": found[-1][0], "name": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Members]:
        low, high = (start["time"], start["name"]), (end["time"], end["name"])
        return self.plan([name for time, name in listed(self.path) if low < (time, name) <= high])

    def read(self, partition: Members | None) -> Iterator[tuple]:
        return ArchiveReader.read(self, partition)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    members: list[dict]


class BundleWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.version = options.get("version") or uuid.uuid4().hex
        self.job = uuid.uuid4().hex
        if not self.version.replace("-", "").replace(".", "").isalnum():
            raise ValueError("a version is letters, digits, dots and hyphens")
        system, base = file_system(self.path)
        if self._exists(system, f"{base}/version={self.version}/{MANIFEST}"):
            raise FileExistsError(f"version {self.version} is published already")

    @staticmethod
    def _exists(system, path: str) -> bool:
        from pyarrow import fs

        return system.get_file_info(path).type != fs.FileType.NotFound

    def write(self, iterator: Iterator) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.zip"
        system, base = file_system(self.path)
        folder = f"{base}/{STAGING}/{self.job}"
        system.create_dir(folder, recursive=True)
        members = []
        with system.open_output_stream(f"{folder}/{name}") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
            for row in iterator:
                content = bytes(row["content"]) if row["content"] is not None else b""
                z.writestr(zipfile.ZipInfo(row["member"]), content, zipfile.ZIP_DEFLATED)
                members.append({"archive": name, "member": row["member"], "bytes": len(content), "sha256": hashlib.sha256(content).hexdigest()})
        return Written(name if members else None, members)

    def commit(self, messages: list[Written | None]) -> None:
        """Move the archives of the successful attempts, then publish them by the manifest; what else was staged goes."""
        system, base = file_system(self.path)
        folder, target = f"{base}/{STAGING}/{self.job}", f"{base}/version={self.version}"
        system.create_dir(target, recursive=True)
        done = [m for m in messages if m is not None and m.name]
        for m in done:
            system.move(f"{folder}/{m.name}", f"{target}/{m.name}")
        manifest = {"version": self.version, "archives": sorted(m.name for m in done), "members": sum(len(m.members) for m in done), "bytes": sum(x["bytes"] for m in done for x in m.members)}
        with system.open_output_stream(f"{folder}/{MANIFEST}") as f:
            f.write(json.dumps(manifest, indent=1).encode())
        system.move(f"{folder}/{MANIFEST}", f"{target}/{MANIFEST}")
        system.delete_dir(folder)

    def abort(self, messages: list[Written | None]) -> None:
        system, base = file_system(self.path)
        if self._exists(system, f"{base}/{STAGING}/{self.job}"):
            system.delete_dir(f"{base}/{STAGING}/{self.job}")


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)

    def streamReader(self, schema) -> ArchiveStream:
        return ArchiveStream(self.options)

    def writer(self, schema, overwrite: bool) -> BundleWriter:
        if overwrite:
            raise ValueError("bundles are published by version; write with mode append")
        return BundleWriter(self.options)


def register(spark) -> None:
    """Make the format known to a session, with filters pushed to it."""
    spark.dataSource.register(ArchiveSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
