"""A lock on an output folder, with a lease and a fencing number, on whatever file system Spark writes to.

The lock's files are `_lock/<number>`. A number is taken by creating its file, which the
file system lets one process do, and only when the highest number before it was released
or its lease has run out. So the number also is a fence: who holds a lower one than the
highest has lost the folder, and `publish` does not publish for them.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Seconds that a lock holds without being renewed.
LEASE = 600.0


class Locked(RuntimeError):
    """Somebody else holds the folder."""


class OutputLock:
    def __init__(self, spark: SparkSession, path: str, lease: float = LEASE):
        self.spark, self.lease = spark, lease
        self.owner = uuid.uuid4().hex
        self.number: int | None = None
        jvm = spark._jvm
        self.folder = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_lock")
        self.fs = self.folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def _file(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.folder, name)

    def _create(self, name: str) -> bool:
        """Make an empty file if there is none; whether this call made it."""
        from py4j.protocol import Py4JJavaError

        try:
            if self.fs.getScheme() == "file":  # Hadoop's local files are not created exclusively, Java's are
                files = self.spark._jvm.java.nio.file
                none = self.spark.sparkContext._gateway.new_array(files.attribute.FileAttribute, 0)
                files.Files.createFile(self.spark._jvm.java.io.File(self._file(name).toUri().getPath()).toPath(), none)
            else:
                self.fs.create(self._file(name), False).close()
        except Py4JJavaError as e:
            if self.fs.exists(self._file(name)):
                return False
            raise e
        return True

    def _write(self, name: str, content: dict) -> None:
        out = self.fs.create(self._file(name), True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()

    def _read(self, name: str) -> dict:
        from py4j.protocol import Py4JJavaError

        try:
            size = self.fs.getFileStatus(self._file(name)).getLen()
            stream = self.fs.open(self._file(name))
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8") if size else ""
            stream.close()
            return json.loads(text) if text else {}
        except (Py4JJavaError, ValueError):  # just being written
            return {}

    def _top(self) -> int:
        return max((int(s.getPath().getName()) for s in self.fs.listStatus(self.folder) if s.getPath().getName().isdigit()), default=0)

    def _is_live(self, number: int) -> bool:
        if not number or self.fs.exists(self._file(f"{number}-released")):
            return False
        until = self._read(str(number)).get("until")
        if until is None:  # taken, but not yet written to
            until = self.fs.getFileStatus(self._file(str(number))).getModificationTime() / 1000 + self.lease
        return time.time() < until

    def acquire(self) -> int:
        """Take the folder; its fencing number. Raises Locked if it is held."""
        self.fs.mkdirs(self.folder)
        top = self._top()
        if self._is_live(top) or not self._create(str(top + 1)):
            raise Locked(f"{self.folder.getParent()} is being written by another process")
        self.number = top + 1
        self.renew()
        for s in self.fs.listStatus(self.folder):  # what lies below can never be the highest again
            if int(s.getPath().getName().partition("-")[0]) < top:
                self.fs.delete(s.getPath(), False)
        return self.number

    def holds(self) -> bool:
        """Whether nobody has taken the folder since."""
        return self.number is not None and self._top() == self.number and not self.fs.exists(self._file(f"{self.number}-released"))

    def renew(self) -> None:
        if not self.holds():
            raise Locked("the lock was taken over")
        self._write(str(self.number), {"owner": self.owner, "until": time.time() + self.lease})

    def release(self) -> None:
        if self.holds():
            self._create(f"{self.number}-released")
        self.number = None

    def __enter__(self) -> "OutputLock":
        self.acquire()
        return self

    def __exit__(self, *_) -> None:
        self.release()


def publish_locked(df: DataFrame, path: str, version: str, lease: float = LEASE, lock: OutputLock | None = None) -> str:
    """Write a version of a folder under its lock: staged, and moved to its place only while the lock still is ours."""
    spark = df.sparkSession
    held = lock or OutputLock(spark, path, lease)
    if lock is None:
        held.acquire()
    target, staged = f"{path}/version={version}", f"{path}/_staged-{held.number}-{held.owner}"
    there, here = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (target, staged))
    try:
        if held.fs.exists(there):
            raise FileExistsError(f"version {version} is published already")
        df.write.parquet(staged)
        held.renew()  # raises if the lock was taken over meanwhile
        if not held.fs.rename(here, there):
            raise OSError(f"{staged} could not be moved")
    finally:
        held.fs.delete(here, True)
        if lock is None:
            held.release()
    return target
