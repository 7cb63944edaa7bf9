"""Small driver-side file operations through Hadoop's FileSystem, so any store that Spark reaches works.

Files of the local file system are written and folders deleted by Python: Hadoop's starts a process or two for each file's mode and
status, which costs more than all the rest of a small write.
"""

from __future__ import annotations

import contextlib
import os
import re
import shutil

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, base: str) -> None:
        # Each name of a package is a round trip to the JVM, so classes are looked up once.
        self._jvm, self._path = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(base).getFileSystem(conf)
        self._is_local = self._fs.getScheme() == "file"

    def exists(self, p: str) -> bool:
        return self._fs.exists(self._path(p))

    def mkdirs(self, p: str) -> None:
        self._fs.mkdirs(self._path(p))

    def delete(self, p: str) -> None:
        path = self._local(p)
        if path and os.path.isdir(path) and not os.path.islink(path):
            shutil.rmtree(path)
            return
        self._fs.delete(self._path(p), True)

    def names(self, p: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(p))) if self.exists(p) else []

    def read_text(self, p: str) -> str:
        stream = self._fs.open(self._path(p))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _local(self, p: str) -> str | None:
        """The path for Python, if it is an absolute one of the local file system."""
        path = re.sub(r"^file:(//[^/]*)?", "", p)
        return path if self._is_local and path.startswith("/") else None

    def write_bytes(self, p: str, data: bytes, sync: bool = True) -> None:
        """Writes a file, or over it; readers may see a part of it until then."""
        path = self._local(p)
        if path:
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with contextlib.suppress(FileNotFoundError):  # Hadoop's checksum of the file before
                os.remove(f"{os.path.dirname(path)}/.{os.path.basename(path)}.crc")
            with open(path, "wb") as f:
                f.write(data)
                f.flush()
                if sync:
                    os.fsync(f.fileno())
            return
        out = self._fs.create(self._path(p), True)
        try:
            out.write(bytearray(data))
            if sync:
                out.hsync()
        finally:
            out.close()

    def write_text(self, p: str, text: str) -> None:
        """Writes beside the target, syncs and renames over it: readers see the old text or the new."""
        self.write_bytes(f"{p}.tmp", text.encode())
        path = self._local(p)
        if path:
            with contextlib.suppress(FileNotFoundError):
                os.remove(f"{os.path.dirname(path)}/.{os.path.basename(path)}.crc")
            os.replace(f"{path}.tmp", path)
            return
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        overwrite = self._jvm.java.lang.reflect.Array.newInstance(options.OVERWRITE.getClass(), 1)
        overwrite[0] = options.OVERWRITE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._fs.getConf())
        context.rename(self._path(f"{p}.tmp"), self._path(p), overwrite)
