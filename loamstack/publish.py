"""Numbered heads of a folder, each published whole or not at all.

A head is one small JSON file. It is written under a name of its own first and then moved to its number, which fails if
the number is taken; so a writer that stops midway leaves no head, and of two writers of one number one fails.
"""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


class StaleWriter(RuntimeError):
    """What a writer goes by no longer holds: its lease was given away, or its state is not the newest."""


class Overtaken(StaleWriter):
    """Another writer has published the number first; looking again and trying anew is safe."""


class Heads:
    """Heads ``prefix-N.json`` of ``folder``. Heads that cannot be read are passed over, but their numbers stay taken."""

    def __init__(self, spark: SparkSession, folder: str, prefix: str):
        self.spark, self.folder, self.prefix = spark, folder, prefix
        jvm = spark.sparkContext._jvm
        self._jvm, self._path = jvm, jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(folder).getFileSystem(self._conf)
        self._fs.mkdirs(self._path(folder))
        url = urlparse(str(self._fs.makeQualified(self._path(folder)).toUri().toString()))
        #: The folder as the driver's own file system has it, where it is such a one.
        self.local = unquote(url.path) if url.scheme == "file" else None

    def numbers(self) -> list[int]:
        if self.local:
            names = os.listdir(self.local)
        else:
            names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        start, stop = len(self.prefix) + 1, -len(".json")
        return sorted(int(n[start:stop]) for n in names if n.startswith(f"{self.prefix}-") and n.endswith(".json") and n[start:stop].isdigit())

    def read(self, number: int) -> dict | None:
        """The content of a head; None if it is torn or gone."""
        name = f"{self.prefix}-{number}.json"
        try:
            if self.local:
                with open(os.path.join(self.local, name), "rb") as file:
                    raw = file.read()
            else:
                stream = self._fs.open(self._path(f"{self.folder}/{name}"))
                try:
                    raw = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").encode()
                finally:
                    stream.close()
            found = json.loads(raw)
        except Exception:  # noqa: BLE001 - whatever keeps it from being read, it is no head
            return None
        return found if isinstance(found, dict) else None

    def newest(self) -> tuple[int, dict | None]:
        """The greatest number that is taken (-1 for none), and the content of the newest head that can be read."""
        numbers = self.numbers()
        for number in reversed(numbers):
            found = self.read(number)
            if found is not None:
                return numbers[-1], found
        return (numbers[-1] if numbers else -1), None

    def publish(self, number: int, content: dict) -> None:
        """Publish a head; Overtaken if its number is taken."""
        name, own = f"{self.prefix}-{number}.json", f".{self.prefix}-{number}-{uuid.uuid4().hex}"
        raw = json.dumps(content).encode()
        if self.local:
            mine, target = os.path.join(self.local, own), os.path.join(self.local, name)
            with open(mine, "wb") as file:
                file.write(raw)
                file.flush()
                os.fsync(file.fileno())
            try:
                os.link(mine, target)
            except FileExistsError as error:
                raise Overtaken(f"{name} was published by another writer") from error
            finally:
                os.unlink(mine)
            return
        mine, target = self._path(f"{self.folder}/{own}"), self._path(f"{self.folder}/{name}")
        out = self._fs.create(mine, True)
        try:
            out.write(raw)
        finally:
            out.close()
        gateway = self.spark.sparkContext._gateway
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = gateway.new_array(rename, 1)
        how[0] = rename.NONE
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(mine.toUri(), self._conf).rename(mine, target, how)
        except Exception as error:
            self._fs.delete(mine, False)
            if self._fs.exists(target):
                raise Overtaken(f"{name} was published by another writer") from error
            raise

    def remove(self, name: str) -> None:
        """Remove a file or folder inside the folder."""
        self._fs.delete(self._path(f"{self.folder}/{name}"), True)

    def ages(self) -> dict[str, float]:
        """Names in the folder and when each was last changed, in seconds."""
        return {s.getPath().getName(): s.getModificationTime() / 1000 for s in self._fs.listStatus(self._path(self.folder))}
