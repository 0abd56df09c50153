"""Published states of a folder of tables.

A state is a small JSON value that names the tables which make up a store. Tables are written first, under
names never used before; publishing the next state renames one file to the next number, which Hadoop's file
systems do as a whole or not at all and refuse if that number is taken. Readers see one state or the next,
never a mixture, and a job that dies before publishing leaves tables that no state names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class ConcurrentCommit(RuntimeError):
    """Another writer published the state first."""


class Commits:
    """The states of one folder, numbered from 1."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._log = self._paths(f"{self.path}/_commits")
        self._fs = self._log.getFileSystem(spark._jsc.hadoopConfiguration())

    def new_name(self, kind: str) -> str:
        """A folder that no state has named before."""
        return f"{kind}-{uuid.uuid4().hex}"

    def folder(self, name: str) -> str:
        return f"{self.path}/{name}"

    def versions(self) -> list[int]:
        if not self._fs.exists(self._log):
            return []
        names = [str(f.getPath().getName()) for f in self._fs.listStatus(self._log)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def latest(self) -> tuple[int, dict]:
        """(number, state) of the last published state, (0, {}) before the first."""
        known = self.versions()
        return (known[-1], self.state(known[-1])) if known else (0, {})

    def state(self, version: int) -> dict:
        opened = self._fs.open(self._file(version))
        try:
            return json.loads(bytes(opened.readAllBytes()).decode())
        finally:
            opened.close()

    def publish(self, after: int, state: dict) -> int:
        """Make ``state`` the one that follows number ``after``."""
        written = self._paths(f"{self.path}/_commits/.{uuid.uuid4().hex}")
        out = self._fs.create(written)
        try:
            out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        finally:
            out.close()
        target = self._file(after + 1)
        if self._fs.exists(target) or not self._fs.rename(written, target):
            self._fs.delete(written, False)
            raise ConcurrentCommit(f"state {after + 1} of {self.path} is already published")
        return after + 1

    def vacuum(self, named: set[str], keep: int = 1) -> list[str]:
        """Delete tables that none of the last ``keep`` states and not ``named`` names; no writer may be at work."""
        gone = []
        for entry in self._fs.listStatus(self._paths(self.path)):
            name = str(entry.getPath().getName())
            if entry.isDirectory() and not name.startswith("_") and name not in named:
                self._fs.delete(entry.getPath(), True)
                gone.append(name)
        for version in self.versions()[:-keep]:
            self._fs.delete(self._file(version), False)
        return gone

    def _file(self, version: int):
        return self._paths(f"{self.path}/_commits/{version:012d}.json")
