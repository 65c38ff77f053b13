"""Stored tables (glossaries, memory, jobs) as versions: a writer puts a new one beside the old and then names it.

A version is a folder of Parquet files, and its name in the list of versions is a small file that is moved there when it
is whole: a write that fails leaves no name, and of two writers who began from the same version the later finds its name
taken. Readers keep the version they opened. That two writers never get one name rests on a file system that moves a
file in one step and only where there is none, as HDFS does; on a local disk that holds for the writers of one process.
"""

from __future__ import annotations

from collections.abc import Callable
from threading import Lock
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

Migration = Callable[[DataFrame], DataFrame]
_naming = Lock()


class Conflict(RuntimeError):
    """Another writer stored a version in the meantime; read again and repeat."""


class StoredTable:
    """A table at a path. migrations[k] turns rows of schema version k into those of k + 1; the current schema version is
    how many there are."""

    def __init__(self, spark: SparkSession, path: str, migrations: tuple[Migration, ...] = ()):
        self.spark, self.path, self.migrations = spark, path.rstrip("/"), migrations

    def _place(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _system(self):
        return self._place("_versions").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> dict[int, tuple[int, str]]:
        """By number: schema version and folder of each version there is."""
        system, place = self._system(), self._place("_versions")
        if not system.exists(place):
            return {}
        files = [f.getPath().toString() for f in system.listStatus(place) if f.getPath().getName().isdigit()]
        found = (r.value.split(" ", 2) for r in (self.spark.read.text(files).collect() if files else []))
        return {int(n): (int(schema), folder) for n, schema, folder in found}

    def version(self) -> int:
        """The latest version's number; 0 if there is none."""
        return max(self.versions(), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest if none is given, in the current schema."""
        known = self.versions()
        number = max(known, default=0) if version is None else version
        if number not in known:
            raise LookupError(f"{self.path} has no version {number}")
        schema, folder = known[number]
        if schema > len(self.migrations):
            raise ValueError(f"{self.path} has schema version {schema}, newer than {len(self.migrations)}")
        rows = self.spark.read.parquet(f"{self.path}/{folder}")
        for migrate in self.migrations[schema:]:
            rows = migrate(rows)
        return rows

    def write(self, rows: DataFrame, base: int | None = None) -> int:
        """Store rows, made from the version base (the latest, if none is given), as the next version; its number."""
        base = self.version() if base is None else base
        folder = f"v{base + 1}-{uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        self._name(base + 1, folder)
        return base + 1

    def _name(self, number: int, folder: str) -> None:
        system, taken = self._system(), self._place(f"_versions/{number}")
        written = self._place(f"_new/{uuid4().hex}")
        out = system.create(written, False)
        out.write(bytearray(f"{number} {len(self.migrations)} {folder}\n".encode()))
        out.close()
        system.mkdirs(self._place("_versions"))
        with _naming:
            named = not system.exists(taken) and system.rename(written, taken)
        if not named:
            system.delete(written, False)
            system.delete(self._place(folder), True)
            raise Conflict(f"{self.path} has a version {number} already")

    def changed(self, change: Callable[[DataFrame], DataFrame], tries: int = 5) -> int:
        """Store change(rows) of the latest version, again from the start where another writer was faster; the number."""
        for _ in range(tries - 1):
            try:
                base = self.version()
                return self.write(change(self.read(base)), base)
            except Conflict:
                continue
        base = self.version()
        return self.write(change(self.read(base)), base)

    def forget(self, keep: int = 2) -> list[int]:
        """Delete all versions but the last few; for when no reader has them open. Their numbers."""
        system, known = self._system(), self.versions()
        gone = sorted(known)[: max(0, len(known) - max(keep, 1))]
        for number in gone:
            system.delete(self._place(f"_versions/{number}"), False)
            system.delete(self._place(known[number][1]), True)
        return gone
