"""Tables that change by whole versions: a commit is one small file that is put in place if nobody else has put it there."""

from __future__ import annotations

import json
import os
import re
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


class Conflict(Exception):
    """Another writer has committed that version."""


class VersionedTable:
    """A folder with data in parts that are written once, and a manifest for every version that names the parts it has.

    Writers put their rows into a part of their own, which no reader sees, and then commit the next version's manifest. The
    manifest is written aside and put in place in one step that fails where it exists: a hard link on a local or mounted
    folder, else a rename that doesn't replace (HDFS; a store whose rename replaces must not be used). So of two writers
    at once one commits and the other sees the conflict, and a writer that dies before its commit leaves a part that
    belongs to no version. Readers read a version's parts, whatever is written meanwhile.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _hadoop(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        at, fs = self._hadoop(f"{self.path}/_versions")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"(\d{12})\.json", n)))

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, or of the newest; of a table that has none, that of version 0, without a part."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if version == 0:
            return {"version": 0, "parts": [], "note": {}}
        if version not in known:
            raise FileNotFoundError(f"{self.path} has no version {version}")
        at, fs = self._hadoop(f"{self.path}/_versions/{version:012}.json")
        stream = fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default."""
        parts = self.manifest(version)["parts"]
        if not parts:
            raise FileNotFoundError(f"{self.path} has no rows yet")
        return self.spark.read.parquet(*[f"{self.path}/{p}" for p in parts])

    def stage(self, rows: DataFrame) -> str:
        """Writes rows as a part that no version has yet."""
        part = f"part-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{part}")
        return part

    def commit(self, version: int, parts: list[str], **note) -> None:
        """Makes ``parts`` the next version after ``version``, or raises Conflict if there is one already."""
        name = f"{version + 1:012}.json"
        text = json.dumps({"version": version + 1, "parts": parts, "note": note})
        aside, fs = self._hadoop(f"{self.path}/_versions/.{uuid.uuid4().hex}")
        out = fs.create(aside)
        out.write(bytearray(text.encode()))
        out.close()
        target, _ = self._hadoop(f"{self.path}/_versions/{name}")
        try:
            if fs.getScheme() == "file":
                os.link(aside.toUri().getPath(), Path(target.toUri().getPath()))
            else:
                context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
                none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
                context.rename(aside, target, none)
        except Exception as e:
            if isinstance(e, FileExistsError) or fs.exists(target):
                raise Conflict(f"{self.path} has a version {version + 1}") from e
            raise
        finally:
            fs.delete(aside, False)

    def append(self, rows: DataFrame, keys: list[str], tries: int = 20) -> int:
        """Appends the rows whose key the table doesn't have, each key once, and gives the version that has them all.

        A writer that loses the race takes from what it staged the keys that the winner brought, and tries again: rows are
        neither lost nor doubled, whoever writes at the same time. Nothing new: no new version."""
        rows = rows.dropDuplicates(keys)
        for _ in range(tries):
            now = self.manifest()
            new = rows.join(self.read(now["version"]).select(*keys), keys, "left_anti").select(*rows.columns) if now["parts"] else rows
            part = self.stage(new)
            rows = self.spark.read.parquet(f"{self.path}/{part}")
            n = rows.count()
            if not n:
                return now["version"]
            try:
                self.commit(now["version"], [*now["parts"], part], rows=n)
                return now["version"] + 1
            except Conflict:
                continue
        raise Conflict(f"{self.path}: {tries} versions came before this one")

    def publish(self, rows: DataFrame, tries: int = 20, **note) -> int:
        """A snapshot: a version that has these rows alone. Older versions stay readable."""
        part = self.stage(rows)
        for _ in range(tries):
            version = self.manifest()["version"]
            try:
                self.commit(version, [part], **note)
                return version + 1
            except Conflict:
                continue
        raise Conflict(f"{self.path}: {tries} versions came before this one")

    def compact(self) -> int:
        """The newest version's rows as one part; a version that comes meanwhile wins, and nothing changes."""
        now = self.manifest()
        if len(now["parts"]) < 2:
            return now["version"]
        try:
            self.commit(now["version"], [self.stage(self.read(now["version"]))], compacted=len(now["parts"]))
            return now["version"] + 1
        except Conflict:
            return self.manifest()["version"]

    def history(self) -> DataFrame:
        """(version, parts, note) of every version."""
        made = [(m["version"], len(m["parts"]), json.dumps(m["note"], sort_keys=True)) for m in map(self.manifest, self.versions())]
        return self.spark.createDataFrame(made, "version long, parts long, note string")

