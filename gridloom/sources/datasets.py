"""Named datasets: session views, with an opt-in copy in a workspace folder."""

from __future__ import annotations

import re
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from ..functions.columns import quoted

# Fixed value: characters a dataset name may not hold.
UNSAFE_NAME = r'[<>:"/\\|?*]'
COMMIT = "version-"


def safe_name(name: str) -> str:
    return re.sub(UNSAFE_NAME, "_", name).strip() or "dataset"


class Datasets:
    """Add, list, fetch and remove frames by name; save them to and load them from a folder."""

    def __init__(self, spark: SparkSession, workspace: str | None = None):
        self.spark = spark
        self.workspace = workspace
        self._names: list[str] = []

    def add(self, name: str, df: DataFrame) -> str:
        name = safe_name(name)
        df.createOrReplaceTempView(quoted(name))
        if name not in self._names:
            self._names.append(name)
        return name

    def names(self) -> list[str]:
        return list(self._names)

    def get(self, name: str) -> DataFrame:
        return self.spark.table(quoted(safe_name(name)))

    def derive(self, name: str, df: DataFrame, label: str = "cleaned") -> str:
        """Store a result beside its source, as ``X (cleaned)``."""
        return self.add(f"{name} ({label})", df)

    def remove(self, name: str) -> None:
        name = safe_name(name)
        self.spark.sql(f"DROP VIEW IF EXISTS {quoted(name)}")
        self._names = [n for n in self._names if n != name]

    def _path(self, name: str) -> str:
        if not self.workspace:
            raise ValueError("this store has no workspace folder")
        return f"{self.workspace}/{safe_name(name)}.parquet"

    def save(self) -> dict[str, int]:
        """Write every set to a fresh folder and commit it as its next version; returns the versions."""
        saved = {}
        for name in self._names:
            folder = f"data-{uuid.uuid4().hex}"
            self.get(name).write.parquet(f"{self._path(name)}/{folder}")
            saved[name] = self._log(name).commit(folder)
        return saved

    def versions(self, name: str) -> list[int]:
        return sorted(self._log(name).versions())

    def load(self, name: str, version: int | None = None) -> DataFrame:
        """The newest version, or the one named. The frame keeps reading it whatever is saved later."""
        found = self._log(name).versions()
        if not found or (version is not None and version not in found):
            raise ValueError(f"{name} has no version {'' if version is None else version}".rstrip())
        df = self.spark.read.parquet(f"{self._path(name)}/{found[max(found) if version is None else version]}")
        self.add(name, df)
        return df

    def tidy(self, name: str, keep: int = 1, hours: float = 24) -> list[str]:
        """Delete all but the newest ``keep`` versions, and data of saves that broke off more than ``hours`` ago.

        Younger data without a version may belong to a save that is still running. Frames that read a deleted
        version can no longer do so.
        """
        if keep < 1:
            raise ValueError("at least one version must be kept")
        return self._log(name).tidy(keep, hours)

    def _log(self, name: str) -> "_Versions":
        return _Versions(self.spark, self._path(name))


class _Versions:
    """Commit log of one set: a file per version, made only if absent, whose one line names a data folder.

    A file without its line end is a commit that broke off; it counts as none, and its number is not used again.
    That two saves never share a number rests on the file system making a file only if absent, as HDFS does.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.path = path
        self.root = self._at(path)
        self.files = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def _listed(self, prefix: str) -> dict[str, object]:
        if not self.files.exists(self.root):
            return {}
        found = self.files.listStatus(self.root)
        return {s.getPath().getName(): s for s in found if s.getPath().getName().startswith(prefix)}

    def _line(self, name: str) -> str | None:
        stream = self.files.open(self._at(f"{self.path}/{name}"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return text[:-1] if text.endswith("\n") else None

    def versions(self) -> dict[int, str]:
        """Data folder per committed version."""
        lines = {int(name.removeprefix(COMMIT)): self._line(name) for name in self._listed(COMMIT)}
        return {number: folder for number, folder in lines.items() if folder}

    def commit(self, folder: str) -> int:
        number = max((int(name.removeprefix(COMMIT)) for name in self._listed(COMMIT)), default=0)
        while True:
            number += 1
            target = self._at(f"{self.path}/{COMMIT}{number:012d}")
            try:
                stream = self.files.create(target, False)
            except Py4JJavaError:
                if not self.files.exists(target):
                    raise
                continue  # another save took the number
            stream.write(bytearray(f"{folder}\n".encode()))
            stream.close()
            return number

    def tidy(self, keep: int, hours: float) -> list[str]:
        folders = self._listed("data-")
        found = self.versions()
        kept = {found[v] for v in sorted(found)[-keep:]}
        old = time.time() * 1000 - hours * 3_600_000
        named = set(found.values())
        gone = [f for f, s in folders.items() if f not in kept and (f in named or s.getModificationTime() < old)]
        for number in sorted(found)[:-keep]:  # the name goes first, so no version names deleted data
            self.files.delete(self._at(f"{self.path}/{COMMIT}{number:012d}"), False)
        for folder in gone:
            self.files.delete(self._at(f"{self.path}/{folder}"), True)
        return sorted(gone)
