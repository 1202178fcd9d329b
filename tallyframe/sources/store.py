"""Persistent datasets: Parquet data and a metadata file per generation, on any Hadoop file system.

A save writes gen=<n> beside the older generations and then moves a pointer to it, so readers never see
half a dataset. A lock file keeps to one writer, and is broken when that has died. Older generations beyond `keep` are removed.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from tallyframe.meta import NAME, Dataset

KEEP = 24
#: Seconds after which a lock is that of a writer that has died.
STALE = 6 * 3600


class Locked(RuntimeError):
    """Another writer holds the dataset."""


class Store:
    def __init__(self, spark: SparkSession, *paths: str, stale: float = STALE) -> None:
        """paths: folders searched in order; the first is written to. stale: seconds after which a lock is broken."""
        self.spark, self.paths, self.stale = spark, paths, stale
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self._conf)

    def _text(self, path: str) -> str:
        stream = self._fs(path).open(self._path(path))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, path: str, text: str) -> None:
        stream = self._fs(path).create(self._path(path), True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def _replace(self, fresh: str, old: str) -> None:
        """Move a file over another in one step, so that there is always one of them."""
        jvm = self.spark._jvm
        how = self.spark._sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        how[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(fresh).toUri(), self._conf).rename(self._path(fresh), self._path(old), how)

    def _list(self, path: str) -> list[str]:
        fs, p = self._fs(path), self._path(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    @contextmanager
    def locked(self, name: str) -> Iterator[None]:
        """Hold the dataset for writing.

        The lock says who holds it. One that is older than `stale` seconds was left by a writer that died: it is moved
        away, which only one of several waiting writers can do, and taken anew.
        """
        folder, lock = f"{self.paths[0]}/{name}", f"{self.paths[0]}/{name}/_LOCK"
        fs = self._fs(folder)
        fs.mkdirs(self._path(folder))
        mine = uuid.uuid4().hex
        if not fs.createNewFile(self._path(lock)):
            age = time.time() - fs.getFileStatus(self._path(lock)).getModificationTime() / 1000 if fs.exists(self._path(lock)) else 0.0
            aside = f"{lock}-{mine}"
            if age <= self.stale or not fs.rename(self._path(lock), self._path(aside)):
                raise Locked(f"dataset {name!r} is being written")
            fs.delete(self._path(aside), False)
            if not fs.createNewFile(self._path(lock)):
                raise Locked(f"dataset {name!r} is being written")
        self._put(lock, mine)
        try:
            yield
        finally:
            # Not the lock of another writer that took this one for dead.
            if fs.exists(self._path(lock)) and self._text(lock) == mine:
                fs.delete(self._path(lock), False)

    def generations(self, name: str, path: str | None = None) -> list[int]:
        return [int(f[4:]) for f in self._list(f"{path or self.paths[0]}/{name}") if f.startswith("gen=")]

    def save(self, ds: Dataset, keep: int = KEEP, partition_by: list[str] | None = None) -> int:
        """Write a new generation and point to it; returns its number."""
        folder = f"{self.paths[0]}/{ds.name}"
        with self.locked(ds.name):
            have = self.generations(ds.name)
            n = max(have, default=0) + 1
            writer = ds.df.write.mode("overwrite")
            (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{folder}/gen={n:06d}")
            self._put(f"{folder}/meta-{n:06d}.json", ds.meta_json())
            # Write the pointer under another name and rename it over the old one.
            fresh, pointer = f"{folder}/_CURRENT-{uuid.uuid4().hex}", f"{folder}/_CURRENT"
            fs = self._fs(folder)
            self._put(fresh, str(n))
            self._replace(fresh, pointer)
            for old in sorted([*have, n])[:-keep]:
                fs.delete(self._path(f"{folder}/gen={old:06d}"), True)
                fs.delete(self._path(f"{folder}/meta-{old:06d}.json"), False)
        return n

    def find(self, name: str) -> tuple[str, str]:
        """(folder, stored name) of a dataset, whatever the case of its name."""
        if not NAME.match(name):
            raise ValueError(f"bad dataset name {name!r}")
        for path in self.paths:
            for entry in self._list(path):
                if entry.lower() == name.lower() and "_CURRENT" in self._list(f"{path}/{entry}"):
                    return path, entry
        raise FileNotFoundError(f"no dataset {name!r}")

    def load(self, name: str, generation: int | None = None) -> Dataset:
        """A dataset, of the current or a given generation; columns are read only when used."""
        path, entry = self.find(name)
        n = generation or int(self._text(f"{path}/{entry}/_CURRENT"))
        return Dataset.from_json(self.spark.read.parquet(f"{path}/{entry}/gen={n:06d}"), self._text(f"{path}/{entry}/meta-{n:06d}.json"))

    def available(self) -> list[str]:
        return sorted({e for p in self.paths for e in self._list(p) if "_CURRENT" in self._list(f"{p}/{e}")})

    def share_filter(self, name: str, filter_name: str, expr: str, expected: str | None = None) -> None:
        """Store a named filter with the dataset; expected: the text it replaces, or a conflict is raised."""
        from tallyframe.plans.predicate import parse

        import json

        parse(expr)
        path, entry = self.find(name)
        file = f"{path}/{entry}/filters.json"
        with self.locked(entry):
            held = json.loads(self._text(file)) if "filters.json" in self._list(f"{path}/{entry}") else {}
            if held.get(filter_name) != expected:
                raise ValueError(f"filter {filter_name!r} has been changed meanwhile")
            self._put(file, json.dumps(held | {filter_name: expr}))

    def shared_filters(self, name: str) -> dict[str, str]:
        import json

        path, entry = self.find(name)
        return json.loads(self._text(f"{path}/{entry}/filters.json")) if "filters.json" in self._list(f"{path}/{entry}") else {}
