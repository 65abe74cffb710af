"""Tables in a shared folder: artifacts of a pipeline's steps, and lineage cuts."""

from __future__ import annotations

import atexit
import json
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


#: Scratch folders of this Python's applications.
_SCRATCH: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset, a temporary one, which only a local session can share."""
    set_there = spark.conf.get("spark.checkpoint.dir", None)
    if set_there:
        return set_there.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), "phrasewerk-shared")
    os.makedirs(own, exist_ok=True)
    return f"file://{own}"


def scratch_dir(spark: SparkSession) -> str:
    """The application's own folder in the shared one; it goes when Python ends or with clear_scratch."""
    path = f"{shared_dir(spark)}/phrasewerk-{spark.sparkContext.applicationId}"
    if path not in _SCRATCH:
        _SCRATCH.add(path)
        atexit.register(_drop, spark, path)
    return path


def _drop(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001 - the session has ended before
        if path.startswith("file:") or path.startswith("/"):
            shutil.rmtree(re.sub(r"^file:/*", "/", path), ignore_errors=True)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes what written left; to be called when no result is read any more."""
    _drop(spark, scratch_dir(spark))


def written(df: DataFrame, what: str) -> DataFrame:
    """Writes *df* to a table in the shared folder and reads it back: a lineage cut that outlives lost executors."""
    path = f"{scratch_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class ArtifactStore:
    """Parquet tables of processes and their steps below one folder: <root>/<process>/<step>."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, process: str, step: str | None = None):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join(filter(None, [self.root, process, step])))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def path(self, process: str, step: str) -> str:
        return f"{self.root}/{process}/{step}"

    def has(self, process: str, step: str) -> bool:
        """True for a step that was written to its end."""
        path, fs = self._at(process, f"{step}/_SUCCESS")
        return fs.exists(path)

    def save(self, df: DataFrame, process: str, step: str, mode: str = "overwrite") -> DataFrame:
        df.write.mode(mode).parquet(self.path(process, step))
        return self.table(process, step)

    def table(self, process: str, step: str) -> DataFrame:
        return self.spark.read.parquet(self.path(process, step))

    def get_or_compute(self, process: str, step: str, make: Callable[[], DataFrame], overwrite: bool = False) -> DataFrame:
        """The stored table, or the one that *make* returns, stored."""
        return self.table(process, step) if self.has(process, step) and not overwrite else self.save(make(), process, step)

    def steps(self, process: str) -> list[str]:
        """Finished steps, found by their folders."""
        path, fs = self._at(process)
        return sorted(s.getPath().getName() for s in fs.listStatus(path) if self.has(process, s.getPath().getName())) if fs.exists(path) else []

    def delete(self, process: str, step: str | None = None) -> bool:
        """Deletes a step, or all of a process; True if there was one."""
        path, fs = self._at(process, step)
        return bool(fs.delete(path, True))

    # Versioned tables: <root>/<name>/<version>, the present one named by a file beside them.

    def _text(self, path: str) -> str | None:
        at, fs = self._at(path)
        if not fs.exists(at):
            return None
        lines = self.spark.read.text(f"{self.root}/{path}", wholetext=True).first()
        return lines[0] if lines else None

    def _write_text(self, path: str, text: str) -> None:
        """Writes a small file beside the old one and moves it there, so a reader sees one or the other."""
        at, fs = self._at(f"{path}.new-{uuid.uuid4().hex}")
        out = fs.create(at, True)
        out.write(bytearray(text.encode()))
        out.close()
        goal, _ = self._at(path)
        fs.delete(goal, False)
        fs.rename(at, goal)

    def put(self, df: DataFrame, name: str) -> None:
        """A new version of the table *name*."""
        version = uuid.uuid4().hex
        df.write.parquet(f"{self.root}/{name}/{version}")
        self._write_text(f"{name}/present", version)

    def present(self, name: str) -> str | None:
        """The version that is the present one, if there is one."""
        return self._text(f"{name}/present")

    def read_present(self, name: str) -> DataFrame:
        version = self.present(name)
        if version is None:
            raise FileNotFoundError(f"no table {name} under {self.root}")
        return self.spark.read.parquet(f"{self.root}/{name}/{version}")

    def set_properties(self, name: str, values: dict) -> None:
        self._write_text(f"{name}/properties.json", json.dumps(values))

    def properties(self, name: str) -> dict:
        return json.loads(self._text(f"{name}/properties.json") or "{}")


class Loader:
    """Tables of a process's steps, each with those it depends on, kept open once read."""

    #: What each step is made from.
    NEEDS = {"data": (), "embedding": ("data",), "clustering": ("embedding",), "graph": ("clustering",), "integration": ("graph", "embedding")}

    def __init__(self, store: ArtifactStore, process: str):
        self.store, self.process = store, process
        self.open: dict[str, DataFrame] = {}

    def load(self, step: str) -> DataFrame:
        """The table of a step; the steps it is made from are loaded first, and a missing one is an error."""
        for before in self.NEEDS.get(step, ()):
            self.load(before)
        if step not in self.open:
            if not self.store.has(self.process, step):
                raise FileNotFoundError(f"{self.process} has no {step}")
            self.open[step] = self.store.table(self.process, step)
        return self.open[step]

    def close(self) -> None:
        for table in self.open.values():
            table.unpersist()
        self.open.clear()
