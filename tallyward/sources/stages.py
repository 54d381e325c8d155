"""Finished stages, kept in the shared folder and found again by what they were made from.

A stage is named by a digest of its input files (path, size, time of change), its parameters and the code of this
package, so a result is used again only as long as none of them changes. Every writer has a folder of its own and
announces it by an empty file when it is complete: a job that dies leaves nothing that could be read, and of two
writers at once either may be used.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence
from functools import cache, cached_property
from pathlib import Path
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

from tallyward.session import shared_folder

PACKAGE = Path(__file__).resolve().parent.parent
PARTS = ("functions", "operators", "plans", "sources")
DONE = "done-"
Model = TypeVar("Model")


@cache
def code_digest() -> str:
    digest = hashlib.sha256()
    for part in PARTS:
        for file in sorted((PACKAGE / part).glob("*.py")):
            digest.update(file.read_bytes())
    return digest.hexdigest()


class StageStore:
    """Stages made from ``inputs`` (files or folders) under ``params``."""

    def __init__(self, spark: SparkSession, inputs: Sequence[str], root: str | None = None, **params):
        self.spark, self.inputs, self.params = spark, sorted(inputs), params
        self.root = root or f"{shared_folder(spark)}/tallyward/stages"

    def _path(self, place: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(place)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    @cached_property
    def source(self) -> str:
        """Digest of the input files; only their listing is read."""
        found = []
        for place in self.inputs:
            path, files = self._path(place)
            listing = files.listFiles(path, True)
            while listing.hasNext():
                f = listing.next()
                found.append(f"{f.getPath().toString()} {f.getLen()} {f.getModificationTime()}")
        return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()

    def folder(self, name: str, **params) -> str:
        made_from = json.dumps([self.source, code_digest(), self.params, params], sort_keys=True)
        return f"{self.root}/{name}/{hashlib.sha256(made_from.encode()).hexdigest()}"

    def find(self, name: str, **params) -> str | None:
        """Where a complete result lies, if there is one."""
        folder = self.folder(name, **params)
        path, files = self._path(folder)
        if not files.exists(path):
            return None
        names = (s.getPath().getName() for s in files.listStatus(path))
        done = sorted(n for n in names if n.startswith(DONE))
        return f"{folder}/{done[0].removeprefix(DONE)}" if done else None

    def _made(self, name: str, save: Callable[[str], None], params: dict) -> str:
        place = self.find(name, **params)
        if place is None:
            folder, own = self.folder(name, **params), uuid.uuid4().hex
            save(f"{folder}/{own}")
            path, files = self._path(f"{folder}/{DONE}{own}")
            files.createNewFile(path)
            place = f"{folder}/{own}"
        return place

    def table(self, name: str, make: Callable[[], DataFrame], **params) -> DataFrame:
        """The stored table, made first if there is none."""
        place = self._made(name, lambda path: make().write.parquet(path), params)
        return self.spark.read.parquet(place)

    def model(
        self, name: str, fit: Callable[[], Model], save: Callable[[Model, str], None], load: Callable[[str], Model], **params
    ) -> Model:
        """The stored model, fitted and saved first if there is none; always read back."""
        return load(self._made(name, lambda path: save(fit(), path), params))

    def remove(self, name: str | None = None, **params) -> None:
        """Delete a result of this store's inputs, or with no name all stages of all inputs."""
        path, files = self._path(self.folder(name, **params) if name else self.root)
        files.delete(path, True)
