"""Results of stages kept between sessions under a hash of what they were made from."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .tables import exact_unions, file_system


@dataclass(frozen=True)
class Stage:
    """A stored result: its rows, the key it is stored under, and whether it was made now or found."""

    rows: DataFrame
    key: str
    made: bool


class StageStore:
    """Stages below a folder that all executors and sessions share: ``<root>/<name>/<key>``, the key being a hash of the stage's name, version and
    parameters and of the keys of its inputs. A stage whose key is there is read, else made and written; so a changed parameter makes its stage and those after it
    anew, and no other. A result that a killed session left half written has no mark of success and is made again. Two sessions that make one result at once write
    the same rows; the later one replaces the earlier."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.used: set[tuple[str, str]] = set()

    def source(self, path: str) -> Stage:
        """Parquet files as an input: their key changes with the name, size or time of any file."""
        files, where = file_system(self.spark, path)
        found, listed = files.listFiles(where, True), []
        while found.hasNext():
            f = found.next()
            listed.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        return Stage(self.spark.read.parquet(path), _hash(["source", sorted(listed)]), False)

    def stage(self, name: str, build: Callable[..., DataFrame], inputs: list[Stage], params: object = None, version: int = 1) -> Stage:
        """The rows of ``build(*rows of the inputs)``, which must follow from the inputs, the ``params`` (what JSON can tell, or a dataclass) and the ``version`` of its code."""
        exact_unions(self.spark)
        told = dataclasses.asdict(params) if dataclasses.is_dataclass(params) else params
        key = _hash([name, version, told, [i.key for i in inputs]])
        path = f"{self.root}/{name}/{key}"
        files, where = file_system(self.spark, f"{path}/_SUCCESS")
        made = not files.exists(where)
        if made:
            build(*[i.rows for i in inputs]).write.mode("overwrite").parquet(path)
        self.used.add((name, key))
        return Stage(self.spark.read.parquet(path), key, made)

    def prune(self, keep: int = 0) -> list[str]:
        """Delete results that this session hasn't used, but for the ``keep`` newest of each stage; returns what went. Nobody may be reading them."""
        files, where = file_system(self.spark, self.root)
        gone = []
        for stage in files.listStatus(where) if files.exists(where) else []:
            name = stage.getPath().getName()
            spare = [f for f in files.listStatus(stage.getPath()) if (name, f.getPath().getName()) not in self.used]
            spare.sort(key=lambda f: (-f.getModificationTime(), f.getPath().getName()))
            for f in spare[keep:]:
                files.delete(f.getPath(), True)
                gone.append(f"{name}/{f.getPath().getName()}")
        return sorted(gone)


def _hash(told: object) -> str:
    return hashlib.sha1(json.dumps(told, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]
