"""Stored stages: tables named by a signature of all that they depend on."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from covermill.functions.signature import signature


class StageStore:
    """Parquet tables under ``root/<name>/<signature>``. A stage is read back only if its signature is the same and
    its write was finished; otherwise it is made anew. Signatures take the settings, the inputs' states and the
    signatures of the stages before (so a changed frozen map makes a new universe)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def path(self, name: str, payload: Any) -> str:
        return f"{self.root}/{name}/{signature(name, payload)}"

    def load(self, name: str, payload: Any) -> DataFrame | None:
        """The stored stage, or ``None`` where it is missing, unfinished or unreadable."""
        path = self.path(name, payload)
        fs, done = self._fs(f"{path}/_SUCCESS")
        if not fs.exists(done):
            return None
        try:
            return self.spark.read.parquet(path)
        except Exception:  # a damaged stage is as good as none
            return None

    def stage(self, name: str, payload: Any, make: Callable[[], DataFrame], rebuild: bool = False) -> DataFrame:
        if not rebuild and (found := self.load(name, payload)) is not None:
            return found
        path = self.path(name, payload)
        make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def remove(self, name: str, payload: Any) -> None:
        fs, at = self._fs(self.path(name, payload))
        fs.delete(at, True)
