"""Signatures of configurations and files, which name stored stages."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from typing import Any

from pyspark.sql import SparkSession


def plain(value: Any) -> Any:
    """A value as JSON can hold it: sets sorted, tuples as lists, dictionary keys as text, dataclasses as dictionaries."""
    if dataclasses.is_dataclass(value) and not isinstance(value, type):
        value = dataclasses.asdict(value)
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (set, frozenset)):
        return sorted((plain(v) for v in value), key=repr)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value if isinstance(value, (str, int, float, bool, type(None))) else str(value)


def signature(name: str, payload: Any) -> str:
    """sha1 over a name and a payload; the order of keys and set members does not matter."""
    text = json.dumps([name, plain(payload)], sort_keys=True, separators=(",", ":"))
    return hashlib.sha1(text.encode()).hexdigest()


def file_state(spark: SparkSession, path: str) -> dict:
    """Path and, by the session's file system, number, size and last change of the files and a hash of their names,
    sizes and times, so that a file changed inside a folder counts as well; a missing file has its own state."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return {"path": path, "missing": True}
    files, found = fs.listFiles(at, True), []
    while files.hasNext():
        one = files.next()
        found.append((one.getPath().toString(), one.getLen(), one.getModificationTime()))
    digest = hashlib.sha1(json.dumps(sorted(found)).encode()).hexdigest()
    return {"path": path, "files": len(found), "size": sum(f[1] for f in found), "changed": max((f[2] for f in found), default=0), "digest": digest}
