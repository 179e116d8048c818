"""The warehouse's commit log: one small JSON file per published change.

Commit ``n`` is the file ``_manifest/<n>.json``. It is written under a
temporary name and renamed without overwriting, so of two writers that want
the same number exactly one succeeds (on file systems whose rename refuses an
existing target, such as HDFS; on a local disk the check comes just before
the rename). A reader sees a commit whole or not at all.

A ``refresh`` names the folders that replace everything before it, an
``append`` one more folder of transaction lines; an append names the stream
and batch that wrote it, so a replayed batch is recognised.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import SparkSession

MANIFEST = "_manifest"


class CommitConflict(RuntimeError):
    """Another writer published first."""


def file_system(spark: SparkSession, path: str):
    """Hadoop file system and path object of ``path``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def commits(spark: SparkSession, warehouse: str) -> list[dict]:
    """All commits in order. The log has one row per published change, however large the data is."""
    fs, folder = file_system(spark, f"{warehouse}/{MANIFEST}")
    if not fs.exists(folder):
        return []
    found = []
    for status in fs.listStatus(folder):
        path = status.getPath()
        if not path.getName().startswith(("_", ".")) and path.getName().endswith(".json"):
            stream = fs.open(path)
            try:
                found.append(json.loads(bytes(stream.readAllBytes()).decode()))
            finally:
                stream.close()
    return sorted(found, key=lambda c: c["commit"])


def publish(spark: SparkSession, warehouse: str, number: int, record: dict) -> dict:
    """Write commit ``number``; raises CommitConflict when it exists already."""
    jvm = spark._jvm
    fs, folder = file_system(spark, f"{warehouse}/{MANIFEST}")
    fs.mkdirs(folder)
    path = jvm.org.apache.hadoop.fs.Path
    draft = path(folder, f"_draft-{uuid.uuid4().hex}")
    record = record | {"commit": number, "published": int(time.time())}
    out = fs.create(draft, False)
    try:
        out.write(bytearray(json.dumps(record).encode()))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme()
                                                                  else fs.getUri(), spark._jsc.hadoopConfiguration())
    keep = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    keep[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(path(folder, f"{number:012d}.json")), keep)
    except Exception as e:  # py4j wraps the Java exception
        fs.delete(draft, False)
        if "FileAlreadyExists" in str(e):
            raise CommitConflict(f"commit {number} was published by another writer") from None
        raise
    return record


def since_refresh(log: list[dict]) -> list[dict]:
    """The newest refresh and the appends after it."""
    last = max((i for i, c in enumerate(log) if c["kind"] == "refresh"), default=None)
    return [] if last is None else log[last:]
