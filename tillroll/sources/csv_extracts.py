"""Raw CSV extracts (households, products, transaction lines).

Read as text only, mapped by name: the header of each delivered file is read
(its first line, nothing else), files with equal headers are read together
with that header as their schema, and the groups are put together by
normalised column name. Deliveries may therefore order their columns
differently, pad or case their names, or carry columns nobody reads. The
files are splittable, so Spark's file splits replace the reference's row
chunks.

A record with more fields than its header is malformed: it cannot be mapped
and goes to the rejects. A record with fewer fields lacks its last ones,
which read as missing.
"""

from __future__ import annotations

import csv
import io
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The file names a data drop delivers.
HOUSEHOLDS_FILE = "400_households.csv"
PRODUCTS_FILE = "400_products.csv"
TRANSACTIONS_FILE = "400_transactions.csv"

# Record texts that the reader could not map, and the file they stand in.
MALFORMED = "_malformed"
FILE = "_file"


def normalised(name: str) -> str:
    return name.strip().upper()


def _files(spark: SparkSession, path: str) -> list[str]:
    """Data files under a file or folder, at any depth."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found, it = [], fs.listFiles(root, True)
    base = fs.makeQualified(root).toString()
    while it.hasNext():
        file = it.next().getPath().toString()
        below = file[len(base):].strip("/").split("/")
        if not any(part.startswith(("_", ".")) for part in below):
            found.append(file)
    return sorted(found)


def _first_line(spark: SparkSession, path: str) -> str:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsc.hadoopConfiguration()
    stream = p.getFileSystem(conf).open(p)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(p)
        text = stream if codec is None else codec.createInputStream(stream)
        utf8 = jvm.java.nio.charset.StandardCharsets.UTF_8
        line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(text, utf8)).readLine()
    finally:
        stream.close()
    return (line or "").removeprefix("﻿")


def headers(spark: SparkSession, *paths: str) -> dict[str, tuple[str, ...]]:
    """Header fields of every file under the paths; a file without any line has none.

    One small read a file, many at a time: what grows is the number of files, not their size.
    """
    files = [f for path in paths for f in _files(spark, path)]
    with ThreadPoolExecutor(16) as pool:
        lines = list(pool.map(lambda f: _first_line(spark, f), files))
    return {f: tuple(next(csv.reader(io.StringIO(line)), ())) for f, line in zip(files, lines)}


def _reader(spark: SparkSession, header: tuple[str, ...]):
    """Reader of files with this header; column pruning is off, so that a record is judged by all its fields."""
    names = [f"c{i}" for i in range(len(header))]
    fields = T.StructType([T.StructField(n, T.StringType()) for n in [*names, MALFORMED]])
    return (spark.read.schema(fields).option("header", True).option("mode", "PERMISSIVE")
            .option("escape", '"')                     # the files double their quotes
            .option("enforceSchema", True)             # the names are ours, in the file's order
            .option("columnPruning", False).option("columnNameOfCorruptRecord", MALFORMED)), names


def _surplus(record: Column, fields: int) -> Column:
    """The record when it has more fields than the header, by its commas outside quotes."""
    bare = F.regexp_replace(record, '"[^"]*"', "")
    return F.when(F.size(F.split(bare, ",")) > fields, record)


def read_extract(spark: SparkSession, *paths: str) -> DataFrame:
    """All columns of the files under the paths as text, by normalised name, with ``_malformed`` and ``_file``."""
    groups: dict[tuple[str, ...], list[str]] = {}
    for file, header in headers(spark, *paths).items():
        if header:
            groups.setdefault(header, []).append(file)
    if not groups:
        raise FileNotFoundError(f"no CSV file with a header under {', '.join(paths)}")
    parts = []
    for header, files in sorted(groups.items()):
        labels = [normalised(h) for h in header]
        if len(set(labels)) < len(labels):
            raise ValueError(f"{files[0]}: the header repeats a column: {list(header)}")
        reader, names = _reader(spark, header)
        raw = reader.csv(files)
        parts.append(raw.select(*[F.col(n).alias(label) for n, label in zip(names, labels)],
                                _surplus(F.col(MALFORMED), len(names)).alias(MALFORMED),
                                F.col("_metadata.file_path").alias(FILE)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Normalised column names of a CSV file or folder (reads the header lines only)."""
    return sorted({normalised(h) for header in headers(spark, path).values() for h in header})


def stream_files(spark: SparkSession, folder: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The files that arrive in a landing folder, as a stream of their paths (contents are not read here)."""
    reader = spark.readStream.format("binaryFile").schema(
        "path string, modificationTime timestamp, length long, content binary")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    return reader.load(folder).select("path")
