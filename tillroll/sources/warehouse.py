"""Curated retail tables on shared storage: replaced as a whole, extended by streams.

``refresh`` reads a full data drop (three extracts), cleans and validates
all of it before publishing anything: the raw files are parsed once, into a
staging folder with what was wrong with each row (``cleaning.checked``); the
counts of malformed records, bad keys and bad dates go into the commit and
the rows themselves into the ``quarantine`` table. It writes each table into a new version
folder, and only then publishes one commit naming that version
(``sources.commits``). ``append_lines`` adds a batch of cleaned lines the
same way. Readers resolve the newest refresh and the appends after it, so
they see either the old or the new data, never a half-written state; a job
that dies midway leaves its folder unreferenced. A refresh fails with
``CommitConflict`` when anything was published since it began, because it
would hide that change; an append takes the next free number instead. Every
step is a Spark job (task retries after an executor loss are safe: Spark's
output committer only publishes each file once). ``retain`` deletes folders
that only older commits name.

Layout choices for scale: transaction lines are range-partitioned and
sorted on (hshd_num, basket_num, product_num), so Parquet min/max
statistics let a household pull skip almost every file and row group, and
no single household or basket can force one giant output file.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tillroll import schema
from tillroll.operators import cleaning
from tillroll.operators.heavy import heavy_keys
from tillroll.sources import commits
from tillroll.sources.commits import CommitConflict
from tillroll.sources.csv_extracts import (
    HOUSEHOLDS_FILE,
    PRODUCTS_FILE,
    TRANSACTIONS_FILE,
    read_extract,
)
from tillroll.sources.fixture import RetailTables


class DuplicateKeyError(ValueError):
    """A dimension key appears more than once (it would multiply lines)."""


def _check_unique(df: DataFrame, key: str, table: str) -> None:
    dup = (df.where(F.col(key).isNotNull()).groupBy(key).count()
           .where(F.col("count") > 1).limit(5).collect())
    if dup:
        keys = [r[key] for r in dup]
        raise DuplicateKeyError(f"{table}: duplicate {key} values, e.g. {keys}")


def _write(df: DataFrame, path: str, name: str, mode: str = "error") -> int:
    """Write ``df`` and return its number of rows, counted on the way."""
    seen = Observation(name)
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode).parquet(path)
    return seen.get["rows"]


def _ranged(lines: DataFrame, files: int | None = None) -> DataFrame:
    keys = ("hshd_num", "basket_num", "product_num")
    ranged = lines.repartitionByRange(int(files), *keys) if files else lines.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys)


def _heavy(spark: SparkSession, path: str) -> dict[str, list]:
    """Keys with a large share of the written lines; two columns are read, once, and reports use them ever after."""
    return heavy_keys(spark.read.schema(schema.TRANSACTIONS).parquet(path), ["hshd_num", "basket_num"])


def write_version(spark: SparkSession, tables: RetailTables, warehouse: str,
                  version: str | None = None, validate: bool = True,
                  line_files: int | None = None, facts: dict | None = None) -> dict:
    """Write curated tables as a new version, then publish it.

    ``line_files`` fixes the number of transaction files (key ranges); by
    default AQE sizes the range partitions from the data. ``facts`` go into
    the commit as they are.
    """
    log = commits.commits(spark, warehouse)
    number = log[-1]["commit"] + 1 if log else 1
    if validate:
        _check_unique(tables.households, "hshd_num", "households")
        _check_unique(tables.products, "product_num", "products")
    version = version or str(int(time.time() * 1000))
    counts = {
        "households": _write(tables.households, f"{warehouse}/households/v={version}", "households"),
        "products": _write(tables.products, f"{warehouse}/products/v={version}", "products"),
        "transactions": _write(_ranged(tables.transactions, line_files),
                               f"{warehouse}/transactions/v={version}", "transactions")}
    commits.publish(spark, warehouse, number, {
        "kind": "refresh", "version": version, **counts, **(facts or {}),
        "heavy": _heavy(spark, f"{warehouse}/transactions/v={version}")})
    return {"version": version, "commit": number, **counts}


def _staged(spark: SparkSession, raw: DataFrame, table: str, path: str) -> tuple[DataFrame, dict]:
    """Checked rows, written once, and how many there were of each kind."""
    seen = Observation(table)
    counts = [F.count(F.lit(1)).alias("rows"), *(F.count_if(F.col("reason_") == r).alias(r) for r in cleaning.REASONS)]
    cleaning.checked(raw, table).observe(seen, *counts).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), dict(seen.get)


def _quarantine(rows: dict[str, DataFrame], facts: dict[str, dict], path: str) -> None:
    """Write the rows with a reason, table by table; tables without one are not read again."""
    for table, df in rows.items():
        if any(facts[table][r] for r in cleaning.REASONS):
            cleaning.rejected(df, table).write.mode("append").parquet(path)


def refresh(spark: SparkSession, landing: str, warehouse: str,
            version: str | None = None, lines: str | None = None) -> dict:
    """Full replace of the curated tables from a landing folder's three extracts (files or folders).

    ``lines`` names the transaction extract where it lies elsewhere.
    """
    version = version or str(int(time.time() * 1000))
    staging = f"{warehouse}/_staging/{version}"
    rows, facts = {}, {}
    try:
        for table, name in (("households", HOUSEHOLDS_FILE), ("products", PRODUCTS_FILE),
                            ("transactions", TRANSACTIONS_FILE)):
            path = lines if lines and table == "transactions" else f"{landing}/{name}"
            rows[table], facts[table] = _staged(spark, read_extract(spark, path), table, f"{staging}/{table}")
        tables = RetailTables(**{t: cleaning.kept(df, t) for t, df in rows.items()})
        _quarantine(rows, facts, f"{warehouse}/quarantine/v={version}")
        return write_version(spark, tables, warehouse, version, facts={"ingested": facts})
    finally:
        fs, path = commits.file_system(spark, staging)
        fs.delete(path, True)


def append_files(spark: SparkSession, files: list[str], warehouse: str, stream: str, batch: int) -> dict | None:
    """Add the lines of some extract files, whatever the order of their columns; see ``append_lines``."""
    if _published(commits.commits(spark, warehouse), stream, batch):
        return None
    staging = f"{warehouse}/_staging/{stream}-{batch}"
    try:
        rows, facts = _staged(spark, read_extract(spark, *files), "transactions", staging)
        _quarantine({"transactions": rows}, {"transactions": facts},
                    f"{warehouse}/quarantine/stream={stream}/batch={batch}")
        return append_lines(spark, cleaning.kept(rows, "transactions"), warehouse, stream, batch,
                            facts={"ingested": {"transactions": facts}})
    finally:
        fs, path = commits.file_system(spark, staging)
        fs.delete(path, True)


def quarantine(spark: SparkSession, warehouse: str) -> DataFrame:
    """Rows that were rejected, or kept with a bad value, by the current refresh and the appends after it."""
    names = [f"v={c['version']}" if c["kind"] == "refresh" else f"stream={c['stream']}/batch={c['batch']}"
             for c in current(spark, warehouse)]
    found = []
    for name in names:
        fs, path = commits.file_system(spark, f"{warehouse}/quarantine/{name}")
        if fs.exists(path):
            found.append(f"{warehouse}/quarantine/{name}")
    schema_ = "source string, reason string, kept boolean, file string, record string"
    return spark.read.schema(schema_).parquet(*found) if found else spark.createDataFrame([], schema_)


def _published(log: list[dict], stream: str, batch: int) -> bool:
    return any(c.get("stream") == stream and c.get("batch") == batch for c in log)


def append_lines(spark: SparkSession, lines: DataFrame, warehouse: str, stream: str, batch: int,
                 facts: dict | None = None) -> dict | None:
    """Add a batch of cleaned lines; None when this batch of the stream was added before.

    A replay first finds its commit in the log. One that died before its
    commit overwrites its own folder. A number taken by another writer is
    tried again with the next one: appends do not depend on what they follow.
    """
    folder = f"transactions/stream={stream}/batch={batch}"
    rows = None
    while True:
        log = commits.commits(spark, warehouse)
        if _published(log, stream, batch):
            return None
        if not commits.since_refresh(log):
            raise FileNotFoundError(f"no refresh was published under {warehouse}")
        if rows is None:
            rows = _write(_ranged(lines), f"{warehouse}/{folder}", "lines", mode="overwrite")
        try:
            return commits.publish(spark, warehouse, log[-1]["commit"] + 1,
                                   {"kind": "append", "stream": stream, "batch": batch, "folder": folder,
                                    "transactions": rows, **(facts or {}),
                                    "heavy": _heavy(spark, f"{warehouse}/{folder}")})
        except CommitConflict:
            continue


def current(spark: SparkSession, warehouse: str) -> list[dict]:
    """The newest refresh and the appends after it."""
    live = commits.since_refresh(commits.commits(spark, warehouse))
    if not live:
        raise FileNotFoundError(f"no published version under {warehouse}")
    return live


def current_version(spark: SparkSession, warehouse: str) -> str:
    """Version of the newest refresh."""
    return current(spark, warehouse)[0]["version"]


def line_folder(warehouse: str, commit: dict) -> str:
    """Folder of the transaction lines that a commit brought."""
    return f"{warehouse}/" + (commit["folder"] if commit["kind"] == "append" else f"transactions/v={commit['version']}")


def read_lines(spark: SparkSession, warehouse: str, live: list[dict]) -> DataFrame:
    """One scan over the lines of some commits."""
    return spark.read.schema(schema.TRANSACTIONS).parquet(*[line_folder(warehouse, c) for c in live])


def read_commits(spark: SparkSession, warehouse: str, live: list[dict], lines: list[dict]) -> RetailTables:
    """Dimensions of the refresh that leads ``live``, with the lines of the commits ``lines``."""
    v = live[0]["version"]
    return RetailTables(
        households=spark.read.schema(schema.HOUSEHOLDS).parquet(f"{warehouse}/households/v={v}"),
        products=spark.read.schema(schema.PRODUCTS).parquet(f"{warehouse}/products/v={v}"),
        transactions=read_lines(spark, warehouse, lines),
        heavy={c: sorted({k for x in lines for k in x.get("heavy", {}).get(c, [])}) for c in ("hshd_num", "basket_num")},
        rows={t: live[0][t] for t in ("households", "products") if t in live[0]})


def read_current(spark: SparkSession, warehouse: str) -> RetailTables:
    live = current(spark, warehouse)
    return read_commits(spark, warehouse, live, live)


def retain(spark: SparkSession, warehouse: str, versions: int = 2) -> list[str]:
    """Delete folders that only commits before the newest ``versions`` refreshes name; returns them.

    Readers that resolved an older refresh lose its files, so keep as many
    versions as a refresh may happen during the longest read. Folders that no
    commit names stay: their writer may still be at work.
    """
    log = commits.commits(spark, warehouse)
    starts = [i for i, c in enumerate(log) if c["kind"] == "refresh"]
    old = log[:starts[-versions]] if len(starts) > versions else []
    gone = []
    for c in old:
        folders = [line_folder(warehouse, c)]
        if c["kind"] == "refresh":
            folders += [f"{warehouse}/{t}/v={c['version']}" for t in ("households", "products", "quarantine")]
        else:
            folders.append(f"{warehouse}/quarantine/stream={c['stream']}/batch={c['batch']}")
        for folder in folders:
            fs, path = commits.file_system(spark, folder)
            if fs.exists(path):
                fs.delete(path, True)
                gone.append(folder)
    return gone
