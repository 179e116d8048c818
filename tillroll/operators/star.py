"""The star join every report reads: lines ⋈ products ⋈ households.

Inner equi-joins on ``product_num`` and ``hshd_num``: a line whose product
or household is missing from its dimension vanishes from every metric.
Join strategy is the planner's: a dimension measured under the broadcast
threshold is broadcast, otherwise both sides shuffle on the key (AQE splits
a skewed key such as one giant household). The planner measures compressed
files, less the share of the columns that a report leaves out: millions of
curated rows pass for a few megabytes, though the driver hashes them row by
row. A dimension that its tables count (``RetailTables.rows``) above
``BROADCAST_ROWS`` is therefore merged. Households that the tables name
as heavy (``RetailTables.heavy``) stay spread over the tasks that scan their
lines, so a per-household aggregate on top is partial there. Catalyst prunes
the columns a report does not use, down to the Parquet scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tillroll.operators.heavy import split_join
from tillroll.sources.fixture import RetailTables


# Both dimensions at this size, broadcast with the labels of all series, leave 431 MB in use on the driver (measured).
BROADCAST_ROWS = 1_000_000


def _hint(t: RetailTables, table: str) -> str | None:
    return "merge" if t.rows.get(table, 0) > BROADCAST_ROWS else None


def star(t: RetailTables) -> DataFrame:
    lines = split_join(t.transactions, t.products, "product_num", "product_num", [], _hint(t, "products"))
    return split_join(lines, t.households, "hshd_num", "hshd_num", t.heavy.get("hshd_num", []), _hint(t, "households"))
