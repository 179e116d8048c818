"""SQL access: publish the curated tables and the star as temporary views.

Analysts who write SQL against Households / Products / Transactions keep
doing so with ``spark.sql``; the views are logical plans, so Catalyst still
prunes columns and pushes filters into the underlying scans.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from tillroll.operators.star import star
from tillroll.sources.fixture import RetailTables


def register_views(spark: SparkSession, t: RetailTables, prefix: str = "") -> list[str]:
    """Create/replace ``households``, ``products``, ``transactions`` and
    ``star`` temp views (optionally prefixed); returns the view names."""
    views = {
        "households": t.households,
        "products": t.products,
        "transactions": t.transactions,
        "star": star(t),
    }
    names = []
    for name, df in views.items():
        df.createOrReplaceTempView(prefix + name)
        names.append(prefix + name)
    return names
