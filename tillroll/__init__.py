"""tillroll: retail analytics (households, products, transaction lines) on Spark.

Sub-packages: ``sources`` (driver-table mapping, CSV extracts, warehouse,
JDBC), ``functions`` (column expressions), ``operators`` (cleaning, star
join, pull, KPIs, summaries, baskets, churn, median), ``ml`` (CLV, basket
value, churn model), ``plans`` (reports, query registry, SQL oracles) and
``streaming`` (incremental ingest).
"""

__version__ = "0.1.0"
