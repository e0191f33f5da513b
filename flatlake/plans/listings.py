"""Listing tables derived from the benchmark tables: one SQL text that Spark and DuckDB read alike.

`{orders}` and so on stand for the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LISTINGS = """
SELECT o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) AS price, CAST(nullif(o_custkey % 7, 6) AS INT) AS rooms,
  CASE WHEN o_orderkey % 11 <> 0 THEN CAST(20 + o_orderkey % 90 AS DOUBLE) END AS area,
  CASE WHEN o_orderkey % 13 <> 0 THEN CAST(1 + o_orderkey % 12 AS INT) END AS floor, CAST(1 + o_orderkey % 12 + o_custkey % 5 AS INT) AS total_floors,
  o_orderpriority AS source, concat('https://s.test/a/', CAST(o_orderkey - o_orderkey % 3 AS STRING)) AS url, c_name AS title,
  concat(n_name, ', ', c_mktsegment) AS address, CASE WHEN o_custkey % 4 <> 0 THEN n_name END AS district,
  43.0e0 + CAST(o_orderkey % 997 AS DOUBLE) / 2000e0 AS lat, 76.6e0 + CAST(o_custkey % 991 AS DOUBLE) / 1700e0 AS lon,
  CAST(o_orderdate AS DATE) AS date_published, CAST(o_orderkey % 100 AS INT) AS quality_score,
  CASE WHEN o_custkey % 5 = 0 THEN '' ELSE concat('8 707 ', CAST(1000000 + o_custkey % 5000 AS STRING)) END AS phone, o_custkey % 40 AS org
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
"""

#: Price histories: a part is a listing, its line items are the log.
HISTORY = """
SELECT l_partkey AS listing_key, CAST(floor(l_extendedprice) AS BIGINT) AS price, 'KZT' AS currency, CAST(l_shipdate AS TIMESTAMP) AS checked_at, l_orderkey * 10 + l_linenumber AS seq
FROM {lineitem}
"""

#: A small city in the same box as the listings.
DISTRICTS = [
    ("North", [(43.30, 76.60), (43.30, 76.90), (43.45, 76.95), (43.50, 76.75), (43.45, 76.60)]),
    ("Old Town", [(43.15, 76.70), (43.15, 76.95), (43.32, 76.98), (43.34, 76.80), (43.28, 76.68)]),
    ("Hills", [(43.00, 76.60), (43.00, 77.20), (43.10, 77.10), (43.18, 76.85), (43.08, 76.70)]),
    ("East", [(43.10, 76.95), (43.40, 76.95), (43.45, 77.19), (43.25, 77.05), (43.12, 77.15)]),
    ("Line", [(43.20, 76.60), (43.21, 76.61)]),
]
STATIONS = [
    ("Alatau", 43.2389, 76.8975), ("Bazaar", 43.2640, 76.9300), ("Circus", 43.2510, 76.8800), ("Depot", 43.3400, 76.9500), ("East Gate", 43.2300, 77.0500), ("Forest", 43.0700, 76.8300),
]
RATES = {"rub": 0.165, "usd": 0.00206}
TABLES = ("orders", "customer", "nation", "lineitem")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The DataFrame of one of the SQL texts."""
    names = [t for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events") if "{" + t + "}" in sql]
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names})


def duck(sql: str) -> str:
    """The same text for DuckDB."""
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        sql = sql.replace("{" + t + "}", t)
    return sql


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, LISTINGS)


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, HISTORY)
