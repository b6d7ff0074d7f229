"""Untidy projections of the given tables; the same SQL text runs in Spark and in the checking engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

DIRTY = {
    "dirty_orders": """
SELECT o_orderkey, o_custkey,
 CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS total_amount,
 CASE WHEN o_orderkey % 97 = 0 THEN o_totalprice * 1000 ELSE o_totalprice / 100 END AS payout_value,
 CASE WHEN o_orderkey % 13 = 0 THEN NULL
      WHEN o_orderkey % 5 = 0 THEN concat('  ', lower(o_orderpriority), chr(9))
      ELSE o_orderpriority END AS priority_label,
 CASE WHEN o_orderkey % 11 = 0 THEN 'n/a'
      ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS order_date_text,
 CASE WHEN o_orderkey % 19 = 0 THEN 'None' ELSE o_orderstatus END AS order_status,
 CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_orderdate END AS posted_at
FROM orders""",
    "dirty_money": """
SELECT o_orderkey,
 CASE WHEN o_orderkey % 29 = 0 THEN 'unknown'
      WHEN o_orderkey % 31 = 0 THEN '12d'
      WHEN o_orderkey % 3 = 0 THEN concat('($', t, ')')
      WHEN o_orderkey % 3 = 1 THEN concat(' $', t)
      ELSE t END AS amount_text
FROM (SELECT o_orderkey,
  concat(CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS STRING), ',',
         lpad(CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS STRING), 3, '0'), '.50') AS t
 FROM orders) q""",
    "dirty_customer": """
SELECT * FROM customer
UNION ALL SELECT * FROM customer WHERE c_custkey % 10 = 0
UNION ALL SELECT * FROM customer WHERE c_custkey % 50 = 0""",
    "numbered_customer": """
SELECT *, c_custkey * 10 + 1 AS row_id FROM customer
UNION ALL SELECT *, c_custkey * 10 + 2 FROM customer WHERE c_custkey % 10 = 0
UNION ALL SELECT *, c_custkey * 10 + 3 FROM customer WHERE c_custkey % 50 = 0""",
    "dirty_lineitem": """
SELECT l_orderkey, l_linenumber, l_quantity,
 CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_discount END AS l_discount,
 CASE WHEN l_orderkey % 101 = 0 THEN l_extendedprice * 50 ELSE l_extendedprice END AS l_extendedprice,
 l_returnflag, l_shipdate
FROM lineitem""",
    "dirty_profile": """
SELECT o_orderkey,
 CAST(o_orderkey % 40 AS STRING) AS size_label,
 CASE WHEN o_orderkey % 3 <> 0 THEN NULL ELSE o_totalprice END AS sparse_amount,
 'X' AS constant_flag,
 concat('2001-01-', lpad(CAST(o_orderkey % 28 + 1 AS STRING), 2, '0')) AS day_label,
 concat('$', CAST(o_orderkey % 45 AS STRING)) AS band_label,
 o_orderkey % 2 = 0 AS is_even,
 CASE WHEN o_orderkey % 4 = 0 THEN 'Denied' WHEN o_orderkey % 4 = 1 THEN 'denied late'
      WHEN o_orderkey % 9 = 0 THEN 'Approved' ELSE 'Denied' END AS claim_outcome,
 CASE WHEN o_orderkey % 2 = 0 THEN 0.0 WHEN o_orderkey % 50 = 1 THEN -1.0 ELSE o_totalprice END AS settlement_fee
FROM orders""",
}

SOURCE_OF = {
    "dirty_orders": "orders", "dirty_money": "orders", "dirty_customer": "customer", "numbered_customer": "customer", "dirty_lineitem": "lineitem",
    "dirty_profile": "orders",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or an untidy projection of one."""
    if name not in DIRTY:
        return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    source = SOURCE_OF[name]
    read(spark, sf_dir, source).createOrReplaceTempView(source)
    return spark.sql(DIRTY[name])


def with_dirty(names: str, body: str) -> str:
    """SQL text that starts with the untidy projections it needs."""
    return "WITH " + ",\n".join(f"{n} AS ({DIRTY[n]})" for n in names.split()) + "\n" + body
