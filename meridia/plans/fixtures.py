"""The generated tables as the engine's model, in Spark and in SQL.

Tenants are regions, profiles are customers, the behavioural log is the events
table.  Each view has a SQL twin (a CTE) for the counterpart queries.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AT = dt.datetime(2024, 1, 20, 12, 30)
LATER = dt.datetime(2024, 1, 28)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with tenant and nation.  Nations are a fixed dimension of 25 rows."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    customer = table(spark, sf_dir, "customer")
    return customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("r"), F.col("n_regionkey")).alias("tenant_id"),
        F.concat(F.lit("p"), F.col("c_custkey")).alias("profile_id"),
        "c_custkey",
        "c_name",
        "n_name",
        "c_mktsegment",
        "c_acctbal",
    )


def behavior_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    homes = _homes(spark, sf_dir).select("tenant_id", "profile_id", "c_custkey")
    return events.join(homes, F.col("user_id") == F.col("c_custkey")).select(
        "tenant_id",
        "profile_id",
        F.concat(F.lit("e"), F.col("event_id")).alias("event_id"),
        F.col("event_type").alias("event_name"),
        F.col("ts").cast("timestamp").alias("occurred_at"),
        F.to_json(
            F.struct(F.get_json_object("props", "$.k").cast("long").alias("k"), F.col("value").alias("revenue"))
        ).alias("props"),
    )


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey"))
        .agg(F.count(F.lit(1)).alias("total_orders"), F.max("o_orderdate").alias("last_order"))
    )
    seen = (
        table(spark, sf_dir, "events")
        .groupBy("user_id")
        .agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    )
    joined = (
        _homes(spark, sf_dir)
        .join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
        .join(seen, F.col("c_custkey") == F.col("user_id"), "left")
    )
    tags = F.filter(
        F.array(F.when(F.col("c_acctbal") > 5000, "gold"), F.lower("c_mktsegment")), lambda x: x.isNotNull()
    )
    return joined.select(
        "tenant_id",
        "profile_id",
        F.concat(F.lit("customer_"), F.col("c_custkey")).alias("canonical_user_id"),
        F.to_json(
            F.struct(
                F.col("c_name").alias("name"),
                F.col("n_name").alias("country"),
                F.col("c_mktsegment").alias("segment"),
                F.col("c_acctbal").alias("balance"),
                F.concat(F.lit("user"), F.col("c_custkey"), F.lit("@example.com")).alias("email"),
            )
        ).alias("traits"),
        F.to_json(F.struct(F.col("total_orders"), tags.alias("tags"))).alias("computed_attributes"),
        F.col("first_seen").cast("timestamp").alias("first_seen_at"),
        F.col("last_seen").cast("timestamp").alias("last_seen_at"),
    )


#: CTEs ``log`` and ``prof``; timestamps stay without zone.
SQL = """
homes AS (
  SELECT 'r' || n_regionkey AS tenant_id, 'p' || c_custkey AS profile_id, c_custkey, c_name, n_name, c_mktsegment, c_acctbal
  FROM customer JOIN nation ON c_nationkey = n_nationkey
), log AS (
  SELECT tenant_id, profile_id, 'e' || event_id AS event_id, event_type AS event_name, ts AS occurred_at,
         cast(json_extract_string(props, '$.k') AS BIGINT) AS k, value AS revenue
  FROM events JOIN homes ON user_id = c_custkey
), ords AS (
  SELECT o_custkey, count(*) AS total_orders FROM orders GROUP BY o_custkey
), seen AS (
  SELECT user_id, min(ts) AS first_seen_at, max(ts) AS last_seen_at FROM events GROUP BY user_id
), prof AS (
  SELECT tenant_id, profile_id, 'customer_' || c_custkey AS canonical_user_id, c_custkey, c_name AS name, n_name AS country,
         c_mktsegment AS segment, c_acctbal AS balance, 'user' || c_custkey || '@example.com' AS email,
         total_orders, first_seen_at, last_seen_at
  FROM homes LEFT JOIN ords ON c_custkey = o_custkey LEFT JOIN seen ON c_custkey = user_id
)
"""

AT_SQL = "TIMESTAMP '2024-01-20 12:30:00'"
LATER_SQL = "TIMESTAMP '2024-01-28 00:00:00'"


def with_sql(body: str, extra: str = "") -> str:
    return f"WITH {SQL}{', ' + extra if extra else ''}\n{body}"


def ntz(df: DataFrame) -> DataFrame:
    """Timestamps without zone, as the counterpart queries return them."""
    cols = [
        F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name) if f.dataType.typeName() == "timestamp" else F.col(f"`{f.name}`")
        for f in df.schema
    ]
    return df.select(*cols)
