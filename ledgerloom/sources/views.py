"""The engine's tables as views over the test tables (a tree, a ledger, tasks, versions, gates)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import LEASE_SECONDS, add_seconds
from ledgerloom.sources.tables import table

NOW = "2024-01-15 12:00:00"
GATE_STEP = 7


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """region > nation > customer > order as domain > directory > directory > snapshot."""
    def level(name: str, key: str, prefix: str, parent, node_name, kind: str, lifecycle=F.lit("active")) -> DataFrame:
        return table(spark, d, name).select(F.concat(F.lit(prefix), F.col(key)).alias("node_id"), parent.alias("parent_id"), node_name.alias("name"), F.lit(kind).alias("kind"), lifecycle.alias("lifecycle"))

    ref = lambda prefix, key: F.concat(F.lit(prefix), F.col(key))
    return (
        level("region", "r_regionkey", "r", F.lit(None).cast("string"), F.col("r_name"), "domain")
        .union(level("nation", "n_nationkey", "n", ref("r", "n_regionkey"), F.col("n_name"), "directory"))
        .union(level("customer", "c_custkey", "c", ref("n", "c_nationkey"), F.col("c_name"), "directory"))
        .union(level("orders", "o_orderkey", "o", ref("c", "o_custkey"), ref("order-", "o_orderkey"), "snapshot", F.when(F.col("o_orderstatus") == "P", "deleted").otherwise("active")))
    )


def ledger(spark: SparkSession, d: str) -> DataFrame:
    """events as requests in the order of acceptance."""
    # What an event's type stands for.
    operation = F.when(F.col("event_type") == "signup", "snapshot.create").when(F.col("event_type") == "error", "directory.delete").when(F.col("event_type") == "purchase", "conflict.resolve").when(F.col("event_type") == "view", "snapshot.read").otherwise("snapshot.patch")
    return table(spark, d, "events").select((F.col("event_id") + 1).alias("event_seq"), F.concat(F.lit("req-"), F.lpad(F.col("event_id").cast("string"), 8, "0")).alias("request_id"), F.concat(F.lit("u"), "user_id").alias("node_id"), operation.alias("operation"), "event_type", F.col("props").alias("payload"), "value", F.col("ts").alias("created_at"))


def tasks(spark: SparkSession, d: str) -> DataFrame:
    # What an event's type stands for.
    state = F.when(F.col("event_type") == "signup", "completed").when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "pending").when(F.col("event_type") == "purchase", "processing").otherwise("needs_attention")
    rows = ledger(spark, d)
    return rows.select(F.concat(F.lit("tsk-"), "request_id").alias("task_id"), "event_seq", "request_id", "node_id", state.alias("state"), F.pmod("event_seq", F.lit(6)).cast("int").alias("failure_count"), F.col("created_at").alias("available_at"), add_seconds(F.col("created_at"), LEASE_SECONDS).alias("lease_until"), F.concat(F.lit("w"), F.col("event_seq") % 3).alias("lease_owner"), (F.col("event_seq") % 4).alias("lease_epoch"))


def effects(spark: SparkSession, d: str) -> DataFrame:
    """What became of each request."""
    # What an event's type stands for.
    effect = F.when(F.col("event_type") == "signup", "applied").when(F.col("event_type") == "view", "applied_noop").when(F.col("event_type") == "click", "pending").when(F.col("event_type") == "purchase", "conflict").otherwise("needs_attention")
    effect = F.when(F.col("value") > 100, "cancelled").otherwise(effect)
    return ledger(spark, d).select("request_id", "event_seq", "node_id", "operation", effect.alias("effect"), F.col("value") > 200, F.when((F.col("event_seq") % 2 == 0) & (F.col("value") > 100), F.concat(F.lit("sup-"), "request_id")).alias("superseded_by")).toDF("request_id", "event_seq", "node_id", "operation", "effect", "target_deleted", "superseded_by")


def dependencies(spark: SparkSession, d: str) -> DataFrame:
    """Each request depends on the one before it of the same node."""
    before = F.lag("request_id").over(Window.partitionBy("node_id").orderBy("event_seq"))
    return ledger(spark, d).select("request_id", "event_seq", F.lit(0).alias("pos"), before.alias("depends_on")).where("depends_on IS NOT NULL")


def versions(spark: SparkSession, d: str) -> DataFrame:
    """Turns of a conversation as versions of a snapshot."""
    return table(spark, d, "conversations").select(F.col("conv_id").alias("node_id"), (F.col("turn") + 1).alias("revision"), F.col("text").alias("content_json"), F.concat_ws("-", F.lit("req"), "conv_id", "turn").alias("request_id"))


def gates(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh nation is being deleted."""
    return table(spark, d, "nation").where(F.col("n_nationkey") % GATE_STEP == 0).select(F.concat(F.lit("n"), "n_nationkey").alias("node_id"))


#: The same views in SQL, for the oracles.
SQL = {
    "nodes": """nodes AS (
  SELECT 'r' || r_regionkey AS node_id, CAST(NULL AS VARCHAR) AS parent_id, r_name AS name, 'domain' AS kind, 'active' AS lifecycle FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, 'directory', 'active' FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name, 'directory', 'active' FROM customer
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'order-' || o_orderkey, 'snapshot', CASE WHEN o_orderstatus = 'P' THEN 'deleted' ELSE 'active' END FROM orders)""",
    "gates": "gates AS (SELECT 'n' || n_nationkey AS node_id FROM nation WHERE n_nationkey % 7 = 0)",
    "ledger": """ledger AS (
  SELECT event_id + 1 AS event_seq, 'req-' || lpad(CAST(event_id AS VARCHAR), 8, '0') AS request_id, 'u' || user_id AS node_id, event_type, props AS payload, value, ts AS created_at,
         CASE event_type WHEN 'signup' THEN 'snapshot.create' WHEN 'error' THEN 'directory.delete' WHEN 'purchase' THEN 'conflict.resolve' WHEN 'view' THEN 'snapshot.read' ELSE 'snapshot.patch' END AS operation
  FROM events)""",
    "tasks": """tasks AS (
  SELECT 'tsk-' || request_id AS task_id, event_seq, request_id, node_id, CAST(event_seq % 6 AS INTEGER) AS failure_count, created_at AS available_at, created_at + INTERVAL 300 SECOND AS lease_until, 'w' || (event_seq % 3) AS lease_owner, event_seq % 4 AS lease_epoch,
         CASE event_type WHEN 'signup' THEN 'completed' WHEN 'view' THEN 'queued' WHEN 'click' THEN 'pending' WHEN 'purchase' THEN 'processing' ELSE 'needs_attention' END AS state
  FROM ledger)""",
    "effects": """effects AS (
  SELECT request_id, event_seq, node_id, operation, value > 200 AS target_deleted, CASE WHEN event_seq % 2 = 0 AND value > 100 THEN 'sup-' || request_id END AS superseded_by,
         CASE WHEN value > 100 THEN 'cancelled' ELSE CASE event_type WHEN 'signup' THEN 'applied' WHEN 'view' THEN 'applied_noop' WHEN 'click' THEN 'pending' WHEN 'purchase' THEN 'conflict' ELSE 'needs_attention' END END AS effect
  FROM ledger)""",
    "dependencies": "dependencies AS (SELECT * FROM (SELECT request_id, event_seq, lag(request_id) OVER (PARTITION BY node_id ORDER BY event_seq) AS depends_on FROM ledger) WHERE depends_on IS NOT NULL)",
    "versions": "versions AS (SELECT conv_id AS node_id, turn + 1 AS revision, text AS content_json, 'req-' || conv_id || '-' || turn AS request_id FROM conversations)",
}


def with_views(*names: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(SQL[n] for n in names)
