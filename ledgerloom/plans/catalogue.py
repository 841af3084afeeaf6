"""The queries over the test tables, each beside the SQL that says what it must return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as fn
from ledgerloom.operators import reads, reconcile, rollups, tree, work
from ledgerloom.plans import accept, fold
from ledgerloom.session import work_dir
from ledgerloom.sources import tables, views
from ledgerloom.sources.views import NOW, with_views
from ledgerloom.streaming import project

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# --- the tree -----------------------------------------------------------------

_BELOW = "below AS (SELECT node_id, 0 AS depth FROM nodes WHERE node_id = '{root}' UNION ALL SELECT n.node_id, b.depth + 1 FROM below b JOIN nodes n ON n.parent_id = b.node_id)"
_UP = "up AS (SELECT node_id, node_id AS ancestor_id, parent_id AS next, 0 AS distance FROM nodes UNION ALL SELECT u.node_id, n.node_id, n.parent_id, u.distance + 1 FROM up u JOIN nodes n ON n.node_id = u.next)"
_PATHS = "paths AS (SELECT node_id, name AS path, 1 AS depth FROM nodes WHERE parent_id IS NULL AND lifecycle = 'active' UNION ALL SELECT n.node_id, p.path || '/' || n.name, p.depth + 1 FROM paths p JOIN nodes n ON n.parent_id = p.node_id WHERE n.lifecycle = 'active')"


@query(with_views("nodes", recursive=True) + ",\n" + _BELOW.format(root="n7") + """
SELECT b.node_id, n.parent_id, n.name, n.kind, n.lifecycle, b.depth FROM below b JOIN nodes n ON n.node_id = b.node_id WHERE n.lifecycle <> 'deleted' ORDER BY b.node_id LIMIT 51""")
def tree_subtree(spark: SparkSession, d: str) -> DataFrame:
    return reads.query_subtree(views.nodes(spark, d), "n7")


@query(with_views("nodes", recursive=True) + ",\n" + _UP + "\nSELECT node_id, ancestor_id, distance FROM up")
def tree_ancestors(spark: SparkSession, d: str) -> DataFrame:
    return tree.closure(views.nodes(spark, d))


@query(with_views("nodes", recursive=True) + ",\n" + _UP + "\nSELECT ancestor_id AS node_id, distance FROM up WHERE node_id = 'c11'")
def tree_chain(spark: SparkSession, d: str) -> DataFrame:
    return tree.ancestors_of(views.nodes(spark, d), "c11")


@query(with_views("nodes", recursive=True) + ",\n" + _PATHS + "\nSELECT node_id, path, depth FROM paths")
def tree_paths(spark: SparkSession, d: str) -> DataFrame:
    return tree.paths(views.nodes(spark, d))


@query(with_views("nodes", recursive=True) + ",\n" + _PATHS + """,
wanted AS (SELECT r_name || '/' || n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'nowhere/' || n_name FROM nation UNION ALL SELECT ''),
hits AS (SELECT w.path, count(p.node_id) AS matches, min(p.node_id) AS node_id FROM wanted w LEFT JOIN paths p ON p.path = w.path GROUP BY w.path)
SELECT h.path, CASE WHEN matches = 1 THEN h.node_id END AS node_id, CASE WHEN h.path = '' THEN 'root' ELSE n.kind END AS kind, matches FROM hits h LEFT JOIN nodes n ON n.node_id = h.node_id AND matches = 1""")
def tree_resolve(spark: SparkSession, d: str) -> DataFrame:
    nation, region = tables.table(spark, d, "nation"), tables.table(spark, d, "region")
    real = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws("/", "r_name", "n_name").alias("path"))
    wanted = real.union(nation.select(F.concat(F.lit("nowhere/"), "n_name"))).union(nation.limit(1).select(F.lit("")))
    return tree.resolve(views.nodes(spark, d), wanted)


@query(with_views("nodes", "gates", recursive=True) + ",\n" + _UP + """,
stops AS (SELECT node_id FROM nodes WHERE lifecycle <> 'active' UNION SELECT node_id FROM gates)
SELECT u.node_id, arg_min(u.ancestor_id, u.distance) AS blocked_by, min(u.distance) AS distance FROM up u JOIN stops s ON s.node_id = u.ancestor_id GROUP BY u.node_id""")
def tree_blocked(spark: SparkSession, d: str) -> DataFrame:
    return tree.blocked(views.nodes(spark, d), views.gates(spark, d))


@query(with_views("nodes", recursive=True) + ",\n" + _UP + """,
moves AS (SELECT 'n' || n_nationkey AS node_id, 'c' || c_custkey AS new_parent_id FROM customer JOIN nation ON c_custkey % 25 = n_nationkey)
SELECT m.node_id, m.new_parent_id, EXISTS (SELECT 1 FROM up u WHERE u.node_id = m.new_parent_id AND u.ancestor_id = m.node_id) AS cycle FROM moves m""")
def tree_cycle_check(spark: SparkSession, d: str) -> DataFrame:
    moves = tables.table(spark, d, "customer").join(tables.table(spark, d, "nation"), F.col("c_custkey") % 25 == F.col("n_nationkey")).select(F.concat(F.lit("n"), "n_nationkey").alias("node_id"), F.concat(F.lit("c"), "c_custkey").alias("new_parent_id"))
    return tree.move_cycles(views.nodes(spark, d), moves)


_SAME_NAMES = "parts AS (SELECT CAST(p_partkey AS VARCHAR) AS node_id, p_brand AS parent_id, p_type || '-' || p_size AS name, CASE WHEN p_partkey % 11 = 0 THEN 'deleted' WHEN p_partkey % 11 = 1 THEN 'deleting' ELSE 'active' END AS lifecycle FROM part)"


def _parts(spark: SparkSession, d: str) -> DataFrame:
    lifecycle = F.when(F.col("p_partkey") % 11 == 0, "deleted").when(F.col("p_partkey") % 11 == 1, "deleting").otherwise("active")
    return tables.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("node_id"), F.col("p_brand").alias("parent_id"), F.concat_ws("-", "p_type", F.col("p_size").cast("string")).alias("name"), lifecycle.alias("lifecycle"))


@query(f"WITH {_SAME_NAMES} SELECT parent_id, name, count(*) AS n FROM parts WHERE lifecycle <> 'deleted' GROUP BY parent_id, name HAVING count(*) > 1")
def sibling_collisions(spark: SparkSession, d: str) -> DataFrame:
    return tree.sibling_collisions(_parts(spark, d))


@query(f"""WITH {_SAME_NAMES}, wanted AS (SELECT parent_id, name, node_id AS except_id FROM parts)
SELECT parent_id, name, except_id FROM wanted w WHERE EXISTS (SELECT 1 FROM parts p WHERE p.parent_id IS NOT DISTINCT FROM w.parent_id AND p.name = w.name AND p.lifecycle <> 'deleted' AND p.node_id <> w.except_id)""")
def name_taken(spark: SparkSession, d: str) -> DataFrame:
    parts = _parts(spark, d)
    return tree.name_taken(parts, parts.select("parent_id", "name", F.col("node_id").alias("except_id")))


# --- pages and lookups ----------------------------------------------------------


@query("SELECT 'ledgerloom' AS product, 'tree-snapshots' AS protocol, 1 AS api_version, md5('epoch') AS workspace_epoch, CAST(count(*) AS BIGINT) AS catalog_revision FROM events WHERE event_type IN ('signup', 'error')")
def capabilities(spark: SparkSession, d: str) -> DataFrame:
    meta = tables.table(spark, d, "events").where(F.col("event_type").isin("signup", "error")).agg(F.count("*").alias("catalog_revision")).withColumn("workspace_epoch", F.md5(F.lit("epoch").cast("binary")))
    return reads.capabilities(meta, "ledgerloom", "tree-snapshots", 1)


@query(with_views("nodes") + " SELECT node_id, name, kind FROM nodes WHERE parent_id = 'n3' AND lifecycle = 'active' ORDER BY name LIMIT 10 OFFSET 10")
def dir_list_page(spark: SparkSession, d: str) -> DataFrame:
    return reads.children(views.nodes(spark, d), "n3", 10, page=1)


@query(with_views("nodes") + " SELECT node_id, name, kind FROM nodes WHERE parent_id = 'n3' AND lifecycle = 'active' AND name > 'Customer#000000050' ORDER BY name LIMIT 20")
def dir_list_keyset(spark: SparkSession, d: str) -> DataFrame:
    return reads.children(views.nodes(spark, d), "n3", 0, after="Customer#000000050")


@query(with_views("nodes") + " SELECT node_id, name, kind FROM nodes WHERE parent_id IS NULL AND lifecycle = 'active' ORDER BY name LIMIT 1")
def dir_list_root(spark: SparkSession, d: str) -> DataFrame:
    return reads.children(views.nodes(spark, d), None, -5)


@query(with_views("nodes", recursive=True) + ",\n" + _BELOW.format(root="n14") + " SELECT node_id FROM below ORDER BY node_id LIMIT 50 OFFSET 50")
def manifest_page(spark: SparkSession, d: str) -> DataFrame:
    return reads.manifest(views.nodes(spark, d), "n14", 50, 99)


@query(with_views("versions") + " SELECT node_id, max(revision) AS revision, arg_max(content_json, revision) AS content_json FROM versions GROUP BY node_id")
def latest_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return reads.latest_snapshots(views.versions(spark, d))


@query(with_views("versions") + " SELECT revision, request_id, CAST(strlen(content_json) AS BIGINT) AS bytes FROM versions WHERE node_id = 3 ORDER BY revision DESC LIMIT 5")
def history_page(spark: SparkSession, d: str) -> DataFrame:
    return reads.history(views.versions(spark, d), 3, 5)


@query(with_views("versions") + " SELECT node_id, count(*) AS versions, CAST(sum(strlen(content_json)) AS BIGINT) AS bytes FROM versions GROUP BY node_id")
def history_bytes(spark: SparkSession, d: str) -> DataFrame:
    return views.versions(spark, d).groupBy("node_id").agg(F.count("*").alias("versions"), F.sum(fn.bytes_of(F.col("content_json"))).alias("bytes"))


@query(with_views("versions", "ledger", "effects") + """, snaps AS (SELECT node_id, max(revision) AS revision FROM versions GROUP BY node_id),
required AS (SELECT DISTINCT conv_id AS node_id, 'req-' || lpad(CAST(conv_id AS VARCHAR), 8, '0') AS request_id FROM conversations WHERE conv_id % 2 = 0)
SELECT s.node_id, s.revision, r.request_id, e.effect, r.request_id IS NOT NULL AND coalesce(e.effect NOT IN ('applied', 'applied_noop'), true) AS stale
FROM snaps s LEFT JOIN required r ON r.node_id = s.node_id LEFT JOIN effects e ON e.request_id = r.request_id""")
def snapshot_read(spark: SparkSession, d: str) -> DataFrame:
    required = views.versions(spark, d).where("node_id % 2 = 0").select("node_id", F.concat(F.lit("req-"), F.lpad(F.col("node_id").cast("string"), 8, "0")).alias("request_id")).distinct()
    return reads.read_snapshots(reads.latest_snapshots(views.versions(spark, d)), views.effects(spark, d), required)


# --- requests, dependencies, tasks ----------------------------------------------

_DEPENDENCY = """states AS (
  SELECT d.request_id, CASE WHEN e.request_id IS NULL THEN 'dependency_missing' WHEN e.effect = 'conflict' THEN 'dependency_replan_required' WHEN e.effect = 'needs_attention' THEN 'dependency_blocked'
    WHEN (e.effect = 'cancelled' OR e.target_deleted) AND e.superseded_by IS NOT NULL THEN 'dependency_superseded' WHEN e.effect = 'cancelled' OR e.target_deleted THEN 'dependency_cancelled'
    WHEN e.effect NOT IN ('applied', 'applied_noop') THEN 'dependency_pending' ELSE 'ready' END AS dependency
  FROM dependencies d LEFT JOIN effects e ON e.request_id = d.depends_on)"""
_DISPLAY = "CASE WHEN target_deleted THEN 'cancelled' WHEN effect IN ('applied', 'applied_noop') THEN 'projected' WHEN effect IN ('conflict', 'needs_attention', 'cancelled') THEN effect ELSE 'd1_committed' END"


def _states(spark: SparkSession, d: str) -> DataFrame:
    return work.dependency_states(views.dependencies(spark, d), views.effects(spark, d))


@query(with_views("ledger", "effects", "dependencies") + ",\n" + _DEPENDENCY + " SELECT request_id, dependency FROM states")
def dependency_state(spark: SparkSession, d: str) -> DataFrame:
    return _states(spark, d)


@query("""WITH RECURSIVE edges AS (SELECT 'q' || o_orderkey AS a, 'q' || CASE WHEN o_orderkey % 10 = 9 AND o_orderkey % 30 < 10 THEN o_orderkey - 9 ELSE o_orderkey + 1 END AS b FROM orders WHERE o_orderkey % 10 <> 9 OR o_orderkey % 30 < 10),
reach AS (SELECT a AS request_id, b FROM edges UNION SELECT r.request_id, e.b FROM reach r JOIN edges e ON e.a = r.b)
SELECT request_id FROM reach GROUP BY request_id HAVING count(*) > 32 OR max(CASE WHEN b = request_id THEN 1 ELSE 0 END) = 1""")
def dependency_cycle(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    closes = (k % 10 == 9) & (k % 30 < 10)
    edges = tables.table(spark, d, "orders").where((k % 10 != 9) | closes).select(F.concat(F.lit("q"), k).alias("request_id"), F.concat(F.lit("q"), F.when(closes, k - 9).otherwise(k + 1)).alias("depends_on"))
    return work.dependency_cycles(edges)


@query(with_views("ledger", "effects", "dependencies") + ",\n" + _DEPENDENCY + f" SELECT e.request_id, e.event_seq, e.operation, e.effect, coalesce(s.dependency, 'ready') AS dependency, {_DISPLAY} AS display FROM effects e LEFT JOIN states s ON s.request_id = e.request_id")
def request_status(spark: SparkSession, d: str) -> DataFrame:
    return reads.request_status(views.effects(spark, d), views.ledger(spark, d), _states(spark, d))


@query(with_views("ledger", "tasks") + " SELECT t.task_id, t.event_seq, t.state, t.failure_count, l.operation FROM tasks t LEFT JOIN ledger l ON l.event_seq = t.event_seq")
def task_status(spark: SparkSession, d: str) -> DataFrame:
    return reads.task_status(views.tasks(spark, d), views.ledger(spark, d))


@query(with_views("ledger", "effects") + " SELECT e.request_id AS conflict_id, e.node_id, l.created_at, CASE WHEN e.event_seq % 3 = 0 THEN 'resolved' ELSE 'open' END AS status FROM effects e JOIN ledger l ON l.request_id = e.request_id WHERE e.effect = 'conflict' AND e.event_seq % 3 <> 0 AND e.node_id = 'u7'")
def conflict_list(spark: SparkSession, d: str) -> DataFrame:
    rows = views.effects(spark, d).where("effect = 'conflict'").join(views.ledger(spark, d).select("request_id", "created_at"), "request_id")
    return reads.conflicts(rows.select(F.col("request_id").alias("conflict_id"), "node_id", "created_at", F.when(F.col("event_seq") % 3 == 0, "resolved").otherwise("open").alias("status")), node="u7")


@query(with_views("ledger", "effects") + f" SELECT {_DISPLAY} AS effect, count(*) AS n FROM effects GROUP BY 1")
def effect_counts(spark: SparkSession, d: str) -> DataFrame:
    return reads.effect_counts(views.effects(spark, d), fn.display_for(F.lit("cloud_acknowledged"), F.col("effect"), F.col("target_deleted")))


@query("""SELECT l AS local, e AS effect, CASE WHEN l <> 'cloud_acknowledged' THEN l WHEN e IN ('applied', 'applied_noop') THEN 'projected' WHEN e IN ('conflict', 'needs_attention', 'cancelled') THEN e ELSE 'd1_committed' END AS display
FROM (SELECT unnest(['local_pending', 'sending', 'cloud_acknowledged', 'waiting_dependency', 'delivery_blocked', 'cancelled']) AS l), (SELECT unnest(['pending', 'applied', 'applied_noop', 'conflict', 'cancelled', 'needs_attention', NULL]) AS e)""")
def display_matrix(spark: SparkSession, d: str) -> DataFrame:
    grid = spark.range(1).select(F.explode(F.array(*map(F.lit, fn.LOCAL_STATUSES))).alias("local")).select("local", F.explode(F.array(*map(F.lit, fn.EFFECTS), F.lit(None))).alias("effect"))
    return grid.select("local", "effect", fn.display_status(F.col("local"), F.col("effect")).alias("display"))


@query(with_views("ledger", "tasks") + " SELECT t.task_id, EXISTS (SELECT 1 FROM tasks p WHERE p.node_id = t.node_id AND p.event_seq < t.event_seq AND p.state NOT IN ('completed', 'cancelled')) AS blocked FROM tasks t")
def predecessor_pending(spark: SparkSession, d: str) -> DataFrame:
    return work.predecessors(views.tasks(spark, d))


_DUE = f"due AS (SELECT * FROM tasks WHERE (state IN ('pending', 'queued') AND available_at <= TIMESTAMP '{NOW}') OR (state = 'processing' AND lease_until <= TIMESTAMP '{NOW}'))"


@query(with_views("ledger", "tasks") + f", {_DUE} SELECT task_id, event_seq, state FROM due")
def due_tasks(spark: SparkSession, d: str) -> DataFrame:
    return work.due(views.tasks(spark, d), _now()).select("task_id", "event_seq", "state")


@query(with_views("ledger", "tasks", "effects", "dependencies") + ",\n" + _DEPENDENCY + f""", {_DUE}
SELECT t.task_id, t.event_seq, t.node_id, t.state FROM due t LEFT JOIN states s ON s.request_id = t.request_id
WHERE coalesce(s.dependency, 'ready') = 'ready' AND NOT EXISTS (SELECT 1 FROM tasks p WHERE p.node_id = t.node_id AND p.event_seq < t.event_seq AND p.state NOT IN ('completed', 'cancelled'))""")
def first_ready(spark: SparkSession, d: str) -> DataFrame:
    return work.claimable(views.tasks(spark, d), _states(spark, d), _now())


@query(with_views("ledger", "tasks") + f" SELECT task_id, event_seq FROM tasks WHERE state = 'processing' AND lease_until < TIMESTAMP '{NOW}'")
def expired_leases(spark: SparkSession, d: str) -> DataFrame:
    return work.expired(views.tasks(spark, d), _now()).select("task_id", "event_seq")


@query(with_views("ledger", "tasks") + f""", failed AS (SELECT task_id, failure_count + 1 AS n FROM tasks)
SELECT task_id, CAST(n AS INTEGER) AS failure_count, CASE WHEN n >= 5 THEN 'needs_attention' ELSE 'pending' END AS state, CASE WHEN n < 5 THEN CAST(30 * (1 << (n - 1)) AS INTEGER) END AS wait_seconds,
       CASE WHEN n < 5 THEN TIMESTAMP '{NOW}' + to_seconds(30 * (1 << (n - 1))) END AS available_at FROM failed""")
def backoff_schedule(spark: SparkSession, d: str) -> DataFrame:
    return work.after_failure(views.tasks(spark, d), _now())


@query(with_views("ledger", "tasks", "effects") + f""" SELECT t.task_id, t.event_seq, t.request_id, t.node_id, 'pending' AS state, CAST(0 AS INTEGER) AS failure_count, TIMESTAMP '{NOW}' AS available_at, CAST(NULL AS TIMESTAMP) AS lease_until, CAST(NULL AS VARCHAR) AS lease_owner, t.lease_epoch + 1 AS lease_epoch, 'by hand' AS last_error, 'pending' AS effect
FROM tasks t JOIN effects e ON e.request_id = t.request_id WHERE t.state = 'needs_attention' AND e.effect = 'needs_attention' AND t.event_seq % 2 = 0""")
def task_retry(spark: SparkSession, d: str) -> DataFrame:
    tasks = views.tasks(spark, d)
    return work.retried(tasks, views.effects(spark, d), tasks.where("event_seq % 2 = 0").select("task_id"), _now(), "by hand")


@query(with_views("ledger", "tasks", "effects") + """ SELECT w.task_id, 'task_not_retryable' AS code FROM (SELECT task_id FROM tasks WHERE event_seq % 3 = 0 UNION ALL SELECT 'tsk-unknown') w
WHERE (SELECT count(*) FROM tasks t JOIN effects e ON e.request_id = t.request_id WHERE t.task_id = w.task_id AND t.state = 'needs_attention' AND e.effect = 'needs_attention') <> 1""")
def retry_guard(spark: SparkSession, d: str) -> DataFrame:
    tasks = views.tasks(spark, d)
    unknown = tasks.sparkSession.createDataFrame([("tsk-unknown",)], "task_id string")
    return work.refused_retries(tasks, views.effects(spark, d), tasks.where("event_seq % 3 = 0").select("task_id").union(unknown))


@query(with_views("ledger", "effects", "dependencies") + """, own AS (SELECT d.*, 'e' || (event_seq % 7 // 6) AS epoch FROM dependencies d), eff AS (SELECT *, CASE WHEN event_seq % 5 > 0 THEN 'e' || (event_seq % 3 // 2) END AS its_epoch FROM effects)
SELECT d.request_id, CASE WHEN d.epoch <> 'e0' THEN 'workspace_epoch_mismatch' WHEN e.request_id IS NULL THEN 'dependency_missing' WHEN e.its_epoch <> d.epoch THEN 'dependency_epoch_mismatch' WHEN e.effect = 'conflict' THEN 'dependency_replan_required'
  WHEN e.effect = 'needs_attention' THEN 'dependency_blocked' WHEN (e.effect = 'cancelled' OR e.target_deleted) AND e.superseded_by IS NOT NULL THEN 'dependency_superseded' WHEN e.effect = 'cancelled' OR e.target_deleted THEN 'dependency_cancelled'
  WHEN e.effect NOT IN ('applied', 'applied_noop') THEN 'dependency_pending' ELSE 'ready' END AS dependency FROM own d LEFT JOIN eff e ON e.request_id = d.depends_on""")
def dependency_epochs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_seq")
    own = views.dependencies(spark, d).withColumn("workspace_epoch", F.concat(F.lit("e"), F.floor(k % 7 / 6)))
    effects = views.effects(spark, d).withColumn("workspace_epoch", F.when(k % 5 > 0, F.concat(F.lit("e"), F.floor(k % 3 / 2))))
    return work.dependency_states(own, effects, epoch="e0")


@query(with_views("ledger", "tasks", "effects", "dependencies") + ",\n" + _DEPENDENCY + f""", {_DUE}
SELECT t.task_id, t.event_seq, t.node_id, t.state FROM due t LEFT JOIN states s ON s.request_id = t.request_id
WHERE coalesce(s.dependency, 'ready') = 'ready' AND NOT EXISTS (SELECT 1 FROM tasks p WHERE p.node_id = t.node_id AND p.event_seq < t.event_seq AND p.state NOT IN ('completed', 'cancelled')) ORDER BY t.event_seq LIMIT 1""")
def claim_next(spark: SparkSession, d: str) -> DataFrame:
    return work.next_task(views.tasks(spark, d), _states(spark, d), _now())


@query(with_views("ledger", "tasks") + f", {_DUE} SELECT task_id, 'processing' AS state, 'me' AS lease_owner, lease_epoch + 1 AS lease_epoch, TIMESTAMP '{NOW}' + INTERVAL 300 SECOND AS lease_until FROM due")
def task_claim(spark: SparkSession, d: str) -> DataFrame:
    return work.claim(work.due(views.tasks(spark, d), _now()), _now(), "me").select("task_id", "state", "lease_owner", "lease_epoch", "lease_until")


@query(with_views("ledger", "tasks") + f" SELECT task_id, 'pending' AS state, failure_count, TIMESTAMP '{NOW}' + INTERVAL 30 SECOND AS available_at FROM tasks WHERE state = 'processing'")
def task_deferred(spark: SparkSession, d: str) -> DataFrame:
    return work.deferred(views.tasks(spark, d).where("state = 'processing'"), _now()).select("task_id", "state", "failure_count", "available_at")


@query(with_views("ledger", "tasks") + f" SELECT task_id, lease_epoch, 'pending' AS state, TIMESTAMP '{NOW}' AS available_at FROM tasks WHERE state = 'queued' AND lease_epoch = event_seq % 3")
def task_released(spark: SparkSession, d: str) -> DataFrame:
    """Handoffs of every task that failed, some under an epoch that is over."""
    tasks = views.tasks(spark, d)
    handoffs = tasks.select("task_id", (F.col("event_seq") % 3).alias("lease_epoch"))
    return work.released(tasks, handoffs, _now()).select("task_id", "lease_epoch", "state", "available_at")


@query("SELECT 'g' || o_orderkey AS task_id, 'stale_catalog_revision' AS code FROM orders WHERE o_orderkey % 4 > 0 AND o_orderkey % 6 <> 5")
def guard_catalog_revision(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    guards = tables.table(spark, d, "orders").select(F.concat(F.lit("g"), k).alias("task_id"), F.when(k % 4 > 0, k % 6).alias("expected_catalog_revision"))
    return work.stale_catalog(guards, spark.createDataFrame([(5,)], "catalog_revision bigint"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'stale_task_write' WHEN 'click' THEN 'stale_snapshot_revision' WHEN 'error' THEN 'deletion_gate_blocks_write' WHEN 'signup' THEN 'snapshot_revision_regression' END AS reason FROM events")
def abort_reasons(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    said = F.when(kind == "view", "stale_task_write").when(kind == "click", "stale_snapshot_revision").when(kind == "error", "deletion_gate_blocks_write").when(kind == "signup", "snapshot_revision_regression").otherwise("disk full")
    message = F.concat(F.lit("batch failed: "), said, F.lit(": constraint"))
    return tables.table(spark, d, "events").select("event_id", fn.abort_reason(message).alias("reason"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'named-' || o_orderkey WHEN 1 THEN o_orderpriority END AS name FROM orders")
def rename_targets(spark: SparkSession, d: str) -> DataFrame:
    k, path = F.col("o_orderkey"), lambda *p: F.array(*map(F.lit, p))
    one = lambda op, p, value: F.struct(F.lit(op).alias("op"), p.alias("path"), value.alias("value"))
    changes = F.array(one("set", path("title"), F.lit("other")), one("remove", path("name"), F.lit(None).cast("string")), F.when(k % 3 == 1, one("set", path("name"), F.col("o_orderpriority"))).otherwise(one("set", path("name", "inner"), F.lit("x"))))
    return tables.table(spark, d, "orders").select("o_orderkey", fn.rename_target(F.when(k % 3 == 0, F.concat(F.lit("named-"), k)), changes).alias("name"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS at, CAST(least(greatest(CASE WHEN event_id % 61 = 0 OR event_id % 7 = 0 THEN 20 ELSE event_id % 61 - 3 END, 1), 50) AS INTEGER) AS size, event_id % 3 = 0 AS equal FROM events WHERE event_id % 61 <> 3")
def wire_forms(spark: SparkSession, d: str) -> DataFrame:
    """Times as text, page sizes, and JSON compared by value: 1 and 1.0 are equal, whatever the order of keys."""
    k = F.col("event_id")
    wanted = F.when(k % 7 != 0, F.when(k % 61 == 0, 0).otherwise(k % 61 - 3)).cast("int")
    left, right = F.concat(F.lit('{"a":1,"k":'), k, F.lit("}")), F.concat(F.lit('{"k":'), k, F.when(k % 3 == 0, ".0").otherwise(".5"), F.lit(',"a":1.0}'))
    rows = tables.table(spark, d, "events").where(k % 61 != 3)
    return rows.select("event_id", fn.iso_millis(F.col("ts")).alias("at"), fn.page_size(wanted).alias("size"), fn.json_equal(left, right).alias("equal"))


_HASHES = "arrivals AS (SELECT event_id AS event_seq, 'req-' || (event_id % 4000) AS request_id, sha256(CASE WHEN event_id % 7 = 0 THEN props ELSE CAST(event_id % 4000 AS VARCHAR) END) AS content_hash FROM events)"


def _arrivals(spark: SparkSession, d: str) -> DataFrame:
    content = F.when(F.col("event_id") % 7 == 0, F.col("props")).otherwise((F.col("event_id") % 4000).cast("string"))
    return tables.table(spark, d, "events").select(F.col("event_id").alias("event_seq"), F.concat(F.lit("req-"), F.col("event_id") % 4000).alias("request_id"), F.sha2(content, 256).alias("content_hash"))


@query(f"WITH {_HASHES} SELECT request_id, min(event_seq) AS event_seq, arg_min(content_hash, event_seq) AS content_hash, count(*) AS arrivals, count(DISTINCT content_hash) > 1 AS conflict FROM arrivals GROUP BY request_id")
def idempotent_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return work.deduplicated(_arrivals(spark, d))


@query(f"""WITH {_HASHES}, firsts AS (SELECT request_id, min(event_seq) AS s, arg_min(content_hash, event_seq) AS h FROM arrivals GROUP BY request_id)
SELECT a.request_id, a.event_seq, CASE WHEN a.event_seq = f.s THEN 'new' WHEN a.content_hash = f.h THEN 'replay' ELSE 'request_id_conflict' END AS answer FROM arrivals a JOIN firsts f ON f.request_id = a.request_id""")
def request_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return work.answers(_arrivals(spark, d))


# --- guards ---------------------------------------------------------------------

_GUARDS = "guards AS (SELECT 'tsk-req-' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 8, '0') AS task_id, 'o' || o_orderkey AS expected_node_id, CASE WHEN o_orderkey % 5 = 0 THEN 'directory.delete' ELSE 'snapshot.patch' END AS operation, CAST(o_orderkey % 3 AS BIGINT) AS expected_snapshot_revision, 'w' || (o_orderkey % 10000 + 1) % 3 AS owner, CASE WHEN o_orderkey % 5 = 1 THEN 9 ELSE (o_orderkey % 10000 + 1) % 4 END AS expected_epoch FROM orders)"


def _guards(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return tables.table(spark, d, "orders").select(F.concat(F.lit("tsk-req-"), F.lpad((k % 10000).cast("string"), 8, "0")).alias("task_id"), F.concat(F.lit("o"), k).alias("expected_node_id"), F.when(k % 5 == 0, "directory.delete").otherwise("snapshot.patch").alias("operation"), (k % 3).alias("expected_snapshot_revision"), F.concat(F.lit("w"), (k % 10000 + 1) % 3).alias("owner"), F.when(k % 5 == 1, 9).otherwise((k % 10000 + 1) % 4).alias("expected_epoch"))


@query(with_views("nodes", "gates") + " SELECT n.node_id, n.name FROM nodes n WHERE EXISTS (SELECT 1 FROM gates g WHERE g.node_id = n.parent_id)")
def gate_semi(spark: SparkSession, d: str) -> DataFrame:
    return views.nodes(spark, d).join(views.gates(spark, d).withColumnRenamed("node_id", "parent_id"), "parent_id", "left_semi").select("node_id", "name")


@query(with_views("ledger", "tasks") + f", {_GUARDS} SELECT g.task_id, 'stale_task_write' AS code FROM guards g WHERE NOT EXISTS (SELECT 1 FROM tasks t WHERE t.task_id = g.task_id AND t.state = 'processing' AND t.lease_owner = g.owner AND t.lease_epoch = g.expected_epoch AND t.lease_until > TIMESTAMP '{NOW}')")
def lease_anti(spark: SparkSession, d: str) -> DataFrame:
    return work.stale_leases(_guards(spark, d), views.tasks(spark, d), _now())


@query(with_views("nodes") + f", {_GUARDS} SELECT g.task_id, 'stale_node_state' AS code FROM guards g WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.node_id = g.expected_node_id AND n.lifecycle = CASE WHEN g.operation = 'directory.delete' THEN 'deleting' ELSE 'active' END)")
def guard_node_state(spark: SparkSession, d: str) -> DataFrame:
    return work.stale_nodes(_guards(spark, d), views.nodes(spark, d))


@query(f"WITH {_GUARDS}, snaps AS (SELECT 'o' || o_orderkey AS node_id, CAST(o_orderkey % 2 AS BIGINT) AS revision FROM orders) SELECT g.task_id, 'stale_snapshot_revision' AS code FROM guards g WHERE NOT EXISTS (SELECT 1 FROM snaps s WHERE s.node_id = g.expected_node_id AND s.revision = g.expected_snapshot_revision)")
def guard_snapshot_revision(spark: SparkSession, d: str) -> DataFrame:
    snaps = tables.table(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("node_id"), (F.col("o_orderkey") % 2).alias("revision"))
    return work.stale_snapshots(_guards(spark, d), snaps)


@query(f"WITH {_GUARDS}, gated AS (SELECT 'o' || o_orderkey AS node_id FROM orders WHERE o_custkey % 7 = 0) SELECT g.task_id, 'deletion_gate_blocks_write' AS code FROM guards g WHERE g.operation <> 'directory.delete' AND EXISTS (SELECT 1 FROM gated x WHERE x.node_id = g.expected_node_id)")
def guard_gate(spark: SparkSession, d: str) -> DataFrame:
    gated = tables.table(spark, d, "orders").where("o_custkey % 7 = 0").select(F.concat(F.lit("o"), "o_orderkey").alias("node_id"))
    return work.gated_writes(_guards(spark, d), gated)


@query("SELECT node_id, seq, 'snapshot_revision_regression' AS code FROM (SELECT user_id AS node_id, event_id AS seq, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE value < p")
def guard_revision_regression(spark: SparkSession, d: str) -> DataFrame:
    return work.revision_regressions(tables.table(spark, d, "events").select(F.col("user_id").alias("node_id"), F.col("event_id").alias("seq"), F.col("value").alias("revision")))


@query("SELECT o_orderkey, CAST(o_orderkey % 4 AS BIGINT) AS expected, count(l_orderkey) AS observed FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(l_orderkey) <> o_orderkey % 4")
def guard_counts(spark: SparkSession, d: str) -> DataFrame:
    claims = tables.table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 4).alias("expected"))
    return work.wrong_counts(claims, tables.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query(with_views("nodes", "ledger", "tasks") + ", picked AS (SELECT node_id FROM ledger WHERE event_type = 'error' AND event_seq % 50 = 0) SELECT task_id FROM tasks WHERE event_seq IN (SELECT event_seq FROM ledger WHERE payload LIKE '%7}') OR node_id IN (SELECT node_id FROM picked)")
def or_in_semi(spark: SparkSession, d: str) -> DataFrame:
    """A disjunction of two IN lists as the union of two semi-joins, so both stay hash joins."""
    tasks, ledger = views.tasks(spark, d), views.ledger(spark, d)
    one = tasks.join(ledger.where(F.col("payload").endswith("7}")).select("event_seq"), "event_seq", "left_semi").select("task_id")
    two = tasks.join(ledger.where("event_type = 'error' AND event_seq % 50 = 0").select("node_id"), "node_id", "left_semi").select("task_id")
    return one.union(two).distinct()


# --- scalar functions -------------------------------------------------------------


@query("""SELECT doc_id, CASE WHEN name = '' THEN 'empty' WHEN name IN ('.', '..') THEN 'dot_segment' WHEN contains(name, '/') OR contains(name, chr(92)) THEN 'separator' WHEN length(name) > 128 THEN 'characters' WHEN strlen(name) > 512 THEN 'bytes' END AS problem, CAST(length(name) AS INTEGER) AS characters
FROM (SELECT doc_id, nfc_normalize(string_split(text, chr(10))[1]) AS name FROM documents)""")
def name_validation(spark: SparkSession, d: str) -> DataFrame:
    names = tables.table(spark, d, "documents").select("doc_id", fn.nfc(F.substring_index("text", "\n", 1)).alias("name"))
    return names.select("doc_id", fn.name_problem(F.col("name")).alias("problem"), F.length("name").alias("characters"))


@query("SELECT event_id, sha256('{\"k\":' || json_extract_string(props, '$.k') || '}') AS content_hash, 'evt_' || substr(sha256('req-' || event_id), 1, 40) AS evt FROM events")
def canonical_hash(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "events").select("event_id", fn.content_hash(F.col("props")).alias("content_hash"), fn.derived_id("evt", F.concat(F.lit("req-"), "event_id")).alias("evt"))


@query("""WITH r AS (SELECT event_id, '"workspaceEpoch":"e1"' AS epoch, '"requestId":"req-' || event_id || '"' AS id, '"operation":"snapshot.patch"' AS op, '{"nodeId":"u' || user_id || '"}' AS target, CASE WHEN event_id % 2 = 0 THEN '"baseRevision":' || (event_id % 5) || ',' ELSE '' END AS base,
  CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 5 AS VARCHAR) ELSE 'null' END AS rev, '[{"op":"set","path":["a"],"value":' || props || '}]' AS changes FROM (SELECT event_id, user_id, '{"k":' || json_extract_string(props, '$.k') || '}' AS props FROM events))
SELECT event_id, sha256('{' || base || '"changes":' || changes || ',' || op || ',' || id || ',"target":' || target || ',' || epoch || '}') AS content, sha256('{"baseRevision":' || rev || ',"changes":' || changes || ',' || op || '}') AS payload,
  sha256('{"apiVersion":1,"baseRevision":' || rev || ',"changes":' || changes || ',"confirmation":null,"dependsOn":[],' || op || ',"protocol":"p",' || id || ',"target":' || target || ',' || epoch || '}') AS client FROM r""")
def request_hashes(spark: SparkSession, d: str) -> DataFrame:
    """The server's hash, the payload's and the client's, of requests whose fields stand in another order and have one that does not count."""
    k, text = F.col("event_id"), lambda *c: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in c))
    base = F.when(k % 2 == 0, text('"baseRevision": ', k % 5, ", ")).otherwise("")
    raw = text('{"requestId": "req-', k, '", "extra": [1], ', base, '"target": {"nodeId": "u', F.col("user_id"), '"}, "changes": [{"value": ', F.col("props"), ', "op": "set", "path": ["a"]}], "apiVersion": 1, "protocol": "p", "workspaceEpoch": "e1", "operation": "snapshot.patch"}')
    return tables.table(spark, d, "events").select("event_id", fn.request_hash(raw).alias("content"), fn.request_hash(raw, fn.PAYLOAD_FIELDS).alias("payload"), fn.request_hash(raw, fn.CLIENT_FIELDS).alias("client"))


@query("SELECT event_id, user_id FROM events WHERE json_extract_string(props, '$.k') IN ('3', '7') OR json_extract_string(props, '$.j') IN ('3')")
def json_path_filter(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "events").where(F.get_json_object("props", "$.k").isin("3", "7") | F.get_json_object("props", "$.j").isin("3")).select("event_id", "user_id")


@query("SELECT o_orderkey, r_name || '/' || n_name || '/' || c_name AS path, o_orderkey % 2 = 0 OR r_name = 'ASIA' AS overlap FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def path_format(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: tables.table(spark, d, n)
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    path = F.array("r_name", "n_name", "c_name")
    other = F.when(F.col("o_orderkey") % 2 == 0, F.array("r_name", "n_name")).otherwise(F.array(F.lit("ASIA")))
    return rows.select("o_orderkey", fn.display_path(path).alias("path"), fn.overlaps(path, other).alias("overlap"))


@query("SELECT CAST(quantile_disc(value, 0.5) AS DOUBLE) AS p50, CAST(quantile_disc(value, 0.95) AS DOUBLE) AS p95, max(value) AS most, count(*) AS n, event_type FROM events GROUP BY event_type")
def percentile_report(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "events").groupBy("event_type").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"), F.max("value").alias("most"), F.count("*").alias("n"))


@query("SELECT user_id, event_id, 'll1:' || url_encode('{\"after\":\"' || event_type || '\",\"op\":\"page\"}') AS cursor FROM events")
def cursor_codec(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "events").select("user_id", "event_id", fn.cursor_column(("op", F.lit("page")), ("after", F.col("event_type"))).alias("cursor"))


# --- sinks --------------------------------------------------------------------------


@query("SELECT user_id, arg_max(event_type, CASE WHEN event_id % 2 = 1 THEN 1000000000 ELSE 0 END + event_id) AS event_type, arg_max(event_id, CASE WHEN event_id % 2 = 1 THEN 1000000000 ELSE 0 END + event_id) AS event_id FROM events GROUP BY user_id")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.table(spark, d, "events").select("user_id", "event_type", "event_id")
    return tables.upsert(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), ["user_id"], ["event_id"])


@query("SELECT 'erase:' || user_id AS audit_id, min(event_id) AS event_id FROM events WHERE event_type = 'error' AND user_id NOT IN (SELECT user_id FROM events WHERE event_id % 97 = 0) GROUP BY user_id")
def audit_insert_once(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.table(spark, d, "events").withColumn("audit_id", F.concat(F.lit("erase:"), "user_id"))
    return tables.insert_or_ignore(rows.where("event_id % 97 = 0").select("audit_id", "event_id"), rows.where("event_type = 'error'").select("audit_id", "event_id"), "audit_id")


# --- offline reconciliation -----------------------------------------------------------


def _replica(spark: SparkSession, d: str) -> DataFrame:
    return views.nodes(spark, d).select("node_id", "parent_id", (F.col("kind") == "directory").__and__(F.xxhash64("node_id") < 0).alias("unused"), F.lit(False).alias("moved_out"), F.lit(False).alias("moved_in")).drop("unused").withColumns({"moved_out": F.col("node_id").rlike("^c[0-9]*3$"), "moved_in": F.col("node_id").rlike("^c[0-9]*5$")})


_ACTIONS = """replica AS (SELECT node_id, parent_id, regexp_matches(node_id, '^c[0-9]*3$') AS moved_out, regexp_matches(node_id, '^c[0-9]*5$') AS moved_in FROM nodes),
walk AS (SELECT node_id, 'erase' AS action FROM gates UNION ALL
  SELECT r.node_id, CASE WHEN w.action = 'conflict' OR r.moved_in THEN 'conflict' ELSE 'erase' END FROM walk w JOIN replica r ON r.parent_id = w.node_id WHERE w.action = 'conflict' OR NOT r.moved_out),
actions AS (SELECT r.node_id, coalesce(w.action, 'keep') AS action FROM replica r LEFT JOIN walk w ON w.node_id = r.node_id)"""


@query(with_views("nodes", "gates", recursive=True) + ",\n" + _ACTIONS + " SELECT node_id, action FROM actions")
def offline_keep_erase(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.plan(views.gates(spark, d), _replica(spark, d))


def _pending(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    state = F.element_at(F.array(*map(F.lit, fn.LOCAL_STATUSES)), (k % 6 + 1).cast("int"))
    return tables.table(spark, d, "orders").select(F.concat(F.lit("p"), k).alias("request_id"), F.concat(F.lit("o"), k).alias("node_id"), F.concat(F.lit("c"), "o_custkey").alias("parent_id"), state.alias("state"), F.lit("snapshot.patch").alias("operation"))


_PENDING = "pending AS (SELECT 'p' || o_orderkey AS request_id, 'o' || o_orderkey AS node_id, 'c' || o_custkey AS parent_id, ['local_pending', 'sending', 'cloud_acknowledged', 'waiting_dependency', 'delivery_blocked', 'cancelled'][CAST(o_orderkey % 6 + 1 AS INTEGER)] AS state FROM orders)"


@query(with_views("nodes", "gates", recursive=True) + ",\n" + _ACTIONS + f""", {_PENDING}
SELECT p.request_id, min(CASE WHEN a.node_id = p.node_id THEN 'node_erased' ELSE 'parent_erased' END) AS reason FROM pending p JOIN actions a ON a.node_id IN (p.node_id, p.parent_id) AND a.action = 'erase' WHERE p.state NOT IN ('cloud_acknowledged', 'cancelled') GROUP BY p.request_id""")
def offline_cancel(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.cancellations(reconcile.plan(views.gates(spark, d), _replica(spark, d)), _pending(spark, d))


@query(f"WITH {_PENDING}, hit AS (SELECT 'c' || c_custkey AS node_id FROM customer WHERE c_nationkey = 4) SELECT request_id, CASE state WHEN 'cancelled' THEN 'already_cancelled' WHEN 'cloud_acknowledged' THEN 'acknowledged' ELSE 'cancelled' END AS outcome FROM pending WHERE parent_id IN (SELECT node_id FROM hit)")
def cancel_by_node(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.cancel_by_node(_pending(spark, d), tables.table(spark, d, "customer").where("c_nationkey = 4").select(F.concat(F.lit("c"), "c_custkey").alias("node_id")))


@query(f"WITH {_PENDING} SELECT request_id, 'snapshot.patch' AS operation, node_id, true AS body_redacted FROM pending WHERE state = 'cloud_acknowledged'")
def redaction_tombstones(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.tombstones(_pending(spark, d).where("state = 'cloud_acknowledged'"))


@query(with_views("nodes", "gates", recursive=True) + """,
dels AS (SELECT node_id, 'del-' || node_id AS request_id FROM gates UNION ALL SELECT 'ghost', 'del-ghost'),
below AS (SELECT d.node_id AS root, d.request_id AS by_, n.node_id FROM dels d JOIN nodes n ON n.node_id = d.node_id UNION ALL SELECT b.root, b.by_, n.node_id FROM below b JOIN nodes n ON n.parent_id = b.node_id),
ev AS (SELECT 'q' || o_orderkey AS request_id, o_orderkey AS event_seq, CASE WHEN o_orderkey % 2 = 0 THEN 'o' || o_orderkey ELSE 'new' || o_orderkey END AS node_id, 'c' || o_custkey AS target_parent_id FROM orders
  UNION ALL SELECT request_id, -1 - row_number() OVER (ORDER BY node_id), node_id, NULL FROM dels),
hits AS (SELECT DISTINCT e.request_id, e.event_seq FROM ev e JOIN below b ON b.node_id IN (e.node_id, e.target_parent_id) AND b.by_ <> e.request_id)
SELECT 'node' AS kind, d.node_id AS id, CASE WHEN n.node_id IS NULL THEN 'tombstone' ELSE 'deleted' END AS action FROM dels d LEFT JOIN nodes n ON n.node_id = d.node_id
UNION ALL SELECT 'snapshot', node_id, 'removed' FROM nodes WHERE kind = 'snapshot' AND node_id IN (SELECT node_id FROM below)
UNION ALL SELECT 'event', request_id, 'redacted' FROM hits
UNION ALL SELECT 'task', 't' || o_orderkey, 'cancelled' FROM orders WHERE o_orderkey % 4 < 3 AND o_orderkey IN (SELECT event_seq FROM hits)
UNION ALL SELECT 'request', 'q' || o_orderkey, 'cancelled' FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey IN (SELECT event_seq FROM hits)""")
def delete_cleanup(spark: SparkSession, d: str) -> DataFrame:
    """Deletions of the gated nations and of a node that was never there, over requests of every order."""
    k, text = F.col("o_orderkey"), lambda p, c: F.concat(F.lit(p), c)
    gates = views.gates(spark, d)
    deletes = gates.union(spark.createDataFrame([("ghost",)], "node_id string")).withColumn("request_id", text("del-", F.col("node_id")))
    orders = tables.table(spark, d, "orders")
    events = orders.select(text("q", k).alias("request_id"), k.alias("event_seq"), F.when(k % 2 == 0, text("o", k)).otherwise(text("new", k)).alias("node_id"), text("c", F.col("o_custkey")).alias("target_parent_id"))
    events = events.union(deletes.select("request_id", F.lit(-1).cast("bigint"), "node_id", F.lit(None).cast("string")))
    state = F.element_at(F.array(*map(F.lit, ("pending", "queued", "processing", "completed"))), (k % 4 + 1).cast("int"))
    tasks = orders.select(text("t", k).alias("task_id"), k.alias("event_seq"), state.alias("state"))
    requests = orders.select(text("q", k).alias("request_id"), F.when(k % 3 == 0, "pending").otherwise("applied").alias("effect"))
    return reconcile.directory_delete(deletes, views.nodes(spark, d), events, tasks, requests)


# --- folds ------------------------------------------------------------------------------


@query("SELECT event_seq, CAST(sum(CASE WHEN operation IN ('snapshot.create', 'directory.delete') THEN 1 ELSE 0 END) OVER (ORDER BY event_seq) AS BIGINT) AS catalog_revision FROM (" + with_views("ledger") + " SELECT * FROM ledger)")
def catalog_revision_running(spark: SparkSession, d: str) -> DataFrame:
    return fold.catalog_revisions(views.ledger(spark, d))


def _patches(spark: SparkSession, d: str) -> DataFrame:
    """A user's first event creates a document, each later one sets the field of its type, written against the version before it."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    value = F.get_json_object("props", "$.k")
    change = F.concat(F.lit('[{"op":"set","path":["'), "event_type", F.lit('"],"value":"'), value, F.lit("-"), "event_id", F.lit('"}]'))
    rows = tables.table(spark, d, "events").withColumn("n", n)
    return rows.select(F.col("user_id").cast("string").alias("node_id"), F.col("event_id").alias("event_seq"), F.concat(F.lit("req-"), "event_id").alias("request_id"), F.when(F.col("n") == 1, "snapshot.create").otherwise("snapshot.patch").alias("operation"), (F.col("n") - 1).alias("base_revision"), change.alias("changes"))


@query("""WITH last AS (SELECT user_id, event_type, arg_max(json_extract_string(props, '$.k') || '-' || event_id, event_id) AS v FROM events GROUP BY user_id, event_type)
SELECT CAST(l.user_id AS VARCHAR) AS node_id, any_value(n.n) AS revision, '{' || string_agg('"' || event_type || '":"' || v || '"', ',' ORDER BY event_type) || '}' AS content_json
FROM last l JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) n ON n.user_id = l.user_id GROUP BY l.user_id""")
def patch_fold(spark: SparkSession, d: str) -> DataFrame:
    return fold.snapshots(fold.fold_snapshots(_patches(spark, d)))


@query("""WITH p AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
SELECT CAST(user_id AS VARCHAR) AS node_id, event_id AS event_seq, 'req-' || event_id AS request_id, CAST(0 AS INTEGER) AS pos, event_type AS path, 'concurrent_change' AS reason
FROM p WHERE n > 1 AND EXISTS (SELECT 1 FROM p q WHERE q.user_id = p.user_id AND q.event_type = p.event_type AND q.n < p.n)
""")
def merge_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """The same patches, all written against the first version: a field that a later patch has set since is in conflict."""
    rows = _patches(spark, d).withColumn("base_revision", F.when(F.col("operation") == "snapshot.patch", F.lit(1)).otherwise(F.lit(0)))
    first = rows.where("operation = 'snapshot.create'").withColumn("changes", F.lit("[]"))
    all_rows = first.select(*rows.columns).withColumn("event_seq", F.lit(-1).cast("bigint")).union(rows.withColumn("operation", F.lit("snapshot.patch")).withColumn("base_revision", F.lit(1)))
    return fold.conflict_rows(fold.fold_snapshots(all_rows)).select("node_id", "event_seq", "request_id", "pos", "path", "reason")


@query(with_views("nodes") + """, done AS (SELECT 'c' || c_custkey AS node_id, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS gone, max(CASE WHEN event_type = 'click' THEN 'r' || (event_id % 5) END) IS NOT NULL AS moved,
  arg_max(CAST(event_id % 25 AS VARCHAR), event_id) FILTER (WHERE event_type = 'click') AS target, arg_max(props, event_id) FILTER (WHERE event_type = 'view') AS renamed, count(*) FILTER (WHERE event_type IN ('click', 'view')) AS revision
  FROM events JOIN customer ON c_custkey = user_id GROUP BY c_custkey)
SELECT n.node_id, CASE WHEN d.moved THEN 'n' || d.target ELSE n.parent_id END AS parent_id, coalesce(d.renamed, n.name) AS name, n.kind, CASE WHEN d.gone = 1 THEN 'deleted' ELSE n.lifecycle END AS lifecycle, coalesce(d.revision, 0) AS revision
FROM nodes n LEFT JOIN done d ON d.node_id = n.node_id""")
def structure_fold(spark: SparkSession, d: str) -> DataFrame:
    """Customers renamed by views, moved by clicks and deleted by errors."""
    operation = F.when(F.col("event_type") == "view", "directory.rename").when(F.col("event_type") == "click", "directory.move").otherwise("directory.delete")
    customers = tables.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    rows = tables.table(spark, d, "events").where("event_type IN ('view', 'click', 'error')").join(customers, "user_id", "left_semi")
    requests = rows.select((F.col("event_id") + 1).alias("event_seq"), operation.alias("operation"), F.concat(F.lit("c"), "user_id").alias("node_id"), F.concat(F.lit("n"), F.col("event_id") % 25).alias("parent_id"), F.col("props").alias("name"), F.lit(None).cast("string").alias("kind"))
    return fold.fold_tree(views.nodes(spark, d), requests)


@query(with_views("ledger") + """, paths AS (SELECT node_id, request_id, event_seq, event_type, CASE event_seq % 5 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN [payload] WHEN 2 THEN ['f' || (event_seq % 3)] ELSE ['f' || (event_seq % 3), payload] END AS path FROM ledger),
met AS (SELECT c.node_id, c.request_id AS conflict_id, arg_min(f.request_id, f.event_seq) AS resolved_by FROM (SELECT * FROM paths WHERE event_type = 'purchase') c
  LEFT JOIN (SELECT * FROM paths WHERE event_type = 'signup') f ON f.node_id = c.node_id AND f.event_seq > c.event_seq AND len(c.path) > 0 AND len(f.path) > 0 AND c.path[1:least(len(c.path), len(f.path))] = f.path[1:least(len(c.path), len(f.path))] GROUP BY ALL)
SELECT *, CASE WHEN resolved_by IS NULL THEN 'open' ELSE 'resolved' END AS status FROM met""")
def conflict_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Conflicts with the first later resolution of a touching path; some paths are empty, of one name, or of two."""
    k, field = F.col("event_seq"), F.concat(F.lit("f"), F.col("event_seq") % 3)
    path = F.when(k % 5 == 0, F.array().cast("array<string>")).when(k % 5 == 1, F.array("payload")).when(k % 5 == 2, F.array(field)).otherwise(F.array(field, F.col("payload")))
    rows = views.ledger(spark, d).withColumn("path", path)
    conflicts = rows.where("event_type = 'purchase'").select("node_id", "event_seq", F.col("request_id").alias("conflict_id"), "path")
    return fold.resolved(conflicts, rows.where("event_type = 'signup'")).select("node_id", "conflict_id", "resolved_by", "status")


@query("""WITH p AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
c AS (SELECT p.*, q.event_id AS by_ FROM p LEFT JOIN p q ON q.user_id = p.user_id AND q.event_type = 'signup' AND q.n > p.n AND p.event_type <> 'signup')
SELECT CAST(user_id AS VARCHAR) AS node_id, 'req-' || event_id AS request_id, 'req-' || min(by_) AS resolved_by FROM c WHERE event_type <> 'signup' AND n > 1 GROUP BY user_id, event_id HAVING min(by_) IS NOT NULL""")
def resolve_fold(spark: SparkSession, d: str) -> DataFrame:
    """A fold with resolutions: every patch but a signup's sets one shared field against an empty first version; a signup resolves it."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = tables.table(spark, d, "events").withColumn("n", n)
    change = F.concat(F.lit('[{"op":"set","path":["field"],"value":"'), F.col("event_id").cast("string"), F.lit('"}]'))
    requests = rows.select(F.col("user_id").cast("string").alias("node_id"), F.col("event_id").alias("event_seq"), F.concat(F.lit("req-"), "event_id").alias("request_id"), F.when(F.col("event_type") == "signup", "conflict.resolve").otherwise("snapshot.patch").alias("operation"), F.when(F.col("event_type") != "signup", F.lit(1)).cast("bigint").alias("base_revision"), change.alias("changes"), "n")
    # The first event makes the document with the field of value "0", so that every later patch against revision 1 is in conflict once it was written.
    first = requests.where("n = 1").select("node_id", F.lit(-2).cast("bigint").alias("event_seq"), F.lit("create").alias("request_id"), F.lit("snapshot.create").alias("operation"), F.lit(None).cast("bigint").alias("base_revision"), F.lit("[]").alias("changes"))
    second = requests.where("n = 1").select("node_id", F.lit(-1).cast("bigint").alias("event_seq"), F.lit("set").alias("request_id"), F.lit("snapshot.patch").alias("operation"), F.lit(1).cast("bigint").alias("base_revision"), F.lit('[{"op":"set","path":["field"],"value":"0"}]').alias("changes"))
    out = fold.fold_snapshots(first.union(second).union(requests.where("n > 1").drop("n")))
    return out.where("resolves IS NOT NULL").select("node_id", F.explode("resolves").alias("closed"), F.col("request_id").alias("resolved_by")).withColumnRenamed("closed", "request_id")


@query("""SELECT 'r' || user_id AS request_id, CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 0 THEN 'cancelled' ELSE 'local_pending' END AS state, CAST(0 AS INTEGER) AS attempts, count(*) FILTER (WHERE event_type NOT IN ('error')) AS other FROM events GROUP BY user_id""")
def outbox_cancel(spark: SparkSession, d: str) -> DataFrame:
    """Every user's outbox entry: enqueued before all else, and cancelled by an error."""
    rows = tables.table(spark, d, "events")
    start = rows.groupBy("user_id").agg(F.min("ts").alias("ts"), F.count_if(F.col("event_type") != "error").alias("other"))
    step = lambda df, seq, name: df.select(F.concat(F.lit("r"), "user_id").alias("request_id"), seq.alias("seq"), F.col("ts").alias("at"), F.lit(name).alias("step"), F.lit("").alias("code"))
    steps = step(start, F.lit(-1).cast("bigint"), "enqueue").union(step(rows.where("event_type = 'error'"), F.col("event_id"), "cancel"))
    return work.fold_outbox(steps).join(start.select(F.concat(F.lit("r"), "user_id").alias("request_id"), "other"), "request_id").select("request_id", "state", "attempts", "other")


@query("""WITH RECURSIVE life AS (SELECT 'r' || user_id AS request_id, event_id AS seq, ts, CASE event_type WHEN 'view' THEN 'claim' WHEN 'error' THEN 'fail' WHEN 'click' THEN 'recover' WHEN 'signup' THEN 'wait' ELSE 'release' END AS step FROM events),
steps AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY seq) AS n FROM life),
fold AS (SELECT request_id, CAST(0 AS BIGINT) AS n, 'local_pending' AS state, 0 AS attempts, min(ts) AS available_at, CAST(NULL AS TIMESTAMP) AS lease, 0 AS rejected FROM life GROUP BY request_id
  UNION ALL SELECT request_id, n, CASE act WHEN 'claim' THEN 'sending' WHEN 'wait' THEN 'waiting_dependency' WHEN 'block' THEN 'delivery_blocked' WHEN 'reject' THEN state ELSE 'local_pending' END,
    CASE act WHEN 'claim' THEN attempts + 1 WHEN 'wait' THEN greatest(attempts - 1, 0) ELSE attempts END,
    CASE WHEN act IN ('release', 'recover') THEN ts WHEN act = 'fail' THEN ts + to_seconds(30 * (1 << (greatest(attempts, 1) - 1))) ELSE available_at END,
    CASE act WHEN 'claim' THEN ts + INTERVAL 60 SECOND WHEN 'reject' THEN lease END, CASE WHEN act = 'reject' THEN rejected + 1 ELSE rejected END
  FROM (SELECT f.request_id, s.n, f.state, f.attempts, f.available_at, f.lease, f.rejected, s.ts,
      CASE WHEN step = 'claim' AND state = 'local_pending' AND available_at <= ts THEN 'claim' WHEN step = 'wait' AND state = 'sending' THEN 'wait' WHEN step = 'release' AND state = 'waiting_dependency' THEN 'release'
        WHEN step = 'fail' AND state = 'sending' THEN CASE WHEN attempts >= 5 THEN 'block' ELSE 'fail' END WHEN step = 'recover' AND state = 'sending' AND lease < ts THEN 'recover' ELSE 'reject' END AS act
    FROM fold f JOIN steps s ON s.request_id = f.request_id AND s.n = f.n + 1))
SELECT request_id, arg_max(state, n) AS state, CAST(arg_max(attempts, n) AS INTEGER) AS attempts, arg_max(available_at, n) AS available_at, CAST(arg_max(rejected, n) AS INTEGER) AS rejected FROM fold GROUP BY request_id""")
def outbox_fold(spark: SparkSession, d: str) -> DataFrame:
    """A full outbox life: events stand for the steps of claiming, failing, waiting and acknowledging."""
    rows = tables.table(spark, d, "events")
    name = F.when(F.col("event_type") == "view", "claim").when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "click", "recover").when(F.col("event_type") == "signup", "wait").otherwise("release")
    steps = rows.select(F.concat(F.lit("r"), "user_id").alias("request_id"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), name.alias("step"), F.lit("").alias("code"))
    first = steps.groupBy("request_id").agg(F.min("at").alias("at")).select("request_id", F.lit(-1).cast("bigint").alias("seq"), "at", F.lit("enqueue").alias("step"), F.lit("").alias("code"))
    return work.fold_outbox(first.union(steps))


# --- acceptance ------------------------------------------------------------------------------


@query("""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'unsupported_protocol' WHEN event_id % 13 = 0 THEN 'unsupported_api_version' WHEN event_id % 17 = 0 THEN 'invalid_request_id' WHEN event_id % 19 = 0 THEN 'invalid_name'
  WHEN event_id % 31 = 0 THEN 'invalid_replaces' WHEN event_id % 23 = 0 THEN 'invalid_base_revision' WHEN event_id % 29 = 0 THEN 'invalid_change' END AS code FROM events""")
def envelope_validation(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    null = lambda t: F.lit(None).cast(t)
    rows = tables.table(spark, d, "events").select(
        "event_id",
        F.when(k % 11 == 0, "other").otherwise("tree-snapshots").alias("protocol"),
        F.when(k % 13 == 0, 2).otherwise(1).alias("apiVersion"),
        F.md5(F.lit("epoch").cast("binary")).alias("workspaceEpoch"),
        F.when(k % 17 == 0, "short").otherwise(F.concat(F.lit("req-"), F.lpad(k.cast("string"), 8, "0"))).alias("requestId"),
        F.lit("snapshot.patch").alias("operation"),
        F.struct(null("string").alias("nodeId"), null("string").alias("parentId"), F.when(k % 19 == 0, "a/b").otherwise("plain").alias("name"), null("string").alias("kind"), null("array<string>").alias("path")).alias("target"),
        null("array<string>").alias("dependsOn"),
        F.when(k % 23 == 0, -1).otherwise(1).cast("bigint").alias("baseRevision"),
        F.array(F.struct(F.when(k % 29 == 0, "turn").otherwise("set").alias("op"), F.array(F.lit("a")).alias("path"), F.col("props").alias("value"), null("string").alias("field"), null("string").alias("itemId"))).alias("changes"),
        null("string").alias("confirmation"),
        F.when(k % 31 == 0, F.array(F.concat(F.lit("req-"), F.lpad(k.cast("string"), 8, "0")))).alias("replaces"),
    )
    return rows.select("event_id", accept.envelope_code("tree-snapshots", 1).alias("code"))


@query(with_views("nodes", "gates", recursive=True) + ",\n" + _UP + """,
blocked AS (SELECT DISTINCT u.node_id FROM up u JOIN (SELECT node_id FROM nodes WHERE lifecycle <> 'active' UNION SELECT node_id FROM gates) s ON s.node_id = u.ancestor_id),
req AS (SELECT 'q' || o_orderkey AS request_id, CASE o_orderkey % 3 WHEN 0 THEN 'snapshot.patch' WHEN 1 THEN 'snapshot.create' ELSE 'directory.rename' END AS operation,
  CASE o_orderkey % 3 WHEN 0 THEN 'o' || (o_orderkey * 2) WHEN 2 THEN 'c' || o_custkey END AS node_id, CASE WHEN o_orderkey % 3 = 1 THEN 'c' || (o_custkey * 2) END AS parent_id,
  CASE o_orderkey % 3 WHEN 1 THEN 'order-' || o_orderkey WHEN 2 THEN 'Customer#' || lpad(CAST(o_custkey + o_orderkey % 2 AS VARCHAR), 9, '0') END AS name FROM orders),
held AS (SELECT parent_id, name, min(node_id) AS holder, count(*) AS holders FROM nodes WHERE lifecycle <> 'deleted' GROUP BY 1, 2)
SELECT r.request_id, CASE
  WHEN operation = 'snapshot.create' AND p.node_id IS NULL THEN 'target_not_found'
  WHEN operation = 'snapshot.create' AND (p.lifecycle <> 'active' OR bp.node_id IS NOT NULL) THEN 'target_deleted'
  WHEN operation <> 'snapshot.create' AND n.node_id IS NULL THEN 'target_not_found'
  WHEN operation <> 'snapshot.create' AND (n.lifecycle <> 'active' OR bn.node_id IS NOT NULL) THEN 'target_deleted'
  WHEN operation <> 'snapshot.patch' AND h.holder IS NOT NULL AND NOT (h.holder IS NOT DISTINCT FROM r.node_id AND h.holders = 1) THEN 'name_conflict' END AS code
FROM req r LEFT JOIN nodes n ON n.node_id = r.node_id LEFT JOIN nodes p ON p.node_id = r.parent_id LEFT JOIN blocked bn ON bn.node_id = r.node_id LEFT JOIN blocked bp ON bp.node_id = r.parent_id
LEFT JOIN held h ON h.parent_id = CASE WHEN operation = 'directory.rename' THEN n.parent_id ELSE r.parent_id END AND h.name = r.name""")
def accept_targets(spark: SparkSession, d: str) -> DataFrame:
    k, kind = F.col("o_orderkey"), F.col("o_orderkey") % 3
    text = lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in c])
    requests = tables.table(spark, d, "orders").select(
        text("q", k).alias("request_id"),
        F.when(kind == 0, "snapshot.patch").when(kind == 1, "snapshot.create").otherwise("directory.rename").alias("operation"),
        F.when(kind == 0, text("o", k * 2)).when(kind == 2, text("c", F.col("o_custkey"))).alias("node_id"),
        F.when(kind == 1, text("c", F.col("o_custkey") * 2)).alias("parent_id"),
        F.when(kind == 1, text("order-", k)).when(kind == 2, F.concat(F.lit("Customer#"), F.lpad((F.col("o_custkey") + k % 2).cast("string"), 9, "0"))).alias("name"),
    )
    nodes = views.nodes(spark, d)
    return accept.target_codes(requests, nodes, tree.blocked(nodes, views.gates(spark, d))).select("request_id", "code")


@query(with_views("ledger", "effects") + """, named AS (SELECT request_id, event_seq, unnest([event_seq - 1, event_seq - 2]) AS old FROM ledger WHERE event_seq > 2 AND event_seq % 5 = 0)
SELECT n.request_id, count(*) AS expected, count(e.request_id) AS observed, count(*) = count(e.request_id) AS accepted FROM named n LEFT JOIN effects e ON e.event_seq = n.old AND e.effect = 'pending' AND e.operation NOT IN ('directory.delete', 'conflict.resolve', 'task.retry') GROUP BY n.request_id""")
def accept_replaces(spark: SparkSession, d: str) -> DataFrame:
    old = lambda n: F.concat(F.lit("req-"), F.lpad((F.col("event_seq") - n).cast("string"), 8, "0"))
    requests = views.ledger(spark, d).where("event_seq > 2 AND event_seq % 5 = 0").select("request_id", F.array(old(2), old(3)).alias("replaces"))
    return accept.replacements(requests, views.effects(spark, d))


@query(with_views("nodes", "gates", recursive=True) + ",\n" + _UP + """,
blocked AS (SELECT DISTINCT u.node_id FROM up u JOIN (SELECT node_id FROM nodes WHERE lifecycle <> 'active' UNION SELECT node_id FROM gates) s ON s.node_id = u.ancestor_id),
req AS (SELECT event_id AS event_seq, event_id % 4 AS k, user_id, CASE WHEN event_id % 9 = 0 THEN 'ffffffffffffffffffffffffffffffff' ELSE '00000000000000000000000000000000' END AS epoch, CASE WHEN event_id > 0 AND event_id % 7 = 0 THEN 'req-' || lpad(CAST(event_id - 1 AS VARCHAR), 8, '0') ELSE 'req-' || lpad(CAST(event_id AS VARCHAR), 8, '0') END AS request_id, event_id // 2 % 5 AS version FROM events),
judged AS (SELECT r.*, CASE WHEN epoch LIKE 'f%' THEN 'workspace_epoch_mismatch'
  WHEN k < 2 AND c.node_id IS NULL THEN 'target_not_found' WHEN k < 2 AND b.node_id IS NOT NULL THEN 'target_deleted'
  WHEN k >= 2 AND o.node_id IS NULL THEN 'target_not_found' WHEN k >= 2 AND (o.lifecycle <> 'active' OR ob.node_id IS NOT NULL) THEN 'target_deleted' END AS code
  FROM req r LEFT JOIN nodes c ON c.node_id = 'c' || user_id LEFT JOIN blocked b ON b.node_id = c.node_id LEFT JOIN nodes o ON o.node_id = 'o' || user_id LEFT JOIN blocked ob ON ob.node_id = o.node_id),
firsts AS (SELECT request_id, min(event_seq) AS s, arg_min(version, event_seq) AS v FROM judged WHERE code IS NULL GROUP BY request_id)
SELECT j.event_seq, j.request_id, CASE WHEN epoch LIKE 'f%' THEN 'rejected' WHEN f.s < j.event_seq AND f.v = j.version THEN 'replay' WHEN f.s < j.event_seq OR code IS NOT NULL THEN 'rejected' ELSE 'accepted' END AS answer,
  CASE WHEN epoch LIKE 'f%' THEN code WHEN f.s < j.event_seq THEN CASE WHEN f.v = j.version THEN NULL ELSE 'request_id_conflict' END ELSE code END AS code
FROM judged j LEFT JOIN firsts f ON f.request_id = j.request_id""")
def accept_batch(spark: SparkSession, d: str) -> DataFrame:
    """Events as arrivals: creates below customers and patches of orders, some of another epoch, some sent again under the id of an earlier one."""
    k, null = F.col("event_id"), lambda t: F.lit(None).cast(t)
    creates = k % 4 < 2
    rid = lambda c: F.concat(F.lit("req-"), F.lpad(c.cast("string"), 8, "0"))
    target = F.struct(F.when(~creates, F.concat(F.lit("o"), "user_id")).alias("nodeId"), F.when(creates, F.concat(F.lit("c"), "user_id")).alias("parentId"), F.when(creates, F.concat(F.lit("new-"), k)).alias("name"), null("string").alias("kind"), null("array<string>").alias("path"))
    batch = tables.table(spark, d, "events").select(
        k.alias("event_seq"), (F.floor(k / 2) % 5).cast("string").alias("content_hash"), F.lit("tree-snapshots").alias("protocol"), F.lit(1).alias("apiVersion"), F.when(k % 9 == 0, "f" * 32).otherwise("0" * 32).alias("workspaceEpoch"), F.when((k > 0) & (k % 7 == 0), rid(k - 1)).otherwise(rid(k)).alias("requestId"),
        F.when(creates, "snapshot.create").otherwise("snapshot.patch").alias("operation"), target.alias("target"), null("array<string>").alias("dependsOn"), F.lit(1).cast("bigint").alias("baseRevision"), null("array<struct<op:string,path:array<string>,value:string,field:string,itemId:string>>").alias("changes"), null("string").alias("confirmation"), null("array<string>").alias("replaces"),
    )
    none = spark.createDataFrame([], "request_id string, content_hash string, workspace_epoch string, operation string, node_id string, effect string")
    return accept.accept_batch(batch, views.nodes(spark, d), views.gates(spark, d), none, "0" * 32, "tree-snapshots", 1).select("event_seq", "request_id", "answer", "code")


@query("SELECT 'req-' || event_id AS request_id, 'evt_' || substr(sha256('req-' || event_id), 1, 40) AS event_id, 'tsk_' || substr(sha256('req-' || event_id), 1, 40) AS task_id, 'pending' AS state, 'd1_committed' AS accepted FROM events")
def accept_enqueue(spark: SparkSession, d: str) -> DataFrame:
    return accept.enqueue(tables.table(spark, d, "events").select(F.concat(F.lit("req-"), "event_id").alias("request_id")))


# --- streams ----------------------------------------------------------------------------------


@query("SELECT user_id, count(*) AS n_events, max(event_id) AS last_event_id, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id")
def stream_projection(spark: SparkSession, d: str) -> DataFrame:
    return project.project(spark, project.event_stream(spark, f"{d}/events.parquet"), work_dir(spark, "projection"))


@query(ORACLES["patch_fold"])
def stream_fold(spark: SparkSession, d: str) -> DataFrame:
    """The fold of ``patch_fold`` over a stream of four batches, by the nodes' state."""
    rows, folder = _patches(spark, d), work_dir(spark, "fold")
    least, most = rows.agg(F.min("event_seq"), F.max("event_seq")).first()
    step = ((most or 0) - (least or 0)) // 4 + 1
    for i in range(4):
        rows.where(F.floor((F.col("event_seq") - (least or 0)) / step) == i).coalesce(1).write.mode("append").parquet(f"{folder}/requests")
    return fold.snapshots(project.fold_stream(spark, project.event_stream(spark, f"{folder}/requests"), folder))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    stream = project.event_stream(spark, f"{d}/events.parquet")
    return project.deduplicate(spark, stream.select("user_id", "event_type", "ts"), work_dir(spark, "dedupe"), ["user_id", "event_type"]).select("user_id", "event_type")


@query("SELECT user_id, count(*) AS n_events, max(event_id) AS last_event_id, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id")
def staged_rebuild(spark: SparkSession, d: str) -> DataFrame:
    return project.rebuild(spark, tables.table(spark, d, "events"), work_dir(spark, "rebuild"), 1)


@query("SELECT user_id, count(*) AS n_events, max(event_id) AS last_event_id, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id")
def incremental_apply(spark: SparkSession, d: str) -> DataFrame:
    """The state of the first half of the ledger with the second half applied to it."""
    events = tables.table(spark, d, "events")
    return project.combine(project.summarize(events.where("event_id % 10 < 5")), project.summarize(events.where("event_id % 10 >= 5")))


# --- reducers -----------------------------------------------------------------------------------

_OUTCOME = "CASE event_type WHEN 'purchase' THEN 'positive' WHEN 'error' THEN 'negative' ELSE 'neutral' END"
_TOPICS = f"""e AS (SELECT event_id, ts, 't' || (user_id % 40) AS topic, {_OUTCOME} AS outcome, 'p' || (event_id % 300) AS problem_id, 'k' || (event_id - event_id % 2) AS event_key FROM events),
once AS (SELECT arg_min(topic, event_id) AS topic, min(event_id) AS seq, arg_min(outcome, event_id) AS outcome, arg_min(problem_id, event_id) AS problem_id, arg_min(ts, event_id) AS seen_at FROM e GROUP BY event_key),
topics AS (SELECT topic, count(*) AS attempts, count(*) FILTER (WHERE outcome = 'negative') AS negative, count(*) FILTER (WHERE outcome = 'positive') AS positive, count(*) FILTER (WHERE outcome = 'neutral') AS neutral,
  arg_max(outcome, seq) AS last_outcome, arg_max(seen_at, seq) AS last_at, count(DISTINCT problem_id) AS problems FROM once GROUP BY topic)"""


def _observed(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    outcome = F.when(F.col("event_type") == "purchase", "positive").when(F.col("event_type") == "error", "negative").otherwise("neutral")
    return tables.table(spark, d, "events").select(k.alias("seq"), F.col("ts").alias("at"), F.concat(F.lit("t"), F.col("user_id") % 40).alias("topic"), outcome.alias("outcome"), F.concat(F.lit("p"), k % 300).alias("problem_id"), F.concat(F.lit("k"), k - k % 2).alias("event_key"), "user_id", "value")


@query(f"WITH {_TOPICS} SELECT * FROM topics")
def topic_mastery(spark: SparkSession, d: str) -> DataFrame:
    return rollups.topics(_observed(spark, d))


@query(f"WITH {_TOPICS} SELECT topic, negative, CASE WHEN positive > 0 THEN 'improving' ELSE 'open' END AS status, last_outcome FROM topics WHERE negative > 0")
def weaknesses(spark: SparkSession, d: str) -> DataFrame:
    return rollups.weaknesses(rollups.topics(_observed(spark, d)))


@query(f"WITH {_TOPICS} SELECT problem_id, arg_max(outcome, event_id) AS last_outcome FROM e GROUP BY problem_id HAVING arg_max(outcome, event_id) <> 'positive'")
def pending_problems(spark: SparkSession, d: str) -> DataFrame:
    return rollups.pending_problems(_observed(spark, d))


_PROFILE = f"obs AS (SELECT event_id AS seq, 'k' || event_id AS key, event_type IN ('view', 'click') AS dimension, 's' || (user_id % 30) AS subject, CASE WHEN event_id % 9 = 0 THEN 'negative' WHEN event_id % 2 = 0 THEN 'positive' ELSE 'neutral' END AS polarity, 'src' || (event_id % 4) AS source, CASE WHEN event_id % 13 = 0 THEN 'k' || (event_id - 4) END AS replaces FROM events)"


@query(f"""WITH {_PROFILE}, active AS (SELECT * FROM obs WHERE key NOT IN (SELECT replaces FROM obs WHERE replaces IS NOT NULL)),
last AS (SELECT *, max(CASE WHEN polarity = 'negative' THEN seq END) OVER (PARTITION BY dimension, subject) AS ln FROM active)
SELECT dimension, subject, CASE WHEN any_value(ln) IS NULL AND count(*) FILTER (WHERE polarity = 'positive') > 0 THEN 'strength' WHEN any_value(ln) IS NULL THEN 'neutral' WHEN count(DISTINCT CASE WHEN polarity = 'positive' AND seq > ln THEN source END) >= 2 THEN 'closed' ELSE 'weakness' END AS bucket,
  count(DISTINCT CASE WHEN polarity = 'positive' AND seq > ln THEN source END) AS confirmed FROM last GROUP BY dimension, subject""")
def profile_buckets(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    rows = tables.table(spark, d, "events").select(k.alias("seq"), F.concat(F.lit("k"), k).alias("key"), F.col("event_type").isin("view", "click").alias("dimension"), F.concat(F.lit("s"), F.col("user_id") % 30).alias("subject"), F.when(k % 9 == 0, "negative").when(k % 2 == 0, "positive").otherwise("neutral").alias("polarity"), F.concat(F.lit("src"), k % 4).alias("source"), F.when(k % 13 == 0, F.concat(F.lit("k"), k - 4)).alias("replaces"))
    return rollups.profile(rows)


def _reviews(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_orderkey")
    return tables.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("seq"), F.max("l_quantity").alias("q")).select(k.alias("session"), F.col("l_linenumber").alias("version"), "seq", (k % 50).alias("question"), (F.col("seq") % 3).alias("variant"), (F.col("q") > 30).alias("passed"))


_REVIEWS = "reviews AS (SELECT l_orderkey AS session, l_linenumber AS version, max(l_partkey) AS seq, l_orderkey % 50 AS question, max(l_partkey) % 3 AS variant, max(l_quantity) > 30 AS passed FROM lineitem GROUP BY l_orderkey, l_linenumber)"


@query(f"WITH {_REVIEWS} SELECT session, version, seq, question, variant, passed FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY version DESC, seq DESC) AS r FROM reviews) WHERE r = 1")
def interview_selection(spark: SparkSession, d: str) -> DataFrame:
    return rollups.selected_reviews(_reviews(spark, d))


@query(f"""WITH {_REVIEWS}, s AS (SELECT question, count(DISTINCT CASE WHEN passed THEN session END) AS sessions, count(DISTINCT CASE WHEN passed THEN variant END) AS variants FROM reviews GROUP BY question)
SELECT *, CASE WHEN sessions >= 2 AND variants >= 2 THEN 'closed' ELSE 'open' END AS status FROM s""")
def interview_closure(spark: SparkSession, d: str) -> DataFrame:
    return rollups.interview_closure(_reviews(spark, d))


_SCORES = "scores AS (SELECT CAST(ts AS DATE) AS day, 'q' || (user_id % 60) AS question, event_id AS seq, value AS score FROM events)"


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return tables.table(spark, d, "events").select(F.to_date("ts").alias("day"), F.concat(F.lit("q"), F.col("user_id") % 60).alias("question"), F.col("event_id").alias("seq"), F.col("value").alias("score"))


@query(f"WITH {_SCORES} SELECT day, question, min(seq) AS seq, arg_min(score, seq) AS score FROM scores GROUP BY day, question")
def first_score_per_day(spark: SparkSession, d: str) -> DataFrame:
    return rollups.first_scores(_scores(spark, d))


@query(f"""WITH {_SCORES}, firsts AS (SELECT day, question, min(seq) AS seq, arg_min(score, seq) AS score FROM scores GROUP BY day, question),
lists AS (SELECT question, list(score ORDER BY seq) AS s FROM firsts GROUP BY question)
SELECT question, CAST(list_reduce(list_transform(s, lambda x: CAST(x AS DECIMAL(18, 4))), lambda a, x: CAST(round(CAST(CAST(0.6 AS DECIMAL(2, 1)) * CAST(x AS DECIMAL(18, 4)) + CAST(0.4 AS DECIMAL(2, 1)) * CAST(a AS DECIMAL(18, 4)) AS DECIMAL(24, 6)), 2) AS DECIMAL(18, 4))) AS DOUBLE) AS mastery, CAST(len(s) AS INTEGER) AS n FROM lists""")
def mastery_ewma(spark: SparkSession, d: str) -> DataFrame:
    return rollups.mastery(rollups.first_scores(_scores(spark, d)))


@query("WITH q AS (SELECT p_brand AS grp, p_partkey AS question FROM part) SELECT grp AS \"group\", count(t.question) AS tested, count(*) AS total FROM q LEFT JOIN (SELECT DISTINCT l_partkey AS question FROM lineitem WHERE l_quantity > 48) t ON t.question = q.question GROUP BY grp")
def topic_coverage(spark: SparkSession, d: str) -> DataFrame:
    questions = tables.table(spark, d, "part").select(F.col("p_brand").alias("group"), F.col("p_partkey").alias("question"))
    return rollups.coverage(questions, tables.table(spark, d, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("question")))


@query("SELECT user_id, seq, outcome FROM (SELECT user_id, event_id AS seq, " + _OUTCOME + " AS outcome, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 5")
def recent_issues(spark: SparkSession, d: str) -> DataFrame:
    return rollups.recent(_observed(spark, d), "user_id", "seq").select("user_id", "seq", "outcome")


@query("""WITH req AS (SELECT 'i' || o_orderkey AS intent_key, md5(CAST(o_orderkey % 3 AS VARCHAR)) AS content_hash, o_orderkey FROM orders), known AS (SELECT 'i' || o_orderkey AS k, md5('0') AS h FROM orders WHERE o_orderkey % 2 = 0), alias AS (SELECT 'i' || o_orderkey AS a, 'i' || (o_orderkey + 1) AS t FROM orders WHERE o_orderkey % 5 = 0)
SELECT intent_key, CASE WHEN k IS NULL THEN 'new' WHEN h <> content_hash THEN 'conflict' WHEN t IS NOT NULL THEN 'alias' ELSE 'replay' END AS decision FROM req LEFT JOIN alias ON a = intent_key LEFT JOIN known ON k = coalesce(t, intent_key)""")
def intent_decision(spark: SparkSession, d: str) -> DataFrame:
    orders, k = tables.table(spark, d, "orders"), F.col("o_orderkey")
    key = lambda c: F.concat(F.lit("i"), c)
    requests = orders.select(key(k).alias("intent_key"), F.md5((k % 3).cast("string").cast("binary")).alias("content_hash"))
    known = orders.where(k % 2 == 0).select(key(k).alias("intent_key"), F.md5(F.lit("0").cast("binary")).alias("content_hash"))
    return rollups.intent(requests, known, orders.where(k % 5 == 0).select(key(k).alias("intent_key"), key(k + 1).alias("target_key")))
