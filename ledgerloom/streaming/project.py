"""Projecting a ledger as a stream.

Summaries: a batch folds its own events and merges them into the state of the
batch before it; the new version is written to a folder named by the batch, so a
batch that runs again writes the same thing in the same place, and a restarted stream goes on
from the folder. Counts, greatest sequences and last values merge in any order, so any
cut into batches gives the full fold's result.

Documents: the fold of a node is a stateful operator, keyed by node, whose state (document,
named versions, open conflicts, last sequence) Spark keeps and checkpoints.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.plans.fold import RESULT, NodeFold, outcome


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Events of a Parquet table as a stream; the time is an instant, as watermarks need it.

    A stream reads folders: the table's name is a pattern in the folder above, whether it is a file or a folder of files.
    """
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.parquet")
    single = spark.read.parquet(path).inputFiles()[0].rstrip("/").endswith(f"/{name}")
    stream = reader.option("pathGlobFilter", name).parquet(folder) if single else reader.parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in schema.names else stream


def complete(spark: SparkSession, folder: str) -> list[str]:
    """The numbered folders below one that a writer has finished, the last number last."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path):
        return []
    names = [s.getPath().getName() for s in store.listStatus(path) if s.isDirectory()]
    done = [n for n in names if n.rpartition("=")[2].isdigit() and store.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
    return [f"{folder}/{n}" for n in sorted(done, key=lambda n: int(n.rpartition("=")[2]))]


def summarize(events: DataFrame) -> DataFrame:
    """Per user: how many events, the last sequence and its type."""
    return events.groupBy("user_id").agg(F.count("*").alias("n_events"), F.max("event_id").alias("last_event_id"), F.max_by("event_type", "event_id").alias("last_type"))


def combine(state: DataFrame, change: DataFrame) -> DataFrame:
    return state.unionByName(change).groupBy("user_id").agg(F.sum("n_events").alias("n_events"), F.max("last_event_id").alias("last_event_id"), F.max_by("last_type", "last_event_id").alias("last_type"))


def project(spark: SparkSession, stream: DataFrame, folder: str) -> DataFrame:
    """Run the stream over all there is new and return the last version of the state. Run again on the same folder, it goes on from there."""
    schema = summarize(spark.createDataFrame([], "user_id bigint, event_id bigint, event_type string")).schema
    path = lambda batch_id: f"{folder}/state/batch={batch_id}"

    def step(batch: DataFrame, batch_id: int) -> None:
        # Batches are numbered without gaps, so the state before this batch is that of the number before.
        before = spark.read.schema(schema).parquet(path(batch_id - 1)) if batch_id else spark.createDataFrame([], schema)
        combine(before, summarize(batch)).write.mode("overwrite").parquet(path(batch_id))

    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    last = complete(spark, f"{folder}/state")
    return spark.read.schema(schema).parquet(last[-1]) if last else spark.createDataFrame([], schema)


def _fold_node(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """A batch's requests of one node in order of sequence; those at or below the last one folded are told as ``late``."""
    text, last = state.get if state.exists else (None, None)
    node = NodeFold.of(json.loads(text)) if text else NodeFold()
    rows = pd.concat([*frames]).sort_values("event_seq", kind="stable")  # of one batch
    out = []
    for row in rows.itertuples(index=False):
        if last is not None and row.event_seq <= last:
            out.append((row.node_id, row.event_seq, row.request_id, "late", node.revision, None, None, None))
            continue
        base = None if pd.isna(row.base_revision) else int(row.base_revision)
        effect, conflicts = node.apply(row.operation, base, json.loads(row.changes) if isinstance(row.changes, str) else [], row.request_id)
        out.append(outcome(row, node, effect, conflicts))
        last = row.event_seq
    state.update((json.dumps(node.state()), int(last)))
    yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in RESULT.split(", ")])


def fold_stream(spark: SparkSession, requests: DataFrame, folder: str) -> DataFrame:
    """Outcomes (columns of ``plans.fold.RESULT``) of a stream of requests, as ``fold_snapshots`` gives them for a table of the same.

    A batch's requests of a node meet in memory, what a node keeps between batches is
    Spark's state: its document and all its versions, as later batches may name any of them. Late
    requests have the effect ``late`` and change nothing: a side output by ``where``.
    """
    rows = requests.select(F.col("node_id").cast("string"), F.col("event_seq").cast("bigint"), "request_id", "operation", F.col("base_revision").cast("bigint"), "changes")
    out = rows.groupBy("node_id").applyInPandasWithState(_fold_node, RESULT, "node string, last bigint", "append", "NoTimeout")
    out.writeStream.format("parquet").option("path", f"{folder}/outcomes").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/outcomes")


def deduplicate(spark: SparkSession, stream: DataFrame, folder: str, keys: list[str], delay: str = "40 days") -> DataFrame:
    """The first row of every key within the delay; older state is dropped, so it stays bounded."""
    schema = stream.schema
    once = stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)
    once.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/rows")


def rebuild(spark: SparkSession, events: DataFrame, folder: str, generation: int) -> DataFrame:
    """Write a full fold as a new generation. It becomes the current one when its writer has finished, in one step; older ones are left as they are."""
    summarize(events).write.mode("overwrite").parquet(f"{folder}/generation={generation}")
    return spark.read.parquet(current(spark, folder))


def current(spark: SparkSession, folder: str) -> str:
    """The last generation that is complete."""
    return complete(spark, folder)[-1]
