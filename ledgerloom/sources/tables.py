"""Sources and sinks: Parquet tables, JSON lines, append, upsert and insert-or-ignore."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_change = T.StructType([T.StructField(n, t) for n, t in (("op", T.StringType()), ("path", T.ArrayType(T.StringType())), ("value", T.StringType()), ("field", T.StringType()), ("itemId", T.StringType()))])
_target = T.StructType([T.StructField(n, T.ArrayType(T.StringType()) if n == "path" else T.StringType()) for n in ("nodeId", "parentId", "name", "kind", "path")])

#: A request as it arrives in JSON lines.
ENVELOPE = T.StructType(
    [
        T.StructField("protocol", T.StringType()),
        T.StructField("apiVersion", T.IntegerType()),
        T.StructField("workspaceEpoch", T.StringType()),
        T.StructField("requestId", T.StringType()),
        T.StructField("operation", T.StringType()),
        T.StructField("target", _target),
        T.StructField("dependsOn", T.ArrayType(T.StringType())),
        T.StructField("baseRevision", T.LongType()),
        T.StructField("changes", T.ArrayType(_change)),
        T.StructField("confirmation", T.StringType()),
        T.StructField("replaces", T.ArrayType(T.StringType())),
    ]
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def requests_from_json(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Envelopes from files of JSON lines; a line that is no JSON gives nulls and its text in ``raw``."""
    schema = T.StructType([*ENVELOPE.fields, T.StructField("raw", T.StringType())])
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "raw").json(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def upsert(current: DataFrame, changed: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The table after ``changed`` has been written over ``current`` by key, the last by ``order`` winning.

    One aggregation with map-side combine: no sort of a key's rows, so a hot key costs no more than others.
    """
    values = [c for c in current.columns if c not in keys]
    both = current.withColumn("_new", F.lit(0)).unionByName(changed.select(*current.columns).withColumn("_new", F.lit(1)))
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct("_new", *order)).alias("_row"))
    return last.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in values)).select(*current.columns)


def insert_or_ignore(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of ``new``, one a key, that ``current`` does not have yet."""
    return new.groupBy(key).agg(F.min(F.struct(*[c for c in new.columns if c != key])).alias("_row")).select(key, "_row.*").join(current.select(key), key, "left_anti").select(*new.columns)


def latest(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row of greatest ``order`` for each key."""
    values = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col(order)).alias("_row")).select(*keys, *(F.col(f"_row.{c}").alias(c) for c in values))


def numbered(rows: DataFrame, by: str, order: Sequence[str], name: str = "n") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)))
