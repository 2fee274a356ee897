"""Sources and sinks: observations, locations and chain records as DataFrames, Parquet in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafield.operators.ranges import numbered


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def write(df: DataFrame, path: str, partition_by: str | None = None, mode: str = "append") -> None:
    """Appends long-format records, e.g. partitioned by param so that a query reads its parameters only."""
    out = df.write.mode(mode)
    (out.partitionBy(partition_by) if partition_by else out).parquet(path)


def lattice_observations(lineitem: DataFrame) -> DataFrame:
    """obs(x, y, z, cov): many observations on few locations."""
    d = lambda c: F.col(c).cast("double")
    return lineitem.select(d("l_quantity").alias("x"), d("l_discount").alias("y"), d("l_extendedprice").alias("z"), d("l_tax").alias("cov"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def point_locations(embeddings: DataFrame) -> DataFrame:
    """locs(loc_id, x, y, label): the first two components of each vector."""
    return embeddings.select(F.col("vec_id").alias("loc_id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), "label")


def chain_records(events: DataFrame, components: int = 1) -> DataFrame:
    """records(chain, iteration, i, value): one chain per event type (five of them, so their starts are sent to all tasks), numbered by time; i spreads
    rows over components."""
    rows = numbered(events.select("event_type", "ts", "event_id", "user_id", "value"), [F.col(c).asc() for c in ("event_type", "ts", "event_id")])
    starts = rows.groupBy(F.col("event_type").alias("_type")).agg(F.min("rank").alias("_start"))
    rows = rows.join(F.broadcast(starts), F.col("event_type").eqNullSafe(F.col("_type")))
    i = F.pmod(F.col("user_id"), F.lit(components)).cast("int")
    return rows.select(F.col("event_type").alias("chain"), (F.col("rank") - F.col("_start") + 1).cast("int").alias("iteration"), i.alias("i"), F.col("value").cast("double").alias("value"))
