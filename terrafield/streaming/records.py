"""Running diagnostics on a stream of chain records: an extra beside the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafield.operators.sampler import RECORDS


def read_records(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Records as chains append them to a folder."""
    return spark.readStream.schema(RECORDS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def running_summary(records: DataFrame) -> DataFrame:
    """Mean, sd and count of each parameter and chain so far; state of one row a component."""
    return records.groupBy("chain", "param", "i", "j").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))


def start_summary(spark: SparkSession, folder: str, name: str, checkpoint: str):
    """Keeps running_summary in the memory table `name`."""
    return running_summary(read_records(spark, folder)).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()


def each_batch_psrf(spark: SparkSession, folder: str, param: str, sink, checkpoint: str):
    """Calls sink(psrf table, batch id) on all records so far whenever new ones arrive."""
    from terrafield.operators.diagnostics import psrf

    def run(_batch: DataFrame, batch_id: int) -> None:
        r = spark.read.schema(RECORDS).parquet(folder).where(F.col("param") == param)
        sink(psrf(r.select("chain", F.col("iteration").alias("i"), F.struct("i", "j").alias("component"), "value"), by=["component"]), batch_id)

    return read_records(spark, folder).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()
