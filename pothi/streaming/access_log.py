"""The access log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pothi.operators.logs import log_time
from pothi.plans.lineage import new_path


def stream(spark: SparkSession, folder: str) -> DataFrame:
    """Log entries as they arrive in the folder of the table, each retry once within ten days of its time."""
    path = f"{folder}/access_log.parquet"
    schema = spark.read.parquet(path).schema
    # A single file is found by a pattern on its name; a folder of part files is watched whole.
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8)
    log = source.option("pathGlobFilter", "access_log.parquet").parquet(folder) if _is_file(spark, path) else source.parquet(path)
    at = log.withColumn("at", log_time(F.col("ts"))).withWatermark("at", "10 days")
    return at.dropDuplicatesWithinWatermark(["ts", "name", "method", "path"])


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def daily_counts_stream(spark: SparkSession, folder: str) -> DataFrame:
    """day, n: requests of each UTC day, counted by a stream over all that is there."""
    out = new_path(spark, "days")
    days = stream(spark, folder).groupBy(F.window("at", "1 day").alias("w")).agg(F.count("*").alias("n"))

    def store(batch: DataFrame, number: int) -> None:
        # Days that changed, by batch: the latest count of a day holds. A batch run again replaces its own rows.
        batch.select(F.to_date("w.start").cast("string").alias("day"), "n").write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = days.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", new_path(spark, "stream")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.option("basePath", out).parquet(out).groupBy("day").agg(F.max_by("n", "batch").alias("n"))
