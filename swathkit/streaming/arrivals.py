"""Scene arrivals as a stream: monthly composites that grow as files come in.

The stream keeps moments (count, mean, squared distances) of each tile and day. A day that the watermark has passed leaves the
state for a table; rows that come later are dropped. What is still open is read from the checkpoint's state, so composites are
at hand at any time, and neither they nor the days pass through the driver. The table's writer commits by batch, so a
stream that is stopped and started again from its checkpoint neither loses nor repeats a day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import temporal
from ..sources import storage

DAYS = "tile_id long, day timestamp, n long, mean double, m2 double"


def daily_moments(arrivals: DataFrame, lateness: str = "62 days") -> DataFrame:
    """tile_id, day, n, mean, m2 of a stream of (tile_id, ts, value): a day comes out once the watermark, ``lateness`` behind the latest row, has passed its end."""
    timed = arrivals.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)
    n = F.count("value")
    days = timed.groupBy(F.window("at", "1 day"), "tile_id").agg(n.alias("n"), F.sum("value").alias("total"), F.var_pop("value").alias("var"))
    return days.select(F.col("tile_id").cast("long").alias("tile_id"), F.col("window.start").alias("day"), "n", (F.col("total") / F.nullif("n", F.lit(0))).alias("mean"), (F.col("var") * F.col("n")).alias("m2"))


def run(arrivals: DataFrame, table: str, checkpoint: str, lateness: str = "62 days") -> None:
    """Takes in what has arrived since the last run with this checkpoint and appends the days that closed to ``table``."""
    writer = daily_moments(arrivals, lateness).writeStream.outputMode("append").format("parquet")
    writer.option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def closed_days(spark: SparkSession, table: str) -> DataFrame:
    """The days that have left the state."""
    return spark.read.schema(DAYS).parquet(table)


def open_days(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The days still in the state of the last committed batch: key and buffers of the aggregate, told as moments."""
    day, tile, n, total, m2 = (F.col(c) for c in ("key.window", "key.tile_id", "value.count", "value.sum", "value.m2"))
    state = spark.read.format("statestore").load(checkpoint)
    return state.select(tile.cast("long").alias("tile_id"), day["start"].alias("day"), n.cast("long").alias("n"), (total / F.nullif(n, F.lit(0))).alias("mean"), m2.alias("m2"))


def composites(days: DataFrame) -> DataFrame:
    """tile_id, month, n, mean, m2 of days of moments."""
    month = F.date_trunc("month", F.col("day").cast("timestamp_ntz"))
    return temporal.merge_moments(days.withColumn("month", month), ["tile_id", "month"])


def monthly(spark: SparkSession, path: str) -> DataFrame:
    """tile_id, month, n, value (the mean), m2 of the arrivals in a Parquet path up to its present end, closed days and open ones."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    events = source.parquet(path) if _is_folder(spark, path) else source.option("pathGlobFilter", name).parquet(folder)
    table, checkpoint = storage.scratch(spark, "days"), storage.scratch(spark, "arrivals")
    run(events.select(F.col("user_id").alias("tile_id"), "ts", "value"), table, checkpoint)
    return composites(closed_days(spark, table).unionByName(open_days(spark, checkpoint))).withColumnRenamed("mean", "value")


def _is_folder(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()
