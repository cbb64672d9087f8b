"""The moving window of positions as Structured Streaming: watermarks, windows, late rows, state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut


def stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A folder (or one file) of Parquet as a stream."""
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if name.endswith(".parquet"):
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def tumbling(rows: DataFrame, time: str, width: str, lateness: str, keys: list[str], aggregates: dict) -> DataFrame:
    """Aggregates for each window and key; rows later than `lateness` are dropped and state is evicted."""
    grouped = rows.withWatermark(time, lateness).groupBy(F.window(time, width), *keys).agg(*[a.alias(n) for n, a in aggregates.items()])
    return grouped.select(F.col("window.start").alias("window_start"), *keys, *aggregates)


def sessions(rows: DataFrame, time: str, gap: str, lateness: str, keys: list[str], aggregates: dict) -> DataFrame:
    grouped = rows.withWatermark(time, lateness).groupBy(F.session_window(time, gap).alias("window"), *keys).agg(*[a.alias(n) for n, a in aggregates.items()])
    return grouped.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, *aggregates)


def distinct_within(rows: DataFrame, time: str, lateness: str, keys: list[str]) -> DataFrame:
    return rows.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


def ready_chunks(rows: DataFrame, pos: str, width: int) -> DataFrame:
    """Rows with `chunk`, of chunks that every sample has passed: the barrier before a chunk is processed."""
    reached = rows.groupBy("sample").agg(F.max(pos).alias("reached")).agg(F.min("reached").alias("barrier"))
    chunked = rows.withColumn("chunk", F.floor(F.col(pos) / width)).join(F.broadcast(reached))
    return chunked.where((F.col("chunk") + 1) * width <= F.col("barrier")).drop("barrier")


def overlapping_chunks(rows: DataFrame, pos: str, width: int, early: int) -> DataFrame:
    """Rows with each `chunk` that needs them: their own, and later ones that start within `early` places.

    `own` tells the first kind; a chunk reads the others early, to know what reaches into it.
    """
    last = F.floor((F.col(pos) + early) / width)
    chunks = F.sequence(F.floor(F.col(pos) / width), last)
    return rows.withColumn("chunk", F.explode(chunks)).withColumn("own", F.col("chunk") == F.floor(F.col(pos) / width))


def position_time(rows: DataFrame, pos: str) -> DataFrame:
    """Positions as event time, a second each, so that windows of positions are windows of time."""
    return rows.withColumn("at", F.timestamp_seconds(F.col(pos)))


def drained(made: DataFrame, mode: str, store: Callable[[], str]) -> DataFrame:
    """All that a finite stream gives, through a Parquet or memory sink, as a batch DataFrame.

    append goes to files in a folder that `store` names; complete goes through foreachBatch.
    """
    spark = made.sparkSession
    folder = store()
    if mode == "append":
        query = made.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(made.schema).parquet(f"{folder}/out")
    last: dict[str, DataFrame] = {}

    def keep(batch: DataFrame, _: int) -> None:
        last["df"] = cut(batch)

    query = made.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return last.get("df", spark.createDataFrame([], made.schema))


def ordered_or_error(rows: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Rows as they are; an error if one starts before its predecessor in file order.

    For inputs that must come sorted: `sequence` is the place in the file.
    """
    from pyspark.sql import Window

    before = F.lag(time).over(Window.partitionBy(*keys).orderBy("sequence"))
    wrong = F.raise_error(F.concat(F.lit("out of order at "), F.col("sequence").cast("string")))
    return rows.withColumn("__before", before).withColumn(time, F.when(F.col("__before") > F.col(time), wrong.cast(rows.schema[time].dataType)).otherwise(F.col(time))).drop("__before")
