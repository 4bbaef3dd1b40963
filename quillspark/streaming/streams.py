"""Streaming forms of the incremental operators."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from quillspark.operators.dedup import first_row_per_key
from quillspark.operators.features import extract_features
from quillspark.session import new_path, spread


def read_parquet_stream(spark: SparkSession, folder: str, schema: ST.StructType, glob: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)


def append_within_watermark(stream: DataFrame, id_col: str, time_col: str, delay: str) -> DataFrame:
    """Each id once.  State is bounded: an id is remembered until the watermark has passed it."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([id_col])


def run_to_end(stream: DataFrame, name: str) -> DataFrame:
    """Process what is available, append it to a new table, and return that table."""
    spark = stream.sparkSession
    path = new_path(spark, name)
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", new_path(spark, f"{name}-progress"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _run_name(progress: str) -> str:
    return hashlib.sha256(progress.encode()).hexdigest()[:16]


def stream_append_unseen(stream: DataFrame, store: str, id_col: str = "id", progress: str | None = None):
    """All-time form: each batch adds the rows whose id the stored table does not hold.

    A batch writes its own folder ``run=<name>/batch=<n>`` and does not read what
    this batch or a later one of the run has written, so a batch that is repeated
    after a failure gives the same result.  ``progress`` names the run: the same
    folder goes on with it, a new one adds to whatever the store holds.
    """
    spark = stream.sparkSession
    schema = stream.schema
    progress = progress or new_path(spark, "append-unseen-progress")
    run = _run_name(progress)
    full = ST.StructType(
        schema.fields + [ST.StructField("run", ST.StringType()), ST.StructField("batch", ST.LongType())]
    )
    # an empty first part, so that the store can be read from the first batch on
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{store}/run=none/batch=0")

    def add(batch: DataFrame, batch_id: int) -> None:
        order = [c for c in batch.columns if c != id_col]
        stored = spark.read.schema(full).parquet(store)
        earlier = stored.where((F.col("run") != run) | (F.col("batch") < batch_id))
        once = first_row_per_key(batch, F.col(id_col), order)
        fresh = once.join(earlier.select(id_col), id_col, "left_anti").select(*batch.columns)
        fresh.write.mode("overwrite").parquet(f"{store}/run={run}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(add)
        .option("checkpointLocation", progress).trigger(availableNow=True).start()
    )


def stream_features(stream: DataFrame, store: str, vocabulary: DataFrame | None = None, progress: str | None = None, **options):
    """Style features of all levels, batch by batch: each batch meets the static ``vocabulary`` by a join.

    A batch writes its own folder ``run=<name>/batch=<n>``, again in full if it is repeated after a failure.  Give a written
    vocabulary: every batch reads it.  Ids must be unique inside a batch, and the source must give a batch's rows again
    (files do).  ``options`` are those of ``extract_features``.
    """
    progress = progress or new_path(stream.sparkSession, "features-progress")
    run = _run_name(progress)

    def add(batch: DataFrame, batch_id: int) -> None:
        table = extract_features(spread(batch), vocabulary=vocabulary, **options)
        table.write.mode("overwrite").parquet(f"{store}/run={run}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(add)
        .option("checkpointLocation", progress).trigger(availableNow=True).start()
    )


def stream_posts_per_day(stream: DataFrame, time_col: str = "date", delay: str = "1 day") -> DataFrame:
    """(day, n), final once the watermark has passed the day; later rows are dropped."""
    return (
        stream.withWatermark(time_col, delay)
        .groupBy(F.window(time_col, "1 day").alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").cast("date").alias("day"), "n")
    )
