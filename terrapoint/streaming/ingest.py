"""Streaming ingest of point lines into a SpatialIndex."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terrapoint.plans.index import ConcurrentChange, SpatialIndex
from terrapoint.sources.points import parsed_lines


def lines_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """New text files of a folder, some a batch."""
    return parsed_lines(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder))


def ingest(stream: DataFrame, index: SpatialIndex, checkpoint: str, progress: Callable[[int, int], None] | None = None, attempts: int = 5) -> StreamingQuery:
    """Appends each batch to the index as one delta, exactly once: the batch's number is part of the manifest that adds
    its rows, under the checkpoint's name, so a batch that comes again after a crash is known. Points without a label
    are called pt{id}. progress gets (rows so far, batch number)."""

    def add(batch: DataFrame, number: int) -> None:
        rows = batch.select("x0", "x1", "label")
        label = F.coalesce(F.when(F.col("label") != "", F.col("label")), F.concat(F.lit("pt"), F.col("id").cast("string")))
        for attempt in range(attempts):
            index.refresh()
            if index.state.get("streams", {}).get(checkpoint, -1) >= number:
                return
            try:
                index.insert(rows, ["x0", "x1", "label"], lambda r: r.withColumn("label", label), (checkpoint, number))
                break
            except ConcurrentChange:
                if attempt == attempts - 1:
                    raise
        if progress:
            progress(index.state["next_id"], number)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_totals(batches: DataFrame, interval: int) -> DataFrame:
    """checkpoint, rows: cumulative rows at every `interval` rows and at the end. batches: one row an arrival."""
    n = batches.agg(F.count(F.lit(1)).alias("n"))
    steps = F.sequence(F.lit(1).cast("long"), F.greatest(F.ceil(F.col("n") / interval), F.lit(1)).cast("long"))
    return n.where("n > 0").select("n", F.explode(steps).alias("checkpoint")).select("checkpoint", F.least(F.col("checkpoint") * interval, F.col("n")).alias("rows"))
