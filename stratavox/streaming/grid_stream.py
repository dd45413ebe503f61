"""The grid as a stream of scans.

Frames are whole units, so the grid is stateless across micro-batches: every
trigger runs the batch plan on the frames that arrived. A frame must come within
one trigger, as a scan file does; one that goes on in a later trigger would give
overlapping cells, so the stream refuses it. Running confusion counts and rolling
latencies are true streaming aggregations.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratavox.config import GridConfig
from stratavox.operators.grid import build_grid
from stratavox.operators.keys import CFG


def start_grid_stream(points: DataFrame, path: str, checkpoint: str, cfg: GridConfig = CFG, available_now: bool = True):
    """Writes the cells of every micro-batch below ``path``, a folder per batch, so
    a batch that is run again after a failure replaces its own output. The frames
    of every batch are listed beside it, to refuse a frame that comes again."""
    listed = f"{path.rstrip('/')}_frames"

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        batch.select("frame_no").distinct().write.mode("overwrite").parquet(f"{listed}/batch={number}")
        known = spark.read.parquet(listed)
        again = known.filter(F.col("batch") < number).join(known.filter(F.col("batch") == number).select("frame_no"), "frame_no", "left_semi").first()
        if again is not None:
            raise ValueError(f"frame {again.frame_no} came in batch {again.batch} and goes on in batch {number}")
        build_grid(batch, cfg).write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.unpersist()

    writer = points.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()


def running_confusion(labelled: DataFrame) -> DataFrame:
    """Streaming counts by (gt, pred); state is at most classes squared rows."""
    return labelled.filter("gt > 0").groupBy("gt", "pred").agg(F.count("*").alias("n"))


def rolling_latency(timings: DataFrame, window: str = "10 seconds", late: str = "30 seconds") -> DataFrame:
    """Count, mean and worst of end_to_end per tumbling window of event time ``ts``."""
    t = timings.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"))
    return t.agg(F.count("*").alias("frames"), F.avg("end_to_end").alias("mean_ms"), F.max("end_to_end").alias("max_ms")).select("w.start", "w.end", "frames", "mean_ms", "max_ms")


def stream_to_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams the points of the test table through the grid and reads the cells back."""
    from stratavox.sources.adapter import points

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    where = f"{base.rstrip('/')}/grid-stream-{uuid.uuid4().hex}"
    points(spark, sf_dir).write.parquet(f"{where}/points")
    schema = spark.read.parquet(f"{where}/points").schema
    query = start_grid_stream(spark.readStream.schema(schema).parquet(f"{where}/points"), f"{where}/cells", f"{where}/checkpoint")
    query.awaitTermination()
    return spark.read.parquet(f"{where}/cells").groupBy("frame_no", "level").agg(F.count("*").alias("n"), F.sum("point_count").alias("points"))
