"""LiDAR-like inputs derived from the test tables.

Units are 1/1024, so sums are exact in any order of summation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stratavox.config import LEARNING_MAP


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """points(frame_no, seq, x, y, z, remission, conf, cls, gt)."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("k"), "user_id", "event_type")
    ground = F.col("event_type").isin("view", "click")
    k, u = F.col("k"), F.col("user_id") % 10

    def at(a: Column, b: Column) -> Column:
        return F.when(ground, a).otherwise(b) / F.lit(1024.0)

    e = e.select(
        (k % 4).cast("int").alias("frame_no"),
        k.alias("seq"),
        at((k * 7919) % 163841 - 81920, (u * 35711) % 122881 - 61440 + (k * 31) % 410 - 205).alias("x"),
        at((k * 104729) % 163841 - 81920, (u * 7001) % 40961 - 20480 + (k * 57) % 410 - 205).alias("y"),
        at((k * 17) % 41 - 1792, (k * 37) % 1536 - 1740).alias("z"),
        ((k % 1024) / F.lit(1024.0)).alias("remission"),
        ((512 + (k * 13) % 512) / F.lit(1024.0)).alias("conf"),
        "event_type",
        "user_id",
    )
    side = F.abs("y")
    cls = (
        F.when(F.col("event_type") == "view", F.when(side < 6, 9).when(side < 8, 11).otherwise(17))
        .when(F.col("event_type") == "click", 15)
        .when(F.col("event_type") == "purchase", 1)
        .when(F.col("event_type") == "error", F.when(F.col("user_id") % 2 == 0, 6).otherwise(13))
        .otherwise(F.when(F.col("seq") % 5 == 0, 0).otherwise(18))
    )
    e = e.withColumn("cls", cls.cast("int"))
    gt = F.when(F.col("seq") % 11 == 0, ((F.col("seq") * 7) % 20).cast("int")).otherwise(F.col("cls"))
    return e.select("frame_no", "seq", "x", "y", "z", "remission", "conf", "cls", gt.alias("gt"))


def raw_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw labels: instance id in the high bits, class id in the low sixteen."""
    ids = F.array(*[F.lit(k) for k in LEARNING_MAP])
    e = table(spark, sf_dir, "events")
    raw = F.shiftleft(F.col("user_id"), 16).bitwiseOR(F.get(ids, (F.col("event_id") % len(LEARNING_MAP)).cast("int")).cast("long"))
    return e.select(F.col("event_id").alias("seq"), raw.alias("raw"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with given pixel coordinates: (frame_no, seq, px, py, depth, cls)."""
    k = F.col("seq")
    return points(spark, sf_dir).select("frame_no", "seq", (k % 64).cast("int").alias("px"), ((k * 5) % 16).cast("int").alias("py"), ((512 + (k * 29) % 4096) / F.lit(128.0)).alias("depth"), "cls")


#: Stage columns and the multiplier and modulus that derive each from order keys.
STAGES = {
    "upload": (31, 127),
    "project": (37, 251),
    "model": (41, 2917),
    "post": (43, 509),
    "grid_gpu": (47, 611),
    "grid_cpu": (53, 97),
    "grid_to_cpu": (59, 211),
}


def frame_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per frame: milliseconds of every stage; grid_cpu is missing on some."""
    k = F.col("o_orderkey")
    cols = [(F.when(k % 3 == 0, F.lit(None)).otherwise((k * p) % q / F.lit(128.0)) if c == "grid_cpu" else (k * p) % q / F.lit(128.0)).alias(c) for c, (p, q) in STAGES.items()]
    return table(spark, sf_dir, "orders").select(k.alias("frame_no"), F.format_string("%06d", k).alias("frame"), *cols, ((k * 61) % 1024 + 400).cast("double").alias("vram_mb"), ((k * 67) % 5000 + 100000).alias("n_points"))


def power_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("reading"), (F.col("event_id") * 3 / F.lit(64.0)).alias("t"), F.col("value").alias("watts"))


def processing_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("event_id") * 7 / F.lit(32.0)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("interval"), start.alias("start"), (start + 0.125).alias("end"))
