"""Quantisation of points and cells to the integers of a frame file, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

INT16, UINT8, UINT16 = (-32768, 32767), (0, 255), (0, 65535)


def quantize(v: Column, scale: float, span: tuple[int, int]) -> Column:
    """Round half to even, then clip before the cast."""
    return F.least(F.greatest(F.rint(v.cast("double") * F.lit(scale)), F.lit(float(span[0]))), F.lit(float(span[1]))).cast("int")


def quantize_points(points: DataFrame, stride: int = 1) -> DataFrame:
    p = points.filter(F.col("seq") % max(int(stride), 1) == 0)
    unit = lambda c: F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0))
    return p.select("frame_no", "seq", *[quantize(F.col(c), 100.0, INT16).alias(f"{c}_cm") for c in "xyz"], quantize(unit("remission"), 255.0, UINT8).alias("intensity"), F.col("cls").alias("class"), quantize(unit("conf"), 255.0, UINT8).alias("confidence"), F.col("gt").alias("gt_class"))


def quantize_cells(cells: DataFrame) -> DataFrame:
    index = lambda c: F.least(F.greatest(F.floor(F.col(c) / F.col("resolution") + F.lit(0.5)), F.lit(-32768)), F.lit(32767)).cast("int")
    return cells.select(
        "frame_no",
        index("x_min").alias("ix"),
        index("y_min").alias("iy"),
        "level",
        F.col("semantic_class").alias("cls"),
        quantize(F.col("min_height"), 100.0, INT16).alias("z_min_cm"),
        quantize(F.col("max_height"), 100.0, INT16).alias("z_max_cm"),
        quantize(F.col("elevation"), 100.0, INT16).alias("z_cm"),
        quantize(F.sqrt(F.greatest(F.col("elevation_variance"), F.lit(0.0))), 1000.0, UINT16).alias("z_std_mm"),
        quantize(F.col("traversability"), 255.0, UINT8).alias("trav"),
        quantize(F.col("terrain_complexity"), 255.0, UINT8).alias("complexity"),
        quantize(F.col("semantic_confidence"), 255.0, UINT8).alias("confidence"),
        F.least(F.greatest(F.col("point_count"), F.lit(0.0)), F.lit(65535.0)).cast("int").alias("n_points"),
    )


def dequantize_cells(q: DataFrame, finest_m: float = 0.05, max_level: int = 3) -> DataFrame:
    size = F.lit(finest_m) * F.expr(f"shiftleft(1, {max_level} - level)")
    q = q.withColumn("size", size)
    byte = lambda c: F.col(c) / F.lit(255.0)
    cm = lambda c: F.col(c) / F.lit(100.0)
    return q.select("frame_no", "level", "cls", "size", (F.col("ix") * F.col("size")).alias("x_min"), (F.col("iy") * F.col("size")).alias("y_min"), cm("z_min_cm").alias("min_height"), cm("z_max_cm").alias("max_height"), cm("z_cm").alias("elevation"), (F.col("z_std_mm") / F.lit(1000.0)).alias("height_std"), byte("trav").alias("traversability"), byte("complexity").alias("terrain_complexity"), byte("confidence").alias("semantic_confidence"), "n_points")
