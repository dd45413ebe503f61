"""Drivability of cells on a road or off-road profile, and areas by state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stratavox.config import DRIVABLE, OBSTACLES, OFF_ROAD, UNLABELED, VEGETATION

STATES = ["drivable", "caution", "blocked"]


def drivability(cls: Column, complexity: Column, confidence: Column, profile: str = "on-road", rough_caution: float = 0.5, rough_blocked: float = 0.8, min_confidence: float = 0.5) -> Column:
    """0 drivable, 1 caution, 2 blocked; the order of the rules matters."""
    off = profile == "off-road"
    state = F.when(cls.isin(DRIVABLE), 0).when(cls.isin(OFF_ROAD), 0 if off else 1).when(cls == VEGETATION, 1 if off else 2).otherwise(1)
    doubt = (complexity >= rough_caution) | (confidence < min_confidence)
    return F.when(cls.isin([*OBSTACLES, UNLABELED]) | (complexity >= rough_blocked), 2).when((state == 0) & doubt, 1).otherwise(state)


def frame_drivability(quantized: DataFrame, **options) -> DataFrame:
    """Codes from quantised cells, whose bytes stand for shares of 255."""
    code = drivability(F.col("cls"), F.col("complexity") / F.lit(255.0), F.col("confidence") / F.lit(255.0), **options)
    return quantized.select("frame_no", "ix", "iy", "level", code.alias("code"))


def drivable_area(codes: DataFrame, finest_m: float = 0.05, max_level: int = 3) -> DataFrame:
    """(frame_no, state, area_m2): all three states for every frame, zero where none."""
    size = F.lit(finest_m) * F.expr(f"shiftleft(1, {max_level} - level)")
    per = codes.withColumn("a", size * size).groupBy("frame_no").agg(*[F.sum(F.when(F.col("code") == k, F.col("a")).otherwise(0.0)).alias(s) for k, s in enumerate(STATES)])
    return per.select("frame_no", F.inline(F.array(*[F.struct(F.lit(s).alias("state"), F.col(s).alias("area_m2")) for s in STATES])))
