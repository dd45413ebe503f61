"""Confusion, IoU, accuracy by distance and grid, obstacle safety."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stratavox.config import CAR, DRIVABLE, DYNAMIC, N_CLASSES, OBSTACLES, PERSON, GridConfig
from stratavox.operators.grid import cell_lookup
from stratavox.operators.keys import CFG

BANDS = ["0-10 m", "10-30 m", "30-60 m", "60+ m"]


def confusion(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, gt, pred, n) over points with a true class."""
    return rows.filter("gt > 0").groupBy(*keys, "gt", "pred").agg(F.count("*").alias("n"))


def iou_per_class(cm: DataFrame, *keys: str) -> DataFrame:
    """(keys, class_id, tp, gt_points, pred_points, iou) for every class that occurs."""
    both = F.inline(F.array(F.struct(F.col("gt").alias("class_id"), F.col("n").alias("g"), F.lit(0).cast("long").alias("p"), F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0).alias("t")), F.struct(F.col("pred").alias("class_id"), F.lit(0).cast("long").alias("g"), F.col("n").alias("p"), F.lit(0).cast("long").alias("t"))))
    s = cm.select(*keys, both).groupBy(*keys, "class_id").agg(F.sum("t").alias("tp"), F.sum("g").alias("gt_points"), F.sum("p").alias("pred_points"))
    return s.withColumn("iou", F.col("tp") / F.greatest(F.col("gt_points") + F.col("pred_points") - F.col("tp"), F.lit(1)))


def miou(cm: DataFrame, *keys: str) -> DataFrame:
    """(keys, miou, classes_present) over classes 1..19 that have true points."""
    present = iou_per_class(cm, *keys).filter((F.col("class_id") >= 1) & (F.col("gt_points") > 0))
    out = present.groupBy(*keys) if keys else present
    return out.agg(F.avg("iou").alias("miou"), F.count("*").alias("classes_present"))


def accuracy(cm: DataFrame, *keys: str) -> DataFrame:
    hit = F.sum(F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0))
    grouped = cm.groupBy(*keys) if keys else cm
    return grouped.agg(F.try_divide(hit.cast("double"), F.sum("n").cast("double")).alias("accuracy"), F.sum("n").alias("points"))


def distance_band(x: Column, y: Column) -> Column:
    """0..3; the edges belong to the band above."""
    r = F.sqrt(x * x + y * y)
    return F.when(r >= 60, 3).when(r >= 30, 2).when(r >= 10, 1).otherwise(0)


def frame_accuracy(rows: DataFrame) -> DataFrame:
    """Accuracy, car and person IoU per frame; null where the class has no true point."""

    def iou(c: int) -> Column:
        both = F.count_if((F.col("gt") == c) & (F.col("pred") == c))
        either = F.count_if((F.col("gt") == c) | (F.col("pred") == c))
        return F.when(F.count_if(F.col("gt") == c) > 0, both / either)

    return rows.filter("gt > 0").groupBy("frame_no").agg(
        F.avg((F.col("gt") == F.col("pred")).cast("double")).alias("accuracy"),
        iou(CAR).alias("car_iou"),
        iou(PERSON).alias("person_iou"),
        F.count_if(F.col("gt") == CAR).alias("gt_car_points"),
        F.count_if(F.col("gt") == PERSON).alias("gt_person_points"),
    )


def evaluated_cells(points: DataFrame, cells: DataFrame, cfg: GridConfig = CFG) -> DataFrame:
    """Cells that hold true points: (frame_no, key, level, resolution, semantic_class, gt_class, correct)."""
    at = cell_lookup(points.filter("gt > 0").select("frame_no", "seq", "x", "y", "gt"), cells.select("frame_no", "tile", "key", "level", "resolution", "semantic_class"), cfg)
    at = at.filter("c_key is not null").select("frame_no", F.col("c_key").alias("key"), F.col("c_level").alias("level"), F.col("c_resolution").alias("resolution"), F.col("c_semantic_class").alias("semantic_class"), "gt", "tile")
    counts = [F.count_if(F.col("gt") == c) for c in range(N_CLASSES)]
    votes = at.groupBy("tile", "frame_no", "key", "level", "resolution", "semantic_class").agg(F.array(*counts).alias("votes"))
    votes = votes.withColumn("gt_class", (F.array_position("votes", F.array_max("votes")) - 1).cast("int"))
    return votes.select("frame_no", "key", "level", "resolution", "semantic_class", "gt_class", (F.col("gt_class") == F.col("semantic_class")).alias("correct"))


def grid_accuracy(evaluated: DataFrame) -> DataFrame:
    """By cell size, and the total (level null): cells, correct, area, area_correct."""
    area = F.col("resolution") * F.col("resolution")
    out = evaluated.rollup("level").agg(F.count("*").alias("cells"), F.count_if("correct").alias("correct"), F.sum(area).alias("area"), F.sum(F.when(F.col("correct"), area).otherwise(0.0)).alias("area_correct"))
    return out.withColumns({"by_cell": F.try_divide(F.col("correct").cast("double"), F.col("cells").cast("double")), "by_area": F.try_divide("area_correct", "area")})


def obstacle_safety(points: DataFrame, cells: DataFrame, cfg: GridConfig = CFG) -> DataFrame:
    """Counters per frame. A point without a cell is a missed obstacle, and never a blocked road."""
    at = cell_lookup(points.select("frame_no", "seq", "x", "y", "gt"), cells.select("frame_no", "tile", "key", "level", "traversability"), cfg)
    blocked = F.coalesce(F.col("c_traversability") < cfg.blocked_below, F.lit(False))
    gt = F.col("gt")
    out = []
    for name, classes, bad, what in (("obs", OBSTACLES, ~blocked, "missed"), ("dyn", DYNAMIC, ~blocked, "missed"), ("drv", DRIVABLE, blocked, "blocked")):
        out += [F.count_if(gt.isin(classes)).alias(name), F.count_if(gt.isin(classes) & bad).alias(f"{name}_{what}")]
    return at.groupBy("frame_no").agg(*out)


def row_normalized(cm: DataFrame) -> DataFrame:
    """Confusion as shares of each true class."""
    total = cm.groupBy("gt").agg(F.sum("n").alias("total"))
    return cm.join(total, "gt").select("gt", "pred", (F.col("n") / F.greatest("total", F.lit(1))).alias("share"))
