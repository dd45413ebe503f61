"""From scans to labels, cells and counters, and the time of every stage."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from stratavox.config import GridConfig, SensorConfig
from stratavox.operators import grid as g, range_image as ri
from stratavox.operators.keys import CFG


@dataclass(frozen=True)
class FrameResult:
    """labels (frame_no, seq, cls, conf, pixel_cls), cells and stats of all frames; each is lazy."""

    labels: DataFrame
    cells: DataFrame
    stats: DataFrame


def segment_points(points: DataFrame, model: Callable, sensor: SensorConfig = ri.SENSOR, vote: bool = True) -> DataFrame:
    """(frame_no, seq, cls, conf, pixel_cls): labels of every point by an injected model.

    cls is the neighbour vote, or the pixel's class without it; conf is the model's
    score of the final class at the point's pixel.
    """
    p = ri.project(points, sensor)
    scores = ri.segment(ri.channels(p, sensor), model, sensor)
    near = scores.select("frame_no", "py", "px", "depth", "cls")
    pixel = ri.pixel_labels(p, scores)
    labels = ri.knn_vote(p, near, sensor) if vote else pixel.withColumnRenamed("pixel_cls", "label")
    return ri.point_confidence(labels, p, scores).join(pixel, ["frame_no", "seq"])


def process(points: DataFrame, model: Callable | None = None, sensor: SensorConfig = ri.SENSOR, cfg: GridConfig = CFG, vote: bool = True) -> FrameResult:
    """Points (frame_no, seq, x, y, z, remission) of any number of frames to their results.

    Without a model the points bring their labels (cls, conf) along.
    """
    if model is None:
        labels = points.select("frame_no", "seq", "cls", "conf", F.col("cls").alias("pixel_cls"))
        labelled = points
    else:
        labels = segment_points(points, model, sensor, vote)
        labelled = points.drop("cls", "conf").join(labels.drop("pixel_cls"), ["frame_no", "seq"])
    return FrameResult(labels, g.build_grid(labelled, cfg), g.grid_stats(labelled, cfg))


def stage_times(points: DataFrame, cfg: GridConfig = CFG) -> dict[str, float]:
    """Milliseconds that every stage of the grid adds to the ones before it.

    Spark fuses the stages, so each prefix of the plan is run on its own.
    """
    parts = g.partials(points, cfg)
    leaves = g.stage2(points, cfg)
    states = g.merged_cells(g.merge_groups(leaves, cfg))
    prefixes = {"keys": g.with_tiles(g.drop_unlabeled(points), cfg), "cells": parts, "split": leaves, "merge": states, "finalize": g.finalize(states, cfg)}
    out, before = {}, 0.0
    for name, df in prefixes.items():
        start = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        taken = (time.perf_counter() - start) * 1000
        out[name], before = max(taken - before, 0.0), taken
    return out
