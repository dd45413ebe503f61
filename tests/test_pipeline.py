"""One call from scans to results, with a model and without."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratavox.config import SensorConfig
from stratavox.operators import pipeline, reporting as rp
from stratavox.operators.grid import build_grid, grid_stats


@pytest.fixture(scope="module")
def points(spark):
    r = np.random.default_rng(4)
    n = 3000
    a, d = r.uniform(-np.pi, np.pi, n), r.uniform(4, 50, n)
    return spark.createDataFrame(pd.DataFrame({"frame_no": (np.arange(n) % 3).astype("int32"), "seq": np.arange(n), "x": d * np.cos(a), "y": d * np.sin(a), "z": r.uniform(-1.8, 0.5, n), "remission": r.random(n), "cls": r.integers(1, 20, n).astype("int32"), "conf": r.integers(1, 64, n) / 64})).cache()


def test_with_given_labels(points):
    got = pipeline.process(points)
    assert got.cells.exceptAll(build_grid(points)).count() == 0 and got.stats.collect() == grid_stats(points).collect()
    assert got.labels.count() == points.count()


def test_with_a_model(points):
    sensor = SensorConfig(height=16, width=128)

    def model(dense):
        depth = dense[0]
        scores = np.full((20, 16, 128), 0.01, np.float32)
        scores[9], scores[1] = np.where(depth > 0, 0.75, 0.25), np.where(depth > 0, 0.25, 0.75)
        return scores

    got = pipeline.process(points, model, sensor)
    labels = got.labels.cache()
    assert labels.count() == points.count() and set(x.cls for x in labels.select("cls").distinct().collect()) <= {1, 9}
    # the confidence is the final class's score at the point's pixel, not the pixel's best
    rows = labels.collect()
    assert all(r.conf in (0.25, 0.75) and (r.conf == 0.75) == (r.cls == r.pixel_cls) for r in rows)
    assert any(r.cls != r.pixel_cls for r in rows)
    assert got.cells.agg(F.sum("point_count")).first()[0] == points.count()
    plain = pipeline.segment_points(points, model, sensor, vote=False)
    assert plain.filter("cls <> pixel_cls or conf <> 0.75").count() == 0


def test_stage_times(points):
    got = pipeline.stage_times(points)
    assert list(got) == ["keys", "cells", "split", "merge", "finalize"] and all(v >= 0 for v in got.values())


@pytest.mark.parametrize("bins", [1, 7, 4096])
def test_percentiles_equal_numpy(spark, bins):
    r = np.random.default_rng(bins)
    t = pd.DataFrame({"a": r.normal(size=500), "b": np.where(r.random(500) < 0.9, 3.0, r.random(500)), "c": np.full(500, 2.5), "d": np.where(r.random(500) < 0.3, np.nan, r.exponential(size=500))})
    df = spark.createDataFrame(t).select("a", "b", "c", F.when(~F.isnan("d"), F.col("d")).alias("d"), F.lit(None).cast("double").alias("e"))
    got = {(x.stage, x.share): x.value for x in rp.percentiles(df, list("abcde"), [0.0, 0.5, 0.95, 0.99, 1.0], bins).collect()}
    want = {(c, q): np.nanquantile(t[c], q) for c in "abcd" for q in (0.0, 0.5, 0.95, 0.99, 1.0)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_marks_take_the_first_of_equals_and_leave_out_what_is_absent(spark):
    rows = [(0, "000000", 0.5, 0.9, 0.4, 49, 20, None), (1, "000001", 0.5, 0.8, None, 50, 0, 12.0), (2, "000002", float("nan"), 0.7, 0.3, 60, 19, 12.0), (3, "000003", None, None, None, None, None, 40.0)]
    schema = "index int, frame string, accuracy double, car_iou double, person_iou double, gt_car_points long, gt_person_points long, end_to_end double"
    got = {r.label: (r.frame, r["index"], r.value) for r in rp.bookmarks(spark.createDataFrame(rows, schema)).collect()}
    assert list(got.values()) == [("000000", 0, 0.5), ("000001", 1, 0.8), ("000000", 0, 0.4), ("000002", 2, 79.0), ("000001", 1, 12.0), ("000003", 3, 40.0)]
    none = spark.createDataFrame([(0, "000000", *[None] * 6)], schema)
    assert rp.bookmarks(none).count() == 0
