import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratavox.operators import grid as g
from stratavox.sources import adapter
from tests.scene import plain_grid, scan


def points_df(spark, xyz, cls, conf, frame=0):
    p = pd.DataFrame({"frame_no": np.int32(frame), "seq": np.arange(len(cls)), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2], "remission": xyz[:, 3], "conf": conf, "cls": np.asarray(cls, np.int32), "gt": np.asarray(cls, np.int32)})
    return spark.createDataFrame(p)


@pytest.fixture(scope="module")
def scene(spark):
    xyz, cls, conf = scan()
    df = points_df(spark, xyz, cls, conf).cache()
    cells = g.build_grid(df).cache()
    return xyz, cls, conf, df, cells, cells.toPandas()


def test_equals_plain_grid(scene):
    xyz, cls, conf, df, _, got = scene
    want, counters = plain_grid(xyz, cls, conf)
    index = {(r.level, round(r.x_min / r.resolution), round(r.y_min / r.resolution)): r for r in got.itertuples()}
    assert set(index) == set(want)
    for key, w in want.items():
        r = index[key]
        assert (r.point_count, r.semantic_class, r.min_height, r.max_height) == (w["n"], w["cls"], w["low"], w["high"])
        assert r.elevation == pytest.approx(w["mean"], abs=1e-9) and r.semantic_confidence == pytest.approx(w["won"] / w["total"], abs=1e-9)
    stats = g.grid_stats(df).first().asDict()
    assert {k: stats[k] for k in counters} == counters


def test_every_used_point_counts_once(scene):
    _, cls, *_, got = scene
    assert got.point_count.sum() == (cls != 0).sum()


def test_cells_never_overlap(scene):
    *_, got = scene
    seen = set()
    for r in got.itertuples():
        n = 1 << (3 - r.level)
        x, y = round(r.x_min / 0.05), round(r.y_min / 0.05)
        own = {(x + a, y + b) for a in range(n) for b in range(n)}
        assert not own & seen
        seen |= own


def test_points_lie_in_their_cells(scene):
    _, _, _, df, cells, _ = scene
    at = g.cell_lookup(df.select("frame_no", "seq", "x", "y"), cells.select("frame_no", "key", "tx", "ty", "level", "x_min", "x_max", "y_min", "y_max"))
    assert at.filter("c_key is null").count() == 0
    inside = (F.col("x") >= F.col("c_x_min") - 1e-9) & (F.col("x") < F.col("c_x_max") + 1e-9) & (F.col("y") >= F.col("c_y_min") - 1e-9) & (F.col("y") < F.col("c_y_max") + 1e-9)
    assert at.filter(~inside).count() == 0 and at.count() == df.count()


def test_near_field_is_fine(scene):
    *_, got = scene
    tile_x, tile_y = (got.tx + 0.5) * 0.4, (got.ty + 0.5) * 0.4
    near = tile_x**2 + tile_y**2 < 100
    assert near.any() and (got.level[near] == 3).all()


def test_unlabeled_points_are_dropped(spark, scene):
    xyz, cls, conf, *_ = scene
    cls = cls.copy()
    cls[::50] = 0
    df = points_df(spark, xyz, cls, conf)
    s = g.grid_stats(df).first()
    assert s.n_unlabeled_dropped == len(cls[::50]) and s.n_points_used + s.n_unlabeled_dropped == s.n_points_in
    assert g.build_grid(df).agg(F.sum("point_count")).first()[0] == s.n_points_used


def test_edge_cells(spark):
    """All confidences zero; a border point; negative and clipped coordinates; a
    single point; one leaf promoted alone; only unlabeled points."""
    rows = [
        (0, 20.01, 0.01, 0.0, 9, 0.0), (0, 20.02, 0.02, 0.0, 9, 0.0),  # no score: class 0, which splits
        (1, 0.05, 0.0, 0.0, 9, 1.0), (1, -0.05, -0.001, 0.0, 9, 1.0),
        (2, 2e5, -2e5, 0.0, 9, 1.0),
        (3, 20.0, 0.0, 0.0, 13, 1.0),
        (4, 25.0, 0.0, 0.0, 9, 1.0),
        (5, 1.0, 1.0, 0.0, 0, 1.0),
    ]
    df = spark.createDataFrame(rows, "frame_no int, x double, y double, z double, cls int, conf double")
    got = {k: v for k, v in g.build_grid(df).toPandas().groupby("frame_no")}
    assert (got[0].semantic_class == 0).all() and (got[0].level == 3).all() and (got[0].semantic_confidence == 0).all()
    assert sorted(got[1].x_min.round(2)) == [-0.05, 0.05] and sorted(got[1].y_min.round(2)) == [-0.05, 0.0]
    assert got[2].x_min.iloc[0] == pytest.approx(2097151 // 8 * 0.4) and got[2].level.iloc[0] == 0
    assert got[3].level.iloc[0] == 2 and got[3].point_count.iloc[0] == 1
    assert got[4].level.iloc[0] == 1  # a lone leaf of level 2 goes up one level
    assert 5 not in got
    s = {r.frame_no: r for r in g.grid_stats(df).collect()}
    assert s[5].n_final_cells == 0 and s[5].n_points_used == 0 and s[4].n_merges == 1 and s[0].n_splits == 1


def test_labels_are_checked(spark):
    bad = spark.createDataFrame([(0, 20)], "frame_no int, cls int")
    with pytest.raises(Exception, match="labels must be in"):
        g.checked_labels(bad).collect()


@pytest.mark.parametrize("sf,cells", [("sf0.001", {0: 201, 1: 205, 2: 208, 3: 209}), ("sf0.01", {0: 1428, 1: 1410, 2: 1377, 3: 1381})])
def test_golden_counts(spark, sf, cells):
    got = g.build_grid(adapter.points(spark, f"/root/testdata/{sf}")).groupBy("frame_no").count()
    assert dict(got.collect()) == cells


def test_one_exchange(spark, sf):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = g.build_grid(adapter.points(spark, sf))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan
