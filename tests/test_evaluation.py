import pytest

from stratavox.operators import evaluation as ev, reporting as rp
from stratavox.operators.drivability import drivability
from pyspark.sql import functions as F


def pairs(spark, gt, pred):
    return spark.createDataFrame([(0, i, a, b) for i, (a, b) in enumerate(zip(gt, pred))], "frame_no int, seq long, gt int, pred int")


def test_iou_by_hand(spark):
    cm = ev.confusion(pairs(spark, [1, 1, 1, 9, 9, 9, 9, 0], [1, 1, 9, 9, 9, 9, 1, 5]))
    iou = {r.class_id: r.iou for r in ev.iou_per_class(cm).collect()}
    assert iou[1] == pytest.approx(2 / 4) and iou[9] == pytest.approx(3 / 5)
    m = ev.miou(cm).first()
    assert m.miou == pytest.approx(0.55) and m.classes_present == 2


def test_absent_class_is_null(spark):
    r = ev.frame_accuracy(pairs(spark, [9, 9, 11], [9, 11, 11])).first()
    assert r.accuracy == pytest.approx(2 / 3) and r.car_iou is None and r.person_iou is None


def test_bands_are_closed_on_the_left(spark):
    df = spark.createDataFrame([(9.999, 0.0), (10.0, 0.0), (0.0, 30.0), (60.0, 0.0)], "x double, y double")
    assert [r[0] for r in df.select(ev.distance_band(F.col("x"), F.col("y"))).collect()] == [0, 1, 2, 3]


def test_perfect_labels_and_points_without_cells(spark):
    from stratavox.operators.grid import build_grid

    rows = [(0, i, 15.0 + i % 7, 3.0 + i % 5, -1.7, c, 1.0, c) for i, c in enumerate([1, 9, 9, 13, 6] * 20)]
    p = spark.createDataFrame(rows, "frame_no int, seq long, x double, y double, z double, cls int, conf double, gt int")
    cells = build_grid(p)
    total = ev.grid_accuracy(ev.evaluated_cells(p, cells)).filter("level is null").first()
    assert total.cells > 0 and total.correct <= total.cells
    far = spark.createDataFrame([(0, 999, 500.0, 500.0, 0.0, 1, 1.0, 1), (0, 1000, 501.0, 500.0, 0.0, 9, 1.0, 9)], p.schema)
    s = ev.obstacle_safety(far, cells).first()
    assert (s.obs, s.obs_missed, s.drv, s.drv_blocked) == (1, 1, 1, 0)


def test_power_as_of(spark):
    iv = spark.createDataFrame([(0, 0.0, 1.0), (1, 2.0, 2.5), (2, 2.2, 2.3), (3, 500.0, 700.0)], "interval long, start double, end double")
    rd = spark.createDataFrame([(0, 0.5, 1.0), (1, 1.5, 2.0), (2, 2.1, 3.0), (3, 2.4, 4.0), (4, 650.0, 5.0), (5, -1.0, 6.0), (6, 2.0, 7.0)], "reading long, t double, watts double")
    got = {r.reading: r.interval for r in rp.power_during(rd, iv).collect()}
    assert got == {0: 0, 2: 1, 4: 3, 6: 1}  # 2.4 belongs to the latest start, which has ended


def test_latency_and_real_time(spark):
    t = rp.add_totals(spark.createDataFrame([(i, f"{i:06d}", 1.0, 2.0, float(i), None, 4.0, None, 1.0, 500.0) for i in range(1, 101)], "frame_no long, frame string, upload double, project double, model double, post double, grid_gpu double, grid_cpu double, grid_to_cpu double, vram_mb double"))
    by = {r.stage: r for r in rp.latency_summary(t).collect()}
    assert by["model"].median_ms == 50.5 and by["model"].max_ms == 100 and by["grid_engine_total"].mean_ms == 5
    r = rp.real_time_summary(t).first()
    assert r.slowest_frame == "000100" and r.pct_within_100ms == pytest.approx(0.91)


def test_records_take_the_first_of_equals(spark):
    a = spark.createDataFrame([(1, 0.9, 0.5, None, 60, 5), (2, 0.9, 0.8, 0.7, 10, 30), (3, 0.1, 0.4, 0.9, 70, 19)], "frame_no int, accuracy double, car_iou double, person_iou double, gt_car_points long, gt_person_points long")
    got = {r.record: (r.frame_no, r.value) for r in rp.record_frames(a).collect()}
    assert got == {"highest_accuracy": (1, 0.9), "highest_car_iou": (1, 0.5), "highest_person_iou": (2, 0.7)}


def test_stress_test_falls_back_to_predictions(spark):
    c = spark.createDataFrame([(1, 5, 1, 2, 2), (2, None, None, 9, 0)], "frame_no int, gt_car long, gt_person long, pred_car long, pred_person long")
    r = rp.stress_test(c).first()
    assert (r.source, r.frame_no, r.car_points) == ("predicted", 2, 9)


def test_histogram_of_equal_values(spark):
    t = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    assert [tuple(r) for r in rp.histogram(t, "v").collect()] == [(0, 2)]


def test_drivability_rules(spark):
    rows = [(1, 0.0, 1.0), (0, 0.0, 1.0), (9, 0.9, 1.0), (9, 0.1, 1.0), (9, 0.6, 1.0), (9, 0.1, 0.2), (17, 0.1, 1.0), (15, 0.1, 1.0)]
    df = spark.createDataFrame(rows, "c int, q double, p double")
    code = lambda profile: [r[0] for r in df.select(drivability(F.col("c"), F.col("q"), F.col("p"), profile)).collect()]
    assert code("on-road") == [2, 2, 2, 0, 1, 1, 1, 2]
    assert code("off-road") == [2, 2, 2, 0, 1, 1, 0, 1]
