import numpy as np
import pytest
from pyspark.sql import functions as F

from stratavox.functions.quantize import dequantize_cells, quantize_cells, quantize_points
from stratavox.operators.grid import build_grid
from stratavox.sources import adapter, frames


@pytest.fixture(scope="module")
def coded(spark, sf):
    p = adapter.points(spark, sf)
    return quantize_points(p).cache(), quantize_cells(build_grid(p)).cache(), build_grid(p).cache()


def test_scans_and_labels(spark, tmp_path):
    r = np.random.default_rng(1)
    for k in (3, 7, 12):
        v = r.normal(size=(50, 4)).astype("<f4")
        v[4] = np.nan
        v.tofile(tmp_path / f"{k:06d}.bin")
        ((np.arange(50, dtype="<u4") << 16) | 10).tofile(tmp_path / f"{k:06d}.label")
    all_rows = frames.read_scans(spark, str(tmp_path))
    assert all_rows.count() == 150 and all_rows.filter("frame_id = '000003'").count() == 50
    kept = frames.read_scans(spark, str(tmp_path), validate=True, start=4, count=1)
    assert {(x.frame_id, x.n) for x in kept.groupBy("frame_id").agg(F.count("*").alias("n")).collect()} == {("000007", 49)}
    assert kept.filter("seq = 4").count() == 0
    labels = frames.read_labels(spark, str(tmp_path))
    assert labels.count() == 150 and {x.cls for x in labels.select("cls").distinct().collect()} == {1}


def test_bad_scans_are_refused(spark, tmp_path):
    (tmp_path / "000001.bin").write_bytes(b"123")
    with pytest.raises(Exception, match="whole number"):
        frames.read_scans(spark, str(tmp_path)).collect()
    with pytest.raises(ValueError):
        frames.scan_rows(b"")


def test_labeled_upload(spark, tmp_path):
    v = np.array([[1, 2, 3, 0.5, 9], [4, 5, 6, 0.1, 1]], "<f4")
    v.tofile(tmp_path / "000000.bin")
    got = frames.read_scans(spark, str(tmp_path), layout="labeled").orderBy("seq").collect()
    assert [r.cls for r in got] == [9, 1] and {r.conf for r in got} == {1.0}


@pytest.mark.parametrize("level", [None, 6])
def test_frame_round_trip(spark, coded, level):
    p, c, _ = coded
    files = frames.encode_frames(p, c, level)
    out = {r.frame_no: r for r in frames.decode_frames(files).collect()}
    want = {r.frame_no: r.n for r in c.groupBy("frame_no").agg(F.count("*").alias("n")).collect()}
    assert {k: v.n_cells for k, v in out.items()} == want
    for r in files.collect():
        header, sections = frames.parse_frame(bytes(r.content))
        assert all(s["offset"] % 8 == 0 for s in header["sections"]) and header["version"] == 1
        own = c.filter(F.col("frame_no") == r.frame_no).orderBy("level", "ix", "iy").toPandas()
        assert (sections["cells.ixy"] == own[["ix", "iy"]].to_numpy()).all() and (sections["cells.z_std_mm"] == own.z_std_mm).all()
    with pytest.raises(ValueError):
        frames.parse_frame(b"nothing")
    with pytest.raises(TypeError):
        frames.frame_bytes({}, {"x": np.zeros(1)})


def test_frame_files_source_and_sink(spark, coded, tmp_path):
    p, c, _ = coded
    frames.register(spark)
    frames.encode_frames(p, c).write.format("frame_files").mode("append").save(str(tmp_path))
    back = spark.read.format("frame_files").load(str(tmp_path))
    assert sorted(r.frame_id for r in back.select("frame_id").collect()) == ["000000", "000001", "000002", "000003"]


def test_clip_and_manifest(spark, coded, tmp_path):
    import json

    from stratavox.config import class_table
    from stratavox.sources import tables

    p, c, cells = coded
    stats = cells.groupBy("frame_no").agg(F.count("*").alias("n_final_cells"))
    accuracy = stats.filter("frame_no <> 2").select("frame_no", F.lit(0.75).alias("accuracy"), F.lit(None).cast("double").alias("car_iou"))
    timings = stats.select("frame_no", F.lit(31.5).alias("end_to_end"))
    meta = frames.frame_meta(stats, timings, accuracy)
    m = frames.export_clip(p, c, str(tmp_path), stride=3, sequence="08", meta=meta)
    listed = m.orderBy("index").collect()
    assert [r["index"] for r in listed] == [0, 1, 2, 3] and all(r.lite_bytes < r.full_bytes for r in listed)
    for r in listed:
        for kind, stride in (("lite", 3), ("full", 1)):
            raw = (tmp_path / r[kind]).read_bytes()
            assert len(raw) == r[f"{kind}_bytes"]
            header, sections = frames.parse_frame(raw)
            assert header["n_points_total"] == r.n_points and header["n_cells"] == r.n_cells == header["stats"]["n_final_cells"]
            assert header["point_stride"] == stride and len(sections["points.class"]) == p.filter((F.col("frame_no") == int(r.id)) & (F.col("seq") % stride == 0)).count()
            assert header["timing_ms"] == {"end_to_end": 31.5} and header["accuracy"] == (None if r.id == "000002" else {"accuracy": 0.75})
            assert header["sequence"] == "08" and header["units"]["z"] == "cm" and header["level_sizes_m"][3] == 0.05
    marks = spark.createDataFrame([("Fastest end to end (ms)", "000000", 0, 31.5)], "label string, frame string, index long, value double")
    summary = spark.createDataFrame([("CPU", 31.5)], "device string, median_end_to_end_ms double")
    (tmp_path / "manifest.json").write_text(frames.manifest_json(m, class_table(spark), marks, summary, "08", 3))
    row = tables.read_manifest(spark, f"{tmp_path}/manifest.json").first()
    assert (row.frame_count, row.first_frame, row.last_frame, row.fps, row.lite_point_stride) == (4, "000000", "000003", 10, 3)
    assert row.classes[9].name == "road" and row.classes[9].traversability == 0.95 and row.bookmarks[0].value == 31.5
    assert row.frames[1].stats["n_final_cells"] == listed[1].n_cells and row.frames[2].accuracy is None and row.frames[0].accuracy.accuracy == 0.75
    url = tables.read_manifest(spark, f"{tmp_path}/manifest.json").select(F.inline("frames")).select(tables.frame_url("http://h/c/manifest.json", F.col("lite")).alias("u")).first().u
    assert url == "http://h/c/lite/000000.lgf.gz"


def test_decoded_rows_equal_the_encoded(spark, coded, tmp_path):
    p, c, _ = coded
    files = frames.encode_frames(p, c).cache()
    assert frames.decode_cells(files).drop("place").exceptAll(c).count() == 0 and frames.decode_cells(files).count() == c.count()
    back = frames.decode_points(files).drop("place")
    assert back.exceptAll(p.drop("seq")).count() == 0 and back.count() == p.count()
    bare = frames.decode_points(frames.encode_frames(p.drop("gt_class"), c))
    assert bare.filter("gt_class is not null").count() == 0 and bare.count() == p.count()
    frames.register(spark)
    files.write.format("frame_files").option("suffix", ".lgf.gz").mode("append").save(f"file://{tmp_path}")
    assert frames.decode_cells(frames.read_frame_files(spark, str(tmp_path))).count() == c.count()
    # overwriting leaves only the frames of the last write
    files.filter("frame_no = 1").write.format("frame_files").option("suffix", ".lgf.gz").mode("overwrite").save(str(tmp_path))
    assert sorted(x.name for x in tmp_path.glob("*.lgf.gz")) == ["000001.lgf.gz"] and not list(tmp_path.glob("*.tmp"))


def test_scans_with_labels_where_there_are_any(spark, tmp_path):
    (tmp_path / "scans").mkdir(), (tmp_path / "labels").mkdir()
    for k in (1, 2, 3):
        v = np.arange(20, dtype="<f4").reshape(5, 4) + k
        v[3] = np.inf
        v.tofile(tmp_path / "scans" / f"{k:06d}.bin") if k < 3 else np.save(tmp_path / "scans" / f"{k:06d}.npy", v)
        if k != 2:
            np.array([10, 40, 70, 0, (7 << 16) | 10], "<u4").tofile(tmp_path / "labels" / f"{k:06d}.label")
    got = frames.read_scans(spark, str(tmp_path / "scans"), validate=True, labels=str(tmp_path / "labels")).collect()
    by = {k: [r.gt for r in sorted((r for r in got if r.frame_no == k), key=lambda r: r.seq)] for k in (1, 2, 3)}
    assert by == {1: [1, 9, 15, 1], 2: [None] * 4, 3: [1, 9, 15, 1]}
    np.array([10], "<u4").tofile(tmp_path / "labels" / "000002.label")
    with pytest.raises(Exception, match="5 points and 1 labels"):
        frames.read_scans(spark, str(tmp_path / "scans"), labels=str(tmp_path / "labels")).collect()
    with pytest.raises(ValueError, match="4 columns"):
        np.save(tmp_path / "x.npy", np.zeros((3, 5)))
        frames.scan_rows((tmp_path / "x.npy").read_bytes())


def test_cells_are_written_in_order(spark, coded, tmp_path):
    from stratavox.sources.tables import write_cells

    *_, cells = coded
    write_cells(cells, f"{tmp_path}/cells")
    import pyarrow.parquet as pq

    n = 0
    for f in (tmp_path / "cells").glob("*.parquet"):
        t = pq.read_table(f, columns=["frame_no", "key"]).to_pandas()
        assert t.sort_values(["frame_no", "key"]).equals(t)
        n += len(t)
    assert n == cells.count()


def test_quantisation_bounds(coded):
    _, q, cells = coded
    a = dequantize_cells(q).toPandas().sort_values(["frame_no", "level", "x_min", "y_min"]).reset_index()
    b = cells.toPandas().sort_values(["frame_no", "level", "x_min", "y_min"]).reset_index()
    assert (abs(a.elevation - b.elevation) <= 0.005 + 1e-6).all() and (abs(a.traversability - b.traversability) <= 0.5 / 255 + 1e-9).all()


def test_rounding_is_half_even_and_clipped(spark):
    from stratavox.functions.quantize import INT16, UINT8, quantize

    df = spark.createDataFrame([(2.5, 1e9), (3.5, -1e9)], "a double, b double")
    got = df.select(quantize(F.col("a"), 1.0, UINT8), quantize(F.col("b"), 100.0, INT16)).collect()
    assert [tuple(r) for r in got] == [(2, 32767), (4, -32768)]


def test_tables(spark, tmp_path):
    from stratavox.sources import tables

    df = spark.createDataFrame([("000007", 1.5), ("000010", float("nan"))], "frame string, accuracy double")
    tables.write_frames(df.na.drop(), f"{tmp_path}/csv")
    assert tables.read_frames(spark, f"{tmp_path}/csv", "frame string, accuracy double").first().frame == "000007"
    tables.write_json(df, f"{tmp_path}/json")
    got = {r.frame: r.accuracy for r in tables.read_summary(spark, f"{tmp_path}/json", "frame string, accuracy double").collect()}
    assert got == {"000007": 1.5, "000010": None}
    assert tables.read_summary(spark, f"{tmp_path}/none", "frame string") is None
    cm = spark.createDataFrame([(1, 1, 5), (1, 9, 2), (9, 9, 7)], "gt int, pred int, n long")
    tables.write_confusion(cm, f"{tmp_path}/cm")
    dense = tables.dense_confusion(spark.read.parquet(f"{tmp_path}/cm")).collect()
    assert dense[0]["9"] == 2 and dense[1]["1"] == 0


def test_sensor_config_keeps_defaults():
    from stratavox.config import SensorConfig
    from stratavox.sources.tables import sensor_config

    assert sensor_config(None) == SensorConfig() == sensor_config("{broken")
    got = sensor_config('{"dataset": {"sensor": {"fov_up": 2.0, "img_prop": {"width": 1024}}}, "post": {"KNN": {"params": {"knn": 7}}}}')
    assert (got.width, got.fov_up_deg, got.knn, got.height) == (1024, 2.0, 7, 64)


@pytest.mark.parametrize("level", [None, 6])
def test_large_frames_pass_in_batches(spark, coded, level):
    """A frame comes in many batches and leaves in slices, never as a table of its own."""
    p, c, _ = coded
    meta = c.select("frame_no").distinct().select("frame_no", F.lit('{"stats": {"n_splits": 3}}').alias("meta"))
    # a frame without cells, one without points, and points in no order
    p, c = p.filter("frame_no <> 2").repartition(3), c.filter("frame_no <> 1").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        files = frames.encode_kinds(p, c, {"lite": 3, "full": 1}, level, meta=meta)
        assert "CoGroup" not in files._jdf.queryExecution().toString()
        got = {(r.frame_no, r.kind): r for r in files.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 8
    points, cells = p.toPandas(), c.toPandas()
    for (no, kind), r in got.items():
        own, near = points[points.frame_no == no].sort_values("seq"), cells[cells.frame_no == no].sort_values(["level", "ix", "iy"])
        kept = own[own.seq % 3 == 0] if kind == "lite" else own
        header, s = frames.parse_frame(bytes(r.content))
        assert (r.n_points, r.n_cells, header["n_points_total"], header["stats"]) == (len(kept), len(near), len(own), {"n_splits": 3})
        for table, spec in ((kept, frames.POINT_SECTIONS), (near, frames.CELL_SECTIONS)):
            for name, (dtype, cols) in spec.items():
                want = table[cols].to_numpy().astype(dtype)
                assert s[name].dtype == dtype and (s[name] == (want if len(cols) > 1 else want[:, 0])).all() and len(s[name]) == len(want)


def test_points_of_several_slices(spark):
    n = 150_000
    v = np.arange(n)
    sections = {name: (np.stack([v % 251] * len(cols), 1) if len(cols) > 1 else v % 251).astype(kind) for name, (kind, cols) in frames.POINT_SECTIONS.items() if name != "points.gt_class"}
    sections |= {name: np.zeros((0, len(cols)) if len(cols) > 1 else 0, kind) for name, (kind, cols) in frames.CELL_SECTIONS.items()}
    raw = frames.frame_bytes(frames.frame_header("000005", n, 0), sections, 6)
    files = spark.createDataFrame([(5, bytearray(raw))], "frame_no int, content binary")
    back = frames.decode_points(files)
    got = back.select(F.count("*"), F.min("place"), F.max("place"), F.count_distinct("place"), F.count_if(F.col("x_cm") != F.col("place") % 251), F.count("gt_class")).first()
    assert tuple(got) == (n, 0, n - 1, n, 0, 0)
    assert frames.decode_cells(files).count() == 0
    sections["points.intensity"] = sections["points.intensity"][:-1]
    files = spark.createDataFrame([(5, bytearray(frames.frame_bytes({}, sections, None)))], "frame_no int, content binary")
    with pytest.raises(Exception, match="different lengths"):
        frames.decode_points(files).collect()
