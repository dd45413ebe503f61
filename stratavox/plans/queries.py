"""Every registered query: (spark, sf_dir) -> DataFrame, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratavox import config
from stratavox.functions.quantize import dequantize_cells, quantize_cells, quantize_points
from stratavox.operators import evaluation as ev, grid as g, range_image as ri, reporting as rp
from stratavox.operators.drivability import drivable_area, frame_drivability
from stratavox.operators.keys import near_field, pack_key, parent_key, unpack_key, with_keys
from stratavox.sources import adapter as src


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    return with_keys(src.points(spark, d))


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return g.build_grid(src.points(spark, d))


def _variants(spark: SparkSession, d: str) -> DataFrame:
    """Points with one row per label variant."""
    p = src.points(spark, d)
    k, c = F.col("seq"), F.col("cls")
    row = lambda name, pred: F.struct(F.lit(name).alias("variant"), pred.alias("pred"))
    rows = F.array(row("A", c), row("B", F.when(k % 13 == 0, 15).otherwise(c)), row("C", F.when(k % 17 == 0, 9).otherwise(c)))
    return p.select("frame_no", "seq", "x", "y", "gt", F.inline(rows))


def _active(spark: SparkSession, d: str) -> DataFrame:
    p = src.points(spark, d)
    return p.select("frame_no", "seq", "x", "y", "gt", F.when(F.col("seq") % 17 == 0, 9).otherwise(F.col("cls")).alias("pred"))


def load_filter_valid(spark, d):
    p = src.points(spark, d)
    finite = lambda c: ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return p.filter(finite("x") & finite("y") & finite("z") & finite("remission")).select("frame_no", "seq", "x", "y", "z")


def learning_map(spark, d):
    raw = src.raw_labels(spark, d).select("seq", F.col("raw").bitwiseAND(65535).alias("raw_id"))
    # 34 rows at any input size
    return raw.join(F.broadcast(config.learning_map(spark)), "raw_id", "left").select("seq", F.coalesce("cls", F.lit(0)).alias("cls"))


def frame_listing(spark, d):
    n = F.col("event_id") % 50
    paths = src.table(spark, d, "events").select(F.concat(F.lit("/scans/"), F.format_string("%06d", n), F.lit(".bin")).alias("path"), n.alias("n")).distinct()
    frames = paths.withColumn("frame_id", F.split_part(F.element_at(F.split("path", "/"), -1), F.lit("."), F.lit(1)))
    labels = frames.filter("n % 3 <> 0").select("frame_id")
    return frames.filter("n >= 10").join(labels, "frame_id", "left_semi").select("frame_id").orderBy("frame_id").limit(20)


def point_keys(spark, d):
    return _keyed(spark, d).select("frame_no", "seq", "level", pack_key(F.col("level"), F.col("cx"), F.col("cy")).alias("key"))


def key_roundtrip(spark, d):
    level, ix, iy = unpack_key(F.col("key"))
    return point_keys(spark, d).select("frame_no", "seq", level.alias("level"), ix.alias("ix"), iy.alias("iy"))


def parent_keys(spark, d):
    return point_keys(spark, d).select("frame_no", "seq", parent_key(F.col("key")).alias("parent"))


def split_children(spark, d):
    return g.split_children(src.points(spark, d)).select("frame_no", "level", "cx", "cy", "cnt", "zsum", "zmin", "zmax", "cls", "wscore", "total")


def merge_groups(spark, d):
    groups = g.merge_groups(g.stage2(src.points(spark, d)))
    return g.with_cells(groups.filter("eligible"), code="parent", names=("plevel", "px", "py")).select("frame_no", "plevel", "px", "py").distinct()


def _eval(spark, d):
    return ev.evaluated_cells(src.points(spark, d), _cells(spark, d))


def _by(cm: DataFrame, key: str) -> DataFrame:
    m = ev.miou(cm, key).select(key, F.round("miou", 12).alias("miou"), "classes_present")
    return ev.accuracy(cm, key).join(m, key).select(key, "accuracy", "points", "miou", "classes_present")


def accuracy_by_band(spark, d):
    rows = _active(spark, d).withColumn("band", ev.distance_band(F.col("x"), F.col("y")))
    return _by(ev.confusion(rows, "band"), "band")


def grid_accuracy_rollup(spark, d):
    r = ev.grid_accuracy(_eval(spark, d))
    return r.select("level", "cells", "correct", F.round("area", 9).alias("area"), F.round("area_correct", 9).alias("area_correct"), "by_cell", F.round("by_area", 9).alias("by_area"))


def grid_frame_accuracy(spark, d):
    e = _eval(spark, d)
    return e.groupBy("frame_no").agg(F.count("*").alias("cells"), (F.count_if("correct") / F.count("*")).alias("accuracy"))


def _timings(spark, d):
    return rp.add_totals(src.frame_timings(spark, d))


def stress_test(spark, d):
    a = _active(spark, d)
    counts = a.groupBy("frame_no").agg(*[F.count_if(F.col(c) == k).alias(f"{n}_{w}") for c, n in (("gt", "gt"), ("pred", "pred")) for k, w in ((1, "car"), (6, "person"))])
    return rp.stress_test(counts)


def throughput(spark, d):
    t = rp.throughput(_timings(spark, d), rp.power_during(src.power_readings(spark, d), src.processing_intervals(spark, d)))
    return t.select("frames", "points", "seconds", "power_readings", "peak_w", *[F.round(c, 6).alias(c) for c in ("points_per_s", "frames_per_s", "grid_engine_points_per_s", "mean_active_w", "joules_per_frame", "frames_per_joule")])


def bench_left_accuracy(spark, d):
    """Every benchmark frame beside its accuracy; null where it has no points."""
    n = src.frame_timings(spark, d).select(F.col("frame_no").cast("int").alias("frame_no"))
    return n.join(ev.frame_accuracy(_active(spark, d)).select("frame_no", "accuracy"), "frame_no", "left")


def pred_class_points(spark, d):
    c = _cells(spark, d)
    of = lambda k, n: F.sum(F.when(F.col("semantic_class") == k, F.col("point_count")).otherwise(0.0)).cast("long").alias(n)
    return c.groupBy("frame_no").agg(of(config.CAR, "pred_car_points"), of(config.PERSON, "pred_person_points"))


def _drive(spark, d, profile="on-road"):
    return frame_drivability(quantize_cells(_cells(spark, d)), profile=profile)


def knn_vote(spark, d):
    p = src.pixels(spark, d)
    near = ri.nearest_per_pixel(p)
    image = near.join(p.select("frame_no", F.col("seq").alias("owner"), "cls"), ["frame_no", "owner"])
    return ri.knn_vote(p, image, height=16, width=64)


def pixel_lookup(spark, d):
    p = src.pixels(spark, d)
    image = ri.nearest_per_pixel(p).join(p.select("frame_no", F.col("seq").alias("owner"), "cls"), ["frame_no", "owner"])
    return ri.pixel_labels(p, image)


def range_channels(spark, d):
    c = ri.channels(ri.project(src.points(spark, d)))
    return c.drop("depth").withColumn("ch_depth", F.round("ch_depth", 9))


def grid_micro_batch(spark, d):
    """The grid built by the streaming path, one trigger over the whole table."""
    from stratavox.streaming.grid_stream import stream_to_table

    return stream_to_table(spark, d)


def _encoded(spark, d):
    """Frame files of all points and cells, with their counters in the header."""
    from stratavox.sources.frames import encode_frames, frame_meta

    p = src.points(spark, d)
    accuracy = ev.frame_accuracy(_active(spark, d)).select("frame_no", "accuracy", "car_iou", "person_iou")
    return encode_frames(quantize_points(p), quantize_cells(g.build_grid(p)), meta=frame_meta(g.grid_stats(p), accuracy=accuracy))


def frame_round_trip(spark, d):
    """Frames encoded to bytes and decoded again, with every point."""
    from stratavox.sources.frames import decode_frames

    return decode_frames(_encoded(spark, d)).select("frame_no", "n_points", "n_cells")


def decode_cells(spark, d):
    """Every field of every cell, read back from the frames' bytes."""
    from stratavox.sources.frames import decode_cells as decode

    return decode(_encoded(spark, d)).drop("place")


def decode_points(spark, d):
    """Every field of every point, read back from the frames' bytes."""
    from stratavox.sources.frames import decode_points as decode

    return decode(_encoded(spark, d)).drop("place")


def frame_header(spark, d):
    """Fields of the headers as a reader of the files finds them."""
    from stratavox.sources.frames import decode_frames

    h = decode_frames(_encoded(spark, d))
    field = lambda path, kind, name: F.get_json_object("header", f"$.{path}").cast(kind).alias(name)
    return h.select(
        "frame_no", field("format", "string", "format"), field("version", "int", "version"), field("frame_id", "string", "frame_id"), field("n_points_total", "long", "n_points_total"), field("point_stride", "int", "point_stride"), field("n_cells", "long", "n_cells"),
        field("sensor_height_m", "double", "sensor_height_m"), field("level_sizes_m[0]", "double", "level_0_m"), field("level_sizes_m[3]", "double", "level_3_m"), field("units.z_std", "string", "z_std_unit"),
        field("stats.n_points_used", "long", "n_points_used"), field("stats.n_splits", "long", "n_splits"), field("stats.n_merges", "long", "n_merges"), F.round(field("accuracy.accuracy", "double", "a"), 12).alias("accuracy"),
    )


def manifest_frames(spark, d):
    """Rows of a clip's manifest, but for the files' sizes."""
    from stratavox.sources.frames import frame_meta, manifest_frames as listed

    p = src.points(spark, d)
    stats = g.grid_stats(p)
    per = p.groupBy("frame_no").agg(F.count("*").alias("n_points")).join(stats.select("frame_no", F.col("n_final_cells").alias("n_cells")), "frame_no")
    rows = listed(per, frame_meta(stats, accuracy=ev.frame_accuracy(_active(spark, d)).select("frame_no", "accuracy")))
    return rows.select("index", "id", "lite", "full", "n_points", "n_cells", F.get_json_object("meta", "$.stats.n_merges").cast("long").alias("n_merges"), F.round(F.get_json_object("meta", "$.accuracy.accuracy").cast("double"), 12).alias("accuracy"))


def label_paths(spark, d):
    """Every scan of a listing beside its label file, null where there is none."""
    from stratavox.sources.frames import label_paths as paired

    n = F.col("event_id") % 50
    name = F.format_string("%06d", n)
    rows = src.table(spark, d, "events").select(n.alias("n"), name.alias("frame_id")).distinct()
    scans = rows.select("frame_id", F.concat(F.lit("/scans/"), "frame_id", F.lit(".bin")).alias("path"))
    labels = rows.filter("n % 3 <> 0").select("frame_id", F.concat(F.lit("/labels/"), "frame_id", F.lit(".label")).alias("path"))
    return paired(scans, labels)


def gt_optional(spark, d):
    """Points of all frames beside their true class; frames 3 have no labels, so theirs is null."""
    p = src.points(spark, d)
    labels = p.filter("frame_no <> 3").select("frame_no", "seq", "gt")
    return p.select("frame_no", "seq", "cls").join(labels, ["frame_no", "seq"], "left")


def final_confidence(spark, d):
    """Score of every point's voted class at its pixel, by scores that follow from the pixel."""
    p = src.pixels(spark, d)
    image = ri.nearest_per_pixel(p).select("frame_no", "py", "px")
    probs = F.transform(F.sequence(F.lit(0), F.lit(config.N_CLASSES - 1)), lambda c: ((F.col("px") * 31 + F.col("py") * 17 + c * 7) % 97) / F.lit(128.0))
    return ri.point_confidence(knn_vote(spark, d), p, image.withColumn("probs", probs))


def _named_iou(spark, d):
    classes = config.class_table(spark).select("class_id", "name")
    return ev.iou_per_class(ev.confusion(_active(spark, d))).join(F.broadcast(classes), "class_id")


def iou_chart(spark, d):
    """Bars of the class chart: classes with true points, worst first."""
    return _named_iou(spark, d).filter("class_id > 0 and gt_points > 0").select("name", "iou", F.format_string("%.1f", F.col("iou") * 100).alias("label")).orderBy("iou", "name")


def chart_rows(spark, d):
    """Shares of the confusion chart that get a label: at least one percent, one class hidden."""
    shares = ev.row_normalized(ev.confusion(_active(spark, d)))
    return shares.filter("gt <> 5 and pred <> 5 and share >= 0.01").select("gt", "pred", F.round(F.col("share") * 100, 6).alias("percent"))


def class_summary(spark, d):
    """Per class: IoU (null where absent), true points, and points predicted though absent."""
    there = F.col("gt_points") > 0
    return _named_iou(spark, d).filter("class_id > 0").select("name", F.when(there, F.col("iou")).alias("iou"), "gt_points", F.when(~there & (F.col("pred_points") > 0), F.col("pred_points")).alias("absent_predicted"))


def eval_frames(spark, d):
    """Segmentation measures of every frame beside its grid measures."""
    return ev.frame_accuracy(_active(spark, d)).select("frame_no", "accuracy", "car_iou").join(grid_frame_accuracy(spark, d).select("frame_no", F.col("accuracy").alias("grid_cell_accuracy")), "frame_no", "left")


def segment_offsets(spark, d):
    """Cells of a frame in key order: their index and the first of their points."""
    from pyspark.sql import Window

    w = Window.partitionBy("frame_no").orderBy("key")
    c = _cells(spark, d)
    return c.select("frame_no", "key", (F.row_number().over(w) - 1).alias("segment"), (F.sum("point_count").over(w) - F.col("point_count")).cast("long").alias("offset"))


def size_labels(spark, d):
    c = _cells(spark, d).groupBy("level").agg(F.count("*").alias("n"))
    size = F.lit(5) * F.expr("shiftleft(1, 3 - level)")
    return c.select(F.concat(size.cast("string"), F.lit(" cm")).alias("size"), "n")


def typed_cells(spark, d):
    """The matrix form of the cells cast back to the record's types."""
    return _cells(spark, d).select("frame_no", "key", F.col("level").cast("double").cast("int").alias("level"), F.col("semantic_class").cast("double").cast("int").alias("semantic_class"), F.col("semantic_priority").cast("double").cast("int").alias("semantic_priority"), "point_count")


def dense_confusion(spark, d):
    from stratavox.sources.tables import dense_confusion as dense

    m = dense(ev.confusion(_active(spark, d)))
    return m.select("gt", *[F.col(str(k)).alias(f"p{k}") for k in range(config.N_CLASSES)])


def class_table_json(spark, d):
    return config.class_table(spark).select("class_id", F.to_json(F.struct(F.col("class_id").alias("id"), "name", "color", "priority", "traversability")).alias("json"))


def bookmarks(spark, d):
    """The marks of a clip of all frames."""
    t = _timings(spark, d).select(F.col("frame_no").cast("int").alias("frame_no"), "end_to_end")
    frames = ev.frame_accuracy(_active(spark, d)).join(t, "frame_no", "left")
    return rp.bookmarks(frames.withColumns({"index": F.col("frame_no"), "frame": F.format_string("%06d", "frame_no")}))


def preview_filter(spark, d):
    """Cells whose centre is within 40 m on both axes."""
    near = (F.abs("x_center") < 40) & (F.abs("y_center") < 40)
    return _cells(spark, d).filter(near).select("frame_no", "key", "x_min", "x_max", "y_min", "y_max", "traversability")


QUERIES = {
    "iou_chart": iou_chart,
    "chart_rows": chart_rows,
    "class_summary": class_summary,
    "eval_frames": eval_frames,
    "segment_offsets": segment_offsets,
    "size_labels": size_labels,
    "typed_cells": typed_cells,
    "dense_confusion": dense_confusion,
    "class_table_json": class_table_json,
    "bookmarks": bookmarks,
    "load_filter_valid": load_filter_valid,
    "learning_map": learning_map,
    "frame_listing": frame_listing,
    "drop_unlabeled": lambda s, d: g.drop_unlabeled(src.points(s, d)).select("frame_no", "seq", "cls"),
    "point_keys": point_keys,
    "key_roundtrip": key_roundtrip,
    "parent_keys": parent_keys,
    "near_field": lambda s, d: _keyed(s, d).select("frame_no", "seq", near_field(F.col("tx"), F.col("ty")).alias("near")),
    "stage1_cells": lambda s, d: g.stage1(src.points(s, d)).select("frame_no", "level", "cx", "cy", "cnt", "zsum", "zsq", "zmin", "zmax"),
    "class_vote": lambda s, d: g.stage1(src.points(s, d)).select("frame_no", "level", "cx", "cy", "cls", "wscore", "total"),
    "split_flags": lambda s, d: g.stage1(src.points(s, d)).select("frame_no", "level", "cx", "cy", "is_split"),
    "split_children": split_children,
    "merge_groups": merge_groups,
    "grid_cells": lambda s, d: _cells(s, d).drop("tile"),
    "grid_stats": lambda s, d: g.grid_stats(src.points(s, d)),
    "grid_bounds": lambda s, d: g.grid_bounds(src.points(s, d)).withColumn("level_sizes", F.array_join(F.transform("level_sizes", lambda x: F.format_string("%.2f", x)), " ")),
    "cells_by_level": lambda s, d: _cells(s, d).groupBy("frame_no", "level").agg(F.count("*").alias("n"), F.sum("point_count").alias("points")),
    "cell_lookup": lambda s, d: g.cell_lookup(src.points(s, d).select("frame_no", "seq", "x", "y"), _cells(s, d).select("frame_no", "tile", "key", "level")).select("frame_no", "seq", F.col("c_key").alias("key")),
    "unlabeled_lookup": lambda s, d: g.cell_lookup(src.points(s, d).filter("cls = 0").select("frame_no", "seq", "x", "y"), _cells(s, d).select("frame_no", "tile", "key", "level")).groupBy("frame_no").agg(F.count("*").alias("n"), F.count("c_key").alias("on_cell")),
    "confusion": lambda s, d: ev.confusion(_active(s, d)),
    "iou_per_class": lambda s, d: ev.iou_per_class(ev.confusion(_active(s, d))),
    "miou": lambda s, d: ev.miou(ev.confusion(_active(s, d))).select(F.round("miou", 12).alias("miou"), "classes_present"),
    "accuracy": lambda s, d: ev.accuracy(ev.confusion(_active(s, d))),
    "accuracy_by_band": accuracy_by_band,
    "frame_accuracy": lambda s, d: ev.frame_accuracy(_active(s, d)),
    "variant_accuracy": lambda s, d: _by(ev.confusion(_variants(s, d), "variant"), "variant"),
    "grid_accuracy_rollup": grid_accuracy_rollup,
    "grid_frame_accuracy": grid_frame_accuracy,
    "obstacle_safety": lambda s, d: ev.obstacle_safety(src.points(s, d), _cells(s, d)),
    "stage_totals": lambda s, d: _timings(s, d).select("frame_no", "seg_total", "grid_engine_total", "end_to_end"),
    "latency_summary": lambda s, d: rp.latency_summary(_timings(s, d)),
    "real_time_summary": lambda s, d: rp.real_time_summary(_timings(s, d)),
    "record_frames": lambda s, d: rp.record_frames(ev.frame_accuracy(_active(s, d))),
    "fastest_frame": lambda s, d: rp.fastest_frame(_timings(s, d)),
    "stress_test": stress_test,
    "throughput": throughput,
    "power_asof": lambda s, d: rp.power_during(src.power_readings(s, d), src.processing_intervals(s, d)),
    "bench_left_accuracy": bench_left_accuracy,
    "pred_class_points": pred_class_points,
    "drivability_on_road": _drive,
    "drivability_off_road": lambda s, d: _drive(s, d, "off-road"),
    "drivable_area": lambda s, d: drivable_area(_drive(s, d)).withColumn("area_m2", F.round("area_m2", 9)),
    "quantize_cells": lambda s, d: quantize_cells(_cells(s, d)),
    "quantize_points": lambda s, d: quantize_points(src.points(s, d)),
    "dequantize_cells": lambda s, d: dequantize_cells(quantize_cells(_cells(s, d))),
    "point_stride": lambda s, d: quantize_points(src.points(s, d), 4).select("frame_no", "seq"),
    "preview_filter": preview_filter,
    "nearest_per_pixel": lambda s, d: ri.nearest_per_pixel(src.pixels(s, d)),
    "pixel_lookup": pixel_lookup,
    "knn_vote": knn_vote,
    "project_pixels": lambda s, d: ri.project(src.points(s, d)).select("frame_no", "seq", "px", "py"),
    "range_channels": range_channels,
    "row_normalized_confusion": lambda s, d: ev.row_normalized(ev.confusion(_active(s, d))),
    "latency_histogram": lambda s, d: rp.histogram(_timings(s, d), "end_to_end"),
    "class_table": lambda s, d: config.class_table(s),
    "labeled_upload": lambda s, d: src.points(s, d).select("frame_no", "seq", "x", "y", "z", "cls", F.lit(1.0).alias("conf")),
    "clip_summary": lambda s, d: rp.clip_summary(_timings(s, d), ev.frame_accuracy(_active(s, d))),
    "frame_round_trip": frame_round_trip,
    "grid_micro_batch": grid_micro_batch,
    "frame_header": frame_header,
    "frame_levels": lambda s, d: _cells(s, d).groupBy("frame_no").agg(F.count("*").alias("n_cells"), F.sum("point_count").cast("long").alias("n_points"), F.min("level").alias("min_level"), F.max("level").alias("max_level")),
    "decode_cells": decode_cells,
    "decode_points": decode_points,
    "manifest_frames": manifest_frames,
    "label_paths": label_paths,
    "gt_optional": gt_optional,
    "final_confidence": final_confidence,
}
