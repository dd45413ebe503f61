"""Latency, real-time, record, throughput and power summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

STAGE_COLUMNS = ["upload", "project", "model", "post", "seg_total", "grid_gpu", "grid_to_cpu", "grid_engine_total", "end_to_end"]


def add_totals(t: DataFrame) -> DataFrame:
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    t = t.withColumns({"seg_total": z("project") + z("model") + z("post"), "grid_engine_total": z("grid_gpu") + z("grid_cpu") + z("grid_to_cpu")})
    return t.withColumn("end_to_end", z("upload") + F.col("seg_total") + F.col("grid_engine_total"))


#: Bins of a column in which percentiles are looked for.
BINS = 4096


def percentiles(t: DataFrame, columns: list[str], shares: list[float], bins: int = BINS) -> DataFrame:
    """(stage, share, value): exact interpolated percentiles of columns, nulls left out.

    Values are counted in bins first; only those of the bins that hold a wanted
    rank are put in order, and equal ones are summed before. So a task sees a
    ``bins``-th of the values, not all of them.
    """
    values = t.select(F.inline(F.array(*[F.struct(F.lit(c).alias("stage"), F.col(c).cast("double").alias("v")) for c in columns]))).filter("v is not null")
    # a row per column, so these are broadcast at any input size
    span = values.groupBy("stage").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"))
    at = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1))).otherwise(0).cast("int")
    binned = values.join(F.broadcast(span.select("stage", "low", "high")), "stage").select("stage", at.alias("bin"), "v")
    counts = binned.groupBy("stage", "bin").agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.partitionBy("stage").orderBy("bin"))
    counts = counts.select("stage", "bin", (upto - F.col("k")).alias("start"), upto.alias("stop"))
    wanted = span.select("stage", "n", F.explode(F.array(*[F.lit(float(q)) for q in shares])).alias("share")).withColumn("pos", F.col("share") * (F.col("n") - 1))
    wanted = wanted.select("stage", "share", (F.col("pos") - F.floor("pos")).alias("part"), F.explode(F.array_distinct(F.array(F.floor("pos"), F.ceil("pos")))).alias("rank"))
    # two rows per column and share
    wanted = wanted.join(counts, "stage").filter("rank >= start and rank < stop").select("stage", "share", "part", "bin", (F.col("rank") - F.col("start")).alias("rank"))
    near = binned.join(F.broadcast(wanted.select("stage", "bin").distinct()), ["stage", "bin"]).groupBy("stage", "bin", "v").agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.partitionBy("stage", "bin").orderBy("v"))
    near = near.select("stage", "bin", "v", (upto - F.col("k")).alias("start"), upto.alias("stop"))
    found = near.join(F.broadcast(wanted), ["stage", "bin"]).filter("rank >= start and rank < stop")
    ends = found.groupBy("stage", "share").agg(F.min("v").alias("a"), F.max("v").alias("b"), F.max("part").alias("part"))
    return ends.select("stage", "share", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("value"))


def _value(stage: str, share: float) -> Column:
    return F.max(F.when((F.col("stage") == stage) & (F.col("share") == share), F.col("value")))


def latency_summary(t: DataFrame) -> DataFrame:
    """(stage, median_ms, p95_ms, p99_ms, max_ms, mean_ms) of every stage column there."""
    there = [c for c in STAGE_COLUMNS if c in t.columns]
    wide = t.agg(*[F.struct(F.max(c).alias("m"), F.avg(c).alias("a")).alias(c) for c in there])
    rows = wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("stage"), F.col(c).alias("s")) for c in there])))
    q = lambda share: F.round(F.max(F.when(F.col("share") == share, F.col("value"))), 2)
    found = percentiles(t, there, [0.5, 0.95, 0.99]).groupBy("stage").agg(q(0.5).alias("median_ms"), q(0.95).alias("p95_ms"), q(0.99).alias("p99_ms"))
    # a row per stage on both sides
    return rows.join(F.broadcast(found), "stage", "left").select("stage", "median_ms", "p95_ms", "p99_ms", F.round("s.m", 2).alias("max_ms"), F.round("s.a", 2).alias("mean_ms"))


def real_time_summary(t: DataFrame) -> DataFrame:
    first = lambda k, desc=False: F.min_by(k, F.struct("frame_no")) if not desc else F.max_by(k, F.struct("frame_no"))
    late = percentiles(t, ["end_to_end", "grid_engine_total"], [0.99]).agg(F.round(_value("end_to_end", 0.99), 6).alias("e2e_p99_ms"), F.round(_value("grid_engine_total", 0.99), 6).alias("grid_p99_ms"))
    out = t.agg(
        F.avg((F.col("end_to_end") < 100).cast("double")).alias("pct_within_100ms"),
        F.avg((F.col("grid_engine_total") < 30).cast("double")).alias("pct_grid_within_30ms"),
        F.max("end_to_end").alias("e2e_max_ms"),
        F.max("grid_engine_total").alias("grid_max_ms"),
        F.max_by("frame", F.struct("end_to_end", -F.col("frame_no"))).alias("slowest_frame"),
        F.round(F.stddev_samp("end_to_end"), 6).alias("e2e_std_ms"),
        F.round(F.stddev_samp("grid_engine_total"), 6).alias("grid_std_ms"),
        first("vram_mb").alias("vram_first_mb"),
        first("vram_mb", True).alias("vram_last_mb"),
        F.max("vram_mb").alias("vram_max_mb"),
    )
    # two single rows
    return out.crossJoin(F.broadcast(late))


def clip_summary(t: DataFrame, accuracy: DataFrame) -> DataFrame:
    """One row of a clip's medians, frames and mean accuracy over the frames that have one."""
    medians = percentiles(t, ["grid_engine_total", "end_to_end"], [0.5]).agg(F.round(_value("grid_engine_total", 0.5), 6).alias("median_grid_ms"), F.round(_value("end_to_end", 0.5), 6).alias("median_e2e_ms"))
    # single rows
    return medians.crossJoin(F.broadcast(t.agg(F.count("*").alias("frames")))).crossJoin(F.broadcast(accuracy.agg(F.round(F.avg("accuracy"), 9).alias("mean_accuracy"))))


# The names of a clip's marks, and the points that a class needs to be marked.
MARKS = {
    "accuracy": "Highest overall accuracy",
    "car": "Highest car IoU",
    "person": "Highest person IoU",
    "stress": "Stress test (most car + pedestrian points)",
    "fastest": "Fastest end to end (ms)",
    "slowest": "Slowest end to end (ms)",
}
MIN_CAR_POINTS, MIN_PERSON_POINTS = 50, 20


def bookmarks(frames: DataFrame) -> DataFrame:
    """(label, frame, index, value) of a clip's marks, in one pass; the first of equal frames.

    frames: index, frame, accuracy, car_iou, person_iou, gt_car_points,
    gt_person_points, end_to_end; measures may be null. A mark without a frame
    that qualifies is left out.
    """
    stress = F.col("gt_car_points") + F.col("gt_person_points")
    car = F.when(F.col("gt_car_points") >= MIN_CAR_POINTS, F.col("car_iou"))
    person = F.when(F.col("gt_person_points") >= MIN_PERSON_POINTS, F.col("person_iou"))

    def best(v: Column, least: bool = False) -> Column:
        v = v.cast("double")
        row = F.struct((-v if least else v).alias("rank"), (-F.col("index")).alias("turn"), F.col("frame").alias("frame"), v.alias("value"))
        return F.max(F.when(v.isNotNull() & ~F.isnan(v), row))

    found = {"accuracy": best(F.col("accuracy")), "car": best(car), "person": best(person), "stress": best(stress), "fastest": best(F.col("end_to_end"), True), "slowest": best(F.col("end_to_end"))}
    wide = frames.agg(*[c.alias(k) for k, c in found.items()])
    rows = wide.select(F.inline(F.array(*[F.struct(F.lit(MARKS[k]).alias("label"), F.col(k).alias("b")) for k in found]))).filter("b is not null")
    return rows.select("label", "b.frame", (-F.col("b.turn")).alias("index"), "b.value")


def record_frames(acc: DataFrame, min_car: int = 50, min_person: int = 20) -> DataFrame:
    """(record, frame_no, value): best accuracy, car and person IoU; first of equals, nulls skipped."""
    row = lambda name, ok, v: F.struct(F.lit(name).alias("record"), ok.alias("ok"), F.col(v).cast("double").alias("value"))
    true = F.lit(True)
    long = acc.select("frame_no", F.inline(F.array(row("highest_accuracy", true, "accuracy"), row("highest_car_iou", F.col("gt_car_points") >= min_car, "car_iou"), row("highest_person_iou", F.col("gt_person_points") >= min_person, "person_iou"))))
    best = long.filter("ok and value is not null and not isnan(value)").groupBy("record").agg(F.max(F.struct("value", (-F.col("frame_no")).alias("f"))).alias("b"))
    return best.select("record", (-F.col("b.f")).alias("frame_no"), F.col("b.value").alias("value"))


def fastest_frame(t: DataFrame) -> DataFrame:
    best = t.agg(F.min(F.struct("end_to_end", "frame_no", "frame", "seg_total", "grid_engine_total")).alias("b"))
    return best.select("b.frame", F.col("b.end_to_end").alias("end_to_end_ms"), F.col("b.seg_total").alias("seg_ms"), F.col("b.grid_engine_total").alias("grid_ms"))


def stress_test(counts: DataFrame) -> DataFrame:
    """The frame with most cars and people: by true counts if every frame has them,
    else by predicted ones. counts: frame_no, gt_car, gt_person (nullable), pred_car, pred_person."""
    all_gt = F.count_if(F.col("gt_car").isNull()) == 0
    pick = lambda a, b: F.max(F.struct((F.col(a) + F.col(b)).alias("n"), (-F.col("frame_no")).alias("f"), F.col(a).alias("car"), F.col(b).alias("person")))
    r = counts.agg(all_gt.alias("g"), pick("gt_car", "gt_person").alias("t"), pick("pred_car", "pred_person").alias("p"))
    use = lambda f: F.when(F.col("g"), F.col(f"t.{f}")).otherwise(F.col(f"p.{f}"))
    return r.select(F.when(F.col("g"), "ground truth").otherwise("predicted").alias("source"), (-use("f")).alias("frame_no"), use("car").alias("car_points"), use("person").alias("person_points"))


def throughput(t: DataFrame, active: DataFrame) -> DataFrame:
    """Rates and energy of a run. active: readings (watts) within the processing intervals."""
    seconds, grid_s = F.sum("end_to_end") / 1000, F.sum("grid_engine_total") / 1000
    out = t.agg(F.count("*").alias("frames"), F.sum("n_points").alias("points"), seconds.alias("seconds"), grid_s.alias("grid_s"))
    power = active.agg(F.avg("watts").alias("mean_active_w"), F.max("watts").alias("peak_w"), F.count("*").alias("power_readings"))
    out = out.crossJoin(F.broadcast(power))  # two single rows
    joules = F.col("mean_active_w") * F.col("seconds") / F.col("frames")
    return out.select("frames", "points", "seconds", (F.col("points") / F.col("seconds")).alias("points_per_s"), (F.col("frames") / F.col("seconds")).alias("frames_per_s"), (F.col("points") / F.col("grid_s")).alias("grid_engine_points_per_s"), "mean_active_w", "peak_w", "power_readings", joules.alias("joules_per_frame"), F.try_divide(F.lit(1.0), joules).alias("frames_per_joule"))


def power_during(readings: DataFrame, intervals: DataFrame, bucket_s: float = 64.0) -> DataFrame:
    """Readings within the latest interval that starts at or before them.

    An as-of join without a nested loop: both sides are merged in time order and
    the last start is carried along. Time is cut into buckets so the order is
    not one task's work; a bucket's first readings get the latest start of the
    buckets before it from a small table of one row per bucket.
    """
    a = intervals.select(F.col("start").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("reading"), F.lit(None).cast("double").alias("watts"), F.struct("start", "end", "interval").alias("iv"))
    b = readings.select(F.col("t").alias("at"), F.lit(1).alias("kind"), "reading", "watts", F.lit(None).cast(a.schema["iv"].dataType).alias("iv"))
    rows = a.unionByName(b).withColumn("bucket", F.floor(F.col("at") / bucket_s))
    w = Window.partitionBy("bucket").orderBy("at", "kind", "iv").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("here", F.last("iv", True).over(w))
    last = rows.groupBy("bucket").agg(F.max("iv").alias("latest"))
    carried = last.select("bucket", F.last("latest", True).over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    found = rows.filter("kind = 1").join(carried, "bucket").withColumn("hit", F.coalesce("here", "before"))
    return found.filter(F.col("at") <= F.col("hit.end")).select("reading", F.col("at").alias("t"), "watts", F.col("hit.interval").alias("interval"))


def histogram(t: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """(bin, n) of equal bins from the least to the greatest value; the last bin is closed."""
    span = t.agg(F.min(column).alias("low"), F.max(column).alias("high"))
    at = F.floor((F.col(column) - F.col("low")) / ((F.col("high") - F.col("low")) / bins)).cast("int")
    # one row of two numbers
    return t.select(column).crossJoin(F.broadcast(span)).select(F.when(F.col("high") > F.col("low"), F.least(at, F.lit(bins - 1))).otherwise(0).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
