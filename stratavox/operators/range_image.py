"""Range image: projection, nearest point per pixel, neighbour vote, segmenters."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, functions as F

from stratavox.config import N_CLASSES, SensorConfig

SENSOR = SensorConfig()


def project(points: DataFrame, sensor: SensorConfig = SENSOR) -> DataFrame:
    """Adds depth, px, py by spherical projection (double precision)."""
    up, down = math.radians(sensor.fov_up_deg), math.radians(sensor.fov_down_deg)
    fov = abs(up) + abs(down)
    depth = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    p = points.withColumn("depth", depth)
    yaw = -F.atan2("y", "x")
    pitch = F.asin(F.least(F.greatest(F.col("z") / F.greatest(F.col("depth"), F.lit(1e-6)), F.lit(-1.0)), F.lit(1.0)))

    def clamp(v: Column, n: int) -> Column:
        return F.least(F.greatest(F.floor(v), F.lit(0)), F.lit(n - 1)).cast("int")

    return p.withColumns({
        "px": clamp(F.lit(0.5) * (yaw / F.lit(math.pi) + F.lit(1.0)) * sensor.width, sensor.width),
        "py": clamp((F.lit(1.0) - (pitch + F.lit(abs(down))) / F.lit(fov)) * sensor.height, sensor.height),
    })


def nearest_per_pixel(points: DataFrame) -> DataFrame:
    """(frame_no, py, px, owner, depth): the nearest point of every hit pixel, the first of equals."""
    best = points.groupBy("frame_no", "py", "px").agg(F.min(F.struct("depth", "seq")).alias("b"))
    return best.select("frame_no", "py", "px", F.col("b.seq").alias("owner"), F.col("b.depth").alias("depth"))


def channels(points: DataFrame, sensor: SensorConfig = SENSOR) -> DataFrame:
    """Normalised network input of every hit pixel, its owner and depth; pixels without a row are 0.

    The nearest point brings its values along, so points are dealt once.
    """
    best = points.groupBy("frame_no", "py", "px").agg(F.min(F.struct("depth", "seq", "x", "y", "z", "remission")).alias("b"))
    values = zip(("depth", "x", "y", "z", "remission"), sensor.means, sensor.stds)
    return best.select("frame_no", "py", "px", F.col("b.seq").alias("owner"), F.col("b.depth").alias("depth"), *[((F.col(f"b.{c}") - F.lit(m)) / F.lit(s)).alias(f"ch_{c}") for c, m, s in values])


def kernel(sensor: SensorConfig = SENSOR) -> list[float]:
    """One minus the normalised Gaussian weight of every window place, row by row."""
    r = sensor.search // 2
    raw = [math.exp(-(dx * dx + dy * dy) / (2 * sensor.sigma**2)) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]
    total = sum(raw)
    return [1 - v / total for v in raw]


#: Rows of the image that one task of the vote sees, besides the window's margin.
BAND = 8
#: Points that vote at once.
AT_ONCE = 1 << 14


def knn_vote(points: DataFrame, image: DataFrame, sensor: SensorConfig = SENSOR, height: int | None = None, width: int | None = None) -> DataFrame:
    """(frame_no, seq, label): the vote of the ``knn`` nearest pixels of a window.

    points: frame_no, seq, px, py, depth; image: frame_no, py, px, depth, cls.
    Beyond the image's edge range and class are 0; empty pixels are infinitely
    far; the centre has the point's own range; neighbours beyond the cutoff and
    class 0 don't vote; with no vote at all the label is 1. Ties of distance go
    to the earlier place of the window, ties of votes to the lower class.

    Points and pixels are dealt once, by bands of ``BAND`` rows of the image; a
    pixel goes to the bands whose windows reach it. A band's pixels come before its
    points and make a dense array, which the sensor bounds; the points pass in
    batches, so any number of them may share a pixel. As joins, every point would
    be shuffled once per place of its window.
    """
    import numpy as np
    import pyarrow as pa

    from stratavox.functions.runs import runs

    if sensor.search % 2 == 0:
        raise ValueError("the search window must be odd")
    height, width = height or sensor.height, width or sensor.width
    r, n_places, weights = sensor.search // 2, sensor.search**2, np.array(kernel(sensor))
    place = (np.arange(n_places) // sensor.search, np.arange(n_places) % sensor.search)
    kinds = {f.name: f.dataType.simpleString() for f in points.select("frame_no", "seq").schema.fields}
    band = lambda row: F.floor(row / BAND).cast("int")
    at = [F.col("py").cast("int").alias("py"), F.col("px").cast("int").alias("px"), F.col("depth").cast("double").alias("depth")]
    reach = F.sequence(band(F.greatest(F.col("py") - r, F.lit(0))), band(F.least(F.col("py") + r, F.lit(height - 1))))
    rows = image.select(F.col("frame_no").cast(kinds["frame_no"]).alias("frame_no"), F.explode(reach).alias("band"), F.lit(0).alias("votes"), *at, F.col("cls").cast("long").alias("cls"), F.lit(None).cast(kinds["seq"]).alias("seq"))
    p = points.select("frame_no", band(F.col("py")).alias("band"), F.lit(1).alias("votes"), *at, F.lit(None).cast("long").alias("cls"), "seq")

    def labels(batch: pa.RecordBatch, top: int, depth: np.ndarray, kind: np.ndarray) -> pa.Array:
        y, x, own = (batch.column(c).to_numpy() for c in ("py", "px", "depth"))
        there, c = (a[(y - top - r)[:, None] + place[0], x[:, None] + place[1]] for a in (depth, kind))
        there[:, n_places // 2] = own
        dist = np.abs(there - own[:, None]) * weights
        near = np.argsort(dist, axis=1, kind="stable")[:, : sensor.knn]
        c, far = np.take_along_axis(c, near, 1), np.take_along_axis(dist, near, 1) > sensor.cutoff
        c = np.where(far, 0, c) if sensor.cutoff > 0 else c
        votes = (c[:, :, None] == np.arange(1, N_CLASSES)).sum(axis=1)
        return pa.array((votes.argmax(axis=1) + 1).astype("int32"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = None
        for (frame, strip, votes), batch in runs(batches, 3):
            if here != (frame, strip):
                here, top = (frame, strip), strip * BAND - r  # the first row of the dense array
                depth = np.full((BAND + 2 * r, width + 2 * r), np.inf)
                kind = np.zeros(depth.shape, np.int64)
                line = np.arange(top, top + len(depth))
                depth[(line < 0) | (line >= height)], depth[:, :r], depth[:, width + r :] = 0.0, 0.0, 0.0
            if not votes:
                y, x = batch.column("py").to_numpy() - top, batch.column("px").to_numpy() + r
                depth[y, x], kind[y, x] = batch.column("depth").to_numpy(), batch.column("cls").to_numpy()
                continue
            for k in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(k, AT_ONCE)
                yield pa.RecordBatch.from_arrays([part.column("frame_no"), part.column("seq"), labels(part, top, depth, kind)], ["frame_no", "seq", "label"])

    dealt = rows.unionByName(p).repartition("frame_no", "band").sortWithinPartitions("frame_no", "band", "votes")
    return dealt.mapInArrow(vote, f"frame_no {kinds['frame_no']}, seq {kinds['seq']}, label int")


def point_confidence(labels: DataFrame, points: DataFrame, scores: DataFrame) -> DataFrame:
    """(frame_no, seq, cls, conf): every point's final label with its score at the point's pixel.

    labels: frame_no, seq, label; points: frame_no, seq, px, py; scores: frame_no, py, px, probs.
    """
    at = points.select("frame_no", "seq", "px", "py").join(labels, ["frame_no", "seq"])
    at = at.join(scores.select("frame_no", "py", "px", "probs"), ["frame_no", "py", "px"])
    return at.select("frame_no", "seq", F.col("label").alias("cls"), F.get("probs", F.col("label")).cast("double").alias("conf"))


def pixel_labels(points: DataFrame, image: DataFrame) -> DataFrame:
    """Every point with the class of its pixel."""
    return points.select("frame_no", "seq", "py", "px").join(image.select("frame_no", "py", "px", F.col("cls").alias("pixel_cls")), ["frame_no", "py", "px"], "left").select("frame_no", "seq", "pixel_cls")


def segment(image: DataFrame, model: Callable, sensor: SensorConfig = SENSOR) -> DataFrame:
    """Class scores of every hit pixel, beside its depth, by an injected model.

    ``model`` takes a float32 array (5, height, width) and returns scores
    (classes, height, width). It runs once per frame; a frame is bounded by the
    image's size. Without a model use the labels that come with the points.
    """
    import numpy as np
    import pyarrow as pa

    names = ["ch_depth", "ch_x", "ch_y", "ch_z", "ch_remission"]

    def run(frame: pa.Table) -> pa.Table:
        dense = np.zeros((5, sensor.height, sensor.width), np.float32)
        py, px = (frame.column(c).to_numpy() for c in ("py", "px"))
        for k, c in enumerate(names):
            dense[k, py, px] = frame.column(c).to_numpy()
        scores = np.asarray(model(dense))[:, py, px]
        offsets = pa.array(np.arange(len(py) + 1, dtype=np.int32) * len(scores))
        probs = pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(scores.T, np.float32).ravel()))
        return pa.table([frame.column("frame_no"), frame.column("py"), frame.column("px"), frame.column("depth"), probs, pa.array(scores.argmax(0).astype("int32"))], names=["frame_no", "py", "px", "depth", "probs", "cls"])

    return image.groupBy("frame_no").applyInArrow(run, f"frame_no {dict(image.dtypes)['frame_no']}, py int, px int, depth double, probs array<float>, cls int")
