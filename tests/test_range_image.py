import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratavox.config import SensorConfig
from stratavox.operators import range_image as ri
from tests.scene import scan


@pytest.fixture(scope="module")
def projected(spark):
    xyz, cls, _ = scan(1)
    df = spark.createDataFrame(pd.DataFrame({"frame_no": 0, "seq": np.arange(len(cls)), "x": xyz[:, 0].astype(float), "y": xyz[:, 1].astype(float), "z": xyz[:, 2].astype(float), "remission": xyz[:, 3].astype(float), "cls": cls}))
    return ri.project(df).cache()


def test_nearest_point_of_every_pixel(projected):
    p = projected.select("seq", "px", "py", "depth").toPandas()
    want = p.sort_values(["depth", "seq"]).drop_duplicates(["px", "py"]).set_index(["px", "py"]).seq.to_dict()
    got = {(r.px, r.py): r.owner for r in ri.nearest_per_pixel(projected).collect()}
    assert got == want and p.px.between(0, 2047).all() and p.py.between(0, 63).all()


def test_knn_against_a_dense_image(spark):
    r = np.random.default_rng(3)
    sensor = SensorConfig(height=8, width=12)
    n = 150
    p = pd.DataFrame({"frame_no": 0, "seq": np.arange(n), "px": r.integers(0, 12, n), "py": r.integers(0, 8, n), "depth": r.uniform(1, 6, n), "cls": r.integers(0, 20, n)})
    df = spark.createDataFrame(p)
    image = p.sort_values(["depth", "seq"]).drop_duplicates(["px", "py"])
    depth, kind = np.full((12, 16), -1.0), np.zeros((12, 16), int)
    depth[:2], depth[-2:], depth[:, :2], depth[:, -2:] = 0, 0, 0, 0
    for q in image.itertuples():
        depth[q.py + 2, q.px + 2], kind[q.py + 2, q.px + 2] = q.depth, q.cls
    at = np.stack(np.meshgrid(np.arange(5) - 2, np.arange(5) - 2, indexing="ij"))
    bell = np.exp(-0.5 * (at**2).sum(0)).ravel()
    w = 1 - bell / bell.sum()
    assert np.allclose(w, ri.kernel(sensor), atol=1e-15)
    want = {}
    for q in p.itertuples():
        d, k = depth[q.py : q.py + 5, q.px : q.px + 5].ravel().copy(), kind[q.py : q.py + 5, q.px : q.px + 5].ravel()
        d[d < 0] = np.inf
        d[12] = q.depth
        dist = abs(d - q.depth) * w
        near = np.argsort(dist, kind="stable")[:5]
        votes = np.bincount([k[i] for i in near if dist[i] <= 1.0 and k[i] > 0], minlength=20)
        want[q.seq] = int(votes[1:].argmax()) + 1
    got = {x.seq: x.label for x in ri.knn_vote(df, spark.createDataFrame(image), sensor).collect()}
    assert got == want and 0 not in got.values()


def test_points_vote_in_batches(spark):
    """A band's points pass in batches behind its pixels; their votes are those of the whole band."""
    r = np.random.default_rng(5)
    sensor = SensorConfig(height=24, width=16)
    n = 4000
    p = pd.DataFrame({"frame_no": r.integers(0, 3, n), "seq": np.arange(n), "px": r.integers(0, 16, n), "py": r.integers(0, 24, n), "depth": r.uniform(1, 6, n), "cls": r.integers(0, 20, n)})
    # most points share a pixel, and a frame has no image
    p.loc[p.seq % 4 > 0, ["px", "py"]] = 3, 7
    df = spark.createDataFrame(p)
    image = df.filter("frame_no < 2").join(ri.nearest_per_pixel(df).select("frame_no", F.col("owner").alias("seq")), ["frame_no", "seq"])
    votes = ri.knn_vote(df, image, sensor)
    assert "CoGroup" not in votes._jdf.queryExecution().toString()
    want = {(x.frame_no, x.seq): x.label for x in votes.collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(x.frame_no, x.seq): x.label for x in ri.knn_vote(df, image, sensor).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and len(got) == n and len(set(got.values())) > 10
    assert {v for (frame, _), v in got.items() if frame == 2} == {1}


def test_even_window_is_refused(projected):
    with pytest.raises(ValueError):
        ri.knn_vote(projected, projected, SensorConfig(search=4))


def test_segmenter_gets_zeros_for_empty_pixels(projected):
    def model(dense):
        assert dense.shape == (5, 64, 2048)
        empty = (dense == 0).all(axis=0).mean()
        scores = np.zeros((20, 64, 2048), np.float32)
        scores[9] = empty > 0.5
        return scores

    got = ri.segment(ri.channels(projected), model)
    assert {r.cls for r in got.select("cls").distinct().collect()} == {9}
    assert got.select(F.size("probs")).first()[0] == 20
