import datetime as dt

from pyspark.sql import functions as F

from stratavox.operators.grid import build_grid
from stratavox.sources import adapter
from stratavox.streaming import grid_stream as gs


def test_stream_of_frames_equals_batch(spark, sf, tmp_path):
    p = adapter.points(spark, sf)
    for k in range(4):
        p.filter(F.col("frame_no") == k).coalesce(1).write.parquet(f"{tmp_path}/in/frame={k}")
    source = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    gs.start_grid_stream(source, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.select("batch").distinct().count() == 4
    assert got.drop("batch").exceptAll(build_grid(p)).count() == 0 and got.count() == build_grid(p).count()


def test_running_confusion(spark, sf, tmp_path):
    p = adapter.points(spark, sf).withColumn("pred", F.col("cls"))
    p.write.parquet(f"{tmp_path}/in")
    q = gs.running_confusion(spark.readStream.schema(p.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("cm").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("cm").agg(F.sum("n")).first()[0] == p.filter("gt > 0").count()


def test_rolling_latency(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(t0 + dt.timedelta(seconds=s), float(s)) for s in (1, 5, 12, 200)]
    df = spark.createDataFrame(rows, "ts timestamp, end_to_end double")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    q = gs.rolling_latency(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("lat").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.frames for r in spark.table("lat").collect()) == [1, 2]


def test_a_frame_over_two_triggers_is_refused(spark, sf, tmp_path):
    import pytest

    from stratavox.streaming.grid_stream import start_grid_stream

    p = adapter.points(spark, sf).filter("frame_no = 1")
    for k in (0, 1):
        p.filter(F.col("seq") % 8 < 4 if k else F.col("seq") % 8 >= 4).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = start_grid_stream(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    with pytest.raises(Exception, match="goes on in batch 1"):
        query.awaitTermination()
