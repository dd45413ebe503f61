"""Per-frame tables, summaries and manifests as CSV, JSON and Parquet."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from stratavox.config import SensorConfig


def read_frames(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Per-frame CSV; ``frame`` is a string in ``schema``, so leading zeros stay."""
    return spark.read.csv(path, header=True, schema=schema)


def write_frames(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def no_nan(df: DataFrame) -> DataFrame:
    """NaN and infinities as null, as JSON has neither."""

    def fixed(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c).alias(f.name)
        return c

    return df.select(*[fixed(f) for f in df.schema.fields])


def write_json(df: DataFrame, path: str) -> None:
    no_nan(df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_summary(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A summary as JSON, or None if there is none at ``path``."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.json(path, schema=schema, multiLine=True)


def write_confusion(cm: DataFrame, path: str) -> None:
    """Long form (gt, pred, n); the matrix is ``dense_confusion``."""
    cm.write.mode("overwrite").parquet(path)


def dense_confusion(cm: DataFrame, n_classes: int = 20) -> DataFrame:
    return cm.groupBy("gt").pivot("pred", list(range(n_classes))).agg(F.sum("n")).na.fill(0).orderBy("gt")


MANIFEST = (
    "format string, version int, sequence string, fps int, frame_count long, first_frame string, last_frame string, lite_point_stride int, sensor_height_m double, level_sizes_m array<double>, "
    "classes array<struct<id:int,name:string,color:string,priority:int,traversability:double>>, bookmarks array<struct<label:string,frame:string,index:long,value:double>>, summary map<string,string>, "
    "frames array<struct<index:long,id:string,lite:string,full:string,lite_bytes:long,full_bytes:long,n_points:long,n_cells:long,timing_ms:map<string,double>,stats:map<string,double>,accuracy:struct<accuracy:double,car_iou:double,person_iou:double>>>"
)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A clip's manifest as one row; ``frames`` is an array of its frames."""
    return spark.read.json(path, schema=MANIFEST, multiLine=True)


def frame_url(manifest_url: str, path: Column) -> Column:
    """Address of a frame file: its path is relative to the manifest's folder."""
    return F.concat(F.lit(manifest_url.rsplit("/", 1)[0] + "/"), path)


def write_cells(cells: DataFrame, path: str) -> None:
    """Cells as Parquet, in the order of their keys within a frame, a frame in one file."""
    cells.repartition("frame_no").sortWithinPartitions("frame_no", "key").write.mode("overwrite").parquet(path)


def sensor_config(text: str | None) -> SensorConfig:
    """Sensor and vote parameters from YAML; what is missing or can't be read keeps its default."""
    try:
        import yaml

        found = yaml.safe_load(text) if text else {}
    except Exception:  # noqa: BLE001  no parser, or broken text: defaults
        try:
            found = json.loads(text or "{}")
        except ValueError:
            found = {}
    sensor = found.get("dataset", {}).get("sensor", {}) if isinstance(found, Mapping) else {}
    knn = found.get("post", {}).get("KNN", {}).get("params", {}) if isinstance(found, Mapping) else {}
    prop = sensor.get("img_prop", {})
    names = {"height": prop.get("height"), "width": prop.get("width"), "fov_up_deg": sensor.get("fov_up"), "fov_down_deg": sensor.get("fov_down"), "means": sensor.get("img_means"), "stds": sensor.get("img_stds"), "knn": knn.get("knn"), "search": knn.get("search"), "sigma": knn.get("sigma"), "cutoff": knn.get("cutoff")}
    given = {k: tuple(v) if isinstance(v, list) else v for k, v in names.items() if v is not None}
    return SensorConfig(**given)
