"""Fixed values of the grid, its classes and its evaluation, and the parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Class ids, names, colours, priorities, traversability weights.
CLASSES = [
    (0, "unlabeled", "#000000", 5, 0.00),
    (1, "car", "#ff0000", 5, 0.10),
    (2, "bicycle", "#ff8000", 5, 0.10),
    (3, "motorcycle", "#ff8000", 5, 0.10),
    (4, "truck", "#800000", 5, 0.10),
    (5, "other-vehicle", "#800000", 5, 0.10),
    (6, "person", "#0000ff", 5, 0.05),
    (7, "bicyclist", "#0000ff", 5, 0.05),
    (8, "motorcyclist", "#0000ff", 5, 0.05),
    (9, "road", "#808080", 1, 0.95),
    (10, "parking", "#606060", 1, 0.90),
    (11, "sidewalk", "#a0a0a0", 1, 0.85),
    (12, "other-ground", "#c0c0c0", 1, 0.70),
    (13, "building", "#ffd700", 4, 0.05),
    (14, "fence", "#8b4513", 4, 0.05),
    (15, "vegetation", "#008000", 2, 0.40),
    (16, "trunk", "#8b4513", 4, 0.05),
    (17, "terrain", "#90ee90", 1, 0.50),
    (18, "pole", "#d3d3d3", 4, 0.05),
    (19, "traffic-sign", "#ff00ff", 4, 0.05),
]
N_CLASSES = len(CLASSES)
UNLABELED, CAR, PERSON, VEGETATION = 0, 1, 6, 15
OBSTACLES = [1, 2, 3, 4, 5, 6, 7, 8, 13, 14, 16, 18, 19]
DYNAMIC = [1, 2, 3, 4, 5, 6, 7, 8]
DRIVABLE = [9, 10]
OFF_ROAD = [11, 12, 17]

# Raw label id -> class id.
LEARNING_MAP = {
    0: 0, 1: 0, 10: 1, 11: 2, 13: 5, 15: 3, 16: 5, 18: 4, 20: 5, 30: 6, 31: 7, 32: 8,
    40: 9, 44: 10, 48: 11, 49: 12, 50: 13, 51: 14, 52: 0, 60: 9, 70: 15, 71: 16, 72: 17,
    80: 18, 81: 19, 99: 0, 252: 1, 253: 7, 254: 6, 255: 8, 256: 5, 257: 5, 258: 4, 259: 5,
}


@dataclass(frozen=True)
class GridConfig:
    """Parameters of the grid engine; the defaults are the published ones."""

    max_level: int = 3
    finest_m: float = 0.05
    band_l3_m: float = 10.0
    band_l2_m: float = 30.0
    band_l1_m: float = 60.0
    split_priority: int = 4
    split_min_points: int = 2
    merge_priority: int = 2
    no_merge_radius_m: float = 10.0
    range_limit_m: float = 0.30
    std_limit_m: float = 0.10
    weight_range: float = 0.6
    weight_std: float = 0.4
    terrain_penalty: float = 0.5
    padding_m: float = 1.0
    blocked_below: float = 0.5
    key_bits: int = 22

    @property
    def tile_m(self) -> float:
        return self.finest_m * 2**self.max_level

    @property
    def key_offset(self) -> int:
        return 1 << (self.key_bits - 1)

    @property
    def index_limit(self) -> int:
        return self.key_offset - 1


@dataclass(frozen=True)
class SensorConfig:
    """Range image geometry and channel statistics (range, x, y, z, remission)."""

    height: int = 64
    width: int = 2048
    fov_up_deg: float = 3.0
    fov_down_deg: float = -25.0
    means: tuple[float, ...] = (12.12, 10.88, 0.23, -1.04, 0.21)
    stds: tuple[float, ...] = (12.32, 11.47, 6.91, 0.86, 0.16)
    knn: int = 5
    search: int = 5
    sigma: float = 1.0
    cutoff: float = 1.0


def by_class(values: list, cls: Column) -> Column:
    """Lookup of a per-class constant; folded into the plan as one literal array."""
    return F.get(F.array(*[F.lit(v) for v in values]), cls)


def priority(cls: Column) -> Column:
    return by_class([c[3] for c in CLASSES], cls)


def traversability(cls: Column) -> Column:
    return by_class([c[4] for c in CLASSES], cls)


def class_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CLASSES, "class_id int, name string, color string, priority int, traversability double")


def learning_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LEARNING_MAP.items()), "raw_id long, cls int")
