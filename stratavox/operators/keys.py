"""Cell indices, levels by distance, and packed keys. Pure column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stratavox.config import GridConfig

CFG = GridConfig()


def finest_index(v: Column, cfg: GridConfig = CFG) -> Column:
    """Index of the finest cell; far points fall into the cells at the edge."""
    i = F.floor(v.cast("double") / F.lit(cfg.finest_m))
    return F.least(F.greatest(i, F.lit(-cfg.index_limit)), F.lit(cfg.index_limit)).cast("long")


def pack_key(level: Column, ix: Column, iy: Column, cfg: GridConfig = CFG) -> Column:
    """level, ix and iy in one BIGINT that sorts by them in this order."""
    high = F.shiftleft(level.cast("long"), 2 * cfg.key_bits)
    middle = F.shiftleft(ix.cast("long") + F.lit(cfg.key_offset), cfg.key_bits)
    return high.bitwiseOR(middle).bitwiseOR(iy.cast("long") + F.lit(cfg.key_offset))


def unpack_key(key: Column, cfg: GridConfig = CFG) -> tuple[Column, Column, Column]:
    mask = F.lit((1 << cfg.key_bits) - 1).cast("long")
    off = F.lit(cfg.key_offset)
    return F.shiftright(key, 2 * cfg.key_bits).cast("int"), F.shiftright(key, cfg.key_bits).bitwiseAND(mask) - off, key.bitwiseAND(mask) - off


def parent_key(key: Column, cfg: GridConfig = CFG) -> Column:
    """Key of the enclosing cell one level up; null at level 0."""
    level, ix, iy = unpack_key(key, cfg)
    return F.when(level > 0, pack_key(level - 1, F.shiftright(ix, 1), F.shiftright(iy, 1), cfg))


def tile_r2(tx: Column, ty: Column, cfg: GridConfig = CFG) -> Column:
    cx, cy = (tx + F.lit(0.5)) * F.lit(cfg.tile_m), (ty + F.lit(0.5)) * F.lit(cfg.tile_m)
    return cx * cx + cy * cy


def near_field(tx: Column, ty: Column, cfg: GridConfig = CFG) -> Column:
    return tile_r2(tx, ty, cfg) < F.lit(cfg.no_merge_radius_m * cfg.no_merge_radius_m)


def with_tiles(points: DataFrame, cfg: GridConfig = CFG) -> DataFrame:
    """Adds ix3, iy3 (finest indices) and tx, ty (tile)."""
    p = points.withColumns({"ix3": finest_index(F.col("x"), cfg), "iy3": finest_index(F.col("y"), cfg)})
    return p.withColumns({"tx": F.shiftright("ix3", cfg.max_level), "ty": F.shiftright("iy3", cfg.max_level)})


def level_of(tx: Column, ty: Column, cfg: GridConfig = CFG) -> Column:
    """Level of a tile's base cells, by its distance."""
    r2 = tile_r2(tx, ty, cfg)
    return F.when(r2 < F.lit(cfg.band_l3_m**2), 3).when(r2 < F.lit(cfg.band_l2_m**2), 2).when(r2 < F.lit(cfg.band_l1_m**2), 1).otherwise(0)


def pack_tile(tx: Column, ty: Column, cfg: GridConfig = CFG) -> Column:
    """A tile's indices in one BIGINT."""
    bits = cfg.key_bits - cfg.max_level
    return F.shiftleft(tx, bits).bitwiseOR(ty + F.lit(1 << (bits - 1)))


def tile_xy(tile: Column, cfg: GridConfig = CFG) -> tuple[Column, Column]:
    bits = cfg.key_bits - cfg.max_level
    return F.shiftright(tile, bits), tile.bitwiseAND(F.lit((1 << bits) - 1).cast("long")) - F.lit(1 << (bits - 1))


def tile_of_key(key: Column, cfg: GridConfig = CFG) -> Column:
    level, ix, iy = unpack_key(key, cfg)
    down = lambda i: F.call_function("shiftright", i, level)
    return pack_tile(down(ix), down(iy), cfg)


def with_levels(p: DataFrame, cfg: GridConfig = CFG) -> DataFrame:
    """Adds level, cx, cy (base cell) to points with tiles."""
    p = p.withColumn("level", level_of(F.col("tx"), F.col("ty"), cfg))
    return p.withColumns({"cx": F.expr(f"shiftright(ix3, {cfg.max_level} - level)"), "cy": F.expr(f"shiftright(iy3, {cfg.max_level} - level)")})


def with_keys(points: DataFrame, cfg: GridConfig = CFG) -> DataFrame:
    return with_levels(with_tiles(points, cfg), cfg)
