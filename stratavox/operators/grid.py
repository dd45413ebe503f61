"""The grid engine: cells by distance, split on obstacles, merge on flat ground.

Every level nests in the 40 cm tile, so nothing ever crosses a tile. Points are
dealt once by (frame, tile), as five narrow columns; all later aggregations and
windows have those in their keys, so they need no further exchange. Inside a
tile a cell is one small integer, its ``code``: the level and the cell's place
in the tile. Points are first summed up per child cell and class. A cell's vote
and its split flag are windows over those few rows, and a split only chooses
whether they are summed per cell or per child: the points are never read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stratavox.config import N_CLASSES, UNLABELED, GridConfig, priority, traversability
from stratavox.operators.keys import CFG, level_of, near_field, pack_key, pack_tile, tile_of_key, tile_xy, with_tiles

#: The tile comes first: its values differ most, so sorts by these keys are decided early.
TILE = ["tile", "frame_no"]
CELL = [*TILE, "code"]
STATE = ["cnt", "zsum", "zsq", "zmin", "zmax"]
#: Bits of a class id.
CLASS_BITS = 5


def drop_unlabeled(points: DataFrame) -> DataFrame:
    return points.filter(F.col("cls") != UNLABELED)


def checked_labels(points: DataFrame) -> DataFrame:
    """Fails on a class outside 0..19."""
    bad = (F.col("cls") < 0) | (F.col("cls") >= N_CLASSES)
    return points.withColumn("cls", F.when(bad, F.raise_error(F.lit(f"labels must be in 0..{N_CLASSES - 1}"))).otherwise(F.col("cls")))


def pack_code(level: Column, x: Column, y: Column, cfg: GridConfig = CFG) -> Column:
    """A cell of a tile: its level and its place among the tile's cells of that level."""
    b = cfg.max_level
    return F.shiftleft(level.cast("int"), 2 * b).bitwiseOR(F.shiftleft(x.cast("int"), b)).bitwiseOR(y.cast("int"))


def unpack_code(code: Column, cfg: GridConfig = CFG) -> tuple[Column, Column, Column]:
    b, mask = cfg.max_level, F.lit((1 << cfg.max_level) - 1)
    return F.shiftright(code, 2 * b), F.shiftright(code, b).bitwiseAND(mask), code.bitwiseAND(mask)


def parent_code(code: Column, cfg: GridConfig = CFG) -> Column:
    """Code of the enclosing cell one level up; negative at level 0."""
    level, x, y = unpack_code(code, cfg)
    return F.when(level > 0, pack_code(level - 1, F.shiftright(x, 1), F.shiftright(y, 1), cfg)).otherwise(F.lit(-1))


def with_cells(rows: DataFrame, cfg: GridConfig = CFG, code: str = "code", names: tuple[str, str, str] = ("level", "cx", "cy")) -> DataFrame:
    """Adds the level and the cell's indices of its level, from tile and code."""
    tx, ty = tile_xy(F.col("tile"), cfg)
    level, x, y = unpack_code(F.col(code), cfg)
    rows = rows.withColumns({names[0]: level, "_tx": tx, "_ty": ty, "_x": x, "_y": y})
    return rows.withColumns({names[1]: F.expr(f"shiftleft(_tx, {names[0]}) + _x"), names[2]: F.expr(f"shiftleft(_ty, {names[0]}) + _y")}).drop("_tx", "_ty", "_x", "_y")


def partials(points: DataFrame, cfg: GridConfig = CFG) -> DataFrame:
    """Sums per base cell, child (code kid) and class; dealt by tile."""
    b = cfg.max_level
    p = with_tiles(checked_labels(drop_unlabeled(points).select("frame_no", "x", "y", "z", "conf", "cls")), cfg)
    place = F.expr(f"((ix3 & {(1 << b) - 1}) << {b + CLASS_BITS}) | ((iy3 & {(1 << b) - 1}) << {CLASS_BITS}) | cls").cast("int")
    p = p.select(pack_tile(F.col("tx"), F.col("ty"), cfg).alias("tile"), "frame_no", place.alias("place"), F.col("z").cast("double").alias("z"), F.col("conf").cast("double").alias("conf")).repartition(*TILE)
    # what follows from the tile is worked out after the exchange
    tx, ty = tile_xy(F.col("tile"), cfg)
    p = p.withColumn("kl", F.least(level_of(tx, ty, cfg) + 1, F.lit(b)))
    kid = f"(kl << {2 * b}) | ((place >> ({b + CLASS_BITS} + {b} - kl)) << {b}) | (((place >> {CLASS_BITS}) & {(1 << b) - 1}) >> ({b} - kl))"
    p = p.withColumn("kid", F.expr(f"shiftleft({kid}, {CLASS_BITS}) | (place & {(1 << CLASS_BITS) - 1})").cast("int"))
    sums = p.groupBy(*TILE, "kid").agg(F.count("*").alias("cnt"), F.sum("z").alias("zsum"), F.sum(F.col("z") * F.col("z")).alias("zsq"), F.min("z").alias("zmin"), F.max("z").alias("zmax"), F.sum("conf").alias("score"))
    kid, cls = F.shiftright("kid", CLASS_BITS), F.col("kid").bitwiseAND((1 << CLASS_BITS) - 1)
    # at the finest level a cell is its own child
    own = F.when(level_of(tx, ty, cfg) == b, kid).otherwise(parent_code(kid, cfg))
    return sums.select(*TILE, own.alias("code"), kid.alias("kid"), cls.alias("cls"), *STATE, "score")


def _sums() -> list[Column]:
    return [F.sum("cnt").alias("cnt"), F.sum("zsum").alias("zsum"), F.sum("zsq").alias("zsq"), F.min("zmin").alias("zmin"), F.max("zmax").alias("zmax")]


def winner(best: Column) -> Column:
    """Class of the greatest (score, -class): the least id wins a tie. With no score
    above zero it is class 0, which every vote has with a score of zero."""
    return F.when(best["score"] > 0, -best["other"]).otherwise(0).cast("int")


def ballot() -> Column:
    return F.struct(F.col("score").alias("score"), (-F.col("cls")).alias("other"))


def voted(rows: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """Statistics, class, winner's score and total score per key."""
    extra = [c.alias(f"more{k}") for k, c in enumerate(more)]
    per_class = rows.groupBy(*keys, "cls").agg(*_sums(), F.sum("score").alias("score"), *extra)
    cells = per_class.groupBy(*keys).agg(*_sums(), F.max(ballot()).alias("best"), F.sum("score").alias("total"), *[F.sum(f"more{k}").alias(f"more{k}") for k in range(len(more))])
    return cells.select(*keys, *STATE, winner(F.col("best")).alias("cls"), F.greatest(F.col("best.score"), F.lit(0.0)).alias("wscore"), "total", *[f"more{k}" for k in range(len(more))])


def splits(cls: Column, level: Column, cnt: Column, cfg: GridConfig = CFG) -> Column:
    return (priority(cls) >= cfg.split_priority) & (level < cfg.max_level) & (cnt >= cfg.split_min_points)


def stage1(points: DataFrame, cfg: GridConfig = CFG) -> DataFrame:
    """Base cells (tile, frame_no, level, cx, cy) with their statistics, class and split flag."""
    cells = with_cells(voted(partials(points, cfg), CELL), cfg)
    return cells.withColumn("is_split", splits(F.col("cls"), F.col("level"), F.col("cnt"), cfg))


def with_split_flag(parts: DataFrame, cfg: GridConfig = CFG) -> DataFrame:
    """Partial sums with the split flag of their base cell, and whether they are the
    cell's head, which stands for it in counts. Both windows use one sort."""
    rows = parts.withColumn("class_score", F.sum("score").over(Window.partitionBy(*CELL, "cls")))
    w = Window.partitionBy(*CELL)
    best = F.max(F.struct(F.col("class_score").alias("score"), (-F.col("cls")).alias("other"))).over(w)
    mine = F.struct("kid", "cls")
    rows = rows.withColumns({"best": best, "cell_cnt": F.sum("cnt").over(w), "is_head": F.min(mine).over(w) == mine})
    level = unpack_code(F.col("code"), cfg)[0]
    return rows.withColumn("is_split", splits(winner(F.col("best")), level, F.col("cell_cnt"), cfg)).drop("class_score", "best", "cell_cnt")


def split_children(points: DataFrame, cfg: GridConfig = CFG) -> DataFrame:
    """The children that replace split cells."""
    rows = with_split_flag(partials(points, cfg), cfg).filter("is_split")
    return with_cells(voted(rows.select(*TILE, F.col("kid").alias("code"), "cls", *STATE, "score"), CELL), cfg)


def stage2(points: DataFrame, cfg: GridConfig = CFG) -> DataFrame:
    """Leaves after the split, and marker rows (is_marker) for the parents of split
    cells: such a parent may not be merged. n_cells and n_splits count base cells
    and split ones, each at one of its leaves."""
    up = F.col("is_split")
    rows = with_split_flag(partials(points, cfg), cfg)
    rows = rows.select(*TILE, F.when(up, F.col("kid")).otherwise(F.col("code")).alias("code"), "is_split", "is_head", "cls", *STATE, "score")
    leaves = voted(rows, [*CELL, "is_split"], F.count_if("is_head")).withColumnRenamed("more0", "n_cells")
    leaves = leaves.withColumn("n_splits", F.when(up, F.col("n_cells")).otherwise(0))
    fields = [*STATE, "cls", "wscore", "total", "n_cells", "n_splits"]
    leaf = F.struct("code", *fields, F.lit(False).alias("is_marker"))
    # the split cell itself, one level above its child
    old = F.struct(parent_code(F.col("code"), cfg).alias("code"), *[F.col(f) for f in fields], F.lit(True).alias("is_marker"))
    both = F.when(up & (unpack_code(F.col("code"), cfg)[0] > 1), F.array(leaf, old)).otherwise(F.array(leaf))
    return leaves.select(*TILE, F.inline(both))


def merge_groups(leaves: DataFrame, cfg: GridConfig = CFG) -> DataFrame:
    """Leaves and markers with their parent and its eligibility."""
    rows = leaves.withColumn("parent", parent_code(F.col("code"), cfg))
    w = Window.partitionBy(*TILE, "parent")
    leaf = ~F.col("is_marker")
    tx, ty = tile_xy(F.col("tile"), cfg)
    eligible = (
        (F.col("parent") >= 0)
        & ~F.max("is_marker").over(w)
        & (F.max(F.when(leaf, priority(F.col("cls")))).over(w) <= cfg.merge_priority)
        & (F.min("cls").over(w) == F.max("cls").over(w))
        & ~near_field(tx, ty, cfg)
    )
    return rows.withColumn("eligible", eligible)


def merged_cells(groups: DataFrame) -> DataFrame:
    """Surviving leaves and merged parents as cell states."""
    rows = groups.filter("not is_marker").withColumn("code", F.when(F.col("eligible"), F.col("parent")).otherwise(F.col("code")))
    return rows.groupBy(*CELL).agg(*_sums(), F.min("cls").alias("cls"), F.sum("wscore").alias("wscore"), F.sum("total").alias("total"), F.max("eligible").alias("is_merged"), F.sum("n_cells").alias("n_cells"), F.sum("n_splits").alias("n_splits"))


def cell_states(points: DataFrame, cfg: GridConfig = CFG) -> DataFrame:
    return merged_cells(merge_groups(stage2(points, cfg), cfg))


def finalize(cells: DataFrame, cfg: GridConfig = CFG) -> DataFrame:
    """The twenty output fields of a cell, after frame_no, tile, key, tx and ty."""
    cells = with_cells(cells, cfg)
    tx, ty = tile_xy(F.col("tile"), cfg)
    size = F.lit(cfg.finest_m) * F.expr(f"shiftleft(1, {cfg.max_level} - level)")
    c = cells.withColumn("resolution", size)
    r = F.col("resolution")
    cnt = F.col("cnt").cast("double")
    c = c.withColumns({"x_min": F.col("cx") * r, "x_max": (F.col("cx") + 1) * r, "y_min": F.col("cy") * r, "y_max": (F.col("cy") + 1) * r, "elevation": F.col("zsum") / cnt})
    c = c.withColumn("elevation_variance", F.greatest(F.col("zsq") / cnt - F.col("elevation") * F.col("elevation"), F.lit(0.0)))
    c = c.withColumn("height_range", F.col("zmax") - F.col("zmin"))
    rough = F.lit(cfg.weight_range) * F.least(F.col("height_range") / F.lit(cfg.range_limit_m), F.lit(1.0)) + F.lit(cfg.weight_std) * F.least(F.sqrt("elevation_variance") / F.lit(cfg.std_limit_m), F.lit(1.0))
    c = c.withColumn("terrain_complexity", rough)
    trav = traversability(F.col("cls")) * (F.lit(1.0) - F.lit(cfg.terrain_penalty) * F.col("terrain_complexity"))
    return c.select(
        "frame_no",
        "tile",
        pack_key(F.col("level"), F.col("cx"), F.col("cy"), cfg).alias("key"),
        tx.alias("tx"),
        ty.alias("ty"),
        "x_min",
        "x_max",
        "y_min",
        "y_max",
        ((F.col("x_min") + F.col("x_max")) * 0.5).alias("x_center"),
        ((F.col("y_min") + F.col("y_max")) * 0.5).alias("y_center"),
        "resolution",
        F.col("level").cast("int").alias("level"),
        "elevation",
        F.col("zmin").alias("min_height"),
        F.col("zmax").alias("max_height"),
        "elevation_variance",
        F.col("cls").alias("semantic_class"),
        F.when(F.col("total") > 0, F.col("wscore") / F.when(F.col("total") > 0, F.col("total"))).otherwise(0.0).alias("semantic_confidence"),
        F.lit(1.0).alias("occupancy"),
        "terrain_complexity",
        F.least(F.greatest(trav, F.lit(0.0)), F.lit(1.0)).alias("traversability"),
        cnt.alias("point_count"),
        priority(F.col("cls")).alias("semantic_priority"),
        "height_range",
    )


def build_grid(points: DataFrame, cfg: GridConfig = CFG) -> DataFrame:
    """Points to finished cells, all frames in one job."""
    return finalize(cell_states(points, cfg), cfg)


def grid_stats(points: DataFrame, cfg: GridConfig = CFG) -> DataFrame:
    """The seven counters per frame; points are dealt once."""
    used = (F.col("cls") != UNLABELED).cast("long")
    n_in = points.groupBy("frame_no").agg(F.count("*").alias("n_points_in"), F.sum(used).alias("n_points_used"), F.sum(1 - used).alias("n_unlabeled_dropped"))
    cells = cell_states(points, cfg).groupBy("frame_no").agg(F.sum("n_cells").alias("n_stage1_cells"), F.sum("n_splits").alias("n_splits"), F.count_if("is_merged").alias("n_merges"), F.count("*").alias("n_final_cells"))
    out = n_in.join(cells, "frame_no", "left")
    return out.select("frame_no", "n_points_in", "n_points_used", "n_unlabeled_dropped", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_stage1_cells", "n_splits", "n_merges", "n_final_cells")])


def grid_bounds(points: DataFrame, cfg: GridConfig = CFG) -> DataFrame:
    """Extent of the used points per frame, padded and snapped to tiles."""
    b = drop_unlabeled(points).groupBy("frame_no").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    t, pad = F.lit(cfg.tile_m), F.lit(cfg.padding_m)
    low = lambda c: F.floor((F.col(c) - pad) / t) * t
    high = lambda c: F.ceil((F.col(c) + pad) / t) * t
    return b.select("frame_no", "x0", "y0", "x1", "y1", low("x0").alias("grid_x_min"), low("y0").alias("grid_y_min"), high("x1").alias("grid_x_max"), high("y1").alias("grid_y_max"), t.alias("tile_size"), F.array(*[F.lit(cfg.finest_m * 2 ** (cfg.max_level - k)) for k in range(cfg.max_level + 1)]).alias("level_sizes"))


def cell_lookup(points: DataFrame, cells: DataFrame, cfg: GridConfig = CFG) -> DataFrame:
    """Every point with the cell that covers it, null columns if none.

    Cells never overlap, so a point has one at most. The join is by tile, which
    is how built cells are partitioned already; the level is a residual condition.
    Cells need their key; the tile is worked out from it where it isn't there.
    """
    b = cfg.max_level
    p = with_tiles(points, cfg).withColumn("tile", pack_tile(F.col("tx"), F.col("ty"), cfg))
    if "tile" not in cells.columns:
        cells = cells.withColumn("tile", tile_of_key(F.col("key"), cfg))
    mask = f"{(1 << cfg.key_bits) - 1}"
    c = cells.withColumns({"_l": F.expr(f"{b} - cast(shiftright(key, {2 * cfg.key_bits}) as int)"), "_x": F.expr(f"(shiftright(key, {cfg.key_bits}) & {mask}) - {cfg.key_offset}"), "_y": F.expr(f"(key & {mask}) - {cfg.key_offset}")})
    c = c.select(*[F.col(x).alias(f"c_{x}") for x in c.columns])
    on = (p.frame_no == c.c_frame_no) & (p.tile == c.c_tile) & F.expr("shiftright(ix3, c__l) = c__x AND shiftright(iy3, c__l) = c__y")
    return p.join(c, on, "left").drop("c_frame_no", "c_tile", "c__l", "c__x", "c__y")
