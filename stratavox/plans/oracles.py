"""SQL of every query that SQL can express, written independently of the engine.

The grid is expressed in plain relational steps: join back to points for the
split, UNION ALL for the merge. All literals that must be doubles have an
exponent.
"""

from __future__ import annotations

from stratavox.config import CLASSES, LEARNING_MAP
from stratavox.sources.adapter import STAGES

PRI = "[" + ", ".join(str(c[3]) for c in CLASSES) + "]"
TRAV = "[" + ", ".join(f"{c[4]:.2f}e0" for c in CLASSES) + "]"
IDS = "[" + ", ".join(map(str, LEARNING_MAP)) + "]"
MAP = "(VALUES " + ", ".join(f"({k}, {v})" for k, v in LEARNING_MAP.items()) + ") lm(raw_id, c)"

PTS = """
src AS (SELECT event_id AS k, user_id AS uid, user_id % 10 AS u, event_type AS t FROM events),
geo AS (SELECT k, uid, t, (k % 4)::INTEGER AS frame_no,
  (CASE WHEN t IN ('view', 'click') THEN (k * 7919) % 163841 - 81920 ELSE (u * 35711) % 122881 - 61440 + (k * 31) % 410 - 205 END) / 1024e0 AS x,
  (CASE WHEN t IN ('view', 'click') THEN (k * 104729) % 163841 - 81920 ELSE (u * 7001) % 40961 - 20480 + (k * 57) % 410 - 205 END) / 1024e0 AS y,
  (CASE WHEN t IN ('view', 'click') THEN (k * 17) % 41 - 1792 ELSE (k * 37) % 1536 - 1740 END) / 1024e0 AS z,
  (k % 1024) / 1024e0 AS remission, (512 + (k * 13) % 512) / 1024e0 AS conf FROM src),
lab AS (SELECT *, (CASE t WHEN 'view' THEN CASE WHEN abs(y) < 6 THEN 9 WHEN abs(y) < 8 THEN 11 ELSE 17 END WHEN 'click' THEN 15 WHEN 'purchase' THEN 1
  WHEN 'error' THEN CASE WHEN uid % 2 = 0 THEN 6 ELSE 13 END ELSE CASE WHEN k % 5 = 0 THEN 0 ELSE 18 END END)::INTEGER AS cls FROM geo),
pts AS (SELECT frame_no, k AS seq, x, y, z, remission, conf, cls, (CASE WHEN k % 11 = 0 THEN (k * 7) % 20 ELSE cls END)::INTEGER AS gt FROM lab)"""

KEYS = """,
ix AS (SELECT *, least(greatest(floor(x / 0.05e0), -2097151), 2097151)::BIGINT AS ix3, least(greatest(floor(y / 0.05e0), -2097151), 2097151)::BIGINT AS iy3 FROM pts),
tl AS (SELECT *, ix3 >> 3 AS tx, iy3 >> 3 AS ty FROM ix),
rr AS (SELECT *, ((tx + 0.5e0) * 0.4e0) * ((tx + 0.5e0) * 0.4e0) + ((ty + 0.5e0) * 0.4e0) * ((ty + 0.5e0) * 0.4e0) AS r2 FROM tl),
keyed AS (SELECT *, CASE WHEN r2 < 100e0 THEN 3 WHEN r2 < 900e0 THEN 2 WHEN r2 < 3600e0 THEN 1 ELSE 0 END AS level FROM rr)"""


def _pack(level: str, x: str, y: str) -> str:
    return f"((({level})::BIGINT << 44) | ((({x}) + 2097152) << 22) | (({y}) + 2097152))"


def _agg(keys: str, source: str) -> str:
    scores = ", ".join(f"sum(CASE WHEN cls = {c} THEN conf ELSE 0e0 END)" for c in range(20))
    return f"SELECT {keys}, count(*) AS cnt, sum(z) AS zsum, sum(z * z) AS zsq, min(z) AS zmin, max(z) AS zmax, [{scores}] AS scores FROM {source} GROUP BY {keys}"


VOTE = "(list_position(scores, list_max(scores)) - 1)::INTEGER AS cls, list_max(scores) AS wscore, list_sum(scores) AS total"

STAGE1 = f""",
used AS (SELECT *, ix3 >> (3 - level) AS cx, iy3 >> (3 - level) AS cy FROM keyed WHERE cls <> 0),
a1 AS ({_agg("frame_no, tx, ty, r2, level, cx, cy", "used")}),
v1 AS (SELECT *, {VOTE} FROM a1),
s1 AS (SELECT *, ({PRI}[cls + 1] >= 4 AND level < 3 AND cnt >= 2) AS is_split FROM v1)"""

CHAIN = f""",
kids AS (SELECT p.frame_no, p.tx, p.ty, p.r2, p.level + 1 AS level, p.ix3 >> (2 - p.level) AS cx, p.iy3 >> (2 - p.level) AS cy, p.z, p.conf, p.cls
  FROM used p JOIN s1 USING (frame_no, level, cx, cy) WHERE s1.is_split),
a2 AS ({_agg("frame_no, tx, ty, r2, level, cx, cy", "kids")}),
s2 AS (SELECT frame_no, tx, ty, r2, level, cx, cy, cnt, zsum, zsq, zmin, zmax, cls, wscore, total FROM s1 WHERE NOT is_split
  UNION ALL SELECT frame_no, tx, ty, r2, level, cx, cy, cnt, zsum, zsq, zmin, zmax, {VOTE} FROM a2),
mem AS (SELECT frame_no, r2, level - 1 AS pl, cx >> 1 AS px, cy >> 1 AS py, cls, 0 AS mark FROM s2 WHERE level > 0
  UNION ALL SELECT frame_no, r2, level - 1, cx >> 1, cy >> 1, NULL, 1 FROM s1 WHERE is_split AND level > 0),
par AS (SELECT frame_no, pl, px, py FROM mem GROUP BY ALL
  HAVING max(mark) = 0 AND max({PRI}[cls + 1]) <= 2 AND min(cls) = max(cls) AND min(r2) >= 100e0),
fin AS (SELECT s2.*, par.pl IS NOT NULL AS up FROM s2 LEFT JOIN par ON s2.frame_no = par.frame_no AND s2.level - 1 = par.pl AND s2.cx >> 1 = par.px AND s2.cy >> 1 = par.py),
st AS (SELECT frame_no, tx, ty, CASE WHEN up THEN level - 1 ELSE level END AS level, CASE WHEN up THEN cx >> 1 ELSE cx END AS cx, CASE WHEN up THEN cy >> 1 ELSE cy END AS cy,
  sum(cnt) AS cnt, sum(zsum) AS zsum, sum(zsq) AS zsq, min(zmin) AS zmin, max(zmax) AS zmax, min(cls) AS cls, sum(wscore) AS wscore, sum(total) AS total, bool_or(up) AS is_merged
  FROM fin GROUP BY 1, 2, 3, 4, 5, 6),
f1 AS (SELECT *, 0.05e0 * (1 << (3 - level)) AS res, zsum / cnt::DOUBLE AS mean FROM st),
f2 AS (SELECT *, greatest(zsq / cnt::DOUBLE - mean * mean, 0e0) AS var, zmax - zmin AS hr FROM f1),
f3 AS (SELECT *, 0.6e0 * least(hr / 0.3e0, 1e0) + 0.4e0 * least(sqrt(var) / 0.1e0, 1e0) AS cx_ FROM f2),
cells AS (SELECT frame_no, {_pack("level", "cx", "cy")} AS key, tx, ty, cx * res AS x_min, (cx + 1) * res AS x_max, cy * res AS y_min, (cy + 1) * res AS y_max,
  (cx * res + (cx + 1) * res) * 0.5e0 AS x_center, (cy * res + (cy + 1) * res) * 0.5e0 AS y_center, res AS resolution, level::INTEGER AS level,
  mean AS elevation, zmin AS min_height, zmax AS max_height, var AS elevation_variance, cls AS semantic_class,
  CASE WHEN total > 0 THEN wscore / total ELSE 0e0 END AS semantic_confidence, 1e0 AS occupancy, cx_ AS terrain_complexity,
  least(greatest({TRAV}[cls + 1] * (1e0 - 0.5e0 * cx_), 0e0), 1e0) AS traversability, cnt::DOUBLE AS point_count, {PRI}[cls + 1] AS semantic_priority, hr AS height_range, cx, cy FROM f3)"""

LOOK = """,
lk AS (SELECT p.*, c.key AS c_key, c.level AS c_level, c.resolution AS c_resolution, c.semantic_class AS c_cls, c.traversability AS c_trav
  FROM tl p LEFT JOIN cells c ON p.frame_no = c.frame_no AND p.tx = c.tx AND p.ty = c.ty AND p.ix3 >> (3 - c.level) = c.cx AND p.iy3 >> (3 - c.level) = c.cy)"""

BASE = "WITH " + PTS
KEYED = BASE + KEYS
FIRST = KEYED + STAGE1
GRID = FIRST + CHAIN
LOOKED = GRID + LOOK

VARIANTS = """,
pv AS (SELECT frame_no, seq, x, y, gt, 'A' AS variant, cls AS pred FROM pts UNION ALL
  SELECT frame_no, seq, x, y, gt, 'B', CASE WHEN seq % 13 = 0 THEN 15 ELSE cls END FROM pts UNION ALL
  SELECT frame_no, seq, x, y, gt, 'C', CASE WHEN seq % 17 = 0 THEN 9 ELSE cls END FROM pts),
pc AS (SELECT * FROM pv WHERE variant = 'C'),
cm AS (SELECT gt, pred, count(*) AS n FROM pc WHERE gt > 0 GROUP BY ALL)"""
CM = BASE + VARIANTS


def _iou(source: str, keys: str = "") -> str:
    k = keys + ", " if keys else ""
    return f"""(SELECT {k}class_id, sum(t)::BIGINT AS tp, sum(g)::BIGINT AS gt_points, sum(p)::BIGINT AS pred_points, sum(t) / greatest(sum(g) + sum(p) - sum(t), 1)::DOUBLE AS iou FROM (
    SELECT {k}gt AS class_id, n AS g, 0 AS p, CASE WHEN gt = pred THEN n ELSE 0 END AS t FROM {source} UNION ALL SELECT {k}pred, 0, n, 0 FROM {source}) GROUP BY {k}class_id)"""


def _names() -> str:
    return "(SELECT * FROM (VALUES " + ", ".join(f"({c[0]}, '{c[1]}', '{c[2]}')" for c in CLASSES) + ") v(class_id, name, color))"


QCELLS = """,
q AS (SELECT frame_no, least(greatest(floor(x_min / resolution + 0.5e0), -32768), 32767)::INTEGER AS ix, least(greatest(floor(y_min / resolution + 0.5e0), -32768), 32767)::INTEGER AS iy, level, semantic_class AS cls,
  least(greatest(round_even(min_height * 100e0, 0), -32768), 32767)::INTEGER AS z_min_cm, least(greatest(round_even(max_height * 100e0, 0), -32768), 32767)::INTEGER AS z_max_cm,
  least(greatest(round_even(elevation * 100e0, 0), -32768), 32767)::INTEGER AS z_cm, least(greatest(round_even(sqrt(elevation_variance) * 1000e0, 0), 0), 65535)::INTEGER AS z_std_mm,
  least(greatest(round_even(traversability * 255e0, 0), 0), 255)::INTEGER AS trav, least(greatest(round_even(terrain_complexity * 255e0, 0), 0), 255)::INTEGER AS complexity,
  least(greatest(round_even(semantic_confidence * 255e0, 0), 0), 255)::INTEGER AS confidence, least(greatest(point_count, 0), 65535)::INTEGER AS n_points FROM cells)"""
QUANT = GRID + QCELLS


QPOINTS = BASE + """ SELECT frame_no, seq, least(greatest(round_even(x * 100e0, 0), -32768), 32767)::INTEGER AS x_cm, least(greatest(round_even(y * 100e0, 0), -32768), 32767)::INTEGER AS y_cm, least(greatest(round_even(z * 100e0, 0), -32768), 32767)::INTEGER AS z_cm,
      round_even(least(greatest(remission, 0e0), 1e0) * 255e0, 0)::INTEGER AS intensity, cls AS class, round_even(least(greatest(conf, 0e0), 1e0) * 255e0, 0)::INTEGER AS confidence, gt AS gt_class FROM pts"""
QPOINTS_DECODED = QPOINTS.replace("frame_no, seq,", "frame_no,")


def _drive(off: bool) -> str:
    return f"""SELECT frame_no, ix, iy, level, (CASE WHEN cls IN (0, 1, 2, 3, 4, 5, 6, 7, 8, 13, 14, 16, 18, 19) OR complexity / 255e0 >= 0.8e0 THEN 2
    WHEN s = 0 AND (complexity / 255e0 >= 0.5e0 OR confidence / 255e0 < 0.5e0) THEN 1 ELSE s END)::INTEGER AS code
    FROM (SELECT *, CASE WHEN cls IN (9, 10) THEN 0 WHEN cls IN (11, 12, 17) THEN {0 if off else 1} WHEN cls = 15 THEN {1 if off else 2} ELSE 1 END AS s FROM q)"""


TIMES = (
    "WITH t0 AS (SELECT o_orderkey AS frame_no, printf('%06d', o_orderkey) AS frame, "
    + ", ".join(f"CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_orderkey * {p} % {q}) / 128e0 END AS {c}" if c == "grid_cpu" else f"(o_orderkey * {p} % {q}) / 128e0 AS {c}" for c, (p, q) in STAGES.items())
    + ", (o_orderkey * 61 % 1024 + 400)::DOUBLE AS vram_mb, o_orderkey * 67 % 5000 + 100000 AS n_points FROM orders), "
    "t1 AS (SELECT *, coalesce(project, 0e0) + coalesce(model, 0e0) + coalesce(post, 0e0) AS seg_total, coalesce(grid_gpu, 0e0) + coalesce(grid_cpu, 0e0) + coalesce(grid_to_cpu, 0e0) AS grid_engine_total FROM t0), "
    "t AS (SELECT *, coalesce(upload, 0e0) + seg_total + grid_engine_total AS end_to_end FROM t1) "
)

_STAGE = "SELECT '{c}' AS stage, round(quantile_cont({c}::DOUBLE, 0.5e0), 2) AS median_ms, round(quantile_cont({c}::DOUBLE, 0.95e0), 2) AS p95_ms, round(quantile_cont({c}::DOUBLE, 0.99e0), 2) AS p99_ms, round(max({c}), 2) AS max_ms, round(avg({c}), 2) AS mean_ms FROM t"

FACC = """,
fa AS (SELECT frame_no, avg((gt = pred)::INTEGER::DOUBLE) AS accuracy,
  CASE WHEN count(*) FILTER (gt = 1) > 0 THEN count(*) FILTER (gt = 1 AND pred = 1) / (count(*) FILTER (gt = 1 OR pred = 1))::DOUBLE END AS car_iou,
  CASE WHEN count(*) FILTER (gt = 6) > 0 THEN count(*) FILTER (gt = 6 AND pred = 6) / (count(*) FILTER (gt = 6 OR pred = 6))::DOUBLE END AS person_iou,
  count(*) FILTER (gt = 1) AS gt_car_points, count(*) FILTER (gt = 6) AS gt_person_points FROM pc WHERE gt > 0 GROUP BY frame_no)"""

CELL_COLUMNS = "frame_no, key, tx, ty, x_min, x_max, y_min, y_max, x_center, y_center, resolution, level, elevation, min_height, max_height, elevation_variance, semantic_class, semantic_confidence, occupancy, terrain_complexity, traversability, point_count, semantic_priority, height_range"

EVAL = """,
ev AS (SELECT frame_no, c_key AS key, c_level AS level, c_resolution AS resolution, c_cls AS semantic_class, gt, count(*) AS n FROM lk WHERE gt > 0 AND c_key IS NOT NULL GROUP BY ALL),
ec AS (SELECT frame_no, key, level, resolution, semantic_class, gt AS gt_class, gt = semantic_class AS correct FROM ev QUALIFY row_number() OVER (PARTITION BY frame_no, key ORDER BY n DESC, gt) = 1)"""

PIX = BASE + """,
px AS (SELECT frame_no, seq, (seq % 64)::INTEGER AS px, ((seq * 5) % 16)::INTEGER AS py, (512 + (seq * 29) % 4096) / 128e0 AS depth, cls FROM pts),
own AS (SELECT frame_no, py, px, seq AS owner, depth, cls FROM px QUALIFY row_number() OVER (PARTITION BY frame_no, py, px ORDER BY depth, seq) = 1)"""
# the weights worked out in SQL: one minus a Gaussian of standard deviation 1, divided by its sum over the window
KERNEL = """kn AS (SELECT (dy + 2) * 5 + dx + 2 AS place, dy, dx, 1e0 - exp(-(dx * dx + dy * dy) / 2e0) / sum(exp(-(dx * dx + dy * dy) / 2e0)) OVER () AS w
  FROM (SELECT unnest(range(-2, 3))::INTEGER AS dy), (SELECT unnest(range(-2, 3))::INTEGER AS dx))"""
KNN = PIX + f""", {KERNEL},
      nb AS (SELECT p.frame_no, p.seq, place, abs(CASE WHEN place = 12 THEN p.depth WHEN p.py + dy < 0 OR p.py + dy >= 16 OR p.px + dx < 0 OR p.px + dx >= 64 THEN 0e0 ELSE coalesce(o.depth, 'inf'::DOUBLE) END - p.depth) * w AS dist, coalesce(o.cls, 0) AS c
        FROM px p CROSS JOIN kn LEFT JOIN own o ON o.frame_no = p.frame_no AND o.py = p.py + dy AND o.px = p.px + dx),
      nn AS (SELECT frame_no, seq, CASE WHEN dist <= 1e0 THEN c END AS c FROM nb QUALIFY row_number() OVER (PARTITION BY frame_no, seq ORDER BY dist, place) <= 5),
      vt AS (SELECT frame_no, seq, c, count(*) AS n FROM nn WHERE c > 0 GROUP BY ALL),
      bt AS (SELECT frame_no, seq, c FROM vt QUALIFY row_number() OVER (PARTITION BY frame_no, seq ORDER BY n DESC, c) = 1),
      kv AS (SELECT frame_no, seq, px.px, px.py, coalesce(bt.c, 1)::INTEGER AS label FROM px LEFT JOIN bt USING (frame_no, seq))"""

SENSOR_SQL = """,
sp AS (SELECT frame_no, seq, x, y, z, remission, sqrt(x * x + y * y + z * z) AS depth FROM pts),
pr AS (SELECT *, least(greatest(floor(0.5e0 * (-atan2(y, x) / 3.141592653589793e0 + 1e0) * 2048), 0), 2047)::INTEGER AS px,
  least(greatest(floor((1e0 - (asin(least(greatest(z / greatest(depth, 1e-6), -1e0), 1e0)) + 0.4363323129985824e0) / 0.4886921905584123e0) * 64), 0), 63)::INTEGER AS py FROM sp)"""

SQL: dict[str, str] = {
    "load_filter_valid": BASE + " SELECT frame_no, seq, x, y, z FROM pts WHERE isfinite(x) AND isfinite(y) AND isfinite(z) AND isfinite(remission)",
    "learning_map": f"SELECT event_id AS seq, coalesce(c, 0)::INTEGER AS cls FROM (SELECT event_id, ((user_id << 16) | {IDS}[event_id % {len(LEARNING_MAP)} + 1]) & 65535 AS r FROM events) LEFT JOIN {MAP} ON r = raw_id",
    "frame_listing": "WITH f AS (SELECT DISTINCT printf('%06d', event_id % 50) AS frame_id, event_id % 50 AS n FROM events), l AS (SELECT DISTINCT frame_id FROM f WHERE n % 3 <> 0) SELECT frame_id FROM f WHERE n >= 10 AND frame_id IN (SELECT frame_id FROM l) ORDER BY frame_id LIMIT 20",
    "drop_unlabeled": BASE + " SELECT frame_no, seq, cls FROM pts WHERE cls <> 0",
    "point_keys": KEYED + f" SELECT frame_no, seq, level, {_pack('level', 'ix3 >> (3 - level)', 'iy3 >> (3 - level)')} AS key FROM keyed",
    "key_roundtrip": KEYED + " SELECT frame_no, seq, level, ix3 >> (3 - level) AS ix, iy3 >> (3 - level) AS iy FROM keyed",
    "parent_keys": KEYED + f" SELECT frame_no, seq, CASE WHEN level > 0 THEN {_pack('level - 1', 'ix3 >> (4 - level)', 'iy3 >> (4 - level)')} END AS parent FROM keyed",
    "near_field": KEYED + " SELECT frame_no, seq, r2 < 100e0 AS near FROM keyed",
    "stage1_cells": FIRST + " SELECT frame_no, level, cx, cy, cnt, zsum, zsq, zmin, zmax FROM s1",
    "class_vote": FIRST + " SELECT frame_no, level, cx, cy, cls, wscore, total FROM s1",
    "split_flags": FIRST + " SELECT frame_no, level, cx, cy, is_split FROM s1",
    "split_children": GRID + f" SELECT frame_no, level, cx, cy, cnt, zsum, zmin, zmax, {VOTE} FROM a2",
    "merge_groups": GRID + " SELECT frame_no, pl AS plevel, px, py FROM par",
    "grid_cells": GRID + f" SELECT {CELL_COLUMNS} FROM cells",
    "grid_stats": GRID + """ SELECT a.*, coalesce(b.n1, 0) AS n_stage1_cells, coalesce(b.n2, 0) AS n_splits, coalesce(c.n1, 0) AS n_merges, coalesce(c.n2, 0) AS n_final_cells FROM
      (SELECT frame_no, count(*) AS n_points_in, count(*) FILTER (cls <> 0) AS n_points_used, count(*) FILTER (cls = 0) AS n_unlabeled_dropped FROM pts GROUP BY 1) a
      LEFT JOIN (SELECT frame_no, count(*) AS n1, count(*) FILTER (is_split) AS n2 FROM s1 GROUP BY 1) b USING (frame_no)
      LEFT JOIN (SELECT frame_no, count(*) FILTER (is_merged) AS n1, count(*) AS n2 FROM st GROUP BY 1) c USING (frame_no)""",
    "grid_bounds": BASE + """ SELECT frame_no, x0, y0, x1, y1, floor((x0 - 1e0) / 0.4e0) * 0.4e0 AS grid_x_min, floor((y0 - 1e0) / 0.4e0) * 0.4e0 AS grid_y_min,
      ceil((x1 + 1e0) / 0.4e0) * 0.4e0 AS grid_x_max, ceil((y1 + 1e0) / 0.4e0) * 0.4e0 AS grid_y_max, 0.4e0 AS tile_size, '0.40 0.20 0.10 0.05' AS level_sizes
      FROM (SELECT frame_no, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM pts WHERE cls <> 0 GROUP BY 1)""",
    "cells_by_level": GRID + " SELECT frame_no, level, count(*) AS n, sum(point_count) AS points FROM cells GROUP BY ALL",
    "cell_lookup": LOOKED + " SELECT frame_no, seq, c_key AS key FROM lk",
    "unlabeled_lookup": LOOKED + " SELECT frame_no, count(*) AS n, count(c_key) AS on_cell FROM lk WHERE cls = 0 GROUP BY 1",
    "confusion": CM + " SELECT gt, pred, n FROM cm",
    "iou_per_class": CM + f" SELECT * FROM {_iou('cm')}",
    "miou": CM + f" SELECT round(avg(iou), 12) AS miou, count(*) AS classes_present FROM {_iou('cm')} WHERE class_id >= 1 AND gt_points > 0",
    "accuracy": CM + " SELECT sum(CASE WHEN gt = pred THEN n ELSE 0 END)::DOUBLE / sum(n)::DOUBLE AS accuracy, sum(n)::BIGINT AS points FROM cm",
    "accuracy_by_band": CM + """, b AS (SELECT CASE WHEN r >= 60 THEN 3 WHEN r >= 30 THEN 2 WHEN r >= 10 THEN 1 ELSE 0 END AS band, gt, pred FROM (SELECT sqrt(x * x + y * y) AS r, gt, pred FROM pc WHERE gt > 0)),
      bc AS (SELECT band, gt, pred, count(*) AS n FROM b GROUP BY ALL)
      SELECT band, sum(CASE WHEN gt = pred THEN n ELSE 0 END)::DOUBLE / sum(n)::DOUBLE AS accuracy, sum(n)::BIGINT AS points, any_value(m.miou) AS miou, any_value(m.k) AS classes_present FROM bc
      JOIN (SELECT band, round(avg(iou), 12) AS miou, count(*) AS k FROM """ + _iou("bc", "band") + " WHERE class_id >= 1 AND gt_points > 0 GROUP BY band) m USING (band) GROUP BY band",
    "frame_accuracy": CM + FACC + " SELECT * FROM fa",
    "variant_accuracy": CM + """, vc AS (SELECT variant, gt, pred, count(*) AS n FROM pv WHERE gt > 0 GROUP BY ALL)
      SELECT variant, sum(CASE WHEN gt = pred THEN n ELSE 0 END)::DOUBLE / sum(n)::DOUBLE AS accuracy, sum(n)::BIGINT AS points, any_value(m.miou) AS miou, any_value(m.k) AS classes_present FROM vc
      JOIN (SELECT variant, round(avg(iou), 12) AS miou, count(*) AS k FROM """ + _iou("vc", "variant") + " WHERE class_id >= 1 AND gt_points > 0 GROUP BY variant) m USING (variant) GROUP BY variant",
    "grid_accuracy_rollup": LOOKED + EVAL + """ SELECT level, count(*) AS cells, count(*) FILTER (correct) AS correct, round(sum(resolution * resolution), 9) AS area, round(coalesce(sum(resolution * resolution) FILTER (correct), 0), 9) AS area_correct,
      count(*) FILTER (correct) / count(*)::DOUBLE AS by_cell, round(coalesce(sum(resolution * resolution) FILTER (correct), 0) / sum(resolution * resolution), 9) AS by_area FROM ec GROUP BY ROLLUP (level)""",
    "grid_frame_accuracy": LOOKED + EVAL + " SELECT frame_no, count(*) AS cells, count(*) FILTER (correct) / count(*)::DOUBLE AS accuracy FROM ec GROUP BY 1",
    "obstacle_safety": LOOKED + """ SELECT frame_no, count(*) FILTER (o) AS obs, count(*) FILTER (o AND NOT b) AS obs_missed, count(*) FILTER (d) AS dyn, count(*) FILTER (d AND NOT b) AS dyn_missed, count(*) FILTER (v) AS drv, count(*) FILTER (v AND b) AS drv_blocked
      FROM (SELECT frame_no, gt IN (1, 2, 3, 4, 5, 6, 7, 8, 13, 14, 16, 18, 19) AS o, gt BETWEEN 1 AND 8 AS d, gt IN (9, 10) AS v, coalesce(c_trav < 0.5e0, false) AS b FROM lk) GROUP BY 1""",
    "stage_totals": TIMES + "SELECT frame_no, seg_total, grid_engine_total, end_to_end FROM t",
    "latency_summary": TIMES + " UNION ALL ".join(_STAGE.format(c=c) for c in ["upload", "project", "model", "post", "seg_total", "grid_gpu", "grid_to_cpu", "grid_engine_total", "end_to_end"]),
    "real_time_summary": TIMES + """SELECT avg((end_to_end < 100)::INTEGER::DOUBLE) AS pct_within_100ms, avg((grid_engine_total < 30)::INTEGER::DOUBLE) AS pct_grid_within_30ms,
      round(quantile_cont(end_to_end, 0.99e0), 6) AS e2e_p99_ms, max(end_to_end) AS e2e_max_ms, round(quantile_cont(grid_engine_total, 0.99e0), 6) AS grid_p99_ms, max(grid_engine_total) AS grid_max_ms,
      (SELECT frame FROM t ORDER BY end_to_end DESC, frame_no LIMIT 1) AS slowest_frame, round(stddev_samp(end_to_end), 6) AS e2e_std_ms, round(stddev_samp(grid_engine_total), 6) AS grid_std_ms,
      (SELECT vram_mb FROM t ORDER BY frame_no LIMIT 1) AS vram_first_mb, (SELECT vram_mb FROM t ORDER BY frame_no DESC LIMIT 1) AS vram_last_mb, max(vram_mb) AS vram_max_mb FROM t""",
    "record_frames": CM + FACC + """, r AS (SELECT 'highest_accuracy' AS record, frame_no, accuracy AS value FROM fa UNION ALL SELECT 'highest_car_iou', frame_no, car_iou FROM fa WHERE gt_car_points >= 50 UNION ALL SELECT 'highest_person_iou', frame_no, person_iou FROM fa WHERE gt_person_points >= 20)
      SELECT record, frame_no, value FROM r WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY record ORDER BY value DESC, frame_no) = 1""",
    "fastest_frame": TIMES + "SELECT frame, end_to_end AS end_to_end_ms, seg_total AS seg_ms, grid_engine_total AS grid_ms FROM t ORDER BY end_to_end, frame_no LIMIT 1",
    "stress_test": CM + " SELECT 'ground truth' AS source, frame_no, count(*) FILTER (gt = 1) AS car_points, count(*) FILTER (gt = 6) AS person_points FROM pc GROUP BY frame_no ORDER BY car_points + person_points DESC, frame_no LIMIT 1",
    "throughput": TIMES.rstrip() + """, r AS (SELECT event_id * 3 / 64e0 AS ti, value AS watts FROM events), i AS (SELECT event_id * 7 / 32e0 AS s, event_id * 7 / 32e0 + 0.125e0 AS e FROM events),
      w AS (SELECT avg(watts) AS mean_w, max(watts) AS peak_w, count(*) AS k FROM r ASOF JOIN i ON r.ti >= i.s WHERE ti <= e),
      a AS (SELECT count(*) AS frames, sum(n_points)::BIGINT AS points, sum(end_to_end) / 1000 AS seconds, sum(grid_engine_total) / 1000 AS grid_s FROM t)
      SELECT frames, points, seconds, k AS power_readings, peak_w, round(points / seconds, 6) AS points_per_s, round(frames / seconds, 6) AS frames_per_s, round(points / grid_s, 6) AS grid_engine_points_per_s, round(mean_w, 6) AS mean_active_w,
      round(mean_w * seconds / frames, 6) AS joules_per_frame, round(1e0 / (mean_w * seconds / frames), 6) AS frames_per_joule FROM a, w""",
    "power_asof": "WITH r AS (SELECT event_id AS reading, event_id * 3 / 64e0 AS t, value AS watts FROM events), i AS (SELECT event_id AS interval_id, event_id * 7 / 32e0 AS s, event_id * 7 / 32e0 + 0.125e0 AS e FROM events) SELECT reading, t, watts, interval_id AS \"interval\" FROM r ASOF JOIN i ON r.t >= i.s WHERE t <= e",
    "bench_left_accuracy": CM + FACC + " SELECT o_orderkey::INTEGER AS frame_no, accuracy FROM orders LEFT JOIN fa ON o_orderkey = frame_no",
    "pred_class_points": GRID + " SELECT frame_no, sum(CASE WHEN semantic_class = 1 THEN point_count ELSE 0 END)::BIGINT AS pred_car_points, sum(CASE WHEN semantic_class = 6 THEN point_count ELSE 0 END)::BIGINT AS pred_person_points FROM cells GROUP BY 1",
    "drivability_on_road": QUANT + " " + _drive(False),
    "drivability_off_road": QUANT + " " + _drive(True),
    "drivable_area": QUANT + f", d AS ({_drive(False)}), a AS (SELECT frame_no, code, 0.05e0 * (1 << (3 - level)) AS s FROM d), fr AS (SELECT DISTINCT frame_no FROM a) SELECT frame_no, state, round(coalesce((SELECT sum(s * s) FROM a WHERE a.frame_no = fr.frame_no AND a.code = c), 0e0), 9) AS area_m2 FROM fr, (VALUES (0, 'drivable'), (1, 'caution'), (2, 'blocked')) v(c, state)",
    "quantize_cells": QUANT + " SELECT * FROM q",
    "quantize_points": QPOINTS,
    "decode_points": QPOINTS_DECODED,
    "dequantize_cells": QUANT + " SELECT frame_no, level, cls, 0.05e0 * (1 << (3 - level)) AS size, ix * (0.05e0 * (1 << (3 - level))) AS x_min, iy * (0.05e0 * (1 << (3 - level))) AS y_min, z_min_cm / 100e0 AS min_height, z_max_cm / 100e0 AS max_height, z_cm / 100e0 AS elevation, z_std_mm / 1000e0 AS height_std, trav / 255e0 AS traversability, complexity / 255e0 AS terrain_complexity, confidence / 255e0 AS semantic_confidence, n_points FROM q",
    "point_stride": BASE + " SELECT frame_no, seq FROM pts WHERE seq % 4 = 0",
    "preview_filter": GRID + " SELECT frame_no, key, x_min, x_max, y_min, y_max, traversability FROM cells WHERE abs(x_center) < 40 AND abs(y_center) < 40",
    "nearest_per_pixel": PIX + " SELECT frame_no, py, px, owner, depth FROM own",
    "pixel_lookup": PIX + " SELECT frame_no, seq, own.cls AS pixel_cls FROM px LEFT JOIN own USING (frame_no, py, px)",
    "knn_vote": KNN + " SELECT frame_no, seq, label FROM kv",
    "final_confidence": KNN + " SELECT frame_no, seq, label AS cls, ((px * 31 + py * 17 + label * 7) % 97) / 128e0 AS conf FROM kv",
    "project_pixels": BASE + SENSOR_SQL + " SELECT frame_no, seq, px, py FROM pr",
    "range_channels": BASE + SENSOR_SQL + """, o AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY frame_no, py, px ORDER BY depth, seq) = 1)
      SELECT frame_no, py, px, seq AS owner, round((depth - 12.12e0) / 12.32e0, 9) AS ch_depth, (x - 10.88e0) / 11.47e0 AS ch_x, (y - 0.23e0) / 6.91e0 AS ch_y, (z - -1.04e0) / 0.86e0 AS ch_z, (remission - 0.21e0) / 0.16e0 AS ch_remission FROM o""",
    "row_normalized_confusion": CM + " SELECT gt, pred, n / greatest(sum(n) OVER (PARTITION BY gt), 1)::DOUBLE AS share FROM cm",
    "latency_histogram": TIMES + ", b AS (SELECT min(end_to_end) AS lo, max(end_to_end) AS hi FROM t) SELECT least(floor((end_to_end - lo) / ((hi - lo) / 50)), 49)::INTEGER AS bin, count(*) AS n FROM t, b GROUP BY 1",
    "class_table": "SELECT * FROM (VALUES " + ", ".join(f"({c[0]}, '{c[1]}', '{c[2]}', {c[3]}, {c[4]:.2f}e0)" for c in CLASSES) + ") v(class_id, name, color, priority, traversability)",
    "labeled_upload": BASE + " SELECT frame_no, seq, x, y, z, cls, 1e0 AS conf FROM pts",
    "clip_summary": CM + FACC + ", " + TIMES.removeprefix("WITH ") + "SELECT round(quantile_cont(grid_engine_total, 0.5e0), 6) AS median_grid_ms, round(quantile_cont(end_to_end, 0.5e0), 6) AS median_e2e_ms, count(*) AS frames, (SELECT round(avg(accuracy), 9) FROM fa) AS mean_accuracy FROM t",
    "frame_levels": GRID + " SELECT frame_no, count(*) AS n_cells, sum(point_count)::BIGINT AS n_points, min(level) AS min_level, max(level) AS max_level FROM cells GROUP BY 1",
    "frame_header": GRID + VARIANTS + FACC + """, a AS (SELECT frame_no, count(*) AS np, count(*) FILTER (cls <> 0) AS nu FROM pts GROUP BY 1), b AS (SELECT frame_no, count(*) FILTER (is_split) AS ns FROM s1 GROUP BY 1), c AS (SELECT frame_no, count(*) AS nc, count(*) FILTER (is_merged) AS nm FROM st GROUP BY 1)
      SELECT frame_no, 'LGF1' AS format, 1 AS version, printf('%06d', frame_no) AS frame_id, np AS n_points_total, 1 AS point_stride, nc AS n_cells, 1.73e0 AS sensor_height_m, 0.4e0 AS level_0_m, 0.05e0 AS level_3_m, 'mm' AS z_std_unit,
      nu AS n_points_used, ns AS n_splits, nm AS n_merges, round(fa.accuracy, 12) AS accuracy FROM a JOIN b USING (frame_no) JOIN c USING (frame_no) LEFT JOIN fa USING (frame_no)""",
    "decode_cells": QUANT + " SELECT * FROM q",
    "manifest_frames": GRID + VARIANTS + FACC + """, a AS (SELECT frame_no, count(*) AS np FROM pts GROUP BY 1), c AS (SELECT frame_no, count(*) AS nc, count(*) FILTER (is_merged) AS nm FROM st GROUP BY 1)
      SELECT (row_number() OVER (ORDER BY frame_no) - 1)::INTEGER AS "index", printf('%06d', frame_no) AS id, 'lite/' || printf('%06d', frame_no) || '.lgf.gz' AS lite, 'full/' || printf('%06d', frame_no) || '.lgf.gz' AS "full", np AS n_points, nc AS n_cells, nm AS n_merges, round(fa.accuracy, 12) AS accuracy
      FROM a JOIN c USING (frame_no) LEFT JOIN fa USING (frame_no)""",
    "label_paths": "WITH n AS (SELECT DISTINCT event_id % 50 AS n FROM events) SELECT printf('%06d', n) AS frame_id, '/scans/' || printf('%06d', n) || '.bin' AS path, CASE WHEN n % 3 <> 0 THEN '/labels/' || printf('%06d', n) || '.label' END AS label_path FROM n",
    "gt_optional": BASE + " SELECT frame_no, seq, cls, CASE WHEN frame_no <> 3 THEN gt END AS gt FROM pts",
    "frame_round_trip": GRID + " SELECT frame_no, n_points, n_cells FROM (SELECT frame_no, count(*) AS n_cells FROM cells GROUP BY 1) JOIN (SELECT frame_no, count(*) AS n_points FROM pts GROUP BY 1) USING (frame_no)",
    "grid_micro_batch": GRID + " SELECT frame_no, level, count(*) AS n, sum(point_count) AS points FROM cells GROUP BY ALL",
    "iou_chart": CM + f", nm AS {_names()} SELECT name, iou, printf('%.1f', iou * 100) AS label FROM {_iou('cm')} JOIN nm USING (class_id) WHERE class_id > 0 AND gt_points > 0",
    "chart_rows": CM + ", r AS (SELECT gt, pred, n / greatest(sum(n) OVER (PARTITION BY gt), 1)::DOUBLE AS share FROM cm) SELECT gt, pred, round(share * 100, 6) AS percent FROM r WHERE gt <> 5 AND pred <> 5 AND share >= 0.01e0",
    "class_summary": CM + f", nm AS {_names()} SELECT name, CASE WHEN gt_points > 0 THEN iou END AS iou, gt_points, CASE WHEN gt_points = 0 AND pred_points > 0 THEN pred_points END AS absent_predicted FROM {_iou('cm')} JOIN nm USING (class_id) WHERE class_id > 0",
    "eval_frames": LOOKED + EVAL + VARIANTS + FACC + " SELECT fa.frame_no, fa.accuracy, fa.car_iou, g.a AS grid_cell_accuracy FROM fa LEFT JOIN (SELECT frame_no, count(*) FILTER (correct) / count(*)::DOUBLE AS a FROM ec GROUP BY 1) g USING (frame_no)",
    "segment_offsets": GRID + ' SELECT frame_no, key, row_number() OVER w - 1 AS segment, (sum(point_count) OVER w - point_count)::BIGINT AS "offset" FROM cells WINDOW w AS (PARTITION BY frame_no ORDER BY key)',
    "size_labels": GRID + " SELECT (5 * (1 << (3 - level)))::VARCHAR || ' cm' AS size, count(*) AS n FROM cells GROUP BY 1",
    "typed_cells": GRID + " SELECT frame_no, key, level, semantic_class, semantic_priority, point_count FROM cells",
    "dense_confusion": CM + " SELECT gt, " + ", ".join(f"coalesce(sum(n) FILTER (pred = {k}), 0)::BIGINT AS p{k}" for k in range(20)) + " FROM cm GROUP BY gt",
    "class_table_json": "SELECT class_id, CAST(json_object('id', class_id, 'name', name, 'color', color, 'priority', priority, 'traversability', traversability) AS VARCHAR) AS json FROM (SELECT * FROM (VALUES " + ", ".join(f"({c[0]}, '{c[1]}', '{c[2]}', {c[3]}, {c[4]:.2f}e0)" for c in CLASSES) + ") v(class_id, name, color, priority, traversability))",
    "bookmarks": CM + FACC + ", " + TIMES.removeprefix("WITH ").rstrip() + """, f AS (SELECT fa.*, t.end_to_end FROM fa LEFT JOIN t ON fa.frame_no = t.frame_no),
      r AS (SELECT 'Highest overall accuracy' AS label, frame_no, accuracy AS value, 1 AS way FROM f UNION ALL SELECT 'Highest car IoU', frame_no, car_iou, 1 FROM f WHERE gt_car_points >= 50 UNION ALL SELECT 'Highest person IoU', frame_no, person_iou, 1 FROM f WHERE gt_person_points >= 20
        UNION ALL SELECT 'Stress test (most car + pedestrian points)', frame_no, (gt_car_points + gt_person_points)::DOUBLE, 1 FROM f UNION ALL SELECT 'Fastest end to end (ms)', frame_no, end_to_end, -1 FROM f UNION ALL SELECT 'Slowest end to end (ms)', frame_no, end_to_end, 1 FROM f)
      SELECT label, printf('%06d', frame_no) AS frame, frame_no AS "index", value FROM r WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY label ORDER BY value * way DESC, frame_no) = 1""",
}
