"""Binary inputs and outputs: scans, labels, and frame files.

A frame file has a magic, the header's length, a JSON header padded to eight
bytes, and typed sections at eight-byte offsets that the header lists; it may be
compressed as a whole. One frame is one file, so it is built in one task; frames
are spread over tasks. Its rows come in batches and are kept only as the bytes of
the sections, so a task holds a small multiple of one file, however many points
a frame has.
"""

from __future__ import annotations

import gzip
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from stratavox.config import LEARNING_MAP
from stratavox.functions.runs import runs

# Fixed values of the frame format.
MAGIC = b"LGF1"
VERSION = 1
ALIGN = 8
LEVEL_SIZES_M = [0.4, 0.2, 0.1, 0.05]
SENSOR_HEIGHT_M = 1.73
UNITS = {"xyz": "cm", "z": "cm", "z_std": "mm", "fractions": "0-255 = 0-1"}
POINT_SECTIONS = {"points.xyz_cm": ("int16", ["x_cm", "y_cm", "z_cm"]), "points.intensity": ("uint8", ["intensity"]), "points.class": ("uint8", ["class"]), "points.confidence": ("uint8", ["confidence"]), "points.gt_class": ("uint8", ["gt_class"])}
CELL_SECTIONS = {"cells.ixy": ("int16", ["ix", "iy"]), "cells.level": ("uint8", ["level"]), "cells.class": ("uint8", ["cls"]), "cells.z_cm": ("int16", ["z_min_cm", "z_max_cm", "z_cm"]), "cells.z_std_mm": ("uint16", ["z_std_mm"]), "cells.traversability": ("uint8", ["trav"]), "cells.complexity": ("uint8", ["complexity"]), "cells.confidence": ("uint8", ["confidence"]), "cells.point_count": ("uint16", ["n_points"])}

MAX_POINTS = 200_000

#: Bytes that are compressed or decompressed at once.
CHUNK = 1 << 20
#: Decoded rows that a task holds at once.
SLICE = 1 << 16


def frame_bytes(header: dict, sections: dict[str, np.ndarray], level: int | None = None) -> bytes:
    """Sections after a header that states their places; gzip at ``level`` if given."""
    arrays = {n: np.ascontiguousarray(a) for n, a in sections.items()}
    for n, a in arrays.items():
        if a.dtype.name not in ("int16", "uint8", "uint16", "float32"):
            raise TypeError(f"section {n}: unsupported type {a.dtype}")

    def lay(size: int) -> tuple[bytes, list[int]]:
        at, places = 8 + size, []
        for a in arrays.values():
            at = -(-at // ALIGN) * ALIGN
            places.append(at)
            at += a.nbytes
        listed = [{"name": n, "dtype": a.dtype.name, "shape": list(a.shape), "offset": o, "bytes": a.nbytes} for (n, a), o in zip(arrays.items(), places)]
        raw = json.dumps({**header, "format": MAGIC.decode(), "version": VERSION, "sections": listed}, separators=(",", ":")).encode()
        return raw + b" " * (-(8 + len(raw)) % ALIGN), places

    # the header's length decides the offsets, whose digits decide its length
    size = 0
    while True:
        head, places = lay(size)
        if len(head) <= size:
            break
        size = len(head)
    head = head + b" " * (size - len(head))
    out, zipped = [], zlib.compressobj(level, wbits=31) if level is not None else None

    def put(raw: bytes | np.ndarray) -> None:
        for k in range(0, len(raw), CHUNK):
            out.append(zipped.compress(raw[k : k + CHUNK]) if zipped else bytes(raw[k : k + CHUNK]))

    put(MAGIC + struct.pack("<I", len(head)) + head)
    at = 8 + len(head)
    for a, o in zip(arrays.values(), places):
        put(bytes(o - at))
        put(a.reshape(-1).view(np.uint8))
        at = o + a.nbytes
    return b"".join([*out, zipped.flush()] if zipped else out)


def parse_frame(raw: bytes | pa.Buffer) -> tuple[dict, dict[str, np.ndarray]]:
    raw = memoryview(raw).cast("B")
    if raw[:2] == b"\x1f\x8b":
        whole = bytearray()
        with gzip.GzipFile(fileobj=pa.BufferReader(raw)) as f:
            while part := f.read(CHUNK):
                whole += part
        raw = memoryview(whole)
    if raw[:4] != MAGIC:
        raise ValueError("not a frame file")
    (size,) = struct.unpack_from("<I", raw, 4)
    header = json.loads(bytes(raw[8 : 8 + size]))
    return header, {s["name"]: np.frombuffer(raw, s["dtype"], int(np.prod(s["shape"])), s["offset"]).reshape(s["shape"]) for s in header["sections"]}


def frame_header(frame_id: str, n_points_total: int, n_cells: int, stride: int = 1, meta: dict | None = None, extra: dict | None = None) -> dict:
    """Header of a frame file. meta: stats, timing_ms, accuracy; extra: further or other fields."""
    meta = meta or {}
    header = {"frame_id": frame_id, "source": "precomputed", "sequence": None, "n_points_total": n_points_total, "point_stride": max(int(stride), 1), "n_cells": n_cells, "level_sizes_m": LEVEL_SIZES_M, "sensor_height_m": SENSOR_HEIGHT_M, "units": UNITS}
    return header | {"stats": meta.get("stats") or {}, "timing_ms": meta.get("timing_ms") or {}, "device": meta.get("device"), "accuracy": meta.get("accuracy")} | (extra or {})


def encode_kinds(points: DataFrame, cells: DataFrame, strides: dict[str, int], level: int | None = 6, extra: dict | None = None, meta: DataFrame | None = None) -> DataFrame:
    """(frame_no, kind, n_points, n_cells, content): a frame file per frame and kind, from
    quantised points and cells. A kind keeps every ``strides[kind]``-th point.

    meta: (frame_no, meta), a JSON object of stats, timing_ms and accuracy per frame.

    Points by seq, cells by (level, ix, iy) and the description of a frame come to
    one task in this order, in batches; what is kept of them is their sections.
    """
    extra = dict(extra or {})
    here = [{n: (kind, cols) for n, (kind, cols) in spec.items() if all(x in df.columns for x in cols)} for spec, df in ((POINT_SECTIONS, points), (CELL_SECTIONS, cells))]
    named = [[x for _, cols in here[0].values() for x in cols], ["level", "ix", "iy"]]
    named[1] += [x for _, cols in here[1].values() for x in cols if x not in named[1]]
    width = max(map(len, named))

    def rows(df: DataFrame, part: int, names: list[str]) -> DataFrame:
        """Rows of both kinds in columns of the same names: v0 to v11."""
        value = lambda k: F.col(names[k]).cast("int") if k < len(names) else F.lit(None).cast("int")
        return df.select(F.col("frame_no").cast("int").alias("frame_no"), F.lit(part).alias("part"), (F.col("seq").cast("long") if part == 0 else F.lit(None).cast("long")).alias("seq"), (F.col("meta") if part == 2 else F.lit(None).cast("string")).alias("meta"), *[value(k).alias(f"v{k}") for k in range(width)])

    def keep(kept: dict[str, bytearray], batch: pa.RecordBatch, part: int, mask: np.ndarray | None = None) -> int:
        values = {x: batch.column(f"v{k}").fill_null(0).to_numpy() for k, x in enumerate(named[part])}
        values = values if mask is None else {x: v[mask] for x, v in values.items()}
        for name, (kind, cols) in here[part].items():
            kept[name] += np.column_stack([values[x].astype(kind) for x in cols]).tobytes()
        return batch.num_rows if mask is None else int(mask.sum())

    def files(no: int, parts: dict, n: dict, about: str | None) -> Iterator[pa.RecordBatch]:
        for kind, stride in strides.items():
            sections = {}
            for part, kept in ((0, parts[kind]), (1, parts[None])):
                for name, (dtype, cols) in here[part].items():
                    v = np.frombuffer(kept[name], dtype)
                    sections[name] = v.reshape(-1, len(cols)) if len(cols) > 1 else v
            raw = frame_bytes(frame_header(f"{no:06d}", n["all"], n[None], stride, json.loads(about) if about else None, extra), sections, level)
            # the file's bytes as they are: an array made of them would be a copy
            content = pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, len(raw)], np.int32)), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([pa.array([no], pa.int32()), pa.array([kind]), pa.array([n[kind]], pa.int64()), pa.array([n[None]], pa.int64()), content], ["frame_no", "kind", "n_points", "n_cells", "content"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frame = None
        for (no, part), batch in runs(batches, 2):
            if frame is None or frame[0] != no:
                if frame is not None:
                    yield from files(*frame)
                # sections by kind, those of the cells at None
                frame = [no, {k: {n: bytearray() for n in here[k is None]} for k in (*strides, None)}, dict.fromkeys((*strides, None, "all"), 0), None]
            _, parts, n, about = frame
            if part == 0:
                n["all"] += batch.num_rows
                seq = batch.column("seq").to_numpy(zero_copy_only=False)
                for kind, stride in strides.items():
                    n[kind] += keep(parts[kind], batch, 0, seq % max(stride, 1) == 0)
            elif part == 1:
                n[None] += keep(parts[None], batch, 1)
            elif about is None:
                frame[3] = next((m for m in batch.column("meta").to_pylist() if m is not None), None)
        if frame is not None:
            yield from files(*frame)

    whole = rows(points, 0, named[0]).unionByName(rows(cells, 1, named[1]))
    if meta is not None:
        whole = whole.unionByName(rows(meta, 2, []))
    dealt = whole.repartition("frame_no").sortWithinPartitions("frame_no", "part", "seq", *[f"v{k}" for k in range(width)])
    return dealt.mapInArrow(build, "frame_no int, kind string, n_points long, n_cells long, content binary")


def encode_frames(points: DataFrame, cells: DataFrame, level: int | None = 6, extra: dict | None = None, stride: int = 1, meta: DataFrame | None = None) -> DataFrame:
    """(frame_no, content): one frame file per frame."""
    return encode_kinds(points, cells, {"full": stride}, level, extra, meta).select("frame_no", "content")


def _header_json(header: dict) -> str:
    return json.dumps({k: v for k, v in header.items() if k != "sections"}, sort_keys=True)


def decode_frames(frames: DataFrame) -> DataFrame:
    """(frame_no, header, n_points, n_cells) of every frame file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for no, raw in zip(b.column(0).to_pylist(), b.column(1)):
                h, s = parse_frame(raw.as_buffer())
                out.append((no, _header_json(h), len(s["points.class"]), len(s["cells.level"])))
            if out:
                kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(zip(*out), kinds)], ["frame_no", "header", "n_points", "n_cells"])

    return frames.select(F.col("frame_no").cast("int"), "content").mapInArrow(run, "frame_no int, header string, n_points long, n_cells long")


def _decode(frames: DataFrame, spec: dict[str, tuple[str, list[str]]]) -> DataFrame:
    names = [c for _, cols in spec.values() for c in cols]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for no, raw in zip(b.column(0).to_pylist(), b.column(1)):
                _, s = parse_frame(raw.as_buffer())
                found = {}
                for name, (_, cols) in spec.items():
                    for k, c in enumerate(cols):
                        v = s.get(name)
                        found[c] = None if v is None else v[:, k] if len(cols) > 1 else v
                n = max(len(v) for v in found.values() if v is not None)
                if any(len(v) != n for v in found.values() if v is not None):
                    raise ValueError(f"frame {no}: sections of different lengths")
                for i in range(0, n, SLICE):
                    j = min(i + SLICE, n)
                    values = [pa.nulls(j - i, pa.int32()) if v is None else pa.array(v[i:j].astype("int32")) for v in found.values()]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(j - i, no, np.int32)), pa.array(np.arange(i, j, dtype=np.int64)), *values], ["frame_no", "place", *names])

    return frames.select(F.col("frame_no").cast("int"), "content").mapInArrow(run, "frame_no int, place long, " + ", ".join(f"`{c}` int" for c in names))


def decode_cells(frames: DataFrame) -> DataFrame:
    """(frame_no, place, all fields of a quantised cell) of frame files; the rest is ``dequantize_cells``."""
    return _decode(frames, CELL_SECTIONS)


def decode_points(frames: DataFrame) -> DataFrame:
    """(frame_no, place, all fields of a quantised point) of frame files; gt_class is null where a file has none."""
    return _decode(frames, POINT_SECTIONS)


def scan_rows(raw: bytes, layout: str = "raw") -> np.ndarray:
    """float32 rows of a scan: x, y, z, remission (``raw``), or with a class (``labeled``).
    The bytes are bare floats, or a .npy file of a matrix."""
    width = 5 if layout == "labeled" else 4
    if raw[:6] == b"\x93NUMPY":
        v = np.load(io.BytesIO(raw), allow_pickle=False)
        if v.ndim != 2 or v.shape[1] != width or not len(v):
            raise ValueError(f"a scan is a matrix of {width} columns, and not empty")
        return v.astype("<f4")
    if not raw or len(raw) % (4 * width):
        raise ValueError(f"a scan is a whole number of {width} floats, and not empty")
    return np.frombuffer(raw, "<f4").reshape(-1, width)


def label_rows(raw: bytes) -> np.ndarray:
    """Class ids of a label file: the low sixteen bits, mapped; unknown ids are 0."""
    lut = np.zeros(1 << 16, np.int32)
    for k, v in LEARNING_MAP.items():
        lut[k] = v
    return lut[np.frombuffer(raw, "<u4") & 0xFFFF]


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(frame_id, content) of the files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(F.split_part(F.element_at(F.split("path", "/"), -1), F.lit("."), F.lit(1)).alias("frame_id"), "content")


def read_scans(spark: SparkSession, path: str, layout: str = "raw", validate: bool = False, start: int = 0, count: int | None = None, labels: str | None = None) -> DataFrame:
    """points(frame_id, frame_no, seq, x, y, z, remission[, cls, conf][, gt]) of scan files (.bin, .npy).

    Frames below ``start`` are skipped and the first ``count`` are kept before
    any content is decoded. ``validate`` drops non-finite rows and fails on a
    frame without a valid row or with more than 200,000. With ``labels``, a
    folder of label files, scans are left-joined with them file by file, before
    points are decoded: gt is null for frames without a file.
    """
    files = _files(spark, path, "*.{bin,npy}")
    files = files.withColumn("frame_no", F.col("frame_id").cast("int")).filter(F.col("frame_no") >= start)
    if count is not None:
        files = files.join(files.select("frame_id").orderBy("frame_id").limit(count), "frame_id", "left_semi")
    if labels is not None:
        files = files.join(_files(spark, labels, "*.label").withColumnRenamed("content", "label"), "frame_id", "left")
    else:
        files = files.withColumn("label", F.lit(None).cast("binary"))
    labeled = layout == "labeled"
    extra = (", cls int, conf float" if labeled else "") + (", gt int" if labels is not None else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, no, raw, label in zip(b.frame_id, b.frame_no, b.content, b.label):
                v = scan_rows(bytes(raw), layout)
                keep = np.isfinite(v).all(axis=1) if validate else np.ones(len(v), bool)
                if validate and not 0 < keep.sum() <= MAX_POINTS:
                    raise ValueError(f"frame {name}: {int(keep.sum())} valid points")
                seq, n = np.flatnonzero(keep), len(v)
                v = v[keep]
                out = pd.DataFrame({"frame_id": name, "frame_no": np.int32(no), "seq": seq, "x": v[:, 0], "y": v[:, 1], "z": v[:, 2], "remission": v[:, 3]})
                if labeled:
                    out["cls"], out["conf"] = v[:, 4].astype("i4"), np.float32(1.0)
                if labels is not None:
                    gt = label_rows(bytes(label)) if label is not None else None
                    if gt is not None and len(gt) != n:
                        raise ValueError(f"frame {name}: {n} points and {len(gt)} labels")
                    out["gt"] = pd.Series([None] * len(seq), dtype="Int32") if gt is None else gt[seq]
                yield out

    return files.select("frame_id", "frame_no", "content", "label").mapInPandas(run, f"frame_id string, frame_no int, seq long, x float, y float, z float, remission float{extra}")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(frame_id, seq, cls) of label files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, raw in zip(b.frame_id, b.content):
                v = label_rows(bytes(raw))
                yield pd.DataFrame({"frame_id": name, "seq": np.arange(len(v)), "cls": v})

    return _files(spark, path, "*.label").mapInPandas(run, "frame_id string, seq long, cls int")


def label_paths(scans: DataFrame, labels: DataFrame) -> DataFrame:
    """(frame_id, path, label_path): scans of (frame_id, path) with their label file, null if there is none."""
    return scans.select("frame_id", "path").join(labels.select("frame_id", F.col("path").alias("label_path")), "frame_id", "left")


def store(path: str):
    """(file system, path) of a folder: any store that Arrow knows by its address, or a local folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _FramePartition(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _FrameReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]

    def partitions(self) -> list[_FramePartition]:
        from pyarrow import fs

        where, path = store(self.path)
        return [_FramePartition(f.path) for f in sorted(where.get_file_info(fs.FileSelector(path)), key=lambda f: f.path) if ".lgf" in f.base_name]

    def read(self, partition: _FramePartition) -> Iterator[tuple]:
        where, _ = store(self.path)
        with where.open_input_stream(partition.path, compression=None) as f:
            raw = f.read()
        header, s = parse_frame(raw)
        yield header["frame_id"], _header_json(header), len(s["points.class"]), len(s["cells.level"]), raw


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class _FrameWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.suffix, self.overwrite = options["path"], options.get("suffix", ".lgf"), overwrite

    def write(self, rows: Iterator) -> _Written:
        where, path = store(self.path)
        where.create_dir(path, recursive=True)
        names = []
        for r in rows:
            name = f"{int(r['frame_no']):06d}{self.suffix}"
            # a task that runs again replaces the whole file at once
            part = f"{path}/_{uuid.uuid4().hex}.tmp"
            with where.open_output_stream(part, compression=None) as f:
                f.write(bytes(r["content"]))
            where.move(part, f"{path}/{name}")
            names.append(name)
        return _Written(names)

    def commit(self, messages: list) -> None:
        """With ``overwrite``, frames that aren't of this write go once all of it is there."""
        from pyarrow import fs

        if self.overwrite:
            own = {n for m in messages if m is not None for n in m.names}
            where, path = store(self.path)
            for f in where.get_file_info(fs.FileSelector(path, allow_not_found=True)):
                if ".lgf" in f.base_name and f.base_name not in own:
                    where.delete_file(f.path)


class FrameFiles(DataSource):
    """Format ``frame_files``: a folder of frame files, by an address that Arrow knows
    (file, hdfs, s3, gs) or a path that all machines mount."""

    @classmethod
    def name(cls) -> str:
        return "frame_files"

    def schema(self) -> str:
        return "frame_id string, header string, n_points long, n_cells long, content binary"

    def reader(self, schema) -> _FrameReader:
        return _FrameReader(self.options)

    def writer(self, schema, overwrite: bool) -> _FrameWriter:
        return _FrameWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FrameFiles)


def read_frame_files(spark: SparkSession, path: str) -> DataFrame:
    """(frame_no, content) of frame files in any store that Spark reads."""
    return _files(spark, path, "*.lgf*").select(F.col("frame_id").cast("int").alias("frame_no"), "content")


def frame_meta(stats: DataFrame, timings: DataFrame | None = None, accuracy: DataFrame | None = None) -> DataFrame:
    """(frame_no, meta): the JSON that a frame's header carries, from per-frame tables."""
    rows = stats.select("frame_no", F.struct(*[c for c in stats.columns if c != "frame_no"]).alias("stats"))
    for name, t in (("timing_ms", timings), ("accuracy", accuracy)):
        if t is not None:
            rows = rows.join(t.select("frame_no", F.struct(*[c for c in t.columns if c != "frame_no"]).alias(name)), "frame_no", "left")
    return rows.select("frame_no", F.to_json(F.struct(*rows.columns[1:])).alias("meta"))


def export_clip(points: DataFrame, cells: DataFrame, path: str, stride: int = 4, sequence: str | None = None, meta: DataFrame | None = None, device: str | None = None) -> DataFrame:
    """Frame files lite/<id>.lgf.gz (every ``stride``-th point) and full/<id>.lgf.gz below
    ``path``; returns the manifest's frames. points and cells are quantised ones.

    Frames are encoded once, to a table beside the files, from which both are written.
    """
    spark = points.sparkSession
    extra = {"sequence": sequence, "device": device}
    encode_kinds(points, cells, {"lite": stride, "full": 1}, extra=extra, meta=meta).write.mode("overwrite").parquet(f"{path}/_frames")
    stored = spark.read.parquet(f"{path}/_frames")
    register(spark)
    for kind in ("lite", "full"):
        stored.filter(F.col("kind") == kind).write.format("frame_files").option("suffix", ".lgf.gz").mode("overwrite").save(f"{path}/{kind}")
    per = stored.groupBy("frame_no").agg(*[F.max(F.when(F.col("kind") == k, F.octet_length("content"))).cast("long").alias(f"{k}_bytes") for k in ("lite", "full")], F.max("n_points").alias("n_points"), F.max("n_cells").alias("n_cells"))
    return manifest_frames(per, meta)


def manifest_frames(frames: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """(index, id, lite, full, [sizes], n_points, n_cells, meta) of a clip's frames.

    A clip's frames are one manifest, so they may be numbered in one task.
    """
    if meta is not None:
        frames = frames.join(meta, "frame_no", "left")
    else:
        frames = frames.withColumn("meta", F.lit(None).cast("string"))
    name = F.format_string("%06d", F.col("frame_no"))
    path = lambda kind: F.concat(F.lit(f"{kind}/"), name, F.lit(".lgf.gz")).alias(kind)
    sizes = [c for c in ("lite_bytes", "full_bytes") if c in frames.columns]
    return frames.select((F.row_number().over(Window.orderBy("frame_no")) - 1).alias("index"), name.alias("id"), path("lite"), path("full"), *sizes, "n_points", "n_cells", "meta")


def manifest_json(frames: DataFrame, classes: DataFrame, bookmarks: DataFrame, summary: DataFrame, sequence: str | None = None, stride: int = 4, fps: int = 10) -> str:
    """The manifest of a clip. It lists every frame of one clip, so it is built on the driver."""
    def rows(df: DataFrame, order: str) -> list[dict]:
        return [r.asDict(recursive=True) for r in df.orderBy(order).toLocalIterator()]

    listed = []
    for f in rows(frames, "index"):
        meta = json.loads(f.pop("meta") or "{}")
        listed.append(f | {"timing_ms": meta.get("timing_ms") or {}, "stats": meta.get("stats") or {}, "accuracy": meta.get("accuracy")})
    kinds = [{"id": c["class_id"], "name": c["name"], "color": c["color"], "priority": c["priority"], "traversability": c["traversability"]} for c in rows(classes, "class_id")]
    out = {"format": "LGF1-clip", "version": VERSION, "sequence": sequence, "fps": fps, "frame_count": len(listed), "first_frame": listed[0]["id"] if listed else None, "last_frame": listed[-1]["id"] if listed else None, "lite_point_stride": stride, "sensor_height_m": SENSOR_HEIGHT_M, "level_sizes_m": LEVEL_SIZES_M}
    out |= {"classes": kinds, "bookmarks": [r.asDict() for r in bookmarks.toLocalIterator()], "summary": (summary.first() or {}) and summary.first().asDict(), "frames": listed}
    return json.dumps(out)
