"""Operator 9: embedding near-dedup by collision-counting projections.

Every vector is normalised and projected on ``PROJECTIONS`` random lines. On
each line a block's rows are sorted, and a query's window holds the rows within
``WIDTH`` of it. A pair collides on a line if one lies in the other's window;
pairs with at least ``COLLISIONS`` collisions are verified by their cosine in
double precision.

Calibration (``calibrated``): vectors of cosine 0.93 are at most 0.374 apart, so
with a window of 0.5 a true pair collides on a line with probability 0.819 at
least, and on 15 of 32 lines with 0.9999985. A pair of unrelated directions
collides on a line with 0.28, and is verified for nothing in 1.6 % of all cases.

Equal vectors of a label form a class first. A label's classes are divided into
blocks and every pair of blocks is a task, so a label with a third of all rows
is spread. Links leave a task as counts per vector and a spanning forest, never as pairs.

Cases: null labels, null or zero vectors and vectors with null or non-finite
components link with nothing; vectors of different length never link; equal
vectors link with each other; a null id links with nothing and is kept; rows
that repeat an id count as vectors of their own; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from stratavox.llm.common import dealt, sorted_groups, table, written
from stratavox.llm.components import components

SIMILAR = 0.93
PROJECTIONS = 32
#: Half a window in distances of a true pair, and the share of true pairs that may be missed.
REACH, MISSED = 1.3365, 2e-6
BLOCK, LEAST_BLOCK, SPREAD = 1024, 96, 12
SEED = 20240229


def lines(dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, PROJECTIONS))


def calibrated(similar: float, projections: int = PROJECTIONS) -> tuple[float, int]:
    """Half a window's width, and the greatest count that misses true pairs no more often than ``MISSED``."""
    width = REACH * max(math.sqrt(max(2 - 2 * similar, 0.0)), 1e-4)
    hit, missed, least = math.erf(REACH / math.sqrt(2)), 0.0, 0
    while True:
        missed += math.comb(projections, least) * hit**least * (1 - hit) ** (projections - least)
        if missed > MISSED:
            return width, least
        least += 1


WIDTH, COLLISIONS = calibrated(SIMILAR)


def collisions(px: np.ndarray, py: np.ndarray, width: float = WIDTH) -> Iterator[np.ndarray]:
    """For every row of px, on how many lines each row of py lies in its window."""
    order = np.argsort(py, axis=0, kind="stable").T.copy()
    low, high = (np.array([np.searchsorted(py[o, j], px[:, j] + shift, side) for j, o in enumerate(order)]).T for shift, side in ((-width, "left"), (width, "right")))
    for a, b in zip(low.tolist(), high.tolist()):
        yield np.bincount(np.concatenate([o[m:n] for o, m, n in zip(order, a, b)]), minlength=len(py))


def block_links(x: np.ndarray, y: np.ndarray, similar: float) -> list[tuple[int, np.ndarray]]:
    """For rows of x the linked rows of y, by collision counts, then cosines."""
    nx, ny = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
    way = lines(x.shape[1])
    px, py = ((x / nx[:, None]) @ way).astype("f4"), ((y / ny[:, None]) @ way).astype("f4")
    width, least = calibrated(similar)
    out = []
    for i, count in enumerate(collisions(px, py, width)):
        k = np.flatnonzero(count >= least)
        cosine = np.einsum("ij,ij->i", np.broadcast_to(x[i], (len(k), x.shape[1])), y[k]) / (nx[i] * ny[k])
        k = k[cosine >= similar]
        if len(k):
            out.append((i, k))
    return out


def vector_links(classes: DataFrame, similar: float) -> DataFrame:
    """(a, b, n): counts (b null) of a's linked vectors, and links of a forest (n 0)."""
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("m"))
    rows = classes.join(sizes, ["label", "dim"])
    blocks = F.when(F.col("m") <= LEAST_BLOCK, F.lit(1)).otherwise(F.greatest(F.lit(2), F.ceil(F.col("m") / BLOCK), F.least(F.lit(SPREAD), F.ceil(F.col("m") / LEAST_BLOCK)))).cast("int")
    rows = rows.withColumn("k", blocks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("k") - 1), lambda j: (j != F.col("own")) | (F.col("k") == 1))
    rows = rows.withColumn("other", F.explode(others)).withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")})

    def link(batches):
        for g in sorted_groups(batches, ["label", "dim", "x", "y"]):
            ids, copies, own = (g.column(c).to_numpy() for c in ("id", "copies", "own"))
            x, y, k = (int(g.column(c)[0].as_py()) for c in ("x", "y", "k"))
            v = np.array(g.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(ids), -1)
            label, count, forest = np.arange(len(ids)), np.zeros(len(ids), np.int64), []
            first, second = np.flatnonzero(own == x), np.flatnonzero(own == y)
            # pairs within a block belong to one task: the block's pair with the next, or the last pair
            todo = [(first, first)] * (x == y or y == x + 1) + [(first, second)] * (x != y) + [(second, second)] * (x != y and y == k - 1 and x == y - 1)
            for p, q in todo:
                if not len(p) or not len(q):
                    continue
                for i, found in block_links(v[p], v[q], similar):
                    i, found = p[i], q[found]
                    found = found[found != i]
                    if not len(found):
                        continue
                    count[i] += copies[found].sum()
                    if p is not q:
                        count[found] += copies[i]
                    theirs = label[found]
                    if (theirs != label[i]).any():
                        groups, at = np.unique(theirs, return_index=True)
                        forest += [(int(ids[i]), int(ids[found[j]])) for j, l in zip(at, groups) if l != label[i]]
                        label[np.isin(label, groups)] = label[i]
            has = np.flatnonzero(count)
            a = [*ids[has].tolist(), *(f[0] for f in forest)]
            if a:
                b = [*[None] * len(has), *(f[1] for f in forest)]
                n = [*count[has].tolist(), *[0] * len(forest)]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "n"])

    dealt = rows.select("label", "dim", "x", "y", "k", "own", "id", "copies", "embedding").repartition("label", "dim", "x", "y").sortWithinPartitions("label", "dim", "x", "y", "id")
    return dealt.mapInArrow(link, "a long, b long, n long")


def near_vectors(vectors: DataFrame, similar: float = SIMILAR, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) for every vector."""
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label_"), F.col(vector_col).cast("array<double>").alias("embedding"))
    code = F.xxhash64(F.col("label_").cast("string"))
    finite = ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    fit = F.col("id").isNotNull() & F.col("label_").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda v: v != 0)
    base = base.withColumn("fit", F.coalesce(fit, F.lit(False)))
    usable = base.filter("fit").select("id", code.alias("label"), F.size("embedding").alias("dim"), "embedding")
    grouped = usable.groupBy("label", "dim", "embedding").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    # classes have numbers of their own: ids may repeat, so a least id can be that of several
    classes = written(grouped.select(F.monotonically_increasing_id().alias("id"), "rep", "copies", "label", "dim", "embedding"), "classes")
    links = written(vector_links(classes, similar), "links")
    counts = links.filter("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    found = components(links.filter("b is not null").select("a", "b"))
    found = classes.select("id", "rep").join(found, F.col("id") == F.col("node")).select("node", "component", "rep")
    found = found.join(dealt(found.groupBy("component").agg(F.min("rep").alias("component_id")), "component"), "component").select("node", "component_id")
    marks = classes.join(counts, F.col("id") == F.col("a"), "left").join(found, F.col("id") == F.col("node"), "left")
    marks = marks.select("label", "dim", "embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    members = usable.join(marks, ["label", "dim", "embedding"]).select("id", "n_links", "component_id")
    # rows that link with nothing are added as they are: a join by id would multiply repeated ones
    out = members.unionByName(base.filter("not fit").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").cast(vectors.schema[id_col].dataType).alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
