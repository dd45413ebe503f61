"""Shared helpers: table access, shared-folder tables, Arrow streaming, words."""

from __future__ import annotations

import re
import uuid
import warnings
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: ASCII white space that separates words; every other code point is part of one.
SPACE = r"\x20\x09-\x0D"
WORD = re.compile(rf"[^{SPACE}]+")
#: Lower-cases A-Z only, whatever the locale or Unicode version.
ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    It is read from the session. Only where it is unset, as in local tests, a
    folder below the warehouse is used and set.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            warnings.warn("spark.checkpoint.dir is unset: tables are written below the warehouse, which all machines must share", stacklevel=2)
        where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stratavox-{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores where it is so small that it may come as one split.

    A larger input has splits enough and isn't touched. By the size that the plan
    states, without a job.
    """
    spark = df.sparkSession
    stated = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return df.repartition(spark.sparkContext.defaultParallelism) if stated <= split else df


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow for a function of one batch, fed in slices of bounded size."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out
        # workers are used again: what this task needed shouldn't add to the next one's
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


#: Rows and bytes that one call of a batch function sees; a longer text comes alone.
SLICE, SLICE_BYTES = 1000, 16 << 20


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of bounded rows and bytes."""
    if batch.num_rows > 1 and (batch.num_rows > SLICE or batch.nbytes > SLICE_BYTES):
        half = SLICE if batch.num_rows > SLICE else batch.num_rows // 2
        yield from slices(batch.slice(0, half))
        yield from slices(batch.slice(half))
    elif batch.num_rows:
        yield batch


def kept_columns(keep: list[str] | None, id_col: str, results: Iterable[str]) -> list[str]:
    """Columns to pass on. One that is named like a result gives way to it."""
    taken = {id_col.lower(), *(r.lower() for r in results)}
    return [c for c in dict.fromkeys(keep or []) if c.lower() not in taken]


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Aggregated rows, dealt anew. Else the aggregation would be part of the stage of a
    join on the keys, and adaptive execution splits no such join where a key is hot."""
    return rows.repartition(F.xxhash64(*keys))


def repeated_ids(docs: DataFrame, id_col: str) -> DataFrame:
    """The ids (_dedup_id) that more than one row has; written, so its size is known."""
    ids = docs.select(F.col(id_col).cast("long").alias("_dedup_id")).filter("_dedup_id is not null")
    again = ids.groupBy("_dedup_id").agg(F.count("*").alias("n")).filter("n > 1")
    return written(again.select("_dedup_id", F.lit(True).alias("_dedup_again")), "repeated-ids")


def tagged(docs: DataFrame, id_col: str, text_col: str, again: DataFrame | None = None) -> DataFrame:
    """docs with _dedup_id, _dedup_tag and _dedup_text: id and tag tell documents apart.

    The tag is 0 where an id occurs once, and a hash of the text where it occurs
    again: rows with one id and equal texts are one document, rows with one id and
    other texts are others. The repeated ids are a table of known size, so where
    there are few the texts aren't shuffled for them.
    """
    again = repeated_ids(docs, id_col) if again is None else again
    base = spread(docs).withColumns({"_dedup_id": F.col(id_col).cast("long"), "_dedup_text": F.col(text_col)})
    tag = F.when(F.col("_dedup_again"), F.xxhash64("_dedup_text")).otherwise(F.lit(0).cast("long"))
    return base.join(again, "_dedup_id", "left").withColumn("_dedup_tag", tag).drop("_dedup_again")


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys in a stream sorted by them, each as one table."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [np.asarray(batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False)) for k in keys]
        change = np.zeros(n, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change)
        first = tuple(c[0] for c in cols)
        cuts = [0, *starts.tolist(), n]
        if last is not None and first != last and held:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


#: Rows that a block has at least, where a large group is divided to spread it.
LEAST_BLOCK = 64


def in_blocks(rows: DataFrame, size: str, id_col: str, block: int, spread_from: int, spread: int) -> DataFrame:
    """Copies of each row for every pair (x, y) of blocks of its group that needs it.

    A group of up to ``spread_from`` rows is one pair (0, 0). A larger one has
    enough blocks that each holds ``block`` rows on average at most, and ``spread``
    of them if they don't get too small.
    """
    blocks = F.when(F.col(size) <= spread_from, F.lit(1)).otherwise(F.greatest(F.lit(2), F.ceil(F.col(size) / block), F.least(F.lit(spread), F.ceil(F.col(size) / LEAST_BLOCK)))).cast("int")
    rows = rows.withColumn("_n", blocks).withColumn("_b", F.pmod(F.xxhash64(id_col), F.col("_n")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("_n") - 1), lambda j: (j != F.col("_b")) | (F.col("_n") == 1))
    rows = rows.withColumn("_o", F.explode(others))
    return rows.withColumns({"x": F.least("_b", "_o"), "y": F.greatest("_b", "_o")}).drop("_n", "_b", "_o")


class WordHash:
    """Deterministic 64-bit hash of words with a bounded per-worker memory."""

    LIMIT = 120_000

    def __init__(self, seed: int = 0) -> None:
        import functools

        import xxhash

        self._hash = functools.partial(xxhash.xxh3_64_intdigest, seed=seed) if seed else xxhash.xxh3_64_intdigest
        self._seen: dict[str, int] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        seen = self._seen
        try:
            return np.array([seen[w] for w in words], np.uint64)
        except KeyError:
            pass
        if len(seen) > self.LIMIT:
            seen.clear()
        digest = self._hash
        for w in set(words).difference(seen):
            seen[w] = digest(w.encode("utf-8", "surrogatepass"))
        return np.array([seen[w] for w in words], np.uint64)


_word_hash: dict[int, WordHash] = {}


def word_hashes(words: list[str], seed: int = 0) -> np.ndarray:
    """Hashes of words; other seeds give independent ones."""
    if seed not in _word_hash:
        _word_hash[seed] = WordHash(seed)
    return _word_hash[seed](words)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers (mod 2**64) of an odd base, and of its inverse."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 14)
        have = []
        for value in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, value, np.uint64)
            p[0] = 1
            have.append(np.cumprod(p, dtype=np.uint64))
        if size <= 1 << 22:
            _powers[base] = tuple(have)
    return have[0][:n], have[1][:n]


def prefix_sums(h: np.ndarray, base: int) -> np.ndarray:
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(base, len(h))[0], dtype=np.uint64, out=total[1:])
    return total


def window_hashes(h: np.ndarray, size: int, base: int) -> np.ndarray:
    """Polynomial hash (mod 2**64, then mixed) of every window of ``size`` items."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = prefix_sums(h, base)
    return mix64((total[size:] - total[:n]) * powers(base, n)[1])


def range_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """The same for ranges of any length; the length is part of the hash."""
    total = prefix_sums(h, base)
    return mix64((total[end] - total[start]) * powers(base, len(h) + 1)[1][start] + (end - start).astype(np.uint64))
