"""Operator 7: substring dedup with a log-structured fingerprint index.

Windows of ``window`` words are sampled by content: of a window's word grams
the one of least hash stands for it (its minimiser), so equal windows always
have equal fingerprints at the same place, and about one gram in a dozen is
kept. The index holds sorted immutable runs with one row per fingerprint, and
beside them the postings (fingerprint, document, place). A new batch's
fingerprints are sorted into a run of their own, merge-joined with the runs of
history, and compacted with runs of like size, so the number of runs stays
logarithmic in the number of batches. Fingerprints met before are verified on
the windows themselves: on two hashes of each window's words, 96 bits together,
independent of each other from the words on.

A window that also starts anywhere else goes, in all its places, so a batch
may mark words of earlier batches; ``marks`` reads the index once all batches
are in.

Occurrences with equal surroundings (all words of the row's windows), as copies
have, repeat each other without a further look; only one per distinct
surrounding is compared window by window. A passage that a third of all
documents share is one row of a run; its postings meet the repeated
fingerprints in joins that adaptive execution can split.

Cases: null texts have no words; texts shorter than a window keep all words; a
text may repeat itself; rows with one id and one text are one document, rows
with one id and other texts are documents of their own; rows with a null id
keep all words; other columns pass, but one named like a result gives way to it.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from stratavox.llm.common import WORD, dealt, kept_columns, map_batches, mix64, range_hashes, shared_dir, table, tagged, window_hashes, word_hashes, written

WINDOW = 35
#: Words of a gram whose hash picks a window's place in the index.
GRAM = 10
BATCHES = 3
#: Runs of like size that are merged into one.
FAN_IN = 2
_GRAM_BASE, _BASE_1, _BASE_2 = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5


def anchors(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, place, first window, last window) of a document's minimisers.

    The minimiser of a window is its gram of least hash, the last one of
    equals; consecutive windows with the same one are one row.
    """
    grams = window_hashes(h, gram, _GRAM_BASE)
    span = window - gram + 1
    n = len(grams) - span + 1
    if n <= 0:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty, empty
    value = grams >> np.uint64(1)
    place = np.arange(len(grams))
    # least over a window by doubling; on ties the later place wins
    width = 1
    while width < span:
        step = min(width, span - width)
        a, b = value[:-step], value[step:]
        later = b <= a
        value, place = np.where(later, b, a), np.where(later, place[step:], place[:-step])
        width += step
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.append(first[1:], n) - 1
    at = place[first]
    return grams[at], at, first, last


def within(fp: np.ndarray, around: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, list]:
    """Rows that stand for a document's equal ones, and where those are: ranges [a, b]
    of windows, or None. A word said a thousand times is one row and one range."""
    key = mix64(fp) + around
    _, lead, group, size = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    again: list = [None] * len(lead)
    if len(lead) < len(key):
        order = np.argsort(group, kind="stable")
        ends = np.cumsum(size)
        for g in np.flatnonzero(size > 1).tolist():
            rows = order[ends[g] - size[g] + 1 : ends[g]]
            a, b = first[rows], last[rows]
            cut = np.flatnonzero(a[1:] > b[:-1] + 1)
            again[g] = [{"a": int(x), "b": int(y)} for x, y in zip(a[np.append(0, cut + 1)], b[np.append(cut, len(b) - 1)])]
    return lead, again


def fingerprints(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(fp, around, id, tag, first, last, again) of every document of (id, tag, text);
    ``around`` is the hash of all words of the row's windows, ``again`` the windows
    of the same document that are equal to them."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, tags, found = batch.column(0), batch.column(1), []
        for t in batch.column(2).to_pylist():
            words = WORD.findall(t or "")
            if len(words) < window:
                found.append(None)
                continue
            h = word_hashes(words)
            fp, _, first, last = anchors(h, window, gram)
            around = range_hashes(h, first, last + window, _BASE_1)
            lead, again = within(fp, around, first, last)
            found.append((fp[lead], around[lead], first[lead], last[lead], again))
        row = np.repeat(np.arange(len(found)), [0 if x is None else len(x[0]) for x in found])
        parts = [x for x in found if x is not None]
        cat = lambda k, t: np.concatenate([x[k] for x in parts]) if parts else np.zeros(0, t)
        return pa.RecordBatch.from_arrays(
            [pa.array(cat(0, np.uint64).view("i8")), pa.array(cat(1, np.uint64).view("i8")), ids.take(pa.array(row)), tags.take(pa.array(row)), pa.array(cat(2, np.int64).astype("i4")), pa.array(cat(3, np.int64).astype("i4")), pa.array([r for x in parts for r in x[4]], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))],
            ["fp", "around", "id", "tag", "first", "last", "again"],
        )

    return map_batches(docs.select("id", "tag", "text"), run, "fp long, around long, id long, tag long, first int, last int, again array<struct<a:int,b:int>>")


class FingerprintIndex:
    """Sorted immutable runs in a shared folder, merged as they grow.

    A run is a table of (fp, n, again), one row per fingerprint, in buckets of
    fingerprints, each sorted, so runs meet in merge joins without an exchange.
    Rows are summed before they are dealt, so a fingerprint that every document
    has is no more work than any other. ``append`` adds a batch of documents (id,
    tag, text) and returns the fingerprints that it shares with itself or with
    history; ``repeated`` has all postings whose fingerprint occurs more than once.
    """

    def __init__(self, spark: SparkSession, path: str, window: int = WINDOW, gram: int = GRAM, fan_in: int = FAN_IN) -> None:
        self.spark, self.path, self.window, self.gram, self.fan_in = spark, path, window, gram, fan_in
        #: the exchange of a sum by fingerprint deals rows as the buckets do: one file a bucket
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        #: (level, table) of every live run, oldest first.
        self.runs: list[tuple[int, str]] = []
        self.postings: list[DataFrame] = []
        self.hits: list[DataFrame] = []

    def _write_run(self, rows: DataFrame, level: int) -> DataFrame:
        name = f"stratavox_run_{uuid.uuid4().hex}"
        summed = rows.groupBy("fp").agg(F.sum("n").alias("n"), F.max("again").alias("again"))
        summed.write.option("compression", "zstd").option("path", f"{self.path}/{name}").bucketBy(self.buckets, "fp").sortBy("fp").saveAsTable(name)
        self.runs.append((level, name))
        return self.spark.table(name)

    def append(self, docs: DataFrame) -> DataFrame:
        self._compact()
        history = [name for _, name in self.runs]
        self.postings.append(written(fingerprints(docs, self.window, self.gram), "postings"))
        own = self._write_run(self.postings[-1].select("fp", F.lit(1).cast("long").alias("n"), F.col("again").isNotNull().alias("again")), 0)
        hits = own.filter("n > 1 or again").select("fp")
        for name in history:
            hits = hits.unionByName(own.select("fp").hint("merge").join(self.spark.table(name).select("fp"), "fp"))
        self.hits.append(written(hits.distinct(), "hits"))
        return self.hits[-1]

    def _compact(self) -> None:
        """Merges ``fan_in`` runs of a level into one of the next, before the next batch
        comes. All hits so far are written out, so replaced runs can go."""
        level = 0
        while any(r[0] >= level for r in self.runs):
            same = [r for r in self.runs if r[0] == level]
            if len(same) >= self.fan_in:
                merged = self.spark.table(same[0][1])
                for _, name in same[1:]:
                    merged = merged.unionByName(self.spark.table(name))
                self.runs = [r for r in self.runs if r[0] != level]
                self._write_run(merged, level + 1)
                for _, name in same:
                    self._drop(name)
            level += 1

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def close(self) -> None:
        """Takes the runs out of the catalog and their files away."""
        for _, name in self.runs:
            self._drop(name)
        self.runs = []

    def repeated(self) -> DataFrame:
        hits, rows = self.hits[0], self.postings[0]
        for h in self.hits[1:]:
            hits = hits.unionByName(h)
        for p in self.postings[1:]:
            rows = rows.unionByName(p)
        return rows.join(dealt(hits.distinct(), "fp"), "fp")


def _window_rows(candidates: DataFrame, window: int) -> DataFrame:
    """(h1, h2, id, tag, at) of every candidate window of (id, tag, text, spans)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, h1, h2, at = [], [], [], []
        for k, (t, spans) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            words = WORD.findall(t or "")
            h = word_hashes(words)
            on = np.concatenate([np.arange(s["first"], s["last"] + 1) for s in spans])
            row.append(np.full(len(on), k))
            at.append(on)
            h1.append(window_hashes(h, window, _BASE_1)[on])
            h2.append(window_hashes(word_hashes(words, 1), window, _BASE_2)[on] >> np.uint64(32))
        cat = np.concatenate
        row = pa.array(cat(row))
        return pa.RecordBatch.from_arrays([pa.array(cat(h1).view("i8")), pa.array(cat(h2).astype("u4").view("i4")), batch.column(0).take(row), batch.column(1).take(row), pa.array(cat(at).astype("i4"))], ["h1", "h2", "id", "tag", "at"])

    return map_batches(candidates.select("id", "tag", "text", "spans"), run, "h1 long, h2 int, id long, tag long, at int")


def repeated_windows(docs: DataFrame, window: int = WINDOW, batches: int = BATCHES) -> DataFrame:
    """(id, tag, spans): for documents of (id, tag, text) with repeated windows the
    ranges [a, b] of their starts."""
    spark = docs.sparkSession
    index = FingerprintIndex(spark, f"{shared_dir(spark)}/stratavox-index-{uuid.uuid4().hex}", window)
    for b in range(batches):
        index.append(docs.filter(F.pmod(F.xxhash64("id"), F.lit(batches)) == b))
    found = written(index.repeated().select("fp", "around", "id", "tag", "first", "last", "again"), "found")
    index.close()
    # equal surroundings repeat each other in all their windows; one of them is
    # compared with the other surroundings of its fingerprint, window by window.
    # Rows that repeat a document give equal places, and are one document.
    place = F.struct("id", "tag", "first", "last")
    kinds = written(found.groupBy("fp", "around").agg(F.min(place).alias("rep"), (F.max(F.col("again").isNotNull()) | (F.min(place) < F.max(place))).alias("twice")), "kinds")
    plain = found.join(kinds.filter("twice").select("fp", "around"), ["fp", "around"])
    itself = F.array(F.struct(F.col("first").alias("a"), F.col("last").alias("b")))
    plain = plain.select("id", "tag", F.inline(F.when(F.col("again").isNull(), itself).otherwise(F.concat(itself, "again"))))
    mixed = kinds.groupBy("fp").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("fp")
    asked = kinds.join(dealt(mixed, "fp"), "fp").select("rep.*")
    spans = asked.groupBy("id", "tag").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    rows = written(_window_rows(docs.join(spans, ["id", "tag"]), window), "windows")
    at = F.struct("id", "tag", "at")
    many = rows.groupBy("h1", "h2").agg(F.min(at).alias("a"), F.max(at).alias("b")).filter("a < b").select("h1", "h2")
    single = rows.join(dealt(many, "h1", "h2"), ["h1", "h2"]).select("id", "tag", F.col("at").alias("a"), F.col("at").alias("b"))
    return plain.unionByName(single).groupBy("id", "tag").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def substring_dedup(docs: DataFrame, window: int = WINDOW, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, digest: bool = False) -> DataFrame:
    """(id, kept columns, n_words, n_removed, clean_text); with ``digest`` the
    SHA-256 of the kept words, kept_sha256, instead of the text."""
    kept = kept_columns(keep, id_col, ["n_words", "n_removed", "clean_text", "kept_sha256"])
    names = [id_col, *kept]
    # under names of its own, so no kept column meets a working one
    docs = tagged(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_dedup_row"), F.col(id_col), F.col(text_col)), id_col, text_col)
    base = docs.select(F.col("_dedup_id").alias("id"), F.col("_dedup_tag").alias("tag"), F.col("_dedup_text").alias("text")).filter("id is not null")
    marks = repeated_windows(base, window, batches).select(F.col("id").alias("_dedup_id"), F.col("tag").alias("_dedup_tag"), F.col("spans").alias("_dedup_spans"))
    source = docs.join(marks, ["_dedup_id", "_dedup_tag"], "left").select(*[F.col("_dedup_row").getField(c).alias(c) for c in names], "_dedup_text", "_dedup_spans")
    n_kept = len(names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:n_kept]) + ", n_words long, n_removed long, " + ("kept_sha256 string" if digest else "clean_text string")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        total, gone, out = [], [], []
        for t, spans in zip(*(batch.column(n_kept + k).to_pylist() for k in range(2))):
            words = WORD.findall(t or "")
            left = words
            if spans:
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, [s["a"] for s in spans], 1)
                np.add.at(edge, [s["b"] + window for s in spans], -1)
                left = [w for w, c in zip(words, np.cumsum(edge)[:-1].tolist()) if not c]
            total.append(len(words))
            gone.append(len(words) - len(left))
            text = " ".join(left)
            out.append(hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest() if digest else text)
        return pa.RecordBatch.from_arrays([*batch.columns[:n_kept], pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.string())], [*names, "n_words", "n_removed", "kept_sha256" if digest else "clean_text"])

    return map_batches(source, run, schema)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), digest=True)
