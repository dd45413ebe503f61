"""Operator 3: quality classifier. Hashed word n-gram logistic regression.

Features are hashed word n-grams, each word taken in two
forms: as it is in lower case (n-grams of one and two words), and as a class of
its shape (letters, capitals, digits, trailing marks, a repeat of the word before
it; one to three words). A document's features
are the mean of its n-grams' indicators, so a score is one sparse dot product,
whatever the length. Weights are trained by follow the regularised leader
(FTRL-proximal, per-coordinate rates, L1 and L2).

Training reads a bounded sample of the labelled rows outside the held-out
fold: ``sample`` rows at most in expectation, chosen by a hash of the id. Only
hashed feature counts of that sample reach the driver. Scoring is a pass over
all rows, without a shuffle.

Cases: a null or empty text has no n-grams and gets the bias' score; labels
that are null or not 0 or 1 are left out; of repeated labels for a document
the largest counts, of repeated documents the least text; with no labelled rows,
or one class only, every score is the prior (0.5 without labels); repeated rows
are scored each; a kept column that is named like a result gives way to it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from stratavox.llm.common import WORD, kept_columns, map_batches, mix64, spread, table

BITS = 18
#: Labelled rows that training uses, in expectation.
SAMPLE = 6000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-6, 1e-6
#: N-gram indicators are means; this scale keeps gradients of usual size.
SCALE = 16.0
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2
#: Seed of the order in which training sees its rows.
SEED = 20240229

_MARKS = "!?.,;:#*$%&|<>"


def shape(word: str) -> str:
    """A word's class: capitals, digits, and the run of marks it ends with."""
    body = word.rstrip(_MARKS)
    tail = word[len(body) :]
    if not body:
        kind = "m"
    elif body.isalpha():
        kind = "u" if len(body) > 1 and body.isupper() else "l" if body.islower() else "c"
    elif any(ch.isdigit() for ch in body):
        kind = "d"
    else:
        kind = "x"
    return kind + tail[:3]


class Features:
    """Hashes texts to arrays of feature indices; words are remembered."""

    LIMIT = 100_000

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.word = np.zeros(0, np.uint64)
        self.form = np.zeros(0, np.uint64)

    def codes(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.LIMIT:
            known.clear()
            self.word, self.form = self.word[:0], self.form[:0]
        fresh = [w for w in dict.fromkeys(words) if w not in known]
        if fresh:
            for w in fresh:
                known[w] = len(known)
            digest = xxhash.xxh3_64_intdigest
            self.word = np.concatenate([self.word, np.array([digest(w.lower().encode("utf-8", "surrogatepass")) for w in fresh], np.uint64)])
            self.form = np.concatenate([self.form, np.array([digest("\x00" + shape(w)) for w in fresh], np.uint64)])
        return np.array([known[w] for w in words], np.int64)

    def __call__(self, text: str | None) -> np.ndarray:
        words = WORD.findall(text or "")
        if not words:
            return np.zeros(0, np.int64)
        at = self.codes(words)
        word, form = self.word[at], self.form[at].copy()
        same = np.zeros(len(at), bool)
        same[1:] = at[1:] == at[:-1]
        form[same] ^= np.uint64(0x5851F42D4C957F2D)
        grams = [word, form]
        for h in (word, form):
            for n in (2, 3):
                if len(h) >= n and not (h is word and n == 3):
                    g = h[: len(h) - n + 1]
                    for k in range(1, n):
                        g = mix64(g) + h[k : len(h) - n + 1 + k]
                    grams.append(g)
        return (mix64(np.concatenate(grams)) >> np.uint64(64 - BITS)).astype(np.int64)


_features: Features | None = None


def features(text: str | None) -> np.ndarray:
    global _features
    if _features is None:
        _features = Features()
    return _features(text)


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")), F.lit(FOLDS)) == HELD_OUT


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias from (indices, values, label) rows, in the given order."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2)
        return np.where(np.abs(zi) <= L1, 0.0, w)

    positives = sum(y for _, _, y in rows)
    if not rows or positives in (0, len(rows)):
        p = 0.5 if not rows else (positives + 1) / (len(rows) + 2)
        return np.zeros(size, np.float32), float(np.log(p / (1 - p)))
    # both classes weigh the same, so the rarer one isn't drowned
    weight = {1: len(rows) / (2 * positives), 0: len(rows) / (2 * (len(rows) - positives))}
    for _ in range(epochs):
        for index, value, y in rows:
            i, x = np.append(index, size), np.append(value.astype(np.float64), 1.0)
            w = weights(z[i], n[i])
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * weight[y] * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(z, n)
    return w[:size].astype(np.float32), float(w[size])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """A model from a bounded hash sample of labelled rows outside the held-out fold."""
    kind = docs.schema[id_col].dataType.simpleString()
    usable = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).cast(kind).alias(id_col), F.col(label_col).cast("int").alias("_y"))
    total = max(usable.count(), 1)
    share = min(1.0, sample / total)
    cut = int(share * (1 << 32))
    chosen = usable.filter(F.pmod(F.xxhash64(id_col), F.lit(1 << 32)) < cut).groupBy(id_col).agg(F.max("_y").alias("_y"))
    # about ``sample`` rows of two numbers: bounded by the parameter, not by the input
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen.select(F.col(id_col).alias("_id"), "_y")), "_id")
    # one text per id, so that ids that repeat don't multiply the sample
    rows = rows.groupBy("_id").agg(F.max("_y").alias("_y"), F.min("_text").alias("_text"))
    order = F.xxhash64(F.lit(SEED), F.col("_id").cast("string"))
    rows = rows.select(order.alias("_order"), F.col("_id").cast("string").alias("_id"), "_y", "_text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        index, value = [], []
        for t in batch.column(3).to_pylist():
            f = features(t)
            i, c = np.unique(f, return_counts=True)
            index.append(i.astype("i4"))
            value.append((SCALE * c / max(len(f), 1)).astype("f4"))
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(index, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], ["at", "id", "y", "i", "v"])

    got = map_batches(rows, run, "at long, id string, y int, i array<int>, v array<float>").toArrow()
    # flat arrays: a few bytes a feature on the driver
    parts = [got.column(c).combine_chunks() for c in range(5)]
    turn, ids, label = parts[0].to_pylist(), parts[1].to_pylist(), parts[2].to_numpy()
    at, index, value = parts[3].offsets.to_numpy(), parts[3].values.to_numpy(), parts[4].values.to_numpy()
    del got, parts
    # by a hash of the id: the same model in every run
    order = sorted(range(len(ids)), key=lambda k: (turn[k], ids[k]))
    return ftrl([(index[at[k] : at[k + 1]], value[at[k] : at[k + 1]], int(label[k])) for k in order])


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(id, kept columns, score double, predicted int) for every row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # 1 MB at any input size
    names = [id_col, *kept_columns(keep, id_col, ["score", "predicted"])]
    source = spread(docs).select(*[F.col(f"`{c}`") for c in names], F.col(text_col).alias("_scored_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]) + ", score double, predicted int"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        w, bias = shared.value
        found = []
        for t in batch.column(len(names)).to_pylist():
            f = features(t)
            found.append(bias + (SCALE * float(w[f].sum(dtype=np.float64)) / len(f) if len(f) else 0.0))
        s = 1 / (1 + np.exp(-np.clip(np.array(found, np.float64), -35, 35)))
        return pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(s), pa.array((s >= THRESHOLD).astype("i4"))], [*names, "score", "predicted"])

    return map_batches(source, run, schema)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
