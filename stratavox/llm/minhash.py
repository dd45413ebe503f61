"""Operator 6: MinHash near-dedup by a signature-coordinate inverted join.

1. Documents with equal shingle sets form a class; its least id stands for it.
2. Every class is posted under the first ``PREFIX`` of its ``COORDINATES``
   coordinate-value pairs. Two sets of similarity s share one of them with
   probability 1 - (1 - s) ** PREFIX (0.9999999 at 0.75), and agree in COORDINATES * s
   coordinates on average.
3. A posting list merges its documents' signatures and counts collisions. A pair
   is skipped if an earlier coordinate posts it too, so it is counted once; after
   the first ``CHECKED`` coordinates it is dropped if the others can't bring it to
   the threshold any more. Pairs of at least ``MATCHES`` matches make a graph, of
   which only a spanning forest of each list is emitted: never all pairs of a list.
4. A component of that graph is a family. Inside it all pairs are compared on
   full shingle sets, by an inverted index in blocks; again only a spanning
   forest of the confirmed links is emitted.
5. Components of the confirmed links give every document's class.

Skew: copies collapse in step 1 by an aggregation that combines before the
shuffle. Long lists and large families are divided into blocks, and every pair
of blocks is a task of its own, so no task holds more than two blocks. What
grows with the square of a group's size is only the counting among *different*
texts that are mutually similar.

Cases: A-Z only is lower-cased; fewer than ``words`` words make one shingle of
all; no words, or a null text, make an empty set that links with nothing; a row
with a null id links with nothing and is kept; repeated rows are in one class;
rows with one id and other texts are documents of their own; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from stratavox.llm.common import ASCII_LOWER, LEAST_BLOCK, WORD, dealt, in_blocks, map_batches, mix64, repeated_ids, sorted_groups, table, tagged, window_hashes, word_hashes, written
from stratavox.llm.components import components

WORDS = 5
SIMILAR = 75  # percent
COORDINATES = 64
PREFIX = 12
#: Coordinates in which signatures must agree; at similarity 0.75 the mean is
#: 48 with deviation 3.5, so a true pair is missed with probability 3e-6.
MATCHES = 32
#: Coordinates of the signature that every pair is counted on; the rest only where it may still be enough.
CHECKED = 40
#: Most rows of a posting list, and most documents of a family, in one block.
LIST_BLOCK, FAMILY_BLOCK = 2048, 1024
#: Large groups are divided at least so far that one of them spreads over tasks.
LIST_SPREAD, FAMILY_SPREAD = 6, 24

_SEEDS = mix64(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BASE = 0x2545F4914F6CDD1D


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    if not text:
        return np.zeros(0, np.uint64)
    found = WORD.findall(text.translate(ASCII_LOWER))
    if not found:
        return np.zeros(0, np.uint64)
    h = word_hashes(found)
    if len(h) < words:
        return mix64(window_hashes(h, len(h), _BASE) + np.uint64(len(h)))
    return np.unique(window_hashes(h, words, _BASE))


def signature(s: np.ndarray) -> np.ndarray:
    """Least values of the set under every coordinate's hash."""
    # the values are well mixed already, so a product by an odd seed will do
    out = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 512):
        np.minimum(out, (s[None, at : at + 512] * _SEEDS[:, None]).min(axis=1), out=out)
    return out


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(id, tag, n, mark, sig) of documents (id, tag, text): a hash of the set; one byte of
    each coordinate, and the posted ones whole."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, mark, sig = [], [], []
        for t in batch.column(2).to_pylist():
            s = shingles(t, words)
            n.append(len(s))
            if len(s):
                v = signature(s)
                a, b = np.bitwise_xor.reduce(mix64(s)), np.add.reduce(mix64(s ^ np.uint64(0xA5A5A5A5)))
                mark.append(np.array([a, b], "<u8").tobytes())
                sig.append((mix64(v) >> np.uint64(56)).astype("u1").tobytes() + v[:PREFIX].astype("<u8").tobytes())
            else:
                mark.append(None)
                sig.append(None)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(mark, pa.binary()), pa.array(sig, pa.binary())], ["id", "tag", "n", "mark", "sig"])

    return map_batches(docs.select("id", "tag", "text"), run, "id long, tag long, n long, mark binary, sig binary")


class _Union:
    """Union-find over rows of a block, as labels; notes the links that joined."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def join(self, i: int, others: np.ndarray) -> None:
        mine = self.label[i]
        theirs = self.label[others]
        fresh = theirs != mine
        if not fresh.any():
            return
        groups, first = np.unique(theirs[fresh], return_index=True)
        rows = others[fresh][first]
        self.links += [(i, int(r)) for r in rows]
        self.label[np.isin(self.label, groups)] = mine


def _forest_of_list(ids: np.ndarray, sig: np.ndarray, code: np.ndarray, coordinate: int) -> list[tuple[int, int]]:
    """Spanning forest of the pairs with enough matches that meet in this list first.

    sig: a byte of every coordinate; code: 24 bits of the posted ones. Equal codes
    of an earlier coordinate mean an earlier list (a wrong skip has probability
    2**-24 a coordinate).
    """
    n = len(ids)
    joined = _Union(n)
    early = code[:, :coordinate]
    for at in range(0, n, 64):
        if (joined.label == joined.label[0]).all():
            break
        met = np.zeros((min(64, n - at), n), bool)
        for c in range(coordinate):
            met |= early[at : at + 64, None, c] == early[None, :, c]
        i, j = np.nonzero(~met)
        later = j > at + i
        i, j = at + i[later], j[later]
        for k in range(0, len(i), 1 << 16):
            p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            count = (sig[p, :CHECKED] == sig[q, :CHECKED]).sum(axis=1)
            may = count + COORDINATES - CHECKED >= MATCHES
            p, q, count = p[may], q[may], count[may]
            enough = count + (sig[p, CHECKED:] == sig[q, CHECKED:]).sum(axis=1) >= MATCHES
            p, q = p[enough], q[enough]
            cut = np.flatnonzero(np.diff(p)) + 1
            for own, others in zip(np.split(p, cut), np.split(q, cut)):
                if len(own):
                    joined.join(int(own[0]), others)
    return [(int(ids[a]), int(ids[b])) for a, b in joined.links]


#: Low bits of a list's key, which tell its coordinate.
KEY_BITS = 4


def posting_links(reps: DataFrame) -> DataFrame:
    """(a, b): a spanning forest, list by list, of pairs with enough matches."""

    def unpacked(signatures: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(b"".join(signatures.to_pylist()), "u1").reshape(len(signatures), COORDINATES + 8 * PREFIX)
        return raw[:, :COORDINATES], np.ascontiguousarray(raw[:, COORDINATES:]).view("<u8")

    def post(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(0).to_numpy()
        _, values = unpacked(batch.column(1))
        keys = mix64(values ^ (np.arange(1, PREFIX + 1, dtype=np.uint64) << np.uint64(58)))
        keys = keys >> np.uint64(KEY_BITS) << np.uint64(KEY_BITS) | np.arange(PREFIX, dtype=np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(keys.ravel().view("i8")), pa.array(np.repeat(ids, PREFIX))], ["key", "id"])

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(2).to_pylist()
        low, values = unpacked(batch.column(1))
        # the byte of a posted coordinate is in the signature; two more follow it
        more = (mix64(values) >> np.uint64(40)).astype("<u2").view("u1").reshape(len(lists), 2 * PREFIX)
        sig = pa.array([r.tobytes() for r in np.concatenate([low, more], axis=1)], pa.binary())
        row = pa.array(np.repeat(np.arange(len(lists)), [len(x) for x in lists]))
        key, m = (pa.array([x[c] for own in lists for x in own], pa.int64()) for c in ("key", "m"))
        return pa.RecordBatch.from_arrays([key, m, batch.column(0).take(row), sig.take(row)], ["key", "m", "id", "sig"])

    posted = map_batches(reps.select("id", "sig"), post, "key long, id long")
    sizes = written(posted.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "lists")
    # lists of one need no task, and signatures go only where a list is; long lists are dealt as pairs of blocks
    lists = posted.join(sizes, "key").groupBy("id").agg(F.collect_list(F.struct("key", "m")).alias("lists"))
    live = map_batches(reps.select("id", "sig").join(lists, "id").select("id", "sig", "lists"), sign, "key long, m long, id long, sig binary")
    live = in_blocks(live, "m", "id", LIST_BLOCK, LIST_BLOCK // 2, LIST_SPREAD)

    def link(batches):
        for g in sorted_groups(batches, ["key", "x", "y"]):
            if g.num_rows < 2:
                continue
            ids = g.column("id").to_numpy()
            raw = np.frombuffer(b"".join(g.column("sig").to_pylist()), "u1").reshape(len(ids), COORDINATES + 2 * PREFIX)
            sig, more = raw[:, :COORDINATES], np.ascontiguousarray(raw[:, COORDINATES:]).view("<u2")
            code = sig[:, :PREFIX].astype(np.uint32) << np.uint32(16) | more
            pairs = _forest_of_list(ids, sig, code, int(g.column("key")[0].as_py()) & ((1 << KEY_BITS) - 1))
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*pairs)], ["a", "b"])

    spread = live.select("key", "x", "y", "id", "sig").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "id")
    return spread.mapInArrow(link, "a long, b long")


def _forest_of_sets(ids: np.ndarray, size: np.ndarray, sets: list[np.ndarray], similar: int) -> list[tuple[int, int]]:
    """Spanning forest of the links of a block, by an inverted index of shingles."""
    n = len(ids)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    start = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    end = np.append(start[1:], len(flat))
    shared = end - start > 1
    start, end = start[shared], end[shared]
    # for every document the lists of its shared shingles
    lists = [[] for _ in range(n)]
    for a, b in zip(start.tolist(), end.tolist()):
        posting = owner[a:b]
        for k in posting.tolist():
            lists[k].append(posting)
    joined = _Union(n)
    for i in range(n):
        if not lists[i]:
            continue
        common = np.bincount(np.concatenate(lists[i]), minlength=n)
        union = size[i] + size - common
        linked = np.flatnonzero((100 * common >= similar * union) & (common > 0))
        joined.join(i, linked[linked != i])
        if (joined.label == joined.label[0]).all():
            break
    return [(int(ids[a]), int(ids[b])) for a, b in joined.links]


def confirmed_links(members: DataFrame, words: int, similar: int) -> DataFrame:
    """(a, b): a spanning forest of the links of every family, on full sets.

    members: (id, family, m, text), a row per class.
    """

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [shingles(t, words).astype("<u8").tobytes() for t in batch.column(3).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(raw, pa.binary())], ["id", "family", "m", "set"])

    rows = written(map_batches(members.select("id", "family", "m", "text"), sets, "id long, family long, m long, set binary"), "sets")
    # a family's sets differ little: each is sent as bits over the set of the
    # family's first document, and the shingles that aren't in that one
    hubs = rows.filter("id = family").select("family", F.col("set").alias("hub"))

    def against_hub(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, bits, extra, hub, hub_raw = [], [], [], None, None
        for raw, h in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
            own = np.frombuffer(raw, "<u8")
            if h != hub_raw:
                hub_raw, hub = h, np.frombuffer(h, "<u8")
            at = np.minimum(np.searchsorted(hub, own), len(hub) - 1)
            same = hub[at] == own
            flags = np.zeros(len(hub), bool)
            flags[at[same]] = True
            n.append(len(own))
            bits.append(np.packbits(flags).tobytes())
            extra.append(own[~same].tobytes())
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(bits, pa.binary()), pa.array(extra, pa.binary())], ["id", "family", "m", "n", "bits", "extra"])

    coded = map_batches(rows.join(hubs, "family").select("id", "family", "m", "set", "hub"), against_hub, "id long, family long, m long, n long, bits binary, extra binary")
    spread = in_blocks(coded, "m", "id", FAMILY_BLOCK, 2 * LEAST_BLOCK, FAMILY_SPREAD)

    def link(batches):
        for g in sorted_groups(batches, ["family", "x", "y"]):
            if g.num_rows < 2:
                continue
            sets = [np.concatenate([np.flatnonzero(np.unpackbits(np.frombuffer(b, "u1"))).astype(np.uint64), np.frombuffer(e, "<u8")]) for b, e in zip(g.column("bits").to_pylist(), g.column("extra").to_pylist())]
            pairs = _forest_of_sets(g.column("id").to_numpy(), g.column("n").to_numpy(), sets, similar)
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*pairs)], ["a", "b"])

    spread = spread.select("family", "x", "y", "id", "n", "bits", "extra").repartition("family", "x", "y").sortWithinPartitions("family", "x", "y", "id")
    return spread.mapInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, similar: int = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for every document."""
    again = repeated_ids(docs, id_col)
    base = tagged(docs.select(id_col, text_col), id_col, text_col, again).select(F.col("_dedup_id").alias("id"), F.col("_dedup_tag").alias("tag"), F.col("_dedup_text").alias("text"))
    sketch = written(sketches(base, words), "sketches")
    full = sketch.filter("n > 0 and id is not null")
    # a class's members have equal sets, so any member's signature and text will do;
    # classes have numbers of their own, as one id may have several texts
    classes = full.groupBy("n", "mark").agg(F.min(F.struct("id", "tag")).alias("rep"), F.first("sig").alias("sig"))
    reps = written(classes.select(F.monotonically_increasing_id().alias("id"), F.col("rep.id").alias("rep"), F.col("rep.tag").alias("tag"), "n", "mark", "sig"), "classes")
    families = components(posting_links(reps)).select(F.col("node").alias("id"), F.col("component").alias("family"))
    sizes = families.groupBy("family").agg(F.count("*").alias("m"))
    families = written(families.join(dealt(sizes, "family"), "family").join(reps.select("id", "rep", "tag"), "id").select("id", "family", "m", "rep", "tag"), "families")
    members = base.withColumnRenamed("id", "rep").join(families, ["rep", "tag"]).select("id", "family", "m", "text")
    if not again.isEmpty():
        members = members.dropDuplicates(["id"])  # rows that repeat a document
    found = components(confirmed_links(members, words, similar))
    found = found.join(reps.select("id", "rep"), F.col("node") == F.col("id")).select("node", "component", "rep")
    least = found.groupBy("component").agg(F.min("rep").alias("component_id"))
    found = found.join(dealt(least, "component"), "component").select("node", "component_id")
    marks = reps.select("n", "mark", "id", "rep").join(found, F.col("id") == F.col("node"), "left").select("n", "mark", F.coalesce("component_id", "rep").alias("component_id"))
    # copies meet their class in a join that adaptive execution can split
    out = sketch.withColumn("mark", F.when(F.col("id").isNotNull(), F.col("mark"))).join(marks, ["n", "mark"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
