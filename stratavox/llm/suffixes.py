"""Operator 4: suffix-array dedup by linear grouping construction.

A string of ``LENGTH`` bytes that also starts earlier goes, byte by byte.

1. Of a window's byte grams the one of least hash stands for it (its
   minimiser). Equal windows have equal minimisers at the same place, so rows
   (fingerprint, place, first window, last window) are all that is shuffled;
   a fingerprint that occurs once can't be part of a repeat.
2. Occurrences of a fingerprint with equal surroundings repeat the earliest of
   them. One per distinct surrounding stays.
3. The distinct surroundings of a fingerprint are compared by a suffix array of
   their text, in blocks of ``STEP`` bytes aligned at the fingerprint. Suffixes
   with nine equal blocks form a class; with the few bytes before and after
   them, the class decides whether two windows are equal. A fingerprint of more
   than ``BLOCK`` surroundings is compared window by window, on their hashes.

The suffix array is built by grouping: suffixes are grouped by their first
symbol; groups are processed in descending order; in each one every suffix
finds its previous smaller suffix, and those pointed at move to groups of their
own just above their old ones. Then the groups' orders are emitted from the
least suffix on. No level of recursion, no renaming.

Cases: a null or empty text has no bytes; matches never cross documents;
a text may repeat itself, overlaps included; rows with one id and one text are
one document, rows with one id and other texts are documents of their own, in
an order of their hashes; rows with a null id keep all bytes; other columns
are ignored; kept bytes may end inside a character, so the operator gives bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from stratavox.llm.common import dealt, map_batches, mix64, range_hashes, sorted_groups, table, tagged, window_hashes, written
from stratavox.llm.substring import anchors

LENGTH = 100
GRAM = 20
STEP = 10
#: Distinct surroundings of a fingerprint that one array takes; more are compared
#: window by window, dealt by their hashes, so no task holds such a group.
BLOCK = 8192
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE, _BASE_2 = 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9


def suffix_array(s: list[int]) -> list[int]:
    """Suffixes of s in order. The last symbol must be the least and occur once."""
    n = len(s)
    # groups by first symbol; a group is a range of the final order
    by_symbol: dict[int, list[int]] = {}
    for i, c in enumerate(s):
        by_symbol.setdefault(c, []).append(i)
    start, size, members, last, group, at = [], [], [], {}, [0] * n, 0
    for g, c in enumerate(sorted(by_symbol)):
        own = by_symbol[c]
        for i in own:
            group[i] = g
        start.append(at)
        size.append(len(own))
        members.append(own)
        at += len(own)
        last[at] = g
    before = [-1] * n
    # descending: previous smaller pointers, and the moves that they cause
    high = n
    while high:
        g = last[high]
        low = start[g]
        if size[g] == 1:
            own = [i for i in members[g] if group[i] == g]
            i = own[0]
            j = i - 1
            while j >= 0 and start[group[j]] >= low:
                j = before[j]
            before[i] = j
            pointed = {1: [j]} if j >= 0 else {}
        else:
            count: dict[int, int] = {}
            for i in sorted(i for i in members[g] if group[i] == g):
                j = i - 1
                while j >= 0 and start[group[j]] >= low:
                    j = before[j]
                before[i] = j
                if j >= 0:
                    count[j] = count.get(j, 0) + 1
            pointed = {}
            for j, k in count.items():
                pointed.setdefault(k, []).append(j)
        for k in sorted(pointed, reverse=True):
            split: dict[int, list[int]] = {}
            for j in pointed[k]:
                split.setdefault(group[j], []).append(j)
            for h, moved in split.items():
                q = len(moved)
                if q == size[h]:
                    continue
                end = start[h] + size[h]
                new = len(start)
                size[h] -= q
                start.append(end - q)
                size.append(q)
                members.append(moved)
                last[end], last[end - q] = new, h
                for j in moved:
                    group[j] = new
        high = low
    # emit: every suffix pulls the ones before it to the front of their groups
    order, placed = [-1] * n, [False] * n
    order[0], placed[n - 1] = n - 1, True
    front = start
    for i in range(n):
        j = order[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            order[front[g]] = j
            front[g] += 1
            placed[j] = True
            j = before[j]
    return order


def equal_windows(places: list[int], texts: list[bytes], length: int = LENGTH, step: int = STEP) -> list[list[int]]:
    """For aligned surroundings, earliest first: windows that an earlier one has too.

    places: offset of the fingerprint in each text. Returns per text the starts
    of repeated windows.
    """
    blocks = length // step - 1
    symbols: dict[bytes, int] = {}
    n, s, spots = len(texts), [], []
    for t, (place, text) in enumerate(zip(places, texts)):
        shift = place % step
        for b in range((len(text) - shift) // step):
            word = text[shift + b * step : shift + (b + 1) * step]
            s.append(symbols.setdefault(word, n + 1 + len(symbols)))
            spots.append((t, b))
        s.append(t + 1)  # a separator of its own
        spots.append((t, -1))
    s.append(0)
    spots.append((-1, -1))
    kind: list[dict[int, int]] = [{} for _ in range(n)]
    now, previous = 0, None
    for i in suffix_array(s):
        run = s[i : i + blocks]
        if len(run) < blocks or min(run) <= n:
            continue
        if run != previous:
            now, previous = now + 1, run
        t, b = spots[i]
        kind[t][b] = now
    seen: set[tuple[int, int, bytes, bytes]] = set()
    out = []
    for t, (place, text) in enumerate(zip(places, texts)):
        shift, own, found = place % step, kind[t], []
        rel = (place - shift) // step
        for p in range(len(text) - length + 1):
            edge = (shift - p) % step
            b = (p + edge - shift) // step
            a = p + edge
            key = (own[b], b - rel, text[p:a], text[a + blocks * step : p + length])
            if key in seen:
                found.append(p)
            else:
                seen.add(key)
        out.append(found)
    return out


def byte_anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(fp, around, id, tag, first, last, place, salt) of all minimisers of (id, tag, text).

    Of a batch's rows with equal surroundings only the earliest can be the
    earliest of all: it has salt 0. The others are repeats whatever comes, and
    are dealt by their salt, so a passage of many documents isn't one task's.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, parts = [], []
        for k, t in enumerate(batch.column(2).to_pylist()):
            raw = (t or "").encode("utf-8", "surrogatepass")
            if len(raw) < length:
                continue
            h = _BYTES[np.frombuffer(raw, "u1")]
            fp, at, first, last = anchors(h, length, gram)
            around = range_hashes(h, first, last + length, _BASE)
            row.append(np.full(len(fp), k))
            parts.append((fp, around, first, last, at))
        if not parts:
            return None
        fp, around, first, last, at = (np.concatenate([p[k] for p in parts]) for k in range(5))
        row = np.concatenate(row)
        ids, tags = (np.asarray(batch.column(k).to_numpy())[row] for k in (0, 1))
        order = np.lexsort((first, tags, ids, around, fp))
        fp, around, first, last, at, ids, tags = (x[order] for x in (fp, around, first, last, at, ids, tags))
        salt = np.zeros(len(fp), np.int32)
        again = np.flatnonzero((fp[1:] == fp[:-1]) & (around[1:] == around[:-1])) + 1
        # rows that repeat a document are one document: the same place again is no repeat
        group = np.flatnonzero(np.concatenate([[True], (fp[1:] != fp[:-1]) | (around[1:] != around[:-1])]))
        lead = group[np.searchsorted(group, again, side="right") - 1]
        again = again[(ids[again] != ids[lead]) | (tags[again] != tags[lead]) | (first[again] != first[lead])]
        salt[again] = 1 + ((ids[again] * 31 + tags[again] % 1009 + first[again]) % 997)
        return pa.RecordBatch.from_arrays([pa.array(fp.view("i8")), pa.array(around.view("i8")), pa.array(ids, pa.int64()), pa.array(tags, pa.int64()), *(pa.array(c.astype("i4")) for c in (first, last, at, salt))], ["fp", "around", "id", "tag", "first", "last", "place", "salt"])

    return map_batches(docs.select("id", "tag", "text"), run, "fp long, around long, id long, tag long, first int, last int, place int, salt int")


def repeats(found: DataFrame) -> DataFrame:
    """Rows of fingerprints that occur again: open (to be compared) or not (a plain repeat).

    A stream sorted by fingerprint, surroundings, document and place. A row with
    the surroundings of the one before is a plain repeat; the first of other
    surroundings is open; the first of all is held until other surroundings come,
    so a fingerprint of any number of rows takes one row of memory.
    """

    def run(batches):
        held: pa.RecordBatch | None = None  # the first row of a fingerprint with one kind of surroundings so far
        last = None  # (fp, around, id, tag, first) of the row before
        for batch in batches:
            salt = batch.column(7).to_numpy()
            if salt.any():
                known = batch.filter(pa.array(salt > 0))
                yield known.append_column("open", pa.array(np.zeros(known.num_rows, bool)))
                batch = batch.filter(pa.array(salt == 0))
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy() for k in range(5)]
            before = [np.concatenate([[c[0] if last is None else v], c[:-1]]) for c, v in zip(cols, last or [None] * 5)]
            same = [c == b for c, b in zip(cols, before)]
            if last is None:
                same[0][0] = False
            last = [c[-1] for c in cols]
            new_fp = ~same[0]
            new = new_fp | ~same[1]
            # rows that repeat a document are one document
            real = ~(same[0] & same[1] & same[2] & same[3] & same[4])
            owner = np.cumsum(new_fp)  # 0: the fingerprint goes on from the batch before
            kinds = np.bincount(owner, weights=new)
            emit = real & (~new | (kinds[owner] > 1) | (owner == 0))
            n = int(owner[-1])
            if held is not None:
                if kinds[0] > 0:
                    yield held.append_column("open", pa.array([True]))
                if kinds[0] > 0 or n > 0:
                    held = None
            if n > 0 and kinds[n] == 1:
                held = batch.slice(int(np.flatnonzero(new_fp)[-1]), 1)
            keep = pa.array(emit)
            if emit.any():
                yield batch.filter(keep).append_column("open", pa.array(new[emit]))

    dealt = found.repartition("fp", "salt").sortWithinPartitions("fp", "around", "id", "tag", "first")
    return dealt.mapInArrow(run, "fp long, around long, id long, tag long, first int, last int, place int, salt int, open boolean")


def repeated_strings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(id, tag, spans): per document of (id, tag, text) ranges [a, b) of starts of strings that start earlier."""
    rows = written(repeats(byte_anchors(docs, length, gram)), "repeats")
    plain = rows.filter("not open").select("id", "tag", F.col("first").alias("a"), (F.col("last") + 1).alias("b"))
    unsettled = rows.filter("open").select("fp", "id", "tag", "first", "last", "place")
    # fingerprints of more than a block: few rows, of known number
    large = written(unsettled.groupBy("fp").agg(F.count("*").alias("m")).filter(F.col("m") > BLOCK).select("fp"), "large")
    near = _surroundings(docs, unsettled.join(large, "fp", "left_anti"), length)

    def compare(batches):
        for g in sorted_groups(batches, ["fp"]):
            places, texts = g.column("place").to_pylist(), g.column("around").to_pylist()
            ids, tags, first = (g.column(c).to_pylist() for c in ("id", "tag", "first"))
            once = [k for k in range(len(ids)) if not k or (ids[k], tags[k], first[k]) != (ids[k - 1], tags[k - 1], first[k - 1])]
            if len(once) < len(ids):
                places, texts, ids, tags, first = ([x[k] for k in once] for x in (places, texts, ids, tags, first))
            out = []
            for i, t, f, starts in zip(ids, tags, first, equal_windows(places, texts, length)):
                if starts:
                    at = np.array(starts)
                    cut = np.flatnonzero(np.diff(at) > 1)
                    out += [(i, t, f + int(a), f + int(b) + 1) for a, b in zip(at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["id", "tag", "a", "b"])

    compared = near.repartition("fp").sortWithinPartitions("fp", "id", "tag", "first").mapInArrow(compare, "id long, tag long, a int, b int")
    found = plain.unionByName(compared)
    if not large.isEmpty():  # else the texts would be read again for nothing
        found = found.unionByName(_by_windows(_surroundings(docs, unsettled.join(large, "fp", "left_semi"), length), length))
    return found.groupBy("id", "tag").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def _surroundings(docs: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """(fp, id, tag, first, place, around): the text of the rows' windows, and the fingerprint's place in it."""
    asked = rows.groupBy("id", "tag").agg(F.collect_list(F.struct("fp", "first", "last", "place")).alias("spans"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, values = [], []
        for k, (t, spans) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            raw = t.encode("utf-8", "surrogatepass")
            for s in spans:
                row.append(k)
                values.append((s["fp"], s["first"], s["place"] - s["first"], raw[s["first"] : s["last"] + length]))
        fp, first, place, text = zip(*values)
        row = pa.array(row)
        return pa.RecordBatch.from_arrays([pa.array(fp, pa.int64()), batch.column(0).take(row), batch.column(1).take(row), pa.array(first, pa.int32()), pa.array(place, pa.int32()), pa.array(text, pa.binary())], ["fp", "id", "tag", "first", "place", "around"])

    return map_batches(docs.join(asked, ["id", "tag"]).select("id", "tag", "text", "spans"), run, "fp long, id long, tag long, first int, place int, around binary")


def _by_windows(near: DataFrame, length: int) -> DataFrame:
    """(id, tag, a, b): the repeats among surroundings of fingerprints too large for an
    array of their own, window by window, on 128 bits of hash. The first of equal
    windows is found by sums that combine before they are dealt, the others by a join
    that adaptive execution can split, so work grows with the number of rows."""

    def windows(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, h1, h2, at = [], [], [], []
        for k, (first, text) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            h = _BYTES[np.frombuffer(text, "u1")]
            h1.append(window_hashes(h, length, _BASE))
            h2.append(window_hashes(mix64(h), length, _BASE_2))
            row.append(np.full(len(h1[-1]), k))
            at.append(first + np.arange(len(h1[-1])))
        row = pa.array(np.concatenate(row))
        return pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(h).view("i8")) for h in (h1, h2)), batch.column(0).take(row), batch.column(1).take(row), pa.array(np.concatenate(at).astype("i4"))], ["h1", "h2", "id", "tag", "a"])

    rows = map_batches(near.select("id", "tag", "first", "around"), windows, "h1 long, h2 long, id long, tag long, a int")
    place = F.struct("id", "tag", "a")
    firsts = rows.groupBy("h1", "h2").agg(F.min(place).alias("least"), F.max(place).alias("most")).filter("least < most").select("h1", "h2", "least")
    return rows.join(dealt(firsts, "h1", "h2"), ["h1", "h2"]).filter(place > F.col("least")).select("id", "tag", "a", (F.col("a") + 1).alias("b"))


def suffix_dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept binary); with ``digest`` kept_sha256 instead."""
    kind = docs.schema[id_col].dataType.simpleString()
    docs = tagged(docs.select(id_col, text_col), id_col, text_col)
    base = docs.select(F.col("_dedup_id").alias("id"), F.col("_dedup_tag").alias("tag"), F.col("_dedup_text").alias("text")).filter("id is not null")
    marks = repeated_strings(base, length).select(F.col("id").alias("_dedup_id"), F.col("tag").alias("_dedup_tag"), "spans")
    source = docs.join(marks, ["_dedup_id", "_dedup_tag"], "left").select(id_col, "_dedup_text", "spans")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        size, gone, runs, out = [], [], [], []
        for t, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            raw = (t or "").encode("utf-8", "surrogatepass")
            left, removed, n = [], 0, 0
            if spans:
                at = 0
                for a, b in sorted((s["a"], s["b"] + length - 1) for s in spans):
                    if a > at or not n:
                        left.append(raw[at:a])
                        n += 1
                        start = a
                    else:
                        start = at
                    if b > at:
                        removed += b - max(start, at)
                        at = b
                left.append(raw[at:])
            else:
                left = [raw]
            kept = b"".join(left)
            size.append(len(raw))
            gone.append(removed)
            runs.append(n)
            out.append(hashlib.sha256(kept).hexdigest() if digest else kept)
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (size, gone, runs)), pa.array(out, pa.string() if digest else pa.binary())], [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept"])

    return map_batches(source, run, f"{id_col} {kind}, n_bytes long, n_removed long, n_spans long, " + ("kept_sha256 string" if digest else "kept binary"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), digest=True)
