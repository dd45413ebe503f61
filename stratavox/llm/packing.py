"""Operator 5: packing by cutting-stock column generation.

Documents become token ids with an end id; whole sequences are cut off first,
and what remains (1 to ``capacity`` - 1 tokens) is packed like stock to be cut:
a linear program over patterns of lengths, its columns priced by a knapsack
dynamic program over the length histogram. The histogram has at most
``capacity`` bins at any input size, so the program runs on the driver. It
starts from patterns filled longest length first, and ends by its gap alone.
Rounded patterns are assigned to documents by their rank among pieces of their
length; what rounding leaves over is filled into patterns of its own, and what
fits into none is laid end to end and cut where a sequence ends, so only the
last of all sequences has room left.

Ranks come from counts of (length, input partition), so no length is gathered
in one task even if a third of all rows have it. Pieces are written to the
shared folder once, so the ranks are fixed whatever executors are lost.

Cases: a null or empty text is the end id alone; long texts give many whole
sequences; equal rows are packed each; an empty table gives no rows; other
columns are ignored. Ids of documents should be unique: pieces of rows with
equal ids can't be told apart in the result.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from stratavox.llm.bpe import resolve
from stratavox.llm.common import map_batches, slices, spread, table, written

CAPACITY = 1024
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"
#: Column generation ends at this relative gap to its lower bound, or this near to
#: it in sequences: rounding costs more than one.
GAP, WHOLE = 1e-3, 1.0
#: Tokens of padding that a pattern may have, and what a cut costs as a share of the piece.
MAX_WASTE, CUT = 4, 0.01
#: Fixed value: how a byte-level tokenizers file splits text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters on which regular-expression engines agree whatever their Unicode
#: version: Latin letters, general punctuation, usual signs. Texts with others,
#: or with rare white space, take the library's own path.
UNUSUAL = re.compile("[^\x00-\x1b\x20-\x84\x86-\x9f\xa1-\u024f\u2010-\u2027\u2030-\u205e\u20ac]")


class TokenIds:
    """Token ids of a byte-level tokenizers file.

    Where the file's merges are in the order of their ids, a faster engine is
    built from the same file (its ranks are the ids); special tokens and unusual
    characters always go through the tokenizers library.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        path = resolve(path)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.fast = self._fast(path)

    @staticmethod
    def _fast(path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        pre = spec["pre_tokenizer"]
        plain = spec["normalizer"] is None and pre["type"] == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"]
        if not plain or spec["model"].get("end_of_word_suffix") or [vocab[a + b] for a, b in pairs] != list(range(256, 256 + len(pairs))):
            return None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if i < 256 + len(pairs)}
        return tiktoken.Encoding("from-file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        out = []
        for t in texts:
            t = t or ""
            if self.fast is None or UNUSUAL.search(t) or any(s in t for s in self.special):
                out.append(np.array(self.library.encode(t, add_special_tokens=False).ids, "<u4"))
            else:
                out.append(self.fast.encode_to_numpy(t, disallowed_special=()).astype("<u4", copy=False))
        return out


_tokenizers: dict[str, TokenIds] = {}


def token_ids(path: str, texts: list[str | None]) -> list[np.ndarray]:
    if path not in _tokenizers:
        _tokenizers[path] = TokenIds(path)
    return _tokenizers[path](texts)


def cut_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(id, start, length, doc_tokens, ids, part, nth): nth counts pieces of that
    length in the part."""
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4")

    def run(batches):
        count = np.zeros(capacity + 1, np.int64)
        part = TaskContext.get().partitionId()
        for whole in batches:
            for batch in slices(whole):
                row, start, length, tokens, kept, nth = [], [], [], [], [], []
                for k, ids in enumerate(token_ids(path, batch.column(1).to_pylist())):
                    ids = np.concatenate([ids, end])
                    for a in range(0, len(ids), capacity):
                        piece = ids[a : a + capacity]
                        n = len(piece)
                        row.append(k)
                        start.append(a)
                        length.append(n)
                        tokens.append(len(ids))
                        kept.append(piece.tobytes())
                        nth.append(count[n])
                        count[n] += 1
                if row:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (start, length, tokens)), pa.array(kept, pa.binary()), pa.array([part] * len(row), pa.int32()), pa.array(nth, pa.int64())],
                        [id_col, "start", "length", "doc_tokens", "ids", "part", "nth"],
                    )

    return spread(docs.select(id_col, text_col)).mapInArrow(run, f"{id_col} {kind}, start long, length long, doc_tokens long, ids binary, part int, nth long")


def fill(lengths: np.ndarray, left: np.ndarray, room: int) -> np.ndarray:
    """Counts of lengths, ``left`` of each at most, with the greatest sum that fits ``room``.

    Subset sums as bits of one integer per length; of equal sums the one with the
    longest lengths is taken, as short ones are easier to place later.
    """
    m = int(np.searchsorted(lengths, room, side="right"))
    counts = np.zeros(len(lengths), np.int64)
    most = np.minimum(left[:m], room // lengths[:m]).tolist()
    sums, mask, at = 1, (1 << (room + 1)) - 1, []
    for size, n in zip(lengths[:m].tolist(), most):
        at.append(sums)
        take = 1
        while n > 0:
            step = min(take, n)
            sums |= (sums << (step * size)) & mask
            n -= step
            take *= 2
    total = sums.bit_length() - 1
    for k in range(m - 1, -1, -1):
        size = int(lengths[k])
        for n in range(min(most[k], total // size), -1, -1):
            if at[k] >> (total - n * size) & 1:
                counts[k], total = n, total - n * size
                break
        if not total:
            break
    return counts


def first_basis(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns, their costs and their use: the longest length left, filled up with
    what is left; where over ``MAX_WASTE`` would stay empty, pieces to be cut.

    Every column uses up a length that no later column has, so the columns are
    independent and make a basis.
    """
    left, n = demand.astype(float).copy(), len(lengths)
    columns, cost, x, done = np.zeros((n, n)), np.ones(n), np.zeros(n), 0
    while done < n:
        there = np.maximum(np.floor(left), left > 0).astype(np.int64)
        top = int(np.flatnonzero(there)[-1])
        there[top] -= 1
        pattern = fill(lengths, there, capacity - int(lengths[top]))
        pattern[top] += 1
        if capacity - int(pattern @ lengths) > MAX_WASTE:
            columns[top, done], cost[done], x[done] = 1, (1 + CUT) * lengths[top] / capacity, left[top]
            left[top] = 0
            done += 1
            continue
        on = np.flatnonzero(pattern)
        share = left[on] / pattern[on]
        times = share.min()
        gone = on[share <= times * (1 + 1e-12)]
        left[on] -= times * pattern[on]
        left[gone] = 0
        columns[:, done], x[done] = pattern, times
        for k in gone[1:]:  # used up by the same pattern: a column of its own, not used
            done += 1
            columns[k, done], cost[done] = 1, (1 + CUT) * lengths[k] / capacity
        done += 1
    return columns, cost, x


def price(duals: np.ndarray, lengths: np.ndarray, capacity: int, more: int = 0) -> tuple[float, list[np.ndarray]]:
    """Patterns of great value, the best first: an unbounded knapsack by dynamic programming.

    The others are the best ones that hold a given length, for ``more`` lengths.
    """
    best = np.zeros(capacity + 1)
    item = np.full(capacity + 1, -1, np.int64)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        k = fits[room]
        best[room] = best[room - 1]
        if k:
            value = best[room - lengths[:k]] + duals[:k]
            j = int(value.argmax())
            if value[j] > best[room] + 1e-12:
                best[room], item[room] = value[j], j

    def pattern(room: int, start: int | None = None) -> np.ndarray:
        out = np.zeros(len(lengths))
        if start is not None:
            out[start] += 1
            room -= int(lengths[start])
        while room > 0:
            if item[room] < 0:
                room -= 1
            else:
                out[item[room]] += 1
                room -= int(lengths[item[room]])
        return out

    found = [pattern(capacity)]
    if more:
        value = best[capacity - lengths] + duals
        for k in np.argsort(-value, kind="stable")[:more].tolist():
            if value[k] > 1 + 1e-7:
                p = pattern(capacity, k)
                if not any(np.array_equal(p, q) for q in found):
                    found.append(p)
    return float(best[capacity]), found


#: Columns that one pricing may bring, pivots after which the inverse is made anew,
#: and how near pricing stays to the duals of the best bound.
AT_ONCE, FRESH, PULL = 40, 300, 0.7


def column_generation(lengths: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP) -> tuple[list[tuple[np.ndarray, float]], float, float]:
    """Patterns and how often each is used, the objective and its lower bound, by the
    revised simplex method.

    A piece may also be cut, which costs its share of a sequence and ``CUT`` of it
    more; so a pattern pays as long as it wastes less than that. The program ends
    when the objective is within ``gap`` of the bound (the greater of the volume
    and the value of duals that no pattern exceeds) or less than ``WHOLE`` above it,
    or when no column improves it.
    """
    n = len(lengths)
    if not n:
        return [], 0.0, 0.0
    # a little more of each, all different: no ties, so no pivot without progress
    asked = demand * (1 + 1e-7 * np.random.default_rng(n).random(n))
    columns, cost, x = first_basis(lengths, asked, capacity)
    alone = (1 + CUT) * lengths / capacity
    inverse, bound, pivots = np.linalg.inv(columns), float(asked @ lengths) / capacity, 0
    # duals of the best bound so far: pricing stays near them, as the basis' own swing
    centre, pull = lengths / capacity, PULL
    while True:
        duals = cost @ inverse
        asking = pull * centre + (1 - pull) * np.clip(duals, 0, alone)
        value, found = price(asking, lengths, capacity, AT_ONCE)
        proven = float(asked @ asking) / max(value, 1.0)
        if proven > bound:
            bound, centre = proven, asking / max(value, 1.0)
        reached = float(cost @ x)
        if reached - bound <= max(gap * bound, WHOLE):
            break
        offers = [(p, 1.0) for p in found]
        for k in np.flatnonzero((duals < -1e-9) | (duals > alone + 1e-9)).tolist():
            one = np.zeros(n)
            one[k] = -1.0 if duals[k] < 0 else 1.0  # more of a length than asked for, or a piece to be cut
            offers.append((one, 0.0 if duals[k] < 0 else float(alone[k])))
        moved = False
        for pattern, price_ in offers:
            gain = float(duals @ pattern) - price_
            if gain <= 1e-9:
                continue
            step = inverse @ pattern
            ok = step > 1e-9
            if not ok.any():
                continue
            ratio = np.full(n, np.inf)
            ratio[ok] = x[ok] / step[ok]
            out = int(ratio.argmin())
            t = ratio[out]
            x -= t * step
            x[out] = t
            np.maximum(x, 0, out=x)
            pivot = inverse[out] / step[out]
            duals = duals - gain * pivot
            step[out] -= 1.0
            at = np.flatnonzero(np.abs(step) > 1e-13)
            inverse[at] -= step[at, None] * pivot
            columns[:, out], cost[out] = pattern, price_
            moved, pivots = True, pivots + 1
            if pivots % FRESH == 0:
                inverse = np.linalg.inv(columns)
                x, duals = np.maximum(inverse @ asked, 0), cost @ inverse
        if moved:
            pull = PULL
        elif pull > 0:
            pull = pull / 2 if pull > 0.05 else 0.0
        else:
            break
    used = [(columns[:, k].astype(np.int64), float(x[k])) for k in range(n) if x[k] > 1e-9 and cost[k] == 1]
    return used, float(cost @ x), bound


@dataclass(frozen=True)
class Plan:
    """runs: (length, first rank, end rank, times in a pattern, first sequence,
    offset). rest: (length, first rank, end rank, first token), its tokens
    counted on from the end of the last pattern's sequence. ``sequences`` is the
    number of the patterns' ones; objective and bound are the linear program's.
    """

    runs: np.ndarray
    rest: np.ndarray
    sequences: int
    objective: float
    bound: float

    @property
    def share(self) -> float:
        """Share of the pieces that patterns place."""
        held, over = (int((x[:, 2] - x[:, 1]).sum()) for x in (self.runs, self.rest))
        return held / max(held + over, 1)


def plan_sequences(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> Plan:
    """Rounded patterns as runs of ranks, and the rest laid end to end.

    The program's patterns are used as often as whole numbers go; what is left is
    filled into patterns of its own, longest lengths first. Patterns that waste
    more than ``MAX_WASTE`` tokens aren't used: their pieces are cut instead.
    """
    left, used = demand.astype(np.int64).copy(), np.zeros(len(lengths), np.int64)
    runs, rest, sequence = [], [], 0

    def place(pattern: np.ndarray, times: int) -> None:
        nonlocal sequence
        offset = 0
        for k in np.flatnonzero(pattern)[::-1].tolist():
            a = int(pattern[k])
            runs.append((int(lengths[k]), int(used[k]), int(used[k]) + a * times, a, sequence, offset))
            used[k] += a * times
            left[k] -= a * times
            offset += a * int(lengths[k])
        sequence += times

    most = lambda p: int((left[p > 0] // p[p > 0]).min())
    chosen, objective, bound = column_generation(lengths, demand.astype(float), capacity)
    for pattern, x in chosen:
        times = min(int(x + 1e-6), most(pattern))
        if times > 0 and capacity - int(pattern @ lengths) <= MAX_WASTE:
            place(pattern, times)
    open_ = left.copy()
    while open_.any():
        top = int(np.flatnonzero(open_)[-1])
        open_[top] -= 1
        pattern = fill(lengths, open_, capacity - int(lengths[top]))
        open_[top] += 1
        pattern[top] += 1
        if capacity - int(pattern @ lengths) <= MAX_WASTE:
            times = most(pattern)
            place(pattern, times)
            open_ -= pattern * times
        else:
            open_[top] = 0  # nothing that is left fits beside it
    token = sequence * capacity
    for k in np.flatnonzero(left)[::-1].tolist():
        rest.append((int(lengths[k]), int(used[k]), int(demand[k]), token))
        token += int(left[k] * lengths[k])
    return Plan(np.array(runs, np.int64).reshape(-1, 6), np.array(rest, np.int64).reshape(-1, 4), sequence, objective, bound)


def pack(docs: DataFrame, path: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: (id, start, length, doc_tokens, sequence_id, offset, ids, ids_crc32).

    ids are the piece's tokens as little-endian unsigned integers of 32 bits; a
    sequence is its pieces' ids by offset.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    pieces = written(cut_pieces(docs, path, capacity, end_id, id_col, text_col), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    w = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # of known size when the join is planned: where it's small, no ids are shuffled
    base = written(counts.select("length", "part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base")), "ranks")
    ranked = pieces.join(base, ["length", "part"]).withColumn("rank", F.col("nth") + F.col("base"))
    # at most ``capacity`` rows at any input size
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).toLocalIterator()}
    full = histogram.pop(capacity, 0)
    lengths = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[k] for k in sorted(histogram)], np.int64)
    plan = plan_sequences(lengths, demand, capacity)
    runs, rest, used = plan.runs, plan.rest, plan.sequences
    tail = max(used, -(-int(rest[-1, 3] + (rest[-1, 2] - rest[-1, 1]) * rest[-1, 0]) // capacity) if len(rest) else 0)
    runs = np.concatenate([runs, np.array([[capacity, 0, full, 1, tail, 0]], np.int64)])
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    columns = [id_col, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    schema = f"{id_col} {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    key = 1 << 40
    # for the rest by length: its first rank and the token that one starts at
    rest_rank, rest_token = np.zeros((2, capacity + 1), np.int64)
    rest_rank[rest[:, 0]], rest_token[rest[:, 0]] = rest[:, 1], rest[:, 3]

    def assign(batch: pa.RecordBatch) -> pa.RecordBatch:
        start, length, tokens, rank = (batch.column(i).to_numpy() for i in (1, 2, 3, 4))
        at = np.searchsorted(runs[:, 0] * key + runs[:, 1], length * key + rank, side="right") - 1
        own = runs[np.maximum(at, 0)]
        held = (at >= 0) & (own[:, 0] == length) & (rank < own[:, 2])
        nth = rank - own[:, 1]
        token = rest_token[length] + (rank - rest_rank[length]) * length
        sequence = np.where(held, own[:, 4] + nth // own[:, 3], token // capacity)
        offset = np.where(held, own[:, 5] + nth % own[:, 3] * length, token % capacity)
        over = offset + length > capacity
        if not over.any():
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(sequence), pa.array(offset), batch.column(5)], columns)
        # what reaches over a sequence's end is two rows: up to it, and from it on
        row = np.repeat(np.arange(len(over)), 1 + over)
        second = np.append(False, row[1:] == row[:-1])
        cut = np.where(over, capacity - offset, length)[row]
        raw = batch.column(5).take(pa.array(row)).to_pylist()
        ids = [r[4 * c :] if s else r[: 4 * c] for r, s, c in zip(raw, second.tolist(), cut.tolist())]
        values = (start[row] + np.where(second, cut, 0), np.where(second, length[row] - cut, cut), tokens[row], sequence[row] + second, np.where(second, 0, offset[row]))
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *map(pa.array, values), pa.array(ids, pa.binary())], columns)

    packed = map_batches(ranked.select(*columns[:4], "rank", "ids"), assign, schema)
    return packed.withColumn("ids_crc32", F.crc32("ids"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces with the digests of their ids in place of the ids."""
    return pack(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
