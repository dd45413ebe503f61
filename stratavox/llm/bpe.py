"""Operator 1: BPE encoding and decoding by speculation and verification.

Greedy longest match proposes a token sequence for every distinct word of a
text. A sequence is the BPE encoding exactly if every adjacent pair of tokens
is compatible: merging the two tokens' symbols alone gives the same two tokens
back. That test runs on arrays of pairs, and its verdicts are remembered. Where
a pair fails, the proposal is taken back to it and goes on with the next shorter
token, until all pairs hold; there is only one such sequence. While most pairs
are new, words with a failing pair are merged exactly instead.

Texts are cut into chunks, and results joined, as Arrow arrays; Python sees the
distinct chunks only.

Cases: a null or empty text has no tokens and decodes to the empty string;
repeated documents are encoded each; special-token strings in a text become
their ids, as the file's added tokens say. Text of any length is processed
whole. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
import struct
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from stratavox.llm.common import WORD, map_batches, spread, table

WORD_VOCABULARY = "word_bpe_49k.json"

#: ASCII marks (no apostrophe, which may begin a contraction), Latin-1 letters, ASCII marks.
PLAIN = re.compile(r"([!-&(-/:-@\[-`{-~]*)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """Latin-1 letters as the byte-level alphabet writes their UTF-8 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    sign = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return {c: "".join(sign[b] for b in chr(c).encode()) for c in range(128, 256)}


BYTE_LETTERS = _byte_letters()


def resolve(path: str) -> str:
    """A tokenizer file: a path, or a name in the installed public_tokenizers."""
    if os.path.exists(path):
        return path
    import public_tokenizers

    return public_tokenizers.path(path)


class SpeculativeBPE:
    """Encoder and decoder for a tokenizers JSON file of kind BPE."""

    #: Distinct chunks, and words, that a generation of a worker's memory holds; two are kept.
    MEMORY = 250_000
    #: Verdicts on pairs of tokens remembered by a worker before they are dropped.
    PAIRS = 500_000
    #: Words encoded at once, and how many of them tell the way.
    BLOCK, TRIAL = 50_000, 2_000
    #: Proposals for a word before it is merged instead.
    ROUNDS = 8
    NONE = 1 << 62

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        path = resolve(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        #: Per added token its id and its text.
        self.added = {t: (struct.pack("<I", i), t) for t, i in added.items()}
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        size = max([*self.vocab.values(), *added.values()]) + 1
        self.text: list[str] = [""] * size
        for token, i in [*self.vocab.items(), *added.items()]:
            self.text[i] = token
        rank = np.full(size, -1, np.int64)
        left, right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        merges: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            i, j = self.vocab[a], self.vocab[b]
            k = self.vocab[a + b]
            merges.setdefault((i, j), (r, k))
            if rank[k] < 0:
                rank[k], left[k], right[k] = r, i, j
        self.merges, self.rank, self.left, self.right = merges, rank, left, right
        keys = np.array([(i << 32) | j for i, j in merges], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([r for r, _ in merges.values()], np.int64)[order]
        #: The compatibility test undoes merges latest first, so parts must come before the whole.
        self.ordered = bool(all(rank[k] > max(rank[i], rank[j]) for (i, j), (_, k) in merges.items() if rank[k] >= 0))
        self.proposable = {t: i for t, i in self.vocab.items() if self._whole(t, i)}
        #: The most characters of a token that begins with these four; others have three at most.
        self.reach: dict[str, int] = {}
        for t in self.proposable:
            body = t[: len(t) - len(self.suffix)] if self.suffix and t.endswith(self.suffix) else t
            self.reach[body[:4]] = max(self.reach.get(body[:4], 3), len(body))
        #: Per chunk, and per word, its ids and their decoding; what was used lately and what before.
        self.memory: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}
        self.words: dict[str, tuple[bytes, str]] = {}
        self.older_words: dict[str, tuple[bytes, str]] = {}
        #: Per pair of tokens (left * size + right): are they compatible?
        self.size, self.pairs = size, {}
        #: Chunks end at white space, so an added token with white space in it must be found before.
        self.spaced = not all(map(WORD.fullmatch, added))
        self._pack = [struct.Struct(f"<{n}I").pack for n in range(32)]
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        #: Set where the file's normaliser lower-cases and its splitter takes letter runs.
        self.plain = PLAIN.fullmatch if kinds == ["NFC", "Replace", "Lowercase"] and self.suffix else None

    def _symbols(self, word: str) -> list[str]:
        """A word's characters; the last one carries the end-of-word suffix."""
        return [*word[:-1], word[-1] + self.suffix]

    def _whole(self, token: str, i: int) -> bool:
        """True if the token is a symbol, or is made by the merge recorded for it."""
        body = token.removesuffix(self.suffix) if self.suffix else token
        return len(body) == 1 or self.rank[i] >= 0

    def propose(self, word: str, unknown: list[int] | None = None) -> list[int]:
        """Greedy longest match; the word's last character keeps its suffix.

        With ``unknown``, a token that is known not to be compatible with the one
        before isn't taken, and where none is left the token before is taken back.
        A start that was given up once is never tried again. Pairs without a
        verdict are taken to hold and added to ``unknown``.
        """
        ok, reach, pairs, size, n = self.proposable, self.reach, self.pairs, self.size, len(word)
        whole, checked = word + self.suffix, unknown is not None
        out, starts, dead, at, last = [], [], (), 0, -1
        end = reach.get(word[:4], 3)
        if end > n:
            end = n
        while True:
            while end > at:
                token = ok.get(word[at:end] if end < n else whole[at:])
                if token is not None and end not in dead:
                    if last < 0 or not checked:
                        break
                    fine = pairs.get(last * size + token)
                    if fine is None:
                        unknown.append(last * size + token)
                        break
                    if fine:
                        break
                end -= 1
            else:
                if not out:
                    if checked:
                        return []
                    raise ValueError(f"no token for {word[at]!r}")
                if dead:
                    dead.add(at)
                else:
                    dead = {at}
                out.pop()
                end, at, last = at - 1, starts.pop(), out[-1] if out else -1
                continue
            out.append(token)
            if end == n:
                return out
            starts.append(at)
            at, last = end, token
            end = at + reach.get(word[at : at + 4], 3)
            if end > n:
                end = n

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For arrays of adjacent tokens: would BPE leave the pair as it is?

        Looking back from the finished pair, the later of the two tokens is
        undone again and again; the tokens at the boundary must never have had
        a merge that comes before the one that took them away. Of two merges of
        equal rank the left one happens first.
        """
        a, b = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        limit = np.full(len(a), self.NONE, np.int64)
        fine, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = (x << 32) | y
            at = np.minimum(np.searchsorted(self.pair_keys, key), max(len(self.pair_keys) - 1, 0))
            hit = (self.pair_keys[at] == key) & (self.pair_ranks[at] < limit[live]) if len(self.pair_keys) else np.zeros(len(live), bool)
            fine[live[hit]] = False
            rx, ry = self.rank[x], self.rank[y]
            undo_left = rx > ry
            done = hit | ((rx < 0) & (ry < 0))
            limit[live] = np.where(undo_left, rx, ry + 1)
            a[live] = np.where(undo_left, self.right[x], x)
            b[live] = np.where(undo_left, y, self.left[y])
            live = live[~done]
        return fine

    def merge(self, word: str) -> list[int]:
        """Exact merging: the pair of least rank first, the leftmost of equals."""
        ids = [self.vocab[s] for s in self._symbols(word)]
        if len(ids) > 48:
            return self._merge_long(ids)
        merges, none = self.merges, self.NO_MERGE
        found = [merges.get(pair, none) for pair in zip(ids, ids[1:])]
        while found:
            least = min(found)
            if least is none:
                break
            i = found.index(least)
            ids[i : i + 2] = [least[1]]
            del found[i]
            if i:
                found[i - 1] = merges.get((ids[i - 1], ids[i]), none)
            if i < len(found):
                found[i] = merges.get((ids[i], ids[i + 1]), none)
        return ids

    NO_MERGE = (1 << 62, -1)

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs, so a very long word costs n log n."""
        import heapq

        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, x, y, new = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != x or ids[j] != y:
                continue
            ids[i], alive[j], after[i] = new, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for p in (before[i], i):
                q = after[p] if p >= 0 else n
                if p >= 0 and q < n and (m := self.merges.get((ids[p], ids[q]))):
                    heapq.heappush(heap, (m[0], p, ids[p], ids[q], m[1]))
        return [ids[i] for i in range(n) if alive[i]]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Token ids of pre-tokenised, byte-mapped words.

        The first words tell whether the pairs are known by now. If most have a
        pair without a verdict, as words without any pattern always do, taking
        proposals back costs more than merging the words that fail.
        """
        if not self.ordered:
            return [self.merge(w) for w in words]
        if len(self.pairs) > self.PAIRS:
            self.pairs.clear()
        found, unsure = self._take_back(words[: self.TRIAL])
        rest = words[self.TRIAL :]
        return found + (self._test(rest) if 2 * unsure > len(found) else self._take_back(rest)[0])

    def _take_back(self, words: list[str]) -> tuple[list[list[int]], int]:
        """Proposals by known pairs, again while they fail; how many words weren't sure at once."""
        pairs, size, propose = self.pairs, self.size, self.propose
        found: list[list[int]] = [[]] * len(words)
        left, unsure = list(range(len(words))), -1
        for _ in range(self.ROUNDS):
            open_words, asked = [], set()
            for k in left:
                unknown: list[int] = []
                found[k] = propose(words[k], unknown)
                if unknown or not found[k]:
                    open_words.append((k, unknown))
                    asked.update(unknown)
            if unsure < 0:
                unsure = len(open_words)
            if asked:
                keys = np.fromiter(asked, np.int64, len(asked))
                pairs.update(zip(keys.tolist(), self.compatible(keys // size, keys % size).tolist()))
            left = [k for k, unknown in open_words if not found[k] or not all([pairs[p] for p in unknown])]
            if not left:
                break
        for k in left:
            found[k] = self.merge(words[k])
        return found, unsure

    def _test(self, words: list[str]) -> list[list[int]]:
        """One proposal a word, all pairs tested at once; words with a failing pair are merged."""
        found = [self.propose(w) for w in words]
        flat = np.array([i for x in found for i in x], np.int64)
        owner = np.repeat(np.arange(len(found)), np.array([len(x) for x in found], np.int64))
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        if len(inner):
            keys, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
            fine = self.compatible(keys // self.size, keys % self.size)
            self.pairs.update(zip(keys.tolist(), fine.tolist()))
            for w in np.unique(owner[inner[~fine[back]]]).tolist():
                found[w] = self.merge(words[w])
        return found

    def _kept(self, full: dict) -> dict:
        """A full generation; nothing of one that a slice of ever new words has made far too large."""
        return full if len(full) <= 2 * self.MEMORY else {}

    def _pieces(self, chunk: str) -> list[str]:
        """The words of a chunk, byte-mapped, by the library's own normaliser and splitter."""
        normal, pre = self.library.normalizer, self.library.pre_tokenizer
        return [w for w, _ in pre.pre_tokenize_str(normal.normalize_str(chunk) if normal else chunk)]

    def _coded(self, words: Iterable[str]) -> dict[str, tuple[bytes, str]]:
        """The memory of words, with these in it."""
        if len(self.words) > self.MEMORY:
            self.words, self.older_words = {}, self._kept(self.words)
        known, older, fresh = self.words, self.older_words, []
        for w in words:
            if w not in known:
                got = older.get(w)
                if got is None:
                    fresh.append(w)
                else:
                    known[w] = got
        text, pack = self.text, self._pack
        for k in range(0, len(fresh), self.BLOCK):
            block = fresh[k : k + self.BLOCK]
            for w, own in zip(block, self.encode_words(block)):
                known[w] = (pack[len(own)](*own) if len(own) < 32 else np.array(own, "<u4").tobytes(), " ".join([text[i] for i in own]))
        return known

    def _learn(self, chunks: list[str], marked: bool = False) -> None:
        """Fills the memory for chunks of text without ASCII white space.

        Plain Latin words with marks around them need no library call: the
        normaliser lower-cases them and the splitter parts word and marks. If
        ``marked``, added tokens are taken out of the chunks first.
        """
        if marked:
            parts = {c: [p for p in self.splitter.split(c) if p] for c in chunks if self.splitter.search(c)}
            inner = {p for own in parts.values() for p in own}.difference(self.added)
            self._learn([*inner.union(c for c in chunks if c not in parts)])
            for c, own in parts.items():
                got = [self.added.get(p) or self.memory[p] for p in own]
                self.memory[c] = (b"".join([g[0] for g in got]), " ".join([g[1] for g in got if g[0]]))
            return
        plain, spans, needed = self.plain, [], {}
        for c in chunks:
            m = plain(c) if plain else None
            if m:
                before, word, marks = m.groups()
                word = word.lower()
                if not word.isascii():
                    word = word.translate(BYTE_LETTERS)
                if before:
                    pieces = (before, word, marks) if marks else (before, word)
                else:
                    pieces = (word, marks) if marks else (word,)
            else:
                pieces = self._pieces(c)
            spans.append((c, pieces))
            for w in pieces:
                needed[w] = None
        words, memory = self._coded(needed), self.memory
        for c, pieces in spans:
            if len(pieces) == 1:
                memory[c] = words[pieces[0]]
            else:
                got = [words[w] for w in pieces]
                memory[c] = (b"".join([g[0] for g in got]), " ".join([g[1] for g in got]))

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """Per text its ids (little-endian unsigned 32-bit) and their decoding."""
        ids, decoded = self.encode_array(pa.array(texts, pa.string()))
        return list(zip(ids.to_pylist(), decoded.to_pylist()))

    def encode_array(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """The same of an array of strings, as large_binary and large_string arrays."""
        # lists of numbers have no cycles, and the collector would walk the whole memory over and over
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts.fill_null(""))
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        marked = any(pc.any(pc.match_substring(texts, s)).as_py() for s in self.added)
        if marked and self.spaced:
            cut = pa.array([[w for i, part in enumerate(self.splitter.split(t)) for w in ([part] if i % 2 else WORD.findall(part))] for t in texts.to_pylist()], pa.list_(texts.type))
        else:
            cut = pc.ascii_split_whitespace(texts)
        chunks = cut.values.dictionary_encode()
        distinct = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.memory) > self.MEMORY:
            self.memory, self.older = {}, self._kept(self.memory)
        memory, older = self.memory, self.older
        found = list(map(memory.get, distinct))
        missing = [(k, distinct[k]) for k, got in enumerate(found) if got is None]
        memory.update((c, got) for _, c in missing if (got := older.get(c)) is not None)
        fresh = [c for _, c in missing if c not in memory]
        if fresh:
            self._learn(fresh, marked)
        for k, c in missing:
            found[k] = memory[c]
        ids, decoded = pa.array([g[0] for g in found], pa.large_binary()), pa.array([g[1] for g in found], pa.large_string())
        # chunks without a token, as the empty ones at a text's ends, take no place
        at, ends = chunks.indices.to_numpy(), cut.offsets.to_numpy()
        full = np.array([bool(g[0]) for g in found], bool)[at] if found else np.zeros(0, bool)
        ends = pa.array(np.concatenate([[0], np.cumsum(full)])[ends], pa.int32())
        at = pa.array(at[full])
        return (
            pc.binary_join(pa.ListArray.from_arrays(ends, ids.take(at)), pa.scalar(b"", pa.large_binary())),
            pc.binary_join(pa.ListArray.from_arrays(ends, decoded.take(at)), pa.scalar(" ", pa.large_string())),
        )

    def decode(self, ids: list[int]) -> str:
        """As a tokenizers file without a decoder does: tokens joined by a space."""
        return " ".join(self.text[i] for i in ids)


_encoders: dict[str, SpeculativeBPE] = {}


def encoder(path: str) -> SpeculativeBPE:
    if path not in _encoders:
        _encoders[path] = SpeculativeBPE(path)
    return _encoders[path]


def spans(values: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Where the values of a large_binary or large_string array end (after a start), and their bytes."""
    ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = memoryview(values.buffers()[2] or b"")[ends[0] : ends[-1]]
    return ends - ends[0], data


def sha256(ends: np.ndarray, data: memoryview) -> pa.Array:
    """Lower-case hex digests of the values."""
    at = ends.tolist()
    return pa.array([hashlib.sha256(data[i:j]).hexdigest() for i, j in zip(at, at[1:])], pa.string())


def bpe_round_trip(docs: DataFrame, path: str = WORD_VOCABULARY, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Encodes every text and decodes it again.

    Returns (id, ids array<int>, decoded string); with ``digest`` their sizes
    and SHA-256 sums instead: (id, n_tokens, ids_sha256, decoded_sha256). The
    work is per row, without a shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, decoded = encoder(path).encode_array(batch.column(1))
        ends, numbers = spans(ids)
        if digest:
            sizes = pa.array(np.diff(ends) // 4, pa.int64())
            return pa.RecordBatch.from_arrays([batch.column(0), sizes, sha256(ends, numbers), sha256(*spans(decoded))], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
        lists = pa.ListArray.from_arrays(pa.array(ends // 4, pa.int32()), pa.array(np.frombuffer(numbers, "<u4").astype("i4")))
        return pa.RecordBatch.from_arrays([batch.column(0), lists, decoded.cast(pa.string())], [id_col, "ids", "decoded"])

    schema = f"{id_col} {kind}, " + ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string")
    return map_batches(spread(docs.select(id_col, text_col)), run, schema)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"), WORD_VOCABULARY, digest=True).select(F.col("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")
