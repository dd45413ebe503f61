"""Every text operator against brute force or a round trip, on small tables."""

import collections
import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def passage(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, copies, near copies, shared passages, overlaps,
    repeated rows, and extra columns with clashing names."""
    shared, base = passage(1, 60), passage(2, 120)
    texts = [None, "", "   \n\t ", "one", "one two three", base, base, base.replace("a", "a", 1) + " end", base.upper()]
    words = base.split()
    for k in range(8):
        w = list(words)
        w[10 + 11 * k % 100] = f"changed{k}"
        texts.append(" ".join(w))
    for k in range(6):
        texts.append(passage(100 + k, 30) + " " + shared + "\n" + passage(200 + k, 20 + k))
    texts += ["ab " * 200, "xyz" * 150, passage(7, 6000), "é ñ ü — 😀 " * 40, "a\x00b \x1c c\x85d\xa0e", "<|endoftext|> and <|startoftext|>", "x" * 5000]
    texts += [shared, "Title\n" + passage(300, 80) + ".\nhome | about | news | log | in | out\n" + "word*** " * 30]
    data = [(i, t, "en" if i % 3 else None, None if i % 5 == 0 else f"src{i % 2}", len(t or ""), "clash", i * 2, i, "m", 1.0) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, n long, rank long, mark string, score double"
    return spark.createDataFrame(data, schema)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("doc_id < 0")


def texts_of(docs):
    return dict(docs.select("doc_id", "text").collect())


def test_bpe_equals_the_library(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    from stratavox.llm.bpe import bpe_round_trip

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    digests, whole = rows(bpe_round_trip(docs, digest=True)), rows(bpe_round_trip(docs))
    for i, t in texts_of(docs).items():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        assert whole[i].ids == ids and whole[i].decoded == text
        assert digests[i].n_tokens == len(ids)
        assert digests[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe_round_trip(empty).count() == 0


def test_bpe_on_random_strings():
    import public_tokenizers
    from tokenizers import Tokenizer

    from stratavox.llm.bpe import SpeculativeBPE

    own = SpeculativeBPE("word_bpe_49k.json")
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    r = random.Random(5)
    letters = "aaabbcdehilnorst'éßñİΣσ😀 \n\t0159.,!|   ́\x1c　中文한"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    for t, (ids, text) in zip(texts, own.encode(texts)):
        want = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want and text == lib.decode(want, skip_special_tokens=False)


def test_bpe_proposals_are_checked():
    """Both ways are taken: proposals that hold, and words that need merging."""
    from stratavox.llm.bpe import SpeculativeBPE

    own = SpeculativeBPE("word_bpe_49k.json")
    words = list(dict.fromkeys(passage(3, 3000).split()))
    exact = [own.merge(w) for w in words]
    assert own.encode_words(words) == exact
    wrong = sum(own.propose(w) != e for w, e in zip(words, exact))
    assert 0 < wrong < len(words)
    assert own._merge_long([own.vocab[s] for s in own._symbols("ab" * 100)]) == own.merge("ab" * 100)


def test_bpe_failing_proposals_are_taken_back():
    """A proposal with a failing pair goes on from there; nothing is merged anew."""
    from stratavox.llm.bpe import SpeculativeBPE

    own = SpeculativeBPE("word_bpe_49k.json")
    words = list(dict.fromkeys(passage(3, 3000).split())) + ["ab" * 3000, "thsh" * 700]
    exact = [own.merge(w) for w in words]
    merge, merged = own.merge, []
    own.merge = lambda w: merged.append(w) or merge(w)
    assert own._take_back(words)[0] == exact and not merged
    assert own.encode_words(words) == exact and not merged
    # pairs that aren't known yet, or no round left: words with a failing pair are merged
    for own.TRIAL, own.ROUNDS in ((10, 8), (5000, 1)):
        own.pairs.clear()
        merged.clear()
        assert own.encode_words(words) == exact and 0 < len(merged) < len(words)


def test_bpe_memory_keeps_what_is_used():
    """A full memory drops what wasn't used since it was last full, not the frequent words."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from stratavox.llm.bpe import SpeculativeBPE

    own = SpeculativeBPE("word_bpe_49k.json")
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    own.MEMORY, own.PAIRS = 50, 50
    proposed, encode_words = collections.Counter(), own.encode_words
    own.encode_words = lambda words: proposed.update(words) or encode_words(words)
    rare = passage(4, 4000).split()

    def check(t):
        want = lib.encode(t, add_special_tokens=False).ids
        [(ids, text)] = own.encode([t])
        assert np.frombuffer(ids, "<u4").tolist() == want and text == lib.decode(want, skip_special_tokens=False)

    for k in range(0, len(rare), 40):
        check("Frequent (words), " + " ".join(rare[k : k + 40]))
        assert max(map(len, (own.memory, own.older, own.words, own.older_words))) <= 100
    assert proposed["frequent"] == proposed["words"] == 1
    # a slice of far more new words than the memory holds isn't kept as an older generation
    check(" ".join(rare))
    assert len(own.memory) > 100 and len(own.words) > 100
    check("few words")
    assert not own.older and len(own.memory) == 2 and not own.older_words and len(own.words) == 2


def test_bpe_chunks_with_marks_spaces_and_added_tokens():
    import itertools

    import public_tokenizers
    from tokenizers import Tokenizer

    from stratavox.llm.bpe import SpeculativeBPE

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    parts = ["Word", "é", "'s", "'", "(", "<", "|>", "_", "7", "\u00b2", "\u0130", "H", "\u0331", "\u3000", "\u00a0", "\x85", "\x1c", "\x00", "\x0b", " ", "<|endoftext|>", "<|ENDOFTEXT|>"]
    texts = [None, "", " ", *map("".join, itertools.product(parts, repeat=3))]
    for batch in (texts, [t for t in texts if t and "<|endoftext|>" not in t]):
        for t, (ids, text) in zip(batch, SpeculativeBPE("word_bpe_49k.json").encode(batch), strict=True):
            want = lib.encode(t or "", add_special_tokens=False).ids
            assert np.frombuffer(ids, "<u4").tolist() == want and text == lib.decode(want, skip_special_tokens=False), t


def test_quality_rules(docs, empty):
    from stratavox.llm.quality_rules import quality_rules

    got = rows(quality_rules(docs))
    for i, t in texts_of(docs).items():
        w, g = WORD.findall(t or ""), got[i]
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        tri = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {j for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        assert (g.n_words, g.word_chars, g.n_repeat_words) == (len(w), sum(map(len, w)), len(covered)), i
        assert g.n_symbols == sum(c in "#*$%&|<>" for c in t or "")
        assert g.n_dup_lines == len(lines) - len(set(lines))
        assert g.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (g.base_failed and g.kept)
    last = got[max(got)]
    assert last.n_failed_lines == 2 and "***" not in last.clean_text and last.clean_text.startswith("Title\n")
    assert not last.kept and got[5].kept
    assert quality_rules(empty).count() == 0


def test_quality_rules_stay_native(docs):
    from stratavox.llm.quality_rules import quality_rules
    from stratavox.llm.sharding import hilbert_shards

    for df in (quality_rules(docs), hilbert_shards(docs)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_classifier_on_held_out_rows(spark):
    from stratavox.llm.classifier import op3_quality_classifier

    d = "/root/testdata/sf0.01"
    got = op3_quality_classifier(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert len(got) > 50 and np.mean([r.predicted == r.quality for r in got]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def test_classifier_cases(docs, empty, spark):
    from stratavox.llm.classifier import features, score, train

    labels = spark.createDataFrame([(5, 1), (5, 0), (9, None), (10, 7), (None, 1)], "doc_id long, quality int")
    model = train(docs, labels)  # one class only: the prior
    got = rows(score(docs, model, keep=["lang"]))
    assert len(got) == docs.count() and len({r.score for r in got.values()}) == 1
    assert score(empty, train(empty, labels.limit(0))).count() == 0
    assert len(features(None)) == len(features("")) == 0 and len(features("a b c")) == 11


def near_brute(texts):
    lower = {i: i + 32 for i in range(65, 91)}
    sets = {}
    for i, t in texts.items():
        w = WORD.findall((t or "").translate(lower))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    group = {i: i for i in sets}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                group[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_minhash(docs, empty):
    from stratavox.llm.minhash import near_duplicates

    got = rows(near_duplicates(docs))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == near_brute(texts_of(docs))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    assert near_duplicates(empty).count() == 0


def test_minhash_large_family_in_blocks(spark):
    """Near copies of one text in many blocks, with some that hang on by one link."""
    from stratavox.llm.minhash import near_duplicates

    base, r, data = passage(11, 150).split(), random.Random(4), []
    for i in range(400):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 4, 6, 9])):
            w[r.randrange(150)] = f"w{r.randrange(10**6)}"
        data.append((i, " ".join(w)))
    got = rows(near_duplicates(spark.createDataFrame(data, "doc_id long, text string")))
    assert {i: (g.n_shingles, g.component_id) for i, g in got.items()} == near_brute(dict(data))


def test_minhash_null_ids_and_repeated_rows(spark):
    from stratavox.llm.minhash import near_duplicates

    t = passage(1, 40)
    df = spark.createDataFrame([(None, t), (3, t), (3, t), (4, t), (None, None)], "doc_id long, text string")
    got = sorted(map(str, near_duplicates(df).select("doc_id", "component_id", "kept").collect()))
    assert len(got) == 5 and sum("doc_id=3, component_id=3, kept=True" in g for g in got) == 2
    assert sum("doc_id=4, component_id=3, kept=False" in g for g in got) == 1


def test_components(spark):
    from stratavox.llm.components import components

    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (200, 100), (100, 200)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102, 200)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def substring_brute(texts, window):
    words = {i: WORD.findall(t or "") for i, t in texts.items()}
    count = collections.Counter(tuple(w[k : k + window]) for w in words.values() for k in range(len(w) - window + 1))
    out = {}
    for i, w in words.items():
        gone = {j for k in range(len(w) - window + 1) if count[tuple(w[k : k + window])] > 1 for j in range(k, k + window)}
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest())
    return out


def test_substring(docs, empty):
    from stratavox.llm.substring import substring_dedup

    got = rows(substring_dedup(docs, digest=True))
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in got.items()} == substring_brute(texts_of(docs), 35)
    assert sum(r.n_removed for r in got.values()) > 300
    text = rows(substring_dedup(docs, keep=["lang"]))
    assert all(hashlib.sha256(r.clean_text.encode()).hexdigest() == got[i].kept_sha256 for i, r in text.items())
    assert substring_dedup(empty, digest=True).count() == 0


def test_fingerprint_index_merges_runs(spark, tmp_path):
    from stratavox.llm.substring import FingerprintIndex

    index = FingerprintIndex(spark, str(tmp_path / "index"), fan_in=2)
    t = passage(9, 90)
    hits = []
    for k in range(4):
        batch = spark.createDataFrame([(k, 0, t if k in (0, 3) else passage(50 + k, 90))], "id long, tag long, text string")
        hits.append(index.append(batch).count())
    assert hits[:3] == [0, 0, 0] and hits[3] > 0
    index._compact()
    assert [level for level, _ in index.runs] == [2]
    assert {r.id for r in index.repeated().collect()} == {0, 3}
    index.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("stratavox_run_")]


def suffix_brute(texts, length=100):
    seen, out = set(), {}
    for i in sorted(texts):
        raw = (texts[i] or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        out[i] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(docs, empty):
    from stratavox.llm.suffixes import suffix_dedup

    got = rows(suffix_dedup(docs, digest=True))
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == suffix_brute(texts_of(docs))
    assert suffix_dedup(empty).count() == 0


def test_dedup_of_repeated_rows(spark):
    """Rows with one id are one document; a null id keeps its text."""
    from stratavox.llm.substring import substring_dedup
    from stratavox.llm.suffixes import suffix_dedup

    t = passage(21, 80)
    df = spark.createDataFrame([(1, t), (1, t), (None, t)], "doc_id long, text string")
    assert {r.n_removed for r in substring_dedup(df).collect()} == {0}
    assert {r.n_removed for r in suffix_dedup(df).collect()} == {0}


def test_suffix_array_by_grouping():
    from stratavox.llm.suffixes import suffix_array

    r = random.Random(8)
    for _ in range(1500):
        s = [r.randint(1, r.choice([1, 2, 3, 9])) for _ in range(r.randint(0, 40))] + [0]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def check_packing(got, docs, capacity=1024):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in texts_of(docs).items()}
    at, used = collections.Counter(), collections.Counter()
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        at[r.doc_id] += r.length
    assert at == {i: len(x) for i, x in ids.items()}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used[r.sequence_id]
        used[r.sequence_id] += r.length
    assert max(used.values()) <= capacity
    return sum(capacity - n for n in used.values()) / sum(used.values())


def test_packing(docs, empty):
    from stratavox.llm.packing import pack

    check_packing(pack(docs).collect(), docs)
    assert pack(empty).count() == 0


def test_packing_wastes_little(spark):
    from stratavox.llm.packing import pack

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert check_packing(pack(docs).collect(), docs) < 0.02


def test_packing_returns_the_tokens(docs):
    from stratavox.llm.packing import TokenIds, pack

    texts = texts_of(docs)
    want = {i: x.tolist() + [0] for i, x in zip(texts, TokenIds("byte_bpe_50k.json")(list(texts.values())))}
    got, told = collections.defaultdict(list), pack(docs, capacity=100).collect()
    for r in sorted(told, key=lambda r: (r.doc_id, r.start)):
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        got[r.doc_id] += ids
    assert got == want and any(r.length == 100 for r in told)


def test_column_generation_reaches_the_bound():
    from stratavox.llm.packing import CUT, column_generation, plan_sequences

    lengths, demand = np.array([30, 40, 60, 70]), np.array([100, 50, 80, 90])
    found, objective, bound = column_generation(lengths, demand.astype(float), 100)
    assert all(int(p @ lengths) <= 100 for p, _ in found)
    placed = sum(p * x for p, x in found)
    cut = np.maximum(demand - placed, 0)
    assert objective == pytest.approx(sum(x for _, x in found) + (1 + CUT) * cut @ lengths / 100, rel=1e-3)
    assert bound <= objective <= bound * 1.001 + 1
    plan = plan_sequences(lengths, demand, 100)
    placed = collections.Counter()
    for length, a, b, *_ in plan.runs.tolist() + plan.rest.tolist():
        placed[length] += b - a
    assert placed == dict(zip(lengths.tolist(), demand.tolist()))


def test_column_generation_prices_columns(monkeypatch):
    """From a basis in which every piece is cut, pricing finds the patterns."""
    from stratavox.llm import packing as p

    lengths = np.array([130, 170, 220, 260, 310, 330, 350, 420, 510, 600])
    demand = np.array([90.0, 80, 70, 60, 50, 40, 90, 80, 70, 60])
    n, share = len(lengths), (1 + p.CUT) * lengths / 1024
    monkeypatch.setattr(p, "first_basis", lambda lengths, demand, capacity: (np.eye(n), share.copy(), demand.copy()))
    monkeypatch.setattr(p, "WHOLE", 0.0)
    found, objective, bound = p.column_generation(lengths, demand, 1024, gap=1e-6)
    assert found and objective == pytest.approx(bound, rel=1e-5) and objective < demand @ share
    assert all(int(q @ lengths) <= 1024 for q, _ in found)


def test_price_equals_brute_force():
    from itertools import product

    from stratavox.llm.packing import fill, price

    r = np.random.default_rng(1)
    for _ in range(20):
        lengths = np.sort(r.choice(np.arange(3, 30), 4, replace=False))
        duals, left, room = r.random(4), r.integers(0, 4, 4), 40
        every = [np.array(c) for c in product(range(14), repeat=4) if np.array(c) @ lengths <= room]
        value, found = price(duals, lengths, room, 3)
        assert value == pytest.approx(max(duals @ c for c in every)) and duals @ found[0] == pytest.approx(value)
        assert all(p @ lengths <= room for p in found)
        got = fill(lengths, left, room)
        assert (got <= left).all() and got @ lengths == max(c @ lengths for c in every if (c <= left).all())


def test_patterns_place_nearly_all_pieces():
    """On the lengths of a real table, patterns place the pieces; little is cut."""
    import pyarrow.parquet as pq

    from stratavox.llm.packing import TokenIds, plan_sequences

    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column(0).to_pylist()
    n = np.array([len(x) + 1 for x in TokenIds("byte_bpe_50k.json")(texts)]) % 1024
    lengths, demand = np.unique(n[n > 0], return_counts=True)
    plan = plan_sequences(lengths, demand, 1024)
    assert plan.share > 0.95 and plan.objective <= plan.bound * 1.001
    ends = plan.rest[-1, 3] + (plan.rest[-1, 2] - plan.rest[-1, 1]) * plan.rest[-1, 0]
    assert -(-ends // 1024) <= np.ceil(demand @ lengths / 1024) * 1.002


def test_tokens_equal_the_library():
    from stratavox.llm.packing import TokenIds

    own, r = TokenIds("byte_bpe_50k.json"), random.Random(3)
    letters = "aabbcdehilnorst'éßñİΣσ😀 \n\t0159.,!|   ́\x1c　中文한\x85\r\x0b²½ªº«»ǅÀʰ“”€…"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 50))) for _ in range(4000)] + ["<|endoftext|>a", "", None]
    want = own.library.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert all(g.tolist() == w.ids for g, w in zip(own(texts), want))


def test_vectors(spark):
    from stratavox.llm.vectors import near_vectors

    r, data = np.random.default_rng(2), []
    centres = r.normal(size=(12, 16))
    for i in range(300):
        v = centres[i % 12] + r.normal(size=16) * (0.05 + 0.4 * (i % 4))
        data.append((i, [float(x) for x in v], i % 12 % 3 if i % 50 else None, "x"))
    data += [(300, data[1][1], 1, "x"), (301, data[1][1], 1, "x"), (302, None, 1, "x"), (303, [0.0] * 16, 1, "x"), (304, [float("nan")] * 16, 1, "x"), (305, [1.0, None], 1, "x"), (306, [1.0, 2.0], 1, "x"), (307, [2.0, 4.0], 1, "x"), (308, [], 1, "x")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int, n string")
    got = rows(near_vectors(df), "vec_id")
    good = {i: (np.array(v), l) for i, v, l, _ in data if v and l is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    link = {i: {j for j, (w, m) in good.items() if j != i and m == l and len(w) == len(v) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.93} for i, (v, l) in good.items()}
    comp = {i: i for i, *_ in data}
    for _ in data:
        for i in link:
            comp[i] = min([comp[i], *(comp[j] for j in link[i])])
    assert {i: (x.n_links, x.component_id, x.kept) for i, x in got.items()} == {i: (len(link.get(i, ())), comp[i], comp[i] == i) for i, *_ in data}
    assert near_vectors(df.limit(0)).count() == 0


def test_vectors_in_blocks(spark):
    from stratavox.llm.vectors import block_links, near_vectors

    r = np.random.default_rng(5)
    x = np.repeat(r.normal(size=(20, 64)), 30, axis=0) + r.normal(size=(600, 64)) * 0.25
    n = np.sqrt((x * x).sum(1))
    want = (x @ x.T / np.outer(n, n)) >= 0.93
    np.fill_diagonal(want, False)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = rows(near_vectors(df), "vec_id")
    assert [got[i].n_links for i in range(600)] == want.sum(1).tolist()
    assert sum(len(k) for _, k in block_links(x, x, 0.93)) == want.sum() + 600


def test_vectors_collide_in_windows():
    from stratavox.llm.vectors import WIDTH, collisions

    r = np.random.default_rng(8)
    px, py = r.normal(size=(70, 32)).astype("f4"), r.normal(size=(90, 32)).astype("f4")
    py[:9] = px[:9]
    near = (py >= px[:, None] - WIDTH) & (py <= px[:, None] + WIDTH)
    assert np.array_equal(np.array(list(collisions(px, py))), near.sum(axis=2))


def test_recall_of_collision_counts():
    """Of pairs right at the limit nearly none is missed, and few unrelated ones are verified."""
    from stratavox.llm.vectors import COLLISIONS, WIDTH, calibrated, lines

    assert calibrated(0.93) == (WIDTH, COLLISIONS) and COLLISIONS == 15 and WIDTH == pytest.approx(0.5, abs=1e-3)
    r = np.random.default_rng(5)
    a, e = r.normal(size=(2, 20000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    e -= (e * a).sum(1)[:, None] * a
    e /= np.linalg.norm(e, axis=1)[:, None]
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * e
    way = lines(64)
    found = ((np.abs(a @ way - b @ way) <= WIDTH).sum(axis=1) >= COLLISIONS).mean()
    wrong = ((np.abs(a @ way - e @ way) <= WIDTH).sum(axis=1) >= COLLISIONS).mean()
    print(f"recall at the limit {found:.5f}, unrelated pairs verified {wrong:.4f}")
    assert found >= 0.999 and wrong < 0.05


def test_vectors_of_repeated_ids(spark):
    from stratavox.llm.vectors import near_vectors

    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    data = [(2, a), (2, a), (2, b), (1, b), (3, c), (3, None), (3, None), (None, a), (None, a)]
    df = spark.createDataFrame([(*r, 1) for r in data], "vec_id long, embedding array<double>, label int")
    got = collections.Counter(tuple(r) for r in near_vectors(df).collect())
    assert got == {(2, 1, 2, True): 2, (2, 1, 1, False): 1, (1, 1, 1, True): 1, (3, 0, 3, True): 3, (None, 0, None, True): 2}


def test_sharding(docs, empty):
    from stratavox.llm.sharding import hilbert_index, hilbert_shards

    got = hilbert_shards(docs).collect()
    texts = texts_of(docs)
    per = collections.defaultdict(list)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        per[r.shard].append(r.slot)
    assert len(got) == len(texts) and set(per) == set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in per.values())
    assert max(map(len, per.values())) - min(map(len, per.values())) <= 1
    assert hilbert_shards(empty).count() == 0
    cells = sorted((hilbert_index((a, b, c), 2), (a, b, c)) for a in range(4) for b in range(4) for c in range(4))
    assert [i for i, _ in cells] == list(range(64))
    assert all(sum(abs(p - q) for p, q in zip(a, b)) == 1 for (_, a), (_, b) in zip(cells, cells[1:]))


def test_chat(spark):
    from stratavox.llm.chat import format_chats

    call = lambda i, name, **a: {"id": i, "name": name, "arguments": a}
    m = [
        (1, 0, "user", "hé \"there\"\n"),
        (1, 1, "assistant", json.dumps({"content": "ok", "tool_calls": [call("b", "fetch", url={"$result": "a"}), call("a", "search", query="x", limit=2)]})),
        (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": {"z": 1, "a": 2}})),
        (1, 3, "tool", json.dumps({"tool_call_id": "b", "content": "y"})),
        (1, 4, "tool", json.dumps({"tool_call_id": "zz", "content": "y"})),
        (1, 5, "tool", json.dumps({"tool_call_id": "a", "content": "again"})),
        (2, 0, "tool", json.dumps({"tool_call_id": "q", "content": 1})),
        (2, 1, "assistant", json.dumps({"tool_calls": [call("q", "search", query=5), call("r", "nope"), call("s", "search")]})),
        (3, 0, "assistant", json.dumps({"tool_calls": [call("p", "fetch", url={"$result": "o"}), call("o", "fetch", url={"$result": "p"})]})),
        (3, 1, "tool", json.dumps({"tool_call_id": "p", "content": 1})),
        (3, 2, "tool", json.dumps({"tool_call_id": "o", "content": 1})),
        (4, 0, None, None),
        (4, 1, "assistant", "{broken"),
        (None, None, "tool", json.dumps({"tool_call_id": "a", "content": "lost"})),
    ]
    df = spark.createDataFrame([(*x, "clash") for x in m], "conv_id long, turn long, role string, text string, status string")
    got = format_chats(df).collect()
    by = {(r.conv_id, r.turn, r.kind, r.call_id): r for r in got}
    assert by[1, 0, "message", None].json == '{"content":"hé \\"there\\"\\n","role":"user"}'
    a, b = by[1, 1, "call", "a"], by[1, 1, "call", "b"]
    ra, rb = by[1, 2, "result", "a"], by[1, 3, "result", "b"]
    assert [x.status for x in (a, b, ra, rb)] == ["linked"] * 4 and a.valid and b.valid
    order = [(x.order_turn, x.depth) for x in (a, ra, b, rb)]
    assert order == sorted(order) and len(set(order)) == 4
    assert ra.json == '{"content":{"a":2,"z":1},"role":"tool","tool_call_id":"a"}'
    assert by[1, 4, "result", "zz"].status == "orphan" and by[1, 5, "result", "a"].status == "duplicate"
    assert by[2, 0, "result", "q"].order_turn == 1 and not by[2, 1, "call", "q"].valid
    assert by[2, 1, "call", "r"].status == "orphan" and not by[2, 1, "call", "s"].valid
    assert by[3, 0, "call", "o"].status == by[3, 1, "result", "p"].status == "cycle"
    assert by[4, 0, "message", None].json == '{"content":"","role":"unknown"}' and by[4, 1, "message", None].json == '{"content":"{broken","role":"assistant"}'
    assert by[None, None, "result", "a"].status == "orphan"
    assert len(got) == 19 and format_chats(df.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as cp

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality_classifier", "quality_rules", "minhash_dedup", "substring_dedup", "packing"]
    now, sizes, inputs = docs, [docs.count()], {}
    for name, stage in cp.STAGES[:-1]:
        before, now = now, stage(spark, now, d).cache()
        assert now.columns == docs.columns and now.join(before, "doc_id", "left_anti").count() == 0
        sizes.append(now.count())
        inputs[name] = (before, {r.doc_id: r.text for r in now.collect()})
    # the second stage against the rules in SQL, the third against all pairs, each on its own input
    import duckdb

    from stratavox.llm.quality_rules import OP2_SQL

    db = duckdb.connect()
    db.register("documents", inputs["quality_rules"][0].toArrow())
    judged = {i: (kept, failed) for i, kept, failed in db.sql(f"SELECT doc_id, kept, n_failed_lines FROM ({OP2_SQL})").fetchall()}
    kept = inputs["quality_rules"][1]
    assert set(kept) == {i for i, (k, _) in judged.items() if k} and len(kept) < len(judged)
    source = texts_of(inputs["quality_rules"][0])
    assert all((t == source[i]) == (judged[i][1] == 0) for i, t in kept.items())
    near = near_brute(texts_of(inputs["minhash_dedup"][0]))
    assert set(inputs["minhash_dedup"][1]) == {i for i, (_, root) in near.items() if i == root}
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] == sizes[4] > 0
    texts = {r.doc_id: r.text for r in now.collect()}
    assert check_packing(cp.STAGES[-1][1](spark, now, d).collect(), now) < 0.05
    # the fourth stage against brute force on its own input
    want = substring_brute({r.doc_id: r.text for r in before.collect()}, 35)
    for i, t in texts.items():
        assert len(WORD.findall(t)) == want[i][0] - want[i][1]


def test_near_stage_keeps_one_row_of_a_group(spark):
    import corpus_pipeline as cp

    t, u, v = passage(1, 40), passage(2, 40), passage(3, 40)
    data = [(5, t), (3, t), (3, t), (3, t), (4, u), (4, v), (None, t), (None, "a"), (None, None)]
    df = spark.createDataFrame([(*r, "en", "s", 1) for r in data], "doc_id long, text string, lang string, source string, n_chars long")
    got = cp.near(spark, df, "")
    assert got.columns == cp.COLUMNS
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, [(3, t), (4, u), (4, v), *data[6:]]))


def test_pipeline_takes_empty_input(spark, tmp_path):
    import corpus_pipeline as cp

    d = "/root/testdata/sf0.001"
    now = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        now = stage(spark, now, d)
    assert now.count() == 0


def test_suffix_dedup_of_a_large_group(spark, monkeypatch):
    """One passage in many different surroundings, compared window by window, and a small one beside it."""
    from stratavox.llm import suffixes

    monkeypatch.setattr(suffixes, "BLOCK", 40)
    r, core = random.Random(6), passage(31, 40)
    data = [(i, passage(1000 + i, 5) + " " + core[r.randrange(20) : len(core) - r.randrange(20)] + " " + passage(2000 + i, 5)) for i in range(150)]
    got = rows(suffixes.suffix_dedup(spark.createDataFrame(data, "doc_id long, text string"), digest=True))
    assert {i: (g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) for i, g in got.items()} == suffix_brute(dict(data))


def test_substring_of_periodic_texts(spark):
    """Words said a thousand times, in and across documents."""
    from stratavox.llm.substring import anchors, substring_dedup, within

    data = [(0, "the " * 900), (1, passage(3, 50) + " the" * 300), (2, "a b c " * 200), (3, "x " * 34), (4, "y " * 36), (5, passage(4, 60) + " c a b" * 15)]
    got = rows(substring_dedup(spark.createDataFrame(data, "doc_id long, text string"), digest=True))
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in got.items()} == substring_brute(dict(data), 35)
    h = np.full(1000, 7, np.uint64)
    fp, _, first, last = anchors(h, 35, 10)
    lead, again = within(fp, fp, first, last)
    assert len(lead) == 1 and again == [[{"a": 1, "b": 965}]]


def test_dedup_of_other_texts_under_one_id(spark):
    """Ids that repeat with other texts, with equal ones, and null: no crash, no lost row."""
    from stratavox.llm.substring import substring_dedup
    from stratavox.llm.suffixes import suffix_dedup

    shared = passage(40, 50)
    texts = [(1, passage(41, 30) + " " + shared), (1, shared + " " + passage(42, 30)), (1, shared + " " + passage(42, 30)), (2, passage(43, 20) + " " + shared), (1, None), (1, ""), (None, shared), (3, passage(44, 60)), (2, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    own = {t: k for k, (i, t) in enumerate(texts) if i is not None}  # one number a document
    want = substring_brute({k: t for t, k in own.items()}, 35)
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(df, digest=True).collect())
    plain = lambda t: (len(WORD.findall(t or "")), 0, hashlib.sha256(" ".join(WORD.findall(t or "")).encode()).hexdigest())
    assert got == collections.Counter((i, *(want[own[t]] if i is not None else plain(t))) for i, t in texts)
    assert sum(n for _, _, n, _ in got) > 100
    kept = [(r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup(df).collect()]
    assert sorted((str(i), n) for i, n, _ in kept) == sorted((str(i), len((t or "").encode())) for i, t in texts)
    # the shared passage stays in one of the four documents that have it
    whole = [n for i, n, gone in kept if i is not None and n > 200 and not gone]
    assert len(whole) in (2, 3) and all(gone == 0 for i, _, gone in kept if i in (None, 3))
    first = [gone for i, n, gone in kept if i == 2 and n]
    assert first[0] >= len(shared)


def test_repeats_stream_equals_groups(spark):
    """The stream of sorted rows settles a fingerprint whatever batches it comes in."""
    from stratavox.llm.suffixes import repeats

    r = random.Random(3)
    data = [(r.randrange(12), r.randrange(3), r.randrange(6), 0, r.randrange(4), 0, 0, 0) for _ in range(150)]
    df = spark.createDataFrame(data, "fp long, around long, id long, tag long, first int, last int, place int, salt int")
    groups = collections.defaultdict(lambda: collections.defaultdict(set))
    for fp, around, i, _, first, *_ in data:
        groups[fp][around].add((i, first))
    want = collections.Counter()
    for fp, kinds in groups.items():
        for around, places in kinds.items():
            for n, place in enumerate(sorted(places)):
                if n or len(kinds) > 1:
                    want[fp, around, *place, n == 0] += 1
    for size in (1, 3, 1000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = collections.Counter((x.fp, x.around, x.id, x.first, x.open) for x in repeats(df).collect())
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == want


def test_kept_columns_that_clash(spark):
    """Kept columns keep their values beside working columns; one named like a result gives way."""
    from stratavox.llm.classifier import score, train
    from stratavox.llm.quality_rules import quality_rules
    from stratavox.llm.substring import substring_dedup

    names = ["_t", "_w", "_l", "_n", "_k", "_s", "_p", "_j", "_row", "score", "n_words", "spans", "id", "tag", "a b"]
    df = spark.createDataFrame([(1, passage(1, 60), *range(len(names))), (1, passage(1, 60), *range(len(names))), (None, None, *range(len(names)))], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    model = train(df, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    for got, taken in ((quality_rules(df, keep=names), {"n_words"}), (score(df, model, keep=names), {"score"}), (substring_dedup(df, keep=names), {"n_words"})):
        assert len(got.columns) == len(set(got.columns)) and got.count() == 3
        for r in got.collect():
            assert all(r[n] == k for k, n in enumerate(names) if n not in taken)


def test_slices_are_bounded():
    import pyarrow as pa

    from stratavox.llm.common import SLICE, SLICE_BYTES, slices

    batch = pa.RecordBatch.from_arrays([pa.array(["x" * (3 << 20)] * 20 + ["y"] * 2500 + ["z" * (40 << 20)])], ["t"])
    parts = list(slices(batch))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert all(p.num_rows <= SLICE and (p.num_rows == 1 or p.nbytes <= SLICE_BYTES) for p in parts)


def test_training_of_repeated_ids(spark):
    """Documents that repeat an id are one row of the sample, and runs give one model."""
    from stratavox.llm.classifier import train

    docs = [(i, passage(i, 30) + (" good" if i % 2 else " bad!!")) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    once = train(spark.createDataFrame(docs, "doc_id long, text string"), labels)
    again = train(spark.createDataFrame(docs * 3, "doc_id long, text string"), labels)
    assert np.array_equal(once[0], again[0]) and once[1] == again[1] and once[0].any()


def test_posting_lists_count_a_pair_once():
    """A list counts only pairs that no earlier coordinate posts; all lists together find all."""
    from stratavox.llm.minhash import COORDINATES, MATCHES, PREFIX, _forest_of_list

    r = np.random.default_rng(3)
    base = r.integers(0, 256, COORDINATES).astype("u1")
    sig = np.tile(base, (40, 1))
    for k in range(40):
        change = r.random(COORDINATES) < 0.3 * (k % 4)
        sig[k, change] = r.integers(0, 256, change.sum())
    code = sig[:, :PREFIX].astype(np.uint32)
    label, pairs = np.arange(40), 0
    for c in range(PREFIX):
        for v in np.unique(code[:, c]):
            on = np.flatnonzero(code[:, c] == v)
            links = _forest_of_list(on, sig[on], code[on], c) if len(on) > 1 else []
            pairs += len(links)
            for a, b in links:
                assert (code[a, :c] != code[b, :c]).all() and (sig[a] == sig[b]).sum() >= MATCHES
                label[label == label[b]] = label[a]
    near = (sig[:, None] == sig[None]).sum(2) >= MATCHES
    near &= (code[:, None] == code[None]).any(2)
    want = np.arange(40)
    for a, b in zip(*np.nonzero(near)):
        want[want == want[b]] = want[a]
    assert pairs and ((label[:, None] == label) == (want[:, None] == want)).all()


@pytest.fixture(scope="module")
def odd(spark):
    """Rows that repeat, ids with several texts, null ids, and columns that clash."""
    a, b, c = passage(70, 60), passage(71, 60), passage(72, 45)
    data = [(1, a), (1, a), (1, b), (2, a + " more"), (2, None), (None, a), (None, None), (None, a), (3, ""), (3, ""), (4, c + " " + passage(73, 20)), (4, passage(74, 20) + " " + c), (5, "one two")]
    return spark.createDataFrame([(*r, "en", None, 7, "x", 1, 2.0) for r in data], "doc_id long, text string, lang string, source string, n_chars long, id string, tag long, score double")


def many(df, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_odd_rows_row_by_row(odd):
    """Operators on single rows: every row comes back once, with its own result."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from stratavox.llm.bpe import bpe_round_trip
    from stratavox.llm.classifier import score, train
    from stratavox.llm.quality_rules import quality_rules
    from stratavox.llm.sharding import hilbert_shards

    data = [(r.doc_id, r.text) for r in odd.collect()]
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert many(bpe_round_trip(odd, digest=True), "doc_id", "n_tokens") == collections.Counter((i, len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in data)
    assert many(quality_rules(odd), "doc_id", "n_words") == collections.Counter((i, len(WORD.findall(t or ""))) for i, t in data)
    labels = odd.sparkSession.createDataFrame([(1, 1), (1, 0), (4, 0), (None, 1)], "doc_id long, quality int")
    scored = collections.defaultdict(set)
    for r in score(odd, train(odd, labels), keep=["text"]).collect():
        scored[r.text].add(r.score)
    assert set(scored) == {t for _, t in data} and all(len(s) == 1 for s in scored.values())
    got = hilbert_shards(odd).collect()
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in data)
    assert len({(r.shard, r.slot) for r in got}) == len(data)


def test_odd_rows_in_near_duplicates(odd):
    from stratavox.llm.minhash import near_duplicates

    data = [(r.doc_id, r.text) for r in odd.collect()]
    texts = {k: t for k, (i, t) in enumerate(data)}
    rank = sorted(range(len(data)), key=lambda k: (data[k][0] is None, data[k][0] or 0))
    brute = near_brute({n: texts[k] for n, k in enumerate(rank)})
    want = collections.Counter()
    for n, k in enumerate(rank):
        i = data[k][0]
        root = i if i is None else data[rank[brute[n][1]]][0]
        want[i, brute[n][0], root, i == root] += 1
    assert many(near_duplicates(odd), "doc_id", "n_shingles", "component_id", "kept") == want
    assert want[2, brute[rank.index(3)][0], 1, False] == 1


def test_odd_rows_in_packing(odd):
    from stratavox.llm.packing import TokenIds, pack

    data = [(r.doc_id, r.text) for r in odd.collect()]
    ids = [x.tolist() + [0] for x in TokenIds("byte_bpe_50k.json")([t for _, t in data])]
    got = pack(odd, capacity=64).collect()
    whole = collections.Counter((r.doc_id, r.doc_tokens) for r in got if r.start == 0)
    assert whole == collections.Counter((i, len(x)) for (i, _), x in zip(data, ids))
    assert sum(r.length for r in got) == sum(map(len, ids))
    used = collections.Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used[r.sequence_id] and zlib.crc32(r.ids) == r.ids_crc32
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 64


def test_odd_rows_in_conversations(spark):
    from stratavox.llm.chat import format_chats

    call = json.dumps({"tool_calls": [{"id": None, "name": "fetch", "arguments": {"url": "u"}}, {"name": "fetch", "arguments": {"url": "v"}}]})
    m = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "user", "b"), (None, 0, "user", "a"), (None, None, None, None), (2, 0, "assistant", call), (2, 1, "tool", json.dumps({"tool_call_id": "q"})), (2, 1, "tool", json.dumps({"tool_call_id": "q"}))]
    got = format_chats(spark.createDataFrame(m, "conv_id long, turn long, role string, text string")).collect()
    assert collections.Counter((r.conv_id, r.turn, r.kind) for r in got) == {(1, 0, "message"): 3, (None, 0, "message"): 1, (None, None, "message"): 1, (2, 0, "call"): 2, (2, 1, "result"): 2}
    assert {r.status for r in got if r.kind == "call"} == {"orphan"} and all(r.valid for r in got if r.kind == "call")


def test_odd_rows_in_every_stage(spark, odd, tmp_path):
    import corpus_pipeline as cp

    docs = odd.select(*cp.COLUMNS)
    for name, stage in cp.STAGES[1:-1]:
        got = stage(spark, docs, "")
        assert got.columns == cp.COLUMNS
        before, after = many(docs, "doc_id"), many(got, "doc_id")
        assert all(after[k] <= before[k] for k in after), name
        if name == "substring_dedup":
            assert before == after
    odd.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    assert many(cp.classify(spark, docs, str(tmp_path)), "doc_id", "text") == many(docs, "doc_id", "text")
    assert cp.packing(spark, docs, "").filter("start = 0").count() == docs.count()


def test_scores_equal_a_plain_dot_product(spark):
    """Training and scoring against dictionaries: the same n-grams, the same updates."""
    import math

    from stratavox.llm import classifier as c

    texts = [passage(k, 12) + (" fine." if k % 2 else " BUY!!! 99$") for k in range(30)]
    rows = [(*np.unique(c.features(t), return_counts=True), k % 2) for k, t in enumerate(texts)]
    rows = [(i, (c.SCALE * n / n.sum()).astype("f4"), y) for i, n, y in rows]
    w, bias = c.ftrl(rows, epochs=2)
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        return 0.0 if abs(z[i]) <= c.L1 else -(z[i] - math.copysign(c.L1, z[i])) / ((c.BETA + math.sqrt(n[i])) / c.ALPHA + c.L2)

    for _ in range(2):
        for index, value, y in rows:
            x = {**dict(zip(index.tolist(), map(float, value))), "bias": 1.0}
            own = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(own[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                s = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / c.ALPHA
                z[i] += g - s * own[i]
                n[i] += g * g
    assert bias == pytest.approx(weight("bias"), abs=1e-9)
    used = np.flatnonzero(w)
    assert len(used) > 100 and all(w[i] == pytest.approx(weight(int(i)), rel=1e-5, abs=1e-9) for i in used)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(99, None)], "doc_id long, text string")
    got = rows_by = {r.doc_id: r.score for r in c.score(df, (w, bias)).collect()}
    for k, (i, v, _) in enumerate(rows):
        assert rows_by[k] == pytest.approx(1 / (1 + math.exp(-(bias + float(w[i].astype("f8") @ v)))), abs=1e-6)
    assert got[99] == pytest.approx(1 / (1 + math.exp(-bias)), abs=1e-9)


def test_shards_are_runs_of_the_curve(docs):
    """Shards follow the curve's cells, worked out here by walking the curve; cells are cut
    at shard borders only, and equal texts with equal metadata share a cell."""
    from stratavox.llm.sharding import BITS, hilbert_index, hilbert_shards

    code = lambda v: zlib.crc32((v or "").encode()) % (1 << BITS)
    cell = {r.doc_id: (min(int(np.log2(len((r.text or "").encode()) + 1)), (1 << BITS) - 1), code(r.lang), code(r.source)) for r in docs.collect()}
    place = {hilbert_index(p, BITS): p for p in {(a, b, c) for a in range(16) for b in range(16) for c in range(16)}}
    assert sorted(place) == list(range(4096))
    got = sorted(hilbert_shards(docs).collect(), key=lambda r: (r.shard, r.slot))
    along = [r.curve for r in got]
    assert along == sorted(along) and all(place[r.curve] == cell[r.doc_id] for r in got)


def test_very_long_texts(spark):
    """Texts of some 600 kB, one without any break, beside short ones: whole results."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from stratavox.llm.bpe import bpe_round_trip
    from stratavox.llm.classifier import score, train
    from stratavox.llm.minhash import near_duplicates
    from stratavox.llm.packing import TokenIds, pack
    from stratavox.llm.quality_rules import quality_rules
    from stratavox.llm.sharding import hilbert_shards
    from stratavox.llm.substring import substring_dedup
    from stratavox.llm.suffixes import suffix_dedup

    long = passage(80, 110_000) + "\n" + passage(81, 200)
    texts = {1: long, 2: "ab" * 300_000, 3: passage(81, 200), 4: "short", 5: long[: len(long) // 2]}
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = rows(bpe_round_trip(df, digest=True))
    for i, t in texts.items():
        ids = lib.encode(t, add_special_tokens=False).ids
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    measured = rows(quality_rules(df))
    assert {i: (r.n_words, r.word_chars) for i, r in measured.items()} == {i: (len(w := t.split()), sum(map(len, w))) for i, t in texts.items()}
    model = train(df, spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, quality int"))
    assert score(df, model).filter("score between 0 and 1").count() == len(texts)
    got = rows(suffix_dedup(df, digest=True))
    # the second text repeats itself from its third byte on
    want = suffix_brute({i: t for i, t in texts.items() if i != 2})
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items() if i != 2} == want
    assert (got[2].n_removed, got[2].n_spans, got[2].kept_sha256) == (600_000 - 2, 1, hashlib.sha256(b"ab").hexdigest())
    pieces = pack(df).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    tokens = dict(zip(texts, (len(x) + 1 for x in TokenIds("byte_bpe_50k.json")(list(texts.values())))))
    assert {r.doc_id: (r.n, r.t) for r in pieces} == {i: (n, n) for i, n in tokens.items()}
    got = rows(near_duplicates(df))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == near_brute(texts)
    got = rows(substring_dedup(df, digest=True))
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in got.items()} == substring_brute(texts, 35)
    assert {r.doc_id: r.size for r in hilbert_shards(df).collect()} == {i: len(t) + 1 for i, t in texts.items()}


def test_chat_against_a_plain_walk(spark):
    """Random calls, results, references, duplicates and cycles, conversation by conversation."""
    from stratavox.llm.chat import format_chats

    r, messages = random.Random(12), []
    for conv in range(40):
        ids = [f"c{k}" for k in range(r.randint(1, 5))]
        for turn in range(r.randint(1, 9)):
            if r.random() < 0.5:
                calls = [{"id": r.choice(ids), "name": "fetch", "arguments": {"url": {"$result": r.choice(ids)} if r.random() < 0.5 else "u"}} for _ in range(r.randint(1, 3))]
                messages.append((conv, turn, "assistant", json.dumps({"tool_calls": calls})))
            else:
                messages.append((conv, turn, "tool", json.dumps({"tool_call_id": r.choice(ids), "content": turn})))
    want = {}
    for conv in range(40):
        nodes = []
        for _, turn, role, text in (m for m in messages if m[0] == conv):
            for place, c in enumerate(json.loads(text)["tool_calls"] if role == "assistant" else [json.loads(text)]):
                url = c.get("arguments", {}).get("url")
                nodes.append((turn, place, "call" if role == "assistant" else "result", c.get("id") or c.get("tool_call_id"), url["$result"] if isinstance(url, dict) else None))
        first = {}
        for n in sorted(nodes):
            first.setdefault(n[2:4], n)
        needs = {}
        for n in nodes:
            _, _, kind, i, ref = n
            needs[n] = []
            if kind == "result" and first["result", i] == n and ("call", i) in first:
                needs[n].append(first["call", i])
            if kind == "call" and ref and ("result", ref) in first and ("call", ref) in first:
                needs[n].append(first["result", ref])
        order = {}
        while True:
            fresh = {n: (max([n[0], *(order[m][0] for m in d)]), max([-1, *(order[m][1] for m in d)]) + 1) for n, d in needs.items() if n not in order and all(m in order for m in d)}
            if not fresh:
                break
            order.update(fresh)
        for n in nodes:
            turn, place, kind, i, _ = n
            linked = ("call", i) in first and ("result", i) in first
            status = "duplicate" if first[kind, i] != n else "cycle" if n not in order else "linked" if linked else "orphan"
            want[conv, turn, place] = (kind, i, status, *order.get(n, (turn, -1)))
    got = {(x.conv_id, x.turn, x.place): (x.kind, x.call_id, x.status, x.order_turn, x.depth) for x in format_chats(spark.createDataFrame(messages, "conv_id long, turn long, role string, text string")).collect()}
    assert got == want
    assert {s for _, _, s, _, _ in want.values()} == {"duplicate", "cycle", "linked", "orphan"}
