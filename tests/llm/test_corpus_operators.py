"""The ten operators against plain versions, on rows with nulls, empty and long texts, repeats and clashing columns."""

import hashlib
import re
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import chunking, decontaminate, layouts, lmscore, maincontent, neardup, pieces, substrings, tokencount, tokenstore, toxicity, words
from millrace.llm.components import components
from millrace.llm.queries import tokenizer_file
from millrace.llm.runtime import ship

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, score string, __text string, block int, Text2 string"


def _lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def _texts():
    base = " ".join(f"word{k % 37} x{k}" for k in range(60))
    near = base.replace("x7 ", "y7 ").replace("word5 x5", "word5 X5")
    long = " ".join(f"l{k * k % 9973}" for k in range(60_000))
    return [
        (1, base), (2, base), (3, near), (4, None), (5, ""), (6, "  \n\t "), (7, "one"), (8, "one two"), (9, long), (10, "pre " + base + "\n post"),
        (11, "an idiot said it"), (12, "Élève naïve 日本語 🤗 ▁   x"), (12, "Élève naïve 日本語 🤗 ▁   x"), (None, base), (14, "a" * 3000), (15, "Only here: " + " ".join(f"q{k}" for k in range(40))), (16, long[:5000] + " " + base),
    ]


def _docs(spark, rows=None):
    rows = _texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "en" if i != 8 else None, None, len(t or ""), 5, "s", "clash", 3, "u") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def _bytes(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in raw])]).astype(np.int64)


def test_substrings(spark):
    got = sorted(map(tuple, substrings.remove_repeats(_docs(spark), block_bytes=50_000, range_cells=1 << 12).collect()), key=str)
    first, expected = {}, []
    last = 1 << 62
    rows = sorted(_texts(), key=lambda r: last if r[0] is None else r[0])
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), last if i is None else i)
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < (last if i is None else i):
                gone[k : k + 13] = [True] * 13
        expected.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    assert got == sorted(expected, key=str)


def _components(rows, n, percent):
    """Number of shingles of each row, and the smallest id that each id reaches over links and shared ids."""
    sets = []
    for _, t in rows:
        w = WORD.findall(_lower(t))
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    up = {i: i for i, _ in rows if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, (a, _) in zip(sets, rows, strict=True):
        for y, (b, _) in zip(sets, rows, strict=True):
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((root(a), root(b)))
                up[hi] = lo
    return [len(x) for x in sets], {i: root(i) for i in up}


def _same_groups(spark, rows, n, percent, size=4_000_000):
    got = sorted(map(tuple, neardup.near_duplicates(_docs(spark, rows), n, percent, task_shingles=size).collect()), key=str)
    sizes, of = _components(rows, n, percent)
    assert got == sorted([(i, k, of.get(i), i is None or of[i] == i) for (i, _), k in zip(rows, sizes, strict=True)], key=str)


@pytest.mark.parametrize("n, percent, size", [(3, 85, 4_000_000), (5, 80, 100)])
def test_near_duplicates(spark, n, percent, size):
    _same_groups(spark, _texts(), n, percent, size)


def _edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randint(len(out))] = f"e{rng.randint(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("size", [4_000_000, 3000])
def test_near_duplicates_with_repeated_ids(spark, size):
    """Different texts under one id are one node; near copies, chains of them and documents of one template beside them."""
    rng = np.random.RandomState(11)
    base = [[f"b{k}w{j}" for j in range(80)] for k in range(4)]
    rows = [(k, _edited(rng, base[k % 4], rng.randint(0, 4))) for k in range(60)]
    step = base[0]
    for k in range(12):
        step = _edited(rng, step, 2).split(" ")
        rows.append((100 + k, " ".join(step)))
    rows += [(200 + k, " ".join([*base[1][:60], *(f"own{k}x{j}" for j in range(20))])) for k in range(40)]
    x, y, z = (" ".join(f"{c}{k}" for k in range(40)) for c in "xyz")
    rows += [(505, x), (505, y), (503, x), (509, y), (509, ""), (509, None), (507, z), (507, z), (505, x), (505, x), (506, "alone " + z[:40]), (506, "   ")]
    _same_groups(spark, rows, 3, 85, size)


def test_near_duplicates_by_row_lose_no_text(spark):
    x, y = (" ".join(f"{c}{k}" for k in range(40)) for c in "xy")
    rows = [(5, x), (5, y), (3, x), (9, y), (3, x), (None, y), (4, None)]
    got = neardup.near_duplicates(_docs(spark, rows), by_row=True).where("kept").select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(3, 3), (3, 3), (5, 5), (None, None), (4, 4)], key=str)


def test_many_documents_of_one_template_are_not_paired():
    """Their leading shingles are their own: one task looks at thousands without comparing them."""
    texts = [" ".join([*(f"t{j}" for j in range(40)), *(f"own{k}x{j}" for j in range(12))]) for k in range(6000)] + ["four words of one"] * 2
    texts += [f"a{k} b c d e f" for k in range(6000)]
    data, offsets = _bytes(texts)
    found = neardup._links(np.arange(len(texts)), data, offsets, np.zeros(len(texts), np.int64), 3, 85)
    assert [sorted(x) for x in found] == [[6000, 6001]]


def test_chunks_for_a_miss_under_one_in_a_million():
    for percent in (50, 80, 85, 95, 100):
        j = percent / 100
        assert (1 - (j**6 + 6 * j**5 * (1 - j))) ** neardup.chunks_for(percent) <= 1e-6


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**63 - 1), max_size=40))
def test_sorted_numbers_come_back(numbers):
    keys = np.unique(np.array(numbers, np.int64))
    back, end = words.unpack_sorted(words.pack_sorted(keys) + b"more")
    assert back.tolist() == keys.tolist() and words.pack_sorted(keys)[end:] == b""


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 300)] + [(1000, 1001), (1002, 1001), (7, 7), (1001, 1000)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect())
    assert got == {**dict.fromkeys(range(301), 0), 1000: 1000, 1001: 1000, 1002: 1000}


def test_sentencepiece(spark):
    import sentencepiece

    raw = tokenizer_file("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
    got = sorted(map(tuple, pieces.encode(_docs(spark), raw).collect()), key=str)
    assert got == sorted([(i, sp.encode(t or ""), sp.decode(sp.encode(t or ""))) for i, t in _texts()], key=str)


_MODEL = {}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab er tin\n▁é日🤗.1 \t\x00"), max_size=300), min_size=1, max_size=4))
def test_sentencepiece_like_the_library(texts):
    import sentencepiece

    if not _MODEL:
        raw = tokenizer_file("piece_bpe_32k.model")
        _MODEL["m"], _MODEL["sp"] = pieces.Pieces(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    m, sp = _MODEL["m"], _MODEL["sp"]
    ids, at = m.encode(*_bytes(texts))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == sp.encode(texts)
    assert [x.decode() for x in m.decode(ids, at)] == [sp.decode(sp.encode(t)) for t in texts]


def test_long_units_like_the_library():
    """Texts without spaces merge in rounds of many places; ids are the library's, and rounds are few."""
    import sentencepiece

    raw = tokenizer_file("piece_bpe_32k.model")
    m, sp = pieces.Pieces(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    rng = np.random.RandomState(5)
    texts = ["a" * 4001, "ab" * 1500, "the" * 900, "日本語" * 700]
    for alphabet in ("ab", "etaoin", "thein", "abcdefghijklmnopqrstuvwxyz", "日本語のはを", "aé日🤗"):
        texts += ["".join(rng.choice(list(alphabet), n)) for n in (97, 150, 1000, 3000)]
    words = "".join(rng.choice(["international", "ization", "there", "fore", "ing", "er"], 800))
    ids, at = m.encode(*_bytes([*texts, words]))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == sp.encode([*texts, words])


def test_token_store(spark):
    from tokenizers import Tokenizer

    raw = tokenizer_file("byte_bpe_50k.json")
    tk = Tokenizer.from_buffer(raw)
    docs = _docs(spark)
    folder = tokenstore.store_folder(docs)
    manifest = tokenstore.write_shards(docs, raw, folder, shard_bytes=100_000)
    got = [tuple(r) for r in tokenstore.read_shards(manifest, folder).orderBy("start").collect()]
    expected, start = [], 0
    for i, t in sorted(_texts(), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        expected.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == expected
    shards = [tokenstore.Shard(folder, r["name"]) for r in manifest.collect()]
    for key, text in ((3, _texts()[2][1]), (7, "one")):
        assert [f.tolist() for s in shards for f in s.get(key)] == [[*tk.encode(text, add_special_tokens=False).ids, 0]]
    twice = [f.tolist() for s in shards for f in s.get(12)]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert all(s.get(99_999) == [] for s in shards)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab't sll\n\t é日🤗.,1\xa0\x1c\x85<|>"), max_size=60), min_size=1, max_size=4))
def test_token_units_like_the_library(texts):
    from tokenizers import Tokenizer

    if "e" not in _MODEL:
        raw = tokenizer_file("byte_bpe_50k.json")
        _MODEL["e"], _MODEL["tk"] = tokenstore.Encoder(raw), Tokenizer.from_buffer(raw)
    texts = [*texts, "x<|endoftext|>y"]
    for own in ([texts[0]], texts):
        ids, at = _MODEL["e"].encode(*_bytes(own), 0)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [[*_MODEL["tk"].encode(t, add_special_tokens=False).ids, 0] for t in own]


def test_token_units_are_remembered(monkeypatch):
    """A unit of a worker's earlier texts isn't encoded again, also after some hundred thousand others; its ids are the same."""
    encoder = tokenstore.Encoder(tokenizer_file("byte_bpe_50k.json"))
    encode, asked = encoder.units.encode, []
    monkeypatch.setattr(encoder.units, "encode", lambda units: asked.append(len(units)) or encode(units))
    words = [f" x{k * 7919 % 1_000_003}" for k in range(320_000)]
    texts = ["".join(words[k : k + 40_000]) for k in range(0, len(words), 40_000)]
    got = [encoder.encode(*_bytes([t]), 0)[0] for t in texts]
    assert sum(asked) == len(words)
    for t, ids in zip(texts, got, strict=True):
        assert (encoder.encode(*_bytes([t]), 0)[0] == ids).all()
    assert sum(asked) == len(words)


def test_perfect_hash():
    """Each key leads to its documents, one by one and many at once; absent ones to none; a lookup reads little."""
    rng = np.random.RandomState(1)
    keys = np.unique(rng.randint(-(1 << 60), 1 << 60, 20_000))
    count = rng.randint(1, 4, len(keys))
    first = np.cumsum(count) - count + 3
    offsets = np.arange(int(count.sum()) + 4) * 5
    raw = tokenstore.Index.build(keys, first, count, offsets, 3, 4)
    read = []
    index = tokenstore.Index(lambda n, at: read.append(n) or raw[at : at + n])
    assert sorted(index.numbers(keys).tolist()) == list(range(len(keys)))
    assert (index.first_of(keys) == first).all()
    read.clear()
    assert [index.find(int(k)) for k in keys[:300]] == list(zip(first[:300].tolist(), count[:300].tolist(), strict=True))
    assert sum(read) < 300 * 200 and index.ends(3, 5).tolist() == [15, 20, 25]
    absent = rng.randint(1 << 61, 1 << 62, 3000)
    assert (index.first_of(absent) == -1).all() and {index.find(int(k)) for k in absent[:300]} == {(-1, 0)}
    none = tokenstore.Index.build(keys[:0], keys[:0], keys[:0], np.zeros(1, np.int64), 0, 2)
    assert tokenstore.Index(lambda n, at: none[at : at + n]).find(5) == (-1, 0)


def test_token_store_reads_stretches(spark, monkeypatch):
    """Runs of equal keys and null ones over the ends of stretches."""
    monkeypatch.setattr(tokenstore, "STRETCH", 4)
    monkeypatch.setattr(tokenstore, "STRETCH_IDS", 3)
    rows = [(None, "a b")] * 6 + [(0, f"zero {k}") for k in range(7)] + [(k // 3, f"t {k}") for k in range(5, 20)] + [(-5, None)]
    folder = tokenstore.store_folder(_docs(spark, rows))
    manifest = tokenstore.write_shards(_docs(spark, rows), tokenizer_file("byte_bpe_50k.json"), folder)
    got = []
    for r in manifest.collect():
        for keys, null, ends, ids in tokenstore.Shard(folder, r["name"], whole=True).documents():
            assert ids[ends[1:] - ends[0] - 1].tolist() == [0] * len(keys)
            got += [None if n else int(k) for k, n in zip(keys, null, strict=True)]
    assert got == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))


def test_token_counts(spark):
    raw = tokenizer_file("piece_bpe_32k.model")
    vocabulary = set(tokencount.vocabulary_of(raw)) | {bytes([b]) for b in range(256)}
    longest = max(map(len, vocabulary))

    def plain(t):
        n = 0
        for unit in re.findall("▁+[^▁]*", (" " + t).replace(" ", "▁")) if t else []:
            b, k = unit.encode(), 0
            while k < len(b):
                k += next(m for m in range(min(longest, len(b) - k), 0, -1) if b[k : k + m] in vocabulary)
                n += 1
        return n

    got = sorted(map(tuple, tokencount.token_counts(_docs(spark), raw).collect()), key=str)
    assert got == sorted([(i, len((t or "").encode()), plain(t or "")) for i, t in _texts()], key=str)


def _plain_chunks(text):
    """Chunks by a hash of the last eight bytes at each place, straight from the definition."""
    raw, out, last = text.encode(), [], 0
    for k in range(len(raw)):
        h = sum(int(chunking.GEAR[raw[k - j]]) << j for j in range(min(8, k + 1))) % (1 << 32)
        n = k + 1 - last
        if (n >= 8 and h < 1 << 26) or (n >= 32 and h < 1 << 28) or n == 128 or k + 1 == len(raw):
            out.append(raw[last : k + 1])
            last = k + 1
    return Counter(out)


def _plain_containment(a, b):
    total = sum(len(c) * n for c, n in a.items())
    if a == b:
        return 1.0
    return sum(len(c) * min(n, b[c]) for c, n in a.items()) / total if total else 0.0


def _plain_compare(rows):
    """The rows of compare_with_next as (id, n_chars, edited_sha256, near_edited, near_next), without its code."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    out = []
    for k, (i, t, _) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        n = len(t) // 4
        e = t[: len(t) - n] + following[:n]
        a = _plain_chunks(t)
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), round(_plain_containment(a, _plain_chunks(e)), 9), round(_plain_containment(a, _plain_chunks(following)), 9)))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [4 << 20, 2000])
def test_fingerprints(spark, size):
    rng = np.random.RandomState(8)
    rows = [(i, (t or "")[:20_000]) for i, t in _texts()] + [(int(i), " ".join(rng.choice(["aé", "b", "cc", "日本", "x y"], 60))) for i in [2**62, -7, 40, 41, 41, 41, 42]]
    rows += [(None, f"none {k} {'z' * k}") for k in range(5)]
    docs = _docs(spark, rows)
    tie = {r["text"]: r["h"] for r in docs.select("text", F.expr("xxhash64(text) h")).collect()}
    got = chunking.compare_with_next(docs, part_bytes=size).collect()
    assert sorted([(r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got], key=str) == _plain_compare([(i, t, tie[t]) for i, t in rows])
    of = {}
    for r in got:
        f = chunking.read_hex(r["fingerprint"])
        assert sorted((f & np.uint64(255)).tolist()) == sorted(len(c) for c in _plain_chunks(next(t for i, t in rows if i == r["doc_id"])).elements()) or [x[0] for x in rows].count(r["doc_id"]) > 1
        of.setdefault(r["fingerprint"], set()).add(r["n_chars"])
    assert all(len(n) == 1 for n in of.values()) and 0 in of[""]


def test_parts_are_even_whatever_the_ids(spark):
    """A far id, and a third of all rows under one id or none, leave no part long."""
    ids = [*range(600), 2**62, *[-3] * 300, *[None] * 300]
    docs = _docs(spark, [(i, f"text {k} " * 20) for k, i in enumerate(ids)])
    out = chunking.compare_with_next(docs, part_bytes=10_000)
    sizes = [r["count"] for r in out.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()]
    assert sum(sizes) == len(ids) and max(sizes) < len(ids) / 5


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abc é日\n"), max_size=600), min_size=1, max_size=3))
def test_chunks_like_the_definition(texts):
    data, offsets = _bytes(texts)
    ends, counts = chunking.boundaries(data, offsets)
    raw, cuts = data.tobytes(), np.concatenate([[0], np.cumsum(counts)])
    for k, t in enumerate(texts):
        e = [int(offsets[k]), *ends[cuts[k] : cuts[k + 1]].tolist()]
        assert Counter(raw[a:b] for a, b in zip(e, e[1:], strict=False)) == _plain_chunks(t)


def test_chunks_resist_shifts():
    rng = np.random.RandomState(3)
    text = "".join(chr(97 + x) for x in rng.randint(0, 26, 20_000))
    code, at = chunking.chunks(*_bytes([text, "inserted " + text, text[:10_000]]))
    a, b, c = (code[at[k] : at[k + 1]] for k in range(3))
    assert chunking.containment(a, b) > 0.98 and chunking.containment(c, a) > 0.98 and 0.45 < chunking.containment(a, c) < 0.55


def test_lm_scores(spark):
    docs = _docs(spark)
    model = lmscore.learn(docs.where("doc_id < 11"), filter_bits=20)
    got = sorted(map(tuple, lmscore.score(docs, model, block_bytes=50_000).collect()), key=str)
    tokens = {k: [*WORD.findall(_lower(t)), "\n"] for k, (_, t) in enumerate(_texts())}
    train = [k for k, (i, _) in enumerate(_texts()) if i is not None and i < 11]
    one, two = Counter(), Counter()
    for k in train:
        one.update(tokens[k])
        two.update(zip(["\n", *tokens[k]], tokens[k], strict=False))
    n, v = sum(one.values()), len(one)
    weight = 1 - sum(x == 1 for x in two.values()) / two.total()
    assert model.weight == pytest.approx(weight)
    expected = []
    for k, (i, _) in enumerate(_texts()):
        p = np.array([(one[w] + 0.5) / (n + 0.5 * (v + 1)) for w in tokens[k]])
        before = np.array([one[w] for w in ["\n", *tokens[k][:-1]]])
        c = np.array([two[x] for x in zip(["\n", *tokens[k]], tokens[k], strict=False)])
        low = np.array([max([m for m in lmscore._LEAST_COUNT if m <= x], default=0) for x in c.tolist()])
        q = np.where(before > 0, weight * np.minimum(1, low / np.maximum(before, 1)) + (1 - weight) * p, p)
        expected.append((i, len(tokens[k]), sum(w in one for w in tokens[k]), n, np.log10(p).sum(), np.log10(q).sum()))
    for a, b in zip(got, sorted(expected, key=lambda r: str(next(g for g in got if g[:4] == r[:4]))), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4]) and a[5] == pytest.approx(b[5], rel=0.02, abs=0.3)


def test_lm_scores_keep_every_pair(spark):
    """Pairs over what a broadcast may have are asked for by ranges; none is left out."""
    docs = _docs(spark)
    small = lmscore.learn(docs, filter_bits=10)
    whole = lmscore.learn(docs)
    assert small.filter is None and whole.filter is not None
    got = [sorted(map(tuple, lmscore.score(docs, m, block_bytes=20_000).collect()), key=str) for m in (small, whole)]
    assert got[0] == got[1] and any(r[5] > r[4] for r in got[0])


def test_lm_scores_ask_in_the_time_of_tokens():
    """A block's distinct words and pairs are found by sorting, in a small multiple of the CPU time that its tokens take (a hash table: some eleven times)."""
    rng = np.random.RandomState(3)
    texts = [" ".join(f"w{x}" for x in rng.randint(0, 1 << 16, 100_000)) for _ in range(15)]
    block = pa.table([pa.array(texts), pa.array([2] * len(texts), pa.int32())], names=["__text", "__block"])

    def least(f):
        took = []
        for _ in range(3):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    ask = lmscore._ask(3, True)
    assert least(lambda: ask(block)) < 4 * least(lambda: lmscore._block_tokens(block))
    tokens, _ = lmscore._block_tokens(block)
    rows = ask(block).to_pylist()
    assert len(rows) == 16 and {r["__block"] for r in rows} == {2}
    for kind, keys in ((lmscore.WORDS, tokens), (lmscore.PAIRS, lmscore._pairs(tokens))):
        keys = np.array(sorted(set(keys.tolist())), np.uint64)
        for r in (r for r in rows if r["__kind"] == kind):
            own = keys[keys >> np.uint64(61) == r["__range"]]
            assert (words.unpack_sorted(r["__payload"])[0] == lmscore._short(own, 3, kind)).all()


def test_bloom_never_underestimates():
    rng = np.random.RandomState(0)
    pairs = rng.randint(0, 1 << 62, 3000).astype(np.uint64)
    levels = rng.randint(1, 9, 3000)
    short = lmscore._short(pairs, 0)
    f = lmscore.LogBloom(np.frombuffer(lmscore.LogBloom.segment_of(short, levels, 1 << 18, 2), np.uint8), 1 << 18, 0, 2)
    got = f.levels(pairs)
    assert (got[levels >= 2] >= levels[levels >= 2]).all()
    assert (f.levels(rng.randint(0, 1 << 62, 5000).astype(np.uint64)) == 0).mean() > 0.97


def test_decontamination(spark):
    item = " ".join(f"b{k}" for k in range(30))
    texts = [(1, "intro " + item + " outro"), (2, "x " + item.upper().replace(" ", ",  ") + "!!"), (3, item.replace("b3 ", "c ").replace("b9 ", "c ")), (4, item[: len(item) // 2]), (5, None), (6, ""), (7, item), (None, item), (8, "a b c"), (8, "a b c"), (9, "far away words only here and there")]
    bench = spark.createDataFrame([(1, item), (2, "a b c"), (3, None), (4, ""), (None, item)], "item_id long, text string")
    got = {(r[0], r[1]): tuple(r[2:]) for r in decontaminate.contaminated(_docs(spark, texts), bench).collect()}
    assert got == {(1, 1): (1, 30, 1.0), (2, 1): (1, 30, 1.0), (7, 1): (0, 30, 1.0), (8, 2): (0, 3, 1.0)}
    assert not decontaminate.contaminated(_docs(spark, texts), bench.limit(0)).count()
    assert not decontaminate.contaminated(_docs(spark, []), bench).count()


def _similar_windows(texts, items, n=5, least=0.8):
    """The best window of each document and item, over all windows."""
    words = lambda t: [w for w in re.sub(r"[^0-9a-z]+", " ", (t or "").lower()).split(" ") if w]
    best = {}
    for doc, t in texts:
        for item, u in items:
            w, v = words(t), words(u)
            if doc is None or item is None or not v:
                continue
            k = min(n, len(v))
            grams = lambda x: Counter(tuple(x[i : i + k]) for i in range(len(x) - k + 1))  # noqa: E731, B023
            own = grams(v)
            for a in range(max(0, len(w) - len(v)) + 1):
                got = grams(w[a : a + len(v)])
                both = (own & got).total()
                s = both / (own.total() + got.total() - both)
                if s >= least:
                    m = min(len(v), len(w))
                    best[doc, item] = max(best.get((doc, item), (0, 0, 0)), (s, -a, m))
    return {k: (-a, m, s) for k, (s, a, m) in best.items()}


@pytest.mark.parametrize("segment", [4096, 40])
def test_decontamination_like_all_windows(spark, monkeypatch, segment):
    """Reordered halves, changed, left out and put in words, repeated words, equal windows, items of few words, repeated ids, a long text."""
    monkeypatch.setattr(decontaminate, "SEGMENT", segment)
    rng = np.random.RandomState(7)
    word = lambda n, v: [f"w{x}" for x in rng.randint(0, v, n)]
    items = [(k, " ".join(word(n, v))) for k, (n, v) in enumerate([(60, 9999), (30, 9999), (45, 3), (30, 9999), (12, 9999), (5, 9999), (4, 50), (1, 9999), (25, 2)])]
    items += [(20, items[1][1]), (21, None), (22, "?"), (None, items[0][1])]
    texts = []
    for k in range(60):
        w = items[k % 9][1].split(" ")
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(len(w) + 1)
            w = [w[:at] + word(1, 9999) + w[at + 1 :], w[:at] + w[at + 1 :], w[:at] + word(1, 9999) + w[at:]][rng.randint(3)]
        texts.append((k, " ".join(word(rng.randint(0, 20), 9999) + w + word(rng.randint(0, 20), 9999))))
    half = items[0][1].split(" ")
    texts += [(100, " ".join(half[30:] + half[:30])), (101, " ".join([items[1][1]] * 3)), (102, " ".join(word(3000, 9999) + half + word(3000, 3))), (103, None), (103, ""), (7, items[3][1]), (7, items[4][1]), (None, items[1][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r[0], r[1]): tuple(r[2:]) for r in decontaminate.contaminated(_docs(spark, texts), bench).collect()}
    want = _similar_windows(texts, items)
    assert got == want and (100, 0) in got and len(got) > 30


def test_decontamination_of_repeated_shingles(spark):
    """A run of one word that differs at similarity 0.8: as shingles with numbers, the fingerprints stay near."""
    text = lambda k, end: " ".join([*(f"k{k}w{i}" for i in range(148)), *(f"{end}{i}" for i in range(4)), *[end] * 14])
    docs = _docs(spark, [(k, text(k, "y")) for k in range(20)])
    bench = spark.createDataFrame([(k, text(k, "z")) for k in range(20)], "item_id long, text string")
    assert {r[0] for r in decontaminate.contaminated(docs, bench).collect()} == set(range(20))


def test_blocks_find_all_within_the_radius(spark):
    """Fingerprints at random within 31 bits always share an indexed value of some block."""
    rng = np.random.RandomState(1)
    rows = []
    for k in range(300):
        x = rng.randint(0, 2, 128)
        y = x.copy()
        y[rng.choice(128, rng.randint(0, 32), replace=False)] ^= 1
        rows.append((k, *(int(np.packbits(h).view(">i8")[0]) for h in (x[:64], x[64:], y[:64], y[64:]))))
    df = spark.createDataFrame(rows, "id long, a long, b long, c long, d long")
    x = df.select("id", F.inline(decontaminate.blocks("a", "b", decontaminate.ITEM_FLIPS)))
    y = df.select("id", F.inline(decontaminate.blocks("c", "d", decontaminate.WINDOW_FLIPS)))
    assert x.join(y, ["id", "block", "value"]).select("id").distinct().count() == len(rows)


def test_toxicity(spark):
    rng = np.random.RandomState(2)
    plain = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(400):
        w = list(rng.choice(plain, 40))
        if toxic := i % 4 == 0:
            w.insert(rng.randint(40), rng.choice(["idiot", "moron", "lostraei", "lostraun"]))
        rows.append((i, " ".join(w)))
        labels.append((i, toxic * 1))
    labels += [(9999, 1), (None, 0), (3, None)]
    docs = _docs(spark, rows + _texts()[3:6] + [(500, "such a lostrasp " + rows[1][1])])
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learned(docs, table, lmscore.fold("doc_id") != 0)
    got = toxicity.with_scores(docs, model).collect()
    held = [r for r in got if r["doc_id"] is not None and 6 < r["doc_id"] < 400 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got) and len(got) == docs.count()
    assert next(r for r in got if r["doc_id"] == 500)["score"] > 0.5
    # one row of a repeated id, and no more bytes of text than allowed, reach the driver
    many = docs.union(docs.where("doc_id = 4")).union(docs.where("doc_id = 4").withColumn("text", F.expr("repeat(text, 2000)")))
    assert len(toxicity.sample_of(many, table, None, 4000, 1 << 20)) == len(toxicity.sample_of(docs, table, None, 4000, 1 << 20)) == 400
    few = toxicity.sample_of(many, table, None, 4000, 10_000)
    assert 0 < sum(len(r[0].encode()) for r in few) <= 10_000 and {r[2] for r in few} == {0, 1}
    none = toxicity.learned(docs, table.limit(0))
    assert {r["score"] < 0.01 for r in toxicity.with_scores(docs, none).collect()} == {True}


def test_blocks_are_packed_in_little_memory():
    """Packing a block of 6 MB holds the distinct words of its pieces, not a row of features of each of its words."""
    rng = np.random.RandomState(3)
    words = np.array([f"w{k}" for k in range(3000)])
    texts = [" ".join(rng.choice(words, 20_000)) for _ in range(60)]
    k = np.arange(len(texts))
    columns = [k < 0, k.astype(np.int32) * 0, k, k, (k % 2).astype(np.int32), ["en"] * len(k), texts]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["__apart", "__block", "__h", "__v", "__y", "__lang", "__text"])
    (small,) = toxicity._packed(iter([batch.slice(0, 8)]))
    tracemalloc.start()
    (whole,) = toxicity._packed(iter([batch]))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(whole.column("listed")[0].as_py()) == len(small.column("listed")[0].as_py()) == 3000 * 16
    assert peak < 90_000_000


def test_toxicity_learns_from_every_row(spark):
    """A word that only the last of many labelled ids have, by hash, is learned, in one block and in many; rows dealt otherwise give the same model."""
    ids = [r[0] for r in spark.range(6000).orderBy(F.xxhash64("id")).collect()]
    toxic = {i for k, i in enumerate(ids) if k % 4}
    rare = set(ids[-600:])
    rng = np.random.RandomState(6)
    plain = [" ".join(rng.choice([f"w{k}" for k in range(200)], 8)) for _ in ids]
    rows = [(i, f"{plain[k]} {('grobian' if i in rare else 'idiot') if i in toxic else 'said'} {plain[k - 1]}") for k, i in enumerate(ids)]
    docs = _docs(spark, rows + rows[:5])
    table = spark.createDataFrame([(i, int(i in toxic)) for i in ids], "doc_id long, toxic int")
    asked = _docs(spark, [(1, plain[0]), (2, f"{plain[0]} grobian"), (3, f"{plain[1]} idiot")])
    for block_bytes in (toxicity.BLOCK, 50_000):
        model = toxicity.learned(docs, table, block_bytes=block_bytes)
        got = {r["doc_id"]: r["score"] for r in toxicity.with_scores(asked, model).collect()}
        assert got[1] < 0.5 < min(got[2], got[3])
        again = toxicity.learned(docs.repartition(7), table.repartition(2), block_bytes=block_bytes)
        assert (model.table == again.table).all() and (model.out == again.out).all() and (model.threshold, model.by_language) == (again.threshold, again.by_language)
    few = docs.where("doc_id < 40").select("doc_id", "text")
    table = pa.Table.from_pylist([{"__h": i, "__v": 0, "__y": i % 2, "__lang": None, "__text": t, "__apart": False, "__block": 3} for i, t in few.collect()])
    (batch,) = toxicity._packed(b for t in (table.slice(9), table, table.slice(0, 5)) for b in t.to_batches(7))
    texts = {i: t.encode() for i, t in few.collect()}
    data, sizes = b"".join(texts[i] for i in sorted(texts)), [0, *np.cumsum([len(texts[i]) for i in sorted(texts)])]
    want, first = toxicity.features(np.frombuffer(data, np.uint8), np.array(sizes))
    listed, words, own, labels = toxicity._texts_of(batch, 0)
    assert (listed[words] == want).all() and (own == first).all() and labels.tolist() == [i % 2 for i in sorted(texts)]
    for at, (n, y) in zip(toxicity._numbers(batch, "at", 0), toxicity._numbers(batch, "counts", 0, "<f4").reshape(-1, 2), strict=True):
        having = [i % 2 for k, i in enumerate(sorted(texts)) if (want[first[k] : first[k + 1]] == at).any()]
        assert (n, y) == (len(having), sum(having))


def test_toxicity_threshold():
    """The best F1 of all cuts, by counting rows one by one."""
    rng = np.random.RandomState(8)
    for _ in range(50):
        score, toxic = rng.permutation(100)[:12] / 100, rng.randint(0, 4, 12)
        rows = toxic + rng.randint(0, 4, 12) + (toxic == 0)
        toxic[0] = rows[0]

        def f1(t, s=score, y=toxic, n=rows):
            return 2 * y[s >= t].sum() / (n[s >= t].sum() + y.sum())

        assert f1(toxicity.best_threshold(score, toxic, rows)) == pytest.approx(max(f1(t) for t in score))


def test_toxicity_gradient(spark):
    """The largest activations and their places are those of a plain loop."""
    rng = np.random.RandomState(3)
    sizes = [0, 1, 2, 5, 1]
    first = np.concatenate([[0], np.cumsum(sizes)])
    x = rng.normal(size=(int(first[-1]), toxicity.WIDTH)).astype(np.float32)
    filters = [rng.normal(size=(w, toxicity.WIDTH, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS]
    bias = [rng.normal(size=toxicity.FILTERS).astype(np.float32) for _ in toxicity.WIDTHS]
    top, where = toxicity._maxima(x, first, filters, bias, places=True)
    assert (top == toxicity._maxima(x, first, filters, bias)).all()
    for t, n in enumerate(sizes):
        own = x[first[t] : first[t + 1]]
        for k, w in enumerate(toxicity.WIDTHS):
            places = range(max(1, n - w + 1)) if n else ()
            for f in range(toxicity.FILTERS):
                at = [float(bias[k][f] + sum(own[p + j] @ filters[k][j, :, f] for j in range(w) if p + j < n)) for p in places]
                best = max([0.0, *at])
                assert top[t, k * toxicity.FILTERS + f] == pytest.approx(best, abs=1e-4)
                if n >= w and best > 1e-3:
                    assert where[t, k * toxicity.FILTERS + f] == first[t] + int(np.argmax(at))


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><div id="top"><ul class=menu><li><a href=/a>Home</a><li><a href=/b>About</a></ul></div>
<div class="cookie-notice">We use cookies. Accept all of them.</div><!-- no --><div class="post"><h1>Title &amp; more</h1><p>First long paragraph with many words in it, and a <a href=x>link</a>,
going on. It ends<br>here.<p>Short.<div class="ad">Buy now! Great stuff that you need.</div><p>Second long paragraph with more words in it than you would think. Yes.</div>
<section id="comments"><article class=comment><p>Nice post, I did like it a lot, thanks for writing it.</p></article></section><form>Name <button>Send</button></form>
<footer>Copyright 2020 <a href=/i>Imprint</a></footer><script>var t="</p>";</script></body></html>"""


def test_main_text(spark):
    want = "Title & more\nFirst long paragraph with many words in it, and a link, going on. It ends here.\nShort.\nSecond long paragraph with more words in it than you would think. Yes."
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<article>a < b <b>c</b>d\n\te<br>f"), (5, "u", "<p"), (5, "u", "<p"), (None, "u", "<!-- open")], "page_id long, url string, html string")
    got = sorted(map(tuple, maincontent.extract(pages).collect()), key=str)
    assert got == sorted([(1, "u", want, len(want)), (2, None, "", 0), (3, "u", "", 0), (4, "u", "a < b cd e f", 12), (5, "u", "", 0), (5, "u", "", 0), (None, "u", "", 0)], key=str)
    assert not maincontent.extract(pages.limit(0)).count()


PROSE = "<p>First long paragraph with many words in it, going on for quite a while, it ends here.</p><p>Short.</p><p>Second long paragraph with more words in it than you would think. Yes.</p>"


@pytest.mark.parametrize(
    "page",
    ['<body class="has-sidebar">{}', '<body class="no-sidebar single-post">{}', '<body class="page search-enabled"><div>{}</div>', '<div id="top">{}</div>', '<main class="with-comments">{}</main>', '<article><section id="discussion">{}</section></article>',
     '<div class="legal-history">{}</div>', "<form action=/x><nav><a href=/a>Home</a></nav><div>{}</div><input></form>", "<article>{}<footer>About the author here.</footer></article>",
     '<div class="header"><a href=/>Site</a></div><div class=entry>{}</div><div class="sidebar-left"><p>Words about this site that are long enough to look like text.</p></div><div id="comment-list"><div class="comment-body"><p>I liked this post a lot, thanks for it.</p></div></div>'],
)
def test_main_text_of_odd_names(page):
    assert maincontent.main_text(page.format(PROSE)) == re.sub("</?p>", "", PROSE.replace("</p><p>", "\n"))


def test_main_text_keeps_what_is_not_named_boilerplate():
    assert maincontent.main_text(f"<article>{PROSE}<p>Take <math><mi>x</mi></math> now, it is <object>a fallback</object> good.</p></article>").endswith("\nTake x now, it is a fallback good.")
    long = "<div>" * 3000 + "<p>" + "many words in one text " * 20_000 + ".</p>"
    assert len(maincontent.main_text(long)) > 400_000


def test_the_cut_decides():
    """Generated pages that the fit hasn't seen: the flow changes labels, nearly always for the better."""
    w = maincontent.weights()
    alone = cut = changed = total = flows = 0
    real = maincontent._max_flow

    def counted(*args):
        nonlocal flows
        flows += 1
        return real(*args)

    maincontent._max_flow = counted
    try:
        for parts in layouts.pages(200, seed=7):
            blocks = maincontent.blocks_of("".join(h for h, _ in parts))
            label = [y for h, y in parts if y >= 0 for _ in maincontent.blocks_of(h)]
            z, keep = maincontent.log_odds(maincontent.features(blocks), w), maincontent.content(blocks, w)
            assert len(label) == len(blocks)
            total += len(label)
            alone += sum((x > 0) != y for x, y in zip(z, label, strict=True))
            cut += sum(x != y for x, y in zip(keep, label, strict=True))
            changed += sum((x > 0) != k for x, k in zip(z, keep, strict=True))
    finally:
        maincontent._max_flow = real
    assert changed > 0.005 * total and cut < 0.5 * alone and cut < 0.005 * total and flows > 0


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_min_cut_is_minimal(data):
    n = data.draw(st.integers(1, 8))
    cost = st.integers(0, 12)
    good, bad = data.draw(st.lists(cost, min_size=n, max_size=n)), data.draw(st.lists(cost, min_size=n, max_size=n))
    edges = [(i, j, data.draw(st.integers(0, 6))) for i in range(n) for j in range(i) if data.draw(st.booleans())]

    def value(keep):
        return sum(b if k else g for g, b, k in zip(good, bad, keep, strict=True)) + sum(w for i, j, w in edges if keep[i] != keep[j])

    got = maincontent.min_cut([float(x) for x in good], [float(x) for x in bad], [(i, j, float(w)) for i, j, w in edges])
    assert value(got) == min(value([bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))


def test_empty_tables(spark):
    docs = _docs(spark).limit(0)
    raw, model = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
    folder = tokenstore.store_folder(docs)
    frames = [
        substrings.remove_repeats(docs), neardup.near_duplicates(docs), pieces.encode(docs, model), tokencount.token_counts(docs, model), chunking.compare_with_next(docs),
        lmscore.score(docs, lmscore.learn(docs)), tokenstore.read_shards(tokenstore.write_shards(docs, raw, folder), folder),
    ]
    assert [f.count() for f in frames] == [0] * len(frames)
    untrained = lmscore.score(_docs(spark), lmscore.learn(docs)).collect()
    assert {r["base_score"] for r in untrained} == {0.0}


def test_other_columns_may_have_any_name(spark):
    """Names that the operators use inside occur as further columns of their tables, with nulls."""
    names = ["doc", "item", "words", "hash", "pos", "length", "own", "print", "similarity", "item_print", "block", "value", "__id", "__html", "__url", "n_chars", "toxic", "__y", "__h", "__lang", "score"]
    item = " ".join(f"b{k}" for k in range(30))
    docs = spark.createDataFrame([(1, f"x {item} y", "en"), (2, None, None), (3, "plain", "en")], "doc_id long, text string, lang string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    pages = spark.createDataFrame([(1, None, PAGE)], "page_id long, url string, html string")
    for n in names:
        docs, bench = (x if n in x.columns else x.withColumn(n, F.lit(None).cast("string")) for x in (docs, bench))
        pages = pages.withColumn(n, F.lit("clash"))
    pages = pages.withColumn("text", F.lit("clash"))
    assert [tuple(r)[:2] for r in decontaminate.contaminated(docs, bench).collect()] == [(1, 7)]
    row = maincontent.extract(pages).first()
    assert row["url"] is None and row["text"].startswith("Title & more") and row["n_chars"] == len(row["text"])
    labels = spark.createDataFrame([(1, 0), (3, 1)], "doc_id long, toxic int").withColumn("__id", F.lit("clash")).withColumn("text", F.lit("clash"))
    model = toxicity.learned(docs, labels)
    assert toxicity.with_scores(docs, model, carry=["value"]).count() == 3


def test_ties_and_repeats(spark):
    """Repeated rows and equal texts: every row comes back, equal texts alike, the smallest id stays."""
    text = " ".join(f"t{k}" for k in range(30))
    docs = spark.createDataFrame([(3, text), (1, text), (1, text), (2, text), (None, text), (None, text)], "doc_id long, text string")
    near = neardup.near_duplicates(docs).collect()
    assert len(near) == 6 and {r["component_id"] for r in near if r["doc_id"] is not None} == {1}
    cut = substrings.remove_repeats(docs).collect()
    assert len(cut) == 6 and {r["doc_id"]: r["n_removed"] for r in cut} == {1: 0, 2: 30, 3: 30, None: 30}
    prints = chunking.compare_with_next(docs).collect()
    assert len(prints) == 6 and len({r["fingerprint"] for r in prints}) == 1
    assert len({r["score"] for r in lmscore.score(docs, lmscore.learn(docs)).collect()}) == 1
