"""Operators and functions on small fixtures: known values, brute force, round trips, nulls and empty tables."""

import json
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import answers as A
from millrace.functions import metrics as M
from millrace.functions import text as T
from millrace.functions import urls as U
from millrace.operators import contamination as C
from millrace.operators import duplicates as D
from millrace.operators import evaluation as E
from millrace.operators import packing as K
from millrace.operators import retrieval as R
from millrace.operators import samples as S
from millrace.operators.graph import components, shared_folder
from millrace.operators.ranking import ranked, running
from millrace.sources import catalog, files, indexed
from millrace.streaming import windows as W


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_address_verdicts(spark):
    rows = {
        "http://www.youtube.com/watch": "domain", "https://a.b.imgur.com": "domain", "http://x.org/a.7z": "extension", "http://x.org/a.TAR.GZ?x=1": "extension", "http://x": "short",
        "http://no_such host/": "malformed", "https://x.org/a.html?y=.zip": "ok", "http://127.0.0.1:80/x": "ok", "ftp://files.org/x": "malformed", "http://sub.google.org/": "domain",
        "https://www.amazon.co.uk/b": "domain", "http://amazon.com.au/": "domain", "http://flickr.news.org/": "ok", "http://twitter.example.co.uk/": "ok", "https://co.uk/abc": "ok",
    }
    got = spark.createDataFrame([(u,) for u in rows], "u string").select("u", U.verdict(F.col("u"), F.lit(1)).alias("v")).collect()
    assert {r["u"]: r["v"] for r in got} == rows
    assert one(spark, U.verdict(F.lit("http://a.org/"), F.lit(2))) == "duplicate"


def test_registered_labels(spark):
    for url, label in {"http://a.b.example.co.uk/": "example", "http://x.co/": "x", "http://t.co.": "t", "http://10.1.2.3/": "10.1.2.3", "http://localhost/x": "localhost", "http://go.com/": "go", "http://www.gov.uk/": "gov"}.items():
        assert one(spark, U.site_label(F.lit(url))) == (label if url != "http://www.gov.uk/" else "www")


def test_frequent_ngrams_like_a_plain_count(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice("ab c") for _ in range(rng.randint(0, 12)))) for k in range(60)] + [(1, "a b a b a b"), (70, None), (71, "")]
    want = {}
    for k, t in rows:
        w = (t or "").split()
        for g in {" ".join(w[i : i + 3]) for i in range(len(w) - 2)}:
            want[g] = want.get(g, 0) + 1
    got = {r["ngram"]: r["n_docs"] for r in D.frequent_ngrams(spark.createDataFrame(rows, "id long, text string"), "id", "text", 3, 8).collect()}
    assert got == {g: n for g, n in want.items() if n > 8} and got


def test_groups_of_near_copies(spark):
    """Components over similar pairs, however the smallest text of a bucket lies: a hub, a chain, copies, and texts of one template."""
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefgh ") for _ in range(150))
    rows = [(10 + k, base[: 3 * k] + "XY" + base[3 * k + 2 :]) for k in range(30)] + [(5, base), (6, base), (7, None), (8, "abc")]
    step = "".join(rng.choice("ijklmno ") for _ in range(120))
    for k in range(15):
        step = step[:-4] + "".join(rng.choice("pqrs") for _ in range(4)) + step[-4:][:0]
        rows.append((100 + k, step[4:] + "t" * k))
    rows += [(200 + k, base[:40] + "".join(rng.choice("uvwxyz") for _ in range(60))) for k in range(20)]
    sets = {i: {t[j : j + 5] for j in range(len(t) - 5)} if t else set() for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for a in ids:
        for b in ids:
            if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.7:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    prints = D.fingerprints(spark.createDataFrame(rows, "id long, t string"), "id", "t")
    got = {r["node"]: r["group"] for r in D.groups(prints, 0.7, 50).collect()}
    want = {i: root(i) for i in ids if root(i) != i or any(root(j) == i for j in ids if j != i)}
    assert got == want and len(set(want.values())) >= 2


def test_shared_folder_is_asked_for_on_a_cluster():
    class Session:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"getCheckpointDir": staticmethod(lambda: None), "master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        shared_folder(Session)


def test_metrics_known_values(spark):
    rows = spark.createDataFrame([(1, 1, 0.1), (0, 1, 0.2), (1, 0, 0.3), (0, 0, 0.4), (1, 1, 0.5)], "g int, p int, v double")
    r = rows.agg(M.f1(F.col("g"), F.col("p")).alias("f1"), M.matthews(F.col("g"), F.col("p")).alias("mcc"), M.perplexity(F.log("v")).alias("ppl"), M.upper_median(F.col("v")).alias("med"), M.kappa(F.col("g"), F.col("p")).alias("k")).first()
    assert r["f1"] == pytest.approx(2 / 3) and r["mcc"] == pytest.approx(1 / 6) and r["k"] == pytest.approx(1 / 6) and r["med"] == 0.3
    assert r["ppl"] == pytest.approx(math.exp(-np.mean(np.log([0.1, 0.2, 0.3, 0.4, 0.5]))))
    empty = rows.limit(0).agg(M.f1(F.col("g"), F.col("p")).alias("f1"), M.perplexity(F.col("v")).alias("p")).first()
    assert empty["f1"] == 0.0 and empty["p"] is None


def test_group_metrics(spark):
    parts = spark.createDataFrame([("t", 0.3, 20, 0.02), ("t", 0.2, 40, 0.03), ("t", 0.4, 100, 0.01)], "g string, m double, n long, e double")
    r = E.rollup_groups(parts, "g", "m", "n", "e").first()
    assert r["unweighted"] == pytest.approx(0.3) and r["metric"] == pytest.approx(0.3375) and r["n"] == 160


def test_pass_at_k(spark):
    def plain(n, c, k):
        return 1 - math.comb(n - c, k) / math.comb(n, k)

    for n, c, k in ((10, 0, 1), (10, 3, 1), (10, 3, 5), (10, 9, 2), (4, 4, 1)):
        assert one(spark, M.pass_at_k(F.lit(n), F.lit(c), k)) == pytest.approx(plain(n, c, k))


def test_bootstrap_is_near_the_analytic_error(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([(i, rng.random()) for i in range(1000)], "i long, x double").repartition(3)
    analytic = rows.agg(M.mean_stderr(F.col("x"))).first()[0]
    assert E.bootstrap_stderr(rows, "x", "i").first()[0] == pytest.approx(analytic, rel=0.08)


def test_bleu_chrf_ter(spark):
    same = spark.createDataFrame([("the cat sat on the mat today", "the cat sat on the mat today")], "a string, b string")
    w = lambda c: F.split(c, " ")
    assert E.bleu(same, w("a"), w("b")).first()[0] == pytest.approx(100)
    assert E.chrf(same, F.col("a"), F.col("b")).first()[0] == pytest.approx(100)
    assert E.ter(same, w("a"), w("b")).first()[0] == 0
    other = spark.createDataFrame([("a b c d", "a x c d e")], "a string, b string")
    assert E.ter(other, w("a"), w("b")).first()[0] == pytest.approx(40)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=7), st.lists(st.sampled_from("abc"), max_size=7))
def test_edit_distance(a, b):
    import pandas as pd

    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    assert E.word_edits.func(pd.Series([a]), pd.Series([b]))[0] == d[-1][-1]


def test_longest_common_subsequence(spark):
    for a, b, n in (("abcbdab", "bdcaba", 4), ("", "abc", 0), ("xyz", "abc", 0), ("abc", "abc", 3)):
        col = lambda s: F.filter(F.split(F.lit(s), ""), lambda x: x != "")
        assert one(spark, M.longest_common(col(a), col(b))) == n


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4), st.integers(1, 4), st.data())
def test_best_pairing(n, m, data):
    from itertools import permutations

    s = np.array([[data.draw(st.integers(0, 5)) for _ in range(m)] for _ in range(n)], float)
    t = s if n <= m else s.T
    best = max(sum(t[i, p[i]] for i in range(t.shape[0])) for p in permutations(range(t.shape[1]), t.shape[0]))
    assert E._best_pairing(s).sum() == best


def test_filters(spark):
    assert one(spark, E.regex_filter(F.lit("so #### 12 and #### 7"), r"#### (\d+)", -1)) == "7"
    assert one(spark, E.regex_filter(F.lit("none"), r"#### (\d+)")) == "[invalid]"
    assert one(spark, E.map_filter(F.lit("b"), {"a": "1"}, "?")) == "?"
    assert one(spark, E.pipeline(["lowercase", "whitespace"])(F.lit("  AbC"))) == "abc"
    with pytest.raises(ValueError, match="twice"):
        E.register(E.FILTERS, "lowercase")(F.lower)


SENTENCE = "This is filler sentence number {} with quite a few words in it to make up some length. "


def test_janitor_fixture():
    text = "".join(SENTENCE.format(i) for i in range(30))
    words = text.split()
    assert C.chunks_without(text, []) == [text]
    assert C.chunks_without("short and clean", []) == []
    assert C.chunks_without(text, list(range(11))) == []
    at = text.index("number 15")
    k = words.index("15") - 1
    parts = C.chunks_without(text, [k], n=2, window=20)
    assert len(parts) == 2 and parts[0] == text[: at - 20] and text.endswith(parts[1]) and "15" not in "".join(parts)


def test_janitor_finds_passages(spark):
    bad = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    text = "".join(SENTENCE.format(i) for i in range(20)) + bad.upper().replace(" ", "  ") + "! " + "".join(SENTENCE.format(i) for i in range(20, 40))
    docs = spark.createDataFrame([(1, text), (2, "".join(SENTENCE.format(i) for i in range(9))), (3, None), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in C.janitor(docs, spark.createDataFrame([(bad,)], "text string")).collect()}
    assert got[1]["n_hits"] == 2 and len(got[1]["chunks"]) == 2 and "ALPHA" not in "".join(got[1]["chunks"])
    assert got[2]["n_hits"] == 0 and len(got[2]["chunks"]) == 1
    assert got[3]["chunks"] == [] and got[4]["chunks"] == []


def test_ngram_pieces(spark):
    bad = "one two three four five six seven eight nine ten eleven twelve thirteen"
    body = lambda a, b: "".join(SENTENCE.format(i) for i in range(a, b))
    text = body(0, 10) + "Here: " + bad + ". " + body(10, 20)
    pieces = C.pieces_without(text, {bad}, 13, [13])
    assert len(pieces) == 2 and all(bad not in p for p in pieces) and pieces[0] == text[: len(pieces[0])] and text.endswith(pieces[1])
    assert C.pieces_without("a b c", {"a b c"}, 13, [3]) == ["a b c"]
    docs = spark.createDataFrame([(1, text), (2, body(0, 3)), *((10 + i, bad) for i in range(0))], "doc_id long, text string")
    got = C.without_ngrams(docs, spark.createDataFrame([(bad,)], "ngram string")).collect()
    assert sorted((r["doc_id"], r["split_id"]) for r in got) == [(1, "tasks-0000000001-0000"), (1, "tasks-0000000001-0001"), (2, "tasks-0000000002-0000")]
    common = docs.select("text").where("doc_id = 1").crossJoin(spark.range(12)).select("id", "text").toDF("doc_id", "text")
    assert C.without_ngrams(common, spark.createDataFrame([(bad,)], "ngram string")).count() == 12


def test_rolling_windows_fixture(spark):
    got = K.rolling(spark.createDataFrame([(9,), (2,), (0,)], "n long"), "n", 2, 1).orderBy("n", "k").collect()
    assert [(r["n"], r["input_start"], r["pred_start"], r["pred_end"]) for r in got] == [(2, -1, 0, 2), (9, -1, 0, 2), (9, 1, 2, 4), (9, 3, 4, 6), (9, 5, 6, 8), (9, 6, 8, 9)]


def test_running_sums_and_packing(spark):
    sizes = [(int(k), int(n)) for k, n in zip(np.random.RandomState(1).permutation(9000), np.random.RandomState(2).randint(0, 40, 9000), strict=True)]
    got = {r[0]: r[2] for r in K.running(spark.createDataFrame(sizes, "k long, n long"), "k", {"a": F.col("n")}).collect()}
    total = 0
    for k, n in sorted(sizes):
        assert got[k] == total
        total += n
    packed = K.pack(spark.createDataFrame(sizes[:300], "k long, n long"), "k", "n", 64)
    per = {r[0]: r[1] for r in packed.groupBy("sample_id").agg(F.sum(F.col("doc_end") - F.col("doc_start"))).collect()}
    assert all(per[k] == 64 for k in range(len(per) - 1)) and sum(per.values()) == sum(n for _, n in sizes[:300])


def test_samples_are_the_same_each_time(spark):
    text = " ".join(f"Sentence {i} has some words, and more of them. Next?" for i in range(40))
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "One.")], "doc_id long, text string")
    a, b = (sorted(map(str, S.bert_samples(docs.repartition(n), "doc_id", "text").collect())) for n in (1, 4))
    assert a == b and a
    for r in S.bert_samples(docs, "doc_id", "text").collect():
        t = r["tokens"]
        assert len(t) <= 128 and t[0] == "[CLS]" and t[-1] == "[SEP]" and t[r["n_first"] - 1] == "[SEP]" and len(r["places"]) == len(r["labels"])
    for r in S.t5_samples(docs, "doc_id", "text").collect():
        parts, now = {}, None
        for x in r["target"]:
            if x.startswith("<extra_"):
                now = parts.setdefault(x, [])
            else:
                now.append(x)
        whole = [y for x in r["source"] for y in (parts[x] if x in parts else [x])]
        assert " ".join(whole) in " ".join(text.split()) or r["doc_id"] == 4
    assert S.sentence_samples(docs, "doc_id", "text").where("n_tokens > 160").count() == 0


def test_pack_in_order(spark):
    rows = [(i, 1 + i * 7 % 30) for i in range(500)]
    got = S.pack_in_order(spark.createDataFrame([*rows, (600, 1000), (601, 0)], "k long, n long"), "k", "n", 64, group=100).collect()
    assert sorted((r["k"], r["end"] - r["start"]) for r in got) == [*rows, (600, 64)]
    assert {(r["k"], r["n_cut"]) for r in got if r["n_cut"]} == {(600, 936)}
    want, used = [], 64
    for i, (k, n) in enumerate([*rows, (600, 64)]):
        used = n if i % 100 == 0 or used + n > 64 else used + n
        want.append((k, used))
    assert sorted((r["k"], r["end"]) for r in got) == want


def test_blend_lookup_resolves_every_position(spark, tmp_path):
    from millrace.plans import catalog

    rows = [(i, "ab"[i % 3 == 0]) for i in range(100, 160)]
    spark.createDataFrame(rows, "doc_id long, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, catalog.queries()["blend_lookup"](spark, str(tmp_path)).collect()))
    assert got == sorted((s, k, i) for s in "ab" for k, i in enumerate(i for i, x in rows if x == s))


def test_fix_text(spark):
    bad = "cafÃ© â€œquotedâ€\x9d naïve\r\nline\x00"
    assert one(spark, S.fix_text(F.lit(bad))) == "café “quoted” naïve\nline"
    assert one(spark, S.fix_text(F.lit("plain"))) == "plain" and one(spark, S.fix_text(F.lit(None).cast("string"))) is None


def test_wordpieces_and_diff():
    v = {"un", "##aff", "##able", "a"}
    assert S.wordpieces("unaffable", v) == ["un", "##aff", "##able"] and S.wordpieces("xyz", v) == ["[UNK]"]
    assert S.apply_diff(["a", "b", "c"], "@@ -1,3 +1,3 @@\n a\n-b\n+B\n c") == ["a", "B", "c"]
    assert S.apply_diff(["a"], "@@ -1,1 +1,1 @@\n-x\n+y") is None
    assert S.apply_diff(["a"], "@@ -0,0 +1,1 @@\n+new") == ["new", "a"]


def test_run_overlap(spark):
    for tokens, n in (("a b a b a x a a", 5), ("a x b", 0), ("", 0)):
        c = F.filter(F.split(F.lit(tokens), " "), lambda x: x != "")
        assert one(spark, S.run_overlap(c, F.array(F.lit("a"), F.lit("b")), 3)) == n


@pytest.mark.parametrize("block", [4096, 7])
@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_top_k(spark, block, metric):
    x = np.random.RandomState(0).normal(size=(120, 8)).astype(np.float32)
    x[5] = x[6]
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, x[0].tolist()), (999, None)], "id long, embedding array<float>").repartition(5)
    got = R.top_k(base.where("id % 6 = 0"), base, 4, metric, query_block=block).collect()
    y = x.astype(float)
    for q in range(0, 120, 6):
        d = ((y - y[q]) ** 2).sum(1) if metric == "l2" else -(y @ y[q])
        d[q] = np.inf
        want = np.lexsort((np.arange(120), np.round(d, 9)))[:4].tolist()
        assert [r["id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query"] == q] == want
    assert R.top_k(base.limit(0), base, 4).count() == 0


def test_cells_recall(spark):
    from millrace.plans import catalog as plans

    q = plans.queries()
    exact = q["knn_l2"](spark, "/root/testdata/sf0.001").select("query", "id")
    found = q["ivf_search"](spark, "/root/testdata/sf0.001").select("query", "id")
    assert exact.intersect(found).count() / exact.count() >= 0.9


def test_indexes_by_name(spark):
    rng = np.random.RandomState(2)
    e = spark.createDataFrame([(k, rng.normal(size=4).tolist()) for k in range(60)], "id long, embedding array<double>")
    exact = R.index("exact", e).search(e.where("id < 5"), 3)
    whole = R.index("cells", e, cells=4, probes=4).search(e.where("id < 5"), 3)
    key = lambda df: sorted((r["query"], r["rank"], r["id"]) for r in df.collect())
    assert key(exact) == key(whole) and len(key(exact)) == 15
    with pytest.raises(ValueError):
        R.index("none", e)


def test_components(spark):
    edges = [(k, k + 1) for k in range(100)] + [(500, 501), (501, 502), (7, 7)]
    got = {r["node"]: r["group"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**dict.fromkeys(range(101), 0), 500: 500, 501: 500, 502: 500}


def test_files_round_trip(spark, tmp_path):
    rows = [{"text": "a é"}, {"text": ""}, {"text": "b\nc"}]
    (tmp_path / "in.jsonl").write_text("\n".join([json.dumps(r) for r in rows] + ["{broken", ""]))
    good, bad = files.jsonl(spark, str(tmp_path / "in.jsonl"))
    assert sorted(r["text"] for r in good.collect()) == sorted(r["text"] for r in rows) and [r[0] for r in bad.collect()] == ["{broken"]
    made = files.write_zst(good, f"file://{tmp_path}/zst").where("n > 0").collect()
    back = files.zst_documents(spark, f"{tmp_path}/zst/{made[0]['name']}")
    assert sorted(r["text"] for r in back.collect()) == sorted(r["text"] for r in rows)
    (tmp_path / "arr.json").write_text(json.dumps(rows))
    assert files.json_array(spark, str(tmp_path / "arr.json")).count() == 3
    (tmp_path / "t.tsv").write_text('id\ttext\n1\tsay "x"\n2\ty\n')
    assert [tuple(r) for r in files.tsv(spark, str(tmp_path / "t.tsv"), "id long, text string").collect()] == [(1, 'say "x"'), (2, "y")]
    files.write_split(good.withColumn("v", F.when(F.col("text") == "", "remove_short").otherwise("ok")), str(tmp_path / "s"), "v")
    assert spark.read.json(f"{tmp_path}/s_cleaned").count() == 2 and spark.read.json(f"{tmp_path}/s_filtered").count() == 1
    parts = files.partitioned(spark.range(100), "id", 8).groupBy("part").count().collect()
    assert len(parts) == 8 and sum(r["count"] for r in parts) == 100


def test_indexed_store(spark, tmp_path):
    indexed.register(spark)
    rng = np.random.RandomState(3)
    docs = [(i, rng.randint(0, 60000, rng.randint(0, 50)).tolist()) for i in range(40)]
    df = spark.createDataFrame(docs, "k long, tokens array<int>").repartitionByRange(3, "k").sortWithinPartitions("k")
    folder = f"{tmp_path}/store"
    df.write.format("indexed").option("dtype", "uint16").mode("append").save(folder)
    parts = indexed.parts_of(folder)
    whole = indexed.merge(parts, f"{tmp_path}/all")
    assert len(whole.lengths) == 40 and whole.documents.tolist() == list(range(41))
    got = spark.read.format("indexed").load(f"{tmp_path}/all").orderBy("seq").collect()
    by_order = [t for p in parts for t in ([r["tokens"] for r in spark.read.format("indexed").load(p).orderBy("seq").collect()])]
    assert [r["tokens"] for r in got] == by_order and sorted(map(str, by_order)) == sorted(str(t) for _, t in docs)
    k = next(i for i, t in enumerate(by_order) if len(t) > 5)
    assert indexed.read_tokens(f"{tmp_path}/all", k, 2, 3).tolist() == by_order[k][2:5]
    with pytest.raises(IndexError):
        indexed.read_tokens(f"{tmp_path}/all", k, 0, 1000)


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = W.tumbling(stream, "ts", "1 hour", ["event_type"], "value", "10 days").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: sorted((r["start"], r["event_type"], r["n"]) for r in df.collect())
    assert key(spark.table("windows")) == key(W.tumbling(events, "ts", "1 hour", ["event_type"], "value"))
    assert W.first_seen(events, ["event_type"]).count() == events.select("event_type").distinct().count()


def test_text_functions(spark):
    assert one(spark, T.normalize_answer(F.lit("The  quick, a fox!"))) == "quick fox"
    assert one(spark, T.detok_wiki(F.lit("a @-@ b , c"))) == "a-b, c"
    assert one(spark, F.size(T.ngrams(F.split(F.lit("a b"), " "), 3))) == 0
    assert one(spark, T.ngrams(F.split(F.lit("a b c d"), " "), 3)) == ["a b c", "b c d"]
    assert one(spark, F.size(T.char_shingles(F.lit("abcde")))) == 0 and one(spark, T.char_shingles(F.lit("abcdefg"))) == ["abcde", "bcdef"]


def test_answers(spark):
    for given_, want in ((r"\frac12", r"\frac{1}{2}"), (r"x=\tfrac{3}4", r"\frac{3}{4}"), ("0.5", r"\frac{1}{2}"), ("3/4", r"\frac{3}{4}"), (r"\sqrt3", r"\sqrt{3}"), (r"\left( 2, .5 \right)", "(2,0.5)"), (r"5\text{ inches}", "5"), (r"45^\circ", "45"), (r"12\%", "12")):
        assert one(spark, A.formula(F.lit(given_))) == want, given_
    assert one(spark, A.number(F.lit("1,200.50"))) == "1200.5" and one(spark, A.number(F.lit("seven"))) == "seven"
    assert one(spark, A.drop_tokens(F.lit("The 1,000 well-known  dogs!"))) == ["1000", "well", "known", "dogs"]
    assert one(spark, A.last_boxed(F.lit(r"a \boxed{1} b \boxed{\frac{1}{2}} c"))) == r"\frac{1}{2}"
    assert one(spark, A.last_boxed(F.lit("none"))) is None


def test_catalog(spark, tmp_path):
    for n in ("a.json", "b.JSON", "c.txt"):
        (tmp_path / n).write_text("x")
    assert catalog.listing(spark, str(tmp_path), (".json",)).count() == 2
    assert catalog.blend_list(["3", "a", "1", "b"]) == (["a", "b"], [0.75, 0.25]) and catalog.blend_list(["a", "b"]) == (["a", "b"], None)
    assert catalog.matching(["qa_x", "qa_y", "z"], ["qa_*", "g"], {"g": ["z", "qa_x"]}) == ["qa_x", "qa_y", "z"]
    spark.dataSource.register(catalog.MockTokens)
    read = lambda: sorted(map(str, spark.read.format("mocktokens").options(rows="50", length="9").load().collect()))
    assert read() == read() and len(read()) == 50
    df = spark.createDataFrame([("a|b", 0.5)], "k string, v double")
    assert catalog.markdown(df).endswith("| a\\|b | 0.5000 |") and "a|b & 0.5000" in catalog.latex(df)


def test_model_and_cache(spark):
    rows = spark.createDataFrame([("ab", "c"), ("a", "cd")], "context string, continuation string")
    scored = E.with_model(rows, lambda: lambda a, b: [len(x) + len(y) for x, y in zip(a, b, strict=True)])
    assert {r["score"] for r in scored.collect()} == {3.0}
    hit, todo = E.from_cache(rows, scored.where("context = 'a'"), ["context", "continuation"])
    assert [r["context"] for r in hit.collect()] == ["a"] and [r["context"] for r in todo.collect()] == ["ab"]


def test_ranked_and_running_by_key(spark):
    rng = np.random.RandomState(5)
    rows = [(int(k) if k else None, int(v), int(n)) for k, v, n in zip(rng.randint(0, 3, 900), rng.permutation(900), rng.randint(0, 9, 900), strict=True)]
    df = spark.createDataFrame(rows, "k long, v long, n long").repartition(5)
    got = {r["v"]: (r["p"], r["all"]) for r in ranked(df, ["k"], [F.desc("v")], "p", "all").collect()}
    sums = {r["v"]: r["s_before"] for r in running(df, "v", {"s": F.col("n")}, ["k"]).collect()}
    for k in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: -r[1])
        for p, r in enumerate(own, 1):
            assert got[r[1]] == (p, len(own))
            assert sums[r[1]] == sum(x[2] for x in own[p:])
    assert ranked(df.limit(0), ["k"], ["v"]).count() == 0
