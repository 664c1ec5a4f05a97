"""Work that grew faster than the input: pieces for Python are bounded, plans neither sort nor pair all rows."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.util import PythonEvalType
from pyspark.sql import functions as F

from millrace.batches import BATCH_BYTES, BATCH_SETTING, PIECE_BYTES, cuts, pieces_run
from millrace.functions import metrics as M
from millrace.functions import text as T
from millrace.operators import duplicates as D
from millrace.operators import evaluation as E
from millrace.operators import grams as G
from millrace.operators import graph
from millrace.operators import retrieval as R
from millrace.operators import samples as S
from millrace.plans import catalog

SF = "/root/testdata/sf0.001"
#: Some 10 MB in one batch, as Spark sends it without a bound.
TEXTS = [f"the {k} form-é of it.\nIt is so. " * 120 for k in range(3000)]


def of(column_function, *columns) -> list[pa.Array]:
    """What a column function made by pieces returns for one batch."""
    arrays = tuple(pa.array(c) for c in columns)
    return list(column_function.func(iter([arrays if len(arrays) > 1 else arrays[0]])))


def test_pieces_have_a_size():
    x = pa.array(["a" * k for k in (10, 2 * PIECE_BYTES, 10, PIECE_BYTES // 2, PIECE_BYTES // 2, 0)] + [None])
    assert list(cuts([x])) == [(0, 1), (1, 1), (2, 2), (4, 3)]


def test_queries_bound_batches(spark):
    had = spark.conf.getAll.get(BATCH_SETTING)
    spark.conf.unset(BATCH_SETTING)
    catalog.queries()["split_indices"](spark, SF)
    assert int(spark.conf.get(BATCH_SETTING)) == BATCH_BYTES
    if had:
        spark.conf.set(BATCH_SETTING, had)


def test_split_indices_by_pieces(spark):
    parts = of(T.split_indices, [*TEXTS, None, ""])
    assert len(parts) > 8 and max(len(p) for p in parts) < 500 and sum(map(len, parts)) == 3002
    assert parts[0][0].as_py()[:3] == [{"token": "the", "start": 0}, {"token": "0", "start": 4}, {"token": "form-é", "start": 6}]
    assert parts[-1][-2].as_py() == [] and parts[-1][-1].as_py() == []
    plan = catalog.queries()["split_indices"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split_indices(") <= 2 and plan.count("ArrowEvalPython") == 1


def test_general_cleaning_knows_ascii_words(spark):
    df = spark.createDataFrame([("caf\u00e9\nis\n\n open  now.\n\u00e9_\n1\n",)], "t string")
    assert df.select(T.general_cleaning(F.col("t"))).first()[0] == "caf\u00e9\nis open now.\n\u00e9_ 1 "


def test_blocks_of_queries_meet_all_parts(spark):
    """Keys of both sides are of one type, so equal ones meet in one of many partitions."""
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    q = e.where("id % 5 = 0")
    rows = lambda df: sorted(map(tuple, df.select("query", "id", "rank").collect()))
    coalesce, n = "spark.sql.adaptive.coalescePartitions.enabled", spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(coalesce, "false")
    spark.conf.set("spark.sql.shuffle.partitions", "31")
    try:
        whole = rows(R.top_k(q, e, 5))
        assert len(whole) == 5 * q.count() and rows(R.top_k(q, e, 5, query_block=7)) == whole
        assert rows(R.index("cells", e, cells=4, probes=4).search(q, 5)) == whole
    finally:
        spark.conf.unset(coalesce)
        spark.conf.set("spark.sql.shuffle.partitions", n)


def test_cells_search_is_done_by_blocks(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    plan = R.index("cells", e, cells=4, probes=2).search(e.where("id < 50"), 5)._jdf.queryExecution().toString()
    assert "zip_with" not in plan and "FlatMapCoGroupsInArrow" in plan


def test_nearest_rows_with_ties():
    x = np.vstack([np.zeros((30, 4)), np.eye(4), 2 * np.ones((5, 4))]).astype(np.float32)
    ids = np.arange(len(x))[::-1].copy()
    table = pa.table({"id": pa.array(ids), "v": pa.array(x.tolist(), pa.list_(pa.float32()))})
    for tile in ((256, 8192), (3, 7)):
        got = pa.Table.from_batches(R._nearest(table, table, 3, tile)).to_pylist()
        for i, v in zip(ids, x, strict=True):
            best = sorted((((v - w) ** 2).sum(), j) for j, w in zip(ids, x, strict=True) if j != i)[:3]
            assert [(r["distance"], r["id"]) for r in got if r["query"] == i] == best


def _grams(texts: list[str], n: int) -> list[list[str]]:
    return [[" ".join(w[k : k + n]) for k in range(len(w) - n + 1)] for w in (t.lower().split() for t in texts)]


def test_bucket_ngrams_neither_sorts_nor_sends_ngrams(spark):
    plan = catalog.queries()["bucket_ngrams"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
    texts = ["B a  C\nb a c", "x", "", "a b c"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(G.plain(F.col("text")).alias("t"))
    grams = sorted(g for t in _grams(texts, 3) for g in t)
    assert [tuple(r) for r in G.bucket_least(df, 3, 1).collect()] == [(0, len(grams), grams[0])]


def test_frequent_ngrams_of_few_cells(spark):
    """Few cells, so that n-grams share them, and tasks that send early: the result stays exact. Repeats in a text count once."""
    texts = [f"all of them say so {k} times and {k % 7} more and all of them say so ö" for k in range(60)]
    want = Counter(g for t in _grams(texts, 4) for g in set(t))
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string").repartition(5)
    for held in (G.HELD, 50):
        got = G.frequent(df.select(F.col("k").alias("key"), G.plain(F.col("t")).alias("t")), 4, 8, 1, held).collect()
        assert len(got) == len({r["ngram"] for r in got}) and {r["ngram"]: r["n_docs"] for r in got} == {g: n for g, n in want.items() if n > 8}
    plan = catalog.queries()["frequent_13grams"](spark, SF)._jdf.queryExecution().toString()
    assert "array_distinct" not in plan


def test_rows_by_pieces():
    run = pieces_run(lambda b: {"n": [b.num_rows] * b.num_rows}, pa.schema([("n", pa.int64())]))
    parts = list(run(iter([pa.RecordBatch.from_arrays([pa.array(TEXTS)], names=["t"])])))
    assert len(parts) > 8 and sum(p.num_rows for p in parts) == 3000 and max(p.num_rows for p in parts) < 500


@pytest.mark.parametrize("name", ["t5_samples", "bert_samples", "janitor_clean", "model_generate"])
def test_samples_go_by_pieces(spark, name):
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan


def test_fix_text_by_pieces():
    parts = of(S.fix_text, [*TEXTS, None, "a\r\nÃ©"])
    assert len(parts) > 8 and max(map(len, parts)) < 500 and parts[-1].to_pylist()[-2:] == [None, "a\né"]


def test_wordpiece_by_pieces():
    parts = of(S.wordpiece({"the", "f", "##o"}), [*TEXTS, None, "The foo x"])
    assert len(parts) > 8 and max(map(len, parts)) < 500 and parts[-1].to_pylist()[-2:] == [[], ["the", "f", "##o", "##o", "[UNK]"]]


def test_chrf_counts(spark):
    words = ["the the hat", "", "ééa b", "abcabcabc"]
    a, b = words, ["the hat", "x", "éa b", "cabcab"]
    want = np.zeros((6, 3))
    for x, y in zip(a, b, strict=True):
        for n in range(1, 7):
            p, q = (Counter(t[k : k + n] for k in range(len(t) - n + 1)) for t in (x, y))
            want[n - 1] += (sum((p & q).values()), sum(p.values()), sum(q.values()))
    assert (E.char_counts(a, b, 6) == want).all()
    assert "Generate" not in catalog.queries()["agg_chrf"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_common_length(spark):
    rng = random.Random(3)
    for _ in range(60):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(90))] for _ in "ab")
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        assert M.common_length(a, b) == row[-1]
    assert "ArrowEvalPython" in catalog.queries()["rouge_l"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_bytes_go_by_pieces(spark):
    plan = catalog.queries()["encode_bytes"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f", {PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF}") >= 2 and plan.count("ArrowEvalPython") == 2


def test_shingles_by_pieces():
    parts = of(D.shingle_set, [*TEXTS, None, "abcdefg"])
    assert len(parts) > 8 and max(map(len, parts)) < 500 and [len(x) for x in parts[-1].to_pylist()[-2:]] == [0, 2]
    parts = of(D._least_hashes, TEXTS[:600], [3] * 600)
    assert len(parts) > 1 and sum(map(len, parts)) == 600


def test_forests_are_bounded():
    n = 600_000
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(1, n + 1)), pa.array(np.arange(n))], names=["u", "v"])
    parts = list(graph._local(iter([batch.slice(k, 50_000) for k in range(0, n, 50_000)])))
    assert max(p.num_rows for p in parts) < 350_000 and sum(p.num_rows for p in parts) == n


def test_patched_by_pieces():
    parts = of(S.patched, [*TEXTS, "a\nb"], [*("" for _ in TEXTS), "@@ -1,1 +1,1 @@\n-a\n+c"])
    assert len(parts) > 8 and max(map(len, parts)) < 500 and parts[-1].to_pylist()[-1] == "c\nb"


def test_decontamination_makes_no_strings_of_other_lengths(spark):
    plan = catalog.queries()["decontaminate_ngrams"](spark, SF)._jdf.queryExecution().toString()
    assert "flatten(" not in plan and "MapInPandas" not in plan


def test_word_ngrams_are_cut_from_bytes(spark):
    plan = catalog.queries()["word_ngrams"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan
    texts = ["A b\t c  d", None, "", "x y"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string").select(F.col("k").alias("key"), G.plain(F.col("t")).alias("t"))
    assert [tuple(r) for r in G.listed(df, 3, hashed=False).orderBy("key", "pos").collect()] == [(0, 0, "a b c"), (0, 1, "b c d")]
