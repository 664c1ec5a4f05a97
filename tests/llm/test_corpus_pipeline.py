"""The pipeline: planted cases go, clean rows stay, stages bear odd rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from millrace.llm.runtime import BATCH_BYTES, BATCH_SETTING


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """A folder of tables with planted cases, and what is expected of each document."""
    at = str(tmp_path_factory.mktemp("tables"))
    rng = np.random.RandomState(4)
    words = [f"w{k}" for k in range(4000)]
    text = lambda n: " ".join(rng.choice(words, n))
    docs, labels, expected = [], [], {}
    for i in range(120):
        t = text(80)
        if i % 6 == 5:
            t = t[:100] + " idiot moron scum " + t[100:]
        docs.append((i, t, "en", "a", len(t)))
        labels.append((i, 1, int(i % 6 == 5)))
        expected[i] = None if i % 6 == 5 else t
    item, passage = text(30), text(60)
    more = {200: docs[0][1], 201: docs[1][1].replace(docs[1][1].split()[40], "changed"), 202: text(20) + " " + item + " " + text(20), 203: text(50) + " " + passage, 204: text(50) + "\n" + passage, 205: None, 206: ""}
    for i, t in more.items():
        docs.append((i, t, None, "b", len(t) if t else None))
        expected[i] = t
    docs.append(docs[2])
    docs.append((None, text(30), "en", "a", 3))
    expected[None] = docs[-1][1]
    expected[200] = expected[201] = expected[202] = None
    expected[204] = more[204].split("\n")[0]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, {k: v for k, v in expected.items() if v is not None or k == 205}


def test_run(spark, made):
    at, expected = made
    rows = P.run(spark, at).collect()
    got = {r["doc_id"]: r["text"] for r in rows}
    assert len(rows) == len(got)
    assert {k: v or "" for k, v in expected.items()} == got
    assert all((r["n_tokens"] == len(r["ids"])) for r in rows)


def test_stages_keep_columns_and_bear_clashes(spark, made):
    at, _ = made
    docs = spark.read.parquet(f"{at}/documents.parquet").limit(20)
    wide = docs.selectExpr("*", "1 AS id", "'x' AS kept", "2 AS score", "3 AS toxic", "4 AS kept_text", "5 AS n_removed", "'y' AS `__block`", "6 AS c1", "7 AS ids0")
    for name, stage in P.STAGES:
        out = stage(spark, wide, at)
        assert out.columns[: len(wide.columns)] == wide.columns, name
        assert out.where("kept <> 'x' OR c1 <> 6").count() == 0
        empty = stage(spark, docs.limit(0), at)
        assert empty.count() == 0, name


def test_the_driver_collects_no_texts(spark, made, monkeypatch):
    """The toxicity stage learns on the executors: no labelled text comes to the driver."""
    frame, sizes = type(spark.range(1)), []
    collect = frame.collect

    def watched(self):
        rows = collect(self)
        sizes.extend(len(v) for r in rows for v in r if isinstance(v, str))
        return rows

    monkeypatch.setattr(frame, "collect", watched)
    docs = spark.read.parquet(f"{made[0]}/documents.parquet")
    P.drop_toxic(spark, docs, made[0])
    assert max(sizes, default=0) < 30


def test_batches_for_workers_are_bounded(spark, made):
    """Long texts come to the workers in batches of some MB, not by 10,000 rows; a session's own bound stays."""
    spark.conf.unset(BATCH_SETTING)
    long = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 2000).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    try:
        for name, stage in P.STAGES:
            spark.conf.unset(BATCH_SETTING)
            stage(spark, spark.read.parquet(f"{made[0]}/documents.parquet").limit(5), made[0])
            assert max(r["n"] for r in long.mapInArrow(sizes, "n long").collect()) < BATCH_BYTES + 20_000, name
        spark.conf.set(BATCH_SETTING, "1000000")
        P.tokenise(spark, long, made[0])
        assert spark.conf.get(BATCH_SETTING) == "1000000"
    finally:
        spark.conf.unset(BATCH_SETTING)


def test_near_duplicates_keep_a_row_of_every_text(spark, made):
    """Texts that share an id are not taken for one another; of equal rows one stays, the same in every run."""
    x, y = (" ".join(f"{c}{k}" for k in range(40)) for c in "xy")
    rows = [(5, x, "a"), (5, y, "b"), (3, x, "c"), (9, y, "d"), (3, x, "b"), (None, x, "e"), (7, "", "f"), (7, None, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = [tuple(r) for r in P.drop_near_duplicates(spark, docs, made[0]).collect()]
    assert sorted(got, key=str) == sorted([(3, x, "b"), (5, y, "b"), (None, x, "e"), (7, "", "f"), (7, None, "g")], key=str)
