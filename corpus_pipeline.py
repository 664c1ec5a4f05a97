"""A corpus pipeline: toxic documents go, one document of each near-duplicate group stays, passages
that an earlier document has are cut, documents with benchmark items go, the rest is tokenised.

Stages work on columns by position, so any further columns of documents, whatever their names, pass
through. Null ids and null or empty texts pass every filter. Rows that repeat an id are documents of
their own in the near-duplicate stage; of those with the same text one stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, neardup, pieces, substrings, toxicity
from millrace.llm.queries import tokenizer_file
from millrace.llm.runtime import bound_batches, ship, small_side, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Columns c0, c1, ... and the number name of each column of documents."""
    names = {}
    for k, c in enumerate(docs.columns):
        names.setdefault(c, f"c{k}")
    return docs.toDF(*(f"c{k}" for k in range(len(docs.columns)))), names


def _ready(spark: SparkSession) -> None:
    ship(spark)
    bound_batches(spark)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under the threshold of their language; the classifier learns from the labelled rows."""
    _ready(spark)
    rows, at = _numbered(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    lang = at.get("lang")
    own = labels.select(F.col("doc_id").alias(at["doc_id"]), "toxic")
    model = toxicity.learned(rows, own, id_col=at["doc_id"], text_col=at["text"], lang_col=lang)
    scored = toxicity.with_scores(rows.withColumn("id", F.lit(0)), model, id_col="id", text_col=at["text"], lang_col=lang, carry=rows.columns)
    return scored.where(~F.col("toxic")).select(*rows.columns).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of five-word similarity 0.8 or more.

    Rows are documents here: different texts under one id stay apart, so no text is lost; of rows alike in id
    and text one stays, chosen by a hash of its columns, so the same in every run.
    """
    _ready(spark)
    rows, at = _numbered(docs)
    key, text = at["doc_id"], F.xxhash64(F.col(at["text"]).cast("string"))
    found = stored(neardup.near_duplicates(rows, n=5, percent=80, id_col=key, text_col=at["text"], by_row=True).select(F.col(key).alias("id"), "version", "n_shingles", "kept"), "kept")
    same = (rows[key].cast("long") == F.col("id")) & (text == F.col("version"))
    gone = found.where(~F.col("kept")).select("id", "version").distinct()
    stay = rows.join(small_side(gone), same, "left_anti")
    again = found.where("kept AND id IS NOT NULL AND n_shingles > 0").groupBy("id", "version").count().where("count > 1").select("id", "version")
    if not again.isEmpty():
        again = small_side(again)
        order = F.xxhash64(*(c for c, t in rows.dtypes if not t.startswith("map") and "map<" not in t))
        once = stay.join(again, same).groupBy("id", "version").agg(F.min_by(F.struct(*rows.columns), F.struct(order)).alias("r")).select("r.*")
        stay = stay.join(again, same, "left_anti").union(once)
    return stay.toDF(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that a 13-word window shares with an earlier document; other texts stay as they are."""
    _ready(spark)
    rows, at = _numbered(docs)
    carry = [c for c in rows.columns if c not in (at["doc_id"], at["text"])]
    out = substrings.remove_repeats(rows, id_col=at["doc_id"], text_col=at["text"], carry=carry, untouched=True)
    if "n_chars" in at:
        out = out.withColumn(at["n_chars"], F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col(at["n_chars"])))
    return out.withColumnRenamed("kept_text", at["text"]).select(*rows.columns).toDF(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window that is 0.8 similar to a benchmark item or more."""
    _ready(spark)
    rows, at = _numbered(docs)
    key = at["doc_id"]
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hits = stored(decontaminate.contaminated(rows, items, id_col=key, text_col=at["text"]).select(F.col(key).alias("id")).distinct(), "hits")
    return rows.join(small_side(hits), rows[key] == F.col("id"), "left_anti").toDF(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the text that their pieces decode to, n_tokens and the piece ids."""
    _ready(spark)
    rows, at = _numbered(docs)
    carry = [c for c in rows.columns if c != at["text"]]
    out = pieces.encode(rows.withColumn("id", F.lit(0)), tokenizer_file("piece_bpe_32k.model"), id_col="id", text_col=at["text"], carry=carry)
    out = out.withColumnRenamed("decoded", at["text"]).withColumn("n_tokens", F.size("ids").cast("long"))
    return out.select(*rows.columns, "n_tokens", "ids").toDF(*docs.columns, "n_tokens", "ids")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("sentencepiece", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is a table that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs


#: A trained classifier and a subword tokenizer have no SQL; tests compare run() with a plain version.
ORACLE_SQL = None
