"""Question and sentence-pair sets: rows of tab-separated lines and of nested JSON, in the shapes that evaluation takes.

Lines come as a column ``value`` (``spark.read.text``). The header tells a test file by its number of
columns; it goes with the lines, as it may not be the first of a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T

# The labels of the sentence-pair sets.
MNLI_LABELS = {"contradiction": 0, "entailment": 1, "neutral": 2}
QQP_LABELS = (0, 1)


def _fields(lines: DataFrame) -> DataFrame:
    return lines.select(F.transform(F.split(F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")), "\t"), lambda x: F.trim(x)).alias("f"))


def _numbered(c: Column) -> Column:
    return c.try_cast("bigint")


def mnli(lines: DataFrame, header: str, test_label: str = "contradiction") -> DataFrame:
    """uid, text_a, text_b, label of premise and hypothesis lines; a header of ten columns is that of a test file, whose labels are all ``test_label``.

    Lines with too few columns, an empty text, no number or an unknown label are left out.
    """
    f = _fields(lines.where(F.col("value") != header))
    label = F.lit(test_label) if len(header.strip().split("\t")) == 10 else F.element_at("f", -1)
    codes = F.create_map(*(F.lit(x) for kv in MNLI_LABELS.items() for x in kv))
    rows = f.where(F.size("f") >= 10).select(_numbered(F.get("f", F.lit(0))).alias("uid"), T.clean_task_text(F.get("f", F.lit(8))).alias("text_a"), T.clean_task_text(F.get("f", F.lit(9))).alias("text_b"), F.try_element_at(codes, label).alias("label"))
    return rows.where("uid >= 0 AND text_a <> '' AND text_b <> '' AND label IS NOT NULL")


def qqp(lines: DataFrame, header: str, test_label: int = 0) -> DataFrame:
    """uid, text_a, text_b, label of question pairs; a header of three columns is that of a test file. Malformed lines and empty questions are skipped."""
    test = len(header.strip().split("\t")) == 3
    a, b = (1, 2) if test else (3, 4)
    label = F.lit(test_label) if test else _numbered(F.get("f", F.lit(5))).cast("int")
    f = _fields(lines.where(F.col("value") != header)).where(F.size("f") == (3 if test else 6))
    rows = f.select(_numbered(F.get("f", F.lit(0))).alias("uid"), T.clean_task_text(F.get("f", F.lit(a))).alias("text_a"), T.clean_task_text(F.get("f", F.lit(b))).alias("text_b"), label.alias("label"))
    return rows.where((F.col("uid") >= 0) & (F.col("text_a") != "") & (F.col("text_b") != "") & F.col("label").isin(*QQP_LABELS))


def answer_list(c: Column) -> Column:
    """The strings of a list written with single or double quotes; nothing is evaluated."""
    inner = F.regexp_extract_all(c, F.lit(r"""('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")"""), F.lit(1))
    return F.transform(inner, lambda x: F.regexp_replace(F.substr(x, F.lit(2), F.length(x) - 2), r"\\(.)", "$1"))


def open_questions(lines: DataFrame) -> DataFrame:
    """question and answers of lines ``question <tab> [answers]``; a field may be quoted, with quotes doubled."""
    plain = lambda c: F.when(c.rlike('^".*"$'), F.replace(F.substr(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)
    f = F.split("value", "\t")
    return lines.where(F.size(f) >= 2).select(plain(F.get(f, F.lit(0))).alias("question"), answer_list(plain(F.get(f, F.lit(1)))).alias("answers"))


_CONTEXT = "struct<title:string,text:string>"
RETRIEVAL = f"question string, answers array<string>, positive_ctxs array<{_CONTEXT}>, negative_ctxs array<{_CONTEXT}>, hard_negative_ctxs array<{_CONTEXT}>"


def retrieval_rows(records: DataFrame) -> DataFrame:
    """question, its first positive context, hard negative and negative contexts (empty where there are none), answers."""
    none = F.array().cast(f"array<{_CONTEXT}>")
    return records.where(F.size("positive_ctxs") > 0).select(
        T.normalize_question(F.col("question")).alias("question"), F.get("positive_ctxs", F.lit(0)).alias("pos_context"),
        F.coalesce("hard_negative_ctxs", none).alias("hard_negative_context"), F.coalesce("negative_ctxs", none).alias("negative_context"), "answers",
    )


def retrieval_set(spark: SparkSession, path: str) -> DataFrame:
    """The same of files that are one JSON array of records each."""
    return retrieval_rows(spark.read.option("multiLine", True).schema(RETRIEVAL).json(path))
