"""Queries of the task layer: prompts, examples, requests and models, and of question sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import answers as A
from millrace.functions import text as T
from millrace.operators import packing as K
from millrace.operators import tasks as Q
from millrace.operators import tokenizing as Z
from millrace.plans.base import Tables, query
from millrace.sources import benchmarks as B

_CHOICES = ["German", "English", "Spanish", "French"]
_CODE = "CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 WHEN 'fr' THEN 3 END"
_TEXT = "'Source ' || upper(coalesce(source, '')) || ': ' || coalesce(CAST(n_chars AS VARCHAR), '') || ' characters. Language?'"
_LIST = "['German', 'English', 'Spanish', 'French']"

LANGUAGE = Q.Task(
    "language", "Source {{source|upper}}: {{n_chars}} characters. Language?", "{{label}}", _CHOICES, output_type="multiple_choice",
    process_docs=lambda d: d.withColumn("label", F.expr(_CODE)),
)


@query("task_requests", f"SELECT doc_id, CAST(k - 1 AS INT) AS idx, {_TEXT} AS context, ' ' || {_LIST}[k] AS continuation, coalesce({_CODE} = k - 1, FALSE) AS gold FROM documents, unnest(range(1, 5)) AS u(k)")
def task_requests(t: Tables):
    return Q.requests(t.documents, LANGUAGE, "doc_id")


@query(
    "task_fewshot",
    f"WITH x AS (SELECT doc_id, {_TEXT} AS q, coalesce({_LIST}[{_CODE} + 1], '') AS a FROM documents), p AS (SELECT doc_id AS k, q || ' ' || a AS shown, row_number() OVER (ORDER BY doc_id) AS r FROM x QUALIFY r <= 3) "
    "SELECT doc_id, 'Name the language.' || chr(10) || coalesce((SELECT string_agg(shown || chr(10) || chr(10), '' ORDER BY r) FROM (SELECT shown, r FROM p WHERE k <> x.doc_id ORDER BY r LIMIT 2)), '') || q AS context FROM x",
)
def task_fewshot(t: Tables):
    task = Q.replace(LANGUAGE, num_fewshot=2, description="Name the language.\n")
    return Q.contexts(t.documents, task, "doc_id", t.documents, "first_n").select("doc_id", "context")


@query("task_scores", f"SELECT doc_id, CAST(coalesce({_CODE} = 0, FALSE) AS INT) AS acc, CAST(coalesce({_CODE} = 0, FALSE) AS INT) AS acc_norm FROM documents")
def task_scores(t: Tables):
    return Q.scored(Q.answered(Q.requests(t.documents, LANGUAGE, "doc_id"), "dummy", "multiple_choice"), "doc_id")


@query("model_rolling", "SELECT doc_id, CAST(-length(text) AS DOUBLE) AS score FROM documents")
def model_rolling(t: Tables):
    asked = Q.requests(t.documents.select("doc_id", "text"), Q.Task("all", doc_to_target="{{text}}", output_type="loglikelihood_rolling"), "doc_id")
    return Q.answered(asked, "dummy", "loglikelihood_rolling").select("doc_id", "score")


@query("model_generate", "SELECT doc_id, string_split(string_split(text, chr(10))[-1], '. ')[1] AS answer FROM documents")
def model_generate(t: Tables):
    asked = Q.requests(t.documents.select("doc_id", "text"), Q.Task("go_on", "{{text}}", "{{doc_id}}", until=[". "]), "doc_id")
    return Q.answered(asked, "dummy", "generate_until").select("doc_id", "answer")


_CLEAN = r"trim(replace(replace(replace(regexp_replace(regexp_replace(trim({0}), '\n', ' ', 'g'), '\s+', ' ', 'g'), ' . ', '. '), ' . ', '. '), ' . ', '. '))"
_PLAIN = "regexp_replace(text, '[\\t\\n\\r]+', ' ', 'g')"


def _turns(t: Tables):
    return t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).cast("string").alias("id"), "conv_id", "turn", F.regexp_replace("text", "[\t\n\r]+", " ").alias("plain"))


@query("qqp_rows", f"SELECT CAST(conv_id * 1000 + turn AS BIGINT) AS uid, {_CLEAN.format(_PLAIN)} AS text_a, {_CLEAN.format(f'reverse({_PLAIN})')} AS text_b, CAST((conv_id + turn) % 3 AS INT) AS label FROM conversations WHERE (conv_id + turn) % 3 < 2 AND trim({_PLAIN}) <> ''")
def qqp_rows(t: Tables):
    lines = _turns(t).select(F.concat_ws("\t", "id", F.lit("q1"), F.lit("q2"), "plain", F.reverse("plain"), ((F.col("conv_id") + F.col("turn")) % 3).cast("string")).alias("value"))
    header = "id\tqid1\tqid2\tquestion1\tquestion2\tis_duplicate"
    return B.qqp(lines.union(t.spark.createDataFrame([(header,), ("7\tcut short",)], "value string")), header)


@query("mnli_rows", f"SELECT CAST(conv_id * 1000 + turn AS BIGINT) AS uid, {_CLEAN.format(_PLAIN)} AS text_a, {_CLEAN.format(f'reverse({_PLAIN})')} AS text_b, CAST(turn % 4 AS INT) AS label FROM conversations WHERE turn % 4 < 3 AND trim({_PLAIN}) <> ''")
def mnli_rows(t: Tables):
    label = F.get(F.array(*map(F.lit, [*B.MNLI_LABELS, "-"])), (F.col("turn") % 4).cast("int"))
    lines = _turns(t).select(F.concat_ws("\t", "id", *[F.lit("x")] * 7, "plain", F.reverse("plain"), F.lit("y"), label).alias("value"))
    header = "\t".join(f"column{k}" for k in range(12))
    return B.mnli(lines.union(t.spark.createDataFrame([(header,)], "value string")), header)


@query("open_questions", "SELECT 'where is ' || n_name || '?' AS question, n_name || '|it''s ' || n_regionkey AS answers FROM nation")
def open_questions(t: Tables):
    lines = t.nation.select(F.concat(F.lit("where is "), "n_name", F.lit("?\t['"), "n_name", F.lit("', \"it's "), F.col("n_regionkey").cast("string"), F.lit('"]')).alias("value"))
    return B.open_questions(lines).select("question", F.array_join("answers", "|").alias("answers"))


@query("split_indices", r"SELECT doc_id, count(*) AS n, CAST(max(s) AS BIGINT) AS last_start, CAST(sum(s) AS BIGINT) AS total FROM (SELECT doc_id, sum(length(c)) OVER (PARTITION BY doc_id ORDER BY g) - length(regexp_replace(c, '^\s+', '')) AS s FROM (SELECT doc_id, unnest(w) AS c, generate_subscripts(w, 1) AS g FROM (SELECT doc_id, regexp_extract_all(text, '\s*\S+') AS w FROM documents))) GROUP BY doc_id")
def split_indices(t: Tables):
    d = t.documents.select("doc_id", T.split_indices("text").alias("s")).where(F.size("s") > 0)
    return d.select("doc_id", F.size("s").cast("bigint").alias("n"), F.array_max(F.col("s.start")).cast("bigint").alias("last_start"), F.aggregate("s", F.lit(0).cast("bigint"), lambda a, x: a + x["start"]).alias("total"))


_TOKEN = r"CASE WHEN regexp_matches(x, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$') THEN x ELSE regexp_replace(x, '[!-/:-@\[-`{-~]', '', 'g') END"
_NUMBER = r"CASE WHEN regexp_matches(x, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$') THEN CASE WHEN abs(CAST(x AS DOUBLE)) < 1e15 AND floor(CAST(x AS DOUBLE)) = CAST(x AS DOUBLE) THEN CAST(CAST(x AS DOUBLE) AS BIGINT) || '.0' ELSE CAST(CAST(x AS DOUBLE) AS VARCHAR) END ELSE x END"


@query("drop_normalize", rf"SELECT conv_id, turn, array_to_string(list_filter(list_transform(list_transform(list_transform(regexp_split_to_array(lower(text || ' 1,200 12 7.50 x-3'), ' |-'), lambda x: {_TOKEN}), lambda x: {_NUMBER}), lambda x: trim(regexp_replace(regexp_replace(regexp_replace(x, '(^|[^\p{{L}}\p{{N}}_])(?:a|an|the)([^\p{{L}}\p{{N}}_]|$)', '\1 \2', 'g'), '(^|[^\p{{L}}\p{{N}}_])(?:a|an|the)([^\p{{L}}\p{{N}}_]|$)', '\1 \2', 'g'), '\s+', ' ', 'g'))), lambda x: x <> ''), ' ') AS answer FROM conversations")
def drop_normalize(t: Tables):
    return t.conversations.select("conv_id", "turn", A.drop_answer(F.concat("text", F.lit(" 1,200 12 7.50 x-3"))).alias("answer"))


@query("block_sample", "WITH b AS (SELECT DISTINCT CAST(floor(doc_id / 100) AS BIGINT) AS block FROM documents) SELECT block FROM (SELECT block, row_number() OVER (ORDER BY md5('7:' || block), block) AS r FROM b) WHERE r <= (SELECT ceil(0.25 * count(*)) FROM b)")
def block_sample(t: Tables):
    return K.sample_blocks(t.documents.select(F.floor(F.col("doc_id") / 100).alias("block")), "block", 0.25, 7)


@query("encode_bytes", "SELECT doc_id, CAST(strlen(text) + 1 AS INT) AS n, 256 AS last, text FROM documents")
def encode_bytes(t: Tables):
    d = t.documents.select("doc_id", Z.encoded(F.col("text"), "bytes").alias("ids"))
    return d.select("doc_id", F.size("ids").alias("n"), F.element_at("ids", -1).alias("last"), Z.decoded(F.col("ids"), "bytes").alias("text"))
