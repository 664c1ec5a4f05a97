"""Queries of token stores, packing, blending, splits and sample order."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import packing as K
from millrace.operators import records as R
from millrace.operators.ranking import ranked
from millrace.plans.base import Tables, query, sql_query

_W = r"string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')"
_LEN = f"(SELECT doc_id, source, lang, len({_W}) AS n FROM documents)"
_ID = "CAST(CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT) % 50000 AS BIGINT)"


def _lengths(t: Tables):
    return t.documents.select("doc_id", "source", "lang", F.size(T.words(F.col("text"))).cast("bigint").alias("n"))


@query("idx_layout", f"SELECT doc_id, n, CAST(coalesce(sum(n * 4) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_ptr, row_number() OVER (ORDER BY doc_id) AS end_mark FROM {_LEN}")
def idx_layout(t: Tables):
    out = K.running(_lengths(t).select("doc_id", "n"), "doc_id", {"tokens": F.col("n"), "rows": F.lit(1)})
    return out.select("doc_id", "n", (F.col("tokens_before") * 4).alias("byte_ptr"), (F.col("rows_before") + 1).alias("end_mark"))


@query("encode_docs", f"SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, CAST(list_sum(list_transform(w, lambda x: {_ID.format('x')})) AS BIGINT) AS id_sum FROM (SELECT doc_id, {_W} AS w FROM documents)")
def encode_docs(t: Tables):
    w = t.documents.select("doc_id", F.transform(T.words(F.col("text")), lambda x: T.word_id(x)).alias("ids"))
    return w.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("id_sum"))


@query("token_slice", f"SELECT doc_id, array_to_string({_W}[11:20], ' ') AS piece FROM documents")
def token_slice(t: Tables):
    return t.documents.select("doc_id", F.array_join(F.slice(T.words(F.col("text")), 11, 10), " ").alias("piece"))


@query("pack_samples", f"WITH o AS (SELECT doc_id, n, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM {_LEN}), s AS (SELECT doc_id, n, a, j FROM o, unnest(range(CAST(a // 256 AS BIGINT), CAST((a + n - 1) // 256 AS BIGINT) + 1)) AS t(j)) SELECT CAST(j AS BIGINT) AS sample_id, doc_id, CAST(greatest(0, j * 256 - a) AS BIGINT) AS doc_start, CAST(least(n, (j + 1) * 256 - a) AS BIGINT) AS doc_end FROM s")
def pack_samples(t: Tables):
    return K.pack(_lengths(t).select("doc_id", "n"), "doc_id", "n", 256)


@query("sample_index", f"WITH o AS (SELECT doc_id, n, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM {_LEN}), s AS (SELECT doc_id, n, a, j FROM o, unnest(range(CAST(a // 256 AS BIGINT), CAST((a + n - 1) // 256 AS BIGINT) + 1)) AS t(j)) SELECT CAST(j AS BIGINT) AS sample_id, min(doc_id) AS first_doc, max(doc_id) AS last_doc, CAST(sum(least(n, (j + 1) * 256 - a) - greatest(0, j * 256 - a)) AS BIGINT) AS n_tokens FROM s GROUP BY j")
def sample_index(t: Tables):
    p = pack_samples(t)
    return p.groupBy("sample_id").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.sum(F.col("doc_end") - F.col("doc_start")).alias("n_tokens"))


@query("chunk_docs", f"SELECT doc_id, CAST(s AS BIGINT) AS tok_start, CAST(least(s + 64, n) AS BIGINT) AS tok_end FROM {_LEN}, unnest(range(0, n, 64)) AS t(s)")
def chunk_docs(t: Tables):
    return K.windows(_lengths(t), "n", 64, 64).select("doc_id", F.col("start").alias("tok_start"), F.col("end").alias("tok_end"))


@query("lm_windows", f"SELECT doc_id, CAST(s AS BIGINT) AS start, CAST(least(s + 128, n) AS BIGINT) AS \"end\", CAST(CASE WHEN s = 0 THEN least(128, n) ELSE least(s + 128, n) - (s + 96) END AS BIGINT) AS scored FROM {_LEN}, unnest(range(0, CASE WHEN n <= 128 THEN 1 ELSE n - 96 END, 32)) AS t(s)")
def lm_windows(t: Tables):
    w = K.overlapping(_lengths(t), "n", 128, 32)
    return w.select("doc_id", "start", "end", F.when(F.col("start") == 0, F.col("end")).otherwise(F.col("end") - F.col("start") - 96).alias("scored"))


@query("doc_chunk_offsets", f"WITH c AS (SELECT doc_id, CAST(ceil(n / 64.0) AS BIGINT) AS n_chunks FROM {_LEN}) SELECT doc_id, n_chunks, CAST(sum(n_chunks) OVER (ORDER BY doc_id) AS BIGINT) AS end_chunk FROM c")
def doc_chunk_offsets(t: Tables):
    c = _lengths(t).select("doc_id", F.ceil(F.col("n") / 64.0).alias("n_chunks"))
    out = K.running(c, "doc_id", {"c": F.col("n_chunks")})
    return out.select("doc_id", "n_chunks", (F.col("c_before") + F.col("n_chunks")).alias("end_chunk"))


@query("chunk_counts", f"SELECT source, CAST(sum(ceil(n / 64.0)) AS BIGINT) AS n_total, CAST(sum(CASE WHEN n >= 5 THEN ceil(n / 64.0) ELSE 0 END) AS BIGINT) AS n_valid, CAST(floor(sum(ceil(n / 64.0)) * 0.25) AS BIGINT) AS n_sampled FROM {_LEN} GROUP BY source")
def chunk_counts(t: Tables):
    c = F.ceil(F.col("n") / 64.0)
    return _lengths(t).groupBy("source").agg(F.sum(c).alias("n_total"), F.sum(F.when(F.col("n") >= 5, c).otherwise(0)).alias("n_valid"), F.floor(F.sum(c) * 0.25).alias("n_sampled"))


@query("shuffle_docs", "SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('1234:' || doc_id), doc_id) AS place FROM documents")
def shuffle_docs(t: Tables):
    return ranked(t.documents.select("doc_id", "lang"), ["lang"], [T.key_order("1234", F.col("doc_id")), "doc_id"]).select("doc_id", "place")


@query("document_index", "SELECT epoch, doc_id, row_number() OVER (PARTITION BY epoch ORDER BY md5('7:' || epoch || ':' || doc_id), doc_id) AS place FROM documents, unnest(range(0, 3)) AS t(epoch)")
def document_index(t: Tables):
    e = t.documents.select("doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))).alias("epoch"))
    return ranked(e, ["epoch"], [T.key_order("7", F.col("epoch"), F.col("doc_id")), "doc_id"]).select("epoch", "doc_id", "place")


@query("split_docs", "SELECT doc_id, CASE WHEN r < round(0.969 * n) THEN 'train' WHEN r < round(0.999 * n) THEN 'valid' ELSE 'test' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () AS n FROM documents)")
def split_docs(t: Tables):
    return K.split_by_place(t.documents.select("doc_id"), "doc_id", [("train", 0.969), ("valid", 0.999), ("test", 1.0)])


@query("seq_partitions", "SELECT doc_id, CAST(floor(r / ceil(n / 8.0)) AS BIGINT) AS part FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () AS n FROM documents)")
def seq_partitions(t: Tables):
    out = ranked(t.documents.select("doc_id"), [], ["doc_id"], "r", "n")
    return out.select("doc_id", F.floor((F.col("r") - 1) / F.ceil(F.col("n") / 8.0)).alias("part"))


@query("rank_batches", "SELECT doc_id, CAST(p // 32 AS BIGINT) AS step, CAST((p % 32) // 8 AS BIGINT) AS rank FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p, count(*) OVER () AS n FROM documents) WHERE p < n // 32 * 32")
def rank_batches(t: Tables):
    out = ranked(t.documents.select("doc_id"), [], ["doc_id"], "r", "n").withColumn("p", F.col("r") - 1).where(F.col("p") < F.floor(F.col("n") / 32) * 32)
    return out.select("doc_id", F.floor(F.col("p") / 32).alias("step"), F.floor(F.col("p") % 32 / 8).alias("rank"))


_BLEND = "SELECT source, n_docs, n_docs / CAST(sum(n_docs) OVER () AS DOUBLE) AS weight, CAST(ceil(1000 * (n_docs / CAST(sum(n_docs) OVER () AS DOUBLE)) * 1.005) AS BIGINT) AS size FROM (SELECT source, count(*) AS n_docs FROM documents GROUP BY source)"


@query("blend_sizes", _BLEND)
def blend_sizes(t: Tables):
    return K.blend_sizes(t.documents.groupBy("source").agg(F.count("*").alias("n_docs")), "n_docs", 1000)


@query("blend_weighted", "WITH b AS (SELECT source, n_docs, n_docs / CAST(sum(n_docs) OVER () AS DOUBLE) AS w FROM (SELECT source, count(*) AS n_docs FROM documents GROUP BY source)) SELECT source, count(*) AS n_samples FROM b, unnest(range(0, 1000)) AS t(k) WHERE k < round(w * 1000) GROUP BY source")
def blend_weighted(t: Tables):
    b = K.blend_sizes(t.documents.groupBy("source").agg(F.count("*").alias("n_docs")), "n_docs", 1000)
    return K.blend(b, "source", "weight", 1000).groupBy("source").agg(F.count("*").alias("n_samples"))


@query("pad_ids", f"SELECT doc_id, array_to_string(list_concat(w[1:16], CASE WHEN len(w) < 16 THEN list_transform(range(0, 16 - len(w)), lambda x: '0') ELSE [] END), ' ') AS ids FROM (SELECT doc_id, {_W} AS w FROM documents)")
def pad_ids(t: Tables):
    return t.documents.select("doc_id", F.array_join(K.padded(T.words(F.col("text")), 16, F.lit("0")), " ").alias("ids"))


@query("chatml_render", "SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>', chr(10) ORDER BY turn) AS prompt FROM conversations GROUP BY conv_id")
def chatml_render(t: Tables):
    return K.chatml(t.conversations, "conv_id", "turn", "role", "text")


@query("chat_loss_mask", "SELECT conv_id, turn, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS \"end\", role = 'assistant' AS in_loss FROM conversations")
def chat_loss_mask(t: Tables):
    w = Window.partitionBy("conv_id").orderBy("turn")
    end = F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return t.conversations.select("conv_id", "turn", (end - F.length("text")).alias("start"), end.alias("end"), (F.col("role") == "assistant").alias("in_loss"))


@query("dialog_context", "SELECT conv_id, turn, coalesce(string_agg(text, ' [SEP] ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS context FROM conversations")
def dialog_context(t: Tables):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-3, -1)
    return t.conversations.select("conv_id", "turn", F.array_join(F.collect_list("text").over(w), " [SEP] ").alias("context"))


sql_query("merge_union", "SELECT 'documents' AS origin, doc_id AS id, text FROM documents UNION ALL SELECT 'benchmark' AS origin, item_id AS id, text FROM benchmark")
sql_query("length_describe", "SELECT count(*) AS n, avg(length(text)) AS mean, stddev_samp(length(text)) AS std, CAST(min(length(text)) AS BIGINT) AS least, percentile(length(text), 0.25) AS p25, percentile(length(text), 0.5) AS p50, percentile(length(text), 0.75) AS p75, CAST(max(length(text)) AS BIGINT) AS most FROM conversations", "SELECT count(*) AS n, avg(length(text)) AS mean, stddev_samp(length(text)) AS std, CAST(min(length(text)) AS BIGINT) AS least, quantile_cont(length(text), 0.25) AS p25, quantile_cont(length(text), 0.5) AS p50, quantile_cont(length(text), 0.75) AS p75, CAST(max(length(text)) AS BIGINT) AS most FROM conversations")


@query("split_ntile", "SELECT doc_id, CAST(ntile(4) OVER (PARTITION BY lang ORDER BY doc_id) AS INT) AS part FROM documents")
def split_ntile(t: Tables):
    return K.near_equal(t.documents.select("doc_id", "lang"), ["lang"], "doc_id", 4).select("doc_id", "part")


@query("chunk_sampled", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents) AS x WHERE r <= floor(n * 0.25)")
def chunk_sampled(t: Tables):
    return R.fraction_per_class(t.documents.select("source", "doc_id"), "source", "doc_id", 0.25)


sql_query("fewshot_firstn", "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) AS x WHERE r <= 5")
sql_query("fewshot_sample", "SELECT lang, doc_id, md5(concat('11:', doc_id)) AS k FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(concat('11:', doc_id)), doc_id) AS r FROM documents) AS x WHERE r <= 6")
sql_query("missing_blocks", "SELECT d.block, count(*) AS n FROM (SELECT CAST(floor(doc_id / 100) AS BIGINT) AS block, doc_id FROM documents) AS d LEFT JOIN (SELECT CAST(floor(doc_id / 100) AS BIGINT) AS block FROM labels GROUP BY CAST(floor(doc_id / 100) AS BIGINT) HAVING sum(toxic) >= 4) AS l ON d.block = l.block WHERE l.block IS NULL GROUP BY d.block")
sql_query("blend_audit", "SELECT source, count(*) AS n_docs, least(count(*), 50) AS drawn, count(*) < 50 AS oversampled FROM documents GROUP BY source")
sql_query("regroup_docs", "SELECT conv_id, count(*) AS n_turns, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
sql_query("multichoice_prompt", "SELECT item_id, concat('Question: ', text, ' Options: (A) yes (B) no Answer:') AS prompt FROM benchmark")
