"""Queries of training samples, instruction encoding, blending and benchmark cutting."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import contamination as C
from millrace.operators import grams as G
from millrace.operators import packing as K
from millrace.operators import samples as S
from millrace.operators.ranking import ranked, running
from millrace.plans.base import Tables, query, sql_query

_W = r"string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')"
_ID = "CAST(CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT) % {1} AS BIGINT)"
_IDS = f"list_transform({_W}, lambda x: {_ID.format('x', 50000)})"


def _words(t: Tables):
    return t.documents.select("doc_id", "source", "lang", T.words(F.col("text")).alias("w"))


@query("fix_text")
def fix_text(t: Tables):
    d = t.documents.select("doc_id", "text", S.fix_text("text").alias("fixed"))
    return d.select("doc_id", F.md5(F.col("fixed").cast("binary")).alias("text_md5"), (F.col("fixed") != F.col("text")).alias("changed"))


@query("oov_guard", f"SELECT doc_id, CAST(list_max({_IDS}) AS BIGINT) AS largest FROM documents WHERE list_max({_IDS}) < 49990")
def oov_guard(t: Tables):
    d = _words(t).select("doc_id", F.array_max(F.transform("w", lambda x: T.word_id(x))).alias("largest"))
    return d.where("largest < 49990")


@query("eos_filter", f"SELECT doc_id FROM documents WHERE list_contains(list_transform({_W}, lambda x: {_ID.format('x', 500)}), 2)")
def eos_filter(t: Tables):
    return _words(t).where(F.array_contains(F.transform("w", lambda x: T.word_id(x, 500)), F.lit(2).cast("bigint"))).select("doc_id")


_TURNS = rf"(SELECT conv_id, turn, a, b FROM (SELECT conv_id, turn, role, {_W} AS a, lead({_W}) OVER (PARTITION BY conv_id ORDER BY turn) AS b, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) WHERE role = 'user' AND nxt = 'assistant')"


def _turns(t: Tables):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = t.conversations.select("conv_id", "turn", "role", T.words(F.col("text")).alias("a"))
    return c.withColumn("b", F.lead("a").over(w)).withColumn("nxt", F.lead("role").over(w)).where("role = 'user' AND nxt = 'assistant'")


@query("sft_truncate_pad", f"SELECT conv_id, turn, array_to_string(list_concat(list_concat(a, b)[1:64], CASE WHEN len(a) + len(b) < 64 THEN list_transform(range(0, 64 - len(a) - len(b)), lambda x: '<pad>') ELSE [] END), ' ') AS tokens, CAST(greatest(least(len(a) + len(b), 64) - len(a), 0) AS INT) AS n_loss FROM {_TURNS} WHERE len(a) < 64")
def sft_truncate_pad(t: Tables):
    x = _turns(t).where(F.size("a") < 64)
    n = F.size("a") + F.size("b")
    return x.select("conv_id", "turn", F.array_join(K.padded(F.concat("a", "b"), 64, F.lit("<pad>")), " ").alias("tokens"), F.greatest(F.least(n, F.lit(64)) - F.size("a"), F.lit(0)).alias("n_loss"))


@query("sft_encode", f"SELECT conv_id, turn, 'user: ' || array_to_string(a, ' ') || ' assistant: ' || array_to_string(b, ' ') || ' </s>' AS text, CAST(len(a) + 2 AS INT) AS n_prompt, CAST(len(a) + len(b) + 3 AS INT) AS n_tokens FROM {_TURNS}")
def sft_encode(t: Tables):
    x = _turns(t)
    text = F.concat(F.lit("user: "), F.array_join("a", " "), F.lit(" assistant: "), F.array_join("b", " "), F.lit(" </s>"))
    return x.select("conv_id", "turn", text.alias("text"), (F.size("a") + 2).alias("n_prompt"), (F.size("a") + F.size("b") + 3).alias("n_tokens"))


@query("cls_sep_pack", f"SELECT conv_id, turn, array_to_string(list_concat(list_concat(['[CLS]'], a[1:20]), list_concat(['[SEP]'], list_concat(b[1:20], ['[SEP]']))), ' ') AS tokens, CAST(least(len(a), 20) + 2 AS INT) AS n_first, CAST(least(len(b), 20) + 1 AS INT) AS n_second FROM {_TURNS}")
def cls_sep_pack(t: Tables):
    a, b = F.slice("a", 1, 20), F.slice("b", 1, 20)
    tokens = F.concat(F.array(F.lit("[CLS]")), a, F.array(F.lit("[SEP]")), b, F.array(F.lit("[SEP]")))
    return _turns(t).select("conv_id", "turn", F.array_join(tokens, " ").alias("tokens"), (F.size(a) + 2).alias("n_first"), (F.size(b) + 1).alias("n_second"))


@query("attention_mask", f"SELECT conv_id, turn, CAST(least(len(a), 64) AS INT) AS query_end, CAST(least(len(b), 64) AS INT) AS source_end, CAST(least(len(a), 64) * least(len(b), 64) AS INT) AS n_allowed FROM {_TURNS}")
def attention_mask(t: Tables):
    q, s = F.least(F.size("a"), F.lit(64)), F.least(F.size("b"), F.lit(64))
    return _turns(t).select("conv_id", "turn", q.alias("query_end"), s.alias("source_end"), (q * s).alias("n_allowed"))


@query(
    "overlap_filter",
    f"SELECT conv_id, turn, CAST(n AS INT) AS n FROM (SELECT conv_id, turn, lb, coalesce(sum(c) FILTER (WHERE c >= 2), 0) AS n FROM (SELECT conv_id, turn, lb, run, count(*) AS c FROM (SELECT conv_id, turn, len(b) AS lb, i - row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS run FROM {_TURNS} AS x, unnest(range(1, len(b) + 1)) AS u(i) WHERE list_contains(a, b[i])) GROUP BY ALL) GROUP BY conv_id, turn, lb) WHERE n >= 0.01 * lb AND n <= 0.9 * lb",
)
def overlap_filter(t: Tables):
    x = _turns(t).withColumn("n", S.run_overlap(F.col("b"), F.col("a"), 2))
    return x.where((F.col("n") >= 0.01 * F.size("b")) & (F.col("n") <= 0.9 * F.size("b"))).select("conv_id", "turn", "n")


@query("word_ngrams", r"SELECT doc_id, g AS pos, array_to_string(w[g + 1 : g + 13], ' ') AS ngram FROM (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' ') AS w FROM documents), unnest(range(0, len(w) - 12)) AS t(g)".replace("g AS pos", "CAST(g AS INT) AS pos"))
def word_ngrams(t: Tables):
    return G.listed(t.documents.select(F.col("doc_id").alias("key"), G.plain(F.col("text")).alias("t")), 13, hashed=False).withColumnRenamed("key", "doc_id")


@query("rolling_windows", f"SELECT doc_id, CAST(k AS BIGINT) AS k, CASE WHEN k = 0 THEN -1 ELSE least(n, 128 + k * 97) - 129 END AS input_start, least(n, 128 + k * 97) AS pred_end, CASE WHEN k = 0 THEN 0 ELSE 128 + (k - 1) * 97 END AS pred_start FROM (SELECT doc_id, CAST(len({_W}) AS BIGINT) AS n FROM documents), unnest(range(0, CASE WHEN n <= 128 THEN 1 ELSE 1 + CAST(ceil((n - 128) / 97.0) AS BIGINT) END)) AS u(k)")
def rolling_windows(t: Tables):
    n = _words(t).select("doc_id", F.size("w").cast("bigint").alias("n"))
    return K.rolling(n, "n", 128, 32).select("doc_id", "k", "input_start", "pred_end", "pred_start")


_BATCH = f"(SELECT doc_id // 1000 AS batch, CAST(sum(len({_W})) AS BIGINT) AS n FROM documents GROUP BY 1)"


@query("group_texts", f"SELECT batch, CAST(n // 256 AS BIGINT) AS n_blocks, n % 256 AS n_dropped FROM {_BATCH}")
def group_texts(t: Tables):
    b = _words(t).groupBy(F.floor(F.col("doc_id") / 1000).alias("batch")).agg(F.sum(F.size("w")).alias("n"))
    return b.select("batch", F.floor(F.col("n") / 256).alias("n_blocks"), (F.col("n") % 256).alias("n_dropped"))


@query("num_epochs", f"SELECT CAST(sum(len({_W})) AS BIGINT) AS n_tokens, CAST(ceil((100000 * 256 + 1) / CAST(sum(len({_W})) AS DOUBLE)) AS BIGINT) AS n_epochs FROM documents")
def num_epochs(t: Tables):
    n = _words(t).agg(F.sum(F.size("w")).alias("n_tokens"))
    return n.withColumn("n_epochs", F.ceil(F.lit(100000 * 256 + 1) / F.col("n_tokens").cast("double")))


_LEN = f"(SELECT doc_id, CAST(len({_W}) AS BIGINT) AS n FROM documents)"
_PACK = f"(SELECT doc_id, CAST(j AS BIGINT) AS sample_id, CAST(greatest(0, j * 256 - a) AS BIGINT) AS s, CAST(least(n, (j + 1) * 256 - a) AS BIGINT) AS e, a FROM (SELECT doc_id, n, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM {_LEN}), unnest(range(CAST(a // 256 AS BIGINT), CAST((a + n - 1) // 256 AS BIGINT) + 1)) AS u(j))"


def _packed(t: Tables):
    return K.pack(_words(t).select("doc_id", F.size("w").cast("bigint").alias("n")), "doc_id", "n", 256)


@query("position_ids", f"SELECT sample_id, doc_id, CAST(sum(e - s) OVER (PARTITION BY sample_id ORDER BY doc_id) - (e - s) AS BIGINT) AS segment_start, e - s AS n_positions FROM {_PACK}")
def position_ids(t: Tables):
    n = F.col("doc_end") - F.col("doc_start")
    return _packed(t).select("sample_id", "doc_id", (F.sum(n).over(Window.partitionBy("sample_id").orderBy("doc_id")) - n).alias("segment_start"), n.alias("n_positions"))


@query("loss_mask", f"SELECT sample_id, CAST(sum(e - s) AS BIGINT) AS n_tokens, CAST(sum(CASE WHEN e = n THEN e - s - 1 ELSE e - s END) AS BIGINT) AS n_in_loss FROM {_PACK} JOIN {_LEN} USING (doc_id) GROUP BY sample_id")
def loss_mask(t: Tables):
    n = _words(t).select("doc_id", F.size("w").cast("bigint").alias("n"))
    own = F.col("doc_end") - F.col("doc_start")
    x = _packed(t).join(n, "doc_id")
    return x.groupBy("sample_id").agg(F.sum(own).alias("n_tokens"), F.sum(F.when(F.col("doc_end") == F.col("n"), own - 1).otherwise(own)).alias("n_in_loss"))


@query("shuffle_index", "SELECT CAST(range_id AS INT) AS range_id, doc_id, row_number() OVER (PARTITION BY range_id ORDER BY md5('5:' || doc_id), doc_id) AS place FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN 1 ELSE 0 END AS range_id FROM documents)")
def shuffle_index(t: Tables):
    d = t.documents.select("doc_id", F.when(F.col("doc_id") % 5 == 4, 1).otherwise(0).alias("range_id"))
    return ranked(d, ["range_id"], [T.key_order("5", F.col("doc_id")), "doc_id"]).select("range_id", "doc_id", "place")


@query("rank_batches_random", "SELECT CAST(doc_id % 4 AS BIGINT) AS rank, doc_id, CAST((row_number() OVER (PARTITION BY doc_id % 4 ORDER BY md5('3:' || doc_id), doc_id) - 1) // 8 AS BIGINT) AS step FROM documents")
def rank_batches_random(t: Tables):
    r = ranked(t.documents.select((F.col("doc_id") % 4).alias("rank"), "doc_id"), ["rank"], [T.key_order("3", F.col("doc_id")), "doc_id"], "nth")
    return r.select("rank", "doc_id", F.floor((F.col("nth") - 1) / 8).alias("step"))


@query("length_batches", "SELECT lang, doc_id, CAST((row_number() OVER (PARTITION BY lang ORDER BY length(text) DESC, doc_id) - 1) // 16 AS BIGINT) AS batch FROM documents")
def length_batches(t: Tables):
    d = t.documents.select("lang", "doc_id", F.length("text").alias("n"))
    return ranked(d, ["lang"], [F.desc("n"), "doc_id"], "nth").select("lang", "doc_id", F.floor((F.col("nth") - 1) / 16).alias("batch"))


sql_query("context_groups", "SELECT role, substr(text, 1, 3) AS context, count(*) AS n, min(conv_id) AS first_conv FROM conversations GROUP BY role, substr(text, 1, 3)")


@query("merge_indexed", f"SELECT source, doc_id, CAST(sum(n) OVER (ORDER BY source, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS BIGINT) * 4 AS byte_ptr FROM (SELECT source, doc_id, CAST(len({_W}) AS BIGINT) AS n FROM documents)")
def merge_indexed(t: Tables):
    # offsets inside each part, then the parts' totals run over in a small table
    d = _words(t).select("source", "doc_id", F.size("w").cast("bigint").alias("n"))
    parts = d.groupBy("source").agg(F.sum("n").alias("total"))
    parts = parts.select("source", F.coalesce(F.sum("total").over(Window.orderBy("source").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = running(d, "doc_id", {"own": F.col("n")}, ["source"])
    return own.join(parts, "source").select("source", "doc_id", ((F.col("base") + F.col("own_before")) * 4).alias("byte_ptr"))


_SPLIT = "SELECT doc_id, CASE WHEN r < round_even(0.969 * n, 0) THEN 'train' WHEN r < round_even(0.999 * n, 0) THEN 'valid' ELSE 'test' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () AS n FROM documents)"


@query("train_valid_test", f"SELECT split, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM ({_SPLIT}) GROUP BY split")
def train_valid_test(t: Tables):
    s = K.split_by_place(t.documents.select("doc_id"), "doc_id", [("train", 0.969), ("valid", 0.999), ("test", 1.0)])
    return s.groupBy("split").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))




@query("split_matrix", "SELECT x.split, y.split AS other, CASE WHEN greatest(x.a, y.a) < least(x.b, y.b) THEN greatest(x.a, y.a) END AS start, CASE WHEN greatest(x.a, y.a) < least(x.b, y.b) THEN least(x.b, y.b) END AS \"end\" FROM (SELECT CAST(c1 AS INT) AS split, CAST(c2 AS DOUBLE) AS a, CAST(c3 AS DOUBLE) AS b FROM (VALUES (0, 0.0, 0.9), (1, 0.9, 0.97), (2, 0.97, 1.0)) AS v(c1, c2, c3)) AS x, (SELECT CAST(c1 AS INT) AS split, CAST(c2 AS DOUBLE) AS a, CAST(c3 AS DOUBLE) AS b FROM (VALUES (0, 0.0, 0.5), (1, 0.5, 0.95), (2, 0.95, 1.0)) AS v(c1, c2, c3)) AS y")
def split_matrix(t: Tables):
    return K.split_overlaps(t.spark, [0.0, 0.9, 0.97, 1.0], [0.0, 0.5, 0.95, 1.0])


_BL = "(SELECT source, count(*) AS n FROM documents GROUP BY source)"


@query("blend_exhaustive", f"SELECT source, CAST(k AS BIGINT) AS sample_id, round((k + 0.5) / n, 9) AS turn FROM {_BL}, unnest(range(0, n)) AS u(k)")
def blend_exhaustive(t: Tables):
    b = t.documents.groupBy("source").agg(F.count("*").alias("n"))
    return K.blend(b.withColumn("weight", F.col("n").cast("double")), "source", "weight", 1).select("source", "sample_id", F.round("turn", 9).alias("turn"))


@query("blend_lookup", "WITH d AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k FROM documents) SELECT source, k AS sample_id, doc_id FROM d")
def blend_lookup(t: Tables):
    d = ranked(t.documents.select("source", "doc_id"), ["source"], ["doc_id"], "nth").select("source", "doc_id", (F.col("nth") - 1).alias("sample_id"))
    return blend_exhaustive(t).select("source", "sample_id").join(d, ["source", "sample_id"]).select("source", "sample_id", "doc_id")


@query("join_wordpieces", r"SELECT item_id, replace(array_to_string(string_split(trim(regexp_replace(text, '([a-z]{4})([a-z])', '\1 ##\2', 'g')), ' '), ' '), ' ##', '') AS text FROM benchmark")
def join_wordpieces(t: Tables):
    pieces = F.split(F.trim(F.regexp_replace("text", "([a-z]{4})([a-z])", "$1 ##$2")), " ")
    return t.benchmark.select("item_id", T.join_pieces(pieces).alias("text"))


_HEAD = "regexp_extract(x, '^(the|on|in|is|[a-z])')"
_PIECES = f"CASE WHEN x IN (',', '.') THEN x WHEN NOT regexp_matches(x, '^[a-z]+$') OR length(x) > 100 THEN '[UNK]' ELSE array_to_string(list_concat([{_HEAD}], list_transform(regexp_extract_all(substr(x, length({_HEAD}) + 1), 'er|th|on|es|in|[a-z]'), lambda y: '##' || y)), ' ') END"


@query("wordpiece", rf"SELECT doc_id, CAST(CASE WHEN p = '' THEN 0 ELSE length(p) - length(replace(p, ' ', '')) + 1 END AS INT) AS n, p AS pieces FROM (SELECT doc_id, array_to_string(list_transform(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}\s]'), lambda x: {_PIECES}), ' ') AS p FROM documents)")
def wordpiece(t: Tables):
    letters = "abcdefghijklmnopqrstuvwxyz"
    vocabulary = set(letters) | {"##" + c for c in letters} | {"the", "##er", "##th", "on", "##on", "##es", "in", "##in", "is", ",", "."}
    p = S.wordpiece(vocabulary)("text")
    return t.documents.select("doc_id", p.alias("p")).select("doc_id", F.size("p").alias("n"), F.array_join(F.col("p"), " ").alias("pieces"))


@query("apply_diff", "SELECT doc_id, string_split(text, chr(10))[1] IS NOT NULL AS fits, 'changed' || chr(10) || text AS text FROM documents")
def apply_diff(t: Tables):
    first = F.get(F.split("text", "\n"), F.lit(0))
    diff = F.concat(F.lit("@@ -1,1 +1,2 @@\n-"), first, F.lit("\n+changed\n+"), first)
    return t.documents.select("doc_id", S.patched("text", diff).alias("text")).select("doc_id", F.col("text").isNotNull().alias("fits"), "text")


@query("janitor_clean")
def janitor_clean(t: Tables):
    c = C.janitor(t.documents, t.benchmark)
    return c.select("doc_id", "n_hits", F.size("chunks").alias("n_chunks"), F.md5(F.array_join("chunks", "\u0001").cast("binary")).alias("chunks_md5"))


@query("decontaminate_ngrams")
def decontaminate_ngrams(t: Tables):
    words = t.benchmark.select(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)).alias("w"))
    return C.without_ngrams(t.documents, words.select(F.explode(T.ngrams(F.col("w"), 13)).alias("ngram")))


@query("bert_samples")
def bert_samples(t: Tables):
    return S.bert_samples(t.documents, "doc_id", "text")


@query("t5_samples")
def t5_samples(t: Tables):
    return S.t5_samples(t.documents, "doc_id", "text")


@query("sentence_pack")
def sentence_pack(t: Tables):
    return S.sentence_samples(t.documents, "doc_id", "text")


@query("ict_samples")
def ict_samples(t: Tables):
    return S.ict_samples(t.documents, "doc_id", "text")


@query("sft_pack", """WITH RECURSIVE c AS (SELECT conv_id * 1000 + turn AS key, len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS n FROM conversations),
r AS (SELECT key, least(n, 512) AS n, greatest(n - 512, 0) AS cut, row_number() OVER (ORDER BY key) - 1 AS i FROM c WHERE n > 0),
f(i, g, sample, used) AS (SELECT i, CAST(0 AS BIGINT), CAST(0 AS BIGINT), n FROM r WHERE i = 0
UNION ALL SELECT r.i, r.i // 65536, CASE WHEN r.i % 65536 = 0 THEN 0 WHEN f.used + r.n > 512 THEN f.sample + 1 ELSE f.sample END, CASE WHEN r.i % 65536 = 0 OR f.used + r.n > 512 THEN r.n ELSE f.used + r.n END FROM f JOIN r ON r.i = f.i + 1)
SELECT CAST(g AS BIGINT) AS "group", CAST(sample AS BIGINT) AS sample, CAST(key AS BIGINT) AS key, CAST(used - n AS BIGINT) AS start, CAST(used AS BIGINT) AS "end", CAST(cut AS BIGINT) AS n_cut FROM f JOIN r USING (i)""")
def sft_pack(t: Tables):
    x = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), F.size(T.words(F.col("text"))).alias("n"))
    return S.pack_in_order(x, "key", "n", 512)
