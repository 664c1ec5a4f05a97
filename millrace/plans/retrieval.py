"""Queries of neighbour search, retrieval contexts and row routing.

Queries of a search are the vectors whose id is divisible by 20, against all vectors; a vector's
document is its id divided by 4.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import retrieval as R
from millrace.operators.ranking import ranked
from millrace.plans.base import Tables, query, sql_query, unit, unit_duck

_DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST(q.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE)))"
_L2 = "list_sum(list_transform(range(1, 65), lambda i: pow(CAST(q.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE), 2)))"
_NEAR = f"(SELECT query, id, CAST(row_number() OVER (PARTITION BY query ORDER BY round(d, 9), id) AS INT) AS rank, d FROM (SELECT q.vec_id AS query, b.vec_id AS id, {_L2} AS d FROM embeddings AS q, embeddings AS b WHERE q.vec_id % 20 = 0 AND q.vec_id <> b.vec_id))"


def _near(t: Tables, k: int, metric: str = "l2"):
    e = t.embeddings
    return R.top_k(e.where("vec_id % 20 = 0"), e, k, metric, id_col="vec_id")


@query("knn_l2", f"SELECT query, id, rank, round(d, 6) AS distance FROM {_NEAR} WHERE rank <= 10")
def knn_l2(t: Tables):
    return _near(t, 10).select("query", "id", "rank", F.round("distance", 6).alias("distance"))


@query("mips_topk", f"SELECT query, id, rank, round(d, 6) AS score FROM (SELECT query, id, CAST(row_number() OVER (PARTITION BY query ORDER BY round(-d, 9), id) AS INT) AS rank, d FROM (SELECT q.vec_id AS query, b.vec_id AS id, {_DOT} AS d FROM embeddings AS q, embeddings AS b WHERE q.vec_id % 20 = 0 AND q.vec_id <> b.vec_id)) WHERE rank <= 10")
def mips_topk(t: Tables):
    return _near(t, 10, "ip").select("query", "id", "rank", F.round("distance", 6).alias("score"))


_CAUSAL = f"(SELECT query, id, CAST(row_number() OVER (PARTITION BY query ORDER BY rank) AS INT) AS place FROM {_NEAR} WHERE rank <= 20 AND query // 4 <> id // 4)"


def _causal(t: Tables):
    owner = t.embeddings.select(F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 4).alias("doc"))
    return R.causal(_near(t, 20), owner, 5)


@query("knn_causal_filter", f"SELECT query, id, place FROM {_CAUSAL} WHERE place <= 5")
def knn_causal_filter(t: Tables):
    return _causal(t)


@query("retro_context", f"SELECT query, id, place, CAST(s AS INT) AS step, (id + s) % (SELECT count(*) FROM embeddings) AS chunk FROM {_CAUSAL}, unnest(range(0, 2)) AS u(s) WHERE place <= 5")
def retro_context(t: Tables):
    return R.continuations(_causal(t), t.embeddings.count(), 2)


@query("topk_hits", f"SELECT k, CAST(sum(CAST(first <= k AS INT)) AS BIGINT) AS hits, count(*) AS n, round(avg(CAST(first <= k AS INT)), 6) AS accuracy FROM (SELECT n.query, coalesce(min(rank) FILTER (a.label = b.label), 99) AS first FROM {_NEAR} AS n JOIN embeddings AS a ON a.vec_id = n.query JOIN embeddings AS b ON b.vec_id = n.id WHERE rank <= 10 GROUP BY n.query), (SELECT unnest([1, 5, 10]) AS k) GROUP BY k")
def topk_hits(t: Tables):
    lab = t.embeddings.select("vec_id", "label")
    n = _near(t, 10).join(lab.toDF("query", "a"), "query").join(lab.toDF("id", "b"), "id")
    first = n.groupBy("query").agg(F.coalesce(F.min(F.when(F.col("a") == F.col("b"), F.col("rank"))), F.lit(99)).alias("first"))
    at = first.select("first", F.explode(F.array(F.lit(1), F.lit(5), F.lit(10))).alias("k"))
    hit = (F.col("first") <= F.col("k")).cast("int")
    return at.groupBy("k").agg(F.sum(hit).alias("hits"), F.count("*").alias("n"), F.round(F.avg(hit), 6).alias("accuracy"))


@query("prompt_topk", f"SELECT query, id, CAST(11 - rank AS INT) AS place FROM {_NEAR} WHERE rank <= 10")
def prompt_topk(t: Tables):
    return _near(t, 10).select("query", "id", (11 - F.col("rank")).alias("place"))


@query("neighbor_stats", f"SELECT count(*) AS n, round(avg(d), 6) AS mean, round(min(d), 6) AS least, round(max(d), 6) AS most FROM {_NEAR} WHERE rank <= 20")
def neighbor_stats(t: Tables):
    d = F.col("distance")
    return _near(t, 20).agg(F.count("*").alias("n"), F.round(F.avg(d), 6).alias("mean"), F.round(F.min(d), 6).alias("least"), F.round(F.max(d), 6).alias("most"))


@query("ivf_assign")
def ivf_assign(t: Tables):
    return R.assign_cells(t.embeddings, R.train_cells(t.embeddings, 16, id_col="vec_id"), id_col="vec_id")


@query("ivf_search")
def ivf_search(t: Tables):
    """Neighbours among the vectors of a query's nearest cells; every vector is in the index."""
    e = t.embeddings
    return R.index("cells", e, id_col="vec_id").search(e.where("vec_id % 20 = 0"), 10).select("query", "id", "rank")


@query("embed_docs")
def embed_docs(t: Tables):
    """A vector of each document: signed counts of its words in 64 hashed places, scaled to length one."""
    w = t.documents.select("doc_id", F.explode(T.words(F.lower("text"))).alias("w")).where("w <> ''")
    c = w.groupBy("doc_id", F.pmod(F.xxhash64("w"), F.lit(64)).alias("place")).agg(F.sum(F.when(F.xxhash64(F.lit(1), "w") % 2 == 0, 1).otherwise(-1)).cast("double").alias("x"))
    v = c.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("place", "x"))).alias("m"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.try_element_at("m", i.cast("bigint")), F.lit(0.0)) / F.greatest("norm", F.lit(1.0)))
    return v.select("doc_id", dense.alias("embedding"))


_W = r"string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')"


@query("chunk_validity", rf"SELECT doc_id, CAST(s // 64 AS BIGINT) AS chunk, CASE WHEN regexp_matches(array_to_string(w[s + 1 : s + 64], ' '), '[\p{{L}}\p{{N}}]') THEN 'valid' ELSE 'invalid' END AS side FROM (SELECT doc_id, {_W} AS w FROM documents), unnest(range(0, len(w), 64)) AS u(s)")
def chunk_validity(t: Tables):
    c = _chunks(t)
    return c.select("doc_id", "chunk", F.when(F.col("text").rlike(r"[\p{L}\p{N}]"), "valid").otherwise("invalid").alias("side"))


def _chunks(t: Tables):
    w = t.documents.select("doc_id", T.words(F.col("text")).alias("w"))
    cut = F.transform(F.sequence(F.lit(0), F.size("w") - 1, F.lit(64)), lambda s: F.array_join(F.slice("w", s + 1, F.lit(64)), " "))
    return w.select("doc_id", F.posexplode(cut).alias("chunk", "text")).withColumn("chunk", F.col("chunk").cast("bigint"))


@query("chunk_db", f"SELECT source, CASE WHEN doc_id % 10 = 9 THEN 'valid' ELSE 'train' END AS split, count(*) AS n_chunks, CAST(sum(least(64, n - s)) AS BIGINT) AS n_tokens FROM (SELECT doc_id, source, len({_W}) AS n FROM documents), unnest(range(0, n, 64)) AS u(s) GROUP BY ALL")
def chunk_db(t: Tables):
    c = t.documents.select("doc_id", "source", F.size(T.words(F.col("text"))).cast("bigint").alias("n"))
    split = F.when(F.col("doc_id") % 10 == 9, "valid").otherwise("train")
    return c.groupBy("source", split.alias("split")).agg(F.sum(F.ceil(F.col("n") / 64.0)).cast("bigint").alias("n_chunks"), F.sum("n").alias("n_tokens"))


@query("topic_semi", "SELECT role, count(*) AS n, count(DISTINCT conv_id) AS n_conversations FROM conversations AS c WHERE EXISTS (SELECT 1 FROM labels AS l WHERE l.doc_id = c.conv_id AND l.quality = 1) GROUP BY role")
def topic_semi(t: Tables):
    good = t.labels.where("quality = 1").select(F.col("doc_id").alias("conv_id"))
    return t.conversations.join(good, "conv_id", "left_semi").groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("n_conversations"))


@query("shard_merge", "SELECT vec_id, count(*) AS n_shards FROM (SELECT vec_id FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT vec_id FROM embeddings WHERE vec_id % 2 = 1) GROUP BY vec_id HAVING count(*) = 1")
def shard_merge(t: Tables):
    e = t.embeddings.select("vec_id")
    both = e.where("vec_id % 2 = 0").union(e.where("vec_id % 2 = 1"))
    return both.groupBy("vec_id").agg(F.count("*").alias("n_shards")).where("n_shards = 1")


# Routing of rows to targets: an event's target is its user modulo 16, its score a hash of its id.
_EV = f"(SELECT event_id, user_id % 16 AS target, {unit_duck('event_id')} AS p, value FROM events)"


def _routed(t: Tables):
    return t.events.select("event_id", (F.col("user_id") % 16).alias("target"), unit(F.col("event_id")).alias("p"), "value")


@query("topk_capacity", f"SELECT event_id, target, CAST(row_number() OVER (PARTITION BY target ORDER BY p DESC, event_id) - 1 AS INT) AS slot, row_number() OVER (PARTITION BY target ORDER BY p DESC, event_id) > 50 AS dropped FROM {_EV}")
def topk_capacity(t: Tables):
    return R.with_capacity(_routed(t), "target", "p", 50, "event_id").select("event_id", "target", "slot", "dropped")


@query("expert_histogram", f"SELECT target, count(*) AS n FROM {_EV} GROUP BY target")
def expert_histogram(t: Tables):
    return _routed(t).groupBy("target").agg(F.count("*").alias("n"))


_ENDS = f"(SELECT target, n, sum(n) OVER (ORDER BY target) AS incl, sum(n) OVER (ORDER BY target) - n AS excl FROM (SELECT target, count(*) AS n FROM {_EV} GROUP BY target))"


def _bins(t: Tables):
    h = expert_histogram(t)
    incl = F.sum("n").over(Window.orderBy("target"))
    return h.select("target", "n", incl.alias("incl"), (incl - F.col("n")).alias("excl"))


@query("cumsum_incl", f"SELECT target, CAST(incl AS BIGINT) AS ends FROM {_ENDS}")
def cumsum_incl(t: Tables):
    return _bins(t).select("target", F.col("incl").alias("ends"))


@query("cumsum_excl", f"SELECT target, CAST(excl AS BIGINT) AS starts FROM {_ENDS}")
def cumsum_excl(t: Tables):
    return _bins(t).select("target", F.col("excl").alias("starts"))


@query("replicate_bins", f"SELECT event_id, CAST(excl AS BIGINT) AS starts FROM {_EV} JOIN {_ENDS} USING (target)")
def replicate_bins(t: Tables):
    return _routed(t).join(_bins(t), "target").select("event_id", F.col("excl").alias("starts"))


@query("permute_restore", f"SELECT event_id, CAST(excl + row_number() OVER (PARTITION BY target ORDER BY event_id) - 1 AS BIGINT) AS place FROM {_EV} JOIN {_ENDS} USING (target)")
def permute_restore(t: Tables):
    r = ranked(_routed(t), ["target"], ["event_id"], "nth")
    return r.join(_bins(t), "target").select("event_id", (F.col("excl") + F.col("nth") - 1).alias("place"))


@query("gather_scatter", f"SELECT target, count(*) AS n, round(sum(value * p), 4) AS total FROM {_EV} GROUP BY target")
def gather_scatter(t: Tables):
    return _routed(t).groupBy("target").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value") * F.col("p")), 4).alias("total"))


@query("kv_sort", f"SELECT event_id, target, row_number() OVER (PARTITION BY target ORDER BY p, event_id) AS place FROM {_EV}")
def kv_sort(t: Tables):
    return ranked(_routed(t), ["target"], ["p", "event_id"]).select("event_id", "target", "place")


sql_query("prompt_format", "SELECT item_id, concat('Question: ', text, chr(10), 'Answer:') AS prompt FROM benchmark")
