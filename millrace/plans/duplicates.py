"""Queries of near-duplicates, groups and n-gram contamination."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import duplicates as D
from millrace.operators import grams as G
from millrace.operators.graph import small_side, step_table
from millrace.plans.base import Tables, query

SEEDS, BANDS = 100, 10

_SH = "WITH c AS (SELECT conv_id * 1000 + turn AS key, text FROM conversations UNION ALL SELECT conv_id * 1000 + turn + 500, CASE WHEN conv_id % 2 = 0 THEN text ELSE text || ' (edited)' END FROM conversations WHERE role = 'assistant'), sh AS (SELECT DISTINCT key, substr(text, CAST(i AS INT), 5) AS s FROM c, unnest(range(1, length(text) - 4)) AS t(i) WHERE length(text) > 5)"
_REP = _SH + ", cls AS (SELECT key, min(key) OVER (PARTITION BY same) AS rep FROM (SELECT key, string_agg(s, chr(1) ORDER BY s) AS same FROM sh GROUP BY key))"
_CODE = f"((((CAST(unicode(s[1]) AS BIGINT) * {D.BASE} + unicode(s[2])) % {D.CODES} * {D.BASE} + unicode(s[3])) % {D.CODES} * {D.BASE} + unicode(s[4])) % {D.CODES} * {D.BASE} + unicode(s[5])) % {D.CODES}"
_MH = _REP + f", code AS (SELECT key, " + _CODE + f" AS x FROM sh JOIN cls USING (key) WHERE key = rep), mh AS (SELECT key, k, min((x * (k * 40503 + 7919) + k * 65537) % 2147483647) AS v FROM code, unnest(range(1, {SEEDS + 1})) AS t(k) GROUP BY key, k)"
_BAND = _MH + f", bk AS (SELECT key, (k - 1) // {SEEDS // BANDS} AS band, md5(string_agg(CAST(v AS VARCHAR), ',' ORDER BY k)) AS bucket FROM mh GROUP BY ALL), near AS (SELECT DISTINCT a.key AS a, b.key AS b FROM bk AS a JOIN bk AS b USING (band, bucket) WHERE a.key < b.key), cand AS (SELECT a, b FROM near UNION ALL SELECT rep, key FROM cls WHERE key <> rep)"
_JAC = _BAND + ", n AS (SELECT key, count(*) AS n FROM sh GROUP BY key), i AS (SELECT a, b, count(*) AS i FROM near JOIN sh AS x ON x.key = a JOIN sh AS y ON y.key = b AND y.s = x.s GROUP BY a, b), jac AS (SELECT a, b, CAST(i AS DOUBLE) / (na.n + nb.n - i) AS jaccard FROM i JOIN n AS na ON na.key = a JOIN n AS nb ON nb.key = b UNION ALL SELECT rep, key, 1.0 FROM cls WHERE key <> rep)"
_COMP = _JAC.replace("WITH c AS", "WITH RECURSIVE c AS", 1) + ", e AS (SELECT a, b FROM jac WHERE jaccard >= 0.7 UNION SELECT b, a FROM jac WHERE jaccard >= 0.7), r(node, seen) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen), comp AS (SELECT node, least(node, min(seen)) AS \"group\" FROM r GROUP BY node)"


def _texts(t: Tables):
    """Turns, and second versions of answers: copies or edited ones."""
    c = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), "conv_id", "role", "text")
    again = F.when(F.col("conv_id") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit(" (edited)")))
    return c.select("key", "text").union(c.where("role = 'assistant'").select(F.col("key") + 500, again))


def _prints(t: Tables):
    return step_table(D.fingerprints(_texts(t), "key", "text", SEEDS))


def _edges(t: Tables):
    prints = _prints(t)
    return D.jaccard(D.candidates(prints, BANDS, SEEDS), prints, 0.5)


@query("shingles", _SH + " SELECT key, count(*) AS n, min(s) AS first, max(s) AS last FROM sh GROUP BY key")
def shingles(t: Tables):
    s = _texts(t).select("key", T.char_shingles(F.col("text")).alias("s")).where(F.size("s") > 0)
    return s.select("key", F.size("s").cast("bigint").alias("n"), F.array_min("s").alias("first"), F.array_max("s").alias("last"))


@query("minhash", _MH + " SELECT key, md5(string_agg(CAST(v AS VARCHAR), ',' ORDER BY k)) AS signature FROM mh GROUP BY key")
def minhash(t: Tables):
    p = _prints(t).where("signature IS NOT NULL")
    return p.select("key", F.md5(F.array_join(F.col("signature").cast("array<string>"), ",").cast("binary")).alias("signature"))


@query("lsh_candidates", _BAND + " SELECT a, b FROM cand")
def lsh_candidates(t: Tables):
    return D.candidates(_prints(t), BANDS, SEEDS)


@query("jaccard_pairs", _JAC + " SELECT a, b, jaccard FROM jac WHERE jaccard > 0.5")
def jaccard_pairs(t: Tables):
    return _edges(t)


@query("near_dups", _JAC + " SELECT a AS main, b AS other, jaccard FROM jac WHERE jaccard >= 0.7")
def near_dups(t: Tables):
    return _edges(t).where("jaccard >= 0.7").select(F.col("a").alias("main"), F.col("b").alias("other"), "jaccard")


def _groups(t: Tables):
    return D.groups(_prints(t), 0.7, BANDS, SEEDS)


@query("dup_components", _COMP + ' SELECT node, "group" FROM comp')
def dup_components(t: Tables):
    return _groups(t)


@query("dup_stats", _COMP + ' SELECT count(*) AS n_groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n_removed, CAST(coalesce(max(n), 0) AS BIGINT) AS largest FROM (SELECT "group", count(*) AS n FROM comp GROUP BY "group")')
def dup_stats(t: Tables):
    g = _groups(t).groupBy("group").agg(F.count("*").alias("n"))
    return g.agg(F.count("*").alias("n_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_removed"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"))


@query("dedup_anti", _COMP + ' SELECT key FROM c WHERE key NOT IN (SELECT node FROM comp WHERE node <> "group")')
def dedup_anti(t: Tables):
    gone = _groups(t).where("node <> `group`").select(F.col("node").alias("key"))
    return _texts(t).select("key").join(gone, "key", "left_anti")


@query("dedup_docs", _COMP + ' SELECT key, md5(text) AS text_md5 FROM c WHERE key NOT IN (SELECT node FROM comp WHERE node <> "group")')
def dedup_docs(t: Tables):
    gone = _groups(t).where("node <> `group`").select(F.col("node").alias("key"))
    return _texts(t).join(gone, "key", "left_anti").select("key", F.md5(F.col("text").cast("binary")).alias("text_md5"))


_W = r"string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' ')"


def _ng(table: str, key: str, n: int) -> str:
    return f"SELECT {key}, g AS pos, array_to_string(w[g + 1 : g + {n}], ' ') AS ngram FROM (SELECT {key}, {_W} AS w FROM {table}), unnest(range(0, len(w) - {n} + 1)) AS t(g)"


@query("ngram_hits", f"WITH d AS ({_ng('documents', 'doc_id', 13)}), b AS (SELECT DISTINCT item_id, ngram FROM ({_ng('benchmark', 'item_id', 13)})) SELECT doc_id, item_id, count(*) AS n_hits, min(pos) AS first_pos FROM d JOIN b USING (ngram) GROUP BY doc_id, item_id")
def ngram_hits(t: Tables):
    b = D.hashed_ngrams(t.benchmark, "item_id", "text", 13).select(F.col("key").alias("item_id"), "h1", "h2").distinct()
    d = D.hashed_ngrams(t.documents, "doc_id", "text", 13).join(small_side(b), ["h1", "h2"])
    return d.groupBy(F.col("key").alias("doc_id"), "item_id").agg(F.count("*").alias("n_hits"), F.min("pos").cast("bigint").alias("first_pos"))


@query("train_overlap", f"WITH d AS ({_ng('documents', 'doc_id', 13)}), b AS (SELECT DISTINCT ngram FROM ({_ng('benchmark', 'item_id', 13)})) SELECT DISTINCT doc_id FROM d SEMI JOIN b USING (ngram)")
def train_overlap(t: Tables):
    b = D.hashed_ngrams(t.benchmark, "item_id", "text", 13).select("h1", "h2").distinct()
    return D.hashed_ngrams(t.documents, "doc_id", "text", 13).join(small_side(b), ["h1", "h2"], "left_semi").select(F.col("key").alias("doc_id")).distinct()


@query("ngram_len_hist", f"SELECT CAST(least(13, len(w)) AS INT) AS n_words, count(*) AS n FROM (SELECT {_W} AS w FROM benchmark) GROUP BY 1")
def ngram_len_hist(t: Tables):
    return t.benchmark.select(F.least(F.lit(13), F.size(T.words(F.lower(F.col("text"))))).alias("n_words")).groupBy("n_words").agg(F.count("*").alias("n"))


@query("ngram_below_threshold", f"WITH d AS (SELECT ngram, count(*) AS c FROM ({_ng('documents', 'doc_id', 8)}) GROUP BY ngram), b AS (SELECT DISTINCT ngram FROM ({_ng('benchmark', 'item_id', 8)})) SELECT ngram, coalesce(c, 0) AS frequency FROM b LEFT JOIN d USING (ngram) WHERE coalesce(c, 0) < 10")
def ngram_below_threshold(t: Tables):
    b = D.hashed(D.word_ngrams(t.benchmark, "item_id", "text", 8).select("ngram").distinct(), 8)
    d = D.hashed_ngrams(t.documents, "doc_id", "text", 8).join(small_side(b.select("h1", "h2")), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.count("*").alias("c"))
    return b.join(d, ["h1", "h2"], "left").select("ngram", F.coalesce("c", F.lit(0)).cast("bigint").alias("frequency")).where("frequency < 10")


#: Documents with a line that tells their source: so some 13-grams are in many of them.
_NOTED = "(SELECT doc_id, text || ' this text was taken from ' || source || ' and may be read by all who name it there' AS text FROM documents)"


@query("frequent_13grams", f"SELECT ngram, count(DISTINCT doc_id) AS n_docs FROM ({_ng(_NOTED, 'doc_id', 13)}) GROUP BY ngram HAVING count(DISTINCT doc_id) > 10")
def frequent_13grams(t: Tables):
    noted = t.documents.select("doc_id", F.concat("text", F.lit(" this text was taken from "), "source", F.lit(" and may be read by all who name it there")).alias("text"))
    return D.frequent_ngrams(noted, "doc_id", "text", 13, 10)


_BUCKET = "CAST(CAST('0x' || substr(md5(ngram), 1, 7) AS BIGINT) % 500 AS BIGINT)"


@query("bucket_ngrams", f"SELECT {_BUCKET} AS bucket, count(*) AS n, min(ngram) AS first FROM ({_ng('documents', 'doc_id', 13)}) GROUP BY 1")
def bucket_ngrams(t: Tables):
    return G.bucket_least(t.documents.select(G.plain(F.col("text")).alias("t")), 13, 500)


@query("sorted_buckets", f"SELECT {_BUCKET} AS bucket, ngram, item_id, row_number() OVER (PARTITION BY {_BUCKET} ORDER BY ngram, item_id, pos) AS place FROM ({_ng('benchmark', 'item_id', 13)})")
def sorted_buckets(t: Tables):
    from pyspark.sql import Window

    g = D.word_ngrams(t.benchmark, "item_id", "text", 13).withColumnRenamed("key", "item_id")
    g = g.withColumn("bucket", F.conv(F.substring(F.md5(F.col("ngram").cast("binary")), 1, 7), 16, 10).cast("bigint") % 500)
    return g.select("bucket", "ngram", "item_id", F.row_number().over(Window.partitionBy("bucket").orderBy("ngram", "item_id", "pos")).cast("bigint").alias("place"))
