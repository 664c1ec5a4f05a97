"""Queries of evaluation results: scores, aggregates, filters, groups.

Results to evaluate are made from the tables: a document's gold label is labels.toxic, its task is
doc_id modulo 7, and predictions and likelihoods follow from a hash of its id. Question and answer
texts are those of conversations.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import answers as A
from millrace.functions import metrics as M
from millrace.functions import text as T
from millrace.operators import evaluation as E
from millrace.plans.base import Tables, query, sql_query, unit, unit_duck

_U = unit_duck("doc_id")
#: doc_id, task, gold, u (0 to 1), pred, ll (log likelihood), n_words, n_bytes.
_R = f"""(SELECT l.doc_id, l.doc_id % 7 AS task, l.toxic AS gold, l.quality AS quality, {unit_duck('l.doc_id')} AS u, CASE WHEN {unit_duck('l.doc_id')} < 0.7 THEN l.toxic ELSE 1 - l.toxic END AS pred,
 -50 * {unit_duck('l.doc_id')} - 1 AS ll, len(string_split(trim(regexp_replace(d.text, '\\s+', ' ', 'g')), ' ')) AS n_words, octet_length(encode(d.text)) AS n_bytes FROM labels AS l JOIN documents AS d USING (doc_id))"""


def _results(t: Tables):
    u = unit(F.col("doc_id"))
    return t.labels.join(t.documents.select("doc_id", "text"), "doc_id").select(
        "doc_id", (F.col("doc_id") % 7).alias("task"), F.col("toxic").alias("gold"), "quality", u.alias("u"), F.when(u < 0.7, F.col("toxic")).otherwise(1 - F.col("toxic")).alias("pred"),
        (-50 * u - 1).alias("ll"), F.size(T.words(F.col("text"))).alias("n_words"), F.octet_length("text").alias("n_bytes"),
    )


def _r6(c, name):
    return F.round(c, 6).alias(name)


@query("agg_mean", f"SELECT task, round(avg(u), 6) AS mean, round(list_sort(list(u))[CAST(floor(count(*) / 2) AS BIGINT) + 1], 6) AS median FROM {_R} GROUP BY task")
def agg_mean(t: Tables):
    return _results(t).groupBy("task").agg(_r6(M.mean(F.col("u")), "mean"), _r6(M.upper_median(F.col("u")), "median"))


@query("agg_ppl", f"SELECT task, round(exp(-avg(ll / n_words)), 6) AS perplexity FROM {_R} GROUP BY task")
def agg_ppl(t: Tables):
    return _results(t).groupBy("task").agg(_r6(M.perplexity(F.col("ll") / F.col("n_words")), "perplexity"))


@query("agg_wppl", f"SELECT task, round(exp(-sum(ll) / sum(n_words)), 6) AS word_perplexity, round(exp(-sum(ll) / sum(n_bytes)), 6) AS byte_perplexity FROM {_R} GROUP BY task")
def agg_wppl(t: Tables):
    return _results(t).groupBy("task").agg(_r6(M.weighted_perplexity(F.col("ll"), F.col("n_words")), "word_perplexity"), _r6(M.weighted_perplexity(F.col("ll"), F.col("n_bytes")), "byte_perplexity"))


@query("agg_bpb", f"SELECT task, round(-sum(ll) / sum(n_bytes) / ln(2), 6) AS bits_per_byte FROM {_R} GROUP BY task")
def agg_bpb(t: Tables):
    return _results(t).groupBy("task").agg(_r6(M.bits_per_byte(F.col("ll"), F.col("n_bytes")), "bits_per_byte"))


_CM = f"(SELECT task, count(*) FILTER (gold = 1 AND pred = 1) AS tp, count(*) FILTER (gold = 0 AND pred = 1) AS fp, count(*) FILTER (gold = 1 AND pred = 0) AS fn, count(*) FILTER (gold = 0 AND pred = 0) AS tn FROM {_R} GROUP BY task)"


@query("agg_f1", f"SELECT task, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM {_CM}")
def agg_f1(t: Tables):
    return _results(t).groupBy("task").agg(_r6(M.f1(F.col("gold"), F.col("pred")), "f1"))


@query("agg_mcc", f"SELECT task, round(coalesce((CAST(tp AS DOUBLE) * tn - fp * fn) / nullif(sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc FROM {_CM}")
def agg_mcc(t: Tables):
    return _results(t).groupBy("task").agg(_r6(M.matthews(F.col("gold"), F.col("pred")), "mcc"))


@query("kappa", f"SELECT task, round((CAST(tp + tn AS DOUBLE) / n - c) / nullif(1 - c, 0), 6) AS kappa FROM (SELECT *, tp + fp + fn + tn AS n, (CAST(tp + fp AS DOUBLE) * (tp + fn) + CAST(fn + tn AS DOUBLE) * (fp + tn)) / (CAST(tp + fp + fn + tn AS DOUBLE) * (tp + fp + fn + tn)) AS c FROM {_CM})")
def kappa(t: Tables):
    return _results(t).groupBy("task").agg(_r6(M.kappa(F.col("gold"), F.col("pred")), "kappa"))


@query("agg_brier", f"SELECT task, round(avg(pow(1 - u - (1 - gold), 2) + pow(u - gold, 2)), 6) AS brier FROM {_R} GROUP BY task")
def agg_brier(t: Tables):
    return _results(t).groupBy("task").agg(_r6(M.brier(F.col("gold"), F.array(1 - F.col("u"), F.col("u"))), "brier"))


_CLS = f"(SELECT doc_id, task, (gold * 2 + quality) AS g, CASE WHEN u < 0.6 THEN gold * 2 + quality ELSE CAST(floor(u * 4) AS INT) END AS p FROM {_R})"


def _classes(t: Tables):
    g = F.col("gold") * 2 + F.col("quality")
    return _results(t).select("doc_id", "task", g.alias("g"), F.when(F.col("u") < 0.6, g).otherwise(F.floor(F.col("u") * 4).cast("int")).alias("p"))


@query("macro_f1", f"WITH c AS (SELECT k, count(*) FILTER (g = k AND p = k) AS tp, count(*) FILTER (g = k) + count(*) FILTER (p = k) AS either_side FROM {_CLS}, (SELECT unnest(range(0, 4)) AS k) GROUP BY k) SELECT round(avg(CASE WHEN either_side = 0 THEN 0.0 ELSE 2.0 * tp / either_side END), 6) AS macro_f1 FROM c")
def macro_f1(t: Tables):
    rows = _classes(t).select(F.explode(F.array(F.struct(F.col("g").alias("k"), F.lit(1).alias("n"), (F.col("g") == F.col("p")).cast("int").alias("hit")), F.struct(F.col("p").alias("k"), F.lit(1).alias("n"), F.lit(0).alias("hit")))).alias("r")).select("r.*")
    per = rows.groupBy("k").agg((2.0 * F.sum("hit") / F.sum("n")).alias("f1"))
    return per.agg(_r6(F.sum("f1") / 4, "macro_f1"))


@query("confusion_matrix", f"SELECT g, p, count(*) AS n FROM {_CLS} GROUP BY g, p")
def confusion_matrix(t: Tables):
    return _classes(t).groupBy("g", "p").agg(F.count("*").alias("n"))


@query("iou", f"WITH k AS (SELECT unnest(range(0, 4)) AS k) SELECT CAST(k AS INT) AS k, round(CAST(count(*) FILTER (g = k AND p = k) AS DOUBLE) / nullif(count(*) FILTER (g = k OR p = k), 0), 6) AS iou FROM {_CLS}, k GROUP BY k HAVING count(*) FILTER (g = k OR p = k) > 0")
def iou(t: Tables):
    rows = _classes(t).select(F.explode(F.array_distinct(F.array("g", "p"))).alias("k"), (F.col("g") == F.col("p")).cast("int").alias("hit"))
    return rows.groupBy("k").agg(_r6(F.sum("hit").cast("double") / F.count("*"), "iou"))


@query("accuracy_by_dataset", f"SELECT task, CAST(sum(CAST(gold = pred AS INT)) AS BIGINT) AS correct, count(*) AS total FROM {_R} GROUP BY task")
def accuracy_by_dataset(t: Tables):
    return _results(t).groupBy("task").agg(F.sum((F.col("gold") == F.col("pred")).cast("int")).alias("correct"), F.count("*").alias("total"))


@query("acc_all", f"SELECT task, round(avg(CAST(ok AS INT)), 6) AS acc_all FROM (SELECT task, doc_id // 20 AS question, bool_and(gold = pred) AS ok FROM {_R} GROUP BY ALL) GROUP BY task")
def acc_all(t: Tables):
    q = _results(t).groupBy("task", F.floor(F.col("doc_id") / 20).alias("question")).agg(F.bool_and(F.col("gold") == F.col("pred")).alias("ok"))
    return q.groupBy("task").agg(_r6(M.mean(F.col("ok").cast("int")), "acc_all"))


@query("mean_stderr", f"SELECT task, round(stddev_samp(u) / sqrt(count(u)), 6) AS stderr, round(stddev_pop(u), 6) AS pop_stddev, round(stddev_samp(u), 6) AS sample_stddev FROM {_R} GROUP BY task")
def mean_stderr(t: Tables):
    return _results(t).groupBy("task").agg(_r6(M.mean_stderr(F.col("u")), "stderr"), _r6(F.stddev_pop("u"), "pop_stddev"), _r6(F.stddev_samp("u"), "sample_stddev"))


@query("bootstrap_stderr")
def bootstrap_stderr(t: Tables):
    return E.bootstrap_stderr(_results(t), "u", "doc_id")


_TASKS = f"(SELECT task, task % 2 AS grp, avg(u) AS m, count(*) AS n, stddev_samp(u) / sqrt(count(*)) AS e FROM {_R} GROUP BY task)"


@query("group_rollup", f"SELECT grp, round(sum(m * n) / sum(n), 6) AS metric, round(avg(m), 6) AS unweighted, round(sqrt(sum((n - 1) * e * e * n) / (sum(n) - count(*)) / sum(n)), 6) AS stderr, CAST(sum(n) AS BIGINT) AS n FROM {_TASKS} GROUP BY grp")
def group_rollup(t: Tables):
    parts = _results(t).groupBy("task").agg(F.avg("u").alias("m"), F.count("*").alias("n"), M.mean_stderr(F.col("u")).alias("e")).withColumn("grp", F.col("task") % 2)
    out = E.rollup_groups(parts, "grp", "m", "n", "e")
    return out.select("grp", _r6(F.col("metric"), "metric"), _r6(F.col("unweighted"), "unweighted"), _r6(F.col("stderr"), "stderr"), "n")


_CELLS = f"SELECT task, filter, metric, round(avg(v), 6) AS value, count(*) AS n FROM (SELECT task, 'none' AS filter, 'acc' AS metric, CAST(gold = pred AS INT) AS v FROM {_R} UNION ALL SELECT task, 'none', 'u', u FROM {_R} UNION ALL SELECT task, 'flip', 'acc', CAST(gold <> pred AS INT) FROM {_R}) GROUP BY task, filter, metric"


def _cells(t: Tables):
    cell = lambda f, m, v: F.struct(F.lit(f).alias("filter"), F.lit(m).alias("metric"), v.cast("double").alias("v"))
    r = _results(t).select("task", F.inline(F.array(cell("none", "acc", F.col("gold") == F.col("pred")), cell("none", "u", F.col("u")), cell("flip", "acc", F.col("gold") != F.col("pred")))))
    return r.groupBy("task", "filter", "metric").agg(_r6(F.avg("v"), "value"), F.count("*").alias("n"))


@query("eval_consolidate", _CELLS)
def eval_consolidate(t: Tables):
    return _cells(t)


@query("leaderboard", f"SELECT task, round(max(CASE WHEN filter = 'none' AND metric = 'acc' THEN value END), 6) AS acc, round(max(CASE WHEN metric = 'u' THEN value END), 6) AS u, rank() OVER (ORDER BY max(CASE WHEN filter = 'none' AND metric = 'acc' THEN value END) DESC, task) AS place FROM ({_CELLS}) GROUP BY task")
def leaderboard(t: Tables):
    c = _cells(t)
    acc = F.max(F.when((F.col("filter") == "none") & (F.col("metric") == "acc"), F.col("value")))
    out = c.groupBy("task").agg(acc.alias("acc"), F.max(F.when(F.col("metric") == "u", F.col("value"))).alias("u"))
    return out.withColumn("place", F.rank().over(Window.orderBy(F.desc("acc"), "task")).cast("bigint"))


# Neighbouring turns are prediction and right answer.
_QA = r"(SELECT conv_id, turn, string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' ') AS p, string_split(trim(regexp_replace(lower(nxt), '\s+', ' ', 'g')), ' ') AS g, text, nxt FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) WHERE nxt IS NOT NULL)"
_SHARED = "list_sum(list_transform(list_distinct({0}), lambda x: least(len(list_filter({0}, lambda y: y = x)), len(list_filter({1}, lambda y: y = x)))))"
_F1 = f"CASE WHEN len(p) + len(g) = 0 THEN 1.0 ELSE 2.0 * coalesce({_SHARED.format('p', 'g')}, 0) / (len(p) + len(g)) END"


def _answers(t: Tables):
    w = Window.partitionBy("conv_id").orderBy("turn")
    x = t.conversations.select("conv_id", "turn", "text", F.lead("text").over(w).alias("nxt")).where("nxt IS NOT NULL")
    return x.select("*", T.words(F.lower("text")).alias("p"), T.words(F.lower("nxt")).alias("g"))


@query("token_f1", f"SELECT conv_id, turn, round({_F1}, 6) AS f1 FROM {_QA}")
def token_f1(t: Tables):
    return _answers(t).select("conv_id", "turn", _r6(M.token_f1(F.col("p"), F.col("g")), "f1"))


@query("qa_scores", f"SELECT conv_id, count(*) AS n, round(avg({_F1}), 6) AS f1, CAST(sum(CAST(p = g AS INT)) AS BIGINT) AS exact FROM {_QA} GROUP BY conv_id")
def qa_scores(t: Tables):
    return _answers(t).groupBy("conv_id").agg(F.count("*").alias("n"), _r6(F.avg(M.token_f1(F.col("p"), F.col("g"))), "f1"), F.sum((F.col("p") == F.col("g")).cast("int")).alias("exact"))


_BI = "[{0}[i] || ' ' || {0}[i + 1] for i in range(1, len({0}))]"


@query("ngram_f1", f"SELECT conv_id, turn, round({_F1}, 6) AS f1 FROM (SELECT conv_id, turn, {_BI.format('p')} AS p, {_BI.format('g')} AS g FROM {_QA})")
def ngram_f1(t: Tables):
    return _answers(t).select("conv_id", "turn", _r6(M.token_f1(T.ngrams(F.col("p"), 2), T.ngrams(F.col("g"), 2)), "f1"))


@query("em_max", f"SELECT conv_id, turn, CAST(list_contains([nxt, upper(text), CASE WHEN conv_id % 3 = 0 THEN text ELSE text || '.' END], text) AS INT) AS em FROM {_QA}")
def em_max(t: Tables):
    own = F.when(F.col("conv_id") % 3 == 0, F.col("text")).otherwise(F.concat("text", F.lit(".")))
    hits = F.transform(F.array(F.col("nxt"), F.upper("text"), own), lambda g: (g == F.col("text")).cast("int"))
    return _answers(t).select("conv_id", "turn", M.best_of(hits).alias("em"))


@query("record_f1", f"SELECT conv_id, max_by(turn, (f, -turn)) AS turn, round(max(f), 6) AS f1 FROM (SELECT conv_id, turn, {_F1} AS f FROM {_QA}) GROUP BY conv_id")
def record_f1(t: Tables):
    s = _answers(t).select("conv_id", "turn", M.token_f1(F.col("p"), F.col("g")).alias("f"))
    return s.groupBy("conv_id").agg(F.max_by("turn", F.struct("f", -F.col("turn"))).alias("turn"), _r6(F.max("f"), "f1"))


@query("multirc_em", f"SELECT conv_id, max(CAST(f > 0.2 AS INT)) AS hit, round(sum(f), 6) AS f FROM (SELECT conv_id, {_F1} AS f FROM {_QA}) GROUP BY conv_id")
def multirc_em(t: Tables):
    s = _answers(t).select("conv_id", M.token_f1(F.col("p"), F.col("g")).alias("f"))
    return s.groupBy("conv_id").agg(F.max((F.col("f") > 0.2).cast("int")).alias("hit"), _r6(F.sum("f"), "f"))


@query("rouge_n", f"SELECT conv_id, turn, round(coalesce({_SHARED.format('p', 'g')}, 0) / CAST(len(g) AS DOUBLE), 6) AS recall FROM {_QA}")
def rouge_n(t: Tables):
    return _answers(t).select("conv_id", "turn", _r6(M.shared_tokens(F.col("p"), F.col("g")) / F.size("g").cast("double"), "recall"))


@query("rouge_l")
def rouge_l(t: Tables):
    a = _answers(t).select("conv_id", "turn", "p", "g", M.longest_common(F.col("p"), F.col("g")).alias("n"))
    return a.select("conv_id", "turn", _r6(F.when(F.col("n") > 0, 2.0 * F.col("n") / (F.size("p") + F.size("g"))).otherwise(0.0), "rouge_l"))


_BLEU = " UNION ALL ".join(f"SELECT {n} AS n, CAST(sum(coalesce({_SHARED.format('a', 'b')}, 0)) AS DOUBLE) AS m, CAST(sum(len(a)) AS DOUBLE) AS t, sum(lp) AS lp, sum(lg) AS lg FROM (SELECT [array_to_string(p[i : i + {n - 1}], ' ') for i in range(1, greatest(len(p) - {n - 2}, 1))] AS a, [array_to_string(g[i : i + {n - 1}], ' ') for i in range(1, greatest(len(g) - {n - 2}, 1))] AS b, len(p) AS lp, len(g) AS lg FROM {_QA})" for n in range(1, 5))


@query("agg_bleu", f"WITH s AS ({_BLEU}), h AS (SELECT *, sum(CAST(m = 0 AS INT)) OVER (ORDER BY n) AS z FROM s) SELECT round(100 * exp(sum(ln(CASE WHEN m > 0 THEN m / t ELSE 1 / (pow(2, z) * t) END)) / 4 + min(CASE WHEN lp >= lg THEN 0 ELSE 1 - CAST(lg AS DOUBLE) / lp END)), 6) AS bleu FROM h")
def agg_bleu(t: Tables):
    return E.bleu(_answers(t), F.col("p"), F.col("g")).select(_r6(F.col("bleu"), "bleu"))


@query(
    "agg_chrf",
    r"WITH x AS (SELECT row_number() OVER () AS r, regexp_replace(text, '\s+', '', 'g') AS a, regexp_replace(nxt, '\s+', '', 'g') AS b FROM " + _QA + "), g AS (SELECT r, n, substr(a, i, n) AS g, 1 AS p, 0 AS q FROM x, unnest(range(1, 7)) AS t(n), unnest(range(1, length(a) - n + 2)) AS u(i) UNION ALL SELECT r, n, substr(b, i, n), 0, 1 FROM x, unnest(range(1, 7)) AS t(n), unnest(range(1, length(b) - n + 2)) AS u(i)), own AS (SELECT r, n, g, sum(p) AS p, sum(q) AS q FROM g GROUP BY ALL), s AS (SELECT n, sum(least(p, q)) AS m, sum(p) AS p, sum(q) AS q FROM own GROUP BY n) SELECT round(100 * avg(CASE WHEN m > 0 THEN 5.0 * m / (4 * q + p) ELSE 0 END), 6) AS chrf FROM s WHERE p > 0 AND q > 0",
)
def agg_chrf(t: Tables):
    return E.chrf(_answers(t), F.col("text"), F.col("nxt")).select(_r6(F.col("chrf"), "chrf"))


@query("agg_ter")
def agg_ter(t: Tables):
    return E.ter(_answers(t), F.col("p"), F.col("g")).select(_r6(F.col("ter"), "ter"))


_SAMPLES = f"(SELECT doc_id, 10 AS n, CAST(floor(u * 11) AS INT) AS c FROM {_R})"


@query("pass_at_k", f"SELECT doc_id, round(CASE WHEN n - c < 3 THEN 1.0 WHEN c = 0 THEN 0.0 ELSE 1 - list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1 - 3.0 / i)) END, 6) AS pass_at_3 FROM {_SAMPLES}")
def pass_at_k(t: Tables):
    s = _results(t).select("doc_id", F.lit(10).alias("n"), F.floor(F.col("u") * 11).cast("int").alias("c"))
    return s.select("doc_id", _r6(M.pass_at_k(F.col("n"), F.col("c"), 3), "pass_at_3"))


@query("softmax", f"SELECT doc_id, round(1 / (exp(u) + 1 + exp(-u)), 6) AS p_low, round(exp(u) / (exp(u) + 1 + exp(-u)), 6) AS p_top FROM (SELECT doc_id, u FROM {_R})".replace("1 / (exp(u) + 1 + exp(-u))", "exp(-u) / (exp(u) + 1 + exp(-u))", 1))
def softmax(t: Tables):
    p = M.softmax(F.array(-F.col("u"), F.lit(0.0), F.col("u")))
    return _results(t).select("doc_id", p.alias("p")).select("doc_id", _r6(F.get("p", F.lit(0)), "p_low"), _r6(F.get("p", F.lit(2)), "p_top"))


# Four answers to each document, likelihoods by a hash; the right one is 1 + gold.
_CH = f"(SELECT doc_id, task, k, gold, CAST('0x' || substr(md5(doc_id || ':' || k), 1, 7) AS BIGINT) / 268435456.0 AS s FROM {_R}, unnest(range(0, 4)) AS c(k))"


def _choices(t: Tables):
    r = _results(t).select("doc_id", "task", "gold", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))).alias("k"))
    return r.withColumn("s", unit(F.concat_ws(":", "doc_id", "k")))


@query("mc2", f"SELECT doc_id, round(sum(CASE WHEN k >= 2 THEN exp(s) END) / sum(exp(s)), 6) AS mc2 FROM {_CH} GROUP BY doc_id")
def mc2(t: Tables):
    return _choices(t).groupBy("doc_id").agg(_r6(F.sum(F.when(F.col("k") >= 2, F.exp("s"))) / F.sum(F.exp("s")), "mc2"))


_RANKED = f"(SELECT doc_id, task, min(r) AS r FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, k) AS r FROM {_CH}) WHERE k = 1 + gold GROUP BY ALL)"


@query("mrr", f"SELECT task, round(avg(1.0 / r), 6) AS mrr, round(avg(CAST(r <= 1 AS INT)), 6) AS r_at_1, round(avg(CAST(r <= 2 AS INT)), 6) AS r_at_2 FROM {_RANKED} GROUP BY task")
def mrr(t: Tables):
    r = E.first_rank(_choices(t), ["task", "doc_id"], "s", F.col("k") == 1 + F.col("gold"), "k")
    return r.groupBy("task").agg(_r6(F.avg(1.0 / F.col("rank")), "mrr"), _r6(F.avg((F.col("rank") <= 1).cast("int")), "r_at_1"), _r6(F.avg((F.col("rank") <= 2).cast("int")), "r_at_2"))


@query("avg_rank", f"SELECT task, round(avg(r), 6) AS avg_rank FROM {_RANKED} GROUP BY task")
def avg_rank(t: Tables):
    return E.first_rank(_choices(t), ["task", "doc_id"], "s", F.col("k") == 1 + F.col("gold"), "k").groupBy("task").agg(_r6(F.avg("rank"), "avg_rank"))


@query("acc", f"SELECT doc_id, CAST(r = 1 AS INT) AS acc FROM {_RANKED}")
def acc(t: Tables):
    return E.first_rank(_choices(t), ["doc_id"], "s", F.col("k") == 1 + F.col("gold"), "k").select("doc_id", (F.col("rank") == 1).cast("int").alias("acc"))


@query("acc_norm", f"SELECT doc_id, CAST(min(r) = 1 AS INT) AS acc_norm FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY (s - 2) / (k + 3) DESC, k) AS r FROM {_CH}) WHERE k = 1 + gold GROUP BY doc_id")
def acc_norm(t: Tables):
    c = _choices(t).withColumn("s", (F.col("s") - 2) / (F.col("k") + 3))
    return E.first_rank(c, ["doc_id"], "s", F.col("k") == 1 + F.col("gold"), "k").select("doc_id", (F.col("rank") == 1).cast("int").alias("acc_norm"))


@query("pct_stereotype", f"SELECT task, round(avg(CAST(a > b AS INT)), 6) AS pct, round(avg(abs(a - b)), 6) AS likelihood_diff FROM (SELECT doc_id, task, max(CASE WHEN k = 0 THEN s END) AS a, max(CASE WHEN k = 1 THEN s END) AS b FROM {_CH} GROUP BY ALL) GROUP BY task")
def pct_stereotype(t: Tables):
    p = _choices(t).groupBy("task", "doc_id").agg(F.max(F.when(F.col("k") == 0, F.col("s"))).alias("a"), F.max(F.when(F.col("k") == 1, F.col("s"))).alias("b"))
    return p.groupBy("task").agg(_r6(F.avg((F.col("a") > F.col("b")).cast("int")), "pct"), _r6(F.avg(F.abs(F.col("a") - F.col("b"))), "likelihood_diff"))


@query("ensemble_sum", f"SELECT doc_id, arg_max(k, (s, -k)) AS k, round(max(s), 6) AS s FROM (SELECT doc_id, k, s + 0.5 * (1 - s) * (k % 2) AS s FROM {_CH}) GROUP BY doc_id")
def ensemble_sum(t: Tables):
    one = _choices(t).select("doc_id", "k", "s")
    two = one.select("doc_id", "k", (0.5 * (1 - F.col("s")) * (F.col("k") % 2)).alias("s"))
    total = one.unionByName(two).groupBy("doc_id", "k").agg(F.sum("s").alias("s"))
    return total.groupBy("doc_id").agg(F.max_by("k", F.struct("s", -F.col("k"))).alias("k"), _r6(F.max("s"), "s"))


@query("word_byte_counts", r"SELECT doc_id, CAST(len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) AS INT) AS n_words, CAST(octet_length(encode(text)) AS INT) AS n_bytes FROM documents")
def word_byte_counts(t: Tables):
    return t.documents.select("doc_id", F.size(T.words(F.col("text"))).alias("n_words"), F.octet_length("text").alias("n_bytes"))


@query("adjusted_ppl", f"SELECT task, round(exp(least(20, -sum(ll) / sum(n_words) * (sum(n_bytes) / CAST(sum(n_words) AS DOUBLE)))), 6) AS adjusted_ppl, round(sum(n_bytes) / CAST(sum(n_words) AS DOUBLE), 6) AS token_ratio FROM {_R} GROUP BY task")
def adjusted_ppl(t: Tables):
    ratio = F.sum("n_bytes") / F.sum("n_words").cast("double")
    return _results(t).groupBy("task").agg(_r6(F.exp(F.least(F.lit(20.0), -F.sum("ll") / F.sum("n_words") * ratio)), "adjusted_ppl"), _r6(ratio, "token_ratio"))


@query("inst_level_acc", f"SELECT task, round(avg(CAST(a AND b AS INT)), 6) AS prompt_level, round(sum(CAST(a AS INT) + CAST(b AS INT)) / (2.0 * count(*)), 6) AS inst_level FROM (SELECT task, gold = pred AS a, u < 0.5 AS b FROM {_R}) GROUP BY task")
def inst_level_acc(t: Tables):
    a, b = F.col("gold") == F.col("pred"), F.col("u") < 0.5
    return _results(t).groupBy("task").agg(_r6(F.avg((a & b).cast("int")), "prompt_level"), _r6(F.sum(a.cast("int") + b.cast("int")) / (2.0 * F.count("*")), "inst_level"))


_THR = f"(SELECT x, sum(CAST((u >= x / 100.0) = (gold = 1) AS INT)) AS hits, count(*) AS n FROM {_R}, unnest(range(0, 100)) AS t(x) GROUP BY x)"


def _thresholds(t: Tables):
    # one histogram over a hundred bins, then thresholds over the bins: rows are read once
    h = _results(t).groupBy(F.floor(F.col("u") * 100).alias("bin")).agg(F.sum("gold").alias("pos"), F.count("*").alias("n"))
    h = h.select("*", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("x"))
    return h.groupBy("x").agg(F.sum(F.when(F.col("bin") >= F.col("x"), F.col("pos")).otherwise(F.col("n") - F.col("pos"))).alias("hits"), F.sum("n").alias("n"))


@query("best_threshold", f"SELECT round(max(hits) / CAST(max(n) AS DOUBLE), 6) AS accuracy, min(x) FILTER (hits = top) / 100.0 AS threshold FROM (SELECT *, max(hits) OVER () AS top FROM {_THR})")
def best_threshold(t: Tables):
    return _thresholds(t).agg(_r6(F.max("hits") / F.max("n").cast("double"), "accuracy"), (F.max_by("x", F.struct("hits", -F.col("x"))) / 100.0).alias("threshold"))


@query("z_score", f"SELECT task, round((a - b) / nullif(sqrt(ea * ea + eb * eb), 0), 6) AS z FROM (SELECT task, avg(u) AS a, avg(u * u) AS b, stddev_samp(u) / sqrt(count(*)) AS ea, stddev_samp(u * u) / sqrt(count(*)) AS eb FROM {_R} GROUP BY task)")
def z_score(t: Tables):
    u = F.col("u")
    s = _results(t).groupBy("task").agg(F.avg(u).alias("a"), F.avg(u * u).alias("b"), M.mean_stderr(u).alias("ea"), M.mean_stderr(u * u).alias("eb"))
    return s.select("task", _r6(M.z_score(F.col("a"), F.col("b"), F.col("ea"), F.col("eb")), "z"))


@query("squad_v2", f"SELECT round(100 * avg(CAST(gold = pred AS INT)), 6) AS exact, round(100 * avg(CASE WHEN gold = 1 THEN CAST(gold = pred AS INT) END), 6) AS has_answer_exact, round(100 * avg(CASE WHEN gold = 0 THEN CAST(gold = pred AS INT) END), 6) AS no_answer_exact, (SELECT round(100.0 * max(hits) / max(n), 6) FROM {_THR}) AS best_exact FROM {_R}")
def squad_v2(t: Tables):
    ok = 100 * (F.col("gold") == F.col("pred")).cast("int")
    s = _results(t).agg(_r6(F.avg(ok), "exact"), _r6(F.avg(F.when(F.col("gold") == 1, ok)), "has_answer_exact"), _r6(F.avg(F.when(F.col("gold") == 0, ok)), "no_answer_exact"))
    return s.join(F.broadcast(_thresholds(t).agg(_r6(100.0 * F.max("hits") / F.max("n"), "best_exact"))))


@query("regex_filter", r"SELECT conv_id, turn, CASE WHEN len(m) > 0 THEN trim(m[1]) ELSE '[invalid]' END AS answer FROM (SELECT conv_id, turn, regexp_extract_all(text, '([A-Z][a-z]+)', 1) AS m FROM conversations)")
def regex_filter(t: Tables):
    return t.conversations.select("conv_id", "turn", E.regex_filter(F.col("text"), "([A-Z][a-z]+)").alias("answer"))


@query("map_filter", "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'U' WHEN 'assistant' THEN 'A' ELSE '?' END AS code FROM conversations")
def map_filter(t: Tables):
    return t.conversations.select("conv_id", "turn", E.map_filter(F.col("role"), {"user": "U", "assistant": "A"}, "?").alias("code"))


@query("multi_choice_regex", r"SELECT item_id, coalesce(nullif(regexp_extract(text, '[ (]([A-E])[.) ]', 1), ''), upper(substr(text, 1, 1))) AS choice FROM benchmark")
def multi_choice_regex(t: Tables):
    m = F.regexp_extract("text", r"[ (]([A-E])[.) ]", 1)
    return t.benchmark.select("item_id", F.when(m != "", m).otherwise(F.upper(F.substring("text", 1, 1))).alias("choice"))


_VOTES = f"(SELECT task, p, count(*) AS n FROM {_CLS} GROUP BY ALL)"


@query("majority_vote", f"SELECT task, min(p) AS p, n AS votes FROM {_VOTES} AS v WHERE n = (SELECT max(n) FROM {_VOTES} AS w WHERE w.task = v.task) GROUP BY task, n")
def majority_vote(t: Tables):
    return E.majority(_classes(t), ["task"], "p")


@query("take_first", f"SELECT task, arg_min(p, doc_id) AS p FROM {_CLS} GROUP BY task")
def take_first(t: Tables):
    return _classes(t).groupBy("task").agg(F.min_by("p", "doc_id").alias("p"))


@query("take_k", f"SELECT task, doc_id, p FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY doc_id) AS r FROM {_CLS}) WHERE r <= 3")
def take_k(t: Tables):
    return _classes(t).withColumn("r", F.row_number().over(Window.partitionBy("task").orderBy("doc_id"))).where("r <= 3").select("task", "doc_id", "p")


_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


@query("has_answer", f"WITH b AS (SELECT item_id, array_to_string(w[1:4], ' ') AS a FROM (SELECT item_id, {_TOK} AS w FROM benchmark)), d AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS a FROM (SELECT doc_id, {_TOK} AS w FROM documents), unnest(range(1, len(w) - 2)) AS t(i)) SELECT doc_id, item_id FROM d JOIN b USING (a)")
def has_answer(t: Tables):
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    b = t.benchmark.select("item_id", F.array_join(F.slice(tokens, 1, 4), " ").alias("a"))
    d = t.documents.select("doc_id", F.explode(F.array_distinct(T.ngrams(tokens, 4))).alias("a"))
    return d.join(b, "a").select("doc_id", "item_id")


@query("drop_f1")
def drop_f1(t: Tables):
    return _answers(t).select("conv_id", "turn", _r6(E.bag_f1(F.split(F.lower("text"), r"[.!?]\s*"), F.split(F.lower("nxt"), r"[.!?]\s*")), "f1"))


sql_query("eval_limit", "SELECT CAST(ceil(count(*) * 0.1) AS BIGINT) AS n_fraction, CAST(least(count(*), 50) AS BIGINT) AS n_limit FROM documents")
sql_query("collapse_outputs", "SELECT role, conv_id, count(*) AS n, min(text) AS first_output FROM (SELECT DISTINCT role, conv_id, text FROM conversations) AS x GROUP BY role, conv_id")
sql_query("samples_flat", "SELECT l.doc_id, 'toxic' AS task, CAST(l.toxic AS STRING) AS target, CAST(CASE WHEN unit(l.doc_id) < 0.7 THEN l.toxic ELSE 1 - l.toxic END AS STRING) AS filtered, d.lang FROM labels AS l JOIN documents AS d ON l.doc_id = d.doc_id")
sql_query("cost_estimate", "SELECT lang, count(*) AS n_requests, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS n_tokens FROM documents GROUP BY lang")
sql_query("cache_left", "SELECT d.doc_id, sha2(d.text, 256) AS request, CASE WHEN l.doc_id IS NULL THEN 'run' ELSE 'cached' END AS side FROM documents AS d LEFT JOIN labels AS l ON d.doc_id = l.doc_id", "SELECT d.doc_id, sha256(d.text) AS request, CASE WHEN l.doc_id IS NULL THEN 'run' ELSE 'cached' END AS side FROM documents AS d LEFT JOIN labels AS l ON d.doc_id = l.doc_id")
sql_query("zip_join", "SELECT a.conv_id, a.turn, a.text AS prompt, b.text AS knowledge FROM conversations AS a JOIN (SELECT conv_id, turn - 1 AS turn, text FROM conversations) AS b ON a.conv_id = b.conv_id AND a.turn = b.turn")
sql_query("record_text", "SELECT conv_id, turn, concat('Passage: ', replace(replace(text, '@highlight', '- '), chr(10), ' '), ' Query:') AS prompt FROM conversations")
sql_query("race_explode", "SELECT item_id, k, concat(text, ' ', chr(65 + k)) AS prompt FROM (SELECT item_id, text, explode(sequence(0, 3)) AS k FROM benchmark) AS x", "SELECT item_id, CAST(k AS INT) AS k, text || ' ' || chr(CAST(65 + k AS INT)) AS prompt FROM benchmark, unnest(range(0, 4)) AS u(k)")
sql_query("mse_psnr", "SELECT task, round(mse, 6) AS mse, round(10 * log10(1 / mse), 6) AS psnr FROM (SELECT l.doc_id % 7 AS task, avg((unit(l.doc_id) - l.toxic) * (unit(l.doc_id) - l.toxic)) AS mse FROM labels AS l GROUP BY l.doc_id % 7) AS x")




@query("formula_answers", "SELECT p_partkey, '\\frac{' || (p_size % 9 + 1) || '}{' || (p_size % 7 + 1) || '}' AS answer FROM part")
def formula_answers(t: Tables):
    a, b = (F.col("p_size") % 9 + 1).cast("string"), (F.col("p_size") % 7 + 1).cast("string")
    return t.part.select("p_partkey", A.formula(F.concat(F.lit("x = \\dfrac"), a, b, F.lit("\\text{ cm}"))).alias("answer"))


@query("number_answers", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS answer FROM orders")
def number_answers(t: Tables):
    return t.orders.select("o_orderkey", A.number(F.concat(F.format_number("o_orderkey", 0), F.lit(".00"))).alias("answer"))
