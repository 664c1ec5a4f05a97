"""Queries of cleaning, filters and address verdicts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import urls as U
from millrace.operators import records as R
from millrace.plans.base import Tables, query

_HOST = "lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]*)', 1))"
_SITES = ", ".join(f"'{x}'" for x in U.SITES)
_ENDINGS = "|".join(x.replace(".", "\\.") for x in U.ENDINGS)
_COUNTRY = "([^.]+)[.](" + "|".join(U.SECOND_LEVEL) + ")[.][a-z][a-z]$"
_LABEL = f"(CASE WHEN regexp_matches({_HOST}, '^[0-9.]+$') OR NOT contains({_HOST}, '.') THEN {_HOST} WHEN regexp_matches({_HOST}, '{_COUNTRY}') THEN regexp_extract({_HOST}, '{_COUNTRY}', 1) ELSE regexp_extract({_HOST}, '([^.]+)[.][^.]*$', 1) END)"
_DOMAIN = f"({_LABEL} IN ({_SITES}))"
_EXT = f"regexp_matches(lower(string_split(url, '?')[1]), '({_ENDINGS})$')"
_BAD = f"(NOT regexp_matches(url, '{U.WELL_FORMED}'))"


#: Addresses of pages, and for each a second one that may break a rule: another site, ending or form, or cut short.
_VARIANTS = ("https://www.flickr.com/p/{0}", "http://shop.amazon.co.uk/{0}", "https://twitter.com.au/{0}", "https://example.org/{0}/a.JPG?x=1", "http://files.example.net/{0}.tar.gz", "http:/", "h://a.b", "ftp://example.org/{0}", "https://no host/{0}", "http://10.0.0.1:80/{0}", "https://news.example.co.jp/{0}")
_LINKS = "(SELECT page_id, url FROM pages UNION ALL SELECT page_id, CASE page_id % 11 " + " ".join(f"WHEN {k} THEN replace('{v}', '{{0}}', CAST(page_id AS VARCHAR))" for k, v in enumerate(_VARIANTS)) + " END FROM pages)"

_VERDICT = f"""SELECT page_id, url, CASE WHEN {_DOMAIN} THEN 'domain' WHEN {_EXT} THEN 'extension' WHEN length(url) <= 8 THEN 'short' WHEN {_BAD} THEN 'malformed'
 WHEN row_number() OVER (PARTITION BY url ORDER BY page_id) > 1 THEN 'duplicate' ELSE 'ok' END AS verdict FROM {_LINKS}"""


def _links(t: Tables):
    variants = F.array(*(F.lit(v) for v in _VARIANTS))
    second = F.replace(F.get(variants, (F.col("page_id") % len(_VARIANTS)).cast("int")), F.lit("{0}"), F.col("page_id").cast("string"))
    return t.pages.select("page_id", "url").union(t.pages.select("page_id", second))


@query("url_domain_block", f"SELECT page_id, {_LABEL} AS site FROM {_LINKS} WHERE {_DOMAIN}")
def url_domain_block(t: Tables):
    return _links(t).where(U.blocked_site(F.col("url"))).select("page_id", U.site_label(F.col("url")).alias("site"))


@query("url_ext_block", f"SELECT page_id, url FROM {_LINKS} WHERE {_EXT}")
def url_ext_block(t: Tables):
    return _links(t).where(U.blocked_ending(F.col("url"))).select("page_id", "url")


@query("url_short", f"SELECT page_id, url FROM {_LINKS} WHERE length(url) <= 8")
def url_short(t: Tables):
    return _links(t).where(U.short(F.col("url"))).select("page_id", "url")


@query("url_malformed", f"SELECT page_id, url FROM {_LINKS} WHERE {_BAD}")
def url_malformed(t: Tables):
    return _links(t).where(U.malformed(F.col("url"))).select("page_id", "url")


@query("url_verdict", _VERDICT)
def url_verdict(t: Tables):
    nth = F.row_number().over(Window.partitionBy("url").orderBy("page_id"))
    return _links(t).select("page_id", "url", nth.alias("nth")).select("page_id", "url", U.verdict(F.col("url"), F.col("nth")).alias("verdict"))


@query("url_verdict_counts", f"SELECT verdict, count(*) AS n FROM ({_VERDICT}) GROUP BY verdict")
def url_verdict_counts(t: Tables):
    return url_verdict(t).groupBy("verdict").agg(F.count("*").alias("n"))


@query("url_distinct", f"SELECT DISTINCT {_HOST} AS host FROM pages")
def url_distinct(t: Tables):
    return t.pages.select(U.host(F.col("url")).alias("host")).distinct()


@query("clean_text", r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, 'https?://[^\s]+', '', 'g'), '[ ]+', ' ', 'g'), '[^0-9A-Za-z\x{4e00}-\x{9fa5},.!?;:()''" -]', '', 'g')) AS text FROM documents""")
def clean_text(t: Tables):
    return t.documents.select("doc_id", T.clean_text(F.col("text")).alias("text"))


@query("clean_text_task", r"""SELECT doc_id, trim(replace(replace(replace(regexp_replace(replace(text, chr(10), ' '), '\s+', ' ', 'g'), ' . ', '. '), ' . ', '. '), ' . ', '. ')) AS text FROM documents""")
def clean_text_task(t: Tables):
    return t.documents.select("doc_id", T.clean_task_text(F.col("text")).alias("text"))


@query("general_cleaning", r"""SELECT doc_id, regexp_replace(text, '(  +|\b\n+ |\b\n+)', ' ', 'g') AS text FROM documents""")
def general_cleaning(t: Tables):
    return t.documents.select("doc_id", T.general_cleaning(F.col("text")).alias("text"))


@query("to_instruction", "SELECT doc_id, '' AS instruction, '' AS input, text AS output FROM documents")
def to_instruction(t: Tables):
    return R.to_instruction(t.documents, "text", "output", keep=["doc_id"])


@query("coalesce_keys", "SELECT conv_id, turn, coalesce(CASE WHEN role = 'user' THEN text END, CASE WHEN role = 'assistant' THEN text END, '') AS output FROM conversations")
def coalesce_keys(t: Tables):
    c = t.conversations.select("conv_id", "turn", F.when(F.col("role") == "user", F.col("text")).alias("query"), F.when(F.col("role") == "assistant", F.col("text")).alias("response"))
    return R.first_key(c, ["query", "response"], "output", default="").select("conv_id", "turn", "output")


@query("lang_filter", "SELECT doc_id, lang FROM documents WHERE lang = 'en'")
def lang_filter(t: Tables):
    return t.documents.where(F.col("lang") == "en").select("doc_id", "lang")


_NW = r"len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '))"


@query("small_doc", f"SELECT doc_id FROM documents WHERE length(text) < 1024 AND {_NW} < 128")
def small_doc(t: Tables):
    return t.documents.where(R.is_small(F.col("text"))).select("doc_id")


_CLEANUP = f"""SELECT doc_id, CASE WHEN length(text) < 512 THEN 'remove_512' WHEN length(text) < 256 AND contains(lower(text), 'javascript') THEN 'remove_256_javascript'
 WHEN length(text) < 512 AND lang <> 'en' THEN 'remove_512_non_english' WHEN contains(text, '  ') THEN 'general_cleaning' ELSE 'unchanged' END AS verdict FROM documents"""


@query("cleanup_fix", _CLEANUP)
def cleanup_fix(t: Tables):
    return t.documents.select("doc_id", R.cleanup_verdict(F.col("text"), F.col("lang")).alias("verdict"))


@query("cleanup_fix_split", f"SELECT doc_id, CASE WHEN verdict LIKE 'remove%' THEN 'filtered' ELSE 'cleaned' END AS side FROM ({_CLEANUP})")
def cleanup_fix_split(t: Tables):
    return cleanup_fix(t).select("doc_id", F.when(F.col("verdict").startswith("remove"), "filtered").otherwise("cleaned").alias("side"))


@query("cleanup_counts", f"SELECT verdict, count(*) AS n FROM ({_CLEANUP}) GROUP BY verdict")
def cleanup_counts(t: Tables):
    return cleanup_fix(t).groupBy("verdict").agg(F.count("*").alias("n"))


@query("add_id", "SELECT doc_id, printf('%s-%010d', source, row_number() OVER (PARTITION BY source ORDER BY doc_id)) AS adlr_id FROM documents")
def add_id(t: Tables):
    return R.add_id(t.documents, "source", "doc_id").select("doc_id", F.col("id").alias("adlr_id"))


@query("pref_pairs", """WITH c AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS chosen, lead(text, 2) OVER (PARTITION BY conv_id ORDER BY turn) AS rejected FROM conversations)
SELECT conv_id, turn, text AS prompt, chosen, rejected FROM c WHERE chosen <> rejected AND length(chosen) > 0 AND length(rejected) > 0""")
def pref_pairs(t: Tables):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = t.conversations.select("conv_id", "turn", F.col("text").alias("prompt"), F.lead("text").over(w).alias("chosen"), F.lead("text", 2).over(w).alias("rejected"))
    return R.preference_pairs(c)


@query("prefix_filter", "SELECT doc_id, source FROM documents WHERE starts_with(source, 'src1')")
def prefix_filter(t: Tables):
    return t.documents.where(F.col("source").startswith("src1")).select("doc_id", "source")


def _chain(pairs) -> str:
    s = "text"
    for a, b in pairs:
        lit = lambda x: "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
        s = f"replace({s}, {lit(a)}, {lit(b)})"
    return s


@query("detok_wiki", "SELECT doc_id, " + _chain(((" @-@ ", "-"), (" @,@ ", ","), (" @.@ ", "."), (" : ", ": "), (" ; ", "; "), (" . ", ". "), (" ! ", "! "), (" ? ", "? "), (" , ", ", "), ("= = = =", "===="), ("= = =", "==="), ("= =", "=="), (" \n", "\n"), ("\n ", "\n"), (" N ", " 1 "), (" 's", "'s"))) + " AS text FROM documents")
def detok_wiki(t: Tables):
    return t.documents.select("doc_id", T.detok_wiki(F.col("text")).alias("text"))


@query("detok_ptb", "SELECT doc_id, " + _chain(((" '", "'"), (" \n", "\n"), ("\n ", "\n"), (" n't", "n't"), (" N ", "1 "), ("$ 1", "$1"), ("# 1", "#1"))) + " AS text FROM documents")
def detok_ptb(t: Tables):
    return t.documents.select("doc_id", T.detok_ptb(F.col("text")).alias("text"))


@query("detok_general", "SELECT doc_id, regexp_replace(" + _chain(((" n't", "n't"), (" )", ")"), ("( ", "("), ('" ', '"'), (' "', '"'))) + r", ' ([.,])', '\1', 'g') AS text FROM documents")
def detok_general(t: Tables):
    return t.documents.select("doc_id", T.detok_general(F.col("text")).alias("text"))


@query("hellaswag_clean", r"SELECT doc_id, replace(regexp_replace(replace(trim(text, ' '), ' [title]', '. '), '\[[^\]]*\]', '', 'g'), '  ', ' ') AS text FROM documents")
def hellaswag_clean(t: Tables):
    return t.documents.select("doc_id", T.hellaswag_clean(F.col("text")).alias("text"))


@query("norm_question", "SELECT conv_id, turn, CASE WHEN ends_with(text, '?') THEN left(text, length(text) - 1) ELSE text END AS question FROM conversations")
def norm_question(t: Tables):
    return t.conversations.select("conv_id", "turn", T.normalize_question(F.col("text")).alias("question"))


@query("get_words", r"SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS BIGINT) AS n_words, md5(array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ' ')) AS words_md5 FROM documents")
def get_words(t: Tables):
    w = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    return t.documents.select("doc_id", F.size(w).cast("bigint").alias("n_words"), F.md5(F.array_join(w, " ").cast("binary")).alias("words_md5"))


@query("janitor_normalize", r"SELECT doc_id, regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[!-/:-@\[-`{-~]', '', 'g') AS text FROM documents")
def janitor_normalize(t: Tables):
    return t.documents.select("doc_id", T.janitor_normalize(F.col("text")).alias("text"))


@query("normalize_answer", r"SELECT item_id, array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '\s+', ' ', 'g')), ' '), lambda x: x NOT IN ('a', 'an', 'the')), ' ') AS answer FROM benchmark")
def normalize_answer(t: Tables):
    return t.benchmark.select("item_id", T.normalize_answer(F.col("text")).alias("answer"))


@query("split_sentences", r"SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, s[1] AS first_sentence FROM (SELECT doc_id, string_split(regexp_replace(trim(text, ' '), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents)")
def split_sentences(t: Tables):
    s = t.documents.select("doc_id", T.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("bigint").alias("n_sentences"), F.get("s", F.lit(0)).alias("first_sentence"))


@query("scan_nonempty", "SELECT doc_id FROM documents WHERE length(text) > 0")
def scan_nonempty(t: Tables):
    return t.documents.where(F.length("text") > 0).select("doc_id")


@query("corrupt_split", "SELECT event_id, CASE WHEN json_valid(props) THEN 'parsed' ELSE 'corrupt' END AS side FROM events")
def corrupt_split(t: Tables):
    return t.events.select("event_id", R.json_side(F.col("props")).alias("side"))


@query("bench_scan", "SELECT item_id, text, CAST(length(text) AS BIGINT) AS n_chars FROM benchmark WHERE length(text) > 0")
def bench_scan(t: Tables):
    return t.benchmark.where(F.length("text") > 0).select("item_id", "text", F.length("text").cast("bigint").alias("n_chars"))


@query("evidence_unique", "SELECT count(*) AS n_rows, count(DISTINCT doc_id) AS n_ids, count(*) = count(DISTINCT doc_id) AS is_unique FROM documents")
def evidence_unique(t: Tables):
    return t.documents.agg(F.count("*").alias("n_rows"), F.countDistinct("doc_id").alias("n_ids")).withColumn("is_unique", F.col("n_rows") == F.col("n_ids"))


@query("file_offsets", "WITH f AS (SELECT source, count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS size FROM documents GROUP BY source) SELECT source, n_docs, size, CAST(coalesce(sum(size) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM f")
def file_offsets(t: Tables):
    f = t.documents.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.length("text")).alias("size"))
    return f.withColumn("start", F.coalesce(F.sum("size").over(Window.orderBy("source").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint"))


@query("task_match", "SELECT DISTINCT source FROM documents WHERE source LIKE 'src_'")
def task_match(t: Tables):
    return R.match_names(t.documents.select("source").distinct(), "source", ["src?"])


@query("frac_per_class", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE nth <= floor(0.5 * n)")
def frac_per_class(t: Tables):
    return R.fraction_per_class(t.documents, "source", "doc_id", 0.5).select("doc_id", "source")


@query("parse_args", "SELECT p_partkey, p_type AS type, p_size AS size FROM part")
def parse_args(t: Tables):
    s = F.concat(F.lit("type="), F.col("p_type"), F.lit(",size="), F.col("p_size").cast("string"))
    m = F.str_to_map(s, F.lit(","), F.lit("="))
    return t.part.select("p_partkey", m["type"].alias("type"), m["size"].cast("int").alias("size"))


@query("stop_token_cut", r"""SELECT doc_id, left(text, CAST(least(CASE WHEN instr(text, chr(10)) > 0 THEN instr(text, chr(10)) - 1 ELSE length(text) END, CASE WHEN instr(text, '. ') > 0 THEN instr(text, '. ') - 1 ELSE length(text) END) AS INT)) AS text FROM documents""")
def stop_token_cut(t: Tables):
    return t.documents.select("doc_id", R.cut_at(F.col("text"), ["\n", ". "]).alias("text"))


@query("split_question", "SELECT doc_id, CASE WHEN instr(text, chr(10)) > 0 THEN left(text, instr(text, chr(10)) - 1) ELSE '' END AS question, CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) ELSE text END AS body FROM documents")
def split_question(t: Tables):
    at = F.instr("text", "\n")
    return t.documents.select("doc_id", F.when(at > 0, F.left(F.col("text"), at - 1)).otherwise("").alias("question"), F.when(at > 0, F.substring(F.col("text"), at + 1, F.length("text"))).otherwise(F.col("text")).alias("body"))


@query("vocab_pad", "SELECT lang, count(*) AS size, CAST(ceil(count(*) / 128.0) * 128 AS BIGINT) AS padded FROM documents GROUP BY lang")
def vocab_pad(t: Tables):
    return t.documents.groupBy("lang").agg(F.count("*").alias("size")).withColumn("padded", R.pad_to_multiple(F.col("size"), 128))
