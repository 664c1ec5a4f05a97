"""Benchmark items inside documents, by SimHash windows and a multi-index Hamming join; SQL functions only.

Texts become lower-case words of letters and digits, so marks put next to a word do no harm, and
n-word shingles (an item of fewer words has one of all its words). Every window of an item's number
of words counts, at every word. The similarity of a window and an item is that of their shingles
with their numbers as weights (sum of minima over sum of maxima). A similarity of ``least`` takes a
known number of the window's places to have shingles that some item of that length has, so windows with fewer
are passed over: none of them can reach it.

The k-th of equal shingles is a token of its own, so weights become plain sets. Each window and
item gets a 128-bit SimHash: the window's of those tokens that are shingles of items. It is cut into 8 blocks of
16 bits; the index holds an item's blocks with up to 2 bits flipped and is asked for a window's
blocks with up to 1 bit flipped. Two fingerprints within 31 bits have a block within 3 bits, so
all such pairs are found; of unrelated ones about 8 % are. The exact similarity decides at last.
Windows of the same tokens are looked up once.

Defined cases: null and empty texts and texts without letters and digits match nothing; a document
shorter than an item is one window; repeated rows and items that are alike each match; rows that share
an id are looked at apart, and the best window of any is reported; of windows that are
equally good the first is; documents with a null id are not reported; other columns are ignored;
without items nothing matches.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.runtime import small_side, stored

BLOCKS, BLOCK_BITS, RADIUS = 8, 16, 31
#: Bits flipped in a block of an item and of a window; together the errors that a block may have within the radius.
ITEM_FLIPS, WINDOW_FLIPS = 2, 1
#: Words of a document whose hits are looked at together; items longer than this make it longer.
SEGMENT = 4096


def plain_words(text: str) -> Column:
    """Lower-case runs of letters, marks and digits."""
    w = F.split(F.trim(F.regexp_replace(F.lower(F.col(text).cast("string")), r"[^\p{L}\p{M}\p{N}]+", " ")), " ")
    return F.coalesce(F.filter(w, lambda x: x != ""), F.array().cast("array<string>"))


def shingle_hashes(words: str, width: int) -> Column:
    """A hash of each ``width`` words in a row, in order; none if there are fewer."""
    w = F.col(words)
    each = F.transform(F.slice(w, 1, F.greatest(F.size(w) - (width - 1), F.lit(0))), lambda x, i: F.xxhash64(F.lit(width), x, *(F.get(w, i + k) for k in range(1, width))))
    return F.when(F.size(w) >= width, each).otherwise(F.array().cast("array<bigint>"))


def tokens(hashes: str) -> Column:
    """Of a sorted array: a hash of each value and its number among equal ones."""
    return F.expr(f"transform({hashes}, (h, i) -> xxhash64(h, i + 1 - array_position({hashes}, h)))")


def simhash(own: str, half: int) -> Column:
    """64 bits; each is set if most hashes of the tokens have it set. ``half``: 0 or 1, for independent ones."""
    hashes = f"transform({own}, x -> xxhash64(x, {half}))"
    return F.expr(f"transform(array({hashes}), t -> aggregate(sequence(0, 63), 0L, (acc, b) -> acc | IF(2 * aggregate(t, 0, (n, x) -> n + CAST(getbit(x, b) AS INT)) > size(t), shiftleft(1L, b), 0L)))[0]")


def blocks(first: str, second: str, flips: int) -> Column:
    """(block, value) of a fingerprint of two halves, and of all values up to ``flips`` bits away."""
    masks = [sum(1 << b for b in bits) for n in range(flips + 1) for bits in combinations(range(BLOCK_BITS), n)]
    each = BLOCKS // 2
    out = []
    for k in range(BLOCKS):
        half = F.col(first if k < each else second)
        value = F.shiftrightunsigned(half, BLOCK_BITS * (k % each)).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")
        out.append(F.struct(F.lit(k).alias("block"), value.alias("value")))
    return F.flatten(F.transform(F.array(*out), lambda b: F.transform(F.array(*map(F.lit, masks)), lambda m: F.struct(b["block"].alias("block"), b["value"].bitwiseXOR(m).alias("value")))))


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 5, least: float = 0.8, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document and item that it contains: ids, window_start (word number from 0), window_words and similarity of the best window."""
    items = benchmark.select(F.col(item_id).alias("item"), plain_words(item_text).alias("words")).where("size(words) > 0 AND item IS NOT NULL")
    items = items.withColumn("length", F.size("words")).withColumn("width", F.least(F.lit(n), "length"))
    own = F.array().cast("array<bigint>")
    for width in range(1, n + 1):
        own = F.when(F.col("width") == width, shingle_hashes("words", width)).otherwise(own)
    items = items.withColumn("own", F.array_sort(own)).drop("words").withColumn("tokens", tokens("own"))
    items = stored(items.select("*", simhash("tokens", 0).alias("p0"), simhash("tokens", 1).alias("p1")), "items")
    widths = sorted(r[0] for r in items.select("width").distinct().collect()) or [n]

    # places of shingles that items have, each document read once
    spots = small_side(stored(items.select("length", "width", F.explode("own").alias("hash")).distinct(), "spots"))
    base = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("__text")).where("doc IS NOT NULL AND __text IS NOT NULL")
    cut = base.select("doc", F.xxhash64("__text").alias("version"), plain_words("__text").alias("words"))
    each = F.concat(*(F.transform(shingle_hashes("words", w), lambda h, i: F.struct(i.alias("pos"), h.alias("hash"))) for w in widths))
    hits = cut.select("doc", "version", F.size("words").alias("n_words"), F.inline(each)).join(spots, "hash")
    hits = hits.select("doc", "version", "n_words", "length", "width", "pos", "hash", F.expr(f"pos DIV greatest({SEGMENT}, length)").cast("int").alias("segment"))
    # a window may reach into the segment after its own
    reach = F.when((F.col("segment") > 0) & (F.col("pos") - F.col("segment") * F.greatest(F.lit(SEGMENT), "length") < F.col("length")), F.array("segment", F.col("segment") - 1)).otherwise(F.array("segment"))
    hits = hits.withColumn("segment", F.explode(reach))
    rows = hits.groupBy("doc", "version", "n_words", "length", "width", "segment").agg(F.array_sort(F.collect_set(F.struct("pos", "hash"))).alias("a"))

    # windows with enough hits; size: shingles of a window, full: of an item, need: hits for the least similarity
    rows = rows.withColumn("full", F.expr("length - width + 1")).withColumn("size", F.expr("least(full, n_words - width + 1)"))
    rows = rows.withColumn("need", F.ceil(F.lit(least) * (F.col("full") + F.col("size")) / F.lit(1 + least) - 1e-9).cast("int")).withColumn("end", F.expr("greatest(0, n_words - length)"))
    # the first hit of a window, and the starts that have it as their first; hits that begin in the next segment are its own
    dense = f"filter(transform(a, (x, i) -> named_struct('i', i, 'low', greatest(0, x.pos - (size - need), IF(i = 0, 0, get(a, i - 1).pos + 1)), 'high', least(x.pos, end), 'on', x.pos < (segment + 1) * greatest({SEGMENT}, length) AND get(a, i + need - 1).pos < x.pos + size)), x -> x.on AND x.low <= x.high)"
    starts = f"flatten(transform({dense}, x -> transform(sequence(x.low, x.high), s -> named_struct('start', s, 'found', transform(filter(slice(a, x.i + 1, size), y -> y.pos < s + size), y -> y.hash)))))"
    windows = rows.where("size(a) >= need").select("doc", "length", "n_words", "full", "size", "need", F.expr(f"inline({starts})")).where("size(found) >= need")
    windows = windows.withColumn("found", F.array_sort("found"))
    windows = windows.select("doc", "length", "full", "size", "start", F.expr("least(length, n_words)").alias("window_words"), F.xxhash64("found").alias("k0"), F.xxhash64(F.lit(1), "found").alias("k1"), "found")
    windows = stored(windows, "windows")

    alike = ["length", "size", "k0", "k1"]
    kinds = windows.groupBy(*alike).agg(F.any_value("full").alias("full"), F.any_value("found").alias("found")).withColumn("tokens", tokens("found"))
    kinds = stored(kinds.select(*alike, "full", "tokens", simhash("tokens", 0).alias("w0"), simhash("tokens", 1).alias("w1")), "kinds")
    index = items.select("item", "length", "p0", "p1", F.inline(blocks("p0", "p1", ITEM_FLIPS)))
    near = kinds.select(*alike, "w0", "w1", F.inline(blocks("w0", "w1", WINDOW_FLIPS))).join(small_side(index), ["length", "block", "value"])
    near = near.where(F.bit_count(F.col("w0").bitwiseXOR(F.col("p0"))) + F.bit_count(F.col("w1").bitwiseXOR(F.col("p1"))) <= radius).select(*alike, "item").distinct()
    pairs = near.join(kinds.select(*alike, "full", "tokens"), alike).join(small_side(items.select("item", F.col("length").alias("l"), F.col("tokens").alias("other"))), "item").where("l = length")
    pairs = pairs.withColumn("both", F.size(F.array_intersect("tokens", "other")))
    pairs = pairs.withColumn("similarity", F.col("both").cast("double") / (F.col("size") + F.col("full") - F.col("both"))).where(F.col("similarity") >= least)
    pairs = stored(pairs.select(*alike, "item", "similarity").distinct(), "pairs")
    best = windows.drop("found").join(small_side(pairs), alike).groupBy("doc", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("before"), "window_words")).alias("b"))
    return best.select(F.col("doc").alias(id_col), F.col("item").alias(item_id), (-F.col("b.before")).alias("window_start"), F.col("b.window_words").alias("window_words"), F.col("b.similarity").alias("similarity"))


#: contaminated() over documents and benchmark: every window of every document that shares a shingle with the item.
ORACLE_SQL = r"""
WITH dw AS (SELECT doc_id, row_number() OVER () AS r, list_filter(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
iw AS (SELECT item_id, list_filter(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM benchmark),
items AS (SELECT item_id, len(w) AS l, least(5, len(w)) AS k, w FROM iw WHERE len(w) > 0),
ish AS (SELECT item_id, l, k, array_to_string(w[g + 1 : g + k], ' ') AS s, count(*) AS c FROM items, unnest(range(0, l - k + 1)) AS t(g) GROUP BY ALL),
dsh AS (SELECT r, doc_id, len(w) AS n, k, g AS pos, array_to_string(w[g + 1 : g + k], ' ') AS s FROM dw, (SELECT DISTINCT k FROM items) AS ks, unnest(range(0, len(w) - k + 1)) AS t(g)),
met AS (SELECT DISTINCT d.r, d.doc_id, d.n, i.item_id, i.l, i.k FROM dsh AS d JOIN ish AS i USING (k, s)),
hit AS (SELECT d.r, i.item_id, i.l, d.k, d.pos, d.s, i.c FROM dsh AS d JOIN ish AS i USING (k, s)),
places AS (SELECT r, doc_id, item_id, l, k, least(l, n) AS m, a FROM met, unnest(range(0, greatest(0, n - l) + 1)) AS t(a)),
win AS (SELECT p.r, p.doc_id, p.item_id, p.l, p.k, p.a, p.m, h.s, least(count(*), any_value(h.c)) AS c FROM places AS p JOIN hit AS h ON h.r = p.r AND h.item_id = p.item_id AND h.pos >= p.a AND h.pos + p.k <= p.a + p.m GROUP BY ALL),
sim AS (SELECT doc_id, item_id, a, m, CAST(sum(c) AS DOUBLE) / CAST(m - k + 1 + l - k + 1 - sum(c) AS DOUBLE) AS similarity FROM win GROUP BY r, doc_id, item_id, l, k, a, m)
SELECT doc_id, item_id, CAST(arg_max(a, (similarity, -a)) AS INT) AS window_start, CAST(arg_max(m, (similarity, -a)) AS INT) AS window_words, max(similarity) AS similarity
FROM sim WHERE similarity >= 0.8 GROUP BY doc_id, item_id
"""
