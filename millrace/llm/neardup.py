"""Near-duplicate documents: MinHash signatures joined by a multi-index, links confirmed on full sets.

A document's set is its distinct word shingles. Documents with equal sets (128-bit sums of shingle
hashes) are one class, and only a class's first document goes on. Its signature has components
of 16 bits in chunks of 8, and two classes are candidates if some chunk differs in one component
at most: of every chunk the eight ways to leave one component out are looked up (allowed chunk
errors). By the pigeonhole principle that finds every pair of signatures that differ in fewer
components than twice the chunks. There are so many chunks that a pair just at the least similarity
is missed with a probability under 1e-6 (13 chunks for 0.85, 20 for 0.8), above it with less.

Members of a look-up group are tied to its smallest one as rows are read in order, never paired.
What hangs together so is a group whose texts come together once. A group of more than
``task_shingles`` shingles is first taken apart by an exact rule: with shingles in one common order,
those that many of its documents have last, two documents that are linked share one of their first
n - least shared + 1 shingles. Documents of one template with parts of their own share none of
those, so they fall apart without being compared. What is still larger is dealt into blocks, and
every pair of blocks is a task, so no task holds an unbounded group and no pair is left out.

Within a task the same rule, by rising frequency, says which documents are compared at all; those that
are connected already are not. Links are confirmed on full shingle sets and give the components.

Defined cases: null or empty texts and texts without words have the empty set and are linked with
nothing; rows that share an id are one node, whatever their texts, unless ``by_row``; a null id gets
component_id null and kept true; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import words as W
from millrace.llm.components import components
from millrace.llm.runtime import give_back, small_side, stored

CHUNK, MISSED = 8, 1e-6
#: Shingles that a task compares at once.
TASK_SHINGLES = 4_000_000
#: A shingle counts as frequent in a group, and so comes last, if more than one document in so many has it.
FREQUENT = 20

_MOST = 400  # chunks; enough for a similarity of 0.5
_rng = np.random.RandomState(20240607)
_FACTORS = (_rng.randint(0, 1 << 62, _MOST * CHUNK).astype(W.U64) << W.U64(1)) | W.U64(1)
_SLOTS = W.mix(np.arange(1, _MOST * CHUNK + 1).astype(W.U64) * W.U64(0x9E3779B97F4A7C15)).reshape(_MOST, CHUNK)


def chunks_for(percent: int) -> int:
    """Chunks that leave a pair of this similarity unfound with a probability under MISSED."""
    j = percent / 100
    found = j**CHUNK + CHUNK * j ** (CHUNK - 1) * (1 - j)
    chunks = 1 if found >= 1 else math.ceil(math.log(MISSED) / math.log(1 - found))
    if chunks > _MOST:
        raise ValueError(f"a similarity of {percent} % needs {chunks} chunks; {_MOST} are the most")
    return chunks


def shingles(data: np.ndarray, offsets: np.ndarray, n: int, both: bool = False):
    """Distinct n-word shingle hashes of each text, lower-cased (A-Z): rows (ascending), hashes[, second hashes].

    A text of fewer words has its whole sequence as one.
    """
    data = W.LOWER[data]
    starts, ends, first = W.spans(data, offsets)
    ok = W.inside(first, n, len(starts))
    word = W.row_of(first)
    counts = np.diff(first)
    short = np.flatnonzero((counts > 0) & (counts < n))
    found = []
    for which in range(2 if both else 1):
        h = W.span_hash(data, starts, ends, which)
        rest = [W.ngram_hash(h[first[k] : first[k + 1]], int(counts[k]), which) for k in short]
        found.append(np.concatenate([W.ngram_hash(h, n, which)[ok], *rest]))
    rows = np.concatenate([word[: len(ok)][ok], short])
    if len(short):
        order = np.argsort(rows, kind="stable")
        rows, found = rows[order], [x[order] for x in found]
    _, at = np.unique(found[0] + rows.astype(W.U64) * W.U64(0xD6E8FEB86659FD93), return_index=True)
    at.sort()
    return rows[at], *(x[at] for x in found)


def signatures(rows: np.ndarray, h: np.ndarray, n_rows: int, chunks: int) -> np.ndarray:
    """16-bit components, a line for each row; rows without shingles have zeros."""
    out = np.zeros((n_rows, chunks * CHUNK), np.uint16)
    if len(rows):
        new = np.flatnonzero(np.diff(rows, prepend=-1))
        for k, a in enumerate(_FACTORS[: chunks * CHUNK]):
            out[rows[new], k] = W.mix(np.minimum.reduceat(h * a, new)) >> W.U64(48)
    return out


def look_ups(signature: np.ndarray) -> np.ndarray:
    """The keys of each signature: every chunk with every one component left out."""
    s = signature.reshape(len(signature), -1, CHUNK).astype(W.U64)
    keys = []
    for left in range(CHUNK):
        h = np.zeros(s.shape[:2], W.U64)
        for k in range(CHUNK):
            if k != left:
                h = W.mix(h ^ (s[:, :, k] + W.U64(k << 20)))
        keys.append(h + _SLOTS[: s.shape[1], left])
    return W.mix(np.stack(keys, 2)).reshape(len(s), -1)


def _sign(n: int, chunks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.column(batch, "__text")
            for lo, hi in W.pieces(offsets):
                rows, h1, h2 = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], n, both=True)
                m = hi - lo
                size = np.bincount(rows, minlength=m)
                sums = []
                for h in (h1, h2):
                    s, new = np.zeros(m, W.U64), np.flatnonzero(np.diff(rows, prepend=-1))
                    if len(new):
                        s[rows[new]] = np.add.reduceat(W.mix(h), new)
                    sums.append(pa.array(s.view(np.int64)))
                signed = pa.array([x.tobytes() for x in signatures(rows, h1, m, chunks)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("__id")[lo:hi], batch.column("__version")[lo:hi], pa.array(size.astype(np.int64)), *sums, signed], names=["id", "version", "n", "f1", "f2", "signature"])
        give_back()

    return run


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            signature = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint16).reshape(part.num_rows, -1)
            keys = look_ups(signature)
            ids = np.repeat(W.int_column(part, "node"), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(ids)], names=["key", "id"])
    give_back()


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key and id: each id of a key with the key's smallest id."""
    key = least = None
    for batch in batches:
        keys, ids = W.int_column(batch, "key"), W.int_column(batch, "id")
        if not len(keys):
            continue
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        new[0] = keys[0] != key
        head = np.where(new, ids, 0)
        at = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        star = np.where(run < 0, least if least is not None else 0, head[at[np.maximum(run, 0)]] if len(at) else 0)
        key, least = int(keys[-1]), int(star[-1])
        pairs = np.unique(np.stack([ids, star], 1)[ids != star], axis=0)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])


def leading(size: np.ndarray, percent: int) -> np.ndarray:
    """How many shingles, in a common order, two linked documents share one of at least: n - least shared + 1."""
    return size - -(-percent * size // 100) + 1


def _postings(row: np.ndarray, code: np.ndarray, m: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The leading shingles of each document, rare ones first: numbers of lists by document and its first, and the documents of each list."""
    frequency = np.bincount(code)
    order = np.lexsort((code, frequency[code], row))
    size = np.bincount(row, minlength=m)
    first = np.cumsum(size) - size
    lead = (np.arange(len(row)) - first[row]) < leading(size, percent)[row]
    code, row = code[order][lead], row[lead]
    by = np.argsort(code, kind="stable")
    new = np.diff(code[by], prepend=-1) != 0
    number = np.empty(len(code), np.int64)
    number[by] = np.cumsum(new) - 1
    return number, np.searchsorted(row, np.arange(m + 1)), np.split(row[by], np.flatnonzero(new)[1:])


def _links(ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, side: np.ndarray, n: int, percent: int) -> list[tuple[int, int]]:
    """Confirmed links that connect the documents of one task; side: 0 both, else only pairs of 1 and 2 count."""
    row, h = shingles(data, offsets, n)
    m = len(ids)
    size = np.bincount(row, minlength=m)
    values, code = np.unique(h, return_inverse=True)
    first = np.searchsorted(row, np.arange(m + 1))
    full = np.flatnonzero(size)
    if len(full) < 2:
        return []
    number, own_lists, lists = _postings(row, code, m, percent)
    up = np.arange(m)
    left = len(full)
    mark = np.zeros(len(values), bool)
    out = []
    done = np.zeros(m, bool)
    for i in full[np.argsort(-size[full], kind="stable")]:
        if left <= 1:
            break
        done[i] = True
        met = [x for x in (lists[k] for k in number[own_lists[i] : own_lists[i + 1]]) if len(x) > 1]
        if not met:
            continue
        near = np.unique(np.concatenate(met)) if len(met) > 1 else met[0]
        near = near[~done[near] & (up[near] != up[i]) & (100 * size[near] >= percent * size[i])]
        if side[i]:
            near = near[side[near] != side[i]]
        if not len(near):
            continue
        own = code[first[i] : first[i + 1]]
        mark[own] = True
        if len(near) * 4 > m:
            shared = np.add.reduceat(np.append(mark[code], False).astype(np.int64), np.minimum(first[:-1], len(code)))[near]
        else:
            shared = np.array([np.count_nonzero(mark[code[first[j] : first[j + 1]]]) for j in near])
        mark[own] = False
        for j in near[100 * shared >= percent * (size[i] + size[near] - shared)]:
            if up[i] != up[j]:
                up[up == up[j]] = up[i]
                out.append((int(ids[i]), int(ids[j])))
                left -= 1
    return out


def _confirm(n: int, percent: int):
    """From rows sorted by task: the links of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def close() -> list[tuple[int, int]]:
            if not held:
                return []
            t = pa.Table.from_batches(held)
            held.clear()
            data, offsets = W.column(t, "__text")
            return _links(W.int_column(t, "id"), data[offsets[0] : offsets[-1]], offsets - offsets[0], W.int_column(t, "side"), n, percent)

        for batch in batches:
            tasks = W.int_column(batch, "task")
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(tasks)) + 1, [len(tasks)]])
            found = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a:
                    if tasks[a] != now:
                        found += close()
                        now = tasks[a]
                    held.append(batch.slice(a, b - a))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], names=["u", "v"])
        found = close()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], names=["u", "v"])
        give_back()

    return run


def _sets(n: int):
    """Per document its shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.column(batch, "__text")
            for lo, hi in W.pieces(offsets):
                rows, h = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], n)
                at = np.searchsorted(rows, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("node")[lo:hi], batch.column("group")[lo:hi], pa.ListArray.from_arrays(pa.array(at), pa.array(h.view(np.int64)))], names=["node", "group", "own"])
        give_back()

    return run


def _stars_of(keys: DataFrame) -> DataFrame:
    return keys.repartition("key").sortWithinPartitions("key", "id").mapInArrow(_stars, "u long, v long")


def _apart(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(node, group): large groups taken apart by the leading shingles of their documents. ``texts``: node, group, __text."""
    own = stored(texts.mapInArrow(_sets(n), "node long, group long, own array<long>"), "sets")
    each = own.select("node", "group", F.size("own").alias("n"), F.explode("own").alias("h"))
    most = own.groupBy("group").agg((F.count("*") / FREQUENT).alias("most"))
    frequent = each.groupBy("group", "h").agg(F.count("*").alias("c")).join(small_side(most), "group").where("c > most").select("group", "h", F.lit(1).alias("late"))
    ordered = each.join(small_side(stored(frequent, "frequent")), ["group", "h"], "left").groupBy("node", "group", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("late", F.lit(0)).alias("late"), "h"))).alias("a"))
    lead = F.col("n") - F.expr(f"({percent} * n + 99) DIV 100").cast("int") + 1
    keys = ordered.select(F.col("node").alias("id"), "group", F.explode(F.slice("a", F.lit(1), lead)).alias("x"))
    return components(_stars_of(keys.select(F.xxhash64("group", "x.h").alias("key"), "id"))).withColumnRenamed("component", "group")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", task_shingles: int = TASK_SHINGLES, by_row: bool = False) -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable over links), kept (id = component_id).

    Texts are linked if 100 * shared shingles >= ``percent`` * shingles of either. ``by_row``: rows of one
    id are documents of their own, unless their texts are linked; ``version`` (a hash of the text) comes too,
    and of each component the rows of the smallest id and version are kept.
    """
    base = docs.select(F.col(id_col).cast("long").alias("__id"), F.xxhash64(F.col(text_col).cast("string")).alias("__version"), F.col(text_col).cast("string").alias("__text"))
    signed = stored(base.mapInArrow(_sign(n, chunks_for(percent)), "id long, version long, n long, f1 long, f2 long, signature binary"), "signed")
    one = signed.where("n > 0 AND id IS NOT NULL").groupBy("f1", "f2", "n").agg(F.min(F.struct("id", "version", "signature")).alias("s"))
    # numbers of classes are unique, and fixed once the table is written
    classes = stored(one.select(F.monotonically_increasing_id().alias("node"), "f1", "f2", "n", F.col("s.id").alias("rep"), F.col("s.version").alias("rep_version"), F.col("s.signature").alias("signature")), "classes")
    groups = stored(components(_stars_of(classes.select("node", "signature").mapInArrow(_expand, "key long, id long"))).withColumnRenamed("component", "group"), "groups")

    def dealt(groups: DataFrame) -> DataFrame:
        sized = groups.join(classes.select("node", "n", "rep", "rep_version"), "node")
        parts = sized.groupBy("group").agg(F.ceil(F.sum("n") / task_shingles).cast("int").alias("parts"))
        return stored(sized.join(small_side(parts), "group").select("node", "group", "parts", F.pmod(F.xxhash64("node"), "parts").alias("part"), F.col("rep").alias("__id"), F.col("rep_version").alias("__version")), "dealt")

    def with_texts(rows: DataFrame) -> DataFrame:
        """A text for each class: rows may repeat, so one of equal ones stays."""
        return base.join(small_side(rows), ["__id", "__version"]).dropDuplicates(["node"])

    deal = dealt(groups)
    large = deal.where("parts > 1")
    if not large.isEmpty():
        smaller = _apart(with_texts(large), n, percent)
        deal = deal.where("parts = 1").union(dealt(smaller).select(*deal.columns))
    tasks = with_texts(deal).select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).select(
        F.xxhash64("group", "parts", F.least("part", "other"), F.greatest("part", "other")).alias("task"),
        F.col("node").alias("id"),
        "__text",
        F.when(F.col("part") == F.col("other"), 0).when(F.col("part") < F.col("other"), 1).otherwise(2).cast("long").alias("side"),
    )
    edges = tasks.repartition("task").sortWithinPartitions("task", "id").mapInArrow(_confirm(n, percent), "u long, v long")

    member = signed.select("id", "version", "n", "f1", "f2").join(classes.select("f1", "f2", "n", "node", "rep", "rep_version"), ["f1", "f2", "n"], "left").drop("f1", "f2")
    if not by_row:
        # classes that share an id are tied, and rows without shingles go with their id's others
        member = stored(member, "member")
        again = member.where("id IS NOT NULL").groupBy("id").agg(F.min(F.when(F.col("node").isNotNull(), F.struct("node", "rep"))).alias("lo"), F.max("node").alias("hi"), F.min("n").alias("least"))
        again = stored(again.where("lo IS NOT NULL AND (lo.node <> hi OR least = 0)").select("id", F.col("lo.node").alias("first"), F.col("lo.rep").alias("first_rep")), "again")
        edges = edges.union(member.join(small_side(again), "id").where("node IS NOT NULL AND node <> first").select(F.col("node").alias("u"), F.col("first").alias("v")))
        member = member.join(small_side(again), "id", "left").withColumn("node", F.coalesce("node", "first")).withColumn("rep", F.coalesce("rep", "first_rep"))
    linked = stored(components(edges), "linked")
    best = linked.join(classes.select("node", "rep", "rep_version"), "node").groupBy("component").agg(F.min(F.struct("rep", "rep_version")).alias("best"))
    out = member.join(linked.join(small_side(best), "component").select("node", "best"), "node", "left")
    rep = F.coalesce("best.rep", "rep", "id")
    component = F.when(F.col("id").isNotNull(), rep).alias("component_id")
    if not by_row:
        return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component, (F.col("id").isNull() | (rep == F.col("id"))).alias("kept"))
    kept = F.col("id").isNull() | F.col("node").isNull() | ((rep == F.col("id")) & (F.coalesce("best.rep_version", "rep_version") == F.col("version")))
    return out.select(F.col("id").alias(id_col), "version", F.col("n").alias("n_shingles"), component, kept.alias("kept"))


#: near_duplicates(n=3, percent=85) over documents; copies are joined as one set.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s FROM d, unnest(range(1, greatest(len(w) - 1, 2))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(1) ORDER BY s)) AS same FROM sh GROUP BY doc_id),
cls AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY same) AS rep FROM n),
own AS (SELECT sh.doc_id, s, n FROM sh JOIN cls ON cls.doc_id = sh.doc_id AND cls.rep = sh.doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM own AS a JOIN own AS b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
e AS (SELECT a, b FROM met WHERE 100 * c >= 85 * (na + nb - c) UNION SELECT b, a FROM met WHERE 100 * c >= 85 * (na + nb - c)),
r(node, seen) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
comp AS (SELECT node, min(seen) AS component FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, rep, d.doc_id) AS component_id, coalesce(component, rep, d.doc_id) = d.doc_id AS kept FROM d LEFT JOIN cls ON cls.doc_id = d.doc_id LEFT JOIN comp ON comp.node = cls.rep
"""
