"""The task layer, question sets, resumable scans and the writers beside them."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import packing as K
from millrace.operators import tasks as Q
from millrace.operators import tokenizing as Z
from millrace.sources import benchmarks as B
from millrace.sources import catalog, files
from millrace.streaming import resume


def test_templates(spark):
    row = spark.createDataFrame([(" Who? ", ["x", "y"], 1, None, {"n": 3})], "question string, choices array<string>, label int, none string, more map<string, int>")
    cases = {
        "Q: {{question|trim}}": "Q: Who?", "{{ question.strip() | upper }}!": "WHO?!", "{{choices[label]}}{{choices[0]}}{{choices[-1]}}": "yxy", "{{none}}|{{label}}": "|1", "plain {x}": "plain {x}", "": "",
        "{{question|regex_replace('o(.)', '\\1')}}": " Wh? ", "{{choices|join(', ')}}": "x, y", "{{more['n']}}": "3", "{{question|replace('W', \"w\")|trim}}": "who?",
    }
    for template, want in cases.items():
        assert row.select(Q.render(template).alias("t")).first()["t"] == want, template
    with pytest.raises(ValueError):
        Q.render("{{question ? 1}}")
    with pytest.raises(Exception, match="nothing"):
        row.select(Q.render("{{nothing}}")).collect()


def test_task_from_yaml(spark, tmp_path):
    (tmp_path / "base.yaml").write_text("output_type: multiple_choice\ndescription: 'Pick one. '\nnum_fewshot: 1\n")
    (tmp_path / "hooks.py").write_text("def ready(docs):\n    return docs.withColumn('gold', docs.answer - 1)\n")
    (tmp_path / "own.yaml").write_text("include: base.yaml\ntask: own\nprocess_docs: !function hooks.ready\ndoc_to_text: '{{q}}'\ndoc_to_target: '{{gold}}'\ndoc_to_choice: choices\nnum_fewshot: 2\nmetric_list:\n  - metric: acc\n")
    task = Q.load(tmp_path / "own.yaml")
    assert (task.task, task.output_type, task.num_fewshot, task.metric_list) == ("own", "multiple_choice", 2, [{"metric": "acc"}])
    docs = spark.createDataFrame([(k, f"q{k}", ["no", "yes"], 1 + k % 2) for k in range(5)], "id long, q string, choices array<string>, answer int")
    got = {(r["id"], r["idx"]): r for r in Q.requests(docs, task, "id", docs, "first_n").collect()}
    assert len(got) == 10 and got[4, 1]["context"] == "Pick one. q0 no\n\nq1 yes\n\nq4" and got[0, 0]["context"] == "Pick one. q1 yes\n\nq2 no\n\nq0"
    assert got[3, 1]["gold"] and not got[3, 0]["gold"] and got[3, 1]["continuation"] == " yes"
    for r in Q.contexts(docs, task, "id", docs).collect():
        assert r["context"].count("\n\n") == 2 and f"q{r['id']} " not in r["context"]
    assert Q.contexts(docs, task, "id", docs.limit(0)).count() == 5 and Q.requests(docs.limit(0), task, "id", docs).count() == 0
    hooked = Q.load(tmp_path / "own.yaml", {"hooks.ready": lambda d: d.withColumn("gold", F.lit(0))})
    assert {r["gold"] for r in hooked.documents(docs).collect()} == {0}


def test_models(spark):
    docs = spark.createDataFrame([(1, "a\nlast line. more", "x"), (2, "", "yy"), (3, None, None)], "id long, t string, y string")
    ask = lambda kind, **more: Q.answered(Q.requests(docs, Q.Task("t", "{{t}}", "{{y}}", output_type=kind, **more), "id"), "dummy", kind)
    assert {r["id"]: r["answer"] for r in ask("generate_until", until=[". ", "e"]).collect()} == {1: "last lin", 2: "", 3: ""}
    assert {r["id"]: r["score"] for r in ask("loglikelihood").collect()} == {1: -2.0, 2: -3.0, 3: -1.0}
    assert {r["id"]: r["score"] for r in ask("loglikelihood_rolling").collect()} == {1: -1.0, 2: -2.0, 3: 0.0}
    with pytest.raises(NotImplementedError):
        Q.LanguageModel().loglikelihood([])


def test_sentence_pairs(spark):
    lines = lambda *rows: spark.createDataFrame([(r,) for r in rows], "value string")
    head = "index\t1\t2\t3\t4\t5\t6\t7\tsentence1\tsentence2\tlabel1\tgold_label"
    body = lambda i, a, b, y: f"{i}\t.\t.\t.\t.\t.\t.\t.\t{a}\t{b}\tz\t{y}"
    got = B.mnli(lines(head, body(0, "A  b .", " c ", "neutral"), body(1, "x", "y", "-"), body("n", "x", "y", "neutral"), "short\tline", body(100, "p", "q", "entailment ")), head).collect()
    assert sorted(map(tuple, got)) == [(0, "A b .", "c", 2), (100, "p", "q", 1)]
    test = "\t".join(head.split("\t")[:10])
    assert [tuple(r) for r in B.mnli(lines(test, "5\t.\t.\t.\t.\t.\t.\t.\tp\tq"), test).collect()] == [(5, "p", "q", 0)]
    head = "id\tqid1\tqid2\tquestion1\tquestion2\tis_duplicate"
    rows = lines(head, "1\ta\tb\tOne?\tTwo?\t1", "2\ta\tb\t\tTwo?\t1", "3\ta\tb\tOne?", "10\ta\tb\tx\ty\t0", "11\ta\tb\tx\ty\t7")
    assert sorted(map(tuple, B.qqp(rows, head).collect())) == [(1, "One?", "Two?", 1), (10, "x", "y", 0)]
    test = "id\tquestion1\tquestion2"
    assert [tuple(r) for r in B.qqp(lines(test, "4\tx\ty"), test, 1).collect()] == [(4, "x", "y", 1)]


def test_question_sets(spark, tmp_path):
    rows = [("who is it\t['A b', \"it's\"]",), ('"so ""quoted"""\t"[""x"", \'y\']"',), ("no answers",), ("none\t[]",), ("__import__('os')\t__import__('os')",)]
    got = {r["question"]: r["answers"] for r in B.open_questions(spark.createDataFrame(rows, "value string")).collect()}
    assert got["who is it"] == ["A b", "it's"] and got['so "quoted"'] == ["x", "y"] and got["none"] == [] and "no answers" not in got
    record = {"question": "what?", "answers": ["z"], "positive_ctxs": [{"title": "t", "text": "p"}, {"title": "u", "text": "q"}], "negative_ctxs": [], "hard_negative_ctxs": [{"title": "h", "text": "n"}]}
    (tmp_path / "a.json").write_text(json.dumps([record, record | {"positive_ctxs": []}, {k: v for k, v in record.items() if k != "negative_ctxs"}]))
    got = B.retrieval_set(spark, str(tmp_path / "a.json")).collect()
    assert len(got) == 2 and all(r["question"] == "what" and r["pos_context"]["text"] == "p" and r["negative_context"] == [] and len(r["hard_negative_context"]) == 1 for r in got)


def test_scan_goes_on_where_it_stopped(spark, tmp_path):
    source, to, mark = tmp_path / "in", f"file://{tmp_path}/out", f"file://{tmp_path}/mark"
    source.mkdir()
    for k in range(3):
        (source / f"{k}.txt").write_text(f"a{k}\nb{k}\n")

    def failing(df):
        return df.withColumn("value", F.when(F.col("value") == "b2", F.raise_error(F.lit("stopped"))).otherwise(F.col("value")))

    with pytest.raises(Exception, match="stopped"):
        resume.continue_scan(spark, f"file://{source}", to, mark, failing, files=1)
    resume.continue_scan(spark, f"file://{source}", to, mark, files=1)
    (source / "3.txt").write_text("a3\n")
    resume.continue_scan(spark, f"file://{source}", to, mark)
    assert sorted(r["value"] for r in spark.read.parquet(to).collect()) == sorted([f"{c}{k}" for k in range(3) for c in "ab"] + ["a3"])


def test_progress(spark):
    df, seen = resume.observed(spark.createDataFrame([("é",), ("abc",), (None,)], "t string"), "t")
    df.collect()
    assert seen.get == {"rows": 3, "bytes": 5}
    assert resume.throughput(seen.get, 2.0) == {"docs_per_second": 1.5, "mb_per_second": 2.5e-6}


def test_writers(spark, tmp_path):
    df = spark.range(25).select("id", F.concat(F.lit("é "), "id").alias("t")).repartition(3)
    done = files.write_json_arrays(df, f"file://{tmp_path}/arrays").collect()
    rows = [r for d in done for r in json.loads((tmp_path / "arrays" / d["name"]).read_text())]
    assert sorted(r["id"] for r in rows) == list(range(25)) and sum(d["n"] for d in done) == 25
    files.write_blocks(df, "id", 10, f"file://{tmp_path}/blocks")
    back = spark.read.parquet(f"file://{tmp_path}/blocks")
    assert {(r["block"], r["n"]) for r in back.groupBy("block").agg(F.count("*").alias("n")).collect()} == {(0, 10), (10, 10), (20, 5)}


def test_small_things(spark):
    assert catalog.not_added(["b", "a", "b", "c"], ["a"]) == ["b", "c"]
    assert len(catalog.description_key({"a": 1, "b": [2]})) == 32
    assert catalog.description_key({"a": 1}) != catalog.description_key({"a": 2})
    d = spark.createDataFrame([(" a\n bé c",), ("",), (None,)], "t string")
    assert [[tuple(x) for x in r["s"]] for r in d.select(T.split_indices("t").alias("s")).collect()] == [[("a", 1), ("bé", 4), ("c", 7)], [], []]
    b = spark.range(40).select((F.col("id") % 10).alias("block"))
    got = [r["block"] for r in K.sample_blocks(b, "block", 0.25, 3).collect()]
    assert len(got) == len(set(got)) == 3 and got == [r["block"] for r in K.sample_blocks(b.repartition(7), "block", 0.25, 3).collect()]


def test_tokenizers_by_name(spark):
    public = pytest.importorskip("public_tokenizers")
    d = spark.createDataFrame([("héllo wörld 日本",), ("",), (None,)], "t string")
    for kind, name in (("bytes", None), ("json", "byte_bpe_50k.json"), ("pieces", "piece_bpe_32k.model")):
        options = {"raw": open(public.path(name), "rb").read()} if name else {}
        own = Z.TOKENIZERS[kind](**options)
        rows = d.select("t", Z.encoded(F.col("t"), kind, **options).alias("ids"), Z.encoded(F.col("t"), kind, end=False, **options).alias("bare")).select("*", Z.decoded(F.col("bare"), kind, **options).alias("back")).collect()
        for r in rows:
            assert r["ids"] == [*own.tokenize(r["t"] or ""), own.eod] and r["bare"] == r["ids"][:-1] and r["back"] == (r["t"] or "") and max(r["ids"]) < own.vocab_size
    with pytest.raises(NotImplementedError):
        type("Own", (Z.Tokenizer,), {"vocab_size": 1, "tokenize": lambda s, t: []})().detokenize([])
