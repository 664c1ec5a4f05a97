"""Evaluation tasks: templates as columns, configurations from YAML, few-shot contexts, requests and models.

A template such as ``Q: {{question|trim}} ({{choices[label]}})`` becomes one string column, so prompts are
made where the rows are. Hooks are functions of DataFrames or columns. A model is a class with three
methods on lists; it is made once a task and sees its requests batch by batch.
"""

from __future__ import annotations

import importlib.util
import re
from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.batches import rows_by_pieces
_PART = re.compile(r"\{\{(.*?)\}\}", re.S)
_NAME = re.compile(r"\s*([A-Za-z_]\w*)")
_STEP = re.compile(r"\s*(?:\.\s*(\w+)\s*(\(\s*\))?|\[\s*(?:(-?\d+)|'([^']*)'|\"([^\"]*)\"|([A-Za-z_]\w*))\s*\]|\|\s*(\w+)\s*(?:\(((?:'[^']*'|\"[^\"]*\"|[^()'\"])*)\))?)")
_STRING = re.compile(r"\s*(?:(\w+)\s*=\s*)?(?:'([^']*)'|\"([^\"]*)\"|(-?\d+))\s*(?:,|$)")

#: What a template may apply to a value, by name; ``register`` of operators.evaluation adds to it.
TEMPLATE_FILTERS: dict[str, Callable[..., Column]] = {
    "trim": F.trim, "strip": F.trim, "lower": F.lower, "upper": F.upper, "length": F.length, "string": lambda c: c.cast("string"), "int": lambda c: c.cast("bigint"),
    "capitalize": lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2)))),
    "replace": lambda c, old, new: F.replace(c, F.lit(old), F.lit(new)), "regex_replace": lambda c, pattern, repl: F.regexp_replace(c, pattern, re.sub(r"\\(\d)", r"$\1", repl)),
    "join": lambda c, by="": F.array_join(c, by), "first": lambda c: F.get(c, F.lit(0)), "last": lambda c: F.element_at(c, -1),
}


def _arguments(text: str | None) -> list:
    out, at = [], 0
    while text and at < len(text.rstrip()):
        m = _STRING.match(text, at)
        if not m:
            raise ValueError(f"an argument isn't known: {text}")
        out.append(int(m[4]) if m[4] is not None else m[2] if m[2] is not None else m[3])
        at = m.end()
    return out


def value(expression: str) -> Column:
    """A name with fields, places, methods and filters, as a column."""
    m = _NAME.match(expression)
    if not m:
        raise ValueError(f"no name begins {expression!r}")
    c, at = F.col(f"`{m[1]}`"), m.end()
    while expression[at:].strip():
        m = _STEP.match(expression, at)
        if not m:
            raise ValueError(f"not understood: {expression[at:]!r}")
        name, call, number, one, two, other, filtered, args = m.groups()
        if filtered or call:
            c = TEMPLATE_FILTERS[filtered or name](c, *_arguments(args))
        elif number is not None:
            c = F.element_at(c, int(number) + (int(number) >= 0))
        elif other:
            c = F.get(c, F.col(f"`{other}`").cast("int"))
        else:
            c = c.getField(name or one or two)
        at = m.end()
    return c


def render(template: str) -> Column:
    """The template as a string column; a null value is an empty text, a name that no column has an error."""
    parts, at = [], 0
    for m in _PART.finditer(template):
        parts += [F.lit(template[at : m.start()]), F.coalesce(value(m[1].strip()).cast("string"), F.lit(""))]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


@dataclass
class Task:
    """What a task asks and how it is scored. Hooks may stand in place of templates: functions that give a column."""

    task: str
    doc_to_text: str | Callable[[], Column] = ""
    doc_to_target: str | Callable[[], Column] = ""
    doc_to_choice: str | list[str] | Callable[[], Column] | None = None
    process_docs: Callable[[DataFrame], DataFrame] | None = None
    output_type: str = "generate_until"
    description: str = ""
    target_delimiter: str = " "
    fewshot_delimiter: str = "\n\n"
    num_fewshot: int = 0
    until: list[str] = field(default_factory=lambda: ["\n\n"])
    metric_list: list[dict] = field(default_factory=list)
    metadata: dict = field(default_factory=dict)

    def text(self) -> Column:
        return render(self.doc_to_text) if isinstance(self.doc_to_text, str) else self.doc_to_text()

    def choices(self) -> Column:
        c = self.doc_to_choice
        if isinstance(c, list):
            return F.array(*map(F.lit, c))
        return value(c.strip().removeprefix("{{").removesuffix("}}")) if isinstance(c, str) else c()

    def target(self) -> Column:
        """The text of the answer; where there are choices a number stands for one of them."""
        t = render(self.doc_to_target) if isinstance(self.doc_to_target, str) else self.doc_to_target()
        if self.doc_to_choice is None:
            return t
        return F.coalesce(F.get(self.choices(), t.try_cast("int")), t)

    def documents(self, docs: DataFrame) -> DataFrame:
        return self.process_docs(docs) if self.process_docs else docs


def load(config: str | Path | dict, hooks: dict[str, Callable] | None = None) -> Task:
    """A task from YAML (or a dict): ``include`` is read first, ``!function module.name`` is a hook, or comes from the file beside it."""
    import yaml

    def read(path: Path) -> dict:
        class Loader(yaml.SafeLoader):
            pass

        def function(loader, node):
            name = loader.construct_scalar(node)
            if hooks and name in hooks:
                return hooks[name]
            module, _, attribute = name.rpartition(".")
            spec = importlib.util.spec_from_file_location(module, path.parent / f"{module.replace('.', '/')}.py")
            made = importlib.util.module_from_spec(spec)
            spec.loader.exec_module(made)
            return getattr(made, attribute)

        Loader.add_constructor("!function", function)
        with open(path, encoding="utf-8") as f:
            return whole(yaml.load(f, Loader), path.parent)  # noqa: S506 (a safe loader with one more tag)

    def whole(own: dict, folder: Path) -> dict:
        out: dict = {}
        more = own.pop("include", [])
        for name in reversed([more] if isinstance(more, str) else more):
            out |= read(folder / name)
        return out | own

    got = whole(dict(config), Path()) if isinstance(config, dict) else read(Path(config))
    known = {f.name for f in fields(Task)}
    return replace(Task(got["task"]), **{k: v for k, v in got.items() if k in known})


#: How the examples of a document are chosen: functions of (pool size, number, key of the document) that give their places in the pool.
SAMPLERS: dict[str, Callable[[int, int, Column], Column]] = {
    "first_n": lambda size, n, key: F.array(*(F.lit(k) for k in range(min(n, size)))),
    "default": lambda size, n, key: F.transform(F.sequence(F.lit(0), F.lit(min(n, size) - 1)), lambda k: F.pmod(F.crc32(key.cast("string").cast("binary")) + k, F.lit(size)).cast("int")),
}


def contexts(docs: DataFrame, task: Task, key: str, pool: DataFrame | None = None, sampler: str = "default", most: int = 256) -> DataFrame:
    """The documents with ``context``: the description, examples and the own text.

    Examples come from the first ``most`` rows of ``pool`` by key; a document isn't an example of its own.
    """
    docs, own = task.documents(docs), task.text()
    if not task.num_fewshot or pool is None:
        return docs.withColumn("context", F.concat(F.lit(task.description), own))
    shown = task.documents(pool).select(F.col(key).alias("k"), F.concat(task.text(), F.lit(task.target_delimiter), task.target()).alias("t")).orderBy("k").limit(most).collect()
    if not shown:
        return docs.withColumn("context", F.concat(F.lit(task.description), own))
    table = F.array(*(F.struct(F.lit(r["k"]).alias("k"), F.lit(r["t"]).alias("t")) for r in shown))
    # one example more than are asked for, in case that one is the document itself
    places = SAMPLERS[sampler](len(shown), task.num_fewshot + 1, F.col(key))
    picked = F.filter(F.transform(places, lambda p: F.get(table, p)), lambda x: ~x["k"].eqNullSafe(F.col(key)))
    some = F.transform(F.slice(picked, 1, task.num_fewshot), lambda x: F.concat(x["t"], F.lit(task.fewshot_delimiter)))
    return docs.withColumn("context", F.concat(F.lit(task.description), F.array_join(some, ""), own))


def requests(docs: DataFrame, task: Task, key: str, pool: DataFrame | None = None, sampler: str = "default") -> DataFrame:
    """What a model is asked: key, idx (number of the choice), context, continuation (or the stop texts), target."""
    c = contexts(docs, task, key, pool, sampler)
    if task.output_type == "multiple_choice":
        c = c.select(F.col(key), "context", task.target().alias("target"), F.posexplode(task.choices()).alias("idx", "choice"))
        return c.select(key, "idx", "context", F.concat(F.lit(task.target_delimiter), "choice").alias("continuation"), F.col("target").eqNullSafe(F.col("choice")).alias("gold"))
    target = task.target()
    if task.output_type == "loglikelihood":
        return c.select(key, F.lit(0).alias("idx"), "context", F.concat(F.lit(task.target_delimiter), target).alias("continuation"), F.lit(True).alias("gold"))
    if task.output_type == "loglikelihood_rolling":
        return c.select(key, F.lit(0).alias("idx"), F.lit("").alias("context"), target.alias("continuation"), F.lit(True).alias("gold"))
    return c.select(key, F.lit(0).alias("idx"), "context", F.to_json(F.array(*map(F.lit, task.until))).alias("continuation"), target.alias("target"))


class LanguageModel:
    """What a model has to answer; lists in, lists out."""

    def loglikelihood(self, pairs: list[tuple[str, str]]) -> list[tuple[float, bool]]:
        """Of each (context, continuation): its log-likelihood, and whether it is the likeliest continuation."""
        raise NotImplementedError

    def loglikelihood_rolling(self, texts: list[str]) -> list[float]:
        """The log-likelihood of whole texts, cut into windows where they are longer than the model's."""
        raise NotImplementedError

    def generate_until(self, requests: list[tuple[str, list[str]]]) -> list[str]:
        """A text after each context, up to the first of its stop texts."""
        raise NotImplementedError


class DummyModel(LanguageModel):
    """For trials: longer continuations are less likely, and the answer is the context's last line."""

    def loglikelihood(self, pairs):
        return [(-float(len(c)), not c.strip()) for _, c in pairs]

    def loglikelihood_rolling(self, texts):
        return [-float(len(t)) for t in texts]

    def generate_until(self, requests):
        out = []
        for context, until in requests:
            t = context.rsplit("\n", 1)[-1]
            out.append(t[: min([len(t), *(p for s in until if s and (p := t.find(s)) >= 0)])])
        return out


MODELS: dict[str, type[LanguageModel]] = {"dummy": DummyModel}


def answered(asked: DataFrame, model: str | Callable[[], LanguageModel], kind: str) -> DataFrame:
    """The requests with the model's answers: score and greedy, score, or answer, by the kind of request."""
    make = MODELS[model] if isinstance(model, str) else model
    more = {"loglikelihood": "score double, greedy boolean", "multiple_choice": "score double, greedy boolean", "loglikelihood_rolling": "score double", "generate_until": "answer string"}[kind]

    made: list[LanguageModel] = []

    def run(b: pa.RecordBatch) -> dict:
        import json

        if not made:
            made.append(make())
        m = made[0]
        context, continuation = ([x or "" for x in b.column(c).to_pylist()] for c in ("context", "continuation"))
        own = dict(zip(b.schema.names, b.columns, strict=True))
        if kind == "generate_until":
            return own | {"answer": m.generate_until([(c, json.loads(u)) for c, u in zip(context, continuation, strict=True)])}
        if kind == "loglikelihood_rolling":
            return own | {"score": m.loglikelihood_rolling(continuation)}
        got = m.loglikelihood(list(zip(context, continuation, strict=True)))
        return own | {"score": [g[0] for g in got], "greedy": [g[1] for g in got]}

    return rows_by_pieces(asked, run, ", ".join([*(f"`{c}` {t}" for c, t in asked.dtypes), more]))


def scored(answers: DataFrame, key: str) -> DataFrame:
    """acc and acc_norm (scores over the continuation's length) of each document of a multiple-choice task; of equal scores the first counts."""
    best = lambda s: F.max_by("gold", F.struct(s, -F.col("idx")))
    return answers.groupBy(key).agg(best(F.col("score")).cast("int").alias("acc"), best(F.col("score") / F.length("continuation")).cast("int").alias("acc_norm"))
