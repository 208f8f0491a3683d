"""Evaluation prompts, scoring by a pluggable model, score tables, profiles and merging of ranks."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHOICES = ("A", "B", "C", "D")


@dataclass(frozen=True)
class EvalTemplate:
    """``{subject}``, ``{choice}`` and ``{content}`` are filled in."""

    system: str
    choice: str
    answer: str


# The prompts of multiple-choice evaluations.
EVAL_TEMPLATES = {
    "en": EvalTemplate("The following are multiple choice questions (with answers) about {subject}.\n\n", "\n{choice}. {content}", "\nAnswer:"),
    "zh": EvalTemplate("以下是中国关于{subject}考试的单项选择题，请选出其中的正确答案。\n\n", "\n{choice}. {content}", "\n答案："),
}


def register_eval_template(name: str, template: EvalTemplate) -> None:
    if name in EVAL_TEMPLATES:
        raise ValueError(f"evaluation template {name} exists already")
    EVAL_TEMPLATES[name] = template


def eval_template(name: str) -> EvalTemplate:
    if name not in EVAL_TEMPLATES:
        raise ValueError(f"evaluation template {name} does not exist")
    return EVAL_TEMPLATES[name]


def choice_prompt(template: EvalTemplate, question: Column, choices: dict[str, Column]) -> Column:
    """A question with those of its choices A to D that are not null, and the call for an answer."""

    def line(name: str, text: Column) -> Column:
        before, _, after = template.choice.replace("{choice}", name).partition("{content}")
        return F.when(text.isNotNull(), F.concat(F.lit(before), text, F.lit(after))).otherwise("")

    return F.concat(F.coalesce(question, F.lit("")), *[line(n, choices[n]) for n in CHOICES if n in choices], F.lit(template.answer))


def eval_messages(template: EvalTemplate, subject: Column, shots: Column, prompt: Column, answer: Column) -> Column:
    """Turns of the examples ``shots`` (array of prompt, answer), then of the target; the first one begins with the system text."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    pair = lambda p, a: F.array(turn("user", p), turn("assistant", a))
    turns = F.concat(F.flatten(F.transform(shots, lambda s: pair(s["prompt"], s["answer"]))), pair(prompt, answer))
    before, _, after = template.system.partition("{subject}")
    lead = F.concat(F.lit(before), subject, F.lit(after)) if "{subject}" in template.system else F.lit(template.system)
    return F.transform(turns, lambda t, i: F.when(i == 0, turn("user", F.concat(lead, t["content"]))).otherwise(t))


def score_lines(rows: DataFrame, category: str, correct: str) -> DataFrame:
    """category and line, "name: percent" right-aligned to 15, of every category with rows, and of all as Average."""
    rolled = rows.rollup(F.col(category).alias("category")).agg(F.avg(F.col(correct).cast("double")).alias("_m"), F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("_n"))
    name = F.when(F.col("_g") > 0, "Average").otherwise(F.col("category"))
    return rolled.where("_n > 0").select(name.alias("category"), F.format_string("%15s: %.2f", name, 100 * F.col("_m")).alias("line"))


def write_results(answers: DataFrame, lines: DataFrame, folder: str) -> None:
    """Answers (subject, row, output) as JSON lines by subject and the score table as text."""
    answers.write.mode("errorifexists").partitionBy("subject").json(f"{folder}/results")
    lines.select("line").write.mode("errorifexists").text(f"{folder}/scores")


def profile(timings: DataFrame, step: str, seconds: str) -> DataFrame:
    """step, time_ms and runs: mean time of each step over the runs that have it; 0 for a step that no run has."""
    return timings.groupBy(step).agg(F.coalesce(F.avg(seconds), F.lit(0.0)).alias("_s"), F.count(seconds).alias("runs")).select(step, (F.col("_s") * 1000).alias("time_ms"), "runs")


def merge_ranks(spark: SparkSession, folder: str, world: int, schema: str) -> tuple[DataFrame, list[int]]:
    """The rows of all rank files predictions_rank<k>.json in ``folder``, JSON arrays or lines, and the ranks without one."""
    paths = {k: Path(folder) / f"predictions_rank{k}.json" for k in range(world)}
    there = [str(p) for p in paths.values() if p.exists()]
    rows = spark.read.schema(schema).option("multiLine", True).json(there) if there else spark.createDataFrame([], schema)
    return rows, [k for k, p in paths.items() if not p.exists()]


def score(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.Series]], out: str, kind: str, timed: str | None = None) -> DataFrame:
    """Adds ``out``, what a model gives for each batch of rows, and the seconds a row took as ``timed``.

    ``load`` is called once in every worker task and returns the model, a
    function from a batch of rows to a series; works on streams as on tables.
    """
    names = [f"{f.name} {f.dataType.simpleString()}" for f in df.schema]
    schema = ", ".join([*(f"`{n.split(' ', 1)[0]}` {n.split(' ', 1)[1]}" for n in names), f"`{out}` {kind}", *([f"`{timed}` double"] if timed else [])])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            began = time.perf_counter()
            batch = batch.assign(**{out: model(batch)})
            yield batch.assign(**{timed: (time.perf_counter() - began) / max(1, len(batch))}) if timed else batch

    return df.mapInPandas(run, schema)


def batched(df: DataFrame, f: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """A function from columns as lists to columns as lists, batch by batch; the number of rows may change."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(f({c: batch[c].tolist() for c in batch.columns}))

    return df.mapInPandas(run, schema)


def chain(df: DataFrame, steps: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Steps from table to table, one after the other."""
    for step in steps:
        df = df.transform(step)
    return df


class Accumulator:
    """Means of named scores over batches of rows: ``update`` adds a batch, ``dump`` gives the means and starts anew.

    A batch is aggregated where it is; only its sums and counts come to the driver.
    """

    def __init__(self, names: list[str]) -> None:
        self.names = names
        self.sums = dict.fromkeys(names, (0.0, 0))

    def update(self, batch: DataFrame) -> None:
        row = batch.agg(*[F.struct(F.coalesce(F.sum(F.col(n).cast("double")), F.lit(0.0)), F.count(n)).alias(n) for n in self.names]).first()
        self.sums = {n: (self.sums[n][0] + row[n][0], self.sums[n][1] + row[n][1]) for n in self.names}

    def dump(self) -> dict[str, float | None]:
        out = {n: s / k if k else None for n, (s, k) in self.sums.items()}
        self.sums = dict.fromkeys(self.names, (0.0, 0))
        return out


class Callbacks:
    """Functions by event, called in the order in which they were added."""

    def __init__(self) -> None:
        self.by_event: dict[str, list[Callable]] = {}

    def add(self, event: str, f: Callable) -> None:
        self.by_event.setdefault(event, []).append(f)

    def run(self, event: str, *args: object) -> None:
        for f in self.by_event.get(event, ()):
            f(*args)


def inference_stream(stream: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.Series]], out: str, kind: str, write: Callable[[DataFrame, int], None], checkpoint: str, callbacks: Callbacks | None = None):
    """A running query that scores a stream, writes every trigger's rows and calls "batch_start" and "batch_end" around it."""
    hooks = callbacks or Callbacks()

    def each(batch: DataFrame, number: int) -> None:
        hooks.run("batch_start", number)
        write(batch, number)
        hooks.run("batch_end", number)

    return score(stream, load, out, kind, "seconds").writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
