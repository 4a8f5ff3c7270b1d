"""Question specs run as one batch, and their totals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.context import corrections
from ..operators.retrieve import retrieve
from ..sources.files import mapped


def problems(results: DataFrame) -> DataFrame:
    """Results (target, question, must_refuse, answered) that aren't as the spec says."""
    problem = F.when(F.col("must_refuse") & F.col("answered"), "answered a question that must be refused").when(~F.col("must_refuse") & ~F.col("answered"), "refused a question that has an answer")
    return results.withColumn("problem", problem).filter("problem IS NOT NULL")


def rollup(results: DataFrame) -> DataFrame:
    """checked, and clean: those without a problem, each failing (target, question) counted once."""
    wrong = F.col("must_refuse") == F.col("answered")
    failing = F.count_distinct(F.when(wrong, F.struct("target", "question")))
    return results.agg(F.count(F.lit(1)).alias("checked"), (F.count(F.lit(1)) - failing).alias("clean"))


def run(questions: DataFrame, retrievals: DataFrame) -> DataFrame:
    """Each question (question_id, target, question, must_refuse) with whether retrieval answered it."""
    answered = ~F.col("strategy").isin("qualified-miss", "named-symbol-miss", "none")
    return questions.join(retrievals.select("question_id", "strategy", "confidence"), "question_id", "left").withColumn("answered", F.coalesce(answered, F.lit(False)))


def missing_targets(asked: DataFrame, built: DataFrame) -> DataFrame:
    """Targets that questions name and no graph has."""
    return asked.select("target").distinct().join(built.select("target"), "target", "left_anti")


def checked(questions: DataFrame, nodes: DataFrame, meta: DataFrame, stale: DataFrame | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Cases (question_id, target, question, must_refuse, strategy, confidence, answered) of the questions whose target
    has a graph, and faults (target, fault): no graph, a stale one (by ``graph.staleness``), or files that couldn't be
    parsed."""
    asked = questions.join(meta.select("target"), "target", "left_semi")
    _, outcome = retrieve(asked.select("target", "question_id", "question"), nodes, limit=limit)
    faults = missing_targets(questions, meta).select("target", F.lit("no graph").alias("fault"))
    broken = meta.filter(F.size("parse_failures") > 0).select("target", F.lit("files that couldn't be parsed").alias("fault"))
    faults = faults.unionByName(broken)
    if stale is not None:
        faults = faults.unionByName(stale.select("target").distinct().withColumn("fault", F.lit("stale graph")))
    return run(asked, outcome), faults.join(questions.select("target").distinct(), "target", "left_semi")


def corrected(prompts: DataFrame, answers: DataFrame, found: DataFrame, call: Callable[[list[str]], list[str]], retries: int = 0) -> DataFrame:
    """(question_id, target, answer, retried): answers whose findings hold an error are asked for once more, with what is
    wrong; ``call`` answers a list of texts. The second answer stands as it is."""
    again = mapped(corrections(prompts.select("question_id", "prompt"), answers.select("question_id", "answer"), found).select("question_id", "correction"), "correction", "second", call, retries=retries)
    joined = answers.join(again.select("question_id", "second"), "question_id", "left")
    return joined.select("question_id", "target", F.coalesce("second", "answer").alias("answer"), F.col("second").isNotNull().alias("retried"))
