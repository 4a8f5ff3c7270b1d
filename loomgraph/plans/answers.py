"""A batch of questions from retrieval to checked answers, in one plan: matches, facts, prompts, a model's answers, what is
wrong with them, and a second try for those with errors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_answer
from ..operators import context
from ..operators.graph import qualified_names
from ..operators.retrieve import retrieve
from ..settings import Settings
from ..sources.files import mapped
from .build import Graph, stored
from .smoke import corrected, run


def answered(questions: DataFrame, graph: Graph, call: Callable[[list[str]], list[str]], *, snippets: DataFrame | None = None, settings: Settings | None = None, keep: Callable[[DataFrame, str], DataFrame] | None = None, **how) -> DataFrame:
    """(question_id, target, question, strategy, confidence, answered, answer, retried, issues, worst) of questions (question_id,
    target, question, must_refuse). ``call`` answers a list of prompts; its answers are stored, so a task that is tried again
    later doesn't ask twice. An answer with an error is asked for once more; ``issues`` and ``worst`` are what is
    still to be said of the last one (null: nothing). More arguments go to ``retrieve``."""
    keep = keep or (lambda frame, name: stored(frame.sparkSession, frame, name))
    settings = settings or Settings()
    asked = questions.select("target", "question_id", "question")
    qualified = keep(qualified_names(graph.nodes), "qualified")
    matches, outcome = retrieve(asked, graph.nodes, snippets=snippets, limit=settings.max_nodes, semantic=settings.semantic, keep=keep, **how)
    outcome = keep(outcome, "outcome")
    blocks = keep(context.context_blocks(matches, graph.nodes, graph.edges, qualified, snippets), "blocks")
    prompts = keep(context.prompts(asked, outcome, blocks), "prompts")
    first = keep(mapped(prompts, "prompt", "raw", call, retries=settings.retries), "answers").withColumn("answer", normalize_answer(F.col("raw"))).drop("raw")
    found = keep(context.verify(first, blocks, graph.nodes, qualified), "findings")
    last = keep(corrected(prompts, first, found, call, settings.retries).withColumn("answer", F.when(F.col("retried"), normalize_answer(F.col("answer"))).otherwise(F.col("answer"))), "corrected")
    again = context.verify(last.filter("retried"), blocks, graph.nodes, qualified)
    still = found.join(last.filter("retried").select("question_id"), "question_id", "left_anti").unionByName(again)
    said = still.groupBy("question_id").agg(context.summarize().alias("issues"), context.worst_severity().alias("worst"))
    cases = run(questions, outcome).select("question_id", "target", "question", "strategy", "confidence", "answered")
    return cases.join(last.select("question_id", "answer", "retried"), "question_id", "left").join(said, "question_id", "left")
