"""Answers with citations (C14, J14, X15–X18). The model is injected; the offline default shows the best passage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.config import NO_MODEL, NO_PASSAGES
from docloom.functions.text import base_name, split_citations, trim

#: (question, context) -> the model's reply. Called inside a pandas UDF, so it must be picklable.
AnswerModel = Callable[[str, str], str]


def contexts(hits: DataFrame) -> DataFrame:
    """(query_id, context, n_passages): numbered passages joined by blank lines. hits: query_id, pos, source, text."""
    shown = F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("] "), base_name(F.coalesce("source", F.lit("unknown"))), F.lit("\n"), trim(F.coalesce("text", F.lit(""))))
    grouped = hits.select("query_id", "pos", shown.alias("_p")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "_p"))).alias("_l"))
    return grouped.select("query_id", F.array_join(F.transform("_l", lambda x: x["_p"]), "\n\n").alias("context"), F.size("_l").cast("long").alias("n_passages"))


def fallback_answer(context: Column) -> Column:
    return F.concat(F.lit(NO_MODEL), F.substring_index(context, "\n\n", 1))


def used(pos: Column, numbers: Column, n_passages: Column) -> Column:
    """Whether a passage counts as used: cited, or no citation is in range."""
    valid = F.filter(numbers, lambda n: (n >= 1) & (n <= n_passages))
    return (F.size(valid) == 0) | F.array_contains(valid, pos.cast("int"))


def answers(questions: DataFrame, hits: DataFrame, model: AnswerModel | None = None) -> DataFrame:
    """(query_id, question, context, n_passages, answer, cited) for every question, also those without hits."""
    asked = questions.join(contexts(hits), "query_id", "left")
    if model is None:
        answer, cited = fallback_answer(F.col("context")), F.array().cast("array<int>")
    else:

        @F.pandas_udf("string")
        def reply(question, context):
            return context.combine(question, lambda c, q: model(q, c) if c is not None else None)

        asked = asked.withColumn("_reply", reply("question", "context"))
        answer, cited = split_citations(F.coalesce("_reply", F.lit("")))
    none = F.col("context").isNull()
    return asked.select(
        "query_id", "question", "context", F.coalesce("n_passages", F.lit(0)).cast("long").alias("n_passages"), F.when(none, F.lit(NO_PASSAGES)).otherwise(answer).alias("answer"), F.when(none, F.array().cast("array<int>")).otherwise(cited).alias("cited")
    )


def results_with_use(answered: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits with ``used``, as they are kept in the chat history."""
    return hits.join(answered.select("query_id", "cited", "n_passages"), "query_id").withColumn("used", used(F.col("pos"), F.col("cited"), F.col("n_passages"))).drop("cited", "n_passages")
