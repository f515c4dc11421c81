"""Places for a model that a caller brings, each with a declared result without one.

A model is a function of two lists of texts that returns a list of numbers; it
runs on Arrow batches. Without one the declared fallback is a column expression.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Model = Callable[[list[str], list[str]], list[float]]


def scored(a: Column, b: Column, model: Model) -> Column:
    """The model's number for each pair of texts; null counts as empty."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(model(x.fillna("").tolist(), y.fillna("").tolist()), dtype="float64")

    return run(a, b)


def reranked(hits: DataFrame, model: Model | None = None, question: str = "question", content: str = "content", k: int = 5) -> DataFrame:
    """The k best of rows (query, doc, rank) by the model's score of question and
    content; without a model the order stays and the score falls by a tenth a place from 1."""
    score = scored(F.col(question), F.col(content), model) if model else 1 - 0.1 * (F.col("rank") - 1)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("relevance"), "rank"))
    return hits.withColumn("relevance", score).withColumn("place", place).where(F.col("place") <= k).select("query", "doc", "rank", "place", "relevance")


def relevant(question: Column, content: Column, model: Model | None = None, least: float = 0.5) -> Column:
    """Whether a document is kept for a question; without a model every one is."""
    return F.coalesce(scored(question, content, model) >= least, F.lit(False)) if model else F.lit(True)


def similarity(a: Column, b: Column, words: Callable[[Column], Column], model: Model | None = None) -> Column:
    """Likeness of two texts, 0 to 1; without a model the Jaccard index of their words (0 if both lack words)."""
    if model:
        return scored(a, b, model)
    x, y = F.array_distinct(words(a)), F.array_distinct(words(b))
    either = F.size(F.array_union(x, y))
    return F.when(either > 0, F.size(F.array_intersect(x, y)) / either).otherwise(0.0)
