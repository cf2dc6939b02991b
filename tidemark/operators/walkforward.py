"""Walk-forward evaluation: each fold is scored by a model fitted on what came before it."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Fold:
    test: int
    validation: int
    training: tuple[int, ...]


def plan(seasons: Iterable[int], tests: Iterable[int]) -> list[Fold]:
    """A fold for each test season: the season before validates, all earlier ones train. A test season without both is an error."""
    have, out = sorted(set(seasons)), []
    for test in sorted(set(tests)):
        past = [s for s in have if s < test]
        if test not in have or len(past) < 2:
            raise ValueError(f"season {test} can't be tested: {len(past)} before it")
        out.append(Fold(test, past[-1], tuple(past[:-1])))
    return out


def before(df: DataFrame, season: str, test: int, what: str = "training rows") -> DataFrame:
    """df, if all its rows are of seasons before the test one; otherwise an error."""
    late = df.agg(F.max(season)).first()[0]
    if late is not None and late >= test:
        raise ValueError(f"{what} reach into season {late}, tested is {test}")
    return df


def cross_fit(df: DataFrame, week: str, parts: int) -> DataFrame:
    """df with `part`: distinct weeks in order dealt round robin. Weeks are few; only they are numbered."""
    numbered = df.select(F.col(week).alias("_w")).distinct().withColumn("part", (F.row_number().over(Window.orderBy("_w")) - 1) % parts)
    return df.join(numbered, df[week].eqNullSafe(F.col("_w"))).drop("_w")


def folds(df: DataFrame, fold: str, features: Sequence[str], label: str, first: int, last: int, reg: float = 0.01) -> DataFrame:
    """Rows of folds first..last with `prob`, by a logistic model on all rows of earlier folds. A fold without both labels before it is an error, never scored by hindsight."""
    out = None
    for k in range(first, last + 1):
        past, now = df.where(F.col(fold) < k), df.where(F.col(fold) == k)
        if past.select(label).distinct().count() < 2:
            raise ValueError(f"fold {k} has no two labels before it")
        stages = [VectorAssembler(inputCols=list(features), outputCol="_x"), LogisticRegression(featuresCol="_x", labelCol=label, regParam=reg, maxIter=25)]
        scored = Pipeline(stages=stages).fit(past).transform(now).withColumn("prob", vector_to_array("probability")[1]).select(*df.columns, "prob")
        out = scored if out is None else out.unionByName(scored)
    return out
