"""A small linear filter for candidates: full-batch logistic regression and leave-one-group-out scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPOCHS, RATE, RIDGE = 400, 0.1, 1.0


def fit(x: np.ndarray, y: np.ndarray, k: np.ndarray | None = None) -> np.ndarray:
    """Weights, each row counted k times; the first feature is the bias and is not shrunk."""
    w = np.zeros(x.shape[1])
    k = np.ones(len(x)) if k is None else k
    n = max(1, k.sum())
    shrink = np.full(x.shape[1], RIDGE)
    shrink[0] = 0
    for _ in range(EPOCHS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= RATE * (x.T @ (k * (p - y)) + shrink * w) / n
    return w


def leave_one_out(rows: DataFrame, group: str, key: str, features: list[str], label: str, threshold: float = 0.5, most_groups: int = 200) -> DataFrame:
    """(group, key, p, keep) for every row, scored by weights from all other groups. Rows without a group are one group; where no other group
    has a label there is nothing to learn from, so p is 0.5.

    The gradient needs only sums, so rows are first merged: equal feature rows with equal labels count once with their number.
    A fold's merged table is bounded by the features' different values; more than most_groups groups are an error, not cut.
    """
    merged = rows.groupBy(group, *features, label).agg(F.count(F.lit(1)).alias("_n"))
    folds = [r[0] for r in rows.select(group).distinct().limit(most_groups + 1).collect()]
    if len(folds) > most_groups:
        raise ValueError(f"more than {most_groups} groups to leave out")
    kind = rows.schema[group].dataType.simpleString()
    others = F.array_except(F.array(*(F.lit(f).cast(kind) for f in folds)), F.array(group))
    train = merged.withColumn("_fold", F.explode(others))

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        known = pdf[pdf[label].notna()]
        x = np.column_stack([np.ones(len(known)), known[features].to_numpy(float)])
        w = fit(x, known[label].to_numpy(float), known["_n"].to_numpy(float))
        return pd.DataFrame({"_group": [pdf["_fold"].iloc[0]], "_w": [w.tolist()]})

    weights = train.groupBy("_fold").applyInPandas(learn, f"_group {kind}, _w array<double>")
    x = F.array(F.lit(1.0), *(F.col(f).cast("double") for f in features))
    dot = F.aggregate(F.zip_with(x, "_w", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), dot))))
    nothing = F.array_repeat(F.lit(0.0), len(features) + 1)
    scored = rows.join(weights, F.col(group).eqNullSafe(F.col("_group")), "left").withColumn("_w", F.coalesce("_w", nothing))
    return scored.select(group, key, p.alias("p")).withColumn("keep", F.col("p") >= threshold)
