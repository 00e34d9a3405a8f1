"""Iterate-to-convergence per row, and labelling by an opaque model with isolated failures."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fire(x: np.ndarray, force: Callable[[np.ndarray], np.ndarray], limit: float = 1e-3, rounds: int = 2000, step: float = 0.1, most: float = 0.2) -> tuple[np.ndarray, int, bool]:
    """Fast inertial relaxation: velocity follows the force while they agree, stops when they do not."""
    v, dt, alpha, good = np.zeros_like(x), step, 0.1, 0
    for n in range(rounds):
        f = force(x)
        if np.abs(f).max(initial=0) < limit:
            return x, n, True
        power = float((f * v).sum())
        if power > 0:
            good += 1
            v = (1 - alpha) * v + alpha * f * np.linalg.norm(v) / max(np.linalg.norm(f), 1e-12)
            if good > 5:
                dt, alpha = min(1.1 * dt, 10 * step), 0.99 * alpha
        else:
            v, dt, alpha, good = np.zeros_like(x), 0.5 * dt, 0.1, 0
        v = v + dt * f
        move = dt * v
        x = x + move * min(1.0, most / max(np.abs(move).max(initial=0), 1e-12))
    return x, rounds, False


def relax(df: DataFrame, ident: str, points: str, force: Callable[[np.ndarray], np.ndarray], limit: float = 1e-3, rounds: int = 2000) -> DataFrame:
    """(ident, points, rounds, converged): each row relaxed on its own, in Arrow batches of its partition."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            done = [fire(np.array([list(p) for p in x], float), force, limit, rounds) for x in part[points]]
            yield pd.DataFrame({ident: part[ident], points: [x.tolist() for x, _, _ in done], "rounds": [n for _, n, _ in done], "converged": [ok for _, _, ok in done]})

    kind = df.schema[ident].dataType.simpleString()
    return df.select(ident, points).mapInPandas(run, f"`{ident}` {kind}, `{points}` array<array<double>>, rounds int, converged boolean")


def label(df: DataFrame, ident: str, value: str, model: Callable[[pd.Series], pd.Series], batch: int = 512) -> DataFrame:
    """(ident, label, error): a model over batches; if a batch fails its rows are tried one by one."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i in range(0, len(part), batch):
                rows = part.iloc[i : i + batch]
                out, why = [], []
                try:
                    out, why = list(model(rows[value])), [None] * len(rows)
                except Exception:  # noqa: BLE001 - any failure of the model is reported in its rows
                    for j in range(len(rows)):
                        try:
                            out.append(float(model(rows[value].iloc[j : j + 1]).iloc[0]))
                            why.append(None)
                        except Exception as e:  # noqa: BLE001
                            out.append(None)
                            why.append(f"{type(e).__name__}: {e}"[:200])
                yield pd.DataFrame({ident: rows[ident].to_numpy(), "label": pd.Series(out, dtype="float64"), "error": pd.Series(why, dtype="object")})

    kind = df.schema[ident].dataType.simpleString()
    return df.select(ident, value).mapInPandas(run, f"`{ident}` {kind}, label double, error string").withColumn("label", F.when(~F.isnan("label"), F.col("label")))


def project(df: DataFrame, ident: str, vector: str, k: int) -> DataFrame:
    """(ident, projection): the first k principal components, from Spark's own PCA."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = df.select(ident, array_to_vector(F.transform(vector, lambda v: v.cast("double"))).alias("__x"))
    model = PCA(k=k, inputCol="__x", outputCol="__p").fit(x)
    return model.transform(x).select(ident, vector_to_array("__p").alias("projection"))
