"""Statistical downscaling: predictors of each station to its components, by least squares or a perceptron; and attribution."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from .kernels import regress as R


def _kinds(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in columns)


def fit_linear(df: DataFrame, keys: list[str], predictors: list[str], targets: list[str], most: int = 10, train: str | None = "is_train") -> DataFrame:
    """Coefficients per key: predictors chosen forward by cross-validated error on all targets, least squares for each. Predictor '' is the intercept.

    predictors and targets are columns, scaled as they should be (isohyet.operators.temporal.apply_scaler).
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        use = pdf[pdf[train]] if train else pdf
        use = use.dropna(subset=[*predictors, *targets])
        head = {k: pdf[k].iloc[0] for k in keys}
        if len(use) < 3:
            return pd.DataFrame({c: [] for c in [*keys, "target", "predictor", "coefficient"]}, dtype=object)
        x, y = use[predictors].to_numpy(float), use[targets].to_numpy(float)
        at = R.forward_selection(x, y, most)
        c = R.least_squares(x[:, at], y)
        return pd.DataFrame([{**head, "target": t, "predictor": p, "coefficient": float(c[i, j])} for j, t in enumerate(targets) for i, p in enumerate(["", *(predictors[k] for k in at)])])

    columns = [*keys, *predictors, *targets, *([train] if train else [])]
    return df.select(*columns).groupBy(*keys).applyInPandas(run, f"{_kinds(df, keys)}, target string, predictor string, coefficient double")


def predict_linear(df: DataFrame, coefficients: DataFrame, keys: list[str], predictors: list[str], time: str = "date", conditional: bool = False) -> DataFrame:
    """Each target's prediction, and under target null their sum, not below 0 if conditional. A join and sums; nothing leaves the JVM."""
    long = df.unpivot([*keys, time], predictors, "predictor", "x").unionByName(df.select(*keys, time, F.lit("").alias("predictor"), F.lit(1.0).alias("x")))
    each = long.join(coefficients, [*keys, "predictor"]).groupBy(*keys, time, "target").agg(F.sum(F.col("x") * F.col("coefficient")).alias("prediction"))
    total = F.sum("prediction")
    whole = each.groupBy(*keys, time).agg((F.greatest(total, F.lit(0.0)) if conditional else total).alias("prediction")).withColumn("target", F.lit(None).cast("string"))
    return each.unionByName(whole)


def perceptron(df: DataFrame, keys: list[str], predictors: list[str], target: str, time: str = "date", train: str = "is_train", layers: tuple[int, ...] = (500, 500, 250), epochs: int = 200, subsets: list[list[str]] | None = None, seed: int = 0) -> DataFrame:
    """Predictions of a perceptron fitted per key on the training rows, for all rows; of several predictor subsets the one of best test NSE."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ok = pdf[predictors].notna().all(axis=1)
        rows = pdf[ok]
        use = rows[rows[train] & rows[target].notna()]
        test = rows[~rows[train] & rows[target].notna()]
        best = (-np.inf, np.full(len(rows), np.nan))
        for names in subsets or [predictors]:
            if len(use) < 3:
                break
            m = R.Perceptron(layers, epochs, seed=seed).fit(use[names].to_numpy(float), use[target].to_numpy(float))
            judge = test if len(test) > 1 else use
            y, p = judge[target].to_numpy(float), m.predict(judge[names].to_numpy(float))[:, 0]
            nse = 1 - ((y - p) ** 2).sum() / max(((y - y.mean()) ** 2).sum(), 1e-300)
            if nse > best[0]:
                best = (nse, m.predict(rows[names].to_numpy(float))[:, 0])
        return rows[[*keys, time]].assign(prediction=best[1])

    return df.select(*keys, time, *predictors, target, train).groupBy(*keys).applyInPandas(run, f"{_kinds(df, [*keys, time])}, prediction double")


def attribution(df: DataFrame, keys: list[str], features: list[str], target: str, trees: int = 60, depth: int = 3) -> DataFrame:
    """Mean absolute Shapley value of each feature in a boosted-tree model of its key, its share, and whether it is the main one."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        use = pdf.dropna()
        x, y = use[features].to_numpy(float), use[target].to_numpy(float)
        span = np.ptp(x, axis=0)
        x = (x - x.min(axis=0)) / np.where(span > 0, span, 1.0)
        m = np.abs(R.BoostedTrees(trees, depth).fit(x, y).shap(x)).mean(axis=0)
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "feature": f, "mean_shap": float(v)} for f, v in zip(features, m, strict=True)])

    out = df.select(*keys, *features, target).groupBy(*keys).applyInPandas(run, f"{_kinds(df, keys)}, feature string, mean_shap double")
    w = W.partitionBy(*keys)
    share = F.try_divide("mean_shap", F.sum("mean_shap").over(w))
    return out.withColumns({"share": share, "is_main": F.col("mean_shap") == F.max("mean_shap").over(w)})
