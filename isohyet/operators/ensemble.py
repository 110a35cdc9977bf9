"""Ensembles of models: inverse-deviation and other weights, their use, and the decomposition of uncertainty.

An ensemble is long: keys, date, obs, gcm, value. What aggregates and windows can say is said so; solves and sampling
run per series in numpy (isohyet.operators.kernels).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from .kernels import bayes


def assemble(df: DataFrame, keys: list[str], models: list[str], time: str = "date", model: str = "gcm", value: str = "value") -> DataFrame:
    """Wide: a column a model, for the times that every model has."""
    wide = df.groupBy(*keys, time).pivot(model, models).agg(F.first(value))
    return wide.dropna(subset=models)


def equal_times(df: DataFrame, keys: list[str], time: str = "date", model: str = "gcm") -> DataFrame:
    """Times that not every model of their keys has: an ensemble should return none."""
    n = df.groupBy(*keys).agg(F.count_distinct(model).alias("__n"))
    have = df.groupBy(*keys, time).agg(F.count_distinct(model).alias("__have"))
    return have.join(n, keys).where("__have < __n").select(*keys, time)


def quick_weights(df: DataFrame, keys: list[str], model: str = "gcm") -> DataFrame:
    """Weights in proportion to 1 / population deviation of (model - obs)."""
    sd = df.groupBy(*keys, model).agg(F.stddev_pop(F.col("value") - F.col("obs")).alias("sd"))
    inverse = F.try_divide(F.lit(1.0), "sd")
    return sd.withColumn("weight", F.try_divide(inverse, F.sum(inverse).over(W.partitionBy(*keys)))).select(*keys, model, "weight")


def apply_weights(df: DataFrame, weights: DataFrame, keys: list[str], time: str = "date", model: str = "gcm", conditional: bool = False) -> DataFrame:
    """The weighted sum over models at each time; not below 0 if conditional."""
    out = F.sum(F.col("value") * F.col("weight"))
    if conditional:
        out = F.greatest(out, F.lit(0.0))
    return df.join(weights, [*keys, model]).groupBy(*keys, time).agg(out.alias("estimate"))


def _matrix(pdf: pd.DataFrame, time: str, model: str) -> tuple[list, np.ndarray, np.ndarray]:
    wide = pdf.pivot_table(index=time, columns=model, values="value").dropna()
    obs = pdf.drop_duplicates(time).set_index(time)["obs"].reindex(wide.index)
    ok = obs.notna()
    return list(wide.columns), wide[ok].to_numpy(float), obs[ok].to_numpy(float)


def fitted_weights(df: DataFrame, keys: list[str], method: str, time: str = "date", model: str = "gcm", seed: int = 0) -> DataFrame:
    """Weights per series by lagrange (least variance of the error, summing to 1), ridge (closed form, 200 penalties, 10 folds) or bma (model-averaged coefficients). An intercept has the model name ''."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keys)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        names, x, y = _matrix(pdf, time, model)
        if method == "lagrange":
            b, c = 0.0, bayes.least_variance(x - y[:, None])
        elif method == "ridge":
            b, c = bayes.ridge_cv(x, y)
        else:
            b, c = bayes.averaged_coefficients(x, y, seed=seed)
        head = {k: pdf[k].iloc[0] for k in keys}
        return pd.DataFrame([{**head, model: n, "weight": float(w)} for n, w in zip(["", *map(str, names)], [b, *c], strict=True)])

    return df.groupBy(*keys).applyInPandas(fit, f"{kinds}, {model} string, weight double")


def posterior(df: DataFrame, keys: list[str], time: str = "date", model: str = "gcm", inclusion: float = 1 / 3) -> DataFrame:
    """Every model subset with its posterior probability, and each model's inclusion in it (models array, probability)."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keys)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        names, x, y = _matrix(pdf, time, model)
        head = {k: pdf[k].iloc[0] for k in keys}
        return pd.DataFrame([{**head, "models": [str(n) for n, k in zip(names, m, strict=True) if k], "probability": p} for m, p in bayes.enumerate_models(x, y, inclusion).items()])

    return df.groupBy(*keys).applyInPandas(fit, f"{kinds}, models array<string>, probability double")


def posterior_by_chains(df: DataFrame, keys: list[str], chains: int = 8, iterations: int = 10_000, time: str = "date", model: str = "gcm", inclusion: float = 1 / 3, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The posterior of subsets for any number of models, by Metropolis walks; a chain of a key is a task.

    First the subsets visited, with their share of all chains' visits after burn-in (keys, models, probability); then the
    chains' agreement on the subset's size (keys, chains, rhat: between to within variance, 1 where they agree; ess: effective draws).
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keys)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        names, x, y = _matrix(pdf, time, model)
        chain = int(pdf["__chain"].iloc[0])
        visits, steps = bayes.mc3(x, y, iterations, inclusion, seed=[seed, chain, *(hash_key(str(pdf[k].iloc[0])) for k in keys)])
        sizes = np.array([sum(m) for m in steps[len(steps) // 2 :]], float)
        tau = bayes.integrated_time(sizes) if sizes.std() else 0.5
        head = {k: pdf[k].iloc[0] for k in keys} | {"chain": chain, "mean": sizes.mean(), "var": sizes.var(ddof=1), "n": len(sizes), "ess": len(sizes) / (2 * tau)}
        return pd.DataFrame([{**head, "models": [str(n) for n, k in zip(names, m, strict=True) if k], "share": p} for m, p in visits.items()])

    dealt = df.withColumn("__chain", F.explode(F.sequence(F.lit(0), F.lit(chains - 1))))
    told = dealt.groupBy(*keys, "__chain").applyInPandas(walk, f"{kinds}, chain int, mean double, var double, n long, ess double, models array<string>, share double")
    post = told.groupBy(*keys, "models").agg((F.sum("share") / chains).alias("probability"))
    each = told.groupBy(*keys, "chain").agg(*[F.first(c).alias(c) for c in ("mean", "var", "n", "ess")])
    within, between = F.avg("var"), F.coalesce(F.var_samp("mean"), F.lit(0.0))
    rhat = F.when(within == 0, F.when(between == 0, 1.0)).otherwise(F.sqrt((F.avg("n") - 1) / F.avg("n") + between / F.nullif(within, F.lit(0.0))))
    return post, each.groupBy(*keys).agg(F.count(F.lit(1)).alias("chains"), rhat.alias("rhat"), F.sum("ess").alias("ess"))


def predictive_interval(df: DataFrame, keys: list[str], mass: float = 0.9, time: str = "date", model: str = "gcm", inclusion: float = 1 / 3) -> DataFrame:
    """Mean, low and high of the averaged prediction at each time that all models have; models are fitted to the times with obs.

    The prediction is a mixture of Student distributions, a subset of models each; its quantiles are found by bisection.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in [*keys, time])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        names, x, y = _matrix(pdf, time, model)
        wide = pdf.pivot_table(index=time, columns=model, values="value").dropna()
        w, centres, widths, n = bayes.predictive_mixture(x, y, wide[names].to_numpy(float), inclusion)
        low, high = (bayes.mixture_quantile(w, centres, widths, n, p) for p in ((1 - mass) / 2, (1 + mass) / 2))
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, time: wide.index, "mean": w @ centres, "low": low, "high": high})

    return df.groupBy(*keys).applyInPandas(fit, f"{kinds}, mean double, low double, high double")


def inclusion(post: DataFrame, keys: list[str]) -> DataFrame:
    """Posterior inclusion of each model."""
    return post.select(*keys, "probability", F.explode("models").alias("gcm")).groupBy(*keys, "gcm").agg(F.sum("probability").alias("inclusion"))


def joint_inclusion(post: DataFrame, keys: list[str], models: list[str]) -> DataFrame:
    """Posterior probability that all of `models` are in."""
    both = F.size(F.array_intersect("models", F.array(*[F.lit(m) for m in models]))) == len(models)
    return post.groupBy(*keys).agg(F.sum(F.when(both, F.col("probability")).otherwise(0.0)).alias("probability"))


def size_distribution(post: DataFrame, keys: list[str]) -> DataFrame:
    return post.groupBy(*keys, F.size("models").alias("size")).agg(F.sum("probability").alias("probability"))


def uncertainty(df: DataFrame, weights: DataFrame, keys: list[str], model: str = "gcm") -> DataFrame:
    """Per model: inner (weight x sample variance) and inter (weight x squared distance of its mean from the weighted one); bma is the sum of all."""
    per = df.groupBy(*keys, model).agg(F.var_samp("value").alias("s2"), F.avg("value").alias("m")).join(weights, [*keys, model])
    w = W.partitionBy(*keys)
    per = per.withColumn("grand", F.sum(F.col("weight") * F.col("m")).over(w))
    per = per.withColumns({"inner": F.col("weight") * F.col("s2"), "inter": F.col("weight") * F.pow(F.col("m") - F.col("grand"), F.lit(2.0))})
    return per.withColumn("bma", F.sum(F.col("inner") + F.col("inter")).over(w)).select(*keys, model, "inner", "inter", "bma")


def time_variance(df: DataFrame, weights: DataFrame, keys: list[str], time: str = "date", model: str = "gcm") -> DataFrame:
    """At each time: weighted mean and weighted variance over the models."""
    j = df.join(weights, [*keys, model])
    m = F.sum(F.col("weight") * F.col("value"))
    return j.groupBy(*keys, time).agg(m.alias("mean"), (F.sum(F.col("weight") * F.col("value") * F.col("value")) - 2 * m * m + m * m * F.sum("weight")).alias("variance"))


def monte_carlo_interval(df: DataFrame, weights: DataFrame, keys: list[str], iterations: int = 10_000, percent: float = 90.0, seed: int = 0, conditional: bool = False, independent: bool = False, time: str = "date", model: str = "gcm") -> DataFrame:
    """Lower and upper percentile at each time of draws: a model by its weight, plus normal noise of the time's deviation.

    One draw of noise serves the whole series of an iteration, or one a time if independent. Negative values are drawn
    again if conditional. The seed and the keys alone decide the draws.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in [*keys, time])
    rows = df.join(weights, [*keys, model])

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index=time, columns=model, values="value").dropna()
        w = pdf.drop_duplicates(model).set_index(model)["weight"].reindex(wide.columns).to_numpy(float)
        w = np.maximum(w, 0) / np.maximum(w, 0).sum()
        x = wide.to_numpy(float)
        sd = np.sqrt(np.maximum(((x - (x @ w)[:, None]) ** 2) @ w, 0))
        rng = np.random.default_rng([seed, *(abs(hash_key(str(pdf[k].iloc[0]))) for k in keys)])
        pick = rng.choice(len(w), iterations, p=w)
        z = rng.standard_normal((len(x), iterations) if independent else iterations)
        out = x[:, pick] + sd[:, None] * z
        if conditional:
            for _ in range(100):
                bad = out < 0
                if not bad.any():
                    break
                out[bad] = (x[:, pick] + sd[:, None] * rng.standard_normal(out.shape))[bad]
            out = np.maximum(out, 0)
        low, high = np.percentile(out, [(100 - percent) / 2, 100 - (100 - percent) / 2], axis=1)
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, time: wide.index, "low": low, "high": high})

    return rows.groupBy(*keys).applyInPandas(draw, f"{kinds}, low double, high double")


def hash_key(text: str) -> int:
    """A stable number of a key, for seeds."""
    import zlib

    return zlib.crc32(text.encode())
