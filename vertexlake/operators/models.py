"""Count deviance, Poisson regression with a normal prior, and softmax classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vertexlake.functions import blocks, keyed, ranks, vectors
from vertexlake.operators.bins import choose_bins, equal_bins


def deviance(long: DataFrame, n_samples: int) -> DataFrame:
    """(feature, mean, deviance): Poisson deviance of each feature against its mean over all samples.

    Absent entries are zeros and count with their mean; null values count as absent; a feature of zeros has deviance 0.
    """
    total = F.sum("value")
    ylog = F.sum(F.when(F.col("value") > 0, F.col("value") * F.log("value")).otherwise(0.0))
    x = long.filter(F.col("value").isNotNull()).groupBy("feature").agg(total.alias("s"), ylog.alias("l"))
    mean = F.col("s") / float(n_samples)
    # 2 sum(y ln(y / mu) - y + mu) with mu the mean: the last two terms cancel over all samples.
    return x.select("feature", mean.alias("mean"), F.when(F.col("s") > 0, 2 * (F.col("l") - F.col("s") * F.log(mean))).otherwise(0.0).alias("deviance"))


def poisson_map(y: np.ndarray, x: np.ndarray, sd: float = 3.0, mean: float = 0.0, rounds: int = 100, tol: float = 1e-9) -> np.ndarray:
    """Coefficients (the intercept first) of a log-linear Poisson model under a normal prior on all of them, by Newton steps."""
    a = np.column_stack([np.ones(len(y)), x]) if x.size else np.ones((len(y), 1))
    b = np.full(a.shape[1], float(mean))
    score = lambda v: float(y @ (a @ v) - np.exp(np.minimum(a @ v, 700.0)).sum() - ((v - mean) ** 2).sum() / (2 * sd * sd))
    now = score(b)
    for _ in range(rounds):
        mu = np.exp(np.minimum(a @ b, 700.0))
        grad = a.T @ (y - mu) - (b - mean) / (sd * sd)
        step = np.linalg.solve((a * mu[:, None]).T @ a + np.eye(len(b)) / (sd * sd), grad)
        t = 1.0
        while t > 1e-10 and not score(b + t * step) >= now:
            t /= 2
        b, new = b + t * step, score(b + t * step)
        if abs(new - now) < tol * (abs(now) + 1):
            break
        now = new
    return b


def poisson_regression(long: DataFrame, covariates: DataFrame | None = None, sd: float = 3.0) -> DataFrame:
    """(feature, coef array<double>, deviance) of each feature (sample_id, feature, value) on covariates (sample_id, x array<double>).

    Each feature's rows are first summed over equal covariates (value sums and counts suffice), so a task holds the distinct
    covariate rows, not the samples. All samples of a feature must be present, zeros too.
    """
    x = long.filter(F.col("value").isNotNull())
    x = x.join(covariates, "sample_id") if covariates is not None else x.withColumn("x", F.array().cast("array<double>"))
    ylog = F.sum(F.when(F.col("value") > 0, F.col("value") * F.log("value")).otherwise(0.0))
    g = x.groupBy("feature", "x").agg(F.sum("value").alias("y"), F.count("*").cast("double").alias("n"), ylog.alias("l"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = blocks.rows(pdf["x"])
        y, n = pdf["y"].to_numpy(float), pdf["n"].to_numpy(float)
        # n rows of one covariate: sum of log-likelihoods is y.eta - n.exp(eta), i.e. an offset of ln n.
        a1 = np.column_stack([np.ones(len(y)), a]) if a.size else np.ones((len(y), 1))
        b = np.zeros(a1.shape[1])
        for _ in range(100):
            mu = n * np.exp(np.minimum(a1 @ b, 700.0))
            step = np.linalg.solve((a1 * mu[:, None]).T @ a1 + np.eye(len(b)) / sd**2, a1.T @ (y - mu) - b / sd**2)
            b = b + np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-10:
                break
        eta = a1 @ b
        dev = 2 * float(pdf["l"].sum() - (y * eta).sum() - y.sum() + (n * np.exp(eta)).sum())
        return pd.DataFrame({"feature": [pdf["feature"].iloc[0]], "coef": [b.tolist()], "deviance": [dev]})

    return g.groupBy("feature").applyInPandas(run, "feature string, coef array<double>, deviance double")


# Softmax classifiers


def split_by_class(df: DataFrame, label: str, id_: str, share: float = 0.3, seed: int = 5, per_class: bool = True) -> DataFrame:
    """`validation`: round(n * share) rows of each class (half to even), or of the table, those of the least keys."""
    by = [label] if per_class else []
    x = df.withColumn("key_", keyed.uniform(seed, "split", F.col(id_)))
    x = ranks.row_numbers(x, by, "key_", [id_], "rn_", total="n_")
    return x.withColumn("validation", F.col("rn_") <= F.bround(F.col("n_") * share, 0)).drop("key_", "rn_", "n_")


def make_features(dist: DataFrame, long: DataFrame, n_bins: int = 10, n_samples: int = 10, select: list[int] | None = None, combine: list[int] | None = None, seed: int = 3) -> DataFrame:
    """(arch, bin, example, feature, value): samples binned by distance, dealt to examples by key, averaged and z-scored over the bins of an example and feature."""
    b = choose_bins(equal_bins(dist, ["arch"], "dist", ["sample_id"], n_bins), select, combine)
    b = b.withColumn("example", F.floor(keyed.uniform(seed, "example", F.col("arch"), F.col("sample_id")) * n_samples).cast("int"))
    m = b.select("sample_id", "arch", "bin", "example").join(long, "sample_id").groupBy("arch", "bin", "example", "feature").agg(F.avg("value").alias("value"))
    w = Window.partitionBy("feature", "example")
    z = (F.col("value") - F.avg("value").over(w)) / F.stddev_samp("value").over(w)
    return m.withColumn("value", F.when(F.stddev_samp("value").over(w) > 0, z))


def fit_softmax(df: DataFrame, features: str, label: str, penalty: float = 0.01, kind: str = "l1", soft: str | None = None, rounds: int = 100):
    """A multinomial model of (features array<double>, label); `soft` is an array of class weights instead of a label.

    l1 uses penalty * sum |w|, l2 penalty * sum w^2; the bias is not penalised (`fit_softmax_full` does).
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    if soft:
        x = df.select(array_to_vector(features).alias("x"), F.posexplode(soft).alias("y", "w")).filter("w > 0").withColumn("y", F.col("y").cast("double"))
    else:
        x = df.select(array_to_vector(features).alias("x"), F.col(label).cast("double").alias("y"), F.lit(1.0).alias("w"))
    alpha, reg = (1.0, penalty) if kind == "l1" else (0.0, 2 * penalty)
    return LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", family="multinomial", elasticNetParam=alpha, regParam=reg, standardization=False, maxIter=rounds).fit(x)


def coefficients(model) -> tuple[np.ndarray, np.ndarray]:
    return model.coefficientMatrix.toArray(), model.interceptVector.toArray()


def fit_softmax_full(df: DataFrame, features: str, label: str, n_classes: int, penalty: float = 0.01, kind: str = "l2", rate: float = 0.5, epochs: int = 100, patience: int = 50, validation: str | None = None) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(weights classes x features, bias, losses) with weights and bias penalised: full-batch steps with momentum, each one pass.

    A pass returns one gradient of fixed size for each partition. With a boolean column `validation` the loss of those rows
    decides when to stop.
    """
    x = df.filter(F.col(features).isNotNull() & F.col(label).isNotNull()).select(F.col(features).alias("x"), F.col(label).cast("int").alias("y"), (F.col(validation) if validation else F.lit(False)).alias("v")).persist()
    d = x.select(F.size("x")).first()
    if d is None:
        return np.zeros((n_classes, 0)), np.zeros(n_classes), []
    w = np.zeros((n_classes, d[0] + 1))
    speed, losses, best, waited = np.zeros_like(w), [], np.inf, 0
    for _ in range(epochs):

        def part(batches: Iterator[pd.DataFrame], w: np.ndarray = w) -> Iterator[pd.DataFrame]:
            g, loss, n, vl, vn = np.zeros_like(w), 0.0, 0, 0.0, 0
            for b in batches:
                if not len(b):
                    continue
                a = np.column_stack([np.array(b["x"].tolist(), float), np.ones(len(b))])
                z = a @ w.T
                z -= z.max(1, keepdims=True)
                p = np.exp(z)
                p /= p.sum(1, keepdims=True)
                y, v = b["y"].to_numpy(), b["v"].to_numpy(bool)
                nll = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))
                p[np.arange(len(y)), y] -= 1.0
                g += p[~v].T @ a[~v]
                loss, n, vl, vn = loss + float(nll[~v].sum()), n + int((~v).sum()), vl + float(nll[v].sum()), vn + int(v.sum())
            yield pd.DataFrame({"g": [g.ravel().tolist()], "s": [[loss, float(n), vl, float(vn)]]})

        got = x.mapInPandas(part, "g array<double>, s array<double>").toPandas()
        loss, n, vl, vn = np.sum([np.array(s) for s in got["s"]], 0)
        g = np.sum([np.array(v) for v in got["g"]], 0).reshape(w.shape) / max(n, 1.0)
        g += penalty * (np.sign(w) if kind == "l1" else 2 * w)
        speed = 0.9 * speed - rate * g
        w = w + speed
        now = vl / vn if vn else loss / max(n, 1.0)
        losses.append(float(now))
        best, waited = (now, 0) if now < best - 1e-6 else (best, waited + 1)
        if waited >= patience:
            break
    x.unpersist()
    return w[:, :-1], w[:, -1], losses


def probabilities(features: Column, weights: np.ndarray, bias: np.ndarray) -> Column:
    """Softmax probabilities of an array column, as an expression."""
    score = [vectors.dot(features, F.array(*map(F.lit, map(float, w)))) + float(b) for w, b in zip(weights, bias)]
    s = F.array(*score)
    e = F.transform(s, lambda x: F.exp(x - F.array_max(s)))
    return F.transform(e, lambda x: x / vectors.total(e))


def classify(df: DataFrame, p: str = "probabilities", classes: list[str] | None = None) -> DataFrame:
    """`pred_class` (the first largest probability, numbered from 1 or named) and `class_entropy`."""
    at = vectors.first_argmax(F.col(p))
    named = at if classes is None else F.array(*map(F.lit, classes))[at - 1]
    return df.withColumn("pred_class", named).withColumn("class_entropy", vectors.entropy(F.col(p)))


def confusion(df: DataFrame, observed: str, predicted: str, zeros: bool = False) -> DataFrame:
    """(observed_class, predicted_class, N, proportion): proportion of the observed class. With `zeros` pairs that do not occur have N 0."""
    x = df.groupBy(F.col(observed).alias("observed_class"), F.col(predicted).alias("predicted_class")).agg(F.count("*").alias("N"))
    if zeros:
        own = x.groupBy(F.lit(0).alias("one_")).agg(F.collect_set("predicted_class").alias("own_"))  # the classes of a model
        every = x.select("observed_class").distinct().withColumn("one_", F.lit(0)).join(own, "one_").select("observed_class", F.explode("own_").alias("predicted_class"))
        x = every.join(x, ["observed_class", "predicted_class"], "left").na.fill(0, ["N"])
    total = F.sum("N").over(Window.partitionBy("observed_class"))
    return x.withColumn("proportion", F.when(total > 0, F.col("N") / total))


def soft_confusion(df: DataFrame, reference: str, p: str) -> DataFrame:
    """(observed_class, predicted_class, N): sums of products of two probability vectors."""
    x = df.select(F.posexplode(reference).alias("i", "a"), F.col(p).alias("p")).select("i", "a", F.posexplode("p").alias("j", "b"))
    return x.groupBy((F.col("i") + 1).alias("observed_class"), (F.col("j") + 1).alias("predicted_class")).agg(F.sum(F.col("a") * F.col("b")).alias("N"))


def top_weights(weights: DataFrame, least: float = 1e-3) -> DataFrame:
    """`place` of each (class, feature, weight) by falling weight; `name` is null where the weight is nearly 0."""
    n = F.row_number().over(Window.partitionBy("class").orderBy(F.col("weight").desc(), "feature"))
    return weights.withColumn("place", n).withColumn("name", F.when(F.abs("weight") >= least, F.col("feature")))


def weight_table(spark, w: np.ndarray, features: list[str]) -> DataFrame:
    rows = [(i + 1, f, float(w[i, j])) for i in range(len(w)) for j, f in enumerate(features)]
    return spark.createDataFrame(rows, "class int, feature string, weight double")
