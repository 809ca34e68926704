"""Reward and preference models with ``pyspark.ml``.

The reference fine-tunes a transformer regressor on feedback scores and a
pairwise sigmoid head; here both are distributed Spark ML pipelines:

* reward regressor: RegexTokenizer → HashingTF → IDF → LinearRegression
  (squared error) on "Query: q / Response: r" texts, trained on a disjoint
  hash split and evaluated on the held-out part;
* reward on numeric features of the texts (``size_features``): unregularised
  least squares, the form that plain SQL can check;
* pairwise model: text features of both responses concatenated
  (VectorAssembler) → LogisticRegression on the preference label;
* pairwise model on numeric features of both responses: Newton steps, each one
  aggregation of gradient and Hessian, the form that plain SQL can check.
"""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

NUM_FEATURES = 1 << 18


def reward_pipeline(text_col: str = "pair_text", label_col: str = "label",
                    num_features: int = NUM_FEATURES, reg: float = 0.1, max_iter: int = 50) -> Pipeline:
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text_col, outputCol="_tok", pattern=r"(?U)\W+", toLowercase=True),
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features),
        IDF(inputCol="_tf", outputCol="features"),
        LinearRegression(featuresCol="features", labelCol=label_col, predictionCol="reward",
                         loss="squaredError", regParam=reg, maxIter=max_iter),
    ])


def size_features(df: DataFrame, query: str = "query", response: str = "response") -> DataFrame:
    """Thousands of characters of the response."""
    return df.withColumn("response_size", F.char_length(response) / F.lit(1000.0))


def least_squares_pipeline(features: tuple[str, ...] = ("response_size",), label_col: str = "label") -> Pipeline:
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="features"),
        LinearRegression(featuresCol="features", labelCol=label_col, predictionCol="reward", solver="normal", regParam=0.0)])


def fit_least_squares(dataset: DataFrame, is_test: str = "is_test", label: str = "feedback_score") -> PipelineModel:
    """Fitted on the rows that are not held out."""
    train = size_features(dataset.filter(~F.col(is_test))).select("response_size", F.col(label).cast("double").alias("label"))
    return least_squares_pipeline().fit(train)


def least_squares_scores(model: PipelineModel, pairs: DataFrame, query: str = "query", response: str = "response",
                         out: str = "reward") -> DataFrame:
    """``pairs`` with the model's reward for each row as ``out``."""
    scored = model.transform(size_features(pairs, query, response)).drop("features", "response_size")
    return scored.withColumnRenamed("reward", out) if out != "reward" else scored


def preference_probability(reward_a, reward_b):
    """P(a preferred over b): the sigmoid of the rewards' difference."""
    return 1.0 / (1.0 + F.exp(reward_b - reward_a))


def with_pair_text(df: DataFrame, query: str = "query", response: str = "response") -> DataFrame:
    return df.withColumn("pair_text", T.pair_text(query, response))


def one_part_a_core(kept: DataFrame) -> DataFrame:
    """Persisted rows in one partition for each core at most, for a fit on text features.

    Each task of each of the optimiser's passes shuffles a dense gradient of all
    features (2 MB at ``NUM_FEATURES``), so its volume goes with the partitions, not
    with the rows.  The rows are not shuffled; a task reads its partitions in turn."""
    return kept.coalesce(max(kept.sparkSession.sparkContext.defaultParallelism, 1))


def train_reward_model(dataset: DataFrame, is_test: str = "is_test", label: str = "feedback_score"):
    """Fit on the training rows, evaluate on the held-out rows.

    Returns (model, metrics DataFrame with n_train, n_test, mse, baseline_mse).
    The training input is persisted (memory and disk) because the optimiser
    makes several passes over it.
    """
    d = with_pair_text(dataset).withColumn("label", F.col(label).cast("double"))
    train = d.filter(~F.col(is_test)).persist(StorageLevel.MEMORY_AND_DISK)
    test = d.filter(F.col(is_test))
    model = reward_pipeline().fit(one_part_a_core(train))
    pred = model.transform(test)
    mean_label = train.agg(F.avg("label")).scalar()
    metrics = pred.agg(
        F.count(F.lit(1)).alias("n_test"),
        F.avg(F.pow(F.col("reward") - F.col("label"), 2)).alias("mse"),
        F.avg(F.pow(mean_label - F.col("label"), 2)).alias("baseline_mse"),
    ).withColumn("n_train", train.agg(F.count(F.lit(1))).scalar())
    train.unpersist()
    return model, metrics


def score_pairs(model: PipelineModel, pairs: DataFrame) -> DataFrame:
    """Reward of every (query, response) pair with a fitted reward model."""
    return model.transform(with_pair_text(pairs)).drop("_tok", "_tf", "features", "pair_text")


def evaluator_mse(pred: DataFrame, label: str = "label", prediction: str = "reward") -> float:
    return RegressionEvaluator(labelCol=label, predictionCol=prediction, metricName="mse").evaluate(pred)


def train_pairwise_model(pairs: DataFrame, num_features: int = 1 << 16, max_iter: int = 50, test_pct: int = 20):
    """Pairwise preference: P(a preferred over b) from concat(features(a), features(b)).

    Fitted on the pairs of ``100 - test_pct`` percent of the queries; only the
    held-out queries' pairs are scored."""
    is_test = F.pmod(F.xxhash64("query"), F.lit(100)) < test_pct
    d = (pairs.withColumn("is_test", is_test).withColumn("text_a", T.pair_text("query", "response_a"))
              .withColumn("text_b", T.pair_text("query", "response_b"))
              .withColumn("label", F.col("preference").cast("double")))
    stages = []
    for side in ("a", "b"):
        stages += [RegexTokenizer(inputCol=f"text_{side}", outputCol=f"_tok_{side}", pattern=r"(?U)\W+"),
                   HashingTF(inputCol=f"_tok_{side}", outputCol=f"_tf_{side}", numFeatures=num_features)]
    stages += [VectorAssembler(inputCols=["_tf_a", "_tf_b"], outputCol="features"),
               LogisticRegression(featuresCol="features", labelCol="label", maxIter=max_iter, regParam=0.01)]
    train = d.filter("not is_test").persist(StorageLevel.MEMORY_AND_DISK)
    model = Pipeline(stages=stages).fit(one_part_a_core(train))
    train.unpersist()
    out = model.transform(d.filter("is_test")).select(
        "query", "response_a", "response_b", "preference",
        F.col("prediction").cast("int").alias("predicted"),
        F.get(vector_to_array("probability"), 1).alias("p_a_preferred"))
    return model, out


def held_out_queries(pairs: DataFrame, test_pct: int = 20) -> DataFrame:
    """``pairs`` with ``is_test``: all pairs of a query are on one side."""
    part = F.conv(F.substr(F.md5(F.col("query").cast("binary")), F.lit(1), F.lit(4)), 16, 10).cast("int")
    return pairs.withColumn("is_test", part % 100 < test_pct)


def pair_sizes(pairs: DataFrame) -> DataFrame:
    """Features of both responses side by side: thousands of characters of a, of b."""
    return (pairs.withColumn("size_a", F.char_length("response_a") / F.lit(1000.0))
                 .withColumn("size_b", F.char_length("response_b") / F.lit(1000.0)))


PAIR_FEATURES = ("size_a", "size_b")


def fit_pairwise(pairs: DataFrame, features: tuple[str, ...] = PAIR_FEATURES, label: str = "preference",
                 ridge: float = 1.0, steps: int = 6) -> list[float]:
    """Weights of a logistic model without intercept by ``steps`` Newton steps with an L2 penalty.

    Each step is one aggregation of the gradient and the upper half of the
    Hessian, combined on the map side; the driver sees those k + k (k + 1) / 2
    numbers and solves k equations.  The training pairs are kept in memory and
    on disk between steps and computed again where an executor is lost."""
    k = len(features)
    x = [F.col(c).cast("double") for c in features]
    train = pairs.select(*[c.alias(f"x{i}") for i, c in enumerate(x)], F.col(label).cast("double").alias("y")).persist(StorageLevel.MEMORY_AND_DISK)
    w = np.zeros(k)
    for _ in range(steps):
        z = sum((F.lit(float(w[i])) * F.col(f"x{i}") for i in range(k)), F.lit(0.0))
        p = train.withColumn("p", 1.0 / (1.0 + F.exp(-z)))
        slope = [F.sum((F.col("y") - F.col("p")) * F.col(f"x{i}")) for i in range(k)]
        bend = [F.sum(F.col("p") * (1 - F.col("p")) * F.col(f"x{i}") * F.col(f"x{j}")) for i in range(k) for j in range(i, k)]
        sums = [float(v or 0.0) for v in p.agg(*[e.alias(f"s{n}") for n, e in enumerate(slope + bend)]).first()]
        hessian = np.zeros((k, k))
        hessian[np.triu_indices(k)] = sums[k:]
        hessian = hessian + np.triu(hessian, 1).T + ridge * np.eye(k)
        w = w + np.linalg.solve(hessian, np.array(sums[:k]) - ridge * w)
    train.unpersist()
    return w.tolist()


def pairwise_scores(weights: list[float], pairs: DataFrame, features: tuple[str, ...] = PAIR_FEATURES) -> DataFrame:
    """``pairs`` with ``p_a_preferred`` and ``predicted`` (1 if a is; a tie up to rounding is 0)."""
    z = sum((F.lit(float(w)) * F.col(c) for w, c in zip(weights, features)), F.lit(0.0))
    return pairs.withColumn("p_a_preferred", 1.0 / (1.0 + F.exp(-z))).withColumn(
        "predicted", (F.round("p_a_preferred", 9) > 0.5).cast("int"))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
