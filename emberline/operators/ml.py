"""Training and evaluating the name model and the tree model with Spark ML."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators.ranking import stratified_folds
from emberline.sources.stores import checkpointed


def balanced(rows: DataFrame) -> DataFrame:
    """rows with weight n / (2 n_class)."""
    per = rows.groupBy("label").agg(F.count("*").alias("_k"))
    n = per.agg(F.sum("_k").alias("_n"))
    return rows.join(F.broadcast(per.crossJoin(n)), "label").withColumn("weight", F.col("_n") / (2 * F.col("_k"))).drop("_k", "_n")


def name_model(c: float = 1.0) -> LogisticRegression:
    return LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", regParam=0.01 / c, elasticNetParam=0.0, standardization=False, maxIter=50)


def tree_model(rounds: int = 400) -> GBTClassifier:
    return GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=rounds, maxDepth=4, stepSize=0.05, seed=7)


def name_rows(spark, d: str) -> DataFrame:
    """Embeddings with a label; the domain stands for the field that a name comes from."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("key"), (F.col("label") < 3).cast("int").alias("label"), (F.col("label") % 4).alias("domain"), array_to_vector("embedding").alias("features"))


def document_rows(spark, d: str) -> DataFrame:
    """Labelled documents with imputed features and an indicator for each that may be missing."""
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    j = docs.join(labels, "doc_id")
    f = j.select(F.col("doc_id").alias("key"), F.col("toxic").alias("label"), F.log1p("n_chars").alias("log_chars"), F.when(F.length("text") > 200, F.size(F.split("text", " ")) / F.length("text")).alias("density"), F.col("quality").cast("double").alias("quality"))
    f = f.withColumn("density_missing", F.col("density").isNull().cast("double"))
    filled = Imputer(strategy="median", inputCols=["density"], outputCols=["density_filled"]).fit(f).transform(f)
    return VectorAssembler(inputCols=["log_chars", "density_filled", "density_missing", "quality"], outputCol="features").transform(filled).select("key", "label", "features")


def held_out_scores(rows: DataFrame, model, by: str, values: list) -> DataFrame:
    """(key, label, by, score): rows of each value of `by` scored by a model fitted to those of the others. The fits are Spark
    jobs that run side by side, since each alone leaves executors idle between its rounds."""

    def scored(v) -> DataFrame:
        part = model.fit(rows.where(F.col(by) != v)).transform(rows.where(F.col(by) == v))
        return part.select("key", "label", by, F.round(vector_to_array("probability")[1], 6).alias("score"))

    with ThreadPoolExecutor(max(1, min(8, len(values)))) as pool:
        parts = [*pool.map(inheritable_thread_target(rows.sparkSession)(scored), values)]
    return reduce(DataFrame.union, parts)


def out_of_fold(rows: DataFrame, model, folds: int = 5) -> DataFrame:
    """(key, label, fold, score): each row scored by a model fitted to the other folds."""
    return held_out_scores(checkpointed(stratified_folds(balanced(rows), "label", "key", folds)), model, "fold", [*range(folds)])


def leave_one_out(rows: DataFrame, model, by: str) -> DataFrame:
    """(key, label, by, score): each value's rows scored by a model fitted to the others."""
    weighted = checkpointed(balanced(rows))
    return held_out_scores(weighted, model, by, sorted(r[0] for r in weighted.select(by).distinct().collect()))  # a handful of domains


def contributions(rows: DataFrame) -> DataFrame:
    """(key, feature, contribution): coef * (x - mean) of the standardised logistic baseline, exact for a linear model."""
    weighted = balanced(rows)
    scaled = StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
    lr = LogisticRegression(featuresCol="scaled", labelCol="label", weightCol="weight", maxIter=50)
    fitted = Pipeline(stages=[scaled, lr]).fit(weighted)
    coef = F.array(*[F.lit(float(c)) for c in fitted.stages[-1].coefficients])
    each = fitted.transform(weighted).select("key", F.posexplode(F.zip_with(vector_to_array("scaled"), coef, lambda x, c: x * c)).alias("feature", "contribution"))
    return each.select("key", "feature", F.round("contribution", 6).alias("contribution"))


def tree_paths(model, folder: str) -> list[dict]:
    """The leaves of a fitted boosted-tree model, as arrays: value (times the tree's weight), and for each feature on the path
    the range (low, high] that leads there and the share of the training weight that takes it at those splits.

    The model is saved to `folder`, which executors share, and its nodes are read back as a table: as many rows as the trees
    have nodes. Splits have to be on numbers, not on categories."""
    spark = SparkSession.getActiveSession()
    model.write().overwrite().save(folder)
    nodes = spark.read.parquet(f"{folder}/data").select("treeID", "nodeData.id", "nodeData.prediction", F.col("nodeData.impurityStats")[0].alias("cover"), "nodeData.leftChild", "nodeData.rightChild", F.col("nodeData.split.featureIndex").alias("feature"), F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("at")).collect()
    of = {(r["treeID"], r["id"]): r for r in nodes}
    leaves = []
    for tree, weight in enumerate(model.treeWeights):
        open_ = [(of[tree, 0], {})]
        while open_:
            node, path = open_.pop()
            if node["leftChild"] < 0:
                leaves.append({"value": node["prediction"] * weight, "path": path})
                continue
            for side in ("leftChild", "rightChild"):
                child = of[tree, node[side]]
                low, high, share = path.get(node["feature"], (-np.inf, np.inf, 1.0))
                low, high = (low, min(high, node["at"])) if side == "leftChild" else (max(low, node["at"]), high)
                open_.append((child, path | {node["feature"]: (low, high, share * child["cover"] / node["cover"])}))
    return leaves


def shapley(leaves: list[dict], x: np.ndarray) -> tuple[float, np.ndarray]:
    """(base, contributions of each row and feature) of rows x: exact path-dependent Shapley values of a sum of trees.

    A leaf is a product over its features of o (the row takes the leaf's range: 1 or 0) if the feature is known, else of z (the
    share of training weight that does). A feature's Shapley value is then value (o - z) times the integral over t in [0, 1]
    of the other features' z + (o - z) t: a polynomial, which Gauss-Legendre quadrature integrates exactly."""
    out, base = np.zeros(x.shape), 0.0
    for leaf in leaves:
        path = leaf["path"]
        if not path:
            base += leaf["value"]
            continue
        features = list(path)
        low, high, z = (np.array(c) for c in zip(*path.values()))
        taken = (x[:, features] > low) & (x[:, features] <= high)
        base += leaf["value"] * z.prod()
        gap = taken - z
        t, w = np.polynomial.legendre.leggauss((len(features) + 1) // 2)
        for at, weight in zip((t + 1) / 2, w / 2):
            factor = z + gap * at  # rows x features
            before = np.cumprod(np.c_[np.ones(len(x)), factor[:, :-1]], axis=1)
            after = np.cumprod(np.c_[np.ones(len(x)), factor[:, :0:-1]], axis=1)[:, ::-1]
            out[:, features] += leaf["value"] * weight * gap * before * after
    return base, out


def tree_contributions(model, rows: DataFrame, folder: str) -> DataFrame:
    """(key, base, feature, contribution) of rows (key, features): what each feature moves the model's margin by, from the base
    that all rows share; they add up to the margin. Leaves travel with the task, and rows stay where they are."""
    leaves = tree_paths(model, folder)
    kind = rows.schema["key"].dataType.simpleString()

    def explain(batches):
        for b in batches:
            x = np.array(b.column(1).to_pylist(), np.float64)
            if len(x):
                base, c = shapley(leaves, x)
                n, k = c.shape
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(n), k))), pa.array(np.full(n * k, base)), pa.array(np.tile(np.arange(k, dtype=np.int32), n)), pa.array(c.ravel())], names=["key", "base", "feature", "contribution"])

    return rows.select("key", vector_to_array("features").alias("x")).mapInArrow(explain, f"key {kind}, base double, feature int, contribution double")


def importance(contributions: DataFrame) -> DataFrame:
    """(feature, importance): the mean absolute contribution over all rows."""
    return contributions.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("importance"))
