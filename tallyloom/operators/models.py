"""MLlib models with the settings of the pipeline."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import IDF, PCA, CountVectorizer, NGram, Normalizer, RegexTokenizer, SQLTransformer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def text_features(text: str, out: str, *, ngrams: int = 2, min_df: float = 3, max_df: float = 0.9, size: int = 1 << 16) -> Pipeline:
    """Words and n-grams as unit-length TF-IDF vectors; the vocabulary is cut by document frequency and to `size` terms."""
    stages = [SQLTransformer(statement=f"SELECT *, coalesce({text}, '') AS {out}_t FROM __THIS__"), RegexTokenizer(inputCol=f"{out}_t", outputCol=f"{out}_1", pattern=r"[^\p{L}\p{N}]+")]
    cols = []
    for n in range(1, ngrams + 1):
        if n > 1:
            stages.append(NGram(n=n, inputCol=f"{out}_1", outputCol=f"{out}_{n}"))
        stages += [CountVectorizer(inputCol=f"{out}_{n}", outputCol=f"{out}_c{n}", minDF=min_df, maxDF=max_df, vocabSize=size), IDF(inputCol=f"{out}_c{n}", outputCol=f"{out}_i{n}")]
        cols.append(f"{out}_i{n}")
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=cols, outputCol=f"{out}_a"), Normalizer(inputCol=f"{out}_a", outputCol=out)])


def gatekeeper(df: DataFrame, text: str, label: str, *, c: float = 10.0, balanced: bool = True, **features) -> PipelineModel:
    """Logistic regression on text features with inverse strength c; balanced weighs the classes alike."""
    df = df.filter(F.col(label).isNotNull())
    n = df.groupBy(label).agg(F.count("*").alias("n")).collect()
    total = sum(r["n"] for r in n)
    w = F.lit(1.0)
    for r in n:
        w = F.when(F.col(label) == r[label], total / (len(n) * r["n"])).otherwise(w)
    df = df.withColumn("__w", w if balanced else F.lit(1.0))
    return Pipeline(stages=[text_features(text, "features", **features), LogisticRegression(featuresCol="features", labelCol=label, weightCol="__w", regParam=1 / (c * max(total, 1)), maxIter=50)]).fit(df)


def score(model: PipelineModel, df: DataFrame, keep: list[str]) -> DataFrame:
    """keep columns and p, the probability of class 1."""
    out = model.transform(df).select(*keep, vector_to_array("probability")[1].alias("p"))
    out._model = model  # its broadcast vocabulary goes with the Python object, and the plan runs later
    return out


def cluster_vectors(df: DataFrame, vector: str, *, k: int, components: int | None = None, seed: int = 42) -> DataFrame:
    """df with `cluster`: unit-length vectors (first reduced to principal components, if asked) by k-means on cosine."""
    stages = []
    df, col = df.withColumn("__v", array_to_vector(F.col(vector))), "__v"
    if components:
        stages.append(PCA(k=components, inputCol=col, outputCol="__p"))
        col = "__p"
    stages += [Normalizer(inputCol=col, outputCol="__u"), KMeans(k=k, seed=seed, featuresCol="__u", predictionCol="cluster", distanceMeasure="cosine")]
    model = Pipeline(stages=stages).fit(df)
    out = model.transform(df).drop("__v", "__p", "__u")
    out._model = model
    return out


def forest(df: DataFrame, features: list[str], label: str, *, folds: int = 5, trees: int = 40, seed: int = 42):
    """(model, importances) of a random forest whose depth is chosen by cross-validation."""
    df = VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="skip").transform(df.filter(F.col(label).isNotNull()))
    rf = RandomForestRegressor(featuresCol="__x", labelCol=label, numTrees=trees, seed=seed)
    grid = ParamGridBuilder().addGrid(rf.maxDepth, [4, 8]).build()
    cv = CrossValidator(estimator=rf, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol=label), numFolds=folds, seed=seed, parallelism=2).fit(df)
    return cv.bestModel, dict(zip(features, map(float, cv.bestModel.featureImportances.toArray()), strict=True))


def elastic_net(df: DataFrame, features: list[str], label: str, *, weight: str | None = None, folds: int = 5, seed: int = 42):
    """(model, coefficients) with mixing and strength chosen by cross-validation."""
    df = VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="skip").transform(df.filter(F.col(label).isNotNull()))
    lr = LinearRegression(featuresCol="__x", labelCol=label, maxIter=50, **({"weightCol": weight} if weight else {}))
    grid = ParamGridBuilder().addGrid(lr.elasticNetParam, [0.0, 0.5, 1.0]).addGrid(lr.regParam, [0.001, 0.01, 0.1]).build()
    cv = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol=label), numFolds=folds, seed=seed, parallelism=2).fit(df)
    return cv.bestModel, dict(zip(features, map(float, cv.bestModel.coefficients.toArray()), strict=True))


def area_under_curve(scored: DataFrame, label: str, p: str = "p") -> float:
    return BinaryClassificationEvaluator(rawPredictionCol=p, labelCol=label).evaluate(scored)
