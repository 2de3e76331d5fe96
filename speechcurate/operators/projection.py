"""K-means, principal components and projected coordinates."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechcurate.operators.joins import align

AXES = ("x", "y", "z")


def kmeans(embeddings: DataFrame, k: int = 2, seed: int = 42) -> DataFrame:
    """``(filename, cluster)`` of k clusters."""
    vectors = embeddings.select("filename", array_to_vector("embedding").alias("features"))
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(vectors)
    return model.transform(vectors).select("filename", "cluster")


@dataclass
class Projection:
    """Fitted centring and components; each component's largest loading is positive."""

    model: PipelineModel
    signs: list[float]
    variance: list[float]

    def transform(self, embeddings: DataFrame) -> DataFrame:
        vectors = embeddings.withColumn("_raw", array_to_vector("embedding"))
        out = self.model.transform(vectors).withColumn("_pc", vector_to_array("_pc"))
        axes = [(F.col("_pc")[i] * F.lit(s)).alias(AXES[i]) for i, s in enumerate(self.signs)]
        return out.select("filename", *axes)


def fit_pca(embeddings: DataFrame, k: int = 2) -> Projection:
    if k not in (2, 3):
        raise ValueError("projection has 2 or 3 dimensions")
    vectors = embeddings.select(array_to_vector("embedding").alias("_raw"))
    centre = StandardScaler(withMean=True, withStd=False, inputCol="_raw", outputCol="_centred")
    model = Pipeline(stages=[centre, PCA(k=k, inputCol="_centred", outputCol="_pc")]).fit(vectors)
    fitted = model.stages[-1]
    loadings = fitted.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(k)])
    return Projection(model, [float(s) for s in signs], [float(v) for v in fitted.explainedVariance.toArray()])


def pca_project(embeddings: DataFrame, k: int = 2) -> DataFrame:
    """``(filename, x, y[, z])``: centred embeddings on their first components."""
    return fit_pca(embeddings, k).transform(embeddings)


def pca_variance(embeddings: DataFrame, k: int = 2) -> DataFrame:
    """Share of the variance along each component."""
    ratios = fit_pca(embeddings, k).variance
    return embeddings.sparkSession.createDataFrame(list(enumerate(ratios)), "component int, ratio double")


def projection_table(embeddings: DataFrame, clusters: DataFrame, k: int = 2) -> DataFrame:
    """Projected coordinates with the cluster of each clip."""
    return align(pca_project(embeddings, k), clusters.select("filename", "cluster"))
