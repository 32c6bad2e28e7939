"""Vector scaling, projection and clustering (pyspark.ml where it has the method)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.functions import arrays as A
from kinloom.session import settle


def standardize(df: DataFrame, vector: str = "vec", name: str = "scaled") -> DataFrame:
    """Per-dimension z-score with the population deviation; a flat dimension is only centred."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    values = A.as_doubles(F.col(vector))
    summary = Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(values))
    one = df.agg(summary.alias("s"))
    n = F.col("s.count").cast("double")
    stats = one.select(
        F.struct(
            vector_to_array("s.mean").alias("mean"),
            F.transform(vector_to_array("s.variance"), lambda v: F.sqrt(v * (n - 1) / n)).alias("std"),
        )
    ).scalar()
    centred = F.zip_with(values, F.col("_stats")["mean"], lambda v, m: v - m)
    scaled = F.zip_with(centred, F.col("_stats")["std"], lambda v, s: F.when(s > 0, v / s).otherwise(v))
    return df.withColumn("_stats", stats).withColumn(name, scaled).drop("_stats")


def pca(df: DataFrame, k: int, vector: str = "vec", name: str = "pcs", scale: bool = True) -> DataFrame:
    """First k principal components of all rows together."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    base = standardize(df, vector, "_scaled") if scale else df.withColumn("_scaled", A.as_doubles(F.col(vector)))
    base = base.withColumn("_v", array_to_vector("_scaled"))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(base)
    return model.transform(base).withColumn(name, vector_to_array("_p")).drop("_scaled", "_v", "_p")


def landmarks_of(df: DataFrame, order: str, n: int, vector: str = "vec") -> DataFrame:
    """n rows in a hash order of the key: a bounded set that the feature itself asks for, spread over all ids."""
    return df.orderBy(F.md5(F.col(order).cast("string")), order).limit(n).select(F.col(order).alias("landmark"), A.as_doubles(F.col(vector)).alias("lv"))


def farthest_landmarks(df: DataFrame, key: str, n: int, vector: str = "vec", settle_every: int = 10) -> DataFrame:
    """n rows that cover the others well: each is the farthest one from those before it (Gonzalez 1985).

    The largest distance from a row to its nearest landmark is at most twice the least possible
    one. The first landmark has the smallest key, ties go to it, too; equal vectors are taken
    once. A round is one aggregate; the distances so far are written now and then.
    """
    rows = df.where(F.col(vector).isNotNull()).select(F.col(key).alias("landmark"), A.as_doubles(F.col(vector)).alias("lv"))
    first = rows.orderBy("landmark").limit(1).collect()
    found = [(r["landmark"], list(r["lv"])) for r in first]
    state, new = settle(rows.withColumn("_d", F.lit(float("inf")))), found[:]
    while found and len(found) < n:
        nearest = [A.squared_distance(F.col("lv"), F.array(*[F.lit(float(v)) for v in lv])) for _, lv in new]
        state = state.withColumn("_d", F.least("_d", *nearest))
        if len(found) % settle_every == 0:
            state = settle(state)
        far = state.agg(F.max_by(F.struct("landmark", "lv", "_d"), F.struct("_d", F.struct("landmark")))).first()[0]
        if far["_d"] <= 0:
            break
        new = [(far["landmark"], list(far["lv"]))]
        found += new
    return df.sparkSession.createDataFrame(found, rows.schema) if found else rows.limit(0)


def pairwise_distance(df: DataFrame, landmarks: DataFrame, key: str, vector: str = "vec") -> DataFrame:
    """Euclidean distance of every row to each landmark of a bounded set (at most a few hundred)."""
    marks = landmarks.agg(F.sort_array(F.collect_list(F.struct("landmark", "lv")))).scalar()
    near = df.withColumn("_marks", marks).select(
        key, A.as_doubles(F.col(vector)).alias("_v"), F.explode("_marks").alias("m")
    )
    return near.select(
        key, F.col("m.landmark").alias("landmark"), A.distance(F.col("_v"), F.col("m.lv")).alias("distance")
    )


def project_2d(
    df: DataFrame, key: str, vector: str = "vec", method: str = "pca", n_landmarks: int = 100, digits: int = 4, choice: str = "farthest"
) -> DataFrame:
    """Two coordinates per row, in one space for all rows.

    ``pca`` takes the first two components. ``landmark`` is landmark MDS (de Silva and
    Tenenbaum 2004): the landmark distances, a matrix of fixed size, are solved once and
    every row is placed by a linear expression of its squared distances to them. ``choice``
    of landmarks: ``farthest`` (a round for each, covers the data) or ``hash`` (one pass).
    """
    if method == "pca":
        p = pca(df, 2, vector, "_xy")
        return p.select(
            *df.columns, F.round(F.col("_xy")[0], digits).alias("x"), F.round(F.col("_xy")[1], digits).alias("y")
        )
    if method != "landmark":
        raise ValueError(f"unknown method {method!r}")
    chosen = {"farthest": farthest_landmarks, "hash": landmarks_of}[choice](df, key, n_landmarks, vector)
    marks = [np.array(r["lv"]) for r in chosen.orderBy("landmark").collect()]
    m = np.stack(marks)
    d2 = ((m[:, None, :] - m[None, :, :]) ** 2).sum(axis=2)
    centre = np.eye(len(m)) - 1.0 / len(m)
    values, vectors = np.linalg.eigh(-0.5 * centre @ d2 @ centre)
    top = np.argsort(values)[::-1][:2]
    signs = np.where(vectors[np.abs(vectors[:, top]).argmax(axis=0), top] < 0, -1.0, 1.0)
    pseudo = (vectors[:, top] * signs) / np.sqrt(np.maximum(values[top], 1e-12))
    mean_d2 = d2.mean(axis=0)
    fixed_marks = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in m])
    deltas = F.transform(fixed_marks, lambda lv: A.squared_distance(A.as_doubles(F.col(vector)), lv))
    centred = F.zip_with(deltas, F.array(*[F.lit(float(v)) for v in mean_d2]), lambda d, mu: d - mu)
    placed = df.withColumn("_delta", centred)
    for i, name in enumerate(("x", "y")):
        weights = F.array(*[F.lit(float(v)) for v in pseudo[:, i]])
        placed = placed.withColumn(name, F.round(-0.5 * A.dot(F.col("_delta"), weights), digits))
    return placed.drop("_delta")


def kmeans_auto(
    df: DataFrame, vector: str = "vec", k_max: int = 10, seed: int = 0, criterion: str = "silhouette", name: str = "cluster"
) -> DataFrame:
    """k-means with k chosen in [2, min(k_max, n/5)] by silhouette or by BIC."""
    from pyspark.ml.clustering import BisectingKMeans, KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    base = df.withColumn("_v", array_to_vector(A.as_doubles(F.col(vector)))).persist()
    try:
        n = base.count()
        upper = min(k_max, max(2, n // 5))
        best, best_score = None, -float("inf")
        for k in range(2, upper + 1):
            if criterion == "bic":
                model = BisectingKMeans(k=k, seed=seed, featuresCol="_v", predictionCol=name).fit(base)
                score = -_bic(model, n)
            else:
                model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol=name).fit(base)
                if len(model.clusterCenters()) < 2:
                    continue
                score = ClusteringEvaluator(featuresCol="_v", predictionCol=name).evaluate(model.transform(base))
            if score > best_score:
                best, best_score = model, score
    finally:
        base.unpersist()
    fresh = df.withColumn("_v", array_to_vector(A.as_doubles(F.col(vector))))
    return best.transform(fresh).drop("_v")


def _bic(model, n: int) -> float:
    """Spherical-Gaussian BIC from the summed squared error."""
    centres = model.clusterCenters()
    k, d = len(centres), len(centres[0])
    variance = max(model.summary.trainingCost / max(1, (n - k) * d), 1e-12)
    return n * d * np.log(variance) + k * (d + 1) * np.log(n)


def quantize_coords(df: DataFrame, columns: tuple[str, ...] = ("x", "y"), digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})
