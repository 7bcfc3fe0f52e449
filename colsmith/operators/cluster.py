"""K-means on one coordinate or a pair of them."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class GeoClusters:
    """Fitted clusters with labels ordered by centre, so that they do not depend on the seed."""

    def __init__(self, columns: list[str], model, order: list[int]):
        self.columns, self.model, self.order = columns, model, order

    def transform(self, df: DataFrame, out: str) -> DataFrame:
        assembler = VectorAssembler(inputCols=[f"__x_{c}" for c in self.columns],
                                    outputCol="__vector", handleInvalid="skip")
        numbers = df
        for c in self.columns:
            numbers = numbers.withColumn(f"__x_{c}", F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
        labelled = self.model.transform(assembler.transform(numbers))
        rank = F.get(F.lit(self.order), F.col("__cluster"))
        known = F.lit(True)
        for c in self.columns:
            known = known & F.col(c).isNotNull()
        return labelled.withColumn(out, F.when(known, rank)).drop(
            "__vector", "__cluster", *[f"__x_{c}" for c in self.columns])


    def certificate(self, df: DataFrame) -> DataFrame:
        """One row that tells whether the clusters fit ``df``: (clusters, rows, nearest_share, largest_shift).

        ``clusters`` are those with rows, ``nearest_share`` is the share of rows with no centre nearer than their own, and
        ``largest_shift`` the largest distance of a centre from its rows' mean, in standard deviations of the coordinate.
        Two jobs of map-side sums; k rows are broadcast.
        """
        centres = [[float(x) for x in c] for c in self.model.clusterCenters()]
        points = [F.col(c).cast("double") for c in self.columns]
        known = df.select(*[p.alias(f"x{i}") for i, p in enumerate(points)], *self.columns).na.drop()
        labelled = self.transform(known, "__label")

        def distance(centre):
            return F.sqrt(sum(((F.col(f"x{i}") - F.lit(v)) * (F.col(f"x{i}") - F.lit(v)) for i, v in enumerate(centre)), F.lit(0.0)))

        own = F.get(F.array(*[distance(centres[old]) for old in sorted(range(len(centres)), key=self.order.__getitem__)]), F.col("__label"))
        best = F.least(*[distance(c) for c in centres]) if len(centres) > 1 else distance(centres[0])
        means = labelled.groupBy("__label").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(own <= best * (1 + 1e-9) + 1e-9).alias("near"), *[F.avg(f"x{i}").alias(f"m{i}") for i in range(len(points))])
        spread = known.agg(*[F.stddev_pop(f"x{i}").alias(f"s{i}") for i in range(len(points))])
        placed = F.lit([centres[old] for old in sorted(range(len(centres)), key=self.order.__getitem__)])
        shifts = [F.abs(F.col(f"m{i}") - F.get(F.get(placed, F.col("__label")), F.lit(i))) / F.when(F.col(f"s{i}") > 0, F.col(f"s{i}")).otherwise(1.0) for i in range(len(points))]
        shift = F.greatest(*shifts) if len(shifts) > 1 else shifts[0]
        return means.crossJoin(F.broadcast(spread)).agg(
            F.count(F.lit(1)).alias("clusters"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), (F.sum("near") / F.sum("n")).alias("nearest_share"), F.max(shift).alias("largest_shift"))


def fit_geo_clusters(df: DataFrame, columns: list[str], n_clusters: int = 10, seed: int = 42, max_iterations: int = 100) -> GeoClusters:
    numbers = df.select(*[F.col(c).cast("double").alias(f"__x_{c}") for c in columns]).na.drop()
    available = numbers.limit(n_clusters).count()
    assembler = VectorAssembler(inputCols=numbers.columns, outputCol="__vector")
    model = KMeans(k=max(1, min(n_clusters, available)), seed=seed, maxIter=max_iterations, featuresCol="__vector",
                   predictionCol="__cluster").fit(assembler.transform(numbers))
    centres = [tuple(float(x) for x in c) for c in model.clusterCenters()]
    by_place = sorted(range(len(centres)), key=lambda i: centres[i])
    order = [0] * len(centres)
    for new, old in enumerate(by_place):
        order[old] = new
    return GeoClusters(columns, model, order)
