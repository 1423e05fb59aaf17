"""Learning on Spark: group splits, running sums, neighbours on a grid, clusters, projections and library models."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.operators.durable import durable


def stratified_groups(counts: DataFrame, group: str, label: str, n: str, folds: int) -> DataFrame:
    """``group, fold``: groups dealt so that each label spreads over the folds.

    Groups are ordered by their scarcest label and, within it, by size, and dealt out back and forth; the order is taken
    within each scarcest label, so the largest task holds the groups of one label.
    """
    total = F.sum(n).over(Window.partitionBy(label))
    scarce = counts.withColumn("_t", total).groupBy(group).agg(F.min_by(label, F.struct("_t", label)).alias("_scarce"), F.sum(n).alias("_n"))
    place = F.row_number().over(Window.partitionBy("_scarce").orderBy(F.desc("_n"), group)) - 1
    turn = F.pmod(place, F.lit(2 * folds))
    return scarce.select(group, F.least(turn, 2 * folds - 1 - turn).cast("int").alias("fold"))


def running_sums(df: DataFrame, order: str, columns: list[str], parts: int = 64) -> DataFrame:
    """``df`` with ``sum_c``, the running sum of each column from the highest ``order`` down, and ``all_c``.

    Rows are cut into ranges of the order, each summed by itself; the totals of the ranges above are added back, so no
    task holds more than a range.  Values of ``order`` must be distinct numbers.
    """
    ends = df.agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / parts + F.lit(1e-9)
    cut = df.crossJoin(F.broadcast(ends)).withColumn("_r", F.least(F.floor((F.col("_hi") - F.col(order)) / width), F.lit(parts - 1)).cast("int")).drop("_lo", "_hi")
    ranges = cut.groupBy("_r").agg(*(F.sum(c).alias(f"_t_{c}") for c in columns))
    w = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # at most ``parts`` rows
    above = ranges.select("_r", *(F.coalesce(F.sum(f"_t_{c}").over(w), F.lit(0)).alias(f"_a_{c}") for c in columns), *(F.sum(f"_t_{c}").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(f"all_{c}") for c in columns))
    own = Window.partitionBy("_r").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    joined = cut.join(F.broadcast(above), "_r")
    return joined.select(*df.columns, *((F.sum(c).over(own) + F.col(f"_a_{c}")).alias(f"sum_{c}") for c in columns), *(f"all_{c}" for c in columns))


def nearest(df: DataFrame, key: str, weights: dict[str, float], k: int) -> DataFrame:
    """``key, donor, rank, distance``: the ``k`` nearest others by weighted Euclidean distance, ties to the smaller key.

    Rows lie on a grid; one whose ``k`` are found within the ring of cells around its own is done once its ``k``-th is no
    farther than the ring's edge.  The others go on with cells twice as wide, so every answer is exact; the last round,
    when few rows are left to ask or the grid is one cell, compares those with all.
    """
    scaled = df.select(F.col(key).alias("_k"), *((F.col(c) * math.sqrt(w)).alias(c) for c, w in weights.items()))
    count = scaled.count()
    side = 8.0 / max(1.0, (count / (2 * k)) ** (1 / len(weights)))
    asking, done = scaled, None
    distance = F.sqrt(sum(((F.col(f"x_{c}") - F.col(f"y_{c}")) ** 2 for c in weights), F.lit(0.0)))
    while True:
        last = side > 64
        cell = lambda c, s=side: F.floor(F.col(c) / s) if not last else F.lit(0)  # noqa: E731, B023
        around = F.explode(F.array(F.lit(0)) if last else F.array(F.lit(-1), F.lit(0), F.lit(1)))
        left = asking.select(F.col("_k").alias("_x"), *(F.col(c).alias(f"x_{c}") for c in weights), *(cell(c).alias(f"_c_{c}") for c in weights))
        for c in weights:
            left = left.withColumn("_d", around).withColumn(f"_c_{c}", F.col(f"_c_{c}") + F.col("_d")).drop("_d")
        right = scaled.select(F.col("_k").alias("_y"), *(F.col(c).alias(f"y_{c}") for c in weights), *(cell(c).alias(f"_c_{c}") for c in weights))
        pairs = left.join(right, [f"_c_{c}" for c in weights]).where("_x <> _y").select("_x", "_y", distance.alias("_d"))
        rank = F.row_number().over(Window.partitionBy("_x").orderBy(F.round("_d", 9), "_y"))
        top = pairs.withColumn("rank", rank).where(F.col("rank") <= k)
        whole = Window.partitionBy("_x")
        ready = top.withColumn("_far", F.max("_d").over(whole)).withColumn("_n", F.count("*").over(whole))
        ready = ready if last else ready.where((F.col("_n") == k) & (F.col("_far") < side))
        ready = ready.select(F.col("_x").alias(key), F.col("_y").alias("donor"), "rank", F.col("_d").alias("distance")).persist()
        done = ready if done is None else done.unionByName(ready)
        if last:
            return done
        asking = asking.join(ready.select(F.col(key).alias("_k")).distinct(), "_k", "left_anti")
        if not asking.take(1):
            return done
        side *= 2


def as_vector(c: str) -> Column:
    from pyspark.ml.functions import array_to_vector

    return array_to_vector(F.col(c).cast("array<double>"))


def clusters(df: DataFrame, key: str, vector: str, k: int, starts: int = 3) -> DataFrame:
    """``key, cluster, silhouette``: k-means by cosine, the start with the best silhouette; nulls take no part."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator

    rows = df.where(F.col(vector).isNotNull()).select(key, as_vector(vector).alias("features")).persist()
    best = None
    for seed in range(starts):
        found = KMeans(k=k, seed=seed, distanceMeasure="cosine", featuresCol="features", predictionCol="cluster").fit(rows).transform(rows)
        score = ClusteringEvaluator(predictionCol="cluster", featuresCol="features", distanceMeasure="cosine").evaluate(found)
        if best is None or score > best[0]:
            best = (score, found)
    return best[1].select(key, "cluster", F.lit(round(best[0], 6)).alias("silhouette"))


def random_projection(edges: DataFrame, width: int, rounds: int, seed: int) -> DataFrame:
    """``a, embedding``: nodes on the ``a`` side of a two-sided graph by averages of sparse random vectors of their partners.

    A partner's vector has 0, 1 or -1 in each place by a hash, so none is stored; each round averages over the other side
    and back.  Vectors have length 1.
    """
    start = F.array(*(F.element_at(F.array(*(F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, 0.0, -1.0))), (F.pmod(F.xxhash64("b", F.lit(seed), F.lit(i)), F.lit(6)) + 1).cast("int")) for i in range(width)))
    mean = lambda c: F.array(*(F.avg(F.col(c)[i]) for i in range(width)))
    side = edges.select("a", start.alias("v")).groupBy("a").agg(mean("v").alias("v"))
    for _ in range(rounds - 1):
        other = edges.join(side, "a").groupBy("b").agg(mean("v").alias("v"))
        side = edges.join(other, "b").groupBy("a").agg(mean("v").alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return side.withColumn("n", length).select("a", F.transform("v", lambda x: F.round(F.when(F.col("n") > 0, x / F.col("n")).otherwise(0.0), 6)).alias("embedding"))


#: Combinations of features that a task of a fit holds.
COMBINED = 20_000


def boosted(df: DataFrame, features: list[str], target: str, training: Column, trees: int = 10) -> DataFrame:
    """``left_out, mae, within_double``: errors on the rest of a model fitted to ``training``, with all features and without each.

    Rows of equal features become one with their number as weight and the mean of their targets: squared errors within them
    are the same whatever the trees, so sums of residuals and gains of splits are those of the rows.  Each combination of
    features is predicted once by all models, and errors are taken for every row in one pass.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    def combined(rows: DataFrame, *more: Column) -> DataFrame:
        found = durable(rows.groupBy(*features).agg(F.count("*").cast("double").alias("_w"), *more))
        return durable(found.repartition(found.count() // COMBINED + 1, *features).sortWithinPartitions(*features))

    rest, leave_out = df.where(~training), ("", *features)
    known, asked = combined(df.where(training), F.avg(target).alias("_y")), combined(rest)
    for k, out in enumerate(leave_out):
        taken = VectorAssembler(inputCols=[f for f in features if f != out], outputCol="_x")
        model = GBTRegressor(featuresCol="_x", labelCol="_y", weightCol="_w", predictionCol=f"_p{k}", maxIter=trees, maxDepth=3, seed=1).fit(taken.transform(known))
        asked = model.transform(taken.transform(asked)).drop("_x")
    same = [rest[f].eqNullSafe(F.col(f"_f_{f}")) for f in features]
    both = rest.join(asked.select(*(F.col(f).alias(f"_f_{f}") for f in features), *(f"_p{k}" for k in range(len(leave_out)))), same)
    errors = [F.abs(F.col(f"_p{k}") - F.col(target)) for k in range(len(leave_out))]
    r = both.agg(*(F.avg(e).alias(f"mae{k}") for k, e in enumerate(errors)), *(F.avg((e <= math.log(2)).cast("double")).alias(f"w{k}") for k, e in enumerate(errors))).first()
    whole = lambda v: round(v, 6) if v is not None else None
    return df.sparkSession.createDataFrame([(out, whole(r[f"mae{k}"]), whole(r[f"w{k}"])) for k, out in enumerate(leave_out)], "left_out string, mae double, within_double double")


def two_stage(df: DataFrame, key: str, vector: str, family: str, kind: str) -> DataFrame:
    """``stage, n, accuracy`` on the fifth of rows held out by a hash: families, kinds at once, kinds within the found family."""
    from pyspark.ml.classification import LogisticRegression

    rows = df.where(F.col(vector).isNotNull()).select(key, as_vector(vector).alias("x"), F.col(family).cast("double").alias("f"), F.col(kind).cast("double").alias("k"), (F.pmod(F.xxhash64(key), F.lit(5)) == 0).alias("held")).persist()
    learn, held = rows.where("NOT held"), rows.where("held")
    model = lambda label, r: LogisticRegression(featuresCol="x", labelCol=label, predictionCol="p", regParam=0.01, maxIter=30).fit(r)
    drop = ("p", "rawPrediction", "probability")
    found = model("f", learn).transform(held).withColumnRenamed("p", "pf").drop(*drop)
    flat = model("k", learn).transform(held)
    parts = [model("k", learn.where(F.col("f") == r.f)).transform(found.where(F.col("pf") == r.f)) for r in learn.select("f").distinct().orderBy("f").collect()]  # families are few
    staged = parts[0]
    for p in parts[1:]:
        staged = staged.unionByName(p)
    share = lambda r, a, b, s: r.agg(F.lit(s).alias("stage"), F.count("*").alias("n"), F.round(F.avg((F.col(a) == F.col(b)).cast("double")), 6).alias("accuracy"))
    return share(found, "pf", "f", "family").unionByName(share(flat, "p", "k", "at once")).unionByName(share(staged, "p", "k", "within family"))
