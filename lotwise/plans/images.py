"""Image match over the vectors of two models, by an inverted-file index.

The fixture has one vector an image; its halves stand for the two models.  Queries are the images whose id is divisible
by 20, against all images.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.operators.durable import checkpoint_dir
from lotwise.operators.inverted import InvertedFile, fused, recall
from lotwise.plans import Registry
from lotwise.sources import sinks
from lotwise.sources.tables import table

REGISTRY = Registry()
query = REGISTRY

#: The models' halves of a vector, how many each ranks, how many the fused list keeps.
MODELS, HALF, RANKED, KEPT = ("shape", "style"), 32, 25, 10


def stored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id`` and a vector for each model."""
    halves = [F.slice("embedding", 1 + i * HALF, HALF).alias(m) for i, m in enumerate(MODELS)]
    return table(spark, sf_dir, "embeddings").select("vec_id", *halves)


RANKS = "WITH v AS (SELECT vec_id, CAST(embedding[1:32] AS DOUBLE[]) AS a, CAST(embedding[33:64] AS DOUBLE[]) AS b FROM embeddings), p AS (SELECT q.vec_id AS query, v.vec_id AS key, round(list_cosine_similarity(q.a, v.a), 9) AS a, round(list_cosine_similarity(q.b, v.b), 9) AS b FROM v q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id), "
RANKS += ", ".join(f"r{m} AS (SELECT query, key, {m} FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY {m} DESC, key) AS n FROM p WHERE NOT isnan({m})) WHERE n <= {RANKED})" for m in "ab")


@query(f"""{RANKS} SELECT query, key, round(a, 6) AS shape, round(b, 6) AS style, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY (a IS NOT NULL AND b IS NOT NULL) DESC, greatest(a, b) DESC, key) AS rank FROM ra FULL JOIN rb USING (query, key)) WHERE rank <= {KEPT}""")
def image_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten images most like each query by two models, those that both rank before the rest; exact."""
    vectors = stored_vectors(spark, sf_dir)
    asked = vectors.where("vec_id % 20 = 0")
    ranked = [InvertedFile.fit(vectors, "vec_id", m, HALF).search(asked, "vec_id", m, RANKED) for m in MODELS]
    return fused(*ranked, KEPT).select("query", "key", F.round("first", 6).alias("shape"), F.round("second", 6).alias("style"), "rank")


@query()
def image_match_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What share of the exact ten nearest each model's fast search finds, reading as many lists as hold 95 % of them for a sample of queries."""
    vectors = stored_vectors(spark, sf_dir)
    asked, out = vectors.where("vec_id % 20 = 0"), None
    for m in MODELS:
        index = InvertedFile.fit(vectors, "vec_id", m, HALF)
        probes = index.probes_for(asked, "vec_id", m, KEPT, 0.95)
        exact, fast = index.search(asked, "vec_id", m, KEPT, probes), index.search(asked, "vec_id", m, KEPT, probes, exact=False)
        row = recall(fast, exact).select(F.lit(m).alias("model"), F.lit(len(index.centroids)).alias("lists"), F.lit(probes).alias("probed"), "queries", "neighbours", F.round("recall", 6).alias("recall"))
        out = row if out is None else out.unionByName(row)
    return out


@query("""SELECT vec_id, label, len(embedding) AS width, round(list_sum(list_transform(embedding, lambda x: CAST(CAST(x AS FLOAT) AS DOUBLE))), 5) AS total FROM embeddings WHERE embedding IS NOT NULL""")
def exported_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as matrices for training elsewhere, and what reading them back gives."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/vectors-{uuid.uuid4().hex}"
    sinks.write_npz(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"), "embedding", path)
    found = sinks.read_npz(spark, path, "embedding", "vec_id long, label int, embedding array<double>")
    return found.select("vec_id", "label", F.size("embedding").cast("long").alias("width"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))
