"""Upkeep of derived layers, and names and titles compared for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwise.functions import strings, text
from lotwise.operators import layers
from lotwise.plans import Registry
from lotwise.plans.textual import KEYED
from lotwise.sources.tables import sales, table, works

REGISTRY = Registry()
query = REGISTRY


@query("""WITH l AS (SELECT user_id, event_type, strftime(ts, '%Y-%m-%d') AS run, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2, 3)
SELECT user_id, event_type, run, n, round(total, 4) AS total FROM l QUALIFY run = max(run) OVER (PARTITION BY user_id, event_type)""")
def current_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the newest run of each user and kind of event derived."""
    runs = table(spark, sf_dir, "events").groupBy("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("run")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return layers.current(runs, ["user_id", "event_type"]).select("user_id", "event_type", "run", "n", "total")


@query("""WITH c AS (SELECT p_partkey, p_brand, p_retailprice AS old, CASE WHEN p_size > 25 THEN round(p_retailprice * 1.1, 2) WHEN p_type = 'PROMO' AND p_brand IN ('Brand#3', 'Brand#7') THEN -1 ELSE p_retailprice END AS new FROM part), b AS (SELECT p_brand, count(*) FILTER (new <= 0 OR new > old * 2) AS broken FROM c GROUP BY 1)
SELECT p_brand AS series, count(*) AS works, any_value(broken) AS broken, any_value(broken) = 0 AS applied, round(sum(CASE WHEN broken = 0 THEN new ELSE old END), 2) AS total FROM c JOIN b USING (p_brand) GROUP BY 1""")
def verified_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned prices, applied to a series only if none of its rows breaks a rule; the others keep the old ones."""
    p = table(spark, sf_dir, "part").select("p_brand", F.col("p_retailprice").alias("old"), F.expr("CASE WHEN p_size > 25 THEN round(p_retailprice * 1.1, 2) WHEN p_type = 'PROMO' AND p_brand IN ('Brand#3', 'Brand#7') THEN -1 ELSE p_retailprice END").alias("new"))
    by = p.groupBy(F.col("p_brand").alias("series")).agg(F.count("*").alias("works"), F.count_if((F.col("new") <= 0) | (F.col("new") > F.col("old") * 2)).alias("broken"), F.sum("new").alias("n"), F.sum("old").alias("o"))
    return by.select("series", "works", "broken", (F.col("broken") == 0).alias("applied"), F.round(F.when(F.col("broken") == 0, F.col("n")).otherwise(F.col("o")), 2).alias("total"))


@query("""SELECT l_partkey AS work, count(*) AS lots FROM lineitem WHERE l_suppkey = 3 AND l_shipdate >= DATE '1997-01-01' GROUP BY 1""")
def guarded_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lots of an artist from a date on; a search that names neither artist nor work is refused."""
    given = layers.constrained({"artist": 3, "work": None, "since": "1997-01-01"}, {"artist", "work"})
    lots = sales(spark, sf_dir)
    for name in ("artist", "work"):
        lots = lots.where(F.col(name) == given[name]) if name in given else lots
    return lots.where(F.col("sale_date") >= F.lit(given["since"]).cast("date")).groupBy("work").agg(F.count("*").alias("lots"))


SHARING = """t AS (SELECT DISTINCT p_name AS t FROM part), w AS (SELECT t, unnest(string_split(t, ' ')) AS word FROM t), p AS (SELECT DISTINCT x.t AS a, y.t AS b FROM w x JOIN w y USING (word) WHERE x.t < y.t)"""
BEST_SQL = "list_avg(list_transform(string_split({a}, ' '), lambda x: list_max(list_transform(string_split(b, ' '), lambda y: jaro_winkler_similarity(x, y)))))"
TURNED = "array_to_string(list_reverse(string_split(a, ' ')), ' ')"


def sharing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of titles that share a word."""
    words = works(spark, sf_dir).select("title").distinct().withColumn("word", F.explode(F.split("title", " ")))
    return words.withColumnRenamed("title", "a").join(words.withColumnRenamed("title", "b"), "word").where("a < b").select("a", "b").distinct()


@query(f"""WITH {SHARING} SELECT a, b, round(greatest(0.55 * {BEST_SQL.format(a='a')} + 0.45 * jaro_winkler_similarity(a, b), 0.55 * {BEST_SQL.format(a='a')} + 0.45 * jaro_winkler_similarity({TURNED}, b)), 6) AS score FROM p""")
def name_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names compared by their words and as a whole, as they are and turned round, the better counting."""
    return sharing(spark, sf_dir).select("a", "b", F.round(strings.name_score_of("a", "b"), 6).alias("score"))


@query()
def sequence_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of two titles that lies in matching runs."""
    return sharing(spark, sf_dir).select("a", "b", F.round(strings.sequence_ratio_of("a", "b"), 6).alias("ratio"))


@query(f"""WITH {SHARING}, k AS (SELECT a, b, list_distinct(string_split({KEYED.format('a')}, ' ')) AS x, list_distinct(string_split({KEYED.format('b')}, ' ')) AS y FROM p) SELECT a, b, round(100 * 2.0 * len(list_intersect(x, y)) / (len(x) + len(y)), 4) AS score, replace(array_to_string(list_sort(x), '-'), ' ', '') = array_to_string(list_sort(y), '-') AS same_slug FROM k WHERE 2.0 * len(list_intersect(x, y)) / (len(x) + len(y)) >= 0.5""")
def title_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles alike by their words, scored to 100, and whether they are the same but for the order of words."""
    k = sharing(spark, sf_dir).select("a", "b", text.tokens(F.col("a")).alias("x"), text.tokens(F.col("b")).alias("y"))
    share = 2.0 * F.size(F.array_intersect("x", "y")) / (F.size("x") + F.size("y"))
    return k.where(share >= 0.5).select("a", "b", F.round(100 * share, 4).alias("score"), (F.array_join("x", "-") == F.array_join("y", "-")).alias("same_slug"))


@query("""WITH t AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), c AS (SELECT a.vec_id, list_cosine_similarity(a.e, b.e) AS c FROM t a JOIN t b ON b.vec_id = a.vec_id - a.vec_id % 10) SELECT vec_id, round(least(greatest((c - 0.72) / (0.96 - 0.72), 0), 1), 6) AS similarity FROM c""")
def rescaled_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosines on the scale of title similarity: 0 up to 0.72, 1 from 0.96 on, against the first of each ten."""
    from lotwise.functions import vectors

    v = table(spark, sf_dir, "embeddings").select("vec_id", vectors.doubles(F.col("embedding")).alias("e"))
    heads = v.where("vec_id % 10 = 0").select(F.col("vec_id").alias("head"), F.col("e").alias("h"))
    c = v.join(heads, F.col("head") == F.col("vec_id") - F.col("vec_id") % 10)
    scaled = (vectors.cosine(F.col("e"), F.col("h")) - 0.72) / (0.96 - 0.72)
    return c.select("vec_id", F.round(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)), 6).alias("similarity"))


GRID = 41


@query(f"""WITH y AS (SELECT l_suppkey AS artist, ln(l_extendedprice) AS y FROM lineitem WHERE l_extendedprice > 0), m AS (SELECT artist, avg(y) AS mu, stddev_pop(y) AS sd FROM y GROUP BY 1), g AS (SELECT artist, i, mu, sd, mu + (i - 20) * 0.2 AS x, exp(-pow((i - 20) * 0.2 / sd, 2) / 2) AS d FROM m, range({GRID}) r(i)),
c AS (SELECT *, sum(d) OVER (PARTITION BY artist ORDER BY i) / sum(d) OVER (PARTITION BY artist) AS cdf FROM g)
SELECT artist, round(min(x) FILTER (cdf >= 0.1), 6) AS p10, round(min(x) FILTER (cdf >= 0.5), 6) AS p50, round(min(x) FILTER (cdf >= 0.9), 6) AS p90, round(sum(pow(cdf - CASE WHEN x >= mu + 0.3 THEN 1 ELSE 0 END, 2) * 0.2), 6) AS crps FROM c GROUP BY 1""")
def grid_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A normal price on a grid of logs: quantiles off its running sum, and the score of an outcome 0.3 above the mean."""
    y = table(spark, sf_dir, "lineitem").where("l_extendedprice > 0").select(F.col("l_suppkey").alias("artist"), F.log("l_extendedprice").alias("y"))
    m = y.groupBy("artist").agg(F.avg("y").alias("mu"), F.stddev_pop("y").alias("sd"))
    g = m.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(GRID - 1)))).withColumn("off", (F.col("i") - 20) * 0.2).withColumn("d", F.exp(-F.pow(F.col("off") / F.col("sd"), F.lit(2)) / 2))
    by = Window.partitionBy("artist")
    c = g.withColumn("cdf", F.sum("d").over(by.orderBy("i")) / F.sum("d").over(by)).withColumn("x", F.col("mu") + F.col("off"))
    first = lambda q: F.round(F.min(F.when(F.col("cdf") >= q, F.col("x"))), 6)
    step = F.when(F.col("x") >= F.col("mu") + 0.3, 1.0).otherwise(0.0)
    return c.groupBy("artist").agg(first(0.1).alias("p10"), first(0.5).alias("p50"), first(0.9).alias("p90"), F.round(F.sum(F.pow(F.col("cdf") - step, F.lit(2)) * 0.2), 6).alias("crps"))
