"""Price models: priors, indices, blends, metrics and rule tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwise.operators import estimates
from lotwise.plans import Registry
from lotwise.plans.market import COMPS, HEADERS, SALES, YEARS, beside_artist, probes_of
from lotwise.sources.tables import headers, sales, table, works

REGISTRY = Registry()
query = REGISTRY


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales(spark, sf_dir).where("sold and hammer > 0").withColumn("y", F.log(F.col("hammer").cast("double")))


LOGS = f"{SALES}, logs AS (SELECT *, ln(CAST(hammer AS DOUBLE)) AS y FROM sales WHERE sold AND hammer > 0)"


@query(f"""WITH {LOGS}, own AS (SELECT artist, p_type AS technique, avg(y) AS m, count(*) AS n FROM logs JOIN part ON work = p_partkey GROUP BY 1, 2), prior AS (SELECT p_type AS technique, avg(y) AS p FROM logs JOIN part ON work = p_partkey GROUP BY 1)
SELECT artist, technique, n, round((m * n + 20 * p) / (n + 20), 6) AS level FROM own JOIN prior USING (technique)""")
def shrunk_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each artist's level by technique, drawn towards the technique's in so far as it rests on few sales."""
    lots = logs(spark, sf_dir).join(works(spark, sf_dir).select("work", "technique"), "work")
    own = lots.groupBy("artist", "technique").agg(F.avg("y").alias("m"), F.count("*").alias("n"))
    prior = lots.groupBy("technique").agg(F.avg("y").alias("p"))
    return own.join(prior, "technique").select("artist", "technique", "n", F.round(estimates.shrunk(F.col("m"), F.col("n"), F.col("p"), 20.0), 6).alias("level"))


@query(f"""WITH {LOGS}, a AS (SELECT artist, avg(y) AS level, count(*) AS n FROM logs GROUP BY 1) SELECT n_regionkey AS segment, count(*) AS artists, round(sum(sqrt(n) * level) / sum(sqrt(n)), 6) AS level FROM a JOIN supplier ON artist = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""")
def segment_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of segments, artists weighted by the root of their sales."""
    a = logs(spark, sf_dir).groupBy("artist").agg(F.avg("y").alias("level"), F.count("*").alias("n"))
    places = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("artist"), F.col("n_regionkey").alias("segment"))
    return a.join(places, "artist").groupBy("segment").agg(F.count("*").alias("artists"), F.round(F.sum(F.sqrt("n") * F.col("level")) / F.sum(F.sqrt("n")), 6).alias("level"))


@query()
def repeat_sales_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price by year relative to 1995, each work's own level taken out."""
    lots = logs(spark, sf_dir).withColumn("year", F.year("sale_date"))
    return estimates.within_effects(lots, "work", "y", "year", 1995).select("year", F.round("effect", 6).alias("effect"), F.round(F.exp("effect"), 6).alias("index"))


@query(f"""WITH {LOGS}, x AS (SELECT y, edition, premium FROM logs) SELECT round(regr_slope(y, edition), 8) AS slope, round(regr_intercept(y, edition), 6) AS intercept, count(*) AS n FROM x""")
def size_price_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log price by edition size."""
    lots = logs(spark, sf_dir)
    intercept, slope = estimates.pooled_line(lots, ["edition"], "y")
    return lots.agg(F.lit(round(slope, 8)).alias("slope"), F.lit(round(intercept, 6)).alias("intercept"), F.count("*").alias("n"))


BLENDED = f"""{COMPS}, b AS (SELECT probe, tier, median(ln(CAST(hammer AS DOUBLE))) AS mu, stddev_samp(ln(CAST(hammer AS DOUBLE))) AS sd, count(*) AS n FROM found GROUP BY 1, 2),
w AS (SELECT probe, mu, greatest(0.2, coalesce(sd, 0.8) / sqrt(n)) AS sigma, CASE tier WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS weight FROM b),
m AS (SELECT probe, sum(weight * mu) / sum(weight) AS mean, count(*) AS n, sqrt(sum(weight * pow(mu, 2)) / sum(weight) - pow(sum(weight * mu) / sum(weight), 2)) AS apart, sum(weight * sigma) / sum(weight) AS own FROM w GROUP BY 1),
g AS (SELECT m.probe, i, any_value(mean) AS mean, -sum(weight * (ln(sigma) + 3 * ln(1 + pow((mean - 4 + i * (8.0::DOUBLE / 600) - mu) / sigma, 2) / 5))) AS l FROM m JOIN w USING (probe), range(601) r(i) GROUP BY 1, 2),
d AS (SELECT *, exp(l - max(l) OVER (PARTITION BY probe)) AS v FROM g), c AS (SELECT *, sum(v) OVER (PARTITION BY probe ORDER BY i) AS cum, sum(v) OVER (PARTITION BY probe) AS total FROM d),
q AS (SELECT probe, {', '.join(f"exp(min(mean - 4 + (i + 0.5::DOUBLE) * (8.0::DOUBLE / 600) - (8.0::DOUBLE / 600) * (cum - {q} * total) / v) FILTER (cum >= {q} * total AND cum - v < {q} * total)) AS {n}" for n, q in (('p10', 0.1), ('median', 0.5), ('p90', 0.9)))} FROM c GROUP BY 1)"""


@query(f"WITH {BLENDED.removeprefix('WITH ')} SELECT probe, n, round(median, 4) AS median, round(p10, 4) AS p10, round(p90, 4) AS p90, round(coalesce(apart, 0) / own, 4) AS divergence FROM m JOIN q USING (probe)")
def blended_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A price with its range for each work, from its own, its artist's and its technique's earlier sales."""

    def rows(p: dict[str, np.ndarray], i: int, own: tuple, others: tuple) -> list[tuple]:
        (_, h0), (_, h, same, _) = own, others
        out = []
        for tier, prices in enumerate((h0, h[same], h[~same])):
            if len(prices):
                y = np.log(prices[prices > 0])
                out.append((p["probe"][i], tier, float(np.median(y)) if len(y) else None, float(y.std(ddof=1)) if len(y) > 1 else None, len(prices)))
        return out

    small, large = beside_artist(spark, sf_dir, rows, "probe long, tier int, mu double, sd double, n long")
    y = F.log(F.col("hammer").cast("double"))
    by = small.unionByName(large.groupBy("probe", "tier").agg(estimates.median(y).alias("mu"), F.stddev_samp(y).alias("sd"), F.count("*").alias("n")))
    witnesses = by.select("probe", "mu", F.greatest(F.lit(0.2), F.coalesce("sd", F.lit(0.8)) / F.sqrt("n")).alias("sigma"), F.element_at(F.array(F.lit(1.0), F.lit(0.5), F.lit(0.25)), F.col("tier") + 1).alias("weight"))
    return estimates.blend(witnesses, "probe").select("probe", "n", *(F.round(c, 4).alias(c) for c in ("median", "p10", "p90", "divergence")))


@query(f"""WITH {LOGS}, d AS (SELECT artist, sale_date, sum(y) AS s, count(*) AS c FROM logs GROUP BY 1, 2), k AS (SELECT artist, sale_date, sum(s) OVER w / sum(c) OVER w AS mu FROM d WINDOW w AS (PARTITION BY artist ORDER BY sale_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)),
e AS (SELECT CAST(year(sale_date) AS INTEGER) AS year, y - mu AS e FROM logs JOIN k USING (artist, sale_date) WHERE mu IS NOT NULL)
SELECT year, count(*) AS n, round(avg(abs(e)), 6) AS mae, round(avg(CASE WHEN abs(e) <= ln(2) THEN 1.0 ELSE 0.0 END), 6) AS within_double, round(exp(avg(e)), 6) AS ratio FROM e GROUP BY 1""")
def error_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of an artist's mean level over strictly earlier sales as a forecast, by year."""
    lots = logs(spark, sf_dir)
    days = lots.groupBy("artist", "sale_date").agg(F.sum("y").alias("s"), F.count("*").alias("c"))
    w = Window.partitionBy("artist").orderBy(F.unix_date("sale_date")).rangeBetween(Window.unboundedPreceding, -1)
    known = days.select("artist", "sale_date", (F.sum("s").over(w) / F.sum("c").over(w)).alias("mu")).where("mu IS NOT NULL")
    off = lots.join(known, ["artist", "sale_date"]).select(F.year("sale_date").alias("year"), (F.col("y") - F.col("mu")).alias("e"))
    return off.groupBy("year").agg(F.count("*").alias("n"), F.round(F.avg(F.abs("e")), 6).alias("mae"), F.round(F.avg((F.abs("e") <= F.log(F.lit(2.0))).cast("double")), 6).alias("within_double"), F.round(F.exp(F.avg("e")), 6).alias("ratio"))


@query("""WITH r AS (SELECT toxic, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS r FROM labels JOIN documents USING (doc_id))
SELECT round((sum(r) FILTER (toxic = 1) - count(*) FILTER (toxic = 1) * (count(*) FILTER (toxic = 1) + 1) / 2.0) / (count(*) FILTER (toxic = 1) * count(*) FILTER (toxic = 0)), 6) AS auc, count(*) FILTER (toxic = 1) AS positives, count(*) FILTER (toxic = 0) AS negatives FROM r""")
def length_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well length ranks adjudicated documents."""
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    a = estimates.ranked_area(both, "n_chars", "toxic")
    return a.select(F.round("auc", 6).alias("auc"), F.col("positives").cast("long").alias("positives"), F.col("negatives").cast("long").alias("negatives"))


@query("""WITH x AS (SELECT lang, quality = 1 AS truth, n_chars BETWEEN 400 AND 4000 AS said FROM labels JOIN documents USING (doc_id)), c AS (SELECT lang, count(*) FILTER (truth AND said) AS tp, count(*) FILTER (NOT truth AND said) AS fp, count(*) FILTER (truth AND NOT said) AS fn FROM x GROUP BY lang)
SELECT lang, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c""")
def classifier_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and their mean of a length rule, by language."""
    truth, said = F.col("quality") == 1, F.col("n_chars").between(400, 4000)
    both = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    c = both.groupBy("lang").agg(F.count_if(truth & said).alias("tp"), F.count_if(~truth & said).alias("fp"), F.count_if(truth & ~said).alias("fn"))
    over = lambda a, b: F.round(F.try_divide(a.cast("double"), b), 6)
    return c.select("lang", "tp", "fp", "fn", over(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), over(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), over(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


@query(f"""{COMPS}, s AS (SELECT probe, count(*) FILTER (tier = 0) AS own, count(*) FILTER (tier = 1) AS near, count(*) AS n FROM found GROUP BY 1)
SELECT work AS probe, CASE WHEN own >= 3 THEN 'direct' WHEN own >= 1 AND near >= 3 THEN 'direct_thin' WHEN own >= 1 THEN 'single' WHEN near >= 5 THEN 'technique' WHEN near >= 1 THEN 'technique_thin' WHEN n >= 1 THEN 'artist' ELSE 'none' END AS evidence FROM (SELECT DISTINCT l_partkey AS work FROM lineitem) LEFT JOIN s ON work = probe""")
def evidence_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a valuation of each work would rest on, in seven classes."""

    def rows(p: dict[str, np.ndarray], i: int, own: tuple, others: tuple) -> list[tuple]:
        return [(p["probe"][i], len(own[0]), int(others[2].sum()), len(own[0]) + len(others[0]))]

    small, large = beside_artist(spark, sf_dir, rows, "probe long, own long, near long, n long")
    known = small.unionByName(large.groupBy("probe").agg(F.count_if(F.col("tier") == 0).alias("own"), F.count_if(F.col("tier") == 1).alias("near"), F.count("*").alias("n")))
    own, near, n = (F.coalesce(c, F.lit(0)) for c in ("own", "near", "n"))
    tier = F.when(own >= 3, "direct").when((own >= 1) & (near >= 3), "direct_thin").when(own >= 1, "single").when(near >= 5, "technique").when(near >= 1, "technique_thin").when(n >= 1, "artist").otherwise("none")
    return sales(spark, sf_dir).select(F.col("work").alias("probe")).distinct().join(known, "probe", "left").select("probe", tier.alias("evidence"))


@query(f"""WITH {HEADERS}, {SALES} SELECT house, round(ln(CAST(sum(hammer) FILTER (sold) AS DOUBLE) / count(*)), 6) AS yield, round(avg(CASE WHEN sold THEN 1.0 ELSE 0.0 END), 6) AS chance, CASE WHEN avg(CASE WHEN sold THEN 1.0 ELSE 0.0 END) >= 0.67 THEN 'liquid' ELSE 'thin' END AS verdict FROM sales JOIN headers USING (sale) GROUP BY 1""")
def liquidity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance of a sale and yield a lot offered, by house."""
    lots = sales(spark, sf_dir).join(headers(spark, sf_dir).select("sale", "house"), "sale")
    chance = F.avg(F.col("sold").cast("double"))
    return lots.groupBy("house").agg(F.round(F.log(F.sum(F.when(F.col("sold"), F.col("hammer"))).cast("double") / F.count("*")), 6).alias("yield"), F.round(chance, 6).alias("chance"), F.when(chance >= 0.67, "liquid").otherwise("thin").alias("verdict"))


@query("""SELECT p_partkey AS work, coalesce(CASE WHEN p_size > 40 THEN 'catalogue' END, CASE WHEN p_retailprice > 1500 THEN 'appraiser' END, CASE WHEN p_type = 'PROMO' THEN 'image' END, 'default') AS source,
 CASE WHEN p_size > 40 AND p_type = 'PROMO' THEN 'agrees' WHEN p_size > 40 AND p_type = 'SMALL' THEN 'diverges' ELSE 'unassessable' END AS verdict FROM part""")
def precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which source a value comes from, in a fixed order, and whether two facets agree."""
    w = works(spark, sf_dir)
    large = F.col("size") > 40
    source = F.coalesce(F.when(large, "catalogue"), F.when(F.col("list_price") > 1500, "appraiser"), F.when(F.col("technique") == "PROMO", "image"), F.lit("default"))
    verdict = F.when(large & (F.col("technique") == "PROMO"), "agrees").when(large & (F.col("technique") == "SMALL"), "diverges").otherwise("unassessable")
    return w.select("work", source.alias("source"), verdict.alias("verdict"))


@query(f"""WITH {LOGS}, m AS (SELECT avg(edition) AS me, avg(premium) AS mp, var_pop(edition) AS s11, var_pop(premium) AS s22, covar_pop(edition, premium) AS s12, covar_pop(edition, y) AS s1y, covar_pop(premium, y) AS s2y FROM logs),
b AS (SELECT me, mp, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM m)
SELECT work, round(avg(b1 * (edition - me)), 6) AS edition_effect, round(avg(b2 * (premium - mp)), 6) AS premium_effect FROM logs, b GROUP BY work""")
def waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What edition and premium add to each work's log price against the corpus mean, by a fit of both; means and slopes are one row."""
    lots = logs(spark, sf_dir)
    _, b1, b2 = estimates.pooled_line(lots, ["edition", "premium"], "y")
    means = lots.agg(F.avg("edition").alias("me"), F.avg("premium").alias("mp"))
    return lots.crossJoin(F.broadcast(means)).groupBy("work").agg(F.round(F.avg(b1 * (F.col("edition") - F.col("me"))), 6).alias("edition_effect"), F.round(F.avg(b2 * (F.col("premium") - F.col("mp"))), 6).alias("premium_effect"))
