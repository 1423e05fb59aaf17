"""Valuation of each work's latest lot: re-based comparables, witnesses, calibration, price and report.

What is known of an artist or a technique before a day comes from running sums over daily totals, so no lot is paired with
the artist's other lots; only sales of the same work are paired.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwise.functions import numbers
from lotwise.operators import estimates, ranges
from lotwise.operators.durable import checkpoint_dir, durable
from lotwise.plans import Registry
from lotwise.plans.market import HEADERS, SALES
from lotwise.plans.pricing import LOGS, logs
from lotwise.sources import sinks
from lotwise.sources.tables import headers, sales, table, works

REGISTRY = Registry()
query = REGISTRY

def at_day(name: str, by: str, rows: str) -> str:
    """SQL of the mean log price of each value of ``by`` before each day that is asked for, from running sums over days."""
    return f"""{name} AS (SELECT v.{by}, d.until, k.s / k.c AS level FROM days d CROSS JOIN (SELECT DISTINCT {by} FROM {rows}) v ASOF JOIN (SELECT {by}, sale_date, sum(s) OVER w AS s, sum(c) OVER w AS c FROM (SELECT {by}, sale_date, sum(y) AS s, count(*) AS c FROM {rows} GROUP BY 1, 2) WINDOW w AS (PARTITION BY {by} ORDER BY sale_date)) k ON k.{by} = v.{by} AND d.until > k.sale_date)"""


#: What houses, years and all sales fetched before a probe's day; nothing of that day or later counts.
LEVELS = f"""{LOGS}, {HEADERS}, priced AS (SELECT l.*, house, estimate, p_type AS technique, CAST(year(sale_date) AS INTEGER) AS year, 1 AS everything FROM logs l JOIN headers USING (sale) JOIN part ON work = p_partkey),
probes AS (SELECT * FROM (SELECT p.*, sale_date AS until, row_number() OVER (PARTITION BY work ORDER BY sale_date DESC, sale DESC, lot DESC, hammer DESC, artist DESC) AS k FROM priced p) WHERE k = 1),
days AS (SELECT DISTINCT until FROM probes), {at_day('house_at', 'house', 'priced')}, {at_day('year_at', 'year', 'priced')}, {at_day('all_at', 'everything', 'priced')}"""


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sold lots with log price ``y``, house, estimate, technique and year."""
    return logs(spark, sf_dir).join(headers(spark, sf_dir).select("sale", "house", "estimate"), "sale").join(works(spark, sf_dir).select("work", "technique"), "work").withColumn("year", F.year("sale_date"))


def settled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Priced lots and each work's latest, computed once for all that a valuation reads of them."""
    lots = durable(priced(spark, sf_dir).select("work", "artist", "technique", "house", "estimate", "sale_date", "year", "sale", "lot", "hammer", "y"))
    return lots, durable(latest(lots))


def level_before(lots: DataFrame, by: str, days: DataFrame) -> DataFrame:
    """``by, until, level``: the mean log price of each value of ``by`` before each of ``days`` (until), where it had any.

    Daily totals and the days asked for go through one window by value; values of ``by`` are few, as houses or years are.
    """
    daily = lots.groupBy(by, F.col("sale_date").alias("until")).agg(F.sum("y").alias("_s"), F.count("*").alias("_c"))
    values = lots.agg(F.collect_set(by).alias("_v"))
    asked = days.crossJoin(F.broadcast(values)).select(F.explode("_v").alias(by), "until", F.lit(True).alias("_asked"))
    earlier = Window.partitionBy(by).orderBy(F.unix_date("until")).rangeBetween(Window.unboundedPreceding, -1)
    sums = daily.unionByName(asked, allowMissingColumns=True).withColumns({"_s": F.sum("_s").over(earlier), "_c": F.sum("_c").over(earlier)})
    return sums.where("_asked AND _c > 0").select(by, "until", (F.col("_s") / F.col("_c")).alias("level"))


def latest(lots: DataFrame) -> DataFrame:
    """Each work's latest sold lot, to be valued as of its day."""
    order = [F.desc("sale_date"), F.desc("sale"), F.desc("lot"), F.desc("hammer"), F.desc("artist")]
    return lots.withColumn("_k", F.row_number().over(Window.partitionBy("work").orderBy(*order))).where("_k = 1").drop("_k").withColumn("until", F.col("sale_date"))


MOVED = "CASE WHEN c.year >= p.year - 1 THEN 0 ELSE coalesce(yt.level - yc.level, 0) END"
REBASED = f"""{LEVELS}, rebased AS (SELECT p.work, p.until, c.sale_date, c.y + coalesce(ht.level - hc.level, 0) + {MOVED} AS y, {MOVED} AS moved
  FROM probes p JOIN priced c ON c.work = p.work AND c.sale_date < p.until LEFT JOIN house_at ht ON ht.house = p.house AND ht.until = p.until LEFT JOIN house_at hc ON hc.house = c.house AND hc.until = p.until
  LEFT JOIN year_at yt ON yt.year = p.year - 1 AND yt.until = p.until LEFT JOIN year_at yc ON yc.year = c.year AND yc.until = p.until)"""


def rebased(lots: DataFrame, probes: DataFrame) -> DataFrame:
    """Earlier sales of each probe's work, moved to the probe's house and forward to the level of the year before it, by what was known on its day."""
    days = probes.select("until").distinct()
    houses, years = level_before(lots, "house", days), level_before(lots, "year", days)
    named = lambda df, by, name: df.select(F.col(by).alias(f"_{name}"), "until", F.col("level").alias(name))
    asked = probes.select("work", "until", F.col("house").alias("_to_house"), (F.col("year") - 1).alias("_to_year"), F.col("year").alias("valued"))
    asked = asked.join(named(houses, "house", "to_house"), ["_to_house", "until"], "left").join(named(years, "year", "to_year"), ["_to_year", "until"], "left")
    comps = lots.select("work", "sale_date", "y", F.col("house").alias("_of_house"), F.col("year").alias("_of_year"))
    pairs = asked.join(comps, "work").where("sale_date < until").join(named(houses, "house", "of_house"), ["_of_house", "until"], "left").join(named(years, "year", "of_year"), ["_of_year", "until"], "left")
    moved = F.when(F.col("_of_year") >= F.col("valued") - 1, 0.0).otherwise(F.coalesce(F.col("to_year") - F.col("of_year"), F.lit(0.0)))
    return pairs.select("work", "until", "sale_date", (F.col("y") + F.coalesce(F.col("to_house") - F.col("of_house"), F.lit(0.0)) + moved).alias("y"), moved.alias("moved"))


@query(f"""WITH {REBASED} SELECT work, count(*) AS n, round(median(y), 6) AS level, round(avg(moved), 6) AS moved, CAST(max(sale_date) AS VARCHAR) AS latest FROM rebased GROUP BY 1""")
def rebased_comps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level of a work by its earlier sales at the probe's house and market."""
    return rebased(*settled(spark, sf_dir)).groupBy("work").agg(F.count("*").alias("n"), F.round(estimates.median("y"), 6).alias("level"), F.round(F.avg("moved"), 6).alias("moved"), F.max("sale_date").cast("string").alias("latest"))


def running(name: str, by: str) -> str:
    on = f"PARTITION BY {by} " if by else ""
    cols = f"{by}, " if by else ""
    return f"""{name} AS (SELECT {cols}sale_date, sum(s) OVER w AS s, sum(c) OVER w AS c FROM (SELECT {cols}sale_date, sum(y) AS s, count(*) AS c FROM priced GROUP BY {cols}sale_date) WINDOW w AS ({on}ORDER BY sale_date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING))"""


BANDS = "CASE WHEN edition <= 10 THEN 'tiny' WHEN edition <= 25 THEN 'small' WHEN edition <= 40 THEN 'medium' ELSE 'large' END"


#: Attributes of a lot and the level of each that others are measured from.
REFERENCES = {"signature": "unsigned", "band": "large", "process": "ECONOMY"}
ATTRIBUTES = f"CASE WHEN signed THEN 'signed' ELSE 'unsigned' END AS signature, {BANDS} AS band, technique AS process"


@query(f"""WITH {LEVELS}, {running('by_artist', 'artist')}, f AS (SELECT *, {ATTRIBUTES} FROM priced), {', '.join(at_day(f'{d}_at', d, 'f') for d in REFERENCES)}, g AS (SELECT *, {ATTRIBUTES} FROM probes),
lvl AS ({' UNION ALL '.join(f"SELECT '{d}' AS dim, {d} AS lvl, until, level FROM {d}_at" for d in REFERENCES)}), ref AS (SELECT * FROM lvl WHERE (dim, lvl) IN ({', '.join(f"('{d}', '{v}')" for d, v in REFERENCES.items())})),
attrs AS (SELECT work, artist, year, sale_date, until, unnest(['signature', 'band', 'process']) AS dim, unnest([signature, band, process]) AS lvl FROM g),
e AS (SELECT a.*, CASE WHEN a.lvl <> ref.lvl THEN lvl.level - ref.level END AS e FROM attrs a LEFT JOIN lvl ON lvl.dim = a.dim AND lvl.lvl = a.lvl AND lvl.until = a.until LEFT JOIN ref ON ref.dim = a.dim AND ref.until = a.until)
SELECT work, round(any_value(b.s / b.c) + coalesce(sum(e), 0) + coalesce(any_value(y.level - z.level), 0), 6) AS mu, coalesce(string_agg(dim || '=' || lvl, ',' ORDER BY dim) FILTER (e IS NOT NULL), '') AS terms
FROM e JOIN by_artist b ON b.artist = e.artist AND b.sale_date = e.sale_date AND b.c > 0 LEFT JOIN year_at y ON y.year = e.year AND y.until = e.until LEFT JOIN all_at z ON z.until = e.until GROUP BY work""")
def attribute_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log price of each probe from its artist's level, what its attributes add to reference levels, and its year, all before its day.

    A level without an effect of its own (a reference, or one without earlier sales) adds nothing and isn't named among
    the terms; without earlier sales of the artist there is no price.
    """
    lots = priced(spark, sf_dir).withColumn("signature", F.when(F.col("signed"), "signed").otherwise("unsigned")).withColumn("band", numbers.banded(F.col("edition"), [(10, "tiny"), (25, "small"), (40, "medium")], "large")).withColumn("process", F.col("technique"))
    probes = latest(lots)
    days = probes.select("until").distinct()
    found = probes.select("work", "artist", "sale_date", "year", "until", *REFERENCES)
    for dim, reference in REFERENCES.items():
        level = level_before(lots, dim, days)
        base = level.where(F.col(dim) == reference).select("until", F.col("level").alias("_r"))
        found = found.join(level, [dim, "until"], "left").join(base, "until", "left").withColumn(f"e_{dim}", F.when(F.col(dim) != reference, F.col("level") - F.col("_r"))).drop("level", "_r")
    known = found.join(before(lots, ["artist"]), ["artist", "sale_date"])
    known = known.join(level_before(lots, "year", days).withColumnRenamed("level", "_y"), ["year", "until"], "left").join(level_before(lots.withColumn("everything", F.lit(1)), "everything", days).select("until", F.col("level").alias("_z")), "until", "left")
    zero = F.lit(0.0)
    added = sum((F.coalesce(f"e_{d}", zero) for d in REFERENCES), zero) + F.coalesce(F.col("_y") - F.col("_z"), zero)
    terms = F.array_join(F.array_compact(F.array(*(F.when(F.col(f"e_{d}").isNotNull(), F.concat(F.lit(f"{d}="), d)) for d in sorted(REFERENCES)))), ",")
    return known.select("work", F.round(F.col("s") / F.col("c") + added, 6).alias("mu"), terms.alias("terms"))


#: Bias and spread by source and key, the most specific key first; ``all`` is the last resort.
CALIBRATION = (("same_work", "3+|recent", -0.02, 0.30), ("same_work", "3+", -0.03, 0.38), ("same_work", "1", -0.05, 0.55), ("same_work", "all", -0.04, 0.45), ("artist_technique", "all", 0.0, 0.80), ("artist", "all", 0.01, 0.95), ("technique", "all", 0.02, 1.10), ("estimate", "all", -0.20, 0.90), ("same_house", "recent", -0.05, 0.40), ("same_house", "all", -0.08, 0.60))
CALIBRATION_SQL = "cal(source, key, bias, sigma) AS (VALUES " + ", ".join(f"('{s}', '{k}', {b}::DOUBLE, {g}::DOUBLE)" for s, k, b, g in CALIBRATION) + ")"
WITNESSES = f"""{REBASED}, {running('by_both', 'artist, technique')}, {running('by_artist', 'artist')}, {running('by_technique', 'technique')}, {CALIBRATION_SQL},
own AS (SELECT work, until, count(*) AS n, median(y) AS mu, max(sale_date) AS last_sale FROM rebased GROUP BY 1, 2),
house AS (SELECT p.work, arg_max(c.y, (c.sale_date, c.sale, c.lot, c.y)) AS mu, max(c.sale_date) AS last_sale, p.until FROM probes p JOIN priced c ON c.work = p.work AND c.house = p.house AND c.sale_date < p.until GROUP BY p.work, p.until),
raw AS (SELECT work, 'same_work' AS source, mu, CASE WHEN n <= 1 THEN '1' WHEN n = 2 THEN '2' ELSE '3+' END AS key2, CASE WHEN date_diff('day', last_sale, until) / 365.25 <= 3 THEN 'recent' ELSE 'old' END AS age FROM own
  UNION ALL SELECT work, 'artist_technique', s / c, NULL, NULL FROM probes JOIN by_both USING (artist, technique, sale_date) WHERE c > 0
  UNION ALL SELECT work, 'artist', s / c, NULL, NULL FROM probes JOIN by_artist USING (artist, sale_date) WHERE c > 0
  UNION ALL SELECT work, 'technique', s / c, NULL, NULL FROM probes JOIN by_technique USING (technique, sale_date) WHERE c > 0
  UNION ALL SELECT work, 'estimate', ln(CAST(estimate AS DOUBLE)), house, NULL FROM probes WHERE estimate > 0
  UNION ALL SELECT work, 'same_house', mu, CASE WHEN date_diff('day', last_sale, until) / 365.25 <= 3 THEN 'recent' ELSE 'old' END, NULL FROM house),
witnesses AS (SELECT work, r.source, r.mu + coalesce(a.bias, b.bias, z.bias) AS mu, coalesce(a.sigma, b.sigma, z.sigma) AS sigma, coalesce(a.key, b.key, z.key) AS key FROM raw r LEFT JOIN cal a ON a.source = r.source AND a.key = key2 || '|' || age LEFT JOIN cal b ON b.source = r.source AND b.key = key2 JOIN cal z ON z.source = r.source AND z.key = 'all')"""


def before(lots: DataFrame, by: list[str]) -> DataFrame:
    """Sum and count of log prices strictly before each day of a sale, by group: running sums over daily totals."""
    days = lots.groupBy(*by, "sale_date").agg(F.sum("y").alias("s"), F.count("*").alias("c"))
    w = Window.partitionBy(*by).orderBy(F.unix_date("sale_date")).rangeBetween(Window.unboundedPreceding, -1)
    return days.select(*by, "sale_date", F.sum("s").over(w).alias("s"), F.sum("c").over(w).alias("c")).where("c > 0")


def raw_witnesses(lots: DataFrame, probes: DataFrame) -> DataFrame:
    """``work, source, mu, keys``: what each source says of a probe's log price, with calibration keys, the surest first."""
    age = F.when(F.datediff("until", "last_sale") / 365.25 <= 3, "recent").otherwise("old")
    band = F.when(F.col("n") <= 1, "1").when(F.col("n") == 2, "2").otherwise("3+")
    own = rebased(lots, probes).groupBy("work", "until").agg(F.count("*").alias("n"), estimates.median("y").alias("mu"), F.max("sale_date").alias("last_sale"))
    found = own.select("work", F.lit("same_work").alias("source"), "mu", F.array(F.concat_ws("|", band, age), band, F.lit("all")).alias("keys"))
    for source, by in (("artist_technique", ["artist", "technique"]), ("artist", ["artist"]), ("technique", ["technique"])):
        known = probes.select("work", *by, "sale_date").join(before(lots, by), [*by, "sale_date"])
        found = found.unionByName(known.select("work", F.lit(source).alias("source"), (F.col("s") / F.col("c")).alias("mu"), F.array(F.lit("all")).alias("keys")))
    found = found.unionByName(probes.where("estimate > 0").select("work", F.lit("estimate").alias("source"), F.log(F.col("estimate").cast("double")).alias("mu"), F.array("house", F.lit("all")).alias("keys")))
    earlier = probes.select("work", "house", "until").join(lots.select("work", "house", "sale_date", "sale", "lot", "y"), ["work", "house"]).where("sale_date < until")
    house = earlier.groupBy("work", "until").agg(F.max_by("y", F.struct("sale_date", "sale", "lot", "y")).alias("mu"), F.max("sale_date").alias("last_sale"))
    return found.unionByName(house.select("work", F.lit("same_house").alias("source"), "mu", F.array(age, F.lit("all")).alias("keys")))


def witnesses(spark: SparkSession, sf_dir: str, known: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``work, source, mu, sigma, key``: witnesses with the bias and spread of their surest key that is calibrated."""
    biases = F.create_map(*(x for s, k, b, g in CALIBRATION for x in (F.lit(f"{s}/{k}"), F.struct(F.lit(b).alias("bias"), F.lit(g).alias("sigma"), F.lit(k).alias("key")))))
    hit = F.try_element_at(F.array_compact(F.transform("keys", lambda k: biases[F.concat("source", F.lit("/"), k)])), F.lit(1))
    return raw_witnesses(*(known or settled(spark, sf_dir))).select("work", "source", "mu", hit.alias("c")).select("work", "source", (F.col("mu") + F.col("c.bias")).alias("mu"), "c.sigma", "c.key")


@query(f"""WITH {WITNESSES} SELECT work, source, round(mu, 6) AS mu, sigma, key FROM witnesses""")
def price_witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six calibrated opinions of each probe's log price."""
    return witnesses(spark, sf_dir).select("work", "source", F.round("mu", 6).alias("mu"), "sigma", "key")


ROUNDED = "CASE WHEN {0} > 0 THEN {1}({0} / pow(10, floor(log10({0})) - 1)) * pow(10, floor(log10({0})) - 1) END"
VALUED = f"""{WITNESSES}, pooled AS (SELECT work, sum(mu / sigma ** 2) / sum(1 / sigma ** 2) AS mu, 1 / sqrt(sum(1 / sigma ** 2)) AS sd, count(*) AS n, max(mu) - min(mu) AS apart, bool_or(source = 'same_work') AS own FROM witnesses GROUP BY 1)"""


@query(f"""WITH {VALUED} SELECT work, n, round(exp(mu), 2) AS median, {ROUNDED.format('exp(mu - 1.2816 * sd)', 'floor')} AS low, {ROUNDED.format('exp(mu + 1.2816 * sd)', 'ceil')} AS high, CASE WHEN own THEN 'own sales' ELSE 'like works' END AS tier, CASE WHEN apart > 1.5 THEN 'witnesses disagree' WHEN n < 4 THEN 'thin evidence' ELSE '' END AS caveat FROM pooled""")
def valuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A price, a range rounded to two figures (down and up) and caveats from the witnesses, weighted by precision."""
    precision = 1 / F.col("sigma") ** 2
    pooled = witnesses(spark, sf_dir).groupBy("work").agg((F.sum(F.col("mu") * precision) / F.sum(precision)).alias("mu"), (1 / F.sqrt(F.sum(precision))).alias("sd"), F.count("*").alias("n"), (F.max("mu") - F.min("mu")).alias("apart"), F.bool_or(F.col("source") == "same_work").alias("own"))

    def rounded(price, way):
        step = F.pow(F.lit(10.0), F.floor(F.log10(price)) - 1)
        return F.when(price > 0, way(price / step) * step)

    low, high = F.exp(F.col("mu") - 1.2816 * F.col("sd")), F.exp(F.col("mu") + 1.2816 * F.col("sd"))
    caveat = F.when(F.col("apart") > 1.5, "witnesses disagree").when(F.col("n") < 4, "thin evidence").otherwise("")
    return pooled.select("work", "n", F.round(F.exp("mu"), 2).alias("median"), rounded(low, F.floor).alias("low"), rounded(high, F.ceil).alias("high"), F.when(F.col("own"), "own sales").otherwise("like works").alias("tier"), caveat.alias("caveat"))


@query(f"""WITH {WITNESSES}, e AS (SELECT w.source, w.key, p.y - w.mu AS e FROM witnesses w JOIN probes p USING (work))
SELECT source, key, count(*) AS n, round(avg(e), 6) AS bias, round(coalesce(stddev_samp(e), 0), 6) AS sigma, round(avg(abs(e)), 6) AS mae FROM e GROUP BY 1, 2""")
def witness_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bias and spread of each source by key, from what the probes fetched."""
    lots, probes = settled(spark, sf_dir)
    truth = probes.select("work", "y")
    off = witnesses(spark, sf_dir, (lots, probes)).join(truth, "work").select("source", "key", (F.col("y") - F.col("mu")).alias("e"))
    return off.groupBy("source", "key").agg(F.count("*").alias("n"), F.round(F.avg("e"), 6).alias("bias"), F.round(F.coalesce(F.stddev_samp("e"), F.lit(0.0)), 6).alias("sigma"), F.round(F.avg(F.abs("e")), 6).alias("mae"))


@query(f"""WITH {WITNESSES}, e AS (SELECT r.source, p.y - r.mu AS e FROM raw r JOIN probes p USING (work)), b AS (SELECT source, median(e) AS bias, count(*) AS n FROM e GROUP BY 1)
SELECT 'v1' AS version, source, 'all' AS key, round(bias, 6) AS bias, round(1.4826 * median(abs(e - bias)), 6) AS sigma, n FROM e JOIN b USING (source) GROUP BY source, bias, n""")
def stored_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bias and robust spread of each source on the probes, written as a calibration document and read back."""
    lots, probes = settled(spark, sf_dir)
    truth = probes.select("work", "y")
    off = durable(raw_witnesses(lots, probes).join(truth, "work").select("source", (F.col("y") - F.col("mu")).alias("e")))
    bias = ranges.quantiles(off, ["source"], "e", [0.5]).select("source", "n", F.col("q0").alias("bias"))
    spread = ranges.quantiles(off.join(bias, "source").select("source", F.abs(F.col("e") - F.col("bias")).alias("a")), ["source"], "a", [0.5]).select("source", (1.4826 * F.col("q0")).alias("sigma"))
    fitted = bias.join(spread, "source").select("source", F.lit("all").alias("key"), "bias", "sigma", "n")
    path = f"{checkpoint_dir(spark).rstrip('/')}/calibration-{uuid.uuid4().hex}"
    sinks.write_calibration(fitted, path, "v1")
    found = sinks.read_calibration(spark, path)
    return found.select("version", "source", "key", F.round("bias", 6).alias("bias"), F.round("sigma", 6).alias("sigma"), "n")


SOURCES = ("same_work", "artist_technique", "artist", "technique", "estimate", "same_house")


@query()
def witness_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of the sources by coordinate descent on the mean error, and the temperature that covers 80 %.

    One aggregate over the witnesses gives the errors of all choices for one source, so a round costs as many jobs as
    there are sources; rounds end when no weight changes.
    """
    lots, probes = settled(spark, sf_dir)
    truth = probes.select("work", "y")
    wide = witnesses(spark, sf_dir, (lots, probes)).groupBy("work").agg(*(F.max(F.when(F.col("source") == s, F.col("mu"))).alias(s) for s in SOURCES)).join(truth, "work").persist()
    choices, weights = (0.0, 0.25, 0.5, 1.0, 2.0), dict.fromkeys(SOURCES, 1.0)

    def pooled(w: dict[str, float]):
        total = sum((F.when(F.col(s).isNotNull(), F.lit(v)).otherwise(0.0) for s, v in w.items()), F.lit(0.0))
        return F.try_divide(sum((F.coalesce(F.col(s) * v, F.lit(0.0)) for s, v in w.items()), F.lit(0.0)), total)

    best = None
    for _ in range(10):
        before_round = dict(weights)
        for s in SOURCES:
            row = wide.agg(*(F.avg(F.abs(F.col("y") - pooled(weights | {s: c}))).alias(f"c{i}") for i, c in enumerate(choices)), *(F.count(pooled(weights | {s: c})).alias(f"n{i}") for i, c in enumerate(choices))).first()
            most = max(row[f"n{i}"] for i in range(len(choices)))  # a choice that leaves lots without a price is none
            allowed = [i for i in range(len(choices)) if row[f"n{i}"] == most and most]
            if allowed:
                at = min(allowed, key=lambda i: (round(row[f"c{i}"], 9), choices[i] != weights[s]))
                weights[s], best = choices[at], row[f"c{at}"]
        if weights == before_round:
            break
    e = F.abs(F.col("y") - pooled(weights))
    half = wide.agg(F.percentile(e, F.lit(0.8)).alias("h")).first().h
    wide.unpersist()
    return spark.createDataFrame([(s, w, best, half) for s, w in weights.items()], "source string, weight double, mae double, half_width double")


QUALIFIERS = "CASE l_linenumber % 4 WHEN 0 THEN NULL WHEN 1 THEN 'direct' WHEN 2 THEN NULL ELSE 'after' END"
#: Hands that aren't the artist's own, as addresses of lots name them.
HANDS = ("after", "manner-of", "circle-of", "attributed-to", "follower-of", "school-of")
#: The hand stands where the lot's own part of an address begins, never in a sale's name.
NON_DIRECT = "/(?:lot/[0-9]+/|[0-9]+-)(?:" + "|".join(HANDS) + ")-"
URLS = "'https://house.example/' || CASE WHEN l_linenumber = 2 THEN 'after-hours/' ELSE 'sale/' END || CASE WHEN l_orderkey % 2 = 0 THEN 'lot/' || CAST(l_partkey AS {0}) || '/' ELSE CAST(l_partkey AS {0}) || '-' END || CASE l_orderkey % 9 WHEN 0 THEN 'after-' WHEN 1 THEN 'Manner-Of-' WHEN 2 THEN 'circle-of-' WHEN 3 THEN 'school-of-' WHEN 4 THEN 'before-' ELSE '' END || 'artist'"


@query(f"""WITH q AS (SELECT l_suppkey AS artist, {QUALIFIERS} AS qualifier, lower({URLS.format('VARCHAR')}) AS url FROM lineitem)
SELECT artist, count(*) AS lots, count(*) FILTER (NOT other) AS direct, count(*) FILTER (other AND qualifier IS NULL) AS by_address FROM (SELECT *, CASE WHEN qualifier IS NOT NULL THEN qualifier <> 'direct' ELSE regexp_matches(url, '{NON_DIRECT}') END AS other FROM q) GROUP BY 1""")
def direct_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lots by the artist's own hand: the qualifier says so or, where there is none, the address says nothing else."""
    q = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("artist"), F.expr(QUALIFIERS).alias("qualifier"), F.lower(F.expr(URLS.format("STRING"))).alias("url"))
    other = F.when(F.col("qualifier").isNotNull(), F.col("qualifier") != "direct").otherwise(F.col("url").rlike(NON_DIRECT))
    return q.withColumn("other", other).groupBy("artist").agg(F.count("*").alias("lots"), F.count_if(~F.col("other")).alias("direct"), F.count_if(F.col("other") & F.col("qualifier").isNull()).alias("by_address"))


@query(f"""WITH {VALUED}, facts AS (SELECT l_partkey AS work, count(*) AS lots, count(*) FILTER (l_returnflag <> 'R') AS sold, count(DISTINCT l_suppkey) AS artists FROM lineitem GROUP BY 1), who AS (SELECT artist, count(*) AS artist_sales, round(avg(y), 6) AS artist_level FROM priced GROUP BY 1)
SELECT p.work, p.artist, CAST(p.until AS VARCHAR) AS until, facts.lots, facts.sold, facts.artists, artist_sales, artist_level, coalesce(o.n, 0) AS same_work, round(v.mu, 6) AS mu FROM probes p JOIN facts USING (work) JOIN who USING (artist) LEFT JOIN own o USING (work) LEFT JOIN pooled v USING (work)""")
def evidence_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that is known of each probe in one row: work facts, artist profile, own sales and pooled level."""
    lots, probes = settled(spark, sf_dir)
    facts = sales(spark, sf_dir).groupBy("work").agg(F.count("*").alias("lots"), F.count_if("sold").alias("sold"), F.count_distinct("artist").alias("artists"))
    who = lots.groupBy("artist").agg(F.count("*").alias("artist_sales"), F.round(F.avg("y"), 6).alias("artist_level"))
    own = rebased(lots, probes).groupBy("work").agg(F.count("*").alias("same_work"))
    precision = 1 / F.col("sigma") ** 2
    pooled = witnesses(spark, sf_dir, (lots, probes)).groupBy("work").agg(F.round(F.sum(F.col("mu") * precision) / F.sum(precision), 6).alias("mu"))
    asked = probes.select("work", "artist", F.col("until").cast("string").alias("until"))
    return asked.join(facts, "work").join(who, "artist").join(own, "work", "left").join(pooled, "work", "left").select("work", "artist", "until", "lots", "sold", "artists", "artist_sales", "artist_level", F.coalesce("same_work", F.lit(0)).alias("same_work"), "mu")


@query(f"""WITH {SALES}, r AS (SELECT *, row_number() OVER (PARTITION BY work ORDER BY sale_date DESC, sale DESC, lot DESC, hammer DESC) AS k FROM sales WHERE sold)
SELECT work, string_agg(CAST(sale_date AS VARCHAR) || ' ' || CAST(hammer AS VARCHAR), '; ' ORDER BY k) AS recent, CASE WHEN min(edition) = max(edition) THEN 'edition of ' || CAST(min(edition) AS VARCHAR) ELSE 'editions of ' || CAST(min(edition) AS VARCHAR) || ' to ' || CAST(max(edition) AS VARCHAR) END AS edition_text, bool_or(p_type = 'PROMO') AS reproduction,
  CASE WHEN bool_or(p_type = 'PROMO') THEN 'inspect for reproduction' WHEN count(*) < 3 THEN 'look for further sales' ELSE 'none' END AS next_step FROM r JOIN part ON work = p_partkey WHERE k <= 8 GROUP BY 1""")
def report_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a report says of a work: its eight latest sales, its editions, whether it may be a reproduction, what to do next."""
    order = [F.desc("sale_date"), F.desc("sale"), F.desc("lot"), F.desc("hammer")]
    last = sales(spark, sf_dir).where("sold").withColumn("k", F.row_number().over(Window.partitionBy("work").orderBy(*order))).where("k <= 8").join(works(spark, sf_dir).select("work", "technique"), "work")
    low, high, copy = F.min("edition"), F.max("edition"), F.bool_or(F.col("technique") == "PROMO")
    said = F.struct("k", F.concat(F.col("sale_date").cast("string"), F.lit(" "), F.col("hammer").cast("string")).alias("s"))
    edition = F.when(low == high, F.concat(F.lit("edition of "), low.cast("string"))).otherwise(F.concat(F.lit("editions of "), low.cast("string"), F.lit(" to "), high.cast("string")))
    return last.groupBy("work").agg(F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda x: x["s"]), "; ").alias("recent"), edition.alias("edition_text"), copy.alias("reproduction"), F.when(copy, "inspect for reproduction").when(F.count("*") < 3, "look for further sales").otherwise("none").alias("next_step"))
