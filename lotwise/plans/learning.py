"""Learning and its evaluation: splits, weights, label matrices, ridges by artist, intervals, transfer, neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwise.operators import boosting, joins, learn, ridges
from lotwise.operators.durable import durable
from lotwise.plans import Registry
from lotwise.plans.pricing import LOGS, logs
from lotwise.sources.tables import sales, table, works

REGISTRY = Registry()
query = REGISTRY

#: Folds of groups by a plain arithmetic hash, so that SQL can follow it.
FOLD_SQL = "(({0} * 2654435761 + 97 * 40503) % 4294967296) % {1}"


def fold_of(c: str, folds: int):
    return F.pmod(F.pmod(F.col(c) * F.lit(2654435761) + F.lit(97 * 40503), F.lit(4294967296)), F.lit(folds))


@query(f"""SELECT CAST({FOLD_SQL.format('l_suppkey', 5)} AS BIGINT) AS fold, count(*) AS rows, count(DISTINCT l_suppkey) AS artists, round(avg(CASE WHEN p_type = 'PROMO' THEN 1.0 ELSE 0.0 END), 6) AS promo FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def grouped_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds that keep all of an artist's lots together, with a class's share in each."""
    lots = sales(spark, sf_dir).join(works(spark, sf_dir).select("work", "technique"), "work")
    return lots.groupBy(fold_of("artist", 5).alias("fold")).agg(F.count("*").alias("rows"), F.count_distinct("artist").alias("artists"), F.round(F.avg((F.col("technique") == "PROMO").cast("double")), 6).alias("promo"))


@query("""WITH c AS (SELECT l_suppkey AS artist, p_type AS technique, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY technique) AS t FROM c),
s AS (SELECT artist, arg_min(technique, (t, technique)) AS scarce, sum(n) AS n FROM t GROUP BY 1), p AS (SELECT artist, (row_number() OVER (PARTITION BY scarce ORDER BY n DESC, artist) - 1) % 10 AS turn FROM s) SELECT artist, CAST(least(turn, 9 - turn) AS INTEGER) AS fold FROM p""")
def stratified_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artists in five folds such that each technique spreads evenly: the scarcest technique's artists are dealt first."""
    lots = sales(spark, sf_dir).join(works(spark, sf_dir).select("work", "technique"), "work").groupBy("artist", "technique").agg(F.count("*").alias("n"))
    return learn.stratified_groups(lots, "artist", "technique", "n", 5)


@query("""WITH n AS (SELECT l_suppkey AS artist, count(*) AS n FROM lineitem GROUP BY 1), w AS (SELECT artist, n, pow(n, -0.5) AS w FROM n)
SELECT artist, n, round(w * (SELECT sum(n) FROM w) / (SELECT sum(n * w) FROM w), 6) AS weight FROM w""")
def sample_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight of each of an artist's lots, falling with the root of their number, mean 1 over all lots."""
    n = sales(spark, sf_dir).groupBy("artist").agg(F.count("*").alias("n")).withColumn("w", F.pow(F.col("n").cast("double"), F.lit(-0.5)))
    whole = n.agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("w")).alias("mass"))
    return n.crossJoin(F.broadcast(whole)).select("artist", "n", F.round(F.col("w") * F.col("rows") / F.col("mass"), 6).alias("weight"))


TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


@query("""WITH l AS (SELECT DISTINCT l_suppkey AS artist, p_type AS label FROM lineitem JOIN part ON l_partkey = p_partkey), k AS (SELECT label FROM l GROUP BY 1 HAVING count(*) >= 5)
SELECT artist, """ + ", ".join(f"CAST(max(CASE WHEN l.label = '{t}' AND k.label IS NOT NULL THEN 1 ELSE 0 END) AS INTEGER) AS {t.lower()}" for t in TYPES) + " FROM l LEFT JOIN k USING (label) GROUP BY 1")
def label_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Techniques of each artist as 0 and 1; techniques of fewer than five artists are left out."""
    seen = sales(spark, sf_dir).select("artist", "work").join(works(spark, sf_dir).select("work", "technique"), "work").select("artist", "technique").distinct()
    kept = seen.join(seen.groupBy("technique").agg(F.count("*").alias("n")), "technique")
    return kept.groupBy("artist").agg(*(F.max(F.when((F.col("technique") == t) & (F.col("n") >= 5), 1).otherwise(0)).alias(t.lower()) for t in TYPES))


@query(f"""WITH {LOGS}, s AS (SELECT artist, count(*) AS n, avg(edition) AS mx, avg(y) AS my, sum(edition * y) - count(*) * avg(edition) * avg(y) AS sxy, sum(edition * edition) - count(*) * avg(edition) * avg(edition) AS sxx FROM logs GROUP BY 1)
SELECT artist, n, round(sxy / (sxx + 10), 8) AS slope, round(my - sxy / (sxx + 10) * mx, 6) AS intercept FROM s WHERE n >= 15""")
def artist_ridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ridge of log price on edition for each artist of fifteen sales or more, from sums alone."""
    x, y, n = F.col("edition").cast("double"), F.col("y"), F.count("*")
    s = logs(spark, sf_dir).groupBy("artist").agg(n.alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), (F.sum(x * y) - n * F.avg(x) * F.avg(y)).alias("sxy"), (F.sum(x * x) - n * F.avg(x) * F.avg(x)).alias("sxx")).where("n >= 15")
    slope = F.col("sxy") / (F.col("sxx") + 10)
    return s.select("artist", "n", F.round(slope, 8).alias("slope"), F.round(F.col("my") - slope * F.col("mx"), 6).alias("intercept"))


TWO = f"""{LOGS}, r AS (SELECT artist, CAST(year(sale_date) AS INTEGER) AS year, y, CAST(edition AS DOUBLE) AS x, ln(p_size) AS z FROM logs JOIN part ON work = p_partkey)"""
#: A ridge on two columns by Cramer's rule, penalty 10.
CRAMER = "count(*) AS n, avg(x) AS mx, avg(z) AS mz, avg(y) AS my, var_pop(x) * count(*) + 10 AS a, var_pop(z) * count(*) + 10 AS b, covar_pop(x, z) * count(*) AS c, covar_pop(x, y) * count(*) AS u, covar_pop(z, y) * count(*) AS v"
SLOPES = "(b * u - c * v) / (a * b - c * c) AS sx, (a * v - c * u) / (a * b - c * c) AS sz"


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sold lots with what a price model reads: artist, work, year, x (edition), z (log of size), y (log price)."""
    sizes = works(spark, sf_dir).select("work", F.log("size").alias("z"))
    return logs(spark, sf_dir).join(sizes, "work").select("artist", "work", F.year("sale_date").alias("year"), F.col("edition").cast("double").alias("x"), "z", "premium", F.col("signed").cast("double").alias("signed"), "y")


@query(f"WITH {TWO}, s AS (SELECT artist, {CRAMER} FROM r GROUP BY 1), k AS (SELECT *, {SLOPES} FROM s) SELECT artist, n, round(sx, 8) AS edition_slope, round(sz, 6) AS size_slope, round(my - sx * mx - sz * mz, 6) AS intercept FROM k WHERE n >= 15")
def artist_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slopes of log price by edition and size for each artist of fifteen sales or more, from sums of products alone."""
    found = ridges.by_group(described(spark, sf_dir), "artist", ["x", "z"], "y", 10.0, 15)
    return found.select("artist", "n", F.round(F.col("slopes")[0], 8).alias("edition_slope"), F.round(F.col("slopes")[1], 6).alias("size_slope"), F.round("intercept", 6).alias("intercept"))


STRENGTHS = (0.0, 5.0, 20.0, 80.0, 320.0)


@query(f"""WITH {TWO}, t AS (SELECT * FROM r WHERE year < 1998), h AS (SELECT * FROM r WHERE year >= 1998), p AS (SELECT *, my - sx * mx - sz * mz AS i FROM (SELECT *, {SLOPES} FROM (SELECT {CRAMER} FROM t))),
o AS (SELECT *, my - sx * mx - sz * mz AS i FROM (SELECT *, {SLOPES} FROM (SELECT artist, {CRAMER} FROM t GROUP BY 1) WHERE n >= 15)), g AS (SELECT unnest({list(STRENGTHS)})::DOUBLE AS strength),
e AS (SELECT strength, h.y - CASE WHEN o.artist IS NULL THEN p.i + p.sx * h.x + p.sz * h.z ELSE (o.n * (o.i + o.sx * h.x + o.sz * h.z) + strength * (p.i + p.sx * h.x + p.sz * h.z)) / (o.n + strength) END AS e FROM h CROSS JOIN g CROSS JOIN p LEFT JOIN o ON o.artist = h.artist),
m AS (SELECT strength, count(*) AS n, avg(e * e) AS error FROM e GROUP BY 1) SELECT strength, n, round(error, 8) AS error, row_number() OVER (ORDER BY error, strength) = 1 AS best FROM m""")
def shrinkage_strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far artists' ridges should be drawn towards the pooled one, by their errors on later sales."""
    lots = described(spark, sf_dir)
    found = ridges.strengths(lots.where("year < 1998"), lots.where("year >= 1998"), "artist", ["x", "z"], "y", 10.0, list(STRENGTHS), 15)
    return found.select("strength", "n", F.round("error", 8).alias("error"), "best")


@query()
def pooled_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log price on edition, size, signature and premium with a level for each artist and each year, all drawn towards 0."""
    model = ridges.TwoWay(described(spark, sf_dir), "artist", "year", ["x", "z", "signed", "premium"], "y", 1.0)
    intercept, slopes = model.coefficients()
    plain = spark.createDataFrame([("intercept", "all", intercept), *(("slope", c, v) for c, v in slopes.items())], "term string, level string, effect double")
    effects = [e.select(F.lit(name).alias("term"), F.col(name).cast("string").alias("level"), "effect") for name, e in (("artist", model.many_effects()), ("year", model.few_effects()))]
    return plain.unionByName(effects[0]).unionByName(effects[1]).withColumn("effect", F.round("effect", 6))


@query()
def year_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price by year relative to 1995 within works, with a 90 % interval from whole works drawn again forty times."""
    found = ridges.bootstrap_effects(described(spark, sf_dir), "work", "year", "y", 1995, DRAWS)
    return found.select("year", *(F.round(c, 6).alias(c) for c in ("effect", "p5", "p95")))


DRAWS = 40
#: Poisson(1) weights by cumulative chance, in thousandths.
POISSON = ((368, 0), (736, 1), (920, 2), (981, 3), (996, 4), (1000, 5))
WEIGHT_SQL = "CASE " + " ".join(f"WHEN h < {c} THEN {w}" for c, w in POISSON) + " END"


@query(f"""WITH {LOGS}, c AS (SELECT work, CAST(year(sale_date) AS INTEGER) AS year, sum(y) AS s, count(*) AS n FROM logs GROUP BY 1, 2), d AS (SELECT c.*, b, (((work * 2654435761 + b * 40503) % 4294967296) // 7) % 1000 AS h FROM c, range({DRAWS}) r(b)),
m AS (SELECT year, b, sum(s * ({WEIGHT_SQL})) / nullif(sum(n * ({WEIGHT_SQL})), 0) AS level FROM d GROUP BY 1, 2), p AS (SELECT year, sum(s) / sum(n) AS level FROM c GROUP BY 1)
SELECT m.year, round(any_value(p.level), 6) AS level, round(quantile_cont(m.level, 0.05), 6) AS p5, round(quantile_cont(m.level, 0.95), 6) AS p95 FROM m JOIN p USING (year) GROUP BY 1""")
def bootstrap_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level of each year with a 90 % interval, whole works drawn again forty times.

    A work's weight in a draw follows from a hash of both, so the draws need no state; sums by work and year go in.
    """
    c = logs(spark, sf_dir).groupBy("work", F.year("sale_date").alias("year")).agg(F.sum("y").alias("s"), F.count("*").alias("n"))
    h = lambda b: F.pmod(F.floor(F.pmod(F.col("work") * F.lit(2654435761) + F.lit(b * 40503), F.lit(4294967296)) / 7), F.lit(1000))

    def weight(b: int):
        out = F.lit(POISSON[-1][1])
        for cut, w in reversed(POISSON[:-1]):
            out = F.when(h(b) < cut, w).otherwise(out)
        return out

    sums = c.groupBy("year").agg((F.sum("s") / F.sum("n")).alias("level"), F.array(*(F.try_divide(F.sum(F.col("s") * weight(b)), F.sum(F.col("n") * weight(b))) for b in range(DRAWS))).alias("draws"))
    levels = sums.select("year", "level", F.explode("draws").alias("d"))
    return levels.groupBy("year").agg(F.round(F.first("level"), 6).alias("level"), F.round(F.percentile("d", F.lit(0.05)), 6).alias("p5"), F.round(F.percentile("d", F.lit(0.95)), 6).alias("p95"))


@query(f"""WITH {LOGS}, s AS (SELECT p_type AS technique, y, CAST(edition AS DOUBLE) AS x FROM logs JOIN part ON work = p_partkey), m AS (SELECT technique, avg(x) AS mx, avg(y) AS my, count(*) AS n, covar_pop(y, x) / var_pop(x) AS slope, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(y, x) AS cxy FROM s GROUP BY 1), pool AS (SELECT sum(n * cxy) / sum(n * vx) AS slope FROM m)
SELECT a.technique, d.technique AS donor, round(d.slope, 8) AS slope, round(a.vy - 2 * d.slope * a.cxy + d.slope * d.slope * a.vx, 8) AS error, round(a.vy - 2 * pool.slope * a.cxy + pool.slope * pool.slope * a.vx, 8) AS pooled_error FROM m a, m d, pool""")
def slope_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well one technique's slope serves another: squared errors by own, donor's and pooled slope, from moments alone."""
    lots = logs(spark, sf_dir).join(works(spark, sf_dir).select("work", "technique"), "work").withColumn("x", F.col("edition").cast("double"))
    m = lots.groupBy("technique").agg(F.count("*").alias("n"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("y", "x").alias("cxy")).withColumn("slope", F.col("cxy") / F.col("vx"))
    pool = m.agg((F.sum(F.col("n") * F.col("cxy")) / F.sum(F.col("n") * F.col("vx"))).alias("pool"))
    error = lambda s: F.round(F.col("vy") - 2 * s * F.col("cxy") + s * s * F.col("vx"), 8)
    donors = F.broadcast(m.select(F.col("technique").alias("donor"), F.col("slope").alias("given")))  # a technique is one row
    return m.crossJoin(donors).crossJoin(F.broadcast(pool)).select("technique", "donor", F.round("given", 8).alias("slope"), error(F.col("given")).alias("error"), error(F.col("pool")).alias("pooled_error"))


@query("""WITH e AS (SELECT lang, source, quality, toxic, CASE WHEN n_chars < 400 THEN 'short' WHEN n_chars < 2000 THEN 'middle' ELSE 'long' END AS said, CASE WHEN quality = 1 AND toxic = 0 THEN 'sound' WHEN quality = 1 THEN 'toxic' ELSE 'junk' END AS truth FROM labels JOIN documents USING (doc_id))
SELECT truth, said, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY truth), 6) AS share FROM e GROUP BY 1, 2""")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each true class is taken for, and how often."""
    docs = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    said = F.when(F.col("n_chars") < 400, "short").when(F.col("n_chars") < 2000, "middle").otherwise("long")
    truth = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "sound").when(F.col("quality") == 1, "toxic").otherwise("junk")
    n = docs.groupBy(truth.alias("truth"), said.alias("said")).agg(F.count("*").alias("n"))
    return n.select("truth", "said", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("truth")), 6).alias("share"))


@query("""WITH s AS (SELECT n_chars AS score, count(*) AS n, sum(toxic) AS p FROM labels JOIN documents USING (doc_id) GROUP BY 1), c AS (SELECT score, p, sum(n) OVER (ORDER BY score DESC) AS above, sum(p) OVER (ORDER BY score DESC) AS hits, sum(p) OVER () AS total FROM s)
SELECT round(sum(p * hits / above) / any_value(total), 6) AS average_precision, round(max(2 * hits / (above + total)), 6) AS best_f1, arg_max(score, (round(2 * hits / (above + total), 9), score)) AS threshold FROM c""")
def precision_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision of a score, and the threshold of the best F1.

    Counts by distinct score go in; running sums over ranges of scores make the window as wide as the cluster.
    """
    docs = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    by = docs.groupBy(F.col("n_chars").alias("score")).agg(F.count("*").alias("n"), F.sum("toxic").alias("p"))
    c = learn.running_sums(by, "score", ["n", "p"])
    f1 = 2 * F.col("sum_p") / (F.col("sum_n") + F.col("all_p"))
    return c.agg(F.round(F.sum(F.col("p") * F.col("sum_p") / F.col("sum_n")) / F.first("all_p"), 6).alias("average_precision"), F.round(F.max(f1), 6).alias("best_f1"), F.max_by("score", F.struct(F.round(f1, 9).alias("f"), "score")).alias("threshold"))


DESCRIBED = f"""{LOGS}, d AS (SELECT artist, avg(y) AS a, avg(CAST(edition AS DOUBLE)) AS b, count(*) AS n FROM logs GROUP BY 1), z AS (SELECT artist, n, (a - avg(a) OVER ()) / stddev_pop(a) OVER () AS a, (b - avg(b) OVER ()) / stddev_pop(b) OVER () AS b FROM d)"""


@query(f"""WITH {DESCRIBED}, p AS (SELECT x.artist, y.artist AS donor, sqrt(2 * (x.a - y.a) ** 2 + (x.b - y.b) ** 2) AS dist, y.n FROM z x JOIN z y ON x.artist <> y.artist), t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY artist ORDER BY round(dist, 9), donor) AS k FROM p) WHERE k <= 10), w AS (SELECT *, exp(-dist / median(dist) OVER (PARTITION BY artist)) * sqrt(n) AS w FROM t)
SELECT artist, donor, CAST(k AS INTEGER) AS rank, round(dist, 6) AS distance, round(w / sum(w) OVER (PARTITION BY artist), 6) AS weight FROM w""")
def artist_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten donors for each artist, nearest in standardised descriptors, weighted by nearness and sales.

    Each artist's ten come from its own cell of a grid over the descriptors and the cells around, grown until they hold
    enough, so artists far apart are never paired.
    """
    d = logs(spark, sf_dir).groupBy("artist").agg(F.avg("y").alias("a"), F.avg(F.col("edition").cast("double")).alias("b"), F.count("*").alias("n"))
    whole = d.agg(*(f(c).alias(f"{n}_{c}") for c in "ab" for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    z = d.crossJoin(F.broadcast(whole)).select("artist", "n", *(((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).alias(c) for c in "ab"))
    near = learn.nearest(z, "artist", {"a": 2.0, "b": 1.0}, 10)
    mid = F.median("distance").over(Window.partitionBy("artist"))
    w = near.join(z.select(F.col("artist").alias("donor"), "n"), "donor").withColumn("w", F.exp(-F.col("distance") / mid) * F.sqrt("n"))
    return w.select("artist", "donor", "rank", F.round("distance", 6).alias("distance"), F.round(F.col("w") / F.sum("w").over(Window.partitionBy("artist")), 6).alias("weight"))


@query("""SELECT l_orderkey AS sale, l_linenumber AS lot, l_partkey AS work, CAST(l_linestatus = 'F' AS INTEGER) AS signed, round(ln(1 + l_quantity), 6) AS edition_log, round(ln(p_size), 6) AS size_log, CAST(year(l_shipdate) - 1995 AS INTEGER) AS year_index, """ + ", ".join(f"CAST(p_type = '{t}' AS INTEGER) AS is_{t.lower()}" for t in TYPES) + ", CAST(l_returnflag <> 'R' AS INTEGER) AS sold, round(least(l_tax / 0.08, 1), 6) AS premium_share FROM lineitem JOIN part ON l_partkey = p_partkey")
def price_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that a price model reads from each lot: logs, shares and one column for each technique."""
    lots = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    kinds = [(F.col("p_type") == t).cast("int").alias(f"is_{t.lower()}") for t in TYPES]
    return lots.select(F.col("l_orderkey").alias("sale"), F.col("l_linenumber").alias("lot"), F.col("l_partkey").alias("work"), (F.col("l_linestatus") == "F").cast("int").alias("signed"), F.round(F.log1p("l_quantity"), 6).alias("edition_log"), F.round(F.log("p_size"), 6).alias("size_log"), (F.year("l_shipdate") - 1995).alias("year_index"), *kinds, (F.col("l_returnflag") != "R").cast("int").alias("sold"), F.round(F.least(F.col("l_tax") / 0.08, F.lit(1.0)), 6).alias("premium_share"))


@query("""WITH c AS (SELECT DISTINCT o_custkey AS source, l_partkey AS work FROM lineitem JOIN orders ON l_orderkey = o_orderkey), p AS (SELECT p_partkey AS work, p_name AS title, p_brand AS catalogue, p_size FROM part),
same AS (SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_size = b.p_size AND a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey),
cat AS (SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_name = b.p_name AND a.p_size <> b.p_size AND a.p_partkey < b.p_partkey)
SELECT a, b, 1 AS label, 'same' AS kind FROM same UNION ALL SELECT a, b, 0, 'catalogue' FROM cat""")
def labelled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs to learn identity from: alike in title, catalogue and size, or in title and catalogue only."""
    p, members = joins.classes(works(spark, sf_dir).select("work", "title", "series", "size").dropna(), "work", ["title", "series", "size"])
    a, b = p.select(F.col("work").alias("a"), "title", "series", F.col("size").alias("x")), p.select(F.col("work").alias("b"), "title", "series", F.col("size").alias("y"))
    same = F.col("x") == F.col("y")
    pairs = a.join(b, ["title", "series"]).where("a <= b").select("a", "b", same.cast("int").alias("label"), F.when(same, "same").otherwise("catalogue").alias("kind"))
    return joins.expanded(pairs, members)


@query("""WITH s AS (SELECT DISTINCT l_suppkey AS artist, CAST(year(l_shipdate) // 5 * 5 AS INTEGER) AS period FROM lineitem) SELECT 'period' AS kind, CAST(period AS VARCHAR) AS node, count(*) AS edges FROM s GROUP BY 2
UNION ALL SELECT 'region', unnest(string_split(r_name || ' ' || n_name, ' ')) AS node, count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 2""")
def derived_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes made of attributes, five-year periods and the words of a nationality, with the artists tied to each."""
    from lotwise.sources.tables import artists

    period = sales(spark, sf_dir).select("artist", (F.floor(F.year("sale_date") / 5) * 5).cast("int").alias("p")).distinct()
    words = artists(spark, sf_dir).where("nationality IS NOT NULL").select(F.explode(F.split(F.concat_ws(" ", "region", "nationality"), " ")).alias("node"))
    first = period.groupBy(F.col("p").cast("string").alias("node")).agg(F.count("*").alias("edges")).select(F.lit("period").alias("kind"), "node", "edges")
    return first.unionByName(words.groupBy("node").agg(F.count("*").alias("edges")).select(F.lit("region").alias("kind"), "node", "edges"))


@query()
def label_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit vectors in six clusters by cosine, the best of three starts by silhouette."""
    return learn.clusters(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", 6, starts=3)


@query()
def graph_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artists embedded by a sparse random projection of their works, averaged over neighbours twice."""
    edges = sales(spark, sf_dir).select(F.col("artist").alias("a"), F.col("work").alias("b")).distinct()
    return learn.random_projection(edges, 16, 2, 42)


@query()
def boosted_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of gradient boosting on later sales after a fit to earlier ones, and without each feature in turn."""
    y = sales(spark, sf_dir).where("sold AND hammer > 0").groupBy("sale", "lot", "work").agg(F.avg(F.log(F.col("hammer").cast("double"))).alias("y"))
    f = durable(price_features(spark, sf_dir).join(y, ["sale", "lot", "work"]).select("signed", "edition_log", "size_log", "premium_share", "year_index", "y"))
    return learn.boosted(f, ["signed", "edition_log", "size_log", "premium_share"], "y", F.col("year_index") < 5)


@query()
def two_stage_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of classes of vectors held out: families first, then classes within the family that was found."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").alias("kind"), (F.col("label") % 3).alias("family"))
    return learn.two_stage(rows, "vec_id", "embedding", "family", "kind")


GAPS = ["edition", "size_log", "premium", "signed"]


def with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sold lots with features of which some are unknown: edition for a third, size for a fifth, signature for a half; year and y."""
    lots = described(spark, sf_dir)
    known = lambda c, share: F.when(F.pmod(F.xxhash64("work", "artist", "y", F.lit(c)), F.lit(share)) != 0, F.col(c))
    return lots.select("year", "y", known("x", 3).alias("edition"), known("z", 5).alias("size_log"), "premium", known("signed", 2).alias("signed"))


@query()
def boosted_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error on later sales of trees on histograms fitted to earlier ones, nulls sent the better way, and with each feature's values dealt out anew."""
    lots = with_gaps(spark, sf_dir)
    model = boosting.fit(lots.where("year < 2000"), GAPS, "y")
    return boosting.importance(lots.where("year >= 2000"), model, "y").select(F.coalesce("feature", F.lit("")).alias("dealt_anew"), "n", F.round("mae", 6).alias("mae"), F.round("within_double", 6).alias("within_double"))
