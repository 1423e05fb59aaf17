"""Vectors, linkage and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwise.functions import vectors
from lotwise.operators import cells, changes, clusters, graph, joins, linkage, ranking
from lotwise.operators.durable import durable
from lotwise.plans import Registry
from lotwise.sources.tables import artists, sales, table, works

REGISTRY = Registry()
query = REGISTRY

NEAR = 0.25
#: Classes whose vectors are sent to every task at most.
CLASSES = 10_000
VECTORS = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", vectors.unit(vectors.doubles(F.col("embedding"))).alias("e"))


@query(f"""WITH {VECTORS}, c AS (SELECT label, list(m ORDER BY i) AS m FROM (SELECT label, i, avg(e[i] / sqrt(list_inner_product(e, e))) AS m FROM v, range(1, 65) r(i) GROUP BY 1, 2) GROUP BY label)
SELECT vec_id, v.label, round(list_cosine_similarity(e, m), 6) AS to_class, round((1 + list_cosine_similarity(e, m)) / 2, 6) AS stored FROM v JOIN c ON v.label = c.label""")
def class_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness of each vector to the mean of its class."""
    v = embedded(spark, sf_dir)
    means = v.select("label", F.posexplode("e").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    mid = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m"))
    c = vectors.cosine(F.col("e"), F.col("m"))
    return v.join(mid, "label").select("vec_id", "label", F.round(c, 6).alias("to_class"), F.round(vectors.stored_scale(c), 6).alias("stored"))


@query(f"""WITH {VECTORS}, c AS (SELECT label, list(m ORDER BY i) AS m FROM (SELECT label, i, avg(e[i] / sqrt(list_inner_product(e, e))) AS m FROM v, range(1, 65) r(i) GROUP BY 1, 2) GROUP BY label),
s AS (SELECT vec_id, c.label, list_cosine_similarity(e, m) AS s FROM v, c), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS n FROM s)
SELECT a.vec_id, a.label AS best, round(a.s - b.s, 6) AS margin, a.s - b.s >= 0.02 AS confident FROM r a JOIN r b ON a.vec_id = b.vec_id AND a.n = 1 AND b.n = 2""")
def zero_shot_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest class of each vector and how far the second lies behind; up to ``CLASSES`` classes go to every task."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    mid = cells.class_means(v, "label", "embedding")
    classes = [(r.label, r.m) for r in mid.limit(CLASSES + 1).collect()]
    if len(classes) > CLASSES:
        raise ValueError(f"more than {CLASSES} classes")
    found = cells.nearest_class(v.where("embedding IS NOT NULL"), "vec_id", "embedding", classes)
    return found.select("vec_id", F.col("best").cast("int").alias("best"), F.round("margin", 6).alias("margin"), (F.col("margin") >= 0.02).alias("confident"))


PAIRS = f"""{VECTORS}, p AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id)"""


@query(f"WITH {PAIRS} SELECT label, count(*) AS pairs, round(quantile_cont(s, 0.95), 6) AS p95, round(quantile_cont(s, 0.99), 6) AS p99 FROM p GROUP BY label HAVING count(*) >= 30")
def background_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike unrelated members of a class are: the level a match must beat."""
    found = cells.group_quantiles(embedded(spark, sf_dir), "label", "vec_id", "e", [0.95, 0.99], 30)
    return found.select("label", "pairs", F.round(F.col("values")[0], 6).alias("p95"), F.round(F.col("values")[1], 6).alias("p99"))


@query(f"""WITH {PAIRS}, e AS (SELECT a AS x, b AS y, s FROM p UNION ALL SELECT b, a, s FROM p), r AS (SELECT x, s, row_number() OVER (PARTITION BY x ORDER BY s DESC, y) AS n FROM e WHERE s < 0.9)
SELECT x AS vec_id, round(max(s), 6) AS best, round(avg(s), 6) AS mean_top FROM r WHERE n <= 5 GROUP BY x""")
def style_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean likeness of each vector to the five nearest of its class, the same image left out."""
    near = cells.within_groups(embedded(spark, sf_dir), "label", "vec_id", "e", cells.best_below(5, 0.9), "a long, b long, s double")
    return ranking.top(near.select(F.col("a").alias("vec_id"), F.col("b").alias("other"), "s"), ["vec_id"], [F.desc("s"), F.col("other")], 5).groupBy("vec_id").agg(F.round(F.max("s"), 6).alias("best"), F.round(F.avg("s"), 6).alias("mean_top"))


@query(f"""WITH RECURSIVE {PAIRS}, e AS (SELECT a AS x, b AS y FROM p WHERE s >= {NEAR} UNION SELECT b, a FROM p WHERE s >= {NEAR}), reach AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON e.x = r.y)
SELECT x AS node, min(least(x, y)) AS component FROM reach GROUP BY x""")
def likeness_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of vectors of a class that are chained by likeness."""
    links = cells.within_groups(embedded(spark, sf_dir), "label", "vec_id", "e", cells.links_from(NEAR), "a long, b long")
    return graph.least_reachable(links)


CONNECTED = """WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS x, l_partkey AS y FROM lineitem),
pairs AS (SELECT DISTINCT a.x AS a, b.x AS b FROM e a JOIN e b ON a.y = b.y AND a.x <> b.x), reach AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a)
SELECT a AS node, least(a, min(b)) AS component FROM reach GROUP BY a"""


@query(CONNECTED)
def artist_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artists connected through works they share; a work's artists are tied to the least of them, so no pairs are made."""
    lots = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("work")).distinct()
    least = lots.groupBy("work").agg(F.min("a").alias("b"))
    return graph.least_reachable(lots.join(least, "work").where("a <> b").select("a", "b").distinct())


@query("""SELECT l_suppkey AS artist, round(sum(CASE WHEN l_returnflag = 'A' THEN 1.0 WHEN l_returnflag = 'N' THEN 0.5 ELSE 0.1 END), 4) AS degree, count(*) AS edges FROM lineitem GROUP BY 1""")
def weighted_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each artist's edges weighted by how sure the attribution is."""
    weight = F.when(F.col("l_returnflag") == "A", 1.0).when(F.col("l_returnflag") == "N", 0.5).otherwise(0.1)
    d = graph.weighted_degree(table(spark, sf_dir, "lineitem"), "l_suppkey", weight)
    return d.select(F.col("l_suppkey").alias("artist"), F.round("degree", 4).alias("degree"), "edges")


SIMILAR = """WITH h AS (SELECT DISTINCT l_suppkey AS node, p_brand || p_type || (p_size // 10) AS feature FROM lineitem JOIN part ON l_partkey = p_partkey), s AS (SELECT node, count(*) AS n FROM h GROUP BY 1 HAVING count(*) >= 5),
p AS (SELECT a.node AS a, b.node AS b, sa.n AS na, sb.n AS nb, count(*) AS common FROM h a JOIN h b ON a.feature = b.feature AND a.node <> b.node JOIN s sa ON sa.node = a.node JOIN s sb ON sb.node = b.node GROUP BY 1, 2, 3, 4),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY common / (na + nb - common) DESC, b) AS rank FROM p) SELECT a, b, CAST(rank AS INTEGER) AS rank, round(common / (na + nb - common), 6) AS similarity FROM r WHERE rank <= 5"""


@query(SIMILAR)
def similar_artists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each artist's five most similar by the kinds of work sold."""
    kind = F.concat("series", "technique", F.floor(F.col("size") / 10).cast("string"))
    edges = sales(spark, sf_dir).select("artist", "work").distinct().join(works(spark, sf_dir).withColumn("kind", kind).select("work", "kind"), "work")
    return graph.similar_nodes(edges, "artist", "kind", 5, 5).select("a", "b", "rank", F.round("similarity", 6).alias("similarity"))


@query("""WITH n AS (SELECT c_custkey AS id, c_name AS name FROM customer), r AS (SELECT s_suppkey AS target, s_name AS name FROM supplier),
x AS (SELECT n.id, a.target AS exact, b.target AS by_number FROM n LEFT JOIN (SELECT name, min(target) AS target FROM r GROUP BY 1) a ON n.name = a.name LEFT JOIN (SELECT CAST(split_part(name, '#', 2) AS BIGINT) AS k, min(target) AS target FROM r GROUP BY 1) b ON CAST(split_part(n.name, '#', 2) AS BIGINT) = b.k)
SELECT id, coalesce(exact, by_number) AS target, CAST(CASE WHEN exact IS NOT NULL THEN 1 WHEN by_number IS NOT NULL THEN 2 END AS INTEGER) AS level FROM x""")
def name_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names looked up in turn as they are and by their number."""
    left = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    right = artists(spark, sf_dir).select(F.col("artist").alias("target"), F.col("name").alias("known"))
    key = lambda c: F.element_at(F.split(c, "#"), 2).cast("long")
    return joins.fallback(left, right, [(F.col("name"), F.col("known")), (key("name"), key("known"))], "target", "target").select("id", "target", "level")


@query("""WITH a AS (SELECT p_name, p_brand, p_partkey FROM part WHERE p_size <= 25), b AS (SELECT p_name, p_brand, p_partkey FROM part WHERE p_size > 25), ka AS (SELECT p_name, p_brand, min(p_partkey) AS a FROM a GROUP BY 1, 2 HAVING count(*) = 1), kb AS (SELECT p_name, p_brand, min(p_partkey) AS b FROM b GROUP BY 1, 2 HAVING count(*) = 1)
SELECT a, b FROM ka JOIN kb USING (p_name, p_brand)""")
def one_to_one_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small and large works of the same title and series, where that names one of each."""
    w = works(spark, sf_dir).withColumn("key", F.concat_ws("|", "title", "series"))
    a, b = w.where("size <= 25").select("key", F.col("work").alias("a")), w.where("size > 25").select("key", F.col("work").alias("b"))
    return joins.one_to_one(a, b, "key").select("a", "b")


@query("""SELECT p_brand AS series, p_type AS technique, count(*) AS works, count(DISTINCT p_size) AS sizes FROM part GROUP BY 1, 2 HAVING count(*) > 1 AND count(DISTINCT p_name) < count(*)""")
def catalogue_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series and techniques that repeat a title."""
    return works(spark, sf_dir).groupBy("series", "technique").agg(F.count("*").alias("works"), F.count_distinct("size").alias("sizes"), F.count_distinct("title").alias("t")).where("works > 1 and t < works").drop("t")


@query("""SELECT l_partkey AS work, CAST(count(DISTINCT survivor) AS BIGINT) AS artists FROM (SELECT l_partkey, CASE WHEN s_acctbal < 0 THEN (SELECT min(s_suppkey) FROM supplier WHERE s_acctbal >= 0) ELSE s_suppkey END AS survivor FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) GROUP BY 1""")
def merged_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works' artists after some artists were merged into one."""
    s = table(spark, sf_dir, "supplier")
    target = s.where("s_acctbal >= 0").agg(F.min("s_suppkey").alias("survivor"))
    merges = s.where("s_acctbal < 0").select(F.col("s_suppkey").alias("old")).crossJoin(F.broadcast(target))
    edges = sales(spark, sf_dir).select("work", "artist")
    return changes.repoint(edges, merges, "artist").groupBy("work").agg(F.count("*").alias("artists"))


#: Works are the same by title, series, technique, size and price; candidates share two or three of these.
SAME = [linkage.Comparison("title", by_frequency=True), linkage.Comparison("series", by_frequency=True), linkage.Comparison("technique"), linkage.Comparison("size", near=2), linkage.Comparison("list_price", near=20)]
RULES = [["title", "series"], ["title", "technique", "size"], ["series", "technique", "size"]]
#: Chances given beforehand, levels from none to full agreement.
GIVEN = linkage.Chances(0.0005, {"title": [0.05, 0.95], "series": [0.1, 0.9], "technique": [0.15, 0.85], "size": [0.1, 0.2, 0.7], "list_price": [0.2, 0.3, 0.5]}, {"title": [0.98, 0.02], "series": [0.96, 0.04], "technique": [0.83, 0.17], "size": [0.9, 0.08, 0.02], "list_price": [0.6, 0.39, 0.01]})
AGREED = {"title": "a.p_name = b.p_name", "series": "a.p_brand = b.p_brand", "technique": "a.p_type = b.p_type", "size": "a.p_size = b.p_size"}
_ALL = lambda rule: " AND ".join(AGREED[c] for c in rule)
_RATIO = lambda c, level: f"log2({GIVEN.m[c][level]} / {GIVEN.u[c][level]}::DOUBLE)"
LINKED = f"""n AS (SELECT *, count(*) OVER (PARTITION BY p_name) / (count(*) OVER ())::DOUBLE AS ft, count(*) OVER (PARTITION BY p_brand) / (count(*) OVER ())::DOUBLE AS fs FROM part),
p AS (SELECT a.p_partkey AS a, b.p_partkey AS b, CASE {' '.join(f'WHEN {_ALL(r)} THEN {i}' for i, r in enumerate(RULES, 1))} END AS rule,
  CASE WHEN {AGREED['title']} THEN log2({GIVEN.m['title'][1]} / a.ft) ELSE {_RATIO('title', 0)} END + CASE WHEN {AGREED['series']} THEN log2({GIVEN.m['series'][1]} / a.fs) ELSE {_RATIO('series', 0)} END + CASE WHEN {AGREED['technique']} THEN {_RATIO('technique', 1)} ELSE {_RATIO('technique', 0)} END
  + CASE WHEN a.p_size = b.p_size THEN {_RATIO('size', 2)} WHEN abs(a.p_size - b.p_size) <= 2 THEN {_RATIO('size', 1)} ELSE {_RATIO('size', 0)} END + CASE WHEN a.p_retailprice = b.p_retailprice THEN {_RATIO('list_price', 2)} WHEN abs(a.p_retailprice - b.p_retailprice) <= 20 THEN {_RATIO('list_price', 1)} ELSE {_RATIO('list_price', 0)} END AS weight
  FROM n a JOIN n b ON a.p_partkey < b.p_partkey AND a.p_name = b.p_name AND ({_ALL(RULES[0])} OR {_ALL(RULES[1])})
  UNION ALL SELECT a.p_partkey, b.p_partkey, 3, {_RATIO('title', 0)} + log2({GIVEN.m['series'][1]} / a.fs) + {_RATIO('technique', 1)} + {_RATIO('size', 2)} + CASE WHEN a.p_retailprice = b.p_retailprice THEN {_RATIO('list_price', 2)} WHEN abs(a.p_retailprice - b.p_retailprice) <= 20 THEN {_RATIO('list_price', 1)} ELSE {_RATIO('list_price', 0)} END
  FROM n a JOIN n b ON {_ALL(RULES[2])} AND a.p_partkey < b.p_partkey AND a.p_name <> b.p_name),
linked AS (SELECT a, b, rule, weight, 1 / (1 + pow(2, -weight) * {1 - GIVEN.match} / {GIVEN.match}) AS probability FROM p)"""


def linked(spark: SparkSession, sf_dir: str, least: float) -> DataFrame:
    return linkage.links(works(spark, sf_dir), "work", SAME, RULES, GIVEN, least)


@query(f"WITH {LINKED} SELECT a AS work_a, b AS work_b, rule, round(weight, 6) AS weight, round(probability, 6) AS probability FROM linked WHERE probability >= 0.01")
def linkage_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of works that may be one, by chances given beforehand, with the rule that made each pair; rare titles and series weigh more."""
    found = linked(spark, sf_dir, 0.01)
    return found.select(F.col("a").alias("work_a"), F.col("b").alias("work_b"), "rule", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"))


@query()
def linkage_chances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chances of each level of agreement among matches and others, learnt from random pairs and from the pairs of each rule."""
    found = linkage.fit(works(spark, sf_dir), "work", SAME, RULES)
    rows = [(c, level, round(m, 6), round(u, 6), round(found.match, 9)) for c in found.m for level, (m, u) in enumerate(zip(found.m[c], found.u[c], strict=True))]
    return spark.createDataFrame(rows, "comparison string, level int, m double, u double, share double")


#: Entries of works in two catalogues; letters after a number name an edition.
ENTRIES_SQL = "SELECT p_partkey AS node, p_brand AS prefix, CAST(p_size % 7 AS {0}) || CASE WHEN p_partkey % 3 = 0 THEN 'Bd' ELSE '' END AS number FROM part UNION ALL SELECT p_partkey, 'General', CAST(p_partkey % 9 AS {0}) FROM part WHERE p_partkey % 2 = 0"
#: The year of a work, unknown for some.
YEAR_SQL = "CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 1900 + (p_partkey * 7) % 40 END"
SPREAD = 30


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    own = part.select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("prefix"), F.concat((F.col("p_size") % 7).cast("string"), F.when(F.col("p_partkey") % 3 == 0, "Bd").otherwise("")).alias("number"))
    return own.unionByName(part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("node"), F.lit("General").alias("prefix"), (F.col("p_partkey") % 9).cast("string").alias("number")))


JUDGED = f"""{LINKED}, entries AS ({ENTRIES_SQL.format('VARCHAR')}), pairs AS (SELECT a, b, probability AS confidence FROM linked WHERE probability >= 0.01),
same AS (SELECT a, b, bool_or(x.number = y.number) AS whole, bool_or(regexp_extract(x.number, '^[0-9]*') = regexp_extract(y.number, '^[0-9]*')) AS head FROM pairs JOIN entries x ON x.node = a JOIN entries y ON y.node = b AND x.prefix = y.prefix GROUP BY 1, 2),
judged AS (SELECT p.*, CASE WHEN s.a IS NULL THEN 'silent' WHEN whole THEN 'agree' WHEN head THEN 'silent' ELSE 'conflict' END AS verdict FROM pairs p LEFT JOIN same s ON s.a = p.a AND s.b = p.b)"""


def known_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works with what catalogues know of each."""
    known = clusters.numbers(entries(spark, sf_dir)).withColumnRenamed("node", "work")
    return works(spark, sf_dir).join(known, "work", "left").withColumn("known", F.coalesce("known", F.array()))


def linked_classes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes of works that their columns don't tell apart, and the classes' members with what catalogues know of each; the classes are compared once, however many numbers catalogues have for copies."""
    pairs, members = linkage.class_links(works(spark, sf_dir), "work", SAME, RULES, GIVEN, 0.01)
    known = members.join(clusters.numbers_by_prefix(entries(spark, sf_dir)), "node", "left")
    return pairs.select("a", "b", F.col("probability").alias("confidence")), known.withColumn("by", F.coalesce("by", F.array()))


def judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Verdicts on pairs of classes of works that neither their columns nor catalogues tell apart, and the classes' members."""
    pairs, known = linked_classes(spark, sf_dir)
    inside = Window.partitionBy("rep", "by").orderBy("node")
    members = durable(known.withColumns({"own": F.first("node").over(inside), "place": F.row_number().over(inside) - 1}))
    finer = members.groupBy("rep", "own").agg(F.first("by").alias("by"), F.count("*").alias("n"))
    of = lambda c, name: finer.select(F.col("rep").alias(c), F.col("own").alias(f"_{name}"), F.col("by").alias(f"_by{name}"), F.col("n").alias(f"_n{name}"))
    both = pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").where("a <> b OR _x < _y OR _x = _y AND _nx > 1")
    found = both.select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"), "confidence", clusters.verdict(F.col("_byx"), F.col("_byy")).alias("verdict"))
    return found, members.select(F.col("own").alias("rep"), "node", "place")


@query(f"WITH {JUDGED} SELECT a, b, round(confidence, 6) AS confidence, verdict FROM judged")
def pair_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What catalogues say of pairs that may be one work: agreement, conflict of digits, or nothing."""
    found = linkage.links(known_works(spark, sf_dir), "work", SAME, RULES, GIVEN, 0.01, "known", clusters.verdict_table)
    verdict = F.element_at(F.array(*map(F.lit, clusters.VERDICTS)), F.col("told") + 1)
    return found.select("a", "b", F.round("probability", 6).alias("confidence"), verdict.alias("verdict"))


@query(f"""WITH RECURSIVE {JUDGED}, kept AS (SELECT DISTINCT a, b, confidence FROM judged WHERE verdict <> 'conflict'), e AS (SELECT a AS x, b AS y FROM kept UNION SELECT b, a FROM kept), reach AS (SELECT x, x AS y FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON e.x = r.y),
found AS (SELECT x AS node, min(y) AS cluster FROM reach GROUP BY 1), sure AS (SELECT cluster, min(confidence) AS confidence FROM kept JOIN found ON node = a GROUP BY 1), broken AS (SELECT x.cluster, count(*) AS n FROM judged JOIN found x ON x.node = a JOIN found y ON y.node = b AND y.cluster = x.cluster WHERE verdict = 'conflict' GROUP BY 1),
facts AS (SELECT cluster, count(*) AS size, min({YEAR_SQL}) AS first, max({YEAR_SQL}) AS last FROM found JOIN part ON p_partkey = node GROUP BY 1)
SELECT node, cluster, size, round(s.confidence, 6) AS confidence, CASE WHEN b.n > 0 THEN CAST(b.n AS VARCHAR) || ' rejected within' WHEN last - first > {SPREAD} THEN 'years ' || CAST(first AS VARCHAR) || ' to ' || CAST(last AS VARCHAR) END AS reason FROM found JOIN facts USING (cluster) JOIN sure s USING (cluster) LEFT JOIN broken b USING (cluster)""")
def held_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works chained into clusters by pairs without a conflict, and the clusters that a conflict within or their years hold back."""
    found, sure, broken = linkage.chained(known_works(spark, sf_dir), "work", SAME, RULES, GIVEN, 0.01, "known", clusters.verdict_table, clusters.VERDICTS.index("conflict"))
    years = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.expr(YEAR_SQL).cast("int").alias("year"))
    return clusters.clusters_of(found, sure, broken, years, SPREAD).withColumn("confidence", F.round("confidence", 6))


#: What makes works candidates of each other: title and year, a catalogue's number, an edition's siblings, an anchor of a museum, a title alone.
GENERATORS = {"title and year": ["p_name", YEAR_SQL], "catalogue": ["p_brand", "p_size % 7"], "edition siblings": ["p_name", "p_brand", "p_type"], "anchor": ["CASE WHEN p_size > 25 THEN p_name END", "CASE WHEN p_type = 'PROMO' THEN NULL ELSE p_brand END"], "title": ["p_name"]}
MOST = 300


@query("WITH g AS (" + " UNION ALL ".join(f"SELECT '{g}' AS generator, {' || {0} || '.format(chr(39) + '|' + chr(39)).join(f'CAST({c} AS VARCHAR)' for c in cs)} AS key, p_partkey AS node FROM part" for g, cs in GENERATORS.items()) + f"), m AS (SELECT DISTINCT * FROM g WHERE key IS NOT NULL), s AS (SELECT *, count(*) OVER (PARTITION BY generator, key) AS size FROM m) SELECT * FROM s WHERE size BETWEEN 2 AND {MOST}")
def candidate_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works that share a key of one of five generators, keys of up to three hundred works."""
    return clusters.generated(table(spark, sf_dir, "part"), "p_partkey", {g: [F.expr(c) for c in cs] for g, cs in GENERATORS.items()}, MOST)


@query(f"WITH e AS ({ENTRIES_SQL.format('VARCHAR')}) SELECT p_name || '|' || p_brand || '|' || p_type AS cluster, prefix, string_agg(DISTINCT number, ',' ORDER BY number) AS numbers FROM part JOIN e ON node = p_partkey GROUP BY 1, 2 HAVING count(DISTINCT number) > 1")
def cluster_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edition siblings that a catalogue knows under several numbers, whole numbers compared."""
    members = table(spark, sf_dir, "part").select(F.concat_ws("|", "p_name", "p_brand", "p_type").alias("cluster"), F.col("p_partkey").alias("node"))
    return clusters.entry_conflicts(members, entries(spark, sf_dir)).withColumn("numbers", F.array_join("numbers", ","))
