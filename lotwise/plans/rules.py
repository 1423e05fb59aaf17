"""Decision tables: who made a lot, which work it is, where it goes next, and what may be stored or said of it.

A part stands for a lot whose evidence (signature, image match, appraiser, embedding) is made of its columns; artists are
suppliers and what is known of them comes from their sales.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.functions import text
from lotwise.plans import Registry
from lotwise.plans.textual import KEYED
from lotwise.sources.tables import sales, table

REGISTRY = Registry()
query = REGISTRY

#: Confidence bands, the lowest first, and the mean confidence of agreeing sources below which a band is lowered.
BANDS, FLOOR = ("LOW", "MEDIUM", "MEDIUM_HIGH", "HIGH"), 0.8
#: Likeness at which an image match is a vote, and at which it is a strong one.
VOTE, STRONG = 0.75, 0.85
#: What each source says of lot p: when it speaks, whom it names, how sure it is.  H is a guess of the appraiser, which is no vote.
SOURCES = (
    ("V", "p_size % 2 = 0", "p_partkey % 10", "CASE WHEN p_size % 5 = 0 THEN 0.5 ELSE 0.45 + (p_size % 6) / 10.0 END"),
    ("R", "p_partkey % 3 <> 0", "(p_partkey + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END) % 10", "0.6 + (p_size % 10) / 25.0"),
    ("A", "p_partkey % 4 = 1", "(p_partkey + CASE WHEN p_partkey % 13 = 0 THEN 3 ELSE 0 END) % 10", "0.85"),
    ("D", "p_partkey % 7 IN (1, 2, 3)", "(p_partkey + CASE WHEN p_partkey % 11 = 0 THEN 2 ELSE 0 END) % 10", "0.9"),
    ("H", "p_partkey % 4 = 3", "(p_partkey + CASE WHEN p_partkey % 17 = 0 THEN 4 ELSE 0 END) % 10", "0.5"),
)
#: A signature that can be read.
LEGIBLE = "p_size % 5 <> 0"
IS_VOTE = f"source <> 'H' AND (source <> 'R' OR sure >= {VOTE})"
VOTES = "said AS (" + " UNION ALL ".join(f"SELECT p_partkey AS lot, '{s}' AS source, CAST({who} AS BIGINT) AS artist, round(CAST({sure} AS DOUBLE), 3) AS sure, {LEGIBLE} AS legible FROM part WHERE {when}" for s, when, who, sure in SOURCES) + f"), votes AS (SELECT lot, source, artist, sure FROM said WHERE {IS_VOTE})"


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lot, source, artist, sure, legible``: one row for each source that names somebody."""
    part = table(spark, sf_dir, "part")
    each = [part.where(when).select(F.col("p_partkey").alias("lot"), F.lit(s).alias("source"), F.expr(who).cast("long").alias("artist"), F.round(F.expr(sure).cast("double"), 3).alias("sure"), F.expr(LEGIBLE).alias("legible")) for s, when, who, sure in SOURCES]
    return reduce(DataFrame.unionByName, each)


def band_sql(level: str) -> str:
    return f"CASE least(greatest({level}, 0), 3) " + " ".join(f"WHEN {i} THEN '{b}'" for i, b in enumerate(BANDS)) + " END"


def band(level: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, BANDS)), F.least(F.greatest(level, F.lit(0)), F.lit(3)) + 1)


KNOWN = "known AS (SELECT l_suppkey AS artist, count(DISTINCT l_partkey) AS works FROM lineitem GROUP BY 1)"
ARTIST_PASS = f"""{VOTES}, {KNOWN}, agreed AS (SELECT lot, artist, count(*) AS n, avg(sure) AS sure, string_agg(source, '' ORDER BY source) AS sources FROM votes GROUP BY 1, 2),
overruled AS (SELECT DISTINCT a.lot FROM said a JOIN said v ON a.lot = v.lot AND a.source = 'A' AND v.source = 'V' AND v.legible AND a.artist <> v.artist), guesses AS (SELECT lot, artist AS guess FROM said WHERE source = 'H'),
largest AS (SELECT lot, max(n) AS n, CASE WHEN lot IN (SELECT lot FROM overruled) THEN 2 ELSE sum(CASE WHEN n = m THEN 1 ELSE 0 END) END AS tops FROM (SELECT *, max(n) OVER (PARTITION BY lot) AS m FROM agreed) GROUP BY 1),
settled AS (SELECT c.lot, c.artist, c.n, c.sure, c.sources, coalesce(k.works, 0) AS works, CASE WHEN coalesce(k.works, 0) >= 100 THEN 1 WHEN coalesce(k.works, 0) >= 1 THEN 0 ELSE -1 END AS lift FROM agreed c JOIN largest t ON t.lot = c.lot AND c.n = t.n AND t.tops = 1 LEFT JOIN known k ON k.artist = c.artist),
judged AS (SELECT settled.*, guess, CASE WHEN n >= 3 THEN 3 WHEN n = 2 THEN 2 WHEN sources = 'V' AND sure < 0.6 THEN 0 WHEN sources = 'R' AND sure < {STRONG} THEN 0 ELSE 1 END AS base,
  CASE WHEN n >= 3 THEN 'A1' WHEN n = 2 THEN CASE lift WHEN 1 THEN 'A2' WHEN 0 THEN 'A3' ELSE 'A4' END WHEN sources = 'V' THEN 'A5' WHEN sources = 'R' THEN CASE WHEN sure >= {STRONG} THEN 'A6' ELSE 'A7' END WHEN sources = 'D' THEN 'A6D' ELSE 'A8' END AS code FROM settled LEFT JOIN guesses USING (lot)),
scored AS (SELECT *, least(greatest(greatest(base - CASE WHEN sure < {FLOOR} THEN 1 ELSE 0 END, 0) + CASE WHEN lift < 0 AND n <> 2 THEN 0 ELSE lift END, 0), 3) AS level FROM judged),
artist_pass AS (SELECT p_partkey AS lot, CASE WHEN t.lot IS NULL THEN 'not_attributed' WHEN t.tops > 1 THEN 'conflict' WHEN s.n >= 2 THEN 'attributed' ELSE 'candidate' END AS verdict, s.artist, CASE WHEN t.lot IS NULL THEN CASE WHEN g.guess IS NULL THEN 'A11' ELSE 'A9' END WHEN t.tops > 1 THEN 'A10' ELSE s.code END AS code, coalesce(s.sources, '') AS sources,
  CASE WHEN s.lot IS NOT NULL THEN {band_sql("level + CASE WHEN s.n = 1 AND s.guess = s.artist THEN 1 ELSE 0 END")} WHEN t.lot IS NULL AND g.guess IS NOT NULL THEN 'LOW' END AS confidence FROM part LEFT JOIN largest t ON t.lot = p_partkey LEFT JOIN scored s ON s.lot = p_partkey LEFT JOIN guesses g ON g.lot = p_partkey)"""


def artist_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lot, verdict, artist, code, sources, confidence``.

    Sources that agree form a set; the largest decides unless another is as large.  Its size sets the band, doubtful
    sources lower it, and what is known of the artist moves it, down only where two agree.  The appraiser's guess is no
    vote: it lifts a single source that names the same artist, and alone attributes nothing.  Papers that name another
    artist than a legible signature are a conflict whatever else is said.
    """
    known = sales(spark, sf_dir).groupBy("artist").agg(F.count_distinct("work").alias("works"))
    said = claims(spark, sf_dir)
    named = lambda s, when=True: F.max(F.when((F.col("source") == s) & when, F.col("artist")))
    asides = said.groupBy("lot").agg(named("H").alias("guess"), named("A").alias("papers"), named("V", F.col("legible")).alias("signature"))
    sets = said.where(IS_VOTE).groupBy("lot", "artist").agg(F.count("*").alias("n"), F.avg("sure").alias("sure"), F.array_join(F.array_sort(F.collect_list("source")), "").alias("sources"))
    best = sets.groupBy("lot").agg(F.max_by(F.struct("artist", "n", "sure", "sources"), F.struct("n", "artist")).alias("d"), F.sort_array(F.collect_list("n"), asc=False).alias("ns"))
    tied = ((F.size("ns") > 1) & (F.try_element_at("ns", F.lit(2)) == F.element_at("ns", 1))) | F.coalesce(F.col("papers") != F.col("signature"), F.lit(False))
    d = asides.join(best, "lot", "left").where("d IS NOT NULL OR guess IS NOT NULL").select("lot", "guess", tied.alias("tied"), "d.*").join(known, "artist", "left")
    n, sure, one = F.col("n"), F.col("sure"), F.col("sources")
    lift = F.when(F.coalesce("works", F.lit(0)) >= 100, 1).when(F.coalesce("works", F.lit(0)) >= 1, 0).otherwise(-1)
    base = F.when(n >= 3, 3).when(n == 2, 2).when((one == "V") & (sure < 0.6), 0).when((one == "R") & (sure < STRONG), 0).otherwise(1)
    code = F.when(n >= 3, "A1").when(n == 2, F.when(lift == 1, "A2").when(lift == 0, "A3").otherwise("A4")).when(one == "V", "A5").when((one == "R") & (sure >= STRONG), "A6").when(one == "R", "A7").when(one == "D", "A6D").otherwise("A8")
    lowered = F.greatest(base - (sure < FLOOR).cast("int"), F.lit(0))
    level = F.least(F.greatest(lowered + F.when((lift < 0) & (n != 2), 0).otherwise(lift), F.lit(0)), F.lit(3)) + F.when((n == 1) & (F.col("guess") == F.col("artist")), 1).otherwise(0)
    silent, settled = n.isNull(), ~F.col("tied")
    judged = d.select(
        "lot", F.when(settled, F.col("artist")).alias("artist"), F.when(silent, "A9").when(settled, code).otherwise("A10").alias("code"), F.when(settled, one).otherwise("").alias("sources"),
        F.when(silent, BANDS[0]).when(settled, band(level)).alias("confidence"), F.when(silent, "not_attributed").when(~settled, "conflict").when(n >= 2, "attributed").otherwise("candidate").alias("verdict"),
    )
    lots = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("lot"))
    return lots.join(judged, "lot", "left").select("lot", F.coalesce("verdict", F.lit("not_attributed")).alias("verdict"), "artist", F.coalesce("code", F.lit("A11")).alias("code"), F.coalesce("sources", F.lit("")).alias("sources"), "confidence")


@query(f"WITH {ARTIST_PASS} SELECT * FROM artist_pass")
def artist_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who made each lot, by which rule, and how sure that is."""
    return artist_verdicts(spark, sf_dir)


TITLES = (("V", "p_size % 3 <> 0", "p_name"), ("R", "p_partkey % 4 <> 0", "CASE WHEN p_partkey % 9 = 0 THEN 'the ' || p_name ELSE p_name END"), ("A", "p_partkey % 5 = 0", "CASE WHEN p_partkey % 20 = 0 THEN 'old map' ELSE p_name END"))
TITLE_VOTES = "titles AS (" + " UNION ALL ".join(f"SELECT p_partkey AS lot, '{s}' AS source, regexp_replace({KEYED.format('(' + c + ')')}, '^(the|a) ', '') AS title FROM part WHERE {when}" for s, when, c in TITLES) + ")"
WORK_PASS = f"""{TITLE_VOTES}, names AS (SELECT {KEYED.format('p_name')} AS title, count(DISTINCT l_orderkey) AS records FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1), tc AS (SELECT lot, title, count(*) AS n FROM titles GROUP BY 1, 2),
tt AS (SELECT lot, max(n) AS n, count(*) FILTER (n = m) AS tops FROM (SELECT *, max(n) OVER (PARTITION BY lot) AS m FROM tc) GROUP BY 1),
work_pass AS (SELECT p_partkey AS lot, CASE WHEN tt.lot IS NULL THEN 'unidentified' WHEN tops > 1 THEN 'conflict' WHEN tc.n >= 2 AND coalesce(records, 0) > 0 THEN 'identified' ELSE 'candidate' END AS verdict, CASE WHEN tops = 1 THEN tc.title END AS title, CASE WHEN tt.lot IS NULL THEN 'T9' WHEN tops > 1 THEN 'T8' WHEN tc.n >= 2 AND coalesce(records, 0) >= 3 THEN 'T1' WHEN tc.n >= 2 AND coalesce(records, 0) > 0 THEN 'T2' WHEN tc.n >= 2 THEN 'T3' WHEN coalesce(records, 0) > 0 THEN 'T4' ELSE 'T5' END AS code
  FROM part LEFT JOIN tt ON tt.lot = p_partkey LEFT JOIN tc ON tc.lot = tt.lot AND tc.n = tt.n AND tops = 1 LEFT JOIN names ON names.title = tc.title)"""


def work_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lot, verdict, title, code``: the title most sources agree on, articles aside, and whether records bear it out."""
    part = table(spark, sf_dir, "part")
    said = [part.where(when).select(F.col("p_partkey").alias("lot"), F.lit(s).alias("source"), F.regexp_replace(text.title_key(F.expr(c)), "^(the|a) ", "").alias("title")) for s, when, c in TITLES]
    counts = reduce(DataFrame.unionByName, said).groupBy("lot", "title").agg(F.count("*").alias("n"))
    best = counts.groupBy("lot").agg(F.max_by(F.struct("title", "n"), F.struct("n", "title")).alias("d"), F.sort_array(F.collect_list("n"), asc=False).alias("ns"))
    tied = (F.size("ns") > 1) & (F.try_element_at("ns", F.lit(2)) == F.element_at("ns", 1))
    by_work = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_orderkey").join(part.select("p_partkey", "p_name"), "p_partkey")
    names = by_work.groupBy("p_name").agg(F.count_distinct("l_orderkey").alias("records")).select(text.title_key(F.col("p_name")).alias("title"), "records")
    d = best.select("lot", tied.alias("tied"), F.when(~tied, F.col("d.title")).alias("title"), F.col("d.n").alias("n")).join(names, "title", "left")
    r, n = F.coalesce("records", F.lit(0)), F.col("n")
    verdict = F.when(F.col("tied"), "conflict").when((n >= 2) & (r > 0), "identified").otherwise("candidate")
    code = F.when(F.col("tied"), "T8").when((n >= 2) & (r >= 3), "T1").when((n >= 2) & (r > 0), "T2").when(n >= 2, "T3").when(r > 0, "T4").otherwise("T5")
    judged = d.select("lot", verdict.alias("verdict"), "title", code.alias("code"))
    return part.select(F.col("p_partkey").alias("lot")).join(judged, "lot", "left").select("lot", F.coalesce("verdict", F.lit("unidentified")).alias("verdict"), "title", F.coalesce("code", F.lit("T9")).alias("code"))


@query(f"WITH {WORK_PASS} SELECT * FROM work_pass")
def work_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which work each lot is, by which rule."""
    return work_verdicts(spark, sf_dir)


IMPRESSION_SQL = "CASE WHEN p_type = 'PROMO' AND p_size > 40 THEN 'reproduction' WHEN p_type = 'SMALL' AND p_size > 30 THEN 'later_edition' ELSE 'none' END"
SCENARIOS = ("clean", "elevated_risk", "specialist_confirms", "unattributed", "competing_candidates", "no_evidence")


@query(f"""WITH {ARTIST_PASS}, {WORK_PASS} SELECT a.lot, CASE WHEN p_retailprice > 1090 AND a.verdict <> 'not_attributed' THEN 'elevated_risk' WHEN {IMPRESSION_SQL} <> 'none' THEN 'elevated_risk' WHEN a.verdict = 'conflict' OR w.verdict = 'conflict' THEN 'competing_candidates'
  WHEN a.verdict = 'attributed' AND a.confidence = 'HIGH' AND w.verdict = 'identified' THEN 'clean' WHEN a.verdict IN ('attributed', 'candidate') THEN 'specialist_confirms' WHEN w.verdict <> 'unidentified' THEN 'unattributed' ELSE 'no_evidence' END AS scenario, a.code AS artist_code, w.code AS work_code
FROM artist_pass a JOIN work_pass w USING (lot) JOIN part ON lot = p_partkey""")
def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each lot goes next: risk and conflict come before a match that looks sure."""
    a, w = artist_verdicts(spark, sf_dir), work_verdicts(spark, sf_dir).select("lot", F.col("verdict").alias("work"), F.col("code").alias("work_code"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("lot"), "p_type", "p_size", "p_retailprice")
    both = a.join(w, "lot").join(part, "lot")
    v, confidence = F.col("verdict"), F.coalesce("confidence", F.lit(""))
    picked = (
        F.when((F.col("p_retailprice") > 1090) & (v != "not_attributed"), "elevated_risk").when(F.expr(IMPRESSION_SQL) != "none", "elevated_risk")
        .when((v == "conflict") | (F.col("work") == "conflict"), "competing_candidates").when((v == "attributed") & (confidence == "HIGH") & (F.col("work") == "identified"), "clean")
        .when(v.isin("attributed", "candidate"), "specialist_confirms").when(F.col("work") != "unidentified", "unattributed").otherwise("no_evidence")
    )
    return both.select("lot", picked.alias("scenario"), F.col("code").alias("artist_code"), "work_code")


CLAIMED = "CAST((p_partkey + CASE WHEN p_partkey % 13 = 0 THEN 3 ELSE 0 END) % 12 AS BIGINT)"


@query(f"""WITH {ARTIST_PASS}, c AS (SELECT p_partkey AS lot, {CLAIMED} AS claimed, p_size, p_type FROM part), f AS (SELECT l_partkey AS lot, avg(l_quantity) AS size FROM lineitem GROUP BY 1)
SELECT c.lot, CASE WHEN s.s_suppkey IS NULL THEN 'not_in_graph' WHEN verdict = 'not_attributed' THEN 'unresolved' WHEN verdict = 'conflict' THEN 'diverges' WHEN artist = claimed THEN 'agrees' ELSE 'diverges' END AS artist, CASE WHEN f.size IS NULL THEN 'unassessable' WHEN abs(f.size - p_size) <= 12 THEN 'agrees' ELSE 'diverges' END AS size,
  CASE WHEN p_type = 'PROMO' THEN 'high' WHEN verdict = 'conflict' OR (artist IS NOT NULL AND artist <> claimed) THEN 'raised' ELSE 'low' END AS risk FROM c JOIN artist_pass USING (lot) LEFT JOIN supplier s ON claimed = s_suppkey LEFT JOIN f ON f.lot = c.lot""")
def attributed_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a catalogue claims against the evidence, facet by facet: it agrees, diverges or can't be assessed."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("lot"), F.expr(CLAIMED).alias("claimed"), "p_size", "p_type")
    known = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("claimed"), F.lit(True).alias("there"))
    size = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("lot")).agg(F.avg("l_quantity").alias("mean_size"))
    both = part.join(artist_verdicts(spark, sf_dir), "lot").join(known, "claimed", "left").join(size, "lot", "left")
    v, same = F.col("verdict"), F.col("artist") == F.col("claimed")
    artist = F.when(F.col("there").isNull(), "not_in_graph").when(v == "not_attributed", "unresolved").when(v == "conflict", "diverges").when(same, "agrees").otherwise("diverges")
    fits = F.when(F.col("mean_size").isNull(), "unassessable").when(F.abs(F.col("mean_size") - F.col("p_size")) <= 12, "agrees").otherwise("diverges")
    risk = F.when(F.col("p_type") == "PROMO", "high").when((v == "conflict") | (F.col("artist").isNotNull() & ~same), "raised").otherwise("low")
    return both.select("lot", artist.alias("artist"), fits.alias("size"), risk.alias("risk"))


COMP_COLUMNS = (
    "page_id", "CASE WHEN page_id % 5 = 0 THEN 'see ' || url ELSE url END AS url", "CASE WHEN page_id % 3 = 0 THEN '' ELSE 'H' || CAST(page_id % 4 AS {0}) END AS house", "CASE WHEN page_id % 7 = 0 THEN 'n/a' ELSE CAST(page_id * 10 AS {0}) END AS price",
    "CASE page_id % 4 WHEN 0 THEN 'gbp' WHEN 1 THEN 'pounds' ELSE 'EUR' END AS currency", "CASE page_id % 3 WHEN 0 THEN 'Hammer' WHEN 1 THEN 'premium-inclusive' ELSE 'total' END AS basis",
)
COMP_SQL = f"SELECT {', '.join(COMP_COLUMNS)} FROM pages"
USABLE = r"^https?://[^/]*\.[^/]+"


@query(f"""WITH c AS ({COMP_SQL.format('VARCHAR')}), a AS (SELECT page_id, CASE WHEN regexp_matches(url, '{USABLE}') THEN 'address' WHEN house <> '' THEN 'house and lot' ELSE 'none' END AS key_kind, coalesce(TRY_CAST(price AS DOUBLE), 0) > 0 AS priced, regexp_matches(upper(currency), '^[A-Z]{{3}}$') AS currency_ok, regexp_replace(lower(basis), '[\\s-]+', '_', 'g') IN ('hammer', 'premium_inclusive') AS basis_ok FROM c)
SELECT page_id, key_kind, key_kind <> 'none' AND priced AND currency_ok AND basis_ok AS storable, concat_ws(',', CASE WHEN key_kind = 'none' THEN 'no_key' END, CASE WHEN NOT priced THEN 'no_price' END, CASE WHEN NOT currency_ok THEN 'no_currency' END, CASE WHEN NOT basis_ok THEN 'no_basis' END) AS reasons FROM a""")
def comp_storability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a researched sale may be stored, and all that stands against it: no key, price, currency or basis of price."""
    c = table(spark, sf_dir, "pages").selectExpr(*(x.format("STRING") for x in COMP_COLUMNS))
    key = F.when(F.col("url").rlike(USABLE), "address").when(F.col("house") != "", "house and lot").otherwise("none")
    tests = {"no_key": key != "none", "no_price": F.coalesce(F.col("price").try_cast("double"), F.lit(0.0)) > 0, "no_currency": F.upper("currency").rlike("^[A-Z]{3}$"), "no_basis": F.regexp_replace(F.lower("basis"), r"[\s-]+", "_").isin("hammer", "premium_inclusive")}
    return c.select("page_id", key.alias("key_kind"), reduce(Column.__and__, tests.values()).alias("storable"), F.concat_ws(",", *(F.when(~ok, r) for r, ok in tests.items())).alias("reasons"))


@query("""WITH web AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(url), '[?#].*$', ''), '^[a-z]+://(www\\.)?', ''), '/$', '') AS k1, 'H' || CAST(page_id % 5 AS VARCHAR) || '|' || CAST(page_id AS VARCHAR) || '-' || CAST(page_id % 7 + 1 AS VARCHAR) AS k2 FROM pages),
graph AS (SELECT DISTINCT 'H' || CAST(l_suppkey % 5 AS VARCHAR) || '|' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS k FROM lineitem), first AS (SELECT k1, min(page_id) AS first FROM web GROUP BY 1)
SELECT page_id FROM web LEFT JOIN first USING (k1) WHERE (k1 IS NULL OR first = page_id) AND k2 NOT IN (SELECT k FROM graph)""")
def new_web_comps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales found on the web that no key ties to a stored one (house and lot) or to one found before (address)."""
    key = F.concat(F.lit("H"), (F.col("page_id") % 5).cast("string"), F.lit("|"), F.col("page_id").cast("string"), F.lit("-"), (F.col("page_id") % 7 + 1).cast("string"))
    pages = table(spark, sf_dir, "pages").select("page_id", text.url_key(F.col("url")).alias("k1"), key.alias("k"))
    lots = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("H"), (F.col("l_suppkey") % 5).cast("string"), F.lit("|"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("k"))
    first = pages.groupBy("k1").agg(F.min("page_id").alias("first"))
    once = pages.join(first, "k1", "left").where("k1 IS NULL OR first = page_id")
    return once.join(lots, "k", "left_anti").select("page_id")


@query("""WITH p AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b, a.s_name AS an, b.s_name AS bn, a.s_nationkey AS ua, b.s_nationkey AS ub FROM supplier a JOIN supplier b ON a.s_suppkey // 10 = b.s_suppkey // 10 AND a.s_suppkey < b.s_suppkey)
SELECT a, b, CASE WHEN (a + b) % 17 = 0 THEN 'refused' WHEN a % 10 = 0 THEN 'collective' WHEN b % 7 = 0 AND a % 7 <> 0 THEN 'afterAttribution' WHEN ua <> ub AND ua IS NOT NULL AND ub IS NOT NULL THEN 'recordConflict' WHEN levenshtein(an, bn) <= 1 THEN 'nameVariant' ELSE 'differentNames' END AS route FROM p""")
def pair_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs of artists by what is to be done with them, the first rule that fits."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", F.floor(F.col("s_suppkey") / 10).alias("block"))
    a, b = (s.select("block", *(F.col(c).alias(f"{n}_{k}") for c, n in (("s_suppkey", "id"), ("s_name", "name"), ("s_nationkey", "record")))) for k in "ab")
    pairs = a.join(b, "block").where("id_a < id_b")
    route = (
        F.when((F.col("id_a") + F.col("id_b")) % 17 == 0, "refused").when(F.col("id_a") % 10 == 0, "collective").when((F.col("id_b") % 7 == 0) & (F.col("id_a") % 7 != 0), "afterAttribution")
        .when(F.col("record_a") != F.col("record_b"), "recordConflict").when(F.levenshtein("name_a", "name_b", 1) >= 0, "nameVariant").otherwise("differentNames")
    )
    return pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), route.alias("route"))


NARRATED = "SELECT l_partkey AS work, CAST(sum(l_quantity) AS BIGINT) AS n, CAST(round(avg(l_extendedprice)) AS BIGINT) AS price FROM lineitem GROUP BY 1"
TEXT_SQL = "CASE work % 4 WHEN 0 THEN 'Sold ' || CAST(n AS {0}) || ' times, about ' || CAST(price AS {0}) || '; above its peers.' WHEN 1 THEN 'Sold ' || CAST(n + 1 AS {0}) || ' times; below its peers.' WHEN 2 THEN 'Some ' || CAST(price AS {0}) || ' and 12,500 besides.' ELSE 'No figures.' END"


@query(f"""WITH f AS ({NARRATED}), s AS (SELECT *, {TEXT_SQL.format('VARCHAR')} AS said, (SELECT avg(price) FROM f) AS mean FROM f), x AS (SELECT *, list_transform(regexp_extract_all(said, '[0-9][0-9,]*'), lambda v: CAST(replace(v, ',', '') AS BIGINT)) AS figures FROM s)
SELECT work, len(list_filter(figures, lambda v: v <> n AND v <> price)) AS unknown_figures, CASE WHEN regexp_matches(said, 'above') AND price <= mean THEN FALSE WHEN regexp_matches(said, 'below') AND price >= mean THEN FALSE ELSE TRUE END AS directions_hold FROM x""")
def narration_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures in a text that the evidence doesn't hold, and whether its words of direction agree with the numbers."""
    f = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("work")).agg(F.sum("l_quantity").cast("long").alias("n"), F.round(F.avg("l_extendedprice")).cast("long").alias("price"))
    s = f.crossJoin(F.broadcast(f.agg(F.avg("price").alias("mean")))).withColumn("said", F.expr(TEXT_SQL.format("STRING")))
    figures = F.transform(F.regexp_extract_all("said", F.lit("[0-9][0-9,]*"), F.lit(0)), lambda v: F.replace(v, F.lit(","), F.lit("")).cast("long"))
    unknown = F.size(F.filter(figures, lambda v: (v != F.col("n")) & (v != F.col("price")))).cast("long")
    wrong = (F.col("said").contains("above") & (F.col("price") <= F.col("mean"))) | (F.col("said").contains("below") & (F.col("price") >= F.col("mean")))
    return s.select("work", unknown.alias("unknown_figures"), (~wrong).alias("directions_hold"))


@query(f"""WITH {ARTIST_PASS}, t AS (SELECT p_partkey AS lot, CAST(p_partkey % 10 AS BIGINT) AS truth, p_retailprice AS price, p_retailprice * (0.5 + (p_size % 30) / 20.0) AS guess FROM part)
SELECT CASE WHEN artist IS NULL THEN 'none' WHEN artist = truth THEN 'exact' WHEN abs(artist - truth) = 1 THEN 'partial' ELSE 'wrong' END AS artist, CASE WHEN guess * 0.8 <= price * 1.1 AND guess * 1.2 >= price * 0.9 THEN 'overlaps' WHEN greatest(guess / price, price / guess) <= 2 THEN 'within double' ELSE 'off' END AS price, count(*) AS n FROM t JOIN artist_pass USING (lot) GROUP BY 1, 2""")
def backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts and prices against what is known: artists exact, partial, wrong or none; ranges that overlap or are within double."""
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("lot"), (F.col("p_partkey") % 10).alias("truth"), F.col("p_retailprice").alias("price"), (F.col("p_retailprice") * (0.5 + (F.col("p_size") % 30) / 20.0)).alias("guess"))
    both = t.join(artist_verdicts(spark, sf_dir), "lot")
    artist = F.when(F.col("artist").isNull(), "none").when(F.col("artist") == F.col("truth"), "exact").when(F.abs(F.col("artist") - F.col("truth")) == 1, "partial").otherwise("wrong")
    g, p = F.col("guess"), F.col("price")
    price = F.when((g * 0.8 <= p * 1.1) & (g * 1.2 >= p * 0.9), "overlaps").when(F.greatest(g / p, p / g) <= 2, "within double").otherwise("off")
    return both.groupBy(artist.alias("artist"), price.alias("price")).agg(F.count("*").alias("n"))


@query(f"""WITH {ARTIST_PASS}, cand AS (SELECT lot, artist, count(*) AS n, max(sure) AS sure FROM votes GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY lot ORDER BY n DESC, sure DESC, artist) AS k FROM cand), oeuvre AS (SELECT l_suppkey AS artist, count(DISTINCT l_partkey) AS works, count(*) AS sales FROM lineitem GROUP BY 1), own AS (SELECT DISTINCT l_suppkey AS artist, l_partkey AS lot FROM lineitem)
SELECT r.lot, CAST(k AS INTEGER) AS rank, r.artist, coalesce(o.works, 0) AS works, coalesce(o.sales, 0) AS sales, own.lot IS NOT NULL AS title_found FROM r LEFT JOIN oeuvre o USING (artist) LEFT JOIN own ON own.artist = r.artist AND own.lot = r.lot WHERE k <= 4""")
def query_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is looked up for each lot: up to four candidates, the work of each, and whether it holds the title."""
    from lotwise.operators import ranking

    cand = claims(spark, sf_dir).where(IS_VOTE).groupBy("lot", "artist").agg(F.count("*").alias("n"), F.max("sure").alias("sure"))
    top = ranking.top(cand, ["lot"], [F.desc("n"), F.desc("sure"), F.col("artist")], 4)
    lots = sales(spark, sf_dir)
    oeuvre = lots.groupBy("artist").agg(F.count_distinct("work").alias("works"), F.count("*").alias("sales"))
    own = lots.select("artist", F.col("work").alias("lot")).distinct().withColumn("found", F.lit(True))
    return top.join(oeuvre, "artist", "left").join(own, ["artist", "lot"], "left").select("lot", "rank", "artist", F.coalesce("works", F.lit(0)).alias("works"), F.coalesce("sales", F.lit(0)).alias("sales"), F.col("found").isNotNull().alias("title_found"))


@query("""WITH v AS (SELECT label, count(*) AS n, count(*) FILTER (embedding IS NULL OR len(embedding) <> 64) AS wrong_size, count(*) FILTER (embedding IS NOT NULL AND abs(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) - 1) > 0.001) AS not_unit FROM embeddings GROUP BY 1)
SELECT *, round((n - wrong_size) * 100.0 / n, 4) AS coverage, (n - wrong_size) * 100.0 / n >= 99 AS passes FROM v""")
def vector_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the wrong size or length by label, and whether enough rows have one."""
    size = F.coalesce(F.size("embedding"), F.lit(-1)) != 64
    length = F.sqrt(F.aggregate(F.transform("embedding", lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x * x))
    v = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.count_if(size).alias("wrong_size"), F.count_if(F.col("embedding").isNotNull() & (F.abs(length - 1) > 0.001)).alias("not_unit"))
    share = (F.col("n") - F.col("wrong_size")) * 100.0 / F.col("n")
    return v.select("*", F.round(share, 4).alias("coverage"), (share >= 99).alias("passes"))


@query("""SELECT l_orderkey AS sale, l_linenumber AS lot, round(l_extendedprice * (1 + l_tax), 4) AS stored, CASE WHEN l_discount > 0.05 THEN 'over-counted' ELSE 'kept' END AS action, round(CASE WHEN l_discount > 0.05 THEN l_extendedprice * (1 + l_tax) - l_extendedprice ELSE l_extendedprice * (1 + l_tax) END, 4) AS repaired FROM lineitem WHERE l_tax > 0""")
def realised_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices with premium that count the hammer twice, less the hammer; the others as they are."""
    stored, twice = F.col("l_extendedprice") * (1 + F.col("l_tax")), F.col("l_discount") > 0.05
    return table(spark, sf_dir, "lineitem").where("l_tax > 0").select(F.col("l_orderkey").alias("sale"), F.col("l_linenumber").alias("lot"), F.round(stored, 4).alias("stored"), F.when(twice, "over-counted").otherwise("kept").alias("action"), F.round(F.when(twice, stored - F.col("l_extendedprice")).otherwise(stored), 4).alias("repaired"))


@query("""SELECT source, count(*) AS n, count(*) FILTER (regexp_matches(text, '(?i)all rights reserved|licensed under')) AS marked FROM documents GROUP BY 1 HAVING count(*) FILTER (regexp_matches(text, '(?i)all rights reserved|licensed under')) > 0""")
def rights_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that hold rows with a rights line, of which a cleared table has none."""
    marked = F.col("text").rlike("(?i)all rights reserved|licensed under")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(marked).alias("marked")).where("marked > 0")


CHANCES = (("HIGH", 0.9), ("MEDIUM_HIGH", 0.75), ("MEDIUM", 0.5), ("LOW", 0.25))


@query(f"""WITH {ARTIST_PASS}, {WORK_PASS}, o AS (SELECT lot, count(DISTINCT artist) > 1 AS overridden FROM votes WHERE source IN ('A', 'V') GROUP BY 1)
SELECT a.lot, CASE WHEN coalesce(overridden, FALSE) THEN 'conflict' ELSE a.verdict END AS artist_verdict, w.verdict AS work_verdict, coalesce(overridden, FALSE) AS overridden,
  round(CASE WHEN coalesce(overridden, FALSE) THEN 0.1 ELSE coalesce(CASE confidence {' '.join(f"WHEN '{b}' THEN {p}" for b, p in CHANCES)} END, 0) * CASE WHEN w.verdict = 'conflict' THEN 0.8 ELSE 1 END END, 4) AS chance FROM artist_pass a JOIN work_pass w USING (lot) LEFT JOIN o USING (lot)""")
def fused_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both verdicts in one row with a chance; a documented claim against a legible signature overrides them."""
    split = claims(spark, sf_dir).where(F.col("source").isin("A", "V")).groupBy("lot").agg((F.count_distinct("artist") > 1).alias("split"))
    both = artist_verdicts(spark, sf_dir).join(work_verdicts(spark, sf_dir).select("lot", F.col("verdict").alias("work_verdict")), "lot").join(split, "lot", "left")
    over = F.coalesce("split", F.lit(False))
    known = F.create_map(*(F.lit(x) for kv in CHANCES for x in kv))
    chance = F.coalesce(known[F.col("confidence")], F.lit(0.0)) * F.when(F.col("work_verdict") == "conflict", 0.8).otherwise(1.0)
    return both.select("lot", F.when(over, "conflict").otherwise(F.col("verdict")).alias("artist_verdict"), "work_verdict", over.alias("overridden"), F.round(F.when(over, 0.1).otherwise(chance), 4).alias("chance"))
