"""Catalogue text: keys, extractors, leaks, search."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwise.functions import numbers, text
from lotwise.operators import joins, leaks
from lotwise.operators.durable import checkpoint_dir
from lotwise.plans import Registry
from lotwise.sources import zipped
from lotwise.sources.tables import table, works

REGISTRY = Registry()
query = REGISTRY

FOLDED = text.fold_sql("{0}")
KEYED = "trim(regexp_replace(regexp_replace(" + FOLDED + ", '[^a-z0-9]+', ' ', 'g'), '\\s+', ' ', 'g'))"
LINE = "split_part(coalesce(text, ''), chr(10), 1)"


def first_line() -> F.Column:
    return F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)


@query(f"SELECT doc_id, {FOLDED.format(LINE)} AS folded FROM documents")
def folded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines without case and accents."""
    return table(spark, sf_dir, "documents").select("doc_id", text.fold(first_line()).alias("folded"))


@query(f"SELECT doc_id, {KEYED.format(LINE)} AS key, length({KEYED.format(LINE)}) AS n FROM documents")
def title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title keys of first lines."""
    key = text.title_key(first_line())
    return table(spark, sf_dir, "documents").select("doc_id", key.alias("key"), F.length(key).cast("long").alias("n"))


@query(f"SELECT key, count(*) AS n, min(doc_id) AS first FROM (SELECT doc_id, {KEYED.format(LINE)} AS key FROM documents) GROUP BY key HAVING count(*) > 1")
def title_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title keys that several documents share."""
    keys = title_keys(spark, sf_dir)
    return keys.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query("""SELECT l_orderkey AS sale, l_linenumber AS lot, CASE WHEN l_quantity <= 10 THEN 'tiny' WHEN l_quantity <= 25 THEN 'small' WHEN l_quantity <= 40 THEN 'medium' ELSE 'large' END AS band,
  CAST(year(l_shipdate) // 10 * 10 AS VARCHAR) || 's' AS era, l_partkey AS work FROM lineitem""")
def edition_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of edition size and decades."""
    band = numbers.banded(F.col("l_quantity"), [(10, "tiny"), (25, "small"), (40, "medium")], "large")
    era = F.concat((F.floor(F.year("l_shipdate") / 10) * 10).cast("string"), F.lit("s"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sale"), F.col("l_linenumber").alias("lot"), band.alias("band"), era.alias("era"), F.col("l_partkey").alias("work"))


@query("SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(url), '[?#].*$', ''), '^[a-z]+://(www\\.)?', ''), '/$', '') AS key FROM pages")
def url_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses without what varies between copies of a page."""
    return table(spark, sf_dir, "pages").select("page_id", text.url_key(F.col("url")).alias("key"))


@query("""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')) AS title FROM pages""")
def html_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of pages, entities decoded."""
    return table(spark, sf_dir, "pages").select("page_id", text.without_tags(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)).alias("title"))


@query("""WITH w AS (SELECT doc_id, unnest(list_distinct(string_split(lower(coalesce(text, '')), ' '))) AS word FROM documents)
SELECT word, count(*) AS documents FROM w WHERE length(word) >= 4 GROUP BY word HAVING count(*) >= 5""")
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of four letters and more with the number of documents that have them, five at least."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), " "))).alias("word"))
    return words.where(F.length("word") >= 4).groupBy("word").agg(F.count("*").alias("documents")).where("documents >= 5")


#: Hashes of listed runs are sent to every task up to this number.
SENT = 1_000_000
GRAMS = "SELECT {id}, unnest(list_transform(range(1, len(w) - 6), lambda i: list_aggregate(w[i:i+7], 'string_agg', ' '))) AS gram FROM (SELECT {id}, string_split(trim(regexp_replace(lower(text), '[^a-zà-ÿ]+', ' ', 'g')), ' ') AS w FROM {table}) WHERE len(w) >= 8"


def grams(df: DataFrame, key: str, n: int = 8) -> DataFrame:
    """Distinct runs of ``n`` words by row."""
    w = df.select(key, F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-zà-ÿ]+", " ")), " ").alias("w")).where(F.size("w") >= n)
    return w.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))).alias("gram")).distinct()


@query(f"""WITH b AS (SELECT DISTINCT * FROM ({GRAMS.format(id='item_id', table='benchmark')})), d AS (SELECT DISTINCT * FROM ({GRAMS.format(id='doc_id', table='documents')}))
SELECT item_id, doc_id, count(*) AS shared FROM b JOIN d USING (gram) GROUP BY 1, 2""")
def leak_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold eight words in a row of a listed passage, and how many such runs.

    Up to ``SENT`` listed runs go to every task, where a document's runs are told by rolling hashes and then word by word;
    with more, documents' runs meet the listed ones in a join.
    """
    listed, docs = grams(table(spark, sf_dir, "benchmark"), "item_id"), table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = listed.limit(SENT + 1).collect()
    if len(rows) > SENT:
        return grams(docs, "doc_id").join(listed, "gram").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared"))
    return leaks.counted(docs.select("doc_id", F.trim(F.regexp_replace(F.lower("text"), "[^a-zà-ÿ]+", " ")).alias("words")), rows, 8)


@query("""WITH d AS (SELECT md5(text) AS h, count(*) AS copies, min(doc_id) AS first, count(DISTINCT source) AS sources FROM documents WHERE text IS NOT NULL GROUP BY 1) SELECT h, copies, first, sources FROM d WHERE copies > 1""")
def duplicate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that occur more than once, by digest."""
    return table(spark, sf_dir, "documents").where("text is not null").groupBy(F.md5("text").alias("h")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"), F.count_distinct("source").alias("sources")).where("copies > 1")


LISTED = ("the", "of", "ring")


@query("""WITH t AS (SELECT p_partkey AS work, p_name AS title, string_split(lower(p_name), ' ') AS w FROM part)
SELECT a.title AS a, b.title AS b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS jaccard, round(jaro_winkler_similarity(a.title, b.title), 6) AS name_likeness, CAST(levenshtein(a.title, b.title) AS INTEGER) AS substitutions
FROM (SELECT DISTINCT title, w FROM t) a JOIN (SELECT DISTINCT title, w FROM t) b ON a.title < b.title""")
def title_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two titles: shared words, likeness as names, and substitutions; titles are a short list whatever the works."""
    from lotwise.functions import strings

    t = works(spark, sf_dir).select("title").distinct().withColumn("w", F.split(F.lower("title"), " "))
    a, b = (t.select(F.col("title").alias(k), F.col("w").alias(f"w{k}")) for k in "ab")
    pairs = a.join(b, F.col("a") < F.col("b"))
    return pairs.select("a", "b", F.round(text.jaccard(F.col("wa"), F.col("wb")), 6).alias("jaccard"), F.round(strings.jaro_winkler_of("a", "b"), 6).alias("name_likeness"), F.levenshtein("a", "b").alias("substitutions"))


@query("WITH t AS (SELECT DISTINCT p_name AS t FROM part) SELECT x.t AS a, y.t AS b, damerau_levenshtein(x.t, y.t) AS edits FROM t x JOIN t y ON x.t < y.t WHERE damerau_levenshtein(x.t, y.t) <= 3")
def typo_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles at most three edits apart, a swap of neighbours counting as one."""
    from lotwise.functions import strings

    near = joins.within_edits(works(spark, sf_dir), "title", 3)
    return near.withColumn("edits", strings.typo_distance_of("a", "b")).where("edits <= 3")


@query("""WITH t AS (SELECT p_partkey AS work, p_name || ' ' || lower(p_type) || ' ' || lower(p_brand) AS body FROM part), w AS (SELECT work, unnest(string_split(body, ' ')) AS word FROM t), f AS (SELECT work, word, count(*) AS tf FROM w GROUP BY 1, 2),
n AS (SELECT count(*) AS docs FROM t), l AS (SELECT work, count(*) AS len FROM w GROUP BY 1), a AS (SELECT avg(len) AS mean FROM l), df AS (SELECT word, count(*) AS df FROM f GROUP BY 1), q AS (SELECT unnest(['small', 'ring', 'promo']) AS word),
s AS (SELECT work, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score FROM f JOIN q USING (word) JOIN df USING (word) JOIN l USING (work), n, a GROUP BY work)
SELECT work, round(score, 6) AS score FROM s ORDER BY round(score, 6) DESC, work LIMIT 30""")
def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirty works that best match three words, by an inverted index and the usual term weights."""
    body = works(spark, sf_dir).select("work", F.explode(F.split(F.concat_ws(" ", "title", F.lower("technique"), F.lower("series")), " ")).alias("word"))
    length = body.groupBy("work").agg(F.count("*").alias("len"))
    stats = length.agg(F.count("*").alias("docs"), F.avg("len").alias("mean"))
    hits = body.where(F.col("word").isin("small", "ring", "promo")).groupBy("work", "word").agg(F.count("*").alias("tf"))
    df = hits.groupBy("word").agg(F.count("*").alias("df"))
    weight = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("len") / F.col("mean")))
    scored = hits.join(df, "word").join(length, "work").crossJoin(F.broadcast(stats)).groupBy("work").agg(F.round(F.sum(weight), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "work").limit(30)


@query("""SELECT conv_id, turn, role, regexp_matches(text, '[0-9]') AS has_number, len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS words, CASE WHEN length(text) > 600 THEN 'long' WHEN text LIKE '%?%' THEN 'question' WHEN text LIKE '%,%' THEN 'list' ELSE 'plain' END AS kind FROM conversations WHERE text IS NOT NULL AND trim(text) <> ''""")
def note_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes by the first of several marks."""
    t = F.col("text")
    kind = F.when(F.length(t) > 600, "long").otherwise(text.first_match(t, [("question", "[?]"), ("list", ",")], "plain"))
    return table(spark, sf_dir, "conversations").where(t.isNotNull() & (F.trim(t) != "")).select("conv_id", "turn", "role", t.rlike("[0-9]").alias("has_number"), F.size(F.split(text.spaced(t), " ")).cast("long").alias("words"), kind.alias("kind"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, md5(props) AS digest FROM events""")
def json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number within JSON text, and a digest of the text."""
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"), F.md5("props").alias("digest"))


@query("""WITH d AS (SELECT doc_id, lang, string_split(lower(coalesce(text, '')), ' ') AS w FROM documents), p AS (SELECT doc_id, lang, w[1] || ' ' || w[2] || ' ' || w[3] AS block FROM d WHERE len(w) >= 3), s AS (SELECT block FROM p GROUP BY block HAVING count(*) BETWEEN 2 AND 300)
SELECT a.doc_id AS a, b.doc_id AS b, 1 AS shared FROM p a JOIN p b ON a.block = b.block AND a.doc_id < b.doc_id WHERE a.block IN (SELECT block FROM s)""")
def blocked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents that begin with the same three words, of blocks of up to 300; ``document_blocks`` has them all, as classes."""
    w = F.split(F.lower(F.coalesce("text", F.lit(""))), " ")
    blocks = table(spark, sf_dir, "documents").where(F.size(w) >= 3).select("doc_id", F.array_join(F.slice(w, 1, 3), " ").alias("block"))
    return joins.blocked_pairs(blocks, "block", "doc_id", 300).select("a", "b", F.col("shared").cast("int").alias("shared"))


@query("""WITH d AS (SELECT doc_id, string_split(lower(coalesce(text, '')), ' ') AS w FROM documents), p AS (SELECT DISTINCT doc_id, w[1] || ' ' || w[2] || ' ' || w[3] AS block FROM d WHERE len(w) >= 3),
g AS (SELECT block, min(doc_id) AS class, count(*) AS members FROM p GROUP BY block HAVING count(*) > 1) SELECT doc_id, class, members, members * (members - 1) // 2 AS links FROM p JOIN g USING (block)""")
def document_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that begin with the same three words, in classes named by their least id, with how many pairs each class has.

    No block is too large: a class takes a row a member, not a row a pair.
    """
    w = F.split(F.lower(F.coalesce("text", F.lit(""))), " ")
    members = table(spark, sf_dir, "documents").where(F.size(w) >= 3).select("doc_id", F.array_join(F.slice(w, 1, 3), " ").alias("block")).distinct()
    classes = members.groupBy("block").agg(F.min("doc_id").alias("class"), F.count("*").alias("members")).where("members > 1")
    return members.join(classes, "block").selectExpr("doc_id", "class", "members", "members * (members - 1) div 2 as links")


@query("""SELECT p_partkey AS work, CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'open' WHEN p_type IN ('SMALL', 'MEDIUM', 'LARGE') THEN 'sized' ELSE 'other' END AS family,
 floor(p_retailprice / pow(10.0, floor(log10(p_retailprice)) - 1)) * pow(10.0, floor(log10(p_retailprice)) - 1) AS low, ceil(p_retailprice * 1.2 / pow(10.0, floor(log10(p_retailprice * 1.2)) - 1)) * pow(10.0, floor(log10(p_retailprice * 1.2)) - 1) AS high FROM part WHERE p_retailprice > 0""")
def technique_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Technique families and an estimate to two figures, low rounded down and high up."""
    family = text.first_match(F.col("technique"), [("open", "^(ECONOMY|PROMO)$"), ("sized", "^(SMALL|MEDIUM|LARGE)$")], "other")
    return works(spark, sf_dir).where("list_price > 0").select("work", family.alias("family"), numbers.two_figures(F.col("list_price")).alias("low"), numbers.two_figures(F.col("list_price") * 1.2, up=True).alias("high"))


@query("""SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS turns, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS asked FROM (SELECT DISTINCT conv_id, turn, role FROM conversations)""")
def turn_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each conversation and how many of the user's so far."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role").distinct()
    w = Window.partitionBy("conv_id")
    return t.select("conv_id", "turn", F.count("*").over(w).alias("turns"), F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w.orderBy("turn")).alias("asked"))


TITLED = """CASE WHEN position('<title>' IN html) > 0 THEN nullif(split_part(split_part(html, '<title>', 2), '</title>', 1), '') END"""


@query(f"""SELECT page_id, url, {TITLED} AS title, CASE WHEN length(html) % 3 = 0 THEN 'fr' ELSE 'en' END AS lang, length(html) AS size FROM pages WHERE url IS NOT NULL""")
def pages_from_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages said in triples inside ZIP archives, read back and put together again by predicate."""
    title = F.nullif(F.split_part(F.split_part("html", F.lit("<title>"), F.lit(2)), F.lit("</title>"), F.lit(1)), F.lit(""))
    pages = table(spark, sf_dir, "pages").where("url IS NOT NULL").select(F.concat(F.lit("http://example.org/page/"), F.col("page_id").cast("string")).alias("subject"), "url", F.when(F.col("html").contains("<title>"), title).alias("title"), F.length("html").alias("size"))
    lang = F.when(F.col("size") % 3 == 0, "fr").otherwise("en")
    said = F.array(
        F.struct(F.lit("http://example.org/url").alias("predicate"), F.col("url").alias("object"), F.lit(False).alias("is_literal"), F.lit(None).cast("string").alias("tag")),
        F.struct(F.lit("http://example.org/title").alias("predicate"), F.col("title").alias("object"), F.lit(True).alias("is_literal"), lang.alias("tag")),
        F.struct(F.lit("http://example.org/size").alias("predicate"), F.col("size").cast("string").alias("object"), F.lit(True).alias("is_literal"), F.concat(F.lit("http://www.w3.org/2001/XMLSchema#integer;"), lang).alias("tag")),
    )
    triples = pages.select("subject", F.explode(said).alias("t")).select("subject", "t.*").where("object IS NOT NULL")
    path = f"{checkpoint_dir(spark).rstrip('/')}/triples-{uuid.uuid4().hex}"
    zipped.write(triples, path, split=1 << 20)
    found = zipped.read(spark, path, split=1 << 18, strict=True)
    of = lambda p, c="object": F.max(F.when(F.col("predicate") == f"http://example.org/{p}", F.col(c)))
    by = found.groupBy("subject").agg(of("url").alias("url"), of("title").alias("title"), F.split_part(of("size", "tag"), F.lit(";"), F.lit(2)).alias("lang"), of("size").cast("long").alias("size"))
    return by.select(F.element_at(F.split("subject", "/"), -1).cast("long").alias("page_id"), "url", "title", "lang", "size")


#: Reports on lots in two versions of their schema, some cut short and some of a version yet to come.
REPORT_SQL = """CASE WHEN l_orderkey % 11 = 0 THEN '{{"artist": "cut' WHEN l_orderkey % 13 = 0 THEN '{{"schema": {{"version": 3}}, "artist": "x"}}'
  WHEN l_orderkey % 2 = 0 THEN '{{"artist": "' || s_name || '", "title": "' || p_name || '", "price": {{"low": ' || CAST(l_linenumber AS {0}) || '00, "high": "' || CAST(l_linenumber AS {0}) || '50", "currency": "GBP"}}, "comparables": [' || CAST(p_size AS {0}) || ', 2.5]}}'
  ELSE '{{"schema": {{"version": 2}}, "attribution": {{"artist": {{"name": "' || s_name || '"}}, "hand": "after"}}, "work": {{"title": "' || p_name || '"}}, "estimate": [' || CAST(l_linenumber AS {0}) || ', ' || CAST(p_size AS {0}) || '.5], "currency": null, "comps": [{{"price": ' || CAST(p_size AS {0}) || ', "tier": 0}}, {{"price": 7, "tier": 2}}]}}' END"""


@query("""WITH l AS (SELECT *, CASE WHEN l_orderkey % 11 = 0 THEN NULL WHEN l_orderkey % 13 = 0 THEN 3 WHEN l_orderkey % 2 = 0 THEN 1 ELSE 2 END AS v FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)
SELECT l_orderkey AS sale, l_linenumber AS lot, CAST(v AS INTEGER) AS version, CASE WHEN v IN (1, 2) THEN s_name END AS artist, CASE WHEN v = 2 THEN 'after' END AS hand, CASE WHEN v IN (1, 2) THEN p_name END AS title, CASE v WHEN 1 THEN l_linenumber * 100.0 WHEN 2 THEN l_linenumber END::DOUBLE AS low,
  CASE v WHEN 1 THEN l_linenumber * 100.0 + 50 WHEN 2 THEN p_size + 0.5 END::DOUBLE AS high, CASE WHEN v = 1 THEN 'GBP' END AS currency, CASE v WHEN 1 THEN p_size + 2.5 WHEN 2 THEN p_size + 7 END::DOUBLE AS comps_sum, CASE WHEN v = 2 THEN 2 END::INTEGER AS last_tier, CASE WHEN v IS NULL THEN 'not JSON' WHEN v = 3 THEN 'version 3' END AS unread FROM l""")
def reports_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of two versions read into one schema, with a word on those that can't be."""
    from lotwise.functions import reports

    lots = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    told = lots.select(F.col("l_orderkey").alias("sale"), F.col("l_linenumber").alias("lot"), reports.read(F.expr(REPORT_SQL.format("STRING"))).alias("r")).select("sale", "lot", "r.*")
    total = F.when(F.col("comps").isNotNull(), F.aggregate("comps", F.lit(0.0), lambda s, c: s + c["price"]))
    return told.select("sale", "lot", "version", "artist", "hand", "title", "low", "high", "currency", total.alias("comps_sum"), F.try_element_at("comps", F.lit(-1))["tier"].alias("last_tier"), "unread")
