"""Catalogue wording: titles, citations, editions, sizes and media read out of lot descriptions.

The fixture has no catalogue text, so each lot gets a title and a description in the usual house forms, made of its
columns; the patterns are the same constants in the DataFrame plans and in the SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.functions import text
from lotwise.functions.parse import ARTICLE, CITED, CONDITION, DEFECTS, MIXED, PAPERS, PREFIXES, QUOTES, bare_title, bare_title_sql, embedding_title, identity_key, mixed_fraction, several_works, several_works_sql, without_article
from lotwise.plans import Registry
from lotwise.plans.textual import KEYED
from lotwise.sources.tables import table

REGISTRY = Registry()
query = REGISTRY

#: House forms of a lot's title and of its parts, by number.
TITLE_SQL = """CASE l_orderkey % 8 WHEN 1 THEN 'The ' || p_name WHEN 2 THEN p_name || ' (' || replace(p_brand, '#', ' ') || ')' WHEN 3 THEN p_name || ', from the ' || p_type || ' Series' WHEN 4 THEN p_name || ', circa ' || CAST(year(l_shipdate) AS VARCHAR)
    WHEN 5 THEN '4. ' || upper(p_name) WHEN 6 THEN substr(p_name, 1, 1) || substr(p_name, 3) WHEN 7 THEN p_name || ' [1998]' ELSE p_name END"""
TEXT_SQL = """title || '. ' || CASE l_linenumber % 5 WHEN 0 THEN 'Etching with aquatint on wove paper, in good condition' WHEN 1 THEN 'Screenprint in colours on Arches, slight foxing and a tear' WHEN 2 THEN 'Lithograph on laid paper, time stained' WHEN 3 THEN 'Woodcut and another' ELSE 'Offset lithograph poster, in fine condition' END
    || CASE l_orderkey % 4 WHEN 0 THEN ', numbered 12/' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ' in pencil (there was an unsigned edition of 500)' WHEN 1 THEN ', from the edition of 1,' || lpad(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), 3, '0') WHEN 2 THEN ', one of ' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ' proofs' ELSE ', sheet 25 1/2 in' END
    || ', ' || CAST(p_size AS VARCHAR) || '.5 x ' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || CASE l_linenumber % 3 WHEN 0 THEN ' cm' WHEN 1 THEN 'mm' ELSE ' in' END"""
LISTED = f"""listed AS (SELECT *, {TEXT_SQL} AS body FROM (SELECT l_orderkey, l_linenumber, l_quantity, p_size, p_brand, l_orderkey AS sale, l_linenumber AS lot, l_partkey AS work, l_suppkey AS artist, p_name AS name, p_type AS kind, CAST(l_shipdate AS DATE) AS sale_date, {TITLE_SQL} AS title FROM lineitem JOIN part ON l_partkey = p_partkey))"""


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lots with a title and a description (``body``) in house style."""
    lots = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    named = lots.select("l_orderkey", "l_linenumber", "l_quantity", "p_size", "p_brand", F.col("l_orderkey").alias("sale"), F.col("l_linenumber").alias("lot"), F.col("l_partkey").alias("work"), F.col("l_suppkey").alias("artist"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("l_shipdate").cast("date").alias("sale_date"), F.expr(TITLE_SQL.replace("VARCHAR", "STRING")).alias("title"))
    return named.withColumn("body", F.expr(TEXT_SQL.replace("VARCHAR", "STRING")))


def extracted(c: str, pattern: str, group: int = 1) -> str:
    """SQL for a group of a pattern, null where it doesn't match."""
    return f"nullif(regexp_extract({c}, '{quoted(pattern)}', {group}), '')"


def quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


EDITION = text.edition_size_sql("body")


@query(f"WITH {LISTED} SELECT sale, lot, work, {EDITION} AS edition FROM listed")
def stated_editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edition size as a description states it; fractions of an inch are none."""
    return listed(spark, sf_dir).select("sale", "lot", "work", text.edition_size(F.col("body")).alias("edition"))


SIZE = r"(?i)(\d+(?:\.\d+)?)\s*[x×]\s*(\d+(?:\.\d+)?)\s*(mm|cm|in)\b"


@query(f"""WITH {LISTED}, p AS (SELECT sale, lot, work, CASE lower({extracted('body', SIZE, 3)}) WHEN 'mm' THEN 0.1::DOUBLE WHEN 'in' THEN 2.54::DOUBLE WHEN 'cm' THEN 1.0::DOUBLE END AS k, CAST({extracted('body', SIZE, 1)} AS DOUBLE) AS w, CAST({extracted('body', SIZE, 2)} AS DOUBLE) AS h FROM listed)
SELECT sale, lot, work, CASE WHEN ok THEN w END AS width, CASE WHEN ok THEN h END AS height FROM (SELECT sale, lot, work, round(w * k, 2) AS w, round(h * k, 2) AS h, round(w * k, 2) BETWEEN 1 AND 400 AND round(h * k, 2) BETWEEN 1 AND 400 AS ok FROM p)""")
def stated_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width and height in cm, null outside 1 to 400."""
    size = text.dimensions(F.col("body"))
    return listed(spark, sf_dir).select("sale", "lot", "work", size["width"].alias("width"), size["height"].alias("height"))


ABOUT, PLAIN = r"(?i)\b(?:c\.|ca\.?|circa)\s*(1[4-9]\d\d|20\d\d)\b", r"\b(1[4-9]\d\d|20\d\d)\b"


@query(f"""WITH {LISTED}, y AS (SELECT sale, lot, work, CAST({extracted('title', ABOUT)} AS INTEGER) AS about, CAST({extracted('title', PLAIN)} AS INTEGER) AS plain FROM listed)
SELECT sale, lot, work, coalesce(about - 5, plain) AS first_year, coalesce(about + 5, plain) AS last_year, CASE WHEN about IS NOT NULL THEN 'circa' WHEN plain IS NOT NULL THEN 'year' END AS precision FROM y""")
def stated_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Period that a title claims."""
    y = text.year_range(F.col("title"))
    return listed(spark, sf_dir).select("sale", "lot", "work", y["first"].alias("first_year"), y["last"].alias("last_year"), y["precision"].alias("precision"))


@query(f"""WITH {LISTED} SELECT sale, lot, work, lower({extracted('title', CITED, 1)}) AS prefix, {extracted('title', CITED, 2)} AS number FROM listed""")
def title_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue reference at the end of a title; a bracket with anything else holds none."""
    first = F.element_at(text.citations(F.col("title")), 1)
    return listed(spark, sf_dir).select("sale", "lot", "work", first["prefix"].alias("prefix"), first["number"].alias("number"))


KEY_SQL = KEYED.format(bare_title_sql("title", KEYED))
NO_SERIES_SQL = KEYED.format(bare_title_sql("title", KEYED, series=True))
NO_ARTICLE_SQL = f"regexp_replace({KEY_SQL}, '{ARTICLE}', '')"


@query(f"""WITH {LISTED} SELECT title, {KEY_SQL} AS key, {NO_SERIES_SQL} AS without_series, {NO_ARTICLE_SQL} AS without_article, count(*) AS n FROM listed GROUP BY 1""")
def title_identity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a title at falling strictness: without citations, years and numbers; without its series; without its article."""
    titles = listed(spark, sf_dir).groupBy("title").agg(F.count("*").alias("n"))
    key = identity_key(F.col("title"))
    return titles.select("title", key.alias("key"), text.title_key(bare_title(F.col("title"), series=True)).alias("without_series"), without_article(key).alias("without_article"), "n")


EMBED_SQL = f"lower(trim(regexp_replace(regexp_replace({bare_title_sql('title', KEYED, series=True)}, '{QUOTES}', '', 'g'), '\\s+', ' ', 'g')))"


@query(f"""WITH {LISTED} SELECT title, {EMBED_SQL} AS plain FROM (SELECT DISTINCT title FROM listed)""")
def embedding_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles as they're given to an encoder: without catalogue entries, years, series, numbers and quotation marks."""
    return listed(spark, sf_dir).select("title").distinct().select("title", embedding_title(F.col("title")).alias("plain"))


ALIASES = "(VALUES ('brand', 'BR'), ('brandno', 'BR'))"


@query(f"""WITH {LISTED}, c AS (SELECT regexp_replace(lower({extracted('title', CITED, 1)}), '[^a-z0-9]', '', 'g') AS folded, {extracted('title', CITED, 2)} AS number, artist FROM listed)
SELECT folded, coalesce(canonical, folded) AS prefix, count(*) AS n, count(DISTINCT number) AS numbers, count(DISTINCT artist) AS artists FROM c LEFT JOIN {ALIASES} AS a(alias, canonical) ON folded = alias WHERE folded IS NOT NULL GROUP BY 1, 2""")
def catalogue_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue names under one spelling, by a small table of aliases."""
    first = F.element_at(text.citations(F.col("title")), 1)
    cited = listed(spark, sf_dir).select(F.regexp_replace(F.lower(first["prefix"]), "[^a-z0-9]", "").alias("folded"), first["number"].alias("number"), "artist").where("folded IS NOT NULL")
    known = F.create_map(*(F.lit(x) for kv in PREFIXES for x in kv))
    return cited.withColumn("prefix", F.coalesce(known[F.col("folded")], "folded")).groupBy("folded", "prefix").agg(F.count("*").alias("n"), F.count_distinct("number").alias("numbers"), F.count_distinct("artist").alias("artists"))


@query("""WITH e AS (SELECT p_partkey AS work, lower(replace(p_brand, '#', ' ')) || CASE WHEN p_size % 3 = 0 THEN 'a' ELSE '' END AS entry FROM part)
SELECT work, regexp_replace(entry, '[^a-z0-9]', '', 'g') AS exact, coalesce(nullif(regexp_extract(entry, '([0-9]+)', 1), ''), '') AS base FROM e""")
def entry_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue entries by prefix and whole number, and by the number's leading digits."""
    entry = F.concat(F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit(" "))), F.when(F.col("p_size") % 3 == 0, "a").otherwise(""))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("work"), F.regexp_replace(entry, "[^a-z0-9]", "").alias("exact"), F.regexp_extract(entry, "([0-9]+)", 1).alias("base"))


@query(f"""WITH {LISTED} SELECT sale, lot, 'lot-cw-' || CAST(artist AS VARCHAR) || '-' || CASE WHEN {extracted('title', CITED, 2)} IS NOT NULL THEN regexp_replace(lower({extracted('title', CITED, 1)}), '[^a-z0-9]+', '-', 'g') || '-' || {extracted('title', CITED, 2)} || '-' ELSE '' END || replace({KEY_SQL}, ' ', '-') AS work_id FROM listed""")
def work_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An id for a work from its artist, its catalogue entry if it has one, and its title."""
    first = F.element_at(text.citations(F.col("title")), 1)
    entry = F.concat_ws("-", F.regexp_replace(first["prefix"], "[^a-z0-9]+", "-"), first["number"], F.when(first["number"].isNotNull(), ""))
    return listed(spark, sf_dir).select("sale", "lot", F.concat(F.lit("lot-cw-"), F.col("artist").cast("string"), F.lit("-"), entry, F.replace(identity_key(F.col("title")), F.lit(" "), F.lit("-"))).alias("work_id"))


CASES_SQL = "CASE s_suppkey % 4 WHEN 0 THEN 'AFTER ' || upper(replace(s_name, '#', ' ')) WHEN 1 THEN 'Attributed to ' || replace(s_name, '#', ' ') || ' (British, 1901-1980)' WHEN 2 THEN upper(replace(s_name, '#', ' mc')) ELSE replace(s_name, '#', ' ') END"
QUALIFIER = r"(?i)^(after|attributed to|circle of|manner of|follower of|studio of|school of)\s+"


@query(f"""WITH a AS (SELECT s_suppkey AS artist, {CASES_SQL} AS raw FROM supplier), b AS (SELECT *, lower(nullif(regexp_extract(raw, '{QUALIFIER}', 1), '')) AS qualifier, trim(regexp_replace(regexp_replace(raw, '{QUALIFIER}', ''), '\\s*\\([^)]*\\)', '', 'g')) AS bare FROM a)
SELECT artist, qualifier, CASE WHEN bare = upper(bare) THEN array_to_string(list_transform(string_split(lower(bare), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') ELSE bare END AS name FROM b""")
def artist_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """House-style artist strings as qualifier and name: brackets out, capitals only as words."""
    raw = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("artist"), F.expr(CASES_SQL).alias("raw"))
    bare = F.trim(F.regexp_replace(F.regexp_replace("raw", QUALIFIER, ""), r"\s*\([^)]*\)", ""))
    found = raw.select("artist", F.lower(F.nullif(F.regexp_extract("raw", QUALIFIER, 1), F.lit(""))).alias("qualifier"), bare.alias("bare"))
    worded = F.array_join(F.transform(F.split(F.lower("bare"), " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")
    return found.select("artist", "qualifier", F.when(F.col("bare") == F.upper("bare"), worded).otherwise(F.col("bare")).alias("name"))


MEDIUM, SUPPORT = r"(?i)\b(etching|screenprint|lithograph|woodcut)\b", r"(?i)\bon\s+(wove|laid|arches)"


@query(f"""WITH {LISTED} SELECT sale, lot, lower({extracted('body', MEDIUM)}) AS medium, lower({extracted('body', SUPPORT)}) AS support, {EDITION} AS edition, CAST({extracted('body', PLAIN)} AS INTEGER) AS year, regexp_matches(body, '(?i)in pencil') AS pencil, regexp_extract(body, '^(.*?)\\. ', 1) AS heading FROM listed""")
def parsed_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A description as heading, medium, support, edition, year and whether pencil is named."""
    part = lambda p: F.lower(F.nullif(F.regexp_extract("body", p, 1), F.lit("")))
    return listed(spark, sf_dir).select("sale", "lot", part(MEDIUM).alias("medium"), part(SUPPORT).alias("support"), text.edition_size(F.col("body")).alias("edition"), F.nullif(F.regexp_extract("body", PLAIN, 1), F.lit("")).cast("int").alias("year"), F.col("body").rlike("(?i)in pencil").alias("pencil"), F.regexp_extract("body", r"^(.*?)\. ", 1).alias("heading"))


def ladder_sql(c: str, classes, other: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '{quoted(p)}') THEN '{n}'" for n, p in classes) + f" ELSE {other} END"


@query(f"""WITH {LISTED} SELECT reason, count(*) AS n, count(DISTINCT work) AS works FROM (SELECT work, {several_works_sql('body', KEYED)} AS reason FROM listed) WHERE reason IS NOT NULL GROUP BY 1""")
def multi_work_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lots of more than one work, by the first wording that says so."""
    found = listed(spark, sf_dir).select("work", several_works(F.col("body")).alias("reason")).where("reason IS NOT NULL")
    return found.groupBy("reason").agg(F.count("*").alias("n"), F.count_distinct("work").alias("works"))


@query(f"""WITH {LISTED} SELECT sale, lot, {ladder_sql('body', CONDITION, "'unstated'")} AS condition, array_to_string(list_filter([{', '.join(f"CASE WHEN regexp_matches(body, '{quoted(p)}') THEN '{n}' END" for n, p in DEFECTS)}], lambda x: x IS NOT NULL), ',') AS defects, {ladder_sql('body', PAPERS)} AS paper FROM listed""")
def condition_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grade of condition, named defects and class of paper."""
    defects = F.array_join(F.array_compact(F.array(*(F.when(F.col("body").rlike(p), n) for n, p in DEFECTS))), ",")
    return listed(spark, sf_dir).select("sale", "lot", text.first_match(F.col("body"), list(CONDITION), "unstated").alias("condition"), defects.alias("defects"), text.first_match(F.col("body"), list(PAPERS)).alias("paper"))


@query(f"""WITH {LISTED}, w AS (SELECT title, list_filter(string_split({KEYED.format('title')}, ' '), lambda x: len(x) >= 4) AS words FROM (SELECT DISTINCT title FROM listed))
SELECT title, list_filter(words, lambda x: len(x) = list_max(list_transform(words, lambda y: len(y))))[1] AS probe FROM w""")
def title_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest word of four letters or more, the first of equals: a filter cheap enough to go before matching."""
    titles = listed(spark, sf_dir).select("title").distinct()
    words = titles.withColumn("words", F.filter(F.split(text.title_key(F.col("title")), " "), lambda x: F.length(x) >= 4))
    most = F.array_max(F.transform("words", lambda x: F.length(x)))
    return words.withColumn("most", most).select("title", F.try_element_at(F.filter("words", lambda x: F.length(x) == F.col("most")), F.lit(1)).alias("probe"))


DATES_SQL = "CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T10:00' WHEN 1 THEN strftime(o_orderdate, '%d %B %Y') WHEN 2 THEN strftime(o_orderdate, '%B %Y') ELSE strftime(o_orderdate, '%d/%m/%Y') END"


@query(f"""WITH d AS (SELECT o_orderkey AS sale, {DATES_SQL} AS said FROM orders)
SELECT sale, said, CAST(coalesce(try_strptime(nullif(regexp_extract(said, '^\\d{{4}}-\\d\\d-\\d\\d'), ''), '%Y-%m-%d'), try_strptime(said, '%d %B %Y')) AS DATE)::VARCHAR AS sale_date FROM d""")
def sale_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sale dates as written: an ISO day at the start or day, month and year in words; all else, such as a month alone or figures in doubtful order, is none."""
    day = F.col("o_orderdate")
    said = F.expr("o_orderkey % 4")
    written = F.when(said == 0, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T10:00"))).when(said == 1, F.date_format(day, "dd MMMM yyyy")).when(said == 2, F.date_format(day, "MMMM yyyy")).otherwise(F.date_format(day, "dd/MM/yyyy"))
    sales = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sale"), written.alias("said"))
    iso, worded = F.nullif(F.regexp_extract("said", r"^\d{4}-\d\d-\d\d", 0), F.lit("")).try_cast("date"), F.try_to_timestamp("said", F.lit("dd MMMM yyyy")).cast("date")
    return sales.select("sale", "said", F.coalesce(iso, worded).cast("string").alias("sale_date"))


@query("""SELECT l_partkey AS work, CASE WHEN l_returnflag = 'N' THEN 'reported' ELSE 'derived' END AS basis, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def hammer_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a hammer price was reported or has to be derived from the price with premium."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("work"), F.when(F.col("l_returnflag") == "N", "reported").otherwise("derived").alias("basis")).agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey AS sale, l_linenumber AS lot, CASE WHEN l_returnflag = 'N' THEN round(l_extendedprice, 2) ELSE round(l_extendedprice * (1 + l_tax) / 1.25, 2) END AS hammer FROM lineitem""")
def hammers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hammer prices: as reported, or the price with premium over the house's ratio."""
    realised = F.col("l_extendedprice") * (1 + F.col("l_tax"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sale"), F.col("l_linenumber").alias("lot"), F.when(F.col("l_returnflag") == "N", F.round("l_extendedprice", 2)).otherwise(F.round(realised / 1.25, 2)).alias("hammer"))


@query(f"""WITH x AS (SELECT p_partkey AS work, CASE p_size % 3 WHEN 0 THEN CAST(p_size AS VARCHAR) || ' 3/8' WHEN 1 THEN '1/' || CAST(p_size AS VARCHAR) ELSE CAST(p_size AS VARCHAR) || '.25' END AS said, list_extract(['I', 'IV', 'IX', 'XIV', 'XL', 'MCMXC'], CAST(p_size % 6 + 1 AS INTEGER)) AS numeral FROM part),
m AS (SELECT *, regexp_extract(said, '{MIXED}', 1) AS a, regexp_extract(said, '{MIXED}', 2) AS b, regexp_extract(said, '{MIXED}', 3) AS c FROM x)
SELECT work, said, round(CASE WHEN c <> '' THEN coalesce(CAST(nullif(a, '') AS DOUBLE), 0) + CAST(b AS DOUBLE) / CAST(c AS DOUBLE) ELSE TRY_CAST(said AS DOUBLE) END, 6) AS inches, numeral, CASE numeral WHEN 'I' THEN 1 WHEN 'IV' THEN 4 WHEN 'IX' THEN 9 WHEN 'XIV' THEN 14 WHEN 'XL' THEN 40 WHEN 'MCMXC' THEN 1990 END AS number FROM m""")
def numerals_and_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixed fractions as numbers and Roman numerals as integers."""
    from lotwise.functions.parse import roman

    said = F.expr("CASE p_size % 3 WHEN 0 THEN CAST(p_size AS STRING) || ' 3/8' WHEN 1 THEN '1/' || CAST(p_size AS STRING) ELSE CAST(p_size AS STRING) || '.25' END")
    numeral = F.element_at(F.array(*(F.lit(x) for x in ("I", "IV", "IX", "XIV", "XL", "MCMXC"))), (F.col("p_size") % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("work"), said.alias("said"), numeral.alias("numeral"))
    return rows.select("work", "said", F.round(mixed_fraction(F.col("said")), 6).alias("inches"), "numeral", roman(F.col("numeral")).alias("number"))


@query("""WITH x AS (SELECT event_id, 'Result: ' || props || ' and {"k": 1} end' AS said FROM events) SELECT event_id, regexp_extract(said, '\\{[^{}]*\\}') AS object, CAST(json_extract(regexp_extract(said, '\\{[^{}]*\\}'), '$.k') AS INTEGER) AS k FROM x""")
def first_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first complete JSON object within a text, braces in balance."""
    from lotwise.functions.parse import first_object

    said = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("Result: "), "props", F.lit(' and {"k": 1} end')).alias("said"))
    return said.select("event_id", first_object(F.col("said")).alias("object")).select("event_id", "object", F.get_json_object("object", "$.k").cast("int").alias("k"))


@query("""SELECT vec_id, label, round(CAST(list_max(embedding) AS DOUBLE), 6) AS most, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS place, len(list_filter(embedding, lambda x: CAST(x AS DOUBLE) > 0.2)) AS strong FROM embeddings""")
def keyed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as maps by column: the strongest column, and how many pass a mark."""
    keyed = table(spark, sf_dir, "embeddings").withColumn("by", F.map_from_arrays(F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: i.cast("string")), "embedding"))
    return keyed.select("vec_id", "label", F.round(F.array_max(F.map_values("by")).cast("double"), 6).alias("most"), (F.array_position("embedding", F.array_max("embedding")) - 1).alias("place"), F.size(F.map_filter("by", lambda _, v: v.cast("double") > 0.2)).cast("long").alias("strong"))


#: Families of printmaking by the words that name them.
FAMILIES = (("intaglio", r"(?i)\b(?:etching|aquatint|drypoint|engraving|mezzotint)\b"), ("planographic", r"(?i)\b(?:lithograph|monotype)\b"), ("relief", r"(?i)\b(?:woodcut|linocut|wood engraving)\b"), ("stencil", r"(?i)\b(?:screenprint|serigraph|silkscreen|pochoir)\b"), ("photomechanical", r"(?i)\b(?:offset|giclee|photogravure)\b"))
FAMILY_LIST = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(body, '{quoted(p)}') THEN '{n}' END" for n, p in FAMILIES) + "], lambda x: x IS NOT NULL)"


@query(f"WITH {LISTED} SELECT sale, lot, {ladder_sql('body', FAMILIES)} AS family, array_to_string(list_sort({FAMILY_LIST}), ',') AS families FROM listed")
def technique_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lot's family of printmaking, the first that its description names, and all that it names."""
    body = F.col("body")
    return listed(spark, sf_dir).select("sale", "lot", text.first_match(body, list(FAMILIES)).alias("family"), F.array_join(text.all_matches(body, list(FAMILIES)), ",").alias("families"))


PROCESSES = (("offset", r"(?i)\boffset\b"), ("etching", r"(?i)\betching\b"), ("lithograph", r"(?i)\blithograph\b"), ("screenprint", r"(?i)\bscreenprint\b"), ("woodcut", r"(?i)\bwoodcut\b"))
PROOFS = (("artist proof", r"(?i)\b(?:artist.s proof|a\.?p\.?)\b"), ("proof", r"(?i)\bproofs?\b"), ("numbered", r"(?i)\bnumbered\b"))


@query(f"WITH {LISTED} SELECT sale, lot, {ladder_sql('body', PROCESSES)} AS process, coalesce({ladder_sql('body', PROOFS)}, 'unknown') AS proof, CASE WHEN regexp_matches(body, '(?i)in pencil') THEN 'pencil' WHEN regexp_matches(body, '(?i)signed') THEN 'signed' ELSE 'unsigned' END AS signature, regexp_matches(body, '(?i)\\bposter\\b') AS poster FROM listed")
def print_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Process, kind of proof, signature and whether it's a poster, by the wording of a description."""
    body = F.col("body")
    signature = F.when(body.rlike("(?i)in pencil"), "pencil").when(body.rlike("(?i)signed"), "signed").otherwise("unsigned")
    return listed(spark, sf_dir).select("sale", "lot", text.first_match(body, list(PROCESSES)).alias("process"), text.first_match(body, list(PROOFS), "unknown").alias("proof"), signature.alias("signature"), body.rlike(r"(?i)\bposter\b").alias("poster"))


@query(f"""WITH {LISTED}, m AS (SELECT l_partkey AS work, CAST(min(l_quantity) AS INTEGER) AS least FROM lineitem GROUP BY 1), c AS (SELECT sale, lot, listed.work, {EDITION} AS said, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_quantity AS INTEGER) END AS seen, least FROM listed JOIN m ON m.work = listed.work)
SELECT sale, lot, work, coalesce(said, seen, least) AS edition, CASE WHEN said IS NOT NULL THEN 'catalogue' WHEN seen IS NOT NULL THEN 'appraiser' ELSE 'work' END AS source, CASE WHEN said IS NULL OR seen IS NULL THEN 'unassessable' WHEN said = seen THEN 'agrees' ELSE 'diverges' END AS verdict FROM c""")
def edition_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each lot's edition with its source, the catalogue before the appraiser before the work's other lots, and whether the first two agree."""
    lots = listed(spark, sf_dir)
    least = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("work")).agg(F.min("l_quantity").cast("int").alias("least"))
    said, seen = text.edition_size(F.col("body")), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity").cast("int"))
    both = lots.join(least, "work").select("sale", "lot", "work", said.alias("said"), seen.alias("seen"), "least")
    values = [F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("value"), F.lit(n).alias("source"))) for c, n in (("said", "catalogue"), ("seen", "appraiser"), ("least", "work"))]
    found = F.coalesce(*values)
    verdict = F.when(F.col("said").isNull() | F.col("seen").isNull(), "unassessable").when(F.col("said") == F.col("seen"), "agrees").otherwise("diverges")
    return both.select("sale", "lot", "work", found["value"].alias("edition"), found["source"].alias("source"), verdict.alias("verdict"))


#: A lot's description as a house prints it, lines parted by tags; every seventh sale's lots hold a second work.
PRINTED_SQL = """CASE l_suppkey % 3 WHEN 0 THEN 'After ' WHEN 1 THEN 'Attributed to ' ELSE '' END || replace(s_name, '#', ' ') || ',<br>' || CASE s_nationkey % 3 WHEN 0 THEN 'Spanish' WHEN 1 THEN 'French/Belgian' ELSE 'New Zealand' END || CASE l_orderkey % 2 WHEN 0 THEN ' 1881-1973' ELSE ' b.1965' END || ',<br/><br>'
    || CASE WHEN l_orderkey % 7 = 0 THEN 'Two works:<br>(i) ' ELSE '' END || p_name || CASE l_linenumber % 3 WHEN 0 THEN ' [Bloch ' || CAST(p_size AS {0}) || ']' ELSE '' END || ', ' || CAST(year(l_shipdate) AS {0}) || ';<br>'
    || CASE l_linenumber % 2 WHEN 0 THEN 'etching on wove paper' ELSE 'screenprint' END || ',<br>' || CASE l_orderkey % 3 WHEN 0 THEN 'from the edition of 1,' || lpad(CAST(CAST(l_quantity AS INTEGER) AS {0}), 3, '0') WHEN 1 THEN 'signed and numbered 1/' || CAST(CAST(l_quantity AS INTEGER) AS {0}) || ' in pencil' ELSE 'an artist&#39;s proof' END || ',<br>'
    || CASE WHEN l_linenumber % 4 = 1 THEN 'printed by Atelier &Eacute;lan &amp; Fils, Paris,<br>' ELSE '' END || 'image: ' || CAST(p_size AS {0}) || ' x ' || CAST(CAST(l_quantity AS INTEGER) AS {0}) || 'cm,<br>'
    || CASE WHEN l_orderkey % 7 = 0 THEN '(ii) Ring &amp; Bell, c.1950;<br>lithograph on wove,<br>' ELSE '' END || CASE WHEN l_quantity > 25 THEN '(framed)<br>' ELSE '' END || CASE WHEN l_orderkey % 5 = 0 THEN 'Provenance<br>Galerie Z,<br>Paris' ELSE '' END"""


#: Descriptions that a task reads, about.
LOTS = 100_000


@query("""WITH l AS (SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey), w AS (SELECT *, unnest(CASE WHEN l_orderkey % 7 = 0 THEN [1, 2] ELSE [1] END) AS k FROM l)
SELECT l_orderkey AS sale, l_linenumber AS lot, CAST(k AS INTEGER) AS work, replace(s_name, '#', ' ') AS artist, CASE l_suppkey % 3 WHEN 0 THEN 'after' WHEN 1 THEN 'attributed' ELSE 'certain' END AS hand, CASE s_nationkey % 3 WHEN 0 THEN 'Spanish' WHEN 1 THEN 'French/Belgian' ELSE 'New Zealand' END AS nationality, CASE l_orderkey % 2 WHEN 0 THEN '1881-1973' ELSE 'b.1965' END AS life,
  CASE k WHEN 2 THEN 'Ring & Bell' ELSE p_name || CASE l_linenumber % 3 WHEN 0 THEN ' [Bloch ' || CAST(p_size AS VARCHAR) || ']' ELSE '' END END AS title, CASE k WHEN 2 THEN 'c.1950' ELSE CAST(year(l_shipdate) AS VARCHAR) END AS year,
  CASE WHEN k = 2 THEN 'lithograph' WHEN l_linenumber % 2 = 0 THEN 'etching' ELSE 'screenprint' END AS medium, CASE WHEN k = 2 THEN 'wove' WHEN l_linenumber % 2 = 0 THEN 'wove paper' END AS support,
  CASE WHEN k = 2 THEN NULL WHEN l_orderkey % 3 = 0 THEN 1000 + CAST(l_quantity AS INTEGER) WHEN l_orderkey % 3 = 1 THEN CAST(l_quantity AS INTEGER) END AS edition_size, k = 1 AND l_orderkey % 3 = 1 AS signed, CASE WHEN k = 1 AND l_linenumber % 4 = 1 THEN 'Atelier Élan & Fils, Paris' END AS printer,
  CASE WHEN k = 1 THEN CAST(p_size AS DOUBLE) END AS width, CASE WHEN k = 1 THEN l_quantity END AS height, CASE WHEN k = 1 AND l_linenumber % 3 = 0 THEN 'Bloch ' || CAST(p_size AS VARCHAR) ELSE '' END AS entries, l_quantity > 25 AS framed, CASE WHEN l_orderkey % 5 = 0 THEN 'Galerie Z, Paris' END AS provenance, CASE WHEN l_orderkey % 7 = 0 THEN '2 works' END AS several,
  CAST(CASE WHEN k = 1 AND l_linenumber % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN k = 1 AND l_linenumber % 4 = 1 THEN 1 ELSE 0 END + CASE WHEN l_orderkey % 5 = 0 THEN 1 ELSE 0 END AS INTEGER) AS leaks FROM w""")
def catalogue_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every work of every lot, with all that its printed description says, by the reader of the table function ``catalogue_works`` over whole descriptions."""
    from lotwise.functions import catalogue

    makers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    read = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate")
    lots = read.join(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), F.col("l_partkey") == F.col("p_partkey")).join(makers, F.col("l_suppkey") == F.col("s_suppkey"))
    # joins, or a file of few row groups, would leave a few long tasks
    dealt = lots.repartition(max(2 * spark.sparkContext.defaultParallelism, -(-read.count() // LOTS)), "l_orderkey", "l_linenumber")
    printed = dealt.select(F.col("l_orderkey").alias("sale"), F.col("l_linenumber").alias("lot"), F.expr(PRINTED_SQL.format("STRING")).alias("body"))
    # by batches: rows that go to the table function and back one by one take longer than the reading
    said = ["work", "artist", "hand", "nationality", "life", "title", "year", "medium", "support", "edition_size", "signed", "printer", "entries", "framed", "provenance", "several", "leaks"]
    return catalogue.described(printed, "body", said).select("sale", "lot", *said[:12], "width", "height", F.array_join("entries", ";").alias("entries"), "framed", "provenance", "several", F.size("leaks").alias("leaks"))
