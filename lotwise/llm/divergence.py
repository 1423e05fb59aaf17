"""Divergence of sources: how far the words of each source of a language are from those of the others.

Plain relational: terms are exploded and counted by group, groups are crossed with the kept vocabulary of their language
so that zeros are there too, the dense table is joined with itself on language and term, and sums are ranked.  A group is
a (lang, source); integers are exact throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.llm.common import written

#: What lies between terms, which are runs of letters A to Z and of anything beyond ASCII; splitting is many times as fast as extracting.
BETWEEN = "[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: Groups are broadcast up to so many; beyond it they are dealt with the vocabulary by language and part of its terms.
FEW_GROUPS = 20_000
#: Parts of a language's vocabulary, or of a group's terms, that are dealt out apart.
PARTS = 64
_SCALE = 10**9


def low(text: Column) -> Column:
    """A to Z in lower case, all else as it is."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, capitals, capitals.lower()))


def share(n: Column, total: Column, size: Column) -> Column:
    """1 + floor(10^9 (n + 1) / (total + size)), by way of decimals where the product exceeds a long."""
    div = lambda a, b: F.call_function("div", a, b)
    wide = div((n + 1).cast("decimal(20,0)") * F.lit(_SCALE).cast("decimal(10,0)"), (total + size).cast("decimal(20,0)"))
    return 1 + F.when(n < 9 * _SCALE, div((n + 1) * F.lit(_SCALE).cast("long"), total + size)).otherwise(wide)


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def _part(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int")


def _with_groups(rows: DataFrame, groups: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """``rows`` joined with the groups on ``keys``: by broadcast for few groups, else dealt out by key and part of the terms."""
    if few:
        return rows.join(F.broadcast(groups), keys)
    spread = groups.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return rows.withColumn("_part", _part(F.col("term"))).join(spread, [*keys, "_part"]).drop("_part")


def keyed(groups: DataFrame) -> tuple[DataFrame, Column]:
    """Groups with a number ``g`` each, and how it is made of lang and source: a hash, of the first seed by which no two groups agree."""
    whole = groups.count()
    for seed in range(100):
        g = F.xxhash64(F.lit(seed), "lang", "source")
        if groups.select(g).distinct().count() == whole:
            return groups.withColumn("g", g), g
    raise RuntimeError("no seed tells all groups apart")


def counted(docs: DataFrame, groups: DataFrame, g: Column, few: bool, least: int) -> DataFrame:
    """Terms in at least ``least`` documents of their language: (lang, term, n_lang, by_source).

    ``by_source`` maps the sources of the language that have the term to their counts, ``n_lang`` is their sum.  Terms of a
    document are sorted, so that each tells by its neighbour whether it is the document's first of its kind.
    """
    terms = docs.select(g.alias("g"), F.sort_array(F.split(low(F.col("text")), BETWEEN)).alias("term"))
    beside = terms.select("g", F.explode(F.arrays_zip("term", F.array_prepend("term", F.lit(None)).alias("before"))).alias("t"))
    counts = beside.select("g", "t.*").where("term <> ''").groupBy("g", "term").agg(F.count("*").alias("n"), F.count_if(~F.col("term").eqNullSafe(F.col("before"))).alias("docs"))
    named = _with_groups(counts, groups.select("g", "lang", "source"), ["g"], few)
    known = named.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("each"))  # a row a source
    return known.where(F.col("docs") >= least).select("lang", "term", "n_lang", F.map_from_entries("each").alias("by_source"))


def audit(docs: DataFrame, least: int = 3, top: int = 200, few_groups: int = FEW_GROUPS) -> DataFrame:
    """Divergence of every group from the other sources of its language, and the terms that set it apart from the language.

    ``docs`` has text, lang and source; other columns are not read, whatever their names.  Returns lang, source, part,
    item, value, rank.  Part ``pair`` has each other source of the language; its value sums floor((p-q)^2/q) over all
    kept terms, p the group's share of the term, q the other's.  Part ``term`` has terms of the group that are commoner
    there than in the language, up to ``top``.  Ranks go by value, ties by item in byte order.

    Nulls in the three columns count as ''.  Each row is a document, repeated ones and those with repeated ids too.  A
    group without kept terms has shares of (0 + 1) / (0 + V); a language without kept terms has pairs of value 0 and
    no terms; one with a single source has no pairs.  No documents give no rows.
    """
    blank = {c: F.coalesce(F.col(c), F.lit("")) for c in ("text", "lang", "source")}
    texts = docs.select(*(e.alias(c) for c, e in blank.items()))
    groups, g = keyed(written(texts.select("lang", "source").distinct(), "groups"))
    few = groups.count() <= few_groups
    kept = written(counted(texts, groups, g, few, least), "terms")
    each = kept.select("lang", "term", "n_lang", F.explode("by_source").alias("source", "n"))
    totals = each.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("size"), F.sum("n_lang").alias("lang_total"))
    groups = groups.drop("g").join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["total", "size", "lang_total"])
    groups = written(groups, "totals")

    dealt = kept.select("lang", "term", "by_source").repartition("lang", "term")  # before zeros are filled in, and as the join below wants it
    dense = _with_groups(dealt, groups.select("lang", "source", "total", "size"), ["lang"], few)
    dense = dense.select("lang", "term", "source", share(F.coalesce(F.try_element_at("by_source", F.col("source")), F.lit(0)), F.col("total"), F.col("size")).alias("p"))
    other = dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"))
    p, q = F.col("p"), F.col("q")
    both = dense.join(other, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(gap(p, q)).alias("there"), F.sum(gap(q, p)).alias("back"))
    ways = F.explode(F.array(F.struct("source", "item", F.col("there").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value"))))
    sums = both.select("lang", ways.alias("w")).select("lang", "w.*")
    wordless = groups.where("size = 0")
    zeros = wordless.select("lang", "source").join(wordless.select("lang", F.col("source").alias("item")), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = sums.unionByName(zeros).withColumn("rank", F.row_number().over(first)).withColumn("part", F.lit("pair"))

    known = _with_groups(each, groups, ["lang", "source"], few)
    p, q = share(F.col("n"), F.col("total"), F.col("size")), share(F.col("n_lang"), F.col("lang_total"), F.col("size"))
    ahead = known.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q").select("lang", "source", "item", gap(F.col("p"), F.col("q")).alias("value"))
    by_part = Window.partitionBy("lang", "source", _part(F.col("item"))).orderBy(F.desc("value"), "item")
    terms = ahead.withColumn("rank", F.row_number().over(by_part)).where(F.col("rank") <= top)  # so a group's last window has PARTS * top rows
    terms = terms.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
