"""Interaction of document filters: what each filter removes, alone and after others, in every order.

Five flags a document say which filters it fails.  Documents are counted by part and flags, the counts are rolled up by
``CUBE`` over the flags and the part, and the grouping-set row whose selected flags are all false holds the survivors of
that subset of filters.  A step of an order is a pair of such subsets, with and without its filter.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.llm.common import written

FILTERS = "ABCDE"
_COUNTS = ("n", "good", "toxic")


def flags(text: Column) -> dict[str, Column]:
    """Which of the filters A to D a text fails; the text may not be null."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    capitals = F.size(F.split(text, "[A-Z]")) - 1
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 50 * F.size(words).cast("long"),
        "C": 100 * capitals.cast("long") > 3 * F.char_length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents by part, filters failed and labels: (part, A .. E, n, good, toxic).

    Texts travel as digests.  Whether a document repeats a smaller id's text follows from the least id of its digest,
    found from counts by digest, part and labels, so a text with any number of copies is a few rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    seen = docs.select(F.col("doc_id"), F.coalesce(F.col("lang"), F.lit("")).alias("part"), F.sha2(text.cast("binary"), 256).alias("digest"), *(f.alias(name) for name, f in flags(text).items()))
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("is_good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("is_toxic"))
    kind = ["digest", "part", *FILTERS[:4], "is_good", "is_toxic"]
    rows = seen.join(marks, "doc_id", "left").withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("is_good", "is_toxic")})
    by_id = rows.groupBy("doc_id", *kind).agg(F.count("*").alias("n"))  # a row an id, but for repeated ids
    by_text = by_id.groupBy(*kind, F.isnull("doc_id").alias("nameless")).agg(F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"))
    by_text = written(by_text, "texts")  # read twice
    first = by_text.groupBy("digest").agg(F.min("least").alias("first"))
    with_first = by_text.join(first, "digest")
    copies = F.when(F.col("nameless"), 0).when(F.col("least") == F.col("first"), F.col("n") - F.col("n_least")).otherwise(F.col("n"))
    both = with_first.withColumn("copies", copies.cast("long"))
    split = both.select(*kind[1:], F.explode(F.array(F.struct(F.lit(False).alias("E"), (F.col("n") - F.col("copies")).alias("n")), F.struct(F.lit(True).alias("E"), F.col("copies").alias("n")))).alias("by_e"))
    if_true = lambda c: F.sum(F.when(F.col(c), F.col("by_e.n")).otherwise(0))
    return split.where("by_e.n > 0 OR NOT by_e.E").groupBy("part", *FILTERS[:4], F.col("by_e.E").alias("E")).agg(F.sum("by_e.n").alias("n"), if_true("is_good").alias("good"), if_true("is_toxic").alias("toxic"))


def _bits(names: str) -> int:
    return sum(1 << FILTERS.index(c) for c in names)


def survivors(failed: DataFrame) -> DataFrame:
    """Documents that pass a subset of the filters: (part, subset, n, good, toxic), subsets as bits, zeros included."""
    cube = failed.cube(*FILTERS, "part").agg(*(F.sum(c).alias(c) for c in _COUNTS), F.grouping("part").alias("all_parts"), *(F.grouping(c).alias(f"without_{c}") for c in FILTERS))
    none_fails = F.lit(True)
    subset = F.lit(0)
    for k, c in enumerate(FILTERS):
        chosen = F.col(f"without_{c}") == 0
        none_fails = none_fails & (~chosen | ~F.coalesce(F.col(c), F.lit(False)))
        subset = subset + F.when(chosen, 1 << k).otherwise(0)
    found = cube.where((F.col("all_parts") == 0) & none_fails).select("part", subset.alias("subset"), *_COUNTS)
    every = failed.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit(2 ** len(FILTERS) - 1))).alias("subset"))
    return every.join(found, ["part", "subset"], "left").fillna(0, list(_COUNTS))


def steps() -> list[tuple[str, int, str, int, int]]:
    """Every step of every order: order, step, filter, subset before, subset after."""
    return [(order := "".join(p), k, order[k - 1], _bits(order[: k - 1]), _bits(order[:k])) for p in permutations(FILTERS) for k in range(1, len(FILTERS) + 1)]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What every filter removes at every step of every order, by part.

    ``docs`` has doc_id, text and lang, ``labels`` doc_id, quality and toxic; other columns are not read, whatever their
    names.  Returns part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600
    rows a part, a part for each lang.  Null text and lang are empty; an empty text fails A only (and E).  Of equal texts
    those of the least doc_id pass E, all of them if that id is repeated; a null doc_id neither fails E nor makes others
    fail it.  Labels count once a document: good if any row has quality 1, toxic if any has toxic 1; none or null
    counts as neither.  Without documents there are no parts and no rows.
    """
    spark, every = docs.sparkSession, _bits(FILTERS)
    left = survivors(failures(docs, labels))
    plan = F.broadcast(spark.createDataFrame(steps(), "filter_order string, step int, letter string, before int, after int"))  # 600 rows
    orders = F.broadcast(plan.groupBy("letter", "before", "after").agg(F.count("*").alias("times")))  # 80 rows
    before = left.select("part", F.col("subset").alias("before"), *(F.col(c).alias(f"{c}_before") for c in _COUNTS))
    after = left.select("part", F.col("subset").alias("after"), *(F.col(c).alias(f"{c}_after") for c in _COUNTS))
    lost = {c: F.col(f"{c}_before") - F.col(f"{c}_after") for c in _COUNTS}
    pairs = before.join(orders, "before").join(after, ["part", "after"])
    pairs = pairs.select("part", "letter", "before", "after", "times", F.col("n_after").alias("kept"), *(e.alias(f"{c}_lost") for c, e in lost.items()))
    at = lambda where: F.sum(F.when(where, F.col("n_lost")).otherwise(0))
    of_filter = pairs.groupBy("part", "letter").agg(at(F.col("before") == 0).alias("fails"), at(F.col("after") == every).alias("unique_fails"), F.sum(F.col("times") * F.col("n_lost")).alias("shapley"))
    told = pairs.join(of_filter, ["part", "letter"]).join(plan, ["letter", "before", "after"])
    return told.select("part", "filter_order", "step", "kept", F.col("n_lost").alias("removed"), (F.col("fails") - F.col("n_lost")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")
