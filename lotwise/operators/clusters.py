"""Clusters of records that may be one: what speaks against a pair or a cluster, and which clusters are held back."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.operators.durable import durable
from lotwise.operators.graph import least_reachable


def digits(number: Column) -> Column:
    """The digits that a catalogue number begins with, which an edition's letters may follow."""
    return F.regexp_extract(number, "^[0-9]*", 0)


def entry_conflicts(members: DataFrame, entries: DataFrame) -> DataFrame:
    """(cluster, prefix, numbers): catalogues that know a cluster's members under several numbers, whole numbers compared.

    ``members`` has cluster and node, ``entries`` node, prefix and number.  "618" and "618Bd" differ here.
    """
    seen = members.select("cluster", "node").join(entries, "node").where("prefix IS NOT NULL AND number IS NOT NULL")
    return seen.groupBy("cluster", "prefix").agg(F.array_sort(F.collect_set("number")).alias("numbers")).where(F.size("numbers") > 1)


def holding_conflicts(members: DataFrame, holdings: DataFrame) -> DataFrame:
    """(cluster, institution, accessions): institutions, not auctions, that hold a cluster's members under several accessions."""
    seen = members.select("cluster", "node").join(holdings.where("institutional AND institution IS NOT NULL AND accession IS NOT NULL"), "node")
    found = seen.groupBy("cluster", "institution").agg(F.array_sort(F.collect_set(F.trim("accession"))).alias("accessions"))
    return found.where(F.size("accessions") > 1)


def numbers_by_prefix(entries: DataFrame) -> DataFrame:
    """(node, by): the catalogues that know a node, in order, each with the numbers it has for it."""
    known = entries.where("prefix IS NOT NULL AND number IS NOT NULL").groupBy("node", "prefix").agg(F.array_sort(F.collect_set("number")).alias("numbers"))
    return known.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("prefix", "numbers"))).alias("by"))


def verdict(x: Column, y: Column) -> Column:
    """The verdict on two nodes by what :func:`numbers_by_prefix` says of them, null or empty for none; either way round."""
    x, y = F.map_from_entries(x), F.map_from_entries(y)
    shared = F.array_intersect(F.map_keys(x), F.map_keys(y))
    heads = lambda m, p: F.transform(m[p], digits)
    agree = F.exists(shared, lambda p: F.arrays_overlap(x[p], y[p]))
    near = F.exists(shared, lambda p: F.arrays_overlap(heads(x, p), heads(y, p)))
    return F.when(F.coalesce(F.size(shared), F.lit(0)) <= 0, "silent").when(agree, "agree").when(near, "silent").otherwise("conflict")


def numbers(entries: DataFrame) -> DataFrame:
    """(node, known): what catalogues know of a node, each catalogue with each number, in order."""
    return entries.where("prefix IS NOT NULL AND number IS NOT NULL").groupBy("node").agg(F.array_sort(F.collect_set(F.struct("prefix", "number"))).alias("known"))


#: Verdicts by their numbers.
VERDICTS = ["silent", "agree", "conflict"]


def verdict_table(known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A number for each node's list of :func:`numbers`, equal for equal ones, and the verdict on every two numbers: :func:`verdict` as products of matrices of what nodes hold."""
    row, entry = pc.list_parent_indices(known).to_numpy(), known.flatten()
    prefix, number = entry.field("prefix"), entry.field("number")
    head = pc.replace_substring_regex(number, r"(?s)[^0-9].*$", "")

    def held(*columns: pa.Array) -> np.ndarray:
        """Which node has which values of the columns, as zeros and ones."""
        at = np.zeros(len(row), int)
        for c in columns:
            code = pc.dictionary_encode(c).indices.to_numpy()
            at = np.unique(at * (len(code) + 1) + code, return_inverse=True)[1]
        out = np.zeros((len(known), at.max(initial=-1) + 1), np.float32)
        out[row, at] = 1
        return out

    if not len(row):
        return np.zeros(len(known), int), np.zeros((1, 1), np.int8)
    whole = held(prefix, number)
    packed = np.ascontiguousarray(np.packbits(whole > 0, axis=1))
    _, first, code = np.unique(packed.view(np.dtype((np.void, packed.shape[1]))).ravel(), return_index=True, return_inverse=True)
    sides, out = [m[first] for m in (whole, held(prefix, head), held(prefix))], np.zeros((len(first), len(first)), np.int8)
    for lo in range(0, len(first), 512):  # a part of the products at a time
        agree, near, shared = (m[lo : lo + 512] @ m.T > 0 for m in sides)
        out[lo : lo + 512] = np.where(agree, 1, np.where(shared & ~near, 2, 0))
    return code.ravel(), out


def pair_verdicts(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """Pairs with ``verdict``: agree (a catalogue has both under one number), conflict (those that know both have numbers of different digits), else silent.

    Here "618" and "618Bd" are silent: a letter may name an edition, so it is neither corroboration nor a veto.
    """
    each = numbers_by_prefix(entries)
    both = pairs.join(each.select(F.col("node").alias("a"), F.col("by").alias("_a")), "a", "left").join(each.select(F.col("node").alias("b"), F.col("by").alias("_b")), "b", "left")
    return both.withColumn("verdict", verdict(F.col("_a"), F.col("_b"))).select(*pairs.columns, "verdict")


def held(pairs: DataFrame, rejected: DataFrame, years: DataFrame, spread: int, members: DataFrame | None = None) -> DataFrame:
    """(node, cluster, size, confidence, reason): clusters of the pairs that aren't rejected, and why one is held, null if it isn't.

    A cluster goes by its least node and is as sure as its least sure pair.  It is held if a rejected pair lies within it,
    chained together by others, else if its years lie further apart than ``spread``.  Pairs (a, b, confidence) and rejected
    pairs (a, b) may come either way round and more than once; nulls take no part, nor do years of zero.
    With ``members`` (rep, node) pairs are of classes by their least node, a class with itself for those within, and each
    stands for all pairs of nodes that it would make.
    """
    ordered = lambda df: df.where("a IS NOT NULL AND b IS NOT NULL" + ("" if members is not None else " AND a <> b")).withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")})
    no = ordered(rejected.select("a", "b")).distinct()
    kept = ordered(pairs.select("a", "b", "confidence")).join(no, ["a", "b"], "left_anti")
    found = least_reachable(kept.select("a", "b")).withColumnRenamed("component", "cluster")
    if members is not None:
        alone = kept.where("a = b").select(F.col("a").alias("node")).distinct().join(found, "node", "left_anti")
        found = durable(found.unionByName(alone.select("node", F.col("node").alias("cluster"))))
    of = lambda c: found.select(F.col("node").alias(c), F.col("cluster").alias(f"_{c}"))
    sure = kept.join(of("a"), "a").groupBy(F.col("_a").alias("cluster")).agg(F.min("confidence").alias("confidence"))
    within = no.join(of("a"), "a").join(of("b"), "b").where("_a = _b")
    made = F.lit(1)
    if members is not None:
        sizes = members.groupBy("rep").agg(F.count("*").alias("_n"))
        within = within.join(sizes.select(F.col("rep").alias("a"), F.col("_n").alias("_na")), "a").join(sizes.select(F.col("rep").alias("b"), F.col("_n").alias("_nb")), "b")
        made = F.when(F.col("a") == F.col("b"), F.expr("_na * (_na - 1) div 2")).otherwise(F.col("_na") * F.col("_nb"))
        found = members.join(found.withColumnRenamed("node", "rep"), "rep").select("node", "cluster")
    return clusters_of(found, sure, within.groupBy(F.col("_a").alias("cluster")).agg(F.sum(made).alias("n")), years, spread)


def clusters_of(found: DataFrame, sure: DataFrame, broken: DataFrame, years: DataFrame, spread: int) -> DataFrame:
    """The clusters of :func:`held` from (node, cluster), (cluster, confidence) and (cluster, n), the number of rejected pairs within."""
    broken = broken.withColumnRenamed("n", "_broken")
    dated = found.join(years.where("year <> 0"), "node", "left").groupBy("cluster").agg(F.count_distinct("node").alias("size"), F.min("year").alias("_first"), F.max("year").alias("_last"))
    wide = F.col("_last") - F.col("_first") > spread
    reason = F.when(F.col("_broken") > 0, F.concat(F.col("_broken").cast("string"), F.lit(" rejected within"))).when(wide, F.concat(F.lit("years "), F.col("_first").cast("string"), F.lit(" to "), F.col("_last").cast("string")))
    facts = dated.join(sure, "cluster").join(broken, "cluster", "left").select("cluster", "size", "confidence", reason.alias("reason"))
    return found.join(facts, "cluster").select("node", "cluster", "size", "confidence", "reason")


def generated(records: DataFrame, node: str, keys: dict[str, list[Column]], most: int | None = None) -> DataFrame:
    """(generator, key, node, size): records that share a key of a generator, one row each; a key with a null part is none.

    Clusters come as members, not as pairs; with ``most``, keys of more members are left to other generators.
    """
    each = [records.select(F.lit(name).alias("generator"), F.when(reduce(Column.__and__, (c.isNotNull() for c in parts)), F.concat_ws("|", *(c.cast("string") for c in parts))).alias("key"), F.col(node).alias("node")) for name, parts in keys.items()]
    members = reduce(DataFrame.unionByName, each).where("key IS NOT NULL AND node IS NOT NULL").distinct()
    sizes = members.groupBy("generator", "key").agg(F.count("*").alias("size")).where("size > 1" if most is None else f"size BETWEEN 2 AND {most}")
    return members.join(sizes, ["generator", "key"]).select("generator", "key", "node", "size")
