"""Tables and the sale record built from them.

A sale record has one row per priced lot: ``work, artist, sale, house, sale_date, hammer, sold, technique, title,
series, edition, estimate``.  Any table can be bound to these roles; here lines of an order stand for lots of a sale,
parts for works and suppliers for artists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sale records without their sale's header: no join, for queries that need none."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("work"), F.col("l_suppkey").alias("artist"), F.col("l_orderkey").alias("sale"), F.col("l_linenumber").alias("lot"),
        F.col("l_shipdate").cast("date").alias("sale_date"), F.col("l_extendedprice").cast(MONEY).alias("hammer"),
        (F.col("l_returnflag") != "R").alias("sold"), F.col("l_quantity").cast("int").alias("edition"), (F.col("l_linestatus") == "F").alias("signed"), F.col("l_tax").alias("premium"),
    )


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("work"), F.col("p_name").alias("title"), F.col("p_brand").alias("series"), F.col("p_type").alias("technique"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("list_price"))


def artists(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "n_name", "r_name")
    return table(spark, sf_dir, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(F.col("s_suppkey").alias("artist"), F.col("s_name").alias("name"), F.col("n_name").alias("nationality"), F.col("r_name").alias("region"))


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales with their house."""
    houses = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("house"))
    return table(spark, sf_dir, "orders").join(houses, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("sale"), "house", F.col("o_custkey").alias("owner"), F.col("o_orderdate").cast("date").alias("offered"), F.col("o_totalprice").cast(MONEY).alias("estimate"), F.col("o_orderstatus").alias("status"))


def csv(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a CSV file by a fixed schema, and those that don't fit it, with the raw line as ``_corrupt``."""
    read = spark.read.schema(f"{schema}, _corrupt string").option("header", True).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").csv(path)
    return read.where(F.col("_corrupt").isNull()).drop("_corrupt"), read.where(F.col("_corrupt").isNotNull())


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def triples(spark: SparkSession, path: str) -> DataFrame:
    """Subject, predicate, object and whether the object is a literal, of an N-Triples file."""
    line = F.col("value")
    pattern = r'^<([^>]*)>\s+<([^>]*)>\s+(?:<([^>]*)>|"((?:[^"\\]|\\.)*)".*)\s*\.\s*$'
    literal = F.length(F.regexp_extract(line, pattern, 3)) == 0
    fits = spark.read.text(path).where(line.rlike(pattern))
    return fits.select(F.regexp_extract(line, pattern, 1).alias("subject"), F.regexp_extract(line, pattern, 2).alias("predicate"), F.when(literal, F.regexp_extract(line, pattern, 4)).otherwise(F.regexp_extract(line, pattern, 3)).alias("object"), literal.alias("is_literal"))


def rates(spark: SparkSession, path: str) -> DataFrame:
    """(day, currency, rate) of a JSON document ``{day: {currency: rate}}``."""
    text = spark.read.text(path, wholetext=True)
    days = text.select(F.explode(F.from_json("value", "map<string,map<string,double>>")).alias("day", "by"))
    return days.select(F.col("day").cast("date").alias("day"), F.explode("by").alias("currency", "rate"))


def database(spark: SparkSession, url: str, name: str, column: str, low: int, high: int, parts: int) -> DataFrame:
    """A database table read in ranges of a numeric column."""
    return spark.read.jdbc(url, name, column=column, lowerBound=low, upperBound=high, numPartitions=parts)
