"""Descriptions read by batches give the rows of the table function."""

from pyspark.sql import functions as F
from test_queries import QUERIES, SF

from lotwise.functions import catalogue

TEXTS = [
    None, "", "<br> ;", "Pablo Picasso RA, After Dora Maar<br>Spanish 1881-1973<br>Two works:<br>(i) Ring [Bloch 4; Baer 618Bd], 1932;<br>etching on wove<br>signed and numbered 3/40 in pencil<br>image: 3 x 4 cm<br>(ii) Bell, c.1950;<br>(framed)<br>Provenance<br>Galerie Picasso",
    "Attributed to X<br>Title<br>numbered<br>5/60<br>printed by<br>published by Y;", "Y<br>b. 1920<br>a set of four (4)<br>edition<br>of 1,000, [Bloch<br>7]<br>plate: 3.5 × 4in",
]


def test_batches_and_the_table_function_agree(spark):
    columns = ["work", "artist", "hand", "others", "title", "year", "medium", "support", "edition", "edition_size", "signed", "inscriptions", "printer", "publisher", "entries", "framed", "provenance", "several", "leaks"]
    lots = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 3)], "id long, body string").repartition(2)
    found = catalogue.described(lots, "body", columns)
    assert found.schema["edition_size"].dataType.simpleString() == "int" and found.columns == ["id", *columns, "width", "height"]
    catalogue.register(spark)
    first = F.try_element_at("sizes", F.lit(1))
    want = spark.sql("SELECT id, w.* FROM {lots}, LATERAL catalogue_works(body) w", lots=lots).select("id", *columns, first["width"].alias("width"), first["height"].alias("height"))
    assert found.count() == 15 and sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    one = {r.title: r for r in found.where("id = 3").collect()}
    assert (one["Ring [Bloch 4; Baer 618Bd]"].edition_size, one["Ring [Bloch 4; Baer 618Bd]"].width, one["Bell"].year, one["Bell"].leaks) == (40, 3.0, "c.1950", ["surname Picasso", "provenance names a seat"])


def test_lots_are_not_handed_over_one_by_one(spark):
    plan = QUERIES["catalogue_works"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "UDTF" not in plan
