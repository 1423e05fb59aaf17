"""What a lot is worth may rest on nothing of its day or later."""

import pytest
from pyspark.sql import functions as F

from lotwise.plans import valuation

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def dearer(spark, tmp_path_factory):
    """The fixture with all sales from a day on ten times as dear and in other houses' order; and that day."""
    path = str(tmp_path_factory.mktemp("later"))
    for t in ("orders", "customer", "part", "supplier", "nation", "region"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{path}/{t}.parquet")
    lots = spark.read.parquet(f"{SF}/lineitem.parquet")
    until = valuation.latest(valuation.priced(spark, SF)).select("until")
    day = until.agg(F.percentile_approx("until", 0.5)).first()[0]
    late = F.col("l_shipdate").cast("date") >= F.lit(day)
    lots.withColumn("l_extendedprice", F.when(late, F.col("l_extendedprice") * 10).otherwise(F.col("l_extendedprice"))).write.parquet(f"{path}/lineitem.parquet")
    return path, day


@pytest.mark.parametrize("name", ["rebased_comps", "attribute_prices", "price_witnesses", "valuations"])
def test_later_sales_change_nothing(spark, dearer, name):
    path, day = dearer
    probes = valuation.latest(valuation.priced(spark, SF)).where(F.col("until") <= F.lit(day)).select("work")
    find = valuation.REGISTRY.queries[name]
    rows = lambda sf: sorted(map(str, find(spark, sf).join(probes, "work").collect()))
    before, after = rows(SF), rows(path)
    assert len(before) > 50 and before == after
