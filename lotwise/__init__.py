"""Analytics for art-auction and catalogue data, on Spark DataFrames."""
