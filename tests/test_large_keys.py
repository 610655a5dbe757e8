"""Keys whose derived values leave 64 bits as the tables grow."""

from tidelog import registry


def test_chunk_bounds_of_cubes_above_64_bits(spark, tmp_path):
    keys = spark.range(1000, 6_401_000, 1000).withColumnRenamed("id", "o_orderkey")  # the last cube is 2.6e20
    keys.write.parquet(f"{tmp_path}/orders.parquet")
    row = registry.QUERIES["a01_chunk_bounds"](spark, str(tmp_path)).first()
    assert tuple(row) == (32, True, 6400, sum(range(1000, 6_401_000, 1000)))
