"""Sums that leave 64 bits as the tables grow."""

import datetime
import decimal

from tidelog import registry


def test_times_of_deletes_sum_to_more_than_64_bits(spark, tmp_path):
    def sums(keys):
        path = f"{tmp_path}/{keys[0]}"
        rows = [(k, 7, "O", 1.5, datetime.datetime(2001, 8, 2), "1-URGENT") for k in keys]
        columns = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
        spark.createDataFrame(rows, columns).write.parquet(f"{path}/orders.parquet")
        spark.range(0).write.parquet(f"{path}/part.parquet")  # named like a column of the messages
        found = registry.QUERIES["b03_rewrite_deletes"](spark, path)
        return found.schema["ts_sum"].dataType.simpleString(), {r["__op"]: (r["n"], r["ts_sum"], r["n_keys"]) for r in found.collect()}

    large = [10**18, 10**18 + 5]  # each message has the time 1.7e12 + 8 * key
    assert all(k * 8 % 97 != 5 for k in large)
    assert sums(large) == ("decimal(29,0)", {"r": (2, decimal.Decimal(2 * 1700000000000 + 8 * sum(large)), 2)})
    assert sums([5, 10]) == ("bigint", {"r": (2, 2 * 1700000000000 + 8 * 15, 2)})
