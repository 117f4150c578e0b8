"""The sort query numbers every order."""

from lodestrata import queries as Q


def test_every_position(spark, tmp_path):
    rows = [(k, k * 37 % 50) for k in range(1, 1301)]
    days = spark.createDataFrame(rows, "o_orderkey long, n int").selectExpr("o_orderkey", "timestamp '1995-01-01' + make_interval(0, 0, 0, n) as o_orderdate")
    days.repartition(5).write.parquet(f"{tmp_path}/orders.parquet")
    want = [(k, i + 1) for i, (k, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))]
    assert sorted(map(tuple, Q.QUERIES["sort_pos"](spark, str(tmp_path)).collect()), key=lambda r: r[1]) == want
