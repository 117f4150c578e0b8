"""The full outer join keeps every row of both sides."""

from lodestrata import queries as Q


def test_every_supplier(spark, tmp_path):
    suppliers = [(k, k % 6) for k in range(20)]
    nations = [(k, f"n{k}", k % 5) for k in range(9)]
    spark.createDataFrame(suppliers, "s_suppkey long, s_nationkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame(nations, "n_nationkey long, n_name string, n_regionkey long").write.parquet(f"{tmp_path}/nation.parquet")
    ref = {k: n for k, n, r in nations if r < 3}
    want = [(n, s, ref.get(n)) for s, n in suppliers] + [(k, None, n) for k, n in ref.items() if k not in {x for _, x in suppliers}]
    got = Q.QUERIES["attribute_join_outer"](spark, str(tmp_path)).select("s_nationkey", "s_suppkey", "n_name").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
