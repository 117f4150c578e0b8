"""The pivot query has a column for each nation."""

from collections import Counter

from lodestrata import queries as Q


def test_every_nation(spark, tmp_path):
    rows = [(f"s{k % 3}", k * k % 25) for k in range(200)] + [("s0", k) for k in range(25)]
    spark.createDataFrame(rows, "c_mktsegment string, c_nationkey long").write.parquet(f"{tmp_path}/customer.parquet")
    want = Counter(rows)
    got = Q.QUERIES["pivot"](spark, str(tmp_path))
    assert set(got.columns) == {"c_mktsegment", *(f"bal_{k}" for k in range(25))}
    assert {(r["c_mktsegment"], k): r[f"bal_{k}"] for r in got.collect() for k in range(25) if r[f"bal_{k}"] is not None} == want
