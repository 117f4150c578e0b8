"""The spanning tree's edges against Kruskal's."""

from lodestrata import queries as Q

N = 410


def test_least_weight(spark, tmp_path):
    spark.range(N).withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    root = list(range(N))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    want = []
    for w, _, k, s in sorted((1.0 + k * 31 % 97, k * 10 + s, k, s) for k in range(N) for s in (1, 7) if k + s < N):
        a, b = find(k), find(k + s)
        if a != b:
            root[a] = b
            want.append((k, s, w))
    assert sorted(map(tuple, Q.QUERIES["mst"](spark, str(tmp_path)).collect())) == sorted(want)
