import numpy as np

from tesselar.llm import topk, vector_dedup


def links(rows, least=0.98):
    ids = [r[0] for r in rows]
    ok = [r[2] is not None and r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], np.float64) for k in (i, j))
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
                    n[i] += 1
                    n[j] += 1
                    x, y = find(i), find(j)
                    root[x if ids[x] > ids[y] else y] = y if ids[x] > ids[y] else x
    return {ids[i]: (n[i], ids[find(i)]) for i in range(len(rows))}


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, 8))
    rows = []
    for k in range(240):
        v = base[rng.integers(0, 12)] + rng.normal(size=8) * rng.choice([0, 0.1, 0.2, 0.4])
        rows.append((k, [float(np.float32(x)) for x in v], int(rng.integers(0, 2)) if k % 17 else None))
    rows += [(240, None, 1), (241, [0.0] * 8, 1), (242, [float("nan")] + [1.0] * 7, 1), (243, [None] + [1.0] * 7, 0), (244, [float("inf")] * 8, 0)]
    return rows


def test_links(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    small = vector_dedup.VectorConfig(block=7, part=3, fan=2, directions=3, fitted=0)
    for cfg in (vector_dedup.VectorConfig(), vector_dedup.VectorConfig(block=7, part=2, fan=3, directions=10), small):
        got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.linked(df, cfg).collect()}
        assert got == links(rows)
    assert vector_dedup.linked(df.limit(0)).count() == 0


def test_links_of_many_lengths_and_odd_columns(spark):
    """Seventy lengths, each with a near pair; labels are text; ids repeat or are null; columns clash with those inside."""
    rng = np.random.default_rng(5)
    rows = []
    for d in range(1, 71):
        v = rng.normal(size=d) + 2
        rows += [(2 * d, [float(x) for x in v], "a"), (2 * d + 1, [float(x) for x in v * 3 + 1e-3], "a"), (1000 + d, [float(x) for x in v], "b")]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<double>, label string, n long, point string").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.linked(df).collect()}
    assert got == links(rows) and all(got[2 * d][0] == 1 for d in range(1, 71))
    twice = [(1, [1.0, 0.0], "a"), (1, [0.0, 1.0], "a"), (2, [1.0, 0.001], "a"), (3, [0.001, 1.0], "a"), (None, [1.0, 0.0], "a")]
    got = vector_dedup.linked(spark.createDataFrame(twice, "vec_id long, embedding array<double>, label string")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in got) == [(0, 0, None, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]


def test_intervals_far_apart_are_skipped(spark):
    """On clustered vectors few pairs of blocks are left of all."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(16, 8))
    rows = [(k, [float(x) for x in base[k % 16] + 0.01 * rng.normal(size=8)], 1) for k in range(1600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    cfg = vector_dedup.VectorConfig(block=20)
    scratch = vector_dedup.Scratch(spark)
    points = df.select(vector_dedup.F.lit("1").alias("lab"), vector_dedup.F.col("embedding").alias("v"), vector_dedup.F.lit(1).cast("long").alias("n"), vector_dedup.F.col("vec_id").alias("point"))
    sequence = vector_dedup.blocks(points, vector_dedup.directions(points, cfg), cfg, scratch)
    n = sequence.count()
    assert n >= 80 and vector_dedup.near_pairs(sequence, cfg, scratch).count() < n * (n + 1) / 2 / 5


def test_links_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = vector_dedup.op7_vector_dedup(spark, sf).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == links(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def best(rows, k):
    """Brute force: by query (ids divisible by 20, every row of one), the k best of other ids."""
    ints = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in ints:
        if q % 20 == 0:
            own = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in ints if c != q and len(w) == len(v))[:k]
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(own)]
    return sorted(out)


def test_topk(spark):
    rows = [(i, v) for i, v, _ in vectors(3)] + [(300, [1.0, 2.0]), (320, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    for cfg in (topk.TopkConfig(k=5, rows=50, queries=6, run=2, levels=(4, 2)), topk.TopkConfig(k=5, levels=(3,), fitted=0), topk.TopkConfig(k=300)):
        got = topk.search(df, df.where("vec_id % 20 = 0"), cfg)
        assert sorted(map(tuple, got.collect())) == best(rows, cfg.k)
    assert topk.search(df.limit(0), df.limit(0)).count() == 0
    assert topk.search(df, df.limit(0)).count() == 0


def test_topk_ties_null_ids_and_clashes(spark):
    """Many equal scores (the smaller ids win), null ids, a repeated id, extra columns named like those inside."""
    rng = np.random.default_rng(8)
    rows = [(k, [float(x) for x in rng.integers(0, 2, 3)]) for k in range(200)] + [(None, [1.0, 1.0, 1.0]), (7, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, score int, block string")
    cfg = topk.TopkConfig(k=9, rows=30, queries=4, run=2, levels=(2,))
    assert sorted(map(tuple, topk.search(df, df.where("vec_id % 20 = 0"), cfg).collect())) == best(rows, 9)


def test_topk_of_large_numbers(spark):
    import pytest
    from pyspark.errors import PySparkException

    rows = [(k, [1e6 + k, -2e6 - k, 5e5]) for k in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.search(df, df.where("vec_id % 20 = 0"), topk.TopkConfig(k=3)).collect())) == best(rows, 3)
    over = spark.createDataFrame([(0, [1e15, 1.0]), (1, [1e15, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(PySparkException):
        topk.search(over, over).collect()


def test_bounds_skip_most_pairs():
    """On clustered vectors blocks and pairs are skipped; on vectors without any structure the finest level still skips most."""
    rng = np.random.default_rng(9)
    ids, order = np.arange(4000), rng.permutation(4000)
    base = rng.normal(size=(20, 32)) * 40
    clustered = np.floor(np.repeat(base, 200, axis=0) + rng.normal(size=(4000, 32)) * 4).astype(np.int64)
    even = np.floor(rng.normal(size=(4000, 64)) * 8).astype(np.int64)
    for matrix, least in ((clustered, 0.85), (even, 0.3)):
        cfg = topk.TopkConfig()
        b = topk.Best(ids[::20], matrix[::20], np.eye(matrix.shape[1]), cfg)
        for s in range(0, 4000, 500):
            own = order[s : s + 500]
            b.add(ids[own], matrix[own])
        assert b.pairs == 200 * 4000 and b.exact <= (1 - least) * b.pairs, b.exact / b.pairs
        score = matrix[::20] @ matrix.T
        q, r, got = b.found
        for k in range(200):
            want = sorted((-s, c) for c, s in enumerate(score[k].tolist()) if c != k * 20)[:20]
            assert list(zip((-got[q == k]).tolist(), r[q == k].tolist())) == want


def test_blocks_are_skipped_by_their_statistics(spark):
    rng = np.random.default_rng(10)
    base = rng.normal(size=(10, 16)) * 4
    rows = [(k, [float(x) for x in base[k % 10] + 0.1 * rng.normal(size=16)]) for k in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    cfg = topk.TopkConfig(rows=50, queries=10)
    steps = topk.Steps(df, df.where("vec_id % 20 = 0"), cfg)
    pairs, left = steps.pairs.count(), steps.rest().count()
    assert pairs >= 40 * 10 and left < pairs / 3
    assert sorted(map(tuple, steps.result().collect())) == best(rows, 20)


def test_topk_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    assert sorted(map(tuple, topk.op4_topk(spark, sf).collect())) == sorted(con.execute(topk.SQL).fetchall())


def test_blocks_do_not_depend_on_batches(spark):
    """Rows are cut alike whatever size their batches have, and so are the vectors of the searches."""
    import pyarrow as pa

    from tesselar.llm.common import even_batches

    rows = pa.table({"v": [[float(k), 1.0] for k in range(100)], "k": list(range(100))})
    want = [(7 * j, 7) for j in range(14)] + [(98, 2)]
    for size in (1, 3, 7, 50, 100, 1000):
        got = list(even_batches(iter(rows.to_batches(max_chunksize=size)), 7))
        assert [(b.column(1)[0].as_py(), b.num_rows) for b in got] == want
        assert [x for b in got for x in b.column(0).flatten().to_pylist()] == [x for k in range(100) for x in (float(k), 1.0)]
    assert list(even_batches(iter([]), 7)) == []
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    df = spark.createDataFrame([r for r in vectors() if r[1] is not None], "vec_id long, embedding array<float>, label int").repartition(1)
    found = []
    try:
        for size in ("10000", "50"):
            spark.conf.set(name, size)
            cfg = vector_dedup.VectorConfig(block=64, fan=2)
            found.append({r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.linked(df, cfg).collect()})
    finally:
        spark.conf.set(name, before)
    assert found[0] == found[1]
