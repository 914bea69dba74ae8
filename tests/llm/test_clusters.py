import hashlib
import math

import numpy as np
import pytest

from tesselar.llm import clusters as K

SCHEMA = "vec_id long, embedding array<double>, label int, cluster int"


def brute(rows, cfg):
    kept = [(i, [math.floor(cfg.scale * x) for x in v]) for i, v in rows if v is not None and len(v) == cfg.dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{cfg.salt}{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[: cfg.clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))
    for _ in range(cfg.rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for k, g in groups.items():
            centroids[k] = [sum(x) // len(g) for x in zip(*g, strict=True)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=repr), centroids


def vectors(seed, dims, n=120):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(5, dims))
    out = [(int(k), (middles[k % 5] + 0.3 * rng.normal(size=dims)).tolist()) for k in range(n)]
    out += [(900 + k, out[0][1]) for k in range(30)]  # copies
    out += [(5, out[7][1]), (5, out[8][1]), (None, out[9][1]), (None, out[3][1])]  # repeated and null ids
    out += [(800, None), (801, []), (802, out[1][1][:-1]), (803, [*out[1][1][:-1], None]), (804, [*out[1][1][:-1], math.nan]), (805, [math.inf, *out[1][1][1:]])]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, None, 0) for i, v in rows], SCHEMA)


@pytest.mark.parametrize("width", [1, 1 << 14])
def test_against_plain_form(spark, width):
    cfg = K.ClusterConfig(clusters=4, dims=6, rounds=5, width=width, block=16)
    rows = vectors(3, 6)
    got, centroids = K.cluster(frame(spark, rows).repartition(5), cfg)
    want = brute(rows, cfg)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want[0]
    assert centroids.tolist() == want[1]


def test_partitions_do_not_change_results(spark):
    cfg = K.ClusterConfig(clusters=3, dims=4, rounds=4)
    rows = vectors(4, 4)
    out = [sorted((tuple(r) for r in K.cluster(frame(spark, rows).repartition(n), cfg)[0].collect()), key=repr) for n in (1, 7)]
    assert out[0] == out[1]


def test_tables_equal_squares():
    rng = np.random.default_rng(1)
    block, centroids = rng.integers(-900, 900, (50, 7)).astype(np.int32), rng.integers(-900, 900, (3, 7))
    want = ((block[:, None, :].astype(np.int64) - centroids[None]) ** 2).sum(axis=2)
    for width in (1, 100, 5000):
        assert (K.distances(block, centroids, width) == want).all()


def test_few_vectors_and_none(spark):
    cfg = K.ClusterConfig(dims=2, rounds=3)
    got, centroids = K.cluster(frame(spark, [(1, [0.5, 0.5]), (2, [-0.25, 1.0])]), cfg)
    assert len(centroids) == 2 and sorted(r.distance for r in got.collect()) == [0, 0]
    assert K.cluster(frame(spark, [(1, None)]), cfg)[0].count() == 0
    assert K.cluster(frame(spark, []), cfg)[0].count() == 0


def test_query_on_tables_with_few_or_no_rows(spark, tmp_path):
    for n in (0, 3):
        rows = [(k, [float(k)] * 64) for k in range(n)]
        frame(spark, rows).write.parquet(f"{tmp_path}/{n}/embeddings.parquet")
        got = K.op13_clusters(spark, f"{tmp_path}/{n}").collect()
        assert len(got) == n and all(r.distance == r.inertia == r.cluster_inertia == 0 for r in got)


def test_floor_of_negative_means(spark):
    cfg = K.ClusterConfig(clusters=1, dims=1, scale=1, rounds=1)
    assert K.cluster(frame(spark, [(1, [-1.0]), (2, [-2.0]), (3, [-2.0])]), cfg)[1].tolist() == [[-2]]


def test_components_too_large_for_exact_distances(spark):
    with pytest.raises(Exception, match="too large"):
        K.cluster(frame(spark, [(1, [1e30, 0.0])]), K.ClusterConfig(dims=2))
