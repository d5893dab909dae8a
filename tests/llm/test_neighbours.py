import numpy as np
import pytest
from pyspark.sql import functions as F

from verilith.llm import ann

SCHEMA = "vec_id bigint, embedding array<float>, label int, row string, i string, v string"


def frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "a", "b", "c") for i, v in zip(ids, vectors)], SCHEMA)


def test_recall_against_brute_force(spark):
    x = np.random.default_rng(0).normal(size=(600, 33)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = ann.neighbours(frame(spark, x), k=5, rerank=12, queries=200, codes_=250).collect()
    score = x.astype(np.float64) @ x.T.astype(np.float64)
    np.fill_diagonal(score, -9)
    best = np.argsort(-score, axis=1)[:, :5]
    found = {(r.vec_id, r.neighbour) for r in got}
    assert len(got) == 3000
    assert np.mean([(i, j) in found for i in range(600) for j in best[i].tolist()]) >= 0.9
    assert all(abs(r.score - score[r.vec_id, r.neighbour]) < 1e-9 for r in got)
    assert {r.rank for r in got} == {1, 2, 3, 4, 5}


def clustered(rows, width=24, groups=12, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(groups, width))[rng.integers(0, groups, rows)] + 0.3 * rng.normal(size=(rows, width))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


@pytest.mark.parametrize("hot", [False, True])
def test_recall_with_cells_and_production_parameters(spark, hot):
    """Just some rows are queries; with ``hot`` a third of all rows are copies of one, so one cell is split."""
    x = clustered(3000)
    if hot:
        x[::3] = x[0]
    got = ann.neighbours(frame(spark, x), asked=F.col("vec_id") % 20 == 7, cell_rows=200, codes_=300, queries=20).collect()
    score = x.astype(np.float64) @ x.T.astype(np.float64)
    np.fill_diagonal(score, -9)
    asked = range(7, 3000, 20)
    assert {r.vec_id for r in got} == set(asked) and len(got) == 10 * len(asked)
    own = {}
    for r in got:
        assert abs(r.score - score[r.vec_id, r.neighbour]) < 1e-6 and r.neighbour != r.vec_id
        own.setdefault(r.vec_id, []).append(r.score)
    # copies have equal scores, so recall is that of scores
    assert np.mean([np.sum(np.array(own[i]) >= np.sort(score[i])[-10] - 1e-6) for i in asked]) / 10 >= 0.9


def test_clusters_need_few_cells(spark):
    x = clustered(4000)
    cells = ann.centroids(x, 40)
    plain = spark.createDataFrame([(k, [float(e) for e in v]) for k, v in enumerate(x)], "row bigint, v array<float>")
    assert ann.cells_to_look_into(plain, x[:50], np.arange(50), cells, 10, 0.98) <= 12


def test_table_scan_is_the_sum_of_lookups():
    rng = np.random.default_rng(4)
    for width in (8, 10):
        x, q = rng.normal(size=(300, width)).astype(np.float32), rng.normal(size=(7, width)).astype(np.float32)
        centres = ann.train(x)
        code = ann.codes(x, centres, 3.0)
        place, score = ann.scan(q, ann.packed(code).T.astype(np.intp), centres, 300)
        exact = q @ ann.decoded(code, centres).T
        for i in range(7):
            assert np.corrcoef(score[i], exact[i][place[i]])[0, 1] > 0.999
        few, _ = ann.scan(q, ann.packed(code).T.astype(np.intp), centres, 20)
        assert all(len(set(few[i]) & set(np.argsort(-exact[i])[:12])) >= 11 for i in range(7))


def test_parallel_error_is_penalised():
    x = np.random.default_rng(1).normal(size=(400, 16)).astype(np.float32)
    centres = np.stack([x[:16, m * 2 : m * 2 + 2] for m in range(8)])

    def parallel(eta):
        r = x - ann.decoded(ann.codes(x, centres, eta, 3), centres)
        return np.mean(((r * x).sum(axis=1) ** 2) / (x * x).sum(axis=1))

    assert parallel(8.0) < 0.8 * parallel(1.0)


def test_awkward_vectors(spark):
    inf = float("inf")
    vectors = [[1, 0, 0], [1, 0, 0], [0, 1, 0], None, [1, None, 0], [inf, 0, 0], [1, 0], [], [0, 0, 0], [0.5, 0.5, 0]]
    got = ann.neighbours(frame(spark, vectors, [0, 0, 2, 3, 4, 5, 6, 7, 8, None]), k=2).collect()
    assert sorted((r.vec_id, r.rank, r.neighbour, r.score) for r in got if r.vec_id == 0 and r.rank == 1) == [(0, 1, 0, 1.0)] * 2
    assert {r.vec_id for r in got} == {0, 2, 8} and len(got) == 8
    assert tuple(ann.left_out(frame(spark, vectors, [0, 0, 2, 3, 4, 5, 6, 7, 8, None])).first()) == (1, 2, 2, 1)
    assert ann.neighbours(frame(spark, vectors), asked=F.lit(False)).count() == 0
    assert ann.neighbours(frame(spark, vectors).limit(0)).count() == 0
    assert ann.neighbours(frame(spark, [[1, 2]])).count() == 0
