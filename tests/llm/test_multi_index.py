"""Embedding near-duplicates against brute force."""
import math

import numpy as np
import pytest

from recsmith.llm import multi_index as M

SCHEMA = "vec_id bigint, embedding array<float>, label int, uid string, home string, w int, h1 int"


def brute(rows, similarity=M.SIMILARITY):
    """(vec_id, n_links, component_id, kept) of every row, in order."""
    sizes = [len(v) for _, v in rows if v]
    dim = min(sorted(set(sizes)), key=lambda d: (-sizes.count(d), d)) if sizes else 0
    fine = [i for i, (_, v) in enumerate(rows) if v and len(v) == dim and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    m = np.array([np.float32(rows[i][1]) for i in fine], float).reshape(len(fine), dim)
    m = m / np.linalg.norm(m, axis=1, keepdims=True) if len(m) else m
    link = m @ m.T >= similarity
    comp = np.arange(len(fine))
    while len(fine) and ((new := np.where(link, comp[None, :], len(fine)).min(1)) != comp).any():
        comp = new
    out = []
    for i, (k, _) in enumerate(rows):
        if i not in fine:
            out.append((k, 0, k, True))
            continue
        p = fine.index(i)
        ids = [rows[fine[q]][0] for q in np.flatnonzero(comp == comp[p])]
        ids = [x for x in ids if x is not None]
        c = min(ids) if ids else None
        out.append((k, int(link[p].sum()) - 1, c, k == c))
    return out


def run(spark, rows, **settings):
    df = spark.createDataFrame([(k, v, 1, "a", "b", 2, 3) for k, v in rows], SCHEMA).repartition(3)
    out = M.near_duplicates(df, **settings)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted(map(tuple, out.collect()), key=str)


def vectors(n, dim=24, seed=0):
    """Groups around centres, some just above and some just under the similarity."""
    rng = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        c = rng.standard_normal(dim)
        c /= np.linalg.norm(c)
        for _ in range(int(rng.integers(1, 12))):
            z = rng.standard_normal(dim)
            z -= (z @ c) * c
            cos = rng.choice([0.999, 0.97, 0.95])
            out.append(list(map(float, cos * c + (1 - cos ** 2) ** 0.5 * z / np.linalg.norm(z))))
    return [(i, v) for i, v in enumerate(out[:n])]


def test_recall_and_precision(spark):
    rows = vectors(1500)
    m = np.array([np.float32(v) for _, v in rows], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    true = (m @ m.T >= M.SIMILARITY).sum(1) - 1
    # many codes, so that pairs do fall into different cells
    grid = M.fit(spark.createDataFrame([(k, v) for k, v in rows], "vec_id bigint, vector array<double>"), 24)
    fine = M.Grid(M.kmeans(m[:, :12], 8), M.kmeans(m[:, 12:], 8), 0.15)
    for g in (grid, fine):
        found = {k: n for k, n, *_ in run(spark, rows, grid=g)}
        got = np.array([found[i] for i in range(len(rows))])
        assert (got <= true).all()
        assert got.sum() >= 0.95 * true.sum() > 0


def test_whole_reach_is_brute_force(spark):
    """With a reach over all cells every link is found, once, in blocks of any size."""
    rows = vectors(300, seed=3) + [(300 + i, [1.0] + [0.0] * 23) for i in range(40)]
    m = np.array([v for _, v in rows], float)
    grid = M.Grid(M.kmeans(m[:, :12], 3), M.kmeans(m[:, 12:], 3), 100.0)
    want = sorted(brute(rows), key=str)
    assert run(spark, rows, grid=grid) == want
    assert run(spark, rows, grid=grid, block=16) == want


def test_pairs_at_the_threshold(spark):
    """Pairs within the error of the codes are decided by the vectors."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(60):
        c = rng.standard_normal(16)
        c /= np.linalg.norm(c)
        z = rng.standard_normal(16)
        z -= (z @ c) * c
        cos = 0.9 + (i - 30) * 1e-5
        rows += [(2 * i, list(map(float, c))), (2 * i + 1, list(map(float, cos * c + (1 - cos ** 2) ** 0.5 * z / np.linalg.norm(z))))]
    assert run(spark, rows) == sorted(brute(rows), key=str)


def test_odd_rows(spark):
    a, b = [1.0, 0.0, 0.0], [0.99, 0.01, 0.0]
    rows = [(1, a), (1, a), (2, b), (None, a), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [float("nan"), 1.0, 0.0]), (7, [1.0, None, 0.0]),
            (8, [1.0, 0.0]), (9, [float("inf"), 0.0, 0.0]), (None, None), (10, [0.0, 1.0, 0.0]), (-3, [0.0, 2.0, 0.0]), (11, [1e30, 0.0, 0.0])]
    assert run(spark, rows) == sorted(brute(rows), key=str)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.0, 0.0])], [(1, [1.0])], [(1, [1.0]), (2, [-1.0]), (3, [5.0])], [(None, [1.0, 1.0])]])
def test_small_tables(spark, rows):
    assert run(spark, rows) == sorted(brute(rows), key=str)


def test_walk_is_the_start_of_the_multi_sequence():
    rng = np.random.default_rng(1)
    g = M.Grid(rng.standard_normal((5, 4)), rng.standard_normal((6, 4)), 1.5)
    x = M.units(rng.standard_normal((40, 8)))
    e1, e2 = g.excess(x)
    who, cell = g.visits(e1, e2)
    for i in range(40):
        sums = (e1[i][:, None] + e2[i][None, :]).ravel()
        assert list(cell[who == i]) == list(np.flatnonzero(sums <= g.reach))
        assert g.homes(e1, e2)[i] in cell[who == i]


def test_one_very_large_group(spark):
    """Copies are folded, near copies counted inside blocks; nothing but a forest of links leaves."""
    rng = np.random.default_rng(2)
    c = rng.standard_normal(16)
    near = [(i, list(map(float, c + 0.01 * rng.standard_normal(16)))) for i in range(400)]
    rows = near + [(1000 + i, list(map(float, c))) for i in range(400)]
    df = spark.createDataFrame([(k, v, 1, "a", "b", 2, 3) for k, v in rows], SCHEMA)
    grid = M.fit(df.selectExpr("vec_id", "cast(embedding as array<double>) AS vector"), 16)
    placed = M.place(df.selectExpr("vec_id", "cast(embedding as array<double>) AS vector"), grid)
    one = placed.dropDuplicates(["h1", "h2"]).selectExpr("vec_id AS uid", "home", "visits", "code", "scale", "off", "cast(1 as bigint) AS w")
    assert one.count() == 401
    sent = M.compare(one, M.SIMILARITY, block=64).count()
    assert sent <= 401 * 2 * (math.ceil(401 / 64) ** 2)
    want = sorted(brute(rows), key=str)
    found = run(spark, rows)
    assert [(k, c, kept) for k, _, c, kept in found] == [(k, c, kept) for k, _, c, kept in want]
    assert sum(not 0.9 * n <= m <= n for (_, m, *_), (_, n, *_) in zip(found, want, strict=True)) <= 8
    assert sum(r[1] for r in found) >= 0.995 * sum(r[1] for r in want)
    assert run(spark, rows, grid=M.replace(grid, reach=100.0), block=128) == want
