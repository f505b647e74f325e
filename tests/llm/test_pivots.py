import numpy as np
import pytest

from logloom.llm import pivots

SCHEMA = "vec_id long, embedding array<float>, label int, class string, ok long"


def brute(rows, threshold=0.98):
    n = len(rows)
    ok = [r[2] is not None and r[1] is not None and len(r[1]) > 0 and all(v is not None and np.isfinite(v) for v in r[1])
          and any(r[1]) for r in rows]
    links = {i: set() for i in range(n)}
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.asarray(rows[k][1], np.float32).astype(float) for k in (i, j))
                if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= threshold:
                    links[i].add(j)
                    links[j].add(i)
    out, seen = [None] * n, set()
    for i in range(n):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - group
            group |= new
            todo += new
        seen |= group
        ids = [rows[k][0] for k in group if rows[k][0] is not None]
        for k in group:
            out[k] = (rows[k][0], len(links[k]), min(ids) if ids else None)
    return out


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return [(r.vec_id, r.n_links, r.component_id, r.kept) for r in pivots.near_dedup(df).collect()]


def clusters(seed, n=300, dim=32):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, dim))
    rows = []
    for i in range(n):
        c = centres[rng.integers(40)] if rng.random() < 0.6 else rng.normal(size=dim)
        v = (c + rng.normal(size=dim) * rng.choice([0, 0.02, 0.1, 0.14]) * np.linalg.norm(c) / np.sqrt(dim)).astype(np.float32)
        rows.append((i, v.tolist(), int(rng.integers(3))))
    return rows


def order(x):
    return sorted(x, key=str)


@pytest.mark.parametrize("seed, block", [(0, 256), (1, 7)])
def test_links_recall_and_components(spark, monkeypatch, seed, block):
    monkeypatch.setattr(pivots, "BLOCK", block)
    rows = clusters(seed)
    got, want = order(run(spark, rows)), order(brute(rows))
    found, there = sum(g[1] for g in got), sum(w[1] for w in want)
    assert there > 200 and there * 0.9 <= found <= there
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    if found == there:
        assert [g[:3] for g in got] == want
    assert all(g[3] == (g[0] == g[2]) for g in got)


def test_recall_on_the_small_table(spark, small):
    e = small("embeddings")
    rows = list(zip(e.vec_id.tolist(), [v.tolist() for v in e.embedding], e.label.tolist()))
    from conftest import SMALL

    got = order((r.vec_id, r.n_links, r.component_id)
                for r in pivots.near_dedup(spark.read.parquet(f"{SMALL}/embeddings.parquet")).collect())
    want = order(brute(rows))
    assert sum(g[1] for g in got) >= 0.9 * sum(w[1] for w in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want))


def dense(seed, shape, n=500, dim=64):
    """Vectors with a common mean, or a few tight groups that hold most rows."""
    rng = np.random.default_rng(seed)
    if shape == "mean":
        x = rng.normal(size=dim) * 6 + rng.normal(size=(n, dim))
    else:
        x = rng.normal(size=(3, dim))[rng.integers(3, size=n)] + rng.normal(size=(n, dim)) * 0.13
        x[: n // 5] = rng.normal(size=(n // 5, dim))
    return [(i, v.tolist(), int(i % 3)) for i, v in enumerate(x.astype(np.float32))]


@pytest.mark.parametrize("shape, block", [("mean", 256), ("mean", 5), ("groups", 256), ("groups", 31)])
def test_no_link_is_lost_in_dense_tables(spark, monkeypatch, shape, block):
    monkeypatch.setattr(pivots, "BLOCK", block)
    rows = dense(3, shape)
    want = brute(rows)
    assert sum(w[1] for w in want) > 1000
    assert [g[:3] for g in order(run(spark, rows))] == order(want)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None),
            (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1), (8, [1.0, None], 1), (9, [nan, 1.0], 1), (10, [inf, 1.0], 1),
            (11, [1.0, 0.0, 0.0], 1), (None, [5.0, 0.0], 1), (13, [3e38, 3e38], 1), (14, [1e-38, 1e-38], 1),
            (2, [2.0, 0.0], 1), (None, [0.0, 0.0, 7.0], 1)]
    got, want = run(spark, rows), brute(rows)
    assert order(g[:3] for g in got) == order(want)
    assert {g[0]: g[3] for g in got if g[0] in (0, 1, 7)} == {0: True, 1: False, 7: True}
    empty = spark.createDataFrame([], SCHEMA)
    assert pivots.near_dedup(empty).count() == 0
