import numpy as np
import pytest
from pointloom.llm import multi_index as M


def brute(vectors, every=20, top=20):
    ids = np.array([i for i, v in vectors])
    x = np.array([v for i, v in vectors], float)
    out = {}
    for i, v in vectors:
        if i % every == 0:
            s = np.array([float(np.dot(v, w)) for w in x])
            out[i] = [(int(ids[k]), s[k]) for k in sorted((k for k in range(len(ids)) if ids[k] != i), key=lambda k: (-round(s[k], 9), ids[k]))[:top]]
    return out


def frame(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1) for i, v in vectors], "vec_id long, embedding array<float>, rank int")


def test_visits_cells_by_summed_distance():
    rng = np.random.default_rng(0)
    index = M.Index(rng.normal(size=(6, 3)), rng.normal(size=(5, 2)), rng.integers(0, 4, 30))
    q = rng.normal(size=5)
    cost = -(index.first @ q[:3])[:, None] - (index.second @ q[3:])[None]
    want = [c for c in np.argsort(cost.ravel(), kind="stable").tolist() if index.filled[c]]
    assert index.visit(q, 10**9) == want
    few = index.visit(q, 7)
    assert few == want[: len(few)] and index.filled[few].sum() >= 7 > index.filled[few[:-1]].sum()


def test_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 64)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16)) * 2
    vectors = [(i, (centres[rng.integers(12)] + rng.normal(size=16)).astype(np.float32)) for i in range(4_000)]
    check_recall(vectors, M.search(frame(spark, vectors)).collect())


def check_recall(vectors, rows, least=0.9):
    want = brute(vectors)
    by = dict(vectors)
    got = {}
    for r in rows:
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
        assert r.score == pytest.approx(float(np.dot(by[r.query_id].astype(float), by[r.vec_id].astype(float))), abs=1e-9)
    assert set(got) == set(want) and all(sorted(v) == list(range(1, 21)) for v in got.values())
    hits = [len({i for i, _ in got[q].values()} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= least


def test_recall_of_a_small_share_where_vectors_have_structure(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 24)) * 3
    vectors = [(i, (centres[rng.integers(40)] + rng.normal(size=24)).astype(np.float32)) for i in range(6_000)]
    check_recall(vectors, M.search(frame(spark, vectors), share=0.08).collect())


@pytest.mark.parametrize("n", [120, 500])
def test_small_tables_take_the_same_way(spark, n):
    rng = np.random.default_rng(n)
    vectors = [(i, rng.normal(size=64).astype(np.float32)) for i in range(n)]
    seen = []
    check_recall(vectors, M.search(frame(spark, vectors)).collect(), 0.85)
    usable = M.entries(frame(spark, vectors))
    index, _ = M.build(usable)
    for _, v in vectors[::20]:
        seen.append(index.filled[index.visit(v.astype(float), int(M.SHARE * n))].sum())
    assert max(seen) < 0.8 * n  # the index passes over cells of small tables too


def test_repeated_rows_and_other_lengths(spark):
    v, w = [1.0, 2.0, 0.5], [0.5, 1.0, 1.0]
    rows = [(20, v)] * 25 + [(21, v), (22, w), (22, w)] + [(k, [3.0, 3.0]) for k in (23, 40)] + [(24, []), (60, [9.0] * 7)]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in M.search(frame(spark, rows)).collect())
    # of 27 vectors of three components, 2 of two and one of seven, those of three take part
    assert got == [(20, 1, 21, 5.25), (20, 2, 22, 3.0)]


def test_a_share_of_one_is_exact_with_ties(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, rng.integers(-2, 3, 6).astype(float)) for i in range(1, 400)]
    vectors += [(1000 + i, np.array([1.0, 2, 0, 1, 0, 1])) for i in range(90)]  # one vector that many share
    vectors = [(i, v) for i, v in vectors if v.any()]
    odd = [(2000, None), (2020, [0.0] * 6), (2040, [1.0, None, 0, 0, 0, 0]), (2060, [float("nan")] + [1.0] * 5), (2080, [float("inf")] + [1.0] * 5), (None, [1.0] * 6)]
    rows = M.search(frame(spark, vectors + odd), share=1.0).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute(vectors)


def test_units():
    u = M.Units.of(np.array([3, 0, 4, 9, 1, 1, 30]), 8)
    assert u.low.tolist() == [0, 3, 4, 6] and u.high.tolist() == [3, 4, 6, 7] and u.parts.tolist() == [1, 2, 1, 4]
    assert u.of_cell.tolist() == [0, 0, 0, 1, 2, 2, 3]


def test_few_and_none(spark):
    df = frame(spark, [(20, [1.0, 2.0]), (3, [1.0, 1.0]), (4, [0.0, 1.0])])
    assert [tuple(r) for r in sorted(M.search(df).collect())] == [(20, 1, 3, 3.0), (20, 2, 4, 2.0)]
    assert M.search(df.limit(0)).count() == 0 and M.search(df.where("vec_id = 20")).count() == 0
