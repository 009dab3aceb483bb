import numpy as np
from pointloom.llm import knn_quality as K


def text(rng, good, n=80):
    words = ["".join(rng.choice(list("abcdefg"), 4)) for _ in range(n)]
    return " ".join(words if good else [w + "%%%" for w in words])


def test_vote_equals_brute_force():
    rng = np.random.default_rng(0)
    x = np.stack([K.features(text(rng, i % 4 > 0)) for i in range(80)])
    space = K.fit(x, np.array([float(i % 4 > 0) for i in range(80)]), 0.8)
    assert np.allclose(np.linalg.norm(space.vectors, axis=1), 1, atol=1e-4)
    q = np.stack([K.features(text(rng, i % 2)) for i in range(20)])
    got = space.score(q)
    for k, z in enumerate(space.place(q)):
        sim = np.array([float(z @ v) for v in space.vectors])
        near = np.argsort(-sim, kind="stable")[: K.NEIGHBOURS]
        w = np.maximum(sim[near], 1e-3) ** K.SHARPNESS * space.vote[near]
        assert np.isclose(got[k], (w * space.quality[near]).sum() / w.sum(), atol=1e-3)
        assert (got[k] >= 0.7) == (k % 2 == 1)


def test_held_out(spark):
    rng = np.random.default_rng(1)
    docs = [(i, text(rng, i % 3 > 0, 20 + i), 0.5) for i in range(150)] + [(900, None, 0.1), (901, "", 0.1), (None, "x" * 300_000, 0.1), (1, "again", 0.2)]
    df = spark.createDataFrame(docs, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(150)] + [(1, 1, 1), (None, 0, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    rows = K.score(df, K.train(df, labels)).collect()
    by = {r.doc_id: r.score for r in rows}
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([(by[i] >= 0.7) == (i % 3 > 0) for i in range(2, 150)]) > 0.95
    assert {r.score for r in K.score(df, K.train(df, labels.limit(0))).collect()} == {0.5}
    assert K.score(df.limit(0), None).count() == 0


def test_equal_neighbours_go_by_sample_order():
    sim = np.array([[0.5, 0.9, 0.5, 0.5, 0.1, 0.5], [0.1, 0.2, 0.3, 0.4, 0.5, 0.6]])
    assert sorted(K.nearest(sim, 3)[0].tolist()) == [0, 1, 2] and sorted(K.nearest(sim, 3)[1].tolist()) == [3, 4, 5]
    rng = np.random.default_rng(2)
    for _ in range(50):
        sim = rng.integers(0, 4, (5, 40)).astype(np.float32)
        got = K.nearest(sim, 7)
        assert [sorted(x) for x in got.tolist()] == [sorted(np.argsort(-row, kind="stable")[:7].tolist()) for row in sim]


def test_clashing_columns(spark):
    rng = np.random.default_rng(3)
    docs = [(i, text(rng, i % 2), "x", 1, 2) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string, id string, quality long, x int")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, id int")
    assert K.score(df, K.train(df, labels)).count() == 40
