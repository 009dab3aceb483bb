import math

import pytest
from pointloom.llm import mixing as M


def level(sizes, weights=(5, 2, 1), cap=3):
    """Reference: reshare the excess by weight until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        if not free:
            return fixed
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return fixed | share
        for s in over:
            fixed[s] = cap * sizes[s]
            left -= fixed[s]


def test_targets_and_words(spark):
    docs = []
    for s, n, words in (("a", 3, 7), ("b", 40, 100), ("c", 200, 11), ("Z", 1, 1), (None, 30, 9), ("é", 5, 0), ("hot", 600, 5)):
        docs += [(len(docs) + i, "wörd " * (words + i % 3 if words else 0), s, 1) for i in range(n)]
    docs += [(9000, None, "a", 1), (None, "one two", "b", 1), (9001, "same text", "c", 1), (9001, "same text", "c", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, size int")
    rows = M.mix(df).collect()
    assert len(rows) == len(docs)
    source = {d[0]: d[2] for d in docs}
    size, taken, target = {}, {}, {}
    for r in rows:
        s = source[r.doc_id]
        size[s] = size.get(s, 0) + r.size
        taken[s] = taken.get(s, 0) + r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 3 * r.size
    for s, t in level(size).items():
        assert target[s] == pytest.approx(t) and abs(taken[s] - t) <= 1
    assert sum(taken.values()) == pytest.approx(sum(size.values()), abs=len(size))
    again = M.mix(df.repartition(7)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.taken)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str) and key
    assert M.mix(df.limit(0)).count() == 0


def test_plan_is_native(spark):
    df = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")
    plan = M.mix(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
    assert math.isclose(M.mix(df).first().taken, 2)


def test_drawn_keeps_columns_of_any_name(spark):
    names = ["id", "of", "tie", "taken", "size", "own", "n", "_n", "_id", "_SIZE"]
    docs = [(i, "w " * (5 + i), f"s{i % 2}", 9, *[i * 10 + k for k in range(len(names))]) for i in range(12)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, n_chars long, " + ", ".join(f"{c} int" for c in names))
    out = M.drawn(df)
    assert out.columns == df.columns and out.count() > 0
    assert all([r[c] for c in names] == [r.doc_id * 10 + k for k in range(len(names))] for r in out.collect())


def test_quality_weight(spark):
    texts = ["plain words of a text " * 9, "#$% && word|" * 9, "SHOUTING! ALL! DAY! " * 9, "12345 67890 " * 9, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    q = [r.q for r in df.orderBy("i").select(M.quality(df.text).alias("q")).collect()]
    assert q[0] == q[4] == 1 and q[1] == q[2] == M.LEAST_QUALITY and M.LEAST_QUALITY <= q[3] < 0.5
