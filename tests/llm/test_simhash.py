import numpy as np
import xxhash
from pointloom.llm import simhash as H
from pointloom.llm.components import connected_components


def slow_fingerprint(text, k=4):
    words = [w.lower() for w in (text or "").encode().split()]
    grams = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))


def roots(fps, radius):
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= radius
    comp = np.arange(len(fps))
    while True:
        new = np.array([comp[row].min() for row in near])
        if (new == comp).all():
            return comp
        comp = new


def test_fingerprint():
    for t in (None, "", " \n", "one", "a b c", "a b c d", "A b C d É f\x85g h  i\tj", "the " * 500 + "end"):
        assert H.fingerprint(t) == slow_fingerprint(t), t
    assert H.fingerprint("AB cd") == H.fingerprint("ab\x0bcd") != H.fingerprint("ab\x1ccd")


def test_forest_and_masks():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 40).astype(np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for _ in range(600)], np.uint64)
    fps = np.unique(base[rng.integers(0, 40, 600)] ^ flips)
    want = roots(fps, 4)
    links = H.forest(fps, 4, tile=64)
    assert len(links) == len(fps) - len(set(want))
    masks = [m & (2**64 - 1) for m in H.block_masks()]
    assert len(masks) == 15
    for i, j in zip(*np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None]) <= 4)):
        assert any(int(fps[i]) & m == int(fps[j]) & m for m in masks)


def test_components_over_tiles(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 12).astype(np.uint64)
    fps = {int(base[i % 12]) for i in range(12)}
    for i in range(900):  # one bucket holds far more than a tile
        x = int(base[0 if i % 3 else i % 12])
        for b in rng.choice(64, rng.integers(1, 5), replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    links = H.near_links(df, tile_rows=50)
    comp = {r.node: r.root for r in connected_components(links).collect()}
    want = roots(fps, 4)
    signed = fps.view(np.int64)
    group = {}
    for k, w in zip(signed.tolist(), want.tolist()):
        group.setdefault(w, set()).add(comp.get(k, k))
    assert all(len(v) == 1 for v in group.values()) and len({min(v) for v in group.values()}) == len(group)


def test_near_duplicates_and_edges(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(300)]
    docs = []
    for g in range(8):
        base = list(rng.choice(words, 200))
        for k in range(5):
            t = base.copy()
            if k:
                t[int(rng.integers(200))] = "changed"
            docs.append((g * 5 + k, " ".join(t), "s", "en", 1))
    docs += [(90, None, "s", "en", 1), (91, "", None, None, 1), (92, " \n", "s", "en", 1), (None, "null id text here now", "s", "en", 1), (7, docs[7][1], "s", "en", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, fp int")
    rows = H.near_duplicates(df).collect()
    assert len(rows) == len(docs)
    fps = np.array([slow_fingerprint(d[1]) for d in docs], np.uint64)
    comp = roots(fps, 4)
    low = {}
    for d, c in zip(docs, comp):
        if d[0] is not None:
            low[c] = min(low.get(c, d[0]), d[0])
    want = sorted((str(d[0]), f"{f:016x}", str(low.get(c))) for d, f, c in zip(docs, fps.tolist(), comp))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in rows) == want
    kept = H.keep_one(df).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted({str(v) for v in low.values()} | {"None"})
    assert H.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    n = 200
    df = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (None, 3), (5, 5)], "a long, b long")
    comp = {r.node: r.root for r in connected_components(df).collect()}
    assert comp == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 1001: 1000}


def test_kept_rows_keep_columns_of_any_name(spark):
    rows = [(1, "a b c d e f", "s", "en", 7, 8, 9), (2, "a b c d e f", "s", "en", 1, 2, 3), (3, "quite another text here now", "s", "en", 4, 5, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, _rank int, rank int, first int")
    assert sorted(tuple(r) for r in H.keep_one(df).collect()) == [rows[0], rows[2]] and H.keep_one(df).columns == df.columns
