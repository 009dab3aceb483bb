import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pointloom.llm import suffix_dedup as S


def rows(spark, docs, **kw):
    df = spark.createDataFrame([(i, t) for i, t in docs], "doc_id long, text string")
    out = S.remove_repeats(df, **kw).collect()
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out)


def expected(docs, length):
    return sorted((k, *v) for k, v in S.brute_force([(i, (t or "").encode()) for i, t in docs], length).items())


@pytest.mark.parametrize("block", [1024, 2])
def test_equals_brute_force(spark, block):
    rng = np.random.default_rng(1)
    word = lambda n: "".join(rng.choice(list("abcdé \n"), n))
    shared = [word(60) for _ in range(4)]
    docs = []
    for i in range(60):
        parts = []
        for _ in range(rng.integers(1, 6)):
            k = rng.integers(0, 3)
            s = shared[rng.integers(0, 4)]
            parts.append(word(rng.integers(1, 50)) if k else s[rng.integers(0, 20) : 60 - rng.integers(0, 20)])
        docs.append((int(i * 7 % 61), "".join(parts)))
    docs += [(100, "ab" * 200), (101, "ab" * 150), (102, ""), (103, None), (104, "a" * 500), (105, docs[0][1]), (106, docs[3][1] * 2)]
    got = rows(spark, docs, length=32, gram=8, block_contexts=block)
    assert got == expected(docs, 32)


def test_production_parameters(spark):
    rng = np.random.default_rng(2)
    text = lambda n: "".join(rng.choice(list("abcdefgh é"), n))
    base = text(3000)
    docs = [(i, text(300) + base[i * 10 : i * 10 + 400] + text(200)) for i in range(30)]
    docs += [(40, base), (41, base[:99]), (42, base[:100]), (43, text(20_000) + base)]
    assert rows(spark, docs) == expected(docs, 100)


def test_edges(spark):
    same = "x" * 10 + "y" * 200
    df = spark.createDataFrame([(1, same, 5), (1, same, 5), (None, same, 1), (2, None, 1)], "doc_id long, text string, kept int")
    out = sorted((r.doc_id or -1, r.n_bytes, r.n_removed) for r in S.remove_repeats(df).collect())
    assert [x[:2] for x in out] == [(-1, 210), (1, 210), (1, 210), (2, 0)]
    assert out[0][2] == 0 and out[1][2] == out[2][2] < 210  # a repeated row is the same place
    assert S.remove_repeats(df.limit(0)).count() == 0


def test_long_text_in_chunks(monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 64)
    data = np.frombuffer(bytes(np.random.default_rng(0).integers(97, 101, 1000).astype(np.uint8)), np.uint8)
    a, c, e, first, n, place = S.anchors(data, 32, 8)
    assert n.sum() == 1000 - 32 + 1 and (np.diff(first) == n[:-1]).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=8, max_size=40), min_size=1, max_size=12))
def test_suffix_sort(parts):
    data = np.frombuffer(b"".join(p.replace(b"\xff", b"a") for p in parts), np.uint8)
    starts = np.arange(len(data) - 6)
    group = np.sort(starts % 3)
    order, same = S.suffix_sort(data, starts, group, 6)
    for g in range(3):
        at = np.flatnonzero(group == g)
        mine = [(data[starts[i] : starts[i] + 6].tobytes(), i) for i in at]
        assert [(data[starts[i] : starts[i] + 6].tobytes(), i) for i in order[at]] == sorted(mine)
        keys = [x[0] for x in sorted(mine)]
        assert list(same[at]) == [i > 0 and keys[i] == keys[i - 1] for i in range(len(keys))]


def test_one_id_with_several_texts(spark):
    rng = np.random.default_rng(9)
    text = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    shared = text(150)
    docs = [(1, text(80) + shared), (1, shared + text(40)), (1, "short"), (-5, text(30) + shared + text(30)), (7, shared * 2), (1, "short"), (None, shared)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, place int, h int")
    out = S.remove_repeats(df).collect()
    hashes = {r.text: r.h64 for r in df.selectExpr("text", "xxhash64(cast(text as binary)) as h64").collect()}
    order = sorted({d for d in docs if d[0] is not None}, key=lambda d: (d[0], hashes[d[1]]))
    want = S.brute_force([(k, t.encode()) for k, (_, t) in enumerate(order)])
    removed = sorted((i, want[order.index((i, t))][1] if i is not None else 0, len(t)) for i, t in docs if i is not None) + [(None, 0, 150)]
    got = [(r.doc_id, r.n_removed, r.n_bytes) for r in out]
    assert sorted(x for x in got if x[0] is not None) + [x for x in got if x[0] is None] == removed
    assert sum(x[1] for x in removed if x[0] == 1) == 300 and S.without_repeats(df).columns == df.columns


def test_reaches_bound_what_contexts_share():
    rng = np.random.default_rng(11)
    letters = lambda n: rng.choice(list(b"abcd"), n).astype(np.uint8).tobytes()
    block, place, texts = [], [], []
    gram = b"GRAMGRAM"
    for _ in range(300):
        left, right = letters(30), letters(30)
        for _ in range(3):
            a, b = left[int(rng.integers(0, 31)) :], right[: int(rng.integers(0, 31))]
            t = letters(int(rng.integers(0, 24))) + a
            block.append(len(block) // 3)
            place.append(len(t))
            texts.append(t + gram + b + letters(int(rng.integers(0, 24))))
    low, high = S.reaches(np.array(block), np.array(place), texts, 32, 8, step=5)
    shared = 0
    for i in range(len(texts)):
        for j in range(i - i % 3, i):
            for x in range(25):  # x bytes to the left of the anchor and 24 - x to the right
                own, its = (texts[k][max(0, place[k] - x) : place[k] + 8 + 24 - x] for k in (i, j))
                if len(own) == len(its) == 32 and own == its:
                    shared += 1
                    assert all(x <= low[k] and 24 - x <= high[k] for k in (i, j))
    assert shared > 50 and (low < 24).mean() > 0.3 and (high < 24).mean() > 0.3


def judged(docs, block_contexts, rows=300):
    """Spans and open classes of documents, by the steps in one process."""
    batches = lambda table, n=rows: table.to_batches(max_chunksize=n)
    data = pa.table({"doc_id": pa.array([i for i, _ in docs], pa.int64()), "data": pa.array([t for _, t in docs], pa.binary())})
    found = pa.Table.from_batches(S._find(100, 24)(batches(data))).sort_by([(c, "ascending") for c in ("a", "c", "kind_e", "doc_id", "where")])
    grouped = pa.Table.from_batches(S._group(100, block_contexts)(batches(found))).to_pylist()
    asked = {}
    for r in grouped:
        if r["lo"] < 0:
            asked.setdefault(r["doc_id"], []).append({k: r[k] for k in ("block", "start", "n", "place", "hot")})
    squeezed = pa.Table.from_batches(S._squeeze(batches(data))).to_pylist()
    kind = pa.list_(pa.struct([("block", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("place", pa.int32()), ("hot", pa.bool_())]))
    wanted = [(r["doc_id"], r["data"], asked[r["doc_id"]]) for r in squeezed if r["doc_id"] in asked]
    ids, texts, lists = zip(*wanted)
    joined = pa.table({"doc_id": pa.array(ids, pa.int64()), "data": pa.array(texts, pa.binary()), "rows": pa.array(lists, kind)})
    contexts = pa.Table.from_batches(S._contexts(100, 24)(batches(joined))).sort_by("block")
    out = pa.Table.from_batches(S._compare(100, 24, block_contexts)(batches(contexts))).to_pylist()
    first, spans = {}, [(r["doc_id"], r["lo"], r["hi"]) for r in out if r["hi"] >= 0] + [(r["doc_id"], r["lo"], r["hi"]) for r in grouped if r["lo"] >= 0]
    open_ = [((r["k1"], r["k2"]), (r["doc_id"], r["lo"])) for r in out if r["hi"] < 0]
    for k, at in open_:
        first[k] = min(at, first.get(k, at))
    return spans + [(*at, at[1] + 100) for k, at in open_ if at > first[k]], len(open_)


def test_a_frequent_line_is_not_sorted_with_all_its_surroundings():
    rng = np.random.default_rng(12)
    letters = lambda n: rng.choice(list(b"abcdefgh "), n).astype(np.uint8).tobytes()
    line = letters(76)
    docs = [(i, letters(120) + line + letters(120)) for i in range(400)]
    spans, open_ = judged(docs, 32)
    assert spans == [] and open_ == 0  # no two documents share 100 bytes
    docs += [(500 + i, docs[i][1][60:] + letters(50)) for i in range(40)]
    spans, _ = judged(docs, 32)
    assert {d for d, _, _ in spans} == set(range(500, 540))


@pytest.mark.parametrize("block, rows", [(64, 300), (1024, 700), (2, 5000)])
def test_a_frequent_passage_is_cut_into_blocks_and_loses_nothing(block, rows):
    rng = np.random.default_rng(13)
    letters = lambda n: rng.choice(list(b"abcdefgh "), n).astype(np.uint8).tobytes()
    line = letters(130)
    docs = [(i, letters(int(rng.integers(0, 60))) + line + letters(int(rng.integers(0, 60)))) for i in range(2600)]
    spans, open_ = judged(docs, block, rows)
    assert open_ > 0
    gone = {}
    for d, lo, hi in spans:
        gone.setdefault(d, set()).update(range(lo, hi))
    want = S.brute_force(docs)
    assert {d: len(x) for d, x in gone.items()} == {d: v[1] for d, v in want.items() if v[1]}
