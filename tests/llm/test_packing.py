import zlib

import numpy as np
import pytest
from pointloom.llm import packing as P


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.public_tokenizer()[0])


TEXTS = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a   b", "a \n b", "a\n\n b", "x \n \n y", "tab\t b", "don't we'll", "12 345!",
    "é ü\xa0 z", "  a b", "<|endoftext|> is text", "a\x1c b", "你好 世界", "end\n", "\r\n a", "a \x85 b",
]


def test_ids_equal_the_library(whole):
    ids = P.TextIds.get(*P.public_tokenizer())
    rng = np.random.default_rng(0)
    made = ["".join(rng.choice(list("ab1,' \n\té  "), 40)) for _ in range(300)]
    for t in TEXTS + made:
        assert np.frombuffer(ids.of(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_plan_and_residue_are_the_histogram():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 200, 20_000):
        counts = np.bincount(rng.integers(1, 1025, n), minlength=1025)
        counts[700] += n // 3  # a length that a third of all pieces share
        planned, used = P.plan(counts)
        for parts, k in planned:
            assert sum(parts) == 1024 and k > 0
            for p in parts:
                used[p] += k
        assert (used == counts).all()
    for n, share in ((20_000, 0.08), (300_000, 0.03)):  # what rounding leaves of even tails; falls with their number
        counts = np.bincount(rng.integers(1, 1024, n), minlength=1025)
        assert (P.plan(counts)[1] * np.arange(1025)).sum() < share * (counts * np.arange(1025)).sum()


def test_stream_is_cut_at_the_ends_of_sequences():
    seen = {}
    for at in range(0, 3003, 7):
        for _, n, sequence, offset in P.cut_stream(at, 7, 5):
            seen.setdefault(sequence, []).append((offset, n))
    assert sorted(seen) == [5, 6, 7]
    for sequence, parts in seen.items():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at == (1024 if sequence < 7 else 3003 - 2048)


def nonnegative_optimum(a, b, rounds=60_000):
    """Least sum of squares by projected gradient with momentum, to convergence."""
    step = 1 / np.linalg.norm(a, 2) ** 2
    x = y = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(y - step * (a.T @ (a @ y - b)), 0)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, y, t = new, new + (t - 1) / s * (new - x), s
    return ((a @ x - b) ** 2).sum()


@pytest.mark.parametrize("seed", range(4))
def test_least_squares_reaches_the_optimum(seed):
    rng = np.random.default_rng(seed)
    window = 24
    counts = rng.integers(0, 400, window + 1) * (rng.random(window + 1) < 0.7)
    counts[0] = counts[window] = 0
    columns = P.combinations(np.flatnonzero(counts), window)
    a = np.zeros((window + 1, len(columns)))
    for j, parts in enumerate(columns.tolist()):
        for p in parts:
            if p:
                a[p, j] += 1
    x = P.solve_repeats(columns, counts)
    reached, best = ((a @ x - counts) ** 2).sum(), nonnegative_optimum(a, counts.astype(float))
    assert (x >= 0).all() and reached <= best + 1e-3 * (counts**2).sum()


def test_least_squares_ends_at_its_conditions():
    rng = np.random.default_rng(1)
    counts = np.bincount(np.minimum(1023, rng.exponential(300, 60_000).astype(int) + 1), minlength=1025)
    columns = P.combinations(np.flatnonzero(counts), 1024)
    x = P.solve_repeats(columns, counts)
    left = counts.astype(float)
    for p in range(3):
        np.subtract.at(left, columns[:, p], x)
    left[0] = 0
    twice = (columns[:, 0] == columns[:, 1]).astype(int) + ((columns[:, 1] == columns[:, 2]) & (columns[:, 1] > 0))
    norm = np.where(columns[:, 2] == 0, 2, 3) + np.array([0, 2, 6])[twice]
    assert np.abs(P.descent(columns, left, norm, x)).max() < 0.5


def test_least_squares_fits_a_solvable_histogram():
    columns = P.combinations(np.array([100, 300, 624, 400, 512]), 1024)
    counts = np.zeros(1025, int)
    counts[[100, 300, 624, 512]] = 50, 50, 90, 40
    counts[400] = 40
    x = P.solve_repeats(columns, counts)
    fit = np.zeros(1025)
    np.add.at(fit, columns.ravel(), np.repeat(x, 3))
    assert np.abs(fit[1:] - counts[1:]).max() < 1


def test_round_trip(spark, whole):
    rng = np.random.default_rng(3)
    docs = [(1000 + i, " ".join(rng.choice(["the", "and", "Über", "x1", "?"], rng.integers(0, 4000))), "s") for i in range(80)]
    docs += [(50, None, "s"), (51, "", None), (None, "null id", "s"), (52, "twice", "s"), (52, "twice", "s")]
    df = spark.createDataFrame(docs, "doc_id long, text string, length string")
    rows = P.pack(df, P.public_tokenizer()).collect()
    seq, doc = {}, {}
    for r in rows:
        seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        doc.setdefault(r.doc_id, []).append(r)
    full = sum(r.length for r in rows)
    assert len(seq) == -(-full // 1024)  # only the last sequence has padding
    for parts in seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
    for i, t, _ in docs:
        if i == 52:
            assert len(doc[52]) == 2
            continue
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(doc[i], key=lambda r: r.start)
        assert [r.start for r in own] == list(np.cumsum([0, *(r.length for r in own)])[:-1])
        assert all(r.doc_tokens == len(ids) for r in own) and sum(r.length for r in own) == len(ids)
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own)
    assert P.pack(df.limit(0), P.public_tokenizer()).count() == 0
