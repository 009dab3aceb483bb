from collections import Counter
from itertools import combinations
from zlib import crc32

import numpy as np
from pointloom.llm import langid as L

# what only begins a piece is in a vocabulary too
VOCAB = {b" ": 0, b"a": 1, b"b": 2, b"ab": 3, b" a": 4, b"ba": 5, b"bab": 6}


def brute(word, prob):
    """Sum over all ways to cut the word."""
    n, total = len(word), 0.0
    for k in range(n):
        for cuts in combinations(range(1, n), k):
            parts = [word[i:j] for i, j in zip((0, *cuts), (*cuts, n))]
            if all(p in VOCAB for p in parts):
                total += np.prod([prob[VOCAB[p]] for p in parts], axis=0)
    return total


def test_forward_sums_all_segmentations():
    prob = np.random.default_rng(0).random((len(VOCAB), 3))
    texts = [b" a", b" ab", b" babab", b" bbaabab"]
    lattice = L.Lattice(texts, L.Trie(VOCAB))
    alpha = lattice.forward(prob)
    for k, w in enumerate(texts):
        assert np.allclose(alpha[k, len(w)], brute(w, prob))
        assert np.allclose(L.log_forward(len(w), L.arcs(w, VOCAB), np.log(prob))[-1], np.log(brute(w, prob)))


def test_trie_finds_what_a_search_finds():
    vocabulary = L.load_pieces(L.public_vocabulary())
    texts = [b" the", b" hello", " ünïcode".encode(), b" " + b"ab" * 40, b" ", " 你好世界".encode()]
    got = {tuple(x) for x in L.Trie(vocabulary).arcs(texts).T.tolist()}
    assert got == {(k, *x) for k, t in enumerate(texts) for x in L.arcs(t, vocabulary)}
    assert L.Trie(VOCAB).arcs([]).shape == (4, 0)


def test_expected_uses():
    prob = np.random.default_rng(1).random(len(VOCAB))
    w = b" babab"
    got, out = L.Lattice([w], L.Trie(VOCAB)).expected(prob, np.array([2.0]))
    assert not len(out) and np.allclose(got, 2 * L.log_expected(len(w), L.arcs(w, VOCAB), np.log(prob), len(VOCAB)))
    eps = 1e-6
    for p in range(len(VOCAB)):  # uses of a piece are the derivative by its log probability
        up = prob.copy()
        up[p] *= 1 + eps
        assert np.isclose(got[p], 2 * (np.log(brute(w, up)) - np.log(brute(w, prob))) / eps, atol=1e-3)


def test_fit_and_detect(spark):
    path = L.public_vocabulary()
    said = {"de": Counter({"der": 9, "und": 5, "mit": 3}), "en": Counter({"the": 9, "and": 5, "with": 3})}
    model = list(said), np.array([L.fit(c, L.load_pieces(path)) for c in said.values()]).T
    docs = [(1, "The and!", 5), (2, "und DER mit", 5), (3, None, 5), (4, "12 %$", 5), (5, "", 5), (None, "with " * 9000, 5), (7, "x" * 3000, 5), (7, "x" * 3000, 5)]
    df = spark.createDataFrame(docs, "doc_id long, text string, score int")
    rows = L.detect(df, model, path).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs)
    assert by[1].lang_pred == "en" and by[2].lang_pred == "de" and by[None].lang_pred == "en"
    assert [by[i].lang_pred for i in (3, 4, 5)] == ["und"] * 3
    assert all(0 <= r.score <= 1 for r in rows) and by[7].lang_pred in ("en", "de")
    assert L.detect(df.limit(0), model, path).count() == 0
    none = L.detect(df, L.train(df.selectExpr("*", "cast(null as string) as lang"), path), path).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_sample_keeps_to_the_folds(spark):
    df = spark.createDataFrame([(i, f"word{'x' * i}", "en" if i % 2 else None) for i in range(40)], "doc_id long, text string, lang string")
    found = L.word_counts(L.sample(df)).collect()
    want = {f"word{'x' * i}" for i in range(1, 40, 2) if crc32(str(i).encode()) % 4 != 2}
    assert {r.lang for r in found} == {"en"} and {r.word for r in found} == {w for t in want for w in L.words(t)}
    assert L.word_counts(L.sample(df.limit(0))).count() == 0


def test_sample_takes_so_many_of_each_and_the_largest_languages(spark):
    rows = [(i, f"t{i}", "hot" if i % 3 else f"l{i % 60}") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    by = {r["lang"]: r["count"] for r in L.sample(df, per_lang=30, max_langs=3).groupBy("lang").count().collect()}
    seen = Counter(lang for i, _, lang in rows if crc32(str(i).encode()) % 4 != 2)
    assert by == dict.fromkeys(sorted(seen, key=lambda x: (-seen[x], x))[:3], 30)


def test_letters_are_letters(spark):
    assert L.words("² ½ Ⅷ ① _7 ٣") == [] and L.words("a²b Ünï①x") == ["a", "b", "ünï", "x"]
    path = L.public_vocabulary()
    model = ["de"], L.fit(Counter({"der": 2}), L.load_pieces(path))[:, None]
    df = spark.createDataFrame([(1, "² ½"), (2, "² ½ é")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in L.detect(df, model, path).collect()} == {1: "und", 2: "de"}


def test_every_piece_and_every_word_counts():
    vocabulary = L.load_pieces(L.public_vocabulary())
    longest = max((p for p, k in vocabulary.items() if k >= 0), key=len)
    assert len(longest) > 16
    long_words = {"ab" * 60: 3, "é" * 90: 2, "x" * 400: 1, "the": 5}
    p = L.fit(Counter(long_words), vocabulary)
    assert np.isclose(p.sum(), 1) and (p > 0).all()
    scorer = L.Scorer(vocabulary, p[:, None])
    scorer.learn(list(long_words))
    for k, w in enumerate(long_words):  # what the scaled sums give is what logarithms give
        text = b" " + w.encode()
        assert np.isclose(scorer.rows[k, 0], L.log_forward(len(text), L.arcs(text, vocabulary), np.log(p)[:, None])[-1, 0])
    without = L.fit(Counter({w: n for w, n in long_words.items() if len(w) < 100}), vocabulary)
    assert not np.allclose(p, without)
