import re
from collections import Counter
from itertools import product

import numpy as np
from pointloom.llm import line_crf as C


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(0)
    for _ in range(50):
        s, start, pairs = rng.normal(size=6), rng.normal(), rng.normal(size=(2, 2)).tolist()
        value = lambda y: start * y[0] + sum(a * b for a, b in zip(s, y)) + sum(pairs[a][b] for a, b in zip(y, y[1:]))
        best = max(product((0, 1), repeat=6), key=value)
        assert C.viterbi(s, start, pairs) == list(best)


def test_fit_learns_and_matches_gradient():
    rng = np.random.default_rng(1)
    chains = []
    for k in range(60):
        y = np.full(5 + k % 90, k % 2)
        x = np.zeros((len(y), len(C.FEATURES)))
        x[:, 0] = 1
        x[:, 5] = (rng.random(len(y)) < (0.1 if k % 2 else 0.8)).astype(float)
        chains.append((x, y))
    field = C.fit(chains)
    right = [np.mean(np.array(C.viterbi(x @ np.array(field.weights), field.start, field.pairs)) == y) for x, y in chains]
    assert np.mean(right) > 0.97
    assert C.fit([]) == C.PLAIN and C.fit(chains[:1]) == C.PLAIN


def slow(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(zip(words, words[1:], words[2:]))
    hit = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines, dup = [], 0
    for x in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in lines
            lines.append(x)
    return len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_counts():
    texts = [None, "", "a b c a b c x", "é\x85ü b\x1cc\n\n\né\x85ü b\x1cc\n \n", "x " * 200, "a a a", "## <b> $%\r\n## <b> $%\r\n", "　漢字 z"]
    for t in texts:
        assert C.judge(t, C.PLAIN)[:5] == slow(t), repr(t)


def test_rules(spark):
    rng = np.random.default_rng(0)
    clean = "\n".join("The " + " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(14)) + "." for _ in range(12))
    junk = " ".join(f"word{i}%%% thing{i}###" for i in range(60))
    docs = [(1, clean, True), (2, junk, True), (3, None, True), (4, "few words", True), (5, "again and again " * 40, True), (None, clean, True), (1, clean, True), (6, clean + "\n" + junk, True), (7, "x" * 200_000, True)]
    df = spark.createDataFrame(docs, "doc_id long, text string, kept boolean")
    rows = C.apply_rules(df, C.PLAIN).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs)
    assert by[1].kept and by[None].kept and not by[2].kept and not by[2].base_failed
    assert by[3].base_failed and by[4].base_failed and by[5].base_failed and by[7].base_failed
    assert C.apply_rules(df.limit(0), C.PLAIN).count() == 0
    assert [v for _, v in C.content_lines(clean + "\n" + junk, C.PLAIN)] == [True] * 12 + [False]
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 1), (9, None, 0)], "doc_id long, quality int, toxic int")
    assert C.train(df, labels.limit(0)) == C.PLAIN
    field = C.train(df, labels)
    assert isinstance(field, C.Field)


def sentence(rng):
    return "The " + " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(12)) + "."


def junk_line(rng):
    return " ".join("".join(rng.choice(list("abcdefgh"), 5)) + "%%%" for _ in range(12))


def test_lines_of_one_document_are_told_apart(spark):
    rng = np.random.default_rng(5)
    docs, labels = [], []
    for i in range(240):  # bad documents hold plain sentences too, good ones a line of symbols at times
        good = i % 2
        share = 0.9 if good else 0.25
        lines = [sentence(rng) if rng.random() < share else junk_line(rng) for _ in range(10)]
        docs.append((i, "\n".join(lines), "q", i))
        labels.append((i, good, 0))
    mixed = [(1000 + k, "\n".join([sentence(rng) for _ in range(k)] + [junk_line(rng) for _ in range(10 - k)]), "q", 0) for k in range(11)]
    df = spark.createDataFrame(docs + mixed, "doc_id long, text string, quality string, id long")  # clashing names
    field = C.train(df, spark.createDataFrame(labels, "doc_id long, quality int, id int"))
    assert field != C.PLAIN
    for _, text, *_ in mixed:
        assert [v for _, v in C.content_lines(text, field)] == ["%%%" not in x for x in text.split("\n")]
    asked = spark.createDataFrame(mixed, "doc_id long, text string, quality string, id long")
    share = {r.doc_id - 1000: (r.content_share, r.kept) for r in C.apply_rules(asked, field).collect()}
    assert all(abs(v - k * 63 / (k * 63 + (10 - k) * 84)) < 0.1 for k, (v, _) in share.items())  # words of 5 characters, or 5 and 3 symbols
    kept = [sum(r.kept for r in C.apply_rules(asked, field, least).collect()) for least in (0.2, 0.5, 0.8)]
    assert kept[0] > kept[1] > kept[2] > 0 and share[10][1] and not share[0][1]


def test_training_lines_are_bounded(spark):
    text = "\n".join(f"line number {i} of a long text." for i in range(1000))
    df = spark.createDataFrame([(1, text), (2, "a%%% b%%%"), (3, text + "%")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    assert isinstance(C.train(df, labels, max_chains=5), C.Field)
