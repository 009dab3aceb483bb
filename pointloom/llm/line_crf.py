"""Quality rules with a linear-chain conditional random field over the lines of a text.

Every line is content or boilerplate. The field scores lines by features of their form and pairs of
neighbours by their labels; Viterbi decoding finds the best labelling of all lines of the text, and the
share of word characters in content lines decides whether the document is kept.

Only documents are labelled, so the labels of training lines are found first (``line_labels``): a line starts with the
quality of its document, lines that repeat an earlier one as boilerplate; a model of single lines, fitted on these, then
gives a line the other label where its form says so clearly, as a plain sentence among junk or a row of symbols in a good
text. The field is fitted on the resulting sequences, in which both labels occur side by side.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_SPACE, bounded_batches, fold, table

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = bytes(range(48, 58))
HIGH = bytes(range(128, 256))
MARKS = b"!?.,;:"
MIN_WORDS = 50
#: Share of word characters in content lines from which a document is kept.
MIN_CONTENT = 0.5
#: Documents of each quality that the field is fitted on, the lines of one training chain, and chains at most.
SAMPLE_PER_CLASS = 1_000
CHAIN = 64
MAX_CHAINS = 6_000
#: Log odds by form from which a training line takes the label that its document does not have.
CLEARLY = 1.0

FEATURES = (
    "one", "short", "middle", "long", "few_words", "symbols", "many_symbols", "shouting", "digits", "marks", "repeats_line",
    "repeats_words", "repeats_many", "no_letter", "ends_sentence", "starts_upper", "long_words",
)


def line_features(line: bytes, seen: set[bytes]) -> list[float]:
    """Features of one line by form; ``seen`` holds the earlier lines and gets this one."""
    n = len(line)
    words = line.split()
    k = len(words)
    up = n - len(line.translate(None, UPPER))
    letters = up + n - len(line.translate(None, LOWER + HIGH))
    symbols = n - len(line.translate(None, SYMBOLS))
    marks = n - len(line.translate(None, MARKS))
    digits = n - len(line.translate(None, DIGITS))
    some = max(1, n)
    distinct = len(set(words)) / k if k else 1.0
    again = bool(k) and line in seen
    if k:
        seen.add(line)
    last = line[-1:]
    return [
        1.0, n < 30, 30 <= n < 200, n >= 1000, k < 4, symbols > 0.02 * some, symbols > 0.08 * some, up > 0.5 * max(1, letters),
        digits > 0.2 * some, marks > 0.1 * some, again, k >= 8 and distinct < 0.5, k >= 8 and distinct < 0.25, not letters,
        last in (b".", b"!", b"?"), line[:1].isupper(), n > 15 * max(1, k),
    ]


@dataclass(frozen=True)
class Field:
    """Weights for content over boilerplate: of features, of the first line, and of label pairs."""

    weights: tuple[float, ...]
    start: float
    pairs: tuple[tuple[float, float], tuple[float, float]]


#: Used where no document is labelled: junk by form is boilerplate, everything else content.
PLAIN = Field((1.5, 0, 0, 0, 0, -1, -3, -3, -1, -1, -2, -2, -3, -2, 0.5, 0.2, -1), 0.0, ((0.5, 0.0), (0.0, 0.5)))


def viterbi(scores: np.ndarray, start: float, pairs) -> list[int]:
    """Best labels (0 boilerplate, 1 content) where ``scores`` favour 1; ties go to content."""
    (p00, p01), (p10, p11) = pairs
    values = scores.tolist()
    a, b = 0.0, start + values[0]
    back = []
    for s in values[1:]:
        from0 = a + p00 > b + p10
        from1 = a + p01 > b + p11
        back.append((from0, from1))
        a, b = (a + p00 if from0 else b + p10), (a + p01 if from1 else b + p11) + s
    label = int(b >= a)
    out = [label]
    for from0, from1 in reversed(back):
        label = int(not (from1 if label else from0))
        out.append(label)
    return out[::-1]


def fit(chains: list[tuple[np.ndarray, np.ndarray]], quality: np.ndarray | None = None, rounds: int = 150, rate: float = 0.5, decay: float = 1e-3) -> Field:
    """Maximise the conditional likelihood of (features, labels) chains by gradient steps.

    ``quality`` is the label of each chain's document, by default its first line's; both kinds of chains weigh alike.
    """
    kind = np.array([int(y[0]) for _, y in chains]) if quality is None else np.asarray(quality, int)
    if not len(chains) or len({int(v) for _, y in chains for v in y}) < 2 or len(set(kind.tolist())) < 2:
        return PLAIN
    n, t, d = len(chains), max(len(y) for _, y in chains), len(FEATURES)
    x, y, on = np.zeros((n, t, d)), np.zeros((n, t), int), np.zeros((n, t), bool)
    for k, (a, b) in enumerate(chains):
        x[k, : len(b)], y[k, : len(b)], on[k, : len(b)] = a, b, True
    share = np.bincount(kind, on.sum(axis=1), 2)
    heavy = (share.sum() / (2.0 * share))[kind]
    heavy = heavy / (heavy * on.sum(axis=1)).sum()
    theta = np.zeros(d + 1 + 4)
    step2 = np.zeros_like(theta)
    for _ in range(rounds):
        w, start, pair = theta[:d], theta[d], theta[d + 1 :].reshape(2, 2)
        emit = np.stack([np.zeros((n, t)), x @ w], axis=2)
        emit[:, 0, 1] += start
        alpha, beta = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        alpha[:, 0] = emit[:, 0]
        for i in range(1, t):
            a = np.logaddexp.reduce(alpha[:, i - 1, :, None] + pair, axis=1) + emit[:, i]
            alpha[:, i] = np.where(on[:, i, None], a, alpha[:, i - 1])
        z = np.logaddexp.reduce(alpha[:, -1], axis=1)
        for i in range(t - 2, -1, -1):
            b = np.logaddexp.reduce(pair + (emit[:, i + 1] + beta[:, i + 1])[:, None, :], axis=2)
            beta[:, i] = np.where(on[:, i + 1, None], b, 0.0)
        post = np.exp(alpha + beta - z[:, None, None])[:, :, 1] * on
        left = (y * on - post) * heavy[:, None]
        grad = np.zeros_like(theta)
        grad[:d] = np.einsum("nt,ntd->d", left, x)
        grad[d] = left[:, 0].sum()
        both = on[:, 1:]
        joint = np.exp(alpha[:, :-1, :, None] + pair + (emit[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None])
        want = np.zeros((n, t - 1, 2, 2))
        np.put_along_axis(want.reshape(n, t - 1, 4), (2 * y[:, :-1] + y[:, 1:])[:, :, None], 1.0, axis=2)
        grad[d + 1 :] = ((want - joint) * both[:, :, None, None] * heavy[:, None, None, None]).sum(axis=(0, 1)).ravel()
        grad -= decay * theta
        step2 += grad**2
        theta += rate * grad / (np.sqrt(step2) + 1e-8)
    pair = theta[d + 1 :].reshape(2, 2)
    return Field(tuple(theta[:d]), float(theta[d]), tuple(map(tuple, pair)))


def line_labels(chains: list[tuple[np.ndarray, np.ndarray]], quality: np.ndarray, clearly: float = CLEARLY) -> list[np.ndarray]:
    """Labels of the lines of (features, first labels) chains, by a model of single lines fitted on the first labels."""
    single = fit([(x[i : i + 1], y[i : i + 1]) for x, y in chains for i in range(len(y))], np.repeat(quality, [len(y) for _, y in chains]))
    out = []
    for (x, y), of in zip(chains, quality.tolist()):
        odds = x @ np.array(single.weights) + single.start
        again = x[:, FEATURES.index("repeats_line")] > 0
        out.append(np.where(again, 0, np.where(odds < -clearly, 0, np.where(odds > clearly, 1, of))))
    return out


def featurise(data: bytes) -> tuple[list[bytes], np.ndarray]:
    lines = data.split(b"\n")
    seen: set[bytes] = set()
    return lines, np.array([line_features(x, seen) for x in lines], float)


def content_lines(text: str | None, field: Field) -> list[tuple[str, bool]]:
    """The lines of a text, each with whether it is content."""
    lines, x = featurise((text or "").encode())
    labels = viterbi(x @ np.array(field.weights), field.start, field.pairs)
    return [(line.decode(), bool(v)) for line, v in zip(lines, labels)]


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words which occurs twice or more."""
    grams = list(zip(words, words[1:], words[2:]))
    counts = Counter(grams)
    if len(counts) == len(grams):
        return 0
    total = end = 0
    for i, g in enumerate(grams):
        if counts[g] > 1:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


def characters(data: bytes) -> int:
    """Code points of UTF-8 that are not ASCII white space."""
    return len(data.translate(None, WORD_SPACE + bytes(range(0x80, 0xC0))))


def judge(text: str | None, field: Field, min_content: float = MIN_CONTENT):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share, n_content_lines)."""
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    word_chars = characters(data)
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    repeats = repeated_words(words)
    lines, x = featurise(data)
    failed = n < MIN_WORDS or 100 * repeats > 50 * n
    labels = viterbi(x @ np.array(field.weights), field.start, field.pairs)
    good = sum(characters(line) for line, v in zip(lines, labels) if v)
    share = good / word_chars if word_chars else 0.0
    return n, word_chars, symbols, int(x[:, FEATURES.index("repeats_line")].sum()), repeats, failed, not failed and share >= min_content, share, sum(labels)


_SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, content_share double, n_content_lines long"
)


def apply_rules(docs: DataFrame, field: Field, min_content: float = MIN_CONTENT) -> DataFrame:
    """One row of counts and verdicts for each row of ``docs``; a null text counts as empty (one line, no word).

    Repeated rows and rows with a null doc_id are judged like any other. Other columns are not read.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        kinds = [pa.int64()] * 6 + [pa.bool_(), pa.bool_(), pa.float64(), pa.int64()]
        names = [x.split()[0] for x in _SCHEMA.split(", ")]
        for b in batches:
            cols = list(zip(*(judge(t, field, min_content) for t in b.column(1).to_pylist()))) or [()] * 9
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds[1:]))], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _SCHEMA)


def labelled_sample(labels: DataFrame, per_class: int) -> DataFrame:
    """(id, quality) of at most ``per_class`` ids of each quality, drawn by a hash outside fold 2; contradictions count as 0."""
    known = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 2))
        .groupBy(F.col("doc_id").alias("id"))
        .agg(F.min("quality").cast("int").alias("quality"))
    )
    parts = [known.where(F.col("quality") == q).orderBy(F.xxhash64("id"), "id").limit(per_class) for q in (0, 1)]
    return parts[0].union(parts[1])


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, max_chains: int = MAX_CHAINS) -> Field:
    """Fit on the lines of a bounded sample of labelled documents, at most ``max_chains`` chains of CHAIN lines.

    Features are made by the executors, three bytes a line; of more chains those with the smallest hashes are taken.
    """
    bounded_batches(docs.sparkSession)
    sample = F.broadcast(labelled_sample(labels, per_class))
    texts = docs.select(F.col("doc_id").alias("of"), F.col("text").cast("string").alias("text"))
    own = texts.join(sample, F.col("of") == F.col("id")).select("id", "quality", "text")

    def run(batches):
        for b in batches:
            rows = []
            for doc, quality, text in zip(*(c.to_pylist() for c in b.columns)):
                _, x = featurise((text or "").encode())
                packed = np.packbits(x.astype(bool), axis=1)
                rows += [(doc, quality, i, packed[i : i + CHAIN].tobytes()) for i in range(0, len(packed), CHAIN)]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 4, kinds)], ["id", "quality", "first", "bits"])

    found = own.mapInArrow(run, "id long, quality int, first long, bits binary").groupBy("id", "quality", "first").agg(F.min("bits").alias("bits"))
    rows = found.orderBy(F.xxhash64("id", "first"), "id", "first").limit(max_chains).collect()
    rows.sort(key=lambda r: (r["id"], r["first"]))
    quality = np.array([r["quality"] for r in rows], int)
    chains = []
    for r in rows:
        bits = np.frombuffer(bytes(r["bits"]), np.uint8).reshape(-1, -(-len(FEATURES) // 8))
        x = np.unpackbits(bits, axis=1)[:, : len(FEATURES)].astype(float)
        chains.append((x, np.where(x[:, FEATURES.index("repeats_line")] > 0, 0, r["quality"])))
    if len(set(quality.tolist())) < 2:
        return PLAIN
    return fit([(x, y) for (x, _), y in zip(chains, line_labels(chains, quality))], quality)


def op1_line_crf(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return apply_rules(docs, train(docs, table(spark, sf_dir, "labels")))
