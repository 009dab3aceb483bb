"""Language identification by unigram pieces, marginalised over all segmentations.

Each language has probabilities over the pieces of a fixed public vocabulary. A word's likelihood is the sum
over all its segmentations into pieces of the product of their probabilities, computed by a forward
pass; a text's is the product over its words. The probabilities are fitted by expectation maximisation
(forward and backward passes over the same lattices) on the words of a bounded sample of labelled documents; each language
is fitted by a task of its own.

All segmentations of the first e bytes of a word cover e bytes, so a factor for each byte of a piece changes every sum
over them by the same power. That keeps the sums of ordinary words in range; where it does not, and for words of more
than LONG_WORD bytes, the passes run over logarithms.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, fold, shuffle_parts, table, tidy

#: Bounds of the sample that the model is fitted on: documents of each language, and languages (those of most documents).
SAMPLE_PER_LANG = 400
MAX_LANGS = 256
EM_ROUNDS = 3
SMOOTHING = 0.02
CACHE_WORDS = 200_000
SLICE_CHARS = 400_000
#: Words of more bytes take the pass over logarithms, one by one.
LONG_WORD = 160
#: Logarithm of the factor for each byte of a piece, about what a byte of text costs.
BYTE = 2.5
#: Sums outside these are taken again over logarithms.
LEAST, MOST = 1e-280, 1e280
#: Cells of the arrays that a batch of words takes.
CELLS = 2_000_000
#: Letters and other numeric signs than decimal digits, which ``words`` parts from them.
_RUNS = re.compile(r"[^\W\d_]+")


def load_pieces(path: str) -> dict[bytes, int]:
    """All pieces of a rank file, one base64 piece and its rank a line.

    What only begins a piece has number -1, so that a search can stop where no piece goes on.
    """
    with open(path, "rb") as f:
        ranks = sorted((int(b), base64.b64decode(a)) for a, b in map(bytes.split, f))
    pieces = {piece: i for i, (_, piece) in enumerate(ranks)}
    for piece in list(pieces):
        for k in range(1, len(piece)):
            pieces.setdefault(piece[:k], -1)
    return pieces


def lengths(vocabulary: dict[bytes, int]) -> np.ndarray:
    """Bytes of each piece."""
    out = np.zeros(1 + max(vocabulary.values()), np.int64)
    for piece, i in vocabulary.items():
        if i >= 0:
            out[i] = len(piece)
    return out


def words(text: str | None) -> list[str]:
    """Runs of letters (Unicode categories L) in lower case."""
    if not text:
        return []
    found = _RUNS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return list(chain.from_iterable([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split() for w in found))


def arcs(word: bytes, vocabulary: dict[bytes, int]) -> list[tuple[int, int, int]]:
    """(start, end, piece) of all pieces in a word."""
    get = vocabulary.get
    out = []
    for i in range(len(word)):
        for j in range(i + 1, len(word) + 1):
            p = get(word[i:j])
            if p is None:
                break
            if p >= 0:
                out.append((i, j, p))
    return out


class Trie:
    """The pieces as a table from (node, byte) to node, so that all places of many words are followed at once."""

    def __init__(self, vocabulary: dict[bytes, int]):
        self.vocabulary = vocabulary
        node = {b"": 0} | {p: k for k, p in enumerate(vocabulary, 1)}
        keys = np.fromiter((node[p[:-1]] * 256 + p[-1] for p in vocabulary), np.int64, len(vocabulary))
        self.piece = np.concatenate(([-1], np.fromiter(vocabulary.values(), np.int64, len(vocabulary))))
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.child = np.zeros(1 << self.bits, np.int64)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):  # each free slot takes one of its keys, the others go on to the next slot
            free = left[self.key[slot[left]] < 0]
            self.key[slot[free]], self.child[slot[free]] = keys[free], free + 1
            left = left[self.key[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & (len(self.key) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The nodes that the bytes lead to, 0 where no piece goes on."""
        keys = node * 256 + byte
        slot = self._slot(keys)
        out = np.where(self.key[slot] == keys, self.child[slot], 0)
        left = np.flatnonzero((self.key[slot] != keys) & (self.key[slot] >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.key) - 1)
            found = self.key[slot[left]] == keys[left]
            out[left[found]] = self.child[slot[left[found]]]
            left = left[~found & (self.key[slot[left]] >= 0)]
        return out

    def arcs(self, texts: list[bytes]) -> np.ndarray:
        """Rows own, start, end, piece of all pieces in the texts."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        data = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64)
        own = np.repeat(np.arange(len(texts)), size)
        first = np.cumsum(size) - size
        at, node = np.arange(len(data)), np.zeros(len(data), np.int64)
        last = (first + size)[own]
        found, depth = [], 0
        while len(at):
            node = self.step(node, data[at + depth])
            depth += 1
            hit = self.piece[node] >= 0
            start = at[hit] - first[own[at[hit]]]
            found.append(np.stack([own[at[hit]], start, start + depth, self.piece[node[hit]]]))
            on = (node > 0) & (at + depth < last[at])
            at, node = at[on], node[on]
        return np.concatenate(found, axis=1) if found else np.zeros((4, 0), np.int64)


class Lattice:
    """All pieces that occur in each of some words, in arrays; a word is its bytes after one space."""

    def __init__(self, texts: list[bytes], trie: Trie):
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.longest = int(self.size.max(initial=0))
        a = trie.arcs(texts)
        self.arcs = a[:, np.argsort(a[2].astype(np.int16 if self.longest < 1 << 15 else np.int64), kind="stable")]  # by end

    def _sweep(self, own: np.ndarray, here: np.ndarray, there: np.ndarray, weight: np.ndarray, out: np.ndarray) -> None:
        """Add weight times the value there to the value here, place by place; arcs are in the order of ``here``, up or down."""
        cut = np.flatnonzero(np.concatenate(([True], here[1:] != here[:-1], [True]))) if len(here) else np.zeros(1, int)
        for s, e in zip(cut, cut[1:]):
            o = own[s:e]
            value = out[o, there[s:e]] * weight[s:e]
            for k in range(out.shape[2]):
                out[:, here[s], k] += np.bincount(o, value[:, k], len(out))

    def forward(self, prob: np.ndarray) -> np.ndarray:
        """alpha[word, place, language] with prob[piece, language]."""
        own, start, end, piece = self.arcs
        alpha = np.zeros((len(self.size), self.longest + 1, prob.shape[1]))
        alpha[:, 0] = 1.0
        self._sweep(own, end, start, prob[piece], alpha)
        return alpha

    def expected(self, prob: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected uses of each piece, one language: prob[piece], weight[word]; and the words whose sums leave the range."""
        alpha = self.forward(prob[:, None])[:, :, 0]
        total = alpha[np.arange(len(self.size)), self.size]
        back = np.zeros((*alpha.shape, 1))
        back[np.arange(len(self.size)), self.size] = 1.0
        own, start, end, piece = self.arcs[:, np.argsort(-self.arcs[1], kind="stable")]
        self._sweep(own, start, end, prob[piece][:, None], back)
        beta = back[:, :, 0]
        fine = (total > LEAST) & (alpha.max(axis=1) < MOST) & (beta.max(axis=1) < MOST)
        share = np.divide(weight, total, out=np.zeros(len(total)), where=fine)
        use = alpha[own, start] * prob[piece] * beta[own, end] * share[own]
        return np.bincount(piece[fine[own]], use[fine[own]], len(prob)), np.flatnonzero(~fine)


def batches_of(texts: list[bytes], langs: int) -> list[list[int]]:
    """Places of the words of at most LONG_WORD bytes, shortest first, in batches of about CELLS cells."""
    out: list[list[int]] = []
    held = 0
    for k in sorted((k for k in range(len(texts)) if len(texts[k]) <= LONG_WORD), key=lambda k: len(texts[k])):
        cells = (len(texts[k]) + 1) * (langs + 4)
        if not out or held + cells > CELLS:
            out.append([])
            held = 0
        out[-1].append(k)
        held += cells
    return out


def log_forward(size: int, found: list[tuple[int, int, int]], log_prob: np.ndarray) -> np.ndarray:
    """log alpha[place, language] of one word of any length, from its arcs and log_prob[piece, language]."""
    log = np.full((size + 1, log_prob.shape[1]), -np.inf)
    log[0] = 0.0
    into: dict[int, list[tuple[int, int]]] = {}
    for i, j, p in found:
        into.setdefault(j, []).append((i, p))
    for e in sorted(into):
        i, p = zip(*into[e])
        log[e] = np.logaddexp.reduce(log[list(i)] + log_prob[list(p)], axis=0)
    return log


def log_expected(size: int, found: list[tuple[int, int, int]], log_prob: np.ndarray, pieces: int) -> np.ndarray:
    """Expected uses of each piece in one word of any length, one language."""
    alpha = log_forward(size, found, log_prob[:, None])[:, 0]
    turned = [(size - j, size - i, p) for i, j, p in found]
    beta = log_forward(size, turned, log_prob[:, None])[::-1, 0]
    i, j, p = (np.array(x) for x in zip(*found))
    return np.bincount(p, np.exp(alpha[i] + log_prob[p] + beta[j] - alpha[size]), pieces)


class Scorer:
    """Log likelihoods of words by language, with a bounded cache that later tasks of the same worker find again."""

    _held: tuple[object, Scorer] | None = None

    @classmethod
    def held(cls, key: object, vocabulary_path: str, shared) -> Scorer:
        if cls._held is None or cls._held[0] != key:
            cls._held = (key, cls(load_pieces(vocabulary_path), shared.value.astype(float)))
        return cls._held[1]

    def __init__(self, vocabulary: dict[bytes, int], prob: np.ndarray):
        self.vocabulary, self.prob, self.trie = vocabulary, prob, Trie(vocabulary)
        self.scaled = prob * np.exp(BYTE * np.minimum(lengths(vocabulary), LONG_WORD))[:, None]
        self.log_prob = np.log(prob)
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, prob.shape[1]))

    def texts(self, texts: list[str | None]) -> np.ndarray:
        """Log likelihood [text, language]; NaN where a text has no letter. Words are held for SLICE_CHARS of text at a time."""
        out = np.full((len(texts), self.prob.shape[1]), np.nan)
        first = chars = 0
        for k, t in enumerate(texts):
            chars += len(t or "")
            if chars >= SLICE_CHARS or k == len(texts) - 1:
                self._slice(texts, first, k + 1, out)
                first, chars = k + 1, 0
        return out

    def _slice(self, texts: list[str | None], first: int, stop: int, out: np.ndarray) -> None:
        counts = [Counter(words(t)) for t in texts[first:stop]]
        new = dict.fromkeys(w for c in counts for w in c if w not in self.known)
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known, self.rows = {}, np.zeros((0, self.prob.shape[1]))
            new = dict.fromkeys(w for c in counts for w in c)
        if new:
            self.learn(list(new))
        for k, c in enumerate(counts, first):
            if c:
                at = np.fromiter(map(self.known.__getitem__, c), np.int64, len(c))
                out[k] = np.fromiter(c.values(), float, len(c)) @ self.rows[at]

    def learn(self, new: list[str]) -> None:
        texts = [b" " + w.encode() for w in new]
        out = np.full((len(new), self.prob.shape[1]), np.nan)
        for part in batches_of(texts, self.prob.shape[1]):
            lattice = Lattice([texts[k] for k in part], self.trie)
            alpha = lattice.forward(self.scaled)
            total = alpha[np.arange(len(part)), lattice.size]
            fine = (total.min(axis=1) > LEAST) & (alpha.max(axis=(1, 2)) < MOST)
            at = np.array(part)[fine]
            out[at] = np.log(total[fine]) - BYTE * lattice.size[fine, None]
        for k in np.flatnonzero(np.isnan(out[:, 0])).tolist():
            out[k] = log_forward(len(texts[k]), arcs(texts[k], self.vocabulary), self.log_prob)[-1]
        base = len(self.rows)
        self.rows = np.concatenate([self.rows, out])
        self.known.update(zip(new, range(base, base + len(new))))


def fit(counts: Counter, vocabulary: dict[bytes, int], rounds: int = EM_ROUNDS, smoothing: float = SMOOTHING) -> np.ndarray:
    """prob[piece] of one language from the counts of its words.

    ``smoothing`` is added to each piece's expected uses; a single byte always keeps some probability, so
    every word has a segmentation.
    """
    size, trie = lengths(vocabulary), Trie(vocabulary)
    factor = np.exp(BYTE * np.minimum(size, LONG_WORD))
    names = sorted(counts) or ["a"]
    texts = [b" " + w.encode() for w in names]
    weight = np.array([counts[w] or 1 for w in names], float)
    parts = [(np.array(part), Lattice([texts[k] for k in part], trie)) for part in batches_of(texts, 1)]
    long = [k for k, w in enumerate(texts) if len(w) > LONG_WORD]
    p = np.full(len(size), smoothing)
    for at, lattice in parts:
        p += np.bincount(lattice.arcs[3], weight[at][lattice.arcs[0]], len(size))
    for k in long:
        p += weight[k] * np.bincount([x[2] for x in arcs(texts[k], vocabulary)], minlength=len(size))
    p /= p.sum()
    for _ in range(rounds):
        use, rest = np.full(len(size), smoothing), list(long)
        for at, lattice in parts:
            got, out = lattice.expected(p * factor, weight[at])
            use += got
            rest += at[out].tolist()
        for k in rest:
            use += weight[k] * log_expected(len(texts[k]), arcs(texts[k], vocabulary), np.log(p), len(size))
        p = use / use.sum()
    return p


def sample(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG, max_langs: int = MAX_LANGS) -> DataFrame:
    """(lang, text) of at most ``per_lang`` documents of each language outside fold 2: those with the smallest hashes of their ids.

    Of more than ``max_langs`` languages those of most documents are taken. A hash limit by each language's count
    leaves a few times ``per_lang`` rows to be ranked, however many there are.
    """
    lang = F.col("lang").cast("string")
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 2)).select(
        F.col("doc_id").alias("id"), lang.alias("lang"), F.col("text").cast("string").alias("text")
    )
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs)
    unit = (F.xxhash64("id").bitwiseAND(F.lit((1 << 52) - 1))).cast("double") / float(1 << 52)
    few = known.drop("text").join(F.broadcast(counts), "lang").where(unit * F.col("n") <= 2.0 * per_lang + 200)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(unit, "id"))
    ids = few.withColumn("r", rank).where(F.col("r") <= per_lang).select(F.col("id").alias("own"), F.col("lang").alias("of")).distinct()
    # at most per_lang * max_langs rows
    return known.join(F.broadcast(ids), (F.col("id") == F.col("own")) & (F.col("lang") == F.col("of"))).select("lang", "text")


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, n) from (lang, text)."""

    def run(batches):
        total: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total.setdefault(lang, Counter()).update(words(text))
        rows = [(k, w, n) for k, c in total.items() for w, n in (c or {"": 0}).items()]
        for i in range(0, len(rows), 20_000):
            k, w, n = zip(*rows[i : i + 20_000])
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(w), pa.array(n, pa.int64())], ["lang", "word", "n"])

    return texts.mapInArrow(tidy(run), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _fit_each(vocabulary_path: str):
    """Rows (lang, word, n) sorted by lang: the probabilities of each language."""

    def run(batches):
        vocabulary: dict[bytes, int] = {}
        at, counts = None, Counter()

        def done():
            vocabulary.update(vocabulary or load_pieces(vocabulary_path))
            p = fit(counts, vocabulary).astype(np.float32)
            return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([p.tobytes()], pa.binary())], ["lang", "prob"])

        for b in batches:
            for lang, word, n in zip(*(c.to_pylist() for c in b.columns)):
                if lang != at:
                    if at is not None:
                        yield done()
                    at, counts = lang, Counter()
                if word:
                    counts[word] = n
        if at is not None:
            yield done()

    return run


def train(docs: DataFrame, vocabulary_path: str, per_lang: int = SAMPLE_PER_LANG, max_langs: int = MAX_LANGS):
    """(languages, prob[piece, language]) fitted on a bounded sample of labelled documents, each language in a task."""
    spark = docs.sparkSession
    bounded_batches(spark)
    dealt = word_counts(sample(docs, per_lang, max_langs)).repartition(shuffle_parts(spark), "lang").sortWithinPartitions("lang", "word")
    found = dealt.mapInArrow(tidy(_fit_each(vocabulary_path)), "lang string, prob binary").collect()  # at most max_langs rows
    found.sort(key=lambda r: r["lang"])
    return [r["lang"] for r in found], np.array([np.frombuffer(bytes(r["prob"]), np.float32) for r in found]).T


def posterior(ll: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether a text has letters, its best language, that language's posterior under equal priors) from log likelihoods."""
    known = ~np.isnan(ll[:, 0])
    ll = np.where(known[:, None], ll, 0.0)
    score = 1.0 / np.exp(np.minimum(ll - ll.max(axis=1, keepdims=True), 0)).sum(axis=1)
    return known, ll.argmax(axis=1), np.where(known, score, 0.0)


def _scored(docs: DataFrame, model, vocabulary_path: str, at: int, make, schema) -> DataFrame:
    """``make(batch, known, best, score)`` over the texts in column ``at``; without languages nothing is known."""
    spark = docs.sparkSession
    bounded_batches(spark)
    langs, prob = model
    shared, key = spark.sparkContext.broadcast(prob), uuid.uuid4().hex  # vocabulary x MAX_LANGS floats at most

    def run(batches):
        scorer = Scorer.held(key, vocabulary_path, shared) if langs else None
        for b in batches:
            texts = b.column(at).to_pylist()
            found = posterior(scorer.texts(texts)) if scorer else (np.zeros(len(texts), bool), np.zeros(len(texts), int), np.zeros(len(texts)))
            yield make(b, *found)

    return docs.mapInArrow(tidy(run), schema)


def detect(docs: DataFrame, model, vocabulary_path: str) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of ``docs`` under ``model = (languages, prob)``.

    score is the posterior of the language told, under equal priors. Texts that are null or have no letter
    are ``und`` with score 0, and so is every text if no language was learned. Ties go to the first language
    by name. Other columns are not read.
    """
    langs = model[0]

    def make(b, known, best, score):
        pred = [langs[k] if x else "und" for x, k in zip(known.tolist(), best.tolist())]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return _scored(own, model, vocabulary_path, 1, make, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model, vocabulary_path: str, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is told with a score of ``least`` or more; rows without letters go."""
    return _scored(docs, model, vocabulary_path, docs.columns.index("text"), lambda b, known, _, score: b.filter(pa.array(known & (score >= least))), docs.schema)


def public_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op8_langid(spark, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), public_vocabulary()
    out = detect(docs, train(docs, path), path)
    return out.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score")
