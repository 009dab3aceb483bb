"""Packing tokenised documents into sequences by non-negative least squares on the length histogram.

A document's ids are cut every ``window`` ids, which leaves full pieces and one shorter tail. Only the
histogram of piece lengths (at most ``window`` counts) reaches the driver. There, combinations of two and
three lengths that fill a window exactly are the columns of a non-negative least squares problem whose
solution says how often each is used; it is rounded within the counts. The plan is a bounded list of (combination, repeats).
Pieces find their place by their rank among the pieces of equal length, which is counted in salted buckets, so that a length that
very many pieces share is ranked by many tasks.

What the plan leaves of a length are its last ranks. These residual tails are packed greedily, one after another, and cut where a
sequence ends, so that only the last sequence has padding. Every tail takes part in the histogram.
"""

from __future__ import annotations

import base64
import re
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut_lineage, table, tidy

WINDOW = 1024
#: Entries of the word cache of a Python worker.
CACHE_WORDS = 250_000
#: Pieces that share a bucket of one length, about.
BUCKET_ROWS = 20_000


class _Loose(Exception):
    """White space next to the space that the text was split at: words are not independent there."""


class WordIds(dict):
    """Ids, as little-endian bytes, of a word with the space before it; bounded."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Loose
        if len(self) >= CACHE_WORDS:
            self.clear()
        out = self[word] = self.encode(" " + word)
        return out


class TextIds:
    """Ids of whole texts under a byte-level BPE of the ``tokenizers`` library.

    Its pattern starts a new word at every single space between two non-space characters, so texts are
    encoded word by word through a cache. If ``ranks`` names the same vocabulary as ranks, words
    that are not in the cache go through the faster library; ids are the same (held by a test). Texts with
    the strings of special tokens go to ``tokenizers`` whole.
    """

    _held: dict[tuple, TextIds] = {}
    tight = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            quick = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=table, special_tokens={})
            self.word = lambda s: np.array(quick.encode_ordinary(s), "<u4").tobytes()
        else:
            self.word = self.of_whole
        self.words = WordIds(self.word)

    @classmethod
    def get(cls, *key) -> TextIds:
        if key not in cls._held:
            cls._held[key] = cls(*key)
        return cls._held[key]

    def of_whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def of(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.of_whole(text)
        first, *rest = text.split(" ")
        try:
            if first and first[-1].isspace():
                raise _Loose
            return self.word(first) + b"".join(map(self.words.__getitem__, rest))
        except _Loose:
            first, *rest = self.tight.split(text)
            return self.word(first) + b"".join([self.word(" " + x) for x in rest])


def pieces(docs: DataFrame, tokenizer: tuple, window: int = WINDOW) -> DataFrame:
    """The ids of each document and an id 0, cut every ``window``; tails carry their ids, as they may be cut again.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, ids (compressed; null but for tails).
    """
    bounded_batches(docs.sparkSession)
    step = 4 * window

    def run(batches):
        ids_of = TextIds.get(*tokenizer).of
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            start, length, crc, own, total, kept = [], [], [], [], [], []
            for k, (doc_id, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                ids = ids_of(text or "") + b"\0\0\0\0"
                for i in range(0, len(ids), step):
                    part = ids[i : i + step]
                    start.append(i // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    own.append(k)
                    total.append(len(ids) // 4)
                    kept.append(None)
                if len(part) < step:
                    kept[-1] = squeeze(part)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(own, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total)), pa.array(kept, pa.binary())],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
    )


# --- the plan, from the histogram alone ---------------------------------------------------------


def combinations(present: np.ndarray, window: int) -> np.ndarray:
    """Pairs and triples of present lengths that fill the window exactly; unused places hold 0."""
    have = np.zeros(window + 1, bool)
    have[present] = True
    a = np.arange(1, window // 2 + 1)
    pair = a[have[a] & have[window - a]]
    out = [np.stack([window - pair, pair, np.zeros_like(pair)], axis=1)]
    for x in present[present <= window // 3]:
        y = np.arange(x, (window - x) // 2 + 1)
        y = y[have[y] & have[window - x - y]]
        out.append(np.stack([window - x - y, y, np.full_like(y, x)], axis=1))
    return np.concatenate(out)


def solve_repeats(columns: np.ndarray, counts: np.ndarray, batch: int = 256) -> np.ndarray:
    """Non-negative x that brings the sum of x times each column nearest to ``counts``, by greedy coordinate descent.

    Each round takes the columns of steepest descent and minimises exactly over one after another, pairs before all columns: triples
    would use up the short lengths. Every step lowers the sum of squares, so it ends, and it ends where no column
    would change by half a repeat: what is left of the optimality conditions is less than rounding can see. The
    columns taken stay few, so that rounding loses little.
    """
    x = np.zeros(len(columns))
    left = counts.astype(float).copy()
    left[0] = 0
    if not len(columns):
        return x
    twice = (columns[:, 0] == columns[:, 1]).astype(int) + ((columns[:, 1] == columns[:, 2]) & (columns[:, 1] > 0))
    norm = np.where(columns[:, 2] == 0, 2, 3) + np.array([0, 2, 6])[twice]
    for taken in (columns[:, 2] == 0, np.ones(len(columns), bool)):
        while True:
            gain = descent(columns, left, norm, x)
            gain[~taken] = 0
            top = np.argpartition(-np.abs(gain), min(batch, len(gain)) - 1)[:batch]
            top = top[np.argsort(-np.abs(gain[top]), kind="stable")]
            if abs(gain[top[0]]) < 0.5:
                break
            for j in top.tolist():
                parts = [p for p in columns[j].tolist() if p]
                step = max(sum(left[p] for p in parts) / norm[j], -x[j])
                if abs(step) >= 0.25 and taken[j]:
                    x[j] += step
                    for p in parts:
                        left[p] -= step
    return x


def descent(columns: np.ndarray, left: np.ndarray, norm: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How far each column alone would move to its minimum, kept non-negative; all zero at the optimum."""
    return np.maximum(left[columns].sum(axis=1) / norm, -x)


def plan(counts: np.ndarray, window: int = WINDOW) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """(lengths that fill a sequence, repeats), and the counts of the histogram that they leave.

    Repeats are rounded from the largest on, each to one at least and to what the counts still hold. What rounding
    leaves is solved anew as a smaller histogram, until it holds no combination of the solution, and then of any.
    """
    left = counts.astype(np.int64).copy()
    repeats: dict[tuple[int, ...], int] = {}

    def take(column: np.ndarray, want: int) -> int:
        parts = tuple(p for p in column.tolist() if p)
        n = min(want, *(int(left[p]) // parts.count(p) for p in parts))
        if n:
            repeats[parts] = repeats.get(parts, 0) + n
            for p in parts:
                left[p] -= n
        return n

    if left[window]:
        repeats[(window,)] = int(left[window])
        left[window] = 0
    columns = combinations(np.flatnonzero(left[:window]), window)
    placed = 1
    while placed and len(columns):
        x = solve_repeats(columns, left)
        placed = sum(take(columns[j], max(1, round(x[j]))) for j in np.argsort(-x, kind="stable")[: np.count_nonzero(x)].tolist())
        columns = columns[(left[columns] > 0)[:, :2].all(axis=1) & ((left[columns[:, 2]] > 0) | (columns[:, 2] == 0))]
    for j in range(len(columns)):
        take(columns[j], int(left.max()))
    return list(repeats.items()), left


def slots(planned: list[tuple[tuple[int, ...], int]], window: int = WINDOW):
    """Sorted by (length, first rank): key, first rank, first sequence, offset of each place of the plan."""
    used = np.zeros(window + 1, np.int64)
    rows = []
    base = 0
    for parts, n in planned:
        offset = 0
        for p in parts:
            rows.append(((p << 48) + used[p], used[p], base, offset))
            used[p] += n
            offset += p
        base += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def cut_stream(at: int, length: int, base: int, window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """(start, length, sequence, offset) of the parts that a tail at a place of the residual stream falls into."""
    out, done = [], 0
    while done < length:
        nth, offset = divmod(at + done, window)
        n = min(window - offset, length - done)
        out.append((done, n, base + nth, offset))
        done += n
    return out


def pack(docs: DataFrame, tokenizer: tuple, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the single id 0. Rows that repeat a doc_id are packed each on its own;
    a null doc_id is kept as null. Pieces of equal length are ranked by a hash, doc_id and start.
    Other columns of ``docs`` are not read. An empty table gives no row.
    """
    cut = cut_lineage(pieces(docs, tokenizer, window))
    buckets = 1 + cut.count() // BUCKET_ROWS
    salted = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    counts = salted.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    histogram = np.zeros(window + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most a row for each length
        histogram[r["length"]] = r["n"]
    planned, left = plan(histogram, window)
    place, base = slots(planned, window), sum(n for _, n in planned)
    stream = np.concatenate(([0], np.cumsum(left * np.arange(window + 1))))  # where the residual tails of each length begin
    used = histogram - left
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    rank = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(rank) - 1).join(first, ["length", "bucket"])
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    names = [*columns, "sequence_id", "offset"]

    def settle(batches):
        expand = zstandard.ZstdDecompressor().decompress
        for b in batches:
            length, rank = b.column(2).to_numpy(), b.column(5).to_numpy()
            fits = rank < used[length]
            whole = b.filter(pa.array(fits))
            if len(whole):
                at = np.searchsorted(place[:, 0], (length[fits] << 48) + rank[fits], "right") - 1
                sequence = place[at, 2] + rank[fits] - place[at, 1]
                yield pa.RecordBatch.from_arrays([*whole.columns[:5], pa.array(sequence), pa.array(place[at, 3])], names)
            rows = []
            for doc_id, start, n, _, tokens, r, ids in zip(*(c.to_pylist() for c in b.filter(pa.array(~fits)).columns)):
                data = expand(ids)
                for s, k, sequence, offset in cut_stream(int(stream[n]) + (r - int(used[n])) * n, n, base, window):
                    rows.append((doc_id, start + s, k, zlib.crc32(data[4 * s : 4 * (s + k)]), tokens, sequence, offset))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    return ranked.select(*columns, (F.col("first") + F.col("rank")).cast("long").alias("at"), "ids").mapInArrow(tidy(settle), ", ".join(f"{c} long" for c in names))


def public_tokenizer() -> tuple:
    import public_tokenizers

    return (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizer())
