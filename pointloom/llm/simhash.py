"""SimHash near-duplicates: exact Hamming links found by tiled numpy comparison.

Fingerprints of equal value are one node. Two nodes within the radius agree on at least
``BLOCKS - RADIUS`` of the blocks that the 64 bits are cut into, so each node is dealt to one
bucket per choice of that many blocks, and a bucket is compared exactly: it is sorted by
population count, cut into tiles, and a pair of tiles is skipped when the population counts
differ by more than the radius. Buckets above ``TILE_ROWS`` are dealt as tile pairs to many
tasks. A task reports a spanning forest of its links rather than the pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut_lineage, shuffle_parts, table, tidy, unused
from .components import connected_components

SHINGLE_WORDS = 4
SEED = 42
RADIUS = 4
BLOCKS = 6
TILE_ROWS = 2048


def fingerprint(text: str | None, words_per_shingle: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Unsigned fingerprint of a whole text; 0 if it has no word."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return 0
    line = b" ".join(words)
    if n <= words_per_shingle:
        return xxhash.xxh64_intdigest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    stop = ends[words_per_shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[s:e], seed) for s, e in zip(starts.tolist(), stop)), "<u8", len(stop))
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 65_536):
        bits = np.unpackbits(h[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words_per_shingle: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp long) for each row; a null text counts as empty."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, words_per_shingle, seed) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), "doc_id long, fp long")


def block_masks(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """Bit masks, one per choice of ``blocks - radius`` blocks; nodes in the radius agree on one of them."""
    cuts = [round(i * 64 / blocks) for i in range(blocks + 1)]
    part = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    masks = [sum(c) for c in combinations(part, blocks - radius)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def forest(fps: np.ndarray, radius: int, tile: int = 512) -> np.ndarray:
    """Spanning links (n, 2) of the distinct fingerprints that lie within the radius."""
    pop = np.bitwise_count(fps).astype(np.int16)
    order = np.argsort(pop, kind="stable")
    fps, pop = fps[order], pop[order]
    root = np.arange(len(fps))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = []
    for i in range(0, len(fps), tile):
        a, high = fps[i : i + tile], int(pop[min(i + tile, len(fps)) - 1])
        for j in range(i, len(fps), tile):
            if int(pop[j]) - high > radius:  # population counts too far apart; so are all later tiles
                break
            near = np.bitwise_count(a[:, None] ^ fps[None, j : j + tile]) <= radius
            for x, y in zip(*(k.tolist() for k in np.nonzero(near))):
                x, y = x + i, y + j
                if x < y and (p := find(x)) != (q := find(y)):
                    root[max(p, q)] = min(p, q)
                    links.append((fps[x], fps[y]))
    return np.array(links, np.uint64).reshape(-1, 2)


def _small_buckets(keys: np.ndarray, fps: np.ndarray, radius: int) -> list[np.ndarray]:
    """Links of many buckets at once; ``keys`` is sorted."""
    cut = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    size = np.diff(cut)
    out = []
    low = (size > 1) & (size <= 16)
    take = np.repeat(low, size)
    f, k = fps[take], keys[take]
    for shift in range(1, int(size[low].max(initial=1))):
        same = k[shift:] == k[:-shift]
        near = same & (np.bitwise_count(f[shift:] ^ f[:-shift]) <= radius)
        at = np.flatnonzero(near)
        out.append(np.stack([f[at], f[at + shift]], axis=1))
    for i in np.flatnonzero(size > 16):
        out.append(forest(fps[cut[i] : cut[i + 1]], radius))
    return out


def _compare(radius: int):
    """mapInArrow over rows (key, fp) sorted by key: links of each run of equal keys."""

    def run(batches):
        keep_k, keep_f = np.empty(0, np.int64), np.empty(0, np.uint64)

        def emit(k, f):
            found = _small_buckets(k, f, radius) if len(k) else []
            e = np.concatenate(found) if found else np.empty((0, 2), np.uint64)
            a, b = np.minimum(e[:, 0], e[:, 1]).view(np.int64), np.maximum(e[:, 0], e[:, 1]).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for x in batches:
            k = np.concatenate([keep_k, x.column(0).to_numpy()])
            f = np.concatenate([keep_f, x.column(1).to_numpy().view(np.uint64)])
            last = int(np.searchsorted(k == k[-1], True)) if len(k) else 0
            yield emit(k[:last], f[:last])
            keep_k, keep_f = k[last:], f[last:]
        yield emit(keep_k, keep_f)

    return run


def near_links(nodes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links (a, b) among the distinct fingerprints of ``nodes(fp)`` whose components are those of all pairs in the radius."""
    spark = nodes.sparkSession
    n = shuffle_parts(spark)
    masks = F.array(*[F.lit(m).cast("long") for m in block_masks(radius, blocks)])
    dealt = nodes.select("fp", F.posexplode(masks).alias("i", "mask")).select(
        "fp", F.xxhash64("i", F.col("fp").bitwiseAND(F.col("mask"))).alias("key")
    )
    hot = dealt.groupBy("key").count().where(F.col("count") > tile_rows).select("key", "count")
    marked = dealt.join(hot, "key", "left")
    plain = marked.where("count is null").select("key", "fp")
    # A large bucket becomes tiles (population count, part); a pair of tiles in the radius is one unit of work.
    parts = F.ceil(F.col("count") / F.lit(tile_rows)).cast("int")
    tiled = marked.where("count is not null").select(
        "key", "fp", parts.alias("parts"), F.bit_count("fp").alias("pop"), F.pmod(F.xxhash64("fp"), parts).cast("int").alias("part")
    )
    mates = F.explode(F.expr(f"transform(sequence(0, {2 * radius}), d -> pop - {radius} + d)")).alias("other_pop")
    pairs = (
        tiled.select("*", mates)
        .select("*", F.explode(F.expr("sequence(0, parts - 1)")).alias("other_part"))
        .select(
            F.xxhash64(
                "key",
                F.least(F.struct("pop", "part"), F.struct(F.col("other_pop").alias("pop"), F.col("other_part").alias("part"))),
                F.greatest(F.struct("pop", "part"), F.struct(F.col("other_pop").alias("pop"), F.col("other_part").alias("part"))),
            ).alias("key"),
            "fp",
        )
    )
    bounded_batches(spark)
    work = plain.union(pairs).repartition(n, "key").sortWithinPartitions("key", "fp")
    return work.mapInArrow(tidy(_compare(radius)), "a long, b long")


def near_duplicates(docs: DataFrame, words_per_shingle: int = SHINGLE_WORDS, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``.

    component_id is the smallest doc_id reachable over links of at most ``radius`` differing bits.
    Null and wordless texts have fingerprint zero and are linked like any other. A null doc_id takes
    part in links but is never the smallest; if a component has only null ids, component_id is null.
    Repeated rows are returned as often as they occur. Other columns of ``docs`` are not read.
    """
    fps = cut_lineage(fingerprints(docs, words_per_shingle, seed))
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    comp = connected_components(near_links(nodes.select("fp"), radius))
    rooted = nodes.join(comp, nodes.fp == comp.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    of = rooted.join(ids, "root").select("fp", "component_id")
    return fps.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` without all but one of each component: the one with the smallest doc_id.

    Repeated rows (same doc_id and text) become one. Rows with a null doc_id cannot be ordered: only
    exact copies among them become one.
    """
    return first_rows(docs, near_duplicates(docs, **params))


def first_rows(docs: DataFrame, of: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``of(doc_id, component_id)`` names first, each once, and those with a null doc_id."""
    name, own, before = unused(docs, "first", "own", "before")
    first = of.where("doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    named = docs.where("doc_id is not null").join(first, F.col("doc_id") == F.col(name), "left_semi")

    def once(rows: DataFrame, by: str) -> DataFrame:
        """One row of those that ``by`` and the text agree in; by doc_id, rows stay where the join has put them."""
        w = Window.partitionBy(by).orderBy(own, "source", "lang")
        marked = rows.withColumn(own, F.xxhash64("text")).withColumn(before, F.lag(own).over(w))
        return marked.where(F.col(before).isNull() | (F.col(before) != F.col(own))).drop(own, before)

    return once(named, "doc_id").unionByName(once(docs.where("doc_id is null"), own))


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
