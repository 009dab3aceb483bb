"""Nearest neighbours by largest inner product with an inverted multi-index.

Both halves of the vectors are quantised by their own centroids, and a pair of centroids is a cell of the
index. For a query, cells are visited in the order of their summed distance, smallest first, by a heap over the
two sorted lists of centroids, until enough vectors have been seen; those are ranked by the exact
inner product. Distance is the negative inner product with a centroid. How many are enough depends on the
data: vectors without any structure (the tests' are such) leave no cell that can be passed over safely, and a
recall of 0.9 takes about half of all entries.

Of equal vectors only the ``top + 1`` smallest ids are entries: no other can be among the nearest. Neighbouring cells
form units of at most BLOCK entries, larger cells are cut into parts; a smaller table has smaller units, so that all tasks
have some. A query goes once to each unit that it visits, with a bitmap of the visited cells; each unit keeps its ``top`` per
query, and the rest is a top-k over those.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut_lineage, shuffle_parts, table

TOP = 20
#: Centroids of each half, and vectors that they are fitted on.
CENTROIDS = 64
SAMPLE = 8_192
ROUNDS = 8
#: A query visits cells until it has seen this share of all entries (and enough for its neighbours).
SHARE = 0.55
#: Entries that are ranked together, at most and at least.
BLOCK, SMALL_BLOCK = 8_192, 256
QUERY_EVERY = 20


@dataclass(frozen=True)
class Index:
    """Centroids of the halves and the number of entries of each cell."""

    first: np.ndarray
    second: np.ndarray
    filled: np.ndarray

    def cells(self, x: np.ndarray) -> np.ndarray:
        h = self.first.shape[1]
        return _nearest(x[:, :h], self.first) * len(self.second) + _nearest(x[:, h:], self.second)

    def visit(self, q: np.ndarray, want: int) -> list[int]:
        """Cells in order of summed distance until they hold ``want`` entries; empty cells are passed over."""
        h = self.first.shape[1]
        a, b = -(self.first @ q[:h]), -(self.second @ q[h:])
        i, j = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        a, b = a[i].tolist(), b[j].tolist()
        heap, out, seen = [(a[0] + b[0], 0, 0)], [], 0
        while heap and seen < want:
            _, x, y = heapq.heappop(heap)
            cell = int(i[x]) * len(b) + int(j[y])
            if self.filled[cell]:
                out.append(cell)
                seen += int(self.filled[cell])
            if y + 1 < len(b):
                heapq.heappush(heap, (a[x] + b[y + 1], x, y + 1))
            if y == 0 and x + 1 < len(a):
                heapq.heappush(heap, (a[x + 1] + b[0], x + 1, 0))
        return out


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x @ centroids.T * -2 + (centroids**2).sum(axis=1)).argmin(axis=1)


def centroids(x: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Lloyd's algorithm from a seeded draw; a centroid that loses all its vectors stays where it is."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def entries(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>) of the vectors that take part.

    Those are of the table's most common length (of equally common ones the longest); others have no inner product with them.
    """
    e = F.col("embedding").cast("array<double>")
    bad = F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = F.col("vec_id").isNotNull() & e.isNotNull() & ~bad & F.exists(e, lambda v: v != 0)
    fine = vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(e, lambda v: v + 0.0).alias("embedding"))
    size = F.size("embedding")
    common = fine.groupBy(size.alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return fine.where(size == (common["size"] if common else 0))


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def build(kept: DataFrame, sample: int = SAMPLE, k: int = CENTROIDS):
    """(index, cells): centroids from a bounded sample drawn by a hash of the id, and (cell, vec_id, embedding) of every entry."""
    drawn = kept.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toPandas()
    if not len(drawn):
        return None, None
    x = np.stack([np.asarray(v, float) for v in drawn["embedding"]])
    h = max(1, x.shape[1] // 2)
    first, second = centroids(x[:, :h], k), centroids(x[:, h:], k)
    blank = Index(first, second, np.zeros(len(first) * len(second), np.int64))

    def assign(batches):
        for b in batches:
            if len(b):
                yield pa.RecordBatch.from_arrays([pa.array(blank.cells(_matrix(b.column(1)))), b.column(0), b.column(1)], ["cell", "vec_id", "embedding"])

    cells = cut_lineage(kept.mapInArrow(assign, "cell long, vec_id long, embedding array<double>"))
    filled = blank.filled.copy()
    for r in cells.groupBy("cell").count().collect():  # at most CENTROIDS ** 2 rows
        filled[r["cell"]] = r["count"]
    return Index(first, second, filled), cells


@dataclass(frozen=True)
class Units:
    """Runs of neighbouring cells [low, high) with their number of parts."""

    low: np.ndarray
    high: np.ndarray
    parts: np.ndarray
    of_cell: np.ndarray

    @classmethod
    def of(cls, filled: np.ndarray, block: int) -> Units:
        low, held = [0], 0
        for c, n in enumerate(filled.tolist()):
            if held and held + n > block:
                low.append(c)
                held = 0
            held += n
        low = np.array(low)
        high = np.append(low[1:], len(filled))
        size = np.add.reduceat(filled, low)
        return cls(low, high, np.maximum(1, -(-size // block)), np.repeat(np.arange(len(low)), high - low))


_WORK = "unit int, part int, kind int, vec_id long, embedding array<double>, cell int, cells binary"


def _rank_units(units: Units, top: int):
    """Rows of _WORK sorted by unit, part, kind and id: the ``top`` entries of each query in the cells it visits."""

    def rank(qid, q, masks, own, base, cell, low, high):
        seen = np.unpackbits(np.frombuffer(b"".join(masks), np.uint8).reshape(len(q), -1), axis=1)[:, : high - low].astype(bool)
        s = q @ base.T
        s[~seen[:, cell - low] | (qid[:, None] == own[None])] = -np.inf
        k = min(top, len(own))
        kth = np.partition(s, len(own) - k, axis=1)[:, len(own) - k, None]
        # the matrix product may round otherwise than the score: what nearly ties with the last one stays in
        take = (s >= kth - 1e-9 * np.maximum(1.0, np.where(np.isfinite(kth), np.abs(kth), 1.0))) & np.isfinite(s)
        x, y = np.nonzero(take)
        score = np.einsum("ij,ij->i", q[x], base[y])
        order = np.lexsort((own[y], -score, x))
        x, y, score = x[order], y[order], score[order]
        first = np.concatenate(([0], np.flatnonzero(x[1:] != x[:-1]) + 1)) if len(x) else np.zeros(0, int)
        nth = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))
        keep = nth < top
        return pa.RecordBatch.from_arrays([pa.array(qid[x][keep]), pa.array(own[y][keep]), pa.array(score[keep])], ["query_id", "vec_id", "score"])

    def run(batches):
        at, parts, ready = None, [], None
        for b in batches:
            unit, part, kind, ids = (b.column(k).to_numpy() for k in range(4))
            if not len(ids):
                continue
            x, cell, masks = _matrix(b.column(4)), b.column(5).fill_null(-1).to_numpy(), b.column(6).to_pylist()
            new = (unit[1:] != unit[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])
            cut = [0, *(np.flatnonzero(new) + 1).tolist(), len(ids)]
            for i, j in zip(cut, cut[1:]):
                if (unit[i], part[i]) != at:
                    at, parts, ready = (unit[i], part[i]), [], None
                if kind[i] == 0:
                    parts.append((ids[i:j], x[i:j], cell[i:j]))
                elif parts:
                    if ready is None:
                        ready = [np.concatenate(c) for c in zip(*parts)]
                    own, base, at_cell = ready
                    low, high = int(units.low[unit[i]]), int(units.high[unit[i]])
                    for k in range(i, j, 128):
                        e = min(k + 128, j)
                        yield rank(ids[k:e], x[k:e], masks[k:e], own, base, at_cell, low, high)

    return run


def search(vectors: DataFrame, every: int = QUERY_EVERY, top: int = TOP, share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest found of each query, a row whose id ``every`` divides.

    Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part. Ids are
    expected to be unique: equal rows are one, other rows that repeat an id are candidates each, but a query is asked once, by
    the smallest of its vectors, and never finds its own id. Fewer candidates than ``top``: all of them. An empty table gives
    no row. Other columns are not read.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    usable = entries(vectors)
    # of equal vectors only the smallest top + 1 ids can be found
    alike = Window.partitionBy("embedding").orderBy("vec_id")
    kept = cut_lineage(usable.distinct().withColumn("r", F.row_number().over(alike)).where(F.col("r") <= top + 1).drop("r"))
    index, cells = build(kept)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    total = int(index.filled.sum())
    want = max(math.ceil(share * total), 2 * top + 2)
    queries = usable.where(F.pmod(F.col("vec_id"), F.lit(every)) == 0).repartition(shuffle_parts(spark), "vec_id")  # visiting cells is work, not bytes
    asked = queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    units = Units.of(index.filled, min(BLOCK, max(SMALL_BLOCK, total // shuffle_parts(spark))))
    shared = spark.sparkContext.broadcast((index, units))  # bounded by CENTROIDS

    def visit(batches):
        own, cut = shared.value
        for b in batches:
            x = _matrix(b.column(1))
            rows: list[tuple] = []
            for k in range(len(b)):
                seen = np.zeros(len(own.filled), bool)
                seen[own.visit(x[k], want)] = True
                for u in np.unique(cut.of_cell[seen]).tolist():
                    mask = np.packbits(seen[cut.low[u] : cut.high[u]]).tobytes()
                    rows += [(u, part, k, mask) for part in range(int(cut.parts[u]))]
                if len(rows) > 5_000 or k == len(b) - 1:
                    unit, part, row, mask = zip(*rows)
                    at = pa.array(row, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(unit, pa.int32()), pa.array(part, pa.int32()), b.column(0).take(at), b.column(1).take(at), pa.array(mask, pa.binary())],
                        ["unit", "part", "vec_id", "embedding", "cells"],
                    )
                    rows = []

    def deal(batches):
        _, cut = shared.value
        for b in batches:
            cell = b.column(0).to_numpy()
            unit = cut.of_cell[cell]
            part = (b.column(1).to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % cut.parts[unit]
            yield pa.RecordBatch.from_arrays(
                [pa.array(unit.astype(np.int32)), pa.array(part.astype(np.int32)), b.column(1), b.column(2), pa.array(cell.astype(np.int32))],
                ["unit", "part", "vec_id", "embedding", "cell"],
            )

    probes = asked.select("vec_id", "embedding").mapInArrow(visit, "unit int, part int, vec_id long, embedding array<double>, cells binary")
    held = cells.mapInArrow(deal, "unit int, part int, vec_id long, embedding array<double>, cell int")
    none = {"cell": F.lit(None).cast("int"), "cells": F.lit(None).cast("binary")}
    names = [c.split()[0] for c in _WORK.split(", ")]
    both = held.withColumns({"kind": F.lit(0), "cells": none["cells"]}).select(*names).union(
        probes.withColumns({"kind": F.lit(1), "cell": none["cell"]}).select(*names)
    )
    dealt = both.repartition(shuffle_parts(spark), "unit", "part").sortWithinPartitions("unit", "part", "kind", "vec_id")
    found = dealt.mapInArrow(_rank_units(units, top), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op10_multi_index(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
