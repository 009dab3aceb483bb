"""Near-copies by similarity: operator 7's tiled comparison for texts of a Jaccard similarity of 0.8 or more on five-word shingles.

Texts come to be compared in two ways. Operator 7 links the fingerprints of the texts' five-word shingles, at NEAR bits instead
of its four, through buckets of agreeing blocks that are compared exactly; the texts of a component share a bucket here.
At a similarity of 0.8 two 64-bit fingerprints differ in ten bits or so and at times in twenty, which no choice of agreeing
blocks can find without comparing nearly all pairs. So texts meet in buckets of another kind too, bands of minimum
hashes: texts of similarity s share one with probability ``1 - (1 - s**ROWS)**BANDS``, above 0.9999 at 0.8. What shares
buckets forms groups; a group within LOAD is one unit of work, a larger one is compared bucket by bucket, and a bucket
beyond LOAD as pairs of tiles. So every two texts of a bucket are compared, however many there are.

In a unit, texts are sorted by their number of shingles, cut into tiles, and a pair of tiles is skipped when the numbers
differ beyond what the similarity allows. Pairs whose fingerprints differ in at most RADIUS bits (exclusive-or and bit
counts) are compared by the exclusive-or of their whole shingle sets, as bit sets over the shingles that the tiles share;
pairs that are connected already are not. A task reports a spanning forest of its links, not the pairs. Many texts that share
bands and are not similar cost the square of their number in comparisons, but no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import bounded_batches, cut_lineage, drop_checkpoint, shuffle_parts, tidy
from .components import connected_components
from .hashing import PrefixHashes, mix

SHINGLE_WORDS = 5
#: Least similarity as a fraction, so that comparing is exact.
SIMILAR = (4, 5)
#: Fingerprint bits in which operator 7's links may differ here, and its blocks.
NEAR = 6
BLOCKS = 8
BANDS = 20
ROWS = 4
SEED = 42
#: Fingerprint bits in which similar texts may differ: at 0.8 about ten do, and more than 24 once in a million pairs.
RADIUS = 24
#: Shingles (8 bytes each) and texts of one unit of work.
LOAD = 1 << 20
TEXTS = 4096
#: Bytes of a text whose shingles are hashed together.
SPAN = 1 << 17
#: Texts and shingles of a tile.
TILE = 256
TILE_LOAD = 1 << 18

_RNG = np.random.default_rng(SEED)
_BASES = tuple(int(x) | 1 for x in _RNG.integers(1 << 62, 1 << 63, 2, np.uint64))
_MULTIPLY = _RNG.integers(0, 2**32, BANDS * ROWS, np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 2**32, BANDS * ROWS, np.uint32)


def line_of(text: str | None) -> bytes:
    """The words of a text in lower case, with one space between."""
    return b" ".join((text or "").encode().lower().split())


def shingles(line: bytes) -> np.ndarray:
    """Sorted distinct hashes of the shingles (two polynomial hashes folded into one); a line of fewer words is one shingle.

    Long lines go through in parts of about SPAN bytes; shingles of more than a part's share of bytes have a hash of their own.
    """
    data = np.frombuffer(line + b" ", np.uint8)
    ends = np.flatnonzero(data == 32)  # one past each word
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(ends) > SHINGLE_WORDS:
        starts, ends = starts[: len(ends) - SHINGLE_WORDS + 1], ends[SHINGLE_WORDS - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    out, size = np.zeros(len(starts), np.uint64), ends - starts
    for k in np.flatnonzero(size > SPAN // 8).tolist():
        out[k] = xxhash.xxh64_intdigest(line[starts[k] : ends[k]], SEED)
    rest = np.flatnonzero(size <= SPAN // 8)
    i = 0
    while i < len(rest):
        low = int(starts[rest[i]])
        part = rest[i : int(np.searchsorted(ends[rest], low + SPAN, "right"))]
        a, b = (PrefixHashes(data[low : ends[part[-1]]], np.uint64(base)).of(starts[part] - low, size[part]) for base in _BASES)
        out[part] = mix(a) ^ mix(mix(b) + size[part].astype(np.uint64))
        i += len(part)
    return np.unique(out)


def bands(grams: np.ndarray) -> np.ndarray:
    """One signed key per band."""
    low = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    small = (grams >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(small), 512):
        np.minimum(low, (small[i : i + 512, None] * _MULTIPLY + _ADD).min(axis=0), out=low)
    key = np.zeros(BANDS, np.uint64)
    for row in low.reshape(BANDS, ROWS).T:
        key = mix(key * np.uint64(_BASES[0]) + row)
    return mix(key + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def fingerprint(grams: np.ndarray) -> np.uint64:
    """The bits that are set in over half of the hashes."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(grams), 65_536):
        total += np.unpackbits(grams[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(total * 2 > len(grams), bitorder="little").view("<u8")[0]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two shingle sets have the least similarity."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * SIMILAR[1] >= (len(a) + len(b) - both) * SIMILAR[0]


def _node(line: bytes) -> int:
    return xxhash.xxh64_intdigest(line, SEED + 1) - 2**63


# --- the tiled comparison ---------------------------------------------------------------------------


def _too_far(less: int, more: int) -> bool:
    """Whether sets of these sizes cannot be similar: then the larger one alone has too much."""
    return less * SIMILAR[1] < more * SIMILAR[0]


def _bits(sets: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
    """Bit sets of ``sets`` over sorted ``columns``; what is in no column is left out."""
    out = np.zeros((len(sets), -(-len(columns) // 64) * 64 if len(columns) else 64), bool)
    for k, s in enumerate(sets if len(columns) else []):  # texts near by their fingerprints may share no shingle
        at = np.searchsorted(columns, s)
        at[at == len(columns)] = 0
        out[k, at[columns[at] == s]] = True
    return np.packbits(out, axis=1, bitorder="little").view("<u8")


def _tiles(size: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of runs of at most TILE texts and about TILE_LOAD shingles."""
    out, i = [], 0
    held = np.cumsum(size)
    while i < len(size):
        j = int(np.searchsorted(held, (held[i - 1] if i else 0) + TILE_LOAD, "right"))
        j = min(len(size), max(i + 1, min(j, i + TILE)))
        out.append((i, j))
        i = j
    return out


def similar_forest(sets: list[np.ndarray], side: np.ndarray | None = None, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Spanning links (places in ``sets``) of the pairs that are similar; with ``side`` only pairs across sides are compared."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    order = np.argsort(size, kind="stable")
    sets = [sets[k] for k in order.tolist()]
    size = size[order]
    side = None if side is None else side[order]
    fps = np.array([fingerprint(s) for s in sets], np.uint64)
    root = np.arange(len(sets))
    links = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    tiles = _tiles(size)
    for p, (i, j) in enumerate(tiles):
        for k, m in tiles[p:]:
            if _too_far(int(size[j - 1]), int(size[k])):
                break
            near = np.bitwise_count(fps[i:j, None] ^ fps[None, k:m]) <= radius
            near &= size[i:j, None] * SIMILAR[1] >= size[None, k:m] * SIMILAR[0]
            if i == k:
                near &= np.tri(j - i, k=-1, dtype=bool).T
            if side is not None:
                near &= side[i:j, None] != side[None, k:m]
            of = np.array([find(x) for x in range(i, j)]), np.array([find(y) for y in range(k, m)])
            near &= of[0][:, None] != of[1][None]
            if not near.any():
                continue
            rows, cols = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
            left, right = [sets[i + x] for x in rows.tolist()], [sets[k + y] for y in cols.tolist()]
            columns = np.intersect1d(np.concatenate(left), np.concatenate(right))
            a, b = _bits(left, columns), _bits(right, columns)
            na, nb = np.bitwise_count(a).sum(axis=1, dtype=np.int64), np.bitwise_count(b).sum(axis=1, dtype=np.int64)
            for x, row in enumerate(rows.tolist()):
                y = np.flatnonzero(near[row, cols])
                differ = np.bitwise_count(b[y] ^ a[x]).sum(axis=1, dtype=np.int64)
                both = (na[x] + nb[y] - differ) // 2
                total = size[i + row] + size[k + cols[y]] - both
                for hit in y[both * SIMILAR[1] >= total * SIMILAR[0]].tolist():
                    u, v = i + row, k + int(cols[hit])
                    if (c := find(u)) != (d := find(v)):
                        root[max(c, d)] = min(c, d)
                        links.append((int(order[u]), int(order[v])))
    return links


def _compare(batches):
    """Rows (unit, side, node, line) sorted by unit: links of each unit. Side is null where all of a unit is compared."""
    expand = zstandard.ZstdDecompressor().decompress

    def emit(side: list, nodes: list[int], lines: list[bytes]):
        two = None if side[0] is None else np.array(side)
        found = similar_forest([shingles(expand(x)) for x in lines], two) if len(nodes) > 1 else []
        pairs = [sorted((nodes[a], nodes[b])) for a, b in found]
        a, b = zip(*pairs) if pairs else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    at, held = None, ([], [], [])
    for x in batches:
        for unit, *row in zip(*(c.to_pylist() for c in x.columns)):
            if unit != at:
                if held[1]:
                    yield emit(*held)
                at, held = unit, ([], [], [])
            for of, value in zip(held, row):
                of.append(value)
    if held[1]:
        yield emit(*held)


# --- steps on DataFrames ----------------------------------------------------------------------------


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, node, n, fp, keys) for each row: the text's node, its number of shingles, its fingerprint and its bands.

    Rows of equal words are one node; what follows it is given once in a task and null on later rows.
    """

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            nodes, sizes, fps, keys = [], [], [], []
            for text in b.column(1).to_pylist():
                line = line_of(text)
                nodes.append(node := _node(line))
                if node in seen:
                    sizes.append(None)
                    fps.append(None)
                    keys.append(None)
                else:
                    seen.add(node)
                    grams = shingles(line)
                    sizes.append(len(grams))
                    fps.append(int(fingerprint(grams).view(np.int64)))
                    keys.append(bands(grams))
            cols = [b.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "node", "n", "fp", "keys"])

    bounded_batches(docs.sparkSession)
    wanted = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return wanted.mapInArrow(tidy(run), "doc_id long, node long, n long, fp long, keys array<long>")


def _lines(docs: DataFrame, sketched: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, line) of the nodes in ``wanted``, compressed; only rows that are first of their node in a task are read again."""

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            lines = [line_of(t) for t in b.column(0).to_pylist()]
            cols = [pa.array(map(_node, lines), pa.int64()), pa.array(map(squeeze, lines), pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["node", "line"])

    ids = sketched.where("keys is not null").join(wanted, "node", "left_semi").select(F.col("doc_id").alias("id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    each = texts.join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select("text").mapInArrow(tidy(run), "node long, line binary")
    return each.join(wanted, "node", "left_semi").dropDuplicates(["node"])


def units(held: DataFrame, groups: DataFrame, load: int = LOAD, texts: int = TEXTS) -> DataFrame:
    """(unit, side, node): who is compared with whom, from held(key, node, n) and groups(node, root).

    Every two nodes that share a key meet in a unit, which holds at most about ``load`` shingles and ``texts`` texts
    (or one text); larger buckets are dealt as pairs of tiles.
    """
    weight = [F.sum("n").alias("w"), F.count("*").alias("c")]
    over = (F.col("w") > load) | (F.col("c") > texts)
    of = held.select("node", "n").distinct().join(groups, "node")
    large = of.groupBy("root").agg(*weight).where(over).select("root")
    none = F.lit(None).cast("int").alias("side")
    small = of.join(large, "root", "left_anti").select(F.xxhash64(F.lit(0), "root").alias("unit"), none, "node")
    rest = held.join(groups.join(large, "root", "left_semi").select("node"), "node", "left_semi")
    hot = rest.groupBy("key").agg(*weight).where(over).select("key")
    plain = rest.join(hot, "key", "left_anti").select(F.xxhash64(F.lit(1), "key").alias("unit"), none, "node")
    # sizes of similar texts lie in one class or in neighbours; a class is cut into tiles by a hash of the node
    kind = F.floor(F.log(F.col("n").cast("double")) / F.lit(0.2232))
    classed = rest.join(hot, "key", "left_semi").withColumn("class", kind)
    cut = F.greatest(F.ceil(F.col("w") / F.lit(load // 2)), F.ceil(F.col("c") / F.lit(max(1, texts // 2)))).cast("int")
    parts = classed.groupBy("key", "class").agg(*weight).select("key", "class", cut.alias("parts"))
    mates = parts.select("key", F.explode(F.array(*[F.col("class") + k for k in (-1, 0, 1)])).alias("class"), F.col("class").alias("other"), F.col("parts").alias("others"))
    tiled = classed.join(parts, ["key", "class"]).join(mates, ["key", "class"])
    tiled = tiled.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("of", F.explode(F.expr("sequence(0, others - 1)")))
    mine, theirs = F.struct("class", "part"), F.struct(F.col("other").alias("class"), F.col("of").alias("part"))
    pairs = tiled.select(
        F.xxhash64(F.lit(2), "key", F.least(mine, theirs), F.greatest(mine, theirs)).alias("unit"),
        F.when(mine != theirs, (mine > theirs).cast("int")).alias("side"),
        "node",
    )
    return small.union(plain).union(pairs)


def fingerprint_keys(sketched: DataFrame, radius: int = NEAR, blocks: int = BLOCKS) -> DataFrame:
    """(node, n, key) for each sketched node: the key names the component of its fingerprint over links of at most ``radius`` bits."""
    rows = sketched.where("keys is not null").select("node", "n", "fp")
    found = simhash.near_links(rows.select("fp").distinct(), radius, blocks)
    comp = connected_components(found).select(F.col("node").alias("of"), "root")
    return rows.join(comp, F.col("fp") == F.col("of"), "left").select("node", "n", F.xxhash64(F.lit(3), F.coalesce("root", "fp")).alias("key"))


def links(docs: DataFrame, sketched: DataFrame, load: int = LOAD, texts: int = TEXTS) -> DataFrame | None:
    """(node, root) of the nodes that are similar to another, or None where no two texts share a bucket."""
    spark = docs.sparkSession
    rows = sketched.where("keys is not null").select("node", "n", F.explode("keys").alias("key")).union(fingerprint_keys(sketched))
    shared = rows.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key", "low")
    held = cut_lineage(rows.join(shared, "key").distinct())
    if held.isEmpty():
        return None
    stars = held.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    work = cut_lineage(units(held.drop("low"), connected_components(stars), load, texts))
    lines = _lines(docs, sketched, work.select("node").distinct())
    bounded_batches(spark)
    dealt = work.join(lines, "node").select("unit", "side", "node", "line").repartition(shuffle_parts(spark), "unit").sortWithinPartitions("unit")
    found = cut_lineage(dealt.mapInArrow(tidy(_compare), "a long, b long"))
    out = connected_components(found)
    drop_checkpoint(held, work, found)
    return out


def near_copies(docs: DataFrame, load: int = LOAD, texts: int = TEXTS) -> DataFrame:
    """(doc_id, component_id) for each row: the smallest doc_id reachable over links of similarity 0.8 or more.

    Texts of equal words are alike, null and wordless ones among themselves; a text of fewer than five words is
    like equal ones only. Null doc_ids take part in links but are never the smallest. Other columns are not read.
    """
    rows = cut_lineage(sketches(docs))
    comp = links(docs, rows, load, texts)
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("low"))
    if comp is None:
        of = nodes.select("node", F.col("low").alias("component_id"))
    else:
        rooted = nodes.join(comp, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
        ids = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
        of = rooted.join(ids, "root").select("node", "component_id")
    return rows.select("doc_id", "node").join(of, "node").select("doc_id", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without all but one of each component, as ``simhash.keep_one`` keeps them."""
    return simhash.first_rows(docs, near_copies(docs))
