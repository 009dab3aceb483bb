"""Suffix-array removal of repeated byte passages.

A byte is removed when a ``length``-byte string that covers it also starts earlier (smaller
doc_id, or the same document further left). The work is done in four steps.

1. Anchors. Every string of ``length`` bytes is represented by the gram of ``GRAM`` bytes with the
   smallest mixed hash among those it contains (leftmost on ties). Equal strings have equal anchors
   at equal places, so only strings below one anchor need comparing. All starts that share an
   anchor form its context: the bytes from the first start to the end of the last string.
2. Equal contexts are settled by order alone: all but the first are removed. Each task does so for its own rows
   before the shuffle. Contexts are equal here when 96 bits of their digests are, beside the anchor's 64 bits; their bytes are
   not compared again.
3. Different contexts below one anchor are compared as suffixes: a mergesort whose comparisons find
   the common extension of two suffixes by binary search over prefix polynomial hashes. Neighbours
   that agree on ``length`` bytes are one class, verified byte by byte; all but the earliest of a
   class are removed. A string that two contexts share has ``length - gram`` bytes beside the anchor, and both contexts agree
   on those to its left and to its right; suffixes of which a context agrees with no other one that far on either side are
   not sorted. The starts of an anchor with very many contexts are dealt anew: strings that begin within ``BIN`` bytes, seen from
   the anchor, have all but ``BIN - 1`` of their bytes in common places, and only contexts that agree on these are compared.
   Where even these are very many they are cut into blocks; what survives in the blocks is settled by the smallest start per
   class, a 128-bit digest of its bytes.
4. The removed spans of a document are joined, and its remaining bytes are what is kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, cut_lineage, shuffle_parts, table, tidy
from .hashing import BASES, PrefixHashes, mix

LENGTH = 100
GRAM = 24
#: Starts of a text that are looked at together, and the bits that hold a place among them.
CHUNK = 1 << 18
PLACE = np.uint64((1 << 24) - 1)
#: Contexts that are sorted together; of an anchor that has more, the starts are dealt anew in bins of so many.
BLOCK_CONTEXTS = 1024
BIN = 11
MULTIPLIERS = tuple(np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3))


def window_minimum(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    out, have = h, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def digests(parts) -> np.ndarray:
    """128-bit digests of byte strings, as rows of two numbers."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, parts)), "<u8").reshape(-1, 2)


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """For each anchor of the text: (hash, 64 and 32 bits of the context's digest, first start, number of starts, gram's place from there).

    Longer texts go through in chunks that overlap; a context cut at a chunk's end differs from whole
    ones with the same anchor and so is compared with them.
    """
    if len(data) < length:
        return None
    found = [
        _anchors(data[i : i + CHUNK + length - 1], i, length, gram)
        for i in range(0, len(data) - length + 1, CHUNK)
    ]
    return tuple(np.concatenate(x) for x in zip(*found))


def _anchors(data: np.ndarray, offset: int, length: int, gram: int):
    n = len(data)
    view = memoryview(data)
    words = np.ndarray((n - 7,), "<u8", view, 0, (1,))  # the eight bytes from each place
    grams = n - gram + 1
    h = words[:grams] * BASES[0]
    for i in range(8, gram, 8):
        h ^= words[min(i, gram - 8) :][:grams] * MULTIPLIERS[i // 8 % len(MULTIPLIERS)]
    h = (h ^ (h >> np.uint64(32))) * BASES[1]
    # the place in the low bits makes the leftmost of equal hashes the smallest
    h = (h & ~PLACE) | np.arange(grams, dtype=np.uint64)
    at = window_minimum(h, length - gram + 1)
    at = at.astype(np.int64) & int(PLACE)
    first = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
    place = at[first]
    count = np.diff(first, append=len(at))
    ends = (first + count + (length - 1)).tolist()
    digest = xxhash.xxh64_intdigest
    context = digests(view[x:y] for x, y in zip(first.tolist(), ends))
    anchor = np.fromiter((digest(view[x : x + gram]) for x in place.tolist()), np.uint64, len(first))
    place = place - first
    return anchor, context[:, 0] ^ mix((place * 131 + count).astype(np.uint64)), context[:, 1] >> np.uint64(32), first + offset, count, place


# --- the hash-compared suffix sort ------------------------------------------------------------


def common_extension(h: PrefixHashes, x: np.ndarray, y: np.ndarray, limit: int) -> np.ndarray:
    """Length of the common prefix of suffixes x and y, up to ``limit``, by binary search on hashes."""
    lo = np.zeros(len(x), np.int64)
    hi = np.full(len(x), limit, np.int64)
    for _ in range(int(limit).bit_length()):
        mid = (lo + hi + 1) >> 1
        same = h.of(x, mid) == h.of(y, mid)
        lo = np.where(same, mid, lo)
        hi = np.where(same, hi, mid - 1)
    return lo


def suffix_sort(data: np.ndarray, starts: np.ndarray, group: np.ndarray, limit: int):
    """Mergesort of suffixes within each group: (order, common prefix with the one before).

    Suffixes are ordered by their first ``limit`` bytes, equal ones as given. ``group`` is sorted; all
    groups merge at once, so a level costs a few array operations. Each comparison takes a
    logarithmic number of hash tests. Neighbours taken as equal are verified by their bytes, and a
    group in which hashes collide is sorted by its bytes instead.
    """
    h = PrefixHashes(data)
    n = len(starts)
    cut = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True]))) if n else np.zeros(1, int)
    begin = np.repeat(cut[:-1], np.diff(cut))
    end = np.repeat(cut[1:], np.diff(cut))
    order = np.arange(n)
    place = np.arange(n)
    longest = int(np.diff(cut).max(initial=0))
    width = 1

    def less(a: np.ndarray, b: np.ndarray, or_equal: bool) -> np.ndarray:
        x, y = starts[a], starts[b]
        ext = common_extension(h, x, y, limit)
        full = ext >= limit
        inner = np.minimum(ext, limit - 1)
        return np.where(full, or_equal, data[x + inner] < data[y + inner])

    while width < longest:
        run = (place - begin) // width
        left = run % 2 == 0
        mate = np.where(left, begin + (run + 1) * width, begin + (run - 1) * width)
        lo = np.minimum(mate, end)
        hi = np.minimum(mate + width, end)
        base = lo.copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            me, it = order[live], order[mid]
            # an element of the left run goes before equal ones of the right run
            before = np.where(left[live], less(it, me, False), less(it, me, True))
            lo[live] = np.where(before, mid + 1, lo[live])
            hi[live] = np.where(before, hi[live], mid)
            live = live[lo[live] < hi[live]]
        pair = begin + (run // 2) * 2 * width
        own = place - (begin + run * width)
        target = pair + own + (lo - base)
        merged = np.empty_like(order)
        merged[target] = order
        order = merged
        width *= 2
    same = np.zeros(n, bool)
    if n > 1:
        near = np.flatnonzero(group[1:] == group[:-1]) + 1
        x, y = starts[order[near]], starts[order[near - 1]]
        claim = common_extension(h, x, y, limit) >= limit
        true = np.zeros(len(near), bool)
        reach = np.arange(limit)
        for i in range(0, len(near), 4_096):
            part = slice(i, i + 4_096)
            true[part] = (data[x[part, None] + reach] == data[y[part, None] + reach]).all(axis=1)
        same[near] = true
        for g in np.unique(group[near[claim != true]]).tolist():  # hashes collided
            s, e = np.searchsorted(group, [g, g + 1])
            own = sorted(range(s, e), key=lambda i: data[starts[i] : starts[i] + limit].tobytes())
            order[s:e] = own
            text = [data[starts[i] : starts[i] + limit].tobytes() for i in own]
            same[s:e] = [False] + [a == b for a, b in zip(text, text[1:])]
    return order, same


# --- steps on DataFrames ------------------------------------------------------------------------

def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def _record(names: str, *arrays) -> pa.RecordBatch:
    kinds = [x.split()[1] for x in names.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    cast = {"long": np.int64, "int": np.int32, "boolean": bool}
    made = [pa.array(x.astype(cast[k]) if k in cast else x, types[k]) for x, k in zip(arrays, kinds)]
    return pa.RecordBatch.from_arrays(made, [x.split()[0] for x in names.split(", ")])


#: What the first step tells, packed, as these are the most rows: an anchor (kind 0) with its start, number of starts and place,
#: or a span that is removed already (kind 1) with its ends.
_FOUND = "a long, c long, kind_e long, doc_id long, where long"


def _pack(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (high.astype(np.int64) << 32) | low.astype(np.int64)


def _unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return packed >> 32, packed & 0xFFFFFFFF


#: Anchors that a task gathers before it settles equal contexts among them.
_GATHER = 120_000


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """Marks the rows, sorted by ``keys``, that differ from the one before."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _find(length: int, gram: int):
    """Anchors of each text; of equal contexts that meet in a task only the first goes on."""
    if length >= 1 << 16:
        raise ValueError("strings of less than 65,536 bytes are looked for")

    def settle(parts):
        a, c, e, d, s, n, p = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((s, d, e, c, a))
        a, c, e, d, s, n, p = (x[order] for x in (a, c, e, d, s, n, p))
        go = _first_of(a, c, e)
        row = _first_of(a, c, e, d, s)  # a repeated row of the input is the same place
        gone = row & ~go
        doc, lo, hi = merge_spans(d[gone], s[gone], s[gone] + n[gone] + length - 1)
        zero = np.zeros(len(lo), np.int64)
        anchor = (a[go].view(np.int64), c[go].view(np.int64), e[go].astype(np.int64), d[go], _pack(s[go], (n[go] << 16) | p[go]))
        span = (zero, zero, _pack(zero + 1, zero), doc, _pack(lo, hi))
        return _record(_FOUND, *(np.concatenate(x) for x in zip(anchor, span)))

    def run(batches):
        parts: list[tuple] = []
        held = 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = anchors(np.frombuffer(text or b"", np.uint8), length, gram)
                if found is not None:
                    a, c, e, first, count, place = found
                    parts.append((a, c, e, np.full(len(a), doc_id, np.int64), first, count, place))
                    held += len(a)
                    if held >= _GATHER:
                        yield settle(parts)
                        parts, held = [], 0
        if parts:
            yield settle(parts)

    return run


_GROUPED = "doc_id long, start int, n int, place int, lo int, hi int, block long, hot boolean"


def _group(length: int, block_contexts: int):
    """Rows of _FOUND sorted by (a, c, kind_e, doc_id, where): spans of repeated contexts, and the contexts that must be compared.

    At most ``block_contexts`` rows are held: an anchor's contexts are told once it has a second one,
    and go out, marked hot, as soon as they are more than that.
    """

    def tell(rows, hot):
        a, d, s, n, p = rows
        minus = np.full(len(a), -1)
        return d, s, n, p, minus, minus, a, np.broadcast_to(hot, len(a))

    def run(batches):
        last = None  # (a, c, e, doc_id, start) of the row before
        carry = None  # rows of the anchor at hand that are not told yet
        hot, hot_rows = None, 0  # the anchor at hand, if it is told in blocks, and its rows so far
        for b in batches:
            cols = _columns(b)
            if not len(cols[0]):
                continue
            out = []
            a, c, e, d = cols[:4]
            s, low = _unpack(cols[4])
            n, p = low >> 16, low & 0xFFFF
            done = e >> 32 == 1
            if done.any():
                gone, lo, hi = d[done], s[done], low[done]
                zero = np.zeros(len(lo), np.int64)
                out.append((gone, lo, hi, zero, lo, hi, zero, zero.astype(bool)))
            a, c, e, d, s, n, p = (x[~done] for x in (a, c, e, d, s, n, p))
            if len(a):
                new_c, new_row = _first_of(a, c, e), _first_of(a, c, e, d, s)
                if last is not None:
                    new_c[0] = (a[0], c[0], e[0]) != last[:3]
                    new_row[0] = (a[0], c[0], e[0], d[0], s[0]) != last
                last = (a[-1], c[-1], e[-1], d[-1], s[-1])
                k = new_row & ~new_c
                zero = np.zeros(int(k.sum()), np.int64)
                out.append((d[k], s[k], n[k], p[k], s[k], s[k] + n[k] + length - 1, zero, zero.astype(bool)))
                rows = tuple(x[new_c] for x in (a, d, s, n, p))
                if carry is not None:
                    rows = tuple(np.concatenate(x) for x in zip(carry, rows))
                if hot_rows and len(rows[0]) and rows[0][0] != hot:
                    hot_rows = 0
                if len(rows[0]):
                    ra = rows[0]
                    new = _first_of(ra)
                    begin = np.flatnonzero(new)
                    size = np.diff(np.concatenate((begin, [len(ra)])))
                    size[0] += hot_rows
                    total = np.repeat(size, np.diff(np.concatenate((begin, [len(ra)]))))
                    final = int(begin[-1])
                    whole = total[-1] > block_contexts  # the last anchor is hot: nothing of it is held
                    stop = len(ra) if whole else final
                    go = np.flatnonzero(total[:stop] > 1)
                    out.append(tell(tuple(x[go] for x in rows), total[go] > block_contexts))
                    if whole:
                        hot, hot_rows, carry = ra[-1], int(total[-1]), None
                    else:
                        hot_rows, carry = 0, tuple(x[final:] for x in rows)
            yield _record(_GROUPED, *(np.concatenate(x) for x in zip(*out)))
        if carry is not None and len(carry[0]) > 1:
            yield _record(_GROUPED, *tell(carry, False))

    return run


_CONTEXT = "block long, doc_id long, start int, n int, place int, hot boolean, bytes binary"
_JUDGED = "doc_id long, lo int, hi int, k1 long, k2 long"


def reaches(block: np.ndarray, place: np.ndarray, texts: list[bytes], length: int, gram: int, step: int = 13) -> list[np.ndarray]:
    """Bytes to the left and to the right of the anchor that each context at most shares with another one of its block.

    They are told in steps, by hashes of ever longer pieces; a context that agrees with no other one on a piece goes no further.
    """
    digest, most = xxhash.xxh64_intdigest, length - gram
    out = []
    for right in (False, True):
        bound = np.full(len(texts), most)
        on = np.arange(len(texts))
        for level in [*range(step, most, step), most]:
            pieces = [texts[k][p : p + gram + level] if right else texts[k][max(0, p - level) : p + gram] for k, p in zip(on.tolist(), place[on].tolist())]
            whole = np.fromiter((len(x) == gram + level for x in pieces), bool, len(pieces))
            h = np.fromiter((digest(x) for x in pieces), np.uint64, len(pieces))
            at = np.flatnonzero(whole)
            order = at[np.lexsort((h[at], block[on[at]]))]
            same = (block[on[order]][1:] == block[on[order]][:-1]) & (h[order][1:] == h[order][:-1])
            agree = np.zeros(len(on), bool)
            agree[order[1:][same]] = True
            agree[order[:-1][same]] = True
            bound[on[~agree]] = level - 1
            on = on[agree]
        out.append(bound)
    return out


def _compare(length: int, gram: int, block_contexts: int):
    """Rows of _CONTEXT sorted by block: the spans removed, and the classes of blocks that are cut, which must still be settled."""

    def judge(rows, cut=False):
        block, d, s, n, p, hot, texts = rows
        hot = hot.astype(bool)
        left, right = np.full((2, len(texts)), length - gram)
        left[~hot], right[~hot] = reaches(block[~hot], p[~hot], texts[~hot].tolist(), length, gram)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        data = np.frombuffer(b"".join(texts), np.uint8)
        offset = np.cumsum(size) - size
        n = n.astype(np.int64)
        own = np.repeat(np.arange(len(n)), n)
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        before = p[own] - step  # bytes of the string to the left of the anchor
        can = (before <= left[own]) & (length - gram - before <= right[own])
        own, step = own[can], step[can]
        if not len(own):
            return _record(_JUDGED, *[np.zeros(0, np.int64)] * 5)
        starts = offset[own] + step
        # equal strings hold the anchor at the same place: suffixes are grouped by anchor and place
        key = block[own].astype(np.int64)
        rel = p[own].astype(np.int64) - step
        order = np.lexsort((s[own] + step, d[own], rel, key))
        own, step, starts, key, rel = (x[order] for x in (own, step, starts, key, rel))
        group = np.cumsum(np.concatenate(([True], (key[1:] != key[:-1]) | (rel[1:] != rel[:-1])))) - 1
        by, same = suffix_sort(data, starts, group, length)
        # the sort is stable and its input is in (doc_id, start) order: the first of a class is its earliest
        doc, at = d[own[by]], s[own[by]] + step[by]
        gone = np.flatnonzero(same)
        out = [(doc[gone], at[gone], at[gone] + length, np.zeros(len(gone), np.int64), np.zeros(len(gone), np.int64))]
        open_ = np.flatnonzero(~same)
        if cut and len(open_):
            x = starts[by[open_]]
            view = memoryview(data)
            key = digests(view[i : i + length] for i in x.tolist()).view(np.int64)
            out.append((doc[open_], at[open_], np.full(len(open_), -1), key[:, 0], key[:, 1]))
        return _record(_JUDGED, *_joined(*(np.concatenate(x) for x in zip(*out))))

    def whole(rows):
        """Blocks that are at hand as a whole; one context alone has nothing to be compared with."""
        block = rows[0]
        new = _first_of(block)
        alone = new & np.append(new[1:], True)
        if alone.all():
            return
        rows = [x[~alone] for x in rows]
        cut = np.append(np.flatnonzero(_first_of(rows[0])), len(rows[0]))
        large = np.diff(cut) > block_contexts
        rest = np.repeat(~large, np.diff(cut))
        if rest.any():
            yield judge([x[rest] for x in rows])
        for k in np.flatnonzero(large).tolist():
            yield from blocks([x[cut[k] : cut[k + 1]] for x in rows])

    def blocks(rows):
        for i in range(0, len(rows[0]), block_contexts):
            yield judge([x[i : i + block_contexts] for x in rows], True)

    def run(batches):
        held, at = None, None  # at: the block at hand, if a part of it has gone out
        for b in batches:
            rows = _columns(b)
            held = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
            if at is not None and len(held[0]) and (more := int(np.searchsorted(held[0] != at, True))) < len(held[0]):
                yield from blocks([x[:more] for x in held])
                held, at = [x[more:] for x in held], None
            if len(held[0]) >= max(2_000, 2 * block_contexts):
                last = 0 if at is not None else int(np.searchsorted(held[0] == held[0][-1], True))
                if last:
                    yield from whole([x[:last] for x in held])
                    held = [x[last:] for x in held]
                if len(held[0]) > block_contexts:
                    full = len(held[0]) // block_contexts * block_contexts
                    at = held[0][0]
                    yield from blocks([x[:full] for x in held])
                    held = [x[full:] for x in held]
        if held is not None and len(held[0]):
            yield from (whole(held) if at is None else blocks(held))

    return run


def _joined(doc, lo, hi, k1, k2):
    """Spans that touch become one; rows of open classes stay."""
    rest = hi < 0
    d, l, h = merge_spans(doc[~rest], lo[~rest], hi[~rest])
    zero = np.zeros(len(d), np.int64)
    return tuple(np.concatenate(x) for x in ((d, doc[rest]), (l, lo[rest]), (h, hi[rest]), (zero, k1[rest]), (zero, k2[rest])))


def _squeeze(batches):
    """Compress the texts (second column): they cross two shuffles."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for b in batches:
        data = pa.array([squeeze(x) for x in b.column(1).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), data, *b.columns[2:]], b.schema.names)


def _texts(column) -> list[bytes]:
    expand = zstandard.ZstdDecompressor().decompress
    return [expand(x) for x in column.to_pylist()]


def bins(text: bytes, s: int, n: int, p: int, length: int, gram: int):
    """The starts of a context in bins of BIN, told by the bytes to the left of the anchor: (block, start, number, place, bytes).

    All strings of a bin hold the bytes that block is the hash of, at the same place from the anchor.
    """
    most = length - gram
    for low in range(0, min(p, most) + 1, BIN):
        high = min(low + BIN - 1, most)
        i, j = max(0, p - high), min(n - 1, p - low)
        if i <= j:
            yield xxhash.xxh64_intdigest(text[p - low : p + length - high], low), s + i, j - i + 1, p - i, text[i : j + length]


def _contexts(length: int, gram: int):
    """Cut the bytes of each context out of its document; rows are (doc_id, squeezed data, contexts)."""

    def dealt(block, doc, s, n, p, hot, text):
        """The hot rows in bins."""
        at = np.flatnonzero(hot).tolist()
        found = [(doc[k], x) for k in at for x in bins(text[k], int(s[k]), int(n[k]), int(p[k]), length, gram)]
        if not found:
            return
        b, s, n, p, text = zip(*(x for _, x in found))
        yield _record(
            _CONTEXT, np.array(b, np.uint64).view(np.int64), np.array([d for d, _ in found]), *map(np.array, (s, n, p)), np.ones(len(b), bool), pa.array(text, pa.binary())
        )

    def run(batches):
        for b in batches:
            datas = _texts(b.column(1))
            size = pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False)
            flat = b.column(2).flatten()
            block, s, n, p, hot = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(5))
            own = np.repeat(np.arange(len(datas)), size)
            doc = b.column(0).to_numpy()[own]
            for i in range(0, len(own), 4_000):
                k = slice(i, i + 4_000)
                ends = (s[k] + n[k] + length - 1).tolist()
                text = [datas[o][x:y] for o, x, y in zip(own[k].tolist(), s[k].tolist(), ends)]
                row = block[k], doc[k], s[k], n[k], p[k], hot[k].astype(bool)
                yield from dealt(*row, text)
                cool = ~row[-1]
                if cool.any():
                    yield _record(_CONTEXT, *(x[cool] for x in row), pa.array([x for x, c in zip(text, cool.tolist()) if c], pa.binary()))

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block_contexts: int = BLOCK_CONTEXTS) -> DataFrame:
    """(doc_id, lo, hi): byte spans of ``docs(doc_id, data)`` to remove; spans may overlap or touch."""
    parts = shuffle_parts(docs.sparkSession)
    found = docs.mapInArrow(tidy(_find(length, gram)), _FOUND)
    to = F.when(F.col("kind_e") < 1 << 32, F.col("a")).otherwise(F.xxhash64("doc_id"))
    grouped = (
        found.repartition(parts, to)
        .sortWithinPartitions("a", "c", "kind_e", "doc_id", "where")
        .mapInArrow(tidy(_group(length, block_contexts)), _GROUPED)
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    equal = grouped.where("lo >= 0").select("doc_id", "lo", "hi")
    asked = (
        grouped.where("lo < 0")
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("block", "start", "n", "place", "hot")).alias("rows"))
    )
    squeezed = docs.mapInArrow(tidy(_squeeze), docs.schema)
    contexts = squeezed.join(asked, "doc_id").select("doc_id", "data", "rows").mapInArrow(tidy(_contexts(length, gram)), _CONTEXT)
    judged = (
        contexts.repartition(parts, "block")
        .sortWithinPartitions("block")
        .mapInArrow(tidy(_compare(length, gram, block_contexts)), _JUDGED)
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    settled = judged.where("hi >= 0").select("doc_id", "lo", "hi")
    open_ = judged.where("hi < 0")
    first = open_.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "lo")).alias("first"))
    later = (
        open_.join(first, ["k1", "k2"])
        .where(F.struct("doc_id", "lo") > F.col("first"))
        .select("doc_id", "lo", (F.col("lo") + F.lit(length)).cast("int").alias("hi"))
    )
    return equal.union(settled).union(later)


def merge_spans(row: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Join the spans of each row that overlap or touch; sorted by row and start."""
    order = np.lexsort((lo, row))
    row, lo, hi = row[order], lo[order].astype(np.int64), hi[order].astype(np.int64)
    if not len(row):
        return row, lo, hi
    own = np.cumsum(_first_of(row))
    shift = own * (int(hi.max()) + 2)
    reach = np.maximum.accumulate(hi + shift)
    new = np.ones(len(row), bool)
    new[1:] = lo[1:] + shift[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(row)])) - 1
    return row[first], lo[first], reach[last] - shift[last]


def _kept(batches):
    for b in batches:
        datas = _texts(b.column(1))
        size = pc.fill_null(pc.list_value_length(b.column(2)), 0).to_numpy(zero_copy_only=False)
        flat = b.column(2).flatten()
        length = np.fromiter(map(len, datas), np.int64, len(datas))
        own = np.repeat(np.arange(len(datas)), size)
        own, lo, hi = merge_spans(own, flat.field(0).to_numpy(), flat.field(1).to_numpy())
        hi = np.minimum(hi, length[own])
        within = lo < hi
        own, lo, hi = own[within], lo[within], hi[within]
        runs = np.bincount(own, minlength=len(datas))
        removed = np.zeros(len(datas), np.int64)
        np.add.at(removed, own, hi - lo)
        kept, lo, hi, k = [], lo.tolist(), hi.tolist(), 0
        for data, n in zip(datas, runs.tolist()):
            if not n:
                kept.append(data)
                continue
            cut = [0, *(x for i in range(k, k + n) for x in (lo[i], hi[i])), len(data)]
            kept.append(b"".join(data[x:y] for x, y in zip(cut[::2], cut[1::2])))
            k += n
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(length), pa.array(removed), pa.array(runs.astype(np.int64)), pa.array(kept, pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def _kept_rows(batches):
    """The same with the kept text and the input row; a character of which a part is removed goes whole."""

    def both():
        for b in batches:
            row.append(b.column(3))
            yield b.select(["doc_id", "data", "spans"])

    row: list = []
    for out in _kept(both()):
        text = pa.array([x.decode("utf-8", "ignore") for x in out.column(4).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*out.columns[:4], text, row.pop()], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_text", "row"])


def one_id_a_text(data: DataFrame) -> DataFrame | None:
    """``data`` with a column place that orders its documents by (doc_id, hash of data); None if ids tell them apart already."""
    digest = F.xxhash64("data")
    known = data.where("doc_id is not null").groupBy("doc_id").agg(F.min(digest).alias("low"), F.max(digest).alias("high"))
    if known.where("low <> high").isEmpty():
        return None
    places = data.select("doc_id", digest.alias("h")).where("doc_id is not null").distinct().orderBy("doc_id", "h")
    places = cut_lineage(places.select(F.col("doc_id").alias("d"), "h", F.monotonically_increasing_id().alias("place")))
    return data.join(places, (F.col("doc_id") == F.col("d")) & (digest == F.col("h")), "left").drop("d", "h")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block_contexts: int = BLOCK_CONTEXTS, rows: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for each row of ``docs``; ``kept`` are the remaining bytes.

    Null texts count as empty; texts shorter than ``length`` are kept whole. doc_id orders the
    documents, so it is expected to be unique: rows that repeat a doc_id and its text are one place
    and each come out like that one document, different texts under one doc_id are documents of their own in an order by
    hash, and rows with a null doc_id are kept whole. Two tables stay persisted, as the result is lazy;
    spark.catalog.clearCache() frees them. Other columns are not read, unless ``rows`` asks for
    the kept text as a string and the rest of each input row as a struct (kept_text and row, in place of kept).
    """
    bounded_batches(docs.sparkSession)
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    whole = [F.struct(*[docs[c] for c in others]).alias("row")] if rows else []
    data = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("data"), *whole
    )
    own = one_id_a_text(data)
    data, by = (data, "doc_id") if own is None else (own, "place")
    spans = repeated_spans(data.where("doc_id is not null").select(F.col(by).alias("doc_id"), "data"), length, gram, block_contexts)
    per_doc = spans.groupBy(F.col("doc_id").alias("place")).agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    squeezed = data.select("doc_id", "data", F.col(by).alias("at"), *(["row"] if rows else []))
    squeezed = squeezed.mapInArrow(tidy(_squeeze), squeezed.schema)
    joined = squeezed.join(per_doc, F.col("at") == F.col("place"), "left").select("doc_id", "data", "spans", *(["row"] if rows else []))
    if rows:
        schema = T.StructType().add("doc_id", "long").add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long")
        return joined.mapInArrow(tidy(_kept_rows), schema.add("kept_text", "string").add("row", data.schema["row"].dataType))
    return joined.mapInArrow(tidy(_kept), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def without_repeats(docs: DataFrame, **params) -> DataFrame:
    """``docs`` with repeated passages cut from their texts and n_chars counted anew; rows of which nothing is left go."""
    out = remove_repeats(docs, rows=True, **params).where("kept_text <> ''")
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return out.select(*[(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns])


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def brute_force(texts: list[tuple[int, bytes]], length: int = LENGTH) -> dict[int, tuple[int, int, int, str]]:
    """The same result by a table of all strings, for tests."""
    seen: set[bytes] = set()
    out = {}
    for doc_id, data in sorted(texts):
        gone = np.zeros(len(data) + 2, bool)
        for i in range(len(data) - length + 1):
            piece = data[i : i + length]
            if piece in seen:
                gone[i + 1 : i + 1 + length] = True
            seen.add(piece)
        runs = int((gone[1:] & ~gone[:-1]).sum())
        kept = bytes(b for b, g in zip(data, gone[1:]) if not g)
        out[doc_id] = (len(data), len(data) - len(kept), runs, hashlib.sha256(kept).hexdigest())
    return out
