"""N-gram Jaccard join by signature trees.

A document's set is its distinct n-grams of lower-case words (of a text of fewer words, all of them as one). Documents
of one set form a class, stood for by its smallest identifier, and each class enters the search once, so thousands of
copies cost no more than one document.

The join is exact. Two sets whose index reaches the threshold t share at least t times as many n-grams as each has, so:

* A set of which fewer n-grams occur elsewhere matches nothing. For this all n-grams are counted, by parts of their
  hashes; as hashes are cut short, some count too often, which only lets more sets through.
* In one order of all n-grams, the rare ones first, two matching sets share one among those of each from which on at
  least t times its size are left; from the first they share on, enough are left in both. Sets that share such an n-gram
  are connected; of more than LIST sets all are connected to the first. Matching sets lie in one component.
* A component is compared with itself: at once, if it is small, else in blocks. A signature tree over its members holds
  the OR of their bitmaps and the range of their sizes, and a dual traversal leaves out pairs of nodes, down to blocks,
  whose largest possible overlap is too small for the threshold. Two blocks that are left are compared by whole sets.

No bound leaves anything out. A pair of classes is met once, in one piece of one component, so links are counted where
they are found and needn't be sent.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import Words, checkpointed, col, column, fixed_binary, fresh, from_binary, large_strings, mix, offsets_of, read, run_starts, slices, whole_groups
from loomgraph.llm.substring_dedup import _pack, _unpack

#: N-grams that are counted, or sent to be counted, together, about.
CHUNK = 1 << 21
#: Sets that share an n-gram are connected in pairs, up to so many.
LIST = 32
#: Members and n-grams of a block, at most, so that no more than two blocks' sets come together.
BLOCK, BLOCK_GRAMS = 1000, 1 << 21
#: Components of so many members are compared by look-ups, larger ones by products of matrices of so many cells.
SMALL, CELLS = 16, 1 << 23
#: Grams that one pass of the look-ups takes at a time.
AT_ONCE = 1 << 20
#: 64-bit numbers in a bitmap.
LANES = 16
LEAF, FAN = 16, 8


def gram_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, as (row, hash) sorted by both. Texts without words have none."""
    w = Words(pc.utf8_lower(texts))
    total = w.sums()
    h, whole = w.grams(n, total)
    row = w.doc[: len(h)][whole]
    h = h[whole]
    short = np.flatnonzero((w.counts > 0) & (w.counts < n))
    if len(short):
        h = np.concatenate((h, w.spans(w.first[short], w.first[short + 1], total)))
        row = np.concatenate((row, short))
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


@functools.cache
def _turns(k: int) -> np.ndarray:
    """In row i, a place for each of k bins in an order of bin i's own."""
    return np.argsort(np.random.default_rng(20_011).random((k, k)), axis=1).argsort(axis=1).astype(np.uint16)


def _densified(least: np.ndarray, empty: np.uint64) -> np.ndarray:
    """Rows of MinHash bins with the empty ones filled: each takes over from the bin that comes first, of those that aren't
    empty, in its own order of all bins. As the orders are independent, so are the bins, however few n-grams a row has:
    two rows agree in each with a probability of their Jaccard index."""
    k = least.shape[1]
    turns = _turns(k)
    out = least.copy()
    hole = least == empty
    for i in np.flatnonzero(hole.any(1) & ~hole.all(1)):
        full = np.flatnonzero(~hole[i])
        at = np.flatnonzero(hole[i])
        out[i, at] = least[i, full[turns[at[:, None], full].argmin(1)]]
    return out


def _signatures(row: np.ndarray, h: np.ndarray, n_rows: int, bands: int, rows: int) -> tuple[np.ndarray, ...]:
    """For each row: number of n-grams, two hashes of the set, keys of MinHash bands (of none, if no bands are asked for),
    bitmap."""
    size = np.bincount(row, minlength=n_rows)
    starts = np.minimum(np.cumsum(size) - size, max(len(h) - 1, 0))
    has = size > 0
    sums = np.zeros((2, n_rows), np.uint64)
    if len(h):
        sums[0, has] = np.add.reduceat(mix(h), starts[has])
        sums[1, has] = np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), starts[has])
    key = np.tile(np.arange(bands, dtype=np.uint64), (n_rows, 1))
    if bands:
        k = bands * rows
        g = mix(h + np.uint64(0x1234567))
        slot = row * k + (g % np.uint64(k)).astype(np.int64)
        empty = np.uint64(0xFFFFFFFFFFFFFFFF)
        least = np.full(n_rows * k, empty, np.uint64)
        np.minimum.at(least, slot, g)
        least = _densified(least.reshape(n_rows, k), empty)
        for j in range(rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + least[:, j::rows])
    bit = (mix(h + np.uint64(0x77)) % np.uint64(64 * LANES)).astype(np.int64)
    flat = np.zeros(n_rows * LANES * 64, bool)
    flat[row * (LANES * 64) + bit] = True
    maps = np.packbits(flat.reshape(n_rows, -1), axis=1, bitorder="little").view(np.uint64)
    return size, sums[0].view(np.int64), sums[1].view(np.int64), key.view(np.int64), maps


class SignatureTree:
    """Levels of nodes over items ordered by size; level 0 is the items themselves. Of each node: the OR of bitmaps,
    smallest and largest size, and the largest excess of n-grams over bits."""

    def __init__(self, size: np.ndarray, maps: np.ndarray, leaf: int = LEAF, fan: int = FAN):
        self.order = np.lexsort((*maps.T[::-1], size))
        size, maps = size[self.order], maps[self.order]
        excess = size - np.bitwise_count(maps).sum(1).astype(np.int64)
        self.levels = [(maps, size, size, excess, np.arange(len(size) + 1))]
        step = leaf
        while len(self.levels[-1][1]) > 1 or len(self.levels) == 1:
            m, low, high, ex, _ = self.levels[-1]
            first = np.arange(0, len(low), step)
            self.levels.append((np.bitwise_or.reduceat(m, first, 0), np.minimum.reduceat(low, first), np.maximum.reduceat(high, first), np.maximum.reduceat(ex, first), np.append(first, len(low))))
            step = fan

    def _may(self, level: int, a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
        """Whether some item below node a may have a Jaccard index of t with one below node b."""
        m, low, high, ex, _ = self.levels[level]
        most = np.bitwise_count(m[a] & m[b]).sum(-1).astype(np.int64) + np.minimum(ex[a], ex[b])
        most = np.minimum(most, np.minimum(high[a], high[b]))
        return (most * (1 + t) >= t * (low[a] + low[b]) - 1e-9) & (high[a] >= t * low[b] - 1e-9) & (high[b] >= t * low[a] - 1e-9)

    def pairs(self, t: float) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of items, as they were numbered, that the bitmaps and sizes don't rule out."""
        x, y = self.nodes(t, 0)
        return self.order[x], self.order[y]

    def nodes(self, t: float, down_to: int) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of nodes of a level, in its order, that the bitmaps and sizes don't rule out; of items without those
        of one with itself."""
        out_a, out_b = [], []
        top = len(self.levels) - 1
        stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, a, b = stack.pop()
            if level == down_to:
                out_a.append(a)
                out_b.append(b)
                continue
            first = self.levels[level][4]
            na, nb = first[a + 1] - first[a], first[b + 1] - first[b]
            total = na * nb
            k = np.repeat(np.arange(len(a)), total)
            i = np.arange(len(k)) - np.repeat(np.cumsum(total) - total, total)
            x, y = first[a][k] + i // nb[k], first[b][k] + i % nb[k]
            ok = x < y if level == 1 else x <= y
            x, y = x[ok], y[ok]
            ok = self._may(level - 1, x, y, t)
            x, y = x[ok], y[ok]
            for at in range(0, len(x), 4096):
                stack.append((level - 1, x[at : at + 4096], y[at : at + 4096]))
        if not out_a:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(out_a), np.concatenate(out_b)


def _squeezed(x: np.ndarray) -> bytes:
    """Numbers compressed, byte by byte of their places."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def _widened(b: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(width, len(raw) // width).T).view(dtype).ravel()


def _sets_of_texts(n: int):
    def sets(batches):
        for b in batches:
            ids, texts = column(b, 0), large_strings(b.column(1))
            for i, j in slices(texts):
                yield (ids[i:j], *gram_sets(texts.slice(i, j - i), n))

    return sets


def _grams(a: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """From binary: where each set's n-grams begin, with the length at the end; the n-grams."""
    a = (a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a).cast(pa.large_binary())
    off = offsets_of(a)
    n = (int(off[-1]) - int(off[0])) // 8
    return (off - off[0]) // 8, np.frombuffer(a.buffers()[2], np.uint64, n, int(off[0])) if n else np.zeros(0, np.uint64)


def _stored_sets(batches):
    for b in batches:
        off, h = _grams(b.column(1))
        yield column(b, 0), np.repeat(np.arange(b.num_rows), np.diff(off)), h


def _spread(sets, parts: int, bits: int):
    """Rows (part, chunk, whole, keys, rows): the n-grams of a chunk of sets whose hashes fall into a part, as sorted keys
    of so many bits and the numbers of their sets; and once, with whole, the identifiers and sizes of the chunk's sets."""

    def apply(batches):
        chunk, held, grams, n = TaskContext.get().partitionId() << 32, [], 0, 0

        def sent():
            ids = np.concatenate([x[0] for x in held])
            first = np.cumsum([0] + [len(x[0]) for x in held])
            row = np.concatenate([x[1] + i for x, i in zip(held, first.tolist())])
            g = mix(np.concatenate([x[2] for x in held]) + np.uint64(0x2468ACE))
            size = np.bincount(row, minlength=len(ids)).astype(np.uint32)
            key = ((g >> np.uint64(32)) % np.uint64(parts) << np.uint64(32)) | (g & np.uint64((1 << bits) - 1))
            order = np.argsort(key)
            key, row = key[order], row[order].astype(np.uint16)
            cut = np.searchsorted(key, np.arange(parts + 1, dtype=np.uint64) << np.uint64(32)).tolist()
            low = key.astype(np.uint32)
            out = [(chunk % parts, chunk, True, _squeezed(ids), _squeezed(size))]
            for p, (i, j) in enumerate(zip(cut[:-1], cut[1:])):
                if i < j:
                    out.append((p, chunk, False, _squeezed(np.diff(low[i:j], prepend=np.uint32(0))), _squeezed(row[i:j])))
            return pa.record_batch([pa.array(x, kind) for x, kind in zip(zip(*out), (pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()))], ["part", "chunk", "whole", "keys", "rows"])

        for x in sets(batches):
            if held and (grams + len(x[2]) > CHUNK or n + len(x[0]) > 0xFFFF):
                yield sent()
                chunk, held, grams, n = chunk + 1, [], 0, 0
            held.append(x)
            grams, n = grams + len(x[2]), n + len(x[0])
        if n:
            yield sent()

    return apply


def _frequent(tokens: bool):
    """Rows (chunk, part, keys, rows, codes), from rows of _spread sorted by part: of the keys that occur twice or more the
    numbers of their sets; with tokens, the keys too, and codes that grow with how often they occur. Rows with whole come
    out as they are, of part -1."""

    def of_part(t: pa.Table):
        chunk, whole, keys, rows = (t.column(i).to_pylist() for i in range(1, 5))
        out = [(c, -1, k, r, None) for c, w, k, r in zip(chunk, whole, keys, rows) if w]
        at = [i for i, w in enumerate(whole) if not w]
        if at:
            key = [np.cumsum(_widened(keys[i], np.uint32), dtype=np.uint32) for i in at]
            every = np.concatenate(key)
            order = np.argsort(every, kind="stable")
            r = np.diff(run_starts(every[order]))
            times = np.empty(len(every), np.int64)
            times[order] = np.repeat(r, r)
            end = np.cumsum([len(k) for k in key]).tolist()
            part = t.column(0)[0].as_py()
            for i, k, a, b in zip(at, key, [0, *end], end):
                many = times[a:b] > 1
                row = _widened(rows[i], np.uint16)[many]
                if not len(row):
                    continue
                if tokens:
                    code = np.minimum(np.log2(times[a:b][many]) * 8, 255).astype(np.uint8)
                    out.append((chunk[i], part, _squeezed(np.diff(k[many], prepend=np.uint32(0))), _squeezed(row), _squeezed(code)))
                else:
                    out.append((chunk[i], part, None, _squeezed(np.diff(np.sort(row), prepend=np.uint16(0))), None))
        if out:
            yield pa.record_batch([pa.array(x, kind) for x, kind in zip(zip(*out), (pa.int64(), pa.int64(), *[pa.binary()] * 3))], ["chunk", "part", "keys", "rows", "codes"])

    def apply(batches):
        for t in whole_groups(batches):
            at = run_starts(column(t, 0)).tolist()
            for i, j in zip(at[:-1], at[1:]):
                yield from of_part(t.slice(i, j - i))

    return apply


def _by_chunk(batches):
    """Of each chunk its identifiers, sizes, and other rows, from rows of _frequent sorted by chunk."""
    for t in whole_groups(batches):
        at = run_starts(column(t, 0)).tolist()
        for i, j in zip(at[:-1], at[1:]):
            rows = t.slice(i, j - i).to_pylist()
            (own,) = (x for x in rows if x["part"] < 0)
            yield _widened(own["keys"], np.int64), _widened(own["rows"], np.uint32).astype(np.int64), [x for x in rows if x["part"] >= 0]


def _survivors(threshold: float):
    """The identifiers of sets with enough n-grams that occur twice."""

    def apply(batches):
        for ids, size, rows in _by_chunk(batches):
            n = np.zeros(len(ids), np.int64)
            for x in rows:
                n += np.bincount(np.cumsum(_widened(x["rows"], np.uint16), dtype=np.uint16), minlength=len(ids))
            yield pa.record_batch([pa.array(ids[(size > 0) & (n >= threshold * size - 1e-9)])], ["id"])

    return apply


def _prefixes(threshold: float):
    """Rows (token, id, size, left): the n-grams that a matching set may share first, in the order of all n-grams, and how
    many of the set's are left from there on."""

    def apply(batches):
        for ids, size, rows in _by_chunk(batches):
            if not rows:
                continue
            token = np.concatenate([np.cumsum(_widened(x["keys"], np.uint32), dtype=np.uint32).astype(np.int64) | x["part"] << 32 for x in rows])
            row = np.concatenate([_widened(x["rows"], np.uint16) for x in rows]).astype(np.int64)
            code = np.concatenate([_widened(x["codes"], np.uint8) for x in rows])
            order = np.lexsort((token, code, row))
            token, row = token[order], row[order]
            n = np.bincount(row, minlength=len(ids))
            left = np.cumsum(n)[row] - np.arange(len(row))  # those that occur once come first
            keep = left >= threshold * size[row] - 1e-9
            token, row, left = token[keep], row[keep], left[keep]
            yield pa.record_batch([pa.array(token), pa.array(ids[row]), pa.array(size[row].astype(np.int32)), pa.array(left.astype(np.int32))], ["token", "id", "size", "left"])

    return apply


def _connected(threshold: float):
    """Pairs (a, b) of sets that share an n-gram, from rows of _prefixes sorted by token and id."""

    def apply(batches):
        for t in whole_groups(batches):
            token, ids, size, left = (column(t, i) for i in range(4))
            at = run_starts(token)
            n = np.diff(at)
            few = np.repeat(n <= LIST, n)
            first = np.repeat(at[:-1], n)
            star = np.flatnonzero(~few & (first != np.arange(len(first))))
            out = [(ids[first[star]], ids[star])]
            for d in range(1, min(LIST, int(n.max(initial=0)))):
                i = np.flatnonzero((token[:-d] == token[d:]) & few[:-d])
                j = i + d
                ok = np.minimum(left[i], left[j]) * (1 + threshold) >= threshold * (size[i].astype(np.int64) + size[j]) - 1e-9
                out.append((ids[i[ok]], ids[j[ok]]))
            a, b = (np.concatenate(x) for x in zip(*out))
            a, b = a[a != b], b[a != b]
            if len(a):
                pair = np.unique(np.stack([a, b], 1), axis=0)
                yield pa.record_batch([pa.array(np.ascontiguousarray(pair[:, i])) for i in (0, 1)], ["a", "b"])

    return apply


def _set_rows(n: int):
    """Rows (id, size, s1, s2, map, grams) of rows (id, packed)."""

    def apply(batches):
        for b in batches:
            ids, texts = column(b, 0), _unpack(b.column(1))
            for i, j in slices(texts):
                row, h = gram_sets(texts.slice(i, j - i), n)
                size, s1, s2, _, maps = _signatures(row, h, j - i, 0, 0)
                off = np.searchsorted(row, np.arange(j - i + 1)) * 8
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(h)]).cast(pa.binary())
                out = pa.record_batch([pa.array(ids[i:j]), pa.array(size.astype(np.int64)), pa.array(s1), pa.array(s2), fixed_binary(maps), raw], ["id", "size", "s1", "s2", "map", "grams"])
                yield out.filter(pa.array(size > 0))

    return apply


def _class_rows(batches):
    """Rows (id, member, s1, size, map, grams), from rows of _set_rows sorted by s1, s2, size and id: a class' smallest
    identifier with each of its members; only with the first row of a class come its bitmap and n-grams."""
    last, own = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        ids, size, s1, s2 = (column(b, i) for i in range(4))
        key = np.stack([s1, s2, size], 1)
        new = np.ones(len(ids), bool)
        new[1:] = (key[1:] != key[:-1]).any(1)
        new[0] = last is None or bool((key[0] != last).any())
        k = np.cumsum(new)
        rep = np.concatenate(([own], ids[new]))[k]
        last, own = key[-1], rep[-1]
        only = pa.array(np.where(new, np.arange(len(ids)), 0), mask=~new)
        yield pa.record_batch([pa.array(rep), b.column(0), b.column(2), b.column(1), b.column(4).take(only), b.column(5).take(only)], ["id", "member", "s1", "size", "map", "grams"])


def _blocks(threshold: float):
    """Rows (root, id, s1, piece, side) of rows (root, id, s1, size, map) sorted by root: the pieces that a set goes to. In
    one with sides 1 and 2, sets of the one side are compared with those of the other; in one with side 0, all are."""

    def of_root(root: int, size: np.ndarray, maps: np.ndarray):
        """Rows (set, piece, side)."""
        leaf = int(max(1, min(BLOCK, BLOCK_GRAMS // max(int(size.max()), 1))))
        base = mix(np.array([root], np.int64).view(np.uint64))[0]
        if len(size) <= leaf:
            yield np.arange(len(size)), base, 0
            return
        tree = SignatureTree(size, maps, leaf=leaf)
        first = tree.levels[1][4]
        for x, y in zip(*(v.tolist() for v in tree.nodes(threshold, 1))):
            piece = mix(np.array([base + np.uint64(x << 32 | y)], np.uint64))[0]
            for side, node in ((1, x), (2, y)) if x != y else ((0, x),):
                yield tree.order[first[node] : first[node + 1]], piece, side

    def apply(batches):
        for t in whole_groups(batches):
            root, ids, s1, size = (column(t, i) for i in range(4))
            maps = from_binary(t.column(4), np.uint64, LANES)
            at, out = run_starts(root).tolist(), []
            with np.errstate(over="ignore"):
                for i, j in zip(at[:-1], at[1:]):
                    for of, piece, side in of_root(int(root[i]), size[i:j], maps[i:j]):
                        out.append((of + i, np.full(len(of), piece).view(np.int64), np.full(len(of), side, np.int32)))
            if out:
                of, piece, side = (np.concatenate(x) for x in zip(*out))
                yield pa.record_batch([pa.array(x) for x in (root[of], ids[of], s1[of], piece, side)], ["root", "id", "s1", "piece", "side"])

    return apply


def _overlaps(x: np.ndarray, y: np.ndarray, off: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """How many n-grams the sets x[i] and y[i] share. A set's n-grams are those from off on, sorted."""
    _, gram = np.unique(grams, return_inverse=True)
    n = int(gram.max()) + 1 if len(gram) else 1
    size = np.diff(off)
    code = gram + np.repeat(np.arange(len(size)), size) * n  # sorted, as sets and their n-grams are
    out = np.zeros(len(x), np.int64)
    ends = np.cumsum(size[x])
    at = 0
    while at < len(x):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
        m = size[x[at:to]]
        of = np.repeat(np.arange(at, to), m)
        k = np.arange(len(of)) - np.repeat(np.cumsum(m) - m, m) + off[x[of]]
        want = gram[k] + y[of] * n
        i = np.minimum(np.searchsorted(code, want), len(code) - 1)
        out += np.bincount(of[code[i] == want], minlength=len(x))
        at = to
    return out


def _products(a: np.ndarray, b: np.ndarray | None, off: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """How many n-grams the sets a share with the sets b, or with each other, as a matrix. A set's n-grams are those from
    off on."""
    size = np.diff(off)
    _, code, times = np.unique(grams, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(size)), size)
    more = times > 1
    keep = more[code]
    code, row = (np.cumsum(more) - 1)[code[keep]], row[keep]
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    n, width = int(more.sum()), max(1, CELLS // len(size))
    kind = np.float32 if size.max(initial=0) < 1 << 24 else np.float64
    out = np.zeros((len(a), len(a) if b is None else len(b)), kind)
    cells = np.zeros((len(size), min(width, n)), kind)
    for at in range(0, n, width):
        i, j = np.searchsorted(code, (at, at + width))
        cells[row[i:j], code[i:j] - at] = 1
        left = cells if b is None and len(a) == len(size) else cells[a]
        out += left @ (left if b is None else cells[b]).T
        cells[row[i:j], code[i:j] - at] = 0
    return out


def _least(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest number that each of n is connected with by pairs."""
    out = np.arange(n)
    while len(x):
        low, before = np.minimum(out[x], out[y]), out.copy()
        for at in (x, y, before[x], before[y]):
            np.minimum.at(out, at, low)
        out = out[out]
        if (out == before).all():
            break
    return out


def _found(threshold: float, as_pairs: bool):
    """Rows (root, id, links, label) of rows (piece, side, root, id, n, grams) sorted by piece: the documents of matching
    sets in the piece, and the smallest identifier connected; or, as pairs, rows (id_a, id_b, jaccard)."""

    def of_pieces(t: pa.Table):
        piece, side, root, ids, n = (column(t, i) for i in range(5))
        off, grams = _grams(t.column(5))
        size = np.diff(off)
        at = run_starts(piece)
        small = (np.diff(at) <= SMALL) & (np.maximum.reduceat(side, at[:-1]) == 0)
        x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        of, end = np.repeat(np.arange(len(small)), np.diff(at)), np.repeat(at[1:], np.diff(at))
        for d in range(1, SMALL):
            i = np.flatnonzero(small[of] & (np.arange(len(of)) + d < end))
            x.append(i)
            y.append(i + d)
        x, y = np.concatenate(x), np.concatenate(y)
        x, y = np.where(size[x] <= size[y], x, y), np.where(size[x] <= size[y], y, x)
        ok = size[x] >= threshold * size[y] - 1e-9
        x, y = x[ok], y[ok]
        out = [(x, y, _overlaps(x, y, off, grams) if len(x) else np.zeros(0, np.int64))]
        for k in np.flatnonzero(~small):
            i, j = int(at[k]), int(at[k + 1])
            own = side[i:j]
            a, b = (np.arange(j - i), None) if not own.any() else (np.flatnonzero(own == 1), np.flatnonzero(own == 2))
            both = _products(a, b, off[i : j + 1] - off[i], grams[off[i] : off[j]])
            at_least = threshold * (size[i:j][a][:, None] + size[i:j][a if b is None else b][None, :]) / (1 + threshold)
            p, q = np.nonzero(both >= at_least - 1e-6 * at_least - 1e-9)
            if b is None:
                p, q = p[p < q], q[p < q]
            out.append((a[p] + i, (a if b is None else b)[q] + i, both[p, q].astype(np.int64)))
        x, y, both = (np.concatenate(v) for v in zip(*out))
        jaccard = both / np.maximum(size[x] + size[y] - both, 1)
        hit = (jaccard >= threshold) & (ids[x] != ids[y])
        x, y, jaccard = x[hit], y[hit], jaccard[hit]
        if as_pairs:
            return pa.record_batch([pa.array(np.minimum(ids[x], ids[y])), pa.array(np.maximum(ids[x], ids[y])), pa.array(jaccard)], ["id_a", "id_b", "jaccard"])
        links = np.bincount(x, n[y], len(ids)) + np.bincount(y, n[x], len(ids))
        # places of a table in the order of identifiers, so that the smallest place is that of the smallest identifier
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        label = ids[order][_least(len(ids), place[x], place[y])][place]
        some = links > 0
        return pa.record_batch([pa.array(v[some]) for v in (root, ids, links.astype(np.int64), label)], ["root", "id", "links", "label"])

    def apply(batches):
        for t in whole_groups(batches):
            if t.num_rows:
                yield of_pieces(t)

    return apply


def _united(batches):
    """Rows (id, class_id, links) from rows (root, id, links, label) sorted by root."""
    for t in whole_groups(batches):
        if not t.num_rows:
            continue
        ids, links, label = (column(t, i) for i in (1, 2, 3))
        every, at = np.unique(np.concatenate((ids, label)), return_inverse=True)
        x, y = at[: len(ids)], at[len(ids) :]
        total = np.bincount(x, links, len(every)).astype(np.int64)
        yield pa.record_batch([pa.array(every), pa.array(every[_least(len(every), x, y)]), pa.array(total)], ["id", "class_id", "links"])


def _compared(docs: DataFrame, threshold: float, n: int, id_col: str, text_col: str, as_pairs: bool) -> tuple[DataFrame, DataFrame]:
    """Rows of _found, or of _united; and (id, member) of the classes that may match any other or have several members."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be over 0 and at most 1")
    parts = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    sent, back = "part long, chunk long, whole boolean, keys binary, rows binary", "chunk long, part long, keys binary, rows binary, codes binary"

    def counted(df: DataFrame, sets, bits: int, tokens: bool) -> DataFrame:
        df = df.mapInArrow(_spread(sets, parts, bits), sent).repartition("part").sortWithinPartitions("part")
        return df.mapInArrow(_frequent(tokens), back).repartition("chunk").sortWithinPartitions("chunk")

    some = counted(texts, _sets_of_texts(n), 28, False).mapInArrow(_survivors(threshold), "id long").distinct()
    sets = texts.mapInArrow(_pack, "id long, packed binary").join(some, "id").select("id", "packed").mapInArrow(_set_rows(n), "id long, size long, s1 long, s2 long, map binary, grams binary")
    rows = checkpointed(sets.repartition("s1").sortWithinPartitions("s1", "s2", "size", "id").mapInArrow(_class_rows, "id long, member long, s1 long, size long, map binary, grams binary"))
    classes, members = rows.where("grams IS NOT NULL"), rows.select("id", "member").distinct()
    prefixes = counted(classes.select("id", "grams"), _stored_sets, 32, True).mapInArrow(_prefixes(threshold), "token long, id long, size int, left int")
    near = prefixes.repartition("token").sortWithinPartitions("token", "id").mapInArrow(_connected(threshold), "a long, b long")
    # classes of rows of different texts that share an identifier
    tied = members.groupBy("member").agg(F.min("id").alias("a"), F.collect_set("id").alias("ids")).where("size(ids) > 1").select("a", F.explode("ids").alias("b")).where("a <> b")
    roots = checkpointed(groups(near.unionByName(tied), "a", "b"))
    pieces = classes.select("id", "s1", "size", "map").join(roots, "id").select("root", "id", "s1", "size", "map").repartition("root").sortWithinPartitions("root", "id")
    pieces = pieces.mapInArrow(_blocks(threshold), "root long, id long, s1 long, piece long, side int")
    whole = classes.select("id", "s1", "grams").join(members.groupBy("id").agg(F.count(F.lit(1)).alias("n")), "id")
    both = pieces.join(whole, ["id", "s1"]).select("piece", "side", "root", "id", "n", "grams").repartition("piece").sortWithinPartitions("piece")
    if as_pairs:
        return both.mapInArrow(_found(threshold, True), "id_a long, id_b long, jaccard double"), members
    found = both.mapInArrow(_found(threshold, False), "root long, id long, links long, label long")
    found = found.unionByName(tied.join(roots, F.col("b") == F.col("id")).selectExpr("root", "b AS id", "0L AS links", "a AS label"))
    return found.repartition("root").sortWithinPartitions("root").mapInArrow(_united, "id long, class_id long, links long"), members


def jaccard_join(docs: DataFrame, threshold: float = 0.5, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_a, id_b, jaccard): the pairs of classes whose Jaccard index is at least the threshold, by their smallest
    identifiers, id_a < id_b; and for every other member of a class, its smallest identifier, the member, and 1.0. So
    the index of any two documents is that of the classes they belong to, without a row for each pair of copies.

    Texts that are NULL or have no words match nothing. Rows whose identifier is NULL can't be named and are left out.
    Repeated rows count once; rows that share an identifier but not a text are compared with others, not with each
    other. Identifiers are 64-bit integers. No rows give no rows.
    """
    found, members = _compared(docs, threshold, n, id_col, text_col, True)
    copies = members.where("id <> member").selectExpr("id AS id_a", "member AS id_b", "1.0D AS jaccard")
    return found.unionByName(copies).groupBy("id_a", "id_b").agg(F.max("jaccard").alias("jaccard"))


def _labels(docs: DataFrame, threshold: float, n: int, id_col: str, text_col: str) -> DataFrame:
    """Rows of near_links, of the documents that may have links only."""
    found, members = _compared(docs, threshold, n, id_col, text_col, False)
    copies = members.groupBy("id").agg(F.collect_set("member").alias("members"))
    out = copies.join(found, "id", "left").select("id", "class_id", F.expr("size(members) - 1 + coalesce(links, 0) AS links"), F.explode("members").alias("doc_id"))
    return out.groupBy("doc_id").agg(F.min(F.expr("coalesce(class_id, id)")).alias("class_id"), F.sum("links").alias("links"))


def near_links(docs: DataFrame, threshold: float = 0.5, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, links), a row for each identifier: how many other documents have a Jaccard index of at least the
    threshold with it, copies included, and the smallest identifier of those that links connect it with, over any number
    of them; its own, if it has none.

    A text that is NULL or has no words has no links. Rows whose identifier is NULL can't be named and are left out.
    Repeated rows count once; rows that share an identifier but not a text are one document, of no links between its own
    texts, and the links of these add up. Identifiers are 64-bit integers. No rows give no rows.
    """
    ids = docs.select(col(id_col).cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    return ids.join(_labels(docs, threshold, n, id_col, text_col), "doc_id", "left").selectExpr("doc_id", "coalesce(class_id, doc_id) AS class_id", "coalesce(links, 0L) AS links")


def document_pairs(found: DataFrame) -> DataFrame:
    """(id_a, id_b, jaccard) of all pairs of documents, id_a < id_b, from the rows of jaccard_join: each pair of classes
    for each two of their members, and each two members of a class. A class of n copies has n * (n - 1) / 2 rows."""
    members = found.where("jaccard = 1").selectExpr("id_a AS root", "id_b AS id")
    members = members.unionByName(found.selectExpr("explode(array(id_a, id_b)) AS root").selectExpr("root", "root AS id")).distinct()
    a, b = members.selectExpr("root AS id_a", "id AS a"), members.selectExpr("root AS id_b", "id AS b")
    across = found.where("jaccard < 1").join(a, "id_a").join(b, "id_b").select("a", "b", "jaccard")
    inside = members.selectExpr("root", "id AS a").join(members.selectExpr("root", "id AS b"), "root").selectExpr("a", "b", "1.0D AS jaccard")
    pairs = across.unionByName(inside).where("a <> b").selectExpr("least(a, b) AS id_a", "greatest(a, b) AS id_b", "jaccard")
    return pairs.groupBy("id_a", "id_b").agg(F.max("jaccard").alias("jaccard"))


def groups(pairs: DataFrame, a: str = "id_a", b: str = "id_b") -> DataFrame:
    """(id, root) of the connected components of pairs of 64-bit integers: the smallest member of each one's component.

    Alternates between hanging larger neighbours and smaller ones onto each node's smallest neighbour, until a round
    changes nothing; the rounds grow with the logarithm of the pairs. A node that has no pair doesn't appear.
    """
    edges = checkpointed(pairs.selectExpr(f"greatest({a}, {b}) AS u", f"least({a}, {b}) AS v").where("u <> v").distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.selectExpr("v AS u", "u AS v"))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.selectExpr("u", "least(u, m) AS m")
        large = both.join(low, "u").where("v > u").selectExpr("v AS u", "m AS v").where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").selectExpr("v AS u", "m AS v").unionByName(least.selectExpr("u", "m AS v"))
        edges = checkpointed(small.where("u <> v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    stars = edges.selectExpr("u AS id", "v AS root")
    return stars.unionByName(stars.selectExpr("root AS id", "root").distinct())


def near_dedup(docs: DataFrame, threshold: float = 0.5, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs but for those whose identifier isn't the smallest of its group, a group being a class of
    near_links. Columns as they were, whatever their names; rows without an identifier, with a NULL text or
    without words all stay, and so do all rows of an identifier that stays. Identifiers are 64-bit integers. No rows give no
    rows."""
    (gone,) = fresh(docs.columns, "gone_")
    lost = _labels(docs, threshold, n, id_col, text_col).where("doc_id <> class_id").select(F.col("doc_id").alias(gone))
    return docs.join(checkpointed(lost), col(id_col).cast("long") == F.col(gone), "left_anti")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_links() of all documents with all."""
    return near_links(read(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, [x FOR x IN string_split_regex(lower(text), '\s+') IF x <> ''] AS w FROM documents WHERE text IS NOT NULL),
g AS (
  SELECT doc_id, CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)])) END AS g
  FROM w WHERE len(w) > 0),
c AS (SELECT min(doc_id) AS id, count(DISTINCT doc_id) AS k, g FROM g GROUP BY g),
one AS (SELECT id, len(g) AS n, unnest(g) AS x FROM c),
shared AS (SELECT a.id AS id_a, b.id AS id_b, a.n AS na, b.n AS nb, count(*) AS k FROM one a JOIN one b ON a.x = b.x AND a.id < b.id GROUP BY ALL),
pair AS (SELECT id_a, id_b FROM shared WHERE k / CAST(na + nb - k AS DOUBLE) >= 0.5),
link AS (SELECT id_a AS a, id_b AS b FROM pair UNION ALL SELECT id_b, id_a FROM pair),
reach AS (SELECT id, id AS root FROM c UNION SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.id WHERE reach.root < link.b),
root AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
linked AS (SELECT link.a AS id, sum(c.k) AS k FROM link JOIN c ON c.id = link.b GROUP BY link.a),
d AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
SELECT d.doc_id, coalesce(root.root, d.doc_id) AS class_id, CAST(coalesce(c.k - 1, 0) + coalesce(linked.k, 0) AS BIGINT) AS links
FROM d LEFT JOIN g ON g.doc_id = d.doc_id LEFT JOIN c ON c.g = g.g LEFT JOIN root ON root.id = c.id LEFT JOIN linked ON linked.id = c.id
"""
