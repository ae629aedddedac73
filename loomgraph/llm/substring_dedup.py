"""Repeated passages by prefix-partitioned suffix trees.

Which word sequences of at least min_words occur in two documents or more, or, with within, in two places at all? Each
such passage is a path of the suffix tree of all documents that goes min_words deep and has leaves of two documents, or
two leaves, below. Only suffixes that can have such a
path are built into trees, and they are told exactly: of the k-word prefixes (k half of min_words) of the suffixes in any
run of min_words words, the one of smallest hash is an anchor, wherever the run occurs; so if a run occurs twice, its
anchors are shared, and suffixes whose anchors aren't shared have no deep node.

The suffixes with shared anchors are partitioned by a prefix of variable length: from a suffix's own first word up to
the end of its anchor, k to min_words words. Prefixes are gathered into groups of a bounded number of anchors, so that a
group's trees fit in memory; a prefix with more suffixes than that is divided by longer prefixes. A group sorts the paths
of its suffixes; those that share a path of min_words words are the leaves of a deep node. Of the longest prefixes, whole
paths, each is sent once for a chunk of places, however many of these have it; whether it is a deep node comes back to the
chunk, for all of its places. Of the leaves, repeated_spans joins those that overlap or touch in a document.

maximal_repeats follows the suffixes to their full depth. A repeat that can't be longer to the left begins at a deep
node whose leaves differ in the word before (or have none); only those leaves' suffixes are taken, each as far as words
are covered by deep nodes. As in a suffix tree, what lies between two branchings is one edge: where a deep node's leaves
differ in the word after (or have none), an edge ends, and it is sent as its hash and length, not word by word. Two
suffixes that agree so far have their branchings in the same places, as these follow from the words before them; and they
part at one. Sorted by their edges, the longest repeat of each suffix is what it has in common with a neighbour. They are
sorted in parts, packed, and these merged where equal nodes meet.

Runs, passages that repeat p words over and over (p up to half of min_words), would have each of their words begin a
suffix as long as the rest of the text. A repeat that begins in a run and goes beyond its end, and can't be longer to the
left, has in its other place as many of the run's words, which begin or end a run there, or does so itself; so only where
lengths of runs of the same period, with the same word after, tell that this may be are suffixes followed beyond the run.
Within it, those from the first p + 1 words are enough: what others repeat lies in the run without its first p words,
which repeats.
"""

from __future__ import annotations

import heapq
import io
import struct
import tempfile
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import Groups, Words, arrow_lists, col, column, fixed_binary, from_binary, large_strings, mix, read, run_starts, slices, whole_groups

MIN_WORDS = 50
#: Anchors in a group, at most, and of one prefix before it is divided by longer ones, down to paths of min_words words,
#: which aren't divided further. It bounds memory; results are the same for any number.
GROUP = 20_000
#: Places round anchors of more suffixes than that, whose paths are made distinct at a time. It bounds memory, too.
CHUNK = 1 << 20

#: Packed parts that are merged at a time.
FAN = 64

#: Places one after another, from word a of document id on.
_RUN = np.dtype([("id", np.int64), ("a", np.int32), ("n", np.int32)])

_A, _C = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def _sliding(x: np.ndarray, w: int, least: bool) -> np.ndarray:
    """Minimum or maximum of each w neighbours."""
    f = np.minimum if least else np.maximum
    size = 1
    while size * 2 <= w:
        x = f(x[:-size], x[size:])
        size *= 2
    rest = w - size
    return f(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(w: Words, min_words: int, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words at which an anchor begins, and the hash of its k words."""
    k = (min_words + 1) // 2
    width = min_words - k + 1
    h, whole = w.grams(k, total)
    if len(w) < min_words:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = h >> np.uint64(1)  # so that no hash is the largest number
    low = _sliding(np.where(whole, h, np.uint64(0xFFFFFFFFFFFFFFFF)), width, True)
    fits = w.doc[: len(low)] == w.doc[min_words - 1 :]  # the run lies in one text
    low = np.where(fits, low, np.uint64(0))
    pad = np.zeros(width - 1, np.uint64)
    high = _sliding(np.concatenate((pad, low, pad)), width, False)
    at = np.flatnonzero(whole & (high == h) & (h > 0))
    return at, h[at]


def _find(min_words: int):
    def apply(batches):
        for b in batches:
            ids, texts = column(b, 0), large_strings(b.column(1))
            for i, j in slices(texts):
                w = Words(texts.slice(i, j - i))
                at, h = anchors(w, min_words, w.sums())
                doc = w.doc[at]
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(ids[i:j][doc]), pa.array((at - w.first[doc]).astype(np.int32))], ["anchor", "id", "at"])

    return apply


def _repeats(r: np.ndarray, ids: np.ndarray, at: np.ndarray, within: bool) -> np.ndarray:
    """Which of the groups that begin at r have two documents, or, within, two places."""
    out = np.minimum.reduceat(ids, r[:-1]) != np.maximum.reduceat(ids, r[:-1])
    return out | (np.minimum.reduceat(at, r[:-1]) != np.maximum.reduceat(at, r[:-1])) if within else out


def _shared(group: int, within: bool):
    """The anchors, from rows (anchor, id, at) sorted by anchor, that two documents have, or two places; many, if they have
    more than a group. Of an anchor no more than a group is held at a time."""

    def rows(ids: np.ndarray, at: np.ndarray, many: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(ids), pa.array(at), pa.array(many)], ["id", "at", "many"])

    def apply(batches):
        key, n, sent, ids, at = None, 0, False, np.zeros(0, np.int64), np.zeros(0, np.int32)

        def shared() -> bool:
            return len(ids) > 1 and bool(_repeats(np.array([0, len(ids)]), ids, at, within)[0])

        for b in batches:
            h = column(b, 0)
            r = run_starts(h)
            for j in sorted({0, len(r) - 2}) if len(h) else ():  # the runs that may go on before or after the batch
                if j == 0 and h[0] == key:
                    ids, at = np.concatenate((ids, column(b, 1)[: r[1]])), np.concatenate((at, column(b, 2)[: r[1]]))
                    n += int(r[1])
                else:
                    if not sent and shared():
                        yield rows(ids, at, np.full(len(ids), n > group))
                    key, n, sent = int(h[r[j]]), int(r[j + 1] - r[j]), False
                    ids, at = column(b, 1)[r[j] : r[j + 1]], column(b, 2)[r[j] : r[j + 1]]
                if n > group and (sent or shared()):
                    yield rows(ids, at, np.ones(len(ids), bool))
                    ids, at, sent = ids[:0], at[:0], True
                elif n > group:  # one place of rows that are repeated
                    ids, at = ids[:1], at[:1]
                if j == 0 and len(r) > 3:  # those in between are whole
                    inner = slice(int(r[1]), int(r[-2]))
                    cut = r[1:-1] - r[1]
                    many = _repeats(cut, column(b, 1)[inner], column(b, 2)[inner], within)
                    size = np.diff(cut)
                    keep = np.repeat(many, size)
                    yield rows(column(b, 1)[inner][keep], column(b, 2)[inner][keep], np.repeat(size > group, size)[keep])
        if not sent and shared():
            yield rows(ids, at, np.full(len(ids), n > group))

    return apply


def _path(anchor: np.ndarray, left: np.ndarray, right: np.ndarray, o: int, k: int, min_words: int) -> np.ndarray:
    """Fingerprints of the first min_words words of the suffixes that begin o words before their anchors. left, right:
    sums that determine the words before and after, by their number."""
    return mix(mix(anchor + np.uint64(o)) + left[:, o] * _A + right[:, min_words - k - o] * _C)


def _sums(words: np.ndarray) -> np.ndarray:
    """In column j, a number that determines the first j words of each row."""
    base = np.multiply.accumulate(np.full(words.shape[1], np.uint64(0xD1342543DE82EF95)))
    out = np.zeros((len(words), words.shape[1] + 1), np.uint64)
    np.cumsum(mix(words.astype(np.uint64)) * base, axis=1, out=out[:, 1:])
    return out


def _beside(n: np.ndarray, words: np.ndarray, o: int) -> np.ndarray:
    """The word after o others, away from the anchor, -1 if the text has none there: of the words to the left, that before
    the suffixes that begin o words before their anchors; of those to the right, that after a path."""
    return np.where(n > o, words[:, o].astype(np.int64), -1)


def _differ(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Of each group of words beside paths, from r on, the word, or -1 if they differ or one is."""
    low = np.minimum.reduceat(x, r[:-1])
    return np.where(low == np.maximum.reduceat(x, r[:-1]), low, -1)


def _paths(chunk: int, path: np.ndarray, ids: np.ndarray, at: np.ndarray, before: np.ndarray, after: np.ndarray, within: bool) -> pa.RecordBatch:
    """Rows (prefix, id, at, around, before, after, sure, chunk, number, runs): each path of a chunk once, with one of its
    places; whether it is sure to be a deep node, with what the chunk has of it; the word beside it, -1 if there is none
    somewhere or two differ; and the runs of places whose first has this path. Paths are numbered as they come in the texts,
    so that a passage has numbers one after another, and another copy of it is a run."""
    order = np.lexsort((at, ids))
    path, ids, at, before, after = (x[order] for x in (path, ids, at, before, after))
    _, first, inverse = np.unique(path, return_index=True, return_inverse=True)
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    number, first = rank[inverse], np.sort(first)
    by = np.argsort(number, kind="stable")
    r = run_starts(number[by])
    sure = _repeats(r, ids[by], at[by], within)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(ids) != 0) | (np.diff(at) != 1) | (np.diff(number) != 1)
    start = np.flatnonzero(new)
    runs_ = np.empty(len(start), _RUN)
    runs_["id"], runs_["a"], runs_["n"] = ids[start], at[start], np.diff(np.append(start, len(at)))
    n = np.bincount(number[start], minlength=len(first))
    off = np.zeros(len(first) + 1, np.int32)
    np.cumsum(n * _RUN.itemsize, out=off[1:])
    runs_ = runs_[np.argsort(number[start], kind="stable")]
    some = pa.py_buffer(np.packbits(n > 0, bitorder="little"))
    binary = pa.Array.from_buffers(pa.binary(), len(first), [some, pa.py_buffer(off), pa.py_buffer(runs_)])
    columns = [path[first].view(np.int64), ids[first], at[first].astype(np.int32), pa.nulls(len(first), pa.binary()), _differ(before[by], r), _differ(after[by], r), sure, np.full(len(first), chunk), np.arange(len(first), dtype=np.int32), binary]
    return pa.record_batch([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], _CUT)


_CUT = ["prefix", "id", "at", "around", "before", "after", "sure", "chunk", "number", "runs"]


def _cut(min_words: int, within: bool = False, most: int = CHUNK):
    """Rows (prefix, id, at, around, before, after, sure, chunk, number, runs): an anchor with the words before and after it;
    or, of anchors with too many suffixes, the paths of these by longer prefixes, themselves, nothing around, as _paths
    gives them for each chunk. A path is taken for its smallest anchor only, the first if there are more: wherever it is,
    that is the same."""
    k = (min_words + 1) // 2
    side = min_words - k

    def around(w: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        doc = w.doc[at]
        n_left = np.minimum(at - w.first[doc], side + 1)
        n_right = np.minimum(w.first[doc + 1] - at - k, side + 1)
        step = np.arange(side + 1)
        short = (w.hash >> np.uint64(32)).astype(np.uint32)
        last = len(w) - 1
        left = short[np.maximum(at[:, None] - 1 - step, 0)]
        right = short[np.minimum(at[:, None] + k + step, last)]
        return n_left, n_right, left, right

    def apply(batches):
        task = TaskContext.get()
        chunk = (task.partitionId() if task else 0) << 32
        held: list[tuple[np.ndarray, ...]] = []
        n_held = 0
        for b in batches:
            ids, texts = column(b, 0), _unpack(b.column(1))
            lists, flags = b.column(2), b.column(3)
            for i, j in slices(texts, 1 << 19):
                w = Words(texts.slice(i, j - i))
                n = lists.slice(i, j - i).value_lengths().to_numpy()
                doc = np.repeat(np.arange(j - i), n)
                rel = lists.slice(i, j - i).flatten().to_numpy().astype(np.int64)
                many = flags.slice(i, j - i).flatten().to_numpy(zero_copy_only=False)
                at = w.first[doc] + rel
                ok = at + k <= w.first[doc + 1]  # it may not, if two rows have one identifier
                doc, rel, at, many = doc[ok], rel[ok], at[ok], many[ok]
                if not len(at):
                    continue
                every = w.grams(k)[0] >> np.uint64(1)
                h = every[at]
                n_left, n_right, left, right = around(w, at)
                few = ~many
                ctx = np.concatenate((n_left[few, None].astype(np.uint32), n_right[few, None].astype(np.uint32), left[few], right[few]), 1)
                none = [pa.nulls(int(few.sum()), kind) for kind in (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.binary())]
                yield pa.record_batch([pa.array(h[few].view(np.int64)), pa.array(ids[i:j][doc[few]]), pa.array(rel[few].astype(np.int32)), fixed_binary(ctx), *none], _CUT)
                if many.any():
                    h, rel, owner, place = h[many], rel[many], ids[i:j][doc[many]], at[many]
                    low = _sliding(every, side + 1, True) if len(every) > side else every[:0]
                    nl, nr, words, more = n_left[many], n_right[many], left[many], right[many]
                    ls, rs = _sums(words), _sums(more)
                    own = np.ones(len(h), bool)
                    for o in range(side + 1):
                        if o:
                            own &= every[np.maximum(place - o, 0)] != h
                        fits = np.flatnonzero((nl >= o) & (nr >= side - o) & own)
                        fits = fits[low[place[fits] - o] == h[fits]]  # other paths round this anchor have another as their own
                        p = _path(h[fits], ls[fits], rs[fits], o, k, min_words)
                        held.append((p, owner[fits], rel[fits] - o, _beside(nl[fits], words[fits], o), _beside(nr[fits], more[fits], side - o)))
                        n_held += len(fits)
                    if n_held >= most:
                        yield _paths(chunk, *map(np.concatenate, zip(*held)), within)
                        held, n_held, chunk = [], 0, chunk + 1
        if n_held:
            yield _paths(chunk, *map(np.concatenate, zip(*held)), within)

    return apply


def _nodes(path: np.ndarray, ids: np.ndarray, at: np.ndarray, within: bool, *beside: np.ndarray) -> np.ndarray:
    """Rows of flags of the suffixes: whether they share their path with one of another document, or of another place, and so
    are leaves of deep nodes; and for each column of words beside the suffixes, whether the leaves differ in it, or have
    none."""
    order = np.argsort(path, kind="stable")
    r = run_starts(path[order])
    flags = [_repeats(r, ids[order], at[order], within)]
    for x in beside:
        x = x[order]
        low = np.minimum.reduceat(x, r[:-1])
        flags.append((low < 0) | (low != np.maximum.reduceat(x, r[:-1])))
    out = np.zeros((len(flags), len(path)), bool)
    out[:, order] = np.repeat(np.stack(flags), np.diff(r), axis=1)
    return out


def _trees(min_words: int, group: int, within: bool, nodes: bool = False):
    """Rows (id, a, b, at, open, ends): the span of the deep nodes' leaves round the anchor at this word; and, if nodes are
    asked for, two bits for each o from 0 on: whether the leaf o words before the anchor is one that a repeat may begin at,
    and whether an edge ends with its path. Of paths, without words around, rows (chunk, number, flags, runs) in further
    columns, where they are deep nodes, or runs begin with them."""
    k = (min_words + 1) // 2
    side = min_words - k

    def spans(t: pa.Table):
        if not t.num_rows:
            return
        prefix, ids, at = column(t, 0).view(np.uint64), column(t, 1), column(t, 2).astype(np.int64)
        ctx = from_binary(t.column(3), np.uint32, 4 + 2 * side)
        n_left, n_right = ctx[:, 0].astype(np.int64), ctx[:, 1].astype(np.int64)
        words, more = ctx[:, 2 : 3 + side], ctx[:, 3 + side :]
        left, right = _sums(words), _sums(more)
        first = np.full(len(at), -1)
        last = np.full(len(at), -1)
        bits = np.zeros((2, len(at), side + 1), bool)
        for o in range(side + 1):
            fits = np.flatnonzero((n_left >= o) & (n_right >= side - o))
            if not len(fits):
                continue
            path = _path(prefix[fits], left[fits], right[fits], o, k, min_words)
            beside = (_beside(n_left[fits], words[fits], o), _beside(n_right[fits], more[fits], side - o)) if nodes else ()
            flags = _nodes(path, ids[fits], at[fits], within, *beside)
            deep = fits[flags[0]]
            if nodes:
                bits[:, deep, o] = flags[1:, flags[0]]
            last[deep] = np.where(last[deep] < 0, o, last[deep])
            first[deep] = o
        hit = first >= 0
        yield ids[hit], (at - first)[hit], (at - last)[hit] + min_words, at[hit], bits[:, hit]

    def apply(batches):
        held: list[pa.Table] = []
        n = 0

        def flush():
            for x in spans(pa.concat_tables(held)):
                none = [pa.nulls(len(x[0]), kind) for kind in (pa.int64(), pa.int32(), pa.int32(), pa.binary())]
                yield pa.record_batch([*_leaf_rows(*x, nodes), *none], _LEAVES + _MARKS)

        def take(tables: list[pa.Table]):
            nonlocal held, n
            for t in tables:
                if held and n + t.num_rows > group:
                    yield from flush()
                    held, n = [], 0
                held.append(t)
                n += t.num_rows

        anchors_ = Groups()
        for b in batches:
            paths = b.filter(pc.and_(b.column(3).is_null(), pc.or_(b.column(4), b.column(9).is_valid())))
            if paths.num_rows:
                yield by_path(paths)
            yield from take(anchors_.push(b.filter(b.column(3).is_valid())))
        yield from take(anchors_.end())
        if held:
            yield from flush()

    def by_path(b: pa.RecordBatch) -> pa.RecordBatch:
        flags = sum(column(b, c).astype(np.int32) << j for j, c in enumerate((4, 5, 6)))
        none = [pa.nulls(b.num_rows, kind) for kind in (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())]
        return pa.record_batch([*none, b.column(7), b.column(8), pa.array(flags), b.column(9)], _LEAVES + _MARKS)

    return apply


_LEAVES, _MARKS = ["id", "a", "b", "at", "open", "ends"], ["chunk", "number", "flags", "runs"]


def _leaf_rows(ids: np.ndarray, a: np.ndarray, b: np.ndarray, at: np.ndarray, bits: np.ndarray, nodes: bool) -> list[pa.Array]:
    both = [fixed_binary(np.packbits(x, axis=1)) if nodes else pa.nulls(len(ids), pa.binary()) for x in bits]
    return [pa.array(ids), *(pa.array(x.astype(np.int32)) for x in (a, b, at)), *both]


def _placed(min_words: int, nodes: bool):
    """Rows (id, a, b, at, open, ends) as of _trees, from its rows, those of paths sorted by chunk: the places of a chunk's
    runs get the flags of their paths. Where they are deep nodes, those of as many words as have bits make a row."""
    side = min_words - (min_words + 1) // 2

    def apply(batches):
        g = Groups(6)
        for b in batches:
            leaves = b.filter(b.column(6).is_null())
            if leaves.num_rows:
                yield leaves.select(_LEAVES)
            for t in g.push(b.filter(b.column(6).is_valid())):
                yield from chunks(t)
        for t in g.end():
            yield from chunks(t)

    def chunks(t: pa.Table):
        r = run_starts(column(t, 6))
        for x, y in zip(r[:-1].tolist(), r[1:].tolist()):
            yield from places(t.slice(x, y - x))

    def places(t: pa.Table):
        number, binary = column(t, 7).astype(np.int64), t.column(9)
        found = np.frombuffer(b"".join(binary.drop_null().to_pylist()), _RUN)
        n = found["n"].astype(np.int64)
        first = np.repeat(number, pc.fill_null(pc.binary_length(binary), 0).to_numpy() // _RUN.itemsize)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        flags = np.zeros(max(int(number.max()), int((first + n).max(initial=0))) + 1, np.int32)
        flags[number] = column(t, 8)
        flag = flags[np.repeat(first, n) + step]
        deep = flag & 1 > 0
        ids, at, flag = np.repeat(found["id"], n)[deep], (np.repeat(found["a"].astype(np.int64), n) + step)[deep], flag[deep]
        if not len(ids):
            return
        order = np.lexsort((at, ids))
        ids, at, flag = ids[order], at[order], flag[order]
        part = at // (side + 1)
        new = np.ones(len(ids), bool)
        new[1:] = (np.diff(ids) != 0) | (np.diff(part) != 0)
        start = np.flatnonzero(new)
        row = np.cumsum(new) - 1
        end = part[start] * (side + 1) + side
        bits = np.zeros((2, len(start), side + 1), bool)
        for j in (0, 1):
            some = flag >> (j + 1) & 1 > 0
            bits[j, row[some], end[row[some]] - at[some]] = True
        yield pa.record_batch(_leaf_rows(ids[start], at[start], at[np.append(start[1:], len(at)) - 1] + min_words, end, bits, nodes), _LEAVES)

    return apply


def _joined(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans that overlap or touch made one; sorted by id and a."""
    r = run_starts(ids)
    lift = np.repeat(np.arange(len(r) - 1), np.diff(r)) << 33
    end = np.maximum.accumulate(b + lift)
    new = np.ones(len(ids), bool)
    new[1:] = (a + lift)[1:] > end[:-1]
    at = np.flatnonzero(new)
    return ids[at], a[at], end[np.append(at[1:], len(ids)) - 1] - lift[at]


def _merge(batches):
    """Spans that overlap or touch made one, from rows (id, a, b) sorted by id and a."""
    for t in whole_groups(batches):
        if t.num_rows:
            ids, a, b = _joined(column(t, 0), column(t, 1).astype(np.int64), column(t, 2).astype(np.int64))
            yield pa.record_batch([pa.array(ids), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array((b - a).astype(np.int32))], ["doc_id", "from_word", "to_word", "n_words"])


def _by_document(min_words: int):
    """Rows (id, at, to, ends): the places in a document that a repeat may begin at, how far spans reach from there, and
    where edges end; from rows (id, a, b, at, open, ends) sorted by id and a."""

    def places(t: pa.Table, j: int, ids: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        width = len(t.column(j)[0].as_py())
        row, o = np.nonzero(np.unpackbits(from_binary(t.column(j), np.uint8, width), axis=1))
        own, number = np.unique(ids, return_inverse=True)
        both = np.unique(number[row] << 33 | (anchor[row] - o))
        return np.stack([own[both >> 33], both & ((1 << 33) - 1)], 1)

    def apply(batches):
        for t in whole_groups(batches):
            if not t.num_rows:
                continue
            ids, anchor = column(t, 0), column(t, 3).astype(np.int64)
            own, _, end = _joined(ids, column(t, 1).astype(np.int64), column(t, 2).astype(np.int64))
            begin, ends = (places(t, j, ids, anchor) for j in (4, 5))
            if not len(begin):
                continue
            ids, a = begin.T
            number = np.unique(np.concatenate((own, ids)), return_inverse=True)[1] << 33
            to = end[np.searchsorted(end + number[: len(own)], a + number[len(own) :], "right")]
            r = run_starts(ids)
            ends = ends[np.isin(ends[:, 0], ids)]
            cut = np.append(np.searchsorted(ends[:, 0], ids[r[:-1]]), len(ends))
            yield pa.record_batch([pa.array(ids[r[:-1]]), *(arrow_lists(r, x.astype(np.int32)) for x in (a, to)), arrow_lists(cut, (ends[:, 1] + min_words).astype(np.int32))], ["id", "at", "to", "ends"])

    return apply


def runs(w: Words, min_words: int) -> np.ndarray:
    """Rows (first word, end, p) of the longest runs of at least min_words words with a smallest period p of at most half
    as many words, sorted."""
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 2]
    for p in range(1, min_words // 2 + 1):
        i = np.arange(0, max(len(w) - p, 0), min_words - p)  # any run has one of these words
        x = y = np.zeros(0, np.int64)
        if ((w.hash[i] == w.hash[i + p]) & (w.doc[i] == w.doc[i + p])).any():
            same = (w.hash[:-p] == w.hash[p:]) & (w.doc[:-p] == w.doc[p:])
            edge = np.flatnonzero(np.diff(same.astype(np.int8), prepend=0, append=0))
            x, y = edge[::2], edge[1::2] + p
            x, y = x[y - x >= min_words], y[y - x >= min_words]
            for d in range(1, p):
                if p % d == 0 and len(x):
                    new = ~np.isin(x, found[d][0])
                    x, y = x[new], y[new]
        found.append((x, y))
    out = np.concatenate([np.stack([x, y, np.full(len(x), p)], 1) for p, (x, y) in enumerate(found)])
    return out[np.argsort(out[:, 0])]


def _run_keys(w: Words, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the runs' last p words and the word after are, as a hash; and which have a word after."""
    x, y, p = found.T
    after = y < w.first[w.doc[x] + 1]
    last = w.spans(y - p, y, w.sums())
    return mix(last ^ mix(w.hash[np.minimum(y, len(w) - 1)] + p.astype(np.uint64))), after


def _runs(min_words: int):
    """Rows (key, id, at, n, p) of the runs that a word follows."""

    def apply(batches):
        for b in batches:
            ids, texts = column(b, 0), large_strings(b.column(1))
            for i, j in slices(texts):
                w = Words(texts.slice(i, j - i))
                found = runs(w, min_words)
                if not len(found):
                    continue
                key, after = _run_keys(w, found)
                x, y, p = found[after].T
                doc = w.doc[x]
                first = x == w.first[doc]
                before = pa.array(w.hash[np.maximum(x - 1, 0)].view(np.int64), mask=first)
                ints = [pa.array(v.astype(np.int32)) for v in (x - w.first[doc], y - x)]
                yield pa.record_batch([pa.array(key[after].view(np.int64)), pa.array(ids[i:j][doc]), *ints, before], ["key", "id", "at", "n", "before"])

    return apply


def _in_runs(w: Words, doc: np.ndarray, rel: np.ndarray, to: np.ndarray, min_words: int, named: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Which places are to be followed, and how far. Of those with at least min_words words of a run to come, the named
    ones as far as the others; the first p + 1 of a run just beyond it; the rest not at all."""
    found = runs(w, min_words)
    if not len(found):
        return np.ones(len(rel), bool), to
    at = w.first[doc] + rel
    k = np.maximum(np.searchsorted(found[:, 0], at, "right") - 1, 0)
    x, y, p = found[k].T
    of = np.repeat(np.arange(len(named)), named.fill_null([]).value_lengths().to_numpy())
    inner = (at >= x) & (y - at >= min_words) & ~np.isin(at, w.first[of] + named.fill_null([]).flatten().to_numpy())
    return ~inner | (at <= x + p), np.where(inner, np.minimum(to, y + 1), to)


def _suffixes(min_words: int, most: int = 8 << 20):
    """Rows (near, packed), as _together packs them, of texts with the rows of _by_document and the places named by
    _run_places: of the suffixes, the first min_words words from a place on, as a hash, and the edges that follow as far as
    spans reach, each as hash and length. near is the least hash of a few words among the first min_words ones: equal nodes
    have equal ones, and so have most neighbours in a text."""
    few = min(8, (min_words + 1) // 2)

    def edges(w: Words, total: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty((len(a), 3), np.uint32)
        h = w.spans(a, b, total)
        out[:, 0], out[:, 1], out[:, 2] = h >> np.uint64(32), h & np.uint64(0xFFFFFFFF), b - a
        return out

    def apply(batches):
        out, size = [], 0
        for b in batches:
            ids, texts = column(b, 0), _unpack(b.column(1))
            for i, j in slices(texts):
                w = Words(texts.slice(i, j - i))
                if len(w) < min_words:
                    continue
                total = w.sums()
                h, _ = w.grams(min_words, total)
                near = _sliding(w.grams(few, total)[0], min_words - few + 1, True).view(np.int64)
                lists, far, ends = (b.column(c).slice(i, j - i) for c in (2, 3, 4))
                doc = np.repeat(np.arange(j - i), lists.value_lengths().to_numpy())
                rel = lists.flatten().to_numpy().astype(np.int64)
                at = w.first[doc] + rel
                to = np.minimum(w.first[doc] + far.flatten().to_numpy(), w.first[doc + 1])
                follow, to = _in_runs(w, doc, rel, to, min_words, b.column(5).slice(i, j - i))
                ok = follow & (to - at >= min_words)  # it may be less, if two rows have one identifier
                doc, rel, at, to = doc[ok], rel[ok], at[ok], to[ok]
                of = np.repeat(np.arange(j - i), ends.value_lengths().to_numpy())
                stop = w.first[of] + ends.flatten().to_numpy()
                stop = stop[stop <= w.first[of + 1]]
                first, last = np.searchsorted(stop, at + min_words, "right"), np.searchsorted(stop, to, "right")
                between = edges(w, total, stop[:-1], stop[1:])  # those across two texts are never used
                some = last > first
                begin = np.zeros((len(at), 3), np.uint32)
                begin[some] = edges(w, total, at[some] + min_words, stop[first[some]])
                tail = between.tobytes()
                size += len(tail)
                for v, x, p, e, d, q, c in zip(h[at].view(np.int64).tolist(), begin, first.tolist(), last.tolist(), ids[i:j][doc].tolist(), rel.tolist(), near[at].tolist()):
                    out.append((c, d, q, v, x.tobytes() if e > p else b"", tail, 12 * p, 12 * (e - 1)))
                    size += 300  # about what this takes
                    if size > most:
                        yield _together(out, most)
                        out, size = [], len(tail)
        if out:
            yield _together(out, most)

    return apply


def _run_places(texts: DataFrame, min_words: int) -> DataFrame:
    """(id, named): the places in runs from which a repeat may go beyond the run: with as many of its words to come as
    another run of the same key has in all; or a run's first, if a longer run has the key, or one as long with another
    word before, or none."""
    found = texts.mapInArrow(_runs(min_words), "key long, id long, at int, n int, before long")
    key, same = Window.partitionBy("key"), Window.partitionBy("key", "n")
    n_same, n_known = F.count(F.lit(1)).over(same), F.count("before").over(same)
    differ = F.coalesce(F.min("before").over(same) != F.max("before").over(same), F.lit(False))
    found = found.withColumns({"sizes": F.collect_set("n").over(key), "first": (F.max("n").over(key) > F.col("n")) | differ | ((n_same > 1) & (n_known < n_same))})
    ends = "transform(filter(sizes, q -> q < n), q -> at + n - q)"
    places = found.select("id", F.explode(F.expr(f"concat({ends}, IF(first, array(at), array()))")).alias("at"))
    return places.groupBy("id").agg(F.collect_set("at").alias("named"))


#: Of a packed suffix: node, id, at, bytes of its edges, which follow.
_HEAD = struct.Struct("<qqii")


def _together(out: list[tuple], most: int) -> pa.RecordBatch:
    """Rows (near, packed) of suffixes (near, id, at, node, first edge, edges of texts, where in these the others begin and
    end): those with one near are sorted by node and suffix and compressed against each other, as far as they are no longer
    than most. Copies, and neighbours in a text, end with the same edges, so this takes far less than the suffixes."""
    z = zstandard.ZstdCompressor(level=3)
    out.sort(key=lambda x: x[:3])
    near, packed = [], []
    i = 0
    while i < len(out):
        j, size, rows = i, 0, []
        while j < len(out) and out[j][0] == out[i][0] and size <= most:
            _, d, q, v, begin, edges, a, b = out[j]
            rows.append((v, begin + edges[a:b], d, q))
            size += len(rows[-1][1])
            j += 1
        rows.sort()
        packed.append(z.compress(b"".join(x for v, suffix, d, q in rows for x in (_HEAD.pack(v, d, q, len(suffix)), suffix))))
        near.append(out[i][0])
        i = j
    return pa.record_batch([pa.array(near, pa.int64()), pa.array(packed, pa.binary())], ["near", "packed"])


def _apart(packed):
    """Suffixes (node, suffix, id, at) of a packed part, or of a file of them, one after another."""
    z = zstandard.ZstdDecompressor()
    small = isinstance(packed, bytes) and zstandard.frame_content_size(packed) <= 1 << 18
    f = io.BytesIO(z.decompress(packed)) if small else z.stream_reader(packed)
    while head := f.read(_HEAD.size):
        v, d, q, n = _HEAD.unpack(head)
        yield v, f.read(n) if n else b"", d, q


def _written(rows):
    """The same rows, from a file."""
    f = tempfile.TemporaryFile()  # noqa: SIM115
    with zstandard.ZstdCompressor(level=1).stream_writer(f, closefd=False) as to:
        for v, suffix, d, q in rows:
            to.write(_HEAD.pack(v, d, q, len(suffix)) + suffix)
    f.seek(0)
    return _apart(f)


def _in_order(batches, fan: int = FAN):
    """Suffixes (node, suffix, id, at), sorted for each near, from rows (near, packed) sorted by near. Of one near, fan
    parts are merged at a time, so that no group is held; the results, if there are more, by files."""
    levels: dict[int, list] = defaultdict(list)

    def push(rows, k: int = 0) -> None:
        levels[k].append(rows)
        if len(levels[k]) == fan:
            push(_written(heapq.merge(*levels.pop(k))), k + 1)

    def merged():
        yield from heapq.merge(*(x for rows in levels.values() for x in rows))
        levels.clear()

    key = None
    for b in batches:
        for near, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if near != key:
                yield from merged()
                key = near
            push(_apart(packed))
    yield from merged()


def _common(x: bytes, y: bytes) -> int:
    """Words of the edges that both begin with."""
    n = min(len(x), len(y)) // 12
    a = np.frombuffer(x, np.uint32, 3 * n).reshape(n, 3)
    if x[: 12 * n] != y[: 12 * n]:
        a = a[: int((a != np.frombuffer(y, np.uint32, 3 * n).reshape(n, 3)).any(1).argmax())]
    return int(a[:, 2].sum())


def _longest(min_words: int):
    """Rows (id, a, b) of the longest repeat at each place, from rows (near, packed) sorted by near."""

    def apply(batches):
        place, last, most = None, b"", 0
        out = []
        for node, suffix, i, p in _in_order(batches):
            if place != (node, i, p):
                n = min_words + _common(last, suffix) if place and place[0] == node else 0
                if place and max(most, n):
                    out.append((*place[1:], max(most, n)))
                place, most = (node, i, p), n
                if len(out) >= 10_000:
                    yield _spans(out)
                    out = []
            last = suffix
        if place and most:
            out.append((*place[1:], most))
        yield _spans(out)

    return apply


def _spans(out: list[tuple]) -> pa.RecordBatch:
    x = np.array(out, np.int64).reshape(-1, 3)
    return pa.record_batch([pa.array(x[:, 0]), pa.array(x[:, 1].astype(np.int32)), pa.array((x[:, 1] + x[:, 2]).astype(np.int32))], ["id", "a", "b"])


def _outer(batches):
    """Spans that lie in no other one of their document, from rows (id, a, b) sorted by id, a, and b from the largest."""
    for t in whole_groups(batches):
        ids, a, b = column(t, 0), column(t, 1), column(t, 2).astype(np.int64)
        if not len(ids):
            continue
        r = run_starts(ids)
        end = np.maximum.accumulate(b + (np.repeat(np.arange(len(r) - 1), np.diff(r)) << 33))
        keep = np.ones(len(ids), bool)
        keep[1:] = end[1:] > end[:-1]
        yield pa.record_batch([pa.array(ids[keep]), pa.array(a[keep]), pa.array(b[keep].astype(np.int32)), pa.array((b - a)[keep].astype(np.int32))], ["doc_id", "from_word", "to_word", "n_words"])


def _pack(batches):
    """Rows (id, packed) of rows (id, text): Zstandard takes a third less than the codec of the shuffle."""
    z = zstandard.ZstdCompressor(level=1)
    for b in batches:
        raw = b.column(1).cast(pa.binary())
        yield pa.record_batch([b.column(0), pa.array([z.compress(x.as_buffer()) for x in raw], pa.binary())], ["id", "packed"])


def _unpack(a: pa.Array) -> pa.Array:
    z = zstandard.ZstdDecompressor()
    return pa.array([z.decompress(x.as_buffer()) for x in a], pa.large_binary()).cast(pa.large_string())


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")


def _packed(texts: DataFrame) -> DataFrame:
    return texts.mapInArrow(_pack, "id long, packed binary")


def _leaves(texts: DataFrame, min_words: int, group: int, within: bool, nodes: bool = False) -> DataFrame:
    if min_words < 2:
        raise ValueError("min_words must be at least 2")
    found = texts.mapInArrow(_find(min_words), "anchor long, id long, at int").repartition("anchor").sortWithinPartitions("anchor")
    shared = found.mapInArrow(_shared(group, within), "id long, at int, many boolean")
    lists = shared.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("at", "many"))).alias("x")).select("id", F.col("x.at").alias("at"), F.col("x.many").alias("many"))
    rows = _packed(texts).join(lists, "id").select("id", "packed", "at", "many")
    cut = rows.mapInArrow(_cut(min_words, within), "prefix long, id long, at int, around binary, before long, after long, sure boolean, chunk long, number int, runs binary")
    # of the suffixes that are divided by their paths, however many chunks a path has: whether it is a deep node, and whether
    # words beside its leaves differ, or there are none; by windows, which spill, so that no group is held
    all_ = Window.partitionBy("prefix")
    differ = lambda c: F.min(c).over(all_) != F.max(c).over(all_)
    deep = F.max("sure").over(all_) | (differ("id") | differ("at") if within else differ("id"))
    cut = cut.repartition("prefix").withColumns({"deep": deep, "open": differ("before") | (F.min("before").over(all_) < 0), "ends": differ("after") | (F.min("after").over(all_) < 0)})
    cut = cut.select("prefix", "id", "at", "around", "deep", "open", "ends", "chunk", "number", "runs").sortWithinPartitions("prefix")
    leaves = "id long, a int, b int, at int, open binary, ends binary"
    found = cut.mapInArrow(_trees(min_words, group, within, nodes), f"{leaves}, chunk long, number int, flags int, runs binary")
    # a path's flags go back to its chunks, which hold the places
    found = found.repartition(F.coalesce("chunk", "id")).sortWithinPartitions("chunk")
    return found.mapInArrow(_placed(min_words, nodes), leaves)


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text", within: bool = False) -> DataFrame:
    """(doc_id, from_word, to_word, n_words) for each longest span of words, counted from 0, to_word not included, that
    consists of sequences of at least min_words words which another document has as well, or, with within, which begin in
    another place too, be it of the same document; such places may overlap.

    Words are what ASCII white space divides, compared byte by byte. Texts that are NULL or shorter have no spans. Rows
    whose identifier is NULL can't be named and are left out. Rows that share an identifier are one document: what they
    repeat of each other doesn't count (with within, not in the same place), and their spans are merged. Identifiers are
    64-bit integers. No rows give no rows.
    """
    leaves = _leaves(_texts(docs, id_col, text_col), min_words, group, within)
    spans = leaves.repartition("id").sortWithinPartitions("id", "a")
    return spans.mapInArrow(_merge, "doc_id long, from_word int, to_word int, n_words int")


def maximal_repeats(docs: DataFrame, min_words: int = MIN_WORDS, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, from_word, to_word, n_words) for each passage of at least min_words words that begins in another place
    too, of any document, and lies in no longer such passage of its own. Passages of a document may overlap; each is
    repeated as a whole. Words, NULLs, identifiers and shared ones are taken as by repeated_spans with within."""
    texts = _texts(docs, id_col, text_col)
    leaves = _leaves(texts, min_words, group, True, True).repartition("id").sortWithinPartitions("id", "a")
    # one plan without a cut: both joins read the same exchange of the texts
    lists = leaves.mapInArrow(_by_document(min_words), "id long, at array<int>, to array<int>, ends array<int>")
    places = lists.join(_run_places(texts, min_words), "id", "left")
    suffixes = _packed(texts).join(places, "id").select("id", "packed", "at", "to", "ends", "named").mapInArrow(_suffixes(min_words), "near long, packed binary")
    longest = suffixes.repartition("near").sortWithinPartitions("near").mapInArrow(_longest(min_words), "id long, a int, b int")
    spans = longest.repartition("id").sortWithinPartitions("id", "a", F.desc("b"))
    return spans.mapInArrow(_outer, "doc_id long, from_word int, to_word int, n_words int")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """maximal_repeats() of all documents."""
    return maximal_repeats(read(spark, sf_dir, "documents"))
