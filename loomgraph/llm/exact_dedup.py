"""Exact dedup by Patricia-trie owners.

Rows are partitioned by the length and the 64-bit hash of their text. Each partition inserts the full byte strings into
compressed radix tries, one for each length, whose terminal nodes store the smallest identifier, which owns the string.
Rows come sorted by length, hash and identifier (Spark's sort, which spills to disk as it needs to), so that a string of
an earlier hash isn't asked for again: once a trie holds more bytes than it may, its largest subtrees under the root are
closed and freed until half is left, between one hash and the next.

Before the shuffle, each task inserts its own texts into a trie in the same way, so that a text that is there many times
is sent once for each task or batch, not with each copy.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from loomgraph.llm.common import col, read

#: Bytes of labels that a trie may hold. One string that is longer is held all the same, until the next.
MOST_BYTES = 64 << 20


class Trie:
    """A compressed radix trie of byte strings. Each node is [label, children by first byte, owner]; an owner is
    stored at terminal nodes only. nodes: how many there are but for the root. held: bytes of their labels."""

    def __init__(self) -> None:
        self.root: list = [b"", {}, None]
        self.nodes = self.held = 0
        self.weight: dict[int, list[int]] = {}  # of each subtree under the root: bytes, nodes

    def insert(self, key: bytes, owner) -> tuple[bool, object, object]:
        """Whether the string is new, its owner before, and its owner now: the smallest that was inserted with it; None
        comes last."""
        node, at, n = self.root, 0, len(key)
        while at < n:
            child = node[1].get(key[at])
            if child is None:
                node[1][key[at]] = [key[at:], {}, (owner,)]
                self._grown(key[0], n - at, 1)
                return True, None, owner
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            k = len(os.path.commonprefix((label, key[at : at + len(label)])))
            upper = [label[:k], {label[k]: child}, None]
            child[0], node[1][key[at]] = label[k:], upper
            self._grown(key[0], 0, 1)
            node, at = upper, at + k
        if node[2] is None:
            node[2] = (owner,)
            return True, None, owner
        old = node[2][0]
        if owner is not None and (old is None or owner < old):
            node[2] = (owner,)
        return False, old, node[2][0]

    def _grown(self, first: int, size: int, nodes: int) -> None:
        w = self.weight.setdefault(first, [0, 0])
        w[0] += size
        w[1] += nodes
        self.held += size
        self.nodes += nodes

    def close(self, most: int) -> None:
        """Frees the largest subtrees under the root until at most so many bytes are held."""
        while self.held > most and self.weight:
            first = max(self.weight, key=lambda k: self.weight[k][0])
            size, nodes = self.weight.pop(first)
            del self.root[1][first]
            self.held -= size
            self.nodes -= nodes


def _binary(a: pa.Array) -> pa.Array:
    return a.cast(pa.large_binary())


def _first(batches, n: int, at: int, most: int):
    """The rows, of n columns, of which that at this place is the text, and after them size, hash and id, that may own their
    text as far as the task knows."""
    trie = Trie()
    for b in batches:
        keep = []
        for text, i in zip(_binary(b.column(at)), b.column(n + 2).to_pylist()):
            if not text.is_valid:
                keep.append(True)
                continue
            new, old, now = trie.insert(text.as_py(), i)
            keep.append(new or (i is not None and (old is None or i < old)))
            if trie.held > most:
                trie.close(most // 2)
        yield b.filter(pa.array(keep, pa.bool_()))


def _owned(batches, n: int, at: int, most: int):
    """The rows that own their text, of what _first gives, sorted by size, hash and id."""
    size, key, trie = None, None, Trie()
    for b in batches:
        keep = []
        for text, s, h, i in zip(_binary(b.column(at)), *(b.column(n + j).to_pylist() for j in range(3))):
            if not text.is_valid:
                keep.append(True)
                continue
            if s != size:
                trie = Trie()
            elif h != key and trie.held > most:
                trie.close(most // 2)
            size, key = s, h
            keep.append(trie.insert(text.as_py(), i)[0])
        yield b.select(range(n)).filter(pa.array(keep, pa.bool_()))


def _least(ids: list) -> object:
    return min((i for i in ids if i is not None), default=None)


def _combined(kind):
    """(text, size, hash, least, ids): each text of a batch once, from rows (text, size, hash, id); a NULL one for each row."""

    def apply(batches):
        for b in batches:
            trie, ids, row = Trie(), [], []
            for k, (text, i) in enumerate(zip(_binary(b.column(0)), b.column(3).to_pylist())):
                new, _, at = trie.insert(text.as_py(), len(ids)) if text.is_valid else (True, None, None)
                if new:
                    ids.append([])
                    row.append(k)
                    at = len(ids) - 1
                ids[at].append(i)
            rows = b.take(pa.array(row, pa.int64()))
            yield pa.record_batch([*(rows.column(j) for j in range(3)), pa.array([_least(x) for x in ids], kind), pa.array(ids, pa.list_(kind))], ["text", "size", "hash", "least", "ids"])

    return apply


def _named(kind, most: int):
    """(doc_id, owner_id) of each identifier, from the rows of _combined sorted by size, hash and least."""

    def apply(batches):
        size, key, trie = None, None, Trie()
        for b in batches:
            ids, owner = [], []
            for text, s, h, least, of in zip(_binary(b.column(0)), *(b.column(j).to_pylist() for j in range(1, 5))):
                if text.is_valid:
                    if s != size:
                        trie = Trie()
                    elif h != key and trie.held > most:
                        trie.close(most // 2)
                    size, key = s, h
                    least = trie.insert(text.as_py(), least)[2]
                ids += of
                owner += [least] * len(of)
            yield pa.record_batch([pa.array(ids, kind), pa.array(owner, kind)], ["doc_id", "owner_id"])

    return apply


def _key(text, ident) -> list:
    """size and hash of a text; of a NULL one, a hash of the identifier, so that such rows don't come to one task."""
    return [F.octet_length(text).alias("size"), F.when(text.isNull(), F.xxhash64(ident)).otherwise(F.xxhash64(text)).alias("hash")]


def owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """(doc_id, owner_id) for each row: the smallest identifier of all rows with the very same bytes of text.

    A NULL text is nobody's copy: its owner is its own identifier. Empty texts are copies of each other. A row whose
    identifier is NULL owns a text only if no other row does. Repeated rows each appear. No rows give no rows.
    """
    kind = docs.schema[id_col].dataType
    ddl = kind.simpleString()
    arrow = to_arrow_type(kind)
    rows = docs.select(col(text_col).alias("text"), *_key(col(text_col), col(id_col)), col(id_col).alias("id"))
    combined = rows.mapInArrow(_combined(arrow), f"text {rows.schema['text'].dataType.simpleString()}, size int, hash long, least {ddl}, ids array<{ddl}>")
    # sorted by the least identifier, a text's first row has the smallest of all
    combined = combined.repartition("size", "hash").sortWithinPartitions("size", "hash", F.col("least").asc_nulls_last())
    out = T.StructType([T.StructField("doc_id", kind), T.StructField("owner_id", kind)])
    return combined.mapInArrow(_named(arrow, most_bytes), out)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """The rows of docs that own their text, all columns as they were: of each group of equal texts the one with the
    smallest identifier; of rows that agree in text and identifier, one. Rows with NULL text all stay; no rows give no
    rows."""
    n, at = len(docs.columns), docs.columns.index(text_col)
    # named c0, c1 ... as mapInArrow takes no names with dots
    rows = docs.select(*(col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)), *_key(col(text_col), col(id_col)), col(id_col).alias("id"))
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)])
    first = rows.mapInArrow(lambda batches: _first(batches, n, at, most_bytes), rows.schema)
    first = first.repartition("size", "hash").sortWithinPartitions("size", "hash", F.col("id").asc_nulls_last())
    return first.mapInArrow(lambda batches: _owned(batches, n, at, most_bytes), schema).toDF(*docs.columns)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """owners() of all documents."""
    return owners(read(spark, sf_dir, "documents"))


OP7_SQL = """
SELECT doc_id, CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS owner_id
FROM documents
"""
