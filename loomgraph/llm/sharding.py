"""Sharding by Karmarkar-Karp differencing.

A partial partition is k bins of groups. The two partial partitions of largest spread (largest bin less smallest) are
combined oppositely ordered, largest bins with smallest, until one is left. The combination of partial partitions is a
partial partition again, so the work is a tree: each bucket of groups, of a bounded expected number, differences its own
groups; then the buckets' results, k bins each, are differenced against each other, fan_in at a time.

A group that is large for a bucket's share of a bin can't be made up for there, and once all buckets have spread their
groups evenly, nowhere. If there are such groups, they are differenced first, all together. Each bucket then differences
its groups with a copy of the large groups' bins, scaled down to its share of the rest, so that what it puts into a bin
is what the large groups leave free; the groups of the last bucket level out what all others have left.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import checkpointed, col, read


def difference(parts: list[list[int]], k: int) -> tuple[list[list[int]], list[int]]:
    """The bin, of k, of each entry of each partial partition (a list of at most k sizes), and the bins' sizes.
    Ties go by order of entry, so the result depends on the input's order alone."""
    if not parts:
        return [], [0] * k
    sums, tree = [], []
    heap = []
    for i, p in enumerate(parts):
        order = sorted(range(len(p)), key=lambda j: (-p[j], j))
        sums.append([p[j] for j in order] + [0] * (k - len(p)))
        tree.append(order)
        heap.append((-(sums[i][0] - sums[i][-1]), i))
    heapq.heapify(heap)
    links: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        together = np.array(sums[a], np.int64) + np.array(sums[b][::-1], np.int64)
        order = np.argsort(-together, kind="stable")
        sums[a] = sums[b] = None
        sums.append(together[order].tolist())
        links.append((a, b, order.astype(np.int32)))
        heapq.heappush(heap, (-(sums[-1][0] - sums[-1][-1]), len(sums) - 1))
    final = heap[0][1]
    where: dict[int, np.ndarray] = {final: np.arange(k, dtype=np.int32)}
    n = len(parts)
    for i in range(len(links) - 1, -1, -1):
        a, b, order = links[i]
        at = where.pop(n + i)
        mine = np.empty(k, np.int32)
        mine[order] = at  # where each bin of a, before the sort, has come to
        where[a], where[b] = mine, mine[::-1]
    bins = []
    for i, order in enumerate(tree):
        out = [0] * len(order)
        for rank, j in enumerate(order):
            out[j] = int(where[i][rank])
        bins.append(out)
    return bins, sums[final]


#: A group is large if it is over this part of a bucket's share of a bin; so there are under buckets * k / LARGE of them.
LARGE = 0.25


def _sorted(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(["size", "group"], ascending=[False, True], na_position="last", kind="stable")


def _around(base: list[int], whole: int | None, k: int):
    """Bins for the groups of a bucket that even out bins filled already with base, or with the bucket's part of whole
    of it; the bins keep their numbers."""

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _sorted(pdf)
        share = base if whole is None else [x * int(pdf["size"].sum()) // max(1, whole) for x in base]
        # bins equally filled are taken in another order by each bucket, else its remainders would add up in the same ones
        order = np.random.default_rng(int(pdf["bucket"].iloc[0])).permutation(k)
        bins, _ = difference([[share[j] for j in order], *([s] for s in pdf["size"].tolist())], k)
        number = np.empty(k, np.int32)
        number[bins[0]] = order
        return pdf.assign(bin=number[[b[0] for b in bins[1:]]])

    return apply


def shard_groups(groups: DataFrame, k: int, per_bucket: int = 50_000, fan_in: int = 256) -> DataFrame:
    """(group, size, shard) for a table (group, size) of distinct groups; shard is 0..k-1. Groups of equal size go by the
    order of the groups. A size that is NULL counts 0, as do groups of no bytes, which go to any shard. No groups give no
    rows."""
    if k < 1:
        raise ValueError("k must be at least 1")
    groups = checkpointed(groups)
    n, total = groups.agg(F.count(F.lit(1)), F.sum("size")).first()
    buckets = max(1, -(-n // per_bucket))

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _sorted(pdf)
        bins, _ = difference([[s] for s in pdf["size"].tolist()], k)
        return pdf.assign(bin=np.array([b[0] for b in bins], np.int32))

    kind = groups.schema["group"].dataType.simpleString()
    schema = f"`group` {kind}, size long, bucket long, bin int"
    at = groups.withColumn("bucket", F.pmod(F.xxhash64("group"), F.lit(buckets)).cast("long"))
    if buckets > 1:
        large = F.coalesce(F.col("size") > F.lit(LARGE * (total or 0) / (buckets * k)), F.lit(False))

        def filled(df: DataFrame) -> list[int]:
            sums = {r["bin"]: r["size"] for r in df.groupBy("bin").agg(F.sum("size").alias("size")).collect()}
            return [sums.get(j, 0) for j in range(k)]

        if groups.where(large).limit(1).count():
            done = checkpointed(groups.where(large).withColumn("bucket", F.lit(-1).cast("long")).groupBy("bucket").applyInPandas(local, schema))
            small = at.where(~large & (F.col("bucket") > 0))
            whole = small.agg(F.sum("size")).first()[0] or 0
            done = done.unionAll(checkpointed(small.groupBy("bucket").applyInPandas(_around(filled(done), whole, k), schema)))
            done = done.unionAll(at.where(~large & (F.col("bucket") == 0)).groupBy("bucket").applyInPandas(_around(filled(done), None, k), schema))
            return done.select("group", "size", F.col("bin").alias("shard"))
    at = checkpointed(at.groupBy("bucket").applyInPandas(local, schema))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bucket", "bin"], kind="stable")
        lists = pdf.groupby("bucket", sort=True)["size"].apply(list)
        bins, _ = difference(lists.tolist(), k)
        return pdf.assign(to=np.concatenate([np.array(b, np.int32) for b in bins]))

    while buckets > 1:
        sums = at.groupBy("bucket", "bin").agg(F.sum("size").alias("size")).withColumn("upper", F.floor(F.col("bucket") / fan_in).cast("long"))
        moved = sums.groupBy("upper").applyInPandas(merge, "bucket long, bin int, size long, upper long, to int").select("bucket", "bin", "upper", "to")
        at = checkpointed(at.join(moved, ["bucket", "bin"]).select("group", "size", F.col("upper").alias("bucket"), F.col("to").alias("bin")))
        buckets = -(-buckets // fan_in)
    return at.select("group", "size", F.col("bin").alias("shard"))


def shard_documents(docs: DataFrame, k: int = 64, id_col: str = "doc_id", text_col: str = "text", group_cols: list[str] | None = None, per_bucket: int = 50_000, fan_in: int = 256) -> DataFrame:
    """(doc_id, n_bytes, shard) for each row: k shards of nearly equal bytes of text, no group divided.

    A group is the rows that agree in group_cols (NULLs agree); without these, the rows with the same text, so that
    copies never lie in two shards. NULL and empty texts have 0 bytes. Repeated rows each appear and each count. With
    fewer groups than shards, some shards stay empty. No rows give no rows.
    """
    key = F.md5(F.coalesce(col(text_col), F.lit("")).cast("binary")) if group_cols is None else F.md5(F.to_json(F.struct(*(F.coalesce(F.concat(F.lit("+"), col(c).cast("string")), F.lit("-")).alias(f"c{i}") for i, c in enumerate(group_cols)))))
    rows = checkpointed(docs.select(col(id_col).alias("doc_id"), F.coalesce(F.octet_length(col(text_col)), F.lit(0)).cast("long").alias("n_bytes"), key.alias("group")))
    shards = shard_groups(rows.groupBy("group").agg(F.sum("n_bytes").alias("size")), k, per_bucket, fan_in)
    return rows.join(shards.select("group", "shard"), "group").select("doc_id", "n_bytes", "shard")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shard_documents() of all documents, copies kept together."""
    return shard_documents(read(spark, sf_dir, "documents"))
