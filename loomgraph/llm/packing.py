"""Packing documents into windows by minimum bin slack.

For each window in turn, a subset-sum table over the remaining lengths, one bitset per length with the count of each
length bounded by what is left, finds the multiset whose sum is closest to the capacity; it is backtracked into a count
of each length. Of several multisets with the best sum, the one that is largest in lexicographic order of lengths is
taken, so long pieces go first. As the choice depends on the histogram of lengths alone, a multiset is used for as many
windows at once as the counts allow, and planning costs the same for any number of documents: the histogram has at most
as many entries as the window has tokens.

Documents are cut into pieces of at most a window, at token boundaries; a document's pieces, one after another, are the
document. Lengths are counted first, without text; then pieces are ranked among those of their length, for which they
are shuffled once, text and all, and by its rank each piece finds its window.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import checkpointed, col, read

#: A stand-in for the tokens of a subword vocabulary that needs no Python: runs of at most four letters or digits, and
#: single other signs.
TOKEN = r"[\p{L}\p{N}]{1,4}|[^\s\p{L}\p{N}]"


def plan_windows(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(number of windows, count of each length in each of them), in order, until no length is left."""
    sizes = sorted(s for s, n in counts.items() if n > 0)
    if sizes and not 1 <= sizes[0] <= sizes[-1] <= capacity:
        raise ValueError("lengths must be from 1 to the capacity")
    left = {s: counts[s] for s in sizes}
    mask = (1 << (capacity + 1)) - 1
    out = []
    table: list[int] = [1]  # table[i]: the sums that the i smallest lengths make
    bound: list[tuple[int, int]] = []  # the (length, count) that the table was built with
    while left:
        now = [(s, min(n, capacity // s)) for s, n in left.items()]
        same = 0
        while same < min(len(bound), len(now)) and bound[same] == now[same]:
            same += 1
        del table[same + 1 :]
        for s, n in now[same:]:
            reach, step = table[-1], 1
            while n > 0:  # n copies as 1 + 2 + 4 + ... + rest
                use = min(step, n)
                reach |= (reach << (s * use)) & mask
                n -= use
                step <<= 1
            table.append(reach)
        bound = now
        goal = table[-1].bit_length() - 1
        used: dict[int, int] = {}
        for i in range(len(now) - 1, -1, -1):
            if goal == 0:
                break
            s, n = now[i]
            n = min(n, goal // s)
            while not table[i] >> (goal - n * s) & 1:
                n -= 1
            if n:
                used[s] = n
                goal -= n * s
        times = min(left[s] // n for s, n in used.items())
        out.append((times, used))
        for s, n in used.items():
            left[s] -= times * n
            if not left[s]:
                del left[s]
    return out


def _plan_rows(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    taken: dict[int, int] = {}
    rows, window = [], 0
    for times, used in plan_windows(dict(zip(pdf["length"].tolist(), pdf["n"].tolist())), capacity):
        start = 0
        for s in sorted(used, reverse=True):
            a = taken.get(s, 0)
            rows.append((s, a, a + times * used[s], used[s], window, start))
            taken[s] = a + times * used[s]
            start += s * used[s]
        window += times
    return pd.DataFrame(rows, columns=["length", "from_rank", "to_rank", "per_window", "first_window", "offset"]).astype("int64")


def encoded(path: str):
    """A function from a column of text to the column of its token numbers, by a tokenizer file at a path that all executors
    can read; NULL for NULL."""

    @F.pandas_udf("array<int>")
    def encode(text: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True  # their names in a text are text
        got = tokenizer.encode_batch([t or "" for t in text], add_special_tokens=False)
        return pd.Series([None if t is None else e.ids for t, e in zip(text, got)], dtype="object")

    return encode


def pack(docs: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", tokens=None, pieces_per_bucket: int = 5_000) -> DataFrame:
    """A row for each piece: doc_id, piece, start (the piece's first token in the document), n_tokens, window_id,
    window_offset (the piece's first token in its window), and the piece itself: text, or tokens if these were given. The
    pieces of a window never overlap nor exceed it.

    tokens: the column of arrays of tokens, such as encoded(path)(col(text)); without, the matches of TOKEN count as tokens,
    and blanks go with the token after them, those at the end with the last. A document over the capacity is cut into full
    windows and a rest; nothing of it is lost. NULL and empty texts, and others of no tokens, are one piece of 0 tokens
    whose window_id and window_offset are NULL. Repeated rows are packed as often as they appear; which of them, or of other
    rows with one identifier, goes where is left open. No rows give no rows.
    """
    given = tokens is not None
    count = F.size(tokens) if given else F.regexp_count(col(text_col), F.lit(TOKEN))
    count = F.greatest(F.coalesce(count, F.lit(0)), F.lit(0)).cast("long")
    n_pieces = F.greatest(F.lit(1), F.ceil(F.col("n") / capacity)).cast("long")
    place = [(F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).alias("length")]

    def cut(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), n_pieces - 1)))
        return rows.withColumns({"start": place[0], "length": place[1]})

    def bucketed(pieces: DataFrame) -> DataFrame:
        return pieces.join(F.broadcast(lengths), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.col("buckets"))).drop("buckets")

    sized = checkpointed(docs.select(col(id_col).alias("doc_id"), count.alias("n")))
    # at most `capacity` rows and one, whatever the input, so both this and the plan may be broadcast
    histogram = checkpointed(cut(sized).groupBy("length").agg(F.count(F.lit(1)).alias("n")))
    lengths = histogram.select("length", F.ceil(F.col("n") / pieces_per_bucket).alias("buckets"))
    # a piece's rank among those of its length: the ones in buckets before, and the ones before it in its bucket
    counted = bucketed(cut(sized)).groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("m"))
    before = counted.selectExpr("length", "bucket", "sum(m) OVER (PARTITION BY length ORDER BY bucket) - m AS before")
    schema = "length long, from_rank long, to_rank long, per_window long, first_window long, offset long"
    plan = histogram.where("length > 0").withColumn("all", F.lit(0)).groupBy("all").applyInPandas(lambda pdf: _plan_rows(pdf, capacity), schema)
    plan = checkpointed(plan.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("from_rank", "to_rank", "per_window", "first_window", "offset"))).alias("uses")))
    if given:
        pieces = cut(docs.select(col(id_col).alias("doc_id"), tokens.alias("all_"), count.alias("n")))
        pieces = pieces.withColumn("tokens", F.slice("all_", (F.col("start") + 1).cast("int"), F.lit(capacity))).drop("all_")
    else:
        text = col(text_col)
        words = F.when(F.col("n") > capacity, F.regexp_extract_all(F.col("text"), F.lit(rf"\s*(?:{TOKEN})"), F.lit(0)))
        pieces = cut(docs.select(col(id_col).alias("doc_id"), text.alias("text"), count.alias("n")).withColumn("all_", words))
        part = F.array_join(F.slice("all_", (F.col("start") + 1).cast("int"), F.lit(capacity)), "")
        last = F.col("start") + F.col("length") == F.col("n")
        part = F.when(last, F.concat(part, F.regexp_extract("text", r"(\s*)\z", 1))).otherwise(part)
        pieces = pieces.withColumn("text", F.when(F.col("all_").isNull(), F.col("text")).otherwise(part)).drop("all_")
    what = "tokens" if given else "text"
    pieces = bucketed(pieces.select("doc_id", "piece", "start", "length", what))
    ranked = pieces.join(before, ["length", "bucket"]).selectExpr("*", "before + row_number() OVER (PARTITION BY length, bucket ORDER BY doc_id, piece) - 1 AS r")
    # pieces of no tokens have no part in the plan
    return _place(ranked.join(F.broadcast(plan), "length", "left"), what)


def _place(ranked: DataFrame, what: str) -> DataFrame:
    use = F.try_element_at(F.filter("uses", lambda u: (u["from_rank"] <= F.col("r")) & (F.col("r") < u["to_rank"])), F.lit(1))
    return ranked.withColumn("u", use).selectExpr("doc_id", "piece", "start", "length AS n_tokens", "u.first_window + (r - u.from_rank) DIV u.per_window AS window_id", "u.offset + length * ((r - u.from_rank) % u.per_window) AS window_offset", what)


def windows(packed: DataFrame) -> DataFrame:
    """(window_id, n_tokens, pieces): each window's pieces in their order, as (window_offset, doc_id, piece, n_tokens, and
    text or tokens). Pieces without tokens are in none. No rows give no rows."""
    what = "tokens" if "tokens" in packed.columns else "text"
    rows = packed.where("window_id IS NOT NULL").groupBy("window_id")
    return rows.agg(F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("window_offset", "doc_id", "piece", "n_tokens", what))).alias("pieces"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack() of all documents, into windows of 2048 tokens."""
    return pack(read(spark, sf_dir, "documents"))
