"""Mixing sources to target weights by Poisson replication.

A source whose share is to become w of a corpus of total size T gets the repetition rate w * T / size. Each document's
number of copies is a Poisson variate with that mean, found by inverting the distribution at a uniform number hashed
from the seed and the document's identifier; so it depends on nothing but these, whatever the partitioning or the
retries. The copies are then shuffled globally by a hash of seed, identifier and copy number.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import checkpointed, col, fresh, read

#: Bytes of the sources' distribution functions that are broadcast, at most; if they are more, documents are joined with
#: them by a shuffle over salted sources. Both ways give the same rows.
MOST_BROADCAST = 32 << 20
SALTS = 64
#: A larger mean is the sum of equal ones of at most this, each with its own uniform number, so that a distribution
#: function is at most about 150 numbers, however large the rate.
MOST_MEAN = 64.0


def thresholds(rate: float) -> list[float]:
    """The Poisson distribution function at 0, 1, 2 ... as far as it is told from 1 by 52 bits: of a uniform u, as many
    of these as are not over u is the variate."""
    if not rate > 0:
        return [1.0]
    out, total, k = [], 0.0, 0
    while True:
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        out.append(min(total, 1.0))
        if k > rate and (total >= 1 - 2**-52 or math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) < 2**-60):
            return out
        k += 1


def source_rates(docs: DataFrame, source_col: str, size_col: str, weights: dict | None, power: float, epochs: float, text_col: str | None = None) -> DataFrame:
    """A row for each source: its size and its mean repetition rate. weights: target share by source, any scale;
    sources that it doesn't name get none. Without: shares in proportion to size ** power. A NULL size is the length of
    the text, if text_col is given."""
    size = F.coalesce(col(size_col), F.length(col(text_col))) if text_col else col(size_col)
    sizes = docs.groupBy(col(source_col).alias("source")).agg(F.coalesce(F.sum(F.greatest(size, F.lit(0)).cast("long")), F.lit(0)).alias("size"))
    if weights is None:
        wanted = F.when(F.col("size") > 0, F.pow(F.col("size").cast("double"), F.lit(power))).otherwise(0.0)
    else:
        wanted = F.lit(0.0)
        for k, w in weights.items():
            wanted = F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(w))).otherwise(wanted)
    sizes = sizes.withColumn("wanted", wanted)
    sums = sizes.agg(F.sum("size").alias("total"), F.sum("wanted").alias("all_wanted"))
    rate = F.col("wanted") / F.col("all_wanted") * (F.col("total") * F.lit(float(epochs))) / F.col("size")
    return sizes.crossJoin(sums).select("source", "size", F.when((F.col("size") > 0) & (F.col("all_wanted") > 0), rate).otherwise(0.0).alias("rate"))


def uniform(seed: int, id_col, text_col, part=None):
    """52 bits of MD5 as a number in [0, 1); of parts after the first one, another number for each."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), text_col, F.lit("")))
    if part is not None:
        named = F.concat(named, F.lit(":"), part.cast("string"))
    return F.conv(F.substring(F.md5(named), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def mix_sources(
    docs: DataFrame, weights: dict | None = None, power: float = 0.5, epochs: float = 1.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size_col: str = "n_chars", copy_col: str | None = None, most_broadcast: int = MOST_BROADCAST
) -> DataFrame:
    """The documents, each as often as its Poisson variate says, in a random order; with copy_col, numbered from 0. A
    copy_col that is a column of docs is a ValueError.

    Sizes are the sums of size_col: where it is NULL, the characters of the text count; negative ones count 0. A NULL
    source is a source of its own. A source of size 0, or one that weights doesn't name, gets rate 0: none of its
    documents stay. A document whose identifier is NULL is hashed by its text instead. Rows that share an identifier share
    the number of copies, and their order among each other is left open. No rows give no rows.
    """
    if copy_col and copy_col.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"{copy_col!r} is a column already")

    @F.pandas_udf("array<double>")
    def cdf(rate: pd.Series) -> pd.Series:
        return rate.map(thresholds)

    rates = source_rates(docs, source_col, size_col, weights, power, epochs, text_col)
    src, parts, steps, copy, salt, mine, order = fresh(docs.columns, "source_", "parts_", "steps_", copy_col or "copy_", "salt_", "salt_of_", "order_")
    many = F.greatest(F.lit(1), F.ceil(F.col("rate") / MOST_MEAN).cast("int"))
    rates = checkpointed(rates.select(F.col("source").alias(src), many.alias(parts), cdf(F.col("rate") / many).alias(steps)))
    on = col(source_col).eqNullSafe(F.col(src))
    bytes_ = rates.agg(F.coalesce(F.sum(8 * F.size(steps) + 64), F.lit(0))).first()[0]
    if bytes_ <= most_broadcast:
        joined = docs.join(F.broadcast(rates), on)
    else:
        spread = rates.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = docs.withColumn(mine, F.pmod(F.xxhash64(col(id_col), col(text_col)), F.lit(SALTS)).cast("int")).join(spread, on & (F.col(mine) == F.col(salt)))

    def variate(u):
        return F.aggregate(F.col(steps), F.lit(0), lambda n, c: n + F.when(c <= u, 1).otherwise(0))

    first = variate(uniform(seed, col(id_col), col(text_col)))
    rest = F.aggregate(F.sequence(F.lit(1), F.col(parts) - 1), F.lit(0), lambda n, j: n + variate(uniform(seed, col(id_col), col(text_col), j)))
    times = first + F.when(F.col(parts) > 1, rest).otherwise(0)
    # one row for each copy; of 0 copies, none
    out = joined.select(*(col(c) for c in docs.columns), times.alias(steps)).where(F.col(steps) > 0)
    out = out.select(*(col(c) for c in docs.columns), F.explode(F.sequence(F.lit(0), F.col(steps) - 1)).alias(copy))
    out = out.withColumn(order, F.xxhash64(F.lit(seed), col(id_col), F.col(copy)))
    out = out.repartition(F.col(order)).sortWithinPartitions(F.col(order))
    return out.select(*(col(c) for c in docs.columns), *([F.col(copy).alias(copy_col)] if copy_col else []))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mix_sources() of all documents, with the number of each copy."""
    return mix_sources(read(spark, sf_dir, "documents"), copy_col="copy")


OP6_SQL = """
WITH sizes AS (SELECT source, CAST(sum(greatest(n_chars, 0)) AS DOUBLE) AS size FROM documents GROUP BY source),
rates AS (
  SELECT source, sqrt(size) / (SELECT sum(sqrt(size)) FROM sizes) * (SELECT sum(size) FROM sizes) / size AS rate
  FROM sizes WHERE size > 0),
steps AS (
  SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c
  FROM rates, (SELECT unnest(range(0, 200)) AS k)),
u AS (
  SELECT doc_id, CAST(('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u, source
  FROM documents),
times AS (SELECT u.doc_id, count(*) AS n FROM u JOIN steps ON u.source IS NOT DISTINCT FROM steps.source AND c <= u GROUP BY u.doc_id)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, CAST(c.k AS INTEGER) AS copy
FROM documents d JOIN times t ON d.doc_id = t.doc_id JOIN (SELECT unnest(range(0, 200)) AS k) c ON c.k < t.n
"""
