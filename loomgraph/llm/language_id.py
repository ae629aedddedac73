"""Language identification by word-first backoff.

A word that the model knows scores the logarithm of its frequency in each language. A word that it doesn't know is
scored by character n-grams, with a blank before and after it: by its known 4-grams if there are any, else by its known
3-grams, and so on down to single characters; the score is the mean over these. A text's score in a language is the sum
over its words, which are the runs of letters of the text in lower case.

Words and n-grams are hashed and looked up in NumPy, a megabyte of text at a time.
"""

from __future__ import annotations

import functools
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomgraph.llm.common import _BYTES, col, large_strings, mix, read, slices

#: Documents of each language that the model is fitted on, at most: those of smallest hash of the identifier.
MOST_PER_LANGUAGE = 800
LONGEST = 4


@functools.cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter or a mark that joins one, as the vowel signs of Indic scripts."""
    return np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)], bool)


class _Text:
    """Code points of texts in lower case, all but letters blank, with a blank around each text, and their words."""

    def __init__(self, texts: list[str]):
        low = [t.lower() for t in texts]
        code = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[np.minimum(code, 0x10FFFF)]
        self.code = np.where(letter, code, np.uint32(32))
        edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        self.start, self.end = edge[::2], edge[1::2]
        ends = np.cumsum([len(t) + 1 for t in low]) if low else np.zeros(0, np.int64)
        self.doc = np.searchsorted(ends, self.start, "left")
        up, self.down = _BYTES.to(len(code) + 1)
        self.total = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(self.code * up[: len(code)], out=self.total[1:])

    def words(self) -> np.ndarray:
        return mix((self.total[self.end] - self.total[self.start]) * self.down[self.start])

    def grams(self, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-grams of these words with their blanks, and the place in which of the word of each."""
        s, count = self.start[which] - 1, self.end[which] - self.start[which] + 3 - n
        if n == 1:  # blanks alone say nothing
            s, count = s + 1, count - 2
        count = np.maximum(count, 0)
        word = np.repeat(np.arange(len(which)), count)
        at = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count) + s[word]
        return mix(((self.total[at + n] - self.total[at]) * self.down[at]) + np.uint64(n)), word


class _Table:
    """Rows of scores by 64-bit hash; the keys are distinct, and each is known."""

    def __init__(self, keys: np.ndarray, scores: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.scores = keys[order], scores[order].astype(np.float32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The row of each, -1 if unknown."""
        if not len(self.keys):
            return np.full(len(h), -1, np.int32)
        i = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[i] == h, i, -1)


@dataclass
class Model:
    languages: list[str]
    words: _Table
    grams: dict[int, _Table]

    def scores(self, texts: list[str]) -> np.ndarray:
        """A row for each text, a column for each language; 0 throughout for a text without letters."""
        t = _Text(texts)
        out = np.zeros((len(texts), len(self.languages)))
        if not len(t.start) or not self.languages:
            return out
        row = self.words.find(t.words())
        for j in range(len(self.languages)):
            out[:, j] += np.bincount(t.doc[row >= 0], self.words.scores[row[row >= 0], j], len(texts))
        left = np.flatnonzero(row < 0)
        for n in range(LONGEST, 0, -1):
            if not len(left):
                break
            h, word = t.grams(left, n)
            g = self.grams[n].find(h)
            word, g = word[g >= 0], g[g >= 0]
            hits = np.bincount(word, minlength=len(left))
            of, seen = t.doc[left], hits > 0
            for j in range(len(self.languages)):
                s = np.bincount(word, self.grams[n].scores[g, j], len(left))
                out[:, j] += np.bincount(of[seen], s[seen] / hits[seen], len(texts))
            left = left[~seen]
        return out

    def best(self, texts: list[str]) -> list[str | None]:
        s = self.scores(texts)
        if not s.shape[1]:
            return [None] * len(texts)
        top = s.argmax(1)
        return [self.languages[i] if r.any() else None for i, r in zip(top.tolist(), s)]


def _count(counts: list[tuple[np.ndarray, np.ndarray]], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the keys of each language and their numbers: the keys seen at least so often, most frequent first, and the
    logarithm of their smoothed frequency."""
    known = np.unique(np.concatenate([u for u, _ in counts])) if counts else np.zeros(0, np.uint64)
    table = np.zeros((len(known), len(counts)))
    for j, (u, c) in enumerate(counts):
        table[np.searchsorted(known, u), j] = c
    total = table.sum(1)
    keep = np.flatnonzero(total >= least)
    keep = keep[np.argsort(-total[keep], kind="stable")]
    smooth = (table[keep] + 0.5) / (table.sum(0) + 0.5 * max(len(keep), 1))
    return known[keep], np.log(smooth)


def fit(rows: list[tuple[str, str]], least_word: int = 2, least_gram: int = 2) -> Model:
    """The model of (language, text) rows, which must not be NULL. A word that occurs less often than least_word in all rows
    together isn't known, as its frequency would tell the row rather than the language; n-grams likewise by least_gram."""
    languages = sorted({x for x, _ in rows})
    counts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(LONGEST + 1)]  # of words, 1-grams, 2-grams ...
    for lang in languages:  # one at a time, as the arrays are many times as large as the texts
        t = _Text([t for x, t in rows if x == lang])
        counts[0].append(np.unique(t.words(), return_counts=True))
        for n in range(1, LONGEST + 1):
            counts[n].append(np.unique(t.grams(np.arange(len(t.start)), n)[0], return_counts=True))
        del t
    words = _Table(*_count(counts[0], least_word))
    grams = {n: _Table(*_count(counts[n], least_gram)) for n in range(1, LONGEST + 1)}
    return Model(languages, words, grams)


def training_rows(docs: DataFrame, most_per_language: int, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """(language, text) of at most so many documents of each language, those of smallest hash of identifier. Only
    identifiers and languages are shuffled. Rows with a NULL among the three don't count; rows that agree in all count
    once, and of one identifier's rows in a language only so many as are bounded; no rows give none."""
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    ids = docs.where(col(lang_col).isNotNull() & col(id_col).isNotNull()).select(col(id_col).alias("id"), col(lang_col).alias("lang"))
    ids = ids.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most_per_language).select("id", "lang").distinct()
    rows = docs.select(col(id_col).alias("id"), col(lang_col).alias("lang"), col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    chosen = rows.join(F.broadcast(ids), ["id", "lang"]).withColumn("hash", F.xxhash64("text"))
    # one text of each identifier and hash, so that repeated rows don't add up on the driver
    pdf = chosen.groupBy("id", "lang", "hash").agg(F.first("text").alias("text")).select("lang", "text").toPandas().sort_values(["lang", "text"])
    return list(zip(pdf["lang"].tolist(), pdf["text"].tolist()))


def fit_documents(docs: DataFrame, most_per_language: int = MOST_PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of training_rows(); of no rows, one that knows no language."""
    return fit(training_rows(docs, most_per_language, id_col, text_col, lang_col))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, language) for each row, whole texts read.

    language is NULL for a text that is NULL or has no letters, and for all if the model was fitted on no rows. Ties
    go to the language that is first in alphabetical order. Repeated rows each appear. No rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches):
        for b in batches:
            texts, out = large_strings(b.column(1)), []
            for i, j in slices(texts):
                out += shared.value.best(texts.slice(i, j - i).to_pylist())
            yield pa.record_batch([b.column(0), pa.array(out, pa.string())], ["doc_id", "language"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("language", T.StringType())])
    return docs.select(col(id_col), col(text_col)).mapInArrow(apply, schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """identify() of all documents, by a model of some of them."""
    docs = read(spark, sf_dir, "documents")
    return identify(docs, fit_documents(docs))
