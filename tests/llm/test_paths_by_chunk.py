import functools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from test_methods import brute_maximal, brute_repeats

from loomgraph.llm import common, substring_dedup


def test_a_path_is_sent_once_a_chunk_and_a_copy_of_a_passage_is_a_run():
    rng = random.Random(4)
    passage = " ".join(f"w{rng.randrange(1000)}" for _ in range(100))
    texts = [f"a{i} {passage} z{i}" for i in range(50)]
    arr = pa.array(texts, pa.large_string())
    w = common.Words(arr)
    at, _ = substring_dedup.anchors(w, 20, w.sums())
    doc = w.doc[at]
    docs = next(substring_dedup._pack([pa.record_batch([pa.array(range(50)), pa.array(texts)], ["id", "text"])]))
    lists = [pa.array([x[doc == i].tolist() for i in range(50)], kind) for x, kind in (((at - w.first[doc]).astype(np.int32), pa.list_(pa.int32())), (np.ones(len(at), bool), pa.list_(pa.bool_())))]
    rows = pa.record_batch([docs.column(0), docs.column(1), *lists], ["id", "packed", "at", "many"])
    sent = [r for b in substring_dedup._cut(20)([rows]) for r in b.to_pylist()]
    assert set(Counter(r["prefix"] for r in sent).values()) == {1}
    assert Counter(r["sure"] for r in sent) == {True: 81, False: 100}  # each text has a path of its own on either side
    found = np.concatenate([np.frombuffer(r["runs"], substring_dedup._RUN) for r in sent if r["runs"]])
    assert len(found) == 1 + 49 * 3  # the first text's are one run
    assert sum(found["n"].tolist()) == 50 * 83


def test_repeats_over_chunks_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "_cut", functools.partial(substring_dedup._cut, most=1))
    rows_ = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        rng = random.Random(9)
        pool = [f"s{j}" for j in range(60)]
        texts = {}
        for i in range(50):
            w = [rng.choice("ab" if i % 3 else "abcdefgh") for _ in range(rng.randrange(50))]
            for _ in range(rng.randrange(4)):
                a = rng.randrange(50)
                w += pool[a : a + rng.randrange(40)]
            texts[i] = " ".join(w)
        df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
        got = {(r.doc_id, r.from_word, r.to_word) for r in substring_dedup.maximal_repeats(df, 9, 2).collect()}
        assert got == brute_maximal(texts, 9)
        got = {(r.doc_id, r.from_word, r.to_word) for r in substring_dedup.repeated_spans(df, 9, 2, within=True).collect()}
        assert got == brute_repeats(texts, 9)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_)
