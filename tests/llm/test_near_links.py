import random

import duckdb
import numpy as np
import pyarrow as pa

from loomgraph.llm import common, ngram_join


def _at_threshold(rng, number):
    """Texts of 60 3-grams in pairs that share 40 of them: an index of exactly 0.5."""
    texts = {}
    for k in range(number):
        common, x, y = ([f"{c}{k}x{rng.random()}" for _ in range(m)] for c, m in (("c", 42), ("a", 20), ("b", 20)))
        texts[2 * k], texts[2 * k + 1] = " ".join(common + x), " ".join(common + y)
    return texts


def test_no_pair_at_the_threshold_is_missed(spark):
    texts = _at_threshold(random.Random(5), 600)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r.id_a, r.id_b): r.jaccard for r in ngram_join.jaccard_join(df).collect()}
    assert got == {(2 * k, 2 * k + 1): 0.5 for k in range(600)}


def test_links_equal_the_sql(spark):
    rng = random.Random(6)
    texts = _at_threshold(rng, 5)
    words = [f"w{i}" for i in range(60)]
    for i in range(100, 160):  # a large group of near copies, some of them copies
        w = list(words)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(60)] = f"o{rng.randrange(30)}"
        texts[i] = " ".join(w)
    texts |= {200: texts[100], 201: texts[101], 202: "", 203: None, 204: "One two", 205: "one  two"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [list(x) for x in texts.items()])
    want = sorted(con.execute(ngram_join.OP3_SQL).fetchall())
    assert sorted(map(tuple, ngram_join.near_links(df).collect())) == want and max(x[2] for x in want) > 20
    near = {r.doc_id for r in ngram_join.near_dedup(df).collect()}
    assert near == {d for d, c, _ in want if d == c}


def test_pieces_meet_each_pair_once(monkeypatch):
    rng = np.random.default_rng(7)
    for name, value in (("BLOCK", 7), ("SMALL", 5), ("CELLS", 500)):
        monkeypatch.setattr(ngram_join, name, value)
    sets = [np.unique(rng.choice(40, int(rng.integers(10, 30)), replace=False)).astype(np.uint64) for _ in range(64)]
    row, h = np.repeat(np.arange(64), [len(x) for x in sets]), np.concatenate(sets)
    size, s1, _, _, maps = ngram_join._signatures(row, h, 64, 0, 0)
    root = np.repeat([1, 2, 3], [4, 10, 50])
    light = pa.record_batch([pa.array(root), pa.array(np.arange(64)), pa.array(s1), pa.array(size), common.fixed_binary(maps)], ["root", "id", "s1", "size", "map"])
    pieces = pa.Table.from_batches(ngram_join._blocks(0.5)([light])).sort_by("piece")
    of = pieces.column("id").to_numpy()
    rows = pa.record_batch([common.column(pieces, 3), pieces.column("side").combine_chunks(), root[of], of, np.ones(len(of), np.int64), pa.array([sets[i].tobytes() for i in of], pa.binary())], ["piece", "side", "root", "id", "n", "grams"])
    got = [(r["id_a"], r["id_b"]) for b in ngram_join._found(0.5, True)([rows]) for r in b.to_pylist()]
    both = [[len(np.intersect1d(x, y)) for y in sets] for x in sets]
    want = {(i, j) for i in range(64) for j in range(i) if root[i] == root[j] and both[i][j] * 3 >= len(sets[i]) + len(sets[j])}
    assert len(got) == len(set(got)) > 50 and set(got) == {(j, i) for i, j in want}
    found = pa.Table.from_batches(ngram_join._found(0.5, False)([rows])).sort_by("root").combine_chunks()
    links = {r["id"]: r["links"] for b in ngram_join._united(found.to_batches()) for r in b.to_pylist()}
    assert links == {i: n for i in range(64) if (n := sum(i in x for x in want))}


def test_near_dedup_makes_no_pairs(spark, monkeypatch):
    monkeypatch.delattr(ngram_join, "jaccard_join")
    df = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e f"), (3, "other words than these here")], "doc_id long, text string")
    assert sorted(r.doc_id for r in ngram_join.near_dedup(df).collect()) == [1, 3]
