from loomgraph.llm import mixing


def test_a_missing_count_is_that_of_the_text(spark):
    rows = [(i, "x" * 50, "ab"[i % 2], 50) for i in range(400)]
    known = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    some = spark.createDataFrame([(i, t, s, None if s == "b" or i % 4 == 0 else n) for i, t, s, n in rows], known.schema)
    got, want = ([r.doc_id for r in mixing.mix_sources(d).collect()] for d in (some, known))
    assert sorted(got) == sorted(want) and any(i % 2 for i in got)
