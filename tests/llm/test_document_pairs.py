from loomgraph.llm import ngram_join


def test_pairs_of_all_documents(spark):
    words = [f"w{j}" for j in range(40)]
    texts = {1: words, 2: words, 3: words, 4: words[:36], 5: words[:36], 6: ["other", "words", "here", "only"]}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    grams = {i: {tuple(w[a : a + 3]) for a in range(len(w) - 2)} for i, w in texts.items()}
    want = {(a, b): len(grams[a] & grams[b]) / len(grams[a] | grams[b]) for a in texts for b in texts if a < b}
    want = {k: v for k, v in want.items() if v >= 0.5}
    got = {(r.id_a, r.id_b): r.jaccard for r in ngram_join.document_pairs(ngram_join.jaccard_join(df)).collect()}
    assert got.keys() == want.keys() and len(got) == 10 and all(abs(got[k] - want[k]) < 1e-9 for k in want)
