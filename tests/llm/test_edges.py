"""Each operator and stage on NULLs, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomgraph.llm import exact_dedup, html_extraction, language_id, mixing, ngram_join, packing, pii, quality_rules, sharding, substring_dedup

LONG = " ".join(f"w{i * 7919 % 10007}" for i in range(60_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, size string, bucket int, `TEXT_` string, `a.b` string, `rule_` int"
ROWS = [
    (1, "one two three four five", "en", "s0", 23, 9, "x", 1, "t", "d", 1),
    (1, "one two three four five", "en", "s0", 23, 9, "x", 1, "t", "d", 1),
    (2, "one two three four five", "en", "s1", 23, None, None, None, None, None, None),
    (3, None, None, None, None, 1, "", 0, "", "", 0),
    (4, "", "fr", "s1", 0, 1, "", 0, "", "", 0),
    (5, "   \n\t ", "fr", None, 7, 1, "", 0, "", "", 0),
    (None, "nameless words that nobody else has", "en", "s0", 30, 1, "", 0, "", "", 0),
    (6, LONG, "de", "s2", len(LONG), 1, "", 0, "", "", 0),
    (7, LONG, "de", "s2", len(LONG), 1, "", 0, "", "", 0),
    (8, LONG + " and more", "de", "s2", len(LONG) + 9, 1, "", 0, "", "", 0),
    (9, "ONE two  THREE four five", "en", "s1", -5, 1, "", 0, "", "", 0),
    (10, "日本語 の 文 です。 été ﬀ İ ß", "xx", "s1", 20, 1, "", 0, "", "", 0),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing(docs, none):
    rows = packing.pack(docs, 64).collect()
    assert packing.pack(none, 64).collect() == []
    assert sorted({r.doc_id for r in rows if r.window_id is None}, key=str) == [3, 4, 5]
    assert sum(r.n_tokens for r in rows if r.doc_id == 1) == 2 * sum(r.n_tokens for r in rows if r.doc_id == 2)
    assert sum(r.doc_id is None for r in rows) == 1
    fill = {}
    for r in rows:
        if r.window_id is not None:
            fill.setdefault(r.window_id, []).append((r.window_offset, r.n_tokens))
    for parts in fill.values():
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n
        assert at <= 64


def test_pieces_are_the_documents(spark, docs):
    odd = [(1, "  a b\n\nc-d  \t"), (2, "日本語" * 50 + "  \n"), (3, None), (4, "  "), (5, "x" * 301), (6, "e\u0301 \u00a0 \U0001f600" * 40)]
    more = spark.createDataFrame(odd, "doc_id long, text string")
    for df in (more, docs.where("doc_id > 1").select("doc_id", "text")):
        rows = packing.pack(df, 64).collect()
        got = {}
        for r in sorted(rows, key=lambda r: r.piece):
            got[r.doc_id] = r.text if r.text is None else got.get(r.doc_id, "") + r.text
        assert got == {r.doc_id: r.text for r in df.collect()}
    again = packing.windows(packing.pack(more, 64)).collect()
    assert all(sum(p.n_tokens for p in w.pieces) == w.n_tokens <= 64 for w in again) and len({w.window_id for w in again}) == len(again)
    numbers = spark.createDataFrame([(1, list(range(150))), (2, None), (3, []), (4, [7])], "doc_id long, ids array<int>")
    rows = packing.pack(numbers, 64, tokens=F.col("ids")).collect()
    assert sorted(x for r in rows if r.doc_id == 1 for x in r.tokens) == list(range(150))
    assert {r.doc_id: r.window_id for r in rows if r.doc_id in (2, 3)} == {2: None, 3: None}


def test_encoding_by_a_public_tokenizer(spark):
    path = "/opt/tokenizers/byte_bpe_50k.json"
    df = spark.createDataFrame([(1, "Hello world <|endoftext|>"), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r.t for r in df.select("doc_id", packing.encoded(path)(F.col("text")).alias("t")).collect()}
    from tokenizers import Tokenizer

    assert Tokenizer.from_file(path).decode(got[1], skip_special_tokens=False) == "Hello world <|endoftext|>" and 50256 not in got[1]
    assert got[2] is None and got[3] == []


def test_substrings(docs, none):
    assert substring_dedup.repeated_spans(none, 5).collect() == []
    got = {(r.doc_id, r.from_word, r.to_word) for r in substring_dedup.repeated_spans(docs, 5).collect()}
    assert got == {(1, 0, 5), (2, 0, 5), (6, 0, 60_000), (7, 0, 60_000), (8, 0, 60_000)}


def test_jaccard(docs, none):
    assert ngram_join.jaccard_join(none).collect() == []
    got = {(r.id_a, r.id_b): r.jaccard for r in ngram_join.jaccard_join(docs).collect()}
    assert set(got) == {(1, 2), (1, 9), (6, 7), (6, 8)}
    assert got[1, 9] == 1.0 and 0.99 < got[6, 8] < 1
    kept = ngram_join.near_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.select("doc_id").collect()), key=str) == [1, 1, 10, 3, 4, 5, 6, None]
    assert ngram_join.near_dedup(none).collect() == []


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, 0), (1, 1), (None, 0), (5, None)], "doc_id long, quality int")
    assert quality_rules.learn_rules(docs, labels) == []
    assert quality_rules.learn_rules(none, labels.limit(0)) == []
    assert [r.keep for r in quality_rules.classify(docs, []).collect()] == [True] * len(ROWS)
    rule = quality_rules.Rule((("n_words", False, 0.0),), 1.0)
    kept = quality_rules.quality_filter(docs, [rule])
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 3
    assert quality_rules.classify(none, [rule]).collect() == []


def test_sharding(docs, none):
    rows = sharding.shard_documents(docs, 3).collect()
    assert len(rows) == len(ROWS) and sharding.shard_documents(none, 3).collect() == []
    shard = {r.doc_id: r.shard for r in rows}
    assert shard[1] == shard[2] and shard[6] == shard[7] != shard[8]
    by_source = sharding.shard_documents(docs, 3, group_cols=["source", "a.b"]).collect()
    assert len(by_source) == len(ROWS)


def test_mixing(docs, none):
    out = mixing.mix_sources(docs, power=1.0, copy_col="doc_id_copy")
    assert out.columns == [*docs.columns, "doc_id_copy"]
    assert mixing.mix_sources(none).collect() == []
    counts = {}
    for r in out.select("doc_id").collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert counts.get(1, 0) % 2 == 0
    # the shuffle join for very many sources gives the same
    few, many = (sorted(map(str, mixing.mix_sources(docs, power=1.0, most_broadcast=n).select("doc_id", "source").collect())) for n in (1000, 0))
    assert few == many
    assert mixing.mix_sources(docs, weights={"s9": 1.0}).collect() == []
    with pytest.raises(ValueError):
        mixing.mix_sources(docs, copy_col="TEXT")
    salted = docs.select("doc_id", "text", "source", "n_chars", F.lit(777).alias("salt_"), F.lit(778).alias("salt_l"), F.lit(779).alias("salt_of_"))
    for n in (1 << 20, 0):
        rows = mixing.mix_sources(salted, power=1.0, most_broadcast=n).select("salt_", "salt_l", "salt_of_").distinct().collect()
        assert [tuple(r) for r in rows] == [(777, 778, 779)]


def test_mixing_large_rates(spark):
    rows = [(i, "t", "big" if i else "small", 10**6 if i else 1) for i in range(200)] + [(1000 + i, "t", "small", 1) for i in range(60)]
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long"), weights={"small": 1.0, "big": 199 * 10**6 / (61 * 300)})
    counts = [r["count"] for r in out.where("source = 'small'").groupBy("doc_id").count().collect()]
    mean = sum(counts) / 61
    assert len(counts) == 61 and 285 < mean < 315 and 10 < (sum((c - mean) ** 2 for c in counts) / 60) ** 0.5 < 25


def test_exact(docs, none):
    assert exact_dedup.owners(none).collect() == [] and exact_dedup.exact_dedup(none).collect() == []
    got = sorted(((r.doc_id, r.owner_id) for r in exact_dedup.owners(docs).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (None, None), (6, 6), (7, 6), (8, 8), (9, 9), (10, 10)], key=str)
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 10, 3, 4, 5, 6, 8, 9, None]


def test_html(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "plain"), (3, "plain"), (4, "<p>un<b>closed <p>twice</html>" + "<div>" * 3000), (None, "<a href='x\">")], "page_id long, html string")
    model = html_extraction.train_pages(pages)
    got = [(r.page_id, r.text) for r in html_extraction.extract_pages(pages, model).collect()]
    assert (1, None) in got and (2, "") in got and got.count((3, "plain")) == 2 and len(got) == 6
    assert html_extraction.extract_pages(pages.limit(0), model).collect() == []


def test_html_signs_and_long_pages(spark):
    model = html_extraction.train(["<nav><a>l</a></nav><article><p>Text, and. More</p></article><footer>f</footer>"] * 3)
    model.root[:], model.edges[:] = 0, 0
    for table in model.seen:
        table[0], table[1] = -1, 0  # all is content
    got = html_extraction.extract(["<p>zero\u200b</p>", "a\u200b<b>b</b>", "<p>x <b>y</b>z <i> u</i></p><p>v", "1 < 2 <a href='x>y\">s", None, ""], model)
    assert got == ["zero\u200b", "a\u200bb", "x yz u\nv", '1 < 2 y">s', None, ""]
    for page in ("<a " * 300_000, "<b>" * 100_000 + "</i>" * 100_000, "<div>" * 200_000, "<p><div>" + "<b>" * 50_000 + "<hr>" * 50_000, "<! " * 300_000, "<a \"' " * 100_000):
        began = time.perf_counter()
        assert html_extraction.extract([page + "<p>end"], model) == ["end"] or page.startswith("<!")
        assert time.perf_counter() - began < 20
    pages = spark.createDataFrame([("x", "<main>one two</main>", "t")] * 3, "page_id string, html string, `TEXT` string")
    rows = html_extraction.extract_pages(pages, html_extraction.train_pages(pages, most=2)).collect()
    assert [r.page_id for r in rows] == ["x"] * 3 and len({r.text for r in rows}) == 1


def test_language(docs, none):
    model = language_id.fit_documents(docs)
    got = {r.doc_id: r.language for r in language_id.identify(docs, model).collect()}
    assert got[3] is None and got[4] is None and got[5] is None and got[1] == "en"
    assert got[6] == "de"
    assert language_id.identify(none, model).collect() == []
    assert {r.language for r in language_id.identify(docs, language_id.fit_documents(none)).collect()} == {None}


def test_pii(docs, none):
    got = {r.doc_id: (r.text, r.n_entities) for r in pii.pseudonymise(docs, "k").collect()}
    assert got[3] == (None, 0) and got[4] == ("", 0) and got[6] == (LONG, 0)
    assert pii.pseudonymise(none, "k").collect() == []


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, docs, none, sf, stage):
    f = corpus_pipeline.STAGES[stage][1]
    out = f(spark, docs, sf)
    if stage < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == docs.columns
    assert out.count() > 0
    assert f(spark, none, sf).count() == 0


def test_null_text_alone(spark):
    only = spark.createDataFrame([(1, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert ngram_join.jaccard_join(only).collect() == []
    assert ngram_join.near_dedup(only).count() == 1
    assert substring_dedup.repeated_spans(only).collect() == []
    assert mixing.mix_sources(only).collect() == []
    assert packing.pack(only).select(F.count("window_id")).first()[0] == 0
