import json

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import expressions as X
from loomgraph.functions import scalars as S
from loomgraph.functions.truth import text, truthy
from loomgraph.plans.compile import scope_of


@pytest.fixture(scope="module")
def df(spark):
    return spark.sql("SELECT 5L AS s__count, true AS s__enabled, 'Ann' AS s__user_name, named_struct('b', 7L) AS s__a, array('x', 'y') AS s__items, 3L AS i__threshold, 'http://h' AS i__base_url, CAST(NULL AS STRING) AS s__none, 8.0D AS s__d")


def value(df, code):
    return df.select(X.evaluate(code, scope_of(df)).column.alias("x")).first().x


@pytest.mark.parametrize(
    "code, want",
    [("state.count > 3", True), ("state.count > inputs.threshold && state.enabled", True), ("state.count < 3 || !state.enabled", False), ("state.a.b == 7", True), ('state.user_name == "Ann"', True), ("state.none == nil", True), ("state.none > 3", False),
     ("state.count * 2 + 1", 11), ("-(state.count - 7) % 2", 0), ("7 / 2", 3), ("7 / 2.0", 3.5), ('"a" + "b"', "ab"), ("[1, 2, 3]", [1, 2, 3]), ("true", True), ("state.count != 5", False)],
)
def test_expressions(df, code, want):
    assert value(df, code) == want


@pytest.mark.parametrize("code", ["state.missing > 1", "unknown", "len(state.items)", "1 +", "", "state.count +* 2", "(1", '"a" + 1', "a b", "state", "1 @ 2", '[1, "a"]', "state.count.x"])
def test_errors(df, code):
    with pytest.raises(X.CompileError):
        X.evaluate(code, scope_of(df))


@pytest.mark.parametrize(
    "raw, want",
    [("plain", "plain"), ("${state.count * 2}", 10), ("${inputs.base_url}/users/${state.user_name}", "http://h/users/Ann"), ("n=${state.none}.", "n=."), ("${state.d}!", "8!"), (" ${state.count} ", 5), ("${state.enabled}?", "true?")],
)
def test_templates(df, raw, want):
    assert df.select(X.template(raw, scope_of(df)).column.alias("x")).first().x == want


@pytest.mark.parametrize("raw", ["${1 + }", "${state.count", "${}", "${state.gone} x"])
def test_malformed_templates(df, raw):
    with pytest.raises(X.CompileError):
        X.template(raw, scope_of(df))


def test_conditions(df):
    got = df.select(*(X.predicate(c, scope_of(df)).alias(str(i)) for i, c in enumerate([" True ", "FALSE", "", None, "state.user_name", "state.none", "state.items"]))).first()
    assert list(got) == [True, False, True, True, True, False, True]


@pytest.mark.parametrize(
    "sql, want",
    [("CAST(NULL AS INT)", False), ("0", False), ("-1", True), ("CAST('NaN' AS DOUBLE)", True), ("0.0D", False), ("''", False), ("'FALSE'", False), ("'0'", True), ("array()", False), ("array(0)", True), ("map()", False), ("map('a', 1)", True), ("true", True), ("false", False), ("date'2020-01-01'", True), ("NULL", False)],
)
def test_truth(spark, sql, want):
    d = spark.sql(f"SELECT {sql} AS x")
    assert d.select(truthy(F.col("x"), d.schema["x"].dataType)).first()[0] is want


def test_text(spark):
    d = spark.sql("SELECT 8.0D AS a, 8.5D AS b, CAST(NULL AS INT) AS c, true AS d, array(1, 2) AS e")
    assert list(d.select(*(text(F.col(f.name), f.dataType) for f in d.schema)).first()) == ["8", "8.5", "", "true", "[1,2]"]


def test_json(spark):
    d = spark.createDataFrame([('{"b": [1, {"c": "x"}], "a": null}', '{"a": 1, "b": 2}'), ('{"a": {"x": 1, "y": 2}}', '{"a": {"y": null, "z": 3}}')], "l string, r string")
    got = d.select(S.json_merge("l", "r").alias("m"), S.json_stringify("l").alias("s"), S.json_query(F.col("l"), "b.1.c").alias("q")).collect()
    assert json.loads(got[0].m) == {"a": 1, "b": 2} and json.loads(got[1].m) == {"a": {"x": 1, "y": None, "z": 3}}
    assert got[0].q == "x" and got[1].q is None
    assert got[1].s == '{\n  "a": {\n    "x": 1,\n    "y": 2\n  }\n}'
    docs = spark.createDataFrame([("{}",), ("",), ('{"a":1} x',), ("NaN",), ("[1, 2]",), (None,), ('{"a":1,"a":2}',)], "j string")
    assert [r[0] for r in docs.select(S.json_validate("j")).collect()] == [True, False, False, False, True, None, True]
    with pytest.raises(Exception, match="no value"):
        d.select(S.json_query(F.col("l"), "zzz", strict=True)).collect()


def test_each_value(spark):
    d = spark.sql("SELECT array(1, 2) AS a, map('b', 2, 'a', 1) AS m, 5 AS s, CAST(NULL AS INT) AS n")
    got = d.select(*(S.each_value(F.col(f.name), f.dataType) for f in d.schema)).first()
    assert got[0] == [1, 2] and [(x.key, x.value) for x in got[1]] == [("a", 1), ("b", 2)] and got[2] == [5] and got[3] == []


def test_scalars(spark):
    d = spark.sql("SELECT 'a_1' AS ok, '1a' AS bad, '0755' AS o, '420' AS p, 'x' AS q, '' AS e, map('k', 'v') AS m")
    got = d.select(S.is_identifier(F.col("ok")), S.is_identifier(F.col("bad")), S.permissions(F.col("o")), S.permissions(F.col("p")), S.permissions(F.col("q")), S.null_if_empty(F.col("e")), S.contains(F.col("m"), {"k": "v"}), S.contains(F.col("m"), {"x": "v"}), S.metadata_json(F.col("m")), S.minted("exec_", F.col("ok"))).first()
    assert list(got)[:9] == [True, False, 0o755, 420, 0o644, None, True, False, '{"k":"v"}'] and got[9].startswith("exec_") and len(got[9]) == 31
    t = spark.sql("SELECT TIMESTAMP '2020-01-01 00:00:10' AS wake, TIMESTAMP '2020-01-01 00:00:04' AS now, 'wait_timeout' AS c, 'cancelled' AS x, 'fatal_error' AS f")
    got = t.select(S.remaining(F.col("wake"), F.col("now")), S.remaining(F.col("now"), F.col("wake")), S.classify(F.col("c")), S.classify(F.col("x")), S.classify(F.col("f")), S.to_utc_text(F.col("now")), S.backoff(F.lit(4), 1, 2, 5), S.backoff(F.lit(1), 0)).first()
    assert list(got) == [6_000_000, 0, "timeout", "activity_failed", "fatal_error", "2020-01-01T00:00:04.000000Z", 5.0, 0.0]
