import json

import pytest
from pyspark.sql import functions as F

from loomgraph.operators.registry import Activity, Registry, builtin, mock
from loomgraph.plans import runner as RN
from loomgraph.plans.compile import Compiler
from loomgraph.plans.spec import Catch, Definitions, InvalidDefinition, Retry, from_dict, load


@pytest.fixture(scope="module")
def reg():
    r = Registry()
    r.function("same")(lambda v: v)
    r.function("times")(lambda v, by: (v * by).cast("bigint"))
    return r


def steps(*s):
    return {"name": "g", "steps": list(s)}


def step(name, value, store="r", **more):
    return {"name": name, "activity": "same", "parameters": {"v": value}, "store": store, **more}


def ids(spark, n=1):
    return spark.range(n).selectExpr("id AS exec_id")


def run(spark, reg, d, inputs=None, df=None, **how):
    return Compiler(from_dict(d), reg, **how).compile(ids(spark) if df is None else df, inputs)


def test_join_takes_values(spark, reg):
    d = {
        "name": "j", "state": {"start": 10}, "outputs": [{"name": n, "branch": "final"} for n in ("total", "doubled", "tripled")],
        "steps": [
            {"name": "s", "next": [{"step": "a", "branch": "a"}, {"step": "b", "branch": "b"}, {"step": "m", "branch": "final"}]},
            {"name": "a", "activity": "times", "parameters": {"v": "${state.start}", "by": 2}, "store": "result"},
            {"name": "b", "activity": "times", "parameters": {"v": "${state.start}", "by": 3}, "store": "result"},
            {"name": "m", "join": {"branches": ["a", "b"], "mappings": {"a.result": "doubled", "b.result": "tripled"}}, "next": [{"step": "sum"}]},
            step("sum", "${state.doubled + state.tripled}", "total"),
        ],
    }
    assert run(spark, reg, d).outputs.first().asDict() == {"exec_id": 0, "total": 50, "doubled": 20, "tripled": 30}
    d["steps"][3]["join"]["mappings"] = {"a": "path_a", "b": "path_b"}
    d["steps"][4]["parameters"] = {"v": "${state.path_a.result + state.path_b.result}"}
    d["outputs"] = [{"name": "total", "branch": "final"}]
    assert run(spark, reg, d).outputs.first().total == 50
    d["steps"][3]["join"] = {"count": 2}
    d["steps"][4]["parameters"] = {"v": "${state.result}"}
    assert run(spark, reg, d).outputs.count() == 1
    d["steps"][3]["join"] = {"count": 4}
    assert run(spark, reg, d).outputs.count() == 0


@pytest.mark.parametrize("matching, want", [("all", ["a", "b"]), ("first", ["a"])])
def test_routes(spark, reg, matching, want):
    edges = [{"step": "a", "condition": "state.value > 10"}, {"step": "b", "condition": "state.value < 20"}, {"step": "c", "condition": "state.value > 20"}]
    d = steps({"name": "s", "edge_matching": matching, "next": edges}, *(step(n, n) for n in "abc")) | {"state": {"value": 15}}
    got = run(spark, reg, d).branches.where("at_step <> 's'").collect()
    assert sorted(r.at_step for r in got) == want
    assert {r.branch_id for r in got} == ({"main"} if matching == "first" else {"main-s-1", "main-s-2"})


def test_no_edge_ends_the_branch(spark, reg):
    d = steps(step("s", 1, next=[{"step": "t", "condition": "state.r > 5"}]), step("t", 2))
    assert [r.at_step for r in run(spark, reg, d).branches.collect()] == ["s"]


def test_each(spark, reg):
    d = {"name": "e", "inputs": [{"name": "xs"}], "outputs": [{"name": "r"}], "steps": [step("s", "${state.x * 2}", each={"items": "${inputs.xs}", "as": "x"})]}
    rows = spark.sql("SELECT 1L AS exec_id, array(1L, 2L, 3L) AS xs UNION ALL SELECT 2L, array()")
    got = Compiler(from_dict(d), reg).compile(rows, columns={"xs": "xs"}).outputs.collect()
    assert {r.exec_id: r.r for r in got} == {1: [2, 4, 6], 2: []}
    d["steps"][0]["each"]["items"] = [4, 5]
    assert {tuple(r.r) for r in Compiler(from_dict(d), reg).compile(rows, columns={"xs": "xs"}).outputs.collect()} == {(8, 10)}
    assert "s__x" not in Compiler(from_dict(d), reg).compile(rows, columns={"xs": "xs"}).branches.columns


def test_loop(spark, reg):
    d = {"name": "l", "inputs": [{"name": "max"}], "state": {"n": 1}, "outputs": [{"name": "n"}], "steps": [
        step("s", "${state.n + 1}", "n", edge_matching="first", next=[{"step": "s", "condition": "state.n <= inputs.max"}, {"step": "e"}]), step("e", "${state.n}", "n")]}
    assert run(spark, reg, d, {"max": 3}).outputs.first().n == 4
    d["steps"][0]["next"] = [{"step": "s"}]
    with pytest.raises(RuntimeError):
        run(spark, reg, d, {"max": 3}, max_rounds=3)


def test_waits(spark, reg):
    rows = spark.sql("SELECT id AS exec_id, TIMESTAMP '2020-01-01 00:00:00' AS entered_at FROM range(3)")
    signals = spark.sql("SELECT 0L AS exec_id, 'go-0' AS topic, 'hi' AS payload, TIMESTAMP '2020-01-01 00:00:05' AS ts UNION ALL SELECT 1L, 'go-1', 'late', TIMESTAMP '2020-01-01 00:00:50'")
    d = {"name": "w", "inputs": [{"name": "id"}], "steps": [{"name": "w", "wait_signal": {"topic": "go-${inputs.id}", "timeout": 10, "store": "got", "on_timeout": "late"}, "next": [{"step": "on"}]}, step("on", "${state.got}"), step("late", "timed out")]}
    import datetime as dt

    c = Compiler(from_dict(d), reg, signals=signals, now=dt.datetime(2020, 1, 1, 0, 0, 20)).compile(rows.withColumn("id", F.col("exec_id")), columns={"id": "id"})
    assert {r.exec_id: r.s__r for r in c.branches.collect()} == {0: "hi", 1: "timed out", 2: "timed out"}
    c = Compiler(from_dict(d), reg, signals=signals, now=dt.datetime(2020, 1, 1, 0, 0, 6)).compile(rows.withColumn("id", F.col("exec_id")), columns={"id": "id"})
    assert {r.exec_id: r.reason for r in c.suspended.collect()} == {1: "waiting_signal", 2: "waiting_signal"}
    nap = {"name": "n", "steps": [{"name": "z", "sleep": 10, "next": [{"step": "on"}]}, step("on", "up")]}
    early, over = (Compiler(from_dict(nap), reg, now=dt.datetime(2020, 1, 1, 0, 0, s)).compile(rows) for s in (9, 10))
    assert early.suspended.count() == 3 and early.branches.count() == 0 and over.branches.count() == 3
    parked = {"name": "p", "steps": [{"name": "z", "pause": True, "next": [{"step": "on"}]}, step("on", "up")]}
    assert [r.reason for r in Compiler(from_dict(parked), reg).compile(rows).suspended.collect()] == ["paused"] * 3


def test_validation_collects_all():
    with pytest.raises(InvalidDefinition) as e:
        from_dict({"name": "", "start": "nope", "outputs": [{"name": "o", "branch": "gone"}], "steps": [
            {"name": "a", "activity": "x", "sleep": 0, "store": "a.b", "next": [{"step": "b"}, {"step": "a", "branch": "main"}]}, {"name": "a", "pause": True, "retry": [{"max_retries": -1}]}, {"name": "j", "join": {"branches": ["q"], "mappings": {"q.a": "z", "q.b": "z"}}}]})
    assert len(e.value.problems) >= 11
    assert from_dict(steps({"name": "j", "join": {"count": 2, "branches": ["main"]}})).warnings()
    with pytest.raises(InvalidDefinition, match="unknown key"):
        from_dict({"name": "a", "steps": [{"name": "s", "typo": 1}]})


def test_inputs():
    d = from_dict({"name": "i", "inputs": [{"name": "a"}, {"name": "b", "default": 2}], "steps": [{"name": "s"}]})
    assert d.bind({"a": 1}) == {"a": 1, "b": 2}
    for bad in ({}, {"a": 1, "z": 2}):
        with pytest.raises(InvalidDefinition):
            d.bind(bad)


def test_definitions_and_registry(tmp_path):
    (tmp_path / "d.json").write_text(json.dumps(steps({"name": "s"})))
    all_ = Definitions()
    all_.register(load(str(tmp_path / "d.json")))
    assert all_.list() == ["g"] and all_.get("g").names() == ["s"]
    r = Registry(mock("m", 1))
    with pytest.raises(ValueError):
        r.register(Activity("m"))
    with pytest.raises(KeyError):
        r.get("x")
    assert "json" in builtin().names()


def test_builtin_activities(spark):
    d = {"name": "b", "outputs": [{"name": "a"}, {"name": "b"}, {"name": "c"}], "steps": [
        {"name": "p", "activity": "print", "parameters": {"message": "hi ${1 + 1}"}, "store": "a", "next": [{"step": "q"}]},
        {"name": "q", "activity": "json", "parameters": {"operation": "query", "data": '{"x": [1, 2]}', "query": "x.1"}, "store": "b", "next": [{"step": "r"}]},
        {"name": "r", "activity": "random.number", "parameters": {"min": 3, "max": 4}, "store": "c"}]}
    got = Compiler(from_dict(d)).compile(ids(spark, 20)).outputs.collect()
    assert {(r.a, r.b) for r in got} == {("hi 2", "2")} and {r.c for r in got} <= {3, 4}


def test_row_functions(spark):
    r = Registry()
    r.rows("join", "string")(lambda a, b: f"{a}/{b}")
    d = {"name": "r", "outputs": [{"name": "x"}], "steps": [{"name": "s", "activity": "join", "parameters": {"a": 1, "b": "z"}, "store": "x"}]}
    assert Compiler(from_dict(d), r).compile(ids(spark)).outputs.first().x == "1/z"


@pytest.mark.parametrize("kind, pattern, want", [("timeout", "all", True), ("fatal_error", "all", False), ("fatal_error", "fatal_error", True), ("timeout", "activity_failed", False), ("own", "activity_failed", True), ("own", "own", True), ("own", "other", False)])
def test_error_patterns(kind, pattern, want):
    assert RN.matches(RN.RunError(kind), pattern) is want
    assert not RN.matches(RN.LeaseLost(), pattern)


def test_retry_and_catch():
    calls, slept = [], []

    def f():
        calls.append(1)
        if len(calls) < 3:
            raise ValueError("no")
        return "ok"

    assert RN.attempt(f, [Retry(["timeout"], 9), Retry([], 2, base_delay=1, backoff_rate=3)], sleep=slept.append)[0] == "ok" and slept == [1, 3]
    calls.clear()
    with pytest.raises(RN.RunError):
        RN.attempt(f, [Retry([], 1)], sleep=slept.append)
    calls.clear()
    _, handler, record = RN.attempt(f, [], [Catch(["timeout"], "x"), Catch(["all"], "y")])
    assert handler.next == "y" and record == {"Error": "activity_failed", "Cause": "no", "Details": None}
    assert RN.delay(1, Retry(base_delay=0)) == 0 and RN.delay(3, Retry(max_delay=3)) == 3


def test_runner_resumes(spark, tmp_path):
    done, fail = [], [True]

    def first(_):
        done.append("a")
        return spark.range(5)

    def second(frames):
        if fail[0]:
            raise TimeoutError("slow")
        return frames["a"].selectExpr("id * 2 AS id")

    r = RN.Runner(spark, str(tmp_path), on_complete=lambda _: ["next"])
    out = r.run("r1", [("a", first), ("b", second)])
    assert out.failed() and out.error.kind == "timeout" and r.follow_ups == []
    fail[0] = False
    out = r.run("r1", [("a", first), ("b", second)])
    assert out.completed() and done == ["a"] and r.follow_ups == ["next"]
    assert sorted(x.id for x in out.outputs["b"].collect()) == [0, 2, 4, 6, 8]


def test_time_limit(spark):
    with pytest.raises(TimeoutError):
        RN.bounded(spark, 1.0, lambda: spark.range(10**13).selectExpr("sum(id % 7)").collect())


def test_checkpoints_and_history(tmp_path):
    c = RN.FileCheckpoints(str(tmp_path))
    with pytest.raises(LookupError):
        c.load("r")
    for i in range(12):
        c.save("r", {"i": i})
    assert c.load("r") == {"i": 11} and c.list() == ["r"]
    (tmp_path / "r" / "checkpoint-99.json").write_text('{"schema_version": 7, "state": {}}')
    with pytest.raises(ValueError):
        c.load("r")
    c.delete("r")
    h = RN.History()
    assert [h.record_or_replay("k", lambda x=x: x) for x in (1, 2)] == [1, 1]
    res = RN.Result("completed", {"s": "x", "i": 2.9, "b": True})
    assert res.string("s") == ("x", True) and res.integer("i") == (2, True) and res.boolean("b") == (True, True) and res.integer("b") == (0, False)
