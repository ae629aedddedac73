"""Plans of compiled definitions, and what runs on the driver: checkpoints, progress, children, loops, the command line."""

import datetime as dt
import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from loomgraph import __main__ as cli
from loomgraph import queries as Q
from loomgraph.operators import runs as R
from loomgraph.operators.registry import Registry, builtin, mock_error
from loomgraph.plans import runner as RN
from loomgraph.plans import state, worker
from loomgraph.plans.compile import Compiler
from loomgraph.plans.spec import Definitions, InvalidDefinition, from_dict
from loomgraph.sources import tables
from loomgraph.sources.files import Files
from loomgraph.streaming import durable


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, exchanges", [("route_first", 0), ("route_all", 0), ("output_projection", 0), ("retry_rows", 0), ("sub_pipeline", 0), ("branch_join_named", 1), ("branch_join_count", 1)])
def test_definitions_scan_once(spark, sf, name, exchanges):
    text = plan(Q.QUERIES[name](spark, sf))
    assert text.count("FileScan") == 1 and text.count("Exchange") == exchanges and "Join" not in text


def diamonds(n):
    steps = []
    for i in range(n):
        after = [{"step": f"s{i + 1}" if i < n - 1 else "end"}]
        steps += [
            {"name": f"s{i}", "edge_matching": "first", "next": [{"step": f"a{i}", "condition": f"inputs.p > {i}"}, {"step": f"b{i}"}]},
            {"name": f"a{i}", "activity": "noop", "parameters": {"v": i}, "store": "y", "next": after}, {"name": f"b{i}", "activity": "noop", "parameters": {"v": -i}, "store": "y", "next": after},
        ]
    return from_dict({"name": "d", "inputs": [{"name": "p"}], "outputs": [{"name": "y"}], "steps": [*steps, {"name": "end"}]})


def test_ten_diamonds_are_one_scan(spark, tmp_path):
    spark.range(20).selectExpr("id AS exec_id").write.parquet(str(tmp_path / "t"))
    c = Compiler(diamonds(10)).compile(spark.read.parquet(str(tmp_path / "t")), columns={"p": "exec_id"})
    assert plan(c.outputs).count("FileScan") == 1 and len(plan(c.outputs)) < 60_000
    assert {r.exec_id: r.y for r in c.outputs.collect()} == {i: 9 if i > 9 else -9 for i in range(20)}
    assert c.executions.where("status = 'completed'").count() == 20


def test_rows_that_python_fails_for(spark):
    r, calls = Registry(), []

    @r.rows("risky", "long")
    def risky(v):
        if v % 2:
            raise ValueError(f"odd {v}")
        return v * 10

    d = {"name": "r", "inputs": [{"name": "v"}], "outputs": [{"name": "x"}], "steps": [
        {"name": "s", "activity": "risky", "parameters": {"v": "${inputs.v}"}, "store": "x", "retry": [{"max_retries": 1, "base_delay": 0.001}], "catch": [{"errors": ["all"], "next": "h", "store": "e"}]}, {"name": "h"}]}
    rows = spark.range(6).selectExpr("id AS exec_id")
    c = Compiler(from_dict(d), r).compile(rows, columns={"v": "exec_id"})
    got = {x.exec_id: (x.status, x.x) for x in c.executions.collect()}
    assert got == {i: ("failed", None) if i % 2 else ("completed", i * 10) for i in range(6)}  # the handler stores no x
    assert {x.s__e.Cause for x in c.branches.where("at_step = 'h'").collect()} == {"odd 1", "odd 3", "odd 5"}
    d["steps"][0].pop("catch")
    failed = Compiler(from_dict(d | {"steps": d["steps"][:1]}), r).compile(rows, columns={"v": "exec_id"}).failed
    assert sorted(x.error.Error for x in failed.collect()) == ["activity_failed"] * 3
    with pytest.raises(Exception, match="is failed"):
        Compiler(from_dict(d | {"steps": d["steps"][:1]}), r).compile(rows, columns={"v": "exec_id"}).strict().collect()


def test_only_rows_at_a_step_run_python(spark):
    r = Registry()
    r.rows("half", "double")(lambda v: 10 / v)
    d = {"name": "h", "inputs": [{"name": "v"}], "steps": [{"name": "s", "edge_matching": "first", "next": [{"step": "go", "condition": "inputs.v > 0"}]}, {"name": "go", "activity": "half", "parameters": {"v": "${inputs.v}"}, "store": "x"}]}
    rows = Compiler(from_dict(d), r).compile(spark.range(3).selectExpr("id AS exec_id"), columns={"v": "exec_id"}).branches.collect()
    assert {x.exec_id: x.s__x for x in rows} == {0: None, 1: 10.0, 2: 5.0}


def test_second_arrival_takes_the_place_of_the_first(spark):
    d = from_dict({"name": "j", "steps": [
        {"name": "s", "next": [{"step": "x", "branch": "a"}, {"step": "x2", "branch": "b"}, {"step": "m", "branch": "w1"}, {"step": "m", "branch": "w2"}]},
        {"name": "x"}, {"name": "x2"}, {"name": "m", "join": {"branches": ["a", "b"]}, "next": [{"step": "end"}]}, {"name": "end"}]})
    c = Compiler(d).compile(spark.range(1).selectExpr("id AS exec_id"))
    assert [r.branch_id for r in c.branches.where("at_step = 'end'").collect()] == ["w2"]
    assert [(r.branch_id, r.reason) for r in c.suspended.collect()] == [("w1", "waiting_join")]


def test_children(spark):
    known = Definitions()
    known.register(from_dict({"name": "a", "steps": [{"name": "s", "activity": "child", "parameters": {"definition": "b"}, "store": "r"}]}))
    known.register(from_dict({"name": "b", "steps": [{"name": "s", "activity": "child", "parameters": {"definition": "a"}, "store": "r"}]}))
    with pytest.raises(InvalidDefinition, match="runs itself"):
        Compiler(known.get("a"), definitions=known).compile(spark.range(1).selectExpr("id AS exec_id"))
    now = [0.0]
    pool = RN.Detached(kept_seconds=10, clock=lambda: now[0])
    h = pool.start(lambda: spark.range(5).count())
    assert pool.result(h, 60) == 5 and pool.done(h)
    bad = pool.start(lambda: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        pool.result(bad, 60)
    now[0] = 11
    with pytest.raises(LookupError):
        pool.result(h)


def test_state(spark):
    d = from_dict({"name": "s", "state": {"a": 1}, "steps": [{"name": "s", "activity": "noop", "parameters": {"v": {"x": 2}}, "store": "b"}]})
    rows = Compiler(d).compile(spark.range(1).selectExpr("id AS exec_id")).branches
    rows = state.put(state.put(rows, "c.d.e", F.lit(3)), "b.y", F.lit(4))
    assert state.keys(rows) == ["a", "b", "c"] and state.keys(state.delete(rows, "a")) == ["b", "c"]
    r = rows.select(state.get(rows, "c.d.e").alias("e"), state.get(rows, "b.x").alias("x"), state.get(rows, "b.y").alias("y"), state.get(rows, "z").alias("z"), state.held(rows).alias("held")).first()
    assert (r.e, r.x, r.y, r.z, r.held) == (3, 2, 4, None, ["a", "b", "c"])


def test_results(spark):
    d = from_dict({"name": "r", "outputs": [{"name": "x"}], "steps": [{"name": "w", "wait_signal": {"topic": "t", "timeout": 60, "store": "x"}}]})
    signals = spark.sql("SELECT 0L AS exec_id, 't' AS topic, 'hi' AS payload, TIMESTAMP '2020-01-01 00:00:05' AS ts")
    rows = spark.sql("SELECT id AS exec_id, TIMESTAMP '2020-01-01 00:00:00' AS entered_at FROM range(2)")
    out = RN.collect(Compiler(d, signals=signals, now=dt.datetime(2020, 1, 1, 0, 0, 30)).compile(rows))
    done, waits = sorted(out, key=lambda r: r.status)
    assert done.completed() and done.string("x") == ("hi", True)
    assert waits.suspended() and waits.needs_resume() and not waits.paused() and waits.suspension() == ("waiting_signal", ["t"], dt.datetime(2020, 1, 1, 0, 1))


def test_activities(spark):
    r = builtin()
    r.register(mock_error("no", "why", "own"))
    r.typed("sum", "a bigint, b bigint")(lambda p: p["a"] + F.coalesce(p["b"], F.lit(0)))
    steps = [("a", "sum", {"a": 2}), ("b", "random.number", {"min": 200}), ("c", "random.hex", {"length": 5, "count": 3}), ("d", "print", {"message": "%v-%d", "args": ["x", 7]})]
    d = from_dict({"name": "s", "outputs": [{"name": n} for n, *_ in steps], "steps": [{"name": n, "activity": a, "parameters": p, "store": n, "next": [{"step": m} for m, *_ in steps[i + 1 : i + 2]]} for i, (n, a, p) in enumerate(steps)]})
    rows = Compiler(d, r).compile(spark.range(50).selectExpr("id AS exec_id")).outputs.collect()
    assert {x.a for x in rows} == {2} and {x.d for x in rows} == {"x-7"}
    assert all(200 <= x.b <= 300 for x in rows) and all(len(x.c) == 3 and all(len(y) == 5 for y in x.c) for x in rows)
    with pytest.raises(ValueError, match="unknown parameters"):
        Compiler(from_dict({"name": "u", "steps": [{"name": "s", "activity": "sum", "parameters": {"z": 1}}]}), r).compile(spark.range(1).selectExpr("id AS exec_id"))
    bad = Compiler(from_dict({"name": "n", "steps": [{"name": "s", "activity": "no", "store": "x"}]}), r).compile(spark.range(1).selectExpr("id AS exec_id"))
    assert bad.executions.first().error.Error == "own"
    parse = from_dict({"name": "p", "inputs": [{"name": "t"}], "outputs": [{"name": "x"}], "steps": [{"name": "s", "activity": "json", "parameters": {"operation": "parse", "data": "${inputs.t}"}, "store": "x", "catch": [{"errors": ["all"], "next": "h"}]}, {"name": "h"}]})
    rows = spark.createDataFrame([(1, '{"a": 1}'), (2, "{")], "exec_id long, t string")
    c = Compiler(parse).compile(rows, columns={"t": "t"})
    assert {x.exec_id: x.at_step for x in c.branches.collect()} == {1: "s", 2: "h"}


def test_checkpoints(spark, tmp_path):
    for store in (RN.MemoryCheckpoints(), RN.FileCheckpoints(str(tmp_path / "a")), RN.FileCheckpoints(str(tmp_path / "b"), spark)):
        state = {"branches": {"main": {"wake_at": 100.0}}, "status": "suspended", "start": 5.0, "checkpoint_at": 9.0}
        store.save("r", state)
        state["branches"].clear()
        store.pause("r", "main", "why", now=40.0)
        store.pause("r", "main", "again", now=50.0)
        assert store.load("r")["branches"]["main"] == {"wake_at": None, "paused": True, "pause_reason": "why", "remaining": 60.0}
        store.unpause("r", "main", now=1000.0)
        assert store.load("r")["branches"]["main"]["wake_at"] == 1060.0 and store.list() == ["r"]
        with pytest.raises(LookupError):
            store.pause("r", "other")
        held = [True]
        claim = RN.Claim("r", "w", 1)
        fenced = claim.checkpoints(store, lambda c: held[0])
        fenced.save("r", {"n": 1})
        held[0] = False
        with pytest.raises(RN.LeaseLost):
            fenced.save("r", {"n": 2})
        assert fenced.load("r") == {"n": 1}
        store.save("s", {"status": "completed", "start": 7.0, "end": 8.5})
        if isinstance(store, RN.FileCheckpoints):
            assert [(x["id"], x["seconds"]) for x in store.summaries()] == [("s", 1.5), ("r", None)]
        store.delete("r")
        with pytest.raises(LookupError):
            store.load("r")
    assert RN.NoCheckpoints().list() == []


def test_progress(spark):
    seen = []
    t = RN.ProgressTracker("e", seen.append)
    t.before("step", "a")
    t.report("a", "half", {"n": "1"})
    t.after("step", "a", 0.1, ValueError("no"))
    t.before("step", "a")
    t.after("step", "a", 0.1, None)
    t.before("step", "a")
    rows = t.frame(spark).orderBy("updated_at").collect()
    assert [(r.status, r.attempt) for r in rows] == [("running", 1), ("running", 1), ("failed", 1), ("running", 2), ("completed", 2), ("running", 1)]
    assert rows[1].detail.Message == "half" and len(seen) == 6
    last = R.latest_progress(t.frame(spark), ["execution_id", "step_name", "branch_id"], ["updated_at"])
    assert last.count() == 1


def test_worker_configuration():
    assert RN.WorkerConfig().concurrency == 10
    for bad in ({"stale_after": 30.0}, {"webhooks": True}, {"concurrency": 0}):
        with pytest.raises(ValueError):
            RN.WorkerConfig(**bad)


def test_worker_runs_what_it_claims():
    queue = [RN.Claim(f"r{i}", "w", 1) for i in range(7)]
    ended, events, refunds, most, now = {}, [], [], [0], [0]
    lock = threading.Lock()

    def claim(n):
        with lock:
            got, queue[:n] = queue[:n], []
        return got

    def handler(c):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.02)
        with lock:
            now[0] -= 1
        if c.run_id == "r3":
            raise ValueError("no")
        if c.run_id == "r4":
            raise RN.LeaseLost(c.run_id)
        return worker.completed(id=c.run_id)

    def finish(c, r):
        ended[c.run_id] = r
        return c.run_id != "r5"

    def debit(c):
        if c.run_id == "r1":
            raise OSError("the ledger is away")

    store = worker.Store(claim, lambda c: True, finish, debit, lambda c, e: events.append((c.run_id, e)), lambda c: refunds.append(c.run_id))
    w = worker.Worker(store, handler, RN.WorkerConfig(concurrency=2, claim_every=0.05))
    t = threading.Thread(target=w.loop)
    t.start()
    for _ in range(200):
        if len(ended) == 6 and not w.running:
            break
        time.sleep(0.02)
    w.stop.set()
    w.wake.notify()
    t.join(5)
    assert not t.is_alive() and most[0] == 2
    assert {k: r.status for k, r in ended.items()} == {f"r{i}": "failed" if i == 3 else "completed" for i in (0, 1, 2, 3, 5, 6)}
    assert refunds == ["r3"] and ("r3", "run.failed") in events and ("r5", "run.completed") not in events
    assert [str(e) for e in w.errors] == ["the ledger is away"]


def test_loops():
    wake, ran = durable.Wake(), []
    done = threading.Event()

    def body():
        ran.append(1)
        if len(ran) == 1:
            raise ValueError("no")
        done.set()

    t, stop = durable.reap_loop(body, 60, wake)
    time.sleep(0.1)
    wake.notify()
    wake.notify()
    assert done.wait(5) and [str(e) for e in wake.errors] == ["no"]
    stop.set()
    wake.notify()
    t.join(5)
    assert not t.is_alive()


def test_tables_by_parts(spark, tmp_path):
    schema = "k string, t int, v string"
    write = durable.upsert_progress(str(tmp_path / "p"), ["k"], ["t"], parts=4, keep=1)
    assert durable.progress_table(spark, str(tmp_path / "p")) is None
    for i in range(4):
        for _ in range(2):  # a batch may come again
            write(spark.createDataFrame([(f"k{j}", i, f"v{i}") for j in range(i, 10)], schema), i)
    got = {r.k: r.v for r in durable.progress_table(spark, str(tmp_path / "p")).collect()}
    assert got == {f"k{j}": f"v{min(j, 3)}" for j in range(10)}
    once = durable.append_once(str(tmp_path / "o"), ["k"], parts=4)
    for i in (0, 0, 1, 1, 0):
        once(spark.createDataFrame([(f"k{j}", i, "") for j in range(5 * i, 5 * i + 7)], schema), i)
    rows = spark.read.parquet(str(tmp_path / "o")).collect()
    assert sorted(r.k for r in rows) == sorted(f"k{j}" for j in range(12))


def test_retention(spark, tmp_path):
    path = str(tmp_path / "events")
    spark.sql("SELECT id, TIMESTAMP '2020-01-01 00:00:00' + make_dt_interval(0, CAST(id AS INT)) AS created_at FROM range(10)").write.parquet(path)
    for _ in range(2):
        durable.retain(spark, dt.datetime(2020, 1, 1, 4), path)
        assert sorted(r.id for r in spark.read.parquet(path).collect()) == [4, 5, 6, 7, 8, 9]


def test_files_have_modes(spark, tmp_path):
    f = Files(spark)
    f.write(str(tmp_path / "x" / "y"), "a", mkdirs=True, mode="0600")
    f.append(str(tmp_path / "x" / "y"), "b")
    assert f.read(str(tmp_path / "x" / "y")) == "ab" and (tmp_path / "x" / "y").stat().st_mode & 0o777 == 0o600
    f.write(str(tmp_path / "z"), "a", mode="rwx")
    assert (tmp_path / "z").stat().st_mode & 0o777 == 0o644


def test_runs_by_identifier(spark):
    r = spark.sql("SELECT 'a' AS id, 'o' AS org_id, CAST(NULL AS BINARY) AS checkpoint UNION ALL SELECT 'b', NULL, CAST('s' AS BINARY)")
    assert R.fetch(r, "o", "a").id == "a" and R.checkpoint_of(r, "b") == b"s"
    for f in (lambda: R.fetch(r, "p", "a"), lambda: R.checkpoint_of(r, "a"), lambda: R.checkpoint_of(r, "z")):
        with pytest.raises(R.NotFound):
            f()


def test_activity_log_table(spark, tmp_path):
    spark.sql(f"CREATE TABLE IF NOT EXISTS log_t ({tables.ACTIVITY_LOG}) USING parquet LOCATION '{tmp_path}/log'")
    row = spark.sql("SELECT '' AS id, 'e' AS execution_id, 'a' AS activity, 's' AS step_name, 'main' AS branch_id, '{}' AS parameters, '1' AS result, '' AS error, TIMESTAMP '2020-01-01 00:00:00' AS start_time, 0.5D AS duration")
    for _ in range(2):
        tables.insert_log(row, "log_t")
    assert tables.history_of(spark.table("log_t"), "e").select("id").distinct().count() == 2
    spark.sql("DROP TABLE log_t")


def test_command_line(spark, tmp_path, capsys):
    d = {"name": "c", "inputs": [{"name": "p"}, {"name": "by", "default": 2}], "outputs": [{"name": "x"}], "steps": [{"name": "s", "activity": "noop", "parameters": {"v": "${inputs.p * inputs.by}"}, "store": "x"}]}
    (tmp_path / "d.json").write_text(json.dumps(d))
    spark.range(3).write.parquet(str(tmp_path / "t"))
    args = [str(tmp_path / "d.json"), "--rows", str(tmp_path / "t"), "--key", "id", "--column", "p=id", "--input", "by=3", "--out", str(tmp_path / "o")]
    assert cli.main(args) == 0
    assert sorted(r.x for r in spark.read.parquet(str(tmp_path / "o")).collect()) == [0, 3, 6]
    assert cli.main([str(tmp_path / "d.json"), "--input", "p=4"]) == 0 and "completed" in capsys.readouterr().out
    assert cli.main([str(tmp_path / "d.json"), "--input", "q=4"]) == 2 and cli.main([str(tmp_path / "none.json")]) == 2
    (tmp_path / "f.json").write_text(json.dumps({"name": "f", "steps": [{"name": "s", "activity": "fail"}]}))
    assert cli.main([str(tmp_path / "f.json")]) == 1
