import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import runs as R
from loomgraph.sources import external, generated, tables
from loomgraph.sources.files import Files
from loomgraph.streaming import durable

T0 = dt.datetime(2024, 1, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


@pytest.fixture(scope="module")
def runs(spark):
    rows = [dict(id=i, status=s, attempt=a, claimed_by=w, heartbeat_at=at(h), created_at=at(c), completed_at=None, started_at=None, org_id=o, definition_type=t, credit_cost=k, metadata=m, error_message="") for i, s, a, w, h, c, o, t, k, m in [
        ("r1", "queued", 0, "", 0, 1, "org-1", "a", 5, {"k": "v1"}), ("r2", "running", 1, "w", 0, 2, "org-1", "b", 5, {"k": "v2"}), ("r3", "running", 3, "w", 0, 3, "org-1", "a", 0, {"k": "v1"}), ("r4", "queued", 0, "", 0, 1, "org-2", "a", 5, {}), ("r5", "failed", 1, "", 0, 5, None, "a", 5, None)]]
    return spark.createDataFrame(rows, "id string, status string, attempt int, claimed_by string, heartbeat_at timestamp, created_at timestamp, completed_at timestamp, started_at timestamp, org_id string, definition_type string, credit_cost int, metadata map<string,string>, error_message string").cache()


def status(df):
    return {r.id: r.status for r in df.collect()}


def test_listing(runs):
    assert R.count(runs, "org-1", R.RunFilter(definition_type="a")).first().n == 2
    assert R.count(runs, "org-1", R.RunFilter(metadata={"k": "v1"})).first().n == 2
    page, cursor = R.paged(runs, "org-1", R.RunFilter(limit=2))
    assert [r.id for r in page] == ["r3", "r2"]
    page, cursor = R.paged(runs, "org-1", R.RunFilter(limit=2, cursor=cursor))
    assert [r.id for r in page] == ["r1"] and cursor is None
    assert R.get(runs, "", "r5").count() == 1 and R.get(runs, "org-2", "r5").count() == 0


def test_queue(spark, runs):
    claimed = R.claim(runs, "me", at(9)).where("id = 'r1'").first()
    assert (claimed.status, claimed.claimed_by, claimed.attempt) == ("running", "me", 1)
    assert status(R.claim(runs, "me", at(9)))["r4"] == "queued"
    assert status(R.reclaim(runs, at(1), 3))["r2"] == "queued" and status(R.reclaim(runs, at(1), 3, ["r2"]))["r2"] == "running"
    assert [r.id for r in R.dead_letters(runs, at(1), 3).collect()] == ["r3"]
    assert status(R.dead_letter(runs, at(1), 3, at(9)))["r3"] == "failed"
    assert status(R.complete(runs, R.fence("r2", "w", 1), "completed", at(9)))["r2"] == "completed"
    assert status(R.complete(runs, R.fence("r2", "w", 2), "completed", at(9)))["r2"] == "running"
    assert R.delete(runs, "org-1", "r2").count() == 5 and R.delete(runs, "org-1", "r1").count() == 4
    assert [R.deletion(runs, "org-1", x) for x in ("r1", "r2", "zz")] == ["", "running", "missing"]
    new = spark.createDataFrame([("r1",), ("r9",), ("r9",)], "id string")
    assert R.enqueue(runs, new, skip=True).count() == 6
    assert R.enqueue(runs, new.where("id = 'r9'").distinct()).count() == 6
    for bad in (new.where("id = 'r1'"), new.where("id = 'r9'")):
        with pytest.raises(Exception, match="a run has the id"):
            R.enqueue(runs, bad).count()


def test_ledger(spark, runs):
    failed = runs.where("id = 'r5'").unionByName(runs.where("id = 'r4'").withColumn("status", F.lit("failed")))
    ledger = spark.createDataFrame([("o", "r5", 5, "debit"), ("o", "r4", 5, "debit"), ("o", "r4", -5, "refund")], "org_id string, run_id string, amount int, reason string")
    assert [r.id for r in R.refund_pending(failed, ledger).collect()] == ["r5"]
    assert R.balance_of(ledger, "o").first().balance == 5 and R.balance_of(ledger, "none").first().balance == 0
    new = ledger.limit(1).withColumn("id", F.lit("x"))
    assert R.once(ledger, new).count() == 3


def test_outbox_and_progress(spark):
    box = spark.createDataFrame([("a", "pending", 4, at(1), ""), ("b", "pending", 0, at(0), ""), ("c", "done", 0, at(0), "")], "id string, status string, attempts int, created_at timestamp, error_message string")
    assert [r.id for r in R.pending(box, 1).collect()] == ["b"]
    got = {r.id: (r.status, r.attempts) for r in R.failed_attempt(box, F.col("status") == "pending", "e").collect()}
    assert got == {"a": ("failed", 5), "b": ("pending", 1), "c": ("done", 0)}
    sent = []
    assert durable.deliver(lambda r: sent.append(r["id"]))(R.pending(box)) == [("b", "delivered", 1, ""), ("a", "delivered", 5, "")]
    prog = spark.createDataFrame([("e", "s", 1, "running"), ("e", "s", 2, "completed"), ("e", "s", 3, "running"), ("e", "t", 1, "x")], "exec string, step string, t int, status string")
    assert {(r.step, r.status) for r in R.latest_progress(prog, ["exec", "step"], ["t"]).collect()} == {("s", "running"), ("t", "x")}
    tries = R.attempts(prog, ["exec", "step"], ["t"], F.col("status") == "completed").where("step = 's'").orderBy("t").collect()
    assert [r.attempt for r in tries] == [1, 2, 1]


def test_branches(spark):
    b = spark.createDataFrame([(1, "a", "completed"), (1, "b", "completed"), (2, "a", "completed"), (2, "b", "failed"), (3, "a", "paused"), (3, "b", "suspended")], "e int, branch_id string, status string")
    assert {r.e: r.final_status for r in R.final_status(b, "e").collect()} == {1: "completed", 2: "failed", 3: "paused"}
    assert [r.e for r in R.ready_by_name(b, "e", ["a", "b"]).collect()] == [1]
    assert {r.e: r.failed for r in R.buckets(b, "e", "branch_id").collect()} == {1: [], 2: ["b"], 3: []}


def test_diff_and_patch(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("z", None)], "k string, v int")
    b = spark.createDataFrame([("x", 1), ("y", 3), ("w", None)], "k string, v int")
    p = R.state_diff(a, b, "k", "v")
    assert {(r.k, r.change) for r in p.collect()} == {("y", "modify"), ("z", "delete"), ("w", "add")}
    assert sorted(map(tuple, R.patched(a, p, "k", "v").collect())) == sorted(map(tuple, b.collect()))


def test_tables(spark, tmp_path):
    log = spark.createDataFrame([("", "e", "a", "s", "b", "{}", "1", "", at(1), 0.5)], tables.ACTIVITY_LOG)
    tables.append_log(tables.with_log_ids(log), str(tmp_path / "log"))
    tables.append_log(tables.with_log_ids(log), str(tmp_path / "log"))
    assert tables.history_of(tables.read_log(spark, str(tmp_path / "log")), "e").select("id").distinct().count() == 2
    cps = spark.createDataFrame([("e", n, 1, "running", "{}", at(0), None, at(n)) for n in (1, 2)], tables.CHECKPOINTS)
    tables.save_checkpoints(cps, str(tmp_path / "cp"))
    back = spark.read.parquet(str(tmp_path / "cp"))
    assert tables.latest_checkpoints(back).first().number == 2
    assert tables.execution_summaries(back).first().micros == 2_000_000
    assert tables.without_execution(back, "e").count() == 0
    with pytest.raises(Exception, match="unknown checkpoint version"):
        tables.latest_checkpoints(back.withColumn("schema_version", F.lit(9))).collect()
    tables.nowhere(log)


def test_files(spark, tmp_path):
    f, p = Files(spark), f"file://{tmp_path}/d/x.txt"
    with pytest.raises(FileNotFoundError):
        f.write(p, "a")
    f.write(p, "é", mkdirs=True)
    f.append(p, "b")
    f.mkdir(f"file://{tmp_path}/d/sub")
    assert f.read(p) == "éb" and [n for n in f.list(f"file://{tmp_path}/d") if not n.startswith(".")] == ["sub/", "x.txt"]
    assert f.exists(p)
    f.delete(p)
    assert not f.exists(p)
    with pytest.raises(FileNotFoundError):
        f.delete(p)


def test_external(spark):
    df = spark.createDataFrame([(1, ["echo", "hi"]), (2, ["false"])], "id int, args array<string>")
    got = {r.id: (r.stdout, r.exit_code, r.success) for r in external.shell(df).collect()}
    assert got == {1: ("hi\n", 0, True), 2: ("", 1, False)}
    bad = external.request("http://127.0.0.1:9/", timeout=1)
    assert not bad["success"] and bad["error"]


def test_generated(spark):
    g = generated
    r = spark.range(300).select(g.number(1, 3).alias("n"), g.real(2, 3).alias("x"), g.string(6).alias("s"), g.hexadecimal().alias("h"), g.choice(["a", "b"]).alias("c"), g.boolean().alias("b"), g.several(g.uuid, 3).alias("u"), g.clock().alias("t")).collect()
    assert {x.n for x in r} == {1, 2, 3} and all(2 <= x.x < 3 and len(x.s) == 6 and len(x.h) == 8 and len(set(x.u)) == 3 for x in r)
    assert {x.c for x in r} == {"a", "b"} and {x.b for x in r} == {True, False} and len({x.s for x in r}) > 250
    with pytest.raises(ValueError):
        g.choice([])


# streams


def stream(spark, tmp_path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def finish(q):
    assert q.awaitTermination(120)


def test_signal_waits(spark, tmp_path):
    schema = "exec_id long, topic string, kind string, payload string, ts timestamp, timeout_ms long"
    rows = [[(1, "t", "signal", "early", at(0), None)], [(1, "t", "wait", None, at(1), 0), (2, "t", "wait", None, at(1), 0)], [(2, "t", "signal", "a", at(2), None), (2, "t", "signal", "b", at(3), None)], [(2, "t", "wait", None, at(4), 0)]]
    rows.append([(3, "t", "wait", None, at(5), 1)])
    q = durable.signal_waits(stream(spark, tmp_path, rows, schema)).writeStream.format("memory").queryName("waits").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    for _ in range(120):  # the timer goes off in a later batch, which comes without data
        got = sorted((r.exec_id, r.outcome, r.payload) for r in spark.table("waits").collect())
        if len(got) == 4:
            break
        time.sleep(0.5)
    q.stop()
    assert got == [(1, "received", "early"), (2, "received", "a"), (2, "received", "b"), (3, "timeout", None)]


def test_upsert_and_append_once(spark, tmp_path):
    schema = "k string, t int, v string"
    batches = [[("a", 1, "x")], [("a", 2, "y"), ("b", 1, "z")]]
    s = stream(spark, tmp_path, batches, schema)
    write = durable.upsert_progress(str(tmp_path / "out"), ["k"], ["t"])
    finish(s.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    assert {(r.k, r.v) for r in durable.progress_table(spark, str(tmp_path / "out")).collect()} == {("a", "y"), ("b", "z")}
    once = durable.append_once(str(tmp_path / "led"), ["k"])
    for i, b in enumerate([batches[0], batches[1], batches[1]]):
        once(spark.createDataFrame(b, schema), min(i, 1))
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "led")).collect()) == ["a", "b"]


def test_windowed_counts(spark, tmp_path):
    e = stream(spark, tmp_path, [[(1, at(0)), (1, at(30)), (1, at(70))]], "u int, ts timestamp_ntz")
    q = durable.windowed_counts(e, "ts", "1 minute", "1 minute", "u").writeStream.format("memory").queryName("win").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    finish(q)
    assert sorted(r.n for r in spark.table("win").collect()) == [1, 2]
