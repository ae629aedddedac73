"""Schemas of the stored tables, and their readers and writers: definitions, checkpoints, activity logs, runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUNS = "id string, spec binary, status string, attempt int, claimed_by string, heartbeat_at timestamp, checkpoint binary, result binary, error_message string, created_at timestamp, started_at timestamp, completed_at timestamp, org_id string, project_id string, parent_run_id string, definition_type string, initiated_by string, credit_cost int, callback_url string, metadata map<string,string>"
STEP_PROGRESS = "execution_id string, step_name string, branch_id string, status string, activity string, attempt int, detail struct<Message:string,Data:map<string,string>>, started_at timestamp, finished_at timestamp, error string, updated_at timestamp"
ACTIVITY_LOG = "id string, execution_id string, activity string, step_name string, branch_id string, parameters string, result string, error string, start_time timestamp, duration double"
EVENTS = "seq bigint, run_id string, event_type string, attempt int, worker_id string, step_name string, payload string, created_at timestamp"
TRIGGERS = "id string, parent_run_id string, child_spec string, status string, attempts int, error_message string, child_run_id string, created_at timestamp, processed_at timestamp"
LEDGER = "id string, org_id string, run_id string, definition_type string, amount int, reason string, created_at timestamp"
WEBHOOKS = "id string, run_id string, url string, event_type string, payload string, status string, attempts int, last_error string, created_at timestamp, delivered_at timestamp"
CHECKPOINTS = "execution_id string, number bigint, schema_version int, status string, state string, start_time timestamp, end_time timestamp, checkpoint_at timestamp"
TABLES = {"runs": RUNS, "step_progress": STEP_PROGRESS, "activity_log": ACTIVITY_LOG, "events": EVENTS, "triggers": TRIGGERS, "ledger": LEDGER, "webhooks": WEBHOOKS}


def bootstrap(spark: SparkSession, prefix: str = "") -> None:
    """Creates the tables that aren't there yet."""
    for name, schema in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {prefix}{name} ({schema}) USING parquet")


def emptied_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """The upgrade of old rows: empty texts become NULL."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in columns})


def scan_runs(df: DataFrame) -> DataFrame:
    """The columns that a listing shows: without spec, checkpoint and result, NULL texts as empty ones."""
    texts = ["org_id", "project_id", "parent_run_id", "initiated_by", "claimed_by", "error_message", "callback_url"]
    hidden = {"spec", "checkpoint", "result"}
    return df.select(*(F.coalesce(c, F.lit("")).alias(c) if c in texts else F.col(c) for c in df.columns if c not in hidden))


def read_definitions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("definition"))


# checkpoints as a table


def save_checkpoints(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("execution_id").parquet(path)


def latest_checkpoints(df: DataFrame, known: int = 1) -> DataFrame:
    """The newest snapshot of each execution; a schema version that isn't 1..known is an error when it is read."""
    last = df.groupBy("execution_id").agg(F.max_by(F.struct(*(c for c in df.columns if c != "execution_id")), "number").alias("x")).select("execution_id", "x.*")
    return last.withColumn("schema_version", F.when(F.col("schema_version").between(1, known), F.col("schema_version")).otherwise(F.raise_error(F.lit("unknown checkpoint version")).cast("int")))


def execution_summaries(df: DataFrame) -> DataFrame:
    """A row for each execution with its duration in microseconds (to the checkpoint if it hasn't ended), newest first."""
    last = latest_checkpoints(df)
    end = F.coalesce("end_time", "checkpoint_at")
    return last.select("execution_id", "status", "start_time", F.timestamp_diff("MICROSECOND", F.col("start_time"), end).alias("micros")).orderBy(F.desc("start_time"), "execution_id")


def without_execution(df: DataFrame, execution_id: str) -> DataFrame:
    return df.where(~F.col("execution_id").eqNullSafe(F.lit(execution_id)))


# activity logs


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ACTIVITY_LOG).json(path)


def insert_log(rows: DataFrame, table: str) -> None:
    """Appends entries to a table of the catalogue, with keys of their own where they have none."""
    spark = rows.sparkSession
    with_log_ids(rows).select(*spark.table(table).columns).write.insertInto(table)


def history_of(log: DataFrame, execution_id: str) -> DataFrame:
    return log.where(F.col("execution_id") == execution_id).orderBy("start_time", "id")


def with_log_ids(log: DataFrame) -> DataFrame:
    """A surrogate key, so that no two entries share one."""
    return log.withColumn("id", F.coalesce(F.nullif("id", F.lit("")), F.uuid()))


def nowhere(df: DataFrame) -> None:
    """The sink that drops all: for plans that are run for their effect on metrics alone."""
    df.write.format("noop").mode("overwrite").save()
